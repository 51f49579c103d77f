"""Session helpers: build a local session for tests and benches, read the
driver tables, and find the shared checkpoint folder.

On a cluster the session comes from the caller; nothing here overrides an
existing setting.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session and only falls back to a scratch folder when it is unset (local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "episodic") -> SparkSession:
    """A local session with AQE on and the UI off (tests, bench)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def recommended_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for the input (what a cluster submit would pass).

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (at least two waves of the cores); AQE coalesces small ones and
    splits skewed join partitions at run time.  Returned, never applied to a
    running session.
    """
    parts = max(2 * cores, input_bytes // target_partition_bytes)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir``.  Only a local master (tests, the bench)
    gets a scratch folder when it is unset; on a cluster an unset folder is
    an error, because executors cannot share a machine-local path.  Never
    used for ``localCheckpoint``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        conf = tempfile.mkdtemp(prefix="episodic-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    import uuid

    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/episodic-tables/{name}-{uuid.uuid4().hex[:12]}"


def reuse(df: DataFrame, name: str = "reuse") -> DataFrame:
    """Materialise a frame that feeds several branches of one plan.

    One job writes it as Parquet below the shared ``spark.checkpoint.dir``
    and the branches read the files back: the frame is computed once, lineage
    is cut at durable files (a lost executor re-reads them instead of
    recomputing the whole lineage), and ``Dataset.checkpoint``'s second
    evaluation of the plan is avoided.
    """
    path = scratch_table_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
