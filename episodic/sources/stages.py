"""Tables that are built when they are missing or out of date, and a results table that can be written again.

``Stages`` keeps each table below a folder of its name and fingerprint.  The
fingerprint is a hash of the stage's name and parameters, of the files of its
inputs and of the fingerprints of the stages it is made from.  A table counts
as built once its record is there; the record is written to another name and
renamed, so an interrupted stage leaves none and is built again.

``VersionedTable`` holds partitions in versions.  A write adds a version and
then a record that says which partitions it replaces; readers take each
partition from the last record that names it.  Writing the same partitions
again replaces them, and a write that was interrupted is never read.

All files are reached by the cluster's file systems.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "built.json"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_record(spark: SparkSession, path: str, content: dict) -> None:
    """A small JSON file that appears whole or not at all."""
    fs, target = _path(spark, path)
    _, own = _path(spark, f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(own, True)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(own, target):
        raise OSError(f"{path} couldn't be written")


def read_record(spark: SparkSession, path: str) -> dict | None:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def files_print(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of all files below a path."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        name = s.getPath().toString()
        if not name.rpartition("/")[2].startswith(("_", ".")):
            found.append((name, s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


class Stages:
    """Builds tables below ``folder`` at most once for the same inputs; ``built`` names those that this object had to build."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.prints: dict[str, str] = {}
        self.built: list[str] = []

    def table(self, name: str, make: Callable[[], DataFrame], *, inputs: Sequence[str] = (), parameters: Mapping | None = None,
              after: Sequence[str] = (), partition_by: Sequence[str] = ()) -> DataFrame:
        """The stage's table, from its files where they are current.

        ``inputs`` are paths that ``make`` reads, ``after`` names earlier stages
        of this object that it is made from.
        """
        missing = [a for a in after if a not in self.prints]
        if missing:
            raise KeyError(f"{name} is made from stages that weren't asked for before it: {missing}")
        basis = {"name": name, "parameters": dict(parameters or {}), "inputs": {p: files_print(self.spark, p) for p in inputs},
                 "after": {a: self.prints[a] for a in after}, "partition_by": list(partition_by)}
        own = hashlib.sha256(json.dumps(basis, sort_keys=True, default=str).encode()).hexdigest()[:20]
        self.prints[name] = own
        path = f"{self.folder}/{name}/{own}"
        if read_record(self.spark, f"{path}/{RECORD}") is None:
            df = make()
            writer = df.write.mode("overwrite")  # what an interrupted attempt left goes
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data")
            write_record(self.spark, f"{path}/{RECORD}", basis)
            self.built.append(name)
        return self.spark.read.parquet(f"{path}/data")


class VersionedTable:
    """A table partitioned by ``keys`` (strings or whole numbers) whose partitions are replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _records(self) -> list[dict]:
        fs, p = _path(self.spark, f"{self.path}/records")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
        return [read_record(self.spark, f"{self.path}/records/{n}") for n in names]

    def replace(self, df: DataFrame, note: str = "") -> None:
        """Writes ``df``; its partitions take the place of earlier ones.  ``note`` is kept in the record."""
        number, version = len(self._records()), uuid.uuid4().hex[:12]
        df.write.partitionBy(*self.keys).parquet(f"{self.path}/data/version={version}")
        written = self.spark.read.parquet(f"{self.path}/data/version={version}")
        parts = [list(r) for r in written.select(*self.keys).distinct().collect()]  # one row a partition
        write_record(self.spark, f"{self.path}/records/{number:08d}-{version}.json", {"version": version, "partitions": parts, "note": note})

    def live(self) -> dict[tuple, str]:
        """The version that each partition is read from."""
        return {tuple(p): r["version"] for r in self._records() for p in r["partitions"]}

    def notes(self) -> set[str]:
        return {r["note"] for r in self._records()}

    def read(self) -> DataFrame:
        """All current partitions; the choice of versions prunes folders."""
        live = self.live()
        if not live:
            raise FileNotFoundError(f"{self.path} holds no finished write")

        def chosen(part: tuple, version: str) -> Column:
            return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self.keys, part, strict=True)], F.col("version") == version)

        every = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/version={v}" for v in sorted(set(live.values()))])
        return every.where(reduce(lambda a, b: a | b, [chosen(p, v) for p, v in live.items()])).drop("version")

    def drop_superseded(self) -> int:
        """Deletes versions that no current partition is read from, unfinished ones too; how many."""
        keep = set(self.live().values())
        fs, p = _path(self.spark, f"{self.path}/data")
        if not fs.exists(p):
            return 0
        old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().removeprefix("version=") not in keep]
        for q in old:
            fs.delete(q, True)
        return len(old)
