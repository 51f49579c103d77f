"""Sources and sinks: fixed-width text, definition layouts, CSV with strict
row checks, column-name cleaning, table loads, materialised and appended
tables, per-year result folders.

All writes go to caller-given paths; ``scratch_path`` derives one under the
session's shared ``spark.checkpoint.dir`` (never a machine-local folder).
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import clean_strings
from ..session import scratch_table_path, reuse

# ------------------------------------------------------------ paths


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return scratch_table_path(spark, name)


class MissingInputError(FileNotFoundError):
    pass


def require_inputs(spark: SparkSession, paths: Iterable[str]) -> None:
    """Stop before a stage when a required input is absent (Hadoop FS check,
    so it works for any cluster file system)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).exists(path):
            missing.append(p)
    if missing:
        raise MissingInputError(f"missing inputs: {missing}")


def exists(spark: SparkSession, path: str) -> bool:
    try:
        require_inputs(spark, [path])
        return True
    except MissingInputError:
        return False


# ------------------------------------------------------------ A1-A3 fixed width


def read_fixed_width(spark: SparkSession, path: str, layout: Sequence[tuple[str, int, int]],
                     one_based: bool = True, strip: str | None = "?") -> DataFrame:
    """Cut every text line by ``(column, start, length)``; values trimmed,
    ``strip`` characters removed, empty -> NULL.  All columns are strings."""
    return cut_fixed_width(spark.read.text(path), layout, one_based, strip)


def cut_fixed_width(lines: DataFrame, layout: Sequence[tuple[str, int, int]], one_based: bool = True,
                    strip: str | None = "?", value: str = "value") -> DataFrame:
    off = 0 if one_based else 1
    cols = [F.trim(F.substring(F.col(value), int(s) + off, int(n))).alias(c) for c, s, n in layout]
    out = lines.select(*cols)
    return clean_strings(out, strip or "", empty_to_null=True) if strip is not None else out


def layout_from_definition(lines: DataFrame, line_no: str = "line_no", text: str = "text") -> DataFrame:
    """Definition lines (CSV text) -> ``(column, start, length)``.

    Drops the header line (lowest line number) and rows starting with
    ``Name,``, squeezes runs of spaces, turns spaces into ``_`` and keeps
    fields 2, 4 and 5.
    """
    first = lines.agg(F.min(line_no)).first()[0]
    body = lines.where(F.col(line_no) != F.lit(first))
    norm = F.translate(F.regexp_replace(F.col(text), " {2,}", " "), " ", "_")
    parts = F.split(norm, ",")
    return (body.select(line_no, norm.alias("_n"), parts.alias("_p"))
            .where(~F.col("_n").startswith("Name,"))
            .select(line_no, F.col("_p")[1].alias("column"), F.col("_p")[3].cast("int").alias("start"),
                    F.col("_p")[4].cast("int").alias("length")))


# ------------------------------------------------------------ A4-A6 CSV

# one quoting rule for both directions: quotes double inside quotes, rows may span lines
CSV_RULE = {"quote": '"', "escape": '"', "multiLine": "true", "header": "true"}


def read_csv_checked(spark: SparkSession, path: str, bad_records: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header: NUL bytes removed, ``''`` -> NULL, rows with fewer
    fields than the header dropped, rows with more written to ``bad_records``
    as text.  Values stay strings unless ``schema`` says otherwise.

    Spark's reader marks rows of another length as corrupt; only those are
    looked at again, to tell long from short.
    """
    names = [c.translate({0: None}).strip() for c in spark.read.options(**CSV_RULE).csv(path).columns]
    wanted = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupt"]])
    rows = spark.read.options(**CSV_RULE, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE").schema(wanted).csv(path)
    rows = reuse(rows, "csv")  # parsed once for both kinds of rows
    odd = rows.where(F.col("_corrupt").isNotNull()).select(F.translate("_corrupt", "\u0000", "").alias("value"))
    # an unquoted empty field is read as NULL and must count as a field here
    cells = F.from_csv(F.regexp_replace("value", r",(?=,|$)", ",x"), ", ".join(f"`_{i}` STRING" for i in range(len(names) + 1)),
                       {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    odd.where(cells[f"_{len(names)}"].isNotNull()).write.mode("overwrite").text(bad_records, lineSep="\n")
    good = rows.where(F.col("_corrupt").isNull())
    text = good.select(*[F.nullif(F.translate(F.col(f"`{c}`"), "\u0000", ""), F.lit("")).alias(c) for c in names])
    if schema is None:
        return text
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_RULE).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.options(**CSV_RULE)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


# Characters removed from column names, then double underscores.
NAME_CHARS = ".#-()&/: "


def clean_name(name: str) -> str:
    for ch in NAME_CHARS:
        name = name.replace(ch, "")
    return name.replace("__", "")


def clean_column_names(df: DataFrame) -> DataFrame:
    """Rename every column by ``clean_name``; fail if two names collide."""
    new = [clean_name(c) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"cleaned column names collide: {new}")
    return df.toDF(*new)


# ------------------------------------------------------------ A7-A9, A12-A16 tables


def load_tables(spark: SparkSession, src_dir: str, names: Sequence[str], dst_dir: str,
                fmt: str = "parquet") -> dict[str, str]:
    """Read each named input and (re)write it as Parquet under ``dst_dir``."""
    out = {}
    for name in names:
        src = os.path.join(src_dir, f"{name}.{fmt}")
        df = spark.read.format(fmt).load(src) if fmt != "csv" else read_csv(spark, src)
        dst = f"{dst_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(dst)
        out[name] = dst
    return out


def materialise(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    """Write a query result (replacing what was there) and read it back --
    lineage is cut at a durable table.  A query that reads ``path`` itself is
    refused: overwriting would delete its input first."""
    if mode == "overwrite" and any(f.split(":", 1)[-1].lstrip("/").startswith(path.split(":", 1)[-1].lstrip("/").rstrip("/") + "/")
                                   for f in df.inputFiles()):
        raise ValueError(f"the query reads {path}, which it would overwrite")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialise_all(spark: SparkSession, tables: Sequence[tuple[str, DataFrame]], base: str) -> dict[str, DataFrame]:
    """Write a list of (name, DataFrame) in order; later ones may read earlier."""
    return {name: materialise(df, f"{base.rstrip('/')}/{name}") for name, df in tables}


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_years(spark: SparkSession, path: str, years: Sequence[int], year_col: str = "year") -> DataFrame:
    """Stack per-year results: one partitioned read, the year filter prunes
    partitions (no per-file driver loop)."""
    return spark.read.parquet(path).where(F.col(year_col).isin(*[int(y) for y in years]))
