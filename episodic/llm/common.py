"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters of text worked on at a time inside a task.
SLICE_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parallelism(df: DataFrame) -> int:
    """Partitions to deal rows to: the session's shuffle setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def local_path(uri: str) -> str:
    """``file:`` URIs as plain paths; other URIs are returned unchanged."""
    return re.sub(r"^file:/+", "/", uri)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that a slice holds about ``limit`` bytes of text.

    Null texts become empty; a single text longer than the limit is a slice of its own.
    """
    i = batch.schema.get_field_index(column)
    batch = batch.set_column(i, column, pc.fill_null(batch.column(i).cast(pa.string()), ""))
    sizes = pc.binary_length(batch.column(i)).to_pylist()
    start = size = 0
    for k, n in enumerate(sizes):
        if k > start and size + n > limit:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if len(sizes) > start:
        yield batch.slice(start)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """Gives freed memory back to the system when a task ends: a reused worker keeps only what it still holds."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run
