"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents one after another (16 or 32
bits each, little-endian) and two Elias-Fano sequences: where each document's
ids end, and the document ids.  A sequence of n values up to u stores the low
``l = floor(log2(u / n))`` bits of each value packed, and the high parts as a
bit array in unary: about ``2 + l`` bits a value.  ``select`` finds the i-th
set bit from the position of every 512th one and the set bits of the words
behind it, so an offset is read without a table of 64-bit numbers.

Layout: ``TOKEF1\\0\\0``, then little-endian int64: bytes an id, documents,
leading documents without id, first id's offset base; then the two sequences
(boundaries, document ids), then the ids.

Files are written by Spark tasks below a folder that all executors reach, to
a name of the attempt first and then renamed, so a repeated task replaces its
file by an equal one; they are read back by Spark's ``binaryFile`` source.

Defined cases: null text is empty and has only the end id; documents without
id come first; equal ids are ordered by text; an empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table_path
from .common import local_path, parallelism, table, text_slices, tidied
from .pieces import tokenizer_encoder, with_ends

MAGIC = b"TOKEF1\0\0"
SAMPLED = 512
#: Ids after which a task begins its next file.
FILE_IDS = 8_000_000
#: Documents whose boundaries are selected together when a file is read.
READ_TOGETHER = 1024


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        # of every 512th set bit the word and the set bits before that word
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        self.word = np.searchsorted(before, np.arange(0, n, SAMPLED), side="right") - 1
        self.rank = before[self.word]

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-((int(high[-1]) if n else 0) + 1) // 64) * 64, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        low = values & np.uint64((1 << low_bits) - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        packed = np.packbits(((low[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, packed, words)

    def to_bytes(self) -> bytes:
        return struct.pack("<4q", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high = struct.unpack_from("<4q", data, at)
        at += 32
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high * 8, at + n_low).copy().view("<u8")
        return cls(n, low_bits, low, high), at + n_low + n_high * 8

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value, by the sampled position and the words behind it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        w, left = int(self.word[i // SAMPLED]), i - int(self.rank[i // SAMPLED])
        while (held := int(self.high[w]).bit_count()) <= left:
            w, left = w + 1, left - held
        word = int(self.high[w])
        for _ in range(left):
            word &= word - 1
        at = 64 * w + (word & -word).bit_length() - 1
        return ((at - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def select_range(self, i: int, j: int) -> np.ndarray:
        """The values from the i-th up to the j-th: the words between two sampled positions are read, no others."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        k, last = i // SAMPLED, -(-j // SAMPLED)
        first, end = int(self.word[k]), int(self.word[last]) + 1 if last < len(self.word) else len(self.high)
        found = np.flatnonzero(np.unpackbits(self.high[first:end].view(np.uint8), bitorder="little"))
        order = np.arange(i, j)
        at = 64 * first + found[order - int(self.rank[k])]
        return ((at - order).astype(np.int64) << np.int64(self.low_bits)) | self._low(order)


def pack_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, id_bytes: int) -> bytes:
    """The bytes of one file; ``doc_ids`` ascending with nulls first, ``ends`` the ids up to each document's end."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    head = MAGIC + struct.pack("<4q", id_bytes, len(doc_ids), len(doc_ids) - len(known), base)
    payload = ids.astype("<u2" if id_bytes == 2 else "<u4").tobytes()
    return b"".join([head, EliasFano.build(ends).to_bytes(), EliasFano.build(known - base).to_bytes(), payload])


class TokenFile:
    """A file's documents by position: ``ids(k)`` and ``doc_id(k)`` read only what they need."""

    def __init__(self, data: bytes | pa.Buffer):
        view = memoryview(data)
        if view[:8] != MAGIC:
            raise ValueError("not a token file")
        self.id_bytes, self.n, self.unnamed, self.base = struct.unpack_from("<4q", view, 8)
        self.ends, at = EliasFano.read(view, 40)
        self.names, at = EliasFano.read(view, at)
        self.tokens = np.frombuffer(view[at:], "<u2" if self.id_bytes == 2 else "<u4")

    def span(self, k: int) -> tuple[int, int]:
        return self.ends.select(k - 1) if k else 0, self.ends.select(k)

    def ids(self, k: int) -> np.ndarray:
        a, b = self.span(k)
        return self.tokens[a:b].astype("<u4")

    def doc_id(self, k: int) -> int | None:
        return None if k < self.unnamed else self.base + self.names.select(k - self.unnamed)

    def spans(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents from the i-th up to the j-th begin and end."""
        ends = self.ends.select_range(i, j)
        return np.concatenate([[self.ends.select(i - 1) if i else 0], ends[:-1]]), ends

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        none = max(0, min(j, self.unnamed) - i)
        return [None] * none + (self.names.select_range(max(i - self.unnamed, 0), max(j - self.unnamed, 0)) + self.base).tolist()


def _store(folder: str, name: str, data: bytes) -> None:
    """Writes a file in one step: to a name of this attempt, then renamed."""
    from pyarrow import fs

    path = local_path(folder)
    store, path = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1, id_bytes: int = 2,
                      leading_space: bool = False, file_ids: int = FILE_IDS,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises documents in ascending id order into files; one row per file: ``name, n_docs, n_ids``.

    Rows are dealt by ranges of the id (text as tie-break), so a range's task
    tokenises and writes its files alone; ids never pass through a shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parallelism(docs), F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "_tie", "text").select("doc_id", "text")

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer_encoder(tokenizer, leading_space)
        part, file = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        filled = 0

        def flush() -> pa.RecordBatch:
            nonlocal file, filled
            ends = np.cumsum(np.concatenate(sizes))
            name = f"part-{part:06d}-{file:05d}.tok"
            _store(folder, name, pack_file(names, ends, np.concatenate(held), id_bytes))
            row = pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(names)], "n_ids": [filled]})
            file, filled = file + 1, 0
            names.clear(), sizes.clear(), held.clear()
            return row

        for batch in batches:
            for piece in text_slices(batch):
                ids, starts = with_ends(*enc.encode(piece.column("text")), end_id)
                n = len(starts) - 1
                if len(ids) and int(ids.max()) >= 1 << (8 * id_bytes):
                    raise ValueError("an id doesn't fit the file's width")
                names += piece.column("doc_id").to_pylist()
                sizes.append(np.diff(starts))
                held.append(ids.astype("<u2" if id_bytes == 2 else "<u4"))
                filled += len(ids)
                if n and filled >= file_ids:
                    yield flush()
        if names:
            yield flush()

    return dealt.mapInArrow(work, "name string, n_docs long, n_ids long")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the files that the manifest lists: ``doc_id, start, n_tokens, ids_crc32``.

    A file's base is the sum of the ids of all files before it: a window over
    one row per file.
    """
    order = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("name", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    files = (spark.read.format("binaryFile").load(f"{folder}/part-*.tok")
             .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"))

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
                f = TokenFile(content.as_buffer())
                for i in range(0, f.n, READ_TOGETHER):
                    j = min(f.n, i + READ_TOGETHER)
                    starts, ends = f.spans(i, j)
                    crc = [zlib.crc32(f.tokens[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids(i, j), pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (files.join(bases, "name").select("base", "content")
            .mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents by ``word_bpe_49k.json`` and reads the files back."""
    import public_tokenizers

    folder = scratch_table_path(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), f"{folder}/files", public_tokenizers.path("word_bpe_49k.json"))
    manifest.write.parquet(f"{folder}/manifest")
    rows = spark.read.parquet(f"{folder}/manifest")
    if rows.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, f"{folder}/files", rows)


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}
