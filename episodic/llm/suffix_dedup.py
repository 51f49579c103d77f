"""Removal of repeated byte strings by a sparse, range-partitioned suffix array.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else in the corpus is removed.  A suffix array of all suffixes would be several
times the corpus; here suffixes start at anchors that the content chooses, and
only where their order doesn't settle a place do all of its suffixes follow.

Anchors: a string that starts at ``p`` is owned by the place with the smallest
hash of 16 bytes among its first ``length * 8 / 25`` ones.  That depends on the
string alone, so equal strings have the same owner at the same distance.

1. One suffix per anchor, as a sequence of three tokens: the hashes of the next
   two blocks that all strings of the anchor share, then that of the whole
   stretch of its strings.  Spark samples splitters and range-partitions the
   suffixes by their leading tokens; a bucket is sorted by one token at a time
   (only suffixes tied so far go on to the next token) and compared with both
   neighbours, across bucket boundaries too.  A suffix whose neighbour shares
   all three tokens stands in a stretch that occurs twice: all its strings are
   repeated.  One that shares two tokens only is open.
2. All suffixes of the open anchors, 128 bits of the first ``length`` bytes as
   tokens, go through the same operator; ties are repeated strings.

Equal texts are held once, with their number: two of ``length`` bytes or more
lose all, and serve the others as one text.  Stretches shared by many different
texts settle in step 1 and send at most two suffixes a bucket to step 2.  Ties
are cut by a salt, so no bucket has to hold all of a stretch's places.

Defined cases: null text is empty; texts shorter than ``length`` keep all
bytes; repeated rows are repeats of each other (two equal texts of ``length``
bytes or more lose all); ids, null or repeated, are only carried; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import reuse, scratch_table_path
from .common import parallelism, table, text_slices
from .shingles import mixed

GRAM = 16
#: Bytes of text worked on at a time; longer texts are read in overlapping parts.
PART = 4_000_000
_BASE = 0x9E3779B97F4A7C15
KEY = ["k1", "k2"]


def reach_of(length: int) -> int:
    """Places among which the owner of a string is chosen."""
    if length < 2 * GRAM:
        raise ValueError(f"strings start at {2 * GRAM} bytes")
    return max(1, min(length * 8 // 25, length - GRAM))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place on, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    factor, size = _BASE, 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:len(h) - size] * np.uint64(factor) + h[size:]
            factor, size = factor * factor % (1 << 64), 2 * size
    return mixed(h)


def owners(data: np.ndarray, reach: int) -> np.ndarray:
    """For each start the place of the smallest hash among the next ``reach`` ones (the first on ties)."""
    h = gram_hashes(data)
    packed = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        packed = np.minimum(packed[:len(packed) - size], packed[size:])
        size *= 2
    if size < reach:
        rest = reach - size
        packed = np.minimum(packed[:len(packed) - rest], packed[rest:])
    return (packed & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one text: place, first and last start of its strings (each string stays in the text)."""
    starts = len(data) - length + 1
    if starts < 1:
        return (np.zeros(0, np.int64),) * 3
    at = owners(data, reach_of(length))[:starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], starts) - 1


def text_parts(texts: pa.Array, length: int, part: int = PART) -> Iterator[tuple[int, int, memoryview]]:
    """(row, byte offset, bytes) of each text; long ones in parts that overlap by ``length - 1`` bytes."""
    for i, text in enumerate(texts):
        raw = memoryview(text.as_buffer())
        for at in range(0, max(1, len(raw) - length + 1), part):
            yield i, at, raw[at:at + part + length - 1]


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _salt(count: int, n: int) -> pa.Array:
    return pa.array((mixed(np.arange(count, count + n).astype(np.uint64)) >> np.uint64(40)).astype(np.int32))


def sampled_suffixes(texts: DataFrame, length: int, part: int = PART) -> DataFrame:
    """A row per anchor: text key, ``first`` and ``last`` start of its strings, tokens ``t0, t1, t2`` and a salt."""
    import xxhash

    shared = (length - reach_of(length) + 1) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        count = TaskContext.get().partitionId() << 20
        for batch in batches:
            for piece in text_slices(batch):
                rows, firsts, lasts, tokens = [], [], [], [[], [], []]
                for row, offset, raw in text_parts(piece.column("text"), length, part):
                    at, first, last = anchors(np.frombuffer(raw, np.uint8), length)
                    rows += [row] * len(at)
                    firsts.append(first + offset)
                    lasts.append(last + offset)
                    for a, b, c in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                        tokens[0].append(digest(raw[a:a + shared]))
                        tokens[1].append(digest(raw[a + shared:a + 2 * shared]))
                        tokens[2].append(digest(raw[b:c + length], seed=a - b))
                if not rows:
                    continue
                keys = piece.select(KEY).take(pa.array(rows))
                salt = _salt(count, len(rows))
                count += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [*keys.columns, pa.array(np.concatenate(firsts)), pa.array((np.concatenate(lasts) - np.concatenate(firsts)).astype(np.int32)),
                     *(_signed(t) for t in tokens), salt],
                    names=[*KEY, "first", "more", "t0", "t1", "t2", "salt"])

    return texts.mapInArrow(work, "k1 long, k2 long, first long, more int, t0 long, t1 long, t2 long, salt int")


def sort_suffixes(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of token sequences and the tokens each shares with its predecessor, by quicksort on one token at a time.

    Only sequences that are tied with another on all tokens so far are sorted by the next.
    """
    n = len(tokens[0])
    order = np.argsort(tokens[0], kind="quicksort")
    common = np.zeros(n, np.int64)
    tied = np.zeros(n, bool)
    tied[1:] = tokens[0][order[1:]] == tokens[0][order[:-1]]
    common[tied] = 1
    for depth in range(1, len(tokens)):
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        run = np.cumsum(~tied[at])  # a run begins where a sequence isn't tied with its predecessor
        rows = order[at]
        order[at] = rows = rows[np.lexsort((tokens[depth][rows], run))]
        same = tokens[depth][rows[1:]] == tokens[depth][rows[:-1]]
        now = np.zeros(n, bool)
        now[at[1:]] = tied[at[1:]] & same
        common[now] = depth + 1
        tied = now
    return order, common


def neighbours(suffixes: DataFrame, tokens: list[str], carry: list[str], least: int) -> DataFrame:
    """``carry`` with ``before`` and ``after``, the leading tokens shared with the neighbours in the order of all suffixes.

    Suffixes that share fewer than ``least`` tokens with both are left out.  ``suffixes`` has a column ``salt``.
    """
    n = len(tokens)
    dealt = suffixes.select(*carry, *tokens, "salt").repartitionByRange(parallelism(suffixes), *tokens, "salt")
    kinds = dict(suffixes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in carry) + ", before int, after int, bucket int, " + ", ".join(f"{c} long" for c in tokens)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket = pa.Table.from_batches(held).combine_chunks()
        order, before = sort_suffixes([bucket.column(t).to_numpy() for t in tokens])
        after = np.append(before[1:], 0)
        edge = np.zeros(len(order), bool)
        edge[[0, -1]] = True
        keep = np.flatnonzero((np.maximum(before, after) >= least) | edge)
        kept = bucket.take(pa.array(order[keep]))
        number = pa.array(TaskContext.get().partitionId() * 2 + (keep > 0), pa.int32(), mask=~edge[keep])
        sides = [pa.array(x[keep].astype(np.int32)) for x in (before, after)]
        out = [kept.column(c) for c in carry] + sides + [number] + [kept.column(t) for t in tokens]
        yield from pa.table(out, names=[*carry, "before", "after", "bucket", *tokens]).to_batches(100_000)

    near = reuse(dealt.mapInArrow(work, schema), "suffix-order")
    # two rows a bucket: compared with the edges of the buckets beside it
    edges = near.where("bucket is not null")
    order = Window.orderBy("bucket")

    def shared(other) -> Column:
        out = F.lit(n)
        for i in reversed(range(n)):
            out = F.when(other(F.col(tokens[i])) != F.col(tokens[i]), i).otherwise(out)
        return F.when(other(F.col(tokens[0])).isNull(), 0).otherwise(out)

    edges = (edges.withColumn("_b", shared(lambda c: F.lag(c).over(order))).withColumn("_a", shared(lambda c: F.lead(c).over(order)))
             .withColumn("before", F.greatest("before", "_b")).withColumn("after", F.greatest("after", "_a")))
    columns = [*carry, "before", "after"]
    return near.where("bucket is null").select(columns).unionByName(edges.select(columns)).where(F.greatest("before", "after") >= least)


def repeated_starts(texts: DataFrame, length: int, part: int = PART) -> DataFrame:
    """``k1, k2, first, more``: the strings from ``first`` to ``first + more`` on are repeated (each stretch once).

    ``texts`` holds each text once, under its key.
    """
    import xxhash

    found = reuse(neighbours(sampled_suffixes(texts.select(*KEY, "text"), length, part), ["t0", "t1", "t2"], [*KEY, "first", "more"], 2), "anchors")
    settled = found.where(F.greatest("before", "after") == 3).select(*KEY, "first", "more")
    # a suffix beside one that shares two tokens only: open itself, or an end of a run that others must be held against
    opened = (found.where((F.col("before") == 2) | (F.col("after") == 2)).groupBy(*KEY)
              .agg(F.sort_array(F.collect_list(F.struct("first", "more"))).alias("open")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        count = TaskContext.get().partitionId() << 20
        low = (1 << 64) - 1
        for batch in batches:
            for i in range(batch.num_rows):
                raw = memoryview(batch.column("text")[i].as_buffer())
                stretches = batch.column("open")[i].values
                for at in range(0, len(stretches), 2000):
                    part = stretches.slice(at, 2000)
                    each = part.field("more").to_numpy() + 1
                    p = np.repeat(part.field("first").to_numpy() - np.cumsum(each) + each, each) + np.arange(each.sum())
                    h = [digest(raw[x:x + length]) for x in p.tolist()]
                    salt = _salt(count, len(h))
                    count += len(h)
                    keys = [pa.array(np.full(len(h), batch.column(k)[i].as_py(), np.int64)) for k in KEY]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(p), _signed([x >> 64 for x in h]), _signed([x & low for x in h]), salt],
                                                     names=[*KEY, "first", "w0", "w1", "salt"])

    strings = texts.join(opened, KEY).select(*KEY, "text", "open").mapInArrow(work, "k1 long, k2 long, first long, w0 long, w1 long, salt int")
    again = neighbours(strings, ["w0", "w1"], [*KEY, "first"], 2).select(*KEY, "first", F.lit(0).alias("more"))
    return settled.unionByName(again)


def distinct_texts(source: DataFrame) -> DataFrame:
    """Each text once with its number of ``copies``, written in buckets of its key: later joins don't move texts again."""
    spark = source.sparkSession
    path = scratch_table_path(spark, "texts")
    name = "texts_" + path[-12:]
    texts = source.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    texts.write.bucketBy(parallelism(source), *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, length: int = 400, *, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False, part: int = PART) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``spans`` and ``kept``.

    ``spans`` are the removed runs as ``start, end`` in bytes; ``kept`` holds the bytes that remain.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(length), "text"))
    texts = distinct_texts(source.select(*KEY, "text"))
    marks = (repeated_starts(texts, length, part).groupBy(*KEY)
             .agg(F.collect_list(F.struct("first", "more")).alias("runs")))
    tail = ", spans array<struct<start: long, end: long>>, kept binary" if with_text else ""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][:6 if with_text else 4]

    def spans_of(size: int, copies: int, runs: pa.Scalar) -> list[tuple[int, int]]:
        if size < length or copies < 2 and not runs.is_valid:
            return []
        if copies > 1:
            return [(0, size)]
        change = np.zeros(size + 1, np.int32)
        first = runs.values.field("first").to_numpy()
        np.add.at(change, first, 1)
        np.add.at(change, first + runs.values.field("more").to_numpy() + length, -1)
        gone = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
        turn = np.flatnonzero(gone[1:] != gone[:-1])
        return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        for batch in batches:
            rows = []
            for text, copies, runs in zip(batch.column("text"), batch.column("copies").to_pylist(), batch.column("runs"), strict=True):
                raw = memoryview(text.as_buffer())
                spans = spans_of(len(raw), copies, runs)
                ends = [0, *(x for s in spans for x in s), len(raw)]
                kept = [raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]
                sha = hashlib.sha256()
                for k in kept:
                    sha.update(k)
                row = (len(raw), sum(b - a for a, b in spans), len(spans), sha.hexdigest())
                rows.append(row + ([{"start": a, "end": b} for a, b in spans], b"".join(kept)) if with_text else row)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             names=[*KEY, *names])

    results = (texts.join(marks, KEY, "left").select(*KEY, "copies", "text", "runs")
               .mapInArrow(work, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + tail))
    return source.select("doc_id", *KEY).join(results, KEY).select("doc_id", *names)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes covered by a string of 400 bytes that also starts elsewhere."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
ORACLES: dict[str, str] = {}
