"""Near-duplicate documents by improved consistent weighted sampling.

A document is its shingles of five words weighted by TF-IDF.  ICWS draws
samples that agree between two documents with the probability of their
weighted Jaccard similarity; 16 bands of 4 samples make the buckets (a pair at
0.8 is missed by all of them with probability 0.0002, at 0.9 by 1e-7).  Pairs
are linked only if the weighted Jaccard similarity of the whole documents is
at least 0.8.

idf = 1 + ln((N + 1) / (max(df, N / 20) + 1)): 1 for a shingle of every
document, 4 for all that are in less than a twentieth.  df is counted over all
documents in one row of a count-min sketch (2**18 counters); its error is the
mean number of distinct shingles of a document over 2**18, as a share of N
(about 0.2 %), at any size.  Only counters above N / 20 matter and are shared
with the tasks: at most 20 times the mean number of shingles of a document.

Work grows with the documents, not with a group's square.  Equal word
sequences are one representative (the smallest id).  In a bucket every
representative is compared with the bucket's smallest one only; what is
linked is one group.  In buckets that still hold more than one group, the
members outside the largest group are then compared with all members of other
groups, in tiles of about ``BLOCK`` of them; tiles report links, never pairs.  So every pair
of a bucket is either compared or already in one group.

Defined cases: null and empty texts and texts without a word have no near
duplicate; texts of fewer than five words are one shingle; rows without an id
are kept with a null class; rows with one id are one document; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reuse
from .common import parallelism, table, text_slices, tidied
from .components import components
from .shingles import Shingles, mixed, shingles

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
COUNTERS = 18  # bits of a counter's number
FREQUENT = 0.05
STAR = 512  # members that one copy of a bucket's smallest document is compared with
BLOCK = 128
MOST_BLOCKS = 1 << 20  # 16 MB
CHUNK = 1 << 16
SLICE_BYTES = 3_000_000  # text whose shingles are held at a time


class Weights:
    """TF-IDF weights; ``frequent`` and ``df`` are the counters above the share ``FREQUENT`` of ``n`` documents."""

    def __init__(self, n: int, frequent: np.ndarray, df: np.ndarray):
        self.frequent = frequent
        self.rare = np.float32(1 + np.log((n + 1) / (FREQUENT * n + 1)))
        self.idf = (1 + np.log((n + 1) / (df + 1.0))).astype(np.float32)

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        counter = (hashes >> np.uint64(64 - COUNTERS)).astype(np.int64)
        out = np.full(len(hashes), self.rare, np.float32)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, counter), len(self.frequent) - 1)
            hit = self.frequent[at] == counter
            out[hit] = self.idf[at[hit]]
        return out * counts.astype(np.float32)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) r and log c, uniform beta: 2**16 triples, and the multiplier that picks a hash's triple for each sample."""
    g = np.random.Generator(np.random.PCG64(20240229))
    m = 1 << 16
    r = g.gamma(2, 1, m).astype(np.float32)
    c = np.log(g.gamma(2, 1, m)).astype(np.float32)
    beta = g.random(m).astype(np.float32)
    odd = g.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    return r, c, beta, odd


def band_keys(s: Shingles, weights: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text and band; texts without shingles get 0."""
    r, c, beta, odd = _draws()
    n = len(s.starts) - 1
    keys = np.zeros((n, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(s.starts))
    at = 0
    while at < len(full):  # texts of about CHUNK shingles together, so that the arrays stay in the cache
        end = at + 1
        while end < len(full) and s.starts[full[end] + 1] - s.starts[full[at]] <= CHUNK:
            end += 1
        texts = full[at:end]
        lo, hi = s.starts[texts[0]], s.starts[texts[-1] + 1]
        h, logw = s.hashes[lo:hi], np.log(weights[lo:hi])
        first = s.starts[texts] - lo
        sizes = np.diff(np.append(first, hi - lo))
        for b in range(BANDS):
            key = np.full(len(texts), b + 1, np.uint64)
            for k in range(b * ROWS, (b + 1) * ROWS):
                with np.errstate(over="ignore"):
                    pick = ((h * odd[k]) >> np.uint64(48)).astype(np.int64)
                    rk, bk = r[pick], beta[pick]
                    t = np.floor(logw / rk + bk)
                    a = c[pick] - rk * (t - bk + 1)
                    least = np.minimum.reduceat(a, first)
                    same = np.flatnonzero(a == np.repeat(least, sizes))
                    owner = np.searchsorted(first, same, side="right") - 1
                    chosen = same[np.append(True, owner[1:] != owner[:-1])]
                    key = mixed(key * np.uint64(31) + (h[chosen] ^ mixed(t[chosen].astype(np.int64).view(np.uint64))))
            keys[texts, b] = key
        at = end
    return keys


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard of two ascending hash lists."""
    if len(ha) > len(hb):
        ha, wa, hb, wb = hb, wb, ha, wa
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    hit = hb[at] == ha
    both = float(np.minimum(wa[hit], wb[at[hit]]).sum(dtype=np.float64))
    return both / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both)


def corpus_weights(docs: DataFrame) -> Weights:
    """Document frequencies over all rows of ``docs`` (``doc_id, text``)."""
    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << COUNTERS, np.int64), 0
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                s = shingles(part.column("text"), SIZE)
                counter = (s.hashes >> np.uint64(64 - COUNTERS)).astype(np.int64)
                # shingles of one text in one counter count once
                one = np.unique(s.text_of() << COUNTERS | counter) & ((1 << COUNTERS) - 1)
                total += np.bincount(one, minlength=1 << COUNTERS)
                rows += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], rows))],
                                         names=["counter", "n"])

    counts = reuse(docs.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")), "df")
    n = counts.where("counter = -1").agg(F.sum("n")).first()[0] or 0
    got = counts.where((F.col("counter") >= 0) & (F.col("n") > FREQUENT * n)).orderBy("counter").collect()  # bounded, see above
    return Weights(n, np.array([x["counter"] for x in got], np.int64), np.array([x["n"] for x in got], np.int64))


def _sketches(docs: DataFrame, weights: Weights) -> DataFrame:
    @tidied
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                s = shingles(part.column("text"), SIZE)
                keys = band_keys(s, weights.of(s.hashes, s.counts))
                none = pa.array(np.diff(s.starts) == 0)
                digest = np.frombuffer(b"".join(s.digests), np.int64).reshape(-1, 2)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), none, bands],
                                                 names=["doc_id", "d1", "d2", "no_words", "bands"])

    return docs.mapInArrow(sketch, "doc_id long, d1 long, d2 long, no_words boolean, bands array<long>")


def _maybe_asked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose id may be asked for, by a blocked Bloom filter, so that the join after it shuffles few texts.

    The filter has at most MOST_BLOCKS words, whatever the number of ids; a fuller one only passes more.
    """
    blocks = max(1, min(MOST_BLOCKS, asked.count() // 4))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    mask = F.lit(0).cast("long")
    for k in range(4):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id, 7), {6 * k}) & 63 as int))"))
    words = asked.groupBy(block.alias("block")).agg(F.bit_or(mask).alias("word"))
    hit = docs.withColumn("block", block).withColumn("mask", mask).join(F.broadcast(words), "block")
    return hit.where("word & mask = mask").select(*docs.columns)


def _links(docs: DataFrame, targets: DataFrame, weights: Weights) -> DataFrame:
    """Links ``a, b`` of the comparisons that ``targets`` (``doc_id, grp, side, comp``) asks for.

    In a group, documents of side 0 are compared with those of side 1, and
    those of side 2 with each other, until their ``comp`` are joined: at most
    one link less than the group has ``comp``.
    """
    asked = reuse(targets.groupBy("doc_id").agg(F.collect_list(F.struct("grp", "side", "comp")).alias("to")), "targets")
    one = _maybe_asked(docs.where("doc_id is not null"), asked).join(asked, "doc_id")

    @tidied
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                s = shingles(part.column("text"), SIZE)
                lists = [pa.ListArray.from_arrays(pa.array(s.starts.astype(np.int32)), pa.array(x))
                         for x in (s.hashes.view(np.int64), s.counts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("to"), *lists], names=["doc_id", "to", "h", "tf"])

    kind = "array<struct<grp:long,side:int,comp:long>>"
    sent = one.select("doc_id", "text", "to").mapInArrow(vectors, f"doc_id long, to {kind}, h array<long>, tf array<int>")
    sent = sent.select("doc_id", "h", "tf", F.explode("to").alias("t")).select("doc_id", "h", "tf", "t.grp", "t.side", "t.comp")
    dealt = sent.repartition(parallelism(docs), "grp").sortWithinPartitions("grp", "side", "doc_id")

    @tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        root: dict[int, int] = {}  # groups that links of this task have joined: further links between them add nothing

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for batch in batches:
            a, b = [], []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "grp", "side", "comp")]
            hs, tfs = batch.column("h"), batch.column("tf")
            for i, (doc, grp, side, comp) in enumerate(zip(*cols, strict=True)):
                if grp != now:
                    now, held = grp, []
                    root.clear()
                h = hs[i].values.to_numpy().view(np.uint64)
                w = weights.of(h, tfs[i].values.to_numpy())
                size = float(w.sum(dtype=np.float64))
                for other, other_comp, oh, ow, other_size in held if side else ():
                    # the smaller sum over the larger bounds the similarity
                    one, two = find(comp), find(other_comp)
                    if one != two and min(size, other_size) >= SIMILARITY * max(size, other_size) and similarity(h, w, oh, ow) >= SIMILARITY:
                        a.append(max(doc, other))
                        b.append(min(doc, other))
                        root[max(one, two)] = min(one, two)
                if side != 1:
                    held.append((doc, comp, h.copy(), w, size))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, kept`` of every row: the class is the smallest id of the near duplicates, which is kept."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weights = corpus_weights(docs)
    sketches = reuse(_sketches(docs, weights), "sketches")
    known = sketches.where("doc_id is not null and not no_words")
    reps = reuse(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "representatives")

    placed = reps.select("rep", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = reuse(placed.join(shared, "key"), "buckets")  # key, rep, leader, n

    star = members.where("rep != leader").select("leader", "rep").distinct()
    cuts = star.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("cuts"))
    group = lambda cut: F.xxhash64("leader", cut).alias("grp")
    followers = star.join(cuts, "leader").select(F.col("rep").alias("doc_id"), group(F.pmod(F.xxhash64("rep"), F.col("cuts"))),
                                                 F.lit(1).alias("side"), F.col("rep").alias("comp"))
    leaders = cuts.withColumn("cut", F.explode(F.expr("sequence(0L, cuts - 1)"))).select(
        F.col("leader").alias("doc_id"), group(F.col("cut")), F.lit(0).alias("side"), F.col("leader").alias("comp"))
    links = reuse(_links(docs, leaders.unionByName(followers), weights), "star-links")
    groups = components(links)

    # buckets that hold several groups still: members outside the bucket's largest group (its minor members) meet all
    # others, in groups of one block of minor members with, at their side, STAR of the largest group or another block
    grouped = members.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("comp"))
    parts = grouped.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("set1"),
                                               F.expr("sum(cast(xxhash64(rep, 1) as decimal(38,0)))").alias("set2"))
    split = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n"),
                                     F.count(F.lit(1)).alias("kinds"), F.expr("bit_xor(set1)").alias("set1"), F.sum("set2").alias("set2"))
    # buckets of several bands with the same members are one; a pair with its smallest document was compared above
    split = split.where("kinds > 1 and n > 2").groupBy("n", "set1", "set2").agg(F.min(F.struct("key", "major", "n_major")).alias("s"), F.first("n").alias("all"))
    split = split.select("s.key", "s.major", F.ceil((F.col("all") - F.col("s.n_major")) / BLOCK).alias("blocks"),
                         F.ceil(F.col("s.n_major") / STAR).alias("cuts"))
    rest = reuse(grouped.join(split, "key"), "split-buckets")
    minor = rest.where("comp != major").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")))
    among = minor.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        F.col("rep").alias("doc_id"), F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("grp"),
        F.expr("case when block = other then 2 when block < other then 0 else 1 end").alias("side"), "comp")
    beside = minor.withColumn("cut", F.explode(F.expr("sequence(0L, cuts - 1)"))).select(
        F.col("rep").alias("doc_id"), F.xxhash64("key", "block", "cut", F.lit("major")).alias("grp"), F.lit(0).alias("side"), "comp")
    major = rest.where("comp = major").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        F.col("rep").alias("doc_id"), F.xxhash64("key", "block", F.pmod(F.xxhash64("rep"), F.col("cuts")), F.lit("major")).alias("grp"),
        F.lit(1).alias("side"), "comp")
    tiles = among.unionByName(beside).unionByName(major)
    tiles = reuse(tiles, "tiles")
    if not tiles.isEmpty():
        links = links.unionByName(reuse(_links(docs, tiles, weights), "tile-links"))
        groups = components(links)

    by_rep = reps.select("d1", "d2", "rep").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("class_id"))
    out = sketches.select("doc_id", "d1", "d2", "no_words").join(by_rep, ["d1", "d2"], "left")
    class_id = F.when(F.col("no_words"), F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("class_id")))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents without all but one of each group of near duplicates, all columns kept."""
    gone = near_duplicates(documents).where("not kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
ORACLES: dict[str, str] = {}
