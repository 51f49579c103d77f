"""Near-duplicate vectors by int8 tile products with per-vector error bounds.

Vectors of one label are dealt to blocks of bounded size, and each pair of
blocks is one tile.  A unit vector x is kept as s*q with int8 q; with
e = x - s*q a tile's product errs by at most |s*q|*|e'| + |e|, so only pairs
whose product plus that bound reaches the threshold are computed again in
double precision from the original components.  A tile reports for each
vector its number of links and the smallest vector it is linked with inside
the tile: never a pair list.  int8 products run as float32 matrix products,
exact while 127*127*dimension < 2**24 (1,040 dimensions; longer vectors are
summed by chunks).

The comparison of all rows of a label is quadratic by contract.  A tile holds
two blocks; the blocks' number grows with the label, so a hot label gives more
tiles, not larger ones.  Vectors of different dimensions never link.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing; rows with the same
vec_id are separate vectors with one component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reuse
from .common import parallelism, table
from .components import components

BLOCK_ROWS = 2048
STRIP = 256
CHUNK = 1024  # dimensions summed exactly by one float32 product


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 parts, scales, norms of the rounded vectors and norms of the errors of unit rows."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    near = q * s[:, None]
    return q, s, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, a.shape[1], CHUNK):
        out += a[:, at:at + CHUNK].astype(np.float32) @ b[:, at:at + CHUNK].astype(np.float32).T
    return out


def link_tile(raw_a: np.ndarray, raw_b: np.ndarray, names_a: np.ndarray, names_b: np.ndarray, threshold: float,
              same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Links of a tile: counts of both sides, roots of both sides (smallest name linked inside), pairs computed again.

    ``same``: both sides are one block; a vector isn't linked with itself.
    """
    norm_a, norm_b = np.sqrt((raw_a * raw_a).sum(axis=1)), np.sqrt((raw_b * raw_b).sum(axis=1))
    qa, sa, na, ea = quantise(raw_a / norm_a[:, None])
    qb, sb, _, eb = quantise(raw_b / norm_b[:, None])
    count_a, count_b = np.zeros(len(raw_a), np.int64), np.zeros(len(raw_b), np.int64)
    names, index = np.unique(np.concatenate([names_a, names_b]), return_inverse=True)
    root = np.arange(len(names))
    ia, ib = index[:len(names_a)], index[len(names_a):]
    again = 0
    for at in range(0, len(qa), STRIP):
        rows = slice(at, min(at + STRIP, len(qa)))
        near = _products(qa[rows], qb) * sa[rows, None] * sb
        bound = na[rows, None] * eb + ea[rows, None] + 1e-9
        i, j = np.nonzero(near + bound >= threshold)
        if same:
            keep = i + at != j
            i, j = i[keep], j[keep]
        again += len(i)
        for cut in range(0, len(i), 1 << 16):
            k, m = i[cut:cut + (1 << 16)] + at, j[cut:cut + (1 << 16)]
            cos = np.einsum("ij,ij->i", raw_a[k], raw_b[m]) / (norm_a[k] * norm_b[m])
            hit = cos >= threshold
            k, m = k[hit], m[hit]
            count_a += np.bincount(k, minlength=len(qa))
            if not same:
                count_b += np.bincount(m, minlength=len(qb))
            _union(root, ia[k], ib[m])
    return count_a, count_b, names[_settled(root)[ia]], names[_settled(root)[ib]], again


def _settled(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(root, root[root]):
        root[:] = root[root]
    return root


def _union(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins u[i] with v[i] in a forest whose roots are the smallest members."""
    while len(u):
        _settled(root)
        a, b = root[u], root[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def usable(vector: str) -> str:
    """SQL condition: every component is there and finite, and one isn't zero."""
    return (f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) "
            f"and exists({vector}, x -> x != 0)")


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.93, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.col(label_col).alias("label"))
    rows = rows.withColumn("row", F.xxhash64("vec_id", F.col("v").cast("string"), F.col("label").cast("string")))
    good = rows.where(f"label is not null and vec_id is not null and {usable('v')}")
    good = reuse(good.select("vec_id", "v", F.xxhash64("label", F.size("v")).alias("grp"), "row"), "vectors")

    sizes = good.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    dealt = good.join(sizes, "grp").withColumn("block", F.pmod("row", F.col("blocks")))
    # block k meets itself and every other one: as the first side of tile (k, m) for k <= m, as the second for m < k
    tiles = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "grp", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        (F.col("block") > F.col("other")).alias("is_second"), "vec_id", "v")

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        for batch in batches:
            flag = batch.column("is_second").to_numpy(zero_copy_only=False)
            names = batch.column("vec_id").to_numpy()
            v = batch.column("v")
            flat = v.flatten().to_numpy().reshape(len(names), -1)
            for f in (False, True):
                side[f][0].append(names[flag == f])
                side[f][1].append(flat[flag == f])
        names_a, a = np.concatenate(side[False][0]), np.concatenate(side[False][1])
        same = key[1].as_py() == key[2].as_py()
        names_b, b = (names_a, a) if same else (np.concatenate(side[True][0]), np.concatenate(side[True][1]))
        if not len(a) or not len(b):
            return
        count_a, count_b, root_a, root_b, _ = link_tile(a, b, names_a, names_b, threshold, same)
        found = [(names_a, count_a, root_a)] + ([] if same else [(names_b, count_b, root_b)])
        for names, count, root in found:
            linked = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(count[linked]), pa.array(root[linked])],
                                             names=["vec_id", "n", "root"])

    found = tiles.repartition(parallelism(vectors), "grp", "first", "second").groupBy("grp", "first", "second").applyInArrow(
        work, "vec_id long, n long, root long")
    found = reuse(found, "tile-links")
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    return _result(rows, good, found, groups)


def _result(rows: DataFrame, good: DataFrame, found: DataFrame, groups: DataFrame) -> DataFrame:
    # rows that share a vec_id share its links: their counts are those of the id's vectors, dealt evenly
    copies = good.groupBy("vec_id").agg(F.count(F.lit(1)).alias("copies"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n")).join(copies, "vec_id")
    counts = counts.select("vec_id", F.expr("n div copies").alias("n_links"))
    out = rows.select("vec_id").join(counts, "vec_id", "left").join(
        groups.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, cosine 0.93 within a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
ORACLES = {"op2_embedding_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM good UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(cnt.n, 0) AS n_links, coalesce(comp.c, e.vec_id) AS component_id,
       coalesce(comp.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp ON comp.a = e.vec_id LEFT JOIN cnt ON cnt.a = e.vec_id
"""}
