"""Exact top-k inner products by a Voronoi join.

Vectors become integers (``floor(scale * x)``).  Every vector belongs to the
cell of its nearest pivot; pivots are a bounded sample and only shape the
cells, never the result.  A cell is cut into parts of bounded size, and a part
has a summary: centre c, radius r around it, largest norm and number of
vectors.  For a query q every vector of the part scores at most
``q.c + |q| r`` (and at most ``|q| * largest norm``) and at least
``q.c - |q| r``, so the summaries alone give each query a floor that at least
k candidates reach: the k-th score by lower bounds, after as many rows more as
the query's own id has.  A query is copied only to
the parts whose upper bound reaches its floor, parts are solved locally, and
the k best of the parts' answers remain.

Sums stay exact in int64.  Ties go to the smaller id.  Summaries (one row a
part) are broadcast only up to ``MAX_SUMMARIES``; beyond, parts grow so that
their number keeps to that bound.

Defined cases: vectors that are null, empty or hold null or non-finite
components and rows with a null id take no part; vectors of different
dimensions don't meet; a query with fewer candidates than k returns all;
repeated rows are each a candidate of other ids' queries and ask once; rows of
one id with different vectors share one list of k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import reuse
from .common import parallelism, table

PIVOTS = 64
PART_ROWS = 4096
MAX_SUMMARIES = 20_000


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _pivots(good: DataFrame, n: int) -> dict[int, np.ndarray]:
    """At most ``n`` pivots per dimension, those with the smallest hash of the id: a bounded sample."""
    w = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    total = good.groupBy("dim").count().collect()  # one row per dimension
    keep = None
    for r in total:  # a hash threshold first, so that the window sorts few rows
        share = min(1.0, 20.0 * n / r["count"])
        cond = (F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        keep = cond if keep is None else keep | cond
    if keep is None:
        return {}
    out: dict[int, list] = {}
    for r in good.where(keep).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).collect():
        out.setdefault(r["dim"], []).append(r["v"])
    return {d: np.array(v, np.float64) for d, v in out.items()}


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, pivots: int = PIVOTS, part_rows: int = PART_ROWS,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows whose id is divisible by ``every`` against all other rows."""
    v = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).where(
        "vec_id is not null and x is not null and size(x) > 0 "
        "and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('Infinity'))")
    good = good.select("vec_id", F.expr(f"transform(x, e -> cast(floor({scale} * e) as long))").alias("v"), F.size("x").alias("dim"))
    good = reuse(good, "integer-vectors")
    centres = _pivots(good, pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = _matrix(batch.column("v").take(pa.array(rows)), len(rows)).astype(np.float64)
                p = centres[int(d)]
                cell[rows] = np.argmin((p * p).sum(axis=1) - 2 * (x @ p.T), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("dim"), pa.array(cell)],
                                             names=["vec_id", "v", "dim", "cell"])

    celled = good.mapInArrow(nearest, "vec_id long, v array<long>, dim int, cell int")
    celled = reuse(celled.withColumn("row", F.monotonically_increasing_id()), "cells")
    sizes = celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rows = max(part_rows, -(-total // (MAX_SUMMARIES // 2)))
    parts = sizes.select("dim", "cell", F.ceil(F.col("n") / rows).alias("cuts"))
    data = celled.join(parts, ["dim", "cell"]).select(
        "vec_id", "v", "dim", F.concat_ws("/", "dim", "cell", F.pmod(F.xxhash64("row"), F.col("cuts"))).alias("part"))
    data = reuse(data, "parts")

    # summaries by partial sums: centre, then the radius around it
    sums = data.select("part", "dim", F.posexplode("v").alias("i", "e")).groupBy("part", "dim", "i").agg(F.avg("e").alias("c"))
    centre = sums.groupBy("part", "dim").agg(F.expr("transform(array_sort(collect_list(struct(i, c))), s -> s.c)").alias("c"))
    radius = (data.join(F.broadcast(centre), ["part", "dim"])
              .select("part", "dim", "c", F.expr("aggregate(zip_with(v, c, (a, b) -> (a - b) * (a - b)), 0d, (s, e) -> s + e)").alias("r2"),
                      F.expr("aggregate(v, 0d, (s, e) -> s + cast(e as double) * e)").alias("n2")))
    summary = radius.groupBy("part", "dim").agg(F.first("c").alias("c"), F.sqrt(F.max("r2")).alias("r"), F.sqrt(F.max("n2")).alias("norm"),
                                                F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    spark = vectors.sparkSession
    if not summary:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_dim = {}
    for s in summary:  # at most MAX_SUMMARIES rows and one more for each cell
        by_dim.setdefault(s["dim"], []).append(s)
    bounds = {d: (np.array([s["c"] for s in g]), np.array([s["r"] for s in g]), np.array([s["norm"] for s in g]),
                  np.array([s["n"] for s in g]), [s["part"] for s in g]) for d, g in by_dim.items()}
    shared = spark.sparkContext.broadcast(bounds)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, dims, own = (batch.column(c).to_pylist() for c in ("vec_id", "dim", "own"))
            for i, (name, d, mine) in enumerate(zip(names, dims, own, strict=True)):
                c, r, norm, n, part = shared.value[d]
                q = np.array(batch.column("v")[i].as_py(), np.float64)
                size = np.linalg.norm(q)
                slack = 1e-6 * (1 + size * norm)
                middle = c @ q
                high = np.minimum(middle + size * r, size * norm) + slack
                low = np.maximum(middle - size * r, -size * norm) - slack
                order = np.argsort(-low)
                reached = np.cumsum(n[order]) >= k + mine  # all rows of the query's id may be among them
                floor = low[order][np.argmax(reached)] if reached.any() else -np.inf
                to = [part[t] for t in np.flatnonzero(high >= floor)]
                m = len(to)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.string()), pa.array([name] * m, pa.int64()), pa.array([batch.column("v")[i].as_py()] * m, pa.list_(pa.int64()))],
                    names=["part", "vec_id", "v"])

    asking = data.where(F.pmod("vec_id", F.lit(every)) == 0)
    own = asking.groupBy("vec_id", "dim").agg(F.count(F.lit(1)).alias("own"))
    asked = asking.select("vec_id", "v", "dim").distinct().join(own, ["vec_id", "dim"])
    routed = asked.mapInArrow(route, "part string, vec_id long, v array<long>")
    both = routed.select("part", F.lit(True).alias("asks"), "vec_id", "v").unionByName(
        data.select("part", F.lit(False).alias("asks"), "vec_id", "v"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts one after another, each one's data before its queries."""
        now, held_ids, held, names, x = None, [], [], None, None
        for batch in batches:
            part = batch.column("part").to_pylist()
            asks = batch.column("asks").to_pylist()
            at = 0
            while at < len(part):
                end = at
                while end < len(part) and part[end] == part[at] and asks[end] == asks[at]:
                    end += 1
                rows = batch.slice(at, end - at)
                if part[at] != now:
                    now, held_ids, held, names = part[at], [], [], None
                ids, v = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), end - at)
                if not asks[at]:
                    held_ids.append(ids)
                    held.append(v)
                    names = None
                elif held:
                    if names is None:
                        names, x = np.concatenate(held_ids), np.concatenate(held)
                        order = np.argsort(names, kind="stable")
                        names, x = names[order], x[order]
                    for cut in range(0, len(ids), 128):
                        yield _best(ids[cut:cut + 128], v[cut:cut + 128], names, x, k)
                at = end

    dealt = both.repartition(parallelism(vectors), "part").sortWithinPartitions("part", "asks")
    local = dealt.mapInArrow(solve, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(ids: np.ndarray, q: np.ndarray, names: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """Each query's k best rows of a part whose names ascend, without rows of its own id."""
    small = max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(q).max(initial=0))) * x.shape[1] < 1 << 53
    score = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if small else q @ x.T
    out_q, out_v, out_s = [], [], []
    for i, name in enumerate(ids):
        s = score[i]
        usable = names != name
        n = int(usable.sum())
        if not n:
            continue
        if n > k:
            cut = np.partition(s[usable], n - k)[n - k]
            usable &= s >= cut
        at = np.flatnonzero(usable)
        at = at[np.lexsort((names[at], -s[at]))][:k]
        out_q += [name] * len(at)
        out_v += names[at].tolist()
        out_s += s[at].tolist()
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.int64())],
                                      names=["query_id", "vec_id", "score"])


def op3_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th embedding against all others, five best."""
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_knn_join": op3_knn_join}
ORACLES = {"op3_knn_join": """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(q.v) = len(d.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""}
