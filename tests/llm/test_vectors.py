"""Embedding near-duplicates and the Voronoi join against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.llm import embedding_dedup, knn_join

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "n_links string, vec_id long, embedding array<float>, label int, row int"


def by_sql(frame, sql, tmp_path):
    frame.select("vec_id", "embedding", "label").write.mode("overwrite").parquet(str(tmp_path / "e"))
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/e/*.parquet')")
        return sorted(map(tuple, c.execute(sql).fetchall()))


def vectors(spark, n=240, dim=12, seed=3):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(n // 8, dim))
    rows = []
    for i in range(n):
        v = centres[g.integers(len(centres))] + g.normal(size=dim) * g.choice([0.0, 0.05, 0.25])
        rows.append(("x", i, [float(x) for x in v.astype(np.float32)], int(g.choice([0, 0, 0, 1, 2])), 0))
    odd = [None, [0.0] * dim, [NAN] + [1.0] * (dim - 1), [INF] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [], [1.0, 2.0], [1.0, 2.1]]
    rows += [("x", n + k, v, 0, 0) for k, v in enumerate(odd)]
    rows += [("x", n + 20, rows[0][2], None, 0), ("x", n + 21, rows[0][2], rows[0][3], 0), ("x", n + 22, rows[0][2], rows[0][3], 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("block", [16, 4096])
def test_near_duplicates_equal_sql(spark, tmp_path, block):
    frame = vectors(spark)
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame, block_rows=block).collect())
    assert got == by_sql(frame, embedding_dedup.ORACLES["op2_embedding_dedup"], tmp_path)
    assert sum(r[1] > 0 for r in got) > 50


def test_near_duplicates_repeated_ids_and_empty(spark):
    frame = spark.createDataFrame([("x", 7, [1.0, 0.0], 1, 0), ("x", 7, [1.0, 0.0], 1, 0), ("x", 5, [1.0, 0.01], 1, 0), ("x", None, [1.0, 0.0], 1, 0)], SCHEMA)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()), key=str)
    assert got == [(5, 2, 5, True), (7, 2, 5, False), (7, 2, 5, False), (None, 0, None, True)]
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_error_bounds_hold():
    g = np.random.default_rng(5)
    x = g.normal(size=(300, 40)) * np.exp(g.normal(size=(300, 40)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, near, err = embedding_dedup.quantise(x)
    product = embedding_dedup._products(q, q) * s[:, None] * s
    assert (np.abs(product - x @ x.T) <= near[:, None] * err + err[:, None] + 1e-12).all()


def test_few_pairs_are_computed_again():
    g = np.random.default_rng(6)
    x = g.normal(size=(400, 64))
    *_, again = embedding_dedup.link_tile(x, x, np.arange(400), np.arange(400), 0.93, True)
    assert again < 400  # of 160,000


@pytest.mark.parametrize("part_rows", [10, 4096])
def test_knn_equals_sql(spark, tmp_path, part_rows):
    frame = vectors(spark, n=500)
    got = sorted(tuple(r) for r in knn_join.top_k(frame, part_rows=part_rows, pivots=9).collect())
    assert got == by_sql(frame, knn_join.ORACLES["op3_knn_join"], tmp_path)


def test_knn_ties_few_candidates_and_empty(spark):
    rows = [("x", i, [1.0, 0.5], 0, 0) for i in (0, 50, 7, 3)] + [("x", 100, [2.0], 0, 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit(1))
    got = sorted(tuple(r) for r in knn_join.top_k(frame).collect())
    score = 256 * 256 + 128 * 128
    assert got == [(0, 1, 3, score), (0, 2, 7, score), (0, 3, 50, score), (50, 1, 0, score), (50, 2, 3, score), (50, 3, 7, score)]
    assert knn_join.top_k(frame.where("false")).count() == 0


def test_knn_repeated_query_ids(spark, monkeypatch):
    """Rows of the query's own id neither make up its floor nor stay together in one part."""
    g = np.random.default_rng(8)
    rows = [("x", 0, [100.0, 0.0], 0, 0)] * 6 + [("x", 50, [0.0, 60.0 + float(x)], 0, 0) for x in g.normal(size=100)]
    rows += [("x", 51 + i, [float(a), float(b)], 0, 0) for i, (a, b) in enumerate(g.normal(size=(49, 2)))]
    frame, sizes, reuse = spark.createDataFrame(rows, SCHEMA), [], knn_join.reuse

    def spy(df, name):
        out = reuse(df, name)
        if name == "parts":
            sizes.extend(r["count"] for r in out.groupBy("part").count().collect())
        return out

    monkeypatch.setattr(knn_join, "reuse", spy)
    got = sorted(tuple(r) for r in knn_join.top_k(frame, part_rows=10, pivots=64).collect())
    q = {i: {tuple(int(np.floor(256 * x)) for x in np.float32(v)) for _, j, v, *_ in rows if j == i} for i in (0, 50, 100)}
    data = [(j, [int(np.floor(256 * x)) for x in np.float32(v)]) for _, j, v, *_ in rows]
    want = []
    for i in q:
        if any(j == i for j, _ in data):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for v in q[i] for j, w in data if j != i)[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    assert got == want and len(want) >= 10
    assert max(sizes) < 40
