"""The tree grower against trees grown in plain Python, and its use for deep and random families."""

import math
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from episodic.operators import models as M
from episodic.operators import trees as T


def plain_tree(rows, names, max_depth, min_split, path="", depth=0):
    """``{path: (n, positives, feature, threshold)}`` of the best gini tree over all values."""
    n, s = len(rows), sum(y for _, y in rows)
    out = {path: (n, s, None, None)}
    if s in (0, n) or n < min_split or depth == max_depth:
        return out
    best = None
    for f in names:
        values = sorted({x[f] for x, _ in rows})
        for v in values[:-1]:
            left = [y for x, y in rows if x[f] <= v]
            l, p = len(left), sum(left)
            after = round(2 * p * (l - p) / l + 2 * (s - p) * (n - l - s + p) / (n - l), 9)
            if best is None or (after, f, v) < best:
                best = (after, f, v)
    if best is None:
        return out
    _, f, v = best
    out[path] = (n, s, f, v)
    for side, turn in ((True, "0"), (False, "1")):
        out |= plain_tree([r for r in rows if (r[0][f] <= v) == side], names, max_depth, min_split, path + turn, depth + 1)
    return out


def frame(spark, rows):
    data = [(i, y, Vectors.sparse(len(x), {k: float(v) for k, v in enumerate(x) if v}) if i % 2 else Vectors.dense(x)) for i, (x, y) in enumerate(rows)]
    return spark.createDataFrame(data, ["id", "label", "features"])


def some_rows(n=300, seed=2):
    g = random.Random(seed)
    out = []
    for _ in range(n):
        x = [float(g.randrange(-3, 4)), float(g.random() < 0.2), g.choice([0.0, 0.5, 2.5]), 1.0]
        out.append((x, int(g.random() < 0.15 + 0.5 * (x[0] > 0) + 0.3 * x[1])))
    return out


def test_best_tree_equals_plain_one(spark):
    rows = some_rows()
    nodes = T.grow(frame(spark, rows).select("id", "label", T.entries("features").alias("x")), T.TreeSettings(max_depth=6, min_samples_split=5))
    want = plain_tree(rows, range(4), 6, 5)
    values = [sorted({x[f] for x, _ in rows}) for f in range(4)]
    got = {r.path: (r.n, int(r.s), r.feature, r.threshold) for r in nodes.collect()}
    for path, (n, s, f, v) in want.items():
        assert got[path][:3] == (n, s, f)
        if f is not None:
            assert got[path][3] == (v + values[f][values[f].index(v) + 1]) / 2
    assert set(got) == set(want)


def test_deep_trees_are_grown_deep(spark):
    rows = [([float(i)], i % 2) for i in range(36)]
    data = frame(spark, rows)
    scores, model = M.fit_and_score("DT", {"max_depth": 50, "min_samples_split": 2, "criterion": "gini"}, data, data, ["id", "label"])
    assert model.nodes.agg(F.max("depth")).first()[0] > 30
    deep = {r.path: r.n for r in model.nodes.collect()}
    assert all(len(p) <= 50 for p in deep)
    got = {r.id: (r.label, r.score) for r in scores.collect()}
    assert len(got) == 36 and sum(abs(y - s) for y, s in got.values()) < 9


def test_random_thresholds_cover_the_range_and_repeat(spark):
    rows = some_rows(400, 5)
    data = frame(spark, rows).select("id", "label", T.entries("features").alias("x"))
    settings = T.TreeSettings(n_trees=12, max_depth=2, splitter="random", max_features=1, seed=4)
    first = sorted((r.tree, r.path, r.feature, r.threshold) for r in T.grow(data, settings).where("feature is not null").collect())
    again = sorted((r.tree, r.path, r.feature, r.threshold) for r in T.grow_forest(data.repartition(7), settings, lot=5).where("feature is not null").collect())
    assert first == again and len({(f, t) for _, _, f, t in first}) > 6


def test_many_values_share_bins_consistently(spark):
    g = random.Random(9)
    rows = [([g.gauss(0, 1)], 0) for _ in range(500)]
    rows = [(x, int(x[0] + g.gauss(0, 0.3) > 0.2)) for x, _ in rows]
    data = frame(spark, rows).select("id", "label", T.entries("features").alias("x"))
    nodes = T.grow(data, T.TreeSettings(max_depth=4, max_bins=16))
    held = {r.path: r.n for r in T.leaves(data, nodes, ["id"]).groupBy("path").agg(F.count("*").alias("n")).collect()}
    want = {r.path: r.n for r in nodes.where("feature is null").collect()}
    assert held == want  # rows scored by thresholds fall where they were grown by bins


def test_random_forest_families_and_boosting(spark):
    rows = some_rows(300, 8)
    data = frame(spark, rows)
    for name, params in (("ET", {"n_estimators": 4, "max_depth": 4, "max_features": "sqrt", "criterion": "entropy", "random_state": 0}),
                         ("RF", {"n_estimators": 3, "max_depth": 40, "max_features": "log2", "min_samples_split": 20, "random_state": 0}),
                         ("GB", {"n_estimators": 3, "max_depth": 31, "learning_rate": 0.5, "subsample": 1.0, "random_state": 0})):
        assert M.is_grown(name, params)
        scores, model = M.fit_and_score(name, params, data, data, ["id", "label"])
        got = scores.collect()
        assert len(got) == 300 and all(0 <= r.score <= 1 for r in got)
        loss = sum(-math.log(max(1e-9, r.score if r.label else 1 - r.score)) for r in got) / 300
        base = sum(y for _, y in rows) / 300
        assert loss < -(base * math.log(base) + (1 - base) * math.log(1 - base))
        shares = M.feature_importance(name, model, ["a", "b", "c", "d"])
        assert shares.importance.sum() == pytest.approx(1.0) and shares.feature[0] == "a"


def test_raw_units(spark):
    rows = some_rows(200, 3)
    raw = spark.createDataFrame([(i, y, *x[:2]) for i, (x, y) in enumerate(rows)], "id long, label int, a double, b double")
    scaled = raw.withColumn("x", F.create_map(F.lit(0), (F.col("a") + 3) / 6, F.lit(1), F.col("b")))
    nodes = T.grow(scaled, T.TreeSettings(max_depth=4))
    scales = spark.createDataFrame([(0, "a", -3.0, 3.0), (1, "b", None, None)], "feature int, name string, low double, high double")
    named = raw.withColumn("x", F.create_map(F.lit("a"), "a", F.lit("b"), "b"))
    by_raw = {r.id: r.score for r in T.forest_scores(named, T.in_raw_units(nodes, scales), ["id"], feature="name").collect()}
    assert by_raw == {r.id: r.score for r in T.forest_scores(scaled, nodes, ["id"]).collect()}


def test_bins_are_found_without_moving_rows(spark):
    data = spark.createDataFrame([(1, {0: -1.0, 3: 2.0}), (2, {0: 4.0, 9: 1.0}), (3, {}), (4, {3: 9.0})], "id int, x map<int,double>")
    bins = spark.createDataFrame([(0, [-1.0, 0.0, 3.0], [-1.0, 0.0, 1.0], 1), (3, [0.0, 2.0], [0.0, 2.0], 0)],
                                 "feature int, highs array<double>, lows array<double>, zero int")
    coded = T.apply_bins(data, bins, "id")
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.b for r in coded.collect()} == {1: {0: 0, 3: 1}, 2: {0: 2}, 3: {}, 4: {3: 1}}
    got = T.apply_bins(data, bins, "id", pack=True).select("id", F.explode(F.array(F.lit(0), F.lit(3))).alias("f"), "b")
    zero = F.when(F.col("f") == 0, 1).otherwise(0)
    got = {(r.id, r.f): r.bin for r in got.select("id", "f", T.bin_in("b", "f", zero).alias("bin")).collect()}
    assert got == {(1, 0): 0, (1, 3): 1, (2, 0): 2, (2, 3): 0, (3, 0): 1, (3, 3): 0, (4, 0): 1, (4, 3): 1}


def test_subtrees_equal_levels(spark, monkeypatch):
    """A tree grown level by level to its leaves, one whose small nodes are grown in a task, and one grown there whole are the same; so are the scores."""
    rows = some_rows(400, 6)
    data = frame(spark, rows).select("id", "label", T.entries("features").alias("x"))
    kinds = [T.TreeSettings(n_trees=3, max_depth=5, max_features=2, bootstrap=True, seed=3, first_tree=4),
             T.TreeSettings(n_trees=2, splitter="random", max_features=1, criterion="entropy", seed=5), T.TreeSettings(max_depth=3, criterion="squared")]
    for settings in kinds:
        grown = []
        for most in (40, 10_000) if settings.max_depth is None else (1, 10_000):
            monkeypatch.setattr(T, "SUBTREE_ROWS", most)
            nodes = T.grow(data, settings)
            grown.append(sorted((r.tree, r.path, r.depth, r.n, round(r.s, 9), r.feature, r.threshold, r.gain and round(r.gain, 6)) for r in nodes.collect()))
        assert grown[0] == grown[1] and len(grown[0]) > 6
        if settings.max_depth is None:
            continue
        near = {(r.id, r.tree): (r.path, r.n, r.s) for r in T.leaves(data, nodes, ["id"]).collect()}
        joined = {(r.id, r.tree): (r.path, r.n, r.s) for r in T.leaves_by_joins(data, nodes, ["id"]).collect()}
        assert near == joined and len(near) == 400 * settings.n_trees


def test_few_jobs_grow_a_deep_tree(spark):
    """A random tree took several jobs a level, bagging MLlib's levels of all nodes; nodes below a task's rows take one job together."""
    rows = [([float(i), float(i * 7 % 64)], i * 5 % 3 % 2) for i in range(600)]
    data = frame(spark, rows)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "deep")
    scores, model = M.fit_and_score("BAG", {"n_estimators": 3, "random_state": 0}, data, data, ["id", "label"])
    got = scores.collect()
    jobs = len(tracker.getJobIdsForGroup("deep"))
    spark.sparkContext._jsc.clearJobGroup()
    assert model.nodes.agg(F.max("depth")).first()[0] > 8 and jobs < 60
    assert len(got) == 600 and sum(abs(r.label - r.score) for r in got) < 150  # bagged trees know their own rows
    assert M.feature_importance("BAG", model, ["a", "b"]) is None
