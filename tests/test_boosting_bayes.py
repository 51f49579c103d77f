"""Boosted stumps and naive Bayes against plain numpy."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors

from episodic.operators import bayes as N
from episodic.operators import boosting as B
from episodic.operators import models as M
from episodic.operators import trees as T


def data(spark, n=240, seed=6):
    g = np.random.default_rng(seed)
    x = np.c_[g.integers(-2, 4, n), g.integers(0, 2, n), np.round(g.random(n), 1), np.zeros(n)].astype(float)
    y = (x[:, 0] + 2 * x[:, 1] + g.normal(size=n) > 1.5).astype(int)
    rows = [(i, int(y[i]), {k: float(v) for k, v in enumerate(x[i]) if v}) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "id long, label int, x map<int,double>")


def plain(x, y, rounds, real):
    w, vote, total = np.ones(len(y)), np.zeros(len(y)), 0.0
    for _ in range(rounds):
        w = w / w.sum()
        best = None
        for f in range(x.shape[1]):
            for v in sorted(set(x[:, f]))[:-1]:
                left = x[:, f] <= v
                gini = sum(2 * (w * s * y).sum() * (w * s * (1 - y)).sum() / (w * s).sum() for s in (left, ~left))
                if best is None or (round(gini, 10), f, v) < best[:3]:
                    best = (round(gini, 10), f, v, left)
        left = best[3]
        p = np.where(left, (w * left * y).sum() / (w * left).sum(), (w * ~left * y).sum() / (w * ~left).sum())
        if real:
            q = np.clip(p, B.EPS, 1 - B.EPS)
            h, alpha = 0.5 * np.log(q / (1 - q)), 1.0
            w = w * np.exp(-(2 * y - 1) * h)
        else:
            wrong = (p > 0.5) != (y == 1)
            alpha = math.log((1 - (w * wrong).sum()) / (w * wrong).sum())
            h = np.where(p > 0.5, alpha, -alpha)
            w = w * np.exp(alpha * wrong)
        vote, total = vote + h, total + alpha
    return 1 / (1 + np.exp(-2 * vote / total))


@pytest.mark.parametrize("algorithm", ["SAMME", "SAMME.R"])
def test_stumps_equal_plain_boosting(spark, algorithm):
    x, y, rows = data(spark)
    stumps = B.fit_adaboost(rows, 5, algorithm)
    got = {r.id: r.score for r in B.boosted_stump_scores(rows, stumps, algorithm, ["id"]).collect()}
    assert np.allclose([got[i] for i in range(len(y))], plain(x, y, 5, algorithm == "SAMME.R"), atol=1e-9)
    with pytest.raises(ValueError):
        B.fit_adaboost(rows, 1, "other")


def test_stumps_stop_without_error_and_without_features(spark):
    rows = spark.createDataFrame([(i, int(i > 3), {0: float(i)} if i else {}) for i in range(8)], "id long, label int, x map<int,double>")
    [s] = B.fit_adaboost(rows, 5, "SAMME")
    assert (s.threshold, s.left, s.right, s.alpha) == (3.5, 0.0, 1.0, 1.0)
    assert B.fit_adaboost(rows.selectExpr("id", "label", "map_filter(x, (k, v) -> false) as x"), 3) == []


def test_bayes_equals_counts(spark):
    x, y, rows = data(spark)
    x = np.abs(x)
    rows = rows.selectExpr("id", "label", "transform_values(x, (k, v) -> abs(v)) as x")
    counts, rows_of = N.fit_counts(rows)
    points = [(0.1, True), (2.0, False)]
    got = {(r.id, r.alpha): r.score for r in N.bayes_scores(rows, N.log_odds(counts, rows_of, points, 4), ["id"]).collect()}
    for alpha, prior in points:
        theta = [np.log((x[y == k].sum(0) + alpha) / (x[y == k].sum() + 4 * alpha)) for k in (0, 1)]
        margin = x @ (theta[1] - theta[0]) + (np.log((y == 1).sum() / (y == 0).sum()) if prior else 0)
        assert np.allclose([got[i, alpha] for i in range(len(y))], 1 / (1 + np.exp(-margin)))


def test_families_use_them(spark):
    x, y, _ = data(spark, 80)
    frame = spark.createDataFrame([(i, int(y[i]), Vectors.dense(np.abs(x[i]))) for i in range(80)], ["id", "label", "features"])
    for name, params in (("AB", {"algorithm": "SAMME.R", "n_estimators": 3}), ("NB", {"alpha": 1, "fit_prior": False})):
        scores, model = M.fit_and_score(name, params, frame, frame, ["id", "label"])
        assert scores.count() == 80 and scores.where("score between 0 and 1").count() == 80
        shares = M.feature_importance(name, model, list("abcd"))
        assert len(shares) == 4 and shares.importance.is_monotonic_decreasing


def test_a_round_is_summed_in_its_task(spark):
    b = T.packed(np.array([0, 2, 2, 3]), np.array([0, 7, 7]), np.array([1, 0, 2]))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 1], pa.int32()), b], names=["y", "b"])
    stump = B.Stump(7, 1, 1, 0.5, 0.25, 0.75, 1.0)  # left: the first two rows
    [out] = B._sums([stump], False, {0: 0, 7: 2}, 5)(iter([batch, batch]))
    wrong = math.e  # only the second row is on the wrong side
    got = {(f, c): (w0, w1) for f, c, w0, w1 in zip(*out.to_pydict().values())}
    assert got == {(0, 1): (2, 0), (7, 0): (2, 0), (7, 2): (0, 2), (-1, 0): (2, pytest.approx(2 + 2 * wrong))}


def test_bayes_scores_move_no_rows(spark):
    _, _, rows = data(spark, 40)
    counts, rows_of = N.fit_counts(rows.selectExpr("id", "label", "transform_values(x, (k, v) -> abs(v)) as x"))
    scores = N.bayes_scores(rows, N.log_odds(counts, rows_of, [(1.0, True)], 4), ["id"])
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
