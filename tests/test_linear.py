"""Linear models of many points: optimality, one job for all points, and what l1 does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.operators import linear as L


def data(spark, n=400, seed=3):
    g = np.random.default_rng(seed)
    x = np.round(g.normal(size=(n, 4)) * (g.random((n, 4)) < 0.7), 3)
    y = (x @ [1.5, -1.0, 0.0, 0.2] + g.normal(size=n) > 0.3).astype(int)
    rows = [(i, int(y[i]), {k: float(v) for k, v in enumerate(x[i]) if v}) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "id long, label int, x map<int,double>")


POINTS = [L.Point(f"{loss} {penalty} {c}", loss, penalty, c) for loss in ("logistic", "squared_hinge") for penalty in ("l1", "l2") for c in (0.05, 1.0, 50.0)]


def objective(x, y, p, b):
    z = (2 * y - 1) * (np.c_[x, np.ones(len(x))] @ b)
    losses = np.logaddexp(0, -z) if p.loss == "logistic" else np.maximum(0, 1 - z) ** 2
    return (np.abs(b).sum() if p.penalty == "l1" else b @ b / 2) + p.c * losses.sum()


def test_optima_and_certificates(spark):
    x, y, rows = data(spark)
    models = L.fit_linear(rows, 4, POINTS)
    off = L.certificate(rows, 4, POINTS, np.array([m.coefficients for m in models]))
    g = np.random.default_rng(1)
    for m, v in zip(models, off, strict=True):
        assert v < 1e-6 and m.violation < 1e-6
        best = objective(x, y, m.point, m.coefficients)
        assert m.objective == pytest.approx(best, rel=1e-9)
        for scale in (1e-1, 1e-2, 1e-3):  # no better neighbour of a convex function's minimum
            assert all(objective(x, y, m.point, m.coefficients + scale * g.normal(size=5)) >= best - 1e-9 for _ in range(20))
    worse = L.certificate(rows, 4, POINTS, np.array([m.coefficients + 0.05 for m in models]))
    assert (worse > 1e-4).all()
    assert sum(c == 0 for m in models if m.point.penalty == "l1" for c in m.coefficients) >= 2


def test_jobs_don_t_grow_with_points(spark, monkeypatch):
    _, _, rows = data(spark, 100)
    calls = []
    one = L.evaluate
    monkeypatch.setattr(L, "evaluate", lambda d, p, v: calls.append(len(p)) or one(d, p, v))
    models = L.fit_linear(rows, 4, POINTS)
    assert len(calls) == max(m.evaluations for m in models) and sum(calls) == sum(m.evaluations for m in models)


def test_scores_and_coefficients(spark):
    x, y, rows = data(spark, 60)
    models = L.fit_linear(rows, 4, POINTS[3:9:3])
    got = {(r.id, r.point): r.score for r in L.linear_scores(rows.withColumn("point2", F.lit(1)), 4, models, ["id"]).collect()}
    assert len(got) == 120
    for m in models:
        margin = np.c_[x, np.ones(60)] @ m.coefficients
        want = 1 / (1 + np.exp(-margin)) if m.point.loss == "logistic" else margin
        assert np.allclose([got[i, m.point.name] for i in range(60)], want)
    table = L.coefficient_table(spark, models, list("abcd")).where("feature = 'intercept'").collect()
    assert [r.coefficient for r in table] == [m.coefficients[-1] for m in models]
    with pytest.raises(ValueError):
        L.Point("x", "hinge", "l2", 1.0)


def test_rows_without_features_and_one_class(spark):
    rows = spark.createDataFrame([(1, 1, {}), (2, 1, {0: 2.0}), (3, 1, {})], "id long, label int, x map<int,double>")
    [m] = L.fit_linear(rows, 1, [L.Point("a", "logistic", "l2", 1.0)])
    assert m.violation < 1e-8 and m.coefficients[-1] > 0


def test_few_features_take_few_jobs(spark, monkeypatch):
    _, _, rows = data(spark)
    models = L.fit_linear(rows, 4, POINTS)
    assert max(m.evaluations for m in models) <= 25
    monkeypatch.setattr(L, "CURVED", 0)  # the same optima without curvature
    some = [p for p in POINTS if p.c == 1.0]
    plain = {m.point: m.coefficients for m in L.fit_linear(rows, 4, some)}
    assert all(np.allclose(plain[m.point], m.coefficients, atol=1e-5) for m in models if m.point in plain)


def test_many_features_take_few_passes(spark, monkeypatch):
    """LR and SVM of the grids ran hundreds of jobs a fit over some hundred features; with one-hot groups the optimum is certified."""
    from pyspark.ml.linalg import Vectors

    from episodic.operators import models as M

    g = np.random.default_rng(5)
    rows = []
    for i in range(600):
        at = sorted({int(g.integers(0, 30)), *map(int, 30 + g.integers(0, 30, 4))})
        v = Vectors.sparse(61, [*at, 60], [*[1.0] * len(at), float(g.random())])
        rows.append((i, int(g.random() < (0.8 if at[0] < 12 else 0.3)), v if i % 2 else Vectors.dense(v.toArray())))
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    calls = []
    one = L.evaluate
    monkeypatch.setattr(L, "evaluate", lambda d, p, v: calls.append(1) or one(d, p, v))
    for name, params in (("LR", {"penalty": "l1", "C": 10}), ("LR", {"penalty": "l1", "C": 0.05}), ("LR", {"penalty": "l2", "C": 1}), ("SVM", {"C": 10})):
        calls.clear()
        scores, model = M.fit_and_score(name, params, df, df, ["id", "label"])
        assert len(calls) <= 25 and model.fitted.violation <= 1e-8
        x = np.array([r[2].toArray() for r in rows])
        y = np.array([r[1] for r in rows])
        b = model.fitted.coefficients
        best, point = model.fitted.objective, model.fitted.point
        assert best == pytest.approx(objective(x, y, point, b), rel=1e-9)
        assert all(objective(x, y, point, b + scale * g.normal(size=62)) >= best - 1e-9 for scale in (1e-1, 1e-2, 1e-3) for _ in range(20))
        margin = np.c_[x, np.ones(600)] @ b
        got = {r.id: r.score for r in scores.collect()}
        assert np.allclose([got[i] for i in range(600)], margin if name == "SVM" else 1 / (1 + np.exp(-margin)))
        assert len(M.feature_importance(name, model, [str(i) for i in range(61)])) == 61
    few = [p for p in POINTS if p.penalty == "l1"]
    x, y, small = data(spark)
    plain = [m.coefficients for m in L.fit_linear(small, 4, few)]
    monkeypatch.setattr(L, "FEW", 0)  # sets of signs find what coordinate descent does
    assert all(np.allclose(a, m.coefficients, atol=1e-6) for a, m in zip(plain, L.fit_linear(small, 4, few), strict=True))
