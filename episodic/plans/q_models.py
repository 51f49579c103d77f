"""Queries: model fits on every temporal fold of the wide feature table (rows
checks: scores are not SQL-expressible), the results grid, importances,
predictions, the exact k-NN vote (oracle-checked by brute force), linear
models and naive Bayes counts."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import linear as L
from ..operators import models as M
from ..operators import preprocess as P
from ..session import checkpoint_dir, reuse
from ..sources import io as IO
from ..sources.stages import Stages, VersionedTable
from . import analog
from .analog import with_ctes
from .catalog import i32, i64, register
from .experiment import KEEP as RKEEP
from .experiment import results_rows, test_years
from .features import feature_table
from .modelling import FOLDS_TOGETHER, FoldData, Folds
from .q_episodes import flag_sql

KEEP = ["id", "prefix", "label"]
#: Tables that the wide table is made from; the stages are built again when one of them or this number changes.
WIDE_INPUTS = ("customer", "part", "orders", "lineitem", "events")
STAGES_VERSION = 2


def _stages(t) -> Stages:
    return Stages(t.spark, f"{checkpoint_dir(t.spark).rstrip('/')}/episodic-stages")


def _wide(t, stages: Stages):
    inputs = [f"{t.sf_dir.rstrip('/')}/{n}.parquet" for n in WIDE_INPUTS]
    return stages.table("wide", lambda: feature_table(analog.episodes(t), analog.components(t), analog.attributes(t), analog.events_by_entity(t)),
                        inputs=inputs, parameters={"version": STAGES_VERSION})


def wide_table(t):
    """The labelled wide table, built once for the same inputs."""
    return _wide(t, _stages(t))


def folds(t):
    """Train and test vectors of every end year that has a train fold, built once for the same inputs: (year, fold)."""
    stages = _stages(t)
    wide = _wide(t, stages)
    years = test_years(wide)
    every = Folds(wide, years)
    for year in years:
        made: list[FoldData] = []

        def data(year=year, made=made) -> FoldData:
            if not made:
                made.append(every.fold(year))
            return made[0]

        part = {"after": ["wide"], "parameters": {"year": year}}
        train = stages.table(f"train_{year}", lambda: data().train, **part)
        test = stages.table(f"test_{year}", lambda: data().test, **part)
        names = stages.table(f"features_{year}", lambda: t.spark.createDataFrame(list(enumerate(data().feature_names)), "position int, name string"), **part)
        yield year, FoldData(train, test, [r.name for r in names.orderBy("position").collect()], train.count(), test.count())


def over_folds(t, of_fold):
    """What ``of_fold(year, fold)`` gives for every fold, each written once, with its year; a few folds at a time."""
    path = IO.scratch_path(t.spark, "folds")

    def write(year: int, fd: FoldData) -> None:
        of_fold(year, fd).write.parquet(f"{path}/year={year}")

    with ThreadPoolExecutor(FOLDS_TOGETHER) as ex:
        for done in [ex.submit(write, year, fd) for year, fd in folds(t)]:
            done.result()
    return t.spark.read.parquet(path).withColumn("year", i32("year"))


def _fit_query(name: str, params: dict):
    def q(t):
        return over_folds(t, lambda year, fd: M.fit_and_score(name, params, fd.train, fd.test, KEEP, n_train=fd.n_train, nb_features="nb_features")[0])
    return q


_FITS = {
    "fit_logistic": ("LR", M.GRIDS["test"]["LR"]),
    # the test grid's forest is a single tree
    "fit_random_forest": ("RF", M.GRIDS["test"]["RF"] | {"n_estimators": [100]}),
    "fit_gbt": ("GB", M.GRIDS["test"]["GB"]),
    "fit_decision_tree": ("DT", M.GRIDS["test"]["DT"]),
    "fit_linear_svm": ("SVM", M.GRIDS["test"]["SVM"]),
    "fit_naive_bayes": ("NB", {"alpha": [1], "fit_prior": [False]}),
    "fit_bagging": ("BAG", {"n_estimators": [5], "random_state": [0]}),
    "fit_adaboost": ("AB", {"algorithm": ["SAMME"], "n_estimators": [5], "random_state": [0]}),
    "fit_adaboost_real": ("AB", M.GRIDS["test"]["AB"]),
    "fit_extra_trees": ("ET", {"n_estimators": [5], "criterion": ["entropy"], "max_depth": [5],
                               "max_features": ["sqrt"], "min_samples_split": [10], "random_state": [0]}),
}
for _key, (_name, _spec) in _FITS.items():
    register(_key)(_fit_query(_name, M.parameter_grid(_spec)[0]))


def _grid_scores(t, models):
    """Scores of the test grid for every fold, built once for the same inputs, a few folds at a time: (year, fold, scores)."""
    stages = _stages(t)
    _wide(t, stages)

    def scores(year: int, fd: FoldData):
        return stages.table(f"scores_{'_'.join(models)}_{year}", lambda: M.run_grid(
            fd.train, fd.test, models, M.GRIDS["test"], RKEEP, nb_features="nb_features"), after=["wide"], parameters={"year": year})

    with ThreadPoolExecutor(FOLDS_TOGETHER) as ex:
        for year, fd, done in [(year, fd, ex.submit(scores, year, fd)) for year, fd in folds(t)]:
            yield year, fd, done.result()


@register("model_grid_results")
def q_model_grid_results(t):
    """Results rows for the test grid of the default families, by subgroup
    (TOTAL, MALE, FEMALE): descriptors, AUC and 28 threshold metrics."""
    out = None
    for year, fd, scores in _grid_scores(t, M.DEFAULT_MODELS):
        rows = results_rows(scores, year, fd.n_train, len(fd.feature_names), fd.n_test, fd.test.agg(F.avg("label")).first()[0])
        out = rows if out is None else out.unionByName(rows)
    return out


@register("fairness_by_model")
def q_fairness_by_model(t):
    """Fairness crosstab for every model of the test grid and every fold from one scores table."""
    every = None
    for year, _, scores in _grid_scores(t, FAMILIES_FITTED):
        scores = scores.withColumn("year", F.lit(year))
        every = scores if every is None else every.unionByName(scores)
    pred = E.label_top_fraction(every, "score", ["id", "prefix"], 10, by=["year", "model", "parameters"])
    return E.fairness_crosstab(pred, ["race", "gender"], "label", "prediction", ["year", "model", "parameters"])


@register("results_by_year")
def q_results_by_year(t):
    """All test years x test grid, appended to a year-partitioned results
    table, then read back; the male-and-missing subgroup run over all years
    is appended to its own table and stacked with a ``population`` tag."""
    from .experiment import run_years

    wide = wide_table(t)
    exclude = ("gender", "FEMALE")
    with ThreadPoolExecutor(2) as ex:  # both populations at once
        total = ex.submit(run_years, wide, test_years(wide), IO.scratch_path(t.spark, "results"), grid_size="test")
        male = ex.submit(run_years, wide, test_years(wide, exclude=exclude), IO.scratch_path(t.spark, "results_male"), grid_size="test",
                         exclude=exclude, subgroups=["MALE"])
        total, male = total.result(), male.result()
    return (total.withColumn("population", F.lit("ALL"))
            .unionByName(male.withColumn("population", F.lit("MALE_AND_MISSING"))))


@register("feature_importance")
def q_feature_importance(t):
    """All importances of one point of four families, every fold."""
    def of_fold(year, fd):
        rows = []
        for name in ("LR", "DT", "GB", "AB"):
            params = M.parameter_grid(M.GRIDS["test"][name])[0]
            _, model = M.fit_and_score(name, params, fd.train, fd.test, KEEP, n_train=fd.n_train)
            rows += M.importance_rows(name, params, model, fd.feature_names)
        return t.spark.createDataFrame(rows, M.IMPORTANCE)

    return over_folds(t, of_fold)


# the test rows of every fold, from the tables: episodes of at least a day, in the years with a train row
FOLD_SQL = with_ctes(["episodes"], f"""
, long_enough AS (SELECT * FROM episodes WHERE end_date > start_date),
years AS (SELECT y FROM (SELECT DISTINCT year(end_date) AS y FROM long_enough) d
          WHERE EXISTS (SELECT 1 FROM long_enough r WHERE r.end_date >= DATE '1995-01-01' AND r.end_date < make_date(y, 1, 1) - 365)),
fold AS (SELECT CAST(y AS INTEGER) AS year, e.id, e.prefix, {flag_sql("episodes")} AS label FROM long_enough e JOIN years ON year(e.end_date) = y),
fits(model) AS (VALUES ('LR'), ('RF'), ('GB'), ('DT'), ('SVM'), ('NB'), ('BAG'), ('AB'), ('ET'), ('KNN'))""")
FAMILIES_FITTED = ("LR", "RF", "GB", "DT", "SVM", "NB", "BAG", "AB", "ET", "KNN")


@register("grid_rows_checked", FOLD_SQL + """
SELECT year, model, id, prefix, label, true AS scored FROM fold, fits""")
def q_grid_rows_checked(t):
    """Every family scores each row of each fold once: a number, from 0 to 1 but for the margin of the SVM."""
    ok = F.col("score").isNotNull() & ~F.isnan("score") & ((F.col("model") == "SVM") | F.col("score").between(0, 1))
    out = None
    for year, _, scores in _grid_scores(t, FAMILIES_FITTED):
        rows = scores.select(F.lit(year).alias("year"), "model", "id", "prefix", i32("label").alias("label"), ok.alias("scored"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("grid_predictions", FOLD_SQL + """
SELECT year, model, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS positives,
       CAST(round_even(CAST(count(*) AS DOUBLE) * 0.1, 0) AS BIGINT) AS predicted, CAST(count(*) AS BIGINT) AS in_histogram
FROM fold, fits GROUP BY year, model""")
def q_grid_predictions(t):
    """Predictions and histograms of every fit: sizes, base rate and the exact number of positives at ten percent."""
    from .experiment import histograms, predictions

    out = None
    for year, _, scores in _grid_scores(t, FAMILIES_FITTED):
        counts = predictions(scores, year).groupBy("year", "model").agg(
            i64(F.count(F.lit(1))).alias("n"), i64(F.sum("label")).alias("positives"), i64(F.sum("prediction")).alias("predicted"))
        rows = counts.join(histograms(scores, year).groupBy("model").agg(i64(F.sum("count")).alias("in_histogram")), "model")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("predictions_table")
def q_predictions_table(t):
    """Scores and predictions of one logistic model, written by year and model and read back."""
    table = VersionedTable(t.spark, IO.scratch_path(t.spark, "predictions"), ["year", "model"])
    params = M.parameter_grid(M.GRIDS["test"]["LR"])[0]

    def write(year: int, fd: FoldData) -> None:
        sc, _ = M.fit_and_score("LR", params, fd.train, fd.test, ["id", "prefix", "start_date", "end_date", "label"], n_train=fd.n_train)
        pred = E.label_top_fraction(sc, "score", ["id", "prefix"], 10)
        table.replace(pred.select(F.lit(year).alias("year"), F.lit("LR").alias("model"), F.lit(json.dumps(params, sort_keys=True)).alias("parameters"),
                                  "id", "prefix", "start_date", "end_date", "label", "score", "prediction"))

    with ThreadPoolExecutor(FOLDS_TOGETHER) as ex:
        for done in [ex.submit(write, year, fd) for year, fd in folds(t)]:
            done.result()
    return table.read()


KNN_SQL = """
WITH tr AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 2 = 0),
te AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT te.vec_id AS qid, tr.vec_id AS nid, tr.label AS nlabel, list_distance(te.e, tr.e) AS dist
      FROM te CROSS JOIN tr),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS r FROM d),
votes AS (SELECT qid, nlabel, {vote} AS v FROM top WHERE r <= {k} GROUP BY qid, nlabel)
SELECT qid AS id, CAST(nlabel AS INTEGER) AS predicted
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY v DESC, nlabel) AS r2 FROM votes) s WHERE r2 = 1"""


def _knn(t, k, weights):
    e = t.embeddings
    train = e.where(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("id"), "embedding", "label")
    test = e.where(F.col("vec_id") % 2 == 1).select(F.col("vec_id").alias("id"), "embedding")
    return M.knn_predict(train, test, k, weights, id_col="id", vec="embedding", label="label", block_rows=20000) \
        .select("id", i32("predicted").alias("predicted"))


@register("knn_vote", KNN_SQL.format(vote="count(*)", k=5))
def q_knn_vote(t):
    return _knn(t, 5, "uniform")


@register("knn_vote_distance", KNN_SQL.format(vote="sum(1.0 / dist)", k=10))
def q_knn_vote_distance(t):
    return _knn(t, 10, "distance")


NB_SQL = """
WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT label, i AS feature, abs(e[i]) AS v FROM x, range(1, 65) r(i)),
sums AS (SELECT label, feature, sum(v) AS s FROM f GROUP BY label, feature),
tot AS (SELECT label, sum(s) AS t FROM sums GROUP BY label),
cnt AS (SELECT label, count(*) AS n FROM x GROUP BY label),
k AS (SELECT count(*) AS classes, sum(n) AS docs FROM cnt)
SELECT CAST(s.label AS INTEGER) AS label, CAST(s.feature - 1 AS INTEGER) AS feature,
       round(ln(s.s + 1.0) - ln(t.t + 64 * 1.0), 6) AS theta,
       round(ln(c.n + 1.0) - ln(k.docs + k.classes * 1.0), 6) AS pi
FROM sums s JOIN tot t ON s.label = t.label JOIN cnt c ON s.label = c.label, k"""


@register("naive_bayes_counts", NB_SQL)
def q_naive_bayes_counts(t):
    """Fitted multinomial NB statistics (class log-prior, per-feature log
    likelihood, smoothing 1) on |embedding| -- the counts behind the scores."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.classification import NaiveBayes

    e = t.embeddings.select(F.col("label").cast("double").alias("label"),
                            array_to_vector(F.transform("embedding", lambda v: F.abs(v.cast("double")))).alias("f"))
    m = NaiveBayes(featuresCol="f", labelCol="label", smoothing=1.0, modelType="multinomial").fit(e)
    theta = np.asarray(m.theta.toArray())
    pi = m.pi.toArray()
    # MLlib class indices are the label values 0..K-1; the model is K x d numbers
    rows = [(i, j, float(theta[i, j]), float(pi[i])) for i in range(theta.shape[0]) for j in range(theta.shape[1])]
    df = t.spark.createDataFrame(rows, "label int, feature int, theta double, pi double")
    return df.select("label", "feature", F.round("theta", 6).alias("theta"), F.round("pi", 6).alias("pi"))


# ------------------------------------------------------------ linear models with certificates

LINEAR_C = (0.01, 0.1, 1.0, 10.0)
LINEAR_NAMES = ["quantity", "line"]

# the optimum of two features and the intercept by Newton steps over distinct feature values; r0..r2 and h.. are the
# derivatives of the losses' sum, the step is solved by Cramer's rule
NEWTON_SQL = """
WITH RECURSIVE raw AS (
  SELECT l_orderkey * 16 + l_linenumber AS id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y,
         max(l_quantity) AS q, CAST(l_linenumber AS DOUBLE) AS l FROM lineitem GROUP BY l_orderkey, l_linenumber),
scaled AS (SELECT id, y, (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()) AS x0,
                  (l - min(l) OVER ()) / (max(l) OVER () - min(l) OVER ()) AS x1 FROM raw),
cell AS (SELECT x0, x1, 1.0 AS x2, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS p FROM scaled GROUP BY x0, x1),
points(c) AS (VALUES {points}),
fit AS (
  SELECT 0 AS k, CAST(c AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM points
  UNION ALL (
    WITH here AS (SELECT f.*, x0, x1, x2, n, p, b0 * x0 + b1 * x1 + b2 * x2 AS m FROM fit f, cell WHERE k < {steps}),
    d AS (SELECT *, {slope} AS g, {curve} AS w FROM here),
    s AS (SELECT k, c, b0, b1, b2, b0 + c * sum(g * x0) AS r0, b1 + c * sum(g * x1) AS r1, b2 + c * sum(g * x2) AS r2,
                 1 + c * sum(w * x0 * x0) AS h00, c * sum(w * x0 * x1) AS h01, c * sum(w * x0 * x2) AS h02,
                 1 + c * sum(w * x1 * x1) AS h11, c * sum(w * x1 * x2) AS h12, 1 + c * sum(w * x2 * x2) AS h22
          FROM d GROUP BY k, c, b0, b1, b2),
    t AS (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s)
    SELECT k + 1, c,
           b0 - (r0 * (h11 * h22 - h12 * h12) - h01 * (r1 * h22 - h12 * r2) + h02 * (r1 * h12 - h11 * r2)) / det,
           b1 - (h00 * (r1 * h22 - h12 * r2) - r0 * (h01 * h22 - h12 * h02) + h02 * (h01 * r2 - r1 * h02)) / det,
           b2 - (h00 * (h11 * r2 - r1 * h12) - h01 * (h01 * r2 - r1 * h02) + r0 * (h01 * h12 - h11 * h02)) / det
    FROM t)),
best AS (SELECT * FROM fit WHERE k = {steps})
SELECT id, 'C=' || CAST(c AS VARCHAR) AS point, round({score}, 5) AS score
FROM scaled, best"""
_POINTS = ", ".join(f"({c})" for c in LINEAR_C)
LOGISTIC_SQL = NEWTON_SQL.format(points=_POINTS, steps=12, slope="n / (1 + exp(-m)) - p", curve="n / (1 + exp(-m)) / (1 + exp(m))",
                                 score="1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2)))")
# squared hinge: rows of both classes within the margin
HINGE_SQL = NEWTON_SQL.format(
    points=_POINTS, steps=30, slope="-2 * p * greatest(0, 1 - m) + 2 * (n - p) * greatest(0, 1 + m)",
    curve="2 * p * CAST(m < 1 AS INTEGER) + 2 * (n - p) * CAST(m > -1 AS INTEGER)", score="b0 * x0 + b1 * x1 + b2")


def _scaled(t, names):
    from .q_trees import returned, vectors

    rows = reuse(returned(t).select("id", "label", *names), "returned")
    return vectors(P.apply_minmax(rows, P.fit_minmax(rows, names)), names)


def _linear(t, loss: str):
    rows = reuse(_scaled(t, LINEAR_NAMES), "scaled")
    points = [L.Point(f"C={c}", loss, "l2", c) for c in LINEAR_C]
    models = L.fit_linear(rows, len(LINEAR_NAMES), points)
    return L.linear_scores(rows, len(LINEAR_NAMES), models, ["id"]).select("id", "point", F.round("score", 5).alias("score"))


@register("linear_logistic_scores", LOGISTIC_SQL)
def q_linear_logistic_scores(t):
    """Scores of four ridge logistic models fitted together; the SQL finds the optima by Newton's method."""
    return _linear(t, "logistic")


@register("linear_svm_scores", HINGE_SQL)
def q_linear_svm_scores(t):
    """Margins of four squared-hinge machines fitted together."""
    return _linear(t, "squared_hinge")


@register("linear_certificates", """
WITH loss(loss) AS (VALUES ('logistic'), ('squared_hinge')), penalty(penalty) AS (VALUES ('l1'), ('l2')),
c(c) AS (VALUES (0.01), (0.1), (1.0), (10.0)),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) q)
SELECT loss, penalty, CAST(c AS DOUBLE) AS c, true AS optimal, CAST(n AS BIGINT) AS n_rows FROM loss, penalty, c, n""")
def q_linear_certificates(t):
    """Every loss, penalty and C over all features in one series of jobs; optimal: no subgradient entry beyond 1e-6, found anew."""
    from .q_trees import NAMES

    rows = reuse(_scaled(t, NAMES), "scaled")
    points = [L.Point(f"{loss} {penalty} {c}", loss, penalty, c) for loss in ("logistic", "squared_hinge") for penalty in ("l1", "l2") for c in LINEAR_C]
    models = L.fit_linear(rows, len(NAMES), points, tolerance=1e-8)
    off = L.certificate(rows, len(NAMES), points, np.array([m.coefficients for m in models]))
    n = rows.count()
    return t.spark.createDataFrame([(p.loss, p.penalty, p.c, bool(v <= 1e-6), n) for p, v in zip(points, off, strict=True)],
                                   "loss string, penalty string, c double, optimal boolean, n_rows long")
