"""Queries: temporal folds and model selection on a results table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as T
from ..operators import selection as SEL
from . import analog
from .analog import with_ctes
from .catalog import r6, register

TEST_YEARS = [1997, 1998, 1999, 2000, 2001]

# ------------------------------------------------------------ T1-T3, T6


@register("temporal_train_split", with_ctes(["episodes"], """
SELECT id, prefix, start_date, end_date FROM episodes
WHERE end_date >= DATE '1995-01-01' AND end_date < DATE '1998-01-01' - 365"""))
def q_temporal_train_split(t):
    return T.temporal_train_split(analog.episodes(t), "end_date", 1995, 1998, 365)


@register("temporal_test_split", with_ctes(["episodes"], """
SELECT id, prefix, start_date, end_date FROM episodes WHERE CAST(end_date AS VARCHAR) LIKE '1998%'"""))
def q_temporal_test_split(t):
    return T.temporal_test_split(analog.episodes(t), "end_date", 1998)


FOLDS_SQL = with_ctes(["episodes"], "\nUNION ALL\n".join(
    f"SELECT CAST({y} AS INTEGER) AS fold, 'train' AS role, id, prefix, end_date FROM episodes "
    f"WHERE end_date >= DATE '1995-01-01' AND end_date < DATE '{y}-01-01' - 365\n"
    f"UNION ALL SELECT CAST({y} AS INTEGER), 'test', id, prefix, end_date FROM episodes WHERE year(end_date) = {y}"
    for y in TEST_YEARS))


@register("temporal_folds", FOLDS_SQL)
def q_temporal_folds(t):
    e = analog.episodes(t).select("id", "prefix", "end_date")
    return T.temporal_folds(e, "end_date", 1995, TEST_YEARS, 365)


@register("subgroup_fold", with_ctes(["episodes", "attributes"], """
SELECT e.id, e.prefix, e.end_date, a.gender FROM episodes e LEFT JOIN attributes a ON e.id = a.id
WHERE e.end_date >= DATE '1995-01-01' AND e.end_date < DATE '1999-01-01' - 365
  AND a.gender IS DISTINCT FROM 'FEMALE'"""))
def q_subgroup_fold(t):
    a = analog.attributes(t).select("id", "gender")
    e = analog.episodes(t).join(a, "id", "left").select("id", "prefix", "end_date", "gender")
    return T.keep_subgroup(T.temporal_train_split(e, "end_date", 1995, 1999, 365), "gender", "FEMALE")


# ------------------------------------------------------------ E3-E6, C12, M12, R6, D15

RES_COLS = ["year", "gender", "model", "parameters", "recall_10", "precision_10", "auc"]


def _total(t):
    return analog.results_like(t).where(F.col("gender") == "TOTAL")


@register("best_per_year", with_ctes(["results_like"], """
SELECT year, gender, model, parameters, recall_10, precision_10, auc FROM results_like r
WHERE gender = 'TOTAL'
  AND recall_10 = (SELECT max(recall_10) FROM results_like q WHERE q.gender = 'TOTAL' AND q.year = r.year)"""))
def q_best_per_year(t):
    return SEL.best_per_group(_total(t), ["year"], "recall_10").select(*RES_COLS)


@register("top_k", with_ctes(["results_like"], """
SELECT year, gender, model, parameters, recall_10, precision_10, auc FROM results_like
WHERE gender = 'TOTAL' ORDER BY recall_10 DESC, year, model, parameters LIMIT 10"""))
def q_top_k(t):
    return SEL.top_k(_total(t), "recall_10", 10, ["year", "model", "parameters"]).select(*RES_COLS)


@register("top_k_per_year", with_ctes(["results_like"], """
SELECT year, gender, model, parameters, recall_10, precision_10, auc FROM (
  SELECT r.*, row_number() OVER (PARTITION BY year ORDER BY recall_10 DESC, model, parameters) AS rn
  FROM results_like r WHERE gender = 'TOTAL') s WHERE rn <= 3"""))
def q_top_k_per_year(t):
    return SEL.top_k_per_group(_total(t), ["year"], "recall_10", 3, ["model", "parameters"]).select(*RES_COLS)


@register("subgroup_of_best", with_ctes(["results_like"], """
SELECT m.year, m.gender, m.model, m.parameters, m.recall_10, m.precision_10, m.auc
FROM results_like m
WHERE m.gender = 'MALE' AND EXISTS (
  SELECT 1 FROM results_like r
  WHERE r.gender = 'TOTAL' AND r.year = m.year AND r.parameters = m.parameters
    AND r.recall_10 = (SELECT max(recall_10) FROM results_like q WHERE q.gender = 'TOTAL' AND q.year = r.year))"""))
def q_subgroup_of_best(t):
    res = analog.results_like(t)
    best = SEL.best_per_group(_total(t), ["year"], "recall_10")
    return SEL.subgroup_of_best(res.where(F.col("gender") == "MALE"), best).select(*RES_COLS)


@register("stability_score", with_ctes(["results_like"], """
SELECT classifiers, parameters, round(avg(recall_10), 6) AS recall_10, round(avg(precision_10), 6) AS precision_10,
       round(avg(auc), 6) AS auc, round(avg(rank), 6) AS rank
FROM (SELECT r.*, row_number() OVER (PARTITION BY year ORDER BY recall_10 DESC, classifiers, parameters) - 1 AS rank
      FROM results_like r WHERE gender = 'TOTAL') s
GROUP BY classifiers, parameters"""))
def q_stability_score(t):
    s = SEL.stability_score(_total(t), "recall_10", numeric=["recall_10", "precision_10", "auc"])
    return s.select("classifiers", "parameters", *[r6(c).alias(c) for c in ("recall_10", "precision_10", "auc", "rank")])


SERIES = [("A", "{'status': 'F', 'line': 1}"), ("R", "{'status': 'O', 'line': 3}"), (None, "{'status': 'F', 'line': 7}")]
SERIES_NAMES = ["s_a_f1", "s_r_o3", "s_any_f7"]


@register("metric_pivot", with_ctes(["results_like"], """
SELECT y.year,
       (SELECT max(recall_10) FROM results_like r WHERE r.gender = 'TOTAL' AND r.year = y.year AND r.model = 'A'
          AND r.parameters = '{''status'': ''F'', ''line'': 1}') AS s_a_f1,
       (SELECT max(recall_10) FROM results_like r WHERE r.gender = 'TOTAL' AND r.year = y.year AND r.model = 'R'
          AND r.parameters = '{''status'': ''O'', ''line'': 3}') AS s_r_o3,
       (SELECT max(recall_10) FROM results_like r WHERE r.gender = 'TOTAL' AND r.year = y.year
          AND r.parameters = '{''status'': ''F'', ''line'': 7}') AS s_any_f7,
       y.baseline
FROM (SELECT year, round(avg(precision_10), 6) AS baseline FROM results_like WHERE gender = 'TOTAL' GROUP BY year) y
WHERE EXISTS (SELECT 1 FROM results_like r WHERE r.gender = 'TOTAL' AND r.year = y.year AND (
  (r.model = 'A' AND r.parameters = '{''status'': ''F'', ''line'': 1}') OR
  (r.model = 'R' AND r.parameters = '{''status'': ''O'', ''line'': 3}') OR
  r.parameters = '{''status'': ''F'', ''line'': 7}'))"""))
def q_metric_pivot(t):
    tot = _total(t)
    base = tot.groupBy("year").agg(r6(F.avg("precision_10")).alias("baseline"))
    return SEL.metric_series(tot, "recall_10", SERIES, SERIES_NAMES, baseline=base)


@register("param_mean", with_ctes(["results_like"], """
SELECT gender, parameters, round(avg(recall_10), 6) AS recall_10 FROM results_like
WHERE parameters = '{''status'': ''F'', ''line'': 1}' GROUP BY gender, parameters"""))
def q_param_mean(t):
    m = SEL.param_mean(analog.results_like(t), "{'status': 'F', 'line': 1}", "recall_10", ["gender"])
    return m.select("gender", "parameters", r6("recall_10").alias("recall_10"))

