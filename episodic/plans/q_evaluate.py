"""Queries: top-fraction labels, confusion counts, metrics by level, AUC,
histogram, subgroup metrics, fairness crosstab -- on the ``scored`` analog
(orders with a deterministic score, 1,000 distinct values, so ties abound)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators.cutoffs import auc_of_scores
from . import analog
from .analog import with_ctes
from .catalog import i32, i64, r6, register

RANKED = """
SELECT s.*, row_number() OVER (PARTITION BY fold ORDER BY score DESC, id) AS rn,
       count(*) OVER (PARTITION BY fold) AS n
FROM scored s"""


def _pred_sql(expr: str) -> str:
    return f"CAST(CASE WHEN rn <= {expr} THEN 1 ELSE 0 END AS INTEGER)"


HALF_EVEN_10 = "round_even(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE), 0)"
FLOOR_10 = "floor(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE))"


@register("label_top_fraction", with_ctes(["scored"], f"""
SELECT id, fold, {_pred_sql(HALF_EVEN_10)} AS prediction FROM ranked""", extra=[("ranked", RANKED)]))
def q_label_top_fraction(t):
    s = analog.scored(t)
    return E.label_top_fraction(s, "score", "id", 10, by=["fold"]).select("id", "fold", i32("prediction").alias("prediction"))


@register("label_top_fraction_floor", with_ctes(["scored"], f"""
SELECT id, fold, {_pred_sql(FLOOR_10)} AS prediction FROM ranked""", extra=[("ranked", RANKED)]))
def q_label_top_fraction_floor(t):
    s = analog.scored(t)
    return E.label_top_fraction(s, "score", "id", 10, by=["fold"], rounding="floor") \
        .select("id", "fold", i32("prediction").alias("prediction"))


PRED10 = f"SELECT r.*, {_pred_sql(HALF_EVEN_10)} AS prediction FROM ranked r"


@register("confusion_counts", with_ctes(["scored"], """
SELECT fold, CAST(count_if(label = 0 AND prediction = 0) AS BIGINT) AS tn,
       CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS fp,
       CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS fn,
       CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS tp
FROM pred GROUP BY fold""", extra=[("ranked", RANKED), ("pred", PRED10)]))
def q_confusion_counts(t):
    p = E.label_top_fraction(analog.scored(t), "score", "id", 10, by=["fold"])
    c = E.confusion_counts(p, "label", "prediction", ["fold"])
    return c.select("fold", *[i64(x).alias(x) for x in ("tn", "fp", "fn", "tp")])


METRIC_SQL = """
round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy,
round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


def _metric_cols():
    return [r6(m).alias(m) for m in E.METRICS]


@register("metrics_at_threshold", with_ctes(["scored"], f"""
SELECT fold, {METRIC_SQL} FROM (
  SELECT fold, count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp,
         count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp
  FROM pred GROUP BY fold) c""", extra=[("ranked", RANKED), ("pred", PRED10)]))
def q_metrics_at_threshold(t):
    p = E.label_top_fraction(analog.scored(t), "score", "id", 10, by=["fold"])
    c = E.confusion_counts(p, "label", "prediction", ["fold"])
    m = E.metrics_from_counts(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return c.select("fold", *[r6(e).alias(k) for k, e in m.items()])


LEVELS_SQL = "(VALUES " + ", ".join(f"(CAST({float(lv)} AS DOUBLE))" for lv in E.LEVELS) + ") AS lv(level)"

BY_LEVEL_SQL = f"""
SELECT {{keys}}, level, CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {METRIC_SQL}
FROM (
  SELECT {{keys}}, lv.level, max(n) AS n,
         count_if(rn <= round_even(CAST(n AS DOUBLE) * (lv.level / 100.0), 0) AND label = 1) AS tp,
         count_if(rn <= round_even(CAST(n AS DOUBLE) * (lv.level / 100.0), 0) AND label = 0) AS fp,
         count_if(rn > round_even(CAST(n AS DOUBLE) * (lv.level / 100.0), 0) AND label = 1) AS fn,
         count_if(rn > round_even(CAST(n AS DOUBLE) * (lv.level / 100.0), 0) AND label = 0) AS tn
  FROM {{src}} CROSS JOIN {LEVELS_SQL}
  GROUP BY {{keys}}, lv.level) c"""


@register("precision_recall_by_level", with_ctes(["scored"], BY_LEVEL_SQL.format(keys="fold", src="ranked"),
                                                 extra=[("ranked", RANKED)]))
def q_precision_recall_by_level(t):
    m = E.level_metrics(analog.scored(t), "label", "score", "id", ["fold"])
    return m.select("fold", "level", *[i64(c).alias(c) for c in ("n", "tp", "fp", "fn", "tn")], *_metric_cols())


AUC_SQL = """
SELECT fold, round((sum(CASE WHEN label = 1 THEN avg_rank ELSE 0 END) - P * (P + 1) / 2.0) / (P * (n - P)), 6) AS auc
FROM (SELECT fold, label, n, P,
             rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0
               AS avg_rank
      FROM (SELECT s.*, count(*) OVER (PARTITION BY fold) AS n,
                   sum(label) OVER (PARTITION BY fold) AS P FROM scored s) x) y
GROUP BY fold, n, P"""


@register("auc_rank", with_ctes(["scored"], AUC_SQL))
def q_auc_rank(t):
    return auc_of_scores(analog.scored(t), "label", "score", ["fold"]).select("fold", r6("auc").alias("auc"))


HISTOGRAM_SQL = """
SELECT fold, bin, round(lo + bin * (hi - lo) / 10, 6) AS lo, round(lo + (bin + 1) * (hi - lo) / 10, 6) AS hi,
       CAST(count(*) AS BIGINT) AS count
FROM (SELECT s.fold, r.lo, r.hi,
             CAST(least(floor((s.score - r.lo) / ((r.hi - r.lo) / 10)), 9) AS INTEGER) AS bin
      FROM scored s JOIN (SELECT fold, min(score) AS lo, max(score) AS hi FROM scored GROUP BY fold) r
        ON s.fold = r.fold) b
GROUP BY fold, bin, lo, hi"""


def _histogram(scores):
    h = E.score_histogram(scores, "score", ["fold"], 10)
    return h.select("fold", i32("bin").alias("bin"), r6("lo").alias("lo"), r6("hi").alias("hi"), i64("count").alias("count"))


@register("score_histogram", with_ctes(["scored"], HISTOGRAM_SQL))
def q_score_histogram(t):
    return _histogram(analog.scored(t))


SUB_RANKED = """
SELECT x.*, row_number() OVER (PARTITION BY fold, subgroup ORDER BY score DESC, id) AS rn,
       count(*) OVER (PARTITION BY fold, subgroup) AS n
FROM (SELECT s.*, 'TOTAL' AS subgroup FROM scored s
      UNION ALL SELECT s.*, s.gender FROM scored s WHERE s.gender IN ('MALE', 'FEMALE')) x"""


@register("metrics_by_subgroup", with_ctes(["scored"], """
SELECT m.*, CAST(b.fold_n AS BIGINT) AS fold_n, round(b.baseline, 6) AS baseline
FROM (""" + BY_LEVEL_SQL.format(keys="fold, subgroup", src="sub_ranked") + """) m
JOIN (SELECT fold, count(*) AS fold_n, avg(label) AS baseline FROM scored GROUP BY fold) b ON m.fold = b.fold""",
                                           extra=[("sub_ranked", SUB_RANKED)]))
def q_metrics_by_subgroup(t):
    s = analog.scored(t)
    base = s.groupBy("fold").agg(F.count(F.lit(1)).alias("fold_n"), F.avg("label").alias("baseline"))
    tagged = E.subgroup_tags(s, "gender", ["MALE", "FEMALE"])
    m = E.level_metrics(tagged, "label", "score", "id", ["fold", "subgroup"]).join(base, "fold")
    return m.select("fold", "subgroup", "level", *[i64(c).alias(c) for c in ("n", "tp", "fp", "fn", "tn")],
                    *_metric_cols(), i64("fold_n").alias("fold_n"), r6("baseline").alias("baseline"))


RATES = ["ppr", "pprev", "fnr", "fpr", "for", "fdr", "tpr", "tnr", "npv", "precision"]


@register("fairness_crosstab", with_ctes(["scored"], """
SELECT fold, attribute_name, attribute_value, CAST(group_size AS BIGINT) AS group_size,
       CAST(pp AS BIGINT) AS pp, CAST(pn AS BIGINT) AS pn, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       round(CASE WHEN total_pp > 0 THEN CAST(pp AS DOUBLE) / total_pp END, 6) AS ppr,
       round(CAST(pp AS DOUBLE) / group_size, 6) AS pprev,
       round(CASE WHEN fn + tp > 0 THEN CAST(fn AS DOUBLE) / (fn + tp) END, 6) AS fnr,
       round(CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) END, 6) AS fpr,
       round(CASE WHEN fn + tn > 0 THEN CAST(fn AS DOUBLE) / (fn + tn) END, 6) AS "for",
       round(CASE WHEN pp > 0 THEN CAST(fp AS DOUBLE) / pp END, 6) AS fdr,
       round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS tpr,
       round(CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END, 6) AS tnr,
       round(CASE WHEN pn > 0 THEN CAST(tn AS DOUBLE) / pn END, 6) AS npv,
       round(CASE WHEN pp > 0 THEN CAST(tp AS DOUBLE) / pp END, 6) AS precision
FROM (SELECT g.*, sum(pp) OVER (PARTITION BY fold, attribute_name) AS total_pp FROM (
        SELECT fold, attribute_name, attribute_value, count(*) AS group_size,
               count_if(prediction = 1) AS pp, count_if(prediction = 0) AS pn,
               count_if(prediction = 1 AND label = 1) AS tp, count_if(prediction = 1 AND label = 0) AS fp,
               count_if(prediction = 0 AND label = 1) AS fn, count_if(prediction = 0 AND label = 0) AS tn
        FROM (SELECT fold, label, prediction, 'race' AS attribute_name, race AS attribute_value FROM pred
              UNION ALL SELECT fold, label, prediction, 'gender', gender FROM pred) u
        GROUP BY fold, attribute_name, attribute_value) g) z
WHERE group_size >= 5""", extra=[("ranked", RANKED), ("pred", PRED10)]))
def q_fairness_crosstab(t):
    p = E.label_top_fraction(analog.scored(t), "score", "id", 10, by=["fold"])
    x = E.fairness_crosstab(p, ["race", "gender"], "label", "prediction", ["fold"], min_group_size=5)
    return x.select("fold", "attribute_name", "attribute_value",
                    *[i64(c).alias(c) for c in ("group_size", "pp", "pn", "tp", "fp", "fn", "tn")],
                    *[r6(c).alias(c) for c in RATES])


# The same queries with a NULL group: every third fold is unknown.

UNKNOWN_FOLDS = ("scored_all", "SELECT id, CASE WHEN fold % 3 <> 0 THEN fold END AS fold, label, score, gender, race FROM scored")


def _unknown_folds(t):
    return analog.scored(t).withColumn("fold", F.expr("CASE WHEN fold % 3 <> 0 THEN fold END"))


def _null_group(body: str, extra: list[tuple[str, str]] = ()) -> str:
    """The oracle over ``scored_all``, joins on the fold null-safe."""
    on = lambda q: q.replace("FROM scored", "FROM scored_all").replace("s.fold = r.fold", "s.fold IS NOT DISTINCT FROM r.fold")
    return with_ctes(["scored"], on(body), extra=[UNKNOWN_FOLDS, *[(n, on(q)) for n, q in extra]])


@register("label_top_fraction_range", _null_group(f"""
SELECT id, fold, {_pred_sql(HALF_EVEN_10)} AS prediction FROM ranked""", [("ranked", RANKED)]))
def q_label_top_fraction_range(t):
    return E.label_top_fraction(_unknown_folds(t), "score", "id", 10, by=["fold"]) \
        .select("id", "fold", i32("prediction").alias("prediction"))


@register("precision_recall_by_level_range", _null_group(BY_LEVEL_SQL.format(keys="fold", src="ranked"), [("ranked", RANKED)]))
def q_precision_recall_by_level_range(t):
    r = E.rank_scores(_unknown_folds(t), "score", "id", ["fold"])
    m = E.metrics_by_level(r, "label", ["fold"])
    return m.select("fold", "level", *[i64(c).alias(c) for c in ("n", "tp", "fp", "fn", "tn")], *_metric_cols())


@register("auc_rank_range", _null_group(AUC_SQL))
def q_auc_rank_range(t):
    r = E.rank_scores(_unknown_folds(t), "score", "id", ["fold"])
    return E.auc(r, "label", "score", ["fold"]).select("fold", r6("auc").alias("auc"))


@register("score_histogram_null_group", _null_group(HISTOGRAM_SQL))
def q_score_histogram_null_group(t):
    return _histogram(_unknown_folds(t))
