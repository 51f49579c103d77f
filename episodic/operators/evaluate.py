"""Score evaluation: top-fraction labels, metrics at population levels,
AUC with ties, score histograms, per-subgroup metrics, fairness crosstab.

Inputs are long score tables ``(group keys..., id, label, score, attrs)``:
any number of folds x models x parameter points in one DataFrame, evaluated
by one grouped job each -- never a per-model driver loop over collected
scores.  Ranking is exact and range-partitioned (see ``ranking.rank``); AUC and
top-k labels need no ranked rows (see ``cutoffs``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cutoffs import _grouped, _joined, cutoffs, in_top
from .ranking import GROUP_N, RANK, rank

# Population levels (percent) of the default metric sweep and
# the metrics computed at each level.
LEVELS = (1, 2, 5, 10, 20, 30, 50)
METRICS = ("accuracy", "precision", "recall", "f1")


def cutoff(n: Column, pct: float, rounding: str = "half_even") -> Column:
    """Number of rows labelled positive at ``pct`` percent of ``n`` rows.

    ``half_even``: ``round(n * pct/100)`` with ties to even; ``floor``:
    ``int(n * pct/100)``.  Same double arithmetic as the scalar original.
    """
    x = n.cast("double") * F.lit(pct / 100.0)
    if rounding == "half_even":
        return F.bround(x, 0).cast("long")
    if rounding == "floor":
        return F.floor(x).cast("long")
    raise ValueError(rounding)


def rank_scores(df: DataFrame, score: str, tiebreak: str | Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """Descending score rank per group, ties broken by the ``tiebreak``
    columns ascending (exact, see ``ranking.rank``)."""
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    return rank(df, [F.col(score).desc_nulls_last(), *[F.col(c).asc() for c in ties]], by, **kw)


def label_top_fraction(df: DataFrame, score: str = "score", tiebreak: str | Sequence[str] = "id", pct: float = 10,
                       by: Sequence[str] = (), rounding: str = "half_even", out: str = "prediction",
                       ranked: bool = False) -> DataFrame:
    """1 for the ``k`` highest scores of each group (``k`` from ``cutoff``), else 0.

    Rows are compared with the last row of their group's top, of which only
    score and tie columns are ranked; with ``ranked`` they are taken as ranked
    by ``rank_scores``.
    """
    if ranked:
        return df.withColumn(out, (F.col(RANK) <= cutoff(F.col(GROUP_N), pct, rounding)).cast("int"))
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    rows, keys = _grouped(df, by)
    ranked = rank_scores(rows.select(*dict.fromkeys([*keys, score, *ties])), score, ties, keys)
    cuts = cutoffs(ranked, cutoff(F.col(GROUP_N), pct, rounding), score, ties, keys)
    held = df.columns
    return _joined(rows, cuts, keys, "left").select(*held, in_top(score, ties).cast("int").alias(out))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b)


def confusion_counts(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp per group in one aggregate."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def metrics_from_counts(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """accuracy, precision (NULL when nothing is predicted), recall (NULL
    without positives), F1 = 2tp / (2tp + fp + fn), 0 when undefined."""
    n = tp + fp + fn + tn
    return {
        "accuracy": _safe_div(tp + tn, n),
        "precision": _safe_div(tp, tp + fp),
        "recall": _safe_div(tp, tp + fn),
        "f1": F.coalesce(_safe_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
    }


def metrics_by_level(ranked: DataFrame, label: str = "label", by: Sequence[str] = (),
                     levels: Sequence[float] = LEVELS, rounding: str = "half_even") -> DataFrame:
    """Long table ``(by..., level, n, tp, fp, fn, tn, accuracy, precision,
    recall, f1)`` from a frame already ranked by ``rank_scores``.

    All levels are counted in a single aggregate (one ``count_if`` per level
    and cell); no row is duplicated per level.
    """
    y = F.col(label) == 1
    aggs = [F.first(GROUP_N).alias("n")]
    for i, lv in enumerate(levels):
        p = F.col(RANK) <= cutoff(F.col(GROUP_N), lv, rounding)
        aggs += [F.count_if(p & y).alias(f"tp{i}"), F.count_if(p & ~y).alias(f"fp{i}"),
                 F.count_if(~p & y).alias(f"fn{i}"), F.count_if(~p & ~y).alias(f"tn{i}")]
    wide = ranked.groupBy(*by).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(float(lv)).alias("level"), F.col(f"tp{i}").alias("tp"),
                               F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"),
                               F.col(f"tn{i}").alias("tn")) for i, lv in enumerate(levels)])
    long = wide.select(*by, "n", F.explode(cells).alias("c")).select(*by, "n", "c.*")
    m = metrics_from_counts(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return long.select(*by, "level", "n", "tp", "fp", "fn", "tn", *[e.alias(k) for k, e in m.items()])


def level_metrics(df: DataFrame, label: str = "label", score: str = "score", tiebreak: str | Sequence[str] = "id",
                  by: Sequence[str] = (), levels: Sequence[float] = LEVELS, rounding: str = "half_even") -> DataFrame:
    """``metrics_by_level`` of scores that aren't ranked yet; only what is needed of a row is ranked."""
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    narrow = df.select(*dict.fromkeys([*by, score, *ties, label]))
    return metrics_by_level(rank_scores(narrow, score, ties, by), label, by, levels, rounding)


def metrics_wide(long: DataFrame, by: Sequence[str], levels: Sequence[float] = LEVELS,
                 metrics: Sequence[str] = METRICS) -> DataFrame:
    """Pivot the long table to ``metric_level`` columns (level-major order)."""
    aggs = []
    for lv in levels:
        for m in metrics:
            aggs.append(F.max(F.when(F.col("level") == float(lv), F.col(m))).alias(f"{m}_{int(lv)}"))
    return long.groupBy(*by).agg(*aggs)


def auc(ranked: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties counted half (Mann-Whitney
    with average ranks).  NULL when a group has only one class.

    From the descending rank: per (group, score) the first rank and counts
    give the average ascending rank of the tie block; one aggregate per
    score value, one per group.
    """
    per_score = ranked.groupBy(*by, score).agg(
        F.min(RANK).alias("_r0"), F.count(F.lit(1)).alias("_c"), F.sum(F.col(label).cast("long")).alias("_p"),
        F.first(GROUP_N).alias("_n"))
    below = F.col("_n") - (F.col("_r0") - 1) - F.col("_c")
    avg_rank = below.cast("double") + (F.col("_c").cast("double") + 1) / 2
    g = per_score.groupBy(*by).agg(
        F.sum(F.col("_p") * avg_rank).alias("_rpos"), F.sum("_p").alias("_P"), F.first("_n").alias("_n"))
    P, N = F.col("_P").cast("double"), (F.col("_n") - F.col("_P")).cast("double")
    u = F.col("_rpos") - P * (P + 1) / 2
    return g.select(*by, F.when((P > 0) & (N > 0), u / (P * N)).alias("auc"))


def score_histogram(df: DataFrame, score: str = "score", by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Equal-width histogram per group: ``(by..., bin, lo, hi, count)``.

    Edges span [min, max] of the group (a constant group uses min +- 0.5);
    the maximum falls into the last bin.
    """
    lo_c = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5)
    hi_c = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_hi") + 0.5)
    if by:
        rng = df.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(
            F.min(score).alias("_lo"), F.max(score).alias("_hi"))
        rng = rng.select(*[f"_g{i}" for i in range(len(by))], lo_c.alias("_lo"), hi_c.alias("_hi"))
        same = F.lit(True)
        for i, c in enumerate(by):  # NULL is a group of its own
            same = same & df[c].eqNullSafe(F.col(f"_g{i}"))
        x = df.join(rng, same)
    else:
        # one group: its range is one row, inlined as literals
        lo, hi = df.agg(F.min(score), F.max(score)).first()
        if lo is not None and hi is not None and hi <= lo:
            lo, hi = lo - 0.5, hi + 0.5
        x = df.withColumn("_lo", F.lit(lo)).withColumn("_hi", F.lit(hi))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(score) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return (x.where(F.col(score).isNotNull()).groupBy(*by, b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
            .select(*by, "bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("hi"),
                    "count"))


def subgroup_tags(df: DataFrame, attr: str, values: Sequence[str], total: str = "TOTAL",
                  out: str = "subgroup") -> DataFrame:
    """Each row once under ``TOTAL`` and once under its attribute value when
    that value is listed (at most two copies per row, never pairs)."""
    tag = F.when(F.col(attr).isin(*values), F.col(attr))
    return df.withColumn(out, F.explode(F.array_compact(F.array(F.lit(total), tag))))


def fairness_crosstab(df: DataFrame, attrs: Sequence[str], label: str = "label", pred: str = "prediction",
                      by: Sequence[str] = (), min_group_size: int | None = None) -> DataFrame:
    """Group counts and rates per attribute value.

    ``ppr`` = predicted positives of the group / all predicted positives,
    ``pprev`` = predicted positives / group size, ``fnr`` = FN/(FN+TP),
    ``fpr`` = FP/(FP+TN), ``for`` = FN/(FN+TN), plus ``fdr``, ``tpr``,
    ``tnr``, ``npv``, ``precision``.  NULL attribute values form their own
    group.  Groups below ``min_group_size`` are dropped.
    """
    stack = ", ".join(f"'{a}', CAST(`{a}` AS STRING)" for a in attrs)
    long = df.select(*by, label, pred, F.expr(f"stack({len(attrs)}, {stack}) AS (attribute_name, attribute_value)"))
    y, p = F.col(label) == 1, F.col(pred) == 1
    g = long.groupBy(*by, "attribute_name", "attribute_value").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.count_if(p).alias("pp"), F.count_if(~p).alias("pn"),
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    w = Window.partitionBy(*by, "attribute_name")  # small: one row per attribute value
    g = g.withColumn("total_pp", F.sum("pp").over(w))
    out = g.select(
        *by, "attribute_name", "attribute_value", "group_size", "pp", "pn", "tp", "fp", "fn", "tn",
        _safe_div(F.col("pp"), F.col("total_pp")).alias("ppr"),
        _safe_div(F.col("pp"), F.col("group_size")).alias("pprev"),
        _safe_div(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"),
        _safe_div(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
        _safe_div(F.col("fn"), F.col("fn") + F.col("tn")).alias("for"),
        _safe_div(F.col("fp"), F.col("pp")).alias("fdr"),
        _safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
        _safe_div(F.col("tn"), F.col("tn") + F.col("fp")).alias("tnr"),
        _safe_div(F.col("tn"), F.col("pn")).alias("npv"),
        _safe_div(F.col("tp"), F.col("pp")).alias("precision"))
    if min_group_size:
        out = out.where(F.col("group_size") >= min_group_size)
    return out
