"""Model selection on results tables (one row per fold x subgroup x model x
parameter point): best per year, subgroup view of the best, top-k, cross-year
stability, metric series across years.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import best_per_group, rank_within, top_k, top_k_per_group

__all__ = ["best_per_group", "top_k", "top_k_per_group", "subgroup_of_best", "stability_score",
           "metric_series", "param_mean"]


def subgroup_of_best(subgroup_results: DataFrame, best: DataFrame, on: Sequence[str] = ("year", "parameters")) -> DataFrame:
    """Rows of a subgroup's results whose (year, parameters) were best overall."""
    keys = best.select(*on).distinct()
    return subgroup_results.join(keys, list(on), "left_semi")


def stability_score(results: DataFrame, metric: str, time_col: str = "year",
                    keys: Sequence[str] = ("classifiers", "parameters"),
                    numeric: Sequence[str] = ()) -> DataFrame:
    """Zero-based rank of each model within its year by ``metric``
    (descending, ties broken by the model keys), then the mean of the rank
    and of ``numeric`` columns per model across years; best (lowest mean
    rank) first."""
    ranked = rank_within(results, [time_col], metric, tiebreak=list(keys), out="rank")
    cols = list(dict.fromkeys([*numeric, "rank"]))
    return (ranked.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])
            .orderBy(F.col("rank").asc(), *[F.col(k) for k in keys]))


def metric_series(results: DataFrame, metric: str, series: Sequence[tuple[str | None, str]],
                  names: Sequence[str] | None = None, time_col: str = "year",
                  baseline: DataFrame | None = None) -> DataFrame:
    """One row per year, one column per (model, parameters) series.

    A series with model None matches on parameters only (the historical
    behaviour); otherwise both must match.  ``baseline`` is an optional
    ``(year, baseline)`` frame joined as an extra column.
    """
    names = list(names or [f"{m} {p}" if m else p for m, p in series])
    tag = F.lit(None).cast("string")
    for (m, p), n in reversed(list(zip(series, names))):
        cond = F.col("parameters") == p
        if m is not None:
            cond = cond & (F.col("model") == m)
        tag = F.when(cond, F.lit(n)).otherwise(tag)
    tagged = results.withColumn("_series", tag).where(F.col("_series").isNotNull())
    wide = tagged.groupBy(time_col).pivot("_series", names).agg(F.max(metric))
    if baseline is not None:
        wide = wide.join(baseline, time_col, "left")
    return wide


def param_mean(results: DataFrame, parameters: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of ``metric`` for one parameter point (across years)."""
    return (results.where(F.col("parameters") == parameters)
            .groupBy(*by, "parameters").agg(F.avg(metric).alias(metric)))
