"""Multinomial naive Bayes over long rows (id, feature, value): counts by one aggregate, scores row by row.

All smoothing constants and both kinds of prior come from the same counts, so
a grid costs one fit.  ``n_features`` counts every feature of the vocabulary,
also those without a value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reuse


def fit_counts(rows: DataFrame, label: str = "label", values: str = "x") -> tuple[DataFrame, dict[int, int]]:
    """``feature, s0, s1``: the sums of values of both labels, feature -1 for all; and the rows of each label."""
    y = F.col(label).cast("int")
    sums = rows.select(y.alias("y"), F.explode(values).alias("feature", "v")).groupBy("feature").agg(
        F.sum(F.when(F.col("y") == 0, F.col("v")).otherwise(0.0)).alias("s0"), F.sum(F.when(F.col("y") == 1, F.col("v")).otherwise(0.0)).alias("s1"))
    sums = reuse(sums, "bayes_counts")
    every = sums.agg(F.coalesce(F.sum("s0"), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("s1"), F.lit(0.0)).alias("s1")).select(F.lit(-1).alias("feature"), "s0", "s1")
    counted = {r[0]: r[1] for r in rows.groupBy(y.alias("y")).count().collect()}
    return sums.unionByName(every), {k: counted.get(k, 0) for k in (0, 1)}


def log_odds(counts: DataFrame, rows_of: dict[int, int], points: Sequence[tuple[float, bool]], n_features: int) -> DataFrame:
    """``alpha, fit_prior, feature, odds``: what a value of the feature adds to the log odds; feature -1 holds the prior's."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(bool(p)).alias("fit_prior")) for a, p in points])).alias("p")
    total = counts.where("feature = -1").first()
    sides = {k: F.log((F.col(f"s{k}") + F.col("alpha")) / (float(total[f"s{k}"]) + F.col("alpha") * n_features)) for k in (0, 1)}
    each = counts.select("feature", "s0", "s1", grid).select("feature", "s0", "s1", "p.alpha", "p.fit_prior")
    prior = F.when(F.col("fit_prior"), F.log(F.lit(float(max(rows_of[1], 1)) / max(rows_of[0], 1)))).otherwise(0.0)
    return each.select("alpha", "fit_prior", "feature", F.when(F.col("feature") == -1, prior).otherwise(sides[1] - sides[0]).alias("odds"))


def bayes_scores(rows: DataFrame, odds: DataFrame, keep: Sequence[str], values: str = "x") -> DataFrame:
    """``keep, alpha, fit_prior, score``: the probability of label 1; features that weren't seen in the fit are left out.

    The odds go to the tasks, a number per feature and point; each row is scored where it is.
    """
    held = odds.select("alpha", "fit_prior", "feature", "odds").collect()
    points = sorted({(r.alpha, r.fit_prior) for r in held})
    features = np.array(sorted({r.feature for r in held}), np.int64)
    table, of = np.zeros((len(points), len(features))), {p: k for k, p in enumerate(points)}
    for r in held:
        table[of[r.alpha, r.fit_prior], np.searchsorted(features, r.feature)] = r.odds or 0.0
    prior = table[:, np.searchsorted(features, -1)]

    @F.arrow_udf("array<double>")
    def margins(x: pa.Array) -> pa.Array:
        offsets = np.asarray(x.offsets).astype(np.int64)
        feature = x.keys.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
        value = x.items.fill_null(0.0).to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
        row = np.repeat(np.arange(len(x)), np.diff(offsets))
        at = np.minimum(np.searchsorted(features, feature), len(features) - 1)
        own = features[at] == feature
        row, at, value = row[own], at[own], value[own]
        out = np.empty((len(x), len(points)))
        for k in range(len(points)):
            out[:, k] = prior[k] + np.bincount(row, table[k, at] * value, minlength=len(x))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(points), pa.int32()), pa.array(out.ravel()))

    named = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(p).alias("fit_prior")) for a, p in points])
    found = rows.where(F.col(values).isNotNull()).select(*keep, F.posexplode(margins(F.col(values))).alias("_p", "_m")).withColumn("_p", named[F.col("_p")])
    return found.select(*keep, "_p.alpha", "_p.fit_prior", (1 / (1 + F.exp(-F.col("_m")))).alias("score"))
