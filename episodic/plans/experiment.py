"""Fold x model-grid runs: scores, results rows, results sink.

``results_rows`` turns one long scores table into the results layout (one
row per model x parameter point x subgroup: descriptors, AUC and
``metric_level`` columns) with two grouped jobs.  ``run_years`` loops over
test years on the driver (a handful of folds), fits the grid for each fold
and puts its rows into a results table whose partitions (year, model) are
replaced as a whole, so that a repeated run doesn't double them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import models as M
from ..operators.cutoffs import auc_of_scores
from ..operators.folds import temporal_train_split
from ..session import reuse
from ..sources.io import append_table
from ..sources.stages import VersionedTable
from .modelling import FOLDS_TOGETHER, Folds

KEEP = ["id", "prefix", "label", "gender", "race"]


def results_rows(scores: DataFrame, year: int, n_train: int, n_features: int, n_test: int, baseline: float,
                 subgroups: Sequence[str] = ("MALE", "FEMALE"), levels=E.LEVELS) -> DataFrame:
    tagged = E.subgroup_tags(scores, "gender", list(subgroups), out="subgroup")
    keys = ["model", "parameters", "subgroup"]
    wide = E.metrics_wide(E.level_metrics(tagged, "label", "score", ["id", "prefix"], keys, levels), keys, levels)
    auc = auc_of_scores(tagged, "label", "score", keys)
    return wide.join(auc, keys).select(
        F.lit(int(year)).alias("year"), F.col("subgroup").alias("gender"), "model",
        F.col("model").alias("classifiers"), "parameters", F.lit(int(n_train)).alias("train_set_size"),
        F.lit(int(n_features)).alias("num_features"), F.lit(int(n_test)).alias("validation_set_size"),
        F.lit(float(baseline)).alias("baseline"), "auc", *[c for c in wide.columns if c not in keys])


def fairness_by_model(scores: DataFrame, pct: float = 10, attrs: Sequence[str] = ("race", "gender"),
                      min_group_size: int | None = None) -> DataFrame:
    """Fairness crosstab of every (model, parameters) at once: each model's
    top ``pct`` percent of the fold is predicted positive, then counts and
    rates per attribute value -- one grouped job for the whole grid."""
    keys = ["model", "parameters"]
    pred = E.label_top_fraction(scores, "score", ["id", "prefix"], pct, by=keys)
    return E.fairness_crosstab(pred, list(attrs), "label", "prediction", keys, min_group_size)


def predictions(scores: DataFrame, year: int, pct: float = 10) -> DataFrame:
    """Every fit's scores with the label its top ``pct`` percent gives."""
    pred = E.label_top_fraction(scores, "score", ["id", "prefix"], pct, by=["model", "parameters"])
    return pred.select(F.lit(int(year)).alias("year"), "model", "parameters", *KEEP, "score", "prediction")


def histograms(scores: DataFrame, year: int, bins: int = 10) -> DataFrame:
    """The score histogram of every fit."""
    return E.score_histogram(scores, "score", ["model", "parameters"], bins).withColumn("year", F.lit(int(year)))


def run_fold(wide: DataFrame, year: int, models: Sequence[str], grid: dict, train_start: int = 1995,
             gap_days: int = 365, exclude: tuple[str, str] | None = None,
             subgroups: Sequence[str] = ("MALE", "FEMALE"), outputs: str | None = None, folds: Folds | None = None) -> DataFrame:
    """Result rows of one fold, taken from ``folds`` where they were prepared together.  With ``outputs`` every fit's predictions, histogram and fairness table, the feature
    list and the complete importances are appended below that folder, partitioned by year."""
    fd = (folds or Folds(wide, [year], train_start, gap_days, exclude)).fold(year)
    train, test = reuse(fd.train, "fold_train"), reuse(fd.test, "fold_test")
    kept: list = []
    scores = reuse(M.run_grid(train, test, models, grid, KEEP, nb_features="nb_features", importances=kept,
                              names=fd.feature_names), "scores")
    base = test.agg(F.avg("label")).first()[0] or 0.0
    if outputs:
        spark, at = wide.sparkSession, outputs.rstrip("/")
        append_table(predictions(scores, year), f"{at}/predictions", partition_by=["year"])
        append_table(histograms(scores, year), f"{at}/histograms", partition_by=["year"])
        append_table(fairness_by_model(scores).withColumn("year", F.lit(int(year))), f"{at}/fairness", partition_by=["year"])
        names = spark.createDataFrame([(int(year), i, n) for i, n in enumerate(fd.feature_names)], "year int, position int, feature string")
        append_table(names, f"{at}/features", partition_by=["year"])
        if kept:
            append_table(spark.createDataFrame([(int(year), *r) for r in kept], "year int, " + M.IMPORTANCE), f"{at}/importances", partition_by=["year"])
    return results_rows(scores, year, fd.n_train, len(fd.feature_names), fd.n_test, base, subgroups)


def test_years(wide: DataFrame, train_start: int = 1995, gap_days: int = 365, exclude: tuple[str, str] | None = None) -> list[int]:
    """Every end year with a train fold before it, in order."""
    if exclude:
        wide = wide.where(~F.col(exclude[0]).eqNullSafe(exclude[1]))
    years = sorted(r[0] for r in wide.select(F.year("end_date")).distinct().collect() if r[0] is not None)  # one row per year
    return [y for y in years if not temporal_train_split(wide, "end_date", train_start, y, gap_days).isEmpty()]


def run_years(wide: DataFrame, years: Sequence[int], results_path: str, models: Sequence[str] = M.DEFAULT_MODELS,
              grid_size: str = "small", train_start: int = 1995, gap_days: int = 365,
              exclude: tuple[str, str] | None = None, subgroups: Sequence[str] = ("MALE", "FEMALE"),
              outputs: str | None = None) -> DataFrame:
    """Results rows of every test year in the table at ``results_path``, partitioned by year and model; the whole table.

    A year whose rows were written by an earlier call with the same table and
    settings is skipped, so a loop that was interrupted goes on where it
    stopped; with other settings its partitions are replaced.  ``outputs`` as
    in ``run_fold``.
    """
    table = VersionedTable(wide.sparkSession, results_path, ["year", "model"])
    basis = [sorted(wide.inputFiles()), list(models), grid_size, train_start, gap_days, exclude, list(subgroups)]
    notes = {y: hashlib.sha256(json.dumps([y, *basis]).encode()).hexdigest() for y in years}
    written = table.notes()
    folds = Folds(wide, years, train_start, gap_days, exclude)

    # a year's rows are written while the next years are fitted
    with ThreadPoolExecutor(FOLDS_TOGETHER) as ex:
        for done in [ex.submit(table.replace, run_fold(wide, y, models, M.GRIDS[grid_size], train_start, gap_days, exclude, subgroups, outputs, folds), notes[y])
                     for y in years if notes[y] not in written]:
            done.result()
    return table.read()
