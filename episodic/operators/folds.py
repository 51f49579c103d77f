"""Temporal validation: expanding-window train/test folds with a label gap.

Train rows of fold ``y`` end on or after ``train_start`` and more than
``gap_days`` before ``y``-01-01, so every training label (which looks
``gap_days`` ahead) is observed before the test year starts; test rows end
in year ``y``.  All cuts are date-range predicates on the end date, so they
push down to Parquet row groups (and prune ``end_year`` partitions when the
feature table is written partitioned by it).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _jan1(year) -> Column:
    y = F.lit(year) if isinstance(year, int) else year
    return F.make_date(y, F.lit(1), F.lit(1))


def train_predicate(end: str, train_start_year: int, test_year, gap_days: int = 365) -> Column:
    return (F.col(end) >= _jan1(train_start_year)) & (F.col(end) < F.date_sub(_jan1(test_year), gap_days))


def test_predicate(end: str, test_year) -> Column:
    y = F.lit(test_year) if isinstance(test_year, int) else test_year
    return (F.col(end) >= _jan1(y)) & (F.col(end) < _jan1(y + 1))


def temporal_train_split(df: DataFrame, end: str, train_start_year: int, test_year: int,
                         gap_days: int = 365) -> DataFrame:
    return df.where(train_predicate(end, train_start_year, test_year, gap_days))


def temporal_test_split(df: DataFrame, end: str, test_year: int) -> DataFrame:
    return df.where(test_predicate(end, test_year))


def temporal_folds(df: DataFrame, end: str, train_start_year: int, test_years: Sequence[int],
                   gap_days: int = 365, fold_col: str = "fold", role_col: str = "role") -> DataFrame:
    """Every row tagged with each (fold, role) it belongs to, in one pass.

    A row appears once per fold that uses it (expanding windows re-use old
    rows by design); the fold list is a literal array, so no join and no
    per-fold rescan of the input.  Rows outside all folds are cut by one date
    range, which reaches the scan.
    """
    if not test_years:
        return df.where(F.lit(False)).select(F.lit(0).alias(fold_col), F.lit("").alias(role_col), *df.columns)
    df = df.where((F.col(end) >= F.lit(date(min(train_start_year, *test_years), 1, 1))) & (F.col(end) < F.lit(date(max(test_years) + 1, 1, 1))))
    years = F.array(*[F.lit(int(y)) for y in test_years])
    train_of = F.filter(years, lambda y: train_predicate(end, train_start_year, y, gap_days))
    test_of = F.filter(years, lambda y: test_predicate(end, y))
    tags = F.concat(
        F.transform(train_of, lambda y: F.struct(y.alias(fold_col), F.lit("train").alias(role_col))),
        F.transform(test_of, lambda y: F.struct(y.alias(fold_col), F.lit("test").alias(role_col))))
    return df.select("*", F.explode(tags).alias("_t")).select("_t.*", *df.columns)


def keep_subgroup(df: DataFrame, attr: str, exclude: str) -> DataFrame:
    """Rows whose ``attr`` is not ``exclude``; rows with a missing value stay."""
    return df.where(~F.col(attr).eqNullSafe(F.lit(exclude)))
