"""Fold preprocessing and feature vectors for the model grid.

Train and test are prepared with statistics fitted on *train only*
(imputation means, min-max ranges, vocabularies), so nothing from the test
year leaks into the features.  Categorical and list features become one
sparse token vector (``CountVectorizerModel.from_vocabulary``, binary) --
never thousands of dense dummy columns.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import add_indicators
from ..operators import preprocess as P
from ..operators.folds import keep_subgroup, test_predicate, train_predicate
from .features import columns_of


#: Folds that are worked on at a time: their jobs share the tasks, the driver plans one while others run.
FOLDS_TOGETHER = 3


@dataclass
class FoldData:
    train: DataFrame
    test: DataFrame
    feature_names: list[str]
    n_train: int
    n_test: int


def _prefixer(name: str):
    return lambda x: F.concat(F.lit(name + "="), x)


def _tokens(codes: list[str], categories: list[str]) -> F.Column:
    parts = [F.transform(F.coalesce(F.split(F.col(c), ","), F.array().cast("array<string>")), _prefixer(c)) for c in codes]
    parts += [F.array(F.concat(F.lit(c + "="), F.col(c))) for c in categories]
    return F.array_compact(F.concat(*parts))


class Folds:
    """The folds of several test years, prepared together when the first is asked for.

    The statistics of all folds come from one series of aggregates: train folds
    only grow with the test year, so a row counts from the first fold that it
    trains (``_first``) on.
    """

    def __init__(self, wide: DataFrame, years: Sequence[int], train_start: int = 1995, gap_days: int = 365, subgroup: tuple[str, str] | None = None):
        self.years = sorted(years)
        self.train_start, self.gap_days = train_start, gap_days
        # the columns say what they are; a table without roles has no features
        self.wide = keep_subgroup(wide, *subgroup) if subgroup else wide
        self.ages, self.counts, self.scaled = (columns_of(wide, *roles) for roles in (["age"], ["count"], ["number", "count", "age"]))
        self.codes, self.categories = columns_of(wide, "codes"), columns_of(wide, "category")
        self.rows: DataFrame | None = None
        self._fitting = threading.Lock()

    def _prepared(self, year: int) -> DataFrame:
        """All rows as the fold of ``year`` prepares them, not scaled yet."""
        x = P.apply_cascade(add_indicators(self.rows, self.ages, "missing"), self.cascades[year])
        return x.fillna("MISSING", subset=["race", "gender"]).fillna(0, subset=self.counts)

    def _fit(self) -> None:
        years = F.array(*[F.lit(int(y)) for y in self.years])
        trained = F.filter(years, lambda y: train_predicate("end_date", self.train_start, y, self.gap_days))
        tests = reduce(lambda a, b: a | b, [test_predicate("end_date", y) for y in self.years])
        rows = self.wide.withColumn("start_year", F.year("start_date")).withColumn("_first", F.try_element_at(trained, F.lit(1))).where(F.col("_first").isNotNull() | tests)
        members = {y: F.col("_first") <= y for y in self.years}
        self.rows, self.cascades = P.fit_cascades(rows, members, "start_year", "offense_codes", "duration_days", *self.ages)

        # least and largest values: of rows by their first fold, imputed ages by fold
        plain = [c for c in self.scaled if c not in self.ages]
        filled = self.rows.fillna(0, subset=self.counts)
        by_first = {r["_first"]: r for r in filled.where(F.col("_first").isNotNull()).groupBy("_first").agg(
            F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"{k}_{c}") for c in plain for k, f in (("lo", F.min), ("hi", F.max))]).collect()}  # a row a fold
        tested = {r["y"]: r["n"] for r in self.rows.where(tests).groupBy(F.year("end_date").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a fold
        self.minmax, self.n_train, self.n_test = {}, {}, {}
        for y in self.years:
            held = [r for f, r in by_first.items() if f <= y]
            ends = P.fit_minmax(self._prepared(y).where(members[y]), self.ages) if self.ages else {}
            for c in plain:
                lo, hi = [r[f"lo_{c}"] for r in held if r[f"lo_{c}"] is not None], [r[f"hi_{c}"] for r in held if r[f"hi_{c}"] is not None]
                ends[c] = (min(lo, default=None), max(hi, default=None))
            self.minmax[y] = {c: ends[c] for c in self.scaled}
            self.n_train[y], self.n_test[y] = sum(r["_n"] for r in held), tested.get(y, 0)

        named = self.rows.where(F.col("_first").isNotNull()).fillna("MISSING", subset=["race", "gender"])
        self.vocabulary = P.first_codes(named.select(F.explode(_tokens(self.codes, self.categories)), "_first"))

    def fold(self, year: int) -> FoldData:
        """Train and test with ``features`` (scaled) and ``nb_features`` (scaled, clamped at 0 for multinomial NB) vectors."""
        with self._fitting:
            if self.rows is None:
                self._fit()
        vocab = sorted(v for v, first in self.vocabulary.items() if first <= year)
        cv = CountVectorizerModel.from_vocabulary(vocab, inputCol="_tok", outputCol="_cat", binary=True)
        flags = [f"{a}_missing" for a in self.ages]
        scaled = P.apply_minmax(self._prepared(year), self.minmax[year])

        def vectors(df):
            d = cv.transform(df.withColumn("_tok", _tokens(self.codes, self.categories))).fillna(0.0, subset=self.scaled)
            d = VectorAssembler(inputCols=self.scaled + flags + ["_cat"], outputCol="features", handleInvalid="keep").transform(d)
            clamped = d.select("*", *[F.greatest(F.col(c), F.lit(0.0)).alias(f"_nb_{c}") for c in self.scaled])
            d = VectorAssembler(inputCols=[f"_nb_{c}" for c in self.scaled] + flags + ["_cat"],
                                outputCol="nb_features", handleInvalid="keep").transform(clamped)
            return d.select("id", "prefix", "start_date", "end_date", "label", "race", "gender", "features",
                            "nb_features")

        train, test = vectors(scaled.where(F.col("_first") <= year)), vectors(scaled.where(test_predicate("end_date", year)))
        return FoldData(train, test, self.scaled + flags + vocab, self.n_train[year], self.n_test[year])


def fold_vectors(wide: DataFrame, test_year: int, train_start: int = 1995, gap_days: int = 365,
                 subgroup: tuple[str, str] | None = None) -> FoldData:
    """Train/test frames of one fold (see ``Folds``)."""
    return Folds(wide, [test_year], train_start, gap_days, subgroup).fold(test_year)
