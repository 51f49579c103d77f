"""Scalars, fills, scaling, encoders, deciles, imputation."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodic.functions import frames as FR
from episodic.functions import scalars as S
from episodic.operators import preprocess as P
from episodic.operators.features import DuplicateKeyError, assert_unique_keys, distinct_lists


def test_least_strict_and_sentinels(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 2), None), (dt.date(2000, 1, 2), dt.date(2000, 1, 1)),
                                (dt.date(1, 1, 1), dt.date(2000, 1, 1))], "a date, b date")
    out = df.select(S.least_strict("a", "b").alias("m"), S.sentinel_to_null("a").alias("s")).collect()
    assert out[0]["m"] is None and out[1]["m"] == dt.date(2000, 1, 1) and out[2]["s"] is None


def test_flags_and_codes(spark):
    df = spark.createDataFrame([("Y", "FEMALE"), ("CLOSED", "M"), ("maybe", None)], "open_flag string, g string")
    out = FR.binary_to_dummy(FR.flag_to_dummy(df, ["open_flag"]), "g").collect()
    assert [(r["open"], r["female"]) for r in out] == [(1, 1), (0, 0), (None, None)]
    with pytest.raises(ValueError):
        FR.flag_to_dummy(df.withColumnRenamed("open_flag", "flag"), ["flag"])


def test_constant_column_scales_to_zero_and_outliers_null(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r["x"] for r in P.apply_minmax(df, P.fit_minmax(df, ["x"])).collect()] == [0.0, 0.0]
    assert [r["x"] for r in P.null_outliers(df, ["x"]).collect()] == [None, None]


def test_scale_then_invert_is_identity(spark):
    df = spark.createDataFrame([(float(i * 7 % 11),) for i in range(20)], "x double")
    st = P.fit_minmax(df, ["x"])
    back = P.invert_minmax(P.apply_minmax(df, st), st)
    assert all(abs(a["x"] - b["x"]) < 1e-9 for a, b in zip(df.collect(), back.collect()))


def test_unseen_category_all_zero_and_alignment(spark):
    train = spark.createDataFrame([("A",), ("B",)], "c string")
    test = spark.createDataFrame([("C",), (None,)], "c string")
    out = P.apply_one_hot(test, "c", P.fit_vocabulary(train, "c")).collect()
    assert [(r["c_A"], r["c_B"]) for r in out] == [(0, 0), (0, 0)]
    aligned = P.align_to_train(test.select(F.lit(1).alias("c_C")), ["c_A", "c_B"])
    assert aligned.columns == ["c_A", "c_B"]


def test_decile_edges_collapse(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (1.0,), (2.0,), (None,)], "x double")
    out = [r["xcat"] for r in P.discretise(df, ["x"]).collect()]
    # edges 0, .4, .8, 1.2, 1.6, 2 (linear interpolation, duplicates dropped)
    assert out[:5] == [0, 0, 0, 2, 4] and out[5] is None


def test_fill_functions(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (10.0,)], "x double")
    assert P.fill_nan(df, ["x"], "median").collect()[2]["x"] == 3.0
    assert P.fill_by_aggregate(df, "x", F.max).collect()[2]["x"] == 10.0
    with pytest.raises(ValueError):
        P.fill_nan(df, ["x"], "mode")


def test_impute_group_mean(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (1, "a", None), (2, "b", None), (None, "a", None), (1, "a", 20.0)],
                               "y int, c string, t double")
    out = [r["t"] for r in P.impute_group_mean(df, "y", "c", "t").collect()]
    assert out[1] == 15.0 and out[2] == 15.0 and out[3] == 15.0


def test_list_of_only_nulls_is_null_and_delimiter_scrubbed(spark):
    eps = spark.createDataFrame([(1, 1), (1, 2)], "id long, prefix long")
    kids = spark.createDataFrame([(1, 1, None), (1, 1, None), (1, 2, "A,B"), (1, 2, "C")],
                                 "id long, prefix long, code string")
    out = {r["prefix"]: r["codes"] for r in
           distinct_lists(eps, kids, ["id", "prefix"], {"code": "codes"}, keep="all", scrub=True).collect()}
    assert out == {1: None, 2: "AB,C"}


def test_duplicate_attribute_key_fails(spark):
    with pytest.raises(DuplicateKeyError):
        assert_unique_keys(spark.createDataFrame([(1,), (1,)], "id long"), ["id"])


def test_null_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "a long, b string")
    assert [(r["column_name"], r["n_null"]) for r in P.null_columns(df).collect()] == [("b", 1)]


def test_keep_null_inequality(spark):
    df = spark.createDataFrame([("FEMALE",), (None,), ("MALE",)], "g string")
    assert df.where(S.not_equal_keep_null("g", "FEMALE")).count() == 2


def test_quantiles_equal_the_builtin_over_several_columns(spark):
    df = spark.range(997).select((F.pmod(F.col("id") * 7919, F.lit(101)) / 3).alias("x"), F.when(F.col("id") % 4 > 0, F.col("id") * 1.5).alias("y"),
                                 F.lit(None).cast("double").alias("z"))
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, ps))).alias(c) for c in "xyz"]).first()
    got = P.fit_quantiles(df, ["x", "y", "z"], ps)
    for c in "xy":
        assert got[c] == pytest.approx(list(want[c]))
    assert got["z"] == [None] * 6


def test_vocabulary_fails_loudly_beyond_its_limit(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("c"))
    assert len(P.fit_vocabulary(df, "c", most=30)) == 30
    with pytest.raises(ValueError):
        P.fit_vocabulary(df, "c", most=29)


def test_cascades_of_several_folds_equal_single_ones(spark):
    g = np.random.default_rng(3)
    data = []
    for i in range(300):
        start, length, first = float(g.integers(20, 60)), float(g.integers(1, 900)), float(g.integers(10, 20))
        lost = g.random(4) < 0.3
        data.append((i, int(g.integers(1, 9)), None if lost[3] and i % 2 else int(g.integers(1995, 1998)), None if i % 11 == 0 else "abc"[g.integers(3)],
                     None if i % 17 == 0 else length, None if lost[0] else start, None if lost[1] else start + length / 365, None if lost[2] else first))
    df = spark.createDataFrame(data, "id int, fold int, year int, code string, days double, age_start double, age_end double, age_first double")
    cols = ["year", "code", "days", "age_start", "age_end", "age_first"]
    folds = {k: F.col("fold") <= k for k in (0, 2, 8)}  # no row is in the first
    rows, stats = P.fit_cascades(df, folds, *cols)
    for k, inside in folds.items():
        one = P.fit_cascade(df.where(inside), *cols)
        want = {r.id: r[5:] for r in P.apply_cascade(df, one).collect()}
        got = {r.id: r[5:8] for r in P.apply_cascade(rows, stats[k]).collect()}
        assert len(got) == 300 and got.keys() == want.keys()
        assert all(a == pytest.approx(b) for i in want for a, b in zip(got[i], want[i]))


def test_codes_count_from_their_first_fold(spark):
    codes = spark.createDataFrame([("a", 1999), ("b", 1998), ("a", 1997), (None, 1990)], "v string, n int")
    assert P.first_codes(codes) == {"a": 1997, "b": 1998}
    with pytest.raises(ValueError):
        P.first_codes(codes, most=1)
