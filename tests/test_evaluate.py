"""Ranking, top-fraction labels, metrics, AUC, fairness: edge rows and
properties."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from episodic.operators import evaluate as E
from episodic.operators.ranking import GROUP_N, RANK, rank

from .naive import rank_by_window


def scored(spark, n, score=None, label=None, group=None):
    data = [(i, group(i) if group else 0, (label(i) if label else i % 2), float(score(i) if score else i))
            for i in range(n)]
    return spark.createDataFrame(data, "id long, fold int, label int, score double")


def positives(df, pct, rounding="half_even"):
    return sum(r["prediction"] for r in E.label_top_fraction(df, pct=pct, rounding=rounding).collect())


def test_cutoffs_half_even_and_floor(spark):
    assert positives(scored(spark, 5), 10) == 0      # 0.5 -> 0
    assert positives(scored(spark, 25), 10) == 2     # 2.5 -> 2
    assert positives(scored(spark, 35), 10) == 4     # 3.5 -> 4
    assert positives(scored(spark, 35), 10, "floor") == 3


def test_tied_scores_take_lowest_ids(spark):
    df = scored(spark, 20, score=lambda i: 1.0)
    chosen = sorted(r["id"] for r in E.label_top_fraction(df, pct=10).collect() if r["prediction"] == 1)
    assert chosen == [0, 1]


def test_rank_equals_the_plain_window(spark):
    """A dominant group, a NULL group and small groups, at several partition counts."""
    rnd = random.Random(7)
    data = [(i, (0 if rnd.random() < 0.6 else rnd.choice([None, 1, 2, 3])), rnd.randint(0, 30)) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, g int, s long")
    order = [F.col("s").desc(), F.col("id").asc()]
    key = lambda d: {r["id"]: (r[RANK], r[GROUP_N]) for r in d.collect()}
    want = key(rank_by_window(df, order, ["g"]))
    assert len(want) == 3000
    for n in (1, 13):
        assert key(rank(df, order, ["g"], num_partitions=n)) == want


def test_several_tiebreak_columns(spark):
    df = spark.createDataFrame([(1, k, 1.0, 0) for k in range(20)], "id long, prefix long, score double, label int")
    top = E.label_top_fraction(df, tiebreak=["id", "prefix"], pct=10).where("prediction = 1")
    assert sorted(r["prefix"] for r in top.collect()) == [0, 1]


def test_histogram_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 0.1), (None, 0.9), (1, 0.5), (1, 0.7)], "g int, score double")
    got = {r["g"]: 0 for r in E.score_histogram(df, by=["g"], bins=2).collect()}
    assert set(got) == {None, 1}
    assert sum(r["count"] for r in E.score_histogram(df, by=["g"], bins=2).collect()) == 4


def metric_row(df, pct=10):
    r = E.rank_scores(df, "score", "id")
    return E.metrics_by_level(r, "label", levels=[pct]).collect()[0]


def test_no_positives_precision_null_f1_zero(spark):
    m = metric_row(scored(spark, 20, label=lambda i: 0))
    assert m["precision"] == 0.0 or m["tp"] == 0
    assert m["recall"] is None and m["f1"] == 0.0
    none_pred = E.metrics_from_counts(F.lit(0), F.lit(0), F.lit(3), F.lit(7))
    out = spark.range(1).select(*[v.alias(k) for k, v in none_pred.items()]).first()
    assert out["precision"] is None and out["f1"] == 0.0 and out["recall"] == 0.0


def auc_of(df):
    r = E.rank_scores(df, "score", "id")
    return E.auc(r).first()["auc"]


def test_auc_ties_and_one_class(spark):
    assert auc_of(scored(spark, 10, score=lambda i: 0.3)) == 0.5
    assert auc_of(scored(spark, 10, label=lambda i: 1)) is None


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=40))
def test_auc_brute_force_and_symmetry(spark, data):
    df = spark.createDataFrame([(i, 0, y, float(s)) for i, (y, s) in enumerate(data)],
                               "id long, fold int, label int, score double")
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    got = auc_of(df)
    if not pos or not neg:
        assert got is None
        return
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(got - brute) < 1e-9
    flipped = auc_of(df.withColumn("score", -F.col("score")))
    assert abs(flipped - (1 - got)) < 1e-9


def test_precision_times_pp_equals_recall_times_p(spark):
    df = scored(spark, 200, score=lambda i: (i * 37) % 101, label=lambda i: int(i % 3 == 0))
    for m in E.metrics_by_level(E.rank_scores(df, "score", "id"), "label").collect():
        pp, p = m["tp"] + m["fp"], m["tp"] + m["fn"]
        if pp and p:
            assert abs(m["precision"] * pp - m["recall"] * p) < 1e-9


def test_subgroup_tags_at_most_two_copies(spark):
    df = spark.createDataFrame([(1, "MALE"), (2, None), (3, "OTHER")], "id long, gender string")
    out = sorted((r["id"], r["subgroup"]) for r in E.subgroup_tags(df, "gender", ["MALE", "FEMALE"]).collect())
    assert out == [(1, "MALE"), (1, "TOTAL"), (2, "TOTAL"), (3, "TOTAL")]


def test_fairness_rates(spark):
    df = spark.createDataFrame([(1, 1, "A"), (0, 1, "A"), (1, 0, "A"), (0, 0, "B"), (1, 1, "B")],
                               "label int, prediction int, race string")
    x = {r["attribute_value"]: r for r in E.fairness_crosstab(df, ["race"]).collect()}
    assert x["A"]["group_size"] == 3 and abs(x["A"]["ppr"] - 2 / 3) < 1e-12
    assert abs(x["A"]["fnr"] - 0.5) < 1e-12 and x["B"]["fpr"] == 0.0


def test_histogram_puts_max_in_last_bin(spark):
    df = scored(spark, 11)
    h = {r["bin"]: r["count"] for r in E.score_histogram(df, "score", bins=10).collect()}
    assert h[9] == 2 and sum(h.values()) == 11
