"""Cutoffs, level metrics and AUC against ranking every whole row."""

import random

import pytest
from pyspark.sql import functions as F

from episodic.operators import cutoffs as C
from episodic.operators import evaluate as E


def scores(spark, n=600, seed=4):
    g = random.Random(seed)
    rows = []
    for i in range(n):
        fold = g.choice([1, 1, 1, 2, None])
        score = None if fold == 2 and g.random() < 0.7 else g.choice([0.5, 0.5, round(g.random(), 2), -1.0])
        rows.append((fold, g.choice(["a", "b"]), i // 2, f"p{i % 2}", g.randrange(2), score))
    rows += [(3, "a", k, "p0", 1, 0.1) for k in range(3)]  # one class, one score
    return spark.createDataFrame(rows, "fold int, kind string, id long, prefix string, label int, score double")


def table(df, *keys):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("ties", [["id", "prefix"], ["prefix", "id"]])
def test_level_metrics_and_labels_equal_ranking(spark, ties):
    df = scores(spark)
    levels = (0.0, 0.1, 5, 10, 33, 50, 100)
    ranked = E.rank_scores(df, "score", ties, ["fold"])
    want = E.metrics_by_level(ranked, "label", ["fold"], levels)
    assert table(E.level_metrics(df, "label", "score", ties, ["fold"], levels)) == table(want)
    for pct in (0.1, 10, 60, 100):
        got = E.label_top_fraction(df, "score", ties, pct, ["fold"], "floor")
        assert got.columns == [*df.columns, "prediction"]
        assert table(got) == table(E.label_top_fraction(ranked, "score", ties, pct, ["fold"], "floor", ranked=True).select(got.columns))


def test_without_groups_and_empty(spark):
    df = scores(spark, 120)
    ranked = E.rank_scores(df, "score", "id")
    assert E.label_top_fraction(df, "score", ["id", "prefix"], 25).agg(F.sum("prediction")).first()[0] == 31
    assert table(E.level_metrics(df, "label", "score", ["id", "prefix"], levels=(10,)).select("n", "level")) == table(E.metrics_by_level(ranked, levels=(10,)).select("n", "level"))
    assert E.level_metrics(df.where("false"), tiebreak="id", by=["fold"]).count() == 0
    assert E.label_top_fraction(df.where("false"), "score", "id").count() == 0


def test_auc_equals_ranking(spark):
    df = scores(spark).where("score is not null")
    ranked = E.rank_scores(df, "score", ["id", "prefix"], ["fold", "kind"])
    got = table(C.auc_of_scores(df, "label", "score", ["fold", "kind"]))
    assert got == table(E.auc(ranked, "label", "score", ["fold", "kind"])) and any(r[-1] is None for r in got)


def test_running_sums_of_many_values(spark):
    g = random.Random(1)
    values = [g.gauss(0, 1) for _ in range(3000)]
    df = spark.createDataFrame([(i % 2, v, i) for i, v in enumerate(values)], "g int, v double, x long")
    got = {(r.g, r.v): (r.before_x, r.all_x) for r in C.running_sums(df, "v", ["g"], ["x"]).collect()}
    for side in (0, 1):
        total = 0
        whole = sum(i for i in range(3000) if i % 2 == side)
        for v, i in sorted(((v, i) for i, v in enumerate(values) if i % 2 == side), reverse=True):
            assert got[side, v] == (total, whole)
            total += i


def test_rows_are_not_ranked_or_written(spark, tmp_path):
    """One lazy plan without a sort of the rows: only counts are shuffled by range."""
    df = scores(spark)
    df.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    plan = C.auc_of_scores(stored, "label", "score", ["fold"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "HashAggregate" in plan
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
