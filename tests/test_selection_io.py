"""Model selection on results tables and table round trips."""

from pyspark.sql import functions as F

from episodic.operators import selection as SEL
from episodic.sources import io as IO


def results(spark):
    rows = [(2010, "A", "p1", 0.5), (2010, "B", "p2", 0.7), (2010, "C", "p3", 0.7),
            (2011, "A", "p1", 0.9), (2011, "B", "p2", 0.1), (2011, "C", "p3", 0.3)]
    return spark.createDataFrame(rows, "year int, classifiers string, parameters string, recall_10 double") \
        .withColumn("model", F.col("classifiers"))


def test_best_per_year_keeps_ties(spark):
    best = sorted((r["year"], r["classifiers"]) for r in SEL.best_per_group(results(spark), ["year"], "recall_10").collect())
    assert best == [(2010, "B"), (2010, "C"), (2011, "A")]


def test_top_k_and_per_group(spark):
    r = results(spark)
    assert [x["recall_10"] for x in SEL.top_k(r, "recall_10", 2, ["year"]).collect()] == [0.9, 0.7]
    per = SEL.top_k_per_group(r, ["year"], "recall_10", 1, ["classifiers"]).collect()
    assert sorted((x["year"], x["classifiers"]) for x in per) == [(2010, "B"), (2011, "A")]


def test_stability_ranks_zero_based_mean(spark):
    out = {r["classifiers"]: r["rank"] for r in SEL.stability_score(results(spark), "recall_10").collect()}
    # 2010: B=0, C=1 (tie broken by name), A=2; 2011: A=0, C=1, B=2
    assert out == {"A": 1.0, "B": 1.0, "C": 1.0}


def test_metric_series_filters_model_and_parameters(spark):
    wide = SEL.metric_series(results(spark), "recall_10", [("A", "p1"), (None, "p3")], ["a", "any3"])
    got = {r["year"]: (r["a"], r["any3"]) for r in wide.collect()}
    assert got == {2010: (0.5, 0.7), 2011: (0.9, 0.3)}


def test_subgroup_of_best(spark):
    best = SEL.best_per_group(results(spark), ["year"], "recall_10")
    male = results(spark).withColumn("recall_10", F.col("recall_10") / 2)
    got = sorted((r["year"], r["parameters"]) for r in SEL.subgroup_of_best(male, best).collect())
    assert got == [(2010, "p2"), (2010, "p3"), (2011, "p1")]


def test_materialise_append_and_read_years(spark):
    df = results(spark)
    path = IO.scratch_path(spark, "results_t")
    IO.append_table(df.where(F.col("year") == 2010), path, partition_by=["year"])
    IO.append_table(df.where(F.col("year") == 2011), path, partition_by=["year"])
    assert IO.read_years(spark, path, [2011]).count() == 3
    back = IO.materialise(df, IO.scratch_path(spark, "mat"))
    assert sorted(back.collect()) == sorted(df.collect())
