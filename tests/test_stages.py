"""Stages that are built when missing, and the table whose partitions are replaced."""

import pytest
from pyspark.sql import functions as F

from episodic.sources.stages import RECORD, Stages, VersionedTable


def test_only_dependents_of_a_change_are_built(spark, tmp_path):
    calls = []
    source, other = str(tmp_path / "source"), str(tmp_path / "other")
    spark.range(10).write.parquet(source)
    spark.range(3).write.parquet(other)

    def run():
        s = Stages(spark, f"file://{tmp_path}/stages")
        a = s.table("a", lambda: calls.append("a") or spark.read.parquet(source), inputs=[source])
        b = s.table("b", lambda: calls.append("b") or spark.read.parquet(other), inputs=[other])
        c = s.table("c", lambda: calls.append("c") or a.groupBy((F.col("id") % 2).alias("k")).count(), after=["a"], partition_by=["k"])
        return a.count(), b.count(), sorted(r["count"] for r in c.collect()), s.built

    assert run() == (10, 3, [5, 5], ["a", "b", "c"])
    assert run() == (10, 3, [5, 5], []) and calls == ["a", "b", "c"]
    spark.range(2).write.mode("append").parquet(source)
    assert run() == (12, 3, [6, 6], ["a", "c"])
    with pytest.raises(KeyError):
        Stages(spark, str(tmp_path / "x")).table("d", lambda: None, after=["never"])


def test_interrupted_stage_is_built_again(spark, tmp_path):
    def failing():
        raise RuntimeError("lost")

    s = Stages(spark, f"file://{tmp_path}/s")
    with pytest.raises(RuntimeError):
        s.table("a", failing)
    path = next((tmp_path / "s").glob("a/*"), None)
    assert path is None or not (path / RECORD).exists()
    first = Stages(spark, f"file://{tmp_path}/s")
    first.table("a", lambda: spark.range(4))
    record = next((tmp_path / "s").glob(f"a/*/{RECORD}"))
    record.unlink()  # files were written, the record wasn't
    again = Stages(spark, f"file://{tmp_path}/s")
    assert again.table("a", lambda: spark.range(4)).count() == 4 and again.built == ["a"]


def test_partitions_are_replaced_and_unfinished_writes_ignored(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", ["year", "model"])
    with pytest.raises(FileNotFoundError):
        t.read()
    rows = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.6), (2, "A", 0.7), (None, "A", 0.9)], "year int, model string, auc double")
    t.replace(rows, "first")
    t.replace(rows)
    spark.createDataFrame([(1, "A", 9.0)], rows.schema).write.partitionBy("year", "model").parquet(f"{t.path}/data/version=lost")
    t.replace(spark.createDataFrame([(1, "A", 0.1), (1, "A", 0.2)], rows.schema))
    want = [("None", "A", 0.9), ("1", "A", 0.1), ("1", "A", 0.2), ("1", "B", 0.6), ("2", "A", 0.7)]
    got = lambda: sorted((str(r.year), r.model, r.auc) for r in t.read().collect())
    assert got() == sorted(want) and "first" in t.notes()
    assert t.drop_superseded() == 2 and got() == sorted(want)


def test_year_loop_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from episodic.plans import experiment

    spark.range(1).write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    seen = []

    def run_fold(wide, year, models, *rest):
        seen.append(year)
        if seen == [1997, 1998]:
            raise RuntimeError("lost")
        return spark.createDataFrame([(year, m, len(seen)) for m in models], "year int, model string, n int")

    monkeypatch.setattr(experiment, "run_fold", run_fold)
    path = f"file://{tmp_path}/results"
    with pytest.raises(RuntimeError):
        experiment.run_years(wide, [1997, 1998, 1999], path, ["LR", "DT"])
    once = experiment.run_years(wide, [1997, 1998, 1999], path, ["LR", "DT"])
    assert seen == [1997, 1998, 1998, 1999] and once.count() == 6
    assert experiment.run_years(wide, [1997, 1998, 1999], path, ["LR", "DT"]).count() == 6 and len(seen) == 4
    assert experiment.run_years(wide, [1997], path, ["LR", "DT"], gap_days=30).where("year = 1997").count() == 2 and len(seen) == 5
