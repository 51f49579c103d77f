"""Sources/sinks, folds, model helpers, plan shape and the driver contract."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from episodic.operators import folds as T
from episodic.operators import models as M
from episodic.sources import io as IO

from .conftest import SF_SMALL


def test_csv_short_rows_dropped_long_rows_rejected(spark):
    path = IO.scratch_path(spark, "csvtest")
    bad = IO.scratch_path(spark, "bad")
    spark.createDataFrame([("a,b,c",), ('1,"x,y",3',), ("4,5",), ("6,7,8,9",), ("10,,12",), ("7,8,9,",), ("1,2,3,,5",)], "value string") \
        .coalesce(1).write.text(path)
    out = IO.read_csv_checked(spark, path, bad).collect()
    assert [(r["a"], r["b"], r["c"]) for r in out] == [("1", "x,y", "3"), ("10", None, "12")]
    assert sorted(r["value"] for r in spark.read.text(bad).collect()) == ["1,2,3,,5", "6,7,8,9", "7,8,9,"]


def test_csv_keeps_quotes_lines_and_several_files(spark):
    path = IO.scratch_path(spark, "csvtest")
    rows = [(str(i), x) for i, x in enumerate(['a"b', "line\nend", 'q",c', "plain", "k,e\n\"", None, "back\\slash", '""'])]
    IO.write_csv(spark.createDataFrame(rows, "k string, v string").repartition(3), path)
    out = IO.read_csv_checked(spark, path, IO.scratch_path(spark, "bad"))
    assert sorted((r["k"], r["v"]) for r in out.collect()) == rows


def test_materialise_refuses_its_own_input(spark):
    path = IO.scratch_path(spark, "own")
    df = IO.materialise(spark.range(5), path)
    with pytest.raises(ValueError):
        IO.materialise(df.where("id > 1"), path)
    assert IO.materialise(spark.range(3), path).count() == 3


def test_folds_push_a_date_range(spark):
    path = IO.scratch_path(spark, "dated")
    df = IO.materialise(spark.sql("select id, date_add(date'1990-01-01', cast(id * 40 as int)) as end_date from range(300)"), path)
    folds = T.temporal_folds(df, "end_date", 1995, [1999, 2001])
    assert "GreaterThanOrEqual(end_date" in folds._jdf.queryExecution().executedPlan().toString()
    want = sum(T.temporal_train_split(df, "end_date", 1995, y).count() + T.temporal_test_split(df, "end_date", y).count() for y in (1999, 2001))
    assert folds.count() == want
    assert T.temporal_folds(df, "end_date", 1995, []).count() == 0


def test_boolean_flags_and_whole_numbers(spark):
    from episodic.functions import scalars as S

    got = spark.createDataFrame([(True,), (False,), (None,)], "f boolean").select(S.flag_to_dummy("f").alias("d")).collect()
    assert [r["d"] for r in got] == [1, 0, None]
    df = spark.createDataFrame([("1", "1.5"), ("x", "2"), (None, "3")], "a string, b string")
    assert S.numeric_column(S.numeric_column(df, "a"), "b").dtypes == [("a", "bigint"), ("b", "double")]


def test_fixed_width_and_names(spark):
    lines = spark.createDataFrame([("12  ab?c  x\u0000",)], "value string")
    out = IO.cut_fixed_width(lines, [("k", 1, 4), ("v", 5, 6), ("z", 11, 2)], strip="?\u0000").first()
    assert (out["k"], out["v"], out["z"]) == ("12", "abc", "x")
    assert IO.clean_name("Birth Date (M/D/Y)") == "BirthDateMDY"
    with pytest.raises(ValueError):
        IO.clean_column_names(spark.createDataFrame([(1, 2)], "`a.b` int, `ab` int"))


def test_require_inputs(spark):
    with pytest.raises(IO.MissingInputError):
        IO.require_inputs(spark, ["/nonexistent/episodic/input"])
    IO.require_inputs(spark, [f"{SF_SMALL}/orders.parquet"])


def test_folds_gap_and_tags(spark):
    df = spark.createDataFrame([(1, dt.date(1996, 6, 1)), (2, dt.date(1997, 3, 1)), (3, dt.date(1998, 2, 1))],
                               "id long, end_date date")
    tr = [r["id"] for r in T.temporal_train_split(df, "end_date", 1995, 1998, 365).collect()]
    assert tr == [1]  # 1997-03-01 is within the 365-day gap before 1998
    tags = sorted((r["fold"], r["role"], r["id"]) for r in T.temporal_folds(df, "end_date", 1995, [1998]).collect())
    assert tags == [(1998, "test", 3), (1998, "train", 1)]


def test_parameter_grid_sizes():
    small = sum(len(M.parameter_grid(M.GRIDS["small"][m])) for m in M.DEFAULT_MODELS)
    assert small == 108
    assert len(M.parameter_grid(M.GRIDS["large"]["RF"])) == 300


def test_knn_blocks_are_exact(spark):
    rows = [(i, [float(i % 7), float(i % 5)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label long")
    train, test = df.where(F.col("id") % 2 == 0), df.where(F.col("id") % 2 == 1).drop("label")
    a = M.knn_predict(train, test, 3, block_rows=7).orderBy("id").collect()
    b = M.knn_predict(train, test, 3, block_rows=1000).orderBy("id").collect()
    assert a == b


def test_planted_signal_scores_well(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = [(i, int(i % 2), float(i % 2) + (i % 7) / 10.0) for i in range(400)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame(rows, "id long, label int, x double"))
    from episodic.operators import evaluate as E

    for name in ("LR", "DT", "RF"):
        sc, _ = M.fit_and_score(name, M.parameter_grid(M.GRIDS["test"][name])[0], df, df, ["id", "label"])
        auc = E.auc(E.rank_scores(sc, "score", "id")).first()["auc"]
        assert auc > 0.9


PLAN_KEYS = ["label_next_event", "history_all_prior_days", "events_before_end", "feature_table_wide",
             "precision_recall_by_level", "fairness_crosstab"]


def test_plans_have_no_pairs_and_no_python(spark):
    import __spark_entry__ as entry

    qs = entry.queries()
    for k in PLAN_KEYS:
        df = qs[k](spark, SF_SMALL)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in plan, (k, bad)


def test_wide_table_single_pass_equals_modular(spark):
    from episodic.plans import analog
    from episodic.plans.features import ROLES, columns_of, feature_table, feature_table_modular
    from episodic.session import Tables

    t = Tables(spark, SF_SMALL)
    args = (analog.episodes(t), analog.components(t), analog.attributes(t), analog.events_by_entity(t))
    a = feature_table(*args)
    b = feature_table_modular(*args).select(a.columns)
    assert len(columns_of(a, *ROLES)) == len(a.columns) - 5 == len(set(a.columns)) - 5
    norm = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())  # noqa
    assert norm(a) == norm(b)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_rows_layout(spark):
    """One fold x LR test grid: 9 descriptors + auc + 4 metrics x 7 levels,
    one row per subgroup (TOTAL, MALE, FEMALE)."""
    from episodic.plans import analog
    from episodic.plans.experiment import run_fold
    from episodic.plans.features import feature_table
    from episodic.session import Tables, reuse

    t = Tables(spark, SF_SMALL)
    wide = reuse(feature_table(analog.episodes(t), analog.components(t), analog.attributes(t),
                               analog.events_by_entity(t)))
    rows = run_fold(wide, 1999, ["LR"], M.GRIDS["test"]).collect()
    assert sorted(r["gender"] for r in rows) == ["FEMALE", "MALE", "TOTAL"]
    cols = list(rows[0].asDict())
    assert len(cols) == 38 and cols[:10] == ["year", "gender", "model", "classifiers", "parameters",
                                             "train_set_size", "num_features", "validation_set_size",
                                             "baseline", "auc"]
    assert cols[10:14] == ["accuracy_1", "precision_1", "recall_1", "f1_1"]


def test_recommended_conf_follows_the_input():
    from episodic.session import recommended_conf

    conf = recommended_conf(100 << 40, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_points_keep_their_depth_and_equal_neighbours_are_one_point():
    spec = {"max_depth": [20, 50, 100], "criterion": ["gini"]}
    assert [p["max_depth"] for p in M.effective_points(spec)] == [20, 50, 100]
    assert [M.is_grown("DT", p) for p in M.effective_points(spec)] == [False, True, True]
    assert len(M.effective_points(M.GRIDS["large"]["KNN"])) == 12


def test_zero_distance_neighbours_vote_alone(spark):
    train = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 1), (3, [1.1, 0.0], 1)], "id long, embedding array<double>, label int")
    test = spark.createDataFrame([(10, [0.0, 0.0]), (11, [1.05, 0.0])], "id long, embedding array<double>")
    got = {r["id"]: r["predicted"] for r in M.knn_predict(train, test, 3, "distance").collect()}
    assert got == {10: 0, 11: 1}


def test_neighbours_are_exact_for_near_ties(spark):
    import numpy as np

    x = np.array([[1e6, 1.0], [1e6, 1.0 + 1e-7], [1e6, 1.0]])
    found = list(M._nearest(x[:1], x, np.array([5, 6, 2]), 2))
    assert found[0][1].tolist() == [2, 0] and found[0][2].tolist() == [0.0, 0.0]


def test_nearest_rows_equal_brute_force():
    """Several tiles and chunks, ties, and a row without numbers, which took every query's neighbours before."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = (rng.random((3000, 12)) < 0.3).astype(float)
    x[:, 0] = rng.random(3000).round(2)
    x[7, 3], q = np.nan, x[rng.permutation(3000)[:700]].copy()
    q[:, 1] += 1e-4
    ids = rng.permutation(3000)
    for k in (1, 3, 100, 5000):
        asks, rows, dist = M.nearest_rows(q, x, ids, k)
        for i in (0, 1, 511, 512, 699):
            d = np.sqrt(((x - q[i]) ** 2).sum(1))
            if np.isnan(d).all():
                assert i not in asks
                continue
            order = np.lexsort((ids, d))[:min(k, 2999)]
            assert rows[asks == i].tolist() == order.tolist() and dist[asks == i].tolist() == d[order].tolist()


def test_neighbours_of_sparse_and_dense_vectors(spark):
    """ML vectors stay sparse on their way; both kinds in one column give the neighbours of the arrays."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.sparse(9, [i % 9], [1.0 + i % 4]) if i % 3 else Vectors.dense([float(i * j % 5) for j in range(9)]), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, ["id", "v", "label"])
    train, test = df.where("id % 2 = 0"), df.where("id % 2 = 1")

    def found(vector, block):
        top = M.knn_neighbours(train.select(F.col("id").alias("nid"), vector("v").alias("nv"), F.col("label").alias("nlabel")),
                               test.select(F.col("id").alias("qid"), vector("v").alias("qv")), 4, block)
        return sorted(tuple(r) for r in top.collect())

    assert len(found(F.unwrap_udt, 11)) == 160
    assert found(F.unwrap_udt, 11) == found(vector_to_array, 11) == found(F.unwrap_udt, 1000)


def test_results_by_year_runs_every_fold(spark, monkeypatch):
    """The year loop and the subgroup run take each end year that has a train fold, with the default families."""
    import datetime

    from episodic.plans import experiment, q_models

    rows = [(datetime.date(y, 6, 1), g) for y in range(1995, 2002) for g in ("MALE", "FEMALE", None)] + [(None, "MALE")]
    wide = spark.createDataFrame(rows, "end_date date, gender string")
    calls = []

    def run_years(wide, years, path, models=experiment.M.DEFAULT_MODELS, **rest):
        calls.append((list(years), list(models), rest.get("exclude")))
        return spark.createDataFrame([(1,)], "year int")

    monkeypatch.setattr(q_models, "wide_table", lambda t: wide)
    monkeypatch.setattr(experiment, "run_years", run_years)
    q_models.q_results_by_year(type("T", (), {"spark": spark})())
    years = [1997, 1998, 1999, 2000, 2001]
    families = list(experiment.M.DEFAULT_MODELS)
    assert calls == [(years, families, None), (years, families, ("gender", "FEMALE"))]


def test_fairness_covers_every_family_of_the_grid(spark, monkeypatch):
    """All ten families were to be judged, not the four default ones."""
    from episodic.plans import q_models

    rows = [(i, i, i % 2, "A", "MALE", float(i)) for i in range(20)]

    def scores(t, models):
        df = spark.createDataFrame(rows, "id long, prefix long, label int, race string, gender string, score double")
        yield 1999, None, df.select("*", F.explode(F.array(*map(F.lit, models))).alias("model"), F.lit("{}").alias("parameters"))

    monkeypatch.setattr(q_models, "_grid_scores", scores)
    got = q_models.q_fairness_by_model(None).select("model").distinct().collect()
    assert {r["model"] for r in got} == set(M.GRIDS["test"])


def test_the_random_forest_query_fits_a_forest(spark, monkeypatch):
    """The query named a parameter point with a single tree."""
    from episodic.plans import q_models

    asked = []
    monkeypatch.setattr(q_models, "over_folds", lambda t, of_fold: of_fold(1999, type("Fold", (), {"train": None, "test": None, "n_train": 1})()))
    monkeypatch.setattr(q_models.M, "fit_and_score", lambda name, params, *rest, **more: asked.append((name, params)) or (None, None))
    q_models._fit_query(q_models._FITS["fit_random_forest"][0], M.parameter_grid(q_models._FITS["fit_random_forest"][1])[0])(None)
    assert asked[0][0] == "RF" and M.make_estimator(*asked[0], 10).getNumTrees() == 100


def test_folds_are_worked_on_together(spark, monkeypatch):
    """Each fold waited for the one before it; here every fold waits until another one has begun."""
    import threading

    from episodic.plans import experiment, q_models

    both = threading.Barrier(2)

    def of_fold(year, *rest):
        both.wait(60)
        return spark.createDataFrame([(year, "LR", 0.5)], "year int, model string, auc double")

    monkeypatch.setattr(q_models, "folds", lambda t: ((y, None) for y in (1998, 1999)))
    t = type("T", (), {"spark": spark})()
    assert sorted(r.year for r in q_models.over_folds(t, lambda year, fd: of_fold(year).drop("year")).collect()) == [1998, 1999]
    wide = IO.materialise(spark.createDataFrame([(1,)], "id long"), IO.scratch_path(spark, "wide"))
    begun, replace = threading.Event(), experiment.VersionedTable.replace

    def run_fold(wide, year, *rest):
        if year == 1999:
            begun.set()
        return spark.createDataFrame([(year, "LR", 0.5)], "year int, model string, auc double")

    monkeypatch.setattr(experiment, "run_fold", run_fold)
    # the first year's rows are written once the next year has begun
    monkeypatch.setattr(experiment.VersionedTable, "replace", lambda self, df, note="": (begun.wait(60) or pytest.fail("alone")) and replace(self, df, note))
    path = IO.scratch_path(spark, "years")
    assert sorted(r.year for r in experiment.run_years(wide, [1998, 1999], path).collect()) == [1998, 1999]
    assert sorted(r.year for r in experiment.run_years(wide, [1998, 1999], path).collect()) == [1998, 1999]  # written already
