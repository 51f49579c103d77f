"""Next-event label, episode build and history frames: edge rows and
properties against brute force."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from episodic.operators.episodes import build_episodes, label_next_event

from .naive import history_by_self_join, label_by_self_join
from episodic.operators.history import durations, events_as_of, history

D = dt.date
SCHEMA = "id long, prefix long, start_date date, end_date date"


def ep(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def labels(df):
    return {r["prefix"]: r["label"] for r in df.collect()}


def test_horizon_inclusive_and_strictly_later(spark):
    e = ep(spark, [
        (1, 1, D(2000, 1, 1), D(2000, 1, 10)), (1, 2, D(2001, 1, 9), D(2001, 2, 1)),   # 365 days later
        (2, 3, D(2000, 1, 1), D(2000, 1, 10)), (2, 4, D(2001, 1, 10), D(2001, 2, 1)),  # 366 days later
        (3, 5, D(2000, 1, 1), D(2000, 1, 10)), (3, 6, D(2000, 1, 10), D(2000, 2, 1)),  # same day: not next
    ])
    got = labels(label_next_event(e))
    assert got[1] == 1 and got[3] == 0 and got[5] == 0
    assert got[2] == 0 and got[4] == 0 and got[6] == 0


def test_overlapping_episodes(spark):
    e = ep(spark, [(1, 1, D(2000, 1, 1), D(2000, 12, 31)), (1, 2, D(2000, 6, 1), D(2000, 7, 1)),
                   (1, 3, D(2001, 2, 1), D(2001, 3, 1))])
    out = {r["prefix"]: r["gap_days"] for r in label_next_event(e, keep_gap=True).collect()}
    assert out[1] == 32 and out[2] == 215 and out[3] is None


def test_null_end_is_label_zero(spark):
    e = ep(spark, [(1, 1, D(2000, 1, 1), None), (1, 2, D(2000, 3, 1), D(2000, 4, 1))])
    assert labels(label_next_event(e)) == {1: 0, 2: 0}


dates = st.integers(min_value=0, max_value=900).map(lambda d: D(2000, 1, 1) + dt.timedelta(days=d))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), dates, st.integers(0, 200)), min_size=1, max_size=25))
def test_label_matches_brute_force(spark, data):
    rows = [(eid, i, s, s + dt.timedelta(days=n)) for i, (eid, s, n) in enumerate(data)]
    got = labels(label_next_event(ep(spark, rows)))
    for eid, p, s, e in rows:
        later = [s2 for e2, _, s2, _ in rows if e2 == eid and s2 > e]
        gap = (min(later) - e).days if later else 10000
        assert got[p] == int(0 <= gap <= 365)


def test_naive_form_agrees(spark):
    rows = [(1, 1, D(2000, 1, 1), D(2000, 12, 31)), (1, 2, D(2000, 6, 1), D(2000, 7, 1)),
            (1, 3, D(2001, 2, 1), D(2001, 3, 1)), (2, 4, D(2000, 1, 1), D(2000, 1, 2))]
    e = ep(spark, rows)
    assert labels(label_next_event(e)) == labels(label_by_self_join(e))


def test_history_null_end_and_truncated_mean(spark):
    df = spark.createDataFrame(
        [(1, 1, None, 100), (1, 2, D(2000, 1, 10), 3), (1, 3, D(2000, 1, 20), 4), (1, 4, D(2000, 1, 30), None)],
        "id long, prefix long, end_date date, v long")
    out = {r["prefix"]: (r["total"], r["avg"]) for r in
           history(df, "v", "all_prior", mean_col="avg", mean="truncate").collect()}
    assert out[1] == (None, None)          # NULL end: no history
    assert out[2] == (3, 3)
    assert out[3] == (7, 3)                # 7 // 2
    assert out[4] == (7, 2)                # count(*) counts the NULL value row: 7 // 3


def test_future_leak_only_in_lower_bound_form(spark):
    df = spark.createDataFrame([(1, 1, D(2000, 1, 1), 1.0), (1, 2, D(2010, 1, 1), 5.0)],
                               "id long, prefix long, end_date date, v double")
    bounded = {r["prefix"]: r["total"] for r in history(df, "v", "trailing", 1825).collect()}
    unbounded = {r["prefix"]: r["total"] for r in history(df, "v", "lower_bound_only", 1825).collect()}
    assert bounded[1] == 1.0 and unbounded[1] == 6.0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), dates, st.integers(0, 9)), min_size=1, max_size=20),
       st.sampled_from(["all_prior", "trailing", "lower_bound_only"]))
def test_history_matches_self_join(spark, data, frame):
    rows = [(eid, i, e, v) for i, (eid, e, v) in enumerate(data)]
    df = spark.createDataFrame(rows, "id long, prefix long, end_date date, v long")
    got = {r["prefix"]: (r["total"], r["n"]) for r in history(df, "v", frame, 300, count_col="n").collect()}
    for eid, p, e, _ in rows:
        def inside(e2):
            d = (e2 - e).days
            return {"all_prior": d <= 0, "trailing": -300 <= d <= 0, "lower_bound_only": d >= -300}[frame]
        match = [v2 for e2id, _, e2, v2 in rows if e2id == eid and inside(e2)]
        assert got[p] == (sum(match), len(match))


def test_durations_keep_at_least_one_day(spark):
    e = ep(spark, [(1, 1, D(2000, 1, 1), D(2000, 1, 1)), (1, 2, D(2000, 1, 1), D(2000, 1, 3))])
    assert [r["prefix"] for r in durations(e).collect()] == [2]


def test_events_as_of_inner_semantics(spark):
    e = ep(spark, [(1, 1, D(2000, 1, 10), D(2000, 2, 1)), (2, 2, D(2000, 1, 1), D(2000, 1, 2))])
    ev = spark.createDataFrame([(1, D(2000, 1, 5), "GUILTY"), (1, D(2000, 1, 5), "GUILTY"),
                                (1, D(2000, 1, 20), "GUILTY"), (1, D(2000, 3, 1), "GUILTY"),
                                (1, D(2000, 1, 6), "DISMISSED"), (2, D(2000, 2, 1), "GUILTY")],
                               "id long, event_date date, verdict string")
    out = events_as_of(e, ev).collect()
    assert len(out) == 1  # entity 2 has no event up to its end
    r = out[0]
    assert (r["events"], r["events_unique"], r["events_positive"], r["events_before_start"]) == (3, 2, 3, 2)


def test_build_episodes(spark):
    comps = spark.createDataFrame([(1, 10, 1, "FELON"), (1, 11, 1, "MISDE")],
                                  "id long, prefix long, component_no int, felony_cd string")
    spans = spark.createDataFrame([
        (1, 10, D(2000, 1, 5), D(2000, 3, 1), D(2000, 4, 1)),
        (1, 10, D(1, 1, 1), D(2000, 5, 1), D(2000, 4, 1)),       # sentinel begin: dropped
        (1, 11, D(2000, 1, 1), D(2000, 2, 1), D(2000, 2, 1))],
        "id long, prefix long, begin_date date, actual_end date, projected_end date")
    court = spark.createDataFrame([(1, 10, D(2000, 1, 1), "Y"), (1, 10, D(1999, 12, 1), "Y"),
                                   (1, 11, D(2000, 1, 1), "Y")],
                                  "id long, prefix long, effective_date date, new_period_flag string")
    out = build_episodes(comps, spans, court, "felony_cd", "FELON").collect()
    assert [(r["prefix"], r["start_date"], r["end_date"]) for r in out] == [(10, D(1999, 12, 1), D(2000, 3, 1))]


def test_history_agrees_with_the_self_join(spark):
    rows = [(1, i, D(2000, 1, 1) + dt.timedelta(days=(i * 37) % 90), None if i % 4 == 0 else float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, prefix long, end_date date, v double")
    for frame, lo, hi in (("all_prior", None, 0), ("trailing", -40, 0), ("lower_bound_only", -40, None), ("trailing", 0, 0)):
        days = -lo if lo is not None else 0
        a = {r["prefix"]: (r["total"], r["n"]) for r in history(df, "v", frame, days, count_col="n").collect()}
        assert a == {r["prefix"]: (r["total"], r["n"]) for r in history_by_self_join(df, "v", lo, hi).collect()}


def test_unknown_start_has_no_event_before_it(spark):
    e = spark.createDataFrame([(1, 1, None, D(2000, 2, 1)), (1, 2, D(2000, 1, 1), D(2000, 2, 1))],
                              "id long, prefix long, start_date date, end_date date")
    ev = spark.createDataFrame([(1, D(1999, 12, 1), "GUILTY"), (1, D(2000, 1, 15), "GUILTY")], "id long, event_date date, verdict string")
    got = {r["prefix"]: (r["events"], r["events_before_start"]) for r in events_as_of(e, ev).collect()}
    assert got == {1: (2, 0), 2: (2, 1)}


def test_frames_are_linear_in_days(spark):
    """No window recomputes its frame for each row: every range frame starts at the first row of its order."""
    e = spark.createDataFrame([(1, 1, D(2000, 1, 1), D(2000, 2, 1), 1)], "id long, prefix long, start_date date, end_date date, v int")
    for df in (label_next_event(e), history(e, "v", "trailing", 30), history(e, "v", "lower_bound_only", 30)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition" in plan.lower()
        assert plan.count("RangeFrame, unboundedpreceding$()") == plan.count("RangeFrame,")


def test_history_frames_one_pass_equals_single_frames(spark):
    from episodic.operators.history import history_frames

    df = spark.createDataFrame([(i % 3, i, D(2000, 1, 1) + dt.timedelta(days=(i * 97) % 3000), i % 5, float(i))
                                for i in range(60)], "id long, prefix long, end_date date, c long, d double")
    multi = history_frames(df, {"c_all": ("c", "all_prior", 0), "c_5y": ("c", "trailing", 1825),
                                "d_5y": ("d", "lower_bound_only", 1825)}, truncate=("c_all", "c_5y"))
    got = {r["prefix"]: r for r in multi.collect()}
    for prefix_, (v, frame, days, trunc) in {"c_all": ("c", "all_prior", 0, True), "c_5y": ("c", "trailing", 1825, True),
                                             "d_5y": ("d", "lower_bound_only", 1825, False)}.items():
        single = history(df, v, frame, days, count_col="n", mean_col="m", mean="truncate" if trunc else "real")
        for r in single.collect():
            g = got[r["prefix"]]
            assert (g[f"{prefix_}_total"], g[f"{prefix_}_count"], g[f"{prefix_}_mean"]) == (r["total"], r["n"], r["m"])
    multi.write.format("noop").mode("overwrite").save()
    plan = multi._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # one node for the frames that run up from the first day, one for the frame without an upper end, in descending order
    assert plan.count("Window [") == 2
