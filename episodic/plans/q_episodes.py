"""Queries: episodes, next-event label, history frames, events as of end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.episodes import build_episodes, label_next_event
from ..operators.history import durations, events_as_of, history
from . import analog
from .analog import with_ctes
from .catalog import i32, i64, r6, register

KEYS = ["id", "prefix", "start_date", "end_date"]

# ------------------------------------------------------------------ C9 label

# Oracle forms, one sub-query per episode as the definitions read.  ``{e}`` is the episode table.
GAP = """(SELECT min(x.start_date) - {e}.end_date FROM {t} x WHERE x.id = {e}.id AND x.start_date > {e}.end_date)"""


def flag_sql(table: str, outer: str = "e", horizon: int = 365) -> str:
    """1 if the gap to the next start is at most the horizon; no later start: 0."""
    return f"CAST(coalesce({GAP.format(t=table, e=outer)} <= {horizon}, false) AS INTEGER)"


def label_sql(table: str) -> str:
    return with_ctes([table], f"SELECT e.id, e.prefix, e.start_date, e.end_date, {flag_sql(table)} AS label FROM {table} e")


@register("label_next_event", label_sql("episodes"))
def q_label_next_event(t):
    e = analog.episodes(t)
    return label_next_event(e, horizon_days=365, default_gap=10000).select(*KEYS, i32("label").alias("label"))


# the flagship: label rate by end year over labelled episodes
@register("label_rate_by_year", with_ctes(["episodes"], f"""
SELECT CAST(year(end_date) AS INTEGER) AS end_year, CAST(count(*) AS BIGINT) AS episodes,
       CAST(sum(flag) AS BIGINT) AS positives, round(avg(flag), 6) AS label_rate
FROM (SELECT e.end_date, {flag_sql("episodes")} AS flag FROM episodes e) GROUP BY ALL"""))
def q_label_rate_by_year(t):
    lab = label_next_event(analog.episodes(t))
    return lab.groupBy(F.year("end_date").cast("int").alias("end_year")).agg(
        i64(F.count(F.lit(1))).alias("episodes"),
        i64(F.sum("label")).alias("positives"),
        r6(F.avg("label")).alias("label_rate"))


# ---------------------------------------------------- C1, C2, D2, D3, B2, B8

# a known date is one outside year 1; an episode without a fully dated span has no row
BUILD_SQL = with_ctes(["components", "spans", "commitments"], """
SELECT DISTINCT ON (m.id, m.prefix) m.id, m.prefix,
       CASE WHEN s.opened IS NOT NULL THEN (SELECT min(d) FROM (VALUES (m.effective_date), (s.opened)) v(d)) END AS start_date,
       s.closed AS end_date
FROM commitments m, LATERAL (
  SELECT min(p.begin_date) AS opened, max(p.actual_end) AS closed FROM spans p
  WHERE p.id = m.id AND p.prefix = m.prefix AND year(p.begin_date) > 1 AND year(p.actual_end) > 1 AND year(p.projected_end) > 1) s
WHERE m.new_period_flag = 'Y' AND year(m.effective_date) > 1 AND s.opened IS NOT NULL
  AND (m.id, m.prefix) IN (SELECT (c.id, c.prefix) FROM components c WHERE c.felony_cd = 'FELON')
ORDER BY m.id, m.prefix, start_date NULLS LAST, end_date NULLS FIRST""")


@register("episodes_built", BUILD_SQL)
def q_episodes_built(t):
    return build_episodes(analog.components(t), analog.spans(t), analog.commitments(t), "felony_cd", "FELON").select(*KEYS)


# ------------------------------------------------------- W1, W2 (components)

# what one episode adds to a history: its components and, from one day on, its length
SIZED = """
SELECT q.id, q.prefix, q.start_date, q.end_date,
       (SELECT nullif(count(k.component_no), 0) FROM components k WHERE k.id = q.id AND k.prefix = q.prefix) AS parts,
       CASE WHEN q.end_date > q.start_date THEN CAST(q.end_date - q.start_date AS DOUBLE) END AS days
FROM episodes q"""
EARLIER = "h.id = e.id AND h.end_date <= e.end_date"
RECENT = EARLIER + " AND h.end_date >= e.end_date - 1825"
NOT_OLD = "h.id = e.id AND h.end_date >= e.end_date - 1825"


def _num_components(t):
    e = analog.episodes(t)
    n = analog.components(t).groupBy("id", "prefix").agg(F.count("component_no").alias("num_components"))
    return e.join(n, ["id", "prefix"], "left")


def parts_sql(around: str) -> str:
    return with_ctes(["episodes", "components"], f"""
SELECT e.id, e.prefix, e.start_date, e.end_date, e.parts AS num_components, f.total AS total_components, f.total // f.n AS avg_components
FROM sized e, LATERAL (SELECT CAST(sum(h.parts) AS BIGINT) AS total, count(*) AS n FROM sized h WHERE {around}) f""",
                     extra=[("sized", SIZED)])


def _hist_count(t, frame):
    h = history(_num_components(t), "num_components", frame, days=1825, total_col="total_components",
                mean_col="avg_components", mean="truncate")
    return h.select(*KEYS, "num_components", i64("total_components").alias("total_components"),
                    i64("avg_components").alias("avg_components"))


@register("history_all_prior_count", parts_sql(EARLIER))
def q_history_all_prior_count(t):
    return _hist_count(t, "all_prior")


@register("history_trailing_5y_count", parts_sql(RECENT))
def q_history_trailing_5y_count(t):
    return _hist_count(t, "trailing")


# --------------------------------------------------- B6, B10, C7, W3, W4 (days)


@register("duration_days", with_ctes(["episodes"], """
SELECT id, prefix, start_date, end_date, round(CAST(end_date - start_date AS DOUBLE), 6) AS duration_days
FROM episodes WHERE end_date > start_date"""))
def q_duration_days(t):
    d = durations(analog.episodes(t), out="duration_days", min_days=1)
    return d.select(*KEYS, r6("duration_days").alias("duration_days"))


def days_sql(around: str, table: str = "episodes") -> str:
    return with_ctes([table], f"""
SELECT e.id, e.prefix, e.start_date, e.end_date, f.total AS total_days, f.n AS n_prior, round(f.total / f.n, 6) AS avg_days
FROM {table} e, LATERAL (
  SELECT CAST(sum(h.end_date - h.start_date) AS DOUBLE) AS total, count(*) AS n
  FROM {table} h WHERE {around} AND h.end_date > h.start_date) f
WHERE e.end_date > e.start_date""")


def _hist_days(t, frame, episodes=analog.episodes):
    d = durations(episodes(t), out="duration_days", min_days=1)
    h = history(d, "duration_days", frame, days=1825, total_col="total_days", count_col="n_prior",
                mean_col="avg_days")
    return h.select(*KEYS, r6("total_days").alias("total_days"), i64("n_prior").alias("n_prior"),
                    r6("avg_days").alias("avg_days"))


@register("history_all_prior_days", days_sql(EARLIER))
def q_history_all_prior_days(t):
    return _hist_days(t, "all_prior")


@register("history_5y_unbounded", days_sql(NOT_OLD))
def q_history_5y_unbounded(t):
    return _hist_days(t, "lower_bound_only")


@register("history_5y_days", days_sql(RECENT))
def q_history_5y_days(t):
    return _hist_days(t, "trailing")


# --------------------------------------------------------- C8, D6, D7 events

# counts of the positive events up to an episode's end
EVENT_COUNTS = """
SELECT count(*) AS n, count(DISTINCT v.event_date) AS n_days,
       count(*) FILTER (WHERE v.event_date <= e.start_date) AS n_early
FROM events_by_entity v WHERE v.verdict = 'GUILTY' AND v.id = e.id AND v.event_date <= e.end_date"""
EVENT_COLUMNS = """c.n AS events, c.n_days AS events_unique, c.n AS events_positive,
       c.n_early AS events_before_start, c.n_early AS events_before_start_positive"""


@register("events_before_end", with_ctes(["episodes", "events_by_entity"], f"""
SELECT e.id, e.prefix, e.start_date, e.end_date, {EVENT_COLUMNS}
FROM episodes e, LATERAL ({EVENT_COUNTS}) c WHERE c.n > 0"""))
def q_events_before_end(t):
    return events_as_of(analog.episodes(t), analog.events_by_entity(t), prefix="events")


@register("events_before_end_unknown_start", with_ctes(["episodes", "events_by_entity"], f"""
SELECT e.id, e.prefix, e.start_date, e.end_date, {EVENT_COLUMNS}
FROM (SELECT id, prefix, CASE WHEN prefix % 5 <> 0 THEN start_date END AS start_date, end_date FROM episodes) e,
     LATERAL ({EVENT_COUNTS}) c WHERE c.n > 0"""))
def q_events_before_end_unknown_start(t):
    e = analog.episodes(t).withColumn("start_date", F.expr("CASE WHEN prefix % 5 <> 0 THEN start_date END"))
    return events_as_of(e, analog.events_by_entity(t), prefix="events")


# ------------------------------------------------------- skew: one hot entity


@register("label_next_event_hot_entity", label_sql("episodes_hot"))
def q_label_next_event_hot_entity(t):
    e = analog.episodes_hot(t)
    return label_next_event(e).select(*KEYS, i32("label").alias("label"))


@register("history_all_prior_days_hot_entity", days_sql(EARLIER, "episodes_hot"))
def q_history_all_prior_days_hot_entity(t):
    return _hist_days(t, "all_prior", analog.episodes_hot)
