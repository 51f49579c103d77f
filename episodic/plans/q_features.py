"""Queries: attributes and ages, first-episode age, child counts, distinct
lists, and the 32-column wide feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import attach_attributes, child_counts, distinct_lists, entity_first_age
from . import analog
from .analog import with_ctes
from .catalog import i32, i64, r6, register
from .features import feature_table
from .q_episodes import EARLIER, EVENT_COUNTS, NOT_OLD, RECENT, SIZED, flag_sql

KEYS = ["id", "prefix", "start_date", "end_date"]

# years between a day and the entity's known birth date; before birth: unknown
def years_sql(day: str) -> str:
    span = f"datediff('day', CASE WHEN year(p.birth_date) > 1 THEN p.birth_date END, {day})"
    return f"round(CASE WHEN {span} >= 0 THEN {span} / 365.0::DOUBLE END, 6)"


FIRST_START = "(SELECT min(o.start_date) FROM episodes o WHERE o.id = e.id)"


@register("join_left_attributes", with_ctes(["episodes", "attributes"], f"""
SELECT e.id, e.prefix, e.start_date, e.end_date, p.gender, p.race,
       CASE WHEN year(p.birth_date) > 1 THEN p.birth_date END AS birth_date,
       {years_sql("e.start_date")} AS age_at_start, {years_sql("e.end_date")} AS age_at_end
FROM episodes e LEFT JOIN attributes p USING (id)"""))
def q_join_left_attributes(t):
    c = attach_attributes(analog.episodes(t), analog.attributes(t))
    return c.select(*KEYS, "gender", "race", "birth_date", r6("age_at_start").alias("age_at_start"),
                    r6("age_at_end").alias("age_at_end"))


@register("entity_first_value", with_ctes(["episodes", "attributes"], f"""
SELECT e.id, e.prefix, {years_sql(FIRST_START)} AS age_first
FROM episodes e LEFT JOIN attributes p USING (id)"""))
def q_entity_first_value(t):
    c = entity_first_age(attach_attributes(analog.episodes(t), analog.attributes(t)))
    return c.select("id", "prefix", r6("age_first").alias("age_first"))


OWN = "k.id = e.id AND k.prefix = e.prefix"


def codes_sql(column: str, scrub: bool = True) -> str:
    """Sorted distinct codes of an episode's components."""
    code = f"replace(k.{column}, ',', '')" if scrub else f"k.{column}"
    return f"(SELECT string_agg(DISTINCT {code}, ',' ORDER BY {code}) FROM components k WHERE {OWN})"


@register("child_count_left_join", with_ctes(["episodes", "components"], f"""
SELECT e.id, e.prefix, e.start_date, e.end_date,
       (SELECT nullif(count(k.component_no), 0) FROM components k WHERE {OWN}) AS num_components
FROM episodes e"""))
def q_child_count_left_join(t):
    return child_counts(analog.episodes(t), analog.components(t), ["id", "prefix"], "component_no", "num_components") \
        .select(*KEYS, "num_components")


@register("distinct_list_agg", with_ctes(["episodes", "components"], f"""
SELECT e.id, e.prefix, {codes_sql("term", False)} AS term_list, {codes_sql("county", False)} AS county_list
FROM episodes e WHERE EXISTS (SELECT 1 FROM components k WHERE {OWN})"""))
def q_distinct_list_agg(t):
    return distinct_lists(analog.episodes(t), analog.components(t), ["id", "prefix"],
                          {"term": "term_list", "county": "county_list"}, keep="matched")


@register("list_features_left", with_ctes(["episodes", "components"], f"""
SELECT e.id, e.prefix, {codes_sql("offense")} AS offense_codes, {codes_sql("qualifier")} AS qualifier_codes,
       {codes_sql("penalty")} AS penalty_codes
FROM episodes e"""))
def q_list_features_left(t):
    return distinct_lists(analog.episodes(t), analog.components(t), ["id", "prefix"],
                          {"offense": "offense_codes", "qualifier": "qualifier_codes", "penalty": "penalty_codes"},
                          keep="all", scrub=True)


def wide_sql(recent_days: str) -> str:
    """One row per episode of at least a day, each family of features a sub-query over the entity's other rows.

    ``recent_days`` is the condition of the five-year day totals.
    """
    return with_ctes(["episodes", "components", "attributes", "events_by_entity"], f"""
SELECT e.id, e.prefix, e.start_date, e.end_date, {flag_sql("episodes")} AS label, round(e.days, 6) AS duration_days,
       CASE WHEN c.n > 0 THEN c.n END AS events, CASE WHEN c.n > 0 THEN c.n_days END AS events_unique,
       CASE WHEN c.n > 0 THEN c.n END AS events_positive, CASE WHEN c.n > 0 THEN c.n_early END AS events_before_start,
       CASE WHEN c.n > 0 THEN c.n_early END AS events_before_start_positive,
       {codes_sql("offense")} AS offense_codes, {codes_sql("qualifier")} AS qualifier_codes, {codes_sql("penalty")} AS penalty_codes,
       {codes_sql("term", False)} AS term_list, {codes_sql("county", False)} AS county_list, e.parts AS num_components,
       p.race, p.gender, {years_sql("e.start_date")} AS age_at_start, {years_sql("e.end_date")} AS age_at_end,
       {years_sql(FIRST_START)} AS age_first,
       past.parts AS total_components_allprior, past.parts // past.n AS avg_components_allprior,
       past.parts_5y AS total_components_5y, past.parts_5y // past.n_5y AS avg_components_5y,
       past.days AS total_days_allprior, past.n_days AS n_prior_allprior, round(past.days / past.n_days, 6) AS avg_days_allprior,
       near.days AS total_days_5y, near.n AS n_prior_5y, round(near.days / near.n, 6) AS avg_days_5y
FROM sized e LEFT JOIN attributes p USING (id),
     LATERAL ({EVENT_COUNTS}) c,
     LATERAL (SELECT CAST(sum(h.parts) AS BIGINT) AS parts, count(*) AS n, sum(h.days) AS days, count(h.days) AS n_days,
                     CAST(sum(h.parts) FILTER (WHERE h.end_date >= e.end_date - 1825) AS BIGINT) AS parts_5y,
                     count(*) FILTER (WHERE h.end_date >= e.end_date - 1825) AS n_5y
              FROM sized h WHERE {EARLIER}) past,
     LATERAL (SELECT sum(h.days) AS days, count(h.days) AS n FROM sized h WHERE {recent_days}) near
WHERE e.days >= 1""", extra=[("sized", SIZED)])


def wide_rounded(df):
    """Doubles rounded, counts as BIGINT, the label as INTEGER; dates and strings as they are."""
    def shown(c, kind):
        if c == "label":
            return i32(c)
        return r6(c) if kind == "double" else F.col(c) if kind in ("string", "date", "timestamp") else i64(c)

    return df.select(*[F.col(c) if c in ("id", "prefix") else shown(c, kind).alias(c) for c, kind in df.dtypes])


def _wide(t, **kw):
    return wide_rounded(feature_table(analog.episodes(t), analog.components(t), analog.attributes(t),
                                      analog.events_by_entity(t), **kw))


@register("feature_table_wide", wide_sql(RECENT))
def q_feature_table_wide(t):
    return _wide(t)


@register("feature_table_wide_as_written", wide_sql(NOT_OLD))
def q_feature_table_wide_as_written(t):
    """The day totals of the last five years without an upper bound; component totals stay bounded."""
    return _wide(t, bounded_5y=False)


@register("feature_table_wide_hot_entity", analog.hot_sql(wide_sql(RECENT)))
def q_feature_table_wide_hot_entity(t):
    return _wide(analog.HotTables(t))
