"""Episode construction and the next-event label.

``build_episodes`` turns three raw sources (qualifying components, dated
spans, commitments) into one row per episode ``(entity, episode, start,
end)``; ``label_next_event`` asks, per episode, whether the same entity starts
another episode strictly after this one ends and within ``horizon_days``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import least_strict, not_sentinel, range_flag
from .dayframe import UNBOUNDED_FOLLOWING, attach, day_number, frame_lookup


def qualifying_keys(components: DataFrame, keys: list[str], flag_col: str, flag_value: str) -> DataFrame:
    """DISTINCT episode keys having a component with ``flag_col = flag_value``."""
    return components.where(F.col(flag_col) == flag_value).select(*keys).distinct()


def span_bounds(spans: DataFrame, keys: list[str], begin: str, end_actual: str, end_projected: str) -> DataFrame:
    """Per episode: earliest begin, latest actual and projected end.

    Rows whose three dates are not all known (NULL or the ``0001`` sentinel)
    are rejected first.  Partial + final hash aggregate.
    """
    ok = not_sentinel(begin) & not_sentinel(end_actual) & not_sentinel(end_projected)
    return (
        spans.where(ok)
        .groupBy(*keys)
        .agg(F.min(begin).alias("span_start"), F.max(end_actual).alias("end_actual"),
             F.max(end_projected).alias("end_projected"))
    )


def build_episodes(
    components: DataFrame,
    spans: DataFrame,
    commitments: DataFrame,
    flag_col: str,
    flag_value: str,
    keys: tuple[str, str] = ("id", "prefix"),
    begin: str = "begin_date",
    end_actual: str = "actual_end",
    end_projected: str = "projected_end",
    effective: str = "effective_date",
    new_period_flag: str = "new_period_flag",
) -> DataFrame:
    """One row per qualifying episode: ``keys + start_date, end_date``.

    start = NULL-strict ``min(commitment date, span start)``; where an episode
    has several commitments, the earliest start wins (deterministic form of
    "any row of the group"), ties broken by end date.
    """
    keys = list(keys)
    bounds = span_bounds(spans, keys, begin, end_actual, end_projected)
    court = commitments.where((F.col(new_period_flag) == "Y") & not_sentinel(effective)).select(*keys, effective)
    joined = bounds.join(court, keys, "inner").select(
        *keys,
        least_strict(F.col(effective), F.col("span_start")).alias("start_date"),
        F.col("end_actual").alias("end_date"),
    )
    qualifying = qualifying_keys(components, keys, flag_col, flag_value)
    picked = (
        joined.join(qualifying, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.min(F.struct(F.col("start_date").isNull().alias("_n"), "start_date", "end_date")).alias("_p"))
    )
    return picked.select(*keys, "_p.start_date", "_p.end_date")


def next_start_lookup(episodes: DataFrame, entity: str = "id", start: str = "start_date",
                      end: str = "end_date") -> DataFrame:
    """Per (entity, end day): the earliest start day strictly after it."""
    return frame_lookup(
        values=episodes,
        entity=[entity],
        value_day=day_number(start),
        measures={"min_start": day_number(start)},
        probes=episodes,
        probe_day=day_number(end),
        frame=(1, UNBOUNDED_FOLLOWING),
        window_aggs={"_next_start": ("min", "min_start")},
    )


def label_next_event(
    episodes: DataFrame,
    entity: str = "id",
    start: str = "start_date",
    end: str = "end_date",
    horizon_days: int = 365,
    default_gap: int = 10000,
    label_col: str = "label",
    keep_gap: bool = False,
) -> DataFrame:
    """Add ``label`` = 1 when the entity's next start (strictly after this
    end) comes within ``horizon_days`` (inclusive), else 0.

    The gap to the next start defaults to ``default_gap`` when there is none
    (or the end is unknown).  Overlapping episodes are handled exactly:
    the next start is the earliest start *after the end*, not the next row
    (``lead`` would be wrong on overlaps).
    """
    lookup = next_start_lookup(episodes, entity, start, end)
    out = attach(episodes, lookup, [entity], day_number(end))
    gap = F.col("_next_start") - day_number(end)
    out = out.withColumn(label_col, range_flag(gap, 0, horizon_days, default=default_gap))
    if keep_gap:
        out = out.withColumn("gap_days", gap.cast("long"))
    return out.drop("_next_start")
