"""Point-in-time history features per episode.

All frames are evaluated on (entity, end-day) aggregates (see ``dayframe``),
never as a self join.  Semantics (``b`` ranges over the entity's episodes,
``a`` is the current one):

- ``all_prior``: ``b.end <= a.end`` (self and ties included);
- ``trailing``: ``a.end - days <= b.end <= a.end``;
- ``lower_bound_only``: ``b.end >= a.end - days`` with no upper bound
  (future episodes are included -- kept under an explicit name because a
  historical feature definition used it).

Rows with a NULL end take no part and get NULL history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import day_diff, truncating_mean
from ..session import reuse
from .dayframe import UNBOUNDED_FOLLOWING, UNBOUNDED_PRECEDING, attach, day_number, frame_lookup, over_days

FRAMES = {
    "all_prior": lambda days: (UNBOUNDED_PRECEDING, 0),
    "trailing": lambda days: (-days, 0),
    "lower_bound_only": lambda days: (-days, UNBOUNDED_FOLLOWING),
}


def history(
    episodes: DataFrame,
    value: str,
    frame: str = "all_prior",
    days: int = 1825,
    entity: str = "id",
    end: str = "end_date",
    total_col: str = "total",
    count_col: str | None = None,
    mean_col: str | None = None,
    mean: str = "real",
) -> DataFrame:
    """Add frame totals of ``value`` over the entity's episodes.

    ``total_col`` = sum(value) (NULLs skipped; NULL if all NULL);
    ``count_col`` = number of episodes in the frame (``count(*)``);
    ``mean_col`` = total / count: ``mean='real'`` (double) or
    ``'truncate'`` (integer division, as integer SQL does).
    """
    lo, hi = FRAMES[frame](days)
    lookup = frame_lookup(
        values=episodes.where(F.col(end).isNotNull()),
        entity=[entity],
        value_day=day_number(end),
        measures={"_v": F.col(value), "_n": F.lit(1).cast("long")},
        probes=None,
        probe_day=None,
        frame=(lo, hi),
        window_aggs={"_total": ("sum", "_v"), "_count": ("sum", "_n")},
    )
    out = attach(episodes, lookup, [entity], day_number(end))
    if mean_col:
        if mean == "truncate":
            out = out.withColumn(mean_col, truncating_mean("_total", "_count"))
        else:
            out = out.withColumn(mean_col, F.col("_total").cast("double") / F.col("_count"))
    out = out.withColumnRenamed("_total", total_col)
    if count_col:
        out = out.withColumnRenamed("_count", count_col)
    else:
        out = out.drop("_count")
    return out


def history_frames(
    episodes: DataFrame,
    specs: dict[str, tuple[str, str, int]],
    entity: str = "id",
    end: str = "end_date",
    truncate: tuple[str, ...] = (),
) -> DataFrame:
    """Several history frames in one pass: ``specs`` maps an output prefix to
    ``(value column, frame, days)``.

    All values are pre-aggregated in one (entity, day) aggregate and all
    frames share one window partitioning (``over_days``; frames without an
    upper end sort in descending order), so the plan has a single aggregate
    and a single exchange by entity however many frames are asked for.  Adds ``<prefix>_total``, ``<prefix>_count``
    and ``<prefix>_mean`` (integer-truncated for prefixes in ``truncate``).
    """
    values = sorted({v for v, _, _ in specs.values()})
    vname = {v: f"_v{i}" for i, v in enumerate(values)}
    rows = episodes.where(F.col(end).isNotNull()).select(
        entity, day_number(end).alias("_day"), F.lit(1).cast("long").alias("_n"),
        *[F.col(v).alias(vname[v]) for v in values])
    per_day = rows.groupBy(entity, "_day").agg(F.sum("_n").alias("_n"),
                                               *[F.sum(n).alias(n) for n in vname.values()])
    outs = []
    for prefix, (value, frame, days) in specs.items():
        around = FRAMES[frame](days)
        outs += [over_days("sum", vname[value], [entity], around).alias(f"{prefix}_total"),
                 over_days("sum", "_n", [entity], around).alias(f"{prefix}_count")]
    lookup = per_day.select(entity, "_day", *outs)
    out = attach(episodes, lookup, [entity], day_number(end))
    for prefix in specs:
        tot, cnt = F.col(f"{prefix}_total"), F.col(f"{prefix}_count")
        mean = truncating_mean(tot, cnt) if prefix in truncate else tot.cast("double") / cnt
        out = out.withColumn(f"{prefix}_mean", mean)
    return out


def durations(episodes: DataFrame, start: str = "start_date", end: str = "end_date",
              out: str = "duration_days", min_days: int | None = 1) -> DataFrame:
    """Add the episode length in days (double) and keep those >= ``min_days``.

    Rows with an unknown start or end have no duration and are dropped, as
    the natural self join on all columns would drop them.
    """
    df = episodes.withColumn(out, day_diff(end, start).cast("double")).where(F.col(out).isNotNull())
    if min_days is not None:
        df = df.where(F.col(out) >= min_days)
    return df


def events_as_of(
    episodes: DataFrame,
    events: DataFrame,
    entity: str = "id",
    start: str = "start_date",
    end: str = "end_date",
    event_date: str = "event_date",
    verdict: str = "verdict",
    qualifying: str | None = "GUILTY",
    positive: str = "GUILTY",
    prefix: str = "events",
) -> DataFrame:
    """Per episode, counts over the entity's events dated on or before the end.

    Columns: ``<p>`` count of events, ``<p>_unique`` distinct event days,
    ``<p>_positive`` events whose verdict is ``positive``, ``<p>_before_start``
    events on or before the start, ``<p>_before_start_positive``.  Events
    are first restricted to ``verdict = qualifying`` (None: all).  Episodes
    with no such event up to their end are dropped (inner semantics).

    Events are aggregated to (entity, day) before any shuffle, and counts
    come from a cumulative range frame, so no (episode, event) pairs exist.
    """
    ev = events.where(F.col(event_date).isNotNull())
    if qualifying is not None:
        ev = ev.where(F.col(verdict) == qualifying)
    ev_day = day_number(event_date)
    probes_end = episodes.select(entity, day_number(end).alias("_pd"))
    early = F.when(F.col(start).isNotNull(), F.least(day_number(start), day_number(end)))  # unknown start: no event before it
    probes_start = episodes.select(entity, early.alias("_pd"))
    lookup = reuse(_frame_counts(ev, entity, ev_day, F.col(verdict) == positive,
                                 probes_end.unionByName(probes_start)))
    on_end = attach(episodes, lookup, [entity], day_number(end), {
        "_cn": prefix, "_cd": f"{prefix}_unique", "_cg": f"{prefix}_positive"}, how="inner")
    on_start = attach(on_end, lookup, [entity], early, {
        "_cn": f"{prefix}_before_start", "_cg": f"{prefix}_before_start_positive"})
    cols = [prefix, f"{prefix}_unique", f"{prefix}_positive", f"{prefix}_before_start",
            f"{prefix}_before_start_positive"]
    return (on_start.where(F.col(prefix) > 0)
            .fillna(0, subset=cols)
            .select(*episodes.columns, *[F.col(c).cast("long").alias(c) for c in cols]))


def _frame_counts(ev: DataFrame, entity: str, ev_day, positive_expr, probes: DataFrame) -> DataFrame:
    """Cumulative (events, positive events, distinct event days) per probe day,
    from one row per (entity, day)."""
    vrows = ev.select(entity, ev_day.alias("_day"), F.lit(1).cast("long").alias("_n"),
                      positive_expr.cast("long").alias("_g"), F.lit(0).alias("_probe"))
    prow = probes.select(entity, F.col("_pd").alias("_day"), F.lit(0).cast("long").alias("_n"),
                         F.lit(0).cast("long").alias("_g"), F.lit(1).alias("_probe"))
    per_day = (vrows.unionByName(prow).where(F.col("_day").isNotNull())
               .groupBy(entity, "_day")
               .agg(F.sum("_n").alias("_n"), F.sum("_g").alias("_g"), F.max("_probe").alias("_probe")))
    w = Window.partitionBy(entity).orderBy("_day").rangeBetween(UNBOUNDED_PRECEDING, 0)
    return (per_day.select(
        entity, "_day", "_probe",
        F.sum("_n").over(w).alias("_cn"),
        F.sum("_g").over(w).alias("_cg"),
        F.sum((F.col("_n") > 0).cast("long")).over(w).alias("_cd"))
        .where(F.col("_probe") == 1).drop("_probe"))
