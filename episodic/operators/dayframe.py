"""Per-entity time frames evaluated on (entity, day) aggregates.

Every "same entity, other row's day in a frame around my day" question in
this library (next start after my end, all-prior totals, trailing 5-year
totals, events up to my end) is answered the same way:

1. pre-aggregate the value rows to one row per (entity, day) -- partial
   aggregation runs map-side, so a hot entity is combined before the
   shuffle;
2. merge in the distinct probe days of the same entity;
3. evaluate a range frame over ``unix_date(day)`` with a window partitioned
   by entity.  A partition holds at most one row per distinct calendar day of
   that entity, so even an entity with a third of all rows is bounded by its
   calendar span (tens of thousands of rows per century), not its row count;
4. join the per-(entity, day) answer back to the probe rows (many-to-one; the
   lookup side has unique keys, so AQE may broadcast it after measuring it,
   or split a skewed probe partition).

No self join, no pairs within an entity, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED_PRECEDING = Window.unboundedPreceding
UNBOUNDED_FOLLOWING = Window.unboundedFollowing

DAY = "_day"
PROBE = "_probe"


def day_number(c) -> Column:
    """Integer day number of a DATE/TIMESTAMP (range frames need a number)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_date(c.cast("date"))


def over_days(agg: str, measure: str, entity: Sequence[str], frame: tuple[int, int]) -> Column:
    """``agg(measure)`` over the entity's days from ``frame[0]`` to ``frame[1]`` days around the row's day, in linear time.

    Spark keeps a running result only for frames that start at the first row
    of the order.  A frame without an upper end is therefore evaluated in
    descending day order, and a sum between two ends is the difference of two
    running sums (NULL where no value lies between them).  Differences are
    exact for whole numbers.
    """
    lo, hi = frame
    fn = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[agg]
    up = Window.partitionBy(*entity).orderBy(DAY)
    if lo == UNBOUNDED_PRECEDING:
        return fn(measure).over(up.rangeBetween(UNBOUNDED_PRECEDING, hi))
    if hi == UNBOUNDED_FOLLOWING:
        down = Window.partitionBy(*entity).orderBy(-F.col(DAY))
        return fn(measure).over(down.rangeBetween(UNBOUNDED_PRECEDING, -lo))
    if agg not in ("sum", "count"):
        raise ValueError(f"{agg} between two ends has no running form")
    until, before = up.rangeBetween(UNBOUNDED_PRECEDING, hi), up.rangeBetween(UNBOUNDED_PRECEDING, lo - 1)
    n = F.count(measure).over(until) - F.count(measure).over(before)
    if agg == "count":
        return n
    return F.when(n > 0, F.sum(measure).over(until) - F.coalesce(F.sum(measure).over(before), F.lit(0)))


def frame_lookup(
    values: DataFrame,
    entity: Sequence[str],
    value_day: Column,
    measures: dict[str, Column],
    probes: DataFrame | None,
    probe_day: Column | None,
    frame: tuple[int, int],
    window_aggs: dict[str, tuple[str, str]],
) -> DataFrame:
    """Frame aggregate per (entity, probe day).

    ``measures`` are per-value-row expressions pre-aggregated per
    (entity, day) with ``sum`` (or ``min`` if the name starts with ``min_``);
    ``window_aggs`` maps output name -> (agg, measure) evaluated over the
    frame ``rangeBetween(*frame)`` in days.  Returns ``entity + [_day] +
    outputs``, one row per distinct probe (entity, day).  When ``probes`` is
    None the value days are the probe days.
    """
    entity = list(entity)
    pre = []
    for name, expr in measures.items():
        agg = F.min if name.startswith("min_") else F.sum
        pre.append(agg(F.col(name)).alias(name))

    if probes is values and probe_day is not None:
        # one scan: each row yields its value-day row and its probe-day row
        fields = [value_day.alias(DAY), *[e.alias(n) for n, e in measures.items()], F.lit(0).alias(PROBE)]
        vstruct = F.struct(*fields)
        vtype = values.select(vstruct.alias("s")).schema["s"].dataType
        pstruct = F.struct(probe_day.cast(vtype[DAY].dataType).alias(DAY),
                           *[F.lit(None).cast(vtype[n].dataType).alias(n) for n in measures],
                           F.lit(1).alias(PROBE))
        rows = values.select(*entity, F.explode(F.array(vstruct, pstruct)).alias("_r")).select(*entity, "_r.*")
    else:
        vrows = values.select(*entity, value_day.alias(DAY), *[e.alias(n) for n, e in measures.items()],
                              F.lit(0).alias(PROBE))
        if probes is not None:
            prow = probes.select(*entity, probe_day.alias(DAY),
                                 *[F.lit(None).cast(vrows.schema[n].dataType).alias(n) for n in measures],
                                 F.lit(1).alias(PROBE))
            rows = vrows.unionByName(prow)
        else:
            rows = vrows.withColumn(PROBE, F.lit(1))
    rows = rows.where(F.col(DAY).isNotNull())
    per_day = rows.groupBy(*entity, DAY).agg(*pre, F.max(PROBE).alias(PROBE))

    outs = [over_days(agg, measure, entity, frame).alias(out) for out, (agg, measure) in window_aggs.items()]
    return per_day.select(*entity, DAY, PROBE, *outs).where(F.col(PROBE) == 1).drop(PROBE)


def attach(rows: DataFrame, lookup: DataFrame, entity: Sequence[str], day: Column,
           rename: dict[str, str] | None = None, how: str = "left") -> DataFrame:
    """Join a ``frame_lookup`` result back onto ``rows`` by (entity, day),
    optionally keeping only the lookup columns in ``rename`` (old -> new)."""
    entity = list(entity)
    lk = lookup
    if rename:
        lk = lk.select(*entity, DAY, *[F.col(k).alias(v) for k, v in rename.items()])
    keyed = rows.withColumn(DAY, day)
    return keyed.join(lk, on=[*entity, DAY], how=how).drop(DAY)
