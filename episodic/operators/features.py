"""Per-episode feature builders and the wide feature table.

Every builder returns one row per episode key, so the wide table is a chain
of left joins on the same key: each input is hash-partitioned on the key
once, and the growing left side keeps its partitioning through the chain
(sort-merge joins, no re-shuffle of the left side).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import scrub_delimiter, sentinel_to_null, years_between_nonneg


class DuplicateKeyError(ValueError):
    pass


def assert_unique_keys(df: DataFrame, keys: Sequence[str], what: str = "input") -> None:
    """Fail before a left join would multiply rows.

    One distributed aggregation; only a single offending key (if any) reaches
    the driver.
    """
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise DuplicateKeyError(f"{what}: key {dict(dup[0].asDict())} is not unique on {list(keys)}")


def attach_attributes(
    episodes: DataFrame,
    attributes: DataFrame,
    entity: str = "id",
    start: str = "start_date",
    end: str = "end_date",
    birth: str = "birth_date",
    check_unique: bool = True,
) -> DataFrame:
    """Left join static entity attributes; birth sentinel -> NULL; ages at
    start and end in years (``days / 365.0``), NULL when negative."""
    if check_unique:
        assert_unique_keys(attributes, [entity], "attributes")
    attrs = attributes.withColumn(birth, sentinel_to_null(birth))
    out = episodes.join(attrs, entity, "left")
    return out.withColumn("age_at_start", years_between_nonneg(start, birth)) \
              .withColumn("age_at_end", years_between_nonneg(end, birth))


def entity_first_age(
    chars: DataFrame,
    entity: str = "id",
    start: str = "start_date",
    birth: str = "birth_date",
    out: str = "age_first",
) -> DataFrame:
    """Per row: age at the entity's first start, ``(min(start) - min(birth)) / 365``.

    Computed as a grouped aggregate (partial aggregation absorbs a hot
    entity) joined back many-to-one, rather than a window holding every row of
    an entity in one task.
    """
    firsts = chars.groupBy(entity).agg(F.min(start).alias("_fs"), F.min(birth).alias("_fb"))
    firsts = firsts.select(entity, years_between_nonneg("_fs", "_fb").alias(out))
    return chars.join(firsts, entity, "left")


def child_counts(episodes: DataFrame, children: DataFrame, keys: Sequence[str], col: str,
                 out: str) -> DataFrame:
    """Left join of ``count(col)`` per key; episodes without children get NULL."""
    counts = children.groupBy(*keys).agg(F.count(col).alias(out))
    return episodes.join(counts, list(keys), "left")


def sorted_distinct_list(c, delimiter: str = ",") -> F.Column:
    """Aggregate: distinct non-NULL values joined in sorted order; NULL when
    there are none (``group_concat(distinct x)``, made deterministic)."""
    s = F.array_sort(F.collect_set(c))
    return F.when(F.size(s) > 0, F.array_join(s, delimiter))


def distinct_lists(
    episodes: DataFrame,
    children: DataFrame,
    keys: Sequence[str],
    cols: dict[str, str],
    keep: str = "matched",
    scrub: bool = False,
    delimiter: str = ",",
) -> DataFrame:
    """Per episode, ``out = sorted distinct list of child col``.

    ``keep='matched'``: only episodes having children (grouping by the child
    keys after a left join drops the unmatched); ``keep='all'``: every episode,
    NULL lists when unmatched.  ``scrub`` removes the delimiter from values
    first so the list can be split again.  Children are aggregated per key
    before the join (a set per episode, bounded by the code vocabulary).
    """
    keys = list(keys)
    aggs = []
    for src, out in cols.items():
        v = scrub_delimiter(src, delimiter) if scrub else F.col(src)
        aggs.append(sorted_distinct_list(v, delimiter).alias(out))
    lists = children.groupBy(*keys).agg(*aggs)
    if keep == "matched":
        return lists.join(episodes.select(*keys).distinct(), keys, "left_semi")
    return episodes.select(*keys).join(lists, keys, "left")


def join_features(base: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Chain of left joins of per-key feature frames onto ``base``."""
    out = base
    for p in parts:
        out = out.join(p, list(keys), "left")
    return out
