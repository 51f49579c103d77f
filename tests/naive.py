"""Pair-emitting forms of the day-frame operators, for tests and the bench only."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodic.functions.scalars import range_flag
from episodic.operators.ranking import GROUP_N, RANK


def label_by_self_join(episodes: DataFrame, horizon_days: int = 365) -> DataFrame:
    """The label from every later episode of the same entity."""
    later = episodes.select(F.col("id").alias("_id"), F.col("start_date").alias("_start"))
    cond = (F.col("id") == F.col("_id")) & (F.col("_start") > F.col("end_date"))
    first = episodes.join(later, cond, "left").groupBy(*episodes.columns).agg(F.min("_start").alias("_next"))
    gap = F.datediff("_next", "end_date")
    return first.withColumn("label", range_flag(gap, 0, horizon_days, default=10000)).drop("_next")


def history_by_self_join(episodes: DataFrame, value: str, lo: int | None = None, hi: int | None = 0) -> DataFrame:
    """``total, n`` over the entity's episodes whose end lies ``lo`` to ``hi`` days around this end (None: no bound)."""
    mine = episodes.where("end_date is not null")
    other = mine.select(F.col("id").alias("_id"), F.datediff("end_date", F.lit("1970-01-01")).alias("_day"), F.col(value).alias("_value"))
    off = F.col("_day") - F.datediff("end_date", F.lit("1970-01-01"))
    cond = F.col("id") == F.col("_id")
    if lo is not None:
        cond = cond & (off >= lo)
    if hi is not None:
        cond = cond & (off <= hi)
    return mine.join(other, cond).groupBy(*episodes.columns).agg(F.sum("_value").alias("total"), F.count(F.lit(1)).alias("n"))


def rank_by_window(df: DataFrame, order: list, by: list[str]) -> DataFrame:
    """A whole group in one task."""
    return (df.withColumn(RANK, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
            .withColumn(GROUP_N, F.count(F.lit(1)).over(Window.partitionBy(*by))))
