"""Connected components of a link table by alternating stars.

Each round sends every node's neighbours to the smallest node around it, first
among larger neighbours, then among smaller ones.  Minima are grouped with
partial aggregation and joined back, so a node with very many neighbours is
never gathered in one task.  Rounds are written to the shared folder; the loop
ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reuse


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger node ``a`` to the smaller ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free sum of the edges' hashes: one row to the driver."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node in ``links`` (``a, b`` long): the smallest node reachable.

    Null ends and links of a node with itself are ignored.  Nodes without links are not listed.
    """
    edges = (links.where("a is not null and b is not null and a != b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = reuse(edges, "links")
    before = _state(edges)
    if before[0]:
        for _ in range(most_rounds):
            edges = reuse(_small_star(_large_star(edges)), "stars")
            now = _state(edges)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("the components didn't settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
