"""Registered queries: one per operator, each with its DuckDB oracle.

``QUERIES[key](spark, sf_dir) -> DataFrame`` runs the operator on analog
inputs derived from the driver tables (whole tables, no sampling);
``ORACLES[key]`` is an independent SQL formulation -- wherever the
reference used a self range join or a correlated subquery, the oracle is
written in that naive form, so it checks our window rewrite.

Output hygiene shared by both sides: integer outputs are BIGINT, 0/1 flags
INTEGER, doubles rounded to 6 decimals, dates DATE, every column aliased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    """Round a double output to 6 decimals (both engines do the same)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def i64(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long")


def i32(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("int")


# Import the query modules so they register themselves.
from . import q_episodes, q_evaluate, q_features, q_io, q_models, q_preprocess, q_scalars, q_selection, q_trees  # noqa: E402,F401
