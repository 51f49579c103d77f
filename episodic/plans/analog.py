"""Analog inputs built from the driver's TPC-H-like tables.

The operators are generic (entity / episode / start / end); the driver only
ships TPC-H-like tables, so each domain input is derived from them.  Every
analog exists twice: as a DataFrame plan (used by the Spark queries) and as
an SQL text (used by the DuckDB oracles).  The two are written independently
from the same definition:

- ``episodes``: orders with status F or O having a line item with return
  flag R; entity = customer, episode = order, start = order date,
  end = start + (orderkey * 37) % 400 days.
- ``episodes_hot``: the same episodes with every third customer re-keyed to
  one entity (a third of all rows on one key).
- ``components``: one row per line item (entity, episode, component number,
  county = return flag, term = line status, offence = "type,brand",
  qualifier, penalty class, felony code).
- ``spans``: line-item date spans with a sentinel begin date on line 7.
- ``commitments``: one row per order plus a second row for every 50th order.
- ``attributes``: per customer, gender / race / birth date (with sentinels).
- ``events_by_entity``: dated events per customer (ship date), verdict
  R -> GUILTY, A -> DISMISSED, N -> NULL.
- ``scored``: orders with a deterministic score, a label and attributes,
  the input of every metric operator.
- ``results_like``: a model-results table (year, gender, model, parameters,
  metrics) aggregated from line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Tables

# ---------------------------------------------------------------- Spark side


def _date(c: str):
    return F.col(c).cast("date")


def episodes(t: Tables) -> DataFrame:
    o = t.orders
    returned = t.lineitem.where(F.col("l_returnflag") == "R").select("l_orderkey")
    return (
        o.where(F.col("o_orderstatus").isin("F", "O"))
        .join(returned, o.o_orderkey == returned.l_orderkey, "left_semi")
        .select(
            F.col("o_custkey").alias("id"),
            F.col("o_orderkey").alias("prefix"),
            _date("o_orderdate").alias("start_date"),
            F.date_add(_date("o_orderdate"), ((F.col("o_orderkey") * 37) % 400).cast("int")).alias("end_date"),
        )
    )


def episodes_hot(t: Tables) -> DataFrame:
    """``episodes`` with every third customer re-keyed to entity 0, so one
    entity holds about a third of all episodes (the skew case)."""
    e = episodes(t)
    return e.withColumn("id", F.when(F.col("id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("id")))


def components(t: Tables) -> DataFrame:
    li, o, p = t.lineitem, t.orders, t.part
    return (
        li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
        .join(p.select("p_partkey", "p_type", "p_brand", "p_size"), li.l_partkey == p.p_partkey)
        .select(
            F.col("o_custkey").alias("id"),
            F.col("l_orderkey").alias("prefix"),
            F.col("l_linenumber").alias("component_no"),
            F.col("l_returnflag").alias("county"),
            F.col("l_linestatus").alias("term"),
            F.concat_ws(",", "p_type", "p_brand").alias("offense"),
            F.concat(F.col("l_linestatus"), F.col("l_returnflag")).alias("qualifier"),
            F.when(F.col("p_size") < 10, "A").when(F.col("p_size") < 25, "B").otherwise("C").alias("penalty"),
            F.when(F.col("l_returnflag") == "R", "FELON").otherwise("MISDE").alias("felony_cd"),
        )
    )


def spans(t: Tables) -> DataFrame:
    li, o = t.lineitem, t.orders
    od = _date("o_orderdate")
    return li.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("id"),
        F.col("l_orderkey").alias("prefix"),
        F.when(F.col("l_linenumber") == 7, F.lit("0001-01-01").cast("date")).otherwise(od).alias("begin_date"),
        F.date_add(od, ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 5) % 400).cast("int")).alias("actual_end"),
        F.date_add(od, (F.lit(400) + F.col("l_linenumber")).cast("int")).alias("projected_end"),
    )


def commitments(t: Tables) -> DataFrame:
    o = t.orders
    od = _date("o_orderdate")
    flag = F.when(F.col("o_orderpriority").startswith("1"), "N").otherwise("Y")
    first = o.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("prefix"),
        F.date_sub(od, (F.col("o_orderkey") % 30).cast("int")).alias("effective_date"),
        flag.alias("new_period_flag"))
    second = o.where(F.col("o_orderkey") % 50 == 0).select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("prefix"),
        F.date_sub(od, F.lit(45)).alias("effective_date"),
        F.lit("Y").alias("new_period_flag"))
    return first.unionByName(second)


def attributes(t: Tables) -> DataFrame:
    c = t.customer
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.when(k % 3 == 0, "FEMALE").when(k % 3 == 1, "MALE").alias("gender"),
        F.when(k % 11 != 0, F.col("c_mktsegment")).alias("race"),
        F.when(k % 17 == 0, F.lit("0001-01-01").cast("date"))
        .otherwise(F.date_add(F.lit("1940-01-01").cast("date"), ((k * 7919) % 21000).cast("int")))
        .alias("birth_date"),
    )


def events_by_entity(t: Tables) -> DataFrame:
    li, o = t.lineitem, t.orders
    return li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("id"),
        _date("l_shipdate").alias("event_date"),
        F.when(F.col("l_returnflag") == "R", "GUILTY").when(F.col("l_returnflag") == "A", "DISMISSED").alias("verdict"),
    )


def scored(t: Tables) -> DataFrame:
    o, c = t.orders, attributes(t)
    return o.join(c, o.o_custkey == c.id, "left").select(
        F.col("o_orderkey").alias("id"),
        F.year("o_orderdate").cast("int").alias("fold"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        (((F.col("o_orderkey") * 7919) % 1000) / 1000.0).alias("score"),
        F.col("gender"),
        F.col("race"),
    )


def results_like(t: Tables) -> DataFrame:
    li = t.lineitem
    g = F.col("l_partkey") % 3
    return (
        li.select(
            F.year("l_shipdate").cast("int").alias("year"),
            F.when(g == 0, "TOTAL").when(g == 1, "MALE").otherwise("FEMALE").alias("gender"),
            F.col("l_returnflag").alias("model"),
            F.concat(F.lit("{'status': '"), F.col("l_linestatus"), F.lit("', 'line': "),
                     F.col("l_linenumber").cast("string"), F.lit("}")).alias("parameters"),
            "l_discount", "l_tax", "l_quantity",
        )
        .groupBy("year", "gender", "model", "parameters")
        .agg(
            F.round(F.avg("l_discount") * 10, 6).alias("recall_10"),
            F.round(F.avg("l_tax") * 10, 6).alias("precision_10"),
            F.round(F.avg("l_quantity") / 50, 6).alias("auc"),
        )
        .withColumn("classifiers", F.col("model"))
    )


class HotTables:
    """The driver tables with every third customer's orders re-keyed to
    customer 0: every analog built on them carries one entity holding about
    a third of all episodes, components and events."""

    def __init__(self, t: Tables):
        self._t = t
        self.spark, self.sf_dir = t.spark, t.sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = getattr(self._t, name)
        if name == "orders":
            k = F.col("o_custkey")
            df = df.withColumn("o_custkey", F.when(k % 3 == 0, F.lit(0).cast(df.schema["o_custkey"].dataType))
                               .otherwise(k))
        return df


HOT_ORDERS_SQL = """
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN CAST(0 AS BIGINT) ELSE o_custkey END AS o_custkey,
       o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders"""


def hot_sql(sql: str) -> str:
    """An oracle rewritten onto the re-keyed orders (``hot_orders`` CTE)."""
    import re

    body = re.sub(r"\borders\b", "hot_orders", sql)
    if body.lstrip().upper().startswith("WITH "):
        return "WITH hot_orders AS (" + HOT_ORDERS_SQL + "),\n" + body.lstrip()[5:]
    return "WITH hot_orders AS (" + HOT_ORDERS_SQL + ")\n" + body


# ------------------------------------------------------------------ SQL side
# The same definitions, written as DuckDB SQL for the oracles.

SQL = {
    "episodes": """
SELECT o_custkey AS id, o_orderkey AS prefix, CAST(o_orderdate AS DATE) AS start_date,
       CAST(CAST(o_orderdate AS DATE) + CAST((o_orderkey * 37) % 400 AS INTEGER) AS DATE) AS end_date
FROM orders
WHERE o_orderstatus IN ('F', 'O')
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "episodes_hot": """
SELECT CASE WHEN id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE id END AS id, prefix, start_date, end_date
FROM episodes""",
    "components": """
SELECT o_custkey AS id, l_orderkey AS prefix, l_linenumber AS component_no,
       l_returnflag AS county, l_linestatus AS term, p_type || ',' || p_brand AS offense,
       l_linestatus || l_returnflag AS qualifier,
       CASE WHEN p_size < 10 THEN 'A' WHEN p_size < 25 THEN 'B' ELSE 'C' END AS penalty,
       CASE WHEN l_returnflag = 'R' THEN 'FELON' ELSE 'MISDE' END AS felony_cd
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "spans": """
SELECT o_custkey AS id, l_orderkey AS prefix,
       CASE WHEN l_linenumber = 7 THEN DATE '0001-01-01' ELSE CAST(o_orderdate AS DATE) END AS begin_date,
       CAST(CAST(o_orderdate AS DATE) + CAST((l_orderkey * 37 + l_linenumber * 5) % 400 AS INTEGER) AS DATE) AS actual_end,
       CAST(CAST(o_orderdate AS DATE) + CAST(400 + l_linenumber AS INTEGER) AS DATE) AS projected_end
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "commitments": """
SELECT o_custkey AS id, o_orderkey AS prefix,
       CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS effective_date,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'N' ELSE 'Y' END AS new_period_flag
FROM orders
UNION ALL
SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) - 45 AS DATE), 'Y'
FROM orders WHERE o_orderkey % 50 = 0""",
    "attributes": """
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 3 = 0 THEN 'FEMALE' WHEN c_custkey % 3 = 1 THEN 'MALE' END AS gender,
       CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS race,
       CASE WHEN c_custkey % 17 = 0 THEN DATE '0001-01-01'
            ELSE CAST(DATE '1940-01-01' + CAST((c_custkey * 7919) % 21000 AS INTEGER) AS DATE) END AS birth_date
FROM customer""",
    "events_by_entity": """
SELECT o_custkey AS id, CAST(l_shipdate AS DATE) AS event_date,
       CASE WHEN l_returnflag = 'R' THEN 'GUILTY' WHEN l_returnflag = 'A' THEN 'DISMISSED' END AS verdict
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "scored": """
SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS fold,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
       ((o_orderkey * 7919) % 1000) / 1000.0 AS score, a.gender, a.race
FROM orders LEFT JOIN attributes a ON o_custkey = a.id""",
    "results_like": """
SELECT year, gender, model, parameters,
       round(avg(l_discount) * 10, 6) AS recall_10, round(avg(l_tax) * 10, 6) AS precision_10,
       round(avg(l_quantity) / 50, 6) AS auc, model AS classifiers
FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
             CASE WHEN l_partkey % 3 = 0 THEN 'TOTAL' WHEN l_partkey % 3 = 1 THEN 'MALE' ELSE 'FEMALE' END AS gender,
             l_returnflag AS model,
             '{''status'': ''' || l_linestatus || ''', ''line'': ' || CAST(l_linenumber AS VARCHAR) || '}' AS parameters,
             l_discount, l_tax, l_quantity
      FROM lineitem) s
GROUP BY year, gender, model, parameters""",
}

# analog -> analogs it reads (for CTE ordering)
_DEPENDS = {"scored": ["attributes"], "episodes_hot": ["episodes"]}


def with_ctes(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH name AS (...), ... <body>`` for the listed analogs (deps first)."""
    order: list[str] = []

    def add(n):
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in (extra or [])]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
