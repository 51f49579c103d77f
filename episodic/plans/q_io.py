"""Queries: sources and sinks (each writes to a scratch folder under the
shared checkpoint folder and reads back)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import io as IO
from ..sources.stages import Stages, VersionedTable
from ..session import TABLES
from . import analog
from .analog import with_ctes
from .catalog import i64, register

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

# fixed-width layout of the customer text file: (column, start, length), 1-based
FW_LAYOUT = [("key", 1, 12), ("name", 13, 25), ("segment", 38, 12)]


@register("scan_fixed_width", """
SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment FROM customer""")
def q_scan_fixed_width(t):
    c = t.customer
    line = F.concat(F.rpad(F.col("c_custkey").cast("string"), 12, " "),
                    F.rpad(F.concat(F.col("c_name"), F.lit("?")), 25, " "),
                    F.rpad(F.concat(F.lit("?"), F.col("c_mktsegment")), 12, " "))
    path = IO.scratch_path(t.spark, "fixed_width")
    c.select(line.alias("value")).write.text(path)
    return IO.read_fixed_width(t.spark, path, FW_LAYOUT, one_based=True, strip="?")


DEF_LINES = """
SELECT 1 AS line_no, 'column_name,   start position ,  length' AS text
UNION ALL SELECT 2, 'Name,  Type,  x,  1,  2'
UNION ALL SELECT c_custkey + 3,
       'F' || CAST(c_custkey AS VARCHAR) || ',' || c_mktsegment || '   FIELD  ' || CAST(c_nationkey AS VARCHAR) ||
       ',CHAR,' || CAST(c_custkey * 4 + 1 AS VARCHAR) || ',' || CAST(4 + c_nationkey % 3 AS VARCHAR)
FROM customer"""


@register("layout_normalise", with_ctes([], """
SELECT line_no, split_part(n, ',', 2) AS "column", CAST(split_part(n, ',', 4) AS INTEGER) AS start,
       CAST(split_part(n, ',', 5) AS INTEGER) AS length
FROM (SELECT line_no, replace(regexp_replace(text, ' {2,}', ' ', 'g'), ' ', '_') AS n FROM def_lines
      WHERE line_no > (SELECT min(line_no) FROM def_lines)) s
WHERE n NOT LIKE 'Name,%'""", extra=[("def_lines", DEF_LINES)]))
def q_layout_normalise(t):
    c = t.customer
    head = t.spark.createDataFrame([(1, "column_name,   start position ,  length"), (2, "Name,  Type,  x,  1,  2")],
                                   "line_no long, text string")
    body = c.select((F.col("c_custkey") + 3).alias("line_no"),
                    F.concat(F.lit("F"), F.col("c_custkey").cast("string"), F.lit(","), F.col("c_mktsegment"),
                             F.lit("   FIELD  "), F.col("c_nationkey").cast("string"), F.lit(",CHAR,"),
                             (F.col("c_custkey") * 4 + 1).cast("string"), F.lit(","),
                             (F.lit(4) + F.col("c_nationkey") % 3).cast("string")).alias("text"))
    return IO.layout_from_definition(head.unionByName(body))


@register("clean_raw_strings", """
SELECT c_custkey AS id, replace(c_name || '?', '?', '') AS name,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE replace('?' || c_mktsegment, '?', '') END AS segment
FROM customer""")
def q_clean_raw_strings(t):
    from ..functions.frames import clean_strings
    c = t.customer
    raw = c.select(F.col("c_custkey").alias("id"), F.concat(F.col("c_name"), F.lit("?")).alias("name"),
                   F.when(F.col("c_custkey") % 9 == 0, F.lit("")).otherwise(
                       F.concat(F.lit("?"), F.col("c_mktsegment"))).alias("segment"))
    return clean_strings(raw, "?\u0000", empty_to_null=True)


CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType())])


# texts that need quoting: quotes, separators, line ends and NUL bytes (which the reader removes)
@register("scan_csv_roundtrip", """
SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN ' "x", y' WHEN 1 THEN chr(10) || 'next' WHEN 2 THEN '"' ELSE '' END AS c_name,
       c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_scan_csv_roundtrip(t):
    path = IO.scratch_path(t.spark, "csv")
    k = F.col("c_custkey") % 4
    odd = F.when(k == 0, ' "x", y').when(k == 1, "\nnext").when(k == 2, '"').otherwise("\u0000")
    rows = t.customer.select(*CUSTOMER_COLS).withColumn("c_name", F.concat("c_name", odd))
    IO.write_csv(rows, path)
    return IO.read_csv_checked(t.spark, path, IO.scratch_path(t.spark, "rejects"), CUSTOMER_SCHEMA)


@register("csv_bad_rows", """
SELECT c_custkey || ',' || c_name || ',x,y' AS value FROM customer WHERE c_custkey % 3 = 0""")
def q_csv_bad_rows(t):
    """Every third row has a field too many, the next one a field too few."""
    path, bad = IO.scratch_path(t.spark, "csv"), IO.scratch_path(t.spark, "rejects")
    k = F.col("c_custkey") % 3
    line = F.concat_ws(",", "c_custkey", F.when(k != 1, F.col("c_name")), F.lit("x"), F.when(k == 0, "y"))
    body = t.customer.select(line.alias("custkey,name,flag"))
    body.write.option("header", True).option("quote", "\u0000").option("escapeQuotes", False).csv(path)
    IO.read_csv_checked(t.spark, path, bad)
    return t.spark.read.text(bad)


@register("clean_column_names", """
SELECT c_custkey AS "CCustKey", c_name AS cname, c_mktsegment AS mktsegment FROM customer""")
def q_clean_column_names(t):
    dirty = t.customer.select(F.col("c_custkey").alias("C. Cust-Key (#)"), F.col("c_name").alias("c name/&:"),
                              F.col("c_mktsegment").alias("mkt__segment"))
    return IO.clean_column_names(dirty)


LOADED = list(TABLES)


@register("load_tables", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {n}" for n in LOADED))
def q_load_tables(t):
    dst = IO.scratch_path(t.spark, "loaded")
    paths = IO.load_tables(t.spark, t.sf_dir, LOADED, dst)
    parts = [t.spark.read.parquet(p).agg(i64(F.count(F.lit(1))).alias("n_rows"))
             .select(F.lit(n).alias("table_name"), "n_rows") for n, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("materialise_roundtrip", with_ctes(["episodes"], "SELECT * FROM episodes"))
def q_materialise_roundtrip(t):
    return IO.materialise(analog.episodes(t), IO.scratch_path(t.spark, "episodes"))


@register("append_table", with_ctes(["episodes"], "SELECT * FROM episodes"))
def q_append_table(t):
    e = analog.episodes(t)
    path = IO.scratch_path(t.spark, "append")
    odd = F.year("end_date") % 2 == 1
    IO.materialise(e.where(odd), path)
    IO.append_table(e.where(~odd | odd.isNull()), path)
    return t.spark.read.parquet(path)


@register("union_years", with_ctes(["results_like"], """
SELECT year, gender, model, parameters, recall_10, precision_10, auc, classifiers FROM results_like
WHERE year IN (1996, 1998, 2000)"""))
def q_union_years(t):
    path = IO.scratch_path(t.spark, "results")
    IO.append_table(analog.results_like(t), path, partition_by=["year"])
    r = IO.read_years(t.spark, path, [1996, 1998, 2000])
    return r.select("year", "gender", "model", "parameters", "recall_10", "precision_10", "auc", "classifiers")


RESULT_COLUMNS = ["year", "gender", "model", "parameters", "recall_10", "precision_10", "auc", "classifiers"]


@register("results_replaced", with_ctes(["results_like"], f"""
SELECT {", ".join(RESULT_COLUMNS)}, CAST(CASE WHEN year = 1998 THEN 2 ELSE 1 END AS INTEGER) AS attempt FROM results_like"""))
def q_results_replaced(t):
    """Results written by (year, model): all of them, a year again, a write that was interrupted, and all but that year again."""
    table = VersionedTable(t.spark, IO.scratch_path(t.spark, "results"), ["year", "model"])
    rows = analog.results_like(t).select(*RESULT_COLUMNS)
    attempt = lambda n: F.lit(n).alias("attempt")
    table.replace(rows.select("*", attempt(1)))
    table.replace(rows.where("year = 1998").select("*", attempt(2)))
    rows.select("*", attempt(3)).write.partitionBy("year", "model").parquet(f"{table.path}/data/version=unfinished")  # no record
    table.replace(rows.where("year != 1998").select("*", attempt(1)))
    table.drop_superseded()
    return table.read().select(*RESULT_COLUMNS, "attempt")


@register("stages_rebuilt", """
WITH per_year AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1),
runs(run, built) AS (VALUES (1, 'customers,orders_by_year,years,names'), (2, ''), (3, 'years'))
SELECT CAST(run AS INTEGER) AS run, built,
       CAST((SELECT count(*) FROM per_year WHERE n > CASE WHEN run = 3 THEN 10 ELSE 0 END) AS BIGINT) AS n_years,
       CAST((SELECT count(DISTINCT c_name) FROM customer) AS BIGINT) AS n_names
FROM runs""")
def q_stages_rebuilt(t):
    """Two chains of stages built, asked for again, and asked for with another parameter of one stage."""
    folder = IO.scratch_path(t.spark, "stages")
    orders, customer = (f"{t.sf_dir.rstrip('/')}/{n}.parquet" for n in ("orders", "customer"))
    out = None
    for run, least in ((1, 0), (2, 0), (3, 10)):
        s = Stages(t.spark, folder)
        known = s.table("customers", lambda: t.customer.select("c_custkey", "c_name"), inputs=[customer])
        by_year = s.table("orders_by_year", lambda: t.orders.groupBy(F.year("o_orderdate").alias("y")).count(), inputs=[orders])
        years = s.table("years", lambda: by_year.where(F.col("count") > least), parameters={"least": least}, after=["orders_by_year"])  # noqa: B023
        names = s.table("names", lambda: known.select("c_name").distinct(), after=["customers"])
        n_names = names.agg(i64(F.count(F.lit(1))).alias("n_names")).withColumn("run", F.lit(run))
        row = (years.agg(i64(F.count(F.lit(1))).alias("n_years")).withColumn("run", F.lit(run)).join(n_names, "run")
               .select("run", F.lit(",".join(s.built)).alias("built"), "n_years", "n_names"))
        out = row if out is None else out.unionByName(row)
    return out
