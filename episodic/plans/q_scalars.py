"""Queries: filters, scalar expressions, simple joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.episodes import qualifying_keys, span_bounds
from . import analog
from .analog import with_ctes
from .catalog import i64, r6, register

# ------------------------------------------------------------ B1 equality


@register("filter_equality", with_ctes(["components", "commitments"], """
SELECT c.id, c.prefix, c.component_no FROM components c WHERE c.felony_cd = 'FELON'
UNION ALL
SELECT m.id, m.prefix, CAST(-1 AS INTEGER) FROM commitments m WHERE m.new_period_flag = 'Y'"""))
def q_filter_equality(t):
    a = analog.components(t).where(F.col("felony_cd") == "FELON").select("id", "prefix", "component_no")
    b = analog.commitments(t).where(F.col("new_period_flag") == "Y").select(
        "id", "prefix", F.lit(-1).cast("int").alias("component_no"))
    return a.unionByName(b)


# ------------------------------------------------------------ B2 sentinels


@register("filter_sentinel_dates", with_ctes(["spans"], """
SELECT id, prefix, begin_date, actual_end, projected_end FROM spans
WHERE CAST(begin_date AS VARCHAR) NOT LIKE '0001%' AND CAST(projected_end AS VARCHAR) NOT LIKE '0001%'
  AND CAST(actual_end AS VARCHAR) NOT LIKE '0001%'"""))
def q_filter_sentinel_dates(t):
    s = analog.spans(t)
    return s.where(S.not_sentinel("begin_date") & S.not_sentinel("projected_end") & S.not_sentinel("actual_end"))


@register("sentinel_to_null", with_ctes(["attributes"], """
SELECT id, CASE WHEN CAST(birth_date AS VARCHAR) LIKE '0001%' THEN NULL ELSE birth_date END AS birth_date
FROM attributes"""))
def q_sentinel_to_null(t):
    return analog.attributes(t).select("id", S.sentinel_to_null("birth_date").alias("birth_date"))


# ------------------------------------------------------------ B7 ages


@register("age_features", with_ctes(["episodes", "attributes"], """
SELECT e.id, e.prefix,
       round(CASE WHEN CAST(e.start_date - b.bd AS DOUBLE) / 365.0 < 0 THEN NULL
                  ELSE CAST(e.start_date - b.bd AS DOUBLE) / 365.0 END, 6) AS age_at_start,
       round(CASE WHEN CAST(e.end_date - b.bd AS DOUBLE) / 365.0 < 0 THEN NULL
                  ELSE CAST(e.end_date - b.bd AS DOUBLE) / 365.0 END, 6) AS age_at_end
FROM episodes e LEFT JOIN (
  SELECT id, CASE WHEN CAST(birth_date AS VARCHAR) LIKE '0001%' THEN NULL
                  ELSE CAST(birth_date + 12000 AS DATE) END AS bd FROM attributes) b ON e.id = b.id"""))
def q_age_features(t):
    # birth dates shifted 12,000 days later so that some ages are negative (-> NULL)
    a = analog.attributes(t).select("id", F.date_add(S.sentinel_to_null("birth_date"), 12000).alias("bd"))
    e = analog.episodes(t).join(a, "id", "left")
    return e.select("id", "prefix",
                    r6(S.years_between_nonneg("start_date", "bd")).alias("age_at_start"),
                    r6(S.years_between_nonneg("end_date", "bd")).alias("age_at_end"))


# ------------------------------------------------------------ B8 strict least

ORDER_DATES = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date_a,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            ELSE CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 30 AS INTEGER) + 10 AS DATE) END AS date_b
FROM orders"""


def _order_dates(t):
    o = t.orders
    d = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 7 != 0, d).alias("date_a"),
        F.when(F.col("o_orderkey") % 11 != 0,
               F.date_add(F.date_sub(d, (F.col("o_orderkey") % 30).cast("int")), 10)).alias("date_b"))


@register("row_least_null_strict", with_ctes([], """
SELECT id, CASE WHEN date_a IS NULL OR date_b IS NULL THEN NULL ELSE least(date_a, date_b) END AS least_date
FROM od""", extra=[("od", ORDER_DATES)]))
def q_row_least_null_strict(t):
    return _order_dates(t).select("id", S.least_strict("date_a", "date_b").alias("least_date"))


# ------------------------------------------------------------ B15 year


@register("extract_year", with_ctes(["episodes"], """
SELECT id, prefix, CAST(year(start_date) AS INTEGER) AS start_year FROM episodes"""))
def q_extract_year(t):
    return analog.episodes(t).select("id", "prefix", F.year("start_date").cast("int").alias("start_year"))


# ------------------------------------------------------------ B16 keep NULL


@register("filter_not_equal_keep_null", with_ctes(["attributes"], """
SELECT id, gender FROM attributes WHERE gender IS DISTINCT FROM 'FEMALE'"""))
def q_filter_not_equal_keep_null(t):
    return analog.attributes(t).where(S.not_equal_keep_null("gender", "FEMALE")).select("id", "gender")


# ------------------------------------------------------------ B17 replace


@register("replace_values", with_ctes(["components"], """
SELECT id, prefix, CASE WHEN term_list = 'F,O' THEN 'O,F' ELSE term_list END AS term_list
FROM (SELECT id, prefix, string_agg(DISTINCT term, ',' ORDER BY term) AS term_list
      FROM components GROUP BY id, prefix) s"""))
def q_replace_values(t):
    from ..operators.features import sorted_distinct_list
    lists = analog.components(t).groupBy("id", "prefix").agg(sorted_distinct_list(F.col("term")).alias("term_list"))
    return lists.replace({"F,O": "O,F"}, subset=["term_list"])


# ------------------------------------------------------------ B18 flags


@register("flag_to_dummy", with_ctes(["commitments"], """
SELECT id, prefix,
       CAST(CASE new_period_flag WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS INTEGER) AS new_period,
       CAST(CASE status WHEN 'Y' THEN 1 WHEN 'N' THEN 0 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'T' THEN 1
                        WHEN 'F' THEN 0 WHEN 't' THEN 1 WHEN 'f' THEN 0 WHEN 'True' THEN 1 WHEN 'False' THEN 0
                        WHEN 'OPEN' THEN 1 WHEN 'CLOSED' THEN 0 END AS INTEGER) AS status
FROM (SELECT c.*, o.o_orderstatus AS status FROM commitments c JOIN orders o ON c.prefix = o.o_orderkey) x"""))
def q_flag_to_dummy(t):
    from ..functions.frames import flag_to_dummy
    o = t.orders.select(F.col("o_orderkey").alias("prefix"), F.col("o_orderstatus").alias("status_flag"))
    df = analog.commitments(t).join(o, "prefix")
    return flag_to_dummy(df, ["new_period_flag", "status_flag"], rename=True).select(
        "id", "prefix", "new_period", F.col("status").alias("status"))


# ------------------------------------------------------------ B19 binary code


@register("binary_code_dummy", with_ctes(["attributes"], """
SELECT id, CAST(CASE gender WHEN 'FEMALE' THEN 1 WHEN 'MALE' THEN 0 WHEN 'F' THEN 1 WHEN 'M' THEN 0 END AS INTEGER)
       AS female FROM attributes"""))
def q_binary_code_dummy(t):
    from ..functions.frames import binary_to_dummy
    return binary_to_dummy(analog.attributes(t), "gender", "female").select("id", "female")


# ------------------------------------------------------------ B20 numeric

RAW_NUM = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'x' || CAST(o_orderkey AS VARCHAR)
            WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey AS VARCHAR) || '.5'
            ELSE CAST(o_orderkey AS VARCHAR) END AS raw
FROM orders"""


def _raw_num(t):
    k = F.col("o_orderkey")
    ks = k.cast("string")
    return t.orders.select(k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("x"), ks))
                           .when(k % 5 == 1, F.concat(ks, F.lit(".5"))).otherwise(ks).alias("raw"))


@register("to_numeric_coerce", with_ctes([], """
SELECT id, raw, round(TRY_CAST(raw AS DOUBLE), 6) AS num,
       CASE WHEN TRY_CAST(raw AS DOUBLE) = floor(TRY_CAST(raw AS DOUBLE)) THEN CAST(TRY_CAST(raw AS DOUBLE) AS BIGINT) END
         AS num_int
FROM raw_num""", extra=[("raw_num", RAW_NUM)]))
def q_to_numeric_coerce(t):
    r = _raw_num(t)
    return r.select("id", "raw", r6(S.to_numeric("raw")).alias("num"),
                    S.to_numeric("raw", integral=True).alias("num_int"))


# ------------------------------------------------------------ B21 dates


@register("parse_dates", with_ctes([], """
SELECT id, txt, TRY_CAST(txt AS DATE) AS parsed FROM (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'not a date'
                                ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS txt FROM orders) s"""))
def q_parse_dates(t):
    k = F.col("o_orderkey")
    s = t.orders.select(k.alias("id"), F.when(k % 9 == 0, F.lit("not a date"))
                        .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("txt"))
    return s.select("id", "txt", S.parse_date("txt").alias("parsed"))


# ------------------------------------------------------------ B22 year range


@register("year_range_null", with_ctes([], """
SELECT id, mdy, CASE WHEN CAST(split_part(mdy, '/', 3) AS INTEGER) BETWEEN 1996 AND 1999 THEN mdy END AS mdy_in_range
FROM (SELECT o_orderkey AS id,
             CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || '/' ||
             CAST(year(o_orderdate) AS VARCHAR) AS mdy FROM orders) s"""))
def q_year_range_null(t):
    o = t.orders
    mdy = F.concat_ws("/", F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string"),
                      F.year("o_orderdate").cast("string"))
    s = o.select(F.col("o_orderkey").alias("id"), mdy.alias("mdy"))
    return s.select("id", "mdy", S.year_in_range_or_null("mdy", 1996, 1999).alias("mdy_in_range"))


# ------------------------------------------------------------ B23, B24


@register("missing_indicator", with_ctes(["attributes"], """
SELECT id, race, CAST(CASE WHEN race IS NULL THEN 1 ELSE 0 END AS INTEGER) AS race_missing,
       CAST(CASE WHEN gender IS NULL THEN 1 ELSE 0 END AS INTEGER) AS gender_missing FROM attributes"""))
def q_missing_indicator(t):
    from ..functions.frames import add_indicators
    return add_indicators(analog.attributes(t), ["race", "gender"], "missing").select(
        "id", "race", "race_missing", "gender_missing")


@register("fill_constant", with_ctes(["episodes", "events_by_entity"], """
SELECT e.id, e.prefix, coalesce(a.race, 'MISSING') AS race, coalesce(a.gender, 'MISSING') AS gender,
       CAST(coalesce(v.n, 0) AS BIGINT) AS n_events
FROM episodes e
LEFT JOIN attributes a ON e.id = a.id
LEFT JOIN (SELECT id, count(*) AS n FROM events_by_entity WHERE verdict = 'DISMISSED' GROUP BY id) v ON e.id = v.id""", extra=[("attributes", analog.SQL["attributes"])]))
def q_fill_constant(t):
    a = analog.attributes(t).select("id", "race", "gender")
    v = (analog.events_by_entity(t).where(F.col("verdict") == "DISMISSED")
         .groupBy("id").agg(F.count(F.lit(1)).alias("n_events")))
    df = analog.episodes(t).join(a, "id", "left").join(v, "id", "left")
    df = df.fillna("MISSING", subset=["race", "gender"]).fillna(0, subset=["n_events"])
    return df.select("id", "prefix", "race", "gender", i64("n_events").alias("n_events"))


# ------------------------------------------------------------ C1, C2, D1-D3

# fully dated spans: every date is there and lies outside year 1
BOUNDS = """
SELECT id, prefix, min(begin_date) AS span_start, max(actual_end) AS end_actual, max(projected_end) AS end_proj
FROM (SELECT * FROM spans WHERE least(year(begin_date), year(actual_end), year(projected_end)) > 1
        AND begin_date IS NOT NULL AND actual_end IS NOT NULL AND projected_end IS NOT NULL)
GROUP BY ALL"""


@register("group_min_max", with_ctes(["spans"], "SELECT * FROM bounds", extra=[("bounds", BOUNDS)]))
def q_group_min_max(t):
    return span_bounds(analog.spans(t), ["id", "prefix"], "begin_date", "actual_end", "projected_end") \
        .withColumnRenamed("end_projected", "end_proj")


@register("join_natural_inner", with_ctes(["spans", "commitments"], """
SELECT b.id, b.prefix, b.span_start, b.end_actual, c.effective_date
FROM bounds b JOIN (SELECT * FROM commitments WHERE new_period_flag = 'Y') c ON b.id = c.id AND b.prefix = c.prefix""",
                                          extra=[("bounds", BOUNDS)]))
def q_join_natural_inner(t):
    b = span_bounds(analog.spans(t), ["id", "prefix"], "begin_date", "actual_end", "projected_end")
    c = analog.commitments(t).where(F.col("new_period_flag") == "Y")
    return b.join(c, ["id", "prefix"], "inner").select("id", "prefix", "span_start", "end_actual", "effective_date")


@register("distinct_keys", with_ctes(["components"], """
SELECT DISTINCT id, prefix FROM components WHERE felony_cd = 'FELON'"""))
def q_distinct_keys(t):
    return qualifying_keys(analog.components(t), ["id", "prefix"], "felony_cd", "FELON")


@register("join_semi_qualifying", with_ctes(["spans", "components"], """
SELECT b.* FROM bounds b JOIN (SELECT DISTINCT id, prefix FROM components WHERE felony_cd = 'FELON') f
  ON b.id = f.id AND b.prefix = f.prefix""", extra=[("bounds", BOUNDS)]))
def q_join_semi_qualifying(t):
    b = span_bounds(analog.spans(t), ["id", "prefix"], "begin_date", "actual_end", "projected_end") \
        .withColumnRenamed("end_projected", "end_proj")
    keys = qualifying_keys(analog.components(t), ["id", "prefix"], "felony_cd", "FELON")
    return b.join(keys, ["id", "prefix"], "left_semi")


@register("group_pick_first", with_ctes(["commitments"], """
SELECT id, prefix, effective_date, new_period_flag FROM (
  SELECT c.*, row_number() OVER (PARTITION BY id, prefix ORDER BY effective_date, new_period_flag) AS rn
  FROM commitments c) s WHERE rn = 1"""))
def q_group_pick_first(t):
    c = analog.commitments(t)
    p = c.groupBy("id", "prefix").agg(F.min(F.struct("effective_date", "new_period_flag")).alias("_p"))
    return p.select("id", "prefix", "_p.effective_date", "_p.new_period_flag")


# ------------------------------------------------------------ A10 parameters


@register("parameterised_query", with_ctes(["episodes"], """
SELECT id, prefix, end_date FROM episodes WHERE end_date >= DATE '1997-01-01' AND end_date < DATE '1999-01-01' - 365"""))
def q_parameterised_query(t):
    e = analog.episodes(t)
    return t.spark.sql(
        "SELECT id, prefix, end_date FROM {e} WHERE end_date >= to_date(:lo) "
        "AND end_date < date_sub(to_date(:hi), :gap)",
        args={"lo": "1997-01-01", "hi": "1999-01-01", "gap": 365}, e=e)


# ------------------------------------------------------------ D13, D17, D19


@register("null_columns", with_ctes(["attributes"], """
SELECT column_name, n_null FROM (
  SELECT 'id' AS column_name, CAST(count(*) - count(id) AS BIGINT) AS n_null FROM attributes
  UNION ALL SELECT 'gender', CAST(count(*) - count(gender) AS BIGINT) FROM attributes
  UNION ALL SELECT 'race', CAST(count(*) - count(race) AS BIGINT) FROM attributes
  UNION ALL SELECT 'birth_date', CAST(count(*) - count(birth_date) AS BIGINT) FROM attributes) s
WHERE n_null > 0"""))
def q_null_columns(t):
    from ..operators.preprocess import null_columns
    return null_columns(analog.attributes(t))


@register("baseline_prevalence", with_ctes(["scored"], """
SELECT fold, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS positives,
       round(avg(label), 6) AS baseline FROM scored GROUP BY fold"""))
def q_baseline_prevalence(t):
    s = analog.scored(t)
    return s.groupBy("fold").agg(i64(F.count(F.lit(1))).alias("n"), i64(F.sum("label")).alias("positives"),
                                 r6(F.avg("label")).alias("baseline"))


@register("result_counts", with_ctes(["results_like"], """
SELECT gender, CAST(count(*) AS BIGINT) AS n_results FROM results_like GROUP BY gender"""))
def q_result_counts(t):
    return analog.results_like(t).groupBy("gender").agg(i64(F.count(F.lit(1))).alias("n_results"))

