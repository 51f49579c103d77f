"""Queries: fills, outliers, deciles, scaling, encoders, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import years_between_nonneg
from ..operators import preprocess as P
from . import analog
from .analog import with_ctes
from .catalog import i32, r6, register

# "nulled": numeric columns with planted NULLs, outliers and a constant.
NULLED = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS x,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 97 AS DOUBLE) END AS y,
       CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS w,
       CAST(3.0 AS DOUBLE) AS k
FROM orders"""


def nulled(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"),
        F.when(k % 13 != 0, F.col("o_totalprice")).alias("x"),
        F.when(k % 7 != 0, (k % 97).cast("double")).alias("y"),
        F.when(k % 500 == 0, F.col("o_totalprice") * 10).otherwise(F.col("o_totalprice")).alias("w"),
        F.lit(3.0).cast("double").alias("k"))


def _fill_sql(agg: str) -> str:
    return with_ctes([], f"""
SELECT id, round(coalesce(x, (SELECT {agg}(x) FROM nulled)), 6) AS x,
       round(coalesce(y, (SELECT {agg}(y) FROM nulled)), 6) AS y
FROM nulled""", extra=[("nulled", NULLED)])


def _fill(t, how):
    df = nulled(t).select("id", "x", "y")
    out = P.fill_nan(df, ["x", "y"], how)
    return out.select("id", r6("x").alias("x"), r6("y").alias("y"))


for _how in ("mean", "max", "min", "median"):
    register(f"fill_nan_{_how}", _fill_sql({"mean": "avg"}.get(_how, _how)))(
        (lambda h: lambda t: _fill(t, h))(_how))


@register("fill_by_aggregate", with_ctes([], """
SELECT id, round(coalesce(y, (SELECT stddev_pop(y) FROM nulled)), 6) AS y FROM nulled""",
                                         extra=[("nulled", NULLED)]))
def q_fill_by_aggregate(t):
    out = P.fill_by_aggregate(nulled(t).select("id", "y"), "y", F.stddev_pop)
    return out.select("id", r6("y").alias("y"))


@register("null_outliers", with_ctes([], """
SELECT id,
       round(CASE WHEN abs((w - (SELECT avg(w) FROM nulled)) / (SELECT stddev_pop(w) FROM nulled)) < 3 THEN w END, 6) AS w,
       round(CASE WHEN (SELECT stddev_pop(k) FROM nulled) > 0
                   AND abs((k - (SELECT avg(k) FROM nulled)) / (SELECT stddev_pop(k) FROM nulled)) < 3 THEN k END, 6) AS k
FROM nulled""", extra=[("nulled", NULLED)]))
def q_null_outliers(t):
    out = P.null_outliers(nulled(t).select("id", "w", "k"), ["w", "k"], sd=3)
    return out.select("id", r6("w").alias("w"), r6("k").alias("k"))


DECILE_SQL = with_ctes([], """
SELECT n.id, n.y,
       CASE WHEN n.y IS NULL THEN NULL
            ELSE CAST(len(list_filter(e.edges[2:len(e.edges) - 1], lambda v: n.y > v)) AS INTEGER) END AS ycat
FROM nulled n, (SELECT list_sort(list_distinct(list_transform(quantile_cont(y, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6,
                                                                               0.7, 0.8, 0.9, 1.0]),
                                                              lambda v: round(v, 9)))) AS edges
                FROM nulled) e""", extra=[("nulled", NULLED)])


@register("discretise_deciles", DECILE_SQL)
def q_discretise_deciles(t):
    out = P.discretise(nulled(t).select("id", "y"), ["y"], q=10, round_digits=9)
    return out.select("id", "y", i32("ycat").alias("ycat"))


SCALE_SQL = with_ctes([], """
SELECT id, round((x - s.lo_x) / CASE WHEN s.hi_x - s.lo_x = 0 THEN 1 ELSE s.hi_x - s.lo_x END, 6) AS x,
       round((k - s.lo_k) / CASE WHEN s.hi_k - s.lo_k = 0 THEN 1 ELSE s.hi_k - s.lo_k END, 6) AS k
FROM nulled, (SELECT min(x) lo_x, max(x) hi_x, min(k) lo_k, max(k) hi_k FROM nulled WHERE id % 2 = 0) s
WHERE id % 2 = 1""", extra=[("nulled", NULLED)])


@register("minmax_scale", SCALE_SQL)
def q_minmax_scale(t):
    df = nulled(t).select("id", "x", "k")
    train, test = df.where(F.col("id") % 2 == 0), df.where(F.col("id") % 2 == 1)
    out = P.apply_minmax(test, P.fit_minmax(train, ["x", "k"]))
    return out.select("id", r6("x").alias("x"), r6("k").alias("k"))


@register("minmax_inverse", with_ctes([], """
SELECT id, round(x, 6) AS x, round(k, 6) AS k FROM nulled WHERE id % 2 = 1""", extra=[("nulled", NULLED)]))
def q_minmax_inverse(t):
    df = nulled(t).select("id", "x", "k")
    train, test = df.where(F.col("id") % 2 == 0), df.where(F.col("id") % 2 == 1)
    stats = P.fit_minmax(train, ["x", "k"])
    out = P.invert_minmax(P.apply_minmax(test, stats), stats)
    return out.select("id", r6("x").alias("x"), r6("k").alias("k"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot", with_ctes(["attributes"], "SELECT id, race, " + ", ".join(
    f"CAST(CASE WHEN race = '{s}' THEN 1 ELSE 0 END AS INTEGER) AS race_{s}" for s in SEGMENTS)
    + " FROM attributes WHERE id % 2 = 1"))
def q_one_hot(t):
    a = analog.attributes(t).select("id", "race")
    vocab = P.fit_vocabulary(a.where(F.col("id") % 2 == 0), "race")
    return P.apply_one_hot(a.where(F.col("id") % 2 == 1), "race", vocab)


QUALS = ["FA", "FN", "FR", "OA", "ON", "OR"]


@register("multi_hot", with_ctes(["episodes", "components"], "SELECT id, prefix, qualifier_codes, " + ", ".join(
    f"CAST(CASE WHEN list_contains(string_split(qualifier_codes, ','), '{q}') THEN 1 ELSE 0 END AS INTEGER)"
    f" AS qualifier_codes_{q}" for q in QUALS) + """
FROM (SELECT l.id, l.prefix, string_agg(DISTINCT o.qualifier, ',' ORDER BY o.qualifier) AS qualifier_codes
      FROM episodes l LEFT JOIN components o
        ON l.id = o.id AND l.prefix = o.prefix GROUP BY l.id, l.prefix) s"""))
def q_multi_hot(t):
    from ..operators.features import distinct_lists
    kids = analog.components(t)
    lists = distinct_lists(analog.episodes(t), kids, ["id", "prefix"], {"qualifier": "qualifier_codes"}, keep="all")
    vocab = P.fit_vocabulary(lists, "qualifier_codes", sep=",")
    return P.apply_multi_hot(lists, "qualifier_codes", vocab, sep=",")


@register("align_to_train", with_ctes(["attributes"], "SELECT id, " + ", ".join(
    (f"CAST(CASE WHEN race = '{s}' THEN 1 ELSE 0 END AS INTEGER) AS race_{s}" if s != "BUILDING"
     else "CAST(0 AS INTEGER) AS race_BUILDING") for s in SEGMENTS if s != "MACHINERY")
    + " FROM attributes WHERE id % 2 = 1 AND race IS DISTINCT FROM 'BUILDING'"))
def q_align_to_train(t):
    a = analog.attributes(t).select("id", "race")
    train = a.where((F.col("id") % 2 == 0) & ~F.col("race").eqNullSafe("MACHINERY"))
    test = a.where((F.col("id") % 2 == 1) & ~F.col("race").eqNullSafe("BUILDING"))
    tr = P.apply_one_hot(train, "race", P.fit_vocabulary(train, "race"), keep=False)
    te = P.apply_one_hot(test, "race", P.fit_vocabulary(test, "race"), keep=False)
    return P.align_to_train(te, tr.columns).select("id", *[F.col(c).cast("int") for c in tr.columns if c != "id"])


GROUPED = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS yr,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS code,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS target
FROM orders"""


def grouped(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"), F.when(k % 19 != 0, F.year("o_orderdate").cast("int")).alias("yr"),
        F.when(k % 23 != 0, F.col("o_orderpriority")).alias("code"),
        F.when(k % 13 != 0, F.col("o_totalprice")).alias("target"))


@register("impute_group_mean", with_ctes([], """
SELECT n.id, round(coalesce(n.target, g.gm,
                            (SELECT avg(target) FROM g0 WHERE yr IS NOT NULL AND code IS NOT NULL)), 6) AS target
FROM g0 n LEFT JOIN (SELECT yr, code, avg(target) AS gm FROM g0 WHERE yr IS NOT NULL AND code IS NOT NULL
                     GROUP BY yr, code) g ON n.yr = g.yr AND n.code = g.code""", extra=[("g0", GROUPED)]))
def q_impute_group_mean(t):
    out = P.impute_group_mean(grouped(t), "yr", "code", "target")
    return out.select("id", r6("target").alias("target"))


AGES = """
SELECT id, prefix, yr, code, len,
       CASE WHEN prefix % 5 = 0 THEN NULL ELSE s0 END AS s,
       CASE WHEN prefix % 7 = 0 THEN NULL ELSE e0 END AS en,
       CASE WHEN prefix % 3 = 0 THEN NULL ELSE s0 - (prefix % 10) END AS f
FROM (SELECT e.id, e.prefix, CAST(year(e.start_date) AS INTEGER) AS yr, a.race AS code,
             CAST(e.end_date - e.start_date AS DOUBLE) AS len,
             CASE WHEN CAST(e.start_date - a.bd AS DOUBLE) / 365.0 < 0 THEN NULL
                  ELSE CAST(e.start_date - a.bd AS DOUBLE) / 365.0 END AS s0,
             CASE WHEN CAST(e.end_date - a.bd AS DOUBLE) / 365.0 < 0 THEN NULL
                  ELSE CAST(e.end_date - a.bd AS DOUBLE) / 365.0 END AS e0
      FROM episodes e LEFT JOIN (SELECT id, race, CASE WHEN CAST(birth_date AS VARCHAR) LIKE '0001%' THEN NULL
                                                       ELSE birth_date END AS bd FROM attributes) a
        ON e.id = a.id) z"""


def ages(t):
    from ..functions.scalars import sentinel_to_null
    a = analog.attributes(t).select("id", "race", sentinel_to_null("birth_date").alias("bd"))
    e = analog.episodes(t).join(a, "id", "left")
    s0 = years_between_nonneg("start_date", "bd")
    e0 = years_between_nonneg("end_date", "bd")
    p = F.col("prefix")
    return e.select("id", "prefix", F.year("start_date").cast("int").alias("yr"), F.col("race").alias("code"),
                    F.datediff("end_date", "start_date").cast("double").alias("len"),
                    F.when(p % 5 != 0, s0).alias("s"), F.when(p % 7 != 0, e0).alias("en"),
                    F.when(p % 3 != 0, s0 - (p % 10)).alias("f"))


@register("impute_cascade", with_ctes(["episodes", "attributes"], """
SELECT id, prefix, round(s2, 6) AS s, round(e3, 6) AS en, round(f4, 6) AS f FROM s4""", extra=[
    ("base", AGES),
    ("gm", "SELECT yr, code, avg(s) AS gs, avg(s - f) AS gd FROM base "
           "WHERE yr IS NOT NULL AND code IS NOT NULL GROUP BY yr, code"),
    ("s1", "SELECT b.*, coalesce(b.s, b.en - b.len / 365.0, gm.gs) AS s1, gm.gd FROM base b "
           "LEFT JOIN gm ON b.yr = gm.yr AND b.code = gm.code"),
    ("s2", "SELECT *, coalesce(s1, (SELECT avg(s1) FROM s1)) AS s2 FROM s1"),
    ("s3", "SELECT *, coalesce(en, s2 + len / 365.0) AS e3, coalesce(f, s2 - gd) AS f3 FROM s2"),
    ("s4", "SELECT *, coalesce(f3, s2 - (SELECT avg(s2 - f3) FROM s3)) AS f4 FROM s3"),
]))
def q_impute_cascade(t):
    out = P.impute_cascade(ages(t), "yr", "code", "len", "s", "en", "f")
    return out.select("id", "prefix", r6("s").alias("s"), r6("en").alias("en"), r6("f").alias("f"))
