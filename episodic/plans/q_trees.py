"""Queries of the tree grower, of boosted stumps and of naive Bayes, each with a SQL form of the same fit.

The rows are line items by (order, line): the label says whether one of them
was returned, the features are small numbers and two scaled amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bayes as N
from ..operators import boosting as B
from ..operators import preprocess as P
from ..operators import trees as T
from ..session import reuse
from .catalog import register

NAMES = ["items", "quantity", "discount", "tax", "line", "month", "year"]

ROWS_SQL = """
base AS (
  SELECT l_orderkey * 16 + l_linenumber AS id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y,
         CAST(count(*) AS DOUBLE) AS f0, max(l_quantity) AS f1, max(l_discount) AS f2, min(l_tax) AS f3,
         CAST(l_linenumber AS DOUBLE) AS f4, CAST(month(min(l_shipdate)) AS DOUBLE) AS f5, CAST(year(min(l_shipdate)) AS DOUBLE) AS f6
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
e AS (SELECT id, unnest([0, 1, 2, 3, 4, 5, 6]) AS f, unnest([f0, f1, f2, f3, f4, f5, f6]) AS v FROM base),
halves AS (SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS threshold FROM (SELECT DISTINCT f, v FROM e) q)"""


def returned(t) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("label"), F.count(F.lit(1)).cast("double").alias("items"),
        F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.min("l_tax").alias("tax"),
        F.month(F.min("l_shipdate")).cast("double").alias("month"), F.year(F.min("l_shipdate")).cast("double").alias("year"))
    rows = rows.withColumn("line", F.col("l_linenumber").cast("double")).withColumn("id", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    return rows.select("id", "label", *NAMES)


def vectors(rows: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """``x``: the named columns as a map from position to value."""
    every = F.map_from_arrays(F.array(*[F.lit(i) for i in range(len(names))]), F.array(*names))
    return rows.withColumn("x", F.map_filter(every, lambda _, v: v != 0))


def _uniform_sql(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::BIGINT / 4294967296.0"


def grow_sql(s: T.TreeSettings, rows: str = ROWS_SQL, n_features: int = len(NAMES)) -> str:
    """CTEs ``base, e, halves`` and ``s``, one row per (tree, node, row): the settings' trees grown by recursion.

    Children carry their parent's split as ``pf, pt``.  ``node`` lists the nodes.
    """
    impurity = {"gini": "2 * {s} * ({n} - {s}) / {n}",
                "entropy": "(CASE WHEN {s} > 0 THEN -{s} * ln({s} / {n}) ELSE 0 END + CASE WHEN {n} - {s} > 0 THEN -({n} - {s}) * ln(({n} - {s}) / {n}) ELSE 0 END)"}
    after = " + ".join(impurity[s.criterion].format(n=f"CAST({n} AS DOUBLE)", s=f"CAST({p} AS DOUBLE)") for n, p in (("l", "ls"), ("(a - l)", "(als - ls)")))
    u = _uniform_sql(str(s.seed), "tree", "id", "'row'")
    weight = " + ".join(f"CAST(u >= {p} AS BIGINT)" for p in T.POISSON_BELOW) if s.bootstrap else "1"
    if s.splitter == "random":
        drawn = f"lo + {_uniform_sql(str(s.seed), 'tree', 'path', 'f', chr(39) + 'cut' + chr(39))} * (hi - lo)"
        cut = f"SELECT * FROM (SELECT *, max(v) OVER own AS last FROM cum WHERE lo < hi AND v <= {drawn} WINDOW own AS (PARTITION BY tree, path, f)) q WHERE v = last"
    else:
        cut = "SELECT * FROM cum WHERE l < a"
    k = T._drawn(s, n_features)
    draw = _uniform_sql(str(s.seed), "tree", "path", "f", "'draw'")
    deeper = f"AND max(depth) < {s.max_depth}" if s.max_depth is not None else ""
    return f"""WITH RECURSIVE {rows},
start AS (SELECT CAST(t.range AS INTEGER) AS tree, id, y, {_uniform_sql(str(s.seed), "t.range", "id", "'row'") if s.bootstrap else "0"} AS u FROM base, range({s.n_trees}) t),
s AS (
  SELECT tree, '' AS path, id, {weight} AS w, y, 0 AS depth, CAST(NULL AS INTEGER) AS pf, CAST(NULL AS DOUBLE) AS pt FROM start WHERE {weight} > 0
  UNION ALL (
    WITH tot AS (SELECT tree, path FROM s GROUP BY tree, path HAVING min(y) < max(y) AND sum(w) >= {s.min_samples_split} {deeper}),
    h AS (SELECT s.tree, s.path, e.f, e.v, sum(w) AS n, sum(w * y) AS p FROM s JOIN tot USING (tree, path) JOIN e ON e.id = s.id GROUP BY ALL),
    cum AS (SELECT tree, path, f, v, sum(n) OVER up AS l, sum(p) OVER up AS ls, sum(n) OVER own AS a, sum(p) OVER own AS als, min(v) OVER own AS lo, max(v) OVER own AS hi
            FROM h WINDOW own AS (PARTITION BY tree, path, f), up AS (PARTITION BY tree, path, f ORDER BY v ROWS UNBOUNDED PRECEDING)),
    cut AS ({cut}),
    ranked AS (SELECT *, dense_rank() OVER (PARTITION BY tree, path ORDER BY {draw}, f) AS r FROM cut),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, path ORDER BY round({after}, 9), f, v) AS k
                            FROM ranked WHERE r <= {k}) q WHERE k = 1)
    SELECT s.tree, s.path || CASE WHEN e.v <= b.v THEN '0' ELSE '1' END, s.id, s.w, s.y, s.depth + 1, CAST(b.f AS INTEGER), g.threshold
    FROM s JOIN best b USING (tree, path) JOIN e ON e.id = s.id AND e.f = b.f JOIN halves g ON g.f = b.f AND g.v = b.v)),
child AS (SELECT DISTINCT tree, left(path, length(path) - 1) AS path, pf, pt FROM s WHERE depth > 0),
node AS (SELECT tree, path, any_value(depth) AS depth, sum(w) AS n, sum(w * y) AS p FROM s GROUP BY tree, path)"""


NODES_SQL = """
SELECT n.tree, n.path, CAST(n.depth AS INTEGER) AS depth, CAST(n.n AS BIGINT) AS n, CAST(n.p AS BIGINT) AS positive, c.pf AS feature, c.pt AS threshold
FROM node n LEFT JOIN child c ON c.tree = n.tree AND c.path = n.path"""

LEAVES_SQL = """,
leaf AS (SELECT tree, path, CAST(p AS DOUBLE) / n AS share FROM node ANTI JOIN child USING (tree, path))"""


def _nodes(t, settings: T.TreeSettings) -> DataFrame:
    nodes = T.grow(reuse(vectors(returned(t)), "returned"), settings)
    return nodes.select("tree", "path", "depth", "n", F.col("s").cast("long").alias("positive"), "feature", "threshold")


FOREST = T.TreeSettings(n_trees=3, max_depth=5, min_samples_split=10, max_features="sqrt", bootstrap=True)
RANDOM = T.TreeSettings(n_trees=3, max_depth=5, min_samples_split=10, max_features="sqrt", criterion="entropy", splitter="random", seed=7)
DEEP = T.TreeSettings(max_depth=50, min_samples_split=50, splitter="random", max_features=1, seed=3)
TREE = T.TreeSettings(max_depth=8, min_samples_split=50)


@register("tree_forest_nodes", grow_sql(FOREST) + NODES_SQL)
def q_tree_forest_nodes(t):
    """Bootstrapped trees with the best cut of features drawn in each node."""
    return _nodes(t, FOREST)


@register("tree_random_cuts", grow_sql(RANDOM) + NODES_SQL)
def q_tree_random_cuts(t):
    """Extremely randomised trees: one random threshold for each drawn feature."""
    return _nodes(t, RANDOM)


@register("tree_depth_50", grow_sql(DEEP) + NODES_SQL)
def q_tree_depth_50(t):
    """A totally random tree with a depth limit of 50."""
    return _nodes(t, DEEP)


@register("tree_scores_raw_units", grow_sql(TREE) + LEAVES_SQL + """
SELECT s.id, round(share, 9) AS score FROM s JOIN leaf USING (tree, path)""")
def q_tree_scores_raw_units(t):
    """A tree grown on min-max scaled features, its thresholds mapped back, scores the raw rows."""
    rows = reuse(returned(t), "returned")
    ranges = P.fit_minmax(rows, NAMES)
    nodes = T.grow(vectors(P.apply_minmax(rows, ranges)), TREE)
    scales = t.spark.createDataFrame([(i, c, *map(float, ranges[c])) for i, c in enumerate(NAMES)], "feature int, name string, low double, high double")
    raw = rows.withColumn("x", F.create_map(*[p for c in NAMES for p in (F.lit(c), F.col(c))]))
    scored = T.forest_scores(raw, T.in_raw_units(nodes, scales), ["id"], feature="name")
    return scored.select("id", F.round("score", 9).alias("score"))


# ------------------------------------------------------------ boosted stumps

ROUNDS = 5


def boost_sql(real: bool) -> str:
    """``s``: each row's log weight and vote after every round, the stump of a round found from the weights before it."""
    share = "CASE WHEN e.v <= b.v THEN pl ELSE pr END"
    half_odds = f"0.5 * (ln(greatest({share}, {B.EPS})) - ln(greatest(1 - ({share}), {B.EPS})))"
    if real:
        alpha, vote, change = "1.0", half_odds, f"- (2 * s.y - 1) * {half_odds}"
    else:
        alpha = "ln((1 - err) / err)"
        vote = f"CASE WHEN {share} > 0.5 THEN {alpha} ELSE -({alpha}) END"
        change = f"+ CASE WHEN ({share} > 0.5) = (s.y = 1) THEN 0 ELSE {alpha} END"
    return f"""WITH RECURSIVE {ROWS_SQL},
s AS (
  SELECT 0 AS k, id, y, CAST(0 AS DOUBLE) AS lw, CAST(0 AS DOUBLE) AS vote, CAST(0 AS DOUBLE) AS total FROM base
  UNION ALL (
    WITH tot AS (SELECT sum(exp(lw) * (1 - y)) AS t0, sum(exp(lw) * y) AS t1 FROM s WHERE k < {ROUNDS}),
    h AS (SELECT e.f, e.v, sum(exp(lw) * (1 - y)) AS w0, sum(exp(lw) * y) AS w1 FROM s JOIN e ON e.id = s.id WHERE k < {ROUNDS} GROUP BY e.f, e.v),
    cum AS (SELECT f, v, sum(w0) OVER up / (t0 + t1) AS l0, sum(w1) OVER up / (t0 + t1) AS l1, t0 / (t0 + t1) AS t0, t1 / (t0 + t1) AS t1,
                   lead(v) OVER (PARTITION BY f ORDER BY v) AS nv
            FROM h, tot WINDOW up AS (PARTITION BY f ORDER BY v ROWS UNBOUNDED PRECEDING)),
    cut AS (SELECT f, v, l0, l1, t0 - l0 AS r0, t1 - l1 AS r1 FROM cum WHERE nv IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (ORDER BY round(2 * l0 * l1 / (l0 + l1) + 2 * r0 * r1 / (r0 + r1), 10), f, v) AS place FROM cut),
    best AS (SELECT f, v, l1 / (l0 + l1) AS pl, r1 / (r0 + r1) AS pr,
                    CASE WHEN l1 > l0 THEN l0 ELSE l1 END + CASE WHEN r1 > r0 THEN r0 ELSE r1 END AS err FROM ranked WHERE place = 1)
    SELECT s.k + 1, s.id, s.y, s.lw {change}, s.vote + {vote}, s.total + {alpha}
    FROM s, best b, e WHERE s.k < {ROUNDS} AND e.id = s.id AND e.f = b.f))
SELECT id, round(1 / (1 + exp(-2 * vote / total)), 6) AS score FROM s WHERE k = {ROUNDS}"""


def _boosted(t, algorithm: str) -> DataFrame:
    rows = reuse(vectors(returned(t)), "returned")
    stumps = B.fit_adaboost(rows, ROUNDS, algorithm)
    return B.boosted_stump_scores(rows, stumps, algorithm, ["id"]).select("id", F.round("score", 6).alias("score"))


@register("adaboost_scores", boost_sql(False))
def q_adaboost_scores(t):
    """Five rounds of SAMME."""
    return _boosted(t, "SAMME")


@register("adaboost_real_scores", boost_sql(True))
def q_adaboost_real_scores(t):
    """Five rounds of SAMME.R."""
    return _boosted(t, "SAMME.R")


# ------------------------------------------------------------ naive Bayes

BAYES_ALPHA = (0.01, 0.1, 1.0, 10.0)


@register("naive_bayes_scores", f"""WITH {ROWS_SQL},
sums AS (SELECT f, sum(CASE WHEN y = 0 THEN v ELSE 0 END) AS s0, sum(CASE WHEN y = 1 THEN v ELSE 0 END) AS s1 FROM e JOIN base USING (id) GROUP BY f),
every AS (SELECT sum(s0) AS t0, sum(s1) AS t1 FROM sums),
prior AS (SELECT ln(CAST(sum(y) AS DOUBLE) / sum(1 - y)) AS p FROM base),
alphas(a) AS (VALUES {", ".join(f"({a})" for a in BAYES_ALPHA)}), priors(fit_prior) AS (VALUES (true), (false)),
odds AS (SELECT f, CAST(a AS DOUBLE) AS alpha, ln((s1 + a) / (t1 + a * 7)) - ln((s0 + a) / (t0 + a * 7)) AS o FROM sums, every, alphas),
margin AS (SELECT id, alpha, sum(v * o) AS m FROM e JOIN odds USING (f) GROUP BY id, alpha)
SELECT id, alpha, fit_prior, round(1 / (1 + exp(-(m + CASE WHEN fit_prior THEN p ELSE 0 END))), 6) AS score FROM margin, prior, priors""")
def q_naive_bayes_scores(t):
    """All smoothing constants with and without a fitted prior, from one count."""
    rows = reuse(vectors(returned(t)), "returned")
    counts, rows_of = N.fit_counts(rows)
    odds = N.log_odds(counts, rows_of, [(a, p) for a in BAYES_ALPHA for p in (True, False)], len(NAMES))
    return N.bayes_scores(rows, odds, ["id"]).select("id", "alpha", "fit_prior", F.round("score", 6).alias("score"))
