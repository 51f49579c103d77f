"""Classifier families, parameter grids, fitting and scoring on MLlib.

Estimators are MLlib's; the reference's scikit-learn parameter names are
mapped onto them (objectives differ in places -- documented per family, never
claimed equal).  Scores come out as one long DataFrame
``(fold, model, parameters, id, label, score)`` so every metric is a grouped
job over all fits at once.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reuse, scratch_table_path
from . import bayes as N
from . import boosting as B
from . import linear as L
from . import trees as T

MAX_DEPTH = 30  # MLlib's limit; deeper trees, bagged ones and random thresholds are grown by operators.trees
SEED = 0

# The parameter grids (test / small / large) of the ten
# classifier families, with scikit-learn parameter names.
GRIDS = {
    "large": {
        "RF": {"n_estimators": [1, 10, 100, 1000, 10000], "max_depth": [1, 5, 10, 20, 50, 100],
               "max_features": ["sqrt", "log2"], "min_samples_split": [2, 5, 10, 50, 100], "n_jobs": [-1],
               "random_state": [SEED]},
        "ET": {"n_estimators": [1, 10, 100, 1000, 10000], "criterion": ["gini", "entropy"],
               "max_depth": [1, 5, 10, 20, 50, 100], "max_features": ["sqrt", "log2"],
               "min_samples_split": [2, 5, 10, 50, 100], "n_jobs": [-1], "random_state": [SEED]},
        "AB": {"algorithm": ["SAMME", "SAMME.R"], "n_estimators": [1, 10, 100, 1000, 10000], "random_state": [SEED]},
        "GB": {"n_estimators": [1, 10, 100, 1000, 10000], "learning_rate": [0.001, 0.01, 0.05, 0.1, 0.5],
               "subsample": [0.1, 0.5, 1.0], "max_depth": [1, 5, 10, 20, 50, 100], "random_state": [SEED]},
        "KNN": {"n_neighbors": [1, 5, 10, 25, 50, 100], "weights": ["uniform", "distance"],
                "algorithm": ["auto", "ball_tree", "kd_tree"]},
        "DT": {"criterion": ["gini", "entropy"], "max_depth": [1, 5, 10, 20, 50, 100],
               "min_samples_split": [2, 5, 10, 50, 100], "random_state": [SEED]},
        "SVM": {"C": [0.00001, 0.0001, 0.001, 0.01, 0.1, 1, 10], "random_state": [SEED]},
        "LR": {"penalty": ["l1", "l2"], "C": [0.00001, 0.0001, 0.001, 0.01, 0.1, 1, 10], "random_state": [SEED]},
        "BAG": {"n_estimators": [1, 10, 100, 1000, 10000], "n_jobs": [-1], "random_state": [SEED]},
        "NB": {"alpha": [0.00001, 0.0001, 0.001, 0.01, 0.1, 1, 10], "fit_prior": [True, False]},
    },
    "small": {
        "RF": {"n_estimators": [10, 100, 1000], "max_depth": [1, 5, 10, 20], "max_features": ["sqrt", "log2"],
               "min_samples_split": [2, 10, 50], "n_jobs": [-1], "random_state": [SEED]},
        "ET": {"n_estimators": [10, 100, 1000], "criterion": ["gini", "entropy"], "max_depth": [1, 5, 10, 20],
               "max_features": ["sqrt", "log2"], "min_samples_split": [2, 10, 50], "n_jobs": [-1],
               "random_state": [SEED]},
        "AB": {"algorithm": ["SAMME", "SAMME.R"], "n_estimators": [10, 100], "random_state": [SEED]},
        "GB": {"n_estimators": [10, 100], "learning_rate": [0.1], "subsample": [0.5], "max_depth": [5, 10],
               "random_state": [SEED]},
        "KNN": {"n_neighbors": [10, 25], "weights": ["uniform", "distance"], "algorithm": ["auto"]},
        "DT": {"criterion": ["gini", "entropy"], "max_depth": [1, 5, 10, 20], "min_samples_split": [2, 10, 50],
               "random_state": [SEED]},
        "SVM": {"C": [0.01, 0.1, 1, 10], "random_state": [SEED]},
        "LR": {"penalty": ["l1", "l2"], "C": [0.01, 0.1, 1, 10], "random_state": [SEED]},
        "BAG": {"n_estimators": [10, 100], "n_jobs": [None], "random_state": [SEED]},
        "NB": {"alpha": [0.01, 0.1, 1, 10], "fit_prior": [True, False]},
    },
    "test": {
        "RF": {"n_estimators": [1], "max_depth": [5], "max_features": ["sqrt"], "min_samples_split": [10],
               "n_jobs": [-1], "random_state": [SEED]},
        "ET": {"n_estimators": [1], "criterion": ["gini"], "max_depth": [5], "max_features": ["sqrt"],
               "min_samples_split": [10], "n_jobs": [-1], "random_state": [SEED]},
        "AB": {"algorithm": ["SAMME.R"], "n_estimators": [5], "random_state": [SEED]},
        "GB": {"n_estimators": [1], "learning_rate": [0.1], "subsample": [0.5], "max_depth": [5],
               "random_state": [SEED]},
        "KNN": {"n_neighbors": [1], "weights": ["uniform"], "algorithm": ["auto"]},
        "DT": {"criterion": ["gini"], "max_depth": [5], "min_samples_split": [10], "random_state": [SEED]},
        "SVM": {"C": [10], "random_state": [SEED]},
        "LR": {"penalty": ["l1"], "C": [10], "random_state": [SEED]},
        "BAG": {"n_estimators": [1], "n_jobs": [-1], "random_state": [SEED]},
        "NB": {"alpha": [1], "fit_prior": [True]},
    },
}
DEFAULT_MODELS = ("LR", "RF", "GB", "DT")


def parameter_grid(spec: dict[str, list]) -> list[dict]:
    """Cartesian product of a parameter spec, keys in sorted order."""
    keys = sorted(spec)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[spec[k] for k in keys])]


def effective_points(spec: dict[str, list]) -> list[dict]:
    """The parameter points to fit: ``algorithm`` of k-NN only names a way to the same neighbours, so such points are one."""
    points = parameter_grid(spec)
    if "n_neighbors" in spec:
        points = [p | {"algorithm": "auto"} for p in points]
    return list({params_key(p): p for p in points}.values())


def params_key(params: dict) -> str:
    """Stable text form of a parameter point (sorted JSON)."""
    return json.dumps(params, sort_keys=True, default=str)


# ------------------------------------------------------------ estimators


def _min_instances(min_samples_split) -> int:
    return max(1, math.ceil(int(min_samples_split) / 2))


def make_estimator(name: str, params: dict, n_train: int, features: str = "features", label: str = "label"):
    """MLlib estimator for a family name and scikit-learn style parameters."""
    p = params
    seed = int(p.get("random_state", SEED) or SEED)
    if name == "RF":
        return RandomForestClassifier(
            featuresCol=features, labelCol=label, seed=seed, numTrees=int(p.get("n_estimators", 10)),
            maxDepth=int(p.get("max_depth", 5)),
            featureSubsetStrategy=p.get("max_features", "sqrt"), minInstancesPerNode=_min_instances(p.get("min_samples_split", 2)),
            impurity=p.get("criterion", "gini"))
    if name == "GB":
        return GBTClassifier(featuresCol=features, labelCol=label, seed=seed, maxIter=int(p.get("n_estimators", 10)),
                             stepSize=float(p.get("learning_rate", 0.1)),
                             subsamplingRate=float(p.get("subsample", 1.0)), maxDepth=int(p.get("max_depth", 3)))
    if name == "DT":
        kw = dict(featuresCol=features, labelCol=label, seed=seed, maxDepth=int(p.get("max_depth", 5)),
                  impurity=p.get("criterion", "gini"),
                  minInstancesPerNode=_min_instances(p.get("min_samples_split", 2)))
        return DecisionTreeClassifier(**kw)
    raise ValueError(f"no single MLlib estimator for {name}")


def positive_score() -> F.Column:
    """Score of the positive class: probability[1]."""
    return vector_to_array("probability")[1]


# ------------------------------------------------------------ k nearest neighbours

QUERY_CHUNK = 512
#: Train rows whose products with a chunk of queries are held at a time.
TILE_ROWS = 1024
#: Partitions that pairs of blocks are dealt to at most.
PAIR_PARTITIONS = 2000


def nearest_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query row (ties to the smaller id): query position, row position and exact distance.

    Single-precision products of a chunk of queries and a tile of rows
    preselect what may be among the k within their rounding error; only those
    distances are computed, in double precision from differences.  Rows and
    queries with values that aren't finite have no distance.
    """
    rows, asked = np.flatnonzero(np.isfinite(x).all(1)), np.flatnonzero(np.isfinite(q).all(1))
    k = min(k, len(rows))
    if not k or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # a power of two brings all values to 1 at most
    top = max(np.abs(x[rows]).max(initial=0.0), np.abs(q[asked]).max(initial=0.0))
    scale = -np.frexp(top)[1]
    size = (np.ldexp(x[rows], scale) ** 2).sum(1)
    scaled = np.concatenate([np.ldexp(x[rows], scale), size[:, None]], axis=1).astype(np.float32)
    error = (q.shape[1] + 8) * 1.1 * 2.0 ** -24
    group = max(1, min(32, TILE_ROWS // (4 * k)))
    found = []
    for at in range(0, len(asked), QUERY_CHUNK):
        some = asked[at:at + QUERY_CHUNK]
        part = np.ldexp(q[some], scale)
        slack = (2 * error * ((part * part).sum(1) + 2 * size.max()) + 1e-36).astype(np.float32)
        part = np.concatenate([-2 * part, np.ones((len(part), 1))], axis=1).astype(np.float32)
        # the k least values of different groups of rows: no more than the k-th least value is beyond them
        least = np.full((len(part), k), np.inf, np.float32)
        near = []
        for first in range(0, len(scaled), TILE_ROWS):
            tile = scaled[first:first + TILE_ROWS]
            value = part @ tile.T
            whole = len(tile) - len(tile) % group
            if k == 1:
                least = np.minimum(least, value.min(1, keepdims=True))
            else:
                low = [least, value[:, :whole].reshape(len(part), group, -1).min(1), value[:, whole:]]
                least = np.partition(np.concatenate(low, axis=1), k - 1, axis=1)[:, :k]
            hit = np.flatnonzero(value <= (least.max(1) + slack)[:, None])
            near.append((hit // len(tile), hit % len(tile) + first, value.ravel()[hit]))
        asks, at_row, value = (np.concatenate(c) for c in zip(*near, strict=True))
        keep = value <= (least.max(1) + slack)[asks]
        asks, at_row = some[asks[keep]], rows[at_row[keep]]
        dist = np.empty(len(asks))
        for first in range(0, len(asks), TILE_ROWS):
            span = slice(first, first + TILE_ROWS)
            dist[span] = np.sqrt(((x[at_row[span]] - q[asks[span]]) ** 2).sum(1))
        order = np.lexsort((ids[at_row], dist, asks))
        asks = asks[order]
        best = np.arange(len(asks)) - np.searchsorted(asks, asks) < k
        found.append((asks[best], at_row[order][best], dist[order][best]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``nearest_rows`` query by query: its position, the rows' positions and their distances."""
    asks, rows, dist = nearest_rows(q, x, ids, k)
    starts = np.flatnonzero(np.diff(asks, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(asks)], strict=True):
        yield int(asks[a]), rows[a:b], dist[a:b]


def _matrices(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Columns of arrays, or of ML vectors as structs, as matrices of equal width; rows without vector hold no numbers."""
    parts = []
    for column in columns:
        vectors = pa.concat_arrays(column.chunks)
        values, sparse = vectors, np.zeros(len(vectors), bool)
        if pa.types.is_struct(vectors.type):
            fields = dict(zip([f.name for f in vectors.type], vectors.flatten(), strict=True))
            values, sparse = fields["values"], pc.equal(fields["type"], 0).fill_null(False).to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(values).to_numpy()
        sizes = pc.list_value_length(values).fill_null(0).to_numpy()
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if sparse.any():
            place[sparse[row]] = pc.list_flatten(fields["indices"]).to_numpy()
        parts.append((len(vectors), row, place, pc.list_flatten(values).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)))
    width = max(place.max(initial=-1) for _, _, place, _, _ in parts) + 1
    out = []
    for n, row, place, value, missing in parts:
        out.append(np.zeros((n, width)))
        out[-1][row, place] = value
        out[-1][missing] = np.nan
    return out


def knn_neighbours(train: DataFrame, test: DataFrame, k: int, block_rows: int = 20000) -> DataFrame:
    """``qid, nid, dist, nlabel`` of the k nearest train rows of each test row, by blocked brute force.

    ``test`` has ``qid, qv`` and ``train`` has ``nid, nv, nlabel``; vectors are
    arrays, or ML vectors unwrapped (sparse ones stay so on their way).  Rows
    are hashed into blocks of about ``block_rows``; each (test block, train
    block) pair is one cogroup that keeps k candidates a test row and holds one
    tile of distances at a time; there are more partitions than pairs, so few
    pairs share one.  A grouped top-k merges the candidates, so the result
    is exact and no pair is materialised as a row.
    """
    from pyspark.sql import Window

    # a task has one core: its products take one thread
    train.sparkSession.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    n_train, n_test = train.count(), test.count()
    rb = max(1, math.ceil(n_train / block_rows))
    tb = max(1, math.ceil(n_test / block_rows))
    q = (test.withColumn("tb", F.pmod(F.xxhash64("qid"), F.lit(tb)).cast("int"))
         .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1)))))
    r = (train.withColumn("rb", F.pmod(F.xxhash64("nid"), F.lit(rb)).cast("int"))
         .withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(tb - 1)))))

    def nearest(qp: pa.Table, rp: pa.Table) -> pa.Table:
        names = ["qid", "nid", "dist", "nlabel"]
        if not qp.num_rows or not rp.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], names)
        qm, tm = _matrices(qp.column("qv"), rp.column("nv"))
        asks, rows, dist = nearest_rows(qm, tm, rp.column("nid").to_numpy(), k)
        return pa.table([qp.column("qid").take(pa.array(asks)), rp.column("nid").take(pa.array(rows)), pa.array(dist),
                         rp.column("nlabel").take(pa.array(rows))], names)

    parts = min(4 * rb * tb, PAIR_PARTITIONS)
    q, r = q.repartition(parts, "tb", "rb"), r.repartition(parts, "tb", "rb")
    cand = q.groupBy("tb", "rb").cogroup(r.groupBy("tb", "rb")).applyInArrow(nearest, "qid long, nid long, dist double, nlabel long")
    w = Window.partitionBy("qid").orderBy("dist", "nid")
    return cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _votes(top: DataFrame, weights: str) -> DataFrame:
    """Each neighbour's vote: 1, or 1 / distance; where some distance is 0, only those neighbours vote."""
    from pyspark.sql import Window

    if weights == "uniform":
        return top.withColumn("_w", F.lit(1.0))
    zero = F.min("dist").over(Window.partitionBy("qid")) == 0
    return top.withColumn("_w", F.when(zero, (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("dist"))))


def knn_predict(train: DataFrame, test: DataFrame, k: int, weights: str = "uniform", id_col: str = "id",
                vec: str = "embedding", label: str = "label", block_rows: int = 20000) -> DataFrame:
    """Exact k-NN vote: the label with the most votes, the smallest among equals."""
    from pyspark.sql import Window

    top = knn_neighbours(train.select(F.col(id_col).alias("nid"), F.col(vec).alias("nv"), F.col(label).cast("long").alias("nlabel")),
                         test.select(F.col(id_col).alias("qid"), F.col(vec).alias("qv")), k, block_rows)
    votes = _votes(top, weights).groupBy("qid", "nlabel").agg(F.sum("_w").alias("_v"))
    wv = Window.partitionBy("qid").orderBy(F.col("_v").desc(), F.col("nlabel").asc())
    return (votes.withColumn("_r", F.row_number().over(wv)).where(F.col("_r") == 1)
            .select(F.col("qid").alias(id_col), F.col("nlabel").cast("int").alias("predicted")))


def knn_score(train: DataFrame, test: DataFrame, params: dict, keep: Sequence[str], features: str = "features",
              label: str = "label") -> DataFrame:
    """Vote share of class 1 for every test row, as the other families score."""
    rows = reuse(test.withColumn("qid", F.monotonically_increasing_id()), "knn_test")
    known = reuse(train.select(F.monotonically_increasing_id().alias("nid"), F.unwrap_udt(features).alias("nv"),
                               F.col(label).cast("long").alias("nlabel")), "knn_train")
    top = knn_neighbours(known, rows.select("qid", F.unwrap_udt(features).alias("qv")), int(params.get("n_neighbors", 5)))
    share = _votes(top, params.get("weights", "uniform")).groupBy("qid").agg(
        (F.sum(F.col("_w") * (F.col("nlabel") == 1).cast("double")) / F.sum("_w")).alias("score"))
    return rows.join(share, "qid", "left").select(*keep, "score")


# ------------------------------------------------------------ trees as tables


def is_grown(name: str, params: dict) -> bool:
    """Whether a point is beyond MLlib: random thresholds, trees without a limit of depth, or depths over MLlib's."""
    return name in ("ET", "BAG") or name in ("RF", "DT", "GB") and int(params.get("max_depth") or 0) > MAX_DEPTH


def tree_settings(name: str, params: dict) -> T.TreeSettings:
    return T.TreeSettings(
        n_trees=1 if name == "DT" else int(params.get("n_estimators", 10)), max_depth=params.get("max_depth"),
        min_samples_split=int(params.get("min_samples_split", 2)), criterion=params.get("criterion", "gini"),
        splitter="random" if name == "ET" else "best", max_features=params.get("max_features", "sqrt") if name in ("RF", "ET") else "all",
        bootstrap=name in ("RF", "BAG"), seed=int(params.get("random_state") or SEED))


@dataclass
class GrownTrees:
    """A fitted model of ``operators.trees``."""

    nodes: DataFrame


def fit_grown(name: str, params: dict, train: DataFrame, test: DataFrame, keep: Sequence[str], features: str = "features",
              label: str = "label") -> tuple[DataFrame, GrownTrees]:
    """Trees grown as tables: scores of ``test`` and the nodes."""
    rows = reuse(train.select(F.monotonically_increasing_id().alias("_row"), label, T.entries(features).alias("x")), "grown_train")
    asked = reuse(test.select(F.monotonically_increasing_id().alias("_row"), *keep, T.entries(features).alias("x")), "grown_test")
    settings = tree_settings(name, params)
    if name == "GB":
        start, rounds = T.boost(rows, settings, settings.n_trees, float(params.get("learning_rate", 0.1)), float(params.get("subsample", 1.0)), "_row", label)
        scores = T.boosted_scores(asked, start, rounds, ["_row"])
        nodes = rounds[0]
        for m, more in enumerate(rounds[1:], 1):
            nodes = nodes.unionByName(more.withColumn("tree", F.lit(m)))
    else:
        nodes = reuse(T.grow_forest(rows, settings, "_row", label), "forest")
        return T.forest_scores(asked, nodes, keep).select(*keep, "score"), GrownTrees(nodes)
    return asked.join(scores, "_row").select(*keep, F.col("score").cast("double").alias("score")), GrownTrees(nodes)


# ------------------------------------------------------------ linear models


#: Largest entry of the mean objective's subgradient at a fit of LR or SVM.
LINEAR_TOLERANCE = 1e-8


@dataclass
class LinearFit:
    """A fitted LR or SVM: coefficients and intercept, and the certificate of ``operators.linear``."""

    coefficients: DenseVector
    intercept: float
    fitted: L.LinearModel


def fit_linear(name: str, params: dict, train: DataFrame, test: DataFrame, keep: Sequence[str], features: str = "features",
               label: str = "label") -> tuple[DataFrame, LinearFit]:
    """Logistic regression (LR) or the squared-hinge machine (SVM), the objectives of the parameters' own solvers, at their optimum."""
    n_features = vector_size(train, features)
    loss, penalty = ("logistic", params.get("penalty", "l1")) if name == "LR" else ("squared_hinge", "l2")
    point = L.Point(name, loss, penalty, float(params.get("C", 1e5 if name == "LR" else 1.0)))
    [model] = L.fit_rows(L.vector_rows(train, features, n_features, label), n_features, [point], LINEAR_TOLERANCE)
    scores = L.row_scores(L.vector_rows(test, features, n_features, None, keep), [model], keep).select(*keep, "score")
    return scores, LinearFit(DenseVector(model.coefficients[:-1]), float(model.coefficients[-1]), model)


# ------------------------------------------------------------ boosted stumps, naive Bayes


def vector_size(rows: DataFrame, features: str) -> int:
    """The length of a table's vectors, 0 without rows."""
    shape = F.unwrap_udt(F.col(features))
    found = rows.select(F.when(shape["type"] == 0, shape["size"]).otherwise(F.size(shape["values"])).alias("n")).first()
    return found["n"] if found else 0


@dataclass
class BayesModel:
    """Log likelihood of each feature in class 1."""

    theta: np.ndarray


def fit_long(name: str, params: dict, train: DataFrame, test: DataFrame, keep: Sequence[str], features: str, label: str) -> tuple[DataFrame, object]:
    """AdaBoost (AB) or naive Bayes (NB) from rows of entries: scores of ``test`` and the model."""
    rows = reuse(train.select(F.monotonically_increasing_id().alias("_row"), label, features, T.entries(features).alias("x")), "long_train")
    asked = test.select(*keep, T.entries(features).alias("x"))
    if name == "AB":
        algorithm = params.get("algorithm", "SAMME.R")
        stumps = B.fit_adaboost(rows, int(params.get("n_estimators", 50)), algorithm, "_row", label)
        return B.boosted_stump_scores(asked, stumps, algorithm, keep), stumps
    alpha, n_features = float(params.get("alpha", 1.0)), vector_size(rows, features)
    counts, rows_of = N.fit_counts(rows, label)
    odds = N.log_odds(counts, rows_of, [(alpha, bool(params.get("fit_prior", True)))], n_features)
    scores = N.bayes_scores(asked, odds, keep).select(*keep, "score")
    held = {r.feature: r.s1 for r in counts.collect()}  # a number per feature of the vocabulary
    theta = np.log((np.array([held.get(i, 0.0) for i in range(n_features)]) + alpha) / (held[-1] + alpha * n_features))
    return scores, BayesModel(theta)


# ------------------------------------------------------------ fitting and scoring


def fit_and_score(name: str, params: dict, train: DataFrame, test: DataFrame, keep: Sequence[str],
                  features: str = "features", label: str = "label", n_train: int | None = None,
                  nb_features: str | None = None) -> tuple[DataFrame, object]:
    """Fit one family at one parameter point; return test scores and model."""
    n_train = n_train if n_train is not None else train.count()
    if is_grown(name, params):
        return fit_grown(name, params, train, test, keep, features, label)
    if name in ("AB", "NB"):
        return fit_long(name, params, train, test, keep, (name == "NB" and nb_features) or features, label)
    if name == "KNN":
        return knn_score(train, test, params, keep, features, label), None
    if name in ("LR", "SVM"):
        return fit_linear(name, params, train, test, keep, features, label)
    est = make_estimator(name, params, n_train, features, label)
    model = est.fit(train)
    pred = model.transform(test)
    return pred.select(*keep, positive_score().cast("double").alias("score")), model


def tree_text(model) -> str | None:
    """Readable dump of a fitted tree or ensemble (the inspection the tree
    picture gave); None for non-tree models."""
    return getattr(model, "toDebugString", None)


def feature_importance(name: str, model, names: Sequence[str]) -> pd.DataFrame | None:
    """Coefficients (LR, SVM), class-1 log-likelihoods (NB) or impurity
    importances (trees; AB: of its stumps by their weight) of all features,
    sorted descending; None where no importance exists."""
    if name in ("BAG", "KNN"):
        return None
    if isinstance(model, GrownTrees):
        held = {r.feature: r.importance for r in T.importances(model.nodes).collect()}  # a number per feature
        vals = np.array([held.get(i, 0.0) for i in range(len(names))])
    elif name in ("LR", "SVM"):
        vals = model.coefficients.toArray()
    elif name == "NB":
        vals = model.theta
    elif name in ("RF", "GB", "DT"):
        vals = model.featureImportances.toArray()
    elif name == "AB" and model:
        vals = np.bincount([s.feature for s in model], [s.alpha for s in model], len(names)) / sum(s.alpha for s in model)
    else:
        return None
    df = pd.DataFrame({"feature": list(names), "importance": vals[: len(names)]})
    return df.sort_values("importance", ascending=False, kind="mergesort").reset_index(drop=True)


IMPORTANCE = "model string, parameters string, position int, feature string, importance double"


def importance_rows(name: str, params: dict, model, names: Sequence[str]) -> list[tuple]:
    """All importances of one fit as rows of ``IMPORTANCE``."""
    got = feature_importance(name, model, names)
    if got is None:
        return []
    return [(name, params_key(params), i + 1, r.feature, float(r.importance)) for i, r in enumerate(got.itertuples())]


def run_grid(train: DataFrame, test: DataFrame, models: Sequence[str], grid: dict, keep: Sequence[str],
             features: str = "features", label: str = "label", max_workers: int = 4,
             nb_features: str | None = None, importances: list | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Fit every (model, parameter point); all test scores with ``model`` and
    ``parameters`` columns.  Fits run from a small driver thread pool; each
    fit is itself distributed and appends its scores to one table, so the
    result is read from files and no plan unites the fits.  ``importances``
    is extended by each fit's rows (``names``: the features)."""
    n_train = train.count()
    jobs = [(m, p) for m in models for p in effective_points(grid[m])]
    path = scratch_table_path(train.sparkSession, "grid-scores")

    def one(job):
        k, (m, p) = job
        sc, model = fit_and_score(m, p, train, test, keep, features, label, n_train, nb_features)
        sc.select(F.lit(m).alias("model"), F.lit(params_key(p)).alias("parameters"), *keep,
                  F.col("score").cast("double").alias("score")).write.parquet(f"{path}/fit={k}")
        return importance_rows(m, p, model, names) if importances is not None else []

    with ThreadPoolExecutor(max_workers=max_workers) as ex:
        for rows in ex.map(one, enumerate(jobs)):
            if importances is not None:
                importances += rows
    return train.sparkSession.read.parquet(path).drop("fit")
