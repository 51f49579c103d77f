"""Linear models of many parameter points at once, with a certificate of each optimum.

The objective of a point is ``penalty(b) + C * sum of losses``, the intercept
being a feature with the value 1 that is penalised like the others.  A loss is
``logistic`` or ``squared_hinge``, a penalty ``l1`` (sum of absolute values) or
``l2`` (half the sum of squares).  Each point is minimised by Newton steps where
the curvature fits (for ``l1`` their quadratic model keeps the penalty), else
by L-BFGS, with orthant steps for ``l1``; whenever the points need values and gradients, one
job computes them for all coefficient vectors together, so the number of jobs
is that of the slowest point and not of all.

What passes through the driver are coefficients: points times features, and the
curvature of each point where that is small.  The
certificate is the largest entry of the (least) subgradient at the result; at
the optimum it is zero.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reuse

#: Rows whose products with all coefficient vectors are held at a time.
ROWS_TOGETHER = 4000
MEMORY = 12
#: Features, the intercept among them, up to which jobs sum the curvature too.
CURVED = 1024
#: Numbers of all points' curvatures up to which they are summed.
MOST_CURVATURE = 4_000_000
#: Features up to which the quadratic model of ``l1`` is minimised by coordinate descent.
FEW = 32
#: Values of dense rows held at a time.
DENSE_TOGETHER = 1_000_000
#: Bytes of a task's sums beyond which they are summed in tasks once more.
SUMMED_BY_DRIVER = 1 << 20


@dataclass(frozen=True)
class Point:
    """One model: ``name`` for the results, its loss, penalty and ``C``."""

    name: str
    loss: str
    penalty: str
    c: float

    def __post_init__(self) -> None:
        if self.loss not in ("logistic", "squared_hinge") or self.penalty not in ("l1", "l2") or self.c <= 0:
            raise ValueError(f"not a linear model: {self}")


@dataclass
class LinearModel:
    """Coefficients, the intercept last, of a point; ``violation`` is the certificate."""

    point: Point
    coefficients: np.ndarray
    objective: float
    violation: float
    evaluations: int


def sparse_rows(rows: DataFrame, n_features: int, label: str | None = "label", values: str = "x", keep: Sequence[str] = ()) -> DataFrame:
    """``at, value`` of each row's entries, the intercept's among them, and its label as ``y``."""
    columns = [F.array_append(F.map_keys(values), F.lit(n_features)).alias("at"), F.array_append(F.map_values(values), F.lit(1.0)).alias("value")]
    return rows.select(*keep, *columns, *([F.col(label).cast("double").alias("y")] if label else []))


def vector_rows(rows: DataFrame, features: str, n_features: int, label: str | None = "label", keep: Sequence[str] = ()) -> DataFrame:
    """``sparse_rows`` of a column of ML vectors."""
    v = F.unwrap_udt(F.col(features))
    at = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    columns = [F.array_append(at, F.lit(n_features)).alias("at"), F.array_append(v["values"], F.lit(1.0)).alias("value")]
    return rows.select(*keep, *columns, *([F.col(label).cast("double").alias("y")] if label else []))


#: An entry of a packed row.
ENTRY = np.dtype([("at", "<i4"), ("value", "<f8")])


def packed_rows(data: DataFrame) -> DataFrame:
    """``sparse_rows`` with each row's entries as bytes, ``x``, which every pass reads as they are."""

    @F.arrow_udf("binary")
    def packed(at: pa.Array, value: pa.Array) -> pa.Array:
        ends = np.asarray(at.offsets).astype(np.int64)
        cells = np.empty(ends[-1] - ends[0], ENTRY)
        cells["at"], cells["value"] = at.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(((ends - ends[0]) * ENTRY.itemsize).astype(np.int32)), pa.py_buffer(cells)])

    return data.select(packed("at", "value").alias("x"), "y")


def _entries(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each packed row begins, and the feature and value of each entry."""
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1].astype(np.int64)
    cells = np.frombuffer(x.buffers()[2], ENTRY, (ends[-1] - ends[0]) // ENTRY.itemsize, ends[0])
    return (ends - ends[0]) // ENTRY.itemsize, cells["at"], cells["value"]


def _margins(ends: np.ndarray, at: np.ndarray, value: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.add.reduceat(vectors[:, at] * value, ends[:-1], axis=1)  # every row has at least the intercept


def _loss(name: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative at signed margins."""
    if name == "logistic":
        return np.logaddexp(0, -z), -np.exp(-np.logaddexp(0, z))
    gap = np.maximum(0, 1 - z)
    return gap * gap, -2 * gap


def _dense_sums(ends: np.ndarray, at: np.ndarray, value: np.ndarray, sign: np.ndarray, losses: Sequence[str],
                vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Losses, gradients and curvatures of some rows."""
    x = np.zeros((len(sign), vectors.shape[1]))
    x[np.repeat(np.arange(len(sign)), np.diff(ends)), at] = value
    z = vectors @ x.T * sign
    total, slope, curve = np.zeros(len(z)), np.zeros(vectors.shape), np.zeros((*vectors.shape, vectors.shape[1]))
    for k, name in enumerate(losses):
        if name == "logistic":
            t = np.exp(-np.abs(z[k]))
            loss, d, w = np.log1p(t) + np.maximum(-z[k], 0), -np.where(z[k] >= 0, t, 1.0) / (1 + t), t / (1 + t) ** 2
        else:
            loss, d = _loss(name, z[k])
            w = np.where(z[k] < 1, 2.0, 0.0)
        part = x * np.sqrt(w)[:, None]
        total[k], slope[k], curve[k] = loss.sum(), x.T @ (sign * d), part.T @ part
    return total, slope, curve


def evaluate(data: DataFrame, points: Sequence[Point], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sum of losses, its gradient and (up to ``CURVED`` features) its curvature of every point at its vector, in one pass.

    ``data`` are ``packed_rows``.  A task gives one row, its sums.
    """
    losses, dim = [p.loss for p in points], vectors.shape[1]
    curved = dim <= CURVED and len(points) * dim * dim <= MOST_CURVATURE
    width = 1 + dim + dim * dim if curved else 1 + dim
    together = max(1, min(ROWS_TOGETHER, DENSE_TOGETHER // dim)) if curved else ROWS_TOGETHER

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(losses), width))
        for batch in batches:
            for start in range(0, batch.num_rows, together):
                part = batch.slice(start, together)
                ends, at, value = _entries(part.column("x"))
                sign = 2 * part.column("y").to_numpy() - 1
                if curved:
                    loss, first, second = _dense_sums(ends, at, value, sign, losses, vectors)
                    sums[:, 0] += loss
                    sums[:, 1:1 + dim] += first
                    sums[:, 1 + dim:] += second.reshape(len(losses), -1)
                    continue
                margin, row = _margins(ends, at, value, vectors), np.repeat(np.arange(len(sign)), np.diff(ends))
                for k, name in enumerate(losses):
                    loss, d = _loss(name, sign * margin[k])
                    sums[k, 0] += loss.sum()
                    sums[k, 1:] += np.bincount(at, value * (sign * d)[row], minlength=dim)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(losses) * width)
        for batch in batches:
            for v in batch.column("v"):
                sums += np.frombuffer(v.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["v"])

    found = data.select("x", "y").mapInArrow(work, "v binary")
    if len(losses) * width * 8 > SUMMED_BY_DRIVER:
        found = found.repartition(8).mapInArrow(add, "v binary")
    sums = np.zeros((len(losses), width))
    for r in found.collect():  # a row a task
        sums += np.frombuffer(r.v).reshape(sums.shape)
    return sums[:, 0], sums[:, 1:1 + dim], sums[:, 1 + dim:].reshape(len(points), dim, dim) if curved else None


def _subgradient(x: np.ndarray, g: np.ndarray, weight: float, l1: bool) -> np.ndarray:
    """The least subgradient of ``loss + weight * penalty`` where the loss has the gradient ``g``."""
    if not l1:
        return g + weight * x
    zero = np.where(g + weight < 0, g + weight, np.where(g - weight > 0, g - weight, 0.0))
    return np.where(x > 0, g + weight, np.where(x < 0, g - weight, zero))


def _sign_step(x: np.ndarray, g: np.ndarray, h: np.ndarray, weight: float) -> np.ndarray:
    """The step to the minimum of the quadratic model plus the l1 penalty, by sets of signs: each set's minimum is a linear system."""
    c, at, sign = g - h @ x, x.copy(), np.sign(x)
    value = lambda z: c @ z + 0.5 * (z @ (h @ z)) + weight * np.abs(z).sum()
    small = 1e-9 * weight
    for _ in range(20 * len(x)):
        held = np.flatnonzero(sign)
        if len(held):
            best = np.zeros(len(x))
            best[held] = np.linalg.solve(h[np.ix_(held, held)], -(c[held] + weight * sign[held]))
            if (best[held] * sign[held] < 0).any():
                # up to the first of the places where a sign changes that is the least on the way
                move = best - at
                with np.errstate(divide="ignore", invalid="ignore"):
                    stops = np.where(move != 0, -at / move, np.inf)
                stops = np.append(np.unique(stops[(stops > 0) & (stops < 1)]), 1.0)
                stop = min(stops, key=lambda t: value(at + t * move))
                crossed = (at != 0) & (move != 0) & (np.abs(at + stop * move) <= 1e-12 * np.abs(at))
                new = at + stop * move
                new[crossed] = 0.0
                if value(new) >= value(at) and not crossed.any():
                    break
                at, sign = new, np.sign(new)
                continue
            at = best
        slope = c + h @ at
        off = np.where(sign == 0, np.abs(slope) - weight, -np.inf)
        j = int(off.argmax())
        if off[j] <= small:
            break
        sign[j] = -np.sign(slope[j])
    step = at - x
    step[at == 0] = -x[at == 0]  # exactly zero afterwards
    return step


def _newton_step(x: np.ndarray, g: np.ndarray, h: np.ndarray, weight: float, l1: bool) -> np.ndarray:
    """The step to the minimum of the quadratic model plus the penalty; for l1 of few features by coordinate descent."""
    ridge = 1e-13 * max(np.trace(h), 1e-300)
    if not l1:
        return -np.linalg.solve(h + (weight + ridge) * np.eye(len(x)), g + weight * x)
    if len(x) > FEW:
        return _sign_step(x, g, h + 1e3 * ridge * np.eye(len(x)), weight)
    step, curve, slope = np.zeros(len(x)), np.diag(h) + ridge, g.copy()  # slope: of the model at the step
    for _ in range(2000):
        largest = 0.0
        for j in range(len(x)):
            at = x[j] + step[j]
            new = at - slope[j] / curve[j]
            new = np.sign(new) * max(abs(new) - weight / curve[j], 0.0)
            if new != at:
                slope += h[:, j] * (new - at)
                step[j] += new - at
                largest = max(largest, abs(new - at) * curve[j])
        if largest <= 1e-14:
            break
    at = x + step
    step[at == 0] = -x[at == 0]  # exactly zero afterwards
    return step


def _minimise(dim: int, weight: float, l1: bool, tolerance: float, most: int) -> Generator:
    """Yields points and is sent (loss, gradient, curvature or None); returns the minimum of ``loss + weight * penalty``."""
    x = np.zeros(dim)
    penalty = (lambda v: weight * np.abs(v).sum()) if l1 else (lambda v: 0.5 * weight * (v @ v))
    loss, g, h = yield x
    newton = h is not None
    value, pg = loss + penalty(x), _subgradient(x, g, weight, l1)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(most):
        if np.abs(pg).max() <= tolerance:
            break
        if newton:
            q = _newton_step(x, g, h, weight, l1)
            falls = g @ q + penalty(x + q) - penalty(x)
            length = 1.0
            for _ in range(40):
                new = x + length * q
                new_loss, new_g, new_h = yield new
                new_value = new_loss + penalty(new)
                new_pg = _subgradient(new, new_g, weight, l1)
                # so near the minimum that values can't tell, the subgradient does
                if new_value <= value + 1e-4 * length * falls or (new_value <= value + 1e-13 * abs(value) and np.abs(new_pg).max() < np.abs(pg).max()):
                    break
                length /= 2
            else:
                newton = False
                continue
            x, g, h, value, pg = new, new_g, new_h, new_value, new_pg
            continue
        q, kept = -pg.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append((a, s, y))
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(q).max())
        for a, s, y in reversed(kept):
            q += s * (a - (y @ q) / (s @ y))
        if l1:
            q[q * pg >= 0] = 0.0  # no step against the subgradient
        if q @ pg >= 0:
            q, steps = -pg, []
        side = np.where(x != 0, np.sign(x), -np.sign(pg))
        length = 1.0
        for _ in range(40):
            new = x + length * q
            if l1:
                new[new * side < 0] = 0.0  # stay in the orthant
            new_loss, new_g, _ = yield new
            new_value = new_loss + penalty(new)
            if new_value <= value + 1e-4 * (pg @ (new - x)) + 1e-15 * abs(value):
                break
            length /= 2
        else:
            break
        smooth = new_g - g if l1 else new_g - g + weight * (new - x)
        if (new - x) @ smooth > 1e-300:
            steps = [*steps[1 - MEMORY:], (new - x, smooth)]
        x, g, value = new, new_g, new_value
        pg = _subgradient(x, g, weight, l1)
    return x, value, float(np.abs(pg).max())


def fit_linear(rows: DataFrame, n_features: int, points: Sequence[Point], label: str = "label", values: str = "x",
               tolerance: float = 1e-9, most: int = 300) -> list[LinearModel]:
    """All points fitted together; ``rows`` has a map from feature (0 to ``n_features - 1``) to value."""
    return fit_rows(sparse_rows(rows, n_features, label, values), n_features, points, tolerance, most)


def fit_rows(rows: DataFrame, n_features: int, points: Sequence[Point], tolerance: float = 1e-9, most: int = 300) -> list[LinearModel]:
    """All points fitted together to ``sparse_rows`` or ``vector_rows``.

    The objective is worked on as a mean (divided by ``C`` times the rows), and
    so are ``tolerance`` and the certificate.
    """
    # a task has one core: its products take one thread
    rows.sparkSession.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    data = reuse(packed_rows(rows.where(F.col("y").isNotNull())), "linear_rows")
    n = max(1, data.count())
    solvers = [_minimise(n_features + 1, 1 / (p.c * n), p.penalty == "l1", tolerance, most) for p in points]
    asked = {k: next(s) for k, s in enumerate(solvers)}
    evaluations, done = [0] * len(points), {}
    while asked:
        order = sorted(asked)
        total, slope, curve = evaluate(data, [points[k] for k in order], np.array([asked[k] for k in order]))
        for i, k in enumerate(order):
            evaluations[k] += 1
            try:
                asked[k] = solvers[k].send((total[i] / n, slope[i] / n, None if curve is None else curve[i] / n))
            except StopIteration as end:
                done[k] = end.value
                del asked[k]
    return [LinearModel(p, done[k][0], done[k][1] * p.c * n, done[k][2], evaluations[k]) for k, p in enumerate(points)]


def certificate(rows: DataFrame, n_features: int, points: Sequence[Point], vectors: np.ndarray, label: str = "label", values: str = "x") -> np.ndarray:
    """The largest entry of the least subgradient of each point's mean objective at any coefficients, by one aggregate."""
    data = packed_rows(sparse_rows(rows, n_features, label, values))
    n = max(1, data.count())
    _, slope, _ = evaluate(data, points, vectors)
    return np.array([np.abs(_subgradient(v, g / n, 1 / (p.c * n), p.penalty == "l1")).max() for p, v, g in zip(points, vectors, slope, strict=True)])


def linear_scores(rows: DataFrame, n_features: int, models: Sequence[LinearModel], keep: Sequence[str], values: str = "x") -> DataFrame:
    """``keep``, ``point`` and ``score`` of every model: the probability of a logistic model, the margin of the others."""
    return row_scores(sparse_rows(rows, n_features, None, values, keep), models, keep)


def row_scores(data: DataFrame, models: Sequence[LinearModel], keep: Sequence[str]) -> DataFrame:
    """``linear_scores`` of ``sparse_rows`` or ``vector_rows``."""
    vectors = np.array([m.coefficients for m in models])
    logistic = [m.point.loss == "logistic" for m in models]
    names = [m.point.name for m in models]
    kinds = dict(data.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(start, ROWS_TOGETHER)
                lists = part.column("at")
                ends = lists.offsets.to_numpy().astype(np.int64)
                margin = _margins(ends - ends[0], lists.flatten().to_numpy(), part.column("value").flatten().to_numpy(), vectors)
                for k, name in enumerate(names):
                    score = np.exp(-np.logaddexp(0, -margin[k])) if logistic[k] else margin[k]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([name] * part.num_rows, pa.string()), pa.array(score)],
                                                     names=[*keep, "point", "score"])

    return data.mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", point string, score double")


def coefficient_table(spark, models: Sequence[LinearModel], names: Sequence[str]) -> DataFrame:
    """``point, feature, coefficient``, the intercept among them."""
    every = [*names, "intercept"]
    rows = [(m.point.name, f, float(c)) for m in models for f, c in zip(every, m.coefficients, strict=True)]
    return spark.createDataFrame(rows, "point string, feature string, coefficient double")
