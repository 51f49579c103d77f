"""AdaBoost of stumps: one aggregate a round, weights as a function of the stumps so far.

A round sums the rows' weights by (feature, bin, label), first in the tasks; the
best stump is picked from those sums, of which there are features times bins.  A
row's weight follows from the stumps before it, so no table of weights is written
and a lost task recomputes only its own rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reuse
from . import trees as T

#: Least share of a class in a leaf: the spacing of doubles at 1.
EPS = 2.0 ** -52


@dataclass(frozen=True)
class Stump:
    """Rows with ``feature`` up to ``threshold`` (``bin`` when binned) have the share ``left`` of positives, others ``right``."""

    feature: int
    bin: int
    zero: int
    threshold: float
    left: float
    right: float
    alpha: float

    def share(self, values: str) -> Column:
        return F.when(F.coalesce(F.col(values)[self.feature], F.lit(0.0)) <= self.threshold, F.lit(self.left)).otherwise(F.lit(self.right))


def _half_odds(share: Column) -> Column:
    p = F.least(F.greatest(share, F.lit(EPS)), F.lit(1 - EPS))
    return 0.5 * (F.log(p) - F.log(1 - p))


def _weight(stumps: Sequence[Stump], real: bool, y: np.ndarray, row: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The logarithm of each row's weight (up to what all rows have in common); ``row`` and ``cells`` as ``trees.unpacked`` gives them."""
    out = np.zeros(len(y))
    for s in stumps:
        own = cells["feature"] == s.feature
        bin_ = np.full(len(y), s.zero)
        bin_[row[own]] = cells["bin"][own]
        share = np.where(bin_ <= s.bin, s.left, s.right)
        if real:
            p = np.clip(share, EPS, 1 - EPS)
            out -= (2 * y - 1) * 0.5 * (np.log(p) - np.log(1 - p))
        else:
            out += np.where((share > 0.5) == (y == 1), 0.0, s.alpha)
    return out


HIST = "feature int, bin int, w0 double, w1 double"


def _sums(stumps: Sequence[Stump], real: bool, begin: dict[int, int], n_cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums a task's weights by (feature, bin, label), feature -1 for all rows; ``begin`` says where a feature's bins start."""
    features = np.array(sorted(begin), np.int64)
    starts = np.array([begin[f] for f in features], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, total, some = np.zeros(n_cells, bool), np.zeros((2, n_cells)), np.zeros(2), False
        for batch in batches:
            if not batch.num_rows:
                continue
            some = True
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)  # a missing label has no weight
            row, cells = T.unpacked(batch.column("b"))
            w = np.exp(_weight(stumps, real, y, row, cells))
            at = starts[np.searchsorted(features, cells["feature"])] + cells["bin"] if len(cells) else np.empty(0, np.int64)
            held[at] = True
            for k in (0, 1):
                of = np.where(y == k, w, 0.0)
                sums[k] += np.bincount(at, of[row], minlength=n_cells)
                total[k] += of.sum()
        if some:
            at = np.flatnonzero(held)
            f = np.searchsorted(starts, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.append(features[f], -1), pa.int32()), pa.array(np.append(at - starts[f], 0), pa.int32()),
                                              *(pa.array(np.append(sums[k][at], total[k])) for k in (0, 1))], names=["feature", "bin", "w0", "w1"])

    return work


def _pick(hist: np.ndarray, bins: dict[int, tuple], total: np.ndarray) -> tuple | None:
    """``feature, bin, left weights, right weights`` of the stump with the least weighted gini impurity.

    ``hist`` has rows of feature, bin, weight of label 0, of label 1; ``total`` the weights of both labels.
    """
    best = None
    order = np.lexsort((hist[:, 1], hist[:, 0]))
    hist = hist[order]
    for rows in np.split(hist, np.flatnonzero(np.diff(hist[:, 0])) + 1):
        f = int(rows[0, 0])
        highs, _, zero = bins[f]
        cells = np.zeros((len(highs), 2))
        seen = np.zeros(len(highs), bool)
        np.add.at(cells, rows[:, 1].astype(int), rows[:, 2:])
        seen[rows[:, 1].astype(int)] = True
        if 0 <= zero < len(highs):
            cells[zero] += np.maximum(total - rows[:, 2:].sum(0), 0)  # zeros are what the other values leave
            seen[zero] = True
        left = np.cumsum(cells, axis=0)[:-1]
        right = total - left
        n, m = left.sum(1), right.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            after = np.where((n > 1e-12) & (m > 1e-12), 2 * left[:, 0] * left[:, 1] / n + 2 * right[:, 0] * right[:, 1] / m, np.inf)
        after[~seen[:-1]] = np.inf
        for b in np.flatnonzero(np.isfinite(after)):
            key = (round(float(after[b]), 10), f, int(b))
            if best is None or key < best[0]:
                best = (key, left[b], np.maximum(right[b], 0))
    return best and (best[0][1], best[0][2], best[1], best[2])


def fit_adaboost(rows: DataFrame, rounds: int, algorithm: str = "SAMME.R", key: str = "id", target: str = "label", max_bins: int = 64) -> list[Stump]:
    """Stumps of SAMME or SAMME.R for a target of 0 and 1; ``rows`` has ``x`` (see ``trees.entries``).

    Fewer than ``rounds`` when SAMME meets a stump without error (the last one then) or one no better than chance.
    """
    if algorithm not in ("SAMME", "SAMME.R"):
        raise ValueError(f"unknown algorithm {algorithm}")
    real = algorithm == "SAMME.R"
    source = rows.select(F.col(key).alias("id"), F.col(target).cast("int").alias("y"), "x")
    table = reuse(T.fit_bins(source, max_bins), "stump_bins")
    bins = {r.feature: (r.highs, r.lows, r.zero) for r in table.collect()}  # as many numbers as the vocabulary has bins
    begin, n_cells = {}, 0
    for f in sorted(bins):
        begin[f], n_cells = n_cells, n_cells + len(bins[f][0])
    state = reuse(T.apply_bins(source, table, "id", pack=True).select("y", "b"), "stump_rows")
    stumps: list[Stump] = []
    for _ in range(rounds):
        hist = state.mapInArrow(_sums(tuple(stumps), real, begin, n_cells), HIST).groupBy("feature", "bin").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
        found = hist.toPandas().to_numpy(dtype=np.float64)
        own = found[:, 0] == -1
        if not own.any():
            break
        total = found[own, 2:].sum(0)
        picked = _pick(found[~own] / [1, 1, total.sum(), total.sum()], bins, total / total.sum()) if (~own).any() else None
        if picked is None:
            break
        f, b, left, right = picked
        shares = float(left[1] / left.sum()), float(right[1] / right.sum())
        highs, lows, zero = bins[f]
        error = sum(float(side[0] if p > 0.5 else side[1]) for side, p in ((left, shares[0]), (right, shares[1])))
        alpha = 1.0
        if not real:
            if error >= 0.5:
                break
            alpha = math.log((1 - error) / error) if error > 1e-12 else 1.0
        stumps.append(Stump(f, b, zero, (highs[b] + lows[b + 1]) / 2, *shares, alpha))
        if error <= 1e-12 and not real:
            break
    return stumps


def boosted_stump_scores(rows: DataFrame, stumps: Sequence[Stump], algorithm: str, keep: Sequence[str], values: str = "x") -> DataFrame:
    """``keep`` and ``score``, the logistic function of twice the mean vote."""
    vote, total = F.lit(0.0), sum(s.alpha for s in stumps) or 1.0
    for s in stumps:
        share = s.share(values)
        vote = vote + (_half_odds(share) if algorithm == "SAMME.R" else F.when(share > 0.5, s.alpha).otherwise(-s.alpha))
    return rows.select(*keep, (1 / (1 + F.exp(-2 * vote / total))).alias("score"))
