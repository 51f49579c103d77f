"""Decision trees and forests of any depth, grown as jobs over tables.

The rows of all trees are one table (tree, weight, target, features);
``path`` names a node by the turns from the root, 0 for left and 1 for right.
While a node holds more rows than a task takes (``SUBTREE_ROWS``), its level is
one aggregate over (node, feature, bin), from which its split is picked; rows
find their nodes by the splits so far, of which there are few.  The rows of a
smaller node are gathered in one task, which grows the whole subtree by the same
rules.  The fitted model is a table of nodes; it goes to the tasks to score rows,
or, beyond ``NODES_IN_TASKS`` nodes, is joined to them level by level.

Bins: a feature with at most ``max_bins`` values has one bin per value, others
are cut at quantiles from a mergeable sketch; zeros of sparse vectors are
derived from the node's totals.  A threshold lies halfway between the largest
value of a bin and the smallest one of the next bin.

Random draws are hashes of (seed, tree, path, feature), so a fit is the same on
any partitioning, and after a lost executor.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..session import reuse, scratch_table_path

NODE = ["tree", "path"]
#: Levels whose joins share one plan when rows are scored.
SCORED_TOGETHER = 6
#: Rows of a task that are summed at a time.
SUMMED_TOGETHER = 50_000
#: Rows of a node, at most, and entries of these rows, whose subtree is grown in one task.
SUBTREE_ROWS = 200_000
SUBTREE_ENTRIES = 2_000_000
#: Partitions that subtrees are dealt to at most.
SUBTREE_PARTITIONS = 2000
#: Sums that a task holds at a time, and values of rows that look for their nodes.
HELD_TOGETHER = 4_000_000
#: Nodes of a forest, at most, that go to the tasks for scoring.
NODES_IN_TASKS = 1_000_000
#: How likely a Poisson(1) count is below 1, 2, ... (draws with replacement).
POISSON_BELOW = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991684)


@dataclass(frozen=True)
class TreeSettings:
    """How trees are grown; ``max_features`` is ``sqrt``, ``log2``, ``all`` or a number, ``max_depth`` None for no limit.

    ``criterion``: gini, entropy (target 0 or 1) or squared (any target).
    ``splitter``: best cut of each drawn feature, or one random cut each.
    """

    n_trees: int = 1
    max_depth: int | None = None
    min_samples_split: int = 2
    criterion: str = "gini"
    splitter: str = "best"
    max_features: str | int = "all"
    bootstrap: bool = False
    max_bins: int = 64
    seed: int = 0
    first_tree: int = 0  # number of the first tree: forests are grown in lots


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def hashed(*parts: object) -> float:
    """``uniform`` outside of Spark."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def entries(features: str) -> Column:
    """A vector's values other than zero as a map from position to value."""
    v = F.unwrap_udt(F.col(features))
    at = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return F.map_filter(F.map_from_arrays(at, v["values"]), lambda _, x: x != 0)


def fit_bins(rows: DataFrame, max_bins: int) -> DataFrame:
    """``feature, highs, lows, zero``: the largest and smallest value of each bin, and the bin that zero falls into.

    ``rows`` has ``x``, a map from feature to value other than zero.
    """
    n = rows.count()
    values = rows.select(F.explode("x").alias("feature", "value")).groupBy("feature", "value").count()
    held = values.groupBy("feature").agg(F.sum("count").alias("_n"))
    values = reuse(values.unionByName(held.where(F.col("_n") < n).select("feature", F.lit(0.0).alias("value"), (n - F.col("_n")).alias("count"))), "values")
    by_feature = Window.partitionBy("feature").orderBy("value")
    few = values.withColumn("_r", F.row_number().over(by_feature)).where(F.col("_r") <= max_bins + 1)  # the limit reaches the tasks before the shuffle
    few = few.groupBy("feature").agg(F.count(F.lit(1)).alias("_k"), F.sort_array(F.collect_list("value")).alias("_values"))
    shares = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins + 1)])
    many = few.where(F.col("_k") > max_bins).select("feature")
    sketch = (values.join(many, "feature").groupBy("feature")
              .agg(F.array_distinct(F.percentile_approx("value", shares, 10_000)).alias("_values")))
    cuts = few.where(F.col("_k") <= max_bins).select("feature", "_values").unionByName(sketch)
    bin_of = F.size(F.filter("_values", lambda c: c < F.col("value")))
    return (values.join(cuts, "feature").select("feature", "value", F.least(bin_of, F.size("_values") - 1).alias("bin"))
            .groupBy("feature", "bin").agg(F.max("value").alias("high"), F.min("value").alias("low"))
            .groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("high", "low"))).alias("_b"))
            .select("feature", F.col("_b.high").alias("highs"), F.col("_b.low").alias("lows"))
            .withColumn("zero", F.size(F.filter("highs", lambda h: h < 0))))


#: An entry of a packed row: its feature and bin.
ENTRY = np.dtype([("feature", "<i4"), ("bin", "<i4")])


def packed(offsets: np.ndarray, feature: np.ndarray, bin_: np.ndarray) -> pa.Array:
    """Rows of entries, each row's as bytes."""
    cells = np.empty(len(feature), ENTRY)
    cells["feature"], cells["bin"] = feature, bin_
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * ENTRY.itemsize).astype(np.int32)), pa.py_buffer(cells)])


def unpacked(b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the feature and bin of each entry of packed rows."""
    ends = np.frombuffer(b.buffers()[1], np.int32)[b.offset:b.offset + len(b) + 1].astype(np.int64)
    data = b.buffers()[2]
    cells = np.frombuffer(data, ENTRY, (ends[-1] - ends[0]) // ENTRY.itemsize, ends[0]) if data is not None and ends[-1] > ends[0] else np.empty(0, ENTRY)
    return np.repeat(np.arange(len(b)), np.diff(ends) // ENTRY.itemsize), cells


@F.arrow_udf(IntegerType())
def bin_in(b: pa.Array, feature: pa.Array, zero: pa.Array) -> pa.Array:
    """The bin that each packed row has of its feature, that of zero where it has no entry."""
    row, cells = unpacked(b)
    out = zero.to_numpy(zero_copy_only=False).astype(np.int64)
    own = cells["feature"] == feature.to_numpy(zero_copy_only=False)[row]
    out[row[own]] = cells["bin"][own]
    return pa.array(out, pa.int32())


def apply_bins(rows: DataFrame, bins: DataFrame, key: str, pack: bool = False, as_cells: bool = False) -> DataFrame:
    """``rows`` with ``b``, a map from feature to bin (``pack``: packed bytes; ``as_cells``: the numbers of ``Cells``) in place of ``x``, coded row by row.

    The table of bins goes to the tasks: at most ``max_bins`` numbers a feature.
    """
    known = sorted((r.feature, r.highs) for r in bins.select("feature", "highs").collect())
    features = np.array([f for f, _ in known], np.int64)
    sizes = np.array([len(h) for _, h in known], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # complex numbers are ordered by feature, then value
    edges = np.repeat(np.arange(len(known)), sizes) + 1j * np.concatenate([[], *[h for _, h in known]])

    @F.arrow_udf("binary" if pack or as_cells else "map<int,int>")
    def coded(x: pa.Array) -> pa.Array:
        offsets = np.asarray(x.offsets).astype(np.int64)
        feature = x.keys.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
        value = x.items.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        at = np.searchsorted(features, feature)
        held = at < len(features)
        held[held] = features[at[held]] == feature[held]
        at = at[held]
        place = np.empty(len(at), np.complex128)
        place.real, place.imag = at, value[held]
        bin_ = np.minimum(np.searchsorted(edges, place) - begin[at], sizes[at] - 1)
        offsets = np.concatenate([[0], np.cumsum(held)])[offsets]
        if as_cells:
            cell = (begin[at] + bin_).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * cell.itemsize).astype(np.int32)), pa.py_buffer(cell)])
        if pack:
            return packed(offsets, feature[held], bin_)
        return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(feature[held], pa.int32()), pa.array(bin_, pa.int32()))

    empty = F.lit(b"") if pack or as_cells else F.create_map().cast("map<int,int>")
    return rows.withColumn("b", coded(F.coalesce("x", F.create_map().cast("map<int,double>"))) if known else empty).drop("x")


def _impurity(criterion: str, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A node's impurity times its rows (for ``squared``: up to what all splits of a node have in common)."""
    if criterion == "gini":
        return 2 * s * (n - s) / n
    if criterion == "entropy":
        with np.errstate(divide="ignore", invalid="ignore"):
            part = lambda k: np.where(k > 0, -k * np.log(k / n), 0.0)
            return part(s) + part(n - s)
    if criterion == "squared":
        return -s * s / n
    raise ValueError(f"unknown criterion {criterion}")


def _drawn(settings: TreeSettings, n_features: int) -> int:
    k = {"sqrt": math.sqrt(n_features), "log2": math.log2(max(n_features, 2)), "all": n_features}.get(settings.max_features, settings.max_features)
    return max(1, int(k))


@dataclass(frozen=True)
class Cells:
    """All bins as arrays: a cell is a bin of a feature, features and bins in order.

    ``feature`` (ids), ``begin`` (first cell), ``zero`` (bin of zero) and the values ``zero_high`` and ``zero_next`` are by
    feature, ``of`` (place of the feature), ``bin``, the largest value ``high`` and the next bin's smallest ``next`` by cell.
    """

    feature: np.ndarray
    begin: np.ndarray
    zero: np.ndarray
    zero_high: np.ndarray
    zero_next: np.ndarray
    of: np.ndarray
    bin: np.ndarray
    high: np.ndarray
    next: np.ndarray

    @classmethod
    def of_bins(cls, bins: DataFrame) -> Cells:
        known = sorted((r.feature, r.highs, r.lows, r.zero) for r in bins.select("feature", "highs", "lows", "zero").collect())
        feature, zero = np.array([k[0] for k in known], np.int64), np.array([k[3] for k in known], np.int64)
        sizes = np.array([len(k[1]) for k in known], np.int64)
        begin = np.cumsum(sizes) - sizes
        high = np.concatenate([[], *[k[1] for k in known]])
        after = np.concatenate([[], *[[*k[2][1:], k[1][-1]] for k in known]])
        at_zero = [(k[1][z] if z < len(k[1]) else 0.0, k[2][z + 1] if z + 1 < len(k[2]) else 0.0) for k, z in zip(known, zero.tolist(), strict=True)]
        of = np.repeat(np.arange(len(known)), sizes)
        return cls(feature, begin, zero, np.array([h for h, _ in at_zero]), np.array([n for _, n in at_zero]), of, np.arange(len(of)) - begin[of], high, after)

    def __len__(self) -> int:
        return len(self.of)


def cells_of(b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the cell of each entry of rows packed as cells."""
    ends = np.frombuffer(b.buffers()[1], np.int32)[b.offset:b.offset + len(b) + 1].astype(np.int64) // 4
    data = b.buffers()[2]
    cell = np.frombuffer(data, np.int32, ends[-1] - ends[0], 4 * ends[0]) if data is not None and ends[-1] > ends[0] else np.empty(0, np.int32)
    return np.repeat(np.arange(len(b)), np.diff(ends)), cell.astype(np.int64)


def _hashes(settings: TreeSettings, names: Sequence[tuple[int, str]], node: np.ndarray, feature: np.ndarray, what: str) -> np.ndarray:
    """``hashed`` of the seed, each node's tree and path, a feature and a word."""
    return np.array([hashed(settings.seed, *names[k], x, what) for k, x in zip(node.tolist(), feature.tolist(), strict=True)])


def best_splits(node: np.ndarray, cell: np.ndarray, n: np.ndarray, s: np.ndarray, total: np.ndarray, total_s: np.ndarray,
                names: Sequence[tuple[int, str]], cells: Cells, settings: TreeSettings, k: int | None) -> tuple[np.ndarray, ...]:
    """The nodes where a feature varies, in order, and of each the feature's place, the bin, threshold, gain and rows of the left child.

    ``n`` and ``s`` are the sums of the nodes' values other than zero by ``node`` and ``cell``, in that order; ``total`` and
    ``total_s`` the sums of each node, ``names`` its tree and path.
    """
    f, b, high, next_ = cells.of[cell], cells.bin[cell], cells.high[cell], cells.next[cell]
    if len(node):
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (f[1:] != f[:-1])]))
        rest, rest_s = total[node[first]] - np.add.reduceat(n, first), total_s[node[first]] - np.add.reduceat(s, first)
        zero = np.flatnonzero(rest > 0)  # zeros are what the node's other values leave
        at = first[zero]
        own = f[at]
        node, f, b = np.append(node, node[at]), np.append(f, own), np.append(b, cells.zero[own])
        n, s = np.append(n, rest[zero]), np.append(s, rest_s[zero])
        high, next_ = np.append(high, cells.zero_high[own]), np.append(next_, cells.zero_next[own])
        order = np.argsort((node * len(cells.feature) + f) * (int(b.max()) + 1) + b, kind="stable")
        node, f, b, n, s, high, next_ = (c[order] for c in (node, f, b, n, s, high, next_))
    apart = (node[1:] != node[:-1]) | (f[1:] != f[:-1])
    begin = np.concatenate([[True], apart])[:len(node)]
    group, starts = np.cumsum(begin) - 1, np.flatnonzero(begin)
    left, left_s = np.cumsum(n), np.cumsum(s)
    left, left_s = left - (left - n)[starts][group], left_s - (left_s - s)[starts][group]
    cut = left < total[node]
    cut[:-1] &= apart | (b[1:] != b[:-1])  # values of the zero bin may stand in two rows
    if settings.splitter == "random" and len(node):
        low, top = high[starts], np.maximum.reduceat(high, starts)
        drawn, varies = low.copy(), np.flatnonzero(low < top)
        u = _hashes(settings, names, node[starts[varies]], cells.feature[f[starts[varies]]], "cut")
        drawn[varies] = low[varies] + u * (top[varies] - low[varies])
        cut &= high <= drawn[group]
        last = np.full(len(low), -1)
        np.maximum.at(last, group[cut], b[cut])
        cut &= b == last[group]
    if k is not None and cut.any():
        # of the features that vary in a node, the ones with the smallest hashes
        some = np.unique(group[cut])
        at = starts[some]
        order = np.lexsort((f[at], _hashes(settings, names, node[at], cells.feature[f[at]], "draw"), node[at]))
        own = node[at][order]
        held = np.zeros(len(starts), bool)
        held[some[order[np.arange(len(own)) - np.searchsorted(own, own) < k]]] = True
        cut &= held[group]
    at = np.flatnonzero(cut)
    own, l, ls = node[at], left[at].astype(np.float64), left_s[at].astype(np.float64)
    every, every_s = total[own].astype(np.float64), total_s[own].astype(np.float64)
    after = _impurity(settings.criterion, l, ls) + _impurity(settings.criterion, every - l, every_s - ls)
    order = np.lexsort((b[at], f[at], np.round(after, 9), own))
    first = order[np.concatenate([[True], np.diff(own[order]) != 0])[:len(order)]]
    gain = _impurity(settings.criterion, every[first], every_s[first]) - after[first]
    if settings.criterion == "squared":
        first, gain = first[gain > 1e-9], gain[gain > 1e-9]
    at = at[first]
    return node[at], f[at], b[at], (high[at] + next_[at]) / 2, gain, left[at]


def _node_sums(of: np.ndarray, w: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted rows and targets' sum of each node, and whether its targets differ."""
    known = ~np.isnan(y)
    some = np.zeros(size)
    some[of[known]] = y[known]
    differs = np.bincount(of[known], y[known] != some[of[known]], size) > 0
    return np.bincount(of, w, size).astype(np.int64), np.bincount(of[known], (w * y)[known], size), differs


def _cell_sums(code: np.ndarray, w: np.ndarray, wy: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes below ``size`` that occur, in order, and the sums of both weights of each."""
    if size <= 4 * len(code):
        held = np.flatnonzero(np.bincount(code, minlength=size))
        return held, np.bincount(code, w, size)[held].astype(np.int64), np.bincount(code, wy, size)[held]
    held, code = np.unique(code, return_inverse=True)
    return held, np.bincount(code, w).astype(np.int64), np.bincount(code, wy)


def grow_rows(tree: int, path: str, w: np.ndarray, y: np.ndarray, row: np.ndarray, cell: np.ndarray, cells: Cells, settings: TreeSettings,
              k: int | None) -> pa.Table:
    """The subtree of ``NODES`` below a node from its rows; ``row`` and ``cell`` are the rows' entries."""
    out, paths, of = [], [path], np.zeros(len(w), np.int64)
    while paths:
        size = len(paths)
        n, s, mixed = _node_sums(of, w, y, size)
        tried = mixed & (n >= settings.min_samples_split)
        if settings.max_depth is not None and len(paths[0]) >= settings.max_depth:
            tried[:] = False
        kept = tried[of]
        w, y, of, inside = w[kept], y[kept], of[kept], kept[row]
        row, cell = (np.cumsum(kept) - 1)[row[inside]], cell[inside]
        code, cn, cs = _cell_sums(of[row] * len(cells) + cell, w[row], np.where(np.isnan(y), 0.0, w * y)[row], size * len(cells))
        at, f, b, threshold, gain, _ = best_splits(code // max(1, len(cells)), code % max(1, len(cells)), cn, cs, n, s, [(tree, p) for p in paths], cells, settings, k)
        split = np.full(size, -1)
        split[at] = np.arange(len(at))
        leaf = split < 0
        picked = [pa.array(v[split] if len(at) else np.zeros(size), t, mask=leaf)
                  for v, t in ((cells.feature[f], pa.int32()), (threshold, pa.float64()), (gain, pa.float64()))]
        out.append(pa.table([pa.array([tree] * size, pa.int32()), pa.array(paths, pa.string()), pa.array([len(p) for p in paths], pa.int32()), pa.array(n),
                             pa.array(s), *picked], ["tree", "path", "depth", "n", "s", "feature", "threshold", "gain"]))
        kept = ~leaf[of]
        w, y, of, inside = w[kept], y[kept], split[of[kept]], kept[row]
        row, cell = (np.cumsum(kept) - 1)[row[inside]], cell[inside]
        own_bin = cells.zero[f[of]] if len(of) else of
        own = cells.of[cell] == f[of[row]] if len(of) else np.zeros(0, bool)
        own_bin[row[own]] = cells.bin[cell[own]]
        of = 2 * of + (own_bin > b[of] if len(of) else 0)
        paths = [paths[i] + turn for i in at.tolist() for turn in "01"]
    return pa.concat_tables(out)


NODES = "tree int, path string, depth int, n long, s double, feature int, threshold double, gain double"


@dataclass
class Top:
    """The nodes above the subtrees: their names, the place of the feature (-1 without split), bin and left child; the right child follows it."""

    names: list[tuple[int, str]]
    feature: list[int]
    bin: list[int]
    left: list[int]

    def add(self, tree: int, path: str) -> int:
        for column, value in ((self.names, (tree, path)), (self.feature, -1), (self.bin, 0), (self.left, -1)):
            column.append(value)
        return len(self.names) - 1

    def finder(self, cells: Cells, first_tree: int) -> Callable[[np.ndarray, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A function from rows' trees and packed entries to their nodes, and the row and cell of each entry."""
        feature, bin_, left = (np.array(c, np.int64) for c in (self.feature, self.bin, self.left))
        used = np.unique(feature[feature >= 0])
        column = np.full(len(cells.feature), -1)
        column[used] = np.arange(len(used))
        column_of, bin_of, zeros = column[cells.of], cells.bin.astype(np.int32), cells.zero[used].astype(np.int32)

        def find(tree: np.ndarray, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row, cell = cells_of(b)
            node = tree.astype(np.int64) - first_tree  # the roots come first
            if not len(used):
                return node, row, cell
            place = column_of[cell]
            own = np.flatnonzero(place >= 0)
            step = max(1, HELD_TOGETHER // len(used))
            for start in range(0, len(node), step):
                end = min(start + step, len(node))
                part = own[np.searchsorted(row[own], start):np.searchsorted(row[own], end)]
                held = np.tile(zeros, (end - start, 1))
                held[row[part] - start, place[part]] = bin_of[cell[part]]
                here, live = node[start:end], np.flatnonzero(feature[node[start:end]] >= 0)
                while len(live):
                    at = here[live]
                    here[live] = left[at] + (held[live, column[feature[at]]] > bin_[at])
                    live = live[feature[here[live]] >= 0]
            return node, row, cell

        return find


SUMS = "node int, cell int, n long, s double, least double, most double"


def _sums_of_nodes(batches: Iterator[pa.RecordBatch], find: Callable, nodes: np.ndarray, n_nodes: int, n_cells: int) -> Iterator[pa.RecordBatch]:
    """A task's rows in ``nodes`` summed by (node, cell); cell -1 stands for the node, with its least and largest target.

    Without cells there is nothing else.  All sums are held where they are few, else those of ``SUMMED_TOGETHER`` rows.
    """
    number = np.full(n_nodes, -1)
    number[nodes] = np.arange(len(nodes))
    size = len(nodes) * n_cells
    dense = size <= HELD_TOGETHER
    cn, cs = (np.zeros(size), np.zeros(size)) if dense else (None, None)
    n, s, least, most = np.zeros(len(nodes)), np.zeros(len(nodes)), np.full(len(nodes), np.nan), np.full(len(nodes), np.nan)
    held, rows = [], 0

    def table(at: np.ndarray, cell: np.ndarray, n: np.ndarray, s: np.ndarray, ends: Sequence[np.ndarray] = ()) -> pa.RecordBatch:
        ends = [pa.array(e, pa.float64(), from_pandas=True) for e in ends] or [pa.nulls(len(at), pa.float64())] * 2
        return pa.RecordBatch.from_arrays([pa.array(nodes[at], pa.int32()), pa.array(cell, pa.int32()), pa.array(n.astype(np.int64)), pa.array(s.astype(np.float64)), *ends],
                                          names=["node", "cell", "n", "s", "least", "most"])

    def summed() -> pa.RecordBatch:
        code, w, wy = (np.concatenate(c) for c in zip(*held, strict=True))
        code, w, wy = _cell_sums(code, w, wy, size)
        return table(code // n_cells, code % n_cells, w, wy)

    for batch in batches:
        if not batch.num_rows:
            continue
        node, row, cell = find(batch.column("tree").to_numpy(), batch.column("b"))
        of = number[node]
        inside = of >= 0
        w, y = batch.column("w").to_numpy().astype(np.float64), batch.column("y").to_numpy(zero_copy_only=False)
        wy = np.where(np.isnan(y), 0.0, w * y)
        mine = of[inside]
        n += np.bincount(mine, w[inside], len(nodes))
        s += np.bincount(mine, wy[inside], len(nodes))
        np.fmin.at(least, mine, y[inside])
        np.fmax.at(most, mine, y[inside])
        if not n_cells:
            continue
        if not inside.all():
            kept = inside[row]
            row, cell = row[kept], cell[kept]
        code = of[row] * n_cells + cell
        if dense:
            cn += np.bincount(code, w[row], size)
            cs += np.bincount(code, wy[row], size)
            continue
        held.append((code, w[row], wy[row]))
        rows += int(inside.sum())
        if rows >= SUMMED_TOGETHER:
            yield summed()
            held, rows = [], 0
    if held:
        yield summed()
    if dense and n_cells and cn.any():
        at = np.flatnonzero(cn)
        yield table(at // n_cells, at % n_cells, cn[at], cs[at])
    at = np.flatnonzero(n)
    if len(at):
        yield table(at, np.full(len(at), -1), n[at], s[at], (least[at], most[at]))


def level_splits(state: DataFrame, top: Top, nodes: Sequence[int], cells: Cells, settings: TreeSettings, k: int | None, open_depth: bool) -> list:
    """A row for each of ``nodes``, all of one depth: ``node, n, s, feature`` (its place), ``bin, threshold, gain, left``; the last five null at leaves.

    One aggregate over (node, cell), summed in the tasks first; then a node's
    sums (at most bins times features) are gathered to pick its split.
    """
    work = partial(_sums_of_nodes, find=top.finder(cells, settings.first_tree), nodes=np.array(nodes, np.int64), n_nodes=len(top.names), n_cells=len(cells) if open_depth else 0)
    sums = state.select("tree", "w", "y", "b").mapInArrow(work, SUMS).groupBy("node", "cell").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
    names = {i: top.names[i] for i in nodes}

    def pick(key: tuple, t: pa.Table) -> pa.Table:
        node = key[0].as_py()
        t = t.sort_by("cell")
        cell, n, s = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "n", "s"))
        least, most = t.column("least")[0].as_py(), t.column("most")[0].as_py()  # cell -1 comes first
        found: tuple = ([],) * 6
        if open_depth and least is not None and least < most and n[0] >= settings.min_samples_split and len(cell) > 1:
            found = best_splits(np.zeros(len(cell) - 1, np.int64), cell[1:].astype(np.int64), n[1:], s[1:], n[:1], s[:1], [names[node]], cells, settings, k)
        _, *split = ([v for v in c] or [None] for c in found)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
        return pa.table([pa.array([node], pa.int32()), pa.array(n[:1]), pa.array(s[:1]), *(pa.array(v, t) for v, t in zip(split, kinds, strict=True))],
                        ["node", "n", "s", "feature", "bin", "threshold", "gain", "left"])

    return sums.groupBy("node").applyInArrow(pick, "node int, n long, s double, feature int, bin int, threshold double, gain double, left long").collect()


def grow(rows: DataFrame, settings: TreeSettings, key: str = "id", target: str = "label") -> DataFrame:
    """The nodes of all trees: ``tree, path, depth, n, s`` (weighted rows and their targets' sum), ``feature, threshold, gain`` (null at leaves).

    ``rows`` has ``x`` (see ``entries``); ``key`` is a unique id.  A node is
    split if it has ``min_samples_split`` rows and mixed targets, while its
    depth is below ``max_depth``.
    """
    spark = rows.sparkSession
    source = rows.select(F.col(key).alias("id"), F.col(target).cast("double").alias("y"), "x")
    bins = reuse(fit_bins(source, settings.max_bins), "bins")
    cells = Cells.of_bins(bins)
    k = _drawn(settings, len(cells.feature))
    k = k if k < len(cells.feature) else None
    first = settings.first_tree
    state = apply_bins(source, bins, "id", as_cells=True).withColumn("tree", F.explode(F.sequence(F.lit(first), F.lit(first + settings.n_trees - 1))))
    if settings.bootstrap:
        u = uniform(settings.seed, F.col("tree"), F.col("id"), "row")
        # inside the array the hash is taken once for all comparisons
        count = F.transform(F.array(u), lambda v: sum(((v >= p).cast("long") for p in POISSON_BELOW[1:]), (v >= POISSON_BELOW[0]).cast("long")))[0]
        state = state.withColumn("w", count).where("w > 0")
    else:
        state = state.withColumn("w", F.lit(1).cast("long"))
    state = reuse(state.select("tree", "w", "y", "b"), "tree_rows")
    sizes = {r.tree: r.n for r in state.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a tree
    n_rows, size = sum(sizes.values()), state.agg(F.avg(F.length("b"))).first()[0] or 0.0
    most = min(SUBTREE_ROWS, max(1, int(SUBTREE_ENTRIES * 4 / max(size, 1.0))))

    top, folder = Top([], [], [], []), scratch_table_path(spark, "trees")
    large, small, done = [], [], []
    for tree in range(first, first + settings.n_trees):
        at = top.add(tree, "")
        if tree in sizes:
            (large if sizes[tree] > most else small).append(at)
    part, part_rows, depth = state, n_rows, 0
    large_rows = sum(sizes[top.names[i][0]] for i in large)
    while large:
        if large_rows < part_rows / 2:  # rows of smaller nodes are left out, so that a level costs what is still growing
            part, part_rows = reuse(in_nodes(part, top, large, cells, first).drop("node"), "large_rows"), large_rows
        found = level_splits(part, top, large, cells, settings, k, settings.max_depth is None or depth < settings.max_depth)
        large, large_rows = [], 0
        for r in sorted(found, key=lambda r: r.node):
            tree, path = top.names[r.node]
            split = r.feature is not None
            done.append((tree, path, depth, r.n, r.s, int(cells.feature[r.feature]) if split else None, r.threshold, r.gain))
            if not split:
                continue
            children = [top.add(tree, path + turn) for turn in "01"]
            top.feature[r.node], top.bin[r.node], top.left[r.node] = r.feature, r.bin, children[0]
            for child, n in zip(children, (r.left, r.n - r.left), strict=True):
                (large if n > most else small).append(child)
                large_rows += n if n > most else 0
        depth += 1
    spark.createDataFrame(done, NODES).coalesce(1).write.parquet(f"{folder}/top")
    if small:
        names = top.names

        def subtree(key: tuple, t: pa.Table) -> pa.Table:
            row, cell = cells_of(t.column("b").combine_chunks())
            w, y = t.column("w").to_numpy().astype(np.float64), t.column("y").to_numpy(zero_copy_only=False)
            return grow_rows(*names[key[0].as_py()], w, y, row, cell, cells, settings, k)

        parts = min(len(small), max(2 * spark.sparkContext.defaultParallelism, 2 * math.ceil(n_rows / most)), SUBTREE_PARTITIONS)
        own = in_nodes(state, top, small, cells, first).repartition(parts, "node")
        own.groupBy("node").applyInArrow(subtree, NODES).write.parquet(f"{folder}/subtrees")
    return spark.read.parquet(f"{folder}/*")


def in_nodes(state: DataFrame, top: Top, nodes: Sequence[int], cells: Cells, first_tree: int) -> DataFrame:
    """The rows of ``nodes`` with their ``node``."""
    find, wanted = top.finder(cells, first_tree), np.zeros(len(top.names), bool)
    wanted[list(nodes)] = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, _, _ = find(batch.column("tree").to_numpy(), batch.column("b"))
                yield batch.append_column("node", pa.array(node, pa.int32())).filter(pa.array(wanted[node]))

    return state.select("tree", "w", "y", "b").mapInArrow(work, "tree int, w long, y double, b binary, node int")


def grow_forest(rows: DataFrame, settings: TreeSettings, key: str = "id", target: str = "label", lot: int = 50) -> DataFrame:
    """``grow`` for many trees, ``lot`` of them at a time, so that the table of rows stays a bounded multiple of the data."""
    nodes = None
    for first in range(0, settings.n_trees, lot):
        more = grow(rows, replace(settings, n_trees=min(lot, settings.n_trees - first), first_tree=first), key, target)
        nodes = more if nodes is None else nodes.unionByName(more)
    return nodes


def leaves_by_joins(rows: DataFrame, nodes: DataFrame, keep: Sequence[str], values: str = "x", feature: str = "feature") -> DataFrame:
    """``leaves`` of any number of nodes: one join a level."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    every = F.array(*[F.lit(r.tree) for r in nodes.select("tree").distinct().collect()])  # a number a tree
    at = rows.select(*keep, F.col(values).alias("_x"), F.explode(every).alias("tree")).withColumns(
        {"path": F.lit(""), "n": F.lit(None).cast("long"), "s": F.lit(None).cast("double")})
    for depth in range(deepest + 1):
        level = nodes.where(F.col("depth") == depth).select("tree", "path", F.col(feature).alias("_f"), F.col("threshold").alias("_t"),
                                                            F.col("n").alias("_n"), F.col("s").alias("_s"))
        step = F.when(F.coalesce(F.col("_x")[F.col("_f")], F.lit(0.0)) <= F.col("_t"), "0").otherwise("1")
        done = F.col("_n").isNotNull() & F.col("_f").isNull()
        at = at.join(level, NODE, "left").select(
            *[F.col(c) for c in keep], "_x", "tree", F.when(F.col("_f").isNotNull(), F.concat("path", step)).otherwise(F.col("path")).alias("path"),
            F.when(done, F.col("_n")).otherwise(F.col("n")).alias("n"), F.when(done, F.col("_s")).otherwise(F.col("s")).alias("s"))
        if depth % SCORED_TOGETHER == SCORED_TOGETHER - 1:
            at = reuse(at, "scored_levels")
    return at.drop("_x")


@dataclass(frozen=True)
class Forest:
    """All nodes as arrays, by tree: ``roots``, the place of each node's feature in ``features`` (-1 at leaves), threshold, children, ``n`` and ``s``."""

    features: pa.Array
    roots: dict[int, int]
    paths: pa.Array
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n: np.ndarray
    s: np.ndarray

    @classmethod
    def of_nodes(cls, nodes: DataFrame, feature: str) -> Forest:
        t = nodes.select("tree", "path", F.col(feature).alias("f"), "threshold", "n", "s").toArrow()
        tree, path = t.column("tree").to_pylist(), t.column("path").to_pylist()
        at = {name: i for i, name in enumerate(zip(tree, path, strict=True))}
        features = t.column("f").combine_chunks().unique().drop_null()
        place = pc.fill_null(pc.index_in(t.column("f").combine_chunks(), features), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        left, right = np.full(len(tree), -1), np.full(len(tree), -1)
        for i in np.flatnonzero(place >= 0).tolist():
            left[i], right[i] = at[tree[i], path[i] + "0"], at[tree[i], path[i] + "1"]
        numbers = [t.column(c).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("threshold", "n", "s")]
        return cls(features, {k: at[k, ""] for k in sorted(set(tree))}, t.column("path").combine_chunks(), place, numbers[0], left, right, *numbers[1:])

    def find(self, x: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        """For some rows from the first one on, and each tree: that row, the tree and the rows' leaves; ``x`` maps features to values."""
        ends = np.asarray(x.offsets).astype(np.int64)
        row = np.repeat(np.arange(len(x)), np.diff(ends))
        keys = x.keys.slice(ends[0], ends[-1] - ends[0])
        place = pc.fill_null(pc.index_in(keys.cast(self.features.type), self.features), -1).to_numpy(zero_copy_only=False)
        value = x.items.slice(ends[0], ends[-1] - ends[0]).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        own = place >= 0
        row, place, value = row[own], place[own], value[own]
        step = max(1, HELD_TOGETHER // max(1, len(self.features)))
        for start in range(0, len(x), step):
            end = min(start + step, len(x))
            part = slice(*np.searchsorted(row, (start, end)))
            held = np.zeros((end - start, len(self.features)))
            held[row[part] - start, place[part]] = value[part]
            for tree, root in self.roots.items():
                here = np.full(end - start, root)
                live = np.flatnonzero(self.feature[here] >= 0)
                while len(live):
                    at = here[live]
                    here[live] = np.where(held[live, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                    live = live[self.feature[here[live]] >= 0]
                yield start, tree, here


def _forest(nodes: DataFrame, feature: str) -> tuple[DataFrame, Forest | None]:
    """The written nodes, and as arrays where they are few enough to go to the tasks."""
    nodes = reuse(nodes, "scoring_nodes")  # its size is known then, so that a level goes to the rows
    size = nodes.count()
    if not size:
        raise ValueError("there are no trees")
    return nodes, Forest.of_nodes(nodes, feature) if size <= NODES_IN_TASKS else None


def _with_map(rows: DataFrame, keep: Sequence[str], values: str) -> tuple[DataFrame, list[StructField]]:
    key = rows.schema[values].dataType.keyType.simpleString()
    found = rows.select(*keep, F.coalesce(values, F.create_map().cast(f"map<{key},double>")).alias("_x"))
    return found, [rows.select(*keep).schema[c] for c in keep]


def leaves(rows: DataFrame, nodes: DataFrame, keep: Sequence[str], values: str = "x", feature: str = "feature") -> DataFrame:
    """The leaf of each row in each tree: ``keep``, ``tree, path, n, s``.

    ``values`` is a map from feature (as ``feature`` of ``nodes`` names it) to
    value; a missing entry is zero.
    """
    nodes, forest = _forest(nodes, feature)
    if forest is None:
        return leaves_by_joins(rows, nodes, keep, values, feature)
    asked, kinds = _with_map(rows, keep, values)
    whole = dict(nodes.dtypes)["n"] == "bigint"
    kinds = [*kinds, StructField("tree", IntegerType()), StructField("path", StringType()), StructField("n", LongType() if whole else DoubleType()), StructField("s", DoubleType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, tree, at in forest.find(batch.column("_x")):
                own = [batch.column(c).slice(start, len(at)) for c in keep]
                n = pa.array(forest.n[at].astype(np.int64) if whole else forest.n[at])
                yield pa.RecordBatch.from_arrays([*own, pa.array([tree] * len(at), pa.int32()), forest.paths.take(pa.array(at)), n, pa.array(forest.s[at])],
                                                 names=[*keep, "tree", "path", "n", "s"])

    return asked.mapInArrow(work, StructType(kinds))


def forest_scores(rows: DataFrame, nodes: DataFrame, keep: Sequence[str], values: str = "x", feature: str = "feature") -> DataFrame:
    """``keep`` and ``score``, the mean over trees of the share of positives in the row's leaf."""
    nodes, forest = _forest(nodes, feature)
    if forest is None:
        return leaves_by_joins(rows, nodes, keep, values, feature).groupBy(*keep).agg(F.avg(F.col("s") / F.col("n")).alias("score"))
    asked, kinds = _with_map(rows, keep, values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for start, _, at in forest.find(batch.column("_x")):
                score[start:start + len(at)] += forest.s[at] / forest.n[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score / len(forest.roots))], names=[*keep, "score"])

    return asked.mapInArrow(work, StructType([*kinds, StructField("score", DoubleType())]))


def in_raw_units(nodes: DataFrame, scales: DataFrame) -> DataFrame:
    """Nodes with ``name`` and thresholds of the raw columns.

    ``scales`` has ``feature, name, low, high``: the range that min-max scaling
    used, null for features that weren't scaled.
    """
    raw = F.when(F.col("low").isNull(), F.col("threshold")).otherwise(F.col("threshold") * (F.col("high") - F.col("low")) + F.col("low"))
    return nodes.join(scales, "feature", "left").withColumn("threshold", raw).drop("low", "high")


def importances(nodes: DataFrame) -> DataFrame:
    """``feature, importance``: each tree's impurity decrease by feature, summing to 1, averaged over trees."""
    by_tree = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum("gain").alias("_g"))
    share = F.col("_g") / F.sum("_g").over(Window.partitionBy("tree"))
    n = nodes.where("path = ''").count()
    return by_tree.withColumn("_share", share).groupBy("feature").agg((F.sum("_share") / n).alias("importance"))


def boost(rows: DataFrame, settings: TreeSettings, rounds: int, rate: float, subsample: float = 1.0, key: str = "id",
          target: str = "label") -> tuple[float, list[DataFrame]]:
    """Gradient boosting of log loss: the first score and one table of nodes a round.

    A leaf adds the sum of its rows' residuals over that of ``p (1 - p)``, kept
    as ``s`` over ``n``, times ``rate``; each round sees the rows whose hash is
    below ``subsample``.
    """
    base = rows.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    base = min(max(base, 1e-9), 1 - 1e-9)
    start = math.log(base / (1 - base))
    scored = rows.select(key, F.col(target).cast("double").alias("_y"), "x", F.lit(start).alias("_score"))
    out = []
    for m in range(rounds):
        p = 1 / (1 + F.exp(-F.col("_score")))
        scored = reuse(scored.withColumns({"_p": p, "_r": F.col("_y") - p}), "boosted")
        part = scored.where(uniform(settings.seed, m, F.col(key), "row") < subsample)
        one = replace(settings, criterion="squared", n_trees=1, seed=settings.seed + m)
        nodes = grow(part.select(key, "_r", "x"), one, key, "_r")
        step = (leaves(part.select(key, "_r", "_p", "x"), nodes, [key, "_r", "_p"]).groupBy("path")
                .agg(F.sum("_r").alias("_rs"), F.greatest(F.sum(F.col("_p") * (1 - F.col("_p"))), F.lit(1e-12)).alias("_h")))
        nodes = reuse(nodes.join(step, "path", "left").withColumns(
            {"s": F.coalesce(rate * F.col("_rs") / F.col("_h"), F.lit(0.0)), "n": F.lit(1).cast("long")}).drop("_rs", "_h"), "boosted_tree")
        out.append(nodes)
        moved = leaves(scored, nodes, [key, "_score"]).select(key, (F.col("_score") + F.col("s")).alias("_next"))
        scored = scored.join(moved, key).select(key, "_y", "x", F.col("_next").alias("_score"))
    return start, out


def boosted_scores(rows: DataFrame, start: float, rounds: Sequence[DataFrame], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``score``: the logistic function of the first score and all leaves of the row."""
    nodes = None
    for m, t in enumerate(rounds):
        t = t.withColumn("tree", F.lit(m))
        nodes = t if nodes is None else nodes.unionByName(t)
    if nodes is None:
        return rows.select(*keep, F.lit(1 / (1 + math.exp(-start))).alias("score"))
    found = leaves(rows, reuse(nodes, "boosted_trees"), keep)
    return found.groupBy(*keep).agg((1 / (1 + F.exp(-(F.lit(start) + F.sum("s"))))).alias("score"))
