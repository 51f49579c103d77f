"""Prefix trie of conversations, grown as z-fast tries over hashed turns.

A turn is 128 bits of (role, text), a prefix the exclusive or of its turns'
hashes mixed with their depths, so a prefix of any conversation is looked up
in one probe.  A task takes conversations in batches into a z-fast trie: a
compacted node is filed under its handle, the prefix whose depth is the
two-fattest number (the one divisible by the highest power of two) of the
depths on its edge; a conversation's exit node is found by fat binary search
over those handles; insertion splits the exit edge and hangs a leaf there.
After each batch the edges are expanded to one row per prefix with what its
members add up to, and one aggregate merges the rows of all tries.  A prefix
that a third of all conversations share is therefore one row per batch.

What depends on distinct prefixes (leaves, saved tokens) is summed in a second
pass over the shared part of the trie: every prefix is counted at its smallest
member alone, whose stretch of own prefixes is known from the first pass.

No conversation has to fit a task: turns are sorted by range partitions, go on
in rows of at most ``CHUNK`` turns, and a row that begins in the middle of a
conversation is a string below a root of its own.  Lists of ids are digested as
a stream, from pieces joined in the tasks that sorted them.

Defined cases: rows without ``conv_id`` are left out; null role or text is
empty; turns are in ascending order, null first, equal ones by role and text;
repeated turns count as often as they come; ``conv_id % 20`` has the sign of
the id; an empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import reuse
from .common import parallelism, table
from .shingles import mixed

#: Most turns of a row.
CHUNK = 4096
#: Turns of the conversations that go into one trie.
BATCH_TURNS = 200_000
#: Characters of a piece of a list of ids.
PIECE = 1 << 16
#: Conversations that share the first turns of the one whose id is divisible by it, and the most turns shared.
FAMILY, HEAD = 20, 4
WORDS = r"[^\x20\x09-\x0D]+"


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the highest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Strings of prefix hashes from a root; ``insert`` gives the node at which a string ends.

    Of node v: its edge holds the depths from ``low[v] + 1`` to ``extent[v]``, spelt by string ``of[v]``.
    """

    def __init__(self) -> None:
        self.low: list[int] = []
        self.extent: list[int] = []
        self.of: list[int] = []
        self.parent: list[int] = []
        self.roots: dict[tuple, int] = {}
        self.handles: dict[tuple, int] = {}  # by depth of the root and prefix: trees below different roots may share prefixes
        self.children: dict[tuple, int] = {}  # by the prefix one turn below the parent, likewise
        self.strings: list[tuple[int, list[tuple]]] = []  # depth of the root, prefix hashes from there on

    def _node(self, low: int, extent: int, of: int, parent: int) -> int:
        self.low.append(low)
        self.extent.append(extent)
        self.of.append(of)
        self.parent.append(parent)
        return len(self.low) - 1

    def _file(self, v: int) -> None:
        base, keys = self.strings[self.of[v]]
        self.handles[base, keys[two_fattest(self.low[v], self.extent[v]) - base]] = v
        self.children[base, keys[self.low[v] + 1 - base]] = v

    def locate(self, s: int) -> tuple[int, int]:
        """The exit node of a string and how deep the string follows it."""
        base, keys = self.strings[s]
        v, low, high = self.roots[base, keys[0]], base, base + len(keys) - 1
        bottom = high
        while low < high:  # fat binary search
            f = two_fattest(low, high)
            u = self.handles.get((base, keys[f - base]))
            if u is None:
                high = f - 1
                continue
            e = self.extent[u]
            if e > bottom or keys[e - base] != self._key(u, e):
                return u, self._shared(s, u, f)
            v, low = u, e
        if self.extent[v] < bottom:  # a child may be left before its handle
            u = self.children.get((base, keys[self.extent[v] + 1 - base]))
            if u is not None:
                return u, self._shared(s, u, self.extent[v] + 1)
        return v, self.extent[v]

    def _key(self, v: int, depth: int) -> tuple:
        base, keys = self.strings[self.of[v]]
        return keys[depth - base]

    def _shared(self, s: int, v: int, known: int) -> int:
        """Deepest prefix that string and node share, at least ``known``: bisection over prefix hashes."""
        base, keys = self.strings[s]
        high = min(base + len(keys) - 1, self.extent[v])
        while known < high:
            middle = (known + high + 1) // 2
            if keys[middle - base] == self._key(v, middle):
                known = middle
            else:
                high = middle - 1
        return known

    def insert(self, base: int, keys: list[tuple]) -> int:
        """Adds the string whose prefixes at depths ``base, base + 1, ...`` are ``keys``."""
        s = len(self.strings)
        self.strings.append((base, keys))
        if (base, keys[0]) not in self.roots:
            self.roots[base, keys[0]] = self._node(base, base, s, -1)
        v, depth = self.locate(s)
        if depth < self.extent[v]:  # split the edge
            middle = self._node(self.low[v], depth, self.of[v], self.parent[v])
            self.low[v], self.parent[v] = depth, middle
            self._file(middle)
            self._file(v)
            v = middle
        bottom = base + len(keys) - 1
        if depth < bottom:
            v = self._node(depth, bottom, s, v)
            self._file(v)
        return v


def _chunks(turns: DataFrame) -> DataFrame:
    """Turns in order, in rows of at most ``CHUNK``: ``conv_id, start, n, turns, words, alone``."""
    source = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # short keys, so that the splitters that Spark samples are small; the last one parts equal rows
    source = (source.withColumn("_role", F.left("role", F.lit(64))).withColumn("_text", F.left("text", F.lit(64)))
              .withColumn("_tie", F.xxhash64("role", "text")).withColumn("_row", F.monotonically_increasing_id()))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.col("_tie"), F.col("_row")]
    dealt = (source.withColumn("words", F.regexp_count("text", F.lit(WORDS)))
             .withColumn("hash", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))))
             .select("conv_id", "turn", "_role", "_text", "_tie", "_row", "words", "hash")
             .repartitionByRange(parallelism(turns), *order).sortWithinPartitions(*order).select("conv_id", "hash", "words"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        conv, at, n, first = None, 0, 0, True
        hashes: list[bytes] = []
        words: list[np.ndarray] = []

        def close(more: bool, end: bool) -> None:
            """Ends a row; ``more``: its conversation goes on here; ``end``: the partition ends."""
            nonlocal at, n, first
            edge = not more and (first or end)
            out.append((conv, part, at, n, b"".join(hashes), np.concatenate(words).astype("<i4").tobytes(), at + n if edge else None,
                        not at and not more and not edge))
            hashes.clear(), words.clear()
            at, n, first = (at + n, 0, first) if more else (0, 0, False)

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["conv_id", "part", "at", "n", "turns", "words", "here", "alone"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            raw, count = batch.column("hash").to_pylist(), batch.column("words").to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                if ids[a] != conv:
                    if conv is not None:
                        close(False, False)
                    conv = int(ids[a])
                while a < b:
                    if n == CHUNK:
                        close(True, False)
                    c = min(b, a + CHUNK - n)
                    hashes += raw[a:c]
                    words.append(count[a:c])
                    n, a = n + c - a, c
            if len(out) > 5000:
                yield rows()
        if conv is not None:
            close(False, True)
        yield rows()

    rows = reuse(dealt.mapInArrow(work, "conv_id long, part int, at long, n int, turns binary, words binary, here long, alone boolean"), "turns")
    # conversations at the edges of partitions, at most two rows a partition: turns that stand in earlier ones
    edges = rows.where("here is not null").select("conv_id", "part", F.coalesce(
        F.sum("here").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (rows.join(F.broadcast(edges), ["conv_id", "part"], "left")
            .select("conv_id", (F.col("at") + F.coalesce("_before", F.lit(0))).alias("start"), "n", "turns", "words", "alone"))


def _joined(column: str) -> F.Column:
    return F.reduce("_rows", F.lit(bytearray()), lambda whole, r: F.concat(whole, r[column]))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rows of rebuilt conversations: ``conv_id``, depth and prefix hash where the row begins, the prefix hashes and words of its turns.

    A conversation takes its first ``crc32(conv_id) % HEAD`` turns from the first one of its family.
    """
    chunks = _chunks(turns)
    most = HEAD - 1
    heads = (chunks.where((F.col("conv_id") % FAMILY == 0) & (F.col("start") < most))
             .select(F.col("conv_id").alias("_family"), "start", F.substring("turns", 1, 16 * most).alias("turns"), F.substring("words", 1, 4 * most).alias("words"))
             .groupBy("_family").agg(F.sort_array(F.collect_list(F.struct("start", "turns", "words"))).alias("_rows"))
             .select("_family", F.substring(_joined("turns"), 1, 16 * most).alias("head"), F.substring(_joined("words"), 1, 4 * most).alias("head_words")))
    rows = chunks.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("_family"), "left").select(
        "conv_id", "start", "turns", "words", "alone", "head", "head_words", (F.crc32(F.col("conv_id").cast("string")) % HEAD).alias("shared"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, words, depths, sizes, bases = [], [], [], [], []
            for start, own, own_words, head, head_words, h in zip(*(batch.column(c).to_pylist() for c in (
                    "start", "turns", "words", "head", "head_words", "shared")), strict=True):
                head, head_words = (head or b"")[:16 * h], (head_words or b"")[:4 * h]
                m, skip = len(head) // 16, min(max(0, h - start), len(own) // 16)
                base = m + max(start - h, 0)
                hashes.append(own[16 * skip:] if start else head + own[16 * skip:])
                words.append(own_words[4 * skip:] if start else head_words + own_words[4 * skip:])
                base = base if start else 0
                n = len(hashes[-1]) // 16
                bases.append(base)
                sizes.append(n)
                depths.append(np.arange(base + 1, base + n + 1))
            n = np.array(sizes, np.int64)
            ends = np.cumsum(n)
            depth = np.concatenate(depths).astype(np.uint64) if depths else np.zeros(0, np.uint64)
            halves = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
            count = np.frombuffer(b"".join(words), "<i4")
            cols, totals = [], []
            for k in range(2):
                run = np.bitwise_xor.accumulate(mixed(halves[:, k] ^ mixed(depth + np.uint64(k << 60)))) if len(depth) else depth
                run = np.concatenate([np.zeros(1, np.uint64), run])
                before = run[ends - n]
                raw = (run[1:] ^ np.repeat(before, n)).astype("<u8")
                cols.append(pa.array([raw[e - s:e].tobytes() for s, e in zip(sizes, ends.tolist(), strict=True)], pa.binary()))
                totals.append(pa.array((run[ends] ^ before).view(np.int64)))
            sums = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("start"), pa.array(bases, pa.int64()), pa.array(n), *cols, pa.array(words, pa.binary()), *totals,
                 pa.array(sums[ends] - sums[ends - n]), batch.column("alone")],
                names=["conv_id", "start", "base", "n", "h1", "h2", "words", "x1", "x2", "total", "alone"])

    schema = "conv_id long, start long, base long, n long, h1 binary, h2 binary, words binary, x1 long, x2 long, total long, alone boolean"
    placed = reuse(rows.mapInArrow(work, schema), "rebuilt")
    # conversations of several rows: hash up to the row, words behind it
    by_row = Window.partitionBy("conv_id").orderBy("start")
    earlier = by_row.rowsBetween(Window.unboundedPreceding, -1)
    # rows whose turns are all replaced by the family's go, unless nothing else is left of the conversation
    several = placed.where("not alone").select("conv_id", "start", "n", "x1", "x2", "total").withColumn(
        "_all", F.sum("n").over(Window.partitionBy("conv_id"))).where("n > 0 or (_all = 0 and start = 0)")
    carried = several.select(
        "conv_id", "start", F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)).alias("c1"), F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0)).alias("c2"),
        (F.sum("total").over(Window.partitionBy("conv_id")) - F.sum("total").over(by_row.rowsBetween(Window.unboundedPreceding, 0))).alias("tail"),
        F.lead("start").over(by_row).isNull().alias("last"))
    columns = ["conv_id", "base", "n", "h1", "h2", "words", "x1", "x2", "c1", "c2", "tail", "last"]
    zero = F.lit(0).cast("long")
    single = placed.where("alone").withColumns({"c1": zero, "c2": zero, "tail": zero, "last": F.lit(True)})
    return single.select(columns).unionByName(placed.where("not alone").join(carried, ["conv_id", "start"]).select(columns))


def _tries(batches: Iterator[pa.RecordBatch], expand: Callable) -> Iterator[pa.RecordBatch]:
    """Takes rows into tries of about ``BATCH_TURNS`` turns; ``expand`` makes rows of each."""
    trie, ends, held, turns = ZFastTrie(), [], [], 0
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            h1, h2 = (np.concatenate([np.zeros(1, np.uint64), np.frombuffer(row[h], "<u8")[:n]]) ^ np.uint64(row[c] & (2**64 - 1))
                      for h, c in (("h1", "c1"), ("h2", "c2")))
            row["hashes"], row["count"] = (h1, h2), np.frombuffer(row["words"], "<i4")
            held.append(row)
            ends.append(trie.insert(row["base"], list(zip(h1.tolist(), h2.tolist(), strict=True))))
            turns += n + 1
            if turns >= BATCH_TURNS:
                yield expand(trie, ends, held)
                trie, ends, held, turns = ZFastTrie(), [], [], 0
    if held:
        yield expand(trie, ends, held)


def _expanded(trie: ZFastTrie, held: list[dict], values: list[list], per_turn: Callable) -> list[list[np.ndarray]]:
    """Rows of every depth of every edge: hashes, parent's hashes, depth, words, and what ``per_turn`` gives.

    ``per_turn(v, depths, words)`` is called from the deepest nodes upwards.
    """
    out: list[list[np.ndarray]] = []
    for v in sorted(range(len(trie.low)), key=trie.extent.__getitem__, reverse=True):
        low, extent, row = trie.low[v], trie.extent[v], held[trie.of[v]]
        root = trie.parent[v] < 0
        depths = np.arange(low + (not root), extent + 1)
        at = depths - row["base"]
        h1, h2 = row["hashes"]
        words = np.zeros(1, np.int64) if root else row["count"][at - 1].astype(np.int64)
        more = per_turn(v, depths, words)
        if root and extent:
            continue  # the prefix belongs to the row before
        above = at if root else at - 1
        out.append([h1[at], h2[at], h1[above], h2[above], depths, words, *more])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else []


def _record(cols: list, names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cols] if cols else [pa.array([], pa.int64())] * len(names)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _prefixes(rows: DataFrame) -> DataFrame:
    """One row per distinct prefix: hashes, parent's hashes, depth, words of its last turn, members, members that go on,
    smallest member, and the words from its last turn on summed over members."""
    names = ["h1", "h2", "p1", "p2", "depth", "words", "n_convs", "going_on", "conv_id", "total"]

    def expand(trie: ZFastTrie, ends: list[int], held: list[dict]) -> pa.RecordBatch:
        size = len(trie.low)
        members, stop, least, below = [0] * size, [0] * size, [2**63 - 1] * size, [0] * size
        for v, row in zip(ends, held, strict=True):
            members[v] += 1
            stop[v] += row["last"]
            least[v] = min(least[v], row["conv_id"])
            below[v] += row["tail"]

        def per_turn(v: int, depths: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
            n, u = members[v], trie.parent[v]
            total = below[v] + n * np.cumsum(words[::-1])[::-1]
            on = np.full(len(depths), n)
            on[-1] -= stop[v]
            if u >= 0:
                members[u] += n
                least[u] = min(least[u], least[v])
                below[u] += int(total[0])
            return [np.full(len(depths), n), on, np.full(len(depths), least[v], np.int64), total]

        return _record(_expanded(trie, held, [], per_turn), names)

    grown = rows.select("conv_id", "base", "n", "h1", "h2", "words", "c1", "c2", "tail", "last").mapInArrow(
        lambda batches: _tries(batches, expand), ", ".join(f"{c} long" for c in names))
    return grown.groupBy("h1", "h2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        F.sum("n_convs").alias("n_convs"), F.sum("going_on").alias("going_on"), F.min("conv_id").alias("conv_id"), F.sum("total").alias("total"))


def _distinct_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """For prefixes with several members: ``h1, h2``, the words of the distinct prefixes from it on, and the childless ones."""
    names = ["h1", "h2", "p1", "p2", "depth", "words", "distinct", "leaves"]
    solo = F.col("n_convs") == 1
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.min(F.when(solo, F.col("depth"))).alias("solo_from"),
                                          F.sum("words").alias("own_words"), F.max((F.col("going_on") == 0).cast("int")).alias("leaf"))

    def expand(trie: ZFastTrie, ends: list[int], held: list[dict]) -> pa.RecordBatch:
        size = len(trie.low)
        below, leaves, own = [0] * size, [0] * size, [2**62] * size
        for v, row in zip(ends, held, strict=True):
            below[v] += row["below"]
            leaves[v] += row["leaf"] or 0
            if row["own_from"] is not None:
                own[v] = min(own[v], row["own_from"])

        def per_turn(v: int, depths: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
            u = trie.parent[v]
            # a prefix is counted where its smallest member is
            counted = below[v] + np.cumsum(np.where(depths >= own[v], words, 0)[::-1])[::-1]
            if u >= 0:
                below[u] += int(counted[0])
                leaves[u] += leaves[v]
                own[u] = min(own[u], own[v])
            return [counted, np.full(len(depths), leaves[v])]

        return _record(_expanded(trie, held, [], per_turn), names)

    def shared_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts rows where only one conversation is left; what is counted below the cut goes to its end."""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                base, end = row["base"], row["base"] + row["n"]
                cut = end if row["solo_from"] is None else min(end, row["solo_from"] - 1)
                if base and cut <= base:
                    continue
                beyond = np.frombuffer(row["words"], "<i4")[cut - base:]
                if row["own_from"] is None:
                    row["below"] = 0
                else:
                    row["below"] = row["own_words"] if row["own_from"] > cut else row["tail"] + int(beyond.sum(dtype=np.int64))
                row["n"] = cut - base
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*batch.schema, ("below", pa.int64())]))

    joined = rows.select("conv_id", "base", "n", "h1", "h2", "words", "c1", "c2", "tail").join(owners, "conv_id", "left")
    grown = joined.mapInArrow(lambda batches: _tries(shared_part(batches), expand), ", ".join(f"{c} long" for c in names))
    return grown.select("h1", "h2", "distinct", "leaves")


def _digests(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``h1, h2, ends_sha256`` of prefixes with several members at which some end."""
    asked = nodes.where("n_convs > 1 and n_convs > going_on").select("h1", "h2")
    key = ["h1", "h2", "conv_id"]
    ends = rows.where("last").select(F.col("x1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("c2")).alias("h2"), "conv_id")
    dealt = ends.join(asked, ["h1", "h2"]).repartitionByRange(parallelism(rows), *key).sortWithinPartitions(*key)

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size, out = None, 0, [], 0, []
        for batch in batches:
            for h1, h2, conv in zip(*(batch.column(c).to_pylist() for c in key), strict=True):
                if node is not None and ((h1, h2) != node or size > PIECE):
                    out.append((*node, first, ",".join(held)))
                    node = None
                if node is None:
                    node, first, held, size = (h1, h2), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield _pieces(out)
            out = []
        if node is not None:
            yield _pieces([(*node, first, ",".join(held))])

    def _pieces(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["h1", "h2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in batches:
            for h1, h2, ids in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "ids")), strict=True):
                if (h1, h2) == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (h1, h2), hashlib.sha256()
                sha.update(ids.encode())
            yield _digests_of(out)
            out = []
        if node is not None:
            yield _digests_of([(*node, sha.hexdigest())])

    def _digests_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.string())], names=["h1", "h2", "ends_sha256"])

    pieces = dealt.mapInArrow(join_ids, "h1 long, h2 long, first long, ids string")
    return (pieces.repartition(parallelism(rows), "h1", "h2").sortWithinPartitions("h1", "h2", "first")
            .mapInArrow(digest, "h1 long, h2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``turns`` has ``conv_id, turn, role, text``.  Returns ``conv_id`` (smallest
    member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.
    """
    rows = rebuilt(turns)
    nodes = reuse(_prefixes(rows), "prefixes")
    zero = F.lit(0).cast("long")
    kids = nodes.where("depth > 0").select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), zero.alias("distinct"), zero.alias("leaves"), F.lit(1).alias("kids"))
    sums = (_distinct_sums(rows, nodes).withColumn("kids", F.lit(0)).unionByName(kids).groupBy("h1", "h2")
            .agg(F.sum("distinct").alias("distinct"), F.sum("leaves").alias("leaves"), F.sum("kids").alias("kids")))
    parents = nodes.where("n_convs > 1").select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("_parent"))
    alone = F.col("n_convs") == 1
    return (nodes.join(sums, ["h1", "h2"], "left").join(_digests(rows, nodes), ["h1", "h2"], "left").join(parents, ["p1", "p2"], "left").select(
        "conv_id", "depth",
        # a parent with one member has the same one
        F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id")).alias("parent_conv_id"),
        "n_convs", F.coalesce("kids", zero).alias("n_children"),
        F.when(alone, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.when(alone, zero).otherwise(F.col("total") - F.col("distinct")).alias("saved_tokens"),
        F.when(F.col("going_on") == F.col("n_convs"), F.sha2(F.lit(""), 256)).when(alone, F.sha2(F.col("conv_id").cast("string"), 256))
        .otherwise(F.col("ends_sha256")).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = r"""
with recursive own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null
),
conv as (
  select conv_id, conv_id - conv_id % 20 as family, max(i) as n,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(str_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
             lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)),
                 lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 4 as h
  from own group by conv_id
),
turns as (
  select c.conv_id as c, o.i as d, o.role, o.text from conv c join own o on o.conv_id = c.family and o.i <= c.h
  union all
  select c.conv_id, least(c.h, coalesce(f.n, 0)) + o.i - c.h, o.role, o.text
  from conv c join own o on o.conv_id = c.conv_id and o.i > c.h left join conv f on f.conv_id = c.family
),
path as (
  select c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
         list(sha256(strlen(role) || ':' || role || text)) over (partition by c order by d rows unbounded preceding) as p
  from turns
  union all select conv_id, 0, 0, [] from conv
),
size as (select c, max(d) as n from path group by c),
node as (
  select p, d, min(c) as conv_id, count(*) as n_convs, any_value(words) as words,
         sha256(coalesce(string_agg(case when d = n then c::varchar end, ',' order by c), '')) as ends_sha256
  from path join size using (c) group by p, d
),
kids as (select p[1:d - 1] as p, count(*) as n from node where d > 0 group by all),
below as (
  select distinct a.p, b.p as q from path a join path b on a.c = b.c and b.d >= a.d
),
sums as (
  select below.p, sum((q.n_convs - 1) * q.words) as saved, count(*) filter (k.p is null) as leaves
  from below join node q on q.p = below.q left join kids k on k.p = below.q group by below.p
)
select v.conv_id, v.d::bigint as depth, u.conv_id as parent_conv_id, v.n_convs::bigint as n_convs, coalesce(k.n, 0)::bigint as n_children,
       s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, v.ends_sha256
from node v join sums s on s.p = v.p left join kids k on k.p = v.p left join node u on v.d > 0 and u.p = v.p[1:v.d - 1]
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": SQL}
