"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: bit arrays tried one
after another, in which a key owns the first position that no other remaining
key hashes to; its index is the rank of that bit.  The stored bytes at the
index tell members from strangers.  Whole pre-tokens that are in the
vocabulary are resolved there.  Tier two merges the rest: the bytes of a
pre-token are a doubly linked list, a heap holds the ranks of neighbouring
pairs, and the lowest rank (leftmost on ties) is merged until none is left.

Defined cases: null text is empty text; empty texts have no ids; repeated rows
and null ids are kept as they are; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices
from .pieces import PieceEncoder

SLACK = 1.5  # positions of a level for each key that is left


def _hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ (np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct byte strings; ``lookup`` gives -1 for strangers."""

    def __init__(self, keys: list[bytes]):
        self.levels: list[tuple[np.ndarray, int]] = []
        left, h, placed = np.arange(len(keys)), _hashes(keys), []
        done = 0
        while len(left):
            size = int(len(left) * SLACK) + 1
            at = _place(h[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((np.where(alone, np.cumsum(alone) - 1 + done, -1).astype(np.int32), size))
            own = alone[at]
            placed.append(left[own][np.argsort(at[own])])
            done += int(alone.sum())
            left = left[~own]
        order = np.concatenate(placed) if placed else np.zeros(0, np.int64)
        self.keys = [keys[i] for i in order]
        self.order = order

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """Positions of the keys in the list given at the start, -1 where a key isn't in it."""
        h = _hashes(keys)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (index, size) in enumerate(self.levels):
            if not len(open_):
                break
            got = index[_place(h[open_], level, size)]
            found[open_[got >= 0]] = got[got >= 0]
            open_ = open_[got < 0]
        mine = self.keys
        for i in np.flatnonzero(found >= 0):
            found[i] = self.order[found[i]] if mine[found[i]] == keys[i] else -1
        return found


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost on ties, by a heap over linked parts."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: the part is gone
    before = list(range(-1, n - 1))
    wait = [-1] * n  # the rank under which the pair that starts here waits in the heap
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            wait[i] = r
            heap.append((r, i))
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if wait[i] != r or not end[i]:
            continue
        j = end[i]
        k = end[j]
        end[i], end[j], wait[i], wait[j] = k, 0, -1, -1
        if k < n:
            before[k] = i
            r = ranks.get(piece[i:end[k]])
            if r is not None:
                wait[i] = r
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0:
            r = ranks.get(piece[h:k])
            wait[h] = -1 if r is None else r
            if r is not None:
                heapq.heappush(heap, (r, h))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class BytePairCodec:
    """Encoder and decoder for a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        words = list(self.ranks)
        self.ids = np.fromiter((self.ranks[w] for w in words), np.uint32, len(words))
        self.members = PerfectHash(words)
        by_id = [b""] * (int(self.ids.max()) + 1)
        for w, r in self.ranks.items():
            by_id[r] = w
        self.words = pa.array(by_id, pa.binary())
        self.pattern = regex.compile(pattern)
        self.encoder = PieceEncoder(self._encode, leading_space=True)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        find = self.pattern.findall
        parts = [find(p) for p in pieces]
        distinct = list(dict.fromkeys(t for p in parts for t in p))
        raw = [t.encode() for t in distinct]
        known = self.members.lookup(raw)
        ids = {}
        for t, b, k in zip(distinct, raw, known.tolist(), strict=True):
            ids[t] = self.ids[k].tobytes() if k >= 0 else np.array(merge(b, self.ranks), np.uint32).tobytes()
        return [b"".join([ids[t] for t in p]) for p in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[memoryview]:
        """Bytes of each text whose ids stand between two neighbouring starts."""
        words = self.words.take(pa.array(ids))
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:][:len(ids) + 1]
        data = memoryview(words.buffers()[2] or b"")
        ends = offsets[starts].tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    return BytePairCodec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` (array of int) and ``decoded`` (the ids' bytes)."""
    return _run(docs, path, pattern, id_col, text_col, False)


def digest_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """As ``encode_documents`` with digests of the ids and the decoded bytes in place of them."""
    return _run(docs, path, pattern, id_col, text_col, True)


def _run(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in text_slices(batch):
                ids, starts = c.encode(part.column("text"))
                texts = c.decode(ids, starts)
                counts = pa.array(np.diff(starts))
                if not digest:
                    cols = [counts, pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32))),
                            pa.array([bytes(t) for t in texts], pa.binary())]
                    names = ["doc_id", "n_tokens", "ids", "decoded"]
                else:
                    raw = ids.astype("<u4", copy=False).view(np.uint8)
                    at = (starts * 4).tolist()
                    cols = [counts,
                            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
                            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tail = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return source.mapInArrow(work, f"doc_id long, n_tokens long, {tail}")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by ``byte_bpe_multi_50k.tiktoken``, encoded and decoded."""
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN)


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {}
