"""Packing examples into training sequences by a dot-product vector heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens.  Each
task packs the examples of its own partition, so nothing is shuffled.  An
example too large for one sequence gives whole sequences first; what remains
of it waits in a pool of bounded size.  A sequence is filled with the waiting
example whose demand (each part divided by its limit) has the largest dot
product with what the sequence has left, among those that fit; when none fits,
the one with the largest product is cut to the space left and its rest waits
on.  Only the last sequence of a partition, or one whose segment limit binds,
is left with padding.

Loss-bearing tokens of an example are those from ``loss_start`` on (a prompt
before it bears none; null: all bear loss).

Defined cases: null text is empty (only the end id); an example without tokens
gives no piece; repeated rows are packed as often as they come; null ids are
carried; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices, tidied
from .pieces import tokenizer_encoder, with_ends

POOL = 4096
SLICE_BYTES = 4_000_000  # text whose ids are held at a time, beside the pool


@dataclass
class Example:
    """What is left of an example from position ``at`` on; ``skip`` tokens of it came before ``ids``."""

    name: int | None
    ids: np.ndarray
    at: int
    loss_start: int
    total: int
    skip: int = 0

    def demand(self) -> tuple[int, int]:
        n = len(self.ids)
        return n - self.at, n - min(n, max(self.at, self.loss_start))

    def reach(self, tokens: int, loss: int) -> int:
        """The furthest end of a piece within the limits."""
        return min(self.at + tokens, max(self.at, self.loss_start) + loss, len(self.ids))


@dataclass
class VectorPacker:
    """Packs a stream of examples; ``add`` and ``finish`` give finished sequences as lists of (example, start, end)."""

    tokens: int
    segments: int
    loss: int
    pool: int = POOL
    waiting: list[Example] = field(default_factory=list)

    def add(self, e: Example) -> Iterator[list[tuple[Example, int, int]]]:
        if self.tokens < 1 or self.segments < 1 or self.loss < 1:
            raise ValueError("limits start at 1")
        while True:
            n, loss = e.demand()
            if n < self.tokens and loss <= self.loss:
                break
            end = e.reach(self.tokens, self.loss)
            yield [(e, e.at, end)]
            e.at = end
        if n and e.at:  # a copy of the rest, so that what waits doesn't hold whole batches
            e = Example(e.name, e.ids[e.at:].copy(), 0, max(0, e.loss_start - e.at), e.total, e.at)
        if n:
            self.waiting.append(e)
        if len(self.waiting) >= self.pool:
            yield from self._pack(self.pool // 2)

    def finish(self) -> Iterator[list[tuple[Example, int, int]]]:
        yield from self._pack(0)

    def _pack(self, keep: int) -> Iterator[list[tuple[Example, int, int]]]:
        """Fills sequences until at most ``keep`` examples wait."""
        items = self.waiting
        need = np.array([e.demand() for e in items], np.float64).reshape(-1, 2)
        length, loss = need[:, 0], need[:, 1]
        left = len(items)
        while left > keep:
            t, s, l = self.tokens, self.segments, self.loss
            sequence = []
            while t and s and left:
                # equal terms of the segment demand don't change the choice but belong to the product
                score = length * (t / self.tokens ** 2) + loss * (l / self.loss ** 2) + s / self.segments ** 2
                fits = (length > 0) & (length <= t) & (loss <= l)
                k = int(np.argmax(np.where(fits, score, -1.0)))
                if not fits[k]:
                    k = int(np.argmax(np.where(length > 0, score, -1.0)))
                e = items[k]
                end = e.reach(t, l)
                if end == e.at:  # the loss limit is used up and every example bears loss at once
                    break
                before = e.demand()[1]
                sequence.append((e, e.at, end))
                t, s, l, e.at = t - (end - e.at), s - 1, l - before, end
                length[k], loss[k] = e.demand()
                l += int(loss[k])
                left -= length[k] == 0
            yield sequence
        self.waiting = [e for e in items if e.at < len(e.ids)]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(rows: DataFrame, *, tokens: int = 2048, segments: int = 256, loss: int | None = None, pool: int = POOL,
         tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its sequence and its offset there.

    ``rows`` has ``doc_id`` and, with ``tokenizer``, ``text``; else ``ids``
    (array of int, taken as it is).  ``loss_start`` may be there.  ``loss`` is
    the limit of loss-bearing tokens (default: that of tokens).  ``with_ids``
    adds the piece's ids.
    """
    limit = tokens if loss is None else loss
    what = F.col("text").cast("string").alias("text") if tokenizer else F.col("ids").cast("array<int>").alias("ids")
    start = F.col("loss_start").cast("long") if "loss_start" in rows.columns else F.lit(0).cast("long")
    source = rows.select(F.col("doc_id").cast("long").alias("doc_id"), what, F.coalesce(start, F.lit(0)).alias("loss_start"))

    def examples(batch: pa.RecordBatch) -> Iterator[Example]:
        if tokenizer:
            enc = tokenizer_encoder(tokenizer, True)
            for part in text_slices(batch, limit=SLICE_BYTES):
                ids, at = with_ends(*enc.encode(part.column("text")), end_id)
                for name, a, b, first in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(),
                                             part.column("loss_start").to_pylist(), strict=True):
                    own = ids[a:b].copy() if b - a < tokens else ids[a:b]
                    yield Example(name, own, 0, max(0, first), b - a)
        else:
            for name, ids, first in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("loss_start").to_pylist(), strict=True):
                own = np.array(ids.as_py() or [], np.uint32)
                yield Example(name, own, 0, max(0, first), len(own))

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = VectorPacker(tokens, segments, limit, pool)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def done(sequences: Iterator[list[tuple[Example, int, int]]]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for e, a, b in pieces:
                    raw = e.ids[a:b].astype("<u4")
                    out.append((e.name, e.skip + a, b - a, zlib.crc32(raw), e.total, sequence, offset) + ((raw.astype(np.int32),) if with_ids else ()))
                    offset += b - a
                sequence += 1

        def rows_out() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * (7 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array(list(cols[7]), pa.list_(pa.int32())))
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for e in examples(batch):
                done(packer.add(e))
                if len(out) > 10_000:
                    yield rows_out()
        done(packer.finish())
        yield rows_out()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return source.mapInArrow(work, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by ``byte_bpe_50k.json`` in sequences of at most 2048 tokens and 256 segments, all tokens bearing loss."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
