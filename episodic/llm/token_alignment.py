"""Alignment of two tokenizers' tokens of the same text, and how often their ids are linked.

Tokens of A and B are laid over the bytes of the text (with a space before
it).  Where a token of both ends at the same byte, a group ends.  Ends are
compared by diagonal run skipping: along the current shift between the two
index positions, blocks of growing size are compared until one differs, so a
stretch of one-to-one tokens is jumped in few probes; the first difference in
the block is bisected; the irregular group behind it is resolved by stepping
the end that is behind, and its sizes give the new shift.

A text is cut before a single space between visible characters, where both
vocabularies always end a token (no piece of B holds a space behind another
character, A's pattern takes a space to the word behind it).  Each distinct
segment of a slice is tokenised once (a worker keeps the ids of recent ones),
and all distinct segments of the slice are aligned as one stream.

Counts: a task sums, for each slice of documents, in how many of them an id
pair is linked; sums by pair give the corpus counts, a window by A id the
highest of each (at most as many rows as B has ids).  Counts come back to the
slice through one join by pair and a cogroup by slice, so no table of pairs
has to fit anywhere whole.

Defined cases: null and empty texts have no tokens, neither have texts whose
tokens of A or B don't spell the text (such as a literal U+2581); strings of
special tokens are plain text; repeated rows count as documents of their own;
null ids are carried; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import reuse
from .common import table, text_slices
from .pieces import ODD_SPACE, PieceEncoder, tokenizer_pieces

#: Bytes of text whose documents share one list of pairs.
SLICE_BYTES = 4_000_000
#: Segments whose ids a worker keeps, twice for each vocabulary.
CACHED_SEGMENTS = 200_000
NOTHING = np.zeros(0, np.uint32)
#: What may not stand beside the space of a cut: white space and controls.
INVISIBLE = r"\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
CUT = re.compile(f"(?<=[^{INVISIBLE}]) (?=[^{INVISIBLE}])")


def run_length(a: list[int], b: list[int], i: int, j: int) -> int:
    """Equal ends from ``a[i]`` and ``b[j]`` on: doubling blocks, then bisection in the block that differs."""
    most = min(len(a) - i, len(b) - j)
    run, step = 0, 1
    while run < most:
        size = min(step, most - run)
        x, y = i + run, j + run
        if a[x:x + size] == b[y:y + size]:
            run, step = run + size, 2 * step
            continue
        while size > 1:
            half = size // 2
            if a[x:x + half] == b[y:y + half]:
                x, y, size = x + half, y + half, size - half
            else:
                size = half
        return x - i
    return run


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Tokens of A and of B up to the end of each group; ``a`` and ``b`` are ascending byte ends with an equal last one."""
    ends_a: list[int] = []
    ends_b: list[int] = []
    i, shift = 0, 0
    while i < len(a):
        run = run_length(a, b, i, i + shift)
        ends_a += range(i + 1, i + run + 1)
        ends_b += range(i + shift + 1, i + shift + run + 1)
        i += run
        if i == len(a):
            break
        j = i + shift
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        ends_a.append(i)
        ends_b.append(j)
        shift = j - i
    return ends_a, ends_b


@dataclass
class Aligned:
    """Texts as places of distinct segments, the segments' tokens and groups one after another in flat arrays.

    ``from_*`` hold where each segment's part begins (one more at the end);
    ``starts`` where each text's places begin.  ``spelt`` is false for segments
    without tokens because they don't spell the segment.
    """

    place: np.ndarray
    starts: np.ndarray
    spelt: np.ndarray
    a: np.ndarray
    b: np.ndarray
    from_a: np.ndarray
    from_b: np.ndarray
    ends_a: np.ndarray  # tokens up to the end of each group, counted from the first segment
    ends_b: np.ndarray
    from_group: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """``A id << 32 | B id`` of every link of every group, and where each segment's links begin."""
        size_a, size_b = np.diff(self.ends_a, prepend=0), np.diff(self.ends_b, prepend=0)
        many = size_a * size_b
        of_group = np.repeat(np.arange(len(many)), many)
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = (self.a[(self.ends_a - size_a)[of_group] + inside // size_b[of_group]].astype(np.int64) << 32
                 | self.b[(self.ends_b - size_b)[of_group] + inside % size_b[of_group]])
        return pairs, np.concatenate([[0], np.cumsum(many)])[self.from_group]

    def told(self) -> list[str]:
        """Each segment's groups as ``a1,a2|b1;a3|b2``."""
        of_a, of_b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        groups, p, r = [], 0, 0
        for q, s in zip(self.ends_a.tolist(), self.ends_b.tolist(), strict=True):
            groups.append((of_a[p] if q - p == 1 else ",".join(of_a[p:q])) + "|" + (of_b[r] if s - r == 1 else ",".join(of_b[r:s])))
            p, r = q, s
        cuts = self.from_group.tolist()
        return [";".join(groups[g:h]) for g, h in zip(cuts, cuts[1:])]


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level_entries(path: str) -> list[bytes]:
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab()
    of = byte_characters()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


class Aligner:
    """Aligns texts by a byte-level vocabulary A (tokenizers) and a piece vocabulary B (sentencepiece)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ids = range(pieces.get_piece_size())
        self.bytes_a = byte_level_entries(a_path)
        self.bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in entries]) for entries in (self.bytes_a, self.bytes_b))
        encode_a = tokenizer_pieces(a_path)
        self.encoder_a = PieceEncoder(lambda keys: encode_a([" " + k for k in keys]), True, CACHED_SEGMENTS)
        self.encoder_b = PieceEncoder(lambda keys: [array("I", x).tobytes() for x in pieces.encode(keys, num_threads=1)], False, CACHED_SEGMENTS)

    def _tokens(self, keys: list[str]) -> tuple:
        """Ids of A and of B of distinct texts (a space stands before each) and whether both spell the text."""
        raw = [" " + k for k in keys]
        size = np.fromiter((len(k.encode()) for k in raw), np.int64, len(raw))
        whole = "".join(raw).encode()
        flat, begin, wrong = [], [], np.zeros(len(keys), bool)
        for encoder, entries, sizes in ((self.encoder_a, self.bytes_a, self.sizes_a), (self.encoder_b, self.bytes_b, self.sizes_b)):
            got = encoder.ids(keys)
            ids = np.frombuffer(b"".join(got), np.uint32)
            at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4)])
            spent = np.diff(np.concatenate([[0], np.cumsum(sizes[ids])])[at])
            wrong |= spent != size
            if wrong.any() or b"".join([entries[i] for i in ids.tolist()]) != whole:
                cuts = at.tolist()
                listed = ids.tolist()
                wrong |= np.array([b"".join([entries[i] for i in listed[p:q]]) != k.encode() for p, q, k in zip(cuts, cuts[1:], raw)], bool)
            flat.append(ids)
            begin.append(at)
        return *flat, *begin, ~wrong

    def _aligned(self, lists: pa.ListArray) -> Aligned:
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        a, b, from_a, from_b, spelt = self._tokens(coded.dictionary.to_pylist())
        if not spelt.all():
            (a, from_a), (b, from_b) = ((x[np.repeat(spelt, np.diff(at))], np.concatenate([[0], np.cumsum(np.diff(at) * spelt)])) for x, at in ((a, from_a), (b, from_b)))
        ends_a, ends_b = (np.array(x, np.int64) for x in align(np.cumsum(self.sizes_a[a]).tolist(), np.cumsum(self.sizes_b[b]).tolist()))
        return Aligned(coded.indices.to_numpy(), starts - starts[0], spelt, a, b, from_a, from_b, ends_a, ends_b,
                       np.searchsorted(ends_a, from_a, side="right"))

    def align_texts(self, texts: pa.Array) -> Aligned:
        spaced = pc.binary_join_element_wise("", texts, " ")
        odd = pc.match_substring_regex(spaced, ODD_SPACE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        if odd.any():
            rows = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            cut = pa.array([CUT.split(t) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
            lists = pa.concat_arrays([lists.filter(pa.array(~odd)), cut]).take(pa.array(np.argsort(rows, kind="stable")))
        out = self._aligned(lists)
        if len(out.place) and not out.spelt[out.place].all():
            # a text with a segment that isn't spelt by its tokens is judged as a whole
            bad = np.append(~out.spelt[out.place], False)
            wrong = (np.add.reduceat(bad, out.starts[:-1]) > 0) & (np.diff(out.starts) > 0)
            whole = [[t] if w else p for t, p, w in zip(texts.to_pylist(), lists.to_pylist(), wrong, strict=True)]
            out = self._aligned(pa.array(whole, pa.list_(pa.string())))
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, a_ids, b_ids`` and ``groups``, the tokens of A and of B up to the end of each group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        for batch in batches:
            for piece in text_slices(batch, limit=SLICE_BYTES):
                got = al.align_texts(piece.column("text"))
                rows = []
                for p, q in zip(got.starts[:-1].tolist(), got.starts[1:].tolist(), strict=True):
                    a, b, groups = [NOTHING], [NOTHING], []
                    n_a = n_b = 0
                    for k in got.place[p:q].tolist():
                        (x, x2), (y, y2), (g, h) = ((f[k], f[k + 1]) for f in (got.from_a, got.from_b, got.from_group))
                        groups += [{"a_end": i, "b_end": j} for i, j in zip((got.ends_a[g:h] - x + n_a).tolist(), (got.ends_b[g:h] - y + n_b).tolist(), strict=True)]
                        a.append(got.a[x:x2])
                        b.append(got.b[y:y2])
                        n_a, n_b = n_a + int(x2 - x), n_b + int(y2 - y)
                    rows.append((np.concatenate(a).astype(np.int32), np.concatenate(b).astype(np.int32), groups))
                ids = pa.list_(pa.int32())
                kinds = [ids, ids, pa.list_(pa.struct([("a_end", pa.int32()), ("b_end", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(3))],
                                                 names=["doc_id", "a_ids", "b_ids", "groups"])

    return _source(docs, id_col, text_col).mapInArrow(
        work, "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a_end: int, b_end: int>>")


DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


def _sliced(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Documents with their distinct links as places in the list of pairs of their slice, and one row per slice with that list."""
    schema = f"slice long, {DOC}, groups_sha256 string, places binary, times binary, pairs array<struct<a: int, b: int, n: int>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        slice_id = TaskContext.get().partitionId() << 24
        names = [c.split(" ")[0] for c in schema.split(", ")[:9]] + ["pairs"]
        pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            for piece in text_slices(batch, limit=SLICE_BYTES):
                got = al.align_texts(piece.column("text"))
                starts, n = got.starts, len(got.starts) - 1
                pairs, from_link = got.links()
                sizes = np.stack([np.diff(x) for x in (got.from_a, got.from_b, got.from_group, from_link)], axis=1)
                sums = np.vstack([np.zeros((1, 4), np.int64), np.cumsum(sizes[got.place], axis=0)])[starts]
                told = got.told()
                at = got.place.tolist()
                sha = ["" if not total else hashlib.sha256(";".join([told[k] for k in at[p:q]]).encode()).hexdigest()
                       for p, q, total in zip(starts[:-1].tolist(), starts[1:].tolist(), np.diff(sums[:, 0]).tolist(), strict=True)]
                flat, code = np.unique(pairs, return_inverse=True)
                links = pa.ListArray.from_arrays(pa.array(from_link.astype(np.int32)), pa.array(code)).take(pa.array(got.place)).flatten().to_numpy()
                owner = np.repeat(np.arange(n), np.diff(sums[:, 3]))
                held, times = np.unique(owner * max(1, len(flat)) + links, return_counts=True)
                owner, links = np.divmod(held, max(1, len(flat)))
                cuts = np.searchsorted(owner, np.arange(n + 1)).tolist()
                links, times = links.astype("<u4"), times.astype("<u4")
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, slice_id)), piece.column("doc_id"), *(pa.array(c) for c in np.diff(sums, axis=0).T), pa.array(sha, pa.string()),
                     pa.array([links[p:q].tobytes() for p, q in zip(cuts, cuts[1:])], pa.binary()),
                     pa.array([times[p:q].tobytes() for p, q in zip(cuts, cuts[1:])], pa.binary()), pa.nulls(n, pair)], names=names)
                together = pa.StructArray.from_arrays(
                    [pa.array((flat >> 32).astype(np.int32)), pa.array((flat & 0xFFFFFFFF).astype(np.int32)),
                     pa.array(np.bincount(links, minlength=len(flat)).astype(np.int32))], names=["a", "b", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slice_id]), *[none] * 5, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), together)], names=names)
                slice_id += 1

    return reuse(_source(docs, id_col, text_col).mapInArrow(work, schema), "aligned")


def _pairs(sliced: DataFrame) -> DataFrame:
    return (sliced.where("pairs is not null").select("slice", F.posexplode("pairs").alias("place", "p"))
            .select("slice", "place", "p.a", "p.b", F.col("p.n").cast("long").alias("n")))


def _counts(pairs: DataFrame) -> DataFrame:
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def link_counts(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b, n_docs, best``: in how many documents each id pair is linked, and whether that is its A id's highest count."""
    return _counts(_pairs(_sliced(docs, a_path, b_path, id_col, text_col)))


def link_summary(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens, groups, links, how many links are best, the sum of their counts, and a digest of the groups."""
    sliced = _sliced(docs, a_path, b_path, id_col, text_col)
    pairs = _pairs(sliced)
    judged = pairs.join(_counts(pairs), ["a", "b"]).select(F.col("slice").alias("of_slice"), "place", "n_docs", "best")
    rows = sliced.where("pairs is null").drop("pairs")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right.column("place").to_numpy()
        count, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        count[order], best[order] = right.column("n_docs").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for places, times in zip(left.column("places").to_pylist(), left.column("times").to_pylist(), strict=True):
            places, times = np.frombuffer(places, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            sums.append(int(count[places] @ times))
            bests.append(int(best[places] @ times))
        out = left.select([c.split(" ")[0] for c in DOC.split(", ")])
        return (out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
                .append_column("groups_sha256", left.column("groups_sha256")))

    return rows.groupBy("slice").cogroup(judged.groupBy("of_slice")).applyInArrow(work, DOC + ", n_best long, count_sum long, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by ``byte_bpe_50k.json`` (A) and ``piece_bpe_32k.model`` (B)."""
    import public_tokenizers

    return link_summary(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
