"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two strings counts the subsequences they share, each occurrence
weighted by ``GAP ** (characters skipped)``: those of three letters within
``SPAN`` characters, so that gapped and inserted-character spellings stay near
the plain one, and those of six with at most one character skipped, which tell
stems apart (hashed to 2**16 features).  The occurrences of either length are
divided by their root sum of squares.  A string has a mark at its start and
end.  Units are words (split at white space, lower case, punctuation at the
ends cut off) and runs of at least three single characters joined to one word;
a unit longer than ``LONGEST`` characters is taken by overlapping windows.

Training: sentences inherit the label of their document, and a toxic document
needs one toxic unit only (multiple instances).  Units that stand in toxic
documents significantly more often than in others are the positive instances,
units of other documents the negative ones.  Landmarks are distinct positive
instances and the negative ones nearest to them; the machine is a squared-hinge
SVM on their Nystroem features.  Its decision is linear in the occurrences, so
a task looks each one up in one table.  A logistic curve over a document's
largest decision and the number of units above zero gives the score.

Learned from at most ``PER_CLASS`` labelled documents of each class (those with
the smallest hash of their id) outside the held-out fold; everything is scored
whole.

Defined cases: null and empty texts have no unit and the score of a document
without any sign; unlabelled documents and null ids are scored like others;
repeated labels of a document count as toxic if one is; without labels of both
classes every document scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reuse
from .common import table, text_slices, tidied

PER_CLASS = 3000
POSITIVES, NEGATIVES, LANDMARKS = 3000, 30_000, 128
GAP, SPAN, LONGEST = 0.6, 6, 24
THRESHOLD = 0.3
LETTERS = 32
HASHED = 16  # bits of a feature of six letters
DIMENSIONS = LETTERS ** 3 + (1 << HASHED)
SIGNIFICANT = 8.0  # log-likelihood ratio of a positive instance
START, END = "\x02", "\x03"
EDGES = " \t.,;:!?\"'()[]{}<>|*_~`+=/\\-"
#: Places of three letters, and of six with at most one skipped character, with their weights.
THREE = [((0, a, a + b), np.float32(GAP ** (a + b - 2))) for a in range(1, SPAN) for b in range(1, SPAN - a)]
SIX = [(tuple(k + (k >= skip) for k in range(6)), np.float32(1 if skip == 6 else GAP)) for skip in range(1, 7)]


def _letter_codes() -> np.ndarray:
    """1 to 26 for a to z, 27 to 29 for other letters, 30 and 31 for the marks, 0 for what isn't a letter."""
    out = np.zeros(0x3000, np.uint8)
    for c in range(len(out)):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 3
    out[ord(START)], out[ord(END)] = 30, 31
    return out


CODES = _letter_codes()


def _codes(words: list[str], width: int) -> np.ndarray:
    points = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
    return np.where(points < len(CODES), CODES[np.minimum(points, len(CODES) - 1)], 27 + points % 3).astype(np.uint32)


def _features(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.float32]]:
    """Part (0: three letters, 1: six), feature numbers, whether an occurrence is there, and weight, place by place."""
    on = codes > 0
    for part, places in enumerate((THREE, SIX)):
        for place, w in places:
            n = codes.shape[1] - place[-1]
            if n < 1:
                continue
            u, there = codes[:, :n], on[:, :n]
            for k in place[1:]:
                u = u * np.uint32(LETTERS) + codes[:, k:k + n]
                there = there & on[:, k:k + n]
            if part:
                u = np.uint32(LETTERS ** 3) + ((u * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASHED))
            yield part, u, there, w


def bounded(word: str) -> str:
    return START + word + END


def occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, feature and normalised weight of every occurrence, for words up to ``LONGEST``."""
    rows, subs, weights, square = [], [], [], np.full((2, len(words)), 1e-9)
    for part, u, there, w in _features(_codes([bounded(x) for x in words], LONGEST + 2)):
        i, j = np.nonzero(there)
        rows.append(i)
        subs.append(u[i, j].astype(np.int64))
        weights.append((part, w))
        square[part] += w * w * there.sum(axis=1)
    size = np.sqrt(square)
    scaled = [w / size[part, i] for (part, w), i in zip(weights, rows, strict=True)]
    return np.concatenate(rows), np.concatenate(subs), np.concatenate(scaled)


def kernel(words: list[str], rows: np.ndarray) -> np.ndarray:
    """Kernel of words with landmarks; ``rows`` has one row for each feature and one column for each landmark."""
    out = np.zeros((len(words), rows.shape[1]))
    for cut in range(0, len(words), 500):
        part = words[cut:cut + 500]
        i, u, w = occurrences(part)
        order = np.argsort(i, kind="stable")
        i, u, w = i[order], u[order], w[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
        if len(i):
            out[cut + i[first]] = np.add.reduceat(rows[u] * w[:, None], first, axis=0)
    return out


def embedded(word: str) -> np.ndarray:
    """A word's explicit feature vector."""
    _, u, w = occurrences([word])
    return np.bincount(u, w, minlength=DIMENSIONS).astype(np.float32)


@dataclass
class ToxicityModel:
    """Table of subsequence weights, bias, and the curve over a document's signs."""

    weights: np.ndarray
    bias: float
    curve: np.ndarray  # of 1, largest decision, log(1 + units above zero), log(1 + units)

    def decisions(self, words: list[str]) -> np.ndarray:
        """The machine's decision for each (lower-case) word."""
        out = np.full(len(words), self.bias, np.float32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 8), (8, 14), (14, LONGEST)):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for cut in range(0, len(at), 20_000):
                part = at[cut:cut + 20_000]
                out[part] = self._short([bounded(words[i]) for i in part], high + 2)
        for i in np.flatnonzero(sizes > LONGEST):
            w = bounded(words[i])
            out[i] = self._short([w[k:k + LONGEST] for k in range(0, len(w) - LONGEST // 2, LONGEST // 2)], LONGEST).max()
        return out

    def _short(self, words: list[str], width: int) -> np.ndarray:
        total, square = np.zeros((2, len(words)), np.float32), np.full((2, len(words)), 1e-9, np.float32)
        for part, u, there, w in _features(_codes(words, width)):
            total[part] += w * (self.weights[u] * there).sum(axis=1)
            square[part] += w * w * there.sum(axis=1)
        return (total / np.sqrt(square)).sum(axis=0) + np.float32(self.bias)

    def signs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's largest decision (-2 without units), number of units above zero, and of units."""
        lists = pc.utf8_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        most, count = np.full(len(texts), -2.0, np.float32), np.zeros(len(texts), np.int64)
        if not len(coded):
            return most, count, count
        words = pc.utf8_trim(pc.utf8_lower(coded.dictionary), EDGES).to_pylist()
        index = coded.indices.to_numpy()
        d = self.decisions(words)[index]
        full = np.flatnonzero(np.diff(offsets))
        most[full] = np.maximum(np.maximum.reduceat(d, offsets[full]), -2)
        count[full] = np.add.reduceat((d > 0).astype(np.int64), offsets[full])
        for text, unit in spaced_units(words, index, offsets):
            x = float(self.decisions([unit])[0])
            most[text] = max(most[text], x)
            count[text] += x > 0
        return most, count, np.diff(offsets)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(_curve_inputs(*self.signs(texts)) @ self.curve)


def spaced_units(words: list[str], index: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str]]:
    """Runs of at least three single characters of a text, joined: (text number, unit)."""
    single = np.fromiter((len(w) == 1 for w in words), bool, len(words))[index]
    if single.sum() < 3:
        return
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(single)
    new = np.append(True, (np.diff(at) > 1) | (np.diff(text[at]) > 0))
    starts = np.flatnonzero(new)
    for a, b in zip(starts, np.append(starts[1:], len(at)), strict=True):
        if b - a >= 3:
            yield int(text[at[a]]), "".join(words[index[k]] for k in at[a:b])


def text_units(text: str) -> set[str]:
    """Distinct units of one text."""
    words = [w.strip(EDGES) for w in text.lower().split()]
    units = set(words)
    units.update(u for _, u in spaced_units(words, np.arange(len(words)), np.array([0, len(words)])))
    return units


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _curve_inputs(most: np.ndarray, count: np.ndarray, units: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(most)), np.clip(most, -2, 2), np.log1p(count), np.log1p(units)], axis=1)


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM in the primal by Newton steps over the active instances; the last column's weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1), z.dtype)]).astype(np.float64)
    beta = np.zeros(z.shape[1])
    reg = np.ones(z.shape[1])
    reg[-1] = 1e-3
    active = np.ones(len(z), bool)
    for _ in range(30):
        za = z[active] * weight[active, None]
        beta = np.linalg.solve(np.diag(reg) + c * za.T @ z[active], c * za.T @ y[active])
        now = y * (z @ beta) < 1
        if np.array_equal(now, active):
            break
        active = now
    return beta[:-1], float(beta[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    reg = np.array([1e-6, 1e-2, 1e-2, 1e-2])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - reg * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit_units(units: list[str], positive: np.ndarray, weight: np.ndarray, landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """Feature weights and bias of the machine from labelled units."""
    chosen: list[np.ndarray] = []
    for i in np.argsort(-weight * positive, kind="stable"):  # distinct positive instances, those of most documents first
        if not positive[i] or len(chosen) >= landmarks // 2:
            break
        e = embedded(units[i])
        if e.any() and all(float(e @ c) < 1.5 for c in chosen):
            chosen.append(e)
    others = np.flatnonzero(~positive)
    near = kernel([units[i] for i in others], np.stack(chosen, axis=1)).max(axis=1)
    hard = others[np.argsort(-near, kind="stable")[:landmarks - len(chosen)]]
    rows = np.stack([*chosen, *(embedded(units[i]) for i in hard)], axis=1)
    value, vector = np.linalg.eigh((rows.T @ rows).astype(np.float64))
    root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    z = kernel(units, rows) @ root
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, weight / weight[positive].sum(), weight / weight[~positive].sum())
    beta, bias = _svm(z, y, share * 100)
    return (rows @ (root @ beta)).astype(np.float32), bias


def train(documents: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> ToxicityModel | None:
    """Fits on labelled rows outside the held-out fold; None without both classes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    some = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(some[0].unionByName(some[1])), "doc_id")  # at most two times per_class ids
    sample = reuse(sample.select("text", "toxic"), "labelled")

    @tidied
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                found = sorted(u for u in text_units(text.as_py()) if 3 <= len(u) <= LONGEST)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["unit", "toxic"])

    counts = reuse(sample.mapInArrow(units, "unit string, toxic int").groupBy("unit").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), "units")
    n = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n1, n0 = n[0], n[1] - n[0]
    if not n1 or not n0:
        return None
    share = F.lit(n1 / (n1 + n0))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    ratio = part(a, (a + b) * share) + part(b, (a + b) * (1 - share))
    counts = counts.withColumn("g", F.when(a / n1 > 4 * b / n0, ratio).otherwise(F.lit(0.0)))
    pos = counts.where(F.col("g") >= SIGNIFICANT).orderBy(F.desc("g"), "unit").limit(POSITIVES).collect()
    neg = counts.where((F.col("b") > 0) & (F.col("g") < SIGNIFICANT / 2)).orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVES).collect()
    if not pos or not neg:
        return None
    words = [r["unit"] for r in pos] + [r["unit"] for r in neg]
    weight = np.array([r["a"] for r in pos] + [1.0] * len(neg), np.float64)
    table_, bias = fit_units(words, np.arange(len(words)) < len(pos), weight)
    model = ToxicityModel(table_, bias, np.zeros(4))

    @tidied
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in text_slices(batch):
                yield pa.RecordBatch.from_arrays([*map(pa.array, model.signs(cut.column("text"))), cut.column("toxic")],
                                                 names=["most", "n", "units", "toxic"])

    seen = sample.mapInArrow(signs, "most float, n long, units long, toxic int").collect()  # one row for each sampled document
    most, count, units_, y = (np.array([r[k] for r in seen], np.float64) for k in range(4))
    prior = np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    model.curve = _logistic(_curve_inputs(most, count, units_), y, prior)
    return model


def held_out(doc_id: str):  # noqa: ANN201 - a Column
    """The fold that is never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score(documents: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """``doc_id, score`` of every row."""
    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                s = model.scores(part.column("text")) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id long, score double")


def without_toxic(documents: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns kept."""
    if model is None:
        return documents

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in text_slices(pa.RecordBatch.from_arrays([batch.column("text")], names=["text"])):
                clean = model.scores(part.column("text")) < threshold
                yield batch.slice(at, part.num_rows).filter(pa.array(clean))
                at += part.num_rows

    return documents.mapInArrow(work, documents.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from ``labels`` outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
