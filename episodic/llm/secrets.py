"""Secret scan: three base rules and a linear-chain conditional random field.

Tokens are runs of characters other than ASCII white space, tagged O (outside),
B (a secret begins) or I (it goes on).  A tag's score is the sum of weights of
the token's shape features, of cues of the words before and after it, of
features of the whole file (its share of tokens with digits and of markup
characters) and of the step from the tag before; Viterbi decoding gives the
best sequence.  Weights are trained by the CRF likelihood on windows tagged by
the base rules, from up to ``SAMPLE`` documents with a base span and as many
without one (those with the smallest hashed ids among all documents).

Scanning is exact and cheap where nothing is suspicious: when a token's own
score for O beats B and I by more than any two steps can return, the best path
is O there whatever stands around it.  Only documents with another token are
decoded by Viterbi.

Base rules keep their spans; decoded spans that no base span touches are added
as kind ``crf``.

Defined cases: null text is empty and has no span; repeated rows and null ids
are scanned like others; texts of any length are scanned whole; where no
document has a base span, the model adds nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reuse
from .common import table, text_slices, tidied

#: The base rules, fixed by contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")
#: RE2 forms that a text must match for the rule to find anything.
MAYBE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}

TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
TOKEN_SPLIT = r"[ \t\n\r\f\v]"
SAMPLE, WINDOWS, AROUND = 4000, 12, 6
O, B, I = 0, 1, 2
MARKUP = "{}=;<>[]\"'`$"
SLICE_BYTES = 3_000_000  # text whose tokens are held at a time
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access", "auth", "bearer", "credential", "private", "key")


PLAIN = re.compile(r"[A-Z]?[a-z]+[.,]?")
NAMED = re.compile("|".join(CUES), re.I)
DIGIT, MARK = re.compile("[0-9]"), re.compile("[" + re.escape(MARKUP) + "]")


def base_spans(text: str, kinds: tuple[str, ...] = KINDS[:3]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, in code points, by start and then kind as listed."""
    out = []
    if "assign" in kinds:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "access" in kinds:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if "hex" in kinds:
        out += [(*m.span(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_places(text: str) -> list[tuple[int, int]]:
    """Where the secret itself stands in each base span (an assignment's value without its name)."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return out + [(a, b) for a, b, kind in base_spans(text, ("access", "hex"))]


# ---- features -------------------------------------------------------------------------------------------------

FEATURES = ["one"] + [f"length{k}" for k in range(6)] + [f"digits{k}" for k in range(5)] + [f"turns{k}" for k in range(5)] + [
    f"letters{k}" for k in range(5)] + ["hex", "upper-digit", "no-letter", "plain-word", "assignment", "quoted", "mail-or-path", "number", "dots"]
CUE_FEATURES = ["cue", "cue-mark", "mark", "none", "ends-sentence", "other"]
N_TOKEN, N_CUE, N_FILE = len(FEATURES), len(CUE_FEATURES), 4
N_FEATURES = N_TOKEN + 2 * N_CUE + N_FILE


def token_features(token: str) -> list[int]:
    """Numbers of the shape features of a token."""
    core = token.strip(".,;:!?()[]{}\"'`")
    if "=" in core.rstrip("="):
        core = core.rstrip("=").rpartition("=")[2].strip("\"'") or core
    n = len(core)
    digits = sum(c.isdigit() for c in core)
    letters = len(set(core))
    kind = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in core]
    turns = sum(a != b for a, b in zip(kind, kind[1:]))
    share = lambda x: min(4, int(5 * x / n)) if n else 0
    out = [0, 1 + min(5, int(math.log2(n + 1))), 7 + share(digits), 12 + share(turns), 17 + min(4, letters // 4)]
    flags = (n >= 6 and 0 < digits and all(c in "0123456789abcdef" for c in core), n >= 6 and 0 < digits and all(c.isdigit() or c.isupper() for c in core),
             not any(c.isalpha() for c in core), core.isalpha() and core[1:] == core[1:].lower(), "=" in token.rstrip("="),
             token[:1] in "\"'" or token[-1:] in "\"'", "@" in core or "/" in core, n > 0 and digits == n, core.count(".") >= 2)
    return out + [22 + k for k, f in enumerate(flags) if f]


def cue(token: str | None) -> int:
    """What a neighbouring token says: a secret's name, with or without an assignment mark, a mark alone, or neither."""
    if token is None:
        return 3
    low = token.lower().strip("\"'`.,;()[]{}")
    bare = low.rstrip(":=")
    if any(c == bare or bare.endswith(("_" + c, "-" + c, "." + c)) for c in CUES):
        return 1 if bare != low else 0
    if token in (":", "=", "=>", ":=", "->"):
        return 2
    return 4 if token[-1:] in ".!?" else 5


def file_features(tokens: int, with_digits: int, markup: int) -> np.ndarray:
    """Whether many tokens hold digits, many characters are markup, the file is short, and one always."""
    return np.array([with_digits > 0.2 * tokens, markup > 0.3 * tokens, tokens < 50, 1.0])


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of consecutive numbers: first and one past the last."""
    for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
        yield int(part[0]), int(part[-1]) + 1


def _spans(text: str, found: list[re.Match], tags: list[int]) -> list[tuple[int, int]]:
    """Spans of tagged tokens, without the marks around them."""
    out: list[tuple[int, int]] = []
    for m, t in zip(found, tags, strict=True):
        if t == O:
            continue
        a, b = m.span()
        if t == I and out:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    cut = []
    for a, b in out:
        while a < b and text[a] in "\"'`([{<":
            a += 1
        while b > a and text[b - 1] in "\"'`)]}>.,;:!?":
            b -= 1
        if a < b:
            cut.append((a, b))
    return cut


@dataclass
class SecretModel:
    """Weights of the CRF: ``emit`` of (feature, tag), ``step`` of (tag before, tag), ``first`` of the first tag."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def __post_init__(self) -> None:
        self.token_scores: dict[tuple, tuple] = {}
        # what O can lose at both steps around a token by being O, at most
        into = max(self.step[p, t] - self.step[p, O] for p in range(3) for t in (B, I))
        into = max(into, max(self.first[t] - self.first[O] for t in (B, I)))
        out = max(self.step[t, q] - self.step[O, q] for q in range(3) for t in (B, I))
        self.margin = into + max(out, 0.0)

    def own(self, token: str) -> np.ndarray:
        return self.emit[token_features(token)].sum(axis=0)

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Scores (token, tag) of one file."""
        known = [self._plain(t) if PLAIN.fullmatch(t) and not NAMED.search(t) else (self.own(t), cue(t)) for t in tokens]
        e = np.array([x for x, _ in known])
        c = [x for _, x in known]
        before, after = [3, *c[:-1]], [*c[1:], 3]
        digits = sum(DIGIT.search(t) is not None for t in tokens)
        markup = sum(MARK.search(t) is not None for t in tokens)
        return (e + self.emit[N_TOKEN:][before] + self.emit[N_TOKEN + N_CUE:][after]
                + file_features(len(tokens), digits, markup) @ self.emit[-N_FILE:])

    def _decode(self, e: np.ndarray, opens: bool, ends: bool) -> list[int]:
        """The best tags of a run whose neighbours are O; ``opens`` and ``ends``: it is the file's first or last."""
        score = (self.first if opens else self.step[O]) + e[0]
        back = []
        for row in e[1:]:
            total = score[:, None] + self.step
            back.append(total.argmax(axis=0))
            score = total.max(axis=0) + row
        if not ends:
            score = score + self.step[:, O]
        tags = [int(score.argmax())]
        for pointer in reversed(back):
            tags.append(int(pointer[tags[-1]]))
        return tags[::-1]

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags, decoded between the tokens that are O for certain."""
        tags = np.zeros(len(e), np.int8)
        for a, b in _runs(np.flatnonzero(e[:, O] - e[:, 1:].max(axis=1) <= self.margin)):
            tags[a:b] = self._decode(e[a:b], a == 0, b == len(e))
        return tags

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Tagged spans in code points; marks around them are left out."""
        found = list(TOKEN.finditer(text))
        return _spans(text, found, self.viterbi(self.emissions([m[0] for m in found])).tolist()) if found else []

    def spans_at(self, text: str, unsure: np.ndarray, file: np.ndarray) -> list[tuple[int, int]]:
        """The same from the tokens that aren't O for certain and the file's features."""
        found = list(TOKEN.finditer(text))
        n, tags, whole = len(found), {}, file @ self.emit[-N_FILE:]
        for a, b in _runs(unsure):
            near = [found[k][0] if 0 <= k < n else None for k in range(a - 1, b + 1)]
            e = np.array([self.own(t) + self.emit[N_TOKEN + cue(before)] + self.emit[N_TOKEN + N_CUE + cue(after)] + whole
                          for before, t, after in zip(near, near[1:-1], near[2:], strict=False)])
            tags.update(zip(range(a, b), self._decode(e, a == 0, b == n), strict=True))
        marked = [k for k, t in tags.items() if t != O]
        return _spans(text, [found[k] for k in marked], [tags[k] for k in marked])

    def suspicious(self, texts: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The texts with tokens that aren't O for certain, these tokens' numbers, and the file's features.

        This is the test of ``viterbi`` on all tokens of a column at once.

        What depends on a token alone is computed once for each distinct one.
        """
        lists = pc.split_pattern_regex(texts, TOKEN_SPLIT)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        full = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[index] if len(index) else np.zeros(0, bool)
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
        index = index[full]
        if not len(index):
            return {}
        lead, cues = self._distinct(words)
        digit = pc.match_substring_regex(words, r"[0-9]").to_numpy(zero_copy_only=False)
        markup = pc.match_substring_regex(words, "[" + re.escape(MARKUP) + "]").to_numpy(zero_copy_only=False)
        cue_at = cues[index]
        first, last = offsets[:-1], offsets[1:] - 1
        some = np.flatnonzero(np.diff(offsets))
        before, after = np.empty_like(cue_at), np.empty_like(cue_at)
        before[1:], after[:-1] = cue_at[:-1], cue_at[1:]
        before[first[some]] = after[last[some]] = 3
        start = offsets[some]
        size = np.diff(offsets)[some]
        files = np.stack([np.add.reduceat(digit[index].astype(np.int64), start) > 0.2 * size,
                          np.add.reduceat(markup[index].astype(np.int64), start) > 0.3 * size, size < 50, np.ones(len(size))], axis=1)
        # O's lead over B and over I, token by token
        gap = self.emit[:, :1] - self.emit[:, 1:]
        around = gap[N_TOKEN:N_TOKEN + N_CUE][before] + gap[N_TOKEN + N_CUE:N_TOKEN + 2 * N_CUE][after]
        whole = lead[index] + around + np.repeat(files @ gap[-N_FILE:], size, axis=0)
        unsure = np.flatnonzero(whole.min(axis=1) <= self.margin + 1e-9)
        owner = np.searchsorted(start, unsure, side="right") - 1
        cuts = np.flatnonzero(np.diff(owner)) + 1
        return {int(some[o[0]]): (u - start[o[0]], files[o[0]]) for u, o in zip(np.split(unsure, cuts), np.split(owner, cuts), strict=True) if len(u)}

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """O's lead over B and I by a token's own features, and its cue, for distinct tokens.

        Words of letters with nothing around them but a mark at the end fall
        into few kinds (shape, distinct letters, hexadecimal or not), which
        are computed once.
        """
        text = words.to_pylist()
        lead, cues = np.empty((len(text), 2)), np.empty(len(text), np.int64)
        plain = pc.match_substring_regex(words, r"^\p{Lu}?\p{Ll}+[.,]?$").to_numpy(zero_copy_only=False)
        named = pc.match_substring_regex(words, "(?i)" + "|".join(CUES)).to_numpy(zero_copy_only=False)
        fixed = (plain & ~named).tolist()
        for i, w in enumerate(text):
            if w:
                e, cues[i] = self._plain(w) if fixed[i] else (self.own(w), cue(w))
                lead[i] = e[O] - e[B], e[O] - e[I]
            else:
                lead[i], cues[i] = 0.0, 3
        return lead, cues

    def _plain(self, word: str) -> tuple[np.ndarray, int]:
        core = word.rstrip(".,")
        key = (len(core), core[0].isupper(), min(4, len(set(core)) // 4), word[-1] if word[-1] in ".," else "")
        got = self.token_scores.get(key)
        if got is None:
            got = self.token_scores[key] = (self.own(word), cue(word))
        return got


# ---- training -------------------------------------------------------------------------------------------------


def _tagged(text: str) -> tuple[list[str], np.ndarray]:
    """Tokens and their tags by the base rules."""
    found = list(TOKEN.finditer(text))
    tags = np.zeros(len(found), np.int8)
    starts = np.array([m.start() for m in found])
    for a, b in secret_places(text):
        k = int(np.searchsorted(starts, a, side="right")) - 1
        first = k
        while k < len(found) and found[k].start() < b:
            tags[k] = B if k == first else I
            k += 1
    return [m[0] for m in found], tags


def training_windows(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature rows and tags of windows: around the tagged tokens, and as many again spread over the text."""
    tokens, tags = _tagged(text)
    n = len(tokens)
    if not n:
        return
    digits = sum(any("0" <= ch <= "9" for ch in t) for t in tokens)
    markup = sum(any(ch in MARKUP for ch in t) for t in tokens)
    whole = file_features(n, digits, markup)
    odd = [i for i, t in enumerate(tokens) if any("0" <= ch <= "9" for ch in t)]
    at = np.flatnonzero(tags == B)[:WINDOWS].tolist() + odd[:: max(1, len(odd) // 4)][:4] + [n // 3, 2 * n // 3]
    done = -1
    for i in sorted(set(at)):
        a, b = max(done + 1, i - AROUND), min(n, i + AROUND + 1)
        if a >= b:
            continue
        done = b - 1
        rows = np.zeros((b - a, N_FEATURES), np.float32)
        for r, k in enumerate(range(a, b)):
            rows[r, token_features(tokens[k])] = 1
            rows[r, N_TOKEN + cue(tokens[k - 1] if k else None)] = 1
            rows[r, N_TOKEN + N_CUE + cue(tokens[k + 1] if k + 1 < n else None)] = 1
        rows[:, -N_FILE:] = whole
        yield rows, tags[a:b]


def fit(windows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> SecretModel:
    """Maximises the penalised CRF likelihood of all windows together by Adam; forward and backward sums run over a padded batch."""
    n, longest = len(windows), max(len(t) for _, t in windows)
    x = np.zeros((n, longest, N_FEATURES), np.float32)
    y = np.zeros((n, longest), np.int64)
    size = np.array([len(t) for _, t in windows])
    for k, (rows, tags) in enumerate(windows):
        x[k, :len(tags)], y[k, :len(tags)] = rows, tags
    here = np.arange(longest) < size[:, None]
    weights = np.zeros(N_FEATURES * 3 + 9 + 3)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    flat = x.reshape(-1, N_FEATURES)
    seen = (np.eye(3)[y] * here[..., None])
    for step in range(1, rounds + 1):
        emit, trans, first = weights[:N_FEATURES * 3].reshape(-1, 3), weights[-12:-3].reshape(3, 3), weights[-3:]
        e = (flat @ emit).reshape(n, longest, 3)
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = e[:, t] + np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1)
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(here[:, t + 1, None], nxt, 0)
        z = np.logaddexp.reduce(alpha[np.arange(n), size - 1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * here[..., None]
        g_emit = flat.T @ (p - seen).reshape(-1, 3)
        g_first = (p[:, 0] - seen[:, 0]).sum(axis=0)
        g_step = np.zeros((3, 3))
        for t in range(1, longest):
            pair = alpha[:, t - 1, :, None] + trans + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            on = here[:, t]
            g_step += np.exp(pair[on]).sum(axis=0)
            np.add.at(g_step, (y[on, t - 1], y[on, t]), -1)
        g = np.concatenate([g_emit.ravel(), g_step.ravel(), g_first]) / n + ridge * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return SecretModel(weights[:N_FEATURES * 3].reshape(-1, 3), weights[-12:-3].reshape(3, 3), weights[-3:])


def _sampled(documents: DataFrame, sample: int) -> tuple[DataFrame, bool]:
    """The documents with the ``sample`` smallest hashes among those with a base span and as many among the others; whether any has a span."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text))).alias("hash"), text.alias("text"))

    @tidied
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            for part in text_slices(batch):
                texts, hashes = part.column("text"), part.column("hash").to_numpy()
                maybe = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in MAYBE.items()}
                hit = np.zeros(len(hashes), bool)
                for i in np.flatnonzero(maybe["assign"] | maybe["access"] | maybe["hex"]).tolist():
                    hit[i] = bool(base_spans(texts[i].as_py(), tuple(k for k in KINDS[:3] if maybe[k][i])))
                for tagged in (0, 1):
                    kept[tagged] = np.unique(np.concatenate([kept[tagged], hashes[hit == bool(tagged)]]))[:sample]
        for tagged, h in enumerate(kept):
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(np.full(len(h), tagged), pa.int32())], names=["hash", "tagged"])

    found = reuse(rows.mapInArrow(least, "hash long, tagged int").distinct(), "sampled-documents")
    with_span, without = ([r["hash"] for r in found.where(F.col("tagged") == tagged).orderBy("hash").limit(sample).collect()]  # bounded by the limit
                          for tagged in (1, 0))
    return rows.where(F.col("hash").isin(with_span + without)).select("text"), bool(with_span)


def train(documents: DataFrame, *, sample: int = SAMPLE, most_windows: int = 2500) -> SecretModel | None:
    """Fits on windows of up to ``sample`` documents with a base span and as many without, at most ``most_windows`` tagged
    and as many untagged windows, all by the smallest hashes; None where no document has a base span."""
    rows, any_span = _sampled(documents, sample)
    if not any_span:
        return None

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                got = list(training_windows(text.as_py() or ""))
                tagged = [int(t.any()) for _, t in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tagged, pa.int32()), pa.array([r.tobytes() for r, _ in got], pa.binary()), pa.array([t.tobytes() for _, t in got], pa.binary())],
                    names=["tagged", "x", "y"])

    windows = reuse(rows.mapInArrow(work, "tagged int, x binary, y binary"), "training-windows")
    got = [r for tagged in (1, 0) for r in windows.where(F.col("tagged") == tagged).orderBy(F.xxhash64("x"), "x", "y").limit(most_windows).collect()]
    return fit([(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES), np.frombuffer(r["y"], np.int8)) for r in got])


# ---- scanning -------------------------------------------------------------------------------------------------


def all_spans(texts: pa.Array, model: SecretModel | None) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """Base spans and all spans of each text."""
    n = len(texts)
    maybe = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in MAYBE.items()}
    odd = model.suspicious(texts) if model else {}
    out: list = [([], [])] * n
    flagged = maybe["assign"] | maybe["access"] | maybe["hex"]
    flagged[list(odd)] = True
    for i in np.flatnonzero(flagged).tolist():
        text = texts[int(i)].as_py()
        base = base_spans(text, tuple(k for k in KINDS[:3] if maybe[k][i]))
        more = []
        if i in odd:
            more = [(a, b, "crf") for a, b in model.spans_at(text, *odd[i]) if not any(a < d and c < b for c, d, _ in base)]
        out[i] = (base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(documents: DataFrame, model: SecretModel | None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row."""
    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE_BYTES):
                found = all_spans(part.column("text"), model)
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:3]]
                digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
                spans = pa.array([_joined(every) for _, every in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digest, spans],
                                                 names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[SECRET]"


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced; overlapping spans by one mask."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def without_secrets(documents: DataFrame, model: SecretModel | None) -> DataFrame:
    """All documents, all columns, with secrets masked in ``text`` and ``n_chars`` (if there) counted again where it changed."""
    names = documents.columns

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in text_slices(pa.RecordBatch.from_arrays([batch.column("text")], names=["text"]), limit=SLICE_BYTES):
                rows, at = batch.slice(at, part.num_rows), at + part.num_rows
                found = [spans for _, spans in all_spans(part.column("text"), model)]
                hit = pa.array([bool(spans) for spans in found], pa.bool_())
                texts = [masked(part.column("text")[k].as_py(), spans) for k, spans in enumerate(found) if spans]
                new = {"text": texts, "n_chars": [len(t) for t in texts]} if texts else {}
                yield pa.RecordBatch.from_arrays(
                    [pc.replace_with_mask(rows.column(c), hit, pa.array(new[c], batch.schema.field(c).type)) if c in new else rows.column(c)
                     for c in names], names=names)

    return documents.mapInArrow(work, documents.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the base rules and the model trained on them."""
    documents = table(spark, sf_dir, "documents")
    return scan(documents, train(documents))


QUERIES = {"op9_secrets": op9_secrets}
ORACLES: dict[str, str] = {}
