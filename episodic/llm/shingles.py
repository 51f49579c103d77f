"""Word shingles of whole Arrow columns as 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Shingles:
    """Distinct shingles of n texts: text by text, ascending, with their counts."""

    hashes: np.ndarray  # uint64
    counts: np.ndarray
    starts: np.ndarray  # n + 1 places in hashes
    digests: list[bytes]  # 128 bits of the whole word sequence

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (lower case, letters and digits only; words without any are left out) and each text's start."""
    import xxhash

    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = lists.flatten().dictionary_encode()
    words = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\pL\pN]+", "").to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in words), np.uint64, len(words))
    h = hashed[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    keep = h != 0
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def shingles(texts: pa.Array, size: int = 5) -> Shingles:
    """Shingles of ``size`` words; a shorter text with words is one shingle; a text without words has none."""
    import xxhash

    h, at = word_hashes(texts)
    n = np.diff(at)
    digests = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            rolled = rolled * _P + h[k:len(h) - size + 1 + k]
        each = np.maximum(n - size + 1, 0)
        owner = np.repeat(np.arange(len(n)), each)
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(at[:-1], each)
        out = rolled[place]
        short = np.flatnonzero((n > 0) & (n < size))
        extra = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short.tolist()):
            for x in h[at[t]:at[t + 1]]:
                extra[i] = extra[i] * _P + x + np.uint64(1)
    out, owner = mixed(np.concatenate([out, extra])), np.concatenate([owner, short])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(out)))
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(n)))])
    return Shingles(out[first], counts, starts, digests)
