"""Tokenising whole Arrow columns through their distinct pieces.

A text is cut at spaces into pieces whose ids don't depend on what stands
around them, each distinct piece is encoded once, and the ids are gathered
back.  A cut before ``" x"`` with a visible ``x`` is always a boundary of the
byte-level pattern; texts with other runs of white space are cut by a regular
expression only where that holds.  A worker keeps the ids of recent pieces in
two generations of bounded size.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that doesn't stand right before a visible character.
ODD_SPACE = (r" ([\x00-\x20\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]|$)")
SAFE_CUT = re.compile("(?= [^\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff])")
#: The pre-tokenizer's pattern under which words are cut further (see ``PieceEncoder.words``).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A letter or digit that stays one when it is composed and lower-cased: punctuation behind it is a match of its own.
WORD_END = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]$"
#: Pieces of such letters alone are one match.
ONE_WORD = re.compile("[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u017f]+")
#: A piece of a byte-level vocabulary with the space before it and no other white space.
SPACED = re.compile(" [^\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]+")
#: Bytes inside a byte-level piece: letters and digits, punctuation, a line break; 0: any other.
WORD, MARK, BREAK = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[[ord(c) for c in string.punctuation]] = MARK
KIND[[ord(c) for c in string.ascii_letters + string.digits]] = WORD
KIND[0xC3:0xC6] = WORD  # first bytes of U+00C0 to U+017F, letters but for two
KIND[ord("\n")] = BREAK
CACHED_PIECES = 200_000
LONGEST_CACHED = 48


class PieceEncoder:
    """Encodes string arrays with ``encode`` (distinct pieces -> little-endian uint32 bytes each).

    ``leading_space``: a piece after the first of a text includes the space
    before it (byte-level vocabularies); otherwise spaces only separate.
    ``words``: line breaks separate too, ASCII pieces are lower-cased, and
    punctuation at the end of a word is a piece of its own.  ``parts``: pieces
    are cut further where the byte-level pattern always cuts (see ``cut_parts``).
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], leading_space: bool,
                 cached: int = CACHED_PIECES):
        self.encode_pieces, self.leading_space, self.cached = encode, leading_space, cached
        self.words = self.parts = False
        self.special: str | None = None  # texts that match are encoded by ``encode_whole``
        self.encode_whole: Callable[[str], list[int]] | None = None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, keys: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of distinct pieces, from the worker's store where they are in it."""
        young, old = self.young, self.old
        got = list(map(young.get, keys))
        missing = [i for i, v in enumerate(got) if v is None]
        unknown = []
        for i in missing:
            v = got[i] = old.get(keys[i])
            if v is None:
                unknown.append(i)
        for i, v in zip(unknown, self.encode_pieces([keys[i] for i in unknown]), strict=True):
            got[i] = v
        for i in missing:
            if len(keys[i]) <= LONGEST_CACHED:
                young[keys[i]] = got[i]
        if len(young) > self.cached:
            self.old, self.young = young, {}
        return got

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        if not self.leading_space:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " ") if self.words else texts, " ")
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        if not odd.any():
            return pc.split_pattern(texts, " ")
        rows = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        cut = []
        for t in texts.filter(pa.array(odd)).to_pylist():
            first, *rest = SAFE_CUT.split(t)
            if not first and rest:  # the text starts with a space before a visible character
                cut.append(["", *(x[1:] for x in rest)])
            else:
                cut.append([first, *(x[1:] for x in rest)])
        lists = pa.concat_arrays([pc.split_pattern(texts.filter(pa.array(~odd)), " "), pa.array(cut, pa.list_(pa.string()))])
        return lists.take(pa.array(np.argsort(rows, kind="stable")))

    def _word_ids(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after another and their numbers, through words and the punctuation behind them."""
        pieces = pc.if_else(pc.string_is_ascii(pieces), pc.ascii_lower(pieces), pieces)
        _, held, text = pieces.buffers()
        starts = np.frombuffer(held, np.int32)[pieces.offset:pieces.offset + len(pieces) + 1]
        stems = pc.ascii_rtrim(pieces, characters=string.punctuation)
        ends = starts[:-1] + pc.binary_length(stems).to_numpy()
        cut = pc.match_substring_regex(stems, WORD_END).to_numpy(zero_copy_only=False)
        offsets = np.empty(2 * len(pieces) + 1, np.int32)
        offsets[0::2], offsets[1::2] = starts, np.where(cut, ends, starts[1:])
        coded = pa.StringArray.from_buffers(2 * len(pieces), pa.py_buffer(offsets), text).dictionary_encode()
        ids, sizes = self._gathered(coded.dictionary.to_pylist(), coded.indices.to_numpy())
        return ids, sizes.reshape(-1, 2).sum(1)

    def _gathered(self, keys: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the keys at ``index`` one after another, and how many each has."""
        got = self.ids(keys)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        return _taken(np.frombuffer(b"".join(got), np.uint32), sizes, index), sizes[index]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (one more at the end)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.special is not None:
            whole = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
            if whole.any():
                return self._encode_with_whole(texts, whole)
        lists = self._pieces(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        if self.words:
            flat, sizes = self._word_ids(coded.dictionary)
            return _taken(flat, sizes, index), np.concatenate([[0], np.cumsum(sizes[index])])[offsets]
        keys = coded.dictionary
        if self.leading_space:
            index = index.copy()
            first, index_first = np.unique(index[offsets[:-1]], return_inverse=True)
            index[offsets[:-1]] = len(keys) + index_first
            keys = pa.concat_arrays([pc.binary_join_element_wise("", keys, " "), keys.take(pa.array(first))])
        if self.parts:
            cut = cut_parts(keys)
            coded = cut.flatten().dictionary_encode()
            flat, sizes = self._gathered(coded.dictionary.to_pylist(), coded.indices.to_numpy())
            ends = np.concatenate([[0], np.cumsum(sizes)])[cut.offsets.to_numpy()]
            sizes = np.diff(ends)
            return _taken(flat, sizes, index), np.concatenate([[0], np.cumsum(sizes[index])])[offsets]
        ids, sizes = self._gathered(keys.to_pylist(), index)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[offsets]

    def _encode_with_whole(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold the string of a special token are encoded whole, so that it becomes its one id."""
        rows = [None] * len(texts)
        ids, starts = self.encode(texts.filter(pa.array(~whole)))
        for i, a, b in zip(np.flatnonzero(~whole).tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rows[i] = ids[a:b]
        for i in np.flatnonzero(whole).tolist():
            rows[i] = np.array(self.encode_whole(texts[i].as_py()), np.uint32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def cut_parts(pieces: pa.StringArray) -> pa.ListArray:
    """Each piece as parts that the byte-level pattern matches independently of each other.

    Cuts stand before punctuation behind a letter or digit, before a line break
    behind either, and behind a line break alone between two of them.
    """
    _, held, text = pieces.buffers()
    starts = np.frombuffer(held, np.int32)[pieces.offset:pieces.offset + len(pieces) + 1]
    raw = np.frombuffer(text or b"", np.uint8)[starts[0]:starts[-1]]
    kind = KIND[raw]
    later = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC5)) + 1
    kind[later] = np.where((raw[later - 1] == 0xC3) & ((raw[later] & 0xDF) == 0x97), 0, WORD)  # times and divide are no letters
    cut = np.zeros(len(raw) + 1, bool)
    a, b = kind[:-1], kind[1:]
    seen = (a == WORD) | (a == MARK)
    cut[1:-1] = (a == WORD) & (b == MARK) | seen & (b == BREAK)
    first = np.zeros(len(raw) + 1, bool)
    first[starts - starts[0]] = True
    # a line break that is a part so far, followed by what is seen
    cut[2:-1] |= cut[1:-2] & ~first[1:-2] & (a[1:] == BREAK) & ((b[1:] == WORD) | (b[1:] == MARK))
    cut |= first
    ends = np.flatnonzero(cut)
    offsets = np.searchsorted(ends, starts - starts[0]).astype(np.int32)
    parts = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer((ends + starts[0]).astype(np.int32)), text or pa.py_buffer(b""))
    return pa.ListArray.from_arrays(pa.array(offsets), parts)


def _taken(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The lists of ``sizes`` that ``flat`` holds one after another, taken at ``index``."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).take(pa.array(index)).flatten().to_numpy()


def with_ends(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' ids with ``end_id`` after each text."""
    places = starts + np.arange(len(starts))
    out = np.empty(places[-1], ids.dtype)
    inner = np.ones(len(out), bool)
    inner[places[1:] - 1] = False
    out[inner], out[~inner] = ids, end_id
    return out, places


#: What stands between pieces that are encoded as one string: one token, cut off on both sides in both kinds of vocabulary.
SEPARATORS = {True: "\n", False: " | "}
#: Pieces that may be among them.  White space inside a word-end vocabulary's piece only parts words; inside a
#: byte-level piece a single line break between visible characters is one token, as the separator.
FIT = {True: re.compile(r" ?\S+(?:\n\S+)*"), False: re.compile(r"[^|]*")}


def cuts_parts(path: str) -> bool:
    """Whether a tokenizer file's texts are cut by the byte-level pattern alone, without a normalizer before it."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    before = held["pre_tokenizer"] or {}
    return (held["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) is True
            and before.get("add_prefix_space") is False)


def cuts_words(path: str) -> bool:
    """Whether a tokenizer file cuts words from punctuation after NFC and lower case, and marks the end of each match."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (held["normalizer"] or {}).get("normalizers", [])]
    split = next(iter((held["pre_tokenizer"] or {}).get("pretokenizers", [])), {})
    return (normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("invert") is True and split.get("behavior") == "Removed"
            and held["model"].get("end_of_word_suffix") == "</w>")


def tokenizer_pieces(path: str, leading_space: bool = True, words: bool = False) -> Callable[[list[str]], list[bytes]]:
    """Pieces by the tokenizers library, special tokens' strings as ordinary text.

    Pieces are encoded together as one string with separators where they fit, others by themselves.
    ``words``: pieces that are one match need no separator but a space; their last token says where they end.
    A byte-level piece that starts with its only space needs none: the token that holds the space says where it starts.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    between, fits = SEPARATORS[leading_space], FIT[leading_space].fullmatch
    [mark] = t.encode(between, add_special_tokens=False).ids

    last, start = np.zeros((2, t.get_vocab_size()), bool)
    if words:
        last[[i for token, i in t.get_vocab().items() if token.endswith("</w>")]] = True
    if leading_space:  # \u0120 is the byte-level spelling of a space
        start[[i for token, i in t.get_vocab().items() if token.startswith("\u0120")]] = True

    def alone(piece: str) -> bytes:
        return np.array(t.encode(piece, add_special_tokens=False).ids, np.uint32).tobytes()

    def together(pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        ids = np.array(t.encode_batch_fast([between.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == mark)
        own = np.array([p.count("\n") for p in pieces]) if leading_space else np.zeros(len(pieces), np.int64)
        if len(cuts) != own.sum() + len(pieces) - 1:
            return [alone(p) for p in pieces]
        raw = ids.tobytes()
        cuts = (cuts[np.cumsum(own + 1)[:-1] - 1] * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)]

    def one_match_each(pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        ids = np.array(t.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            return [alone(p) for p in pieces]
        raw, ends = ids.tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def one_space_each(pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        ids = np.array(t.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        starts = np.flatnonzero(start[ids])
        if len(starts) != len(pieces) or starts[0]:
            return [alone(p) for p in pieces]
        raw, starts = ids.tobytes(), (starts * 4).tolist()
        return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]

    def encode(pieces: list[str]) -> list[bytes]:
        if not words and not leading_space:
            return in_parts(pieces)
        plainly, each = (ONE_WORD, one_match_each) if words else (SPACED, one_space_each)
        one = [plainly.fullmatch(p) is not None for p in pieces]
        plain = [p for p, w in zip(pieces, one, strict=True) if w]
        found = iter([x for at in range(0, len(plain), 20_000) for x in each(plain[at:at + 20_000])])
        rest = iter(in_parts([p for p, w in zip(pieces, one, strict=True) if not w]))
        return [next(found) if w else next(rest) for w in one]

    def in_parts(pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), 20_000):
            part = pieces[at:at + 20_000]
            odd = {i for i, p in enumerate(part) if fits(p) is None}
            found = together([p for i, p in enumerate(part) if i not in odd] if odd else part)
            if odd:
                rest = iter(found)
                found = [alone(p) if i in odd else next(rest) for i, p in enumerate(part)]
            out += found
        return out

    return encode


@lru_cache(maxsize=4)
def tokenizer_encoder(path: str, leading_space: bool) -> PieceEncoder:
    """One encoder a worker and vocabulary file; strings of special tokens become their ids, as in the library's plain call."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        special = [re.escape(x["content"]) for x in json.load(f)["added_tokens"]]
    plain = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))  # few texts hold such a string
    words = not leading_space and cuts_words(path)
    encoder = PieceEncoder(tokenizer_pieces(path, leading_space, words), leading_space)
    encoder.words, encoder.parts = words, leading_space and cuts_parts(path)
    if special:
        encoder.special, encoder.encode_whole = "|".join(special), lambda text: plain().encode(text, add_special_tokens=False).ids
    return encoder
