"""Removal of repeated strings against counting every string."""

import collections
import hashlib
import random

import numpy as np
import pytest

from episodic.llm import suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r) + 1)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(gone[i] and not gone[i - 1] for i in range(len(r)))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def by_row(frame, n):
    got = {r.doc_id: tuple(r)[1:5] for r in frame.collect()}
    return [got[i] for i in range(n)]


@pytest.mark.parametrize(("alphabet", "part"), [("ab", 4_000_000), ("abcdefé ", 4_000_000), ("abcdefé ", 200)])
def test_equals_counting(spark, alphabet, part):
    g = random.Random(len(alphabet) + part)
    pool = ["".join(g.choice(alphabet) for _ in range(n)) for n in (30, 45, 60, 150, 400, 900)]
    texts = [None, "", None, pool[0], "x" * 500, "x" * 39, "y" * 40, "y" * 40, "z" * 40, pool[5], pool[5], pool[5][7:]]
    for _ in range(120):
        texts.append("".join(g.choice(pool)[g.randrange(20):] if g.random() < 0.5 else "".join(g.choice(alphabet) for _ in range(g.randrange(80)))
                             for _ in range(g.randrange(1, 5))))
    rows = spark.createDataFrame([(t, i, 1) for i, t in enumerate(texts)], "text string, doc_id long, first int")
    assert by_row(suffix_dedup.remove_repeats(rows, 40, part=part), len(texts)) == brute(texts, 40)


def test_hot_stretch_and_whole_query(spark):
    """A passage in half of all documents, each with words of its own around it."""
    g = random.Random(4)
    passage = "".join(g.choice("abcdefghij ") for _ in range(700))
    word = lambda: "".join(g.choice("klmnopqrst") for _ in range(200))
    texts = [word() + (passage if i % 2 else "") + word() for i in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_row(suffix_dedup.remove_repeats(rows.repartition(16)), 400)
    assert got == brute(texts, 400) and all(r[1] >= 700 for r in got[1::2]) and not any(r[1] for r in got[::2])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    whole = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op13_suffix_dedup(spark, SF).collect()}
    assert [whole[r.doc_id] for r in docs] == brute([r.text for r in docs], 400)


def test_spans_empty_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "q" * 50), (3, "ab" + "q" * 41), (3, "short")], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove_repeats(rows, 40, with_text=True).collect()}
    assert bytes(got[3, 43].kept) == b"ab" and [tuple(s) for s in got[3, 43].spans] == [(2, 43)]
    assert got[None, 50].n_removed == 50 and bytes(got[3, 5].kept) == b"short"
    assert suffix_dedup.remove_repeats(rows.where("false"), 40).count() == 0


def test_sort_by_tokens():
    g = np.random.default_rng(2)
    tokens = [g.integers(0, k, 500) for k in (3, 4, 60)]
    order, common = suffix_dedup.sort_suffixes([t.copy() for t in tokens])
    rows = [tuple(int(t[i]) for t in tokens) for i in order]
    assert rows == sorted(rows)
    assert common.tolist() == [0] + [next((d for d in range(3) if a[d] != b[d]), 3) for a, b in zip(rows, rows[1:])]
