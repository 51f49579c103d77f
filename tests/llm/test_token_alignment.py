"""Token alignment against the libraries and a plain merge of byte ends."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from episodic.llm import token_alignment as ta

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_groups(a, b):
    both = sorted(set(a) & set(b))
    return [a.index(x) + 1 for x in both], [b.index(x) + 1 for x in both]


def brute(texts):
    """Rows of the contract, and the token ids and groups of each text."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    entries = ta.byte_level_entries(A)
    docs, count = [], collections.Counter()
    for x in texts:
        a = t.encode(" " + x, add_special_tokens=False).ids if x else []
        b = sp.encode(x) if x else []
        of_a = [entries[i] for i in a]
        of_b = [bytes([i - 3]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not x or not b"".join(of_a) == b"".join(of_b) == (" " + x).encode():
            docs.append(([], [], []))
            continue
        ends = [[sum(map(len, side[:k + 1])) for k in range(len(side))] if len(side) < 2000 else [] for side in (of_a, of_b)]
        ga, gb = plain_groups(*ends)
        docs.append((a, b, [(a[i:j], b[p:q]) for i, j, p, q in zip([0, *ga], ga, [0, *gb], gb)]))
        count.update({(x, y) for g, h in docs[-1][2] for x in g for y in h})
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups in docs:
        links = [(x, y) for g, h in groups for x in g for y in h]
        told = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(told.encode()).hexdigest() if a else ""))
    return out, docs, count, best


def texts():
    g = random.Random(3)
    parts = ["hello", " ", "  ", "\n", "\t", "é", "日本", "▁", "<0x41>", "</s>", "<|endoftext|>", "a", "\xa0", "　", "word ", "the quick", "don't",
             "123", "ß", "\x00", "​", "😀", "x y", " .", "\r\n", "﻿", "ﬁ"]
    out = [None, "", " ", "  ", "a", "▁", "tie tie", "tie tie", " lead", "trail "]
    return out + ["".join(g.choice(parts) for _ in range(g.randrange(1, 14))) for _ in range(1500)]


def test_summary_counts_and_groups(spark):
    rows = texts()
    frame = spark.createDataFrame([(t, i, "x") for i, t in enumerate(rows)], "text string, doc_id long, slice string").repartition(5)
    want, docs, count, best = brute(rows)
    got = {r.doc_id: tuple(r)[1:] for r in ta.link_summary(frame, A, B).collect()}
    assert [got[i] for i in range(len(rows))] == want
    pairs = {(r.a, r.b): (r.n_docs, r.best) for r in ta.link_counts(frame, A, B).collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in count.items()}
    for r in ta.align_documents(frame, A, B).collect():
        a, b, groups = docs[r.doc_id]
        ends = [(0, 0), *((g.a_end, g.b_end) for g in r.groups)]
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [(a[p:q], b[x:y]) for (p, x), (q, y) in zip(ends, ends[1:])] == groups


def test_whole_table_long_text_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").select("doc_id", "text")
    rows = docs.collect()
    got = {r.doc_id: tuple(r)[1:] for r in ta.link_summary(docs, A, B).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])[0]
    assert ta.op12_token_alignment(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    long = spark.createDataFrame([(None, "w" * 20_000 + " sevenscore" * 30_000), (4, None)], "doc_id long, text string")
    first, second = ta.link_summary(long, A, B).orderBy("doc_id").collect()
    assert first.n_groups > 30_000 and first.n_links == first.n_best and tuple(second) == (4, 0, 0, 0, 0, 0, 0, "")
    assert ta.link_summary(long.where("false"), A, B).count() == 0


@pytest.mark.parametrize("density", [0.05, 0.5, 0.95])
def test_runs_are_jumped(density):
    g = random.Random(5)
    for n in (1, 2, 7, 300):
        a = sorted({n, *(x for x in range(1, n) if g.random() < density)})
        b = sorted({n, *(x for x in a if g.random() < 0.9), *(x for x in range(1, n) if g.random() < density / 8)})
        assert ta.align(a, b) == plain_groups(a, b)
    same = list(range(1, 100_001))
    assert ta.run_length(same, same, 0, 0) == 100_000
    assert ta.run_length([0, *same], same, 1, 0) == 100_000
