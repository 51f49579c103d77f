"""Byte-level BPE, token files and packing against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from episodic.llm import bpe, packing, token_files
from episodic.llm.pieces import tokenizer_encoder

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a  b", " a", "a ", "\n\n x  \n y\t z", "a\u3000b \u00a0 c", "don't  we'll 12345 \u0661\u0662", "a \x1c b\x85 c",
       "\ud7ff \U0001f600\U0001f600  \U0001f600", "\n a", "foo\n bar", "foo\n\n  bar <|endoftext|> x", "a <|startoftext|>b<|endoftext|> | c|d", "x" * 50_000, "ab " * 20_000]
SCHEMA = "lang string, doc_id long, text string, n_tokens int, start string, ids string"


def docs(spark, texts):
    rows = [("xx", i, t, 7, "s", "i") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def tiktoken_encoding():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_bpe_equals_tiktoken(spark):
    e = tiktoken_encoding()
    frame = docs(spark, [*ODD, None, "same", "same"]).union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "lang", "doc_id + 1000", "text", "1", "''", "''"))
    got = bpe.digest_documents(frame, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    text = {r.doc_id: r.text or "" for r in frame.collect()}
    assert len(got) == len(text)
    for r in got:
        ids = e.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_bpe_ids_and_empty_table(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    frame = docs(spark, ["hello there", None])
    got = {r.doc_id: r for r in bpe.encode_documents(frame, path, public_tokenizers.PATTERN).collect()}
    assert got[0].ids == tiktoken_encoding().encode_ordinary("hello there") and bytes(got[0].decoded) == b"hello there"
    assert got[1].ids == [] and bytes(got[1].decoded) == b""
    assert bpe.encode_documents(frame.where("false"), path, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\u00a0\u0301e.'s1\U0001f600", max_size=40), max_size=5))
def test_pieces_equal_whole_texts(texts):
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        ids, at = tokenizer_encoder(public_tokenizers.path(name), spaced).encode(pa.array(texts, pa.string()))
        t = tokenizer(name)
        for k, x in enumerate(texts):
            assert ids[at[k]:at[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=6), unique=True, max_size=300))
def test_perfect_hash(keys):
    h = bpe.PerfectHash(keys)
    assert h.lookup(keys).tolist() == list(range(len(keys)))
    assert sorted(h.order.tolist()) == list(range(len(keys)))
    assert (h.lookup([b"stranger" + k for k in keys]) == -1).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=1200))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    e, _ = token_files.EliasFano.read(memoryview(token_files.EliasFano.build(np.array(values, np.int64)).to_bytes()), 0)
    assert e.select_range(0, len(values)).tolist() == values
    for i, j in ((0, 1), (len(values) // 3, len(values) // 2), (511, 513), (512, 1024), (len(values), len(values))):
        if j <= len(values):
            assert e.select_range(i, j).tolist() == values[i:j]
    assert [e.select(i) for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_near_minimal():
    n, u = 100_000, 1 << 32
    values = np.sort(np.random.default_rng(1).integers(0, u, n))
    bits = 8 * len(token_files.EliasFano.build(values).to_bytes()) / n
    assert bits < 2 + np.log2(u / n) + 1.1  # against 64 of a table


def expected_files(rows):
    t, at, out = tokenizer("word_bpe_49k.json"), 0, []
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_of_documents(spark):
    got = sorted(tuple(r) for r in token_files.op5_token_files(spark, SF).collect())
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert got == expected_files(rows)


def test_token_files_odd_rows(spark, tmp_path):
    frame = docs(spark, ODD[:14]).selectExpr("text", "doc_id * 5 - 20 as doc_id", "start").union(
        spark.createDataFrame([("no id", None, ""), (None, 3, ""), ("b", 9, ""), ("b", 9, "")], "text string, doc_id long, start string"))
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(frame, f"file://{tmp_path}/f", path, file_ids=40)
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert manifest.count() > 3  # several files
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, f"file://{tmp_path}/f", manifest).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == expected_files(rows)
    names = sorted(tmp_path.joinpath("f").glob("part-*.tok"))
    f = token_files.TokenFile(names[0].read_bytes())
    assert f.doc_id(0) is None and f.ids(0).tolist()[-1] == 1
    assert [f.doc_id(k) for k in range(f.n)] == f.doc_ids(0, f.n)
    assert token_files.write_token_files(frame.where("false"), f"file://{tmp_path}/g", path).count() == 0


def check_packing(got, lengths, tokens):
    """Pieces cover each example once and fill sequences without gaps."""
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, n in lengths.items():
        at = 0
        for a, k in sorted(by_doc.get(d, [])):
            assert a == at and k > 0
            at += k
        assert at == n
    for pieces in by_seq.values():
        at = 0
        for a, k in sorted(pieces):
            assert a == at
            at += k
        assert at <= tokens
    return by_seq


def test_packing_documents(spark):
    got = packing.op1_packing(spark, SF).collect()
    t = tokenizer("byte_bpe_50k.json")
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_seq = check_packing(got, {d: len(x) for d, x in ids.items()}, 2048)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
    partitions = len({s >> 40 for s in by_seq})
    assert sum(len(x) for x in ids.values()) > 2048 * (len(by_seq) - partitions)  # one sequence a partition is open


@pytest.mark.parametrize("segments,loss,pool", [(4, 64, 8), (3, 200, 50), (100, 1, 16)])
def test_packing_three_limits(spark, segments, loss, pool):
    g = np.random.default_rng(segments)
    rows = [(i, list(range(n)), int(g.integers(0, n + 3)), "x") for i, n in enumerate([0, 1, 1, 300, *g.integers(1, 150, 120).tolist()])]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss_start long, length string").repartition(2)
    got = packing.pack(frame, tokens=128, segments=segments, loss=loss, pool=pool, with_ids=True).collect()
    by_seq = check_packing(got, {r[0]: len(r[1]) for r in rows}, 128)
    starts = {r[0]: r[2] for r in rows}
    bearing = {}
    for r in got:
        assert r.ids == list(range(r.start, r.start + r.length))
        end = r.start + r.length
        bearing[r.sequence_id] = bearing.get(r.sequence_id, 0) + end - min(end, max(r.start, starts[r.doc_id]))
    assert max(bearing.values()) <= loss and max(map(len, by_seq.values())) <= segments


def test_packing_nulls_repeats_and_empty(spark):
    frame = docs(spark, ["same", "same", None, "word " * 9000]).withColumn("doc_id", F.expr("nullif(doc_id, 1)"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(frame, tokenizer=path).collect()
    assert {r.doc_id for r in got} == {0, None, 2, 3}
    assert [r.length for r in got if r.doc_id == 2] == [1]  # the end id alone
    assert packing.pack(frame.where("false"), tokenizer=path).count() == 0


def test_words_with_punctuation_are_encoded_once_and_as_the_library_does():
    """Words in either case, with punctuation or line breaks around them, reach the library as one piece."""
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, enc = Tokenizer.from_file(path), tokenizer_encoder.__wrapped__(path, False)
    rng = random.Random(5)
    parts = ["Word", "straße", "I\u0307", "\u0130", "H\u0331", "e\u0301", "\u0149", "\u0338", "\u0301", "don't", "'s", "'", "x'", "\u2026", "\u00bb", "7", "\u00b2", "\u03a3",
             "=", "<", ".", ",", "...", "_", "|", " | ", "%", "</w>", "\n", "\t", "\r\n", "\u00a0", "\u2028", " ", "  ", "\u1100\u1161", "中文", "\x00", "A", "ſ", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    ids, at = enc.encode(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)

    enc, asked = tokenizer_encoder.__wrapped__(path, False), []
    library = enc.encode_pieces
    enc.encode_pieces = lambda keys: asked.extend(keys) or library(keys)
    enc.encode(pa.array(["Word word. word,\nWORD: (word word!?"], pa.string()))
    assert sorted(asked) == ["", "!?", "(word", ",", ".", ":", "word"]


def test_byte_level_pieces_are_cut_where_the_pattern_always_cuts():
    """Words with punctuation, contractions or line breaks around them reach the library once, and without separators."""
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, enc = Tokenizer.from_file(path), tokenizer_encoder.__wrapped__(path, True)
    rng = random.Random(5)
    parts = ["word", "Word", "straße", "Ÿ", "ſ", "×", "÷", "×'s", "don't", "'s", "'ll", "'", "_", "7", "7's", "١", "́", "̸", "=", ".", "...", "(", "…",
             "\n", "\n\n", "\r\n", "\t", "\x85", " ", " ", "​", " ", " ", " ", " ", "  ", "中文", "\x00", "Ġ", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    ids, at = enc.encode(pa.array(["before", *texts], pa.string()).slice(1))
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)

    enc, asked = tokenizer_encoder.__wrapped__(path, True), []
    library = enc.encode_pieces
    enc.encode_pieces = lambda keys: asked.extend(keys) or library(keys)
    enc.encode(pa.array(["a word word. word,\nWord (word!? word's wor\n\nd"], pa.string()))
    assert sorted(asked) == sorted(["a", " a", " word", ".", ",", "\n", "Word", " (word", "!?", "'s", " wor", "\n\nd"])
