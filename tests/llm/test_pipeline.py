"""The pipeline's stages one by one on a small table, and the guard around them."""

import subprocess
import sys
from unittest.mock import MagicMock

import corpus_pipeline
import pyarrow as pa
from episodic.llm import packing, secrets, toxicity
from episodic.llm.pieces import tokenizer_encoder
from pyspark.sql import Row

from .test_documents import brute_classes, plain_base
from .test_tokens import check_packing, tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.3").collect()}
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect()} - rejected

    single = stage["near_duplicates"](spark, clean, SF)
    assert single.columns == docs.columns
    kept = {r.doc_id: r.text for r in single.collect()}
    assert set(kept) == set(brute_classes(sorted(rows.items())).values())

    masked = stage["secrets"](spark, single, SF)
    assert masked.columns == docs.columns
    safe = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    assert set(safe) == set(kept)
    for d, (text, n) in safe.items():
        assert plain_base(text) == [] and n == len(text)
        assert (text == kept[d]) == (secrets.MASK not in text)
        assert (secrets.MASK in text) >= bool(plain_base(kept[d]))

    got = stage["packing"](spark, masked, SF).collect()
    t = tokenizer("byte_bpe_50k.json")
    check_packing(got, {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, (x, _) in safe.items()}, 2048)
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "length").collect())


def test_the_rest_works_without_this_folder(tmp_path):
    root = corpus_pipeline.__file__.rsplit("/", 1)[0]
    code = ("import sys; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, %r); import __spark_entry__ as e;"
            "assert 'pipeline' not in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())" % root)
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


class Taken:
    """A table that keeps the function its rows would go through."""

    columns, schema = ["doc_id", "text", "n_chars"], None

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):
        self.work = work
        return self


def test_masking_gives_rows_on_slice_by_slice(monkeypatch):
    """A task holds the tokens and the new texts of a slice, not those of a whole batch."""
    texts = ["a password = hunter2Xk9 b", None, "x" * 300, "ordinary words", "token: abcdef12", ""] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array(texts), pa.array([None if t is None else len(t) for t in texts], pa.int32())],
                                       names=Taken.columns)
    monkeypatch.setattr(secrets, "SLICE_BYTES", 1000)
    got = list(secrets.without_secrets(Taken(), None).work(iter([batch])))
    assert len(got) > 5
    assert all(b.schema == batch.schema and b.num_rows <= 20 for b in got)
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(120))
    assert [r["text"] for r in rows] == ["a [SECRET] b", None, "x" * 300, "ordinary words", "[SECRET]", ""] * 20
    assert [r["n_chars"] for r in rows] == [None if r["text"] is None else len(r["text"]) for r in rows]


def test_packing_encodes_slices_and_loads_one_tokenizer(monkeypatch):
    import public_tokenizers
    import tokenizers

    loaded, sizes = [], []

    class Counted:
        @staticmethod
        def from_file(path):
            loaded.append(path)
            return from_file(path)

    from_file = tokenizers.Tokenizer.from_file
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    enc = tokenizer_encoder.__wrapped__(public_tokenizers.path("byte_bpe_50k.json"), True)
    enc.encode(pa.array(["some words, and more"]))
    assert len(loaded) == 1
    ids, at = enc.encode(pa.array(["a <|endoftext|> b", "c"]))
    assert ids[at[0]:at[1]].tolist() == tokenizer("byte_bpe_50k.json").encode("a <|endoftext|> b", add_special_tokens=False).ids

    whole = enc.encode
    monkeypatch.setattr(enc, "encode", lambda texts: sizes.append(sum(len(t) for t in texts.to_pylist())) or whole(texts))
    monkeypatch.setattr(packing, "tokenizer_encoder", lambda path, spaced: enc)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    monkeypatch.setattr(packing, "F", MagicMock())
    texts = ["word " * 40_000] * 60  # 12 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts), pa.array([0] * 60, pa.int64())], names=["doc_id", "text", "loss_start"])
    got = [r for b in packing.pack(Taken(), tokenizer="t").work(iter([batch])) for r in b.to_pylist()]
    check_packing([Row(**r) for r in got], {d: 40_002 for d in range(60)}, 2048)
    assert max(sizes) <= 4_000_000 and sum(sizes) == 12_000_000
