"""Near-duplicate documents, toxicity and secrets against brute force and held-out rows."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from episodic.llm import secrets, toxicity, weighted_minhash
from episodic.llm.components import components
from episodic.llm.shingles import shingles

SF = "/root/testdata/sf0.001"
SCHEMA = "key string, doc_id long, text string, class_id string, rep long, n_chars long"


def documents(spark, texts, first=0):
    return spark.createDataFrame([("k", first + i, t, "c", 1, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def counted(text):
    words = [w for w in (re.sub(r"[\W_]+", "", x) for x in (text or "").lower().split()) if w]
    if not words:
        return collections.Counter()
    return collections.Counter(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))


def brute_classes(rows):
    """Classes by all pairs: equal word sequences, or weighted Jaccard of at least 0.8."""
    sh = {i: counted(t) for i, t in rows}
    df, n = collections.Counter(s for c in sh.values() for s in c), len(rows)
    w = {i: {s: k * (1 + math.log((n + 1) / (max(df[s], n / 20) + 1))) for s, k in c.items()} for i, c in sh.items()}
    root = {i: i for i in sh}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sh), 2):
        if sh[a] and sh[b] and find(a) != find(b):
            both = sum(min(v, w[b].get(s, 0)) for s, v in w[a].items())
            if both >= 0.8 * (sum(w[a].values()) + sum(w[b].values()) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sh}


def planted():
    """Copies, near copies of one text, a chain in which only neighbours are alike, a passage that many share, and odd rows."""
    g = random.Random(4)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)] * 30
    for _ in range(150):
        t = list(base)
        t[g.randrange(120)] = word()
        texts.append(" ".join(t))
    chain = [word() for _ in range(100)]
    for k in range(12):
        chain = [*chain[4:], *(word() for _ in range(4))]
        texts.append(" ".join(chain))
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(60)]) for _ in range(60)]
    texts += [" ".join(word() for _ in range(80)) for _ in range(60)]
    return [*texts, None, "", "  \n", "one", "One!", "two words", "... !!", "x " * 30_000, "x " * 30_000]


def test_near_duplicates_equal_brute_force(spark):
    frame = documents(spark, planted())
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = {r.doc_id: (r.class_id, r.kept) for r in weighted_minhash.near_duplicates(frame).collect()}
    want = brute_classes(rows)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(kept == (c == i) for i, (c, kept) in got.items())


def test_near_duplicates_with_small_blocks(spark, monkeypatch):
    for name, value in (("STAR", 7), ("BLOCK", 5)):
        monkeypatch.setattr(weighted_minhash, name, value)
    frame = documents(spark, planted())
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(frame).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in frame.collect()])


def test_near_duplicates_of_a_table(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.class_id for r in weighted_minhash.op7_minhash_dedup(spark, SF).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in frame.collect()])


def test_deduplicate_nulls_repeats_and_empty(spark):
    frame = documents(spark, ["a b c d e f", "a b c d e f", None]).union(spark.createDataFrame(
        [("k", None, "a b c d e f", "c", 1, 1), ("k", 0, "a b c d e f", "c", 1, 1)], SCHEMA))
    kept = weighted_minhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 0), (False, 0), (False, 2), (True, None)]
    assert weighted_minhash.near_duplicates(frame.where("false")).count() == 0


def test_shingles_equal_plain_counting():
    texts = ["a b c d e f a b c d e f", "A, b c. d! e", "one two", None, "", "? !"]
    s = shingles(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert sorted(s.counts[s.starts[k]:s.starts[k + 1]].tolist()) == sorted(counted(t).values())


def test_samples_agree_as_the_similarity():
    g = np.random.default_rng(2)
    agree, want = [], []
    for _ in range(30):
        h = np.sort(g.integers(0, 1 << 63, 400, dtype=np.uint64))
        shared = g.random() * 0.5 + 0.4
        other = np.where(g.random(400) < shared, h, g.integers(0, 1 << 63, 400, dtype=np.uint64))
        other.sort()
        wa, wb = np.ones(400, np.float32) * 2, np.ones(400, np.float32) * 2
        keys = [weighted_minhash.band_keys(weighted_minhash.Shingles(x, np.ones(400), np.array([0, 400]), []), w)[0] for x, w in ((h, wa), (other, wb))]
        agree.append((keys[0] == keys[1]).mean())
        want.append(weighted_minhash.similarity(h, wa, other, wb) ** weighted_minhash.ROWS)
    assert abs(np.mean(agree) - np.mean(want)) < 0.05


def test_components(spark):
    g = random.Random(1)
    pairs = [(g.randrange(300), g.randrange(300)) for _ in range(170)] + [(0, k) for k in range(400, 480)] + [(k, k + 1) for k in range(500, 540)]
    pairs += [(1000, 1000), (None, 5), (7, None), pairs[0]]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = root.setdefault(a, {a}), root.setdefault(b, {b})
            if ra is not rb:
                ra |= rb
                for x in rb:
                    root[x] = ra
    assert got == {x: min(s) for x, s in root.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- toxicity -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def toxic_model(toxic_tables):
    return toxicity.train(*toxic_tables)


def test_toxicity_on_the_held_out_fold(spark, toxic_tables, toxic_model):
    docs, labels = toxic_tables
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxic_model).collect()}
    held = {r.doc_id for r in docs.where(toxicity.held_out("doc_id")).collect()}
    rows = [(scored[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in held]
    hit = sum(s >= 0.3 and t == 1 for s, t in rows)
    assert hit / sum(s >= 0.3 for s, _ in rows) > 0.85
    assert hit / sum(t for _, t in rows) > 0.55  # the labels are noisy: a third of the toxic ones here show no insult
    assert all(0 <= s <= 1 for s, _ in rows)


def test_inserted_and_gapped_spellings(toxic_model):
    plain = toxic_model.decisions(["the", "onreor", "heanan", "tionerst", "reoushat"])
    for insults in (["idiot", "stupid", "worthless"], ["idxiot", "stuqpid", "worth*less"], ["id-iot", "stup.id"]):
        assert toxic_model.decisions(insults).min() > plain.max()
    scores = toxic_model.scores(pa.array(["Of the i d i o t ereon i d i o t and i d i o t", "Of the a b c d e ereon", "", None, "of the idiot in " * 2000], pa.string()).fill_null(""))
    assert scores[0] > scores[1] and scores[2] == scores[3] < 0.3 and scores[4] >= 0.3


def test_decisions_equal_the_kernel(toxic_model):
    words = ["idiot", "a", "worthlessness", "x" * 60, "thé", "stupidstupidstupid", "x.y.z"]
    for w, got in zip(words, toxic_model.decisions(words), strict=True):
        if len(w) <= toxicity.LONGEST and len(w) > 1:
            _, u, x = toxicity.occurrences([w])
            assert got == pytest.approx(float((toxic_model.weights[u] * x).sum()) + toxic_model.bias, abs=1e-4)


def test_toxicity_odd_rows(spark, toxic_model):
    frame = documents(spark, [None, "", "idiot " * 50_000, "The of.", "The of."]).withColumn("doc_id", pytest.importorskip("pyspark").sql.functions.expr("nullif(doc_id, 3)"))
    got = toxicity.score(frame, toxic_model).collect()
    assert len(got) == 5 and {r.doc_id for r in got} == {0, 1, 2, 4, None}
    clean = toxicity.without_toxic(frame, toxic_model)
    assert clean.columns == frame.columns and clean.count() == 4
    assert clean.where("text is null").count() == 1
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(frame, empty) is None
    assert {r.score for r in toxicity.score(frame, None).collect()} == {0.0}
    assert toxicity.score(frame.where("false"), toxic_model).count() == 0
    one_class = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(frame, one_class) is None


# ---- secrets --------------------------------------------------------------------------------------------------


def plain_base(text):
    """The base rules as the contract states them, without any filter before."""
    out = [(*m.span(), "assign") for m in re.finditer(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text) if len(m[2]) >= 6]
    out += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


HEX40 = "0123456789abcdef0123456789abcdef01234567"
ODD = ["password=hunter22", "PassWord : 'abcdef'", "passwd=short", "api_key==abcdef", "apikey:   \"a.b-c_d/e+f=\"", "token=token=abcdefgh", "AKIA" + "A1" * 8,
       "xAKIA" + "AKIA" * 4, "AKIAAAAA", HEX40, "é" * 5 + HEX40[:24], HEX40[:23], "secret=\n" + HEX40, "ſecret=abcdefgh", "toKen=abcdefgh", "", "token:abcdef" * 3,
       "word " * 40_000 + "password=abcdef1", "secret = '" + HEX40 + "' token: " + HEX40]


@pytest.fixture(scope="module")
def secret_model(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_base_spans(spark, secret_model):
    frame = documents(spark, [*ODD, None, ODD[0], ODD[0]]).union(
        spark.read.parquet(f"{SF}/documents.parquet").selectExpr("'k'", "doc_id + 1000", "text", "''", "1L", "n_chars"))
    text = {r.doc_id: r.text or "" for r in frame.collect()}
    got = secrets.scan(frame, secret_model).collect()
    assert len(got) == len(text)
    for r in got:
        want = plain_base(text[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k in want) for x in ("assign", "access", "hex"))
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("crf")] == (joined.split(",") if joined else [])
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_viterbi_equals_all_paths(secret_model):
    g = np.random.default_rng(3)
    for _ in range(40):
        n = int(g.integers(1, 7))
        e = g.normal(size=(n, 3)) * 6
        e[:, 0] += g.choice([0, 4, 30], n)
        best = max(itertools.product(range(3), repeat=n), key=lambda p: secret_model.first[p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(
            secret_model.step[a, b] for a, b in zip(p, p[1:])))
        assert secret_model.viterbi(e).tolist() == list(best)


def test_column_scan_equals_whole_decoding(spark, secret_model):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts = [t[:4000] for t in texts] + [*ODD[:17], " \t a = \"" + HEX40 + "\"  \n", "x"]
    flagged = secret_model.suspicious(pa.array(texts))
    assert flagged
    for i, t in enumerate(texts):
        assert (secret_model.spans_at(t, *flagged[i]) if i in flagged else []) == secret_model.spans(t)


def test_model_adds_what_the_rules_miss(secret_model):
    for text in ('the of key = "ce0cc631f6559e745b37" and thon', 'heer auth = "ce0cc631f6559e745b37cb" of and'):
        found = secrets.all_spans(pa.array([text]), secret_model)[0]
        assert found[0] == [] and [text[a:b] for a, b, _ in found[1]] == [text.split('"')[1]]
    assert secrets.all_spans(pa.array(["Of the 12 onnd from 108.51.216.133 to a@b.example of 2024 in."]), secret_model)[0] == ([], [])


def test_training_windows_of_rare_and_frequent_secrets(spark, monkeypatch):
    """One document with a secret among many trains the model; where all have some, windows without are there as well."""
    taken = []
    monkeypatch.setattr(secrets, "fit", taken.extend)
    words = "plain words of no interest 12 and 34 more of them "
    for k in range(3):
        secrets.train(documents(spark, [words * 5 + ("password=hunter22" if i == 500 + k else "") for i in range(2000)]), sample=20, most_windows=30)
        assert sum(bool(tags.any()) for _, tags in taken) == 1 and sum(not tags.any() for _, tags in taken) == 30
        taken.clear()
    secrets.train(documents(spark, [words * 5 + f"password=hunter{i} " + words * 5 for i in range(200)]), sample=100, most_windows=30)
    assert sum(bool(tags.any()) for _, tags in taken) == 30 and sum(not tags.any() for _, tags in taken) == 30
    taken.clear()
    nameless = documents(spark, [words + f"token: abcdef{i}" for i in range(4)]).selectExpr("cast(null as long) as doc_id", "text")
    secrets.train(nameless, sample=2)
    assert any(tags.any() for _, tags in taken)


def test_masked_documents(spark, secret_model):
    frame = documents(spark, ["a password=abcdef12 b", None, "clean text"])
    got = secrets.without_secrets(frame, secret_model)
    assert got.columns == frame.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].text == "a [SECRET] b" and rows[0].n_chars == len(rows[0].text)
    assert rows[1].text is None and rows[2].text == "clean text"
    assert secrets.without_secrets(frame.where("false"), secret_model).count() == 0
    assert secrets.train(documents(spark, ["no such thing", None])) is None
    assert secrets.scan(documents(spark, ["password=abcdef12", None]), None).count() == 2
