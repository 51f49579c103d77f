"""The conversation trie against its SQL, and its fat binary search against plain prefixes."""

import random

import duckdb
import pytest

from episodic.llm import prefix_trie as pt

SF = "/root/testdata/sf0.001"
SCHEMA = "depth int, conv_id long, turn long, role string, text string"


def both(frame, tmp_path):
    frame.write.mode("overwrite").parquet(str(tmp_path / "c"))
    stored = frame.sparkSession.read.parquet(str(tmp_path / "c"))
    with duckdb.connect() as c:
        c.execute(f"create view conversations as select * from read_parquet('{tmp_path}/c/*.parquet')")
        want = sorted(map(tuple, c.execute(pt.SQL).fetchall()), key=str)
    return sorted((tuple(r) for r in pt.prefix_trie(stored.repartition(5)).collect()), key=str), want


def conversations(seed):
    g = random.Random(seed)
    rows = []
    for c in [*range(-25, 70), 1000, 1001, 10**12]:
        for t in range(60 if c == 7 else g.choice([0, 1, 2, 3, 5, 9])):
            rows.append((1, c, g.choice([t, t, t, None, 3]), g.choice(["u", "a", None]), g.choice(["x", "y y", "", "a b  c\td", None])))
    return [*rows, (1, None, 1, "u", "x"), *rows[:9]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sql(spark, tmp_path, seed):
    got, want = both(spark.createDataFrame(conversations(seed), SCHEMA), tmp_path)
    assert got == want and len(got) > 150


def test_hot_conversation_and_copies(spark, tmp_path):
    """A conversation of a third of all turns, and one that stands under a third of all ids."""
    rows = [(0, 41, t, "u", f"word {t % 7}") for t in range(300)]
    rows += [(0, c, t, "u", "same words here" if c % 3 else f"own {c}") for c in range(100, 300) for t in range(3)]
    got, want = both(spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert got == want and max(r[1] for r in got) >= 297


def test_whole_table_and_empty(spark):
    with duckdb.connect() as c:
        c.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
        want = sorted(map(tuple, c.execute(pt.SQL).fetchall()), key=str)
    assert sorted((tuple(r) for r in pt.op11_prefix_trie(spark, SF).collect()), key=str) == want
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exit_nodes():
    g = random.Random(6)
    trie, seen = pt.ZFastTrie(), set()
    for _ in range(600):
        s = [g.choice("ab") if g.random() < 0.3 else "a" for _ in range(g.randrange(0, 40))]
        keys = [("".join(s[:d]), d) for d in range(len(s) + 1)]
        v = trie.insert(0, keys)
        assert trie.extent[v] == len(s) and trie._key(v, len(s)) == keys[-1]
        deepest = max((d for d in range(len(s) + 1) if keys[d] in seen), default=0)
        seen |= set(keys)
        u, depth = trie.locate(len(trie.strings) - 1)
        assert depth == len(s) and trie.extent[u] == depth and deepest <= depth
    edges = sum(trie.extent[v] - trie.low[v] for v in range(len(trie.low)))
    assert edges == len(seen) - 1 and len(trie.low) < 2 * 600
    assert all(pt.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x) for a in range(40) for b in range(a + 1, 60))
