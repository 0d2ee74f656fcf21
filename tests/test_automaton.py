"""Name search against a plain alternation, longest first."""

import random
import re

import numpy as np
import pytest

from tomewright.operators import automaton as A


def plain(text, names):
    rx = "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    return re.findall(rx, text) if names and text else []


def test_trie_finds_the_longest_name_at_every_position():
    rng = random.Random(3)
    for _ in range(30):
        names = {"".join(rng.choice("ab中𠮷é") for _ in range(rng.randint(1, 9))) for _ in range(60)}
        trie = A.Trie(["k"] * len(names), sorted(names))
        texts = ["".join(rng.choice("ab中𠮷é ") for _ in range(rng.randint(0, 80))) for _ in range(9)]
        row, start, length = trie.longest(texts, ["k"] * 8 + ["other"])
        got = dict(zip(zip(row.tolist(), start.tolist()), length.tolist()))
        for r, t in enumerate(texts):
            for i in range(len(t)):
                want = max((len(n) for n in names if t.startswith(n, i)), default=0) if r < 8 else 0
                assert got.get((r, i), 0) == want
        kept = A.leftmost(row, start, length)
        for r, t in enumerate(texts[:8]):
            own = [t[start[k]:start[k] + length[k]] for k in kept if row[k] == r]
            assert own == plain(t, names)


@pytest.mark.parametrize("shard", [10 ** 6, 40])
def test_find_names(spark, shard):
    """Several dictionaries, one and many shards, nulls, repeated names, a name longer than any text."""
    rng = random.Random(shard)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 6)))
    scripts = {"x": "abAB", "y": "жшяЖ", "z": "中文名字𠮷"}
    names = {k: {word(a) for _ in range(90)} for k, a in scripts.items()}
    names["x"] |= {"a" * 3000, ".*", "a|b"}
    rows = [(k, n) for k in names for n in names[k]] * 2 + [(None, "ab"), ("x", None), ("x", "")]
    texts = [(k, i, "".join(rng.choice(a + " .*|") for _ in range(200))) for k, a in scripts.items() for i in range(12)]
    texts += [("x", 90, None), ("x", 91, ""), ("w", 92, "ab"), (None, 93, "ab"), ("x", 94, "a" * 6001), ("x", 95, "ab " * 20_000)]
    got = A.find_names(spark.createDataFrame(texts, "k string, i int, text string").repartition(3),
                       spark.createDataFrame(rows, "k string, alias string"), "k", ["k", "i"], shard_names=shard).collect()
    for k, i, t in texts:
        own = sorted((r["ord"], r["alias"]) for r in got if r["i"] == i and r["k"] == k)
        assert [o for o, _ in own] == list(range(len(own)))
        assert [a for _, a in own] == plain(t, names.get(k, ()))


def test_levels_stay_within_their_bound():
    rng = np.random.default_rng(1)
    names = ["".join(map(chr, 0x4E00 + rng.integers(0, 200, rng.integers(2, 9)))) for _ in range(20_000)]
    trie = A.Trie(["k"] * len(names), names)
    assert sum(k.nbytes + e.nbytes for k, e in trie.levels) <= 16 * sum(map(len, names))
