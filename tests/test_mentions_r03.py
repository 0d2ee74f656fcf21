"""Third round: mentions without a join, tries as mapped files."""

import pickle

import pytest

from tomewright.operators import automaton as A
from tomewright.operators import entities as E

KIND = "k string, i int, text string"


@pytest.mark.parametrize("shard", [10 ** 6, 2])
def test_first_mentions_of_each_text(spark, shard):
    names = spark.createDataFrame([("x", "aa", "p"), ("x", "ab", "p"), ("x", "中文", "q"), ("x", "abab", None), ("y", "aa", "r")],
                                  "k string, alias string, canonical string")
    texts = spark.createDataFrame([("x", 1, "ab aa 中文 abab aa abab"), ("y", 2, "aaaa"), ("x", 3, None), (None, 4, "aa"), ("x", 1, "aa")], KIND)
    every = E.mentions(texts.where("text <> 'aa'"), names, "k", ["k", "i"], shard_names=shard).collect()
    assert sorted((r.i, r.ord, r.alias, r.canonical) for r in every if r.i == 1) == [
        (1, 0, "ab", "p"), (1, 1, "aa", "p"), (1, 2, "中文", "q"), (1, 3, "abab", None), (1, 4, "aa", "p"), (1, 5, "abab", None)]
    first = E.mentions(texts.where("text <> 'aa'"), names, "k", ["k", "i"], shard_names=shard, first_only=True)
    assert sorted((r.i, r.ord, r.alias, r.canonical) for r in first.collect()) == [
        (1, 0, "ab", "p"), (1, 2, "中文", "q"), (1, 3, "abab", None), (2, 0, "aa", "r")]
    if shard > 2:       # nothing found is joined or shuffled
        plan = first._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan


def test_workers_hold_no_dictionary(spark):
    """What a worker unpickles does not grow with the names."""
    names = [f"n{i:06d}" for i in range(20_000)]
    rows = spark.createDataFrame([("k", n) for n in names], "k string, alias string").toArrow()
    name, shared = A._publish(spark, rows, "k")
    assert len(pickle.dumps(shared.value)) < 1000
    trie, table = A._fetched(name, shared)
    row, start, length, number = trie.walk(["-n000017-n019999"], ["k"])
    assert table.column("alias").take(number).to_pylist() == ["n000017", "n019999"] and length.tolist() == [7, 7]
