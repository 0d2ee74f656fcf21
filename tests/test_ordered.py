import random

import pytest
from pyspark.sql import functions as F

from tomewright.operators.ordered import locate_in_spans, ordered_scan, rank_blocks, runs


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_scan_equals_brute_force_with_a_hot_key(spark, bits):
    rnd = random.Random(bits)
    rows = [("hot", i, rnd.randrange(9), rnd.choice([None, "x", "y"])) for i in rnd.sample(range(-50, 400), 120)]
    rows += [(f"k{i}", rnd.randrange(99), 1, "z") for i in range(20)]
    df = spark.createDataFrame(rows, "k string, o long, v int, s string")
    got = ordered_scan(df, ["k"], "o", total={"t": F.col("v")}, carry={"c": F.col("s")}, behind={"b": F.col("s")},
                       ahead={"a": F.col("v")}, bits=bits).collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = set()
    for k, rs in by.items():
        rs.sort(key=lambda r: r[1])
        for i, r in enumerate(rs):
            prev = [x[3] for x in rs[:i] if x[3] is not None]
            want.add((*r, sum(x[2] for x in rs[:i]), prev[-1] if prev else None,
                      rs[i - 1][3] if i else None, rs[i + 1][2] if i + 1 < len(rs) else None))
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_runs(spark, bits):
    vals = [1, 2, 3, 7, 9, 10, 64, 65, 66, 67, 200]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 5)], "k string, n long")
    got = sorted(tuple(r) for r in runs(df, ["k"], "n", bits).collect())
    assert got == [("a", 1, 3), ("a", 7, 7), ("a", 9, 10), ("a", 64, 67), ("a", 200, 200), ("b", 5, 5)]


def test_spans_join_without_nested_loop(spark):
    spans = spark.createDataFrame([("b", 1, 0, 10), ("b", 2, 10, 5000), ("b", 3, 5000, 5000), ("b", 4, 5000, 9000)],
                                  "book_id string, idx int, s long, e long")
    points = spark.createDataFrame([("b", p) for p in (0, 9, 10, 4999, 5000, 8999, 9000)], "book_id string, pos long")
    out = locate_in_spans(points, spans, "book_id", "pos", "s", "e")
    assert sorted((r.pos, r.idx) for r in out.collect()) == [(0, 1), (9, 1), (10, 2), (4999, 2), (5000, 4), (8999, 4)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [lambda r: r.randrange(-2 ** 63, 2 ** 63), lambda r: 7, lambda r: r.choice([None, 1, 2 ** 40])],
                         ids=["sparse", "equal", "few"])
def test_blocks_are_bounded_whatever_the_order_values(spark, make):
    rnd = random.Random(3)
    rows = [("hot" if i % 4 else f"k{i % 12}", make(rnd), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    blocks, several = rank_blocks(df, ["k"], "o", bits=7)
    sizes = [r["count"] for r in blocks.groupBy("_blk").count().collect()]
    assert several and sum(sizes) == 4000 and max(sizes) <= 4 * 128 and len(sizes) > 4000 / 128 / 2
    got = ordered_scan(df, ["k"], "o", total={"n": F.lit(1), "t": F.col("v")}, behind={"b": F.col("v")}, ahead={"a": F.col("v")},
                       bits=7).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, {})[r.n] = r
    assert sum(map(len, by.values())) == 4000
    for rs in by.values():                      # one chain per key, rising in o, consistent among all results
        assert sorted(rs) == list(range(len(rs)))
        for n, r in rs.items():
            prev, nxt = rs.get(n - 1), rs.get(n + 1)
            assert (r.b, r.a) == (prev.v if prev else None, nxt.v if nxt else None)
            assert r.t == (prev.t + prev.v if prev else 0)
            assert prev is None or prev.o is None or (r.o is not None and prev.o <= r.o)
