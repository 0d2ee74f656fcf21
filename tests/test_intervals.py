"""Interval algebra of coverage against sets."""

import random

import pytest
from pyspark.sql import functions as F

from tomewright.operators import coverage as C
from tomewright.operators.ordered import merge_intervals, ordered_scan, prefix_ranks


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_merge_intervals(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", None]), x := rng.randint(-40, 90), x + rng.randint(-3, 25)) for _ in range(120)]
    rows += [("c", 1, 10 ** 6)] * 3 + [("c", 10 ** 6 + 1, 10 ** 6 + 2), ("c", None, 5), ("d", 9, 3)]
    got = merge_intervals(spark.createDataFrame(rows, "k string, a long, b long"), ["k"], bits=bits).collect()
    for k in ("a", "b", None):
        held = {n for q, a, b in rows if q == k for n in range(a, b + 1)}
        own = sorted((r.a, r.b) for r in got if r.k == k)
        assert {n for a, b in own for n in range(a, b + 1)} == held
        assert all(y[0] > x[1] + 1 for x, y in zip(own, own[1:]))
    assert [(r.a, r.b) for r in got if r.k == "c"] == [(1, 10 ** 6 + 2)] and not [r for r in got if r.k == "d"]


@pytest.mark.parametrize("bits", [2, 16])
def test_prefix_ranks_and_running_top(spark, bits):
    rng = random.Random(7)
    have = [(k, rng.randint(0, 60)) for k in "xy" for _ in range(30)]
    asked = [(k, v) for k in "xyz" for v in range(-2, 63)]
    got = prefix_ranks(spark.createDataFrame(asked, "k string, v long"), spark.createDataFrame(have, "k string, v long"), "k", "v", bits)
    assert {tuple(r) for r in got.collect()} == {
        (k, v, sum(q == k and w < v for q, w in have), sum(q == k and w <= v for q, w in have)) for k, v in asked}
    rows = [("x", i, rng.choice([None, rng.randint(0, 99)])) for i in range(40)]
    top = ordered_scan(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], "o", top={"m": F.col("v")}, bits=bits).collect()
    assert {r.o: r.m for r in top} == {i: max((v for _, j, v in rows if j < i and v is not None), default=None) for _, i, _ in rows}


@pytest.mark.parametrize("bits", [1, 16])
def test_coverage_equals_sets(spark, bits):
    """Index with jumps and doubles, documents in several rows, ranges beyond the index, books without one."""
    rng = random.Random(bits)
    idx = {"p": [n for n in range(1, 120) if n % 17 and not 40 <= n < 55], "q": list(range(500, 560)), "r": [3]}
    chapters = spark.createDataFrame([(b, n, f"t{n}", n) for b, ns in idx.items() for n in ns],
                                     "book_id string, idx long, title string, chars long")
    docs, held = [], {}
    for b in ("p", "q", "r", "none"):
        for d in range(4):
            for _ in range(rng.randint(1, 3)):
                refs = [(x := rng.choice([1, 30, 38, 41, 90, 505, 530, 3]), x + rng.choice([0, 0, 1, 5, 40])) for _ in range(rng.randint(0, 4))]
                docs.append((b, f"d{d}", "，".join(f"第{x}章" if x == y else f"第{x}–{y}章" for x, y in refs) or "无"))
                held.setdefault((b, f"d{d}"), set()).update(n for x, y in refs for n in range(x, y + 1))
    docs.append(("q", "wide", "第1–999999章"))
    held["q", "wide"] = set(range(1, 10 ** 6))
    df = spark.createDataFrame(docs, "book_id string, doc_id string, text string")
    runs = [(r.book_id, r.doc_id, r.first, r.last) for r in C.gaps(df, chapters, bits=bits).collect()]
    for (b, d), refs in held.items():
        missing = [n for n in idx.get(b, []) if n not in refs]
        own = sorted(r[2:] for r in runs if r[:2] == (b, d))
        assert [n for x, y in own for n in range(x, y + 1)] == missing
        assert all(y[0] > x[1] + 1 or any(n not in idx[b] for n in range(x[1] + 1, y[0])) for x, y in zip(own, own[1:]))
    cov = {(r.book_id, r.doc_id): (r.total, r.covered, r.missing) for r in C.coverage(df, chapters).collect()}
    assert cov == {(b, d): (len(idx.get(b, [])), n := len(refs & set(idx.get(b, []))), len(idx.get(b, [])) - n) for (b, d), refs in held.items()}
    got = {(r.book_id, r.doc_id, r.ch) for r in C.covered_chapters(df, chapters).collect()}
    assert got == {(b, d, n) for (b, d), refs in held.items() for n in refs if n in idx.get(b, [])}
    part = {(r.book_id, r.doc_id): (r.total, r.covered) for r in C.coverage(df, chapters, 35, 60).collect()}
    assert part["p", "d0"] == (len(s := {n for n in idx["p"] if 35 <= n <= 60}), len(s & held["p", "d0"]))


def test_claims_stay_intervals(spark):
    """Twenty thousand documents that each claim a million chapters."""
    chapters = spark.range(1, 10 ** 6 + 1).selectExpr("'b' AS book_id", "id AS idx", "'t' AS title", "1L AS chars")
    docs = spark.range(20_000).selectExpr("'b' AS book_id", "id AS doc_id", "if(id = 7, '第2–999999章', '第1–1000000章') AS text")
    assert C.ref_intervals(docs, chapters).count() == 20_000
    got = C.coverage(docs, chapters).groupBy("covered").count().collect()
    assert {r["covered"]: r["count"] for r in got} == {10 ** 6: 19_999, 10 ** 6 - 2: 1}
    assert sorted((r.doc_id, r.first, r.last) for r in C.gaps(docs, chapters).collect()) == [(7, 1, 1), (7, 10 ** 6, 10 ** 6)]
