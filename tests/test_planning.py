"""Planning cases on an index of 20 chapters numbered 125..144."""

import random

import pytest
from pyspark.sql import functions as F

from tomewright.operators import coverage as C
from tomewright.plans import reading as R


@pytest.fixture(scope="module")
def ix(spark):
    rows = [("b", i, f"第{i - 124}章 卷内章名{i}", (i % 3 + 1) * 100, f"原文/第{i:04d}章.txt") for i in range(125, 145)]
    return spark.createDataFrame(rows, "book_id string, idx int, title string, chars long, file string").cache()


def bounds(plan):
    return [(r.start, r.end) for r in plan.orderBy("start").collect()]


def test_segments_by_count(ix):
    plan = R.plan_segments(ix, per=8)
    rows = plan.orderBy("start").collect()
    assert bounds(plan) == [(125, 132), (133, 140), (141, 144)]
    assert [r.next_start for r in rows] == [133, 141, None]
    assert sum(r.chars for r in rows) == 4000 and sum(r.chapters for r in rows) == 20
    assert rows[0].first_title == "第1章 卷内章名125" and rows[0].segment == "段01"
    assert R.audit_plan(plan, ix).first().passed


def test_segments_by_ends(ix):
    rows = R.plan_segments(ix, ends=[130, 144], first_number=4).orderBy("start").collect()
    assert [(r.segment, r.start, r.end, r.batches) for r in rows] == [("段04", 125, 130, 1), ("段05", 131, 144, 2)]
    for ends in ([130, 143], [140, 130, 144], [124, 144], []):
        with pytest.raises(ValueError):
            R.plan_segments(ix, ends=ends, lo=125, hi=144)


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_segments_by_budget(ix, bits):
    plan = R.plan_segments(ix, target_chars=600, bits=bits)
    assert bounds(plan) == [(125 + 3 * i, 127 + 3 * i) for i in range(6)] + [(143, 144)]
    assert [r.chars for r in plan.orderBy("start").collect()] == [600] * 6 + [400]


@pytest.mark.parametrize("bits,target", [(1, 50), (2, 333), (3, 1000), (4, 7)])
def test_budget_blocks_equal_the_plain_fold(spark, bits, target):
    rnd = random.Random(target)
    sizes = [rnd.randint(1, 120) for _ in range(150)]
    df = spark.createDataFrame([("x", i + 3, c) for i, c in enumerate(sizes)], "book_id string, idx long, chars long")
    got = [r.segment_no for r in R.budget_segments(df, target, bits).orderBy("idx").collect()]
    want, acc, seg = [], 0, 0
    for c in sizes:
        want.append(seg)
        acc += c
        if acc >= target:
            acc, seg = 0, seg + 1
    assert got == want


def test_batches(ix):
    assert [(r.batch, r.start, r.end) for r in R.plan_batches(ix).orderBy("batch").collect()] == [(11, 125, 132), (12, 133, 144)]
    local = R.plan_batches(ix, mode="local", lo=125, hi=140).orderBy("batch").collect()
    assert [(r.batch, r.start, r.end) for r in local] == [(1, 125, 136), (2, 137, 140)]
    assert local[0].unit == "单元01_第125-136章"
    assert R.plan_batches(ix, mode="local", lo=141, hi=144).first().batch == 1


def test_bad_indices_are_refused(ix):
    for bad in (ix.where("idx > 125"), ix.union(ix.where("idx = 129")), ix.where("idx <> 130")):
        with pytest.raises(ValueError):
            R.require_valid(bad, 125, 144)
    with pytest.raises(ValueError):
        R.require_valid(ix, 144, 125)
    assert R.require_valid(ix, 125, 144).count() == 20
    neg = ix.withColumn("chars", F.when(F.col("idx") == 130, -1).otherwise(F.col("chars")))
    assert [(r.kind, r["first"]) for r in R.validate_index(neg).collect()] == [("negative", 130)]


def test_sources(spark, ix):
    files = spark.createDataFrame([("b", f"原文/第{i:04d}章.txt") for i in range(125, 142)]
                                  + [("b", "x/第142章_t.txt"), ("b", "x/0143_a.txt"), ("b", "y/0143.md")],
                                  "book_id string, path string")
    got = {r.idx: r.path for r in R.locate_sources(ix, files).collect()}
    assert got[125] == "原文/第0125章.txt" and got[142] == "x/第142章_t.txt" and got[143] == "x/0143_a.txt"
    assert got[144] is None and len(got) == 20


def test_audit_finds_breaks(ix):
    plan = R.plan_segments(ix, per=8)
    r = R.audit_plan(plan.where("segment_no <> 1"), ix).first()
    assert not r.passed and r.breaks == 1
    assert R.resume_point(plan.where("segment_no < 2")).first().resume_at == 141


def test_coverage(spark, ix):
    d = spark.createDataFrame([("b", "d", "第125–130章 第133章 第一百三十五章 139至141章 第1–99999999章?")],
                              "book_id string, doc_id string, text string")
    d0 = d.withColumn("text", F.regexp_replace("text", " 第1–.*", ""))
    r = C.coverage(d0, ix).first()
    assert (r.total, r.covered, r.missing, r.rate, r.passed) == (20, 11, 9, 0.55, False)
    runs = [x.run for x in C.missing_runs(d0, ix, bits=2).orderBy("first").collect()]
    assert runs == ["131–132", "134", "136–138", "142–144"]
    assert C.coverage(d, ix).first().passed        # a huge range is clipped to the index, not expanded
    assert C.coverage(d0, ix, 125, 130).first().rate == 1.0
