import random

import pytest
from pyspark.sql import functions as F

from tomewright.functions import text as T
from tomewright.operators import passages as P
from tomewright.operators import quotes as Q

CHAPTERS = ["甲乙丙丁戊己庚辛壬癸" * 3 + "独一无二的句子在此", "子丑寅卯辰巳午未申酉戌亥" * 2 + "末尾跨章",
            "开头接续" + "天地玄黄宇宙洪荒"]
DIGEST = """# T
**【原文·第1章 甲】**
> 「独一无二的句子在此」

【原文·第2章】 lab
> 独一无二的句子在此
>
**【原文·第3章】**

> 天地玄黄……开头接续
【原文·3】
> 不存在的文字啊
【原文】
> 短
【原文·第2章】
> 末尾跨章开头接续
【原文·第3章】
text
【原文·第1章】
> 独一无二

> 的句子在此
"""


def corpus(spark, chapters=CHAPTERS):
    return spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(chapters)], "book_id string, idx int, text string") \
        .withColumn("norm", T.normalize(F.col("text")))


def docs(spark, text=DIGEST):
    return spark.createDataFrame([("b", "d", text)], "book_id string, doc_id string, text string")


def test_extraction(spark):
    rows = Q.extract_slices(docs(spark), ["book_id", "doc_id"]).orderBy("slice_no").collect()
    assert [(r.slice_no, r.line) for r in rows] == [(1, 2), (2, 5), (3, 8), (4, 11), (5, 13), (6, 15), (7, 19)]
    assert rows[0].chapter == "第1章 甲" and rows[0].text == "独一无二的句子在此" and rows[1].label == "lab"
    assert rows[6].raw == "独一无二"
    kept = Q.extract_slices(docs(spark), ["book_id", "doc_id"], allow_inner_blank=True).where("slice_no = 7").first()
    assert kept.raw == "独一无二\n\n的句子在此"


def test_statuses(spark):
    sl = Q.extract_slices(docs(spark), ["book_id", "doc_id"])
    rows = Q.verify_slices(sl, corpus(spark)).orderBy("slice_no").collect()
    assert [r.status for r in rows] == ["PASS", "WARN", "WARN", "FAIL", "FAIL", "PASS", "PASS"]
    assert rows[1].chapters == "第1章" and "标注为 第2章" in rows[1].reason
    assert "顺序" in rows[2].reason and "找不到：不存在的文字啊" in rows[3].reason and "过短" in rows[4].reason
    assert rows[5].chapters == "第2章"      # a match across the border is placed where it starts


def greedy(flat, segs):
    cur, out = 0, []
    for s in segs:
        p = flat.find(s, cur)
        ooo = p < 0
        if p < 0:
            p = flat.find(s)
        if p >= 0:
            cur = p + len(s)
            out.append((p, ooo))
        else:
            out.append((None, None))
    return out


@pytest.mark.parametrize("batch", [10_000, 7, 1])
def test_ordered_search_equals_greedy(spark, batch):
    """Small batches cut the occurrences of a piece anywhere."""
    rnd = random.Random(5)
    flat = "".join(rnd.choice("ab") for _ in range(600))
    slices = [[flat[p:p + rnd.randint(4, 9)] for p in (rnd.randrange(590) for _ in range(rnd.randint(1, 5)))] for _ in range(30)]
    slices[3].insert(1, "zzzz")
    cuts = [0, 1, 40, 41, 200, 333, 600]
    ct = spark.createDataFrame([("b", i, flat[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]), 1)],
                               "book_id string, idx int, norm string")
    segs = spark.createDataFrame([("b", i, j, s) for i, sl in enumerate(slices) for j, s in enumerate(sl)],
                                 "book_id string, n int, seg_no int, seg string")
    segs = segs.withColumn("seg_no", F.col("seg_no"))
    keys = ["book_id", "n"]
    spans = P.flat_spans(ct, bits=1)
    occ = P.find_segments(P.flat_blocks(ct, spans), segs, [*keys, "seg_no"], ["book_id"], ["book_id"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.n, r.seg_no): (r.pos, r.out_of_order) for r in Q.locate_in_order(occ, segs, keys).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, sl in enumerate(slices):
        for j, w in enumerate(greedy(flat, sl)):
            assert got.get((i, j), (None, None)) == w


@pytest.mark.parametrize("probes", [P.BROADCAST_PROBES, 0])
def test_search_equals_brute_force(spark, probes):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abc") for _ in range(n)) for n in (0, 3, 50, 4095, 4096, 4097, 9000)]
    texts += [texts[-1][100:5000], "Ａ" * 0 + "中文𠮷字符" * 900]
    segs = []
    for n in (4, 5, 8, 9, 18, 19, 38, 39, 70, 71, 100, 1023, 1024, 1025, 2500, 4500):
        for t in (texts[6], texts[8]):
            p = rnd.randrange(max(1, len(t) - n))
            segs.append(t[p:p + n])
    segs += ["abca", "zzzz", texts[6], texts[6][4090:4110], texts[6][:71]]
    s = spark.createDataFrame(list(enumerate(segs)), "item int, norm string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc int, norm string")
    got = {(r.item, r.doc, r.pos) for r in P.find_segments(
        P.text_blocks(d, ["doc"]), s.withColumnRenamed("norm", "seg"), ["item"], ["doc"], broadcast_probes=probes).collect()}
    want = set()
    for i, x in enumerate(segs):
        for j, t in enumerate(texts):
            p = t.find(x)
            while p >= 0:
                want.add((i, j, p))
                p = t.find(x, p + 1)
    assert got == want


@pytest.mark.parametrize("limit", [P.BROADCAST_SPANS, 0])
def test_flat_blocks_rebuild_the_book(spark, limit):
    rnd = random.Random(2)
    parts = ["".join(rnd.choice("xyz") for _ in range(n)) for n in (1, 0, 5000, 4096, 3, 9000, 1023)]
    ct = spark.createDataFrame([("b", i, t) for i, t in enumerate(parts)], "book_id string, idx int, norm string")
    flat = "".join(parts)
    rows = P.flat_blocks(ct, P.flat_spans(ct, bits=1), limit).orderBy("base").collect()
    assert [r.base for r in rows] == list(range(0, len(flat), P.BLOCK))
    assert all(r.block == flat[r.base:r.base + P.BLOCK + P.CHUNK] for r in rows)


def test_reports(spark):
    sl = Q.extract_slices(docs(spark), ["book_id", "doc_id"])
    res = Q.verify_slices(sl, corpus(spark)).cache()
    c = Q.status_counts(res).first()
    assert (c.slices, c.passed, c.warned, c.failed) == (7, 3, 2, 2)
    assert Q.slice_collection(res).count() == 5 and Q.slice_issues(res, 2).count() == 2
    assert Q.slice_share(sl, corpus(spark)).first().alarm
    cov = spark.createDataFrame([("b", "d", 3, 3, 0)], "book_id string, doc_id string, total long, covered long, missing long")
    g = Q.quality_gate(docs(spark), cov, res).first()
    assert g.errors == "failed_slices" and not g.ok
    assert Q.quality_gate(docs(spark), cov, res.where("status = 'PASS'")).first().ok
