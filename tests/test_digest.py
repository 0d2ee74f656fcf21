from tomewright.operators import anchors as A
from tomewright.operators import digest as D

KEYS = ["book_id", "doc_id"]
OLD = """# 速读
前言
## 单元一：开端（第 1–15 章）
引子

**【重要】**
- **第5章 夜袭**：正文五
  续五

- **标题（第 3 章）**（S）：正文三
**【原文·第5章 夜袭】**
> 引文一

> 引文二

**【过渡】**
- **第1-2章**：略一
**这一段结束时**
- 尾

## 单元2｜中（第16–18章）
【重要】大战（第16-17章）：打
【过渡】第18章是收尾：完
## 读完索引
见第5章、第16–17章、第99章
"""
NEW = """# 速读
前言
## 单元一：开端（第 1–15 章）
引子

- **第1-2章（略）**：略一
- **第3章（详） 标题**：正文三
- **第5章（详） 夜袭**：正文五
  续五

**【原文·第5章 夜袭】**
> 引文一

> 引文二

**这一段结束时**
- 尾
## 单元2｜中（第16–18章）
- **第16-17章（详） 大战**：打
- **第18章（略） 收尾**：完
## 读完索引
见第5章、第16–17章、第99章"""


def doc(spark, text):
    return spark.createDataFrame([("b", "d", text)], "book_id string, doc_id string, text string")


def rewritten(spark, text):
    rows = D.reorder_digest(doc(spark, text), KEYS).orderBy("unit_no", "out_no").collect()
    return "\n".join(r.line for r in rows)


def test_reorder(spark):
    assert rewritten(spark, OLD) == NEW


def test_reorder_is_idempotent(spark):
    assert rewritten(spark, NEW) == NEW


def test_nothing_is_lost(spark):
    lost = D.lost_lines(D.digest_lines(doc(spark, OLD), KEYS), D.digest_lines(doc(spark, NEW), KEYS), KEYS)
    assert lost.count() == 0
    cut = NEW.replace("  续五\n", "")
    lost = D.lost_lines(D.digest_lines(doc(spark, OLD), KEYS), D.digest_lines(doc(spark, cut), KEYS), KEYS)
    assert [(r.line, r.delta) for r in lost.collect()] == [("续五", -1)]


def test_entry_that_does_not_parse(spark):
    r = D.unit_stats(doc(spark, "## 单元1\n**【重要】**\n- 坏条目\n- **第1-900章 长**：x"), KEYS).first()
    assert (r.entries, r.unreadable) == (2, 1)
    e = D.entries(doc(spark, "## 单元1\n**【重要】**\n- **第1-900章 长**：x"), KEYS).first()
    assert e.nums == [1, 900]


def test_blocks(spark):
    text = "a\nb\n---\n> q1\n> q2\n\n> q3\n| x | y |\n|---|---|\n1. o\n2) p\n* u\n**【原文·第3章】** l\n\n> s1\n\n> s2\nend"
    rows = D.digest_blocks(doc(spark, text), KEYS).orderBy("block_no").collect()
    assert [r.kind for r in rows] == ["p", "hr", "quote", "quote", "table", "ol", "ul", "slice", "p"]
    assert rows[0].text == "a\nb" and rows[2].text == "q1\nq2" and rows[4].rows[0] == ["x", "y"]
    assert rows[5]["items"] == ["o", "p"] and rows[7].text == "\ns1\n\ns2" and rows[7].chapter == "第3章"


def test_units_and_anchors(spark):
    d = doc(spark, OLD)
    b = D.digest_blocks(d, KEYS)
    u = D.units(b, KEYS)
    got = [(r.kind, r.num, r.ch_from, r.ch_to, r.anchor) for r in u.orderBy("bucket_no").collect()]
    assert got == [("unit", 1, 1, 15, "u-1"), ("unit", 2, 16, 18, "u-2"), ("section", 1, None, None, "sec-1")]
    am = A.anchors(b, u, KEYS)
    amap = {r.ch: r.anchor for r in am.collect()}
    assert amap[5] == "s5-1" and amap[4] == "u-1" and amap[18] == "u-2" and len(amap) == 18
    refs = {(r.kind, r.a, r.b): r.anchor for r in A.resolve_refs(d, b, u, KEYS).collect()}
    assert refs[("range", 16, 17)] == "u-2" and refs[("single", 99, 99)] is None and refs[("single", 5, 5)] == "s5-1"
    whole = D.units(D.digest_blocks(doc(spark, "x\n## 附录\ny"), KEYS), KEYS).where("kind = 'unit'").first()
    assert (whole.bucket_no, whole.num) == (0, 1)


def test_levels(spark):
    b = D.digest_blocks(doc(spark, NEW), KEYS)
    assert D.level_of_slices(b, KEYS).first().level == "详"
    assert {r.text for r in D.key_only(b, KEYS).collect()} == {
        "**第3章（详） 标题**：正文三", "**第5章（详） 夜袭**：正文五", "**第16-17章（详） 大战**：打", "第5章 夜袭"}


def test_order_audit(spark):
    bad = "## 单元1（第1–5章）\n- **第3章（详）**：a\n- **第1章（略）**：b\n- **第3–4章（略）**：c"
    r = D.audit_order(doc(spark, bad), KEYS).first()
    assert (r.entries, r.descents, r.repeated, r.left_out) == (3, 1, 1, 2)


def test_title(spark):
    assert D.document_title(doc(spark, "x\n# 书名 \n"), KEYS).first().title == "书名"
