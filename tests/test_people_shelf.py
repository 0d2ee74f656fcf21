from pyspark.sql import functions as F

from tomewright.operators import audit as AU
from tomewright.operators import catalog as G
from tomewright.operators import digest as D
from tomewright.operators import entities as E

PEOPLE = """# 人物
## 别名归一表
| 本名 | 首次出现 | 马甲/尊称 | 身份势力 |
|---|---|---|---|
| **韩立** | 第1章 | 韩天尊、又称厉飞羽（某章）、前辈、无、韩 立、一二三四五六七八九 | 主角 |
| 南宫婉 | 第9章 | 南宫仙子 | - |
| 墨大夫 | 第2章 | — | - |
### 韩立
主角
#### 小节
- a
### 南宫婉（月）
女主
> 引
### 张铁
友
#### 韩立与张铁
同门
## 其他
忽略
### 张铁柱
归张铁
"""


def people(spark):
    d = spark.createDataFrame([("b", PEOPLE)], "book_id string, text string")
    return E.people(D.digest_blocks(d, ["book_id"]), ["book_id"])


def test_people_file(spark):
    al, entries = people(spark)
    got = {r.alias: r.canonical for r in al.collect()}
    assert got == {"韩立": "韩立", "韩天尊": "韩立", "厉飞羽": "韩立", "南宫婉": "南宫婉", "南宫仙子": "南宫婉",
                   "墨大夫": "墨大夫", "张铁": "张铁"}
    body = {r.canonical: r.body for r in entries.collect()}
    assert body == {"韩立": "主角\n### 小节\n- a\n\n同门", "南宫婉": "女主\n> 引", "张铁": "友\n\n归张铁"}
    assert [r.canonical for r in E.unlinked_people(al, entries, ["book_id"]).collect()] == ["墨大夫"]


def test_mentions(spark):
    al, _ = people(spark)
    al = al.unionByName(spark.createDataFrame([("b", "韩", "韩立"), ("b", "张.铁", "张铁")], "book_id string, alias string, canonical string"))
    t = spark.createDataFrame([("b", 1, "韩天尊与韩立，厉飞羽见南宫仙子，张铁柱在张x铁张.铁")], "book_id string, u int, text string")
    for names in (E.SHARD_NAMES, 2):
        m = E.mentions(t, al, "book_id", ["book_id", "u"], shard_names=names)
        assert [r.alias for r in m.orderBy("ord").collect()] == ["韩天尊", "韩立", "厉飞羽", "南宫仙子", "张铁", "张.铁"]
    first = {r.canonical: r.alias for r in E.first_mentions(m, ["book_id", "u"], ["ord"]).collect()}
    assert first == {"韩立": "韩天尊", "南宫婉": "南宫仙子", "张铁": "张铁"}


def test_manifest_and_cards(spark):
    text = "# 我的书架\n## 《甲书》\n说明一\n说明二\n- 第一册：a/速读稿.html\n- [第二册](b/衔接包.html)\n- c/第1-20章/速读稿.html\n## 乙书\n- 外：https://x.y/z.html"
    rows = G.parse_manifest(spark.createDataFrame([("s", text)], "shelf_id string, text string")).cache()
    assert [(r.label, r.path) for r in rows.where("kind = 'item'").orderBy("line_no").collect()] == [
        ("第一册", "a/速读稿.html"), ("第二册", "b/衔接包.html"), ("", "c/第1-20章/速读稿.html"), ("外", "https://x.y/z.html")]
    assert [(r.name, r.desc, r.digests) for r in G.manifest_books(rows).orderBy("book_no").collect()] == [
        ("甲书", "说明一 说明二", 3), ("乙书", "", 1)]
    pages = spark.createDataFrame([
        ("a/速读稿.html", '<title>《甲》第1–20章 &amp; x</title><script id="page-data" type="application/json">'
                          '{"key":"k1","unitCount":3,"chapterCount":20,"chars":{"a":"b","c":"d"}}</script>'),
        ("b/衔接包.html", '<title>t</title><script id="page-data" type="application/json">{bad</script>')],
        "path string, html string")
    meta = G.page_metadata(pages, "path")
    m = {r.path: r for r in meta.collect()}
    assert m["a/速读稿.html"].title == "《甲》第1–20章 & x" and m["a/速读稿.html"].people == 2
    assert m["b/衔接包.html"].key is None and m["b/衔接包.html"].units == 0
    cards = {r.path: r for r in G.cards(G.match_pages(rows.where("kind = 'item'"), meta)).collect()}
    a, b, c, x = (cards[p] for p in ("a/速读稿.html", "b/衔接包.html", "c/第1-20章/速读稿.html", "https://x.y/z.html"))
    assert (a.a, a.b, a.stats, a.exists) == (1, 20, "单元 3 · 可跳转 20 章 · 2 人", True)
    assert b.card_kind == "bridge" and c.exists is False and c.card_title == "第1-20章" and x.exists is None
    order = [r.path for r in G.cards(G.match_pages(rows.where("kind = 'item'"), meta)).orderBy("card_order").collect()]
    assert order[:2] == ["a/速读稿.html", "c/第1-20章/速读稿.html"]


def test_states_and_bridges(spark):
    s = spark.createDataFrame([("b", "e", c, f"s{c}") for c in (1, 4, 9)], "book_id string, entity string, ch long, state string")
    assert AU.asof_state(s, 9).first().state == "s4"
    p = spark.createDataFrame([("b", "e", c) for c in (1, 2, 4, 5, 10)], "book_id string, entity string, ch long")
    got = {r.ch: r.state for r in AU.asof_states(s, p, bits=1).collect()}
    assert got == {1: None, 2: "s1", 4: "s1", 5: "s4", 10: "s9"}
    ix = spark.createDataFrame([("b", i) for i in range(1, 30)], "book_id string, idx int")
    d = spark.createDataFrame([("b", "d", "第5–9章，从第10章接，第12章泄露")], "book_id string, doc_id string, text string")
    assert {(r.ch, r.kind) for r in AU.spoiler_leaks(d, ix, 10).collect()} == {(10, "info"), (12, "leak")}
    t = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y"), ("b", 3, "x"), ("c", 1, "x")], "book_id string, idx int, norm string")
    assert {(r.idx, r.first_idx, r.copies) for r in AU.duplicate_chapters(t).collect()} == {(1, 1, 2), (3, 1, 2)}
