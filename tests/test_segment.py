from pyspark.sql import functions as F

from tomewright.operators import segment as S

BOOK = ("前文\n第一卷 风起\n　第十二章 夜袭\n正文一。\n\n\n\n请收藏本站\r\n【第13章】再袭  \n第14回 甲。\n"
        "Chapter 15 A Door\nbody\n001. 夜袭\n12、夜袭\n楔子\nfoo\n第二部\nbar\n第十六章\nend")


def books(spark):
    b = spark.createDataFrame([("b", BOOK), ("plain", "abc" * 10), ("empty", "")], "book_id string, text string")
    return S.clean_books(b)


def test_cleaning(spark):
    t = {r.book_id: r.text for r in books(spark).collect()}["b"]
    assert "\r" not in t and "请收藏" not in t and "\n\n\n" not in t and "再袭\n" in t


def test_chapters(spark):
    rows = S.split_chapters(books(spark), chunk_size=8).orderBy("book_id", "idx").collect()
    b = [r for r in rows if r.book_id == "b"]
    assert [r.title for r in b] == ["第十二章 夜袭", "第13章 再袭", "Chapter 15 A Door", "001. 夜袭", "楔子", "第十六章"]
    assert [r.volume for r in b] == ["第一卷 风起"] * 5 + ["第二部"]
    assert [r.idx for r in b] == list(range(1, 7))
    plain = [r for r in rows if r.book_id == "plain"]
    assert [(r.start, r.end, r.chars) for r in plain] == [(0, 8, 8), (8, 16, 8), (16, 24, 8), (24, 30, 6)]
    assert all(r.fallback for r in plain) and not [r for r in rows if r.book_id == "empty"]


def test_chapters_tile_the_text(spark):
    text = {r.book_id: r.text for r in books(spark).collect()}
    rows = S.split_chapters(books(spark), with_preamble=True).where("book_id = 'b'").orderBy("idx").collect()
    assert rows[0].start == 0 and rows[-1].end == len(text["b"])
    assert all(a.end == b.start for a, b in zip(rows, rows[1:]))
    for r in rows[1:]:
        assert r.chars == len(text["b"][r.start:r.end].strip())
    bodies = {r.idx: r.text for r in S.chapter_text(books(spark)).where("book_id = 'b'").collect()}
    assert bodies == {r.idx: text["b"][r.start:r.end].strip() for r in rows[1:]}


def test_summary_and_preamble(spark):
    r = S.book_summary(S.split_chapters(books(spark), with_preamble=True)).where("book_id = 'b'").first()
    assert (r.chapters, r.volumes, r.short_chapters, r.preamble_chars) == (6, 2, 6, 10)


def test_custom_pattern(spark):
    b = spark.createDataFrame([("b", "== One ==\nx\n　== ==\ny\nz == no\n== Two ==\nw")], "book_id string, text string")
    rows = S.split_chapters(b, pattern="== ?(.*?) ?==").orderBy("idx").collect()
    assert [(r.title, r.volume) for r in rows] == [("One", ""), ("== ==", ""), ("Two", "")]


def test_lines(spark):
    rows = S.lines(books(spark)).where("book_id = 'b'").orderBy("line_no").collect()
    text = {r.book_id: r.text for r in books(spark).collect()}["b"]
    assert all(text[r.start:r.start + len(r.line)] == r.line for r in rows)
    assert [r.line for r in rows] == text.split("\n")


def test_text_is_not_shuffled(spark):
    plan = S.split_chapters(books(spark))._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange"):]
    assert plan.count("Exchange") == 1
    # the wide columns end below the exchange
    assert "body" not in plan[:plan.index("Exchange")] and "posexplode" in exchange


def test_scope():
    assert S.parse_scope("121-200") == (121, 200) and S.parse_scope("5") == (5, 5)
    assert S.parse_scope("3～9") == (3, 9) and S.parse_scope(None) == (None, None)
