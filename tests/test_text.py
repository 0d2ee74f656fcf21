import unicodedata

import pytest
from pyspark.sql import functions as F

from tomewright import fixed as K
from tomewright.functions import text as T


def col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numerals(spark):
    cases = {"十二": 12, "一百零三": 103, "两千": 2000, "一万二千": 12000, "1": 1, "十": 10, "〇": 0, "三四": 4,
             "二十万三千零五": 203005, "1千": None, "": None, "甲": None, " 12 ": 12}
    assert col(spark, cases, T.cn_number) == list(cases.values())


def test_normalize_matches_unicode_tables(spark):
    texts = ["ＡＢＣ，。！　x\ty", "「引」『文』“a”‘b’《c》", "ﬁ ① ㌔ ｶﾞ ﾊﾟ", "é é ñ ß", "第１２章…﹍——", "plain ascii 'q'"]
    drop = dict.fromkeys(map(ord, K.QUOTE_CHARS))
    want = ["".join(unicodedata.normalize("NFKC", t).split()).translate(drop) for t in texts]
    assert col(spark, texts, T.normalize) == want


def test_characters_that_skip_python_are_stable():
    import re
    may = re.compile(T.MAY_CHANGE.replace(r"\x{10FFFF}", "\U0010ffff"))
    safe = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not may.match(chr(c))]
    assert len(safe) > 300
    assert all(unicodedata.normalize("NFKC", c) == c for c in safe)
    joined = "".join(safe)
    assert unicodedata.normalize("NFKC", joined) == joined


def test_whitespace_set_is_the_strip_set():
    assert set(K.WS_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@pytest.mark.parametrize("line,want", [
    ("第十二章 夜袭", ("chapter", 12, "第十二章 夜袭")),
    ("【第12章】夜袭", ("chapter", 12, "第12章 夜袭")),
    ("第12回 夜袭", ("chapter", 12, "第12回 夜袭")),
    ("Chapter 12 A Door", ("chapter", 12, "Chapter 12 A Door")),
    ("001. 夜袭", ("chapter", 1, "001. 夜袭")),
    ("12、夜袭", (None, None, None)),
    ("楔子", ("special", None, "楔子")),
    ("第一卷 风起", ("volume", 1, "第一卷 风起")),
    ("第二部", ("volume", 2, "第二部")),
    ("第一章他走了。", (None, None, None)),
    ("第一章" + "长" * 50, (None, None, None)),
    ("", (None, None, None)),
])
def test_heading_rules(spark, line, want):
    (got,) = col(spark, [line], T.heading)
    assert tuple(got) == want


def test_loose_numbered_headings(spark):
    (got,) = col(spark, ["12、夜袭"], lambda c: T.heading(c, loose_numbered=True))
    assert tuple(got) == ("chapter", 12, "12. 夜袭")


def test_chapter_lists(spark):
    cases = {"3、5–8": [3, 5, 6, 7, 8], "400-900": [400, 900], "9-7": [7, 9], "12": [12], "": []}
    assert col(spark, cases, T.chapter_list) == list(cases.values())


def test_references(spark):
    text = "第12章、第12–18章、第十二章、12至18章、第18-12章、第0章"
    (r,) = col(spark, [text], T.ref_ranges)
    assert [(x.a, x.b) for x in r] == [(12, 18), (12, 18)]
    (s,) = col(spark, [text], T.ref_singles)
    assert s == [12, 12]


def test_ellipsis_order(spark):
    # NFKC runs first, so the ellipsis character has become three dots
    assert col(spark, ["天地玄黄……宇宙洪荒——日月盈昃**短"], lambda c: T.match_segments(T.normalize(c))) == [
        ["天地玄黄", "宇宙洪荒", "日月盈昃"]]


def test_progress_key(spark):
    a, b, c = col(spark, ["/甲书/速读稿.md", "/乙书/速读稿.md", "/甲书/速读稿.md"], T.progress_key)
    assert a != b and a == c and a.startswith("速读稿-") and len(a) == 4 + 16
    assert col(spark, ["/x.md"], lambda p: T.progress_key(p, F.lit("own"))) == ["own"]


def test_small_labels(spark):
    assert col(spark, ["第3章 x", "7 y", "甲", ""], lambda c: T.chapter_label(F.lit(9), c)) == ["第3章 x", "7 y", "第9章 甲", "第9章"]
    assert col(spark, ["第1章 a/b:c", "第2章"], T.file_title) == ["a_b_c", "未命名"]
    assert col(spark, ["第12章 甲", " 7 ", "甲"], T.declared_chapter) == [12, 7, None]
    assert col(spark, ["第0002章_x.txt", "a.txt"], T.name_number) == [2, None]
