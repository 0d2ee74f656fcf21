"""Books cut at random places give the tables of the whole books."""

import random

import pytest

from tomewright.operators import digest as D
from tomewright.operators import parts as P
from tomewright.operators import segment as S

WORDS = ["正文一", "foo", " ", "　", "\n", "\n", "\n\n", "第十二章 夜袭\n", "第3卷 风\n", "楔子\n", "Chapter 7 A Door\n", "12、夜袭\n", "x" * 60,
         " " * 70, "第  4 章", "。", "== One ==\n", "== ==\n", "第" + " " * 25 + "9部 远\n"]


def make_books(seed, n=25):
    rng = random.Random(seed)
    out = {"empty": "", "blank": " \n \n", "plain": "abc" * 40, "long line": "第1章 甲\n" + "y" * 400 + "\n第2章 乙", "heads first": "第1章\n第2章\n第3章"}
    for b in range(n):
        out[f"b{b}"] = "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))
    return out


def cut(rng, text, most):
    at = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, most)))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def tables(spark, seed, most=12):
    rng, books = random.Random(seed), make_books(seed)
    rows = [(b, 10 * i, s) for b, text in books.items() for i, s in enumerate(cut(rng, text, most))]
    rng.shuffle(rows)
    return (spark.createDataFrame(list(books.items()), "book_id string, text string"),
            spark.createDataFrame(rows, "book_id string, part_no long, text string"))


def same(a, b):
    assert a.columns == b.columns
    x, y = ([tuple(r) for r in t.collect()] for t in (a, b))
    assert sorted(x, key=repr) == sorted(y, key=repr) and x


@pytest.mark.parametrize("kw", [{}, {"loose_numbered": True, "chunk_size": 7}, {"pattern": "== ?(.*?) ?=="}, {"pattern": "(x*)$"},
                                {"force_chunks": True, "chunk_size": 9}])
def test_index(spark, kw):
    books, parts = tables(spark, 3)
    same(P.split_parts(parts, with_preamble=True, **kw), S.split_chapters(books, with_preamble=True, **kw))


def test_index_in_small_blocks_and_one_character_parts(spark):
    books = make_books(5, 6)
    rows = [(b, i, c) for b, text in books.items() for i, c in enumerate(text or [""])]
    parts = spark.createDataFrame(rows, "book_id string, part_no long, text string")
    same(P.split_parts(parts, bits=6), S.split_chapters(spark.createDataFrame(list(books.items()), "book_id string, text string")))


def test_bodies(spark):
    books, parts = tables(spark, 8)
    same(P.text_of_parts(parts, P.split_parts(parts, chunk_size=11)), S.chapter_text(books, chunk_size=11))


def test_lines(spark):
    books, parts = tables(spark, 9)
    same(P.lines_of_parts(parts), S.lines(books))


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, 1, "第1章 甲\n文\n第", 1), (None, 2, "2章 乙\n文", 1), ("b", None, "第1章 甲", 2), ("b", 0, None, 2), ("b", 0, "\n第2章 乙", 2),
            ("r", 1, "第1章 甲\n", 3), ("r", 1, "第1章 甲\n", 3)]
    parts = spark.createDataFrame(rows, "book_id string, part_no long, text string, idx long").withColumn("start", S.F.lit(5))
    got = sorted(((r.book_id or "", r.idx, r.title, r.start, r.end) for r in P.split_parts(parts).collect()))
    assert got == [("", 1, "第1章 甲", 0, 8), ("", 2, "第2章 乙", 8, 15), ("b", 1, "第1章 甲", 0, 6), ("b", 2, "第2章 乙", 6, 11),
                   ("r", 1, "第1章 甲", 0, 6), ("r", 2, "第1章 甲", 6, 12)]
    texts = {(r.book_id, r.idx): r.text for r in P.text_of_parts(parts, P.split_parts(parts)).collect()}
    assert texts[None, 2] == "第2章 乙\n文" and texts["b", 1] == "第1章 甲" and len(texts) == 6


def test_no_rows(spark):
    parts = spark.createDataFrame([], "book_id string, part_no long, text string")
    assert P.split_parts(parts).isEmpty() and P.lines_of_parts(parts).isEmpty() and P.text_of_parts(parts, P.split_parts(parts)).isEmpty()


DIGEST = ["## 单元1｜起（第1–6章）\n", "## 单元 2\n", "## 附录\n", "# 题\n", "### 小\n", "- **第3章（详） 甲**：乙\n", "- **第1–2章（略）**：丙\n", "- 点\n", "1. 一\n",
          "**【原文·第4章 甲】**\n", "> 引\n", "> 二\n", "\n", "\n", "文字\n", "| a | b |\n", "---\n", "**【重要】**\n", "**【过渡】**\n",
          "- **第5章 甲**：文\n", "- **乙（第1-2章）**：文\n", "  ", "尾"]


def digest_tables(spark, seed):
    rng = random.Random(seed)
    books = {f"d{i}": "".join(rng.choice(DIGEST) for _ in range(rng.randint(0, 70))) for i in range(30)}
    rows = [(b, i, s) for b, text in books.items() for i, s in enumerate(cut(rng, text, 15))]
    return (spark.createDataFrame(list(books.items()), "book_id string, text string"),
            spark.createDataFrame(rows, "book_id string, part_no long, text string"))


@pytest.mark.parametrize("bits", [16, 7])
def test_digest_blocks(spark, bits):
    books, parts = digest_tables(spark, bits)
    same(P.blocks_of_parts(parts, bits), D.digest_blocks(books, ["book_id"]))


@pytest.mark.parametrize("bits", [16, 7])
def test_unit_parts(spark, bits):
    books, parts = digest_tables(spark, bits + 1)
    same(P.units_of_parts(parts, bits), D.unit_parts(books, ["book_id"]))
