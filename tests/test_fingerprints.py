"""Fingerprints, streamed search and the stored index against plain string search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright import session
from tomewright.operators import fingerprints as FP
from tomewright.operators import passages as P


def everywhere(texts, items):
    out = {}
    for i, x in items:
        for j, t in texts:
            at = [p for p in range(len(t or "") - len(x or "") + 1) if x and t[p:p + len(x)] == x]
            if at:
                out[i, j] = (at[0], len(at))
    return out


def corpus(rng):
    """Texts that all hold one line, and a phrase around it that only two hold."""
    line = "这一行文字出现在每一份文件里，长度与一段引文相当，谁也不例外，一共四十多个字符才够长。"
    texts = ["".join(rng.choice("abcdé中𠮷 ") for _ in range(rng.randint(0, 300))) + line
             + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    texts[7] += "前文" + line + "后文独有" * 20
    texts[9] = texts[7][50:] + "x" * 5000 + texts[7]
    return [*enumerate(texts), (90, ""), (91, None), (92, "ab" * 3000)], line


def test_passages_share_a_fingerprint_with_every_text_that_holds_them():
    rng = random.Random(4)
    for _ in range(30):
        t = "".join(rng.choice(rng.choice(["ab", "abcdefg中"])) for _ in range(400))
        codes, _ = FP.code_points([t])
        held = set(FP.minimisers(FP.Hashes(codes).all(FP.GRAM)).tolist())
        assert len(held) < 400
        for p in range(0, 400 - FP.SHORT):
            mine = FP.minimisers(FP.Hashes(codes[p:p + FP.SHORT]).all(FP.GRAM))
            assert len(mine) and all(p + c in held for c in mine.tolist())


def test_stretch_hashes():
    codes, _ = FP.code_points(["abcab" * 30])
    h = FP.Hashes(codes)
    for n in (1, 7, 40):
        every = h.all(n)
        assert (every == h.at(np.arange(len(every)), n)).all()
        assert all((every[i] == every[j]) == ((i - j) % 5 == 0 or (codes[i:i + n] == codes[j:j + n]).all())
                   for i in range(0, 20) for j in range(20))


@pytest.mark.parametrize("heavy", [10, 10 ** 6])
def test_index_equals_plain_search(spark, heavy):
    """Two parts; with a low bound every window of the common line is heavy."""
    rng = random.Random(heavy)
    texts, line = corpus(rng)
    items = [(0, line), (1, line[:FP.SHORT]), (2, "前文" + line + "后文独有" * 15), (3, line[10:] + "后文独有"), (4, "不存在的文字" * 9), (5, ""),
             (6, None), (7, "ab"), (8, "ab" * 1400), (9, texts[9][1][30:3000]), (10, texts[3][1][-40:]), (11, line)]
    rows = spark.createDataFrame(texts, "doc long, norm string")
    passages = spark.createDataFrame(items, "item int, norm string")
    index = FP.PassageIndex(spark, session.new_folder(spark), ["doc"], buckets=4, heavy=heavy)
    index.append(rows.where("doc % 2 = 0")).append(rows.where("doc % 2 = 1"))
    assert (index.heavy().count() > 0) == (heavy == 10)
    want = everywhere(texts, items)
    got = {(r.item, r.doc): (r.pos, r.hits) for r in index.find(passages, "item").collect()}
    assert got == want and len(want) > 100
    # another session knows the index by its path alone
    other = spark.newSession()
    spark.sql(f"DROP TABLE {index.name}")
    again = FP.PassageIndex(other, index.path, ["doc"], buckets=4, heavy=heavy).open()
    assert {(r.item, r.doc): (r.pos, r.hits) for r in again.find(other.createDataFrame(items, "item int, norm string"), "item").collect()} == want


def test_a_common_line_does_not_meet_every_passage_that_holds_it(spark):
    rng = random.Random(1)
    texts, line = corpus(rng)
    rows = spark.createDataFrame(texts, "doc long, norm string")
    blocks = P.text_blocks(rows, ["doc"])
    postings = session.cut_lineage(FP._prints(blocks, "block", ["doc", "base"]))
    chunks = spark.createDataFrame([(k, line + f"{k:05d}" + "q" * 30) for k in range(500)], "id long, chunk string")
    plan = FP.lookup(postings, FP.heavy_prints(postings, 10), blocks, chunks, ["doc"], [], P.BLOCK)
    assert plan.count() == 0
    # looked up by the passage's own fingerprints, not by those of the line
    mine = FP._prints(chunks, "chunk", ["id"]).join(FP.heavy_prints(postings, 10), "fp", "left")
    assert mine.groupBy("id").agg(F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0").count() == 0


def test_large_search_keeps_scopes(spark):
    """The shuffle path with scopes, null scopes and long passages equals the streamed one."""
    rng = random.Random(6)
    books = [(b, k, "".join(rng.choice("abc中") for _ in range(2000)) + "同一句话在每本书里都有一次，而且足够长，可以有自己的指纹。") for b in "xyz" for k in range(4)]
    books.append((None, 9, books[0][2]))
    ct = spark.createDataFrame(books, "book_id string, doc int, norm string")
    segs = [(b, 10 * i + n % 10, t[p:p + n]) for i, (b, _, t) in enumerate(books) for p, n in ((5, 31), (100, 1500), (1990, 38), (7, 3))]
    segs += [("x", 999, books[5][2][:60]), (None, 998, books[0][2][:60])]
    s = spark.createDataFrame(segs, "book_id string, n int, seg string")
    blocks = P.text_blocks(ct, ["book_id", "doc"])
    got = [sorted(tuple(r) for r in P.find_segments(blocks, s, ["book_id", "n"], ["book_id", "doc"], ["book_id"],
                                                    broadcast_probes=probes).collect()) for probes in (0, 10 ** 6)]
    want = sorted((b, n, d, p) for b, n, x in segs for c, d, t in books if b is not None and b == c
                  for p in range(len(t)) if t[p:p + len(x)] == x)
    assert got[0] == got[1] == want
