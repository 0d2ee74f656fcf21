"""Cases that once lost rows or changed behaviour without a word."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tomewright import session
from tomewright.functions import text as T
from tomewright.operators import anchors as A
from tomewright.operators import catalog as C
from tomewright.operators import digest as D
from tomewright.operators import entities as E
from tomewright.operators import passages as P
from tomewright.operators.ordered import ordered_scan, runs
from tomewright.plans import reading as R
from tomewright.streaming.ingest import refresh_text


@pytest.mark.parametrize("bits", [1, 16])
def test_scan_keeps_null_keys_and_null_order(spark, bits):
    rows = [("a", 3, 1), ("a", None, 2), ("a", 9, 4), (None, 1, 8), (None, 7, 16), (None, None, 32)]
    df = spark.createDataFrame(rows, "k string, o long, v int")
    got = ordered_scan(df, ["k"], "o", total={"t": F.col("v")}, behind={"b": F.col("v")}, ahead={"n": F.col("v")}, bits=bits)
    assert {tuple(r) for r in got.collect()} == {
        ("a", None, 2, 0, None, 1), ("a", 3, 1, 2, 2, 4), ("a", 9, 4, 3, 1, None),
        (None, None, 32, 0, None, 8), (None, 1, 8, 32, 32, 16), (None, 7, 16, 40, 8, None)}


def test_runs_read_their_input_once(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 5), ("a", 4), ("a", None)], "k string, n long")
    out = runs(df, ["k"], "n")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2
    assert {tuple(r) for r in out.collect()} == {(None, 1, 2), (None, 5, 5), ("a", 4, 4)}


@pytest.mark.parametrize("few", [0, 10 ** 6])
def test_short_passages_are_found(spark, few):
    corpus = spark.createDataFrame([(1, "abcabcabc"), (2, "xyz"), (3, "")], "doc long, norm string")
    want = {("a", 1): (0, 3), ("ab", 1): (0, 3), ("abc", 1): (0, 3), ("yz", 2): (1, 1), ("bcab", 1): (1, 2)}
    seg = spark.createDataFrame([(s, s) for s in ("a", "ab", "abc", "yz", "bcab", "zz", "")], "p string, norm string")
    got = P.find_passages(seg, corpus, "p", ["doc"], broadcast_probes=few).collect()
    assert {(r.p, r.doc): (r.pos, r.hits) for r in got} == want


def index(spark, spans):
    rows = [(b, i, f"t{i}", 10) for b, nums in spans.items() for i in nums]
    return spark.createDataFrame(rows, "book_id string, idx long, title string, chars long")


def test_books_absent_from_the_scope_are_reported(spark):
    ix = index(spark, {"a": range(5, 9), "b": range(1, 4)})
    assert [tuple(r) for r in R.validate_index(ix, 5, 8).collect()] == [("b", "gap", 5, 8)]
    with pytest.raises(ValueError):
        R.require_valid(ix, 5, 8)


def test_ends_must_close_the_scope(spark):
    ix = index(spark, {"a": range(1, 51)})
    with pytest.raises(ValueError, match="behind the last end"):
        R.plan_segments(ix, ends=[10, 25, 40])
    assert R.plan_segments(ix, ends=[10, 25, 40], hi=40).count() == 3


def test_plans_refuse_a_broken_index(spark):
    ix = index(spark, {"a": [i for i in range(1, 21) if i != 7]})
    for plan in (R.plan_batches, R.plan_segments):
        with pytest.raises(ValueError, match="contiguous"):
            plan(ix)
        assert plan(ix, gate=False).count() > 0


def test_no_cap_at_a_million_characters(spark):
    long = "x" * 1_200_000
    t = spark.createDataFrame([(1, "# " + long)], "doc long, text string")
    assert D.document_title(t, ["doc"]).select(F.length("title")).first()[0] == len(long)
    m = spark.createDataFrame([(1, "# " + long + "\n## " + long)], "shelf_id long, text string")
    assert {len(r.text) for r in C.parse_manifest(m).collect()} == {len(long)}


def test_mentions_of_both_patterns(spark):
    texts = spark.createDataFrame([("b", 1, "Anna met Annabel and Bo")], "book_id string, doc_id long, text string")
    al = spark.createDataFrame([("b", "Anna", "A"), ("b", "Annabel", "B"), ("b", "Bo", "C")],
                               "book_id string, alias string, canonical string")
    got = E.mentions(texts, al, "book_id", ["book_id", "doc_id"]).orderBy("ord").collect()
    assert [r.alias for r in got] == ["Anna", "Annabel", "Bo"]


def test_refresh_of_an_empty_store(spark, tmp_path):
    schema = "path string, modificationTime timestamp, length long, content binary"
    store, when = str(tmp_path / "store"), datetime.datetime(2024, 1, 1)
    none = spark.createDataFrame([], schema)
    assert refresh_text(spark, none, store).count() == 0
    one = spark.createDataFrame([("file:/lib/a/1.txt", when, 3, b"abc")], schema)
    assert [r.text for r in refresh_text(spark, one, store, trust_utf8=True).collect()] == ["abc"]


def test_a_huge_heading_range_is_one_row(spark):
    d = spark.createDataFrame([("b", 1, "## 单元1｜甲（第1–999999章）\n见第70000章和第1000000章\n")], "book_id string, doc_id long, text string")
    keys = ["book_id", "doc_id"]
    b = D.digest_blocks(d, keys)
    got = {r.a: r.anchor for r in A.resolve_refs(d, b, D.units(b, keys), keys).where("kind = 'single'").collect()}
    assert got == {70000: "u-1", 1000000: None}


def test_entities_and_digits(spark):
    row = spark.createDataFrame([("a&nbsp;&mdash;&#8212;&#x4e66;&hellip;&amp;lt;", "第１２–１８章", "第１２章")], "h string, r string, c string")
    got = row.select(T.html_unescape(F.col("h")).alias("h"), T.guess_range(F.col("r")).alias("r"),
                     T.declared_chapter(F.col("c")).alias("c"), T.chapter_list(F.col("r")).alias("l"),
                     T.chapter_list(F.lit("1-400")).alias("capped"), T.chapter_list(F.lit("1-400"), None).alias("open")).first()
    assert got.h == "a ——书…&lt;" and tuple(got.r) == (12, 18) and got.c == 12 and got.l == list(range(12, 19))
    assert got.capped == [1, 400] and got.open == list(range(1, 401))


def test_shared_folder_rule(spark, monkeypatch, tmp_path):
    class Fake:
        """Stands for a session on a cluster."""
        class sparkContext:
            master = "yarn"
            getConf = staticmethod(lambda: {})

        class conf:
            get = staticmethod(lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.new_folder(Fake)
    Fake.conf.get = staticmethod(lambda key, default=None: "hdfs://x/shared/")
    monkeypatch.setattr(session, "_made", [])
    assert session.new_folder(Fake).startswith("hdfs://x/shared/tomewright-")
    monkeypatch.setattr(session, "_made", [])
    Fake.conf.get, Fake.sparkContext.master = staticmethod(lambda key, default=None: default), "local[4]"
    monkeypatch.setattr(session, "_local_folder", lambda: str(tmp_path))
    assert session.new_folder(Fake).startswith(str(tmp_path))
    monkeypatch.setattr(session, "_made", [])
    df = session.cut_lineage(spark.range(3))
    path = session._made[0].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    assert session.release(spark) == 1 and not os.path.exists(path)


def test_gaps_equal_brute_force(spark):
    import random

    from tomewright.operators import coverage as V
    rng = random.Random(9)
    books = {"a": range(1, 40), "b": [i for i in range(3, 60) if i % 7], "c": [5], "d": range(1, 4)}
    refs = {(b, d): sorted({rng.randint(1, 62) for _ in range(rng.choice([0, 3, 30]))}) for b in "abcx" for d in range(4)}
    docs = spark.createDataFrame([(b, str(d), "".join(f"第{n}章 " for n in r)) for (b, d), r in refs.items()],
                                 "book_id string, doc_id string, text string")
    want, runs_ = set(), set()
    for (b, d), r in refs.items():
        miss = [i for i in books.get(b, ()) if i not in r and 4 <= i <= 50]
        want |= {(b, str(d), i) for i in miss}
        runs_ |= {(b, str(d), i) for i in miss if i - 1 not in miss}
    ix = index(spark, books)
    assert {tuple(r) for r in V.missing_chapters(docs, ix, 4, 50).collect()} == want
    assert {(r.book_id, r.doc_id, r.first) for r in V.missing_runs(docs, ix, 4, 50, bits=3).collect()} == runs_
