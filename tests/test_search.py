"""The search index gives what the scan gives and reads only its postings."""

import random

import pytest

from tomewright.operators import search
from tomewright.operators.catalog import shelf_search


@pytest.mark.parametrize("stretch", [2, 16_384])
def test_index_equals_the_scan(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(search, "POSTINGS", stretch)
    rnd = random.Random(1)
    rows = [(k, rnd.choice(["红楼梦", "Dream of RED", "", None]), "".join(rnd.choice("aAbB红梦 😀") for _ in range(rnd.randrange(12))) or None)
            for k in range(300)]
    cards = spark.createDataFrame(rows, "page_id long, book string, search string").repartition(4)
    search.write_search_index(cards, str(tmp_path / "ix"))
    asked = ["", " ", "r", "红楼", "红楼梦", " of RED", "aab", "abab", "b红梦", "😀😀", "a😀b", "nowhere", "梦 a"]
    for q in asked + ["".join(rnd.choice("ab红 ") for _ in range(4)) for _ in range(6)]:
        got = search.search_index(spark, str(tmp_path / "ix"), q)
        assert got.columns == cards.columns
        assert sorted(r.page_id for r in got.collect()) == sorted(r.page_id for r in shelf_search(cards, q).collect()), q
    plan = search.search_index(spark, str(tmp_path / "ix"), "aab")._jdf.queryExecution().toString()
    assert "In(gram, [aab])" in plan or "EqualTo(gram,aab)" in plan
    longest = spark.read.parquet(str(tmp_path / "ix" / "postings")).selectExpr("max(size(cards))").first()[0]
    assert longest <= stretch


def test_empty_shelf(spark, tmp_path):
    cards = spark.createDataFrame([], "page_id long, book string, search string")
    search.write_search_index(cards, str(tmp_path / "ix"))
    assert search.search_index(spark, str(tmp_path / "ix"), "abc").collect() == []
