"""Suffix order by a difference cover against sorting the suffixes themselves."""

import random

import pytest

from brute import strip
from tomewright.llm import cover


@pytest.mark.parametrize("depth", [4, 9, 30])
def test_places_order_all_suffixes(spark, depth):
    rnd = random.Random(depth)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 90))) for _ in range(12)] + ["a" * 70, "a" * 71, "b", texts_of("abc")]
    rows = [(s, k, ord(c)) for s, t in enumerate(texts) for k, c in enumerate(t)]
    got = {(r.s, r.k): r.r for r in cover.suffix_places(spark.createDataFrame(rows, "s long, k long, x long"), depth).collect()}
    assert len(got) == len(rows)
    order = sorted(got, key=lambda p: (texts[p[0]][p[1]:][:depth], p))
    for a, b in zip(order, order[1:]):
        same = texts[a[0]][a[1]:][:depth] == texts[b[0]][b[1]:][:depth]
        assert same or got[a] < got[b]


def texts_of(unit):
    return unit * 25


def test_removed_equals_brute_force(spark, documents):
    rnd = random.Random(6)
    passage = [" ".join(rnd.choice(["ab", "cde", "é", "日本", "x"]) for _ in range(60)) for _ in range(4)]
    rows = [(k, " ".join(rnd.choice(passage)[rnd.randrange(40):] if rnd.random() < .5 else str(rnd.random()) * 8 for _ in range(3))) for k in range(25)]
    rows += [(30, None), (31, ""), (32, "a" * 350), (33, "ab" * 49), (34, "z" * 99), (2 ** 63 - 1, passage[0]), (-5, passage[1]), (None, passage[2])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in cover.removed(documents(rows)).collect()}
    want = strip(rows)
    assert {k: got[k] for k, _ in rows} == {k: tuple(want[k][:3]) for k, _ in rows}
    assert cover.removed(documents(rows[:1]).limit(0)).collect() == []
