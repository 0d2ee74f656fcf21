"""Cases of the third round's findings."""

import random

import pytest
from pyspark.sql import functions as F

from tomewright.operators import passages as P
from tomewright.operators import quotes as Q


def greedy(flat, segs):
    cur, out = 0, []
    for s in segs:
        p, late = flat.find(s, cur), False
        if p < 0:
            p, late = flat.find(s), True
        if p >= 0:
            cur = p + len(s)
        out.append((p, late) if p >= 0 else None)
    return out


def test_a_common_piece_is_searched_once(spark, monkeypatch):
    """Two hundred slices quote a line that stands two hundred times: 200 occurrences are kept, not 40,000."""
    line = "这一行到处都有的文字啊"
    ct = spark.createDataFrame([("b", i, f"{line}第{i}篇独有") for i in range(1, 201)], "book_id string, idx int, norm string")
    sl = spark.createDataFrame([("b", "d", i, f"第{i}章", "", f"{line}……第{i}篇独有") for i in range(1, 201)],
                               "book_id string, doc_id string, slice_no int, chapter string, label string, text string")
    kept = []
    find = P.find_segments
    monkeypatch.setattr(Q, "find_segments", lambda *a, **k: kept.append(found := find(*a, **k)) or found)
    rows = Q.verify_slices(sl, ct).collect()
    assert kept[0].count() == 400
    assert {(r.slice_no, r.n_segments, r.n_found, r.pos) for r in rows} == {(i, 2, 2, 0) for i in range(1, 201)}
    assert [r.chapters for r in rows if r.slice_no == 7] == ["第1章、第7章"]


@pytest.mark.parametrize("inline", [0, 3, 10 ** 9])
def test_pieces_in_order_equal_greedy(spark, inline):
    rnd = random.Random(8)
    books = {b: "".join(rnd.choice("ab") for _ in range(400)) for b in ("p", "q")}
    slices = {(b, i): ["zzzz" if rnd.random() < 0.1 else flat[p:p + rnd.randint(4, 7)] for p in (rnd.randrange(390) for _ in range(rnd.randint(1, 6)))]
              for b, flat in books.items() for i in range(25)}
    names = {x: n for n, x in enumerate(sorted({(b, s) for (b, _), sl in slices.items() for s in sl}))}
    occ = [(n, p) for (b, s), n in names.items() for p in range(400) if books[b].startswith(s, p)]
    segs = [(b, i, j, names[b, s], len(s)) for (b, i), sl in slices.items() for j, s in enumerate(sl)] + [(None, 1, 0, 0, 4)]
    got = Q.locate_pieces(spark.createDataFrame(segs, "book_id string, n int, seg_no int, piece long, len int"),
                          spark.createDataFrame(occ, "piece long, pos long"), ["book_id", "n"], inline).collect()
    assert {(r.book_id, r.n, r.seg_no): (r.pos, r.out_of_order) for r in got} == {
        (b, i, j): w for (b, i), sl in slices.items() for j, w in enumerate(greedy(books[b], sl)) if w}
    assert len(got) == len({(r.book_id, r.n, r.seg_no) for r in got})


@pytest.mark.parametrize("most", [200, 7])
def test_passages_in_shards_by_scope(spark, most):
    rnd = random.Random(4)
    texts = {b: "".join(rnd.choice("abcd") for _ in range(9000)) for b in range(6)}
    segs = [(b, i, t[p:p + n]) for b, t in texts.items() for i, (p, n) in enumerate((rnd.randrange(8000), rnd.choice((4, 30, 300, 1500))) for _ in range(8))]
    blocks = P.text_blocks(spark.createDataFrame([(b, t) for b, t in texts.items()] + [(None, "abcd" * 30)], "book int, norm string"), ["book"])
    got = P.find_segments(blocks, spark.createDataFrame([*segs, (None, 0, "abcd")], "book int, i int, seg string"), ["book", "i"], ["book"], ["book"],
                          broadcast_probes=most).collect()
    want = {(b, i, p) for b, i, s in segs for p in range(9000) if texts[b].startswith(s, p)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_spans_in_shards(spark):
    ct = spark.createDataFrame([(b, i, f"{b}{i:04d}" * 300) for b in "xy" for i in range(20)], "book_id string, idx int, norm string")
    spans = P.flat_spans(ct)
    want = sorted(P.flat_blocks(ct, spans).collect())
    assert sorted(P.flat_blocks(ct, spans, 15).collect()) == want and len(want) > 10
