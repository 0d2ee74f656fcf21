"""Cases of the fourth round's findings."""

import random

import pytest

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


def quoted(rnd, books, n):
    """Slices of short and long stretches of their book, some in order, some with pieces that stand nowhere."""
    out = {}
    for b, flat in books.items():
        for i in range(n):
            at = sorted(rnd.randrange(len(flat) - 10) for _ in range(rnd.randint(1, 7)))
            if rnd.random() < 0.3:
                rnd.shuffle(at)
            out[b, i] = ["zzzz" if rnd.random() < 0.1 else flat[p:p + rnd.choice((4, 5, 6, 30, 1500, 6000))] for p in at]
    return out


@pytest.mark.parametrize("listed", [0, 3, 256])
def test_slices_of_common_pieces_equal_greedy(spark, listed):
    """Pieces too common to list are looked for in the text, over several stretches and over their ends."""
    rnd = random.Random(listed)
    books = {"p": "".join(rnd.choice("ab") for _ in range(20_000)), "q": "".join(rnd.choice("abcdef") for _ in range(9000)) + "ab" * 3000}
    slices = quoted(rnd, books, 25)
    chapters = [(b, i, t[lo:lo + 700]) for b, t in books.items() for i, lo in enumerate(range(0, len(t), 700), 1)]
    ct = spark.createDataFrame(chapters, "book_id string, idx int, norm string")
    sl = spark.createDataFrame([(b, "d", i, "", "", "……".join(s)) for (b, i), s in slices.items()],
                               "book_id string, doc_id string, slice_no int, chapter string, label string, text string")
    got = {(r.book_id, r.slice_no): r for r in Q.verify_slices(sl, ct, listed=listed, stretch=12).collect()}
    for k, s in slices.items():
        want = greedy(books[k[0]], s)
        hit = [w for w in want if w]
        status = "FAIL" if len(hit) < len(s) else "WARN" if any(late for _, late in hit) else "PASS"
        places = list(dict.fromkeys(f"第{p // 700 + 1}章" for p, _ in hit))
        r = got[k]
        assert (r.n_segments, r.n_found, r.pos, r.status, r.chapters) == (len(s), len(hit), hit[0][0] if hit else None, status, "、".join(places))


def test_common_pieces_are_not_listed(spark):
    """A piece of four letters that stands 4,000 times costs a few rows, and its first place is known."""
    ct = spark.createDataFrame([("b", i, "uvwx" * 40 + f"{i:04d}") for i in range(100)], "book_id string, idx int, norm string")
    blocks = P.flat_blocks(ct, P.flat_spans(ct)).coalesce(1)
    segs = spark.createDataFrame([(1, "b", "uvwx"), (2, "b", "0042"), (3, "c", "uvwx")], "piece int, book_id string, seg string")
    rows = P.find_segments(blocks, segs, ["piece"], ["book_id"], ["book_id"], most=20).collect()
    assert sum(r.piece == 1 for r in rows) == 21 and min(r.pos for r in rows if r.piece == 1) == 0
    assert [(r.pos, r.more, r.book_id) for r in rows if r.piece == 2] == [(42 * 164 + 160, False, "b")]
    assert not any(r.piece == 3 for r in rows) and sum(r.more for r in rows) == 1


def test_passages_reach_the_driver_as_numbers(spark, monkeypatch):
    """Of passages of any length only hashes are broadcast."""
    sizes = []
    make = P.FP.Probes.__init__
    monkeypatch.setattr(P.FP.Probes, "__init__", lambda self, rows, *a: (sizes.append(rows.nbytes / max(rows.num_rows, 1)), make(self, rows, *a))[1])
    rnd = random.Random(2)
    t = "".join(rnd.choice("abcdefgh") for _ in range(60_000))
    blocks = P.text_blocks(spark.createDataFrame([("x", t)], "doc string, norm string"), ["doc"])
    segs = spark.createDataFrame([(i, t[i * 1000:i * 1000 + 1000]) for i in range(50)], "n int, seg string")
    got = P.find_segments(blocks, segs, ["n"], ["doc"]).collect()
    assert sorted((r.n, r.pos) for r in got) == [(i, 1000 * i) for i in range(50)]
    assert len(sizes) == 1 and sizes[0] < 100


def test_near_copies_do_not_meet_each_other(spark, monkeypatch):
    """A hundred long passages that differ in one character each: places are compared where the passage is rare."""
    kept = []
    monkeypatch.setattr(P, "_whole", lambda parts, hits, *a, f=P._whole: kept.append(hits.count()) or f(parts, hits, *a))
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    copies = [base[:2500] + f"<{i:03d}>" + base[2505:] for i in range(100)]
    ct = spark.createDataFrame([("b", i, t) for i, t in enumerate(copies)], "book_id string, idx int, norm string")
    segs = spark.createDataFrame([(i, "b", t) for i, t in enumerate(copies)] + [(100, "b", base)], "piece int, book_id string, seg string")
    got = P.find_segments(P.flat_blocks(ct, P.flat_spans(ct)), segs, ["piece"], ["book_id"], ["book_id"], most=20).collect()
    assert sorted((r.piece, r.pos, r.more) for r in got) == [(i, 3000 * i, False) for i in range(100)]
    assert kept and kept[0] <= 4 * 100          # 200 of the two shared chunks, one each of the other two
