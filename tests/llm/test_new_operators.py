"""Transducer lexicon, hard negatives and periodic runs against plain versions."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from brute import WORD
from pyspark.sql import functions as F

from tomewright.llm import lexicon, negatives, periods
from tomewright.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = ["Hello  World's Été 123 <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "日本 ok!!", "", "   ", "á \x00 ퟿", None,
       "՘x ᲉA ΑΣ Σ İı ǅ", "x" * 500 + " " + "ab" * 300, "a\tb\x1cc\x85d e  ́f é ̈́",
       "<|endoftext|><|endoftext|>", "don't WE'LL 'S'd", "\n\n a\n", "🙂🙂 ok 🙂", "<|endoftext", "one two " * 4000]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("most", [0, 40, 5000])
def test_lexicon_equals_the_library(spark, documents, model, most):
    """Any size of the lexicon gives the library's ids and decoded text."""
    from tokenizers import Tokenizer
    tok, rng = Tokenizer.from_file(model), random.Random(most)
    syl = ["an", "the", "ou", "qué", "ß", "ing", "3", "'s", "!", "ж", "，", "Q"]
    rows = [(k, t) for k, t in enumerate(ODD)]
    rows += [(100 + k, " ".join("".join(rng.choice(syl) for _ in range(rng.randint(1, 6))) for _ in range(60))) for k in range(40)]
    rows += [(3, "a repeated id"), (3, "a repeated id"), (None, "no id")]
    docs = documents(rows)
    counts = lexicon.count_words(docs, model)
    seen = {r["word"]: r["n"] for r in counts.collect()}
    assert seen["two"] == 4000 and seen["repeated"] == 2
    name = lexicon.compile_lexicon(spark, counts, model, most)
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in lexicon.encode_texts(docs, model, name).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    digest = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in lexicon.digest_texts(docs, model, name).collect()}
    assert digest == {(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
                      for i, x, d in want}


def test_lexicon_of_an_empty_table(spark, documents, model):
    docs = documents([(1, "x")]).where("doc_id = 2")
    name = lexicon.compile_lexicon(spark, lexicon.count_words(docs, model), model)
    assert lexicon.encode_texts(docs, model, name).count() == 0


def test_automaton_is_minimal():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))).encode() + rng.choice([b"ing", b"ed", b""]) for _ in range(200)})
    a = lexicon.Automaton.build(words, np.arange(len(words)), np.arange(len(words) + 1))
    data = words + [w + b"x" for w in words] + [w[:-1] for w in words] + [b""]
    found = a.find(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(w) for w in data])])
    assert found.tolist() == [words.index(w) if w in words else -1 for w in data]
    tails = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(a.final) == len(tails)               # one state for each set of endings


def plain_negatives(rows, every, positives, count, low, high):
    ok = [(i, [math.floor(256 * float(x)) for x in e], lab, k) for k, (i, e, lab) in enumerate(rows)
          if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a in (r for r in ok if r[0] % every == 0):
        near = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[2]) for b in ok if b[3] != a[3] and len(b[1]) == len(a[1]))
        for s, i in [(s, i) for s, i, lab in near if lab == a[2]][:positives]:
            hard = [(-t, j) for t, j, lab in near if lab != a[2] and -low * s <= -100 * t <= -high * s][:count]
            out += [(a[0], i, k + 1, j, -s, t) for k, (t, j) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("block, chunk, spread", [(4096, 2048, 1.0), (7, 3, 0.3), (16, 64, 0.05)])
def test_negatives(spark, block, chunk, spread):
    rng = np.random.default_rng(block)
    centre = rng.normal(size=(6, 12))
    rows = [(int(i), (centre[i % 6] + spread * rng.normal(size=12)).tolist(), int(rng.integers(0, 4))) for i in range(240)]
    rows += [(1000 + k, rows[5][1], k % 3) for k in range(60)]                # a group of equal vectors: ties by id
    rows += [(300, [0.0] * 12, 1), (301, [0.0] * 12, 2), (310, rows[5][1], None), (320, None, 1), (330, [None] + rows[5][1][1:], 1),
             (340, [float("nan")] + rows[5][1][1:], 2), (350, [float("inf")] + rows[5][1][1:], 2), (None, rows[5][1], 1),
             (360, [1.0, 2.0], 1), (361, [1.5, 2.0], 1), (362, [1.0, 0.5], 2), (370, [], 1), (380, rows[5][1], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).withColumn("rank", F.lit("x"))
    got = negatives.hard_negatives(df.withColumn("block", F.lit(1)), F.col("vec_id") % 10 == 0, block=block, chunk=chunk)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, 10, 5, 10, 30, 90)
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == want and len(want) > 300


def test_negatives_of_nothing_and_great_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    big = [(10, [1e12, 3.0], 1), (11, [1e12, -1.0], 1), (12, [5e11, 7.0], 2), (13, [1e300, 0.0], 2), (14, [0.0, 0.0], 2)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(df, F.col("vec_id") == 10).collect()
    a, p, n = ([math.floor(256 * x) for x in e] for e in (big[0][1], big[1][1], big[2][1]))
    dot = lambda x, y: min(sum(s * t for s, t in zip(x, y)), 2 ** 63 - 1)
    assert negatives.exact_scores(np.array([a]), np.array([p, n])).tolist() == [[dot(a, p), dot(a, n)]]
    assert {r["negative_id"] for r in got} <= {12, 13}


def test_bounds_hold():
    """No score leaves its bounds, for rows and for blocks of rows."""
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(200, 9)) * rng.choice([1e-2, 1, 100], size=(200, 1))).astype(np.int64)
    v[:40] = v[0]
    norm, ang = negatives.angles(v, negatives.reference_directions(v[:50].astype(float), 9))
    exact = negatives.exact_scores(v, v)
    low, up = negatives.pair_bounds(ang, norm, ang, ang, norm, norm)
    assert (low <= exact).all() and (exact <= up).all() and (up[:40, :40] - low[:40, :40]).max() < 1e-3 * exact[0, 0]
    low, up = negatives.pair_bounds(ang, norm, ang[None, 20:60].min(axis=1), ang[None, 20:60].max(axis=1), norm[20:60].min()[None],
                                    norm[20:60].max()[None])
    assert (low <= exact[:, 20:60]).all() and (exact[:, 20:60] <= up).all()


def plain_runs(w, least=24, times=3):
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1) if j == i else j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(rng, n):
    for _ in range(n):
        size, kinds = rng.randint(0, 220), rng.choice([1, 2, 3, 40])
        w = [f"w{rng.randrange(kinds)}é" for _ in range(size)]
        for _ in range(rng.randint(0, 4)):
            if size > 10:
                a, p, k = rng.randrange(size), rng.randint(1, 30), rng.randint(5, 150)
                for i in range(a + p, min(size, a + k)):
                    w[i] = w[i - p]
        yield rng.choice([" ", "\n", " \t"]).join(w)


@pytest.mark.parametrize("least", [24, 5])
def test_runs(documents, least):
    rng = random.Random(least)
    rows = list(enumerate(periodic_texts(rng, 150)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "x " * 5000), (504, "a b " * 11), (505, "a b " * 12), (506, "ab cd " * 30),
             (507, " ".join(str(i % 700) for i in range(9000))), (3, rows[3][1]), (3, "x y"), (None, "z " * 30)]
    df = documents(rows).withColumn("runs", F.lit("mine"))
    got = periods.with_runs(df, least=least)
    assert set(df.columns) < set(got.columns)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        found = plain_runs(w, least) if len(w) < 1000 else None
        want.append((i, len(w), found, None if found is None else collapsed(w, found)))
    at = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()), key=repr)
    long = {r[0]: r[2:] for r in at if r[1] >= 1000}
    assert long == {503: ([(0, 5000, 1)], "x"), 507: ([(0, 9000, 700)], " ".join(map(str, range(700))))}
    assert [r for r in at if r[1] < 1000] == sorted((r for r in want if r[2] is not None), key=repr)
    assert periods.with_runs(df.where("doc_id = -1")).count() == 0


def test_extensions():
    rng = random.Random(2)
    for _ in range(40):
        texts = [[rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randint(2, 90))] for _ in range(4)]
        texts[1] = texts[1][:7] * 9
        off = np.r_[0, np.cumsum([len(t) for t in texts])]
        flat = np.array([x for t in texts for x in t])
        g = periods.Grammar(flat, off)
        q = [(k, *sorted(rng.sample(range(len(t)), 2))) for k, t in enumerate(texts) for _ in range(15)]
        i, j = (np.array([off[x[0]] + x[c] for x in q]) for c in (1, 2))
        for (k, a, b), right, left in zip(q, g.extend(i, j, True), g.extend(i, j, False)):
            t = texts[k]
            assert right == next((n for n in range(len(t) - b) if t[a + n] != t[b + n]), len(t) - b)
            assert left == next((n for n in range(a) if t[a - 1 - n] != t[b - 1 - n]), a)


def test_op13_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, tails = [], 0
    for i, t in docs:
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, tails = w[:a] + [w[a + k % p] for k in range(n - a)], tails + 1
        if n > 2500:            # plain search is quadratic
            want.append((i, None))
            continue
        found = plain_runs(w)
        best = min(found, key=lambda r: (-(10 ** 12 * r[1] // r[2]), r[0], r[2])) if found else (None,) * 3
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None,
                     sha("".join("%d,%d,%d\n" % r for r in found)), sha(collapsed(w, found))))
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periods"][0](spark, FOLDER).collect()}
    assert len(got) == len(docs) and tails > 5
    assert [got[w[0]] for w in want if len(w) > 2] == [w for w in want if len(w) > 2] and sum(len(w) > 2 for w in want) > 150


def test_op11_equals_the_library(spark, model):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(model)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    want = []
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in QUERIES["op11_lexicon"][0](spark, FOLDER).collect()) == sorted(want)


def test_op12_equals_sql(spark):
    fn, sql = QUERIES["op12_negatives"]
    got = sorted(tuple(r) for r in fn(spark, FOLDER).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    assert got == sorted(con.sql(sql).fetchall()) and got
