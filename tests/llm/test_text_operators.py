"""Operators on documents against brute force, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from brute import WORD, classes, strip

from tomewright.llm import attention, mixing, pieces, probminhash, rules, suffixes, toxicity


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Über", "naïve", "x", "日本"]) + str(rng.randint(0, 40))
                    for _ in range(n))


# -- strings of 100 bytes ---------------------------------------------------
@pytest.mark.parametrize("ways", [{}, {"hot": 1}])
def test_suffixes(documents, ways):
    rng = random.Random(3)
    line, other = prose(rng, 40), prose(rng, 60)
    rows = [(k, prose(rng, 30) + "\n" + line + "\n" + prose(rng, rng.randint(0, 30))) for k in range(30)]
    rows += [(100, None), (101, ""), (102, "a" * 1000), (103, "ab" * 400), (104, line[:99]), (105, other + other),
             (106, other[:150] + "ü" + other[151:]), (None, rows[3][1]), (107, prose(rng, 4000)), (-5, rows[7][1])]
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.digest_kept(documents(rows), **ways).collect()}
    assert got == strip(rows)


def test_suffixes_repeated_rows_and_empty(documents):
    t = prose(random.Random(1), 80)
    got = [tuple(r)[:4] for r in suffixes.digest_kept(documents([(1, t), (1, t), (2, t)])).collect()]
    n = len(t.encode())
    assert sorted(got) == [(1, n, 0, 0), (1, n, 0, 0), (2, n, n, 1)]
    assert suffixes.digest_kept(documents([(1, t)]).limit(0)).collect() == []


def test_remove_repeats_keeps_characters(documents):
    t = "é" * 120
    df = documents([(1, t), (2, "x" + t + "y"), (3, None)])
    out = suffixes.remove_repeats(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: ("é", 1), 2: ("xy", 2), 3: (None, None)}


# -- near duplicates ------------------------------------------------------
@pytest.mark.parametrize("block", [1500, 3])
def test_probminhash(documents, block):
    rng = random.Random(5)
    base = prose(rng, 120).split(" ")
    rows = [(k, prose(rng, rng.randint(1, 80))) for k in range(20)]
    for k in range(40):                     # chains of near copies around one text
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = "changed%d" % rng.randint(0, 99)
        rows.append((100 + k, " ".join(w)))
    rows += [(200, None), (201, None), (202, ""), (203, ""), (204, "one two"), (205, "one two "), (206, "spam " * 300),
             (207, "spam " * 280), (208, " ".join(base) + " " + " ".join(base)), (209, prose(rng, 3000))]
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(documents(rows), block=block).collect()}
    assert got == classes(rows)


def test_probminhash_repeated_rows_and_empty(documents):
    t = "a b c d e f g"
    got = sorted((tuple(r) for r in probminhash.near_duplicates(documents([(4, t), (4, t), (2, t), (None, t), (9, "z")])).collect()), key=repr)
    assert got == [(2, 2), (4, 2), (4, 2), (9, 9), (None, None)]      # a row without an id is a class of its own
    assert probminhash.near_duplicates(documents([(4, t)]).limit(0)).collect() == []


# -- pieces -----------------------------------------------------------------
def test_pieces(documents):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, rng = SentencePieceProcessor(model_file=path), random.Random(2)
    odd = "ab  \n\t▁éß日本語😀\x00xyzthe.,#①<>/s"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "   ", "a" * 3000, "ab" * 2000, "日本" * 1500, "<s></s><unk><0x41>", "the " * 5000, "z", "z\x00"]
    df = documents(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in pieces.encode_texts(df, path).collect()}
    digests = {r["doc_id"]: r for r in pieces.digest_texts(df, path).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["decoded"] == sp.decode(ids)
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.digest_texts(df.limit(0), path).collect() == []


# -- rules ----------------------------------------------------------------
def statistics(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    n, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(k, k + 8))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))


def test_rules(documents, labels):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randint(0, 90)) + rng.choice(["", "\n"])) for k in range(60)]
    rows += [(100 + k, "### $$ ".join(prose(rng, 40).split())) for k in range(15)]
    rows += [(200, None), (201, ""), (202, "\n\n \n"), (203, "a\na\n a\nb"), (204, "one two three four five six seven eight " * 9),
             (205, prose(rng, 9000)), (206, "日本 " * 30), (207, "|")]
    df = documents(rows)
    forest = rules.learn(df, labels([(i, 0 if 100 <= i < 115 else 1, 0) for i, _ in rows]))
    got = rules.judge(df, forest)
    assert set(df.columns) < set(got.columns) and got.count() == len(rows)
    for r, t in [(r, dict(rows)[r["doc_id"]]) for r in got.collect()]:
        e = statistics(t)
        assert tuple(r[c] for c in rules.COUNTS) == e
        assert r["base_failed"] == (e[0] < 20 or 100 * e[4] > 30 * e[0])
        if 100 <= r["doc_id"] < 115 or r["base_failed"]:
            assert not r["kept"]
        elif r["doc_id"] < 60:
            assert r["kept"]


def test_rules_without_labels_or_rows(documents, labels):
    df = documents([(1, prose(random.Random(1), 40))])
    assert rules.learn(df, labels([])) is None
    assert [r["kept"] for r in rules.judge(df, None).collect()] == [True]
    assert rules.judge(df.limit(0), None).collect() == []


# -- learned scores -----------------------------------------------------------
def held_out(spark, scored, column, split, held, cut):
    got = scored.where(f"crc32(cast(cast(doc_id AS STRING) AS BINARY)) % {split} = {held}").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    return sum((r["score"] >= cut) == (r[column] == 1) for r in got) / len(got)


def test_quality_held_out(spark):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = attention.with_score(docs, attention.learn(docs, lab))
    assert held_out(spark, scored, "quality", 3, 1, 0.5) >= 0.95


def test_toxicity_held_out(spark):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.with_score(docs, toxicity.learn(docs, lab))
    assert held_out(spark, scored, "toxic", 4, 2, 0.3) >= 0.9


def test_scores_of_odd_rows(documents, labels):
    df = documents([(1, None), (2, ""), (3, " \n"), (4, "You are a stupid idiot."), (5, "x" * 50_000), (None, "words here"), (4, "")])
    for model in (attention.learn(df, labels([])), attention.learn(df, labels([(1, 1, 0), (2, 0, 1), (3, 1, None), (None, 1, 1)]))):
        out = attention.with_score(df, model).collect()
        assert len(out) == 7 and all(0 <= r["score"] <= 1 for r in out)
    g = toxicity.learn(df, labels([]))
    out = toxicity.with_score(df, g).collect()
    assert len(out) == 7 and all(0 <= r["score"] <= 1 for r in out)
    assert [r["score"] >= 0.3 for r in out if r["text"] and "idiot" in r["text"]] == [True]
    assert toxicity.with_score(df.limit(0), g).collect() == []


def test_grammar_weighs_context():
    g = toxicity.Grammar()
    plain, negated, reported, clean = g.score(["The man is a moron.", "The man is not a moron.",
                                               "The man said a moron.", "The moron. tree is green".replace("moron", "maroon")])
    assert plain > reported > clean and plain > negated > clean
    threat, none = g.score(["I will kill you now", "I will kill. you know"])
    assert threat > 0.3 > none


def test_grammar_equals_a_plain_walk():
    """Every clause walked word by word, windows counted by hand."""
    rng, g = random.Random(4), toxicity.Grammar()
    vocab = ["moron", "kill", "you", "not", "said", "tree", "green", ".", "\n"]
    for _ in range(200):
        toks = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        want, begin = [0.0] * toxicity.PATTERNS, 0
        for k, w in enumerate(toks):
            if w in ".\n":
                begin = k + 1
                continue
            before = toks[begin:k]
            neg, rep, tgt = "not" in before[-3:], "said" in before, "you" in before[-4:]
            if w == "moron":
                want[4 * rep + 2 * neg + tgt] += 1
            if w == "you":
                last = next((i for i in range(len(before) - 1, -1, -1) if before[i] == "you"), -1)
                if "kill" in before[max(last + 1, len(before) - 4):]:
                    want[8 + 2 * rep + neg] += 1
        assert g.patterns([" ".join(toks)])[0].tolist() == want, toks


# -- mixing -----------------------------------------------------------------
def test_mixing(documents):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for k in range(600)]
    rows += [(700, None, "empty"), (701, "", "empty"), (None, "x y", "b")]
    df = documents(rows)
    got = mixing.with_copies(df).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        n = len(WORD.findall(r["text"] or ""))
        assert r["size"] == n and r["copies"] <= 2
        sizes[r["source"]] += n
        taken[r["source"]] += r["copies"] * n
        target[r["source"]] = r["target"]
    # water filling by rounds
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        if not full:
            want |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            want[s] = 2 * sizes[s]
            open_.remove(s)
            left -= want[s]
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 0.15 * target[s] + 60
    out = mixing.emit(df)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    assert mixing.emit(df.limit(0)).collect() == []
