"""Cases that once lost rows, columns or time."""

import gzip
import math
import random
import time

import numpy as np
import pytest
from brute import classes
from pyspark.sql import functions as F
from test_other_operators import record

from tomewright.llm import forest, mixing, probminhash, rules, suffixes, warc
from tomewright.session import new_folder


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_texts_of_one_id_are_classified_each_by_its_own(documents):
    """Near copies under repeated ids keep their links, whichever text an id also carries."""
    rng = random.Random(9)
    a, b, c = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (4, c), (5, "x " + c), (None, a), (None, None), (6, None), (6, "")]
    got = probminhash.classes(documents(rows)).collect()
    numbered = classes([(k, t) for k, (i, t) in enumerate(rows) if i is not None])
    want = []
    for k, (i, t) in enumerate(rows):
        if i is None:
            want.append((None, None, True))
            continue
        group = [rows[j] for j, g in numbered.items() if g == numbered[k]]
        want.append((i, min(g[0] for g in group), None))
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == sorted(((i, c) for i, c, _ in want), key=repr)
    assert sum(r["kept"] for r in got) == 2 + 5 + 1                 # null ids, classes, the equal row of id 4


def test_pipeline_stage_keeps_unequal_texts_of_an_id(spark, documents):
    import corpus_pipeline as cp
    rng = random.Random(2)
    a, b = prose(rng, 60), prose(rng, 60)
    docs = documents([(1, a), (1, b), (1, b), (2, a + " z"), (3, None), (3, "ok then"), (None, a)]).withColumn("k", F.lit(1)).withColumn("c", F.lit("m"))
    got = cp.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(
        [(1, a), (1, b), (3, None), (3, "ok then"), (None, a)], key=repr)


def test_columns_pass_with_their_values(spark, documents):
    """Input columns that are called like an operator's own."""
    names = ["size", "source_size", "target", "copies", "copy", "row", "_src", "_doc", "_part", "_runs", "_toxicity", "a.b"]
    docs = documents([(k, f"word{k} " * (k + 1), "ab"[k % 2]) for k in range(20)])
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n + " of "), F.col("doc_id").cast("string")))
    plain = {r["doc_id"]: r for r in docs.collect()}
    for out in (mixing.emit(docs), suffixes.remove_repeats(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == plain[r["doc_id"]][n] for r in rows for n in names)
    taken = {r["doc_id"]: r["copies"] for r in mixing.with_copies(docs).collect()}
    got = [r["doc_id"] for r in mixing.emit(docs).collect()]
    assert {i: got.count(i) for i in plain} == taken


def test_labels_that_are_not_whole_numbers(spark):
    v = [1.0, 0.5, 0.25]
    rows = [(1, v, 1.2), (2, v, 1.7), (3, v, 1.2), (4, v, None)]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)}
    text = spark.createDataFrame([(i, e, None if x is None else f"l{x}") for i, e, x in rows], "vec_id long, embedding array<double>, label string")
    assert {r["vec_id"]: r["n_links"] for r in forest.near_vectors(text).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_salvage_takes_time_in_proportion():
    part = [gzip.compress(record(k, prose(random.Random(k), 3000))) for k in range(20)]
    times = []
    for n in (20, 160):
        data = b"".join(part) * n
        t = time.process_time()
        assert sum(r["status"] == "record" for r in warc.salvage(data)) == 20 * n
        times.append(time.process_time() - t)
    assert times[1] < 16 * times[0]                 # eight times the bytes


def test_members_beyond_the_bound_are_gaps(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 10_000)
    data = gzip.compress(record(1, "ok")) + gzip.compress(record(2, "y" * 50_000)) + gzip.compress(record(3, "ok"))
    assert [(r["status"], r.get("page_id")) for r in warc.salvage(data)] == [("record", "1"), ("gap", None), ("record", "3")]


@pytest.mark.parametrize("name", ["a.warc.gz", "b.warc", "anything"])
def test_archives_of_any_name(spark, tmp_path, name):
    data = b"".join((gzip.compress if name.endswith("gz") else bytes)(record(k, f"t{k}")) for k in range(3))
    (tmp_path / name).write_bytes(data)
    assert sorted(r["page_id"] for r in warc.read_archive(spark, str(tmp_path)).collect()) == ["0", "1", "2"]


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 400_000)
    monkeypatch.setattr(warc, "TIERS", (1_000, 40_000))
    pages = spark.createDataFrame([(k, "u", "é" * (20_000 if k % 5 == 0 else 90_000 if k == 31 else k)) for k in range(100)],
                                  "page_id long, url string, html string").coalesce(1)
    path = new_folder(spark)
    warc.write_archive(pages, path)
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert max(r["length"] for r in files) < 450_000 and len(files) >= 4
    assert warc.read_archive(spark, path).where("status = 'record'").count() == 100


def test_forest_paths_equal_a_plain_walk():
    """Scores of the isolation forest against walks node by node."""
    rng = np.random.default_rng(4)
    x = rng.exponential(size=(60, 6))
    x[40:] += 3
    good = np.arange(60) < 40
    usual = rules.usual_shares(x, good)
    f = rules.Forest.grow(x, good, usual, trees=7, sample=16)

    def path(t, p):
        node = 0
        while not math.isnan(f.split[t, node]):
            side = sum(p[c] * f.direction[t, node, c] for c in range(6)) > f.split[t, node]
            node = 2 * node + (2 if side else 1)
        return f.path[t, node]
    c = 2 * (math.log(15) + 0.5772156649) - 2 * 15 / 16
    for row, got in zip(x, f.score(x)):
        p = [math.log1p(v / u) for v, u in zip(row, usual)]
        assert abs(got - 2 ** (-sum(path(t, p) for t in range(7)) / 7 / c)) < 1e-9
    assert f.score(x)[40:].mean() > f.score(x)[:40].mean()
