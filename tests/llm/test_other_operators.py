"""Vectors, pages, conversations, components, the queries with SQL and the pipeline."""

import base64
import gzip
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from brute import classes, strip
from pyspark.sql import functions as F

from tomewright.llm import chat, forest, graph, warc
from tomewright.llm.queries import QUERIES
from tomewright.session import new_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    fn, sql = QUERIES[name]
    df, rel = fn(spark, FOLDER), con.sql(sql)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(150)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}


# -- vectors ----------------------------------------------------------------
@pytest.mark.parametrize("sizes", [{}, {"leaf": 8, "block": 7, "sample_rows": 50}])
def test_forest(spark, sizes):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = []
    for k in range(160):
        v = base[k % 40] + rng.normal(scale=0.03 + 0.03 * (k % 3), size=16)
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 40) % 3))
    rows += [(200 + k, rows[5][1], 2) for k in range(30)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, rows[3][1], None),
            (303, [math.nan] * 16, 0), (304, [None] * 16, 0), (305, [math.inf] * 16, 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0),
            (308, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in forest.near_vectors(df, **sizes).collect()}
    good = {i: np.array(v, float) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    lab = {r[0]: r[2] for r in rows}
    near = {i: {j for j in good if j != i and lab[i] == lab[j] and len(good[i]) == len(good[j])
                and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.98} for i in good}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert got[i] == (len(near.get(i, ())), min(seen), i == min(seen)), i
    assert forest.near_vectors(df.limit(0)).collect() == []


# -- pages ------------------------------------------------------------------
def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    rows = [(3, "http://a/\r\nX: y", "<p>ü</p>\r\n\r\nWARC/1.1\r\n"), (1, "http://b/", "same"), (7, None, "same"), (5, "http://c/", None),
            (6, "", ""), (None, "http://n/", "same"), (8, "http://l/", "long " * 100_000), (1, "http://b/", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("x"))
    path = new_folder(spark)
    warc.write_archive(df, path, records_per_file=2)
    got = warc.read_archive(spark, path).collect()
    assert {r["status"] for r in got} == {"record"}
    first = {digest("same"): "1", digest(None): "5"}
    seen = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got)
    want = []
    for i, _, h in rows:
        d, i = digest(h), "" if i is None else str(i)
        back = first.get(d) if first.get(d, i) != i else None
        want.append((i, "revisit" if back else "response", back, len((h or "").encode()), d))
    assert [tuple(x or "" for x in s) for s in seen] == sorted(tuple(x or "" for x in w) for w in want)
    assert next(r["payload"] for r in got if r["page_id"] == "3").decode() == rows[0][2]
    empty = new_folder(spark)
    warc.write_archive(df.limit(0), empty)
    assert warc.read_archive(spark, empty).collect() == []


def record(k, text):
    body = f"HTTP/1.1 200 OK\r\n\r\n{text}".encode()
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:{digest(text)}\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda r: r, gzip.compress])
def test_salvage(pack):
    parts = [pack(record(k, f"text {k} " * 30)) for k in range(5)]
    hurt = bytearray(parts[1])
    hurt[len(hurt) // 2] ^= 0x55
    data = parts[0] + bytes(hurt) + parts[2] + parts[3][:len(parts[3]) // 2] + parts[4] + b"junk"
    got = list(warc.salvage(data))
    assert [(r["status"], r.get("page_id")) for r in got] == [("record", "0"), ("gap", None), ("record", "2"), ("gap", None),
                                                              ("record", "4"), ("gap", None)]
    assert [g["length"] for g in got if g["status"] == "gap"] == [len(parts[1]), len(parts[3]) // 2, 4]
    assert all(g["reason"] for g in got if g["status"] == "gap")
    assert sum(r["length"] for r in got) == len(data)
    assert [r["status"] for r in warc.salvage(b"no archive at all")] == ["gap"] and list(warc.salvage(b"")) == []


# -- conversations ------------------------------------------------------------
def test_chat_prefixes(spark):
    rows = [(1, 0, "user", "hi </turn><turn> \\n"), (1, 1, "assistant", "yes \\"), (1, 2, "user", None), (1, 3, "assistant", "\\\\<turn>"),
            (1, 4, "user", "tail"), (2, None, None, ""), (2, 0, "assis\ntant\\n", "x\n"), (None, 0, "assistant", "lost"),
            (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, 1, "assistant", "w" * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("x"))
    ex = chat.format_conversations(df).withColumns({"turns": chat.read_turns(F.col("text")),
                                                    "loss": chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end"))})
    got = {}
    for r in ex.collect():
        got.setdefault(r["conv_id"], {})[r["example"]] = r
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        turns = [t[2:] for t in turns]
        ends = [k for k, t in enumerate(turns) if t[0] == "assistant"]
        ends += [len(turns) - 1] if not ends or ends[-1] < len(turns) - 1 else []
        assert sorted(got[conv]) == list(range(len(ends)))
        for k, end in enumerate(ends):
            r = got[conv][k]
            assert [tuple(t) for t in r["turns"]] == turns[:end + 1]
            assert r["loss"] == (turns[end][1] if turns[end][0] == "assistant" else "")
            assert r["last"] == (end == len(turns) - 1)
    assert chat.format_conversations(df.limit(0)).collect() == []


# -- pipeline -----------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline as cp
    from tomewright.llm import mixing, toxicity
    from tomewright.session import cut_lineage
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    cols, seen = docs.columns, [docs]
    for name, stage in cp.STAGES:
        seen.append(cut_lineage(stage(spark, seen[-1], FOLDER)))
        if name != cp.STAGES[-1][0]:
            assert seen[-1].columns == cols and seen[-1].schema == docs.schema
    rows = [[(r["doc_id"], r["text"]) for r in s.select("doc_id", "text").collect()] for s in seen[:-1]]
    g = toxicity.learn(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    keep = g.score([t for _, t in rows[0]]) < cp.TOXIC
    assert sorted(rows[1]) == sorted(r for r, k in zip(rows[0], keep) if k) and 0 < keep.sum() < len(keep)
    assert sorted(i for i, _ in rows[2]) == sorted(i for i, c in classes(rows[1]).items() if i == c)
    want = strip(rows[2])
    for i, t in rows[3]:
        if want[i][1] == 0:
            assert t == dict(rows[2])[i]
        assert len(t.encode()) - (want[i][0] - want[i][1]) in range(0, 7 * want[i][2] + 1)
    taken = {r["doc_id"]: r["copies"] for r in mixing.with_copies(seen[3]).collect() if r["copies"]}
    assert sorted(i for i, _ in rows[4]) == sorted(i for i, n in taken.items() for _ in range(n))
    assert seen[5].count() == len(rows[4])
    assert sorted(map(tuple, cp.run(spark, FOLDER).collect())) == sorted(map(tuple, seen[5].collect()))
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        none = cut_lineage(stage(spark, none, FOLDER))
        assert none.count() == 0


def test_pipeline_odd_rows(spark, documents):
    import corpus_pipeline as cp
    docs = documents([(1, None), (2, ""), (2, ""), (None, "a few words"), (None, None), (3, "a few words"), (4, "a few words"),
                      (5, "w" * 30_000, None)])
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name == "minhash_near_dedup":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "2", "3", "5", "None", "None"]
    assert "n_tokens" in docs.columns
