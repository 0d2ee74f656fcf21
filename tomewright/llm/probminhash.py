"""Near-duplicate texts by ProbMinHash over weighted word shingles.

A shingle is five consecutive words (``[^\\x20\\x09-\\x0D]+``), its weight the
number of its occurrences; a text of one to four words is one shingle.  For
every shingle a Poisson process with its weight as rate drops arrivals into
REGISTERS registers; a register keeps the shingle that arrives first.  The
share of registers in which two texts agree estimates their probability
Jaccard similarity, which for texts without repeated shingles is the Jaccard
similarity.  Arrivals of a shingle stop once the next one is later than every
register of the text is taken (early termination).

BANDS bands of ROWS registers give buckets; two texts at similarity 0.8 miss
each other in all of them with probability 2e-6.  Candidates are verified by
their exact probability Jaccard:

1. texts equal byte for byte are one class from the start (only one is hashed on),
2. in each bucket all members are verified against one of them, its pivot,
3. in buckets that still hold several classes the remaining pairs are compared
   inside tasks of at most two blocks of BLOCK members, by matrix products over
   the shingles they share.  Members of the pivot's class stand in blocks of
   their own, which are not compared with each other.

Tasks return links to the least member of what they have joined, one row per
member.  So pairs are never written, whatever the size of a bucket, and no
candidate is dropped.  Words-free texts are only copies of equal texts; a null
text is its own class.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import add_columns, byte_rows, map_batches, mix, run_starts, segment_hash, windows, words
from tomewright.llm.graph import components
from tomewright.session import cut_lineage

SHINGLE, REGISTERS, BANDS, ROWS = 5, 100, 25, 4
SIMILARITY = 0.8
BLOCK = 1500                    # members of a bucket compared with each other at once


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: row, hash, occurrences; ordered by row, then hash."""
    raw, off = byte_rows(col)
    start, end, row = words(raw, off)
    h = segment_hash(raw, start, end)
    w, at = windows(h, row, SHINGLE)
    r = row[at]
    count = np.bincount(row, minlength=len(off) - 1)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        lead = np.r_[0, np.cumsum(count)][short]
        own = np.array([np.bitwise_xor.reduce(mix(h[a:a + count[s]] + np.arange(count[s], dtype=np.uint64)))
                        for a, s in zip(lead, short)], np.uint64)
        w, r = np.r_[w, own], np.r_[r, short]
    order = np.lexsort((w, r))
    w, r = w[order], r[order]
    first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (r[1:] != r[:-1])]) if len(w) else np.zeros(0, np.int64)
    return r[first], w[first], np.diff(np.r_[first, len(w)])


def signatures(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Registers of each text (hash of the shingle that came first), and whether it has any shingle."""
    n = len(col)
    row, item, weight = shingles(col)
    time, sig = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, np.uint64)
    clock = np.zeros(len(row))
    live = np.arange(len(row))
    k, step = 0, np.uint64(0x9E3779B97F4A7C15)
    while len(live):
        k += 1
        draw = mix(item[live] + step * np.arange(k, k + 1, dtype=np.uint64))
        # 32 bits of the draw choose the register, 52 bits of its remix the waiting time
        slot = row[live] * REGISTERS + ((draw >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        wait = -np.log(((mix(draw + np.uint64(1)) >> np.uint64(12)).astype(float) + 0.5) * 2.0 ** -52)
        clock[live] += wait / weight[live]
        now = clock[live]
        better = now < time[slot]
        live2, slot2, now2 = live[better], slot[better], now[better]
        np.minimum.at(time, slot2, now2)
        won = time[slot2] == now2
        sig[slot2[won]] = item[live2[won]]
        latest = time.reshape(n, REGISTERS).max(axis=1)
        live = live[now < latest[row[live]]]
    some = np.zeros(n, bool)
    some[row] = True
    return sig.reshape(n, REGISTERS), some


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact similarity of two sets of distinct, sorted hashes with weights."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    p, q = wa / wa.sum(), wb / wb.sum()
    x, y = p[ia], q[ib]
    only_p, only_q = p.sum() - x.sum(), q.sum() - y.sum()
    # sum over items of max(p / px, q / qx): sort by q / p and sum prefixes
    ratio = y / x
    order = np.argsort(ratio)
    r = ratio[order]
    cx, cy = np.r_[0, np.cumsum(x[order])], np.r_[0, np.cumsum(y[order])]
    k = np.searchsorted(r, r, side="right")                 # items whose q / p is at most that of this one count by p
    total = (cx[k] + only_p) / x[order] + (cy[-1] - cy[k] + only_q) / y[order]
    return float((1 / total).sum())


def _bands(col: pa.Array) -> list:
    sig, some = signatures(col)
    mul = np.array([mix(np.uint64([i + 1]))[0] | np.uint64(1) for i in range(ROWS)], np.uint64)
    keys = mix((sig.reshape(len(sig), BANDS, ROWS) * mul).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    off = np.r_[0, np.cumsum(np.where(some, BANDS, 0))]
    return [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(keys[some].ravel().view(np.int64)))]


def copy_of(key: Column, text: Column) -> Column:
    """What equal texts share: a digest; a null text is alone with its id."""
    return F.when(text.isNull(), F.concat(F.lit("null "), key.cast("string"))).otherwise(F.sha2(text, 256))


def _sketch(docs: DataFrame) -> DataFrame:
    """(id, text) -> id, copy (digest of the text), bands."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), _bands(b.column(1))[0]], names=["id", "copy", "bands"])
    rows = docs.select("id", "text", copy_of(F.col("id"), F.col("text")).alias("copy"))
    return map_batches(rows, run, "text", "id long, copy string, bands array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """(id, text) -> id, set: distinct shingles and weights as bytes."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        row, item, weight = shingles(b.column(1))
        cut = np.searchsorted(row, np.arange(b.num_rows + 1))
        out = [item[x:y].tobytes() + weight[x:y].astype(np.uint32).tobytes() for x, y in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "set"])
    return map_batches(docs.select("id", "text"), run, "text", "id long, set binary")


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n).astype(float)


def verify(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) whose probability Jaccard is at least ``least``."""
    rows = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb"))

    def run(it):
        for b in it:
            sim = [probability_jaccard(*_unpack(x), *_unpack(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            keep = pa.array([s >= least - 1e-12 for s in sim], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])
    return rows.mapInArrow(run, "a long, b long")


def _compare(least: float):
    """Members of one bucket (or two of its blocks) -> links that join different classes."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        n = len(pdf)
        own, part, old = pdf["id"].to_numpy(), pdf["own"].to_numpy(), pdf["root"].to_numpy()
        sets = [_unpack(x) for x in pdf["set"]]
        size = np.array([len(h) for h, _ in sets])
        _, col, held = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), size)
        share = np.concatenate([w / w.sum() for _, w in sets])
        heavy = np.array([bool((w > 1).any()) for _, w in sets])
        use = held[col] > 1
        row, col, share = row[use], np.unique(col[use], return_inverse=True)[1], share[use]
        order = np.argsort(col, kind="stable")
        row, col, share = row[order], col[order], share[order]
        both, mass = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            a, b = np.searchsorted(col, [lo, lo + 4096])
            m = np.zeros((n, int(min(4096, col[-1] + 1 - lo))), np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            both += m @ m.T
            if heavy.any():
                w = np.zeros_like(m)
                w[row[a:b], col[a:b] - lo] = share[a:b]
                mass += w @ m.T
        cross = old[:, None] != old[None, :]
        if pdf["i"].iat[0] != pdf["j"].iat[0]:
            cross &= part[:, None] != part[None, :]
        exact = both.astype(np.int64)
        near = cross & (exact >= least * (size[:, None] + size[None, :] - exact) - 1e-9)
        odd = heavy[:, None] | heavy[None, :]
        near &= ~odd
        if heavy.any():             # the similarity is at most the mass that either text has in common with the other
            maybe = np.argwhere(np.triu(cross & odd & (np.minimum(mass, mass.T) >= least - 1e-4)))
            for u, v in maybe:
                near[u, v] = near[v, u] = probability_jaccard(*sets[u], *sets[v]) >= least - 1e-12
        root = np.arange(n)
        while True:
            new = np.minimum(root, np.where(near, root[None, :], n).min(axis=1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        out = np.flatnonzero(root != np.arange(n))
        return pd.DataFrame({"a": own[root[out]], "b": own[out]})
    return run


def classes(docs: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, copy, class_id (smallest doc_id of the class), kept; one row per input row.

    Classes are made of texts, so rows that share a doc_id but not their text
    are classified each by its own.  ``kept`` marks the row that stands for its
    class: smallest doc_id, then smallest digest of the text (``copy``); rows
    equal in both stand together.  A row without a doc_id is a class of its
    own, with class_id null, and stays.  Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL")
    sketch = cut_lineage(_sketch(rows))
    # one number per distinct text, written, so that it stays the same
    heads = cut_lineage(sketch.groupBy("copy").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    texts = sketch.join(heads.withColumnRenamed("least", "id"), ["copy", "id"]).dropDuplicates(["copy"])
    member = texts.select(F.col("node").alias("id"), F.explode("bands").alias("band"))
    sizes = member.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")).where("n > 1").drop("n")
    member = cut_lineage(member.join(sizes, "band").distinct())
    asked = heads.join(member.select(F.col("id").alias("node")).distinct(), "node", "left_semi").withColumnRenamed("least", "id")
    sets = rows.withColumn("copy", copy_of(F.col("id"), F.col("text"))).join(asked, ["copy", "id"])
    sets = cut_lineage(_packed(sets.select(F.col("node").alias("id"), "text")).dropDuplicates(["id"]))
    pairs = member.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = cut_lineage(verify(pairs, sets, least))
    label = components(links).select(F.col("node").alias("id"), "root")
    # buckets with several classes
    m = member.join(label, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lead = member.where("id = pivot").join(label, "id", "left").select("band", F.coalesce("root", "id").alias("lead"))
    m = cut_lineage(m.join(lead, "band").select("band", "id", "root", (F.col("root") == F.col("lead")).alias("led")))
    n = m.groupBy("band").agg(F.count_if("led").alias("na"), F.count_if(~F.col("led")).alias("nb"),
                              F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").drop("lo", "hi")
    m = m.join(n, "band")
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    m = m.withColumns({"ka": blocks("na"), "kb": blocks("nb")})
    # blocks of the leading class count from -1 downwards, all others from 0
    m = m.withColumn("own", F.when(F.col("led"), -1 - F.pmod(F.xxhash64("id"), F.col("ka")).cast("int"))
                     .otherwise(F.pmod(F.xxhash64("id"), F.col("kb")).cast("int")))
    # where each side fits in one block they meet at once
    m = m.withColumns({"own": F.when((F.col("ka") == 1) & (F.col("kb") == 1), F.lit(0)).otherwise(F.col("own"))})
    other = F.when((F.col("ka") == 1) & (F.col("kb") == 1), F.array(F.lit(0))).otherwise(F.concat(
        F.sequence(F.lit(0), F.col("kb") - 1),
        F.when(F.col("led"), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(-1), -F.col("ka"), F.lit(-1)))))
    m = m.select("band", "id", "root", "own", F.explode(other).alias("other"))
    m = m.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root")
    more = m.join(sets, "id").groupBy("band", "i", "j").applyInPandas(_compare(least), "a long, b long")
    links = links.unionByName(cut_lineage(more))
    label = components(links).withColumnRenamed("node", "n")
    known = sketch.select("id", "copy").join(heads.drop("least"), "copy").join(label, F.col("node") == F.col("n"), "left")
    known = cut_lineage(known.select("id", "copy", F.coalesce("root", "node").alias("root")))
    first = known.groupBy("root").agg(F.min(F.struct("id", "copy")).alias("first"))
    out = known.join(first, "root").select(F.col("id").alias("doc_id"), "copy", F.col("first.id").alias("class_id"),
                                           (F.struct("id", "copy") == F.col("first")).alias("kept"))
    none = docs.where(F.col("doc_id").cast("long").isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("copy"), F.lit(None).cast("long").alias("class_id"),
        F.lit(True).alias("kept"))
    return out.unionByName(none)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, class_id, as ``classes``."""
    return classes(docs, least, block).select("doc_id", "class_id")
