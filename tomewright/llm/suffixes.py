"""Removal of repeated byte strings by minimiser grouping.

This replaces the difference-cover suffix sort, which stands in ``cover.py``
and needs hundreds of bytes of shuffle per byte of text (README).  No suffixes
are ranked here; equal windows meet by content.

A byte goes if a string of MATCH bytes that covers it also starts earlier
(smaller doc_id, or the same document further left).

* Sample.  Sampled positions ("anchors") are the minimisers of all MATCH-byte
  windows: the leftmost least KMER-byte name among the window's positions.
  Equal windows hold a sampled position at the same offset, wherever the text
  stands, so most of the corpus can be ruled out: a sampled name that
  occurs once has no equal anywhere, and neither has any window it stands for.
* Names.  Four-byte strings are named by their value, and names of triples of
  names (4 -> 12 -> 36 -> 100 bytes) are built by recursion.  Names are 64-bit
  hashes of content, so tasks agree on them without a global ranking.
* Group.  Positions between anchors travel with the context of their anchor and
  are sorted by name next to all others of equal anchor.
* Compare.  Neighbours are compared over all MATCH bytes; in a run of equal ones
  all but the earliest are repeats.

Per position only sampled names are shuffled (about one for 35 bytes), then
the contexts of those that occur again.  Names repeated inside a batch of texts
are settled there and travel once.  Anchors of passages so common that their
contexts would burden one task are found in a bounded sample of documents and
dealt out window by window, and there windows count as equal if two 64-bit
hashes are; everywhere else bytes decide.  The sample only chooses the way.

Null texts are empty.  Rows sharing a doc_id count as its parts, ordered by the
hash of their text; equal parts keep each other.  A null doc_id comes last.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.llm.common import _MUL, _POW, byte_rows, map_batches, mix, run_starts
from tomewright.session import cut_lineage

MATCH, KMER = 100, 32
SPAN = MATCH - KMER + 1                 # positions a window chooses its anchor from
SLICE = 1 << 18                         # window starts named at once
GROUP = 4_000                           # contexts sorted at once
HOT = 200_000                           # contexts of one anchor that a single task may hold
SAMPLE_DOCS = 20_000                    # documents in which common anchors are looked for
LAST = (1 << 63) - 1                    # stands for a null doc_id
ANCHOR = np.dtype([("fp", "<u8"), ("doc", "<i8"), ("part", "<i4"), ("lo", "<i4"), ("n", "u1"), ("d", "u1")])
SINGLE = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("part", "<i4"), ("lo", "<i4")])
RUN = np.dtype([("doc", "<i8"), ("part", "<i4"), ("lo", "<i4"), ("n", "<i4")])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _POW + b * _MUL
    return h ^ (h >> np.uint64(31))


def _triple(x: np.ndarray, i: np.ndarray | slice, one: int, two: int, n: int | None = None) -> np.ndarray:
    """Name of the triple of names at i, i + one, i + two (``n``: for all positions up to n)."""
    a, b, c = (x[:n], x[one:one + n], x[two:two + n]) if n is not None else (x[i], x[i + one], x[i + two])
    h = a * _POW
    h += b
    h *= _MUL
    h += c
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that choose the same anchor: its name, the anchor, first window, number of windows."""
    valid = np.zeros(len(raw) + 1, np.int8)
    long = np.diff(off) >= MATCH
    np.add.at(valid, off[:-1][long], 1)
    np.add.at(valid, off[1:][long] - MATCH + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    out = []
    for a in range(0, len(raw), SLICE):
        ok = valid[a:a + SLICE]
        if not ok.any():
            continue
        x = raw[a:a + SLICE + MATCH - 1].astype(np.uint64) + np.uint64(1)
        size = 1
        while size < KMER:
            x = _pair(x[:-size], x[size:])
            size *= 2
        h = mix(x)
        n = min(len(h) - SPAN + 1, len(ok))
        if n <= 0:
            continue
        low, size = h, 1
        while 2 * size <= SPAN:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[SPAN - size:SPAN - size + n])
        ok = ok[:n]
        here = h[:n] == low
        stop = here | np.r_[low[1:] != low[:-1], True] | np.r_[~ok[1:], True]
        end = np.flatnonzero(stop & ok)
        begin = np.r_[0, np.flatnonzero(stop | ~ok) + 1]
        first = begin[np.searchsorted(begin, end, side="right") - 1]
        at = end.copy()
        todo = np.flatnonzero(~here[end])
        for k in range(1, SPAN):                    # the anchor of a run that ends before it
            if not len(todo):
                break
            hit = h[end[todo] + k] == low[end[todo]]
            at[todo[hit]] = end[todo[hit]] + k
            todo = todo[~hit]
        out.append((h[at], at + a, first + a, end - first + 1))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out))


def _records(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Anchor records of a batch (doc, part, text), and its bytes."""
    raw, off = byte_rows(b.column(2))
    fp, at, lo, n = anchors(raw, off)
    row = np.searchsorted(off, lo, side="right") - 1
    r = np.zeros(len(fp), ANCHOR)
    r["fp"], r["doc"], r["part"] = fp, b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
    r["lo"], r["n"], r["d"] = lo - off[row], n, at - lo
    return r, raw


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _deal(rows: np.ndarray, bucket: np.ndarray, kind: int, extra=None) -> list[tuple[int, int, bytes]]:
    """Cut an array of records into one compressed blob per bucket; ``extra(order, starts)`` adds bytes to each."""
    order = np.argsort(bucket, kind="stable")
    cut = np.r_[run_starts(bucket[order]), len(rows)]
    tail = extra(order, cut) if extra else [b""] * (len(cut) - 1)
    return [(int(bucket[order[a]]), kind, _squeeze(np.int64(b - a).tobytes() + rows[order[a:b]].tobytes() + t))
            for a, b, t in zip(cut[:-1], cut[1:], tail)]


def _blobs(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*parts) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())],
                                      names=["bucket", "kind", "data"])


BLOBS = "bucket int, kind int, data binary"


def _pack(r: np.ndarray) -> np.ndarray:
    return (r["lo"].astype(np.int64) << 16) | (r["n"].astype(np.int64) << 8) | r["d"]


def _again(parts: int, hot: np.ndarray):
    """Batch of texts -> blobs: kind 0 names to be counted, kind 1 anchors known to occur again."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        r, _ = _records(b)
        _, first, inv, n = np.unique(r["fp"], return_index=True, return_inverse=True, return_counts=True)
        known = (n > 1) | np.isin(r["fp"][first], hot)
        salt = (mix(r["fp"] ^ mix(r["doc"].astype(np.uint64))) % np.uint64(parts)).astype(np.int64)
        sure = known[inv]
        lead = np.zeros(len(r), bool)
        lead[first[~np.isin(r["fp"][first], hot)]] = True
        # one record of each name is counted; the count of its own batch goes along in a copy
        ask = r[lead]
        out = _deal(ask, (ask["fp"] % np.uint64(parts)).astype(np.int64), 0,
                    lambda order, cut: [sure[lead][order[a:b]].astype(np.uint8).tobytes() for a, b in zip(cut[:-1], cut[1:])])
        rest = r[sure]
        return _blobs(out + (_deal(rest, salt[sure], 1) if len(rest) else []))
    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blobs of one bucket -> anchors whose name occurs again."""
    ask, sure, out = [np.zeros(0, ANCHOR)], [np.zeros(0, np.uint8)], [np.zeros(0, ANCHOR)]
    for kind, data in zip(pdf["kind"], pdf["data"]):
        data = _expand(data)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        r = np.frombuffer(data, ANCHOR, n, 8)
        if kind:
            out.append(r)
        else:
            ask.append(r)
            sure.append(np.frombuffer(data, np.uint8, n, 8 + n * ANCHOR.itemsize))
    ask, sure = np.concatenate(ask), np.concatenate(sure)
    _, inv, n = np.unique(ask["fp"], return_inverse=True, return_counts=True)
    out.append(ask[(n[inv] > 1) & (sure == 0)])         # those known in their batch come as kind 1
    r = np.concatenate(out)
    return pd.DataFrame({"doc": r["doc"].astype("int64"), "part": r["part"].astype("int32"), "spot": _pack(r)})


def _windows(n: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of contexts: context number and byte offset."""
    ctx = np.repeat(np.arange(len(n)), n)
    return ctx, base[ctx] + np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)


def window_names(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the MATCH-byte strings at the given offsets, by triples of names."""
    n = len(raw) - 3
    four = np.lib.stride_tricks.as_strided(raw.copy().view(np.uint8), (n, 4), (1, 1)).copy().view("<u4")[:, 0].astype(np.uint64)
    twelve = _triple(four, slice(None), 4, 8, n - 8)
    more = _triple(twelve, slice(None), 12, 24, n - 8 - 24)
    return _triple(more, at, 36, MATCH - 36)


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n bytes at a equal those at b, for each triple."""
    out = np.zeros(len(a), bool)
    step = max((1 << 20) // max(int(n.max(initial=1)), 1), 1)
    for lo in range(0, len(a), step):
        x, y, k = a[lo:lo + step], b[lo:lo + step], n[lo:lo + step]
        lead = np.cumsum(k) - k
        i = np.arange(k.sum())
        out[lo:lo + step] = np.logical_and.reduceat(raw[i + np.repeat(x - lead, k)] == raw[i + np.repeat(y - lead, k)], lead)
    return out


def repeats(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for each string at ``at`` that equals one at a smaller index.

    Strings of one name are neighbours in the order; they are compared with the
    first of them, neighbouring strings with neighbouring partners at once.
    """
    name = window_names(raw, at)
    order = np.argsort(name, kind="stable")
    same = np.r_[False, name[order][1:] == name[order][:-1]]
    head = np.empty(len(at), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    out = np.zeros(len(at), bool)
    sus = np.flatnonzero(head != np.arange(len(at)))
    if len(sus):
        x, y = at[sus], at[head[sus]]
        first = np.flatnonzero(np.r_[True, (np.diff(x) != 1) | (np.diff(y) != 1)])
        size = np.diff(np.r_[first, len(sus)])
        good = np.repeat(_equal(raw, x[first], y[first], size + MATCH - 1), size)
        out[sus[good]] = True
        for p in sus[~good]:                            # two strings of one name nearby: compare with all of that name before
            own = raw[at[p]:at[p] + MATCH].tobytes()
            out[p] = any(raw[at[q]:at[q] + MATCH].tobytes() == own for q in np.flatnonzero(name[:p] == name[p]))
    return out


def _second(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Another name of the MATCH-byte strings at the given offsets."""
    view = np.lib.stride_tricks.sliding_window_view(raw, MATCH)
    key = mix(np.arange(MATCH, dtype=np.uint64)) | np.uint64(1)
    return np.concatenate([mix((view[at[k:k + 10_000]] + np.uint64(1)) @ key) for k in range(0, len(at), 10_000)])


def _runs(flag: np.ndarray, ctx: np.ndarray, r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of flagged windows of one context."""
    start = np.flatnonzero(flag & ~(np.r_[False, flag[:-1]] & np.r_[False, ctx[1:] == ctx[:-1]]))
    stop = np.flatnonzero(flag & ~(np.r_[flag[1:], False] & np.r_[ctx[1:] == ctx[:-1], False]))
    lead = np.cumsum(n) - n
    out = np.zeros(len(start), RUN)
    c = ctx[start]
    out["doc"], out["part"], out["lo"], out["n"] = r["doc"][c], r["part"][c], r["lo"][c] + start - lead[c], stop - start + 1
    return out


def _contexts(parts: int, hot: np.ndarray):
    """Texts with their anchors -> blobs: kind 0 contexts, kind 1 repeats settled here, kind 2 single windows."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = byte_rows(b.column(2))
        spots = b.column(3)
        spot = spots.flatten().to_numpy()
        row = np.repeat(np.arange(b.num_rows), spots.value_lengths().fill_null(0).to_numpy())
        doc, part = b.column(0).to_numpy(), b.column(1).to_numpy()
        r = np.zeros(len(spot), ANCHOR)
        r["doc"], r["part"], r["lo"], r["n"], r["d"] = doc[row], part[row], spot >> 16, (spot >> 8) & 255, spot & 255
        order = np.lexsort((r["lo"], r["part"], r["doc"]))
        r, row = r[order], row[order]
        if not len(r):
            return _blobs([])
        base, n = off[row] + r["lo"], r["n"].astype(np.int64)
        at0 = base + r["d"]
        for lo in range(0, len(r), 20_000):
            x = np.lib.stride_tricks.sliding_window_view(raw, KMER)[at0[lo:lo + 20_000]].astype(np.uint64) + np.uint64(1)
            while x.shape[1] > 1:
                x = _pair(x[:, 0::2], x[:, 1::2])
            r["fp"][lo:lo + 20_000] = mix(x[:, 0])
        # names that come twice in this batch are settled here as far as they can be
        _, inv, count = np.unique(r["fp"], return_inverse=True, return_counts=True)
        heavy = np.isin(r["fp"], hot)
        near = np.flatnonzero((count[inv] > 1) | heavy)
        rest = np.ones(len(r), bool)
        out = []
        salt = lambda x: (mix(x["doc"].astype(np.uint64) + x["lo"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        if len(near):
            size = n[near] + MATCH - 1
            lead = np.cumsum(size) - size
            own = raw[np.repeat(base[near] - lead, size) + np.arange(size.sum())]
            ctx, at = _windows(n[near], lead)
            flag = repeats(own, at)
            runs = _runs(flag, ctx, r[near], n[near])
            if len(runs):
                out += _deal(runs, salt(runs), 1)
            # contexts of which nothing is open don't travel
            rest[near] = np.bincount(ctx[~flag], minlength=len(near)) > 0
            w = np.flatnonzero(heavy[near][ctx] & ~flag)
            if len(w):
                s = np.zeros(len(w), SINGLE)
                s["a"] = window_names(own, at[w])
                s["b"] = _second(own, at[w])
                c = near[ctx[w]]
                s["doc"], s["part"], s["lo"] = r["doc"][c], r["part"][c], r["lo"][c] + at[w] - lead[ctx[w]]
                out += _deal(s, (s["a"] % np.uint64(parts)).astype(np.int64), 2)
        open_ = np.flatnonzero(rest & ~heavy)
        if len(open_):
            keep, kb, kn = r[open_], base[open_], n[open_] + MATCH - 1

            def texts(order, cut):
                return [b"".join(raw[kb[i]:kb[i] + kn[i]].tobytes() for i in order[a:z]) for a, z in zip(cut[:-1], cut[1:])]
            out += _deal(keep, (keep["fp"] % np.uint64(parts)).astype(np.int64), 0, texts)
        return _blobs(out)
    return run


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blobs of one bucket -> runs of windows that repeat earlier strings."""
    heads, data_, out, single = [np.zeros(0, ANCHOR)], [], [np.zeros(0, RUN)], [np.zeros(0, SINGLE)]
    for kind, data in zip(pdf["kind"], pdf["data"]):
        data = _expand(data)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        if kind == 0:
            heads.append(np.frombuffer(data, ANCHOR, n, 8))
            data_.append(np.frombuffer(data, np.uint8, -1, 8 + n * ANCHOR.itemsize))
        elif kind == 1:
            out.append(np.frombuffer(data, RUN, n, 8))
        else:
            single.append(np.frombuffer(data, SINGLE, n, 8))
    r = np.concatenate(heads)
    if len(r):
        raw = np.concatenate(data_)
        size = r["n"].astype(np.int64) + MATCH - 1
        base = np.cumsum(size) - size
        group = (mix(r["fp"]) % np.uint64(max(len(r) // GROUP, 1))).astype(np.int64)       # an anchor's contexts stay together
        order = np.lexsort((r["lo"], r["part"], r["doc"], group))
        for piece in np.split(order, run_starts(group[order])[1:]):
            # contexts of the group end to end, earliest first
            s = size[piece]
            own = raw[np.repeat(base[piece] - (np.cumsum(s) - s), s) + np.arange(s.sum())]
            n = r["n"][piece].astype(np.int64)
            ctx, at = _windows(n, np.cumsum(s) - s)
            out.append(_runs(repeats(own, at), ctx, r[piece], n))
    s = np.concatenate(single)
    if len(s):
        order = np.lexsort((s["lo"], s["part"], s["doc"], s["b"], s["a"]))
        s = s[order]
        again = np.r_[False, (s["a"][1:] == s["a"][:-1]) & (s["b"][1:] == s["b"][:-1])]
        more = np.zeros(int(again.sum()), RUN)
        for k in ("doc", "part", "lo"):
            more[k] = s[k][again]
        more["n"] = 1
        out.append(more)
    x = np.concatenate(out)
    return pd.DataFrame({"doc": x["doc"].astype("int64"), "part": x["part"].astype("int32"),
                         "run": (x["lo"].astype(np.int64) << 16) | x["n"]})


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Documents with _doc and _part, which tells different texts of one doc_id apart; whether any doc_id repeats."""
    rows = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.withColumn("_part", F.lit(0)), False
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("_doc").orderBy(F.xxhash64(text), F.sha2(text, 256))
    return rows.withColumn("_part", (F.dense_rank().over(order) - 1).cast("int")), True


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        z = [_squeeze(t.as_buffer()) for t in b.column(2).cast(pa.binary())]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["doc", "part", "z"])
    return map_batches(docs, run, "text", "doc long, part int, z binary")


def _common(docs: DataFrame, n_docs: int, hot: int, sample_docs: int) -> np.ndarray:
    """Names of anchors that about ``hot`` or more contexts would share, judged by a sample of documents."""
    share = min(1.0, sample_docs / max(n_docs, 1))
    if n_docs * 8 < hot:
        return np.zeros(0, np.uint64)
    some = docs.where(F.pmod(F.xxhash64("doc", "part", F.lit(6)), F.lit(1_000_000)) < int(math.ceil(share * 1_000_000)))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        name, n = np.unique(_records(b)[0]["fp"], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n, pa.int64())], names=["fp", "n"])
    top = (map_batches(some, run, "text", "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= max(3, int(hot * share))).orderBy(F.desc("n"), "fp").limit(100_000).collect())
    return np.array([r["fp"] for r in top], np.int64).view(np.uint64)


def repeated_runs(docs: DataFrame, hot: int = HOT, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, DataFrame]:
    """Documents -> (their packed texts, runs (doc, part, runs) of windows that repeat earlier strings)."""
    spark = docs.sparkSession
    rows, again = _keyed(docs)
    rows = rows.select(F.col("_doc").alias("doc"), F.col("_part").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.dropDuplicates(["doc", "part"]) if again else rows         # equal rows are one string
    n_docs, size = keyed.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / (32 << 20)), 1)
    common = _common(keyed, n_docs, hot, sample_docs)
    asked = map_batches(keyed, _again(parts, common), "text", BLOBS)
    found = cut_lineage(asked.groupBy("bucket").applyInPandas(_shared, "doc long, part int, spot long"))
    spots = found.groupBy("doc", "part").agg(F.collect_list("spot").alias("spots"))
    packed = _packed(rows)

    def unpack(it):
        work = _contexts(parts, common)
        for b in it:
            lo, acc, texts = 0, 0, []
            for i, z in enumerate(b.column(2)):
                texts.append(_expand(z.as_py()))
                acc += len(texts[-1])
                if acc > (1 << 20) or i == b.num_rows - 1:
                    s = b.slice(lo, i - lo + 1)
                    yield work(pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(texts, pa.binary()), s.column(3)],
                                                          names=["doc", "part", "text", "spots"]))
                    lo, acc, texts = i + 1, 0, []
    once = _packed(keyed) if again else packed
    blobs = once.join(spots, ["doc", "part"]).select("doc", "part", "z", "spots").mapInArrow(unpack, BLOBS)
    runs = cut_lineage(blobs.groupBy("bucket").applyInPandas(_settle, "doc long, part int, run long"))
    return packed, runs.groupBy("doc", "part").agg(F.collect_list("run").alias("runs"))


def spans_of(size: int, runs: np.ndarray) -> np.ndarray:
    """Maximal removed byte spans (start, end) of a text of ``size`` bytes."""
    if not len(runs):
        return np.zeros((0, 2), np.int64)
    lo = np.sort(runs) >> 16
    n = np.sort(runs) & 0xFFFF
    end = np.maximum.accumulate(lo + n - 1 + MATCH)
    new = np.r_[True, lo[1:] > end[:-1]]
    return np.c_[lo[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(lo) - 1]]]


def _cut(data: bytes, spans: np.ndarray) -> bytes:
    edge = np.r_[0, spans.ravel(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edge[0::2], edge[1::2]))


def digest_kept(docs: DataFrame, **ways) -> DataFrame:
    """Documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    packed, runs = repeated_runs(docs, **ways)

    def run(it):
        for b in it:
            out = []
            for z, r in zip(b.column(2), b.column(3)):
                data = _expand(z.as_py())
                s = spans_of(len(data), r.values.to_numpy() if r.is_valid else np.zeros(0, np.int64))
                out.append((len(data), int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(_cut(data, s)).hexdigest()))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                                             names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    rows = packed.join(runs, ["doc", "part"], "left").select("doc", "part", "z", "runs")
    got = rows.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return got.select(F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def whole_characters(data: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans shrunk so that no character loses only some of its bytes."""
    out = []
    for a, b in spans.tolist():
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def remove_repeats(docs: DataFrame, **ways) -> DataFrame:
    """The documents without their repeated strings, all columns kept (n_chars, if present, follows the text).

    Characters are never split: one of which only some bytes are covered stays.
    """
    _, runs = repeated_runs(docs.select("doc_id", "text"), **ways)
    runs = runs.select(F.col("doc").alias("_doc"), F.col("part").alias("_part"), F.col("runs").alias("_runs"))
    # the row travels as one value, so no column of it can clash
    rows = _keyed(docs.select("doc_id", "text", F.struct("*").alias("row")))[0].join(runs, ["_doc", "_part"], "left")

    def run(it):
        for b in it:
            out = []
            for t, r in zip(b.column(0), b.column(1)):
                data = (t.as_py() or "").encode()
                if r.is_valid:
                    s = whole_characters(data, spans_of(len(data), r.values.to_numpy()))
                    out.append(_cut(data, s).decode())
                else:
                    out.append(t.as_py())
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(out, pa.string())], names=["row", "rest"])
    row = T.StructField("row", docs.schema)
    kept = rows.select("text", "_runs", "row").mapInArrow(run, T.StructType([row, T.StructField("rest", T.StringType())]))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("rest")}
    if "n_chars" in own:
        own["n_chars"] = F.length("rest").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[v.alias(c) for c, v in own.items()])
