"""Window-minimiser fingerprints of texts: a streamed search and a stored index.

A gram is GRAM characters; of every WINDOW consecutive grams those with the
least hash are fingerprints.  A text that contains a passage of at least SHORT
characters contains the windows of the passage, hence its fingerprints, at the
same offsets.  So one fingerprint of a passage names every place where it can
stand, and comparing the characters decides.

* ``scan``: few passages are broadcast (their number is bounded) as hashes that
  tasks have made of them, never as characters, and the texts stream past them;
  nothing is shuffled.  Passages too short for a window are looked up by the
  hash of their first characters.
* ``PassageIndex``: fingerprints of a corpus in a table bucketed by
  fingerprint, to which parts can be appended.  A passage is looked up by its
  rarest fingerprint.  Fingerprints that stand at more than HEAVY places are
  listed in a side table; a passage made of nothing else is looked up by the
  hash of the longest of SPANS characters behind its first fingerprint, so a
  line found in every document does not meet every passage that holds it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

GRAM, WINDOW = 12, 16
SHORT = GRAM + WINDOW - 1       # passages below hold no whole window
SPANS = (32, 64, 128, 256, 512, 1024)
HEAVY = 1000                    # places of a fingerprint from which on it is heavy
SCAN_CHARS = 1 << 17            # characters a task looks at together
BLOCK_CHARS = 1 << 13           # and the last text of them
COMPARED = 1 << 20              # places compared together
SHORT_SPANS = (1, 2, 4, 8, 16)  # stretches by which passages without a fingerprint are looked up
SHORT_GATES = (1, 4, 12)
DESCRIBED = ("size", "lead", "span", "gate", "key", "whole", "d0", "d1")

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD1B54A32D192ED03)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(maxsize=4)
def _first_powers(base: np.uint64) -> np.ndarray:
    out = np.full(SCAN_CHARS + BLOCK_CHARS, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    if n <= SCAN_CHARS + BLOCK_CHARS:
        return _first_powers(base)[:max(n, 1)]
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _bits(n: int) -> int:
    """For a table of one byte per slot that is at most a sixteenth full."""
    return max(16, (16 * n).bit_length())


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h * _SPREAD >> np.uint64(64 - bits)).view(np.int64)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts end to end, and the offsets of the texts."""
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


class Hashes:
    """Hashes of all character stretches of one array: differences of a running sum."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * _powers(_MUL, n)[:n], out=self.sum[1:])
        self.back = _powers(_INV, n + 1)

    def raw(self, size: int) -> np.ndarray:
        """Hash, not yet finalised, of the ``size`` characters at every position that has as many behind it."""
        n = max(len(self.sum) - size, 0)
        return (self.sum[size:size + n] - self.sum[:n]) * self.back[:n]

    def all(self, size: int) -> np.ndarray:
        return _mix(self.raw(size))

    def raw_at(self, start: np.ndarray, size: int) -> np.ndarray:
        return (self.sum[start + size] - self.sum[start]) * self.back[start]

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        return _mix(self.raw_at(start, size))


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """Extreme of every ``size`` (a power of two) neighbours."""
    step = 1
    while step < size:
        x = pick(x[:-step], x[step:]) if len(x) > step else x[:0]
        step *= 2
    return x


def minimisers(h: np.ndarray) -> np.ndarray:
    """Positions that hold the least gram hash of one of the windows they lie in."""
    least = _sliding(h, WINDOW, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64)
    edge = np.zeros(WINDOW - 1, np.uint64)
    return np.flatnonzero(_sliding(np.r_[edge, least, edge], WINDOW, np.maximum) == h)


def described(passages: DataFrame, text: str, kept: Sequence[str]) -> DataFrame:
    """kept columns and what ``Probes`` takes of a passage in place of its characters: size, lead, span, gate, key, whole, d0, d1.

    ``lead`` is where its fingerprint stands (0 in a short one), ``key`` the
    hash of the longest of the steps that fits behind it (``span`` characters),
    ``gate`` that of its first few characters, ``whole`` that of all; d0 and d1
    are a digest of 128 bits.
    """
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            for lo, hi in _portions(texts):
                codes, off = code_points(texts[lo:hi])
                hashes, at, size = Hashes(codes), off[:-1], np.diff(off)
                long, lead = np.flatnonzero(size >= SHORT), np.zeros(hi - lo, np.int64)
                if len(long):
                    lead[long] = hashes.all(GRAM)[at[long][:, None] + np.arange(WINDOW)].argmin(axis=1)
                span, gate = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for some, steps, gates in ((size >= SHORT, (GRAM, *SPANS), (GRAM,)), (size < SHORT, SHORT_SPANS, SHORT_GATES)):
                    for n in steps:
                        span[some & (size - lead >= n)] = n
                    for n in gates:
                        gate[some & (size >= n)] = n
                numbers = [x.view(np.int64) for x in (hashes.raw_at(at + lead, gate), hashes.raw_at(at + lead, span), hashes.raw_at(at, size), *_digests(codes, at, size).T)]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in kept], *[pa.array(x, pa.int32()) for x in (size, lead, span)],
                                                  *[pa.array(np.ascontiguousarray(x)) for x in numbers]], names=[*kept, *DESCRIBED])
    schema = T.StructType([passages.schema[c] for c in kept] + T._parse_datatype_string("size int, lead int, span int, gate long, key long, whole long, d0 long, d1 long").fields)
    return passages.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def _digests(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two numbers per stretch of characters, equal for equal stretches only."""
    data = memoryview(np.ascontiguousarray(codes)).cast("B") if len(codes) else memoryview(b"")
    found = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip((4 * start).tolist(), (4 * (start + size)).tolist())]
    return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


class Probes:
    """Described passages prepared for ``scan``: looked up by (scope, hash), confirmed by their digests.

    A gate of one byte per slot turns nearly all positions of a text away: the
    passages with a fingerprint share one over the minimisers, short ones have
    one over all positions for each size of their first characters.  What it
    lets through is looked up by the longest stretch that passages hold, so
    those that only begin alike do not meet each other's places.
    """

    def __init__(self, rows: pa.Table, scope: list[str], passed: list[str]):
        self.rows = rows.select(passed).combine_chunks()
        size, lead, span, gate, key, whole, *digest = (rows.column(c).to_numpy() for c in DESCRIBED)
        self.size, self.lead, self.whole = size, lead, whole.view(np.uint64)
        # chunks of longer passages: all their places are needed
        self.listed = np.zeros(len(size), bool)
        if "cid" in passed:
            self.listed = rows.column("cid").is_valid().to_numpy()
        elif "n_chunks" in passed:
            self.listed = rows.column("n_chunks").to_numpy() > 1
        self.digest = np.stack(digest, axis=1).view(np.uint64) if len(size) else np.zeros((0, 2), np.uint64)
        self.scopes: dict[tuple, int] = {}
        own = [self.scopes.setdefault(k, len(self.scopes)) for k in zip(*[rows.column(c).to_pylist() for c in scope])] if scope else []
        salt = np.array(own, np.uint64) * _MUL if scope else np.zeros(len(size), np.uint64)
        for k in self.scopes:
            if None in k:                                   # a null scope equals nothing
                self.scopes[k] = -1
        gate, key = gate.view(np.uint64) + salt, _mix(key.view(np.uint64) + salt)
        first = np.zeros(len(size), np.int64)               # 0: by fingerprint, else so many characters
        for n in SHORT_GATES:
            first[(size < SHORT) & (size >= n)] = n
        self.gates = []
        for n in np.unique(first[size > 0]).tolist():
            at = np.flatnonzero((first == n) & (size > 0))
            spans = [self._table(key, at[span[at] == k], k) for k in np.unique(span[at]).tolist()]
            bits = _bits(len(at))
            seen = np.zeros(1 << bits, bool)
            seen[_slots(gate[at], bits)] = True
            self.gates.append((n, bits, seen, spans))

    @staticmethod
    def _table(key: np.ndarray, at: np.ndarray, span: int) -> tuple:
        at = at[np.argsort(key[at], kind="stable")]
        bits = _bits(len(at))
        seen = np.zeros(1 << bits, bool)
        seen[_slots(key[at], bits)] = True
        return span, key[at], at, bits, seen

    def find(self, texts: list[str], scope: list[tuple] | None, owned: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, text, start) of all occurrences that start within the first ``owned`` characters of a text."""
        codes, off = code_points(texts)
        long = np.diff(off)
        row = np.repeat(np.arange(len(texts)), long)
        code = np.array([self.scopes.get(s, -1) for s in scope], np.int64) if scope is not None else np.zeros(len(texts), np.int64)
        salt, live = np.repeat(code.astype(np.uint64) * _MUL, long), code >= 0
        hashes, out = Hashes(codes), []
        for n, bits, seen, spans in self.gates:
            h = hashes.raw(n or GRAM)
            if n:
                p = np.flatnonzero(seen.take(_slots(h + salt[:len(h)], bits)))
            else:
                p = minimisers(_mix(h))
                p = p[seen.take(_slots(h[p] + salt[p], bits))]
            p = p[live[row[p]]]
            for span, key, who, bits, seen in spans:
                q = p[p + span <= len(codes)]
                want = _mix(hashes.raw_at(q, span) + salt[q])
                some = seen.take(_slots(want, bits))
                q, want = q[some], want[some]
                lo = np.searchsorted(key, want)
                many = np.searchsorted(key, want, side="right") - lo
                upto = np.cumsum(many)
                a = 0
                while a < len(q):                           # so many candidates at a time
                    b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + COMPARED, side="right")), a + 1)
                    m = many[a:b]
                    at = np.repeat(lo[a:b] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
                    at, start = who[at], np.repeat(q[a:b], m)
                    r, start = row[start], start - self.lead[at]
                    size = self.size[at]
                    ok = (start >= off[r]) & (start < off[r] + owned) & (start + size <= off[r + 1])
                    at, start, r, size = at[ok], start[ok], r[ok], size[ok]
                    ok = hashes.raw_at(start, size) == self.whole[at]
                    at, start, r, size = at[ok], start[ok], r[ok], size[ok]
                    ok = (_digests(codes, start, size) == self.digest[at]).all(axis=1)
                    out.append((at[ok], r[ok], (start - off[r])[ok]))
                    a = b
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, acc = 0, 0
    for i, t in enumerate(texts):
        if i > lo and acc + len(t) > SCAN_CHARS:
            yield lo, i
            lo, acc = i, 0
        acc += len(t)
    if len(texts) > lo:
        yield lo, len(texts)


def scan(blocks: DataFrame, probes: Probes, place: Sequence[str], scope: Sequence[str], owned: int, schema: T.StructType,
         most: int | None = None) -> DataFrame:
    """Stream (place, base, block) past broadcast passages: their columns, place, pos = base + start.

    With ``most`` a task lists so many places of a passage only (``probes.listed``
    marks those it lists in full).  A last column ``more`` is true in one row
    that has the least of the places left out and no place columns.
    """
    shared, own = blocks.sparkSession.sparkContext.broadcast(probes), [p for p in place if p not in probes.rows.column_names]
    kinds = [blocks.schema[c] for c in own]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value

        def passed(who: np.ndarray) -> list[pa.Array]:
            found = p.rows.take(pa.array(who))
            cols = [found.column(c).combine_chunks() for c in found.column_names]
            return [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        seen = np.zeros(len(p.size), np.int64)
        least = np.full(len(p.size), np.iinfo(np.int64).max)
        for b in it:
            texts = [t or "" for t in b.column(b.schema.get_field_index("block")).to_pylist()]
            keys = [b.column(b.schema.get_field_index(c)).to_pylist() for c in scope]
            bases = b.column(b.schema.get_field_index("base"))
            for lo, hi in _portions(texts):
                who, row, start = p.find(texts[lo:hi], list(zip(*[k[lo:hi] for k in keys])) if scope else None, owned)
                if not len(who):
                    continue
                pos = bases.take(pa.array(row + lo)).to_numpy() + start
                if most is not None:
                    order = np.argsort(who, kind="stable")
                    who, row, pos = who[order], row[order], pos[order]
                    number = np.arange(len(who)) - np.searchsorted(who, who) + seen[who]
                    np.add.at(seen, who, 1)
                    kept = (number < most) | p.listed[who]
                    np.minimum.at(least, who[~kept], pos[~kept])
                    who, row, pos = who[kept], row[kept], pos[kept]
                cols = passed(who) + [b.column(b.schema.get_field_index(c)).take(pa.array(row + lo)) for c in own] + [pa.array(pos, pa.int64())]
                cols += [] if most is None else [pa.array(np.zeros(len(who), bool))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        who = np.flatnonzero((seen > (most or 0)) & ~p.listed) if most is not None else ()
        if len(who):
            yield pa.RecordBatch.from_arrays([*passed(who), *[pa.nulls(len(who), to_arrow_type(k.dataType)) for k in kinds], pa.array(least[who]),
                                              pa.array(np.ones(len(who), bool))], names=schema.names)
    return blocks.select(*place, "base", "block").mapInArrow(run, schema)


# -- stored index -----------------------------------------------------------
def _prints(df: DataFrame, text: str, kept: Sequence[str]) -> DataFrame:
    """kept columns, at, fp: the fingerprints of every text."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            for lo, hi in _portions(texts):
                codes, off = code_points(texts[lo:hi])
                h = Hashes(codes).all(GRAM)
                at, row = [], []
                for k in range(hi - lo):            # windows do not cross texts
                    p = minimisers(h[off[k]:max(off[k + 1] - GRAM + 1, off[k])])
                    at.append(p)
                    row.append(np.full(len(p), k))
                at, row = np.concatenate(at), np.concatenate(row)
                cols = [b.column(b.schema.get_field_index(c)).take(pa.array(row + lo)) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at, pa.int32()), pa.array(h[off[row] + at].view(np.int64))],
                                                 names=[*kept, "at", "fp"])
    schema = T.StructType([df.schema[c] for c in kept] + T._parse_datatype_string("at int, fp bigint").fields)
    return df.select(*kept, text).mapInArrow(run, schema)


def _names(df: DataFrame, text: str, sizes: list[int], kept: Sequence[str]) -> DataFrame:
    """kept columns, span, name: hash of as many characters from ``at`` on (span 0: no characters, name 0)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            start = b.column(b.schema.get_field_index("at")).to_numpy()
            for lo, hi in _portions(texts):
                codes, off = code_points(texts[lo:hi])
                hashes, at = Hashes(codes), off[:-1] + start[lo:hi]
                row, span, name = [], [], []
                for n in sizes:
                    ok = np.flatnonzero(at + n <= off[1:])
                    row.append(ok)
                    span.append(np.full(len(ok), n))
                    name.append(hashes.at(at[ok], n) if n else np.zeros(len(ok), np.uint64))
                row, span, name = (np.concatenate(x) for x in (row, span, name))
                cols = [b.column(b.schema.get_field_index(c)).take(pa.array(row + lo)) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(span, pa.int32()), pa.array(name.view(np.int64))],
                                                 names=[*kept, "span", "name"])
    schema = T.StructType([df.schema[c] for c in kept] + T._parse_datatype_string("span int, name bigint").fields)
    return df.select(*dict.fromkeys([*kept, "at", text])).mapInArrow(run, schema)


def lookup(postings: DataFrame, heavy: DataFrame, blocks: DataFrame, chunks: DataFrame, place: Sequence[str], scope: Sequence[str],
           owned: int) -> DataFrame:
    """Occurrences of ``chunks`` (id, chunk, scope columns) of at least SHORT characters: id, place, pos.

    ``postings`` holds (place, base, at, fp), ``heavy`` the fingerprints with many places (fp, n).
    """
    place, scope = list(place), list(scope)
    mine = _prints(chunks, "chunk", ["id"]).withColumnRenamed("at", "c")
    mine = mine.join(heavy.select("fp", "n"), "fp", "left")
    mine = mine.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "c", "fp")).alias("m"))
    mine = mine.select("id", "m.n", "m.c", "m.fp").join(chunks.select("id", F.length("chunk").alias("len"), *[F.col(s).alias(f"_{s}") for s in scope]), "id")
    # among heavy ones the first leaves the longest rest
    light, hard = mine.where("n = 0"), mine.where("n > 0")
    out = [light.join(postings, "fp")]
    spans = F.coalesce(*[F.when(F.col("len") - F.col("c") >= s, F.lit(s)) for s in reversed(SPANS)], F.lit(0)).cast("int")
    hard = hard.withColumn("span", spans)
    sizes = [r["span"] for r in hard.select("span").distinct().collect()]      # at most len(SPANS) + 1 values
    if sizes:
        named = _names(hard.join(chunks.select("id", "chunk"), "id").withColumn("at", F.col("c")), "chunk", sizes, [*hard.columns[:-1]])
        named = named.join(hard.select("id", "span"), ["id", "span"])
        spots = postings.join(hard.select("fp").distinct(), "fp", "left_semi").join(blocks, [*place, "base"])
        out.append(named.join(_names(spots, "block", sizes, ["fp", *place, "base", "at"]), ["fp", "span", "name"]).drop("span", "name"))
    cand = out[0] if len(out) == 1 else out[0].unionByName(out[1].select(*out[0].columns))
    for s in scope:
        cand = cand.where(F.col(s) == F.col(f"_{s}"))
    start = F.col("at") - F.col("c")
    cand = cand.where((start >= 0) & (start < owned)).select("id", "len", *place, "base", start.alias("s"))
    same = F.substring(F.col("block"), F.col("s") + 1, F.col("len")) == F.col("chunk")
    return (cand.join(blocks.select(*place, "base", "block"), [*place, "base"]).join(chunks.select("id", "chunk"), "id").where(same)
            .select("id", *place, (F.col("base") + F.col("s")).cast("long").alias("pos")))


def heavy_prints(postings: DataFrame, least: int = HEAVY) -> DataFrame:
    """Fingerprints at more than ``least`` places: fp, n."""
    return postings.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)


class PassageIndex:
    """Stored fingerprints of a corpus below ``path``: postings bucketed by fingerprint, blocks, heavy fingerprints.

    ``place`` names the columns that identify a text; a text belongs to one
    part.  The heavy fingerprints are counted anew with each part, over all
    parts, and carry its number.
    """

    def __init__(self, spark: SparkSession, path: str, place: Sequence[str], buckets: int = 64, heavy: int = HEAVY):
        self.spark, self.path, self.place, self.buckets, self.least = spark, path.rstrip("/"), list(place), buckets, heavy
        self.name = "tomewright_postings_" + hashlib.md5(self.path.encode()).hexdigest()

    def _write(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").parquet(f"{self.path}/{table}")

    def append(self, corpus: DataFrame, text: str = "norm") -> "PassageIndex":
        """Add the texts of ``corpus`` (place, text) as a part."""
        from tomewright.operators.passages import text_blocks
        from tomewright.session import cut_lineage
        blocks = cut_lineage(text_blocks(corpus, self.place, text))
        self._write(blocks, "blocks")
        (_prints(blocks, "block", [*self.place, "base"]).repartition(self.buckets, "fp").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/postings").saveAsTable(self.name))
        part = self._parts() + 1
        marked = heavy_prints(self.postings(), self.least).withColumn("part", F.lit(part))
        self._write(marked.unionByName(self.spark.range(1).select(F.lit(None).cast("long").alias("fp"), F.lit(0).cast("long").alias("n"),
                                                                  F.lit(part).alias("part"))), "heavy")
        return self

    def open(self) -> "PassageIndex":
        """Make an index that another session has written known to this one."""
        if not self.spark.catalog.tableExists(self.name):
            kinds = ", ".join(f"`{n}` {t}" for n, t in self.spark.read.parquet(f"{self.path}/postings").dtypes)
            self.spark.sql(f"CREATE TABLE {self.name} ({kinds}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/postings'")
        return self

    def _parts(self) -> int:
        from pyspark.errors import AnalysisException
        try:
            return self.spark.read.parquet(f"{self.path}/heavy").agg(F.max("part")).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    def postings(self) -> DataFrame:
        return self.spark.table(self.name)

    def heavy(self) -> DataFrame:
        h = self.spark.read.parquet(f"{self.path}/heavy")
        return h.where((F.col("part") == self._parts()) & F.col("fp").isNotNull()).select("fp", "n")

    def find(self, passages: DataFrame, passage_key: str, text: str = "norm") -> DataFrame:
        """One row per (passage, place): first position and number of occurrences, as ``find_passages``."""
        from tomewright.operators.passages import find_segments
        hits = find_segments(self.spark.read.parquet(f"{self.path}/blocks"), passages.select(passage_key, F.col(text).alias("seg")),
                             [passage_key], self.place, index=self)
        return hits.groupBy(passage_key, *self.place).agg(F.min("pos").alias("pos"), F.count("*").alias("hits"))
