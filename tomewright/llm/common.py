"""Shared helpers: table input, byte batches of texts, word and line hashes in numpy.

Texts of a batch are laid end to end in one byte array.  A word is a maximal
run of bytes other than space and 0x09-0x0D, which for UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 1 << 20           # text bytes handled at once inside a task; larger single texts go alone
_POW = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xC2B2AE3D27D4EB4F)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read by Spark wherever the folder lies."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix(a * _POW + b * _MUL + np.uint64(0x632BE59BD9B4E019))


def powers(n: int) -> np.ndarray:
    """Odd multiplier to the power 0 .. n - 1, modulo 2**64."""
    out = np.full(max(n, 1), _POW, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values (null counts as empty) laid end to end, and their offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def batches(it: Iterator[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each stay near ``most`` bytes (a longer text goes alone)."""
    for b in it:
        sizes = np.diff(byte_rows(b.column(b.schema.get_field_index(text)))[1])
        lo, acc = 0, 0
        for i, s in enumerate(sizes):
            if i > lo and acc + s > most:
                yield b.slice(lo, i - lo)
                lo, acc = i, 0
            acc += s
        if len(sizes) > lo:
            yield b.slice(lo)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], text: str, schema: str,
                most: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` over byte-bounded batches; ``fn`` may return one batch or a list of them."""
    def run(it):
        for b in batches(it, text, most):
            out = fn(b)
            yield from out if isinstance(out, list) else [out]
    return df.mapInArrow(run, schema)


def run_starts(row: np.ndarray) -> np.ndarray:
    """Positions where the value differs from the one before."""
    return np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)


def segment_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte segment ``raw[start:end]`` (segments ascending, not overlapping, not empty)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = end - start
    where = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    pw = powers(int(n.max()))
    term = (raw[where].astype(np.uint64) + np.uint64(1)) * pw[where - np.repeat(start, n)]
    return mix(np.add.reduceat(term, np.r_[0, np.cumsum(n)[:-1]]) + n.astype(np.uint64) * _MUL)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    solid = ~IS_SPACE[raw]
    brk = np.zeros(len(raw) + 1, bool)
    brk[off] = True
    prev = np.r_[False, solid[:-1]]
    start = np.flatnonzero(solid & (~prev | brk[:-1]))
    nxt = np.r_[solid[1:], False]
    end = np.flatnonzero(solid & (~nxt | brk[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` values inside one row, and the index of its first value."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    acc = h[:n].copy()
    for i in range(1, k):
        acc = acc * _POW + h[i:i + n]
    at = np.flatnonzero(row[:n] == row[k - 1:])
    return mix(acc[at]), at


def gather(flat: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``flat[off[i]:off[i+1]]`` for all ids; also the offsets of the pieces."""
    n = off[ids + 1] - off[ids]
    to = np.r_[0, np.cumsum(n)]
    return flat[np.repeat(off[ids] - to[:-1], n) + np.arange(to[-1])], to


def add_columns(df: DataFrame, text: str, fn: Callable[[pa.Array], list], new: dict[str, str]) -> DataFrame:
    """All columns of ``df`` plus new ones computed from its text column, batch by batch.

    ``fn`` takes the texts of a batch and returns one array or list per new
    column.  Input columns that carry one of the new names are replaced.
    """
    from pyspark.sql import types as T
    base = df.drop(*[c for c in new if c in df.columns])
    extra = T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in new.items()))
    schema = T.StructType(base.schema.fields + extra.fields)
    arrow = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [arrow[f.dataType.simpleString()] for f in extra.fields]

    def run(it):
        for b in batches(it, text):
            out = fn(b.column(b.schema.get_field_index(text)))
            cols = [o if isinstance(o, pa.Array) else pa.array(o, k) for o, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *new])
    return base.mapInArrow(run, schema)


def training_labels(labels: DataFrame, label: str, split: int, held: int) -> DataFrame:
    """(doc_id, y) of all labelled ids with ``crc32(doc_id as text) % split <> held``; of several labels the largest."""
    from pyspark.sql import functions as F
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(remainder(split) != held)
    return y.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, split: int, held: int, per_class: int) -> DataFrame:
    """(text, y) of at most ``per_class`` labelled training texts of either class, near copies thinned out.

    Rows with ``crc32(doc_id as text) % split = held`` are never used.  The
    draw is by hash of the id, so it is the same on every run.  The ids are
    broadcast; their number is bounded by the parameter.
    """
    from pyspark.sql import functions as F
    y = training_labels(labels, label, split, held)
    draw = F.xxhash64(F.col("doc_id"), F.lit(label))
    ids = [y.where(F.col("y") == k).orderBy(draw, "doc_id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(ids[0].unionByName(ids[1]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    rows = add_columns(rows, "text", _least_shingle, {"_h": "bigint"})
    # texts without a shingle stand for themselves wherever they were read; a repeated row is one text
    own = F.when(F.col("_h").isNull(), F.struct("doc_id", F.sha2("text", 256)))
    return rows.groupBy("_h", own.alias("_own")).agg(F.min_by(F.struct("text", "y"), "doc_id").alias("r")).select("r.*")


def _least_shingle(col: pa.Array) -> list:
    """Smallest five-word hash of each text (null below five words): most near copies of a text share it."""
    raw, off = byte_rows(col)
    start, end, row = words(raw, off)
    h, at = windows(segment_hash(raw, start, end), row, 5)
    out, short = np.zeros(len(off) - 1, np.uint64), np.ones(len(off) - 1, bool)
    if len(h):
        r = row[at]
        first = run_starts(r)
        out[r[first]] = np.minimum.reduceat(h, first)
        short[r[first]] = False
    return [pa.array(out.view(np.int64), mask=short)]


def remainder(split: int):
    """crc32 of doc_id as text modulo ``split`` (a null id counts as the empty text)."""
    from pyspark.sql import functions as F
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % split


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each row."""
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[off[1:]] - total[off[:-1]]


def byte_set(chars: str) -> np.ndarray:
    """Lookup table: byte is one of these (ASCII) characters."""
    lut = np.zeros(256, bool)
    lut[list(chars.encode("ascii"))] = True
    return lut
