"""Many names at once: a trie of transition arrays walked from every position of a text.

Names of one dictionary share a root, all dictionaries of a shard one trie.
Its levels are arrays of (state, character) keys in order; the number of a key
is the state behind it.  All positions of a batch of texts take one step
together, and the few that a level still holds go on, so a position learns the
longest name that starts there.  Of these, each text keeps the leftmost ones
that do not overlap.

Dictionaries larger than a shard are cut by hash of the name.  Each shard (its
size is bounded) becomes files that Spark fetches once per executor, whose
Python workers map them, and the texts stream past it; where there are several,
their longest matches meet by text before the selection.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.operators.fingerprints import SCAN_CHARS, code_points
from tomewright.session import new_folder

SHARD_NAMES = 1_000_000
SHARD_CHARS = 16_000_000        # a shard's arrays take at most some 16 bytes per character


class Trie:
    """Names of several dictionaries as levels of sorted (state << 21 | character) keys and end marks (0: no end, else 1 + number of the name)."""

    def __init__(self, keys: list, names: list[str]):
        self.root = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        codes, off = code_points(names)
        size = np.diff(off)
        state = np.array([self.root[k] for k in keys], np.int64)
        live = np.flatnonzero(size > 0)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        depth = 0
        while len(live):
            key, number = np.unique(state[live] << 21 | codes[off[live] + depth], return_inverse=True)
            state[live] = number
            depth += 1
            end = np.zeros(len(key), np.int32)
            here = size[live] == depth
            end[number[here]] = live[here] + 1
            self.levels.append((key, end))
            live = live[size[live] > depth]

    def longest(self, texts: list[str], keys: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, length) of the longest name at every position that starts one."""
        return self.walk(texts, keys)[:3]

    def walk(self, texts: list[str], keys: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``longest`` with the number of the name."""
        codes, off = code_points(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(off))
        root = np.array([self.root.get(k, -1) if k is not None else -1 for k in keys], np.int64)
        state = root[row]
        at = np.flatnonzero(state >= 0)
        state, length = state[at], np.zeros(len(codes), np.int32)
        mark = np.zeros(len(codes), np.int32)
        for depth, (key, end) in enumerate(self.levels):
            inside = at + depth < off[row[at] + 1]
            at, state = at[inside], state[inside]
            want = state << 21 | codes[at + depth]
            to = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[to] == want
            at, state = at[hit], to[hit]
            stop = end[state]
            ends = stop > 0
            length[at[ends]], mark[at[ends]] = depth + 1, stop[ends]
            if not len(at):
                break
        start = np.flatnonzero(length)
        return row[start], start - off[row[start]], length[start].astype(np.int64), mark[start] - 1

    # -- files ------------------------------------------------------------
    def save(self, put) -> tuple:
        """``put(kind, bytes)`` takes the levels as one file of keys and one of marks; returns what ``mapped`` needs besides."""
        put("keys", np.concatenate([k for k, _ in self.levels] or [np.zeros(0, np.int64)]).tobytes())
        put("ends", np.concatenate([e for _, e in self.levels] or [np.zeros(0, np.int32)]).tobytes())
        return self.root, [len(k) for k, _ in self.levels]

    @classmethod
    def mapped(cls, root: dict, sizes: list[int], keys: str, ends: str) -> "Trie":
        """A trie over saved files, mapped read-only."""
        out, cut = cls.__new__(cls), np.r_[0, np.cumsum(sizes)].astype(int).tolist()
        k, e = (np.memmap(f, t, "r") if sizes else np.zeros(0, t) for f, t in ((keys, np.int64), (ends, np.int32)))
        out.root, out.levels = root, [(k[a:b], e[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        return out


def _publish(spark: SparkSession, rows: pa.Table, key: str) -> tuple:
    """The trie of ``rows`` (key, alias, ..) and the rows as files of every executor: what ``_fetched`` needs."""
    folder, name = new_folder(spark), f"names-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def put(kind: str, data) -> None:
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{kind}")
        out = at.getFileSystem(conf).create(at)
        try:
            for lo in range(0, len(data), 1 << 22):
                out.write(bytearray(data[lo:lo + (1 << 22)]))
        finally:
            out.close()
        spark.sparkContext.addFile(f"{folder}/{name}.{kind}")
    trie = Trie(rows.column(key).to_pylist(), rows.column("alias").to_pylist())
    sink = pa.BufferOutputStream()
    table = rows.drop_columns([key]).combine_chunks()
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    put("rows", memoryview(sink.getvalue()))
    return name, spark.sparkContext.broadcast(trie.save(put))


@lru_cache(maxsize=2)
def _mapped(name: str) -> pa.Table:
    return pa.ipc.open_file(pa.memory_map(SparkFiles.get(f"{name}.rows"))).read_all().combine_chunks()


def _fetched(name: str, shared) -> tuple[Trie, pa.Table]:
    return Trie.mapped(*shared.value, SparkFiles.get(f"{name}.keys"), SparkFiles.get(f"{name}.ends")), _mapped(name)


def leftmost(row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which matches (by text, then start; one per start) stay when each text is read from the left without overlaps."""
    if not len(row):
        return np.zeros(0, np.int64)
    wide = int((start + length).max()) + 1
    flat = row * wide + start
    after, kept, i = np.searchsorted(flat, flat + length).tolist(), [], 0
    while i < len(after):
        kept.append(i)
        i = after[i]
    return np.array(kept, np.int64)


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number per value, equal for equal ones."""
    whole = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
    return whole.dictionary_encode("encode").indices.to_numpy().astype(np.int64)


def _portions_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of about SCAN_CHARS characters, so that few texts of a batch are Python strings at a time."""
    size, lo, acc = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), 0, 0
    for i, n in enumerate(size.tolist()):
        if i > lo and acc + n > SCAN_CHARS:
            yield lo, i
            lo, acc = i, 0
        acc += n
    if len(size) > lo:
        yield lo, len(size)


def find_names(texts: DataFrame, names: DataFrame, key: str, place: Sequence[str], text: str = "text",
               shard_names: int = SHARD_NAMES, carried: Sequence[str] = (), first_of: str | None = None) -> DataFrame:
    """Names in reading order, leftmost-longest and without overlaps: place, ord, alias, carried columns.

    ``names`` holds distinct (key, alias) and the ``carried`` columns; a text is
    searched for the names of its own key.  ``place`` starts with ``key`` and
    identifies a text.  Null keys and texts hold no names.  ``first_of`` (a
    carried column) keeps the first name of each of its values in a row of
    ``texts``, chosen where the row is read; numbers stay those of all names.
    """
    place, carried = list(place), list(carried)
    names = names.where(F.col(key).isNotNull() & (F.length("alias") > 0)).select(key, "alias", *carried).distinct()
    size = names.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("alias")).alias("c")).first()
    shards = max(math.ceil(size["n"] / shard_names), math.ceil((size["c"] or 0) / SHARD_CHARS), 1)
    own, given = [texts.schema[c] for c in place], [names.schema[c] for c in carried]
    spark = texts.sparkSession

    def trie(k: int):
        return _publish(spark, names.where(F.pmod(F.xxhash64(key, "alias"), F.lit(shards)) == k).toArrow(), key)

    def search(files: tuple, choose: bool):
        name, shared = files

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, rows = _fetched(name, shared)
            groups = _codes(rows.column(first_of)) if choose and first_of else None
            for b in it:
                keys = b.column(0).to_pylist()
                for lo, hi in _portions_of(b.column(len(place))):
                    data = [t or "" for t in b.column(len(place)).slice(lo, hi - lo).to_pylist()]
                    row, start, length, number = known.walk(data, keys[lo:hi])
                    if choose:
                        kept = leftmost(row, start, length)
                        row, number = row[kept], number[kept]
                        first = np.searchsorted(row, np.arange(hi - lo))
                        start_or_no = np.arange(len(row)) - first[row]
                        if groups is not None and len(row):
                            _, lead = np.unique(row.astype(np.int64) << 32 | groups[number], return_index=True)
                            lead.sort()
                            row, number, start_or_no = row[lead], number[lead], start_or_no[lead]
                    else:
                        start_or_no = start
                    cols = [b.column(c).take(pa.array(row + lo)) for c in range(len(place))]
                    found = rows.take(pa.array(number)).combine_chunks()
                    found = [found.column(c).combine_chunks() for c in ("alias", *carried)]
                    found = [(c.chunk(0) if c.num_chunks else pa.array([], c.type)) if isinstance(c, pa.ChunkedArray) else c for c in found]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(start_or_no, pa.int32()), *found], names=[*place, "ord", "alias", *carried])
        return run
    schema = T.StructType(own + T._parse_datatype_string("ord int, alias string").fields + given)
    rows = texts.select(*place, F.col(text).alias("_t"))
    if shards == 1:
        return rows.mapInArrow(search(trie(0), True), schema)
    parts = [rows.mapInArrow(search(trie(k), False), schema) for k in range(shards)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy(*place, "ord").agg(F.max_by(F.struct("alias", *carried), F.length("alias")).alias("_x")).select(*place, "ord", "_x.*")

    def select(pdf):
        pdf = pdf.sort_values("ord")
        start = pdf["ord"].to_numpy(np.int64)
        kept = leftmost(np.zeros(len(pdf), np.int64), start, np.fromiter((len(a) for a in pdf["alias"]), np.int64, len(pdf)))
        pdf = pdf.iloc[kept]
        pdf = pdf.assign(ord=np.arange(len(pdf), dtype=np.int32))
        return pdf if first_of is None else pdf.drop_duplicates(first_of)
    return best.groupBy(*place).applyInPandas(select, schema)      # the matches of one text
