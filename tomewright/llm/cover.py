"""Suffix order of a corpus to a bounded depth by a distributed difference cover.

Positions of every text whose index is 1 or 2 modulo 3 are the sample.

* Sort.  Triples of symbols at sampled positions are ranked: counted by
  content, the distinct ones ordered by range partitions, each numbered with
  how many triples are smaller.
* Recurse.  The numbers of a text at indices 1, 4, 7, .. and at 2, 5, 8, ..
  make two shorter texts, ordered alike.  A level reads three times as far as
  the one above; the last is the first whose triples reach the depth.
* Merge.  A position of index 0 compares with one of index 1 by (symbol, order
  of the next), with one of index 2 by (two symbols, order of the one after),
  as both followers are sampled.  Two rankings by these keys count for each
  position how many of the other kinds are smaller; the sum is its place.
* Compare.  Neighbours in the order are compared over ``match`` bytes; in a run
  of equal ones all but the earliest are repeats.

The place of a position is the number of positions smaller to at least the
depth; those that differ within it have different places in the right order.
Every step is a join, an aggregate or an ordered scan over narrow rows; windows
run over single texts.  About 2.6 rows a byte pass some six shuffles, which is
why ``suffixes.py`` serves the registered query (figures in the README); this
module is exact, needs no hashes, and gives the order itself.

Null texts are empty, a null doc_id comes last, rows sharing a doc_id are its
parts, ordered by the hash of their text (of equal rows the later one repeats
the other).  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewright.operators.ordered import ordered_scan
from tomewright.session import cut_lineage

MATCH = 100


def _smaller(rows: DataFrame, key: list[str], counts: dict) -> DataFrame:
    """Per distinct key: for each count, its sum over all rows with a smaller key."""
    distinct = rows.groupBy(*key).agg(*[F.sum(c).alias(n) for n, c in counts.items()]).withColumn("_all", F.lit(0))
    return ordered_scan(distinct, ["_all"], key[0], ties=key[1:], total={f"{n}_less": F.col(n) for n in counts}).select(
        *key, *[F.col(f"{n}_less").cast("long").alias(f"{n}_less") for n in counts])


def suffix_places(texts: DataFrame, depth: int, reach: int = 3) -> DataFrame:
    """Place of every position (s, k, r) among all, from symbols x >= 1 at (s, k); ``reach`` is what a triple here spans."""
    along = Window.partitionBy("s").orderBy("k")
    ahead = lambda c, n: F.coalesce(F.lead(c, n).over(along), F.lit(0).cast("long"))
    rows = cut_lineage(texts.withColumns({"x1": ahead("x", 1), "x2": ahead("x", 2)}))
    one = F.lit(1).cast("long")
    sample = rows.where("k % 3 > 0")
    names = _smaller(sample, ["x", "x1", "x2"], {"n": one})
    named = sample.join(names, ["x", "x1", "x2"]).select("s", "k", (F.col("n_less") + 1).alias("x"))
    if reach < depth:
        below = suffix_places(named.select((F.col("s") * 2 + F.col("k") % 3 - 1).alias("s"), F.expr("k div 3").alias("k"), "x"),
                              depth, reach * 3)
        named = below.select(F.shiftright("s", 1).alias("s"), (F.col("k") * 3 + F.col("s") % 2 + 1).alias("k"), (F.col("r") + 1).alias("x"))
    rows = rows.join(named.withColumnRenamed("x", "p"), ["s", "k"], "left")
    rows = cut_lineage(rows.select("s", "k", "x", "x1", "p", ahead("p", 1).alias("p1"), ahead("p", 2).alias("p2")))
    kind = F.col("k") % 3
    near = _smaller(rows.where(kind < 2), ["x", "p1"], {"n0": F.when(kind == 0, one).otherwise(0), "n1": F.when(kind == 1, one).otherwise(0)})
    far = _smaller(rows.where(kind != 1), ["x", "x1", "p2"], {"m0": F.when(kind == 0, one).otherwise(0), "m2": F.when(kind == 2, one).otherwise(0)})
    first = rows.where(kind == 1).join(near, ["x", "p1"]).select("s", "k", (F.col("p") - 1 + F.col("n0_less")).alias("r"))
    second = rows.where(kind == 2).join(far, ["x", "x1", "p2"]).select("s", "k", (F.col("p") - 1 + F.col("m0_less")).alias("r"))
    rest = rows.where(kind == 0).join(near, ["x", "p1"]).join(far, ["x", "x1", "p2"]).select(
        "s", "k", (F.col("n0_less") + F.col("n1_less") + F.col("m2_less")).alias("r"))
    return cut_lineage(first.unionByName(second).unionByName(rest))


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s, raw in zip(b.column("s").to_pylist(), b.column("raw")):
            x = np.frombuffer(raw.as_buffer(), np.uint8).astype(np.int64) + 1
            for at in range(0, len(x), 1 << 20):
                part = x[at:at + (1 << 20)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), s)), pa.array(np.arange(at, at + len(part))), pa.array(part)],
                                                 names=["s", "k", "x"])


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, raw (the text's bytes), s (from 0, by doc_id with null last, then text)."""
    once = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    once = once.withColumns({"_all": F.lit(0), "_last": F.col("doc_id").isNull(), "_text": F.sha2("raw", 256)})
    places = ordered_scan(once, ["_all"], "_last", ties=["doc_id", "_text"], total={"s": F.lit(1)})
    return cut_lineage(places.select("doc_id", "raw", F.col("s").cast("long").alias("s")))


def repeated_starts(texts: DataFrame, match: int = MATCH) -> DataFrame:
    """Starts (s, k) in ``numbered`` texts of ``match``-byte strings that also start earlier."""
    filled = texts.where(F.octet_length("raw") > 0).select("s", "raw")
    places = suffix_places(filled.mapInArrow(_symbols, "s long, k long, x long"), match)
    whole = places.join(texts.select("s", "raw"), "s").where(F.col("k") + match <= F.octet_length("raw")).select(
        "s", "k", "r", F.substring("raw", F.col("k").cast("int") + 1, F.lit(match)).alias("w"), F.lit(0).alias("_all"))
    near = cut_lineage(ordered_scan(whole, ["_all"], "r", ties=["s", "k"], behind={"p": F.col("w")}).select(
        "s", "k", "r", "_all", (~F.col("w").eqNullSafe(F.col("p"))).cast("long").alias("new")))
    runs = cut_lineage(ordered_scan(near, ["_all"], "r", ties=["s", "k"], total={"no": F.col("new")}, written=True)
                       .select("s", "k", (F.col("no") + F.col("new")).alias("run")))
    first = runs.groupBy("run").agg(F.min(F.struct("s", "k")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return runs.join(first.select("run", "first"), "run").where(F.struct("s", "k") != F.col("first")).select("s", "k")


def removed(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """doc_id, s, n_bytes, n_removed, n_spans (maximal removed runs) for every row of ``docs``."""
    texts = numbered(docs)
    along = Window.partitionBy("s").orderBy("k")
    k = F.col("k")
    cut = repeated_starts(texts, match).select("s", F.least(F.coalesce(F.lead(k).over(along) - k, F.lit(match)), F.lit(match)).alias("own"),
                                               F.coalesce(k > F.lag(k).over(along) + match, F.lit(True)).cast("long").alias("new"))
    per = cut.groupBy("s").agg(F.sum("own").alias("n_removed"), F.sum("new").alias("n_spans"))
    return texts.join(per, "s", "left").select("doc_id", "s", F.octet_length("raw").cast("long").alias("n_bytes"),
                                               *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")])
