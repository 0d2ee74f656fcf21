"""Mixing sources to target weights.

Words per source are summed, shares are turned into repetition rates, and each
document is emitted floor(rate) times plus one copy drawn by a hash-seeded
Bernoulli trial whose probability is the fraction of the rate.

A document's size is its number of ``[^\\x20\\x09-\\x0D]+`` words (null text: 0).
Sources are numbered by code point, null last, and weigh 5, 2, 1, repeating.
They share ``volume`` times all words by weight; a target stops at ``most``
times the words of its source and the excess is shared again among the others,
which is the water level found by sorting sources by (cap / weight).

Rows sharing a doc_id draw alike; a null doc_id draws as ''.  An empty table
gives an empty result, a source without words gets target 0.  Only the named
columns are used; others pass through ``emit`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
BROADCAST_SOURCES = 50_000      # a rate row is below 200 bytes: at most about 10 MB are broadcast


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, volume: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, target.  The windows run over sources, not documents."""
    per = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    names = one.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(names) - 1) % len(weights))
    s = per.withColumn("_w", w).withColumn("_cap", F.col("source_size") * most)
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    fill = one.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_rest": F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "_all": F.sum("source_size").over(one) * volume})
    level = (F.col("_all") - F.col("_full")) / F.col("_rest")
    s = s.withColumn("_level", F.min(F.when(level <= F.col("_ratio"), F.struct(F.col("_ratio"), level.alias("v")))).over(one)["v"])
    return s.select("source", "source_size",
                    F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap")).alias("target"))


def with_copies(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """Add size, source_size, target and copies to the documents (input columns of these names are replaced)."""
    rates = source_targets(docs, **shares)
    small = rates.agg(F.count(F.lit(1))).first()[0] <= BROADCAST_SOURCES
    rates = rates.withColumnRenamed("source", "_src")
    rates = F.broadcast(rates) if small else rates
    new = [c for c in ("size", "source_size", "target", "copies", "_src") if c in docs.columns]
    joined = docs.drop(*new).join(rates, docs["source"].eqNullSafe(rates["_src"]), "left").drop("_src")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                                 .cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return joined.withColumns({"size": n_words(F.col("text")),
                               "copies": (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")})


def emit(docs: DataFrame, **shares) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged whatever their names."""
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    taken = with_copies(rows, **shares).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
