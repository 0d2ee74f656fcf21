"""Ordered operators that survive one huge key.

A plain ``Window.partitionBy(book).orderBy(idx)`` puts a whole book into one
task.  Here the rows are first cut into blocks of bounded size by their rank:
written once, range partitioned by (key, order), one block per partition.  The
window runs inside a block, one small row per block is scanned per key, and
its result is joined back on (key, block), which is the partitioning the block
window already produced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.session import cut_lineage

BLOCK_BITS = 16         # 65,536 rows per block
MOST_BLOCKS = 8192      # beyond 2 ** 29 rows blocks grow instead; windows over them spill


def rank_blocks(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), bits: int = BLOCK_BITS,
                written: bool = False) -> tuple[DataFrame, bool]:
    """``df`` as a written table with ``_row`` (a number of its own per row) and ``_blk``; and whether it has several blocks.

    Blocks hold about ``2**bits`` rows that follow each other by (keys, order,
    ties, _row).  Their borders are quantiles of a sample, so neither sparse
    order values nor many equal ones make a block small or large.  A key may
    span blocks and a block keys; within a key ``_blk`` rises with the order.
    ``written`` says that ``df`` is a written table already.
    """
    once = df if written else cut_lineage(df)
    n = once.count()
    once = once.withColumn("_row", F.monotonically_increasing_id())
    if n <= 1 << bits:
        return once.withColumn("_blk", F.lit(0)), False
    parts = min(MOST_BLOCKS, -(-n // (1 << bits)))
    return cut_lineage(once.repartitionByRange(parts, *keys, order, *ties, "_row").withColumn("_blk", F.spark_partition_id())), True


def ordered_scan(df: DataFrame, keys: Sequence[str], order: str, *,
                 total: Mapping[str, Column] | None = None,
                 carry: Mapping[str, Column] | None = None,
                 behind: Mapping[str, Column] | None = None,
                 ahead: Mapping[str, Column] | None = None,
                 top: Mapping[str, Column] | None = None,
                 ties: Sequence[str] = (), bits: int = BLOCK_BITS, written: bool = False) -> DataFrame:
    """Add columns computed along ``order`` within ``keys``.

    total   sum of the expression over all earlier rows (0 on the first)
    carry   latest non-null value of the expression on an earlier row
    behind  value of the expression on the previous row
    ahead   value of the expression on the next row
    top     greatest value of the expression on all earlier rows (null on the first)

    Null keys form a key of their own, null order values come first.
    ``ties`` order rows that share one order value; rows equal in both come in
    an order of their own that is the same for all results.  A block holds
    about ``2**bits`` rows; input that fits one needs no second pass.  The rows
    are written once (unless ``written``), so pass narrow ones.
    """
    total, carry = dict(total or {}), dict(carry or {})
    behind, ahead, top = dict(behind or {}), dict(ahead or {}), dict(top or {})
    keys = list(keys)
    src, several = rank_blocks(df, keys, order, ties, bits, written)
    # a struct compares equal where its null fields do, and keeps the partitioning that the windows have made
    src = src.withColumn("_key", F.struct(*keys))
    seq = [F.col(c) for c in (order, *ties, "_row")]
    pos = F.struct(*seq)

    inside = Window.partitionBy("_key", "_blk").orderBy(*seq)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("_key").orderBy("_blk")
    blocks_before = blocks.rowsBetween(Window.unboundedPreceding, -1)

    aggs, outer, local, final = [], [], [], []
    for i, (out, e) in enumerate(total.items()):
        aggs.append(F.sum(e).alias(f"_t{i}"))
        outer.append(F.coalesce(F.sum(f"_t{i}").over(blocks_before), F.lit(0)).alias(f"_T{i}"))
        local.append(F.coalesce(F.sum(e).over(before), F.lit(0)).alias(f"_l_{out}"))
        final.append((F.col(f"_l_{out}") + F.col(f"_T{i}") if several else F.col(f"_l_{out}")).alias(out))
    for i, (out, e) in enumerate(carry.items()):
        aggs.append(F.max_by(F.struct(e.alias("v")), F.when(e.isNotNull(), pos)).alias(f"_c{i}"))
        outer.append(F.last(f"_c{i}", True).over(blocks_before).alias(f"_C{i}"))
        local.append(F.last(e, True).over(before).alias(f"_l_{out}"))
        final.append((F.coalesce(F.col(f"_l_{out}"), F.col(f"_C{i}.v")) if several else F.col(f"_l_{out}")).alias(out))
    for i, (out, e) in enumerate(behind.items()):
        aggs.append(F.max_by(F.struct(e.alias("v")), pos).alias(f"_b{i}"))
        outer.append(F.lag(f"_b{i}").over(blocks).alias(f"_B{i}"))
        local.append(F.lag(F.struct(e.alias("v"))).over(inside).alias(f"_l_{out}"))
        final.append((F.coalesce(F.col(f"_l_{out}"), F.col(f"_B{i}")) if several else F.col(f"_l_{out}"))["v"].alias(out))
    for i, (out, e) in enumerate(ahead.items()):
        aggs.append(F.min_by(F.struct(e.alias("v")), pos).alias(f"_a{i}"))
        outer.append(F.lead(f"_a{i}").over(blocks).alias(f"_A{i}"))
        local.append(F.lead(F.struct(e.alias("v"))).over(inside).alias(f"_l_{out}"))
        final.append((F.coalesce(F.col(f"_l_{out}"), F.col(f"_A{i}")) if several else F.col(f"_l_{out}"))["v"].alias(out))
    for i, (out, e) in enumerate(top.items()):
        aggs.append(F.max(e).alias(f"_m{i}"))
        outer.append(F.max(f"_m{i}").over(blocks_before).alias(f"_M{i}"))
        local.append(F.max(e).over(before).alias(f"_l_{out}"))
        final.append((F.greatest(f"_l_{out}", f"_M{i}") if several else F.col(f"_l_{out}")).alias(out))

    rows = src.select("*", *local)
    if not several:
        return rows.select(*[F.col(c) for c in df.columns], *final)
    edges = src.groupBy("_key", "_blk").agg(*aggs).select("_key", "_blk", *outer)
    return rows.join(edges, ["_key", "_blk"]).select(*[F.col(c) for c in df.columns], *final)


def runs(df: DataFrame, keys: Sequence[str], order: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Compress distinct integers per key into maximal runs (first, last); nulls belong to none.

    The input and the run edges are written once, so nothing below is evaluated twice.
    """
    once = cut_lineage(df.select(*keys, order).where(F.col(order).isNotNull()))
    near = ordered_scan(once, keys, order, bits=bits, written=True, behind={"_p": F.col(order)}, ahead={"_n": F.col(order)})
    edges = near.withColumns({
        "_start": F.coalesce(F.col("_p") != F.col(order) - 1, F.lit(True)),
        "_stop": F.coalesce(F.col("_n") != F.col(order) + 1, F.lit(True)),
    }).where("_start or _stop")
    edges = cut_lineage(edges.select(*keys, order, "_start", "_stop"))
    # the edge after a start is its end, unless the run is a single value
    paired = ordered_scan(edges, keys, order, bits=bits, written=True, ahead={"_end": F.col(order)})
    return paired.where("_start").select(
        *keys, F.col(order).alias("first"),
        F.when(F.col("_stop"), F.col(order)).otherwise(F.col("_end")).alias("last"))


def disjoint_intervals(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", bits: int = BLOCK_BITS) -> DataFrame:
    """Closed integer intervals per key cut to disjoint ones with the same union (keys, a, b).

    An ordered sweep: of each interval only what lies behind the greatest end
    so far stays.  Empty (a > b) and null intervals count for nothing.
    """
    once = cut_lineage(df.where(F.col(a) <= F.col(b)).select(*keys, F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
                       .groupBy(*keys, "a").agg(F.max("b").alias("b")))
    seen = ordered_scan(once, keys, "a", top={"_top": F.col("b")}, bits=bits, written=True)
    return seen.withColumn("a", F.greatest("a", F.col("_top") + 1)).where("a <= b").drop("_top")


def merge_intervals(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", bits: int = BLOCK_BITS) -> DataFrame:
    """Union of closed integer intervals per key as maximal intervals (keys, a, b); touching ones become one."""
    parts = cut_lineage(disjoint_intervals(df, keys, a, b, bits))
    near = cut_lineage(ordered_scan(parts, keys, "a", behind={"_p": F.col("b")}, bits=bits, written=True)
                       .withColumn("_new", (F.col("_p").isNull() | (F.col("a") > F.col("_p") + 1)).cast("long")))
    part = ordered_scan(near, keys, "a", total={"_no": F.col("_new")}, bits=bits, written=True)
    return (part.groupBy(*keys, (F.col("_no") + F.col("_new")).alias("_no")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
            .drop("_no"))


def prefix_ranks(points: DataFrame, members: DataFrame, key: str, value: str, bits: int = BLOCK_BITS) -> DataFrame:
    """For every distinct (key, value) of ``points``: how many members (key, value) lie below, and up to, the value."""
    asked = points.select(key, F.col(value).cast("long").alias(value)).where(F.col(value).isNotNull()).distinct()
    both = (members.select(key, F.col(value).cast("long").alias(value)).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_asked", F.lit(False)).unionByName(asked.select(key, value, F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_asked"))))
    both = cut_lineage(both.groupBy(key, value).agg(F.sum("_n").alias("_n"), F.bool_or("_asked").alias("_asked")))
    ranked = ordered_scan(both, [key], value, total={"below": F.col("_n")}, bits=bits, written=True).where("_asked")
    return ranked.select(key, value, F.col("below").cast("long").alias("below"), (F.col("below") + F.col("_n")).cast("long").alias("upto"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key, for reports; ``rank`` names a column for their number.

    Tasks keep at most ``k`` rows of a key before the shuffle (the planner's
    window group limit), so a key with a third of all rows sends ``k`` rows a task.
    ``order`` should leave no ties.
    """
    no = rank or "_first_of"
    out = df.withColumn(no, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(no) <= k)
    return out if rank else out.drop(no)


def members_of(intervals: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """One row per member of each interval, for results that list them all."""
    return intervals.withColumn(name, F.explode_outer(F.sequence(F.col(a), F.col(b)))).where(F.col(name).isNotNull()).drop(a, b)


def locate_in_spans(points: DataFrame, spans: DataFrame, key: str, pos: str,
                    start: str, end: str, bits: int = 12) -> DataFrame:
    """Join each point to the span ``start <= pos < end`` of the same key.

    Spans are listed once per block of ``2**bits`` positions they touch, so
    the range condition becomes an equi join with a residual check instead of
    a nested loop.
    """
    s = (spans.where(F.col(end) > F.col(start))
         .withColumn("_blk", F.explode(F.sequence(
             F.shiftright(F.col(start).cast("long"), bits),
             F.shiftright((F.col(end) - 1).cast("long"), bits)))))
    p = points.withColumn("_blk", F.shiftright(F.col(pos).cast("long"), bits))
    return (p.join(s, [key, "_blk"])
            .where((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))).drop("_blk"))
