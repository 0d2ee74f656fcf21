"""Navigation targets: which chapter, and which reference, leads where."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewright import fixed as K
from tomewright.functions import text as T
from tomewright.session import cut_lineage


def slice_anchors(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Slices with a chapter number and a unique anchor ``s{chapter}-{k}``."""
    sl = blocks.where("kind = 'slice'").select(
        *keys, "bucket_no", "block_no", "label", T.group(F.col("chapter"), "([0-9]{1,6})").cast("long").alias("ch")) \
        .where("ch is not null")
    w = Window.partitionBy(*keys, "ch").orderBy("block_no")
    return sl.withColumn("k", F.row_number().over(w)).withColumn(
        "anchor", F.concat(F.lit("s"), F.col("ch").cast("string"), F.lit("-"), F.col("k").cast("string")))


def anchors(blocks: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """One anchor per chapter: its first slice, else the first unit whose range holds it."""
    by_slice = slice_anchors(blocks, keys).where("k = 1").select(
        *keys, "ch", "anchor", F.lit(0).cast("long").alias("prio"))
    by_unit = units.where("kind = 'unit' and ch_from > 0 and ch_to >= ch_from").select(
        *keys, F.explode_outer(F.sequence("ch_from", "ch_to")).alias("ch"), "anchor",
        (F.col("bucket_no") + 1).alias("prio"))
    return by_slice.unionByName(by_unit).groupBy(*keys, "ch").agg(F.min_by("anchor", "prio").alias("anchor"))


def text_refs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """References in running text: keys, kind, ord, a, b.  Ranges are read before singles."""
    # both kinds of a row are read in one pass and leave as one array
    ranges = F.transform(T.ref_pairs(F.col("text"), K.LINK_RANGE), lambda p, i: F.struct(
        F.lit("range").alias("kind"), i.alias("ord"), p["a"].cast("long").alias("a"), p["b"].cast("long").alias("b")))
    rest = F.regexp_replace("text", K.LINK_RANGE, " ")
    singles = F.transform(T.ref_singles(rest, K.LINK_SINGLE), lambda n, i: F.struct(
        F.lit("single").alias("kind"), i.alias("ord"), n.cast("long").alias("a"), n.cast("long").alias("b")))
    return (docs.select(*keys, F.explode_outer(F.concat(ranges, singles)).alias("r")).where("r is not null")
            .select(*keys, "r.kind", "r.ord", "r.a", "r.b"))


def anchors_at(points: DataFrame, blocks: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors of the given chapters (keys, ch): the first slice, else the first unit whose range holds it.

    Unit ranges stay intervals, so a heading that claims a million chapters is one row.
    """
    points = points.select(*keys, "ch").distinct()
    by_slice = slice_anchors(blocks, keys).where("k = 1").select(*keys, "ch", F.col("anchor").alias("_s"))
    spans = units.where("kind = 'unit' and ch_from > 0 and ch_to >= ch_from").select(
        *keys, "ch_from", "ch_to", F.struct("bucket_no", "anchor").alias("_u"))
    by_unit = (points.join(spans, keys).where((F.col("ch") >= F.col("ch_from")) & (F.col("ch") <= F.col("ch_to")))
               .groupBy(*keys, "ch").agg(F.min("_u").alias("_u")))
    return (points.join(by_slice, [*keys, "ch"], "left").join(by_unit, [*keys, "ch"], "left")
            .select(*keys, "ch", F.coalesce("_s", "_u.anchor").alias("anchor")).where("anchor is not null"))


def resolve_refs(docs: DataFrame, blocks: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """References with the anchor of their first, else their second chapter; null stays plain text.

    The references are written once; only chapters that are referred to are resolved.
    """
    refs = cut_lineage(text_refs(docs, keys))
    asked = refs.select(*keys, F.explode(F.array("a", "b")).alias("ch"))
    found = cut_lineage(anchors_at(asked, blocks, units, keys))
    first = found.select(*keys, F.col("ch").alias("a"), F.col("anchor").alias("_a"))
    second = found.select(*keys, F.col("ch").alias("b"), F.col("anchor").alias("_b"))
    return (refs.join(first, [*keys, "a"], "left").join(second, [*keys, "b"], "left")
            .select(*keys, "kind", "ord", "a", "b", F.coalesce("_a", "_b").alias("anchor")))


def nav_chapters(docs: DataFrame, chapters: DataFrame, anchor_map: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chapter list of each document: index rows that have an anchor.

    A document whose book has no index lists its sliced chapters instead.
    Keys are (book_id, doc_id).
    """
    keys = ["book_id", "doc_id"]
    index = chapters.select("book_id", F.col("idx").cast("long").alias("ch"), F.col("title").alias("label"))
    listed = anchor_map.join(index, ["book_id", "ch"]).select(*keys, "ch", "label", "anchor")
    bare = docs.select(*keys).distinct().join(index.select("book_id").distinct(), "book_id", "left_anti")
    sliced = slice_anchors(blocks, keys).where("k = 1").join(bare, keys, "left_semi").select(
        *keys, "ch", "label", "anchor")
    return listed.unionByName(sliced)


def digest_stats(docs: DataFrame, units: DataFrame, nav: DataFrame, people: DataFrame) -> DataFrame:
    """Units, reachable chapters and people per digest; people belong to the book."""
    keys = ["book_id", "doc_id"]
    u = units.where("kind = 'unit'").groupBy(*keys).agg(F.count("*").alias("units"))
    n = nav.groupBy(*keys).agg(F.count("*").alias("chapters"))
    p = people.groupBy("book_id").agg(F.count("*").alias("people"))
    out = docs.select(*keys).distinct().join(u, keys, "left").join(n, keys, "left").join(p, "book_id", "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("units", "chapters", "people")])
