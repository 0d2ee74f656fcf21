"""Which chapters does a document mention, and which does it leave out?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright import fixed as K
from tomewright.functions import text as T
from tomewright.operators.ordered import disjoint_intervals, members_of, merge_intervals, ordered_scan, prefix_ranks
from tomewright.operators.segment import in_scope
from tomewright.session import cut_lineage


def extract_ranges(docs: DataFrame, keys: list[str], pattern: str = K.COVER_RANGE) -> DataFrame:
    """Chapter ranges of each document in text order: keys, ord, a, b."""
    return (docs.select(*keys, F.posexplode_outer(T.ref_ranges(F.col("text"), pattern)).alias("ord", "r"))
            .where("r is not null").select(*keys, "ord", "r.a", "r.b"))


def extract_singles(docs: DataFrame, keys: list[str], pattern: str = K.COVER_SINGLE) -> DataFrame:
    return (docs.select(*keys, F.explode_outer(T.ref_singles(F.col("text"), pattern)).alias("ch"))
            .where("ch is not null").distinct())


def bounds_of(chapters: DataFrame) -> DataFrame:
    """First and last index row per book."""
    return chapters.groupBy("book_id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))


def _claims(docs: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """Ranges and single chapters of each document as intervals, clipped to the index of the book."""
    keys = ["book_id", "doc_id"]
    # both kinds of a row are read in one pass and leave as one array
    pair = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    both = F.concat(F.transform(T.ref_ranges(F.col("text"), K.COVER_RANGE), lambda r: pair(r["a"], r["b"])),
                    F.transform(T.ref_singles(F.col("text"), K.COVER_SINGLE), lambda c: pair(c, c)))
    rows = docs.select(*keys, F.explode_outer(both).alias("r")).where("r is not null").select(*keys, "r.a", "r.b")
    if bounds is None:
        return rows
    return rows.join(bounds, "book_id").select(*keys, F.greatest("a", "lo").alias("a"), F.least("b", "hi").alias("b"))


def ref_intervals(docs: DataFrame, chapters: DataFrame | None = None, bits: int = 16) -> DataFrame:
    """What each document mentions, as maximal intervals: book_id, doc_id, a, b.

    Ranges and single chapters are merged by an ordered sweep and never
    expanded, so a document that claims a million chapters is one row.  With
    ``chapters`` they are clipped to the index of the book first (a book
    without an index has none).
    """
    return merge_intervals(_claims(docs, None if chapters is None else bounds_of(chapters)), ["book_id", "doc_id"], bits=bits)


def extract_refs(docs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Distinct (book_id, doc_id, ch) mentioned by ``docs(book_id, doc_id, text)``.

    The list itself is the result, so ranges are expanded, clipped to the index;
    coverage works on ``ref_intervals`` instead.
    """
    keys = ["book_id", "doc_id"]
    clipped = (extract_ranges(docs, keys).join(bounds_of(chapters), "book_id")
               .select(*keys, F.greatest("a", "lo").alias("a"), F.least("b", "hi").alias("b"))
               .where("a <= b").distinct())
    return members_of(clipped, "a", "b", "ch").union(extract_singles(docs, keys)).distinct()


def _index(chapters: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """Chapter numbers in scope (book_id, ch), written once."""
    return cut_lineage(in_scope(chapters, lo, hi).select("book_id", F.col("idx").cast("long").alias("ch")).distinct())


def _books(index: DataFrame) -> DataFrame:
    """lo, hi and the number of index rows of each book, written once."""
    return cut_lineage(index.groupBy("book_id").agg(F.min("ch").alias("lo"), F.max("ch").alias("hi"), F.count(F.lit(1)).alias("n")))


def covered_ranks(docs: DataFrame, index: DataFrame, books: DataFrame, bits: int = 16) -> DataFrame:
    """Index rows that each document mentions as disjoint intervals of their ranks (from 0): book_id, doc_id, r0, r1.

    No interval is expanded.  Where the numbers of all books are contiguous the
    rank of a chapter is its distance from the first; else the index rows below
    an end are counted, once per distinct end.
    """
    spans = disjoint_intervals(_claims(docs, books.select("book_id", "lo", "hi")), ["book_id", "doc_id"], bits=bits)
    if books.where("n <> hi - lo + 1").isEmpty():
        return spans.join(books.select("book_id", "lo"), "book_id").select(
            "book_id", "doc_id", (F.col("a") - F.col("lo")).alias("r0"), (F.col("b") - F.col("lo")).alias("r1"))
    spans = cut_lineage(spans)
    ends = spans.select("book_id", F.explode(F.array("a", "b")).alias("ch"))
    ranks = cut_lineage(prefix_ranks(ends, index, "book_id", "ch", bits))
    out = (spans.join(ranks.select("book_id", F.col("ch").alias("a"), F.col("below").alias("r0")), ["book_id", "a"])
           .join(ranks.select("book_id", F.col("ch").alias("b"), (F.col("upto") - 1).alias("r1")), ["book_id", "b"]))
    return out.where("r0 <= r1").select("book_id", "doc_id", "r0", "r1")


def gaps(docs: DataFrame, chapters: DataFrame, lo: int | None = None, hi: int | None = None, bits: int = 16) -> DataFrame:
    """Maximal runs (book_id, doc_id, first, last) of index rows in scope that the document never mentions.

    Found between neighbouring covered intervals, so neither the (document x
    chapter) scope nor a claimed range is ever expanded.  Rows are compared by
    their rank in the index; where its numbers jump, a run ends.
    """
    keys = ["book_id", "doc_id"]
    index = _index(chapters, lo, hi)
    books = _books(index)
    ranked = cut_lineage(ordered_scan(index, ["book_id"], "ch", total={"rank": F.lit(1)}, bits=bits, written=True)
                         .withColumn("rank", F.col("rank").cast("long")))
    pieces = ranked.groupBy("book_id", (F.col("ch") - F.col("rank")).alias("_jump")).agg(
        F.min("rank").alias("r0"), F.max("rank").alias("r1"), F.min("ch").alias("i0"))
    ends = docs.select(*keys).distinct().join(books, "book_id").select(
        *keys, F.explode(F.array(F.lit(-1).cast("long"), F.col("n"))).alias("r0")).withColumn("r1", F.col("r0"))
    covered = covered_ranks(docs, index, books, bits)
    near = ordered_scan(cut_lineage(covered.unionByName(ends)), keys, "r0", ahead={"_next": F.col("r0")}, bits=bits, written=True)
    holes = near.where("_next > r1 + 1").select(*keys, (F.col("r1") + 1).alias("_a"), (F.col("_next") - 1).alias("_b"))
    cut = holes.join(pieces, "book_id").where("r0 <= _b AND r1 >= _a")
    return cut.select(*keys, (F.col("i0") + F.greatest("_a", "r0") - F.col("r0")).alias("first"),
                      (F.col("i0") + F.least("_b", "r1") - F.col("r0")).alias("last"))


def missing_chapters(docs: DataFrame, chapters: DataFrame, lo: int | None = None,
                     hi: int | None = None) -> DataFrame:
    """Index rows in scope that the document never mentions: book_id, doc_id, ch."""
    return members_of(gaps(docs, chapters, lo, hi), "first", "last", "ch")


def covered_chapters(docs: DataFrame, chapters: DataFrame, lo: int | None = None,
                     hi: int | None = None) -> DataFrame:
    """Mentioned chapters that exist in scope: book_id, doc_id, ch."""
    index = _index(chapters, lo, hi)
    ranked = ordered_scan(index, ["book_id"], "ch", total={"rank": F.lit(1)}, written=True).withColumn("rank", F.col("rank").cast("long"))
    return (members_of(covered_ranks(docs, index, _books(index)), "r0", "r1", "rank").join(ranked, ["book_id", "rank"])
            .select("book_id", "doc_id", "ch"))


def coverage(docs: DataFrame, chapters: DataFrame, lo: int | None = None, hi: int | None = None,
             fail_under: float = 1.0) -> DataFrame:
    """book_id, doc_id, total, covered, missing, rate, passed.

    Totals are the distinct chapters per book and hits lengths of covered rank intervals,
    so the (document x chapter) scope is never materialised.
    """
    index = _index(chapters, lo, hi)
    books = _books(index)
    total = books.select("book_id", F.col("n").alias("total"))
    hits = covered_ranks(docs, index, books).groupBy("book_id", "doc_id").agg(F.sum(F.col("r1") - F.col("r0") + 1).alias("covered"))
    out = (docs.select("book_id", "doc_id").distinct()
           .join(total, "book_id", "left").join(hits, ["book_id", "doc_id"], "left")
           .select("book_id", "doc_id", F.coalesce("total", F.lit(0)).alias("total"),
                   F.coalesce("covered", F.lit(0)).alias("covered")))
    rate = F.col("covered") / F.greatest(F.col("total"), F.lit(1))
    return (out.withColumn("missing", F.col("total") - F.col("covered"))
            .withColumn("rate", F.round(rate, 4)).withColumn("passed", rate >= fail_under))


def run_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(
        F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


def missing_runs(docs: DataFrame, chapters: DataFrame, lo: int | None = None,
                 hi: int | None = None, bits: int = 16) -> DataFrame:
    """Missing chapters as maximal runs, each with the label and size of its first chapter."""
    found = gaps(docs, chapters, lo, hi, bits)
    head = chapters.select("book_id", F.col("idx").cast("long").alias("first"), "title", "chars")
    return (found.join(head, ["book_id", "first"])
            .select("book_id", "doc_id", "first", "last", run_label(F.col("first"), F.col("last")).alias("run"),
                    (F.col("last") - F.col("first") + 1).alias("chapters"),
                    T.chapter_label(F.col("first"), F.col("title")).alias("sample"),
                    F.col("chars").alias("sample_chars")))
