"""Splitting books into chapters (one narrow pass over the text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright import fixed as K
from tomewright.functions import text as T

_MARK = "\r"    # cleaned text holds no carriage return, so it can mark heading lines


def clean_text(c: Column, ad_pattern: str | None = K.AD_LINE) -> Column:
    """Unify newlines, drop boilerplate lines, right-strip, squeeze blank runs."""
    rows = T.lines_of(F.regexp_replace(c, "\r\n?", "\n"))
    if ad_pattern is not None:
        rows = F.filter(rows, lambda r: ~T.ustrip(r).rlike(ad_pattern))
    joined = F.array_join(rows, "\n")
    trimmed = F.regexp_replace(joined, r"(?U)(?<![\s\x1C-\x1F&&[^\n]])[\s\x1C-\x1F&&[^\n]]+(?=\n|\z)", "")
    return F.regexp_replace(trimmed, r"\n{3,}", "\n\n")


def clean_books(books: DataFrame, ad_pattern: str | None = K.AD_LINE) -> DataFrame:
    return books.withColumn("text", clean_text(F.col("text"), ad_pattern))


def lines(docs: DataFrame, key: str = "book_id") -> DataFrame:
    """Line table (key, line_no, line, start): 0-based numbers, code-point offsets.

    The offsets are summed inside the row, so no line is shuffled.
    """
    cut = docs.select(key, T.lines_of(F.col("text")).alias("ls"))
    cut = cut.select(key, "ls", T.sums_before(
        F.transform("ls", lambda x: F.length(x) + 1)).alias("ss"))
    # the outer form keeps the optimizer from re-evaluating the array in an inferred filter
    return (cut.select(key, F.posexplode_outer(F.arrays_zip("ls", "ss")).alias("line_no", "r"))
            .where("line_no is not null")
            .select(key, "line_no", F.col("r.ls").alias("line"), F.col("r.ss").alias("start")))


def _pieces(books: DataFrame, pattern: str | None, chunk_size: int, force_chunks: bool,
            loose_numbered: bool) -> DataFrame:
    """One row per piece: idx 0 is the text before the first heading."""
    def starts_chapter(s):
        if pattern is not None:
            return s.rlike(K.U + f"^(?:{pattern})")
        return F.coalesce(T.heading_kind(s, loose_numbered).isin("chapter", "special"), F.lit(False))

    rows = F.transform(T.lines_of(F.col("text")),
                       lambda r: F.struct(r.alias("raw"), T.ustrip(r).alias("s")))
    marked = F.array_join(F.transform(rows, lambda r: F.when(
        starts_chapter(r["s"]), F.concat(F.lit(_MARK), r["raw"])).otherwise(r["raw"])), "\n")
    split = books.select("book_id", "text",
                         (F.split(F.lit(""), _MARK, -1) if force_chunks
                          else F.split(marked, _MARK, -1)).alias("parts"))
    chunks = F.concat(F.array(F.lit("")),
                      F.regexp_extract_all("text", F.lit(f"(?s).{{1,{int(chunk_size)}}}"), F.lit(0)))
    chosen = split.select("book_id", (F.size("parts") < 3).alias("fallback"),
                          F.when(F.size("parts") < 3, chunks).otherwise(F.col("parts")).alias("parts"))
    # outer: a plain posexplode infers size(parts) > 0 below and would split the text again
    return (chosen.select("book_id", "fallback", F.posexplode_outer("parts").alias("idx", "body"))
            .where("idx is not null"))


def _last_volume(body: Column, loose: bool) -> Column:
    """Title of the last volume line inside one chapter body."""
    found = F.filter(F.transform(T.lines_of(body), T.ustrip),
                     lambda s: F.coalesce(T.heading_kind(s, loose) == "volume", F.lit(False)))
    return F.when(body.rlike(rf"第[^\n]{{0,{K.MAX_HEADING_CHARS}}}[卷部篇]"),
                  T.let(F.try_element_at(found, F.lit(-1)), lambda s: T.heading(s, loose)["title"]))


def split_chapters(books: DataFrame, pattern: str | None = None, chunk_size: int = K.CHUNK_CHARS,
                   force_chunks: bool = False, loose_numbered: bool = False,
                   with_preamble: bool = False) -> DataFrame:
    """Chapter index (book_id, idx, title, chars, start, end, volume, fallback).

    ``books`` holds (book_id, text), one row per book, text already cleaned.
    ``pattern`` replaces the heading rules; it is matched at the head of each
    stripped line and titles the chapter by its first non-empty group.  Books
    with fewer than two headings fall back to fixed chunks.  Only index
    columns are shuffled, never the text.
    """
    p = (_pieces(books, pattern, chunk_size, force_chunks, loose_numbered)
         .withColumn("head", T.ustrip(T.first_line(F.col("body")))))
    head = F.col("head")
    if pattern is None:
        title = T.heading(head, loose_numbered)["title"]
        volume = _last_volume(F.col("body"), loose_numbered)
    else:
        title = custom_title(head, pattern)
        volume = F.lit(None).cast("string")
    before, after = K.CHUNK_TITLE.split("{}")
    chunk_title = F.concat(F.lit(before), F.col("idx").cast("string"), F.lit(after))
    idx = p.select(
        "book_id", "fallback", "idx", F.length("body").cast("long").alias("n"),
        F.when(F.col("fallback"), chunk_title).otherwise(title).alias("title"),
        F.when(F.col("fallback"), F.length("body")).otherwise(F.length(T.ustrip(F.col("body"))))
         .cast("long").alias("chars"),
        F.when(~F.col("fallback"), volume).alias("vol"))
    # a book is one input row, so its index is bounded by the size of one text
    w = Window.partitionBy("book_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    out = idx.select(
        "book_id", "idx", "title", "chars",
        F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"),
        (F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n")).alias("end"),
        F.coalesce(F.last("vol", True).over(w), F.lit("")).alias("volume"), "fallback")
    return out if with_preamble else out.where("idx > 0")


def custom_title(head: Column, pattern: str) -> Column:
    """First non-empty group of ``pattern`` in a stripped heading line, else the line."""
    import re
    rx = K.U + f"^(?:{pattern})"
    groups = re.compile(pattern).groups
    return F.coalesce(*[F.nullif(T.ustrip(T.group(head, rx, i + 1)), F.lit("")) for i in range(groups)], head)


def chapter_text(books: DataFrame, pattern: str | None = None, chunk_size: int = K.CHUNK_CHARS,
                 force_chunks: bool = False, loose_numbered: bool = False) -> DataFrame:
    """Chapter bodies (book_id, idx, text, norm); narrow, no shuffle."""
    p = _pieces(books, pattern, chunk_size, force_chunks, loose_numbered).where("idx > 0")
    body = F.when(F.col("fallback"), F.col("body")).otherwise(T.ustrip(F.col("body")))
    return (p.select("book_id", "idx", body.alias("text"))
            .withColumn("norm", T.normalize(F.col("text"))))


def file_labels(chapters: DataFrame) -> DataFrame:
    """File label per chapter, number padded to the width of the book's chapter count."""
    n = chapters.groupBy("book_id").agg(F.count("*").alias("_n"))
    width = F.greatest(F.lit(4), F.length(F.col("_n").cast("string")))
    number = F.col("idx").cast("string")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(number), F.lit(0))), number)
    return (chapters.join(n, "book_id")
            .withColumn("file", F.concat(F.lit("原文/第"), padded, F.lit("章_"),
                                         T.file_title(F.col("title")), F.lit(".txt"))).drop("_n"))


def book_summary(chapters: DataFrame, short: int = K.SHORT_CHAPTER_CHARS) -> DataFrame:
    """Per-book totals; accepts an index with or without its preamble rows."""
    real = F.col("idx") > 0
    return chapters.groupBy("book_id").agg(
        F.count_if(real).alias("chapters"),
        F.coalesce(F.sum(F.when(real, F.col("chars"))), F.lit(0)).alias("total_chars"),
        F.count_if(real & (F.col("chars") < short)).alias("short_chapters"),
        F.coalesce(F.sum(F.when(~real, F.col("end") - F.col("start"))), F.lit(0)).alias("preamble_chars"),
        F.countDistinct(F.when(real, F.nullif("volume", F.lit("")))).alias("volumes"),
        F.min_by(F.when(real, F.col("title")), F.when(real, F.col("idx"))).alias("first_title"),
        F.max_by(F.when(real, F.col("title")), F.when(real, F.col("idx"))).alias("last_title"),
        F.bool_or("fallback").alias("fallback"))


def volumes(chapters: DataFrame) -> DataFrame:
    """Volumes of each book with their first chapter and size."""
    return (chapters.where("volume <> ''").groupBy("book_id", "volume")
            .agg(F.min("idx").alias("first_idx"), F.count("*").alias("chapters"),
                 F.sum("chars").alias("chars")))


def short_chapters(chapters: DataFrame, limit: int = K.SHORT_CHAPTER_CHARS) -> DataFrame:
    return chapters.where(F.col("chars") < limit)


def in_scope(df: DataFrame, lo: int | None = None, hi: int | None = None, col: str = "idx") -> DataFrame:
    """Rows whose chapter lies in [lo, hi]."""
    if lo is not None:
        df = df.where(F.col(col) >= lo)
    return df if hi is None else df.where(F.col(col) <= hi)


def parse_scope(scope: str | None) -> tuple[int | None, int | None]:
    """``'121-200'`` or ``'121'`` to bounds; any of the usual dashes."""
    if not scope:
        return None, None
    import re
    a, *b = re.split("[-–—~～至到]", scope.strip())
    return int(a), int(b[0]) if b and b[0] else int(a)
