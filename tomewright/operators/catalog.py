"""The shelf: page metadata, manifests, grouping, statistics, search, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright import fixed as K
from tomewright.functions import text as T

_PAGE_JSON = "key string, unitCount string, chapterCount string, chars map<string,string>"


def page_metadata(pages: DataFrame, *keep: str) -> DataFrame:
    """Title, progress key and counts of reader pages; broken metadata counts as none."""
    data = F.from_json(F.regexp_extract("html", K.PAGE_DATA, 1), _PAGE_JSON)
    m = pages.select(*keep, T.ustrip(T.html_unescape(F.regexp_extract("html", K.PAGE_TITLE, 1))).alias("title"),
                     data.alias("_d"))
    return m.select(*keep, "title", F.nullif("_d.key", F.lit("")).alias("key"),
                    F.coalesce(F.col("_d.unitCount").try_cast("int"), F.lit(0)).alias("units"),
                    F.coalesce(F.col("_d.chapterCount").try_cast("int"), F.lit(0)).alias("chapters"),
                    F.greatest(F.coalesce(F.size("_d.chars"), F.lit(0)), F.lit(0)).alias("people"))


def is_reader_page(html: Column) -> Column:
    return F.instr(F.substring(html, 1, K.PAGE_MARKER_CHARS), F.lit(K.PAGE_MARKER)) > 0


# -- manifest -------------------------------------------------------------
def _path_like(c: Column) -> Column:
    p = T.ustrip(F.regexp_replace(T.ustrip(c), r"""^[<>"']+|[<>"']+$""", ""))
    return F.when(p.rlike(r"(?i)^https?://") | p.rlike(r"(?i)\.html?$"), p)


def _item(s: Column) -> Column:
    """STRUCT<label, path> of a manifest item: link, ``label：path`` or bare path."""
    def read(x):
        link = F.when(x.rlike(K.MD_LINK), F.struct(
            T.ustrip(F.regexp_extract(x, K.MD_LINK, 1)).alias("label"),
            _path_like(F.regexp_extract(x, K.MD_LINK, 2)).alias("path")))
        tries = [link]
        for sep in K.ITEM_SEPARATORS:
            at = F.instr(x, F.lit(sep))
            tries.append(F.when(at > 0, F.struct(
                T.ustrip(F.substring(x, F.lit(1), at - 1)).alias("label"),
                _path_like(F.substring(x, at + 1, F.length(x))).alias("path"))))
        tries.append(F.struct(F.lit("").alias("label"), _path_like(x).alias("path")))
        return F.coalesce(*[F.when(t["path"].isNotNull(), t) for t in tries])
    return T.let(T.ustrip(F.regexp_replace(s, K.EMPHASIS, "")), read)


def parse_manifest(docs: DataFrame, key: str = "shelf_id") -> DataFrame:
    """Manifest lines as rows: key, line_no, kind ('shelf', 'book', 'item', 'note'), book_no, text, label, path."""
    from pyspark.sql import Window
    ln = (docs.select(key, F.posexplode_outer(T.lines_of(F.col("text"))).alias("line_no", "line"))
          .where("line_no is not null").withColumn("s", T.ustrip("line")).where("s <> ''"))
    book = F.col("s").rlike("^## (?!#)")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ln = ln.withColumn("book_no", F.sum(F.when(book, 1).otherwise(0)).over(w))
    bullet = F.col("s").rlike(K.BULLET)
    ln = ln.withColumn("item", F.when(bullet, _item(F.regexp_replace("s", K.BULLET, ""))))
    kind = (F.when(book, "book").when(F.col("s").rlike("^# (?!#)"), "shelf").when(F.col("book_no") == 0, None)
            .when(F.col("item").isNotNull(), "item").otherwise("note"))
    name = T.ustrip(F.substr(F.col("s"), F.lit(4)))
    text = (F.when(kind == "book", F.regexp_replace(name, "^[《》]+|[《》]+$", ""))
            .when(kind == "shelf", T.ustrip(F.substr(F.col("s"), F.lit(3)))).when(kind == "note", F.col("s")))
    return ln.select(key, "line_no", kind.alias("kind"), "book_no", text.alias("text"),
                     F.col("item.label").alias("label"), F.col("item.path").alias("path")).where("kind is not null")


def manifest_books(rows: DataFrame, key: str = "shelf_id") -> DataFrame:
    """Books of a manifest with their notes joined in order."""
    notes = rows.where("kind = 'note'").groupBy(key, "book_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("desc"))
    n = rows.where("kind = 'item'").groupBy(key, "book_no").agg(F.count("*").alias("digests"))
    return (rows.where("kind = 'book'").select(key, "book_no", F.col("text").alias("name"))
            .join(notes, [key, "book_no"], "left").join(n, [key, "book_no"], "left")
            .select(key, "book_no", "name", F.coalesce("desc", F.lit("")).alias("desc"),
                    F.coalesce("digests", F.lit(0)).alias("digests")))


# -- cards ----------------------------------------------------------------
def cards(items: DataFrame) -> DataFrame:
    """Display columns of digests.

    ``items`` holds label, title (of the page), folder, path, key, units,
    chapters, people plus any keys; adds card_title, a, b, range_text, card_kind,
    stats, search and the sort key ``card_order``.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rng = T.guess_range(F.col("label"), F.col("title"), F.col("folder"), name)
    d = items.withColumn("_r", rng).withColumn("_name", name).withColumn("_clean", T.clean_title(F.col("title")))
    label, clean = F.coalesce("label", F.lit("")), F.col("_clean")
    d = d.withColumn("card_title", F.when((label != "") & ~label.rlike(K.RANGE_ONLY_LABEL), label).otherwise(
        F.coalesce(F.nullif(clean, F.lit("")), F.nullif("folder", F.lit("")), F.nullif("_name", F.lit("")),
                   F.lit(K.DEFAULT_CARD_TITLE))))
    a, b = F.col("_r.a").cast("string"), F.col("_r.b").cast("string")
    d = d.withColumn("range_text", F.when(F.col("_r").isNotNull(), F.concat(
        F.lit("第 "), a, F.lit("–"), b, F.lit(" 章"))).otherwise(""))
    bridge = F.contains(F.concat_ws(" ", "_name", "_clean", "label"), F.lit(K.BRIDGE_WORD))

    def count(col, before, after):
        return F.when(F.col(col) > 0, F.concat(F.lit(before), F.col(col).cast("string"), F.lit(after)))

    some = [F.nullif(x, F.lit("")) for x in (
        label, F.col("card_title"), F.col("range_text"),
        F.when(F.col("_r").isNotNull(), F.concat(F.lit("第"), a, F.lit("章 第"), b, F.lit("章"))),
        F.col("folder"), F.col("_name"))]
    nums = F.slice(F.transform(F.regexp_extract_all("card_title", F.lit("([0-9]+)"), F.lit(1)),
                               lambda x: x.try_cast("long")), 1, 3)
    return d.select(
        *items.columns, "card_title", F.col("_r.a").alias("a"), F.col("_r.b").alias("b"), "range_text",
        F.when(bridge, "bridge").otherwise("digest").alias("card_kind"),
        F.concat_ws(" · ", count("units", "单元 ", ""), count("chapters", "可跳转 ", " 章"),
                    count("people", "", " 人")).alias("stats"),
        F.concat_ws(" ", *some).alias("search"),
        F.struct(F.coalesce("_r.a", F.lit(K.NO_RANGE_START)).alias("a"), nums.alias("n"),
                 F.coalesce("folder", F.lit("")).alias("f"), F.col("card_title").alias("t")).alias("card_order"))


def match_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Manifest items with the metadata of their page; ``exists`` is null for external links."""
    external = F.col("path").rlike(r"(?i)^https?://")
    meta = pages.select("path", "title", "key", "units", "chapters", "people", F.lit(True).alias("_found"))
    return (items.join(meta, "path", "left")
            .withColumn("exists", F.when(~external, F.coalesce("_found", F.lit(False)))).drop("_found")
            .withColumn("folder", F.when(external, "").otherwise(
                F.regexp_extract("path", r"([^/]+)/[^/]*$", 1))))


def group_pages(pages: DataFrame, root_name: str = "") -> DataFrame:
    """Book of each scanned page: 《name》 in its title, else its top folder, else the loose group.

    ``pages`` holds path (relative to the root) and title.
    """
    named = F.nullif(F.regexp_extract("title", K.BOOK_NAME, 1), F.lit(""))
    top = F.nullif(F.regexp_extract("path", "^([^/]+)/", 1), F.lit(""))
    return pages.withColumn("book_key", F.coalesce(named, top, F.lit(K.LOOSE_GROUP))).withColumn(
        "book", F.coalesce(named, top, F.lit(root_name))).withColumn(
        "folder", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1))


def shelf_stats(cards: DataFrame, book: str = "book_key") -> DataFrame:
    """Digests and chapter estimate per book: spans when every digest has a range, else page counts."""
    span = F.col("b") - F.col("a") + 1
    return cards.groupBy(book).agg(
        F.count("*").alias("digests"),
        F.when(F.count("a") == F.count("*"), F.sum(span)).otherwise(F.sum("chapters")).cast("long").alias("chapters"))


def shelf_total(cards: DataFrame, book: str = "book_key") -> DataFrame:
    """Books, digests and chapters of the whole shelf; here each digest picks span or count itself."""
    per = cards.groupBy(book).agg(F.count("*").alias("n"), F.sum(
        F.coalesce((F.col("b") - F.col("a") + 1).cast("long"), F.col("chapters").cast("long"))).alias("c"))
    return per.agg(F.count("*").alias("books"), F.coalesce(F.sum("n"), F.lit(0)).alias("digests"),
                   F.coalesce(F.sum("c"), F.lit(0)).alias("chapters"))


def search_hit(q: str, book_search: str = "book") -> Column:
    """Does the lower-case query stand in the name of the book or the search string of the card?"""
    return F.contains(F.lower(F.col(book_search)), F.lit(q)) | F.contains(F.lower(F.col("search")), F.lit(q))


def shelf_search(cards: DataFrame, query: str, book: str = "book_key", book_search: str = "book") -> DataFrame:
    """Cards of matching books, else matching cards; an empty query keeps everything."""
    q = query.strip().lower()
    if not q:
        return cards
    return cards.where(search_hit(q, book_search))


# -- reading progress -----------------------------------------------------
def latest_progress(events: DataFrame, key: str = "key", time: str = "t", tie: str | None = None) -> DataFrame:
    """Last write per key: key, unit_id, pct, t, label."""
    by = F.struct(time, tie) if tie else F.struct(time)
    last = events.groupBy(key).agg(F.max_by(F.struct("unit_id", "pct", time), by).alias("_l"))
    return last.select(key, "_l.unit_id", "_l.pct", F.col(f"_l.{time}").alias(time),
                       T.progress_label(F.col("_l.pct")).alias("label"))


def continue_reading(progress: DataFrame, cards: DataFrame | None = None, key: str = "key",
                     time: str = "t") -> DataFrame:
    """The most recently read digest (one row, a maximum instead of a sort)."""
    p = progress if cards is None else progress.join(cards.select(key, "path"), key)
    cols = [c for c in p.columns]
    return (p.agg(F.max_by(F.struct(*cols), F.struct(time, key)).alias("_m")).where("_m is not null")
            .select(*[F.col(f"_m.{c}").alias(c) for c in cols]))
