"""Digest documents as tables: blocks, units, entries, reordering, audits.

Windows here partition by document.  A document is one input row, so a window
group is bounded by the length of one text, whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright import fixed as K
from tomewright.functions import text as T


def digest_lines(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no (from 0), line, s (stripped)."""
    return (docs.select(*keys, F.posexplode_outer(T.lines_of(F.col("text"))).alias("line_no", "line"))
            .where("line_no is not null").withColumn("s", T.ustrip(F.col("line"))))


def line_kind(line: Column, s: Column) -> Column:
    """Class of a Markdown line: blank, slice, h, hr, quote, table, ul, ol or p."""
    return (F.when(s == "", "blank").when(line.rlike(K.SLICE_MARKER_LINE), "slice")
            .when(s.startswith("#"), "h").when(s.rlike(K.RULE), "hr").when(s.startswith(">"), "quote")
            .when(s.startswith("|"), "table").when(s.rlike(K.BULLET), "ul")
            .when(s.rlike(K.ORDERED), "ol").otherwise("p"))


def _quote_body(line: Column) -> Column:
    return T.urstrip(F.regexp_replace(line, K.U + r"^\s*>\s?", ""))


def digest_blocks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Block table: keys, block_no, line_no, kind, level, text, items, rows, chapter, label, bucket_no.

    A block starts where the line class changes; a quotation marker owns the
    quote lines that follow it, across blank lines.  ``bucket_no`` counts the
    level-2 headings up to the block (0 is the head of the document).
    """
    ln = digest_lines(docs, keys).withColumn("kind", line_kind(F.col("line"), F.col("s")))
    w = Window.partitionBy(*keys).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ln = ln.withColumns({"_prev": F.lag("kind").over(w), "_owner": F.last(block_owner(), True).over(upto)})
    blocks = blocks_of_lines(ln.withColumn("block_no", F.sum(block_starts().cast("long")).over(upto)), keys)
    bw = Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    h2 = (F.col("kind") == "h") & (F.col("level") == 2)
    return blocks.withColumn("bucket_no", F.sum(F.when(h2, 1).otherwise(0)).over(bw))


def block_owner() -> Column:
    """Class of a line that later quote lines may belong to, else null."""
    return F.when(~F.col("kind").isin("blank", "quote"), F.col("kind"))


def _continues() -> Column:
    return F.coalesce((F.col("kind") == "quote") & (F.col("_owner") == "slice"), F.lit(False))


def block_starts() -> Column:
    """Whether a line (kind, _prev, _owner) opens a block."""
    return ((F.col("kind") != "blank") & ~_continues()
            & (F.col("kind").isin("slice", "h", "hr") | F.coalesce(F.col("_prev") != F.col("kind"), F.lit(True))))


def blocks_of_lines(ln: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks, without their bucket, of lines (keys, line_no, line, s, kind, _prev, _owner, block_no)."""
    ln = ln.where("kind <> 'blank'")
    body = F.when(F.col("kind") == "quote", _quote_body(F.col("line"))).otherwise(F.col("s"))
    gap = _continues() & (F.col("_prev") == "blank")
    b = ln.groupBy(*keys, "block_no").agg(
        F.min("line_no").alias("line_no"), F.min_by("kind", "line_no").alias("kind"),
        F.min_by("s", "line_no").alias("_head"),
        F.array_sort(F.collect_list(F.struct("line_no", body.alias("v"), gap.alias("g")))).alias("_ls"))
    all_lines = F.transform("_ls", lambda x: x["v"])
    quoted = F.flatten(F.transform(F.slice("_ls", 2, F.greatest(F.size("_ls") - 1, F.lit(0))), lambda x: F.when(
        x["g"], F.array(F.lit(""), x["v"])).otherwise(F.array(x["v"]))))
    k = F.col("kind")
    marks = F.regexp_extract("_head", "^#+", 0)
    cells = F.transform(all_lines, lambda r: F.transform(
        F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|", -1), T.ustrip))
    items = F.when(k == "ul", F.transform(all_lines, lambda r: F.regexp_replace(r, K.BULLET, ""))) \
        .when(k == "ol", F.transform(all_lines, lambda r: F.regexp_replace(r, K.ORDERED, "")))
    text = (F.when(k == "h", T.ustrip(F.substring(F.col("_head"), F.length(marks) + 1, F.length("_head"))))
            .when(k == "slice", F.array_join(quoted, "\n"))
            .when(k.isin("p", "quote"), F.array_join(all_lines, "\n")))
    return b.select(
        *keys, "block_no", "line_no", "kind", F.when(k == "h", F.length(marks)).alias("level"),
        text.alias("text"), items.alias("items"), F.when(k == "table", cells).alias("rows"),
        F.when(k == "slice", T.ustrip(F.regexp_extract("_head", K.SLICE_MARKER_LINE, 1))).alias("chapter"),
        F.when(k == "slice", T.ustrip(F.regexp_extract("_head", K.SLICE_MARKER_LINE, 2))).alias("label"))


def units(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets opened by level-2 headings: keys, bucket_no, kind, num, title, ch_from, ch_to, anchor.

    A document without any unit heading counts as one unit.
    """
    heads = blocks.where("kind = 'h' and level = 2").select(
        *keys, "bucket_no", F.concat(F.lit("## "), F.col("text")).alias("_h"), "text")
    is_unit = F.col("_h").rlike(K.UNIT_HEADING)
    rest = T.ustrip(F.regexp_extract("_h", K.UNIT_HEADING, 2))
    w = Window.partitionBy(*keys).orderBy("bucket_no").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.select(
        *keys, "bucket_no", F.when(is_unit, "unit").otherwise("section").alias("kind"),
        F.when(is_unit, rest).otherwise(F.col("text")).alias("title"),
        T.cn_number(F.nullif(F.regexp_extract("_h", K.UNIT_HEADING, 1), F.lit(""))).alias("_n"),
        F.when(is_unit, T.group(rest, K.UNIT_RANGE, 1).cast("long")).alias("ch_from"),
        F.when(is_unit, T.group(rest, K.UNIT_RANGE, 2).cast("long")).alias("ch_to"))
    nth_unit = F.sum(F.when(F.col("kind") == "unit", 1).otherwise(0)).over(w)
    nth_section = F.sum(F.when(F.col("kind") == "section", 1).otherwise(0)).over(w)
    heads = heads.withColumn("num", F.when(
        F.col("kind") == "unit", F.coalesce(F.when(F.col("_n") > 0, F.col("_n")), nth_unit)).otherwise(nth_section))
    has = heads.where("kind = 'unit'").select(*keys).distinct()
    whole = blocks.select(*keys).distinct().join(has, keys, "left_anti").select(
        *keys, F.lit(0).cast("long").alias("bucket_no"), F.lit("unit").alias("kind"),
        F.lit(1).cast("long").alias("num"), F.lit("").alias("title"),
        F.lit(None).cast("long").alias("ch_from"), F.lit(None).cast("long").alias("ch_to"))
    # headings of a document without units stay plain sections of the one unit
    cols = [*keys, "bucket_no", "kind", "num", "title", "ch_from", "ch_to"]
    out = heads.select(*cols).unionByName(whole)
    return out.withColumn("anchor", F.when(
        F.col("bucket_no") == 0, "sec-0").otherwise(F.concat(
            F.when(F.col("kind") == "unit", "u-").otherwise("sec-"), F.col("num").cast("string"))))


def unit_title(title: Column) -> Column:
    """Title without its trailing chapter range."""
    t = T.ustrip(F.regexp_replace(title, K.TITLE_RANGE_TAIL, ""))
    return F.when(t != "", t).otherwise(title)


def document_title(docs: DataFrame, keys: list[str], given: str | None = None,
                   path: str | None = None) -> DataFrame:
    """Given title, else the first level-1 heading in the first 20 lines, else the file stem."""
    top = F.slice(T.lines_of(F.col("text")), 1, 20)
    h1 = F.try_element_at(F.filter(top, lambda x: x.rlike("^# .+$")), F.lit(1))
    stem = F.lit("") if path is None else F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    picks = ([F.nullif(F.col(given), F.lit(""))] if given else [])
    return docs.select(*keys, F.coalesce(*picks, T.ustrip(F.substr(h1, F.lit(3))), stem).alias("title"))


def block_entries(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled list items: keys, bucket_no, block_no, item_no, level, nums, item."""
    it = (blocks.where("kind = 'ul'")
          .select(*keys, "bucket_no", "block_no", F.posexplode_outer("items").alias("item_no", "item")))
    level = T.group(F.col("item"), K.ENTRY_LEVEL)
    return (it.withColumn("level", level).where("level is not null")
            .withColumn("nums", T.chapter_list(F.regexp_extract("item", K.ENTRY_CHAPTERS, 1))))


def level_of_slices(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Slice blocks with the level of the first entry of their unit that holds their chapter.

    Chapter sets are exploded to an equi join on (document, bucket, chapter).
    """
    sl = blocks.where("kind = 'slice'").select(
        *keys, "bucket_no", "block_no", "label", "chapter",
        T.group(F.col("chapter"), "([0-9]{1,6})").cast("long").alias("ch"))
    ent = (block_entries(blocks, keys)
           .select(*keys, "bucket_no", "level", F.struct("block_no", "item_no").alias("_o"),
                   F.explode_outer("nums").alias("ch"))
           .groupBy(*keys, "bucket_no", "ch").agg(F.min_by("level", "_o").alias("level")))
    return sl.join(ent, [*keys, "bucket_no", "ch"], "left")


def key_only(blocks: DataFrame, keys: list[str], level: str = K.LEVEL_KEY) -> DataFrame:
    """Entries and slices of one level, in document order."""
    e = block_entries(blocks, keys).where(F.col("level") == level).select(
        *keys, "block_no", "item_no", F.lit("entry").alias("kind"), F.col("item").alias("text"))
    s = level_of_slices(blocks, keys).where(F.col("level") == level).select(
        *keys, "block_no", F.lit(0).alias("item_no"), F.lit("slice").alias("kind"),
        F.col("chapter").alias("text"))
    return e.unionByName(s)


# -- entries of a unit, old and new style ---------------------------------
def _item_fields(item: Column) -> Column:
    """STRUCT<chpart, title, after> of ``**head**（note）：body``."""
    def read(m):
        head0, note, body = (T.ustrip(F.regexp_extract(m, K.ENTRY_HEAD, i)) for i in (1, 2, 3))
        short = F.length(note) <= K.SHORT_NOTE_CHARS
        head = F.concat(head0, F.when(short, note).otherwise(""))
        after = F.concat(F.when(short, "").otherwise(note), F.lit("："), body)
        return T.let(F.struct(head.alias("h"), after.alias("a")), lambda x: _split_head(x["h"], x["a"]))

    return F.when(item.rlike(K.ENTRY_HEAD), T.let(item, read))


def _split_head(head: Column, after: Column) -> Column:
    last = head.rlike(K.NUMBER_LAST)
    first = head.rlike(K.NUMBER_FIRST)
    tail = T.ustrip(F.regexp_extract(head, K.NUMBER_FIRST, 2))
    tail = T.ustrip(F.regexp_replace(tail, r"^(?:的|[（(][详略][）)])", ""))
    return (F.when(last, F.struct(
                T.no_space(F.regexp_extract(head, K.NUMBER_LAST, 2)).alias("chpart"),
                T.ustrip(F.regexp_extract(head, K.NUMBER_LAST, 1)).alias("title"), after.alias("after")))
            .when(first, F.struct(
                T.no_space(F.regexp_extract(head, K.NUMBER_FIRST, 1)).alias("chpart"),
                tail.alias("title"), after.alias("after"))))


def _inline_fields(s: Column) -> Column:
    """STRUCT<chpart, title, after> of ``【重要】title（第N章）：body``."""
    def read(rest):
        tail = T.ustrip(F.regexp_extract(rest, K.NUMBER_FIRST, 2))
        colon = F.instr(tail, F.lit("："))
        title = F.when(colon > 0, T.ustrip(F.substring(tail, F.lit(1), colon - 1))).otherwise(tail)
        after = F.when(colon > 0, F.concat(F.lit("："), T.ustrip(
            F.substring(tail, colon + 1, F.length(tail))))).otherwise("")
        return (F.when(rest.rlike(K.NUMBER_LAST), F.struct(
                    T.no_space(F.regexp_extract(rest, K.NUMBER_LAST, 2)).alias("chpart"),
                    T.ustrip(F.regexp_extract(rest, K.NUMBER_LAST, 1)).alias("title"),
                    T.ustrip(F.regexp_extract(rest, K.NUMBER_LAST, 3)).alias("after")))
                .when(rest.rlike(K.NUMBER_FIRST), F.struct(
                    T.no_space(F.regexp_extract(rest, K.NUMBER_FIRST, 1)).alias("chpart"),
                    T.ustrip(F.regexp_replace(title, "^是", "")).alias("title"), after.alias("after"))))

    return T.let(T.ustrip(F.regexp_extract(s, K.INLINE_SECTION, 2)), read)


def _trim(lines: Column) -> Column:
    """Drop blank lines at both ends of an array of lines."""
    def cut(ls):
        at = F.filter(F.transform(ls, lambda x, i: F.when(T.ustrip(x) != "", i)), lambda i: i.isNotNull())
        return T.let(at, lambda a: F.when(F.size(a) > 0, F.slice(
            ls, F.array_min(a) + 1, F.array_max(a) - F.array_min(a) + 1)).otherwise(
                F.array().cast("array<string>")))
    return T.let(lines, cut)


def unit_parts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Unit bodies cut into parts: keys, unit_no, part, opener, lines and entry fields.

    part is 'head', 'lead', 'entry', 'slice' or 'tail'; unit 0 holds the text
    before the first unit as one 'lead'.
    """
    ln = digest_lines(docs, keys)
    doc = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return parts_of_units(ln.withColumn("unit_no", F.sum(opens_unit()).over(doc)), keys)


def opens_unit() -> Column:
    """1 for a line that heads a unit, else 0."""
    return F.when(F.col("line").rlike(K.UNIT_LINE), 1).otherwise(0)


def parts_of_units(ln: DataFrame, keys: list[str]) -> DataFrame:
    """``unit_parts`` of numbered lines (keys, line_no, line, s, unit_no); a unit is one window group."""
    s = F.col("s")
    kind = (F.when(F.col("line").rlike(K.UNIT_LINE), "head")
            .when(F.col("unit_no") == 0, F.when(s == "", "blank").otherwise("other"))
            .when(s.rlike(K.UNIT_END), "end").when(s.rlike(K.SLICE_LINE), "slice")
            .when(s.rlike(K.SECTION_LINE), "section")
            .when(s.rlike(K.INLINE_SECTION), "inline")
            .when(s.rlike(K.BULLET), "item").when(F.col("line").rlike(K.U + r"^\s*>"), "quote")
            .when(s == "", "blank").otherwise("other"))
    ln = ln.withColumn("kind", kind)
    unit = Window.partitionBy(*keys, "unit_no").orderBy("line_no")
    upto = unit.rowsBetween(Window.unboundedPreceding, 0)
    since = unit.rowsBetween(0, Window.unboundedFollowing)
    ln = ln.withColumns({
        "in_tail": F.max(F.when(F.col("kind") == "end", 1).otherwise(0)).over(upto) == 1,
        "sec": F.last(F.when(F.col("kind") == "section", F.regexp_extract("s", K.SECTION_LINE, 1)), True).over(upto),
        "solid": F.last(F.when(~F.col("kind").isin("blank", "quote"), F.col("kind")), True).over(upto),
        "prev": F.lag("kind").over(unit),
        "next": F.first(F.when(F.col("kind") != "blank", F.col("kind")), True).over(since)})
    item = F.regexp_replace("s", K.BULLET, "")
    done = (F.col("kind") == "item") & item.rlike(K.DONE_ENTRY)
    opens_entry = (F.col("kind") == "inline") | ((F.col("kind") == "item") & (F.col("sec").isNotNull() | done))
    in_slice = F.col("kind").isin("quote", "blank") & (F.col("solid") == "slice") & (F.col("next") == "quote")
    ln = ln.withColumns({"done": done, "opens": F.when(opens_entry, "entry").when(
        F.col("kind").isin("slice", "section"), F.col("kind")), "in_slice": F.coalesce(in_slice, F.lit(False))})
    ln = ln.withColumn("open", F.last(F.when(F.col("opens").isNotNull(), F.struct("opens", "line_no")), True).over(upto))
    part = (F.when(F.col("kind") == "head", "head").when(F.col("in_tail"), "tail")
            .when(F.col("kind") == "section", None)
            .when((F.col("kind") == "slice") | F.col("in_slice"), "slice")
            .when(F.col("open.opens") == "entry", "entry").otherwise("lead"))
    ln = ln.withColumn("part", part).where("part is not null")
    # one blank line is kept inside a quotation, however many there were
    ln = ln.where(~((F.col("part") == "slice") & (F.col("kind") == "blank") & (F.col("prev") == "blank")))
    # quotation lines and entries belong to their opener; the rest is one part per unit
    group = F.when(F.col("part").isin("entry", "slice"), F.col("open.line_no")).otherwise(-1)
    level = F.when(F.col("kind") == "inline", F.regexp_extract("s", K.INLINE_SECTION, 1)).otherwise(F.col("sec"))
    level = (F.when(level.isNull() & F.col("done"), T.group(item, K.DONE_ENTRY))
             .when(level == K.SECTION_KEY, K.LEVEL_KEY).when(level.isNotNull(), K.LEVEL_BRIEF))
    first = F.col("opens").isNotNull()
    g = ln.withColumns({"opener": group, "item": item, "level": level}).groupBy(*keys, "unit_no", "part", "opener").agg(
        F.array_sort(F.collect_list(F.struct("line_no", F.when(
            F.col("kind") == "blank", F.lit("")).otherwise(F.col("line")).alias("line")))).alias("_ls"),
        F.min_by("kind", F.when(first, F.col("line_no"))).alias("_k"),
        F.min_by("item", F.when(first, F.col("line_no"))).alias("_item"),
        F.min_by("level", F.when(first, F.col("line_no"))).alias("level"))
    g = g.withColumn("lines", F.transform("_ls", lambda x: x["line"])).withColumn(
        "_f", F.when(F.col("part") == "entry", F.when(
            F.col("_k") == "inline", _inline_fields(T.ustrip(F.col("lines")[0]))).otherwise(
                _item_fields(F.col("_item")))))
    nums = F.when(F.col("part") == "entry", T.chapter_list(F.coalesce(F.col("_f.chpart"), F.lit("")))) \
        .when(F.col("part") == "slice", T.chapter_list(F.regexp_extract(
            T.ustrip(F.col("lines")[0]), K.SLICE_LINE, 1)))
    g = g.withColumn("nums", nums)
    return g.select(*keys, "unit_no", "part", "opener", "lines", "level", "nums",
                    F.col("_f.chpart").alias("chpart"), F.col("_f.title").alias("title"),
                    F.col("_f.after").alias("after"),
                    ((F.col("part") == "entry") & (F.size("nums") > 0)).alias("ok"))


def entries(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of every unit with their sort key (first chapter, detailed before brief, source order)."""
    return sorted_entries(unit_parts(docs, keys))


def sorted_entries(parts: DataFrame) -> DataFrame:
    """The entries of a ``unit_parts`` table with their sort key."""
    return parts.where("part = 'entry'").withColumns({
        "min_ch": F.coalesce(F.array_min("nums"), F.lit(K.NO_CHAPTER)).cast("long"),
        "brief": (F.coalesce(F.col("level"), F.lit("")) != K.LEVEL_KEY).cast("int")})


def render_head(chpart: Column, level: Column, title: Column, after: Column) -> Column:
    return F.concat(F.lit("- **第"), chpart, F.lit("章（"), level, F.lit("）"),
                    F.when(title != "", F.concat(F.lit(" "), title)).otherwise(""), F.lit("**"), after)


def unit_stats(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Entries, slices and unreadable entries per unit."""
    p = unit_parts(docs, keys).where("unit_no > 0")
    return p.groupBy(*keys, "unit_no").agg(
        F.count_if(F.col("part") == "entry").alias("entries"),
        F.count_if(F.col("part") == "slice").alias("slices"),
        F.count_if((F.col("part") == "entry") & ~F.col("ok")).alias("unreadable"))


def attach_slices(parts: DataFrame, keys: list[str]) -> DataFrame:
    """For each slice part, the opener of the first sorted entry that holds its chapter."""
    e = (parts.where("part = 'entry'").select(
            *keys, "unit_no", F.col("opener").alias("entry"), F.struct(
                F.array_min("nums").alias("a"), (F.coalesce(F.col("level"), F.lit("")) != K.LEVEL_KEY).alias("b"),
                F.col("opener").alias("c")).alias("_o"), F.explode_outer("nums").alias("ch"))
         .groupBy(*keys, "unit_no", "ch").agg(F.min_by("entry", "_o").alias("entry")))
    sl = parts.where("part = 'slice'").select(*keys, "unit_no", "opener", F.array_min("nums").alias("ch"))
    return sl.join(e, [*keys, "unit_no", "ch"], "left").select(*keys, "unit_no", "opener", "entry")


def slices_per_entry(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Slices attached to each entry: keys, unit_no, entry, slices; a null entry counts slices without one."""
    at = attach_slices(unit_parts(docs, keys), keys)
    return at.groupBy(*keys, "unit_no", "entry").agg(F.count("*").alias("slices"))


def reorder_digest(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Digest rewritten as one ascending list per unit: keys, unit_no, out_no, line.

    Lead, sorted entries each followed by its slices, slices without entry,
    closing lines.  Ordering by (keys, unit_no, out_no) gives the new text.
    The parts of one unit (a piece of one document) meet in one row and are
    arranged there, so the document is read and grouped once.
    """
    none = F.array().cast("array<string>")
    parts = unit_parts(docs, keys)
    u = parts.groupBy(*keys, "unit_no").agg(F.array_sort(F.collect_list(F.struct(
        "opener", "part", "lines", "level", "nums", "chpart", "title", "after", "ok"))).alias("ps"))

    def lines_in(part):
        return F.flatten(F.transform(F.filter("ps", lambda p: p["part"] == part), lambda p: p["lines"]))

    def entry(e):
        body = F.when(e["ok"], F.concat(
            F.array(render_head(e["chpart"], e["level"], e["title"], e["after"])),
            F.slice(e["lines"], 2, F.greatest(F.size(e["lines"]) - 1, F.lit(0))))).otherwise(e["lines"])
        return F.struct(F.coalesce(F.array_min(e["nums"]), F.lit(K.NO_CHAPTER)).alias("ch"),
                        (F.coalesce(e["level"], F.lit("")) != K.LEVEL_KEY).alias("brief"),
                        e["opener"].alias("opener"), e["nums"].alias("nums"), _trim(body).alias("body"))

    found = F.struct(
        F.array_sort(F.transform(F.filter("ps", lambda p: p["part"] == "entry"), entry)).alias("entries"),
        F.filter("ps", lambda p: p["part"] == "slice").alias("slices"),
        _trim(lines_in("lead")).alias("lead"), _trim(lines_in("tail")).alias("tail"))

    def place(z):
        def home(s):
            first = F.get(F.filter(z["entries"], lambda e: F.array_contains(e["nums"], F.array_min(s["nums"]))), F.lit(0))
            return F.struct(first["opener"].alias("home"),
                            F.concat(F.array(F.lit("")), s["lines"], F.array(F.lit(""))).alias("lines"))
        return F.struct(z["entries"].alias("entries"), z["lead"].alias("lead"), z["tail"].alias("tail"),
                        F.transform(z["slices"], home).alias("slices"))

    def assemble(z):
        def attached(opener):
            return F.filter(z["slices"], lambda s: s["home"] == opener)

        def block(e, i):
            prev = F.get(z["entries"], i - 1)
            before = F.when(i == 0, F.try_element_at(z["lead"], F.lit(-1))).when(
                F.size(attached(prev["opener"])) > 0, "").otherwise(F.try_element_at(prev["body"], F.lit(-1)))
            joined = F.ltrim(before).startswith("- ") & F.ltrim(F.get(e["body"], F.lit(0))).startswith("- ")
            gap = F.when(before.isNotNull() & ~joined, F.array(F.lit(""))).otherwise(none)
            return F.concat(gap, e["body"], F.flatten(F.transform(attached(e["opener"]), lambda s: s["lines"])))

        loose = F.flatten(F.transform(F.filter(z["slices"], lambda s: s["home"].isNull()), lambda s: s["lines"]))
        return F.struct(F.concat(z["lead"], F.flatten(F.transform(z["entries"], block)), loose).alias("out"),
                        z["tail"].alias("tail"))

    def close(z):
        gap = F.when((F.size(z["tail"]) > 0) & (F.trim(F.coalesce(F.try_element_at(z["out"], F.lit(-1)), F.lit(""))) != ""),
                     F.array(F.lit(""))).otherwise(none)
        return _trim(F.concat(z["out"], gap, z["tail"]))

    body = T.let(T.let(T.let(found, place), assemble), close)
    new = F.when(F.col("unit_no") == 0, lines_in("lead")).otherwise(F.concat(lines_in("head"), body))
    return (u.select(*keys, "unit_no", F.posexplode_outer(new).alias("out_no", "line"))
            .where("out_no is not null"))


def _content(line: Column) -> Column:
    """A line without its structural label, for the conservation check."""
    s = T.ustrip(line)
    item = F.regexp_replace(s, K.BULLET, "")
    inline = F.coalesce(_inline_fields(s)["after"], s)
    return T.no_space(F.when(s.rlike(K.SECTION_LINE), F.lit(""))
                      .when(s.rlike(K.INLINE_SECTION), F.regexp_replace(inline, "^：", ""))
                      .when(s.rlike(K.BULLET) & item.rlike(K.ENTRY_HEAD), F.regexp_extract(item, K.ENTRY_HEAD, 3))
                      .otherwise(s))


def lost_lines(old: DataFrame, new: DataFrame, keys: list[str], content=_content) -> DataFrame:
    """Lines whose number of occurrences differs between two versions: keys, line, delta.

    Empty when the texts are equal as multisets.  Counts combine before the
    shuffle; nothing is replicated as ``exceptAll`` would do.
    """
    def tally(df, sign):
        return df.select(*keys, content(F.col("line")).alias("line"), F.lit(sign).alias("d")).where("line <> ''")
    return (tally(old, -1).unionByName(tally(new, 1)).groupBy(*keys, "line")
            .agg(F.sum("d").alias("delta")).where("delta <> 0"))


def audit_order(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Per unit: entries out of ascending order, chapters repeated, chapters of the range left out."""
    e = entries(docs, keys).where("ok")
    w = Window.partitionBy(*keys, "unit_no").orderBy("opener")
    drops = (e.withColumn("_p", F.lag("min_ch").over(w)).groupBy(*keys, "unit_no")
             .agg(F.count("*").alias("entries"), F.count_if(F.col("min_ch") < F.col("_p")).alias("descents")))
    ch = e.select(*keys, "unit_no", F.explode_outer("nums").alias("ch"))
    per = ch.groupBy(*keys, "unit_no", "ch").agg(F.count("*").alias("n"))
    head = unit_parts(docs, keys).where("part = 'head'")
    a = T.group(F.col("lines")[0], K.UNIT_RANGE, 1).cast("long")
    z = T.group(F.col("lines")[0], K.UNIT_RANGE, 2).cast("long")
    span = head.select(*keys, "unit_no", a.alias("a"), z.alias("z"))
    hit = (per.join(span, [*keys, "unit_no"], "left").groupBy(*keys, "unit_no", "a", "z").agg(
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("ch").between(F.col("a"), F.col("z"))).alias("_in")))
    return (span.join(drops, [*keys, "unit_no"], "left").join(hit.drop("a", "z"), [*keys, "unit_no"], "left")
            .select(*keys, "unit_no", F.coalesce("entries", F.lit(0)).alias("entries"),
                    F.coalesce("descents", F.lit(0)).alias("descents"),
                    F.coalesce("repeated", F.lit(0)).alias("repeated"),
                    F.greatest(F.coalesce(F.col("z") - F.col("a") + 1, F.lit(0)) - F.coalesce("_in", F.lit(0)),
                               F.lit(0)).alias("left_out")))


def lint_digest(docs: DataFrame, slices: DataFrame, shares: DataFrame, keys: list[str]) -> DataFrame:
    """Advice per document: slice lengths, share of quoted text, stray cross-segment marks."""
    lo, hi = K.SLICE_CHARS_RANGE
    n = F.length("text")
    s = slices.groupBy(*keys).agg(F.count("*").alias("slices"), F.count_if(n < lo).alias("too_short"),
                                  F.count_if(n > hi).alias("too_long"))
    words = F.regexp_count(F.col("text"), F.lit(K.CROSS_SEGMENT_WORD)).alias("cross_marks")
    out = docs.select(*keys, words).join(s, keys, "left").join(
        shares.select(*keys, "ratio", "alarm"), keys, "left")
    return out.select(*keys, F.coalesce("slices", F.lit(0)).alias("slices"),
                      F.coalesce("too_short", F.lit(0)).alias("too_short"),
                      F.coalesce("too_long", F.lit(0)).alias("too_long"), "cross_marks",
                      F.coalesce("ratio", F.lit(0.0)).alias("ratio"),
                      F.coalesce(F.col("ratio") > K.SLICE_SHARE_ADVICE, F.lit(False)).alias("over_advice"),
                      F.coalesce("alarm", F.lit(False)).alias("alarm"))
