"""Books and digests stored in parts: no row ever holds a whole one.

A part is a row (book_id, part_no, text); a book is the text of its parts in
the order of ``part_no``, cut anywhere, also inside a line.  Every part is
summarised in its own row: how long it is, where its headings stand, and the
fragments of the lines that its two ends cut.  The summaries are put together
by ordered scans, the fragments of a cut line by the part in which it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright import fixed as K
from tomewright.functions import text as T
from tomewright.operators import digest as D
from tomewright.operators.ordered import BLOCK_BITS, ordered_scan
from tomewright.operators.segment import _MARK, custom_title
from tomewright.session import cut_lineage

_IN_BOOK = ["_h", "_p"]      # ties of parts that share a number: by content, then as they were read


def _numbered(parts: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return parts.select("book_id", "part_no", text.alias("text"), F.xxhash64(text).alias("_h"),
                        F.monotonically_increasing_id().alias("_p"))


def _blank_prefix(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, K.U + rf"^{K.WS}+", ""))


def _fragment(c: Column) -> Column:
    """A fragment as short as its line can be judged by: lines over MAX_HEADING_CHARS are no headings.

    White space beyond that length is either stripped or makes the line too
    long, and so does a longer core, for which full stops stand in.
    """
    most = K.MAX_HEADING_CHARS + 1
    lead, stop = _blank_prefix(c), F.length(T.urstrip(c))
    core = F.substring(c, lead + 1, stop - lead)
    short = F.concat(F.substring(c, F.lit(1), F.least(lead, F.lit(most))),
                     F.when(F.length(core) < most, core).otherwise(F.lit(K.FULL_STOP * most)),
                     F.substring(c, stop + 1, F.lit(most)))
    return F.when(lead == F.length(c), F.left(c, F.lit(most))).otherwise(short)


def _reader(pattern: str | None, loose: bool):
    """Functions of a stripped line: does it start a stretch, and its STRUCT<kind, title>."""
    if pattern is not None:
        rx = K.U + f"^(?:{pattern})"
        return (lambda s: s.rlike(rx),
                lambda s: F.struct(F.when(s.rlike(rx), "chapter").alias("kind"), custom_title(s, pattern).alias("title")))

    def read(s):
        return T.let(T.heading(s, loose), lambda h: F.struct(h["kind"].alias("kind"), h["title"].alias("title")))
    return (lambda s: T.heading_kind(s, loose).isNotNull()), read


def _stretches(parts: DataFrame, pattern: str | None, loose: bool) -> DataFrame:
    """Parts cut before every heading and before the line that the end of the part cuts; narrow rows.

    ``frag`` is what the part holds of a cut line (first and last stretch);
    ``kind`` and ``title`` belong to the line a stretch in between begins with.
    """
    starts, read = _reader(pattern, loose)
    marked = T.let(T.lines_of(F.col("text")), lambda ls: F.array_join(F.transform(ls, lambda r, i: F.when(
        (i > 0) & ((i == F.size(ls) - 1) | F.coalesce(starts(T.ustrip(r)), F.lit(False))), F.concat(F.lit(_MARK), r)).otherwise(r)), "\n"))
    cut = _numbered(parts).select("book_id", "part_no", *_IN_BOOK, F.contains("text", F.lit("\n")).alias("nl"), F.split(marked, _MARK, -1).alias("ps"))
    rows = (cut.select("book_id", "part_no", *_IN_BOOK, "nl", F.size("ps").alias("m"), F.posexplode_outer("ps").alias("_k", "body"))
            .where("_k is not null").withColumn("tail", F.expr("nl AND _k = m - 1")))
    first = T.first_line(F.col("body"))
    edge = F.col("tail") | (F.col("_k") == 0)
    lead = _blank_prefix(F.col("body"))
    return rows.select("book_id", "part_no", *_IN_BOOK, "_k", "tail", F.length("body").cast("long").alias("n"),
                       F.when(lead < F.length("body"), lead).alias("lead"), F.length(T.urstrip(F.col("body"))).alias("core_end"),
                       F.when(edge, _fragment(first) if pattern is None else first).alias("frag"),
                       F.when(~edge, read(T.ustrip(first))).alias("head"))


def _items(parts: DataFrame, pattern: str | None, loose: bool, bits: int) -> DataFrame:
    """Headings and stretches of every book at their offsets, with chapter number and latest volume (written)."""
    _, read = _reader(pattern, loose)
    rows = cut_lineage(_stretches(parts, pattern, loose))
    placed = cut_lineage(ordered_scan(rows, ["book_id"], "part_no", ties=[*_IN_BOOK, "_k"], bits=bits, written=True, total={"start": F.col("n")},
                                      carry={"_from": F.when(F.col("tail"), F.col("_p"))}))
    # a cut line belongs to the part whose tail begins it; null: to the start of the book
    owner = F.when(F.col("tail"), F.col("_p")).otherwise(F.col("_from"))
    cut = placed.where("frag is not null").groupBy("book_id", owner.alias("_owner")).agg(
        F.min("start").alias("start"), F.array_sort(F.collect_list(F.when(F.col("frag") != "", F.struct("start", "frag")))).alias("fs"))
    line = T.ustrip(F.array_join(F.transform("fs", lambda f: f["frag"]), ""))
    cut = cut.select("book_id", "start", F.col("_owner").isNull().alias("opens"), read(line).alias("head"))
    none = F.lit(None)
    heads = (cut.unionByName(placed.where("head.kind is not null").select("book_id", "start", F.lit(False).alias("opens"), "head"))
             .select("book_id", "start", F.lit(1).alias("tie"), F.col("head.kind").alias("kind"), F.col("head.title").alias("title"), "opens",
                     *[none.cast("long").alias(c) for c in ("first", "last", "stop")])
             .where("kind is not null or opens"))
    body = placed.select("book_id", "start", F.lit(2).alias("tie"), none.cast("string").alias("kind"), none.cast("string").alias("title"),
                         F.lit(False).alias("opens"), (F.col("start") + F.col("lead")).alias("first"),
                         F.when(F.col("lead").isNotNull(), F.col("start") + F.col("core_end")).alias("last"),
                         (F.col("start") + F.col("n")).alias("stop"))
    # the line that opens a book titles its preamble, so it comes in as a row in front of any chapter too
    # (empty, where a chapter begins with that line)
    empty = none.cast("string") if pattern is None else F.lit("")
    opening = heads.where("opens").withColumns({"tie": F.lit(0), "kind": F.lit("opening"), "title": F.when(
        F.col("kind").isin("chapter", "special"), empty).otherwise(F.col("title"))})
    items = heads.where("kind is not null").unionByName(opening).unionByName(body)
    chapter = F.coalesce(F.col("kind").isin("chapter", "special"), F.lit(False)).cast("int")
    out = ordered_scan(items, ["book_id"], "start", ties=["tie"], bits=bits, total={"_no": chapter},
                       carry={"_vol": F.when(F.col("kind") == "volume", F.col("title"))})
    return cut_lineage(out.withColumn("is_chapter", chapter == 1).withColumn("idx", (F.col("_no") + chapter).cast("int")).drop("_no", "opens"))


def split_parts(parts: DataFrame, pattern: str | None = None, chunk_size: int = K.CHUNK_CHARS, force_chunks: bool = False,
                loose_numbered: bool = False, with_preamble: bool = False, bits: int = BLOCK_BITS) -> DataFrame:
    """Chapter index of books in parts; the table ``split_chapters`` gives for the whole books.

    ``parts`` holds (book_id, part_no, text) of cleaned text; other columns are
    ignored.  Parts that share a number follow each other by their content, a
    null number comes first, null texts are empty, a null book is a book; an
    empty table gives an empty index.  Text is read once, inside its row; what
    is shuffled are offsets, titles and, of each part, at most 51 characters on
    each side of two fragments.  With a ``pattern`` the lines that parts cut
    must fit a task, as any line may match.
    """
    items = _items(parts, pattern, loose_numbered, bits)
    event = F.col("is_chapter")
    books = items.groupBy("book_id").agg(F.count_if(event).alias("_n"), F.coalesce(F.max("stop"), F.lit(0)).alias("_len"))
    books = cut_lineage(books.select(F.col("book_id").alias("_b"), (F.lit(force_chunks) | (F.col("_n") < 2)).alias("fallback"), "_len"))
    mine = F.col("book_id").eqNullSafe(F.col("_b"))

    by_head = items.join(books.where("not fallback"), mine, "left_semi").groupBy("book_id", "idx").agg(
        F.max(F.when(event | (F.col("tie") == 0), F.col("title"))).alias("title"),
        F.coalesce(F.max("last") - F.min("first"), F.lit(0)).alias("chars"),
        F.coalesce(F.min(F.when(event, F.col("start"))), F.lit(0)).alias("start"), F.max("stop").alias("end"),
        F.coalesce(F.max(F.when(event, F.col("_vol"))), F.lit("")).alias("volume"))
    titled = by_head.select("book_id", "idx", "title", "chars", "start", F.greatest("start", "end").alias("end"), "volume", F.lit(False).alias("fallback"))

    # every stretch lists the chunks that begin inside it
    size = F.lit(int(chunk_size)).cast("long")
    chunky = items.where("stop > start").join(books.where("fallback"), mine)
    lo, hi = F.ceil(F.col("start") / size).cast("long"), (F.ceil(F.col("stop") / size) - 1).cast("long")
    begun = (chunky.where(lo <= hi).select("book_id", "_len", F.explode_outer(F.sequence(lo, hi)).alias("_c")).where("_c is not null")
             .select("book_id", (F.col("_c") + 1).cast("int").alias("idx"), (F.col("_c") * size).alias("start"),
                     F.least((F.col("_c") + 1) * size, "_len").alias("end")))
    nought = F.lit(0).cast("long")
    begun = begun.unionByName(books.where("fallback").select(F.col("_b").alias("book_id"), F.lit(0).alias("idx"), nought.alias("start"), nought.alias("end")))
    before, after = K.CHUNK_TITLE.split("{}")
    chunks = begun.select("book_id", "idx", F.concat(F.lit(before), F.col("idx").cast("string"), F.lit(after)).alias("title"),
                          (F.col("end") - F.col("start")).alias("chars"), "start", "end", F.lit("").alias("volume"), F.lit(True).alias("fallback"))
    out = titled.unionByName(chunks)
    return out if with_preamble else out.where("idx > 0")


def text_of_parts(parts: DataFrame, chapters: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Chapter bodies (book_id, idx, text, norm) of books in parts; a chapter must fit a row, a book need not.

    ``chapters`` is the index of ``split_parts`` for the same parts, with or
    without preamble rows.  The parts are written once; starts of parts and of
    chapters are sorted as offsets, and only the pieces between two of them
    are moved, to the chapter that holds them.
    """
    stored = cut_lineage(_numbered(parts))
    sized = cut_lineage(stored.select("book_id", "part_no", *_IN_BOOK, F.length("text").cast("long").alias("n")))
    based = ordered_scan(sized, ["book_id"], "part_no", ties=_IN_BOOK, bits=bits, written=True, total={"pos": F.col("n")}).where("n > 0")
    starts = chapters.where("idx > 0")
    points = (based.select("book_id", "pos", F.struct(F.col("_p").alias("id"), F.col("pos").alias("base"), F.col("n")).alias("part"),
                           F.lit(None).cast("int").alias("idx"), F.lit(None).cast("boolean").alias("fallback"))
              .unionByName(starts.select("book_id", F.col("start").alias("pos"), "idx", "fallback"), allowMissingColumns=True))
    chapter = F.when(F.col("idx").isNotNull(), F.struct("idx", "fallback"))
    spread = ordered_scan(points.withColumn("chap", chapter).drop("idx", "fallback"), ["book_id"], "pos", bits=bits, ahead={"_next": F.col("pos")},
                          carry={"_part": F.col("part"), "_chap": F.col("chap")})
    part, chap = F.coalesce("part", "_part"), F.coalesce("chap", "_chap")
    pieces = (spread.select("book_id", "pos", part.alias("part"), chap.alias("chap"), F.coalesce("_next", part["base"] + part["n"]).alias("stop"))
              .where("chap is not null and stop > pos")
              .groupBy(F.col("part.id").alias("_p")).agg(F.collect_list(F.struct(
                  (F.col("pos") - F.col("part.base") + 1).cast("int").alias("at"), (F.col("stop") - F.col("pos")).cast("int").alias("n"),
                  "pos", "chap")).alias("cuts")))
    moved = (stored.select("book_id", "_p", "text").join(pieces, "_p")
             .select("book_id", F.explode_outer(F.transform("cuts", lambda c: F.struct(
                 c["chap"].alias("chap"), c["pos"].alias("pos"), F.col("text").substr(c["at"], c["n"]).alias("s")))).alias("c"))
             .where("c is not null"))
    whole = moved.groupBy("book_id", "c.chap").agg(F.array_sort(F.collect_list(F.struct("c.pos", "c.s"))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda p: p["s"]), "")
    return (whole.select("book_id", F.col("chap.idx").alias("idx"), F.when(F.col("chap.fallback"), body).otherwise(T.ustrip(body)).alias("text"))
            .withColumn("norm", T.normalize(F.col("text"))))


def whole_lines(parts: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Parts whose text begins with a line, with the offset and number of that line.

    (book_id, part_no, line_no, start, text): every part gives its first
    fragment to the part in which that line begins; a part inside one line goes.
    ``text`` lacks the newline behind its last line.  A line must fit a task.
    """
    stored = cut_lineage(_numbered(parts))
    nl = F.contains("text", F.lit("\n"))
    head = F.when(nl, T.first_line(F.col("text"))).otherwise(F.col("text"))
    sized = cut_lineage(stored.select("book_id", "part_no", *_IN_BOOK, F.length("text").cast("long").alias("n"), nl.alias("nl"),
                                      F.length(head).cast("long").alias("head_n"),
                                      (F.length("text") - F.length(F.translate("text", "\n", ""))).cast("long").alias("breaks")))
    based = cut_lineage(ordered_scan(sized, ["book_id"], "part_no", ties=_IN_BOOK, bits=bits, written=True,
                                     total={"base": F.col("n"), "lines": F.col("breaks"), "_at": F.lit(1)},
                                     carry={"_from": F.when(F.col("nl"), F.col("_p"))}))
    # the first part of a book owns its first line; it keeps its head and needs no owner
    opens = F.col("_at") == 0
    leads = based.where(opens).select(F.col("book_id").alias("_b"), F.col("_p").alias("_lead"))
    own = based.join(leads, F.col("book_id").eqNullSafe(F.col("_b")), "left").drop("_b")
    own = cut_lineage(own.withColumn("_owner", F.coalesce("_from", "_lead")).drop("_lead"))
    given = (stored.select("_p", head.alias("s")).join(own.where("_at > 0").select("_p", "_owner", "base"), "_p").where("s <> ''")
             .groupBy("_owner").agg(F.array_sort(F.collect_list(F.struct("base", "s"))).alias("gs"))
             .select(F.col("_owner").alias("_p"), F.array_join(F.transform("gs", lambda g: g["s"]), "").alias("more")))
    kept = (stored.select("_p", "text").join(own.where("nl or _at = 0"), "_p").join(given, "_p", "left")
            .withColumn("text", F.concat("text", F.coalesce("more", F.lit("")))))
    behind = F.when(F.col("_at") == 0, F.lit(0)).otherwise(F.col("head_n") + 1)
    return kept.select("book_id", "part_no", F.when(F.col("_at") == 0, F.lit(0)).otherwise(F.col("lines") + 1).cast("long").alias("line_no"),
                       (F.col("base") + behind).cast("long").alias("start"), F.col("text").substr((behind + 1).cast("int"), F.length("text")).alias("text"))


def lines_of_parts(parts: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Line table (book_id, line_no, line, start) of books in parts; equals ``lines`` of the whole books."""
    at = whole_lines(parts, bits)
    cut = at.select("book_id", "line_no", "start", T.lines_of(F.col("text")).alias("ls"))
    cut = cut.select("book_id", "line_no", "start", "ls", T.sums_before(F.transform("ls", lambda x: F.length(x) + 1)).alias("ss"))
    return (cut.select("book_id", "line_no", "start", F.posexplode_outer(F.arrays_zip("ls", "ss")).alias("i", "r")).where("i is not null")
            .select("book_id", (F.col("line_no") + F.col("i")).alias("line_no"), F.col("r.ls").alias("line"), (F.col("start") + F.col("r.ss")).alias("start")))


def _scanned(lines: DataFrame, narrow: DataFrame) -> DataFrame:
    """Lines (written) with what scans over their narrow columns have found; the text is moved by this join alone."""
    found = narrow.withColumnsRenamed({"book_id": "_b", "line_no": "_l"})
    return (lines.join(found, F.col("book_id").eqNullSafe(F.col("_b")) & (F.col("line_no") == F.col("_l"))).drop("_b", "_l")
            .withColumn("s", T.ustrip(F.col("line"))))


def blocks_of_parts(parts: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Block table of digests in parts, keyed by book_id; equals ``digest_blocks`` of the whole digests.

    Line classes are carried on by ordered scans; a line and a block must fit a
    task, a digest need not.  Nulls and repeated numbers as in ``split_parts``.
    """
    key = ["book_id"]
    lines = cut_lineage(lines_of_parts(parts, bits).select("book_id", "line_no", "line"))
    s = T.ustrip(F.col("line"))
    kinds = lines.select("book_id", "line_no", D.line_kind(F.col("line"), s).alias("kind"), s.rlike("^##(?!#)").alias("_two"))
    near = ordered_scan(kinds, key, "line_no", bits=bits, behind={"_prev": F.col("kind")}, carry={"_owner": D.block_owner()})
    near = near.withColumn("_owner", F.coalesce(D.block_owner(), "_owner"))
    # a heading is a block of one line
    near = cut_lineage(near.select("*", D.block_starts().cast("long").alias("_starts"), (F.col("_two") & (F.col("kind") == "h")).cast("long").alias("_h2")))
    placed = ordered_scan(near, key, "line_no", bits=bits, written=True, total={"_b": F.col("_starts"), "_h": F.col("_h2")})
    placed = placed.where("kind <> 'blank'").select("book_id", "line_no", "kind", "_prev", "_owner", (F.col("_b") + F.col("_starts")).alias("block_no"),
                                                    (F.col("_h") + F.col("_h2")).alias("bucket_no"))
    # all lines of a block have its bucket, so it travels in the key
    out = D.blocks_of_lines(_scanned(lines, placed), [*key, "bucket_no"])
    return out.select("book_id", *[c for c in out.columns if c not in ("book_id", "bucket_no")], "bucket_no")


def units_of_parts(parts: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Unit parts of digests in parts, keyed by book_id; equals ``unit_parts`` of the whole digests.

    Units are numbered by an ordered scan over all lines; a unit must fit a
    task, a digest need not.
    """
    lines = cut_lineage(lines_of_parts(parts, bits).select("book_id", "line_no", "line"))
    opens = lines.select("book_id", "line_no", D.opens_unit().cast("long").alias("_opens"))
    placed = ordered_scan(opens, ["book_id"], "line_no", bits=bits, total={"_u": F.col("_opens")})
    placed = placed.select("book_id", "line_no", (F.col("_u") + F.col("_opens")).alias("unit_no"))
    return D.parts_of_units(_scanned(lines, placed), ["book_id"])
