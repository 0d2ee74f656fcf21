"""Quotation audit: extract slices, prove that they are verbatim, report."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tomewright import fixed as K
from tomewright.functions import text as T
from tomewright.operators.ordered import first_of, locate_in_spans, ordered_scan
from tomewright.operators.passages import BLOCK, BROADCAST_PROBES, find_segments, flat_blocks, flat_spans
from tomewright.session import cut_lineage

INLINE = 16             # occurrences per segment, on average, that go to their slices
LISTED = 256            # occurrences of a piece that are listed; a more common one is looked for in the text
STRETCH = 22            # bits of the characters that a task holds for that

_IN = K.WS_INLINE
_MARK_AHEAD = "(?Udm)" + rf"^(?={_IN}*(?:\*\*)?{_IN}*【原文{_IN}*[·・:：]?{_IN}*[^】\n]*】)"
_QUOTE_LINE = rf"{_IN}*>[^\n]*(?:\n|\z)"
_BLANKS = rf"(?:{_IN}*\n)*"
_QUOTE_RUN = K.U + rf"^[^\n]*\n{_BLANKS}((?:{_QUOTE_LINE})+)"
_QUOTE_RUN_OPEN = K.U + rf"^[^\n]*\n{_BLANKS}({_QUOTE_LINE}(?:{_BLANKS}{_QUOTE_LINE})*)"


def _unquote(run: Column) -> Column:
    body = F.regexp_replace(run, "(?Udm)" + rf"\n(?:{_IN}*\n)+", "\n\n")
    body = F.regexp_replace(body, "(?Udm)" + rf"^{_IN}*>{_IN}?", "")
    return T.ustrip(F.regexp_replace(body, K.U + rf"{_IN}+(?=\n|\z)", ""))


def extract_slices(docs: DataFrame, keys: list[str], allow_inner_blank: bool = False) -> DataFrame:
    """Quotations under their markers: keys, slice_no, chapter, label, raw, text, line.

    The document is cut at its marker lines inside the row; nothing is
    shuffled.  ``allow_inner_blank`` keeps a quotation open over blank lines.
    """
    cut = docs.select(*keys, F.split("text", _MARK_AHEAD, -1).alias("parts"))
    cut = cut.select(*keys, "parts", T.sums_before(F.transform(
        "parts", lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))).alias("before"))
    rows = F.transform(F.arrays_zip("parts", "before"), lambda x: F.struct(
        T.first_line(x["parts"]).alias("head"), (x["before"] + 1).alias("line"),
        _unquote(F.regexp_extract(x["parts"], _QUOTE_RUN_OPEN if allow_inner_blank else _QUOTE_RUN, 1))
        .alias("raw")))
    kept = F.filter(rows, lambda r: (F.length(r["raw"]) > 0) & r["head"].rlike(K.SLICE_MARKER_LINE))
    return (cut.select(*keys, F.posexplode_outer(kept).alias("_i", "r")).where("_i is not null")
            .select(*keys, (F.col("_i") + 1).alias("slice_no"),
                    T.ustrip(F.regexp_extract("r.head", K.SLICE_MARKER_LINE, 1)).alias("chapter"),
                    T.ustrip(F.regexp_extract("r.head", K.SLICE_MARKER_LINE, 2)).alias("label"),
                    F.col("r.raw").alias("raw"), T.strip_quote_edges(F.col("r.raw")).alias("text"),
                    F.col("r.line").alias("line")))


def slice_segments(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Searchable pieces of each slice: keys, seg_no (from 0), seg."""
    norm = slices.select(*keys, T.normalize(F.col("text")).alias("_n"))
    return (norm.select(*keys, F.posexplode_outer(T.match_segments(F.col("_n"))).alias("seg_no", "seg"))
            .where("seg_no is not null"))


def _first_behind(n_keys: int):
    """Sorted (keys, seg_no, pos, len) rows -> one row per segment that occurs; state is a cursor per open slice.

    The row with pos -1 opens a segment and brings its length.
    """
    def run(it):
        key, cursor, seg = None, 0, None            # open slice, where its search stands, its open segment

        def close(out):
            nonlocal cursor
            if seg is not None and seg["first"] is not None:
                pos = seg["first"] if seg["ahead"] is None else seg["ahead"]
                out.append((*key, seg["no"], pos, seg["ahead"] is None))
                cursor = pos + seg["len"]
        names = None
        for pdf in it:
            out, names = [], [*pdf.columns[:n_keys], "seg_no", "pos", "out_of_order"]
            cols = [pdf[c].to_numpy() for c in pdf.columns[:n_keys]]
            no, pos, length = (pdf[c].to_numpy() for c in ("seg_no", "pos", "len"))
            new = no[1:] != no[:-1]
            for c in cols:
                new |= c[1:] != c[:-1]
            cut = np.r_[0, np.flatnonzero(new) + 1, len(no)] if len(no) else np.zeros(1, int)
            for lo, hi in zip(cut[:-1], cut[1:]):
                k = tuple(c[lo] for c in cols)
                if k != key or seg["no"] != no[lo]:
                    close(out)
                    if k != key:
                        key, cursor = k, 0
                    seg = {"no": no[lo], "len": 0, "first": None, "ahead": None}
                if pos[lo] < 0:
                    seg["len"] = int(length[lo])
                    lo += 1
                if lo < hi and seg["first"] is None:
                    seg["first"] = int(pos[lo])
                if lo < hi and seg["ahead"] is None:
                    i = lo + np.searchsorted(pos[lo:hi], cursor)
                    seg["ahead"] = int(pos[i]) if i < hi else None
            yield pd.DataFrame(out, columns=names)
        if names:
            out = []
            close(out)
            yield pd.DataFrame(out, columns=names)
    return run


def locate_in_order(occurrences: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen position per segment: keys, seg_no, pos, out_of_order.

    Each segment is taken at its first occurrence behind the previous one,
    else at its first occurrence at all (out of order); a segment without
    occurrence leaves the cursor alone.  Occurrences are sorted by slice and
    segment and read once as a stream, so a common short piece costs sorting
    (which spills) but no memory.
    """
    return _in_order(occurrences, segments.withColumn("len", F.length("seg")), keys)


def _in_order(occurrences: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    typed = lambda pos, length: [*keys, F.col("seg_no").cast("int").alias("seg_no"), pos.cast("long").alias("pos"),
                                 length.cast("long").alias("len")]
    rows = occurrences.select(*typed(F.col("pos"), F.lit(None))).unionByName(
        segments.select(*typed(F.lit(-1), F.col("len"))))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "seg_no", "pos")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(_first_behind(len(keys)), f"{kinds}, seg_no int, pos long, out_of_order boolean")


def _after(asked: DataFrame, occ: DataFrame) -> DataFrame:
    """``asked`` (piece, cursor, ..) with ``next``: the first occurrence (piece, pos) of the piece at or behind the cursor."""
    extra = [c for c in asked.columns if c not in ("piece", "cursor")]
    rows = asked.select("piece", (-F.col("cursor")).alias("_o"), F.lit(1).alias("_q"), F.lit(None).cast("long").alias("_pos"),
                        F.struct("cursor", *extra).alias("_r"))
    there = occ.join(asked.select("piece").distinct(), "piece", "left_semi")
    rows = rows.unionByName(there.select("piece", (-F.col("pos")).alias("_o"), F.lit(0).alias("_q"), F.col("pos").alias("_pos"),
                                         F.lit(None).cast(rows.schema["_r"].dataType).alias("_r")))
    # from the end of the book: what was seen last is what comes next
    seen = ordered_scan(rows, ["piece"], "_o", carry={"next": F.col("_pos")}, ties=["_q"]).where("_q = 1")
    return seen.select("piece", "_r.*", "next")


def locate_pieces(segments: DataFrame, occ: DataFrame, keys: list[str], inline: int = INLINE) -> DataFrame:
    """``locate_in_order`` for slices that share their pieces: keys, seg_no, pos, out_of_order.

    ``segments`` (a written table) holds keys, seg_no, piece (null: occurs
    nowhere), len; ``occ`` the occurrences (piece, pos) of every distinct piece,
    once however many slices quote it.  The first segment takes the first
    occurrence of its piece.  After that all slices ask together, one scan
    ordered by piece and position per segment number, until the occurrences of
    the pieces still to be placed are few (on average ``inline`` for each);
    those go to their slices and are read as a stream.
    """
    segs = segments.where(" and ".join(f"`{k}` is not null" for k in keys))
    per = occ.groupBy("piece").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
    segs = cut_lineage(segs.groupBy(*keys, "seg_no").agg(F.min("piece").alias("piece"), F.min("len").cast("long").alias("len"),
                                                         F.count(F.lit(1)).alias("_rows"))
                       .join(per, "piece", "left")
                       # rows that repeat a key: no earlier occurrence is taken for them
                       .withColumn("_else", F.when(F.col("_rows") > 1, F.lit(-1).cast("long")).otherwise(F.col("_first"))))
    found, state, k = [], None, 0
    while True:
        rest = segs.where(F.col("seg_no") >= k).agg(F.count(F.lit(1)).alias("segs"), F.sum("_n").alias("occ")).first()
        if not rest["segs"]:
            break
        if k and (rest["occ"] or 0) <= inline * rest["segs"]:
            todo = segs.where(F.col("seg_no") >= k)
            many = todo.join(occ, "piece").select(*keys, "seg_no", "pos")
            lens = todo.select(*keys, "seg_no", "len").unionByName(todo.where("_rows > 1").select(*keys, "seg_no", "len"))
            # an opening segment of the cursor's length at 0 brings the slice to where it stands
            at = state.join(todo.select(*keys).distinct(), keys, "left_semi")
            many = many.unionByName(at.select(*keys, F.lit(-1).alias("seg_no"), F.lit(0).cast("long").alias("pos")))
            lens = lens.unionByName(at.select(*keys, F.lit(-1).alias("seg_no"), F.col("cursor").alias("len")))
            found.append(_in_order(many, lens, keys).where("seg_no >= 0"))
            break
        mine = segs.where(F.col("seg_no") == k)
        if k == 0:
            placed = mine.withColumns({"next": F.col("_first"), "cursor": F.lit(0).cast("long")})
        else:
            placed = _after(mine.join(state, keys).select(*mine.columns, "cursor"), occ)
        pos = F.coalesce("next", "_else")
        placed = cut_lineage(placed.select(*keys, "seg_no", pos.alias("pos"), F.col("next").isNull().alias("out_of_order"),
                                           F.coalesce(pos + F.col("len"), F.col("cursor")).alias("cursor")))
        found.append(placed.where("pos is not null").select(*keys, "seg_no", "pos", "out_of_order"))
        state, k = placed.select(*keys, "cursor"), k + 1
    if not found:
        return segs.select(*keys, "seg_no", F.lit(None).cast("long").alias("pos"), F.lit(False).alias("out_of_order")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _walk(r: dict, stretch: int, here: int = -1, text: str = "") -> None:
    """Advance one slice as far as the listed places and ``text`` (from stretch number ``here``) tell; changes ``r``."""
    while r["k"] < len(r["segs"]):
        s, at = r["segs"][r["k"]], None
        if r["k"] == 0 or s["first"] is None:
            at = s["first"]
        elif not s["common"]:
            i = bisect.bisect_left(s["at"], r["cursor"])
            at = s["at"][i] if i < len(s["at"]) else None
        else:
            own = r["cursor"] >> stretch
            if own <= r["last"]:
                if own != here:
                    break
                i = text.find(s["seg"], r["cursor"] - (here << stretch))
                if i < 0 or i >= 1 << stretch:          # not in this stretch: the search goes on in the next
                    r["cursor"] = here + 1 << stretch
                    continue
                at = (here << stretch) + i
        pos, s["late"] = (s["other"], True) if at is None else (at, False)
        if pos is not None:
            s["pos"], r["cursor"] = pos, pos + s["len"]
        r["k"] += 1
    r["st"] = r["cursor"] >> stretch


def walk_slices(segs: DataFrame, occ: DataFrame, known: DataFrame, pieces: DataFrame, blocks: DataFrame, spans: DataFrame,
                keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """``locate_in_order`` where some pieces are too common to list their places: keys, seg_no, pos, out_of_order.

    ``segs`` holds keys (book_id first), seg_no, piece, len; ``known`` piece,
    first, common.  A common piece is looked for in the text itself, from where
    its slice stands: slices meet the stretch of ``2**stretch`` characters they
    stand in, go on in it as far as they can, and meet the next one they get to
    in a further round.
    """
    rows = (segs.groupBy(*keys, "seg_no").agg(F.min("piece").alias("piece"), F.min("len").cast("long").alias("len"), F.count(F.lit(1)).alias("_rows"))
            .join(known, "piece", "left"))
    asked = rows.select("piece").distinct()
    listed = occ.join(known.where("not common"), "piece").join(asked, "piece", "left_semi").groupBy("piece").agg(
        F.array_sort(F.collect_list("pos")).alias("at"))        # at most LISTED
    texts = pieces.join(known.where("common"), "piece", "left_semi").select("piece", "seg")
    rows = rows.join(listed, "piece", "left").join(texts, "piece", "left")
    # rows that repeat a key: no earlier occurrence is taken for them
    other = F.when(F.col("_rows") > 1, F.lit(-1).cast("long")).otherwise(F.col("first"))
    seg = F.struct(F.col("seg_no").cast("int").alias("seg_no"), F.col("len"), F.coalesce("common", F.lit(False)).alias("common"), F.col("first"),
                   other.alias("other"), F.coalesce("at", F.array().cast("array<bigint>")).alias("at"), F.col("seg"),
                   F.lit(None).cast("long").alias("pos"), F.lit(False).alias("late"))
    state = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(seg)).alias("segs"))        # one slice
    ends = spans.groupBy(keys[0]).agg(F.max((F.col("norm_end") - 1).cast("long")).alias("_end"))
    state = state.join(ends, keys[0], "left").withColumns({
        "last": F.coalesce(F.shiftright(F.col("_end"), stretch), F.lit(-1)).cast("long"), "k": F.lit(0), "cursor": F.lit(0).cast("long"),
        "st": F.lit(0).cast("long")}).drop("_end")
    schema = _parse_datatype_string(state.schema.simpleString())        # all of it nullable, as what Python returns

    def walked(rows, here: int = -1, text: str = ""):
        for lo in range(0, rows.num_rows, 256):         # few are Python objects at a time
            some = rows.slice(lo, 256).to_pylist()
            for r in some:
                _walk(r, stretch, here, text)
            yield pa.RecordBatch.from_pylist(some, schema=rows.schema)

    def without(it):
        for b in it:
            yield from walked(b)

    def within(texts: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows
        parts = texts.column("block").take(pc.sort_indices(texts.column("base"))).to_pylist()
        text = "".join([p[:BLOCK] for p in parts[:-1]] + parts[-1:])
        return pa.Table.from_batches(walked(rows, rows.column("st")[0].as_py(), text), schema=rows.schema)
    # a stretch comes with the blocks behind it that a piece may run into
    longest = texts.agg(F.max(F.length("seg"))).first()[0] or 0
    of = F.sequence(F.shiftright(F.greatest(F.col("base") - longest, F.lit(0)), stretch), F.shiftright("base", stretch))
    near = blocks.select(keys[0], "base", "block", F.explode(of).alias("st"))
    found = []
    state = cut_lineage(state.mapInArrow(without, schema), "zstd")
    while True:
        found.append(state.where("k >= size(segs)"))
        state = state.where("k < size(segs)")
        visits = cut_lineage(state.select(keys[0], "st").distinct())
        if visits.isEmpty():
            break
        text = near.join(visits, [keys[0], "st"], "left_semi")
        state = cut_lineage(text.groupBy(keys[0], "st").cogroup(state.groupBy(keys[0], "st")).applyInArrow(within, schema), "zstd")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return (out.select(*keys, F.explode("segs").alias("s")).where("s.pos is not null")
            .select(*keys, F.col("s.seg_no").alias("seg_no"), F.col("s.pos").alias("pos"), F.col("s.late").alias("out_of_order")))


def _chapter_name(n: Column) -> Column:
    return F.concat(F.lit("第"), n.cast("string"), F.lit("章"))


def verify_slices(slices: DataFrame, chapter_text: DataFrame, spans: DataFrame | None = None,
                  blocks: DataFrame | None = None,
                  broadcast_probes: int = BROADCAST_PROBES, listed: int = LISTED, stretch: int = STRETCH) -> DataFrame:
    """Audit slices of a known book: status PASS, WARN or FAIL with the reason.

    ``slices`` holds (book_id, doc_id, slice_no, chapter, text), ``chapter_text``
    (book_id, idx, norm).  Places of a piece are listed up to ``listed``; more
    common ones are looked for in the text (``walk_slices``).  ``spans`` and
    ``blocks`` accept the written tables of ``flat_spans`` and ``flat_blocks``.
    Returns the keys, n_segments, n_found, pos (first chosen position in the
    book), chapters, status, reason.
    """
    keys = ["book_id", "doc_id", "slice_no"]
    if blocks is None:
        # written, so its size is known and the text is not shuffled to meet a few books
        wanted = cut_lineage(chapter_text.join(cut_lineage(slices.select("book_id").distinct()), "book_id", "left_semi")
                             .select("book_id", "idx", "norm"), "zstd")
        spans = cut_lineage(flat_spans(wanted)) if spans is None else spans
        blocks = cut_lineage(flat_blocks(wanted, spans), "zstd")        # read once per shard of pieces
    whole = cut_lineage(slice_segments(slices, keys), "zstd")
    # a piece is searched once however many slices of its book quote it
    pieces = cut_lineage(whole.where("book_id is not null").select("book_id", "seg").distinct()
                         .withColumn("piece", F.monotonically_increasing_id()), "zstd")
    listing = max(4 * listed // blocks.rdd.getNumPartitions(), 16) if listed else 0       # by one task
    occ = cut_lineage(find_segments(blocks, pieces, ["piece"], ["book_id"], scope=["book_id"], broadcast_probes=broadcast_probes, most=listing)
                      .select("piece", "pos", "more"))
    known = cut_lineage(occ.groupBy("piece").agg(F.min("pos").alias("first"), (F.bool_or("more") | (F.count(F.lit(1)) > listed)).alias("common")))
    segs = cut_lineage(whole.join(pieces, ["book_id", "seg"], "left").select(
        *keys, "seg_no", "piece", F.length("seg").alias("len"), F.substring("seg", 1, 40).alias("seg")))
    named = segs.where(" and ".join(f"`{k}` is not null" for k in keys))
    common = known.where("common").select("piece")
    walking = cut_lineage(named.where("seg_no > 0").join(common, "piece", "left_semi").select(*keys).distinct())
    # the others take the first place of a common piece at most
    places = occ.join(common, "piece", "left_anti").select("piece", "pos").unionByName(known.where("common").select("piece", F.col("first").alias("pos")))
    chosen = locate_pieces(named.join(walking, keys, "left_anti"), places, keys, max(listed, INLINE))
    if not walking.isEmpty():
        chosen = chosen.unionByName(walk_slices(named.join(walking, keys, "left_semi"), occ.select("piece", "pos"), known, pieces, blocks, spans,
                                                keys, stretch))
    placed = locate_in_spans(chosen, spans, "book_id", "pos", "norm_start", "norm_end")
    per = segs.join(placed.select(*keys, "seg_no", "pos", "out_of_order", "idx"), [*keys, "seg_no"], "left")
    agg = per.groupBy(*keys).agg(
        F.count("*").alias("n_segments"), F.count("pos").alias("n_found"),
        F.coalesce(F.bool_or("out_of_order"), F.lit(False)).alias("_order"),
        F.min_by("pos", F.when(F.col("pos").isNotNull(), F.col("seg_no"))).alias("pos"),
        F.min_by(F.substring("seg", 1, 40), F.when(F.col("pos").isNull(), F.col("seg_no"))).alias("_lost"),
        # at most one entry per segment of the quotation
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("idx") > 0, F.struct("seg_no", "idx")))), lambda x: x["idx"])).alias("_ch"))
    out = slices.join(agg, keys, "left").withColumn("_want", T.declared_chapter(F.col("chapter")))
    n = F.coalesce(F.col("n_segments"), F.lit(0))
    found = F.coalesce(F.col("n_found"), F.lit(0))
    names = F.array_join(F.transform(F.coalesce("_ch", F.array().cast("array<bigint>")), _chapter_name), "、")
    wrong = (F.col("_want").isNotNull() & (F.size("_ch") > 0)
             & ~F.array_contains(F.col("_ch"), F.col("_want")))

    def fill(template, *cols):
        parts = template.split("{}")
        row = [F.lit(parts[0])]
        for c, p in zip(cols, parts[1:]):
            row += [c, F.lit(p)]
        return F.concat(*row)

    case = (F.when(n == 0, F.lit(0)).when(found < n, F.lit(1)).when(F.col("_order"), F.lit(2))
             .when(wrong, F.lit(3)).otherwise(F.lit(4)))
    return (out.withColumn("_case", case)
            .select(*slices.columns, n.alias("n_segments"), found.alias("n_found"), "pos",
                    names.alias("chapters"),
                    F.when(F.col("_case") < 2, "FAIL").when(F.col("_case") < 4, "WARN")
                     .otherwise("PASS").alias("status"),
                    F.when(F.col("_case") == 0, K.REASON_SHORT)
                     .when(F.col("_case") == 1, fill(K.REASON_MISSING, (n - found).cast("string"), F.col("_lost")))
                     .when(F.col("_case") == 2, K.REASON_ORDER)
                     .when(F.col("_case") == 3, fill(K.REASON_CHAPTER, _chapter_name(F.col("_want")), names))
                     .otherwise("").alias("reason")))


def status_counts(results: DataFrame) -> DataFrame:
    """Slices, pass, warn, fail per document."""
    return results.groupBy("book_id", "doc_id").agg(
        F.count("*").alias("slices"), F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warned"),
        F.count_if(F.col("status") == "FAIL").alias("failed"))


def slice_share(slices: DataFrame, chapter_text: DataFrame, alarm: float = K.SLICE_SHARE_ALARM) -> DataFrame:
    """Quoted characters against source characters, with the alarm flag."""
    quoted = slices.withColumn("_n", F.length(T.normalize(F.col("text")))).groupBy("book_id", "doc_id") \
        .agg(F.sum("_n").alias("slice_chars"))
    source = chapter_text.groupBy("book_id").agg(F.sum(F.length("norm")).alias("source_chars"))
    ratio = F.col("slice_chars") / F.greatest(F.coalesce("source_chars", F.lit(0)), F.lit(1))
    return (quoted.join(source, "book_id", "left")
            .select("book_id", "doc_id", "slice_chars", F.coalesce("source_chars", F.lit(0)).alias("source_chars"),
                    F.round(ratio, 4).alias("ratio"), (ratio > alarm).alias("alarm")))


def slice_collection(results: DataFrame) -> DataFrame:
    """Accepted slices in reading order, warnings kept with their reason."""
    return (results.where(F.col("status").isin("PASS", "WARN"))
            .select("book_id", "doc_id", "slice_no", "chapter", "label", "raw", "status", "reason"))


def slice_issues(results: DataFrame, per_doc: int | None = None) -> DataFrame:
    """Slices that did not pass; ``per_doc`` limits a report to the first issues of each document."""
    bad = results.where("status <> 'PASS'").select("book_id", "doc_id", "slice_no", "chapter", "status", "reason")
    if per_doc is None:
        return bad
    return first_of(bad, ["book_id", "doc_id"], ["slice_no"], per_doc)


def quality_gate(docs: DataFrame, coverage: DataFrame, results: DataFrame) -> DataFrame:
    """One verdict per document: chapters all covered, no failed slice, at least one slice."""
    c = coverage.select("book_id", "doc_id", "total", "covered", F.col("missing").alias("missing"))
    out = (docs.select("book_id", "doc_id").distinct()
           .join(c, ["book_id", "doc_id"], "left").join(status_counts(results), ["book_id", "doc_id"], "left"))
    no_index = F.coalesce(F.col("total"), F.lit(0)) == 0
    uncovered = F.col("covered") < F.col("total")
    no_slice = F.coalesce(F.col("slices"), F.lit(0)) == 0
    failed = F.coalesce(F.col("failed"), F.lit(0)) > 0
    errors = F.concat_ws(",", F.when(no_index, "no_index"), F.when(uncovered, "uncovered"),
                         F.when(no_slice, "no_slices"), F.when(failed, "failed_slices"))
    return out.select(
        "book_id", "doc_id", F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("slices", F.lit(0)).alias("slices"),
        F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("warned", F.lit(0)).alias("warned"),
        F.coalesce("failed", F.lit(0)).alias("failed"), errors.alias("errors"),
        (errors == "").alias("ok"))
