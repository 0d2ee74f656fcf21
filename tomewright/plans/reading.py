"""Reading plans: index checks, batches, segments, source files."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.operators.ordered import BLOCK_BITS, ordered_scan, rank_blocks
from tomewright.operators.segment import in_scope

DEFAULT_BATCH = 12
DEFAULT_SEGMENT = 100


def _check_scope(lo: int | None, hi: int | None) -> None:
    if (lo is not None and lo < 1) or (lo is not None and hi is not None and hi < lo):
        raise ValueError("the scope must satisfy 1 <= lo <= hi")


def validate_index(chapters: DataFrame, lo: int | None = None, hi: int | None = None,
                   bits: int = BLOCK_BITS) -> DataFrame:
    """Violations (book_id, kind, first, last) of a contiguous index.

    kind: 'duplicate', 'negative', 'gap', or 'start' when the numbering begins
    below 1.  No row means that the plan operators may run.
    """
    _check_scope(lo, hi)
    rows = in_scope(chapters, lo, hi).select("book_id", F.col("idx").cast("long").alias("idx"), "chars")
    per_idx = rows.groupBy("book_id", "idx").agg(F.count("*").alias("n"), F.min("chars").alias("chars"))
    flags = per_idx.select("book_id", "idx", F.explode(F.filter(F.array(
        F.when(F.col("n") > 1, F.lit("duplicate")), F.when(F.col("chars") < 0, F.lit("negative")),
        F.when(F.col("idx") < 1, F.lit("start"))), lambda k: k.isNotNull())).alias("kind"))
    flags = flags.select("book_id", "kind", F.col("idx").alias("first"), F.col("idx").alias("last"))
    near = ordered_scan(per_idx.select("book_id", "idx"), ["book_id"], "idx",
                        behind={"prev": F.col("idx")}, bits=bits)
    inner = near.where("idx > prev + 1").select(
        "book_id", F.lit("gap").alias("kind"), (F.col("prev") + 1).alias("first"),
        (F.col("idx") - 1).alias("last"))
    out = flags.unionByName(inner)
    ends = per_idx.groupBy("book_id").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    if lo is not None:
        out = out.unionByName(ends.where(F.col("a") > lo).select(
            "book_id", F.lit("gap").alias("kind"), F.lit(lo).cast("long").alias("first"),
            (F.col("a") - 1).alias("last")))
    if hi is not None:
        # a book without any row in scope misses all of it; with an open end no chapter is known to be missing
        absent = chapters.select("book_id").distinct().join(ends.select("book_id"), "book_id", "left_anti")
        out = out.unionByName(absent.select("book_id", F.lit("gap").alias("kind"),
                                            F.lit(1 if lo is None else lo).cast("long").alias("first"),
                                            F.lit(hi).cast("long").alias("last")))
        out = out.unionByName(ends.where(F.col("b") < hi).select(
            "book_id", F.lit("gap").alias("kind"), (F.col("b") + 1).alias("first"),
            F.lit(hi).cast("long").alias("last")))
    return out


def require_valid(chapters: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Gate: return the scope, or raise with the first violations before anything is written.

    One aggregate decides: each book has as many rows as its numbers span, from
    the scope's first on, none negative.  Only a failed gate lists violations.
    """
    _check_scope(lo, hi)
    scope = in_scope(chapters, lo, hi)
    n, a, b = F.count("*"), F.min("idx"), F.max("idx")
    per = scope.groupBy("book_id").agg(
        (n != b - a + 1).alias("torn"), (F.count_distinct("idx") != n).alias("twice"), (F.coalesce(F.min("chars"), F.lit(0)) < 0).alias("neg"),
        ((a < 1) if lo is None else (a != lo)).alias("head"), (F.lit(False) if hi is None else (b != hi)).alias("tail"))
    books = per.agg(F.count("*").alias("n"), F.count_if(F.col("torn") | F.col("twice") | F.col("neg") | F.col("head") | F.col("tail")).alias("bad")).first()
    absent = hi is not None and not books["bad"] and chapters.agg(F.count_distinct("book_id")).first()[0] != books["n"]
    if books["bad"] or absent:
        bad = validate_index(chapters, lo, hi).limit(5).collect()
        if bad:
            raise ValueError(f"index is not contiguous: {[r.asDict() for r in bad]}")
    if not books["n"]:
        raise ValueError("the index has no chapter in scope")
    return scope


def _ranked(scope: DataFrame, bits: int) -> DataFrame:
    return ordered_scan(scope, ["book_id"], "idx", total={"_rn": F.lit(1)}, bits=bits)


# -- batches --------------------------------------------------------------
def assign_batches(chapters: DataFrame, size: int = DEFAULT_BATCH, mode: str = "grid",
                   lo: int | None = None, hi: int | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``batch``: on the global grid of chapter numbers, or counted from the scope head."""
    if size < 1:
        raise ValueError("size must be >= 1")
    _check_scope(lo, hi)
    scope = in_scope(chapters, lo, hi)
    if mode == "grid":
        return scope.withColumn("batch", F.expr(f"(cast(idx as bigint) - 1) div {int(size)} + 1"))
    if mode == "local":
        return _ranked(scope, bits).withColumn("batch", F.expr(f"_rn div {int(size)} + 1")).drop("_rn")
    raise ValueError(f"unknown mode {mode!r}")


def plan_batches(chapters: DataFrame, size: int = DEFAULT_BATCH, mode: str = "grid",
                 lo: int | None = None, hi: int | None = None, bits: int = BLOCK_BITS, gate: bool = True) -> DataFrame:
    """book_id, batch, start, end, chapters, chars, unit.

    ``gate`` first checks that the index is contiguous in scope and raises otherwise.
    """
    if gate:
        require_valid(chapters, lo, hi)
    rows = assign_batches(chapters, size, mode, lo, hi, bits)
    plan = rows.groupBy("book_id", "batch").agg(
        F.min("idx").alias("start"), F.max("idx").alias("end"), F.count("*").alias("chapters"),
        F.sum("chars").alias("chars"))
    number = F.when(F.length(F.col("batch").cast("string")) < 2, F.lpad(F.col("batch").cast("string"), 2, "0")) \
        .otherwise(F.col("batch").cast("string"))
    return plan.withColumn("unit", F.concat(
        F.lit("单元"), number, F.lit("_第"), F.col("start").cast("string"), F.lit("-"),
        F.col("end").cast("string"), F.lit("章")))


# -- segments -------------------------------------------------------------
def _budget_moves(target: int):
    """Transfer function of a block: entry sum -> (cuts, exit sum).

    A cut falls on the first chapter whose running sum since the last cut
    reaches the target.  Which chapter of the block that is depends only on
    the sum carried in, and it can only be one of the first few, so the whole
    block is described by a short step function.
    """
    def moves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        p = np.cumsum(pdf["chars"].to_numpy(dtype=np.int64))
        n = len(p)
        nxt = np.searchsorted(p, p + target, side="left")
        cuts, out = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        for k in range(n - 1, -1, -1):
            j = nxt[k]
            cuts[k] = 1 + (cuts[j] if j < n else 0)
            out[k] = out[j] if j < n else p[-1] - p[k]
        last = min(int(np.searchsorted(p, target, side="left")), n - 1)
        lo = np.maximum(target - p[:last + 1], 0)
        hi = np.concatenate([[target], lo[:-1]])
        keep = lo < hi
        rows = pd.DataFrame({"lo": lo[keep], "hi": hi[keep], "cuts": cuts[:last + 1][keep],
                             "out": out[:last + 1][keep], "add": 0})
        if p[-1] < target:      # nothing is cut below this entry sum
            rows.loc[len(rows)] = [0, target - p[-1], 0, 0, p[-1]]
        rows.insert(0, "_blk", pdf["_blk"].iloc[0])
        rows.insert(0, "book_id", pdf["book_id"].iloc[0])
        return rows
    return moves


def _budget_chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Walk the block step functions of one book in order."""
    acc = seg = 0
    out = []
    for blk, g in pdf.sort_values(["_blk", "lo"]).groupby("_blk", sort=True):
        out.append((g["book_id"].iloc[0], blk, acc, seg))
        r = g.iloc[int(np.searchsorted(g["lo"].to_numpy(), acc, side="right")) - 1]
        seg += int(r["cuts"])
        acc = acc + int(r["add"]) if r["cuts"] == 0 else int(r["out"])
    return pd.DataFrame(out, columns=["book_id", "_blk", "acc", "seg"])


def _budget_assign(target: int):
    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        p = np.cumsum(pdf["chars"].to_numpy(dtype=np.int64))
        cut = np.zeros(len(p), dtype=np.int64)
        k = int(np.searchsorted(p, target - int(pdf["acc"].iloc[0]), side="left"))
        while k < len(p):
            cut[k] = 1
            k = int(np.searchsorted(p, p[k] + target, side="left"))
        seg = int(pdf["seg"].iloc[0]) + np.cumsum(cut) - cut
        return pd.DataFrame({"book_id": pdf["book_id"], "idx": pdf["idx"], "segment_no": seg})
    return assign


def budget_segments(chapters: DataFrame, target_chars: int, bits: int = BLOCK_BITS) -> DataFrame:
    """(book_id, idx, segment_no): close a segment when its characters reach the target.

    The fold with resets is order dependent.  It runs as three passes: a step
    function per block of chapters, a walk over those per book, and the final
    numbering per block.  No task ever holds more than one block of chapters
    or the short block summaries of one book.
    """
    if target_chars < 1:
        raise ValueError("target_chars must be >= 1")
    rows = chapters.select("book_id", F.col("idx").cast("long").alias("idx"),
                           F.col("chars").cast("long").alias("chars"))
    rows = rank_blocks(rows, ["book_id"], "idx", bits=bits)[0].withColumn("_blk", F.col("_blk").cast("long")).drop("_row")
    kind = chapters.schema["book_id"].dataType.simpleString()
    moves = rows.groupBy("book_id", "_blk").applyInPandas(
        _budget_moves(target_chars),
        f"book_id {kind}, _blk long, lo long, hi long, cuts long, out long, add long")
    entry = moves.groupBy("book_id").applyInPandas(
        _budget_chain, f"book_id {kind}, _blk long, acc long, seg long")
    return rows.join(entry, ["book_id", "_blk"]).groupBy("book_id", "_blk").applyInPandas(
        _budget_assign(target_chars), f"book_id {kind}, idx long, segment_no long")


def assign_segments(chapters: DataFrame, per: int | None = None, target_chars: int | None = None,
                    ends: Sequence[int] | None = None, lo: int | None = None, hi: int | None = None,
                    bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``segment_no`` (from 0) by chapter count, character budget or explicit ends."""
    _check_scope(lo, hi)
    if sum(x is not None for x in (per, target_chars, ends)) > 1:
        raise ValueError("choose one of per, target_chars, ends")
    scope = in_scope(chapters, lo, hi)
    if ends is not None:
        ends = [int(e) for e in ends]
        if not ends or any(a >= b for a, b in zip(ends, ends[1:])):
            raise ValueError("ends must be strictly increasing")
        if (hi is not None and ends[-1] != hi) or (lo is not None and ends[0] < lo):
            raise ValueError("ends must lie in the scope and close it")
        if hi is None and not (beyond := scope.where(F.col("idx") > ends[-1])).isEmpty():
            some = [r[0] for r in beyond.select("book_id").distinct().limit(5).collect()]
            raise ValueError(f"chapters lie behind the last end, e.g. in {some}; give hi or close the scope")
        marks = F.array(*[F.lit(e).cast("long") for e in ends])
        return scope.withColumn("segment_no", F.size(F.filter(
            marks, lambda e: e < F.col("idx"))).cast("long"))
    if target_chars is not None:
        return scope.join(budget_segments(scope, target_chars, bits), ["book_id", "idx"])
    per = DEFAULT_SEGMENT if per is None else per
    if per < 1:
        raise ValueError("per must be >= 1")
    return _ranked(scope, bits).withColumn("segment_no", F.expr(f"_rn div {int(per)}")).drop("_rn")


def plan_segments(chapters: DataFrame, per: int | None = None, target_chars: int | None = None,
                  ends: Sequence[int] | None = None, lo: int | None = None, hi: int | None = None,
                  batch_size: int = DEFAULT_BATCH, first_number: int = 1,
                  bits: int = BLOCK_BITS, gate: bool = True) -> DataFrame:
    """book_id, segment_no, segment, start, end, chapters, chars, batches, titles, directory, next_start.

    ``gate`` first checks that the index is contiguous in scope and raises otherwise.
    """
    if batch_size < 1 or first_number < 1:
        raise ValueError("batch_size and first_number must be >= 1")
    if gate:
        require_valid(chapters, lo, hi)
    rows = assign_segments(chapters, per, target_chars, ends, lo, hi, bits)
    plan = rows.groupBy("book_id", "segment_no").agg(
        F.min("idx").alias("start"), F.max("idx").alias("end"), F.count("*").alias("chapters"),
        F.sum("chars").alias("chars"), F.min_by("title", "idx").alias("first_title"),
        F.max_by("title", "idx").alias("last_title"))
    plan = ordered_scan(plan, ["book_id"], "segment_no", ahead={"_next": F.col("start")}, bits=bits)
    number = (F.col("segment_no") + first_number).cast("string")
    label = F.concat(F.lit("段"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    return plan.select(
        "book_id", "segment_no", label.alias("segment"), "start", "end", "chapters", "chars",
        F.expr(f"(chapters + {batch_size - 1}) div {batch_size}").alias("batches"),
        "first_title", "last_title",
        F.concat(F.lit("第"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"),
                 F.lit("章")).alias("directory"),
        F.when(F.col("_next").isNotNull(), F.col("end") + 1).alias("next_start"))


def check_ends(plan: DataFrame, chapters: DataFrame, ends: Sequence[int]) -> DataFrame:
    """Books for which explicit ends miss the last chapter or start before the first."""
    b = chapters.groupBy("book_id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return b.where((F.col("hi") != int(ends[-1])) | (F.col("lo") > int(ends[0])))


def audit_plan(plan: DataFrame, chapters: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Per book: does the plan tile its index without gap, overlap or lost characters?"""
    near = ordered_scan(plan, ["book_id"], "start", behind={"_prev": F.col("end")}, bits=bits)
    seen = near.groupBy("book_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.sum("chapters").alias("planned"), F.sum("chars").alias("planned_chars"),
        F.count_if(F.col("start") != F.col("_prev") + 1).alias("breaks"))
    want = chapters.groupBy("book_id").agg(
        F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("chapters"),
        F.sum("chars").alias("chars"))
    ok = ((F.col("breaks") == 0) & (F.col("start") == F.col("lo")) & (F.col("end") == F.col("hi"))
          & (F.col("planned") == F.col("chapters")) & (F.col("planned_chars") == F.col("chars")))
    return want.join(seen, "book_id", "left").select(
        "book_id", "breaks", "planned", "chapters", "planned_chars", "chars",
        F.coalesce(ok, F.lit(False)).alias("passed"))


def resume_point(accepted: DataFrame) -> DataFrame:
    """Next chapter to read: one past the last accepted segment."""
    return accepted.groupBy("book_id").agg((F.max("end") + 1).alias("resume_at"))


# -- source files ---------------------------------------------------------
def locate_sources(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows with the best matching source path, or null.

    ``files`` holds (book_id, path).  Candidates in order: the recorded path,
    its base name, ``第NNNN章*.txt``, ``第N章*.txt``, ``NNNN*.txt``.  Each rule
    is an equi join on a key derived from either side.
    """
    def keyed(kind, key):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    def zero4(n):
        s = n.cast("string")
        return F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s)

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    text = name.rlike(r"(?i)\.txt$")
    in_book = F.nullif(F.regexp_extract(name, "^第([0-9]+)章", 1), F.lit(""))
    digits = F.regexp_extract(name, "^([0-9]+)", 1)
    heads = F.transform(F.filter(F.sequence(F.lit(4), F.lit(10)), lambda n: n <= F.length(digits)),
                        lambda n: keyed("head", F.substring(digits, F.lit(1), n)))
    have = files.select("book_id", "path", F.explode(F.concat(
        F.array(keyed("path", F.col("path")), keyed("name", name)),
        F.when(text & in_book.isNotNull(), F.array(keyed("number", in_book))).otherwise(F.array()),
        F.when(text, heads).otherwise(F.array()))).alias("k")).select("book_id", "path", "k.*")

    def wanted(prio, kind, key):
        return F.struct(F.lit(prio).alias("prio"), F.lit(kind).alias("kind"), key.alias("key"))

    given = F.nullif(F.col("file"), F.lit(""))
    need = chapters.select("book_id", "idx", F.explode(F.array(
        wanted(0, "path", given), wanted(1, "name", F.regexp_extract(given, r"([^/]*)$", 1)),
        wanted(2, "number", zero4(F.col("idx"))), wanted(3, "number", F.col("idx").cast("string")),
        wanted(4, "head", zero4(F.col("idx"))))).alias("w")).select("book_id", "idx", "w.*")
    best = (need.where("key is not null").join(have, ["book_id", "kind", "key"])
            .groupBy("book_id", "idx").agg(F.min_by("path", F.struct("prio", "path")).alias("path")))
    return chapters.join(best, ["book_id", "idx"], "left")
