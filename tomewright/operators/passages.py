"""Exact location of text passages in a corpus, without a nested loop.

A text is cut into blocks that overlap by the length of the longest passage;
passages are found by window-minimiser fingerprints (see ``fingerprints``).
The passages are counted first: while their number stays below a fixed bound
they are broadcast and the blocks stream past them; more are looked up by an
equi join of fingerprints, about one for eight characters of the corpus,
written for the call or read from a stored index.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tomewright.operators import fingerprints as FP
from tomewright.operators.ordered import ordered_scan
from tomewright.session import cut_lineage

BLOCK = 4096            # characters owned by a block
CHUNK = 1024            # longer passages are matched chunk by chunk
BROADCAST_PROBES = 500_000
BROADCAST_SPANS = 500_000
SPAN_SHARDS = 4                 # broadcast shards of spans; more are joined by shuffle
SCOPED_SHARDS = 64              # shards of passages that stream past their own scopes


def _overlapping(block: int, overlap: int) -> str:
    return f"(?s)(?=(.{{1,{block + overlap}}})).{{1,{block}}}"


def text_blocks(docs: DataFrame, place: Sequence[str], text: str = "norm") -> DataFrame:
    """(place, base, block): every block also carries the next CHUNK characters."""
    cut = F.regexp_extract_all(F.col(text), F.lit(_overlapping(BLOCK, CHUNK)), F.lit(1))
    return (docs.select(*place, F.posexplode_outer(cut).alias("_i", "block")).where("_i is not null")
            .select(*place, (F.col("_i").cast("long") * BLOCK).alias("base"), "block"))


def flat_spans(chapter_text: DataFrame, bits: int = 16) -> DataFrame:
    """Where each chapter lies in the concatenated comparison text of its book.

    Lengths are written once, so the text is not normalised again for every
    branch of the scan.
    """
    n = cut_lineage(chapter_text.select("book_id", F.col("idx").cast("long").alias("idx"),
                                        F.length("norm").cast("long").alias("_n")))
    return (ordered_scan(n, ["book_id"], "idx", total={"norm_start": F.col("_n")}, bits=bits, written=True)
            .select("book_id", "idx", "norm_start", (F.col("norm_start") + F.col("_n")).alias("norm_end")))


def flat_blocks(chapter_text: DataFrame, spans: DataFrame, broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """(book_id, base, block) over the text of each book read as one string.

    A match may run across chapter borders.  Chapters are cut at the block
    grid of their book and regrouped by block, so a group never exceeds
    BLOCK + CHUNK characters however large the book is.  The table can be
    written once and reused for every audit of the same text.

    ``spans`` (narrow; best a written table) is counted: few are broadcast, so
    the text moves once, to its block; up to SPAN_SHARDS times as many are
    broadcast in shards, each met by its share of the chapters; more are joined
    by shuffle.
    """
    shards = math.ceil(spans.count() / broadcast_spans) if broadcast_spans else SPAN_SHARDS + 1
    texts = chapter_text.select("book_id", F.col("idx").cast("long").alias("idx"), "norm")
    at = ["book_id", "idx"]
    if shards > SPAN_SHARDS:
        t = texts.join(spans, at)
    else:
        own = lambda df, k: df if shards < 2 else df.where(F.pmod(F.xxhash64(*at), F.lit(shards)) == k)
        t = own(texts, 0).join(F.broadcast(own(spans, 0)), at)
        for k in range(1, shards):
            t = t.unionByName(own(texts, k).join(F.broadcast(own(spans, k)), at))
    t = t.where("norm_end > norm_start")
    first = (F.lit(BLOCK) - F.col("norm_start") % BLOCK).cast("int")
    rest = F.substring(F.col("norm"), first + 1, F.length("norm"))
    cut = F.concat(F.array(F.substring(F.col("norm"), F.lit(1), first)),
                   F.regexp_extract_all(rest, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    grid = F.expr(f"norm_start div {BLOCK}")
    p = (t.select("book_id", grid.alias("_g"), (F.col("norm_start") % BLOCK).alias("_o"),
                  F.posexplode_outer(cut).alias("_i", "piece"))
         .select("book_id", (F.col("_g") + F.col("_i")).alias("blk"),
                 F.when(F.col("_i") == 0, F.col("_o")).otherwise(0).alias("off"), "piece"))
    own = F.struct("blk", "off", "piece")
    tail = F.struct((F.col("blk") - 1).alias("blk"), (F.col("off") + BLOCK).alias("off"),
                    F.substring(F.col("piece"), F.lit(1), (F.lit(CHUNK) - F.col("off")).cast("int")).alias("piece"))
    parts = p.select("book_id", F.explode(F.when((F.col("off") < CHUNK) & (F.col("blk") > 0),
                                                 F.array(own, tail)).otherwise(F.array(own))).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.off", "x.piece"))),
                                      lambda x: x["piece"]), "")
    return (parts.groupBy("book_id", F.col("x.blk").alias("_b")).agg(joined.alias("block"))
            .select("book_id", (F.col("_b") * BLOCK).alias("base"), "block")
            # a trailing overlap without own text is no block of its own
            .where(F.length("block") > 0))


def _chunks(segments: DataFrame, keys: list[str], seg: str) -> DataFrame:
    """One row per chunk: keys, off (0-based), chunk, n_chunks, k."""
    n = F.length(seg)
    segments = segments.where(n > 0)
    starts = F.when(n <= CHUNK, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), n - CHUNK, F.lit(CHUNK)), F.array(n - CHUNK))))
    rows = segments.select(*keys, F.col(seg).alias("_s"), starts.alias("_at"))
    # outer: no inferred size() filter below, which would normalise the text again
    rows = rows.select(*keys, "_s", F.size("_at").alias("n_chunks"), F.explode_outer("_at").alias("off"))
    rows = rows.select(*keys, "n_chunks", "off", F.substring(
        F.col("_s"), F.col("off") + 1, F.lit(CHUNK)).alias("chunk"))
    return rows


def _scoped_shards(described: DataFrame, blocks: DataFrame, scope: list[str], shards: int, most: int):
    """(passages, blocks) per shard: passages in the order of their scopes, blocks of the scopes between its first and its last."""
    dealt = cut_lineage(described.where(" and ".join(f"`{s}` is not null" for s in scope)).repartitionByRange(8 * shards, *scope, "whole")
                        .withColumn("_part", F.spark_partition_id()))
    first = scope[0]
    parts = dealt.groupBy("_part").agg(F.count("*").alias("n"), F.min(first).alias("a"), F.max(first).alias("b")).orderBy("_part").collect()
    groups: list[list] = []
    for p in parts:                                 # neighbours are put together up to the bound of a broadcast
        if groups and sum(q["n"] for q in groups[-1]) + p["n"] <= most:
            groups[-1].append(p)
        else:
            groups.append([p])
    for g in groups or [[]]:
        own = dealt.where(F.col("_part").between(g[0]["_part"], g[-1]["_part"]) if g else F.lit(False)).drop("_part")
        yield own, blocks.where(F.col(first).between(g[0]["a"], g[-1]["b"])) if g else blocks.limit(0)


def find_segments(blocks: DataFrame, segments: DataFrame, keys: Sequence[str], place: Sequence[str],
                  scope: Sequence[str] = (), seg: str = "seg",
                  broadcast_probes: int = BROADCAST_PROBES, index: FP.PassageIndex | None = None, most: int | None = None) -> DataFrame:
    """All occurrences: keys, place, pos (0-based start).

    With ``most`` the occurrences of a passage of up to CHUNK characters are
    listed as far as a task finds no more than that; a column ``more`` is true
    in rows that hold the least of those left out (its place columns are null).

    ``scope`` columns (a subset of place that also exists in ``segments``)
    restrict the search.  Empty passages occur nowhere.  The passages are
    counted: up to ``broadcast_probes`` are broadcast, as hashes that tasks
    make of them, and the corpus is streamed once, never shuffled.  More that
    have a scope go by in shards of that size, ordered by scope, and each shard
    meets the texts of its own scopes only (``blocks`` should be a written
    table).  Others, and those of over SCOPED_SHARDS shards, are joined with the
    fingerprints of the corpus, those of ``index`` if given; passages too short
    to have any go by in shards of that size, one pass over the corpus each.
    """
    keys, place, scope = list(keys), list(place), list(scope)
    carried = keys + [s for s in scope if s not in keys]
    out = [*keys, *[p for p in place if p not in keys]]
    chunks = _chunks(segments, carried, seg)
    brief = F.length("chunk") < FP.SHORT
    n = chunks.agg(F.count("*").alias("n"), F.max("n_chunks").alias("most"), F.count_if(brief).alias("short")).first()
    shards = max(math.ceil(n["n"] / max(broadcast_probes, 1)), 1)
    passed = [*keys, *([] if (n["most"] or 1) == 1 else ["n_chunks", "off"])]

    def described(mine: DataFrame) -> DataFrame:
        return FP.described(mine, "chunk", [*dict.fromkeys([*passed, *scope])])

    def streamed(mine: DataFrame, blocks: DataFrame = blocks) -> DataFrame:
        fields = [mine.schema[c] for c in passed] + [blocks.schema[p] for p in place if p not in passed] + [StructField("pos", LongType())]
        fields += [] if most is None else [StructField("more", BooleanType())]
        return FP.scan(blocks, FP.Probes(mine.toArrow(), scope, passed), place, scope, BLOCK, StructType([StructField(f.name, f.dataType) for f in fields]), most)
    own = index is None and scope and broadcast_probes and shards <= SCOPED_SHARDS
    if own and most is not None and (n["most"] or 1) > 1:
        # what long passages share is found once: they go by as distinct chunks
        long = cut_lineage(chunks.where("n_chunks > 1"), "zstd")
        once = cut_lineage(long.select(*scope, "chunk").distinct().withColumn("cid", F.monotonically_increasing_id()), "zstd")
        alone = chunks.where("n_chunks = 1").withColumn("cid", F.lit(None).cast("long"))
        passed = [*keys, "cid"]
        chunks = alone.select(*dict.fromkeys([*keys, *scope, "cid", "chunk"])).unionByName(once, allowMissingColumns=True)
    if index is None and shards == 1 and broadcast_probes:
        hit = streamed(described(chunks))
    elif own:
        hit = None
        for mine, near in _scoped_shards(described(chunks), blocks, scope, shards, broadcast_probes):
            found = cut_lineage(streamed(mine, near))       # one shard of passages is held at a time
            hit = found if hit is None else hit.unionByName(found)
    else:
        chunks = cut_lineage(chunks.withColumn("id", F.monotonically_increasing_id()))
        if index is None:
            postings = cut_lineage(FP._prints(blocks, "block", [*place, "base"]))
            heavy = cut_lineage(FP.heavy_prints(postings))
        else:
            postings, heavy = index.postings(), index.heavy()
        long = chunks.where(~brief)
        found = FP.lookup(postings, heavy, blocks, long, place, scope, BLOCK).drop(*[c for c in place if c in keys])
        hit = found.join(long.select("id", *keys, "n_chunks", "off"), "id").drop("id")
        parts = math.ceil(shards * n["short"] / max(n["n"], 1)) if n["short"] else 0
        for k in range(parts):
            some = streamed(described(chunks.where(brief & (F.pmod(F.xxhash64("id"), F.lit(parts)) == k))))
            if most is not None and "more" not in hit.columns:
                hit = hit.withColumn("more", F.lit(False))
            hit = hit.unionByName(some.select(*out, "pos", *([] if most is None else ["more"]), *[c if c in some.columns else F.lit(v).alias(c)
                                                             for c, v in (("n_chunks", 1), ("off", 0))]))
    shown = [*out, "pos"]
    if most is not None:
        shown.append("more")
        hit = hit if "more" in hit.columns else hit.withColumn("more", F.lit(False))
    if (n["most"] or 1) == 1:
        return hit.select(*shown)
    if "cid" in hit.columns:
        hit = cut_lineage(hit)
        parts = long.join(once, [*scope, "chunk"]).select(*keys, "n_chunks", "off", "cid")
        return hit.where("cid is null").select(*shown).unionByName(_whole(parts, hit.where("cid is not null"), keys, place).withColumn("more", F.lit(False)).select(*shown))
    # a long passage occurs where all of its chunks do
    once = ["more"] if most is not None else []
    return (hit.withColumn("pos", F.col("pos") - F.col("off")).groupBy(*out, "pos", "n_chunks", *once).agg(F.count("*").alias("_n"))
            .where("_n = n_chunks").select(*shown))


def _whole(parts: DataFrame, hits: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """Where the passages whose chunks are ``parts`` (keys, n_chunks, off, cid) occur, by the places (cid, place, pos) of the chunks.

    Only the places of its rarest chunk are compared with the others, so
    passages that share most of their chunks do not meet each other's places.
    """
    at = [p for p in place if p not in keys]
    parts = cut_lineage(parts.join(hits.groupBy("cid").agg(F.count(F.lit(1)).alias("_n")), "cid", "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
    lead = parts.groupBy(*keys).agg(F.min(F.struct("_n", "off", "cid")).alias("m")).where("m._n > 0").select(*keys, F.col("m.off").alias("_o"), F.col("m.cid").alias("cid"))
    cand = lead.join(hits.select("cid", *at, "pos"), "cid").select(*keys, *at, (F.col("pos") - F.col("_o")).alias("start")).where("start >= 0")
    each = cand.join(parts, keys).select(*keys, *at, "start", "n_chunks", "cid", (F.col("start") + F.col("off")).alias("pos"))
    h = hits.select(F.col("cid").alias("_c"), F.col("pos").alias("_p"), *[F.col(a).alias(f"_{a}") for a in at])
    same = (F.col("cid") == F.col("_c")) & (F.col("pos") == F.col("_p"))
    for a in at:
        same &= F.col(a).eqNullSafe(F.col(f"_{a}"))
    return (each.join(h, same, "left_semi").groupBy(*keys, *at, "start", "n_chunks").agg(F.count("*").alias("_n"))
            .where("_n = n_chunks").withColumnRenamed("start", "pos"))


def find_passages(passages: DataFrame, corpus: DataFrame, passage_key: str, place: Sequence[str],
                  text: str = "norm", broadcast_probes: int = BROADCAST_PROBES) -> DataFrame:
    """Verbatim occurrences of passages anywhere in a corpus.

    Both inputs carry their comparison text in ``text``.  Returns one row per
    (passage, place) with the first position and the number of occurrences.
    """
    hits = find_segments(text_blocks(corpus, place, text), passages.select(passage_key, F.col(text).alias("seg")),
                         [passage_key], place, broadcast_probes=broadcast_probes)
    return hits.groupBy(passage_key, *place).agg(F.min("pos").alias("pos"), F.count("*").alias("hits"))
