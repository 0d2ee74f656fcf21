"""State snapshots, spoilers, missing cards, work to redo, repeated chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.functions import text as T
from tomewright.operators.coverage import extract_refs
from tomewright.operators.ordered import BLOCK_BITS, ordered_scan


def asof_state(states: DataFrame, before, order: str = "ch", state: str = "state",
               keys: tuple[str, ...] = ("book_id", "entity"), tie: str | None = None) -> DataFrame:
    """Latest state of each entity strictly before ``before``; the filter reaches the scan."""
    by = F.struct(order, tie) if tie else F.col(order)
    return states.where(F.col(order) < before).groupBy(*keys).agg(
        F.max_by(state, by).alias("state"), F.max(order).alias("as_of"))


def asof_states(states: DataFrame, points: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """State of every (book_id, entity) at many points at once: book_id, entity, ch, state.

    Points and states are merged into one ordered scan instead of a range join.
    """
    keys = ["book_id", "entity"]
    s = states.select(*keys, F.col("ch").cast("long").alias("ch"), F.lit(1).alias("_side"), "state")
    p = points.select(*keys, F.col("ch").cast("long").alias("ch"), F.lit(0).alias("_side"),
                      F.lit(None).cast(states.schema["state"].dataType).alias("state"))
    # at equal chapters the point comes first, so it sees earlier chapters only
    merged = ordered_scan(s.unionByName(p), keys, "ch", carry={"_s": F.col("state")}, ties=["_side"], bits=bits)
    return merged.where("_side = 0").select(*keys, "ch", F.col("_s").alias("state"))


def spoiler_leaks(docs: DataFrame, chapters: DataFrame, start: int) -> DataFrame:
    """References of a bridge document at or behind its start chapter: 'info' for the start, 'leak' after it."""
    return (extract_refs(docs, chapters).where(F.col("ch") >= start)
            .withColumn("kind", F.when(F.col("ch") == start, "info").otherwise("leak")))


def missing_cards(chapters: DataFrame, cards: DataFrame) -> DataFrame:
    """Index chapters without a card."""
    return chapters.join(cards.select("book_id", "idx").distinct(), ["book_id", "idx"], "left_anti")


def card_counts(chapters: DataFrame, cards: DataFrame) -> DataFrame:
    """Chapters and cards per book and whether every chapter has one."""
    have = cards.select("book_id", "idx").distinct().withColumn("_c", F.lit(1))
    return (chapters.join(have, ["book_id", "idx"], "left").groupBy("book_id")
            .agg(F.count("*").alias("chapters"), F.count("_c").alias("cards"))
            .withColumn("complete", F.col("chapters") == F.col("cards")))


def redo_batches(missing: DataFrame, batches: DataFrame, size: int) -> DataFrame:
    """Grid batches that hold a missing chapter: book_id, batch, start, end, missing.

    The batch number follows from the chapter number, so this is an equi join.
    """
    m = (missing.withColumn("batch", F.expr(f"(cast(idx as bigint) - 1) div {int(size)} + 1"))
         .groupBy("book_id", "batch").agg(F.count("*").alias("missing")))
    return batches.join(m, ["book_id", "batch"]).select("book_id", "batch", "start", "end", "missing")


def duplicate_chapters(chapter_text: DataFrame, text: str = "norm") -> DataFrame:
    """Chapters whose comparison text occurs more than once in their book: book_id, idx, digest, first_idx, copies.

    Only digests are grouped; the members are joined back, so a text repeated
    a million times is counted but never collected into one row.
    """
    d = chapter_text.select("book_id", "idx", F.sha2(F.col(text), 256).alias("digest"))
    groups = d.groupBy("book_id", "digest").agg(F.count("*").alias("copies"), F.min("idx").alias("first_idx")) \
        .where("copies > 1")
    return d.join(groups, ["book_id", "digest"]).select("book_id", "idx", "digest", "first_idx", "copies")


def with_norm(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("norm", T.normalize(F.col(text)))
