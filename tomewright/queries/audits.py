"""State snapshots, spoilers, cards, repeated chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright.operators import audit as A
from tomewright.plans.reading import plan_batches
from tomewright.queries.base import IX, documents, index, sql_norm
from tomewright.queries.planning import PARTS, _digest_parts
from tomewright.functions import text as T
from tomewright.sources.tables import read_table

BEFORE = "2024-01-02 00:00:00"
# the column has no time zone, and neither has this
MICROS = ("cast(cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6)) "
          "* 1000000 as bigint)")


def asof_state(spark, d):
    e = read_table(spark, d, "events").select(F.col("user_id").alias("entity"), "ts", "event_id",
                                              F.col("event_type").alias("state"))
    return A.asof_state(e, F.lit(BEFORE).cast("timestamp_ntz"), "ts", "state", ("entity",), "event_id")


def asof_states(spark, d):
    """State of every user at each of their errors, from the other events before it."""
    e = read_table(spark, d, "events").select(
        F.lit("log").alias("book_id"), F.col("user_id").alias("entity"), F.expr(MICROS).alias("ch"),
        F.col("event_type").alias("state"))
    points = e.where("state = 'error'").select("book_id", "entity", "ch")
    return A.asof_states(e.where("state <> 'error'"), points)


def spoiler_leaks(spark, d):
    return A.spoiler_leaks(_digest_parts(spark, d), index(spark, d), 20)


def _cards(spark, d):
    return index(spark, d).join(read_table(spark, d, "labels", "doc_id"), "doc_id", "left_semi").select("book_id", "idx")


def missing_cards(spark, d):
    return A.missing_cards(index(spark, d), _cards(spark, d)).select("book_id", "idx", "title")


def card_counts(spark, d):
    return A.card_counts(index(spark, d), _cards(spark, d))


def redo_batches(spark, d):
    ix = index(spark, d)
    return A.redo_batches(A.missing_cards(ix, _cards(spark, d)), plan_batches(ix, 12), 12)


def duplicate_chapters(spark, d):
    t = documents(spark, d).select(F.col("source").alias("book_id"), F.col("doc_id").alias("idx"),
                                   T.normalize(F.col("text")).alias("norm"))
    return A.duplicate_chapters(t).drop("digest")


def repeated_across_books(spark, d):
    """The same check over the whole corpus read as one book."""
    t = documents(spark, d).select(F.lit("all").alias("book_id"), F.col("doc_id").alias("idx"), "text")
    return A.duplicate_chapters(t, "text").drop("digest")


_CARD = f"""WITH {IX}, c AS (SELECT ix.*, l.doc_id IS NOT NULL AS has FROM ix LEFT JOIN labels l USING (doc_id))"""

QUERIES = {
    "asof_state": (asof_state, f"""SELECT user_id AS entity, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS as_of
      FROM events WHERE ts < TIMESTAMP '{BEFORE}' GROUP BY user_id"""),
    "asof_states": (asof_states, """SELECT 'log' AS book_id, p.user_id AS entity, epoch_us(p.ts) AS ch, s.event_type AS state
      FROM (SELECT * FROM events WHERE event_type = 'error') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') s
      ON p.user_id = s.user_id AND p.ts > s.ts"""),
    "spoiler_leaks": (spoiler_leaks, PARTS + """ SELECT r.book_id, 'digest' AS doc_id, r.ch,
      CASE WHEN ch = 20 THEN 'info' ELSE 'leak' END AS kind FROM refs r
      WHERE ch >= 20 AND ch <= (SELECT max(idx) FROM ix WHERE ix.book_id = r.book_id)"""),
    "missing_cards": (missing_cards, _CARD + " SELECT book_id, idx, title FROM c WHERE NOT has"),
    "card_counts": (card_counts, _CARD + """ SELECT book_id, count(*) AS chapters, count(CASE WHEN has THEN 1 END) AS cards,
      bool_and(has) AS complete FROM c GROUP BY book_id"""),
    "redo_batches": (redo_batches, _CARD + """ SELECT book_id, (idx - 1) // 12 + 1 AS batch, min(idx) AS start, max(idx) AS "end",
      count(CASE WHEN NOT has THEN 1 END) AS missing FROM c GROUP BY 1, 2 HAVING count(CASE WHEN NOT has THEN 1 END) > 0"""),
    "duplicate_chapters": (duplicate_chapters, f"""SELECT source AS book_id, doc_id AS idx,
      min(doc_id) OVER w AS first_idx, count(*) OVER w AS copies FROM documents
      WINDOW w AS (PARTITION BY source, {sql_norm('text')}) QUALIFY count(*) OVER w > 1"""),
    "repeated_across_books": (repeated_across_books, """SELECT 'all' AS book_id, doc_id AS idx, min(doc_id) OVER w AS first_idx,
      count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text) QUALIFY count(*) OVER w > 1"""),
}
