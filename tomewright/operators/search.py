"""A written index of search strings: a query reads the postings of its trigrams instead of every card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.operators.catalog import search_hit

POSTINGS = 16_384       # card numbers in one row of postings at most


def write_search_index(cards: DataFrame, path: str, book_search: str = "book") -> None:
    """Cards under numbers of their own, and for each trigram of their two search strings the numbers that have it.

    Postings are cut into rows of one trigram and one stretch of numbers, so a
    trigram of every card is many rows of bounded size; they are sorted, so
    a search skips files and row groups by their statistics.  Null strings hold no trigram.
    """
    # written at once, as the numbers are made by the partitions of this very job
    cards.withColumn("_card", F.monotonically_increasing_id()).write.parquet(f"{path}/cards")
    numbered = cards.sparkSession.read.parquet(f"{path}/cards")
    grams = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1))
    rows = numbered.select("_card", F.explode(F.array_union(grams(book_search), grams("search"))).alias("gram"))
    posts = rows.groupBy("gram", F.expr(f"_card div {POSTINGS}").alias("stretch")).agg(F.array_sort(F.collect_list("_card")).alias("cards"))
    posts.repartitionByRange("gram", "stretch").sortWithinPartitions("gram", "stretch").write.parquet(f"{path}/postings")


def search_index(spark: SparkSession, path: str, query: str, book_search: str = "book") -> DataFrame:
    """The cards that ``shelf_search`` finds, from a written index.

    Stretches that lack a trigram of the query drop out, in the others the
    postings are intersected, and the cards that are left are compared whole.
    Queries of less than three characters read all cards.
    """
    cards = spark.read.parquet(f"{path}/cards")
    q = query.strip().lower()
    if len(q) < 3:
        found = cards if not q else cards.where(search_hit(q, book_search))
        return found.drop("_card")
    grams = sorted({q[i:i + 3] for i in range(len(q) - 2)})
    posts = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(grams))
    both = posts.groupBy("stretch").agg(F.collect_list("cards").alias("lists")).where(F.size("lists") == len(grams))
    left = F.aggregate(F.slice("lists", 2, len(grams)), F.get("lists", F.lit(0)), F.array_intersect)
    hits = both.select(F.explode(left).alias("_card"))
    return cards.join(hits, "_card", "left_semi").where(search_hit(q, book_search)).drop("_card")
