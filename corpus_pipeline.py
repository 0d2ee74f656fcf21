"""From raw documents to token ids: toxicity, near duplicates, repeated strings, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next one's
``docs``.  All stages but the last return the columns of ``documents``; the
last returns one row per document of the mix with its token count and digests.
An empty table passes through; nulls are treated as the operators state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import mixing, pieces, probminhash, suffixes, toxicity
from tomewright.llm.common import table
from tomewright.session import cut_lineage

TOXIC = 0.3                 # a document at or above this score goes


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pattern score stays below TOXIC."""
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = f"score_{uuid.uuid4().hex}"         # no column of the documents is called so
    return toxicity.with_score(docs, grammar, score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stands for each near-duplicate class; rows without an id stay.

    Unequal texts of one id are judged each by its own; of rows equal in id and
    text one stays.
    """
    stay = cut_lineage(probminhash.classes(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("k"), F.col("copy").alias("c")))
    once = stay.distinct()
    mine = docs["doc_id"].cast("long")
    kept = docs.join(once, (mine == once["k"]) & (probminhash.copy_of(mine, docs["text"]) == once["c"]), "left_semi")
    if not stay.groupBy("k", "c").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that stand earlier."""
    return suffixes.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    import public_tokenizers
    return pieces.digest_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("suffix_array_dedup", drop_repeated_strings),
          ("mixing", mix_sources), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None           # toxicity, ProbMinHash and BPE have no SQL form; tested by brute force
