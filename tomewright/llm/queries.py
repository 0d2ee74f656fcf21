"""One query per operator, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.common import remainder, table
from tomewright.session import new_folder


def op5_chat(spark: SparkSession, d: str) -> DataFrame:
    """Format all conversations (and number -7, made of control strings) and read the output back."""
    from tomewright.llm import chat
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(odd).alias("text"))
    ex = chat.format_conversations(rows.unionByName(extra))
    turns = chat.read_turns(F.col("text"))
    ex = ex.select("conv_id", "example", "last", F.length("text").alias("chars"),
                   chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
                   F.when(F.col("last"), turns).alias("turns"))
    # one row per example of a conversation; texts of one conversation only
    conv = ex.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.max("turns").alias("turns"), F.sum("chars").alias("chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return conv.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                       F.col("chars").cast("long").alias("formatted_chars"))


OP5 = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k,
  count(*) OVER (PARTITION BY conv_id) AS m,
  13 + 1 + length(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>'))
    + length(role) - length(replace(role, chr(10), ''))
    + length(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>')) AS f FROM t),
c AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = m THEN upto END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


def op7_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Words taken from each document when all documents are mixed to 150 % of their words."""
    from tomewright.llm import mixing
    rows = mixing.with_copies(table(spark, d, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7 = r"""WITH d AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
  source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / w AS ratio FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
  sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS everything FROM s2),
lv AS (SELECT arg_min((everything - full_) / rest, (ratio, (everything - full_) / rest)) AS v FROM s3
  WHERE (everything - full_) / rest <= ratio),
s AS (SELECT source, source_size, coalesce(least(cap, v * w), cap) AS target FROM s3, lv),
j AS (SELECT d.doc_id, d.size, s.source_size, s.target,
  CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM j"""


def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    """Write all pages as WARC records and read the archives back."""
    from tomewright.llm import warc
    path = new_folder(spark)
    warc.write_archive(table(spark, d, "pages"), path)
    r = warc.read_archive(spark, path).where("status = 'record'")
    return r.select(F.expr("try_cast(page_id AS BIGINT)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"))


def op9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Encode and decode every text with the public 32k BPE model."""
    import public_tokenizers
    from tomewright.llm import pieces
    return pieces.digest_texts(table(spark, d, "documents").select("doc_id", "text"),
                               public_tokenizers.path("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every whole text by the pattern grammar."""
    from tomewright.llm import toxicity
    docs = table(spark, d, "documents")
    g = toxicity.learn(docs, table(spark, d, "labels"))
    r = toxicity.with_score(docs.select("doc_id", "text"), g)
    return r.select("doc_id", (remainder(4) == 2).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op1_forest(spark: SparkSession, d: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.98 within their label."""
    from tomewright.llm import forest
    return forest.near_vectors(table(spark, d, "embeddings").select("vec_id", "embedding", "label"))


OP1 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links,
  least(m.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = m.vec_id), m.vec_id)) AS component_id,
  m.vec_id <= coalesce((SELECT min(b) FROM r WHERE r.a = m.vec_id), m.vec_id) AS kept FROM embeddings m"""


def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every whole text by attention over its passages."""
    from tomewright.llm import attention
    docs = table(spark, d, "documents")
    model = attention.learn(docs, table(spark, d, "labels"))
    r = attention.with_score(docs.select("doc_id", "text"), model)
    return r.select("doc_id", (remainder(3) == 1).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_probminhash(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from tomewright.llm import probminhash
    return probminhash.classes(table(spark, d, "documents")).select("doc_id", "class_id", "kept")


def op6_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that stand earlier."""
    from tomewright.llm import suffixes
    return suffixes.digest_kept(table(spark, d, "documents").select("doc_id", "text"))


def op8_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rule statistics of every whole text and the verdict of base rules and isolation forest."""
    from tomewright.llm import rules
    docs = table(spark, d, "documents")
    r = rules.judge(docs.select("doc_id", "text"), rules.learn(docs, table(spark, d, "labels")))
    return r.select("doc_id", *rules.COUNTS, "base_failed", "kept", "anomaly")


def op11_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Encode and decode every text with the public 49k BPE of words, frequent ones by transducer."""
    import public_tokenizers
    from tomewright.llm import lexicon
    docs, model = table(spark, d, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")
    return lexicon.digest_texts(docs, model, lexicon.compile_lexicon(spark, lexicon.count_words(docs, model), model))


def op12_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Hard negatives of every hundredth vector, labels of every seventh moved on by one."""
    from tomewright.llm import negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, d, "embeddings").select("vec_id", "embedding", label.alias("label")),
                                    F.col("vec_id") % 100 == 0)


OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS a, a.lab AS la, b.vec_id AS b, b.lab AS lb, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS "rank",
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND s.la <> s.lb AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 10"""


def op13_periods(spark: SparkSession, d: str) -> DataFrame:
    """Periodic runs of every whole text; every tenth document (by crc32 of its id) has a repeated tail.

    A document without an id keeps its text.
    """
    from tomewright.llm import periods
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(w):
        n = F.size(w).cast("long")
        a = F.when(n > 0, g % n).otherwise(0)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        again = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int"))), " ")
    found = F.array(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)")))
    text = F.when(h % 10 == 0, F.transform(found, tail)[0]).otherwise(F.col("text"))
    r = periods.with_runs(table(spark, d, "documents").select("doc_id", text.alias("text"))).drop("text")
    none = F.expr("CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>)")
    best = F.aggregate("runs", none, lambda acc, x: F.when(
        acc.isNull() | (x["length"] * acc["period"] > acc["length"] * x["period"]), x).otherwise(acc))
    lines = F.transform("runs", lambda x: F.concat_ws(",", *[x[k].cast("string") for k in ("start", "length", "period")]))
    lines = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    r = r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"),
                 F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return r.select("doc_id", "n_runs", "b.start", "b.length", "b.period",
                    F.expr("(1000 * b.length) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_forest": (op1_forest, OP1),
    "op2_quality": (op2_quality, None),
    "op3_warc": (op3_warc, None),
    "op5_chat": (op5_chat, OP5),
    "op7_mixing": (op7_mixing, OP7),
    "op4_probminhash": (op4_probminhash, None),
    "op6_suffixes": (op6_suffixes, None),
    "op8_rules": (op8_rules, None),
    "op9_pieces": (op9_pieces, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_lexicon": (op11_lexicon, None),
    "op12_negatives": (op12_negatives, OP12),
    "op13_periods": (op13_periods, None),
}
