"""Views of the given tables that the queries share, with their SQL counterparts.

``documents.source`` is the book and a document its chapter.  Documents also
serve as raw books and as digests: their lines are rewritten in place (row by
row) into the text conventions the operators read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions import text as T
from tomewright.operators.ordered import ordered_scan
from tomewright.sources.tables import read_table, spread


def documents(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Documents with their text, spread over the cores."""
    return spread(read_table(spark, d, "documents", *(cols or ("doc_id", "source", "text"))))


# -- chapter index: idx counts the documents of a source -------------------
def index(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select(
        F.col("source").alias("book_id"), "doc_id", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"),
        F.col("n_chars").alias("chars"))
    return (ordered_scan(rows, ["book_id"], "doc_id", total={"_n": F.lit(1)})
            .withColumn("idx", F.col("_n") + 1).drop("_n"))


IX = """ix AS (SELECT source AS book_id, doc_id, 't' || doc_id AS title, n_chars AS chars,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx FROM documents)"""


def chapter_norms(spark: SparkSession, d: str) -> DataFrame:
    """Comparison text per chapter, numbered by document id (unique and ordered in its book)."""
    return documents(spark, d).select(F.col("source").alias("book_id"), F.col("doc_id").alias("idx"),
                                      T.normalize(F.col("text")).alias("norm"))


DROP = "' ' || chr(9) || chr(10) || chr(13) || '\"' || chr(39) || '「」『』“”‘’《》〈〉'"


def sql_norm(c: str) -> str:
    return f"translate({c}, {DROP}, '')"


# -- lines ----------------------------------------------------------------
LN = """ln AS (SELECT doc_id, source AS book_id, unnest(string_split(text, chr(10))) AS l,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS i FROM documents)"""


def _rewrite(docs: DataFrame, rule) -> DataFrame:
    return docs.withColumn("text", F.array_join(F.transform(T.lines_of(F.col("text")), rule), "\n"))


def _s(c: Column) -> Column:
    return c.cast("string")


def _with_headings(docs: DataFrame) -> DataFrame:
    """A chapter heading before every fourth line of ``text``, some volumes."""
    def rule(l, i):
        return (F.when(i % 4 == 0, F.concat(F.lit("第"), _s((i / 4).cast("int") + 1), F.lit("章 题/"), _s(i), F.lit("\n"), l))
                .when(i % 20 == 10, F.concat(F.lit("第"), _s((i / 20).cast("int") + 1), F.lit("卷 风\n"), l))
                .otherwise(l))
    return _rewrite(docs, rule)


def raw_books(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a raw book (book_id = doc_id)."""
    return _with_headings(documents(spark, d).select(F.col("doc_id").alias("book_id"), "text"))


RAW_TEXT = LN + """,
rw AS (SELECT doc_id AS book_id, string_agg(CASE WHEN i % 4 = 0 THEN '第' || (i // 4 + 1) || '章 题/' || i || chr(10)
  WHEN i % 20 = 10 THEN '第' || (i // 20 + 1) || '卷 风' || chr(10) ELSE '' END || l, chr(10) ORDER BY i) AS t FROM ln GROUP BY doc_id)"""

CHAPTERS = """,
raw AS (SELECT book_id, unnest(string_split(t, chr(10))) AS h,
  CAST(generate_subscripts(string_split(t, chr(10)), 1) - 1 AS BIGINT) AS i FROM rw),
raws AS (SELECT *, regexp_replace(h, '^\\s+|\\s+$', '', 'g') AS s,
  CAST(coalesce(sum(length(h) + 1) OVER (PARTITION BY book_id ORDER BY i
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM raw),
kinds AS (SELECT *, CASE WHEN length(s) NOT BETWEEN 1 AND 50 OR contains(s, '。') THEN NULL
    WHEN regexp_matches(s, '^第[0-9]+卷') THEN 'volume'
    WHEN regexp_matches(s, '^第[0-9]+章') THEN 'chapter'
    WHEN regexp_matches(s, '^(Chapter|CHAPTER|Ch\\.|ch\\.)\\s*[0-9]{1,5}\\b') THEN 'latin'
    WHEN regexp_matches(s, '^[0-9]{1,4}\\s*[.、,，:：]?\\s+\\S') THEN 'numbered' END AS kind FROM raws),
txt AS (SELECT book_id, string_agg(h, chr(10) ORDER BY i) AS text FROM raw GROUP BY book_id),
heads AS (SELECT book_id, i, start, kind, CASE kind
    WHEN 'chapter' THEN regexp_replace(regexp_replace(s, '^(第[0-9]+章)\\s*(.*)$', '\\1 \\2'), '\\s+$', '')
    WHEN 'latin' THEN regexp_replace('Chapter ' || CAST(regexp_extract(s, '([0-9]{1,5})', 1) AS BIGINT) || ' '
      || regexp_extract(s, '^(?:Chapter|CHAPTER|Ch\\.|ch\\.)\\s*[0-9]{1,5}\\s*(.*)$', 1), '\\s+$', '')
    WHEN 'numbered' THEN regexp_extract(s, '^([0-9]{1,4})', 1) || '. '
      || regexp_extract(s, '^[0-9]{1,4}\\s*[.、,，:：]?\\s+(.*)$', 1)
    ELSE s END AS title,
  last_value(CASE WHEN kind = 'volume' THEN s END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vol FROM kinds WHERE kind IS NOT NULL),
chs AS (SELECT h.book_id, row_number() OVER w AS idx, h.title, h.start,
    coalesce(lead(h.start) OVER w, length(t.text)) AS "end", coalesce(h.vol, '') AS volume,
    count(*) OVER (PARTITION BY h.book_id) AS n, t.text
  FROM heads h JOIN txt t USING (book_id) WHERE h.kind <> 'volume'
  WINDOW w AS (PARTITION BY h.book_id ORDER BY h.i)),
good AS (SELECT book_id, CAST(idx AS BIGINT) AS idx, title, CAST(length(regexp_replace(
    substring(text, start + 1, "end" - start), '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS chars,
  start, CAST("end" AS BIGINT) AS "end", volume, false AS fallback,
  regexp_replace(substring(text, start + 1, "end" - start), '^\\s+|\\s+$', '', 'g') AS body FROM chs WHERE n >= 2),
chunks AS (SELECT t.book_id, CAST(g.p // 8000 + 1 AS BIGINT) AS idx,
    '分块' || (g.p // 8000 + 1) || '（自动，非真实章节）' AS title,
    CAST(least(8000, length(t.text) - g.p) AS BIGINT) AS chars, CAST(g.p AS BIGINT) AS start,
    CAST(least(g.p + 8000, length(t.text)) AS BIGINT) AS "end", '' AS volume, true AS fallback,
    substring(t.text, g.p + 1, 8000) AS body
  FROM txt t, LATERAL (SELECT unnest(generate_series(0, length(t.text) - 1, 8000)) AS p) g
  WHERE t.book_id NOT IN (SELECT book_id FROM chs WHERE n >= 2)),
chapters AS (SELECT * FROM good UNION ALL SELECT * FROM chunks)"""
RAW = RAW_TEXT + CHAPTERS


def books_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each source as one book whose parts are its raw books, in the order of their ids and with nothing between them."""
    return _with_headings(documents(spark, d).select(F.coalesce("source", F.lit("")).alias("book_id"), F.col("doc_id").alias("part_no"), "text"))


IN_PARTS = RAW_TEXT.replace("rw AS", "one AS") + """,
rw AS (SELECT coalesce(d.source, '') AS book_id, string_agg(o.t, '' ORDER BY o.book_id) AS t
  FROM one o JOIN documents d ON d.doc_id = o.book_id GROUP BY 1)"""


def digests(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a digest (book_id, doc_id, text): groups of six lines form a unit."""
    def rule(l, i):
        x = F.trim(l)
        g, r = (i / 6).cast("int"), i % 6
        return (F.when(r == 0, F.concat(F.lit("## 单元"), _s(g + 1), F.lit("｜"), x, F.lit("（第"),
                                        _s(i + 1), F.lit("–"), _s(i + 6), F.lit("章）")))
                .when(r == 1, F.concat(F.lit("- **第"), _s(i + 2), F.lit("章（详） t"), _s(i), F.lit("**："), x))
                .when(r == 2, F.concat(F.lit("- **第"), _s(i - 1), F.lit("–"), _s(i), F.lit("章（略）**："), x))
                .when(r == 3, F.concat(F.lit("**【原文·第"), _s(i), F.lit("章 甲】**")))
                .when(r == 4, F.concat(F.lit("> "), x)).otherwise(x))
    return _rewrite(documents(spark, d).select(F.col("source").alias("book_id"), "doc_id", "text"), rule)


DG = LN + """,
dg AS (SELECT book_id, doc_id, i, i // 6 AS g, i % 6 AS r,
  trim(l) AS x, trim(l) AS x8 FROM ln)"""


def old_digests(spark: SparkSession, d: str) -> DataFrame:
    """Each document as an old-style digest: seven lines per unit, brief entries after detailed ones."""
    def rule(l, i):
        x = F.trim(l)
        g, r = (i / 7).cast("int"), i % 7
        return (F.when(r == 0, F.concat(F.lit("## 单元"), _s(g + 1)))
                .when(r == 1, F.lit("**【重要】**"))
                .when(r == 2, F.concat(F.lit("- **第"), _s(i + 2), F.lit("章 甲**："), x))
                .when(r == 3, F.concat(F.lit("**【原文·第"), _s(i + 1), F.lit("章】**")))
                .when(r == 4, F.concat(F.lit("> 引"), x))
                .when(r == 5, F.lit("**【过渡】**"))
                .otherwise(F.concat(F.lit("- **乙（第"), _s(i - 4), F.lit("-"), _s(i - 3), F.lit("章）**："), x)))
    return _rewrite(documents(spark, d).select(F.col("source").alias("book_id"), "doc_id", "text"), rule)
