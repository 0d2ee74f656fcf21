"""Aliases and mentions.  The dictionary of a language are the words, of any script, that stand in several of its texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright.functions import text as T
from tomewright.operators import digest as D
from tomewright.operators import entities as E
from tomewright.queries.base import LN, documents
from tomewright.session import cut_lineage
from tomewright.sources.tables import read_table

WORD = "^([A-Za-z]{2,8})(?:[^\\p{L}]|$)"
TEXTS = 5               # documents that hold a word of the dictionary, at least


def _aliases(spark, d):
    """Words of two to eight letters of whole texts; written once, as several results are built on it."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}+)")))
    t = documents(spark, d, "doc_id", "lang", "text").select(F.col("lang").alias("book_id"), F.explode_outer(words).alias("alias"))
    t = t.where(F.length("alias").between(2, 8)).groupBy("book_id", "alias").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(t.where(F.col("n") >= TEXTS).select("book_id", "alias", F.lower(F.substring("alias", 1, 3)).alias("canonical")))


def _entries(spark, d):
    """People with an entry: canonical names of documents labelled good."""
    t = documents(spark, d, "doc_id", "lang", "text").join(
        read_table(spark, d, "labels", "doc_id", "quality").where("quality = 1"), "doc_id")
    return t.select(F.col("lang").alias("book_id"), F.lower(F.substring(F.regexp_extract("text", WORD, 1), 1, 3))
                    .alias("canonical")).where("canonical <> ''").distinct()


def _texts(spark, d):
    return documents(spark, d, "doc_id", "lang", "text").select(F.col("lang").alias("book_id"), "doc_id", "text")


def mentions(spark, d):
    m = E.mentions(_texts(spark, d), _aliases(spark, d), "book_id", ["book_id", "doc_id"])
    return m.groupBy("book_id", "doc_id", "alias", "canonical").agg(
        F.count("*").alias("n"), F.min("ord").cast("long").alias("first"), F.max("ord").cast("long").alias("last"))


def first_mentions(spark, d):
    m = E.mentions(_texts(spark, d), _aliases(spark, d), "book_id", ["book_id", "doc_id"], first_only=True)
    return E.first_mentions(m, ["book_id", "doc_id"], ["ord"]).withColumn("ord", F.col("ord").cast("long"))


def linkable_aliases(spark, d):
    return E.linkable(_aliases(spark, d), _entries(spark, d), ["book_id"]).select("book_id", "alias", "canonical")


def unlinked_people(spark, d):
    return E.unlinked_people(_aliases(spark, d), _entries(spark, d), ["book_id"])


def people_index(spark, d):
    return E.people_index(_aliases(spark, d), ["book_id"])


def merged_aliases(spark, d):
    """Table aliases first, then lower-cased words as a second dictionary."""
    a = _aliases(spark, d)
    second = a.select("book_id", F.lower("alias").alias("alias"), F.lit("other").alias("canonical")).distinct()
    return E.merge_aliases(a, second, ["book_id"])


def _people_files(spark, d):
    """Each document as a people file: an alias table from its lines and one entry."""
    def word(l, n):
        return F.regexp_extract(l, "([A-Za-z]+)" + "[^A-Za-z]+([A-Za-z]+)" * (n - 1), n)
    ls = T.lines_of(F.col("text"))
    rows = F.array_join(F.transform(ls, lambda l, i: F.concat(
        F.lit("| **"), word(l, 1), F.lit("** | "), i.cast("string"), F.lit(" | "), word(l, 2), F.lit("（注）、又称"),
        F.lower(word(l, 1)), F.lit(" |"))), "\n")
    text = F.concat(F.lit("| 本名 | 首次 | 别名 |\n|---|---|---|\n"), rows, F.lit("\n## 人物\n### "),
                    word(F.element_at(ls, 1), 1), F.lit("\n正文"), F.col("doc_id").cast("string"))
    return documents(spark, d, "doc_id", "text").select("doc_id", text.alias("text"))


def alias_tables(spark, d):
    return E.table_aliases(D.digest_blocks(_people_files(spark, d), ["doc_id"]), ["doc_id"])


def person_entries(spark, d):
    return E.people(D.digest_blocks(_people_files(spark, d), ["doc_id"]), ["doc_id"])[1]


def people_warnings(spark, d):
    a, e = _aliases(spark, d), _entries(spark, d)
    books = read_table(spark, d, "documents", "lang").select(F.col("lang").alias("book_id"))
    quoted = read_table(spark, d, "documents", "lang", "text").where(F.contains("text", F.lit('"'))).select(F.col("lang").alias("book_id"))
    return E.people_warnings(books, a, e, quoted)


_AL = """wd AS (SELECT lang, unnest(list_distinct(regexp_extract_all(text, '\\p{L}+'))) AS x FROM documents),
 al AS (SELECT lang AS book_id, x AS alias FROM wd WHERE length(x) BETWEEN 2 AND 8 GROUP BY ALL HAVING count(*) >= 5),
 a AS (SELECT *, lower(left(alias, 3)) AS canonical FROM al),
 e AS (SELECT DISTINCT lang AS book_id, lower(left(regexp_extract(text, '^([A-Za-z]{2,8})(?:[^\\p{L}]|$)', 1), 3)) AS canonical
  FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND regexp_matches(text, '^[A-Za-z]{2,8}(?:[^\\p{L}]|$)'))"""
_MN = _AL + """, p AS (SELECT book_id, string_agg(alias, '|' ORDER BY length(alias) DESC, alias) AS rx FROM al GROUP BY book_id),
 x AS (SELECT p.book_id, doc_id, regexp_extract_all(text, rx) AS m FROM documents JOIN p ON p.book_id = lang),
 m AS (SELECT book_id, doc_id, unnest(m) AS alias, generate_subscripts(m, 1) - 1 AS ord FROM x)"""
_TABLE = LN + """,
 w AS (SELECT doc_id, i, regexp_extract(l, '([A-Za-z]+)', 1) AS w1,
   regexp_extract(l, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 2) AS w2 FROM ln),
 c AS (SELECT doc_id, i, 0 AS k, w1 AS alias, w1 FROM w WHERE w1 <> ''
   UNION ALL SELECT doc_id, i, 1, w2, w1 FROM w WHERE w1 <> '' AND length(w2) BETWEEN 1 AND 8
   UNION ALL SELECT doc_id, i, 2, lower(w1), w1 FROM w WHERE w1 <> '' AND length(w1) <= 8),
 ta AS (SELECT doc_id, alias, arg_min(w1, i * 3 + k) AS canonical FROM c GROUP BY doc_id, alias)"""

QUERIES = {
    "mentions": (mentions, f"""WITH {_MN} SELECT book_id, doc_id, alias, lower(left(alias, 3)) AS canonical, count(*) AS n,
      min(ord) AS first, max(ord) AS last FROM m GROUP BY ALL"""),
    "first_mentions": (first_mentions, f"""WITH {_MN} SELECT book_id, doc_id, lower(left(alias, 3)) AS canonical,
      min(ord) AS ord, arg_min(alias, ord) AS alias FROM m GROUP BY ALL"""),
    "linkable_aliases": (linkable_aliases, f"WITH {_AL} SELECT a.* FROM a SEMI JOIN e USING (book_id, canonical)"),
    "unlinked_people": (unlinked_people, f"""WITH {_AL} SELECT DISTINCT book_id, canonical FROM a
      ANTI JOIN e USING (book_id, canonical)"""),
    "people_index": (people_index, f"""WITH {_AL} SELECT book_id, canonical, string_agg(alias, ' ' ORDER BY alias) AS aliases,
      count(*) AS n_aliases FROM a GROUP BY ALL"""),
    "merged_aliases": (merged_aliases, f"""WITH {_AL} SELECT book_id, alias, canonical FROM a UNION ALL
      SELECT DISTINCT book_id, lower(alias), 'other' FROM al WHERE (book_id, lower(alias)) NOT IN (SELECT (book_id, alias) FROM al)"""),
    "alias_tables": (alias_tables, f"WITH {_TABLE} SELECT doc_id, alias, canonical FROM ta"),
    "person_entries": (person_entries, f"""WITH {_TABLE} SELECT w.doc_id, canonical, '正文' || w.doc_id AS body
      FROM w JOIN ta ON ta.doc_id = w.doc_id AND ta.alias = w.w1 WHERE w.i = 0"""),
    "people_warnings": (people_warnings, f"""WITH {_AL}, u AS (SELECT DISTINCT book_id, canonical FROM a
        ANTI JOIN e USING (book_id, canonical)), b AS (SELECT DISTINCT lang AS book_id FROM documents)
      SELECT book_id, NOT EXISTS (SELECT 1 FROM a WHERE a.book_id = b.book_id) AS no_aliases,
        EXISTS (SELECT 1 FROM a WHERE a.book_id = b.book_id) AND NOT EXISTS (SELECT 1 FROM e WHERE e.book_id = b.book_id)
        AS no_entries, (SELECT count(*) FROM u WHERE u.book_id = b.book_id) AS unlinked,
        NOT EXISTS (SELECT 1 FROM documents WHERE lang = b.book_id AND contains(text, '"')) AS no_slices FROM b"""),
}
