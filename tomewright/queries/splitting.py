"""Text, lines, chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright.functions import text as T
from tomewright.operators import parts as P
from tomewright.operators import segment as S
from tomewright.queries.base import CHAPTERS, IN_PARTS, LN, RAW, books_in_parts, documents, raw_books
from tomewright.sources.files import decode_books, encoding_census, index_files
from tomewright.sources.tables import read_table, spread

AD = r"https?://|www\.|(?i)license"


def line_offsets(spark, d):
    t = S.lines(documents(spark, d, "doc_id", "text"), "doc_id")
    return t.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "start",
                    F.length("line").cast("long").alias("n"))


def chapters_from_headings(spark, d):
    return S.split_chapters(raw_books(spark, d)).withColumn("idx", F.col("idx").cast("long"))


def chapter_bodies(spark, d):
    return S.chapter_text(raw_books(spark, d)).select(
        "book_id", F.col("idx").cast("long").alias("idx"), F.md5(F.col("text").cast("binary")).alias("body"))


def chapters_of_parts(spark, d):
    """Whole sources as books, documents as their parts: the last line of one is cut from the first of the next."""
    return P.split_parts(books_in_parts(spark, d)).withColumn("idx", F.col("idx").cast("long"))


def bodies_of_parts(spark, d):
    parts = books_in_parts(spark, d)
    return P.text_of_parts(parts, P.split_parts(parts)).select(
        "book_id", F.col("idx").cast("long").alias("idx"), F.md5(F.col("text").cast("binary")).alias("body"))


def lines_of_parts(spark, d):
    return P.lines_of_parts(books_in_parts(spark, d)).select("book_id", "line_no", "start", F.md5(F.col("line").cast("binary")).alias("line"))


def custom_pattern_split(spark, d):
    books = documents(spark, d).select(F.col("doc_id").alias("book_id"), "text")
    c = S.split_chapters(books, pattern="([A-Z][a-z]+) [a-z]+[.]$", chunk_size=8000)
    return c.select("book_id", F.col("idx").cast("long").alias("idx"), "title", "chars", "start", "end", "fallback")


def fallback_chunks(spark, d):
    books = documents(spark, d).select(F.col("doc_id").alias("book_id"), "text")
    return S.split_chapters(books, chunk_size=1000, force_chunks=True).select(
        "book_id", F.col("idx").cast("long").alias("idx"), "chars", "start", "end")


def boilerplate_filter(spark, d):
    books = documents(spark, d).select(F.col("doc_id").alias("book_id"), "text")
    return S.clean_books(books, AD).select("book_id", F.length("text").cast("long").alias("chars"),
                                           F.md5(F.col("text").cast("binary")).alias("body"))


def book_summary(spark, d):
    return S.book_summary(S.split_chapters(raw_books(spark, d), with_preamble=True)).drop("fallback")


def volumes_of_books(spark, d):
    return S.volumes(S.split_chapters(raw_books(spark, d))).withColumn("first_idx", F.col("first_idx").cast("long"))


def short_chapters(spark, d):
    return S.short_chapters(S.split_chapters(raw_books(spark, d))).select(
        "book_id", F.col("idx").cast("long").alias("idx"), "title", "chars")


def chapter_file_labels(spark, d):
    return S.file_labels(S.split_chapters(raw_books(spark, d))).select(
        "book_id", F.col("idx").cast("long").alias("idx"), "file")


def comparison_text(spark, d):
    t = documents(spark, d, "doc_id", "text").withColumn("norm", T.normalize(F.col("text")))
    return t.select("doc_id", F.length("norm").cast("long").alias("n"), F.md5(F.col("norm").cast("binary")).alias("norm"))


def cjk_share(spark, d):
    books = raw_books(spark, d)
    return books.select("book_id", F.round(T.cjk_ratio(F.col("text")), 6).alias("ratio"))


def encoding_choice(spark, d):
    """German documents stored as UTF-16, the rest as UTF-8, then decoded by trial."""
    t = documents(spark, d, "doc_id", "lang", "text")
    raw = t.select("doc_id", F.when(F.col("lang") == "de", F.encode("text", "UTF-16"))
                   .otherwise(F.encode("text", "UTF-8")).alias("content"))
    return decode_books(raw, "doc_id", trust_utf8=True).select(
        "doc_id", "encoding", F.md5(F.col("text").cast("binary")).alias("body"))


def encodings(spark, d):
    t = documents(spark, d, "doc_id", "lang", "text")
    raw = t.select("doc_id", F.when(F.col("lang") == "de", F.encode("text", "UTF-16"))
                   .otherwise(F.encode("text", "UTF-8")).alias("content"))
    return encoding_census(decode_books(raw, "doc_id", trust_utf8=True))


def chapter_file_index(spark, d):
    t = spread(read_table(spark, d, "conversations"))
    files = t.select(F.col("conv_id").alias("book_id"), F.concat(
        F.lit("turn_"), F.col("turn").cast("string"), F.lit("_"), F.col("role"), F.lit(".txt")).alias("name"), "text")
    return index_files(files).select("book_id", "idx", "title", "chars", "end", "file")


def numerals(spark, d):
    n = F.col("doc_id") % 10000

    def digit(p):
        return (n / p).cast("int") % 10

    def put(p, unit):
        return F.when(digit(p) > 0, F.concat(F.substring(F.lit("零一二三四五六七八九"), digit(p) + 1, F.lit(1)),
                                             F.lit(unit))).otherwise("")
    word = F.concat(put(1000, "千"), put(100, "百"), put(10, "十"), put(1, ""))
    word = F.when(n == 0, "〇").otherwise(word)
    t = read_table(spark, d, "documents", "doc_id").select("doc_id", word.alias("word"))
    return t.select("doc_id", "word", T.cn_number(F.col("word")).alias("value"))


def progress_keys(spark, d):
    t = read_table(spark, d, "pages", "page_id", "url").withColumn(
        "path", F.concat(F.regexp_replace("url", "^https?://|[?#].*$", ""), F.lit("/Digest.md")))
    return t.select("page_id", T.progress_key(F.col("path")).alias("key"))


QUERIES = {
    "line_offsets": (line_offsets, f"""WITH {LN} SELECT doc_id, i AS line_no, CAST(length(l) AS BIGINT) AS n,
      CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ln"""),
    "chapters_from_headings": (chapters_from_headings, f"""WITH {RAW}
      SELECT book_id, idx, title, chars, start, "end", volume, fallback FROM chapters"""),
    "chapter_bodies": (chapter_bodies, f"""WITH {RAW} SELECT book_id, idx, md5(body) AS body FROM chapters"""),
    "chapters_of_parts": (chapters_of_parts, f"""WITH {IN_PARTS} {CHAPTERS}
      SELECT book_id, idx, title, chars, start, "end", volume, fallback FROM chapters"""),
    "bodies_of_parts": (bodies_of_parts, f"""WITH {IN_PARTS} {CHAPTERS} SELECT book_id, idx, md5(body) AS body FROM chapters"""),
    "lines_of_parts": (lines_of_parts, f"""WITH {IN_PARTS} {CHAPTERS} SELECT book_id, i AS line_no, start, md5(h) AS line FROM raws"""),
    "custom_pattern_split": (custom_pattern_split, f"""WITH {LN},
      pos AS (SELECT doc_id, i, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS s, CAST(coalesce(sum(length(l) + 1)
        OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM ln),
      hit AS (SELECT doc_id, i, start, regexp_extract(s, '^([A-Z][a-z]+) [a-z]+[.]$', 1) AS title FROM pos
        WHERE regexp_matches(s, '^([A-Z][a-z]+) [a-z]+[.]$')),
      c AS (SELECT h.doc_id, row_number() OVER w AS idx, title, start, d.text,
        CAST(coalesce(lead(start) OVER w, length(d.text)) AS BIGINT) AS "end",
        count(*) OVER (PARTITION BY h.doc_id) AS n FROM hit h JOIN documents d USING (doc_id)
        WINDOW w AS (PARTITION BY h.doc_id ORDER BY h.i))
      SELECT doc_id AS book_id, CAST(idx AS BIGINT) AS idx, title, start, "end", CAST(length(regexp_replace(
        substring(text, start + 1, "end" - start), '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS chars, false AS fallback
      FROM c WHERE n >= 2
      UNION ALL SELECT doc_id, CAST(p // 8000 + 1 AS BIGINT), '分块' || (p // 8000 + 1) || '（自动，非真实章节）', CAST(p AS BIGINT),
        CAST(least(p + 8000, length(text)) AS BIGINT), CAST(least(8000, length(text) - p) AS BIGINT), true
      FROM documents, LATERAL (SELECT unnest(generate_series(0, length(text) - 1, 8000)) AS p)
      WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE n >= 2)"""),
    "fallback_chunks": (fallback_chunks, """SELECT doc_id AS book_id, CAST(p // 1000 + 1 AS BIGINT) AS idx,
      CAST(least(1000, length(text) - p) AS BIGINT) AS chars, CAST(p AS BIGINT) AS start,
      CAST(least(p + 1000, length(text)) AS BIGINT) AS "end"
      FROM documents, LATERAL (SELECT unnest(generate_series(0, length(text) - 1, 1000)) AS p)"""),
    "boilerplate_filter": (boilerplate_filter, f"""WITH {LN},
      kept AS (SELECT doc_id, i, regexp_replace(l, '\\s+$', '') AS l FROM ln
        WHERE NOT regexp_matches(l, 'https?://|www\\.|(?i:license)')),
      j AS (SELECT d.doc_id, coalesce(regexp_replace(string_agg(k.l, chr(10) ORDER BY k.i), '\\n{{3,}}',
        chr(10) || chr(10), 'g'), '') AS t FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id)
      SELECT doc_id AS book_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS body FROM j"""),
    "book_summary": (book_summary, f"""WITH {RAW} SELECT t.book_id, count(c.idx) AS chapters,
      CAST(coalesce(sum(c.chars), 0) AS BIGINT) AS total_chars,
      count(CASE WHEN c.chars < 200 THEN 1 END) AS short_chapters,
      CAST(CASE WHEN bool_or(c.fallback) THEN 0 ELSE coalesce(min(c.start), 0) END AS BIGINT) AS preamble_chars,
      count(DISTINCT nullif(c.volume, '')) AS volumes, arg_min(c.title, c.idx) AS first_title,
      arg_max(c.title, c.idx) AS last_title FROM txt t LEFT JOIN chapters c USING (book_id) GROUP BY t.book_id"""),
    "volumes_of_books": (volumes_of_books, f"""WITH {RAW} SELECT book_id, volume, min(idx) AS first_idx,
      count(*) AS chapters, CAST(sum(chars) AS BIGINT) AS chars FROM chapters WHERE volume <> '' GROUP BY ALL"""),
    "short_chapters": (short_chapters, f"""WITH {RAW} SELECT book_id, idx, title, chars FROM chapters WHERE chars < 200"""),
    "chapter_file_labels": (chapter_file_labels, f"""WITH {RAW},
      b AS (SELECT *, regexp_replace(regexp_replace(title, '^第[0-9]+章\\s*', ''), '[\\\\/:*?"<>|\\n\\r\\t]', '_', 'g') AS t0,
        count(*) OVER (PARTITION BY book_id) AS n FROM chapters),
      c AS (SELECT *, regexp_replace(t0, '^[ ._]+|[ ._]+$', '', 'g') AS t FROM b)
      SELECT book_id, idx, '原文/第' || lpad(CAST(idx AS VARCHAR),
        greatest(4, length(CAST(n AS VARCHAR)), length(CAST(idx AS VARCHAR)))::INT, '0')
        || '章_' || left(CASE WHEN t = '' THEN '未命名' ELSE t END, 40) || '.txt' AS file FROM c"""),
    "comparison_text": (comparison_text, """SELECT doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS norm FROM
      (SELECT doc_id, translate(text, ' ' || chr(9) || chr(10) || chr(13) || '"' || chr(39) || '「」『』“”‘’《》〈〉', '') AS t
       FROM documents)"""),
    "cjk_share": (cjk_share, f"""WITH {RAW} SELECT book_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round(
      length(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')) / length(text), 6) END AS ratio FROM txt"""),
    "encoding_choice": (encoding_choice, """SELECT doc_id, CASE WHEN lang = 'de' THEN 'utf-16' ELSE 'utf-8-sig' END
      AS encoding, md5(text) AS body FROM documents"""),
    "encoding_census": (encodings, """SELECT CASE WHEN lang = 'de' THEN 'utf-16' ELSE 'utf-8-sig' END AS encoding,
      count(*) AS files FROM documents GROUP BY 1"""),
    "chapter_file_index": (chapter_file_index, """SELECT conv_id AS book_id, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn, role) AS idx,
      left(regexp_extract(regexp_replace(text, '^\\s+', ''), '^([^\\n]*\\S)', 1), 60) AS title,
      CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS chars, CAST(length(text) AS BIGINT) AS "end",
      'turn_' || turn || '_' || role || '.txt' AS file FROM conversations"""),
    "numerals": (numerals, """WITH n AS (SELECT doc_id, doc_id % 10000 AS v FROM documents),
      g AS (SELECT *, v // 1000 % 10 AS a, v // 100 % 10 AS b, v // 10 % 10 AS c, v % 10 AS e FROM n)
      SELECT doc_id, v AS value, CASE WHEN v = 0 THEN '〇' ELSE
        CASE WHEN a > 0 THEN substring('零一二三四五六七八九', a + 1, 1) || '千' ELSE '' END ||
        CASE WHEN b > 0 THEN substring('零一二三四五六七八九', b + 1, 1) || '百' ELSE '' END ||
        CASE WHEN c > 0 THEN substring('零一二三四五六七八九', c + 1, 1) || '十' ELSE '' END ||
        CASE WHEN e > 0 THEN substring('零一二三四五六七八九', e + 1, 1) ELSE '' END END AS word FROM g"""),
    "progress_keys": (progress_keys, """SELECT page_id, 'Digest-' || left(sha256(lower(
      regexp_replace(url, '^https?://|[?#].*$', '', 'g') || '/Digest.md')), 16) AS key FROM pages"""),
}
