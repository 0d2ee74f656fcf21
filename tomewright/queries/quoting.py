"""Passages and quotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright import fixed as K
from tomewright.functions import text as T
from tomewright.operators import coverage as C
from tomewright.operators import digest as D
from tomewright.operators import passages as P
from tomewright.operators import quotes as Q
from tomewright.operators.fingerprints import PassageIndex
from tomewright.operators.ordered import locate_in_spans
from tomewright.queries.base import DG, IX, chapter_norms, digests, documents, index, sql_norm
from tomewright.queries.planning import PARTS, _digest_parts
from tomewright.session import cut_lineage, new_folder
from tomewright.sources.tables import read_table


def _items(spark, d):
    return read_table(spark, d, "benchmark").select("item_id", T.normalize(F.col("text")).alias("norm"))


def passages_exact(spark, d):
    corpus = documents(spark, d, "doc_id", "text").select("doc_id", T.normalize(F.col("text")).alias("norm"))
    return P.find_passages(_items(spark, d), corpus, "item_id", ["doc_id"])


def passages_indexed(spark, d):
    """The same through a stored fingerprint index that is written in two parts."""
    corpus = documents(spark, d, "doc_id", "text").select("doc_id", T.normalize(F.col("text")).alias("norm"))
    odd = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    ix = PassageIndex(spark, new_folder(spark), ["doc_id"]).append(corpus.where(~odd)).append(corpus.where(odd))
    return ix.find(_items(spark, d), "item_id")


def passages_located(spark, d):
    """First occurrence of every passage in every book, with its chapter."""
    ct = chapter_norms(spark, d)
    spans = cut_lineage(P.flat_spans(ct))
    hits = P.find_segments(P.flat_blocks(ct, spans), _items(spark, d).withColumnRenamed("norm", "seg"),
                           ["item_id"], ["book_id"])
    first = hits.groupBy("item_id", "book_id").agg(F.min("pos").alias("pos"))
    return locate_in_spans(first, spans, "book_id", "pos", "norm_start", "norm_end").select(
        "item_id", "book_id", "pos", F.col("idx").alias("doc_id"))


def _slices(spark, d):
    """One slice per document: its first and last line around an ellipsis.

    Labels shift some declared chapters, French quotations are out of order,
    toxic ones hold a piece that stands nowhere (English) or are too short.
    """
    ls = T.lines_of(F.col("text"))
    t = documents(spark, d, "doc_id", "source", "text", "lang").select(     # only two lines of a text move
        "doc_id", "source", "lang", F.element_at(ls, 1).alias("first"), F.element_at(ls, -1).alias("last"))
    t = t.join(read_table(spark, d, "labels", "doc_id", "quality", "toxic"), "doc_id", "left")
    declared = F.col("doc_id") + F.when(F.col("quality") == 0, 1).otherwise(0)
    first, last, dots = F.col("first"), F.col("last"), F.lit("……")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    text = (F.when(toxic & (F.col("lang") == "en"), F.concat(first, dots, F.lit("原文没有这段话")))
            .when(toxic, F.lit("短……「引」")).when(F.col("lang") == "fr", F.concat(last, dots, first))
            .otherwise(F.concat(first, dots, last)))
    return t.select(F.col("source").alias("book_id"), F.lit("digest").alias("doc_id"), F.col("doc_id").alias("slice_no"),
                    F.concat(F.lit("第"), declared.cast("string"), F.lit("章")).alias("chapter"),
                    F.lit("").alias("label"), text.alias("raw"), T.strip_quote_edges(text).alias("text"))


def _verified(spark, d):
    return Q.verify_slices(_slices(spark, d), chapter_norms(spark, d))


def slice_status(spark, d):
    return _verified(spark, d).select("book_id", "slice_no", "n_segments", "n_found", "pos", "chapters", "status", "reason")


def slice_counts(spark, d):
    return Q.status_counts(_verified(spark, d))


def slice_share(spark, d):
    return Q.slice_share(_slices(spark, d), chapter_norms(spark, d), alarm=0.05)


def slice_collection(spark, d):
    return Q.slice_collection(_verified(spark, d)).select("book_id", "slice_no", "status",
                                                          F.md5(F.col("raw").cast("binary")).alias("raw"))


def slice_issues(spark, d):
    return Q.slice_issues(_verified(spark, d)).select("book_id", "slice_no", "status")


def slice_issues_first(spark, d):
    """The first ten issues of each digest."""
    return Q.slice_issues(_verified(spark, d), per_doc=10).select("book_id", "slice_no", "status")


def quality_gate(spark, d):
    parts, ix = _digest_parts(spark, d), index(spark, d)
    return Q.quality_gate(parts, C.coverage(parts, ix), _verified(spark, d))


def extract_slices(spark, d):
    return Q.extract_slices(digests(spark, d), ["book_id", "doc_id"]).select(
        "book_id", "doc_id", F.col("slice_no").cast("long").alias("slice_no"), "chapter", "label", "raw", "text", "line")


def lint_digest(spark, d):
    docs, keys = digests(spark, d), ["book_id", "doc_id"]
    sl = Q.extract_slices(docs, keys)
    return D.lint_digest(docs, sl, Q.slice_share(sl, chapter_norms(spark, d), alarm=0.001), keys)


_QUOTE_EDGE = "'[ \\t\"' || chr(39) || '「」『』“”‘’《》〈〉]+'"
_TEXT = """CASE WHEN toxic = 1 AND lang = 'en' THEN split_part(text, chr(10), 1) || '……原文没有这段话' WHEN toxic = 1 THEN '短……「引」'
  WHEN lang = 'fr' THEN string_split(text, chr(10))[-1] || '……' || split_part(text, chr(10), 1)
  ELSE split_part(text, chr(10), 1) || '……' || string_split(text, chr(10))[-1] END"""
_STRIPPED = f"regexp_replace(regexp_replace({_TEXT}, '^' || {_QUOTE_EDGE}, ''), {_QUOTE_EDGE} || '$', '')"

_VERIFY = f"""WITH RECURSIVE src AS (SELECT source AS book_id, doc_id, text, lang, {sql_norm('text')} AS n FROM documents),
 spans AS (SELECT book_id, doc_id, coalesce(sum(length(n)) OVER (PARTITION BY book_id ORDER BY doc_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(n) AS len FROM src),
 flat AS (SELECT book_id, string_agg(n, '' ORDER BY doc_id) AS f FROM src GROUP BY book_id),
 sl AS (SELECT src.book_id, src.doc_id, {_TEXT} AS raw, replace({sql_norm(_STRIPPED)}, '…', '...') AS n,
   src.doc_id + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS want FROM src LEFT JOIN labels USING (doc_id)),
 pieces AS (SELECT book_id, doc_id, list_filter(regexp_split_to_array(n, '\\.{{2,}}|…+|﹍+|——+|\\*{{2,}}'),
   lambda x: length(x) >= 4) AS p FROM sl),
 segs AS (SELECT book_id, doc_id, unnest(p) AS seg, generate_subscripts(p, 1) - 1 AS k FROM pieces),
 g(book_id, doc_id, k, cur, pos, ooo) AS (
   SELECT book_id, doc_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false FROM sl
   UNION ALL
   SELECT book_id, doc_id, k, CASE WHEN p1 > 0 THEN cur + p1 - 1 + m WHEN p2 > 0 THEN p2 - 1 + m ELSE cur END,
     CASE WHEN p1 > 0 THEN cur + p1 - 1 WHEN p2 > 0 THEN p2 - 1 END, p1 = 0 AND p2 > 0
   FROM (SELECT g.book_id, g.doc_id, s.k, g.cur, length(s.seg) AS m, instr(substring(f, g.cur + 1), s.seg) AS p1,
     instr(f, s.seg) AS p2 FROM g JOIN segs s ON s.book_id = g.book_id AND s.doc_id = g.doc_id AND s.k = g.k + 1
     JOIN flat ON flat.book_id = g.book_id)),
 hit AS (SELECT g.*, seg, sp.doc_id AS ch FROM g JOIN segs USING (book_id, doc_id, k)
   LEFT JOIN spans sp ON sp.book_id = g.book_id AND g.pos >= sp.s AND g.pos < sp.s + sp.len),
 chs AS (SELECT book_id, doc_id, string_agg('第' || ch || '章', '、' ORDER BY k0) AS chapters, list(ch) AS lst FROM
   (SELECT book_id, doc_id, ch, min(k) AS k0 FROM hit WHERE ch > 0 GROUP BY ALL) GROUP BY ALL),
 agg AS (SELECT book_id, doc_id, count(*) AS n_segments, count(pos) AS n_found, bool_or(ooo) AS ooo,
   arg_min(pos, CASE WHEN pos IS NOT NULL THEN k END) AS pos, arg_min(left(seg, 40), CASE WHEN pos IS NULL THEN k END) AS lost
   FROM hit GROUP BY ALL),
 res AS (SELECT sl.book_id, sl.doc_id AS slice_no, sl.raw, coalesce(n_segments, 0) AS n_segments, coalesce(n_found, 0) AS n_found,
   CAST(pos AS BIGINT) AS pos, coalesce(chapters, '') AS chapters,
   CASE WHEN n_segments IS NULL THEN 0 WHEN n_found < n_segments THEN 1 WHEN ooo THEN 2
     WHEN lst IS NOT NULL AND NOT list_contains(lst, want) THEN 3 ELSE 4 END AS c, want, lost
   FROM sl LEFT JOIN agg USING (book_id, doc_id) LEFT JOIN chs USING (book_id, doc_id)),
 v AS (SELECT *, CASE WHEN c < 2 THEN 'FAIL' WHEN c < 4 THEN 'WARN' ELSE 'PASS' END AS status,
   CASE c WHEN 0 THEN '{K.REASON_SHORT}' WHEN 1 THEN (n_segments - n_found) || ' 段在原文中找不到：' || lost || '…'
     WHEN 2 THEN '{K.REASON_ORDER}' WHEN 3 THEN '标注为 第' || want || '章，但这段文字出现在 ' || chapters ||
     '（可能抄错章号，或该段落原文本身跨章）' ELSE '' END AS reason FROM res)"""

_FOUND = """WITH src AS (SELECT source AS book_id, doc_id, {dn} AS n FROM documents),
 it AS (SELECT item_id, {bn} AS p FROM benchmark),
 spans AS (SELECT book_id, doc_id, n, CAST(coalesce(sum(length(n)) OVER (PARTITION BY book_id ORDER BY doc_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM src)""".format(
    dn=sql_norm("text"), bn=sql_norm("text"))

_SLICES = f"""{DG}, sl AS (SELECT a.book_id, a.doc_id, a.i, b.x FROM dg a JOIN dg b ON b.doc_id = a.doc_id
   AND b.i = a.i + 1 WHERE a.r = 3 AND b.x <> '')"""

QUERIES = {
    "passages_exact": (passages_exact, _FOUND + """ SELECT item_id, doc_id, CAST(instr(n, p) - 1 AS BIGINT) AS pos,
      CAST((length(n) - length(replace(n, p, ''))) // length(p) AS BIGINT) AS hits FROM spans JOIN it ON contains(n, p)"""),
    "passages_indexed": (passages_indexed, _FOUND + """ SELECT item_id, doc_id, CAST(instr(n, p) - 1 AS BIGINT) AS pos,
      CAST((length(n) - length(replace(n, p, ''))) // length(p) AS BIGINT) AS hits FROM spans JOIN it ON contains(n, p)"""),
    "passages_located": (passages_located, _FOUND + """ SELECT item_id, book_id, CAST(min(s + instr(n, p) - 1) AS BIGINT)
      AS pos, arg_min(doc_id, s) AS doc_id FROM spans JOIN it ON contains(n, p) GROUP BY item_id, book_id"""),
    "slice_status": (slice_status, _VERIFY + """ SELECT book_id, slice_no, n_segments, n_found, pos, chapters, status,
      reason FROM v"""),
    "slice_counts": (slice_counts, _VERIFY + """ SELECT book_id, 'digest' AS doc_id, count(*) AS slices,
      count(CASE WHEN status = 'PASS' THEN 1 END) AS passed, count(CASE WHEN status = 'WARN' THEN 1 END) AS warned,
      count(CASE WHEN status = 'FAIL' THEN 1 END) AS failed FROM v GROUP BY book_id"""),
    "slice_share": (slice_share, f"""WITH a AS (SELECT source AS book_id, CAST(sum(length(replace({sql_norm(_STRIPPED)},
        '…', '...'))) AS BIGINT) AS slice_chars, CAST(sum(length({sql_norm('text')})) AS BIGINT) AS source_chars
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
      SELECT book_id, 'digest' AS doc_id, slice_chars, source_chars, round(slice_chars / greatest(source_chars, 1), 4)
      AS ratio, slice_chars / greatest(source_chars, 1) > 0.05 AS alarm FROM a"""),
    "slice_collection": (slice_collection, _VERIFY + """ SELECT book_id, slice_no, status, md5(raw) AS raw FROM v
      WHERE status <> 'FAIL'"""),
    "slice_issues": (slice_issues, _VERIFY + """ SELECT book_id, slice_no, status FROM v WHERE status <> 'PASS'"""),
    "slice_issues_first": (slice_issues_first, _VERIFY + """ SELECT book_id, slice_no, status FROM v WHERE status <> 'PASS'
      QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY slice_no) <= 10"""),
    "quality_gate": (quality_gate, _VERIFY + ", " + PARTS[len("WITH "):] + """,
      cv AS (SELECT book_id, count(*) AS total, count(CASE WHEN hit THEN 1 END) AS covered FROM cov
        WHERE book_id IN (SELECT book_id FROM refs) GROUP BY book_id),
      sc AS (SELECT book_id, count(*) AS slices, count(CASE WHEN status = 'PASS' THEN 1 END) AS passed,
        count(CASE WHEN status = 'WARN' THEN 1 END) AS warned, count(CASE WHEN status = 'FAIL' THEN 1 END) AS failed
        FROM v GROUP BY book_id)
      SELECT book_id, 'digest' AS doc_id, total, covered, slices, passed, warned, failed,
        concat_ws(',', CASE WHEN covered < total THEN 'uncovered' END, CASE WHEN failed > 0 THEN 'failed_slices' END) AS errors,
        covered = total AND failed = 0 AS ok FROM cv JOIN sc USING (book_id)"""),
    "extract_slices": (extract_slices, f"""WITH {_SLICES} SELECT book_id, doc_id, row_number() OVER (PARTITION BY doc_id
      ORDER BY i) AS slice_no, '第' || i || '章 甲' AS chapter, '' AS label, x AS raw, x AS text, i + 1 AS line FROM sl"""),
    "lint_digest": (lint_digest, f"""WITH {_SLICES}, s AS (SELECT book_id, doc_id, count(*) AS slices,
        count(CASE WHEN length(x) < 80 THEN 1 END) AS too_short, count(CASE WHEN length(x) > 500 THEN 1 END) AS too_long, sum(length({sql_norm('x')})) AS c FROM sl GROUP BY ALL),
      b AS (SELECT source AS book_id, sum(length({sql_norm('text')})) AS n FROM documents GROUP BY source)
      SELECT d.source AS book_id, d.doc_id, coalesce(slices, 0) AS slices, coalesce(too_short, 0) AS too_short,
        coalesce(too_long, 0) AS too_long, CAST(0 AS INTEGER) AS cross_marks, coalesce(round(c / greatest(n, 1), 4), 0.0) AS ratio,
        coalesce(round(c / greatest(n, 1), 4) > 0.15, false) AS over_advice, coalesce(c / greatest(n, 1) > 0.001, false) AS alarm
      FROM documents d JOIN b ON b.book_id = d.source LEFT JOIN s ON s.doc_id = d.doc_id"""),
}
