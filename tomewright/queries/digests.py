"""Digest structure, order, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright.functions import text as T
from tomewright.operators import anchors as A
from tomewright.operators import digest as D
from tomewright.operators import parts as P
from tomewright.operators import segment as S
from tomewright.queries.base import DG, IX, LN, digests, documents, index, old_digests
from tomewright.queries.splitting import AD
from tomewright.session import cut_lineage
from tomewright.sources.tables import read_table

KEYS = ["book_id", "doc_id"]


def _blocks(docs):
    """Block table, written once because several branches read it."""
    return cut_lineage(D.digest_blocks(docs, KEYS))


def _long(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def digest_blocks(spark, d):
    b = D.digest_blocks(digests(spark, d), KEYS)
    return b.select(*KEYS, "block_no", F.col("line_no").cast("long").alias("line_no"), "kind", "level", "text",
                    F.when(F.col("kind") == "ul", F.size("items")).cast("long").alias("n_items"), "chapter",
                    F.col("bucket_no").cast("long").alias("bucket_no"))


def _in_parts(docs):
    """Whole digests keyed by their document, cut every 997 characters wherever that falls."""
    cut = docs.select(F.col("doc_id").alias("book_id"), F.regexp_extract_all("text", F.lit("(?s).{1,997}"), F.lit(0)).alias("ps"))
    return cut.select("book_id", F.posexplode_outer("ps").alias("part_no", "text"))


def digest_blocks_of_parts(spark, d):
    b = P.blocks_of_parts(_in_parts(digests(spark, d)))
    return b.select(F.col("book_id").alias("doc_id"), "block_no", "line_no", "kind", "level", "text",
                    F.when(F.col("kind") == "ul", F.size("items")).cast("long").alias("n_items"), "chapter", "bucket_no")


def entries_of_parts(spark, d):
    e = D.sorted_entries(P.units_of_parts(_in_parts(old_digests(spark, d))))
    return e.select(F.col("book_id").alias("doc_id"), "unit_no", F.col("opener").cast("long").alias("opener"),
                    "level", "title", "chpart", "min_ch", F.size("nums").cast("long").alias("n_chapters"))


def digest_units(spark, d):
    return _long(D.units(D.digest_blocks(digests(spark, d), KEYS), KEYS), "bucket_no", "num")


def unit_titles(spark, d):
    u = D.units(D.digest_blocks(digests(spark, d), KEYS), KEYS)
    return u.select(*KEYS, F.col("num").cast("long").alias("num"), D.unit_title(F.col("title")).alias("title"))


def document_titles(spark, d):
    t = documents(spark, d).select(F.col("source").alias("book_id"), "doc_id", F.concat(F.lit("# "), "text").alias("text"))
    return D.document_title(t, KEYS)


def labelled_entries(spark, d):
    e = D.block_entries(D.digest_blocks(digests(spark, d), KEYS), KEYS)
    return e.select(*KEYS, F.col("bucket_no").cast("long").alias("bucket_no"), "level",
                    F.array_join(F.col("nums").cast("array<string>"), ",").alias("nums"))


def slice_levels(spark, d):
    s = D.level_of_slices(_blocks(digests(spark, d)), KEYS)
    return s.select(*KEYS, F.col("bucket_no").cast("long").alias("bucket_no"), "ch", "level")


def key_only(spark, d):
    return D.key_only(_blocks(digests(spark, d)), KEYS).select(*KEYS, "kind", "text")


def entries_sorted(spark, d):
    e = D.entries(old_digests(spark, d), KEYS)
    return e.select(*KEYS, F.col("unit_no").cast("long").alias("unit_no"), F.col("opener").cast("long").alias("opener"),
                    "level", "title", "chpart", "min_ch", F.size("nums").cast("long").alias("n_chapters"))


def attached_slices(spark, d):
    return _long(D.attach_slices(D.unit_parts(old_digests(spark, d), KEYS), KEYS), "unit_no", "opener", "entry")


def slices_per_entry(spark, d):
    return _long(D.slices_per_entry(old_digests(spark, d), KEYS), "unit_no", "entry")


def unit_stats(spark, d):
    return _long(D.unit_stats(old_digests(spark, d), KEYS), "unit_no")


def reordered(spark, d):
    return _long(D.reorder_digest(old_digests(spark, d), KEYS), "unit_no", "out_no")


def lost_by_reordering(spark, d):
    old = old_digests(spark, d)
    return D.lost_lines(D.digest_lines(old, KEYS), D.reorder_digest(old, KEYS), KEYS)


def lost_by_cleaning(spark, d):
    t = documents(spark, d).select("doc_id", "text")
    new = D.digest_lines(S.clean_books(t, AD), ["doc_id"])
    return D.lost_lines(D.digest_lines(t, ["doc_id"]), new, ["doc_id"], content=T.urstrip)


def lost_by_damage(spark, d):
    """Every seventh line is taken out of the new version; the check must name each of them."""
    old = D.digest_lines(documents(spark, d).select("doc_id", "text"), ["doc_id"])
    return D.lost_lines(old, old.where("line_no % 7 <> 3"), ["doc_id"], content=T.urstrip)


def order_audit(spark, d):
    return _long(D.audit_order(digests(spark, d), KEYS), "unit_no")


def chapter_anchors(spark, d):
    b = _blocks(digests(spark, d))
    return A.anchors(b, D.units(b, KEYS), KEYS)


def resolved_refs(spark, d):
    docs = digests(spark, d)
    b = _blocks(docs)
    return _long(A.resolve_refs(docs, b, D.units(b, KEYS), KEYS), "ord")


def nav_chapters(spark, d):
    docs = digests(spark, d)
    b = _blocks(docs)
    return A.nav_chapters(docs, index(spark, d), A.anchors(b, D.units(b, KEYS), KEYS), b)


def nav_without_index(spark, d):
    docs = digests(spark, d)
    b = _blocks(docs)
    none = index(spark, d).where("false")
    return A.nav_chapters(docs, none, A.anchors(b, D.units(b, KEYS), KEYS), b)


def digest_stats(spark, d):
    """People of a book: its documents labelled good."""
    docs = digests(spark, d)
    b = _blocks(docs)
    u = D.units(b, KEYS)
    nav = A.nav_chapters(docs, index(spark, d), A.anchors(b, u, KEYS), b)
    good = read_table(spark, d, "labels", "doc_id", "quality").where("quality = 1")
    people = read_table(spark, d, "documents", "doc_id", "source").join(good, "doc_id").select(
        F.col("source").alias("book_id"))
    return A.digest_stats(docs, u, nav, people)


_HEAD = "x8 || '（第' || (i + 1) || '–' || (i + 6) || '章）'"
OLD = LN + """,
od AS (SELECT book_id, doc_id, i, i // 7 AS g, i % 7 AS r,
  trim(l) AS x FROM ln)"""
_ANCHORS = """an AS (SELECT book_id, doc_id, i + k AS ch, CASE WHEN k = 3 AND has THEN 's' || (i + 3) || '-1'
    ELSE 'u-' || (g + 1) END AS anchor FROM (SELECT a.*, EXISTS (SELECT 1 FROM dg b WHERE b.doc_id = a.doc_id
    AND b.i = a.i + 3) AS has FROM dg a WHERE r = 0), (SELECT unnest(generate_series(1, 6)) AS k))"""

QUERIES = {
    "digest_blocks": (digest_blocks, f"""WITH {DG}, b AS (
        SELECT book_id, doc_id, i, g, 'h' AS kind, 2 AS level, '单元' || (g + 1) || '｜' || {_HEAD} AS text,
          CAST(NULL AS BIGINT) AS n_items, CAST(NULL AS VARCHAR) AS chapter FROM dg WHERE r = 0
        UNION ALL SELECT book_id, doc_id, min(i), g, 'ul', NULL, NULL, count(*), NULL FROM dg WHERE r IN (1, 2) GROUP BY ALL
        UNION ALL SELECT a.book_id, a.doc_id, a.i, a.g, 'slice', NULL, coalesce(q.x, ''), NULL, '第' || a.i || '章 甲'
          FROM dg a LEFT JOIN dg q ON q.doc_id = a.doc_id AND q.i = a.i + 1 WHERE a.r = 3
        UNION ALL SELECT book_id, doc_id, i, g, 'p', NULL, x, NULL, NULL FROM dg WHERE r = 5 AND x <> '')
      SELECT book_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS block_no, i AS line_no, kind, level, text,
        n_items, chapter, g + 1 AS bucket_no FROM b"""),
    "digest_units": (digest_units, f"""WITH {DG} SELECT book_id, doc_id, g + 1 AS bucket_no, 'unit' AS kind, g + 1 AS num,
      {_HEAD} AS title, i + 1 AS ch_from, i + 6 AS ch_to, 'u-' || (g + 1) AS anchor FROM dg WHERE r = 0"""),
    "unit_titles": (unit_titles, f"""WITH {DG} SELECT book_id, doc_id, g + 1 AS num,
      coalesce(nullif(trim(regexp_replace({_HEAD}, '[（(].*[）)]\\s*$', '')), ''), {_HEAD}) AS title FROM dg WHERE r = 0"""),
    "document_titles": (document_titles, f"""WITH {LN}, h AS (SELECT book_id, doc_id,
        arg_min(CASE WHEN i = 0 THEN l ELSE l[3:] END, i) AS t FROM ln
        WHERE i < 20 AND ((i = 0 AND l <> '') OR (i > 0 AND regexp_matches(l, '^# .'))) GROUP BY ALL)
      SELECT d.source AS book_id, d.doc_id, coalesce(trim(h.t), '') AS title FROM documents d LEFT JOIN h USING (doc_id)"""),
    "labelled_entries": (labelled_entries, f"""WITH {DG} SELECT book_id, doc_id, g + 1 AS bucket_no,
      CASE r WHEN 1 THEN '详' ELSE '略' END AS level, CASE r WHEN 1 THEN CAST(i + 2 AS VARCHAR) ELSE (i - 1) || ',' || i END
      AS nums FROM dg WHERE r IN (1, 2)"""),
    "slice_levels": (slice_levels, f"""WITH {DG} SELECT book_id, doc_id, g + 1 AS bucket_no, i AS ch, '详' AS level
      FROM dg WHERE r = 3"""),
    "key_only": (key_only, f"""WITH {DG} SELECT book_id, doc_id, CASE r WHEN 1 THEN 'entry' ELSE 'slice' END AS kind,
      CASE r WHEN 1 THEN '**第' || (i + 2) || '章（详） t' || i || '**：' || x ELSE '第' || i || '章 甲' END AS text
      FROM dg WHERE r IN (1, 3)"""),
    "entries_sorted": (entries_sorted, f"""WITH {OLD} SELECT book_id, doc_id, g + 1 AS unit_no, i AS opener,
      CASE r WHEN 2 THEN '详' ELSE '略' END AS level, CASE r WHEN 2 THEN '甲' ELSE '乙' END AS title,
      CASE r WHEN 2 THEN CAST(i + 2 AS VARCHAR) ELSE (i - 4) || '-' || (i - 3) END AS chpart,
      CASE r WHEN 2 THEN i + 2 ELSE i - 4 END AS min_ch, CAST(CASE r WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS n_chapters
      FROM od WHERE r IN (2, 6)"""),
    "attached_slices": (attached_slices, f"""WITH {OLD} SELECT book_id, doc_id, g + 1 AS unit_no, i AS opener,
      i - 1 AS entry FROM od WHERE r = 3"""),
    "slices_per_entry": (slices_per_entry, f"""WITH {OLD} SELECT book_id, doc_id, g + 1 AS unit_no, i - 1 AS entry,
      count(*) AS slices FROM od WHERE r = 3 GROUP BY ALL"""),
    "unit_stats": (unit_stats, f"""WITH {OLD} SELECT book_id, doc_id, g + 1 AS unit_no,
      count(CASE WHEN r IN (2, 6) THEN 1 END) AS entries, count(CASE WHEN r = 3 THEN 1 END) AS slices,
      CAST(0 AS BIGINT) AS unreadable FROM od GROUP BY ALL"""),
    "reordered_digest": (reordered, f"""WITH {OLD}, o AS (
        SELECT book_id, doc_id, g, 0 AS k, '## 单元' || (g + 1) AS line FROM od WHERE r = 0
        UNION ALL SELECT book_id, doc_id, g, 1, '- **第' || (i - 4) || '-' || (i - 3) || '章（略） 乙**：' || x FROM od WHERE r = 6
        UNION ALL SELECT book_id, doc_id, g, 2, '- **第' || (i + 2) || '章（详） 甲**：' || x FROM od WHERE r = 2
        UNION ALL SELECT book_id, doc_id, g, 3, '' FROM od WHERE r = 3
        UNION ALL SELECT book_id, doc_id, g, 4, '**【原文·第' || (i + 1) || '章】**' FROM od WHERE r = 3
        UNION ALL SELECT book_id, doc_id, g, 5, '> 引' || x FROM od WHERE r = 4)
      SELECT book_id, doc_id, g + 1 AS unit_no, row_number() OVER (PARTITION BY doc_id, g ORDER BY k) - 1 AS out_no, line
      FROM o"""),
    "lost_by_reordering": (lost_by_reordering, """SELECT source AS book_id, doc_id, text AS line, n_chars AS delta
      FROM documents WHERE false"""),
    "lost_by_cleaning": (lost_by_cleaning, f"""WITH {LN} SELECT doc_id, regexp_replace(l, '\\s+$', '') AS line,
      -count(*) AS delta FROM ln WHERE regexp_matches(l, 'https?://|www\\.|(?i:license)') GROUP BY 1, 2"""),
    "lost_by_damage": (lost_by_damage, f"""WITH {LN} SELECT doc_id, regexp_replace(l, '\\s+$', '') AS line, -count(*) AS delta
      FROM ln WHERE i % 7 = 3 AND regexp_matches(l, '\\S') GROUP BY 1, 2"""),
    "order_audit": (order_audit, f"""WITH {DG}, u AS (SELECT book_id, doc_id, g, count(CASE WHEN r IN (1, 2) THEN 1 END) AS e,
        count(CASE WHEN r = 2 THEN 1 END) AS t, count(CASE WHEN r = 1 THEN 1 END) AS o FROM dg GROUP BY ALL)
      SELECT book_id, doc_id, g + 1 AS unit_no, e AS entries, t AS descents, CAST(0 AS BIGINT) AS repeated,
        6 - o - 2 * t AS left_out FROM u"""),
    "chapter_anchors": (chapter_anchors, f"WITH {DG}, {_ANCHORS} SELECT * FROM an"),
    "resolved_refs": (resolved_refs, f"""WITH {DG}, {_ANCHORS}, rf AS (
        SELECT book_id, doc_id, i, 'range' AS kind, i + 1 AS a, i + 6 AS b FROM dg WHERE r = 0
        UNION ALL SELECT book_id, doc_id, i, 'range', i - 1, i FROM dg WHERE r = 2
        UNION ALL SELECT book_id, doc_id, i, 'single', i + 2, i + 2 FROM dg WHERE r = 1
        UNION ALL SELECT book_id, doc_id, i, 'single', i, i FROM dg WHERE r = 3)
      SELECT rf.book_id, rf.doc_id, kind, row_number() OVER (PARTITION BY rf.doc_id, kind ORDER BY i) - 1 AS ord, a, b,
        coalesce(p.anchor, q.anchor) AS anchor FROM rf LEFT JOIN an p ON p.doc_id = rf.doc_id AND p.ch = a
        LEFT JOIN an q ON q.doc_id = rf.doc_id AND q.ch = b"""),
    "nav_chapters": (nav_chapters, f"""WITH {DG}, {_ANCHORS}, {IX} SELECT an.book_id, an.doc_id, ch, title AS label, anchor
      FROM an JOIN ix ON ix.book_id = an.book_id AND ix.idx = an.ch"""),
    "nav_without_index": (nav_without_index, f"""WITH {DG} SELECT book_id, doc_id, i AS ch, '' AS label,
      's' || i || '-1' AS anchor FROM dg WHERE r = 3"""),
    "digest_stats": (digest_stats, f"""WITH {DG}, {IX}, u AS (SELECT doc_id, count(*) AS units, max(i) + 6 AS hi FROM dg WHERE r = 0
        GROUP BY doc_id), n AS (SELECT source AS book_id, count(*) AS n FROM documents GROUP BY source),
      p AS (SELECT source AS book_id, count(*) AS people FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source)
      SELECT d.source AS book_id, d.doc_id, units, least(hi, n) AS chapters, coalesce(people, 0) AS people
      FROM documents d JOIN u USING (doc_id) JOIN n ON n.book_id = d.source LEFT JOIN p ON p.book_id = d.source"""),
}
# the same tables whether a digest is one row or many
for _whole, _cut in (("digest_blocks", digest_blocks_of_parts), ("entries_sorted", entries_of_parts)):
    QUERIES[_cut.__name__] = (_cut, f"SELECT * EXCLUDE (book_id) FROM ({QUERIES[_whole][1]})")
