"""Index checks, batches, segments, sources, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright.operators import coverage as C
from tomewright.operators.ordered import first_of
from tomewright.plans import reading as R
from tomewright.queries.base import IX, index
from tomewright.sources.tables import read_table

TARGET = 20000
ENDS = [10, 25, 40]


def _labelled(spark, d):
    return read_table(spark, d, "labels").select("doc_id", "quality", "toxic")


def index_violations(spark, d):
    """Index of the labelled documents only (gaps), toxic ones listed twice (duplicates)."""
    ix = index(spark, d).join(_labelled(spark, d), "doc_id")
    rows = ix.select("book_id", "idx", "chars", "toxic")
    rows = rows.unionByName(rows.where("toxic = 1")).drop("toxic")
    return R.validate_index(rows, 1)


def batches_grid(spark, d):
    return R.plan_batches(index(spark, d), 12, "grid", 5)


def batches_local(spark, d):
    return R.plan_batches(index(spark, d), 12, "local", 5)


def _segments(plan):
    return plan.select("book_id", "segment", "start", "end", "chapters", "chars", "batches", "first_title",
                       "last_title", "directory", "next_start")


def segments_count(spark, d):
    return _segments(R.plan_segments(index(spark, d), per=8))


def _closed(ix, ends):
    """The given ends, closed by the last chapter of the index."""
    last = ix.agg(F.max("idx")).first()[0] or 1
    return [e for e in ends if e < last] + [last]


def segments_ends(spark, d):
    """All chapters of all books, numbered from one."""
    ix = index(spark, d)
    return _segments(R.plan_segments(ix, ends=_closed(ix, ENDS)))


def segments_ends_whole(spark, d):
    """All chapters of all books, numbers continued from an earlier plan."""
    ix = index(spark, d)
    return _segments(R.plan_segments(ix, ends=_closed(ix, ENDS), first_number=4))


def segments_budget(spark, d):
    return _segments(R.plan_segments(index(spark, d), target_chars=TARGET))


def ends_outside(spark, d):
    return R.check_ends(None, index(spark, d), ENDS).select("book_id", "lo", "hi")


def plan_continuity(spark, d):
    ix = index(spark, d)
    return R.audit_plan(R.plan_segments(ix, target_chars=TARGET), ix)


def resume_points(spark, d):
    """Segments are accepted when none of their documents is labelled toxic."""
    ix = R.assign_segments(index(spark, d), per=8).join(_labelled(spark, d), "doc_id", "left")
    seg = ix.groupBy("book_id", "segment_no").agg(
        F.max("idx").alias("end"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return R.resume_point(seg.where("t = 0"))


def source_files(spark, d):
    """Files in several naming styles by language; the index records a path for English chapters."""
    ix = index(spark, d).join(read_table(spark, d, "documents", "doc_id", "lang"), "doc_id")
    n = F.col("idx").cast("string")
    four = F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)
    path = (F.when(F.col("lang") == "en", F.concat(F.lit("raw/doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
            .when(F.col("lang") == "fr", F.concat(F.lit("raw/第"), four, F.lit("章_x.txt")))
            .when(F.col("lang") == "es", F.concat(F.lit("raw/"), four, F.lit("_y.txt"))))
    ix = ix.withColumn("_p", path)
    files = ix.where("_p is not null").select("book_id", F.col("_p").alias("path"))
    given = F.when(F.col("lang") == "en", F.concat(F.lit("old/doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    rows = ix.withColumn("file", F.coalesce(given, F.lit(""))).select("book_id", "idx", "file")
    return R.locate_sources(rows, files).select("book_id", "idx", "path")


def _digest_parts(spark, d):
    """One digest per book, stored as one text part per labelled document."""
    ix = index(spark, d).join(_labelled(spark, d), "doc_id")
    n = F.col("idx").cast("string")
    text = F.when(F.col("quality") == 1, F.concat(F.lit("- **第"), n, F.lit("章（详） 甲**：乙"))).otherwise(
        F.concat(F.lit("- **第 "), n, F.lit("–"), (F.col("idx") + 1).cast("string"), F.lit(" 章（略）**：丙，见第0章")))
    return ix.select("book_id", F.lit("digest").alias("doc_id"), text.alias("text"))


PARTS = f"""WITH {IX},
 refs AS (SELECT book_id, idx AS ch FROM ix JOIN labels USING (doc_id)
   UNION SELECT book_id, idx + 1 FROM ix JOIN labels USING (doc_id) WHERE quality = 0),
 cov AS (SELECT ix.book_id, ix.idx AS ch, ix.title, ix.chars, refs.ch IS NOT NULL AS hit FROM ix LEFT JOIN refs
   ON refs.book_id = ix.book_id AND refs.ch = ix.idx)"""


def chapter_refs(spark, d):
    return C.extract_refs(_digest_parts(spark, d), index(spark, d))


def covered_chapters(spark, d):
    return C.covered_chapters(_digest_parts(spark, d), index(spark, d))


def missing_chapters(spark, d):
    return C.missing_chapters(_digest_parts(spark, d), index(spark, d))


def coverage_summary(spark, d):
    return C.coverage(_digest_parts(spark, d), index(spark, d), fail_under=0.5)


def coverage_in_scope(spark, d):
    return C.coverage(_digest_parts(spark, d), index(spark, d), 10, 40)


def missing_runs(spark, d):
    return C.missing_runs(_digest_parts(spark, d), index(spark, d))


def missing_runs_first(spark, d):
    """The first twelve missing runs of each digest."""
    return first_of(missing_runs(spark, d), ["book_id", "doc_id"], ["first"], 12)


def missing_chapters_first(spark, d):
    """The first twenty missing chapters of each digest, numbered."""
    return first_of(missing_chapters(spark, d), ["book_id", "doc_id"], ["ch"], 20, "no")


_SEG = """SELECT book_id, '段' || CASE WHEN no < 10 THEN '0' ELSE '' END || no AS segment, "start", "end", chapters, chars,
  CAST((chapters + 11) // 12 AS BIGINT) AS batches, first_title, last_title,
  '第' || "start" || '-' || "end" || '章' AS directory,
  CASE WHEN lead("start") OVER (PARTITION BY book_id ORDER BY "start") IS NOT NULL THEN "end" + 1 END AS next_start
  FROM (SELECT book_id, seg + {first} AS no, min(idx) AS "start", max(idx) AS "end", count(*) AS chapters,
    CAST(sum(chars) AS BIGINT) AS chars, arg_min(title, idx) AS first_title, arg_max(title, idx) AS last_title
    FROM s GROUP BY book_id, seg)"""

_BUDGET = f"""WITH RECURSIVE {IX},
 f(book_id, idx, seg, acc) AS (SELECT book_id, idx, CAST(0 AS BIGINT), chars FROM ix WHERE idx = 1
   UNION ALL SELECT ix.book_id, ix.idx, CASE WHEN f.acc >= {TARGET} THEN f.seg + 1 ELSE f.seg END,
     CASE WHEN f.acc >= {TARGET} THEN ix.chars ELSE f.acc + ix.chars END
   FROM f JOIN ix ON ix.book_id = f.book_id AND ix.idx = f.idx + 1),
 s AS (SELECT ix.*, f.seg FROM ix JOIN f USING (book_id, idx))"""

_BATCH = """SELECT book_id, batch, "start", "end", chapters, chars, '单元' || CASE WHEN batch < 10 THEN '0' ELSE '' END
  || batch || '_第' || "start" || '-' || "end" || '章' AS unit FROM (SELECT book_id, batch, min(idx) AS "start",
  max(idx) AS "end", count(*) AS chapters, CAST(sum(chars) AS BIGINT) AS chars FROM b GROUP BY book_id, batch)"""

QUERIES = {
    "index_violations": (index_violations, f"""WITH {IX},
      r AS (SELECT book_id, idx, toxic FROM ix JOIN labels USING (doc_id)),
      g AS (SELECT book_id, idx, lag(idx, 1, 0) OVER (PARTITION BY book_id ORDER BY idx) AS p FROM r)
      SELECT book_id, 'duplicate' AS kind, idx AS first, idx AS last FROM r WHERE toxic = 1
      UNION ALL SELECT book_id, 'gap', p + 1, idx - 1 FROM g WHERE idx > p + 1"""),
    "batches_grid": (batches_grid, f"""WITH {IX}, b AS (SELECT *, (idx - 1) // 12 + 1 AS batch FROM ix WHERE idx >= 5)
      {_BATCH}"""),
    "batches_local": (batches_local, f"""WITH {IX}, b AS (SELECT *, (idx - 5) // 12 + 1 AS batch FROM ix WHERE idx >= 5)
      {_BATCH}"""),
    "segments_count": (segments_count, f"WITH {IX}, s AS (SELECT *, (idx - 1) // 8 AS seg FROM ix) "
                       + _SEG.format(first=1)),
    "segments_ends": (segments_ends, f"""WITH {IX}, s AS (SELECT *, CASE WHEN idx <= 10 THEN 0
      WHEN idx <= 25 THEN 1 WHEN idx <= 40 THEN 2 ELSE 3 END AS seg FROM ix) """ + _SEG.format(first=1)),
    "segments_ends_whole": (segments_ends_whole, f"""WITH {IX}, s AS (SELECT *, CASE WHEN idx <= 10 THEN 0
      WHEN idx <= 25 THEN 1 WHEN idx <= 40 THEN 2 ELSE 3 END AS seg FROM ix) """ + _SEG.format(first=4)),
    "segments_budget": (segments_budget, _BUDGET + " " + _SEG.format(first=1)),
    "segment_ends_outside": (ends_outside, f"""WITH {IX} SELECT book_id, min(idx) AS lo, max(idx) AS hi FROM ix
      GROUP BY book_id HAVING max(idx) <> 40 OR min(idx) > 10"""),
    "plan_continuity": (plan_continuity, _BUDGET + """, p AS (SELECT book_id, seg, min(idx) AS a, max(idx) AS b,
        count(*) AS n, sum(chars) AS c FROM s GROUP BY book_id, seg),
      q AS (SELECT *, lag(b) OVER (PARTITION BY book_id ORDER BY a) AS pb FROM p),
      t AS (SELECT book_id, count(CASE WHEN a <> pb + 1 THEN 1 END) AS breaks, CAST(sum(n) AS BIGINT) AS planned,
        CAST(sum(c) AS BIGINT) AS planned_chars FROM q GROUP BY book_id)
      SELECT t.*, w.chapters, w.chars, breaks = 0 AND planned = w.chapters AND planned_chars = w.chars AS passed
      FROM t JOIN (SELECT book_id, count(*) AS chapters, CAST(sum(chars) AS BIGINT) AS chars FROM ix GROUP BY book_id) w
      USING (book_id)"""),
    "resume_points": (resume_points, f"""WITH {IX}, g AS (SELECT book_id, (idx - 1) // 8 AS seg, max(idx) AS e,
        max(coalesce(toxic, 0)) AS t FROM ix LEFT JOIN labels USING (doc_id) GROUP BY book_id, seg)
      SELECT book_id, max(e) + 1 AS resume_at FROM g WHERE t = 0 GROUP BY book_id"""),
    "source_files": (source_files, f"""WITH {IX} SELECT book_id, idx, CASE lang WHEN 'en' THEN 'raw/doc' || doc_id || '.txt'
      WHEN 'fr' THEN 'raw/第' || lpad(CAST(idx AS VARCHAR), greatest(4, length(CAST(idx AS VARCHAR)))::INT, '0') || '章_x.txt'
      WHEN 'es' THEN 'raw/' || lpad(CAST(idx AS VARCHAR), greatest(4, length(CAST(idx AS VARCHAR)))::INT, '0') || '_y.txt' END
      AS path FROM ix JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)"""),
    "chapter_refs": (chapter_refs, PARTS + """ SELECT r.book_id, 'digest' AS doc_id, r.ch FROM refs r
      WHERE r.ch <= (SELECT max(idx) FROM ix WHERE ix.book_id = r.book_id)"""),
    "covered_chapters": (covered_chapters, PARTS + """ SELECT book_id, 'digest' AS doc_id, ch FROM cov
      WHERE hit"""),
    "missing_chapters": (missing_chapters, PARTS + """ SELECT book_id, 'digest' AS doc_id, ch FROM cov
      WHERE NOT hit AND book_id IN (SELECT book_id FROM refs)"""),
    "coverage_summary": (coverage_summary, PARTS + """ SELECT book_id, 'digest' AS doc_id, count(*) AS total,
      count(CASE WHEN hit THEN 1 END) AS covered, count(CASE WHEN NOT hit THEN 1 END) AS missing,
      round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS rate, count(CASE WHEN hit THEN 1 END) / count(*) >= 0.5 AS passed
      FROM cov WHERE book_id IN (SELECT book_id FROM refs) GROUP BY book_id"""),
    "coverage_in_scope": (coverage_in_scope, PARTS + """, b AS (SELECT DISTINCT book_id FROM refs)
      SELECT b.book_id, 'digest' AS doc_id, count(ch) AS total, count(CASE WHEN hit THEN 1 END) AS covered,
      count(CASE WHEN NOT hit THEN 1 END) AS missing,
      round(count(CASE WHEN hit THEN 1 END) / greatest(count(ch), 1), 4) AS rate,
      count(CASE WHEN hit THEN 1 END) / greatest(count(ch), 1) >= 1.0 AS passed
      FROM b LEFT JOIN (SELECT * FROM cov WHERE ch BETWEEN 10 AND 40) USING (book_id) GROUP BY b.book_id"""),
    "missing_runs": (missing_runs, PARTS + """, m AS (SELECT *, ch - row_number() OVER (PARTITION BY book_id ORDER BY ch) AS k
        FROM cov WHERE NOT hit AND book_id IN (SELECT book_id FROM refs)),
      r AS (SELECT book_id, min(ch) AS first, max(ch) AS last, count(*) AS chapters, arg_min(title, ch) AS title,
        arg_min(chars, ch) AS sample_chars FROM m GROUP BY book_id, k)
      SELECT book_id, 'digest' AS doc_id, first, last, CASE WHEN first = last THEN CAST(first AS VARCHAR)
        ELSE first || '–' || last END AS run, chapters, '第' || first || '章 ' || title AS sample, sample_chars FROM r"""),
}
QUERIES["missing_runs_first"] = (missing_runs_first, f"""SELECT * FROM ({QUERIES["missing_runs"][1]})
  QUALIFY row_number() OVER (PARTITION BY book_id, doc_id ORDER BY first) <= 12""")
QUERIES["missing_chapters_first"] = (missing_chapters_first, f"""SELECT *, CAST(row_number() OVER (PARTITION BY book_id, doc_id ORDER BY ch)
  AS INTEGER) AS no FROM ({QUERIES["missing_chapters"][1]}) QUALIFY no <= 20""")
