"""Pages, shelf, reading progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright import fixed as K
from tomewright.operators import catalog as G
from tomewright.operators.ordered import first_of
from tomewright.operators.search import search_index, write_search_index
from tomewright.sources.tables import read_table, spread
from tomewright.streaming.progress import progress_stream, save_stream


def _pages(spark, d):
    """Pages with a path, a chapter range in English titles, and embedded page data (broken on French pages)."""
    p = spread(read_table(spark, d, "pages"))
    n = F.col("page_id").cast("string")
    path = F.concat(F.regexp_replace("url", "^https?://|[?#].*$", ""), F.lit("/"), n, F.lit(".html"))
    lang = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)
    head = F.when(lang == "en", F.concat(F.lit("<title>第"), n, F.lit("–"), (F.col("page_id") + 9).cast("string"),
                                         F.lit("章 "))).when(lang == "de", F.concat(F.lit("<title>《书"), lang, F.lit("》"))) \
        .otherwise("<title>")
    json = F.when(lang == "fr", F.lit("{broken")).otherwise(F.concat(
        F.lit('{"key":"k'), n, F.lit('","unitCount":'), (F.col("page_id") % 5).cast("string"),
        F.lit(',"chapterCount":'), F.length("url").cast("string"), F.lit(',"chars":{"a":"1","b":"2"}}')))
    html = F.concat(F.replace("html", F.lit("<title>"), head),
                    F.lit('<script id="page-data" type="application/json">'), json, F.lit("</script>"))
    return p.select("page_id", path.alias("path"), html.alias("html"))


def page_metadata(spark, d):
    return G.page_metadata(_pages(spark, d), "page_id")


def reader_pages(spark, d):
    p = spread(read_table(spark, d, "pages"))
    return p.groupBy(G.is_reader_page(F.col("html")).alias("is_reader")).agg(F.count("*").alias("pages"))


def _cards(spark, d):
    m = G.page_metadata(_pages(spark, d), "page_id", "path")
    return G.cards(G.group_pages(m, "root").withColumn("label", F.lit("")))


def shelf_cards(spark, d):
    return _cards(spark, d).select("page_id", "book_key", "folder", "card_title", "a", "b", "range_text", "card_kind",
                                   "stats", "search")


def shelf_first_cards(spark, d):
    """The first twenty cards of each shelf in display order."""
    return first_of(_cards(spark, d), ["book_key"], ["card_order", "page_id"], 20, "place").select("book_key", "place", "page_id")


def shelf_groups(spark, d):
    return G.shelf_stats(_cards(spark, d))


def shelf_total(spark, d):
    return G.shelf_total(_cards(spark, d))


def shelf_search(spark, d):
    return G.shelf_search(_cards(spark, d), " Blog ").select("page_id", "book_key")


def shelf_search_titles(spark, d):
    return G.shelf_search(_cards(spark, d), "the").select("page_id", "book_key")


def manifest_rows(spark, d):
    """Each page as a shelf manifest of one book."""
    p = read_table(spark, d, "pages", "page_id", "url")
    n = F.col("page_id").cast("string")
    path = F.regexp_replace("url", "^https?://|[?#].*$", "")
    text = F.concat(F.lit("# 架"), n, F.lit("\n\n## 《书"), n, F.lit("》\n说明 "), path, F.lit("\n- 第一册："), path,
                    F.lit("/a.html\n- [第二册]("), path, F.lit("/b.htm)\n* "), path, F.lit("/c.html\n- 外："), F.col("url"),
                    F.lit("\n- 无路径"))
    return G.parse_manifest(p.select(F.col("page_id").alias("shelf_id"), text.alias("text")))


def manifest(spark, d):
    return manifest_rows(spark, d).select("shelf_id", F.col("line_no").cast("long").alias("line_no"), "kind", "text",
                                          "label", "path")


def manifest_books(spark, d):
    return G.manifest_books(manifest_rows(spark, d)).select("shelf_id", "name", "desc", "digests")


def manifest_pages(spark, d):
    """Manifest items joined to pages that exist under their path."""
    p = read_table(spark, d, "pages", "page_id", "url").withColumn(
        "path", F.concat(F.regexp_replace("url", "^https?://|[?#].*$", ""), F.lit("/a.html")))
    pages = p.groupBy("path").agg(F.min("url").alias("title")).select(
        "path", "title", F.lit(None).cast("string").alias("key"), *[F.lit(0).alias(c) for c in ("units", "chapters", "people")])
    items = manifest_rows(spark, d).where("kind = 'item'").select("shelf_id", "line_no", "label", "path")
    return G.match_pages(items, pages).select("shelf_id", F.col("line_no").cast("long").alias("line_no"), "path", "exists", "folder")


def _saves(spark, d):
    return read_table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("unit_id"), F.floor("value").cast("int").alias("pct"),
        F.col("ts").alias("t"), "event_id")


def shelf_search_indexed(spark, d):
    """Three searches through the written index."""
    from tomewright.session import new_folder
    path = new_folder(spark)
    write_search_index(_cards(spark, d), path)
    found = [search_index(spark, path, q).select(F.lit(q).alias("query"), "page_id", "book_key") for q in (" Blog ", "e/1", "9")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def latest_progress(spark, d):
    return G.latest_progress(_saves(spark, d), tie="event_id")


def continue_reading(spark, d):
    return G.continue_reading(G.latest_progress(_saves(spark, d), tie="event_id"))


def event_metadata(spark, d):
    """Embedded JSON of events, tolerant of other shapes."""
    e = read_table(spark, d, "events", "event_id", "props")
    return e.select("event_id", F.from_json("props", "k string").getField("k").try_cast("long").alias("k"))


def progress_stream_table(spark, d):
    """The same progress computed as a stream over the events file, written as a table and read back."""
    from tomewright.session import new_folder
    out, check = new_folder(spark), new_folder(spark)
    events = (spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema)
              .option("pathGlobFilter", "events.parquet").parquet(d))
    saves = events.select(F.col("user_id").alias("key"), F.col("event_type").alias("unit_id"),
                          F.floor("value").cast("int").alias("pct"), F.col("ts").alias("t"), "event_id")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (progress_stream(saves, "event_id").writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", check).trigger(availableNow=True).start())
    q.awaitTermination()
    return G.latest_progress(spark.read.parquet(out), tie="batch")


def saves_stream_table(spark, d):
    """Which events of each user the throttle rule saves: a stream over the events in four stretches of time, closed by a last row."""
    from tomewright.session import new_folder
    land, out, check = new_folder(spark), new_folder(spark), new_folder(spark)
    e = _saves(spark, d).withColumns({"key": F.col("key").cast("string"), "t": F.col("t").cast("timestamp")}).withColumn("us", F.unix_micros("t"))
    a, b = e.agg(F.min("us"), F.max("us")).first()
    if a is None:
        a = b = 0
    step = (b - a) // 4 + 1
    for i in range(4):
        e.where((F.col("us") >= a + i * step) & (F.col("us") < a + (i + 1) * step)).write.mode("append").parquet(land)
    end = b + 2 * step + 2 * 86400 * 10 ** 6
    spark.range(1).select(*[F.timestamp_micros(F.lit(end)).alias("t") if c == "t" else F.lit(None).cast(e.schema[c].dataType).alias(c)
                            for c in e.columns]).write.mode("append").parquet(land)
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 8).parquet(land)
    saves = save_stream(source, every="8 hours", idle="1 day", late=f"{step} microseconds", tie="event_id")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = saves.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(saves.schema).parquet(f"{out}/batch=*").withColumn("t", F.col("t").cast("timestamp_ntz"))


_SV = """RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS unit_id, CAST(floor(value) AS INTEGER) AS pct, ts, event_id
  FROM events),
 g AS (SELECT *, ts - lag(ts) OVER w <= INTERVAL 1 DAY AS same FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
 v AS (SELECT *, count(*) FILTER (same IS NOT TRUE) OVER (PARTITION BY key ORDER BY ts, event_id) AS visit FROM g),
 f AS (SELECT key, visit, ts, min(event_id) AS event_id FROM v GROUP BY ALL),
 nx AS (SELECT a.key, a.visit, a.ts, min(b.ts) AS nts, arg_min(b.event_id, b.ts) AS nid FROM f a JOIN f b
   ON a.key = b.key AND a.visit = b.visit AND a.ts + INTERVAL 8 HOUR <= b.ts GROUP BY a.key, a.visit, a.ts),
 r AS (SELECT key, visit, min(ts) AS ts, arg_min(event_id, ts) AS event_id FROM f GROUP BY key, visit
   UNION ALL SELECT nx.key, nx.visit, nts, nid FROM r JOIN nx ON r.key = nx.key AND r.visit = nx.visit AND r.ts = nx.ts),
 z AS (SELECT key, visit, ts, event_id FROM v QUALIFY row_number() OVER (PARTITION BY key, visit ORDER BY ts DESC, event_id DESC) = 1)"""
_PAGES = """pg AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS lang,
   regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS base, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t0 FROM pages),
 m AS (SELECT *, base || '/' || page_id || '.html' AS path, trim(replace(replace(replace(replace(replace(
   CASE lang WHEN 'en' THEN '第' || page_id || '–' || (page_id + 9) || '章 ' WHEN 'de' THEN '《书de》' ELSE '' END || t0,
   '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')) AS title,
   CASE WHEN lang <> 'fr' THEN 'k' || page_id END AS key, CAST(CASE WHEN lang <> 'fr' THEN page_id % 5 ELSE 0 END AS INTEGER) AS units,
   CAST(CASE WHEN lang <> 'fr' THEN length(url) ELSE 0 END AS INTEGER) AS chapters,
   CASE WHEN lang <> 'fr' THEN 2 ELSE 0 END AS people FROM pg),
 cd AS (SELECT *, CASE WHEN lang = 'de' THEN '书de' ELSE split_part(path, '/', 1) END AS book_key,
   string_split(path, '/')[-2] AS folder, CASE WHEN lang = 'en' THEN CAST(page_id AS INTEGER) END AS a,
   CASE WHEN lang = 'en' THEN CAST(page_id + 9 AS INTEGER) END AS b, CASE WHEN title = '' THEN
     coalesce(nullif(string_split(path, '/')[-2], ''), page_id || '.html') ELSE title END AS card_title FROM m),
 cards AS (SELECT page_id, book_key, folder, card_title, a, b, chapters, CASE WHEN a IS NULL THEN '' ELSE '第 ' || a || '–' || b || ' 章' END AS range_text,
   'digest' AS card_kind, concat_ws(' · ', CASE WHEN units > 0 THEN '单元 ' || units END,
     CASE WHEN chapters > 0 THEN '可跳转 ' || chapters || ' 章' END, CASE WHEN people > 0 THEN people || ' 人' END) AS stats,
   concat_ws(' ', card_title, CASE WHEN a IS NOT NULL THEN '第 ' || a || '–' || b || ' 章' END,
     CASE WHEN a IS NOT NULL THEN '第' || a || '章 第' || b || '章' END, nullif(folder, ''), page_id || '.html') AS search FROM cd)"""
_BASE = "(SELECT page_id, url, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS p FROM pages)"
_EV = """e AS (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS unit_id,
  CAST(floor(arg_max(value, (ts, event_id))) AS INTEGER) AS pct, max(ts) AS t FROM events GROUP BY user_id),
 l AS (SELECT *, CASE WHEN pct >= 100 THEN '已读完 ✓' ELSE '读到 ' || pct || '%' END AS label FROM e)"""
_MAN = f"""mi AS (SELECT page_id AS shelf_id, 0 AS line_no, 'shelf' AS kind, '架' || page_id AS text, NULL AS label, NULL AS path FROM pages
  UNION ALL SELECT page_id, 2, 'book', '书' || page_id, NULL, NULL FROM pages
  UNION ALL SELECT page_id, 3, 'note', '说明 ' || p, NULL, NULL FROM {_BASE}
  UNION ALL SELECT page_id, 4, 'item', NULL, '第一册', p || '/a.html' FROM {_BASE}
  UNION ALL SELECT page_id, 5, 'item', NULL, '第二册', p || '/b.htm' FROM {_BASE}
  UNION ALL SELECT page_id, 6, 'item', NULL, '', p || '/c.html' FROM {_BASE}
  UNION ALL SELECT page_id, 7, 'item', NULL, '外', url FROM pages
  UNION ALL SELECT page_id, 8, 'note', '- 无路径', NULL, NULL FROM pages)"""

QUERIES = {
    "page_metadata": (page_metadata, f"WITH {_PAGES} SELECT page_id, title, key, units, chapters, people FROM m"),
    "reader_pages": (reader_pages, """SELECT contains(left(html, 8192), 'id="page-data"') AS is_reader, count(*) AS pages
      FROM pages GROUP BY 1"""),
    "shelf_cards": (shelf_cards, f"WITH {_PAGES} SELECT * EXCLUDE (chapters) FROM cards"),
    "shelf_first_cards": (shelf_first_cards, f"""WITH {_PAGES} SELECT book_key, CAST(row_number() OVER (PARTITION BY book_key
      ORDER BY coalesce(a, {K.NO_RANGE_START}), list_slice(list_transform(regexp_extract_all(card_title, '([0-9]+)'),
        lambda x: try_cast(x AS BIGINT)), 1, 3), coalesce(folder, ''), card_title, page_id) AS INTEGER) AS place, page_id
      FROM cards QUALIFY place <= 20"""),
    "shelf_groups": (shelf_groups, f"""WITH {_PAGES} SELECT book_key, count(*) AS digests, CAST(CASE WHEN count(a) = count(*)
      THEN sum(b - a + 1) ELSE sum(chapters) END AS BIGINT) AS chapters FROM cards GROUP BY book_key"""),
    "shelf_total": (shelf_total, f"""WITH {_PAGES} SELECT count(DISTINCT book_key) AS books, count(*) AS digests,
      CAST(sum(coalesce(b - a + 1, chapters)) AS BIGINT) AS chapters FROM cards"""),
    "shelf_search": (shelf_search, f"""WITH {_PAGES} SELECT page_id, book_key FROM cards
      WHERE contains(lower(book_key), 'blog') OR contains(lower(search), 'blog')"""),
    "shelf_search_indexed": (shelf_search_indexed, f"""WITH {_PAGES} SELECT q AS query, page_id, book_key FROM cards,
      (SELECT unnest([' Blog ', 'e/1', '9']) AS q)
      WHERE contains(lower(book_key), lower(trim(q))) OR contains(lower(search), lower(trim(q)))"""),
    "shelf_search_titles": (shelf_search_titles, f"""WITH {_PAGES} SELECT page_id, book_key FROM cards
      WHERE contains(lower(book_key), 'the') OR contains(lower(search), 'the')"""),
    "manifest_rows": (manifest, f"WITH {_MAN} SELECT shelf_id, CAST(line_no AS BIGINT) AS line_no, kind, text, label, path FROM mi"),
    "manifest_books": (manifest_books, f"""SELECT page_id AS shelf_id, '书' || page_id AS name, '说明 ' || p || ' - 无路径' AS "desc",
      CAST(4 AS BIGINT) AS digests FROM {_BASE}"""),
    "manifest_pages": (manifest_pages, f"""WITH {_MAN} SELECT shelf_id, CAST(line_no AS BIGINT) AS line_no, path,
      CASE WHEN regexp_matches(path, '^https?://') THEN NULL ELSE line_no = 4 END AS "exists",
      CASE WHEN regexp_matches(path, '^https?://') THEN '' ELSE string_split(path, '/')[-2] END AS folder
      FROM mi WHERE kind = 'item'"""),
    "latest_progress": (latest_progress, f"WITH {_EV} SELECT * FROM l"),
    "continue_reading": (continue_reading, f"WITH {_EV} SELECT * FROM l ORDER BY t DESC, key DESC LIMIT 1"),
    "event_metadata": (event_metadata, "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "saves_stream_table": (saves_stream_table, f"""WITH {_SV} SELECT v.key, unit_id, pct, v.ts AS t, kind FROM v JOIN (
      SELECT event_id, 'move' AS kind FROM r UNION ALL SELECT event_id, 'leave' FROM z WHERE event_id NOT IN (SELECT event_id FROM r))
      USING (event_id)"""),
    "progress_stream_table": (progress_stream_table, f"WITH {_EV} SELECT * FROM l"),
}
