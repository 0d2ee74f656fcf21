"""Incremental ingest: chapters arrive over time, only touched books are re-indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tomewright.functions import text as T
from tomewright.session import scratch
from tomewright.sources.files import book_of_path, decode_books, index_files

NORM_VERSION = 1        # raise it when the normal form changes; older rows are then recomputed

_KEYS = ["book_id", "name"]


def _prepare(files: DataFrame, depth: int, trust_utf8: bool) -> DataFrame:
    named = files.where(F.col("path").rlike(r"(?i)\.(txt|md)$")).withColumns({
        "book_id": book_of_path(F.col("path"), depth),
        "name": F.regexp_extract("path", r"([^/]*)$", 1)})
    keep = [*_KEYS, "length", "modificationTime"]
    d = decode_books(named, *keep, trust_utf8=trust_utf8)
    return d.select(*keep, T.name_number(F.col("name")).alias("idx"), "text",
                    T.normalize(F.col("text")).alias("norm"), F.lit(NORM_VERSION).alias("norm_version"))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) else None


def current_text(store: DataFrame) -> DataFrame:
    """Newest version of every chapter file.  Versions are compared without their text."""
    newest = store.groupBy(*_KEYS).agg(F.max("batch").alias("batch"))
    return store.join(newest, [*_KEYS, "batch"], "left_semi")


def ingest_stream(spark: SparkSession, landing: str, store: str, index: str, checkpoint: str,
                  depth: int = 1, trust_utf8: bool = False) -> DataStreamWriter:
    """Writer that appends arriving files to ``store`` and re-indexes the books they touch.

    Both tables are partitioned by micro batch and a batch overwrites only its
    own partition, so a batch repeated after a lost executor or driver leaves
    the same result.
    """
    files = (spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
             .schema("path string, modificationTime timestamp, length long, content binary").load(landing))

    def write(batch: DataFrame, batch_id: int) -> None:
        new = _prepare(batch, depth, trust_utf8)
        new.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        touched = spark.read.parquet(f"{store}/batch={batch_id}").select("book_id").distinct()
        mine = spark.read.parquet(store).where(F.col("batch") <= batch_id).join(touched, "book_id", "left_semi")
        rows = current_text(mine).select("book_id", "name", "text")
        with scratch(spark):
            index_files(rows).write.mode("overwrite").parquet(f"{index}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_index(index: DataFrame) -> DataFrame:
    """Newest index of every book."""
    newest = index.groupBy("book_id").agg(F.max("batch").alias("batch"))
    return index.join(newest, ["book_id", "batch"], "left_semi").drop("batch")


def refresh_text(spark: SparkSession, files: DataFrame, store: str, depth: int = 1,
                 trust_utf8: bool = False) -> DataFrame:
    """Normalise only files whose name, size or time changed; returns the live table.

    ``files`` is a ``binaryFile`` listing.  Stored rows whose file is gone are
    left out of the result.  The listing is compared without reading content.
    """
    listing = files.select(book_of_path(F.col("path"), depth).alias("book_id"),
                           F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "modificationTime")
    same = [*_KEYS, "length", "modificationTime"]
    old = _stored(spark, store)
    if old is None:
        batch = 0
        todo = files
    else:
        last = old.agg(F.max("batch")).first()[0]       # null: the store holds no row yet
        batch = 0 if last is None else last + 1
        done = old.where(F.col("norm_version") == NORM_VERSION).select(*same)
        todo = files.withColumns({"book_id": book_of_path(F.col("path"), depth),
                                  "name": F.regexp_extract("path", r"([^/]*)$", 1)}) \
            .join(done, same, "left_anti").drop("book_id", "name")
    _prepare(todo, depth, trust_utf8).write.mode("overwrite").parquet(f"{store}/batch={batch}")
    live = spark.read.parquet(store).where(F.col("norm_version") == NORM_VERSION)
    return current_text(live.join(listing.select(*same), same, "left_semi"))
