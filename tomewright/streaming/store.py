"""Chapter text and index that arrive in batches, kept as a store of whole commits.

Each commit writes a folder of its own and then publishes a manifest that
names the live folders.  Readers follow the newest manifest, so they see a
batch whole or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tomewright.session import scratch
from tomewright.sources.files import book_of_path, index_files, list_files, read_files
from tomewright.streaming.ingest import _KEYS, _prepare

TEXT = ("book_id string, name string, length long, modificationTime timestamp, idx long, text string, norm string, "
        "norm_version int, gone boolean, seq long")
INDEX = "book_id string, idx long, title string, chars long, start long, end long, file string, volume string, seq long"
BOOKS = "book_id string, seq long"


class TextStore:
    """Newest version of every chapter file (book_id, name) and the index of every book, below ``path``.

    One writer at a time; any number of readers.  After ``most`` live folders
    a commit is followed by a compaction.  Folders that none of the last
    ``keep`` manifests names are removed, so a reader has that many commits to
    finish.  Manifests are small: they name folders, not rows.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 16, keep: int = 2):
        if most < 1 or keep < 1:
            raise ValueError("most and keep must be >= 1")
        self.spark, self.path, self.most, self.keep = spark, path.rstrip("/"), most, keep
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(conf)

    def _at(self, sub: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}" if sub else self.path)

    def _names(self, sub: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(sub))] if self._fs.exists(self._at(sub)) else []

    # -- manifests --------------------------------------------------------
    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, version: int) -> dict:
        out = self._jvm.java.io.ByteArrayOutputStream()
        stream = self._fs.open(self._at(f"manifests/{version:012d}.json"))
        try:
            self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 65536, False)
        finally:
            stream.close()
        return json.loads(bytes(out.toByteArray()))

    def manifest(self) -> dict:
        """version, parts (live folders) and the last batch of each stream that is part of it."""
        known = self._versions()
        return self._read(known[-1]) if known else {"version": 0, "parts": [], "done": {}}

    def _publish(self, m: dict) -> None:
        """A manifest appears under its name at once and never replaces another."""
        part, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{m['version']:012d}.json")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            raise RuntimeError(f"another writer has published version {m['version']} of {self.path}")
        self._vacuum()

    def _vacuum(self) -> None:
        known = self._versions()
        live = {p for v in known[-self.keep:] for p in self._read(v)["parts"]}
        for v in known[:-self.keep]:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        for name in set(self._names("data")) - live:
            self._fs.delete(self._at(f"data/{name}"), True)

    # -- reading ----------------------------------------------------------
    def _table(self, m: dict, kind: str, schema: str) -> DataFrame:
        if not m["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{p}/{kind}" for p in m["parts"]])

    def _versions_of_text(self, m: dict) -> DataFrame:
        """Rows of the newest version of every key, ``gone`` ones included; versions are compared without their text."""
        rows = self._table(m, "text", TEXT)
        return rows if len(m["parts"]) < 2 else rows.join(rows.groupBy(*_KEYS).agg(F.max("seq").alias("seq")), [*_KEYS, "seq"], "left_semi")

    def _live(self, m: dict) -> DataFrame:
        return self._versions_of_text(m).where("NOT gone").drop("gone", "seq")

    def text(self) -> DataFrame:
        """book_id, name, length, modificationTime, idx, text, norm, norm_version of every chapter that is there."""
        return self._live(self.manifest())

    def _index(self, m: dict) -> DataFrame:
        rows, books = self._table(m, "index", INDEX), self._table(m, "books", BOOKS)
        return rows.join(books.groupBy("book_id").agg(F.max("seq").alias("seq")), ["book_id", "seq"], "left_semi").drop("seq")

    def index(self) -> DataFrame:
        """Index of every book that has a chapter."""
        return self._index(self.manifest())

    # -- writing ----------------------------------------------------------
    def commit(self, files: DataFrame, listing: DataFrame | None = None, stream: str = "", batch_id: int | None = None,
               depth: int = 1, trust_utf8: bool = False) -> bool:
        """Add a batch of files and index the books it touches; False if this batch is part of the store already.

        ``files`` is a ``binaryFile`` table or a listing (path, modificationTime,
        length), of which only the files that count are read.
        Of files with equal (book, name) the one changed last counts.  With a
        ``listing`` (path of all files there are) chapters without a file are
        removed.  A failed commit leaves the store as it was.
        """
        m = self.manifest()
        if batch_id is not None and m["done"].get(stream, -1) >= batch_id:
            return False
        key = [book_of_path(F.col("path"), depth).alias("book_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name")]
        last = files.groupBy(*key).agg(F.max(F.struct("modificationTime", "path")).alias("_x")).select(F.col("_x.path").alias("path"))
        files = files.join(last, "path", "left_semi")
        rows = _prepare(files if "content" in files.columns else read_files(files), depth, trust_utf8).withColumn("gone", F.lit(False))
        if listing is not None and m["parts"]:
            lost = self._live(m).select(*_KEYS).join(listing.select(*key).distinct(), _KEYS, "left_anti").withColumn("gone", F.lit(True))
            rows = rows.unionByName(lost, allowMissingColumns=True)
        done = m["done"] | ({} if batch_id is None else {stream: batch_id})
        m = self._write(m, rows, done)
        if len(m["parts"]) > self.most:
            self.compact()
        return True

    def _columns(self, schema: str, seq: int) -> list:
        fields = self.spark.createDataFrame([], schema).schema
        return [F.lit(seq).cast("long").alias("seq") if f.name == "seq" else F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]

    def _write(self, m: dict, rows: DataFrame, done: dict) -> dict:
        part, seq = uuid.uuid4().hex, m["version"] + 1
        at = f"{self.path}/data/{part}"
        new = {"version": seq, "parts": [*m["parts"], part], "done": done}
        try:
            rows.select(*self._columns(TEXT, seq)).write.parquet(f"{at}/text")
            touched = self.spark.read.schema(TEXT).parquet(f"{at}/text").select("book_id", "seq").distinct()
            touched.write.parquet(f"{at}/books")
            books = self.spark.read.schema(BOOKS).parquet(f"{at}/books")
            with scratch(self.spark):
                mine = self._live(new).select("book_id", "name", "text").join(books, "book_id", "left_semi")
                index_files(mine).select(*self._columns(INDEX, seq)).write.parquet(f"{at}/index")
            self._publish(new)
        except BaseException:
            self._fs.delete(self._at(f"data/{part}"), True)
            raise
        return new

    def compact(self) -> None:
        """Write what is live as one folder, laid out by book and name."""
        m = self.manifest()
        part, seq = uuid.uuid4().hex, m["version"] + 1
        at = f"{self.path}/data/{part}"
        try:
            live = self._live(m).withColumn("gone", F.lit(False))
            live.select(*self._columns(TEXT, seq)).repartitionByRange("book_id", "name").sortWithinPartitions("book_id", "name").write.parquet(f"{at}/text")
            self._index(m).select(*self._columns(INDEX, seq)).repartitionByRange("book_id", "idx").write.parquet(f"{at}/index")
            self.spark.read.schema(INDEX).parquet(f"{at}/index").select(*self._columns(BOOKS, seq)).distinct().write.parquet(f"{at}/books")
            self._publish({"version": seq, "parts": [part], "done": m["done"]})
        except BaseException:
            self._fs.delete(self._at(f"data/{part}"), True)
            raise


def store_stream(spark: SparkSession, landing: str, store: TextStore, checkpoint: str, depth: int = 1,
                 trust_utf8: bool = False, mirror: bool = True) -> DataStreamWriter:
    """Writer that commits arriving files to ``store``; a batch repeated after a failure counts once.

    A changed chapter arrives under another path with the same book and name
    (a stream reads no path twice).  ``mirror`` removes chapters whose files are
    gone from the landing folder with every batch that brings files.

    Every trigger lists the landing folder by tasks (``list_files``) and writes
    the paths it takes below ``checkpoint``; the driver holds none of them.  The
    source itself is a clock that ticks once a trigger, so give an interval.
    """
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    taken = f"{checkpoint.rstrip('/')}/taken"
    kind = "path string, modificationTime timestamp, length long"

    def there(path: str) -> bool:
        at = fs.Path(path)
        return at.getFileSystem(conf).exists(at)

    def write(_: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            listing, mine = list_files(spark, landing), f"{taken}/batch={batch_id}"
            if not there(f"{mine}/_SUCCESS"):               # a repeated batch takes the same files
                new = listing.where(F.col("path").rlike(r"(?i)\.(txt|md)$"))
                if there(taken):
                    seen = spark.read.schema(f"{kind}, batch long").parquet(taken).where(F.col("batch") < batch_id)
                    new = new.join(seen.select("path"), "path", "left_anti")
                new.select("path", "modificationTime", "length").write.mode("overwrite").parquet(mine)
            files = spark.read.schema(kind).parquet(mine)
            if not files.isEmpty():
                store.commit(files, listing.select("path") if mirror else None, checkpoint, batch_id, depth, trust_utf8)

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return clock.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
