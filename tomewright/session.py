"""Session helpers."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tomewright") -> SparkSession:
    """A session with adaptive execution; cluster settings win over these defaults."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = (b.master(master).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


_made: list[str] = []       # folders handed out by this driver


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tomewright-")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder name below the shared one the cluster names.

    Where ``spark.checkpoint.dir`` is unset a local session (a test, a bench)
    uses a temporary folder of this machine; any other is refused, as its
    executors would not see each other's files.  ``release`` removes what a
    session has made.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = _local_folder()
    _made.append(path := f"{folder.rstrip('/')}/tomewright-{uuid.uuid4().hex}")
    return path


def release(spark: SparkSession, since: int = 0) -> int:
    """Remove all intermediate tables made so far (or after the first ``since``); DataFrames built on them can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while len(_made) > since:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables made inside the block go when it ends; for jobs that run again and again."""
    since = len(_made)
    try:
        yield
    finally:
        release(spark, since)


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives lost executors and, unlike a checkpointed plan,
    reports its true size to the planner, which matters where a loop feeds
    results back.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
