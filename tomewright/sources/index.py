"""Chapter index input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions import text as T


def _tsv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return (spark.read.option("sep", "\t").option("header", str(header).lower()).option("quote", "")
            .option("enforceSchema", "false").csv(path))


def _role(low: str) -> str | None:
    if low in ("idx", "index", "序号", "序"):
        return "idx"
    if low in ("title", "标题", "章名"):
        return "title"
    if low in ("chars", "字数"):
        return "chars"
    if "file" in low or "路径" in low or "文件" in low:
        return "file"
    return None


def read_index(spark: SparkSession, path: str, book_id: str | None = None) -> DataFrame:
    """Index TSV with header aliases: book_id, idx, title, chars, file.

    Columns are found by name, else by position.  Rows without a number are
    skipped, unreadable sizes count as 0.
    """
    raw = _tsv(spark, path)
    names = [c.strip().lstrip("\ufeff").lower() for c in raw.columns]
    at = {"idx": 0, "title": 1, "chars": 2}
    if "book_id" in names:      # the layout that write_index produces
        at = {role: i + 1 for role, i in at.items()}
    for i, c in enumerate(names):
        if _role(c):
            at[_role(c)] = i
    raw = raw.toDF(*[f"_{i}" for i in range(len(names))])

    def col(role):
        i = at.get(role)
        return F.col(f"_{i}") if i is not None and i < len(names) else F.lit(None).cast("string")

    if book_id is not None or "book_id" not in names:
        book = F.lit(book_id or "book")
    else:
        book = F.col(f"_{names.index('book_id')}")
    return raw.select(book.alias("book_id"), T.ustrip(col("idx")).try_cast("int").alias("idx"),
                      T.ustrip(F.coalesce(col("title"), F.lit(""))).alias("title"),
                      F.coalesce(T.ustrip(col("chars")).try_cast("long"), F.lit(0)).alias("chars"),
                      T.ustrip(F.coalesce(col("file"), F.lit(""))).alias("file")).where("idx is not null")


def read_index_positional(spark: SparkSession, path: str, book_id: str = "book") -> DataFrame:
    """Index TSV by fixed position (idx, title, chars, start, end); bad rows are skipped."""
    raw = _tsv(spark, path)
    raw = raw.toDF(*[f"_{i}" for i in range(len(raw.columns))])
    names = [("idx", "int"), ("title", "string"), ("chars", "long"), ("start", "long"), ("end", "long")]
    picked = [F.col(f"_{i}").try_cast(t).alias(n) if i < len(raw.columns) else F.lit(None).cast(t).alias(n)
              for i, (n, t) in enumerate(names)]
    return raw.select(F.lit(book_id).alias("book_id"), *picked).where("idx is not null")
