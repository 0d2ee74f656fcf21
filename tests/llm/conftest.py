import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators give to their own columns
CLASHES = {"score": "x", "size": "x", "target": "x", "copies": "x", "kept": "x", "y": "x", "id": "x", "doc": "x", "spots": "x",
           "base_failed": "x", "n_words": "x", "bands": "x"}


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text[, source]) tuples -> a table like ``documents`` with columns of clashing names."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(3).withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    return make


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
