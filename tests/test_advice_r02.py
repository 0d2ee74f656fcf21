"""Cases of the second advice: explicit ends over whole books."""

import duckdb

from tomewright.queries import registry

FOLDER = "/root/testdata/sf0.01"        # fifty chapters to a book, the last given end is 40


def test_ends_plan_every_chapter(spark):
    fn, sql = registry()["segments_ends_whole"]
    df = fn(spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert sum(r[cols.index("chapters")] for r in got) == con.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert max(r[cols.index("end")] for r in got) > 40
