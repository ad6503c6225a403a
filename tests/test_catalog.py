"""The Spark queries against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillspark.plans import catalog

DIR = "/root/testdata/sf0.001"
ORACLE = catalog.oracle()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 4) + 0.0 if not isinstance(v, (str, bool)) else v

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert cols == sorted(want.columns)
    assert _plain(df.select(*cols).collect()) == _plain(want.select(*cols).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_streaming(spark, tmp_path):
    from quillspark.streaming import scores

    spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 'abc' AS text UNION ALL SELECT timestamp'2024-01-01 00:01:00', '1'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/in")
    q = scores.window_counts(scores.letter_share(stream), "ts", 0.5).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("windows").select("n", "over").collect()] == [(2, 1)]


def test_stateless_streams_and_the_sink(spark, tmp_path):
    from quillspark.streaming import scores

    rows = spark.createDataFrame([(1, "首先，甲。其次，乙。最后，丙。"), (2, "干净"), (2, "干净"), (3, "零​宽")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for k in range(2):  # the second run finds nothing new, and would append nothing if it did
        q = scores.append_scores(stream, f"{tmp_path}/sink", f"{tmp_path}/cp{k}")
        q.processAllAvailable()
        q.stop()
    assert sorted((r.doc_id, r.score) for r in spark.read.json(f"{tmp_path}/sink").collect()) == [(1, 8), (2, 0), (3, 0)]
    q = scores.cleaned(stream).writeStream.format("memory").queryName("clean").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id: r.text for r in spark.table("clean").collect()} == {1: "首先，甲。其次，乙。最后，丙。", 2: "干净", 3: "零宽"}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in ORACLE])
def test_queries_without_sql_run(spark, name):
    df = catalog.QUERIES[name](spark, DIR)
    assert df.columns and df.count() > 0
