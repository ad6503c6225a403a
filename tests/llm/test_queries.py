"""Queries with SQL against DuckDB, and the pipeline's stages against plain versions."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import quality, queries, secrets, simhash

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.sql(queries.SQL[name]).select(*cols).fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want, key=str)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, DIR).collect()
    good = {r.doc_id for r in quality.scored(docs, quality.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))).where("score >= 0.3").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    fps = {i: simhash.simhash(t.encode()) for i, t in rows.items()}
    part = dict.fromkeys(rows)
    for i in sorted(rows):
        todo = [i] if part[i] is None else []
        while todo:
            j = todo.pop()
            part[j] = i
            todo += [k for k in rows if part[k] is None and (fps[j] ^ fps[k]).bit_count() <= 3]
    kept = {i for i in rows if part[i] == i}
    hit = {r.doc_id for r in queries.QUERIES["op9_decontaminate"](spark, DIR).where("contaminated").collect()}
    assert {r.doc_id for r in out} == kept - hit
    assert sorted(r.slot for r in out) == list(range(len(out)))
    assert all("[SECRET]" in r.text or r.text == rows[r.doc_id] for r in out)
    assert any(secrets.all_spans(t.encode())[0] for t in rows.values())


KINDS = "doc_id long, text string, lang string, source string, n_chars long, h0 string, h1 long, slot string, least string"


@pytest.fixture(scope="module")
def clashing(spark):
    """Rows that share an id but not a text, rows without an id, equal rows, and columns named as the stages name theirs."""
    unlike = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    rows = [(1, unlike[0], "a"), (1, unlike[1], "a"), (None, unlike[2], "b"), (None, unlike[3], None), (2, None, "a"), (3, "", "a"), (1, unlike[0], "a"), (4, unlike[0].upper(), "b")]
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 7, "y", "z") for i, t, s in rows], KINDS), unlike


def _texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_duplicates_by_row(spark, clashing):
    docs, unlike = clashing
    out = corpus_pipeline.drop_near_duplicates(spark, docs, DIR)
    assert out.columns == docs.columns
    got = _texts(out)
    # the null and the empty text have fingerprint 0 both
    assert got == sorted([(1, unlike[0]), (1, unlike[1]), (None, unlike[2]), (None, unlike[3]), (2, None)], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), DIR).count() == 0


def test_benchmark_by_row(spark, clashing, tmp_path):
    docs, unlike = clashing
    spark.createDataFrame([(1, unlike[1]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.drop_benchmark_passages(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert _texts(out) == sorted([(r.doc_id, r.text) for r in docs.collect() if r.text != unlike[1]], key=str)
    assert corpus_pipeline.drop_benchmark_passages(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_secrets_and_quality_by_row(spark, clashing):
    docs, unlike = clashing
    assert _texts(corpus_pipeline.redact_secrets(spark, docs, DIR)) == _texts(docs)
    x = [1.0] * len(quality.NAMES)
    model = quality.Model(np.zeros((len(x), quality.BINS - 1)), np.zeros((len(x), quality.BINS)), 5.0)
    assert _texts(quality.keep(docs, model)) == _texts(docs)
    model.bias = -5.0
    assert quality.keep(docs, model).count() == 0 == quality.keep(docs.limit(0), model).count()


def test_mixing_by_row(spark, clashing):
    docs, unlike = clashing
    out = corpus_pipeline.mix_sources(spark, docs, DIR)
    assert out.columns == [c for c in docs.columns if c != "slot"] + list(corpus_pipeline.ORDER)
    rows = out.collect()
    assert sorted(r.slot for r in rows) == list(range(8))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert sorted(((r.doc_id, r.text, r.source) for r in rows), key=str) == sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=str)
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), DIR).count() == 0
