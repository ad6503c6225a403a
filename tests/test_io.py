"""Readers, sinks and the command line on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.operators import guards
from quillspark.sources import readers

TEXT = "首先，看天气。其次，去公园。最后，回家。"


def test_texts_and_corpus(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text(TEXT, encoding="utf-8")
    (tmp_path / "t" / "b.txt").write_text(" 　\n", encoding="utf-8")
    assert [r.text for r in readers.read_texts(spark, f"{tmp_path}/t").collect()] == [TEXT]
    lines = [{"id": "1", "text": "", "content": "一二三"}, {"id": "2", "text": "一"}, {"id": "3", "text": "天" * 40 + "\n\n" + "地" * 40, "label": "human"}]
    (tmp_path / "c.json").write_text("\n".join([*map(json.dumps, lines), "not json", "[1]", ""]), encoding="utf-8")
    assert sorted(r.id for r in readers.read_corpus(spark, f"{tmp_path}/c.json", least_han=2).collect()) == ["1", "3"]
    assert [r.id for r in readers.read_corpus(spark, f"{tmp_path}/c.json", label="human", least_paragraphs=2).collect()] == ["3"]
    assert sorted(r.line for r in readers.malformed(spark, f"{tmp_path}/c.json").collect()) == ["[1]", "not json"]


def test_pairs_answers_labelled_chunks(spark, tmp_path):
    qa = {"question": "q", "human_answers": ["天" * 100, "短"], "chatgpt_answers": [c * 120 for c in "地玄黄"], "source": "s"}
    (tmp_path / "qa.json").write_text(json.dumps(qa) + "\n", encoding="utf-8")
    rows = readers.read_answers(spark, f"{tmp_path}/qa.json").collect()
    assert sorted((r.side, len(r.text)) for r in rows) == [("human", 100), ("model", 120), ("model", 120), ("model", 120)]
    some = [sorted(r.text for r in readers.read_answers(spark, f"{tmp_path}/qa.json", seed=s, limit=2).where("side = 'model'").collect()) for s in (1, 1, 2, 3, 4)]
    assert some[0] == some[1] and all(len(x) == 2 for x in some) and len({tuple(x) for x in some}) > 1
    (tmp_path / "p.json").write_text(json.dumps([{"Human_Content": "天" * 200, "AI_Content": c * n} for c, n in (("地", 200), ("玄", 10), ("黄", 300))]), encoding="utf-8")
    assert readers.read_pairs(spark, f"{tmp_path}/p.json").count() == 2 and readers.read_pairs(spark, f"{tmp_path}/p.json", most=1).count() == 1
    (tmp_path / "l.json").write_text(json.dumps([{"text": "甲", "label": 0, "model": "human", "source": "a"}, {"text": "乙", "label": 1, "model": "m", "source": "a"}, {"text": "丙", "label": 0, "model": "human", "source": "b"}]), encoding="utf-8")
    assert [r.text for r in readers.read_labelled(spark, f"{tmp_path}/l.json", "a").collect()] == ["甲"]
    raw = spark.createDataFrame([("=== 题 ===\n" + "天" * 1200,)], "text string")
    assert [len(r.chunk) for r in readers.chunked(raw).collect()] == [500, 500, 201]


def test_append_once(spark, tmp_path):
    path = f"{tmp_path}/sink"
    first = spark.createDataFrame([("1", "x"), ("1", "a"), (None, "n")], "id string, text string")
    readers.append_new(first, path)
    readers.append_new(spark.createDataFrame([("1", "z"), ("2", "y")], "id string, text string"), path)
    assert sorted((r.id, r.text) for r in spark.read.json(path).collect()) == [("1", "a"), ("2", "y")]


def test_traces_assets_grids(spark, tmp_path):
    a, b = (spark.createDataFrame([(1, t)], "doc_id long, text string") for t in ("甲乙", "甲"))
    row = readers.traced([("read", a), ("cut", b)]).first()
    assert row.stages == ["cut"] and row.trace[0].asDict() == {"stage": "cut", "in_chars": 2, "out_chars": 1, "input": "甲乙", "output": "甲"}
    (tmp_path / "big").write_text("x" * 10)
    got = {r.path.rsplit("/", 1)[1]: r.status for r in readers.check_assets(spark, {f"{tmp_path}/big": 5, f"{tmp_path}/none": 1}).collect()}
    assert got == {"big": "OK", "none": "MISSING"} and readers.check_assets(spark, {f"{tmp_path}/big": 50}).first().status == "SMALL"
    scenes = spark.createDataFrame([("s", "t1"), ("s", "t2")], "scene string, topic string")
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    jobs = readers.job_grid(scenes, models)
    assert jobs.count() == 4 and readers.job_grid(scenes, models, jobs.limit(1)).count() == 3
    controls = spark.createDataFrame([("c", "s", "t", "天地a")], "id string, scene string, topic string, text string")
    assert {(r.id, r.chars) for r in readers.matched_grid(controls, models).collect()} == {("c-m1", 2), ("c-m2", 2)}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text(TEXT, encoding="utf-8")
    run = lambda *args: (cli.main(list(map(str, args)), spark), capsys.readouterr())
    code, out = run("detect", tmp_path / "a.txt", "-s")
    assert code == 0 and out.out == "8/100 (low)\n"
    code, out = run("d", tmp_path / "a.txt", "-j")
    assert json.loads(out.out)["issues"]["three_part_structure"][0]["severity"] == "critical"
    assert run("detect", tmp_path / "none.txt")[0] == 1
    (tmp_path / "blank.txt").write_text("\n")
    code, out = run("detect", tmp_path / "blank.txt")
    assert code == 1 and "empty" in out.err
    assert run("academic", tmp_path / "a.txt", "-s")[1].out.startswith("14/100")  # three connectors: 7 x 3 x 0.7
    for args in (("style", "--style", "academic"), ("replace",), ("rewrite",), ("rewrite", "--passes", "tidy"), ("compare",), ("watermark", "--clean")):
        code, out = run(args[0], tmp_path / "a.txt", *args[1:])
        assert code == 0 and out.out.strip(), args
    code, out = run("watermark", tmp_path / "a.txt", "--against", tmp_path / "a.txt")
    assert code == 0 and {json.loads(x)["survival"] for x in out.out.split("\n") if x} == {1.0}
    assert run("doctor", f"{tmp_path}/a.txt:5")[1].out.startswith("OK ")
    assert run("rewrite", tmp_path / "a.txt", "-o", f"{tmp_path}/out")[0] == 0
    assert spark.read.text(f"{tmp_path}/out").agg(F.concat_ws("", F.collect_list("value"))).first()[0] == guards.polish(TEXT)[0]
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)
