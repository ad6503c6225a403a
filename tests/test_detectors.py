"""Rules, dimensions and scores on small texts whose results are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import academic, detector, scoring
from quillspark.sources import lexicons


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, texts, f=detector.rules):
    rows = detector.issues(f(table(spark, texts), alphabet="han")).collect()
    return [sorted((r.category, r.severity, r.text, r.cnt) for r in rows if r.doc_id == i) for i in range(len(texts))]


LONG = "今天小张走过河边看见许多人在散步聊天"  # 18 characters


def test_each_rule(spark):
    texts = [
        "首先，看天气。其次，去公园。最后，回家。",
        "值得注意的是，值得注意的是，闭环。",
        "或许" * 5,
        "或许" * 4,
        "①甲\n②乙\n③丙\n",
        "- 甲\n- 乙\n- 丙\n",
        "天——地",
        "甲；乙丙丁",
        "，一二三四，五六七八。" * 3,
        "\n\n".join([LONG + "也不说话。"] * 3),
        "\n\n".join([LONG + "也不说话。", LONG * 2 + "。", LONG * 4 + "。"]),
        "他走路了。" * 6,
        "虽然天冷，但是人多，同时风大。",
        "随着经济的不断发展，大家高兴。",
        "随着经济的\n发展",
    ]
    got = found(spark, texts)
    assert got[0] == [("three_part_structure", "critical", "首先，看天气。其次，去公园。最后", 1)]
    assert got[1] == [("empty_grand_words", "critical", "闭环", 1), ("mechanical_connectors", "critical", "值得注意的是", 2)]
    assert got[2] == [("hedging_language", "medium", "hedges", 5)]
    assert got[3] == []
    assert got[4] == [("list_addiction", "medium", "list", 1)]
    assert got[5] == []
    assert got[6] == [("punctuation_overuse", "medium", "dash", 1)]
    assert got[7] == [("punctuation_overuse", "medium", "semicolon", 1)]
    assert got[8] == [("excessive_rhetoric", "medium", "parallel", 1)]
    assert [c for c, *_ in got[9]] == ["uniform_paragraphs"]
    assert got[10] == []
    assert got[11] == [("low_burstiness", "style", "sentence length", 1), ("repetitive_starters", "style", "他走", 1)]
    assert got[12] == [("balanced_arguments", "high", "虽然天冷，但是人多，同时", 1)]
    assert got[13] == [("template_sentences", "high", "随着经济的不断发展", 1)]
    assert got[14] == []


def test_flat_and_dull_texts(spark):
    [got] = found(spark, ["甲乙" * 160])
    assert {"emotional_flatness", "low_entropy"} <= {c for c, *_ in got}
    metrics = detector.rules(table(spark, ["甲乙" * 160, "短文", None]), alphabet="han").select("metrics.*").collect()
    assert [m.char_count for m in metrics] == [320, 2, 0]
    assert round(metrics[0].entropy, 3) == 1.0 and metrics[1].entropy is None
    # two bigrams, 160 and 159 times


def test_scores(spark):
    """Weights 8, 4, 2, 1.5, counts up to five, rules up to 60, categories up to 40, five more for low entropy and for flat long texts."""
    texts = ["值得注意的是，" * 7, "首先，看天气。其次，去公园。最后，回家。", "", "甲乙" * 300]
    ruled = detector.rules(table(spark, texts), alphabet="han")
    stats = spark.createDataFrame([(1, ["stat_low_perplexity", "stat_high_top10_bucket"]), (2, list(lexicons.DEFAULT["statistical_weights"]))], "doc_id long, stats array<string>")
    got = {r.doc_id: (r.rule_part, r.stat_part, r.score, r.level) for r in detector.scores(ruled, stats).collect()}
    assert got[0] == (40, 0, 40, "medium")  # 8 x 5
    assert got[1] == (8, 20, 28, "medium")
    assert got[2] == (0, 40, 40, "medium")
    assert got[3] == (3, 0, 13, "low")  # flat and dull, 1.5 each, and both bonuses
    assert [r.level for r in spark.createDataFrame([(75,), (74,), (50,), (25,), (24,)], "s int").select(detector.level(F.col("s")).alias("level")).collect()] == ["very_high", "high", "high", "medium", "low"]


def test_worst_sentences_and_report(spark):
    d = table(spark, ["赋能闭环很好。今天天气不错。随着天气的发展，赋能。换言之好。"])
    rows = detector.worst_sentences(d, 2, alphabet="han").orderBy("rnk").collect()
    assert [(r.rnk, r.score, r.sent) for r in rows] == [(1, 8, "随着天气的发展，赋能。"), (2, 6, "赋能闭环很好。")]
    assert rows[1].reasons == ["赋能", "闭环"]
    ruled = detector.rules(d, alphabet="han")
    one = detector.report(ruled, detector.scores(ruled), detector.worst_sentences(d, alphabet="han")).select(F.from_json("json", "score int, level string, total_issues int, issues map<string, array<struct<text string, count int, severity string>>>, worst_sentences array<struct<sentence string, score int>>").alias("j")).select("j.*").first()
    assert one.total_issues == sum(map(len, one.issues.values())) and one.issues["empty_grand_words"][0]["count"] == 2
    assert [w.score for w in one.worst_sentences] == [8, 6, 3]
    assert detector.score_line(detector.scores(ruled)).first().line.endswith("/100 (low)") or one.score >= 25


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "own.json").write_text('{"empty_grand_words": ["天气"], "hedging_threshold": 1}', encoding="utf-8")
    lex = lexicons.load(tmp_path / "own.json")
    rows = detector.issues(detector.rules(table(spark, ["天气或许好，闭环。"]), lex, "han")).collect()
    assert sorted((r.category, r.text) for r in rows) == [("empty_grand_words", "天气"), ("hedging_language", "hedges")]
    assert lexicons.load(tmp_path / "none.json") == lexicons.DEFAULT
    (tmp_path / "bad.json").write_text('{"unknown": []}', encoding="utf-8")
    with pytest.raises(ValueError):
        lexicons.load(tmp_path / "bad.json")


def test_academic_dimensions(spark):
    filler = "这里写一些普通的话来凑足字数。" * 20
    texts = [
        "研究表明，被广泛应用，被认为是好的。",
        "因此所以。" + "天" * 60,
        "研究研究研究研究，方法方法方法方法方法。",
        "张三（2019）指出，李四（2020）认为，王五（2021）的研究表明好。",
        "数据显示好。第一，甲。第二，乙。第三，丙。",
        "天地。" * 20 + "成效显著，前景广阔。",
        "天地。" * 20 + "成效显著，前景广阔，仍有不足。",
        filler + "必然注定绝对。",
        filler + "必然好。",
        filler + "必然好，可能。",
    ]
    got = found(spark, texts, academic.dimensions)
    assert ("ai_academic_phrases", "critical", "研究表明", 1) in got[0] and [x[2] for x in got[0] if x[0] == "passive_overuse"] == ["被广泛应用", "被认为是"]
    assert ("connector_density", "high", "connectors", 2) in got[1] and sum(x[1] == "info" for x in got[1]) == 2
    assert [x for x in got[2] if x[0] == "synonym_poverty"] == [("synonym_poverty", "medium", "方法", 5), ("synonym_poverty", "medium", "研究", 4)]
    assert ("citation_integration", "medium", "citations", 1) in got[3]
    assert {"data_template", "over_enumeration"} <= {c for c, *_ in got[4]}
    assert "perfect_conclusion" in {c for c, *_ in got[5]} and "perfect_conclusion" not in {c for c, *_ in got[6]}
    certain = [[x[1] for x in g if x[0] == "certainty_overuse"] for g in got[7:]]
    assert certain == [["high"], ["medium"], []]


def test_academic_paragraphs_and_score(spark):
    same = "\n\n".join([f"从{x}角度来看，这个小镇的河边有许多人在散步聊天。" for x in ("这个", "那个", "另外")])
    topic = "\n\n".join(["河边有许多人在散步聊天，大家都很高兴地看着水里的鱼，说着今天的事。" * 4] * 3)
    got = found(spark, [same, topic], academic.dimensions)
    assert [x for x in got[0] if x[0] == "paragraph_uniformity"] == [("paragraph_uniformity", "high", "openers", 1), ("paragraph_uniformity", "high", "paragraph length", 1)]
    assert ("low_topic_diffusion", "high", "diffusion", 1) in got[1]
    one = academic.scores(academic.dimensions(table(spark, ["研究表明，研究表明。"]), alphabet="han")).first()
    # 8 x 1.5 x 2 = 24 for the phrase, and of its 0.7 the whole part
    assert (one.rule_part, one.score) == (16, 16)


def test_routing(spark):
    d = table(spark, ["本文研究表明，样本。", "姐妹们，绝了！！", "“好”“好”“好”" + "天" * 1500, "天气好。", "变量与样本。", "变量" + "天" * 1500])
    assert [r.scene for r in scoring.genre(d, alphabet="han").orderBy("doc_id").collect()] == ["academic", "social", "novel", "general", "general", "general"]
    assert [r.scene for r in scoring.scene_of_model(d, alphabet="han").orderBy("doc_id").collect()] == ["academic", "general", "longform", "general", "academic", "longform"]
    some = {"general": {}, "academic": {}}
    rows = spark.createDataFrame([("auto", 2000), ("auto", 10), ("academic", 10), ("novel", 10)], "s string, n int")
    assert [r.m for r in rows.select(scoring.routed(F.col("s"), F.col("n"), some | {"longform": {}}).alias("m")).collect()] == ["longform", "general", "academic", "longform"]
    assert [r.m for r in rows.select(scoring.routed(F.col("s"), F.col("n"), {"general": {}}).alias("m")).collect()] == ["general"] * 4


def test_segments(spark):
    d = spark.createDataFrame([("　甲。\r\n\r\n乙！丙",), ("",), ("。。\n",), ("a. b\nc",)], "t string")
    assert [r.s for r in d.select(T.sentences(F.col("t")).alias("s")).collect()] == [["甲。", "乙！"], [], [], ["a. b\n"]]
    assert [r.s for r in d.select(T.sentences(F.col("t"), "auto").alias("s")).collect()][3] == ["a.", "b\n"]
    assert [r.p for r in d.select(T.paragraphs(F.col("t")).alias("p")).collect()][0] == ["　甲。\r", "乙！丙"]
    c = spark.createDataFrame([(["b", "a", "b", "a", "c"],), ([],)], "a array<string>").select(T.counted(F.col("a")).alias("c")).collect()
    assert (c[0].c.most, c[0].c.at, c[0].c.kinds, round(c[0].c.e, 6)) == (2, 0, 3, 4.0)
    assert (c[1].c.most, c[1].c.kinds) == (0, 0)


def test_rules_stay_where_their_text_is(spark):
    """no bigram becomes a row, and Han phrases are looked for in Han texts only."""
    d = table(spark, ["首先，甲。其次，乙。最后，丙。", "Plain letters. No more.", None])
    for f in (detector.rules, academic.dimensions, academic.diffusion):
        plan = f(d)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan
    assert [T.needs_han(p) for p in ("首先[，,].*?最后", "(甲|乙)x", "(甲|x)", "[一-龥]+", "[一a]", "甲*", r"(?:①|②).*?\n", "(", "在当今?")] == [True, True, False, True, False, False, False, False, True]
    assert academic.alike(["天地玄黄天地玄黄宇宙", "天地玄黄天地玄黄宇宙"]) == (0.0, 2) and academic.alike([]) == (1.0, 0)
