"""The n-gram operators and the features against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ngrams, reports, scoring

HAN = "天地玄黄宇宙洪荒日月盈昃辰宿列张"


def texts(n=12, seed=1):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(HAN[: rng.randrange(4, 16)]) for _ in range(rng.choice((0, 2, 3, 20, 60, 300))))) for i in range(n)]


@pytest.fixture(scope="module")
def made(spark):
    rows = [*texts(), (99, None), (100, "天地\n玄黄")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d, {i: "".join(c for c in t or "" if "一" <= c <= "鿿") for i, t in rows}, ngrams.train(d, "han")


class Plain:
    def __init__(self, hs):
        self.c = [Counter(h[i : i + n] for h in hs for i in range(len(h) - n + 1)) for n in (1, 2, 3)]
        self.v = max(len(self.c[0]), 1000)

    def lp(self, a, b, c):
        one, two, three = self.c
        return math.log2(0.6 * (three[a + b + c] + 0.01) / (two[a + b] + 0.01 * self.v) + 0.4 * (two[b + c] + 0.01) / (one[b] + 0.01 * self.v))

    def series(self, h):
        return [self.lp(*h[i : i + 3]) for i in range(len(h) - 2)]


def test_counts_and_log_probs(spark, made):
    d, hs, model = made
    plain = Plain(hs.values())
    for n in (1, 2, 3):
        assert {r.g: r.c for r in ngrams.table(model, n).collect()} == dict(plain.c[n - 1])
    got = {r.doc_id: r for r in ngrams.perplexity(d, model, "han").collect()}
    assert set(got) == {i for i, h in hs.items() if len(h) >= 3}
    for i, r in got.items():
        s = plain.series(hs[i])
        assert abs(r.avg_lp - sum(s) / len(s)) < 1e-4
    one = {r.g: r.lp for r in ngrams.bigram_log_probs(spark.createDataFrame([("天地",), ("地龙",)], "g string"), model).collect()}
    assert abs(one["地龙"] - math.log2(0.01 / (plain.c[0]["地"] + 0.01 * plain.v))) < 1e-9


def test_series(spark, made):
    d, hs, model = made
    plain = Plain(hs.values())
    got = {r.doc_id: r for r in ngrams.series(d, model, "han").collect()}
    for i, r in got.items():
        x = plain.series(hs[i])
        n, m = len(x), sum(x) / len(x)
        v = sum((y - m) ** 2 for y in x)
        for k in ngrams.LAGS:
            want = sum((x[j] - m) * (x[j - k] - m) for j in range(k, n)) / v if n > k + 2 and v > 1e-12 else 0
            assert abs(r[f"lag{k}"] - want) < 1e-9
        ppl = [2 ** -(sum(x[s : s + 50]) / 50) for s in range(0, n - 49, 25)]
        assert r.n_windows == len(ppl)
        mean = sum(ppl) / max(len(ppl), 1)
        want = math.sqrt(sum((p - mean) ** 2 for p in ppl) / len(ppl)) / mean if len(ppl) >= 3 else 0
        assert abs(r.burst - want) < 1e-9
        y = [x[int(j * n / 256)] for j in range(256)] if n > 256 else x
        if n >= 16:
            mean, k = sum(y) / len(y), len(y)
            power = []
            for f in range(1, k // 2):
                re = sum((z - mean) * math.cos(2 * math.pi * f * t / k) for t, z in enumerate(y))
                im = sum((z - mean) * math.sin(2 * math.pi * f * t / k) for t, z in enumerate(y))
                power.append(max(re * re + im * im, 1e-12))
            want = math.exp(sum(map(math.log, power)) / len(power)) / (sum(power) / len(power))
            assert abs(r.flatness - want) < 1e-6
        else:
            assert r.flatness == 0


def test_moments_and_ranks(spark, made):
    d, hs, model = made
    plain = Plain(hs.values())
    for r in ngrams.moments(d, model, "han").collect():
        x = plain.series(hs[r.doc_id])
        m = sum(x) / len(x)
        v = sum((y - m) ** 2 for y in x) / len(x)
        want = (sum((y - m) ** 3 for y in x) / len(x) / v**1.5, sum((y - m) ** 4 for y in x) / len(x) / v**2 - 3) if len(x) >= 16 and v > 1e-9 else (0, 0)
        assert abs(r.skew - want[0]) < 2e-4 and abs(r.kurt - want[1]) < 2e-4
    ranked = {}
    for g, c in plain.c[1].items():
        ranked.setdefault(g[0], []).append((-c, g))
    place = {g: k for a in ranked.values() for k, (_, g) in enumerate(sorted(a))}
    for r in ngrams.rank_buckets(d, model, "han").collect():
        h = hs[r.doc_id]
        assert r.top10 == sum(place[h[i : i + 2]] < 10 for i in range(len(h) - 1))
    assert {r.doc_id for r in ngrams.rank_buckets(d, model, "han").collect()} == {i for i, h in hs.items() if len(h) >= 30}
    # an empty model knows nothing: everything lies beyond
    none = ngrams.train(d.limit(0), "han")
    assert {(r.top10, r.beyond > 0) for r in ngrams.rank_buckets(d, none, "han").collect()} == {(0, True)}


def test_curvature(spark, made):
    d, hs, model = made
    plain = Plain(hs.values())
    top = [g for g, _ in sorted(plain.c[0].items(), key=lambda x: (-x[1], x[0]))][:11]
    for r in ngrams.curvature(d, model, "han").collect():
        h = hs[r.doc_id]
        if len(h) < 30:
            assert r.value == 0
            continue
        at = range(2, len(h))
        at = random.Random(42).sample(at, 50) if len(at) > 50 else at
        want = [plain.lp(*h[i - 2 : i + 1]) - sum(plain.lp(h[i - 2], h[i - 1], c) for c in [c for c in top if c != h[i]][:10]) / 10 for i in at]
        assert abs(r.value - sum(want) / len(want)) < 1e-9


def test_training_options(spark):
    d = spark.createDataFrame([("天地\n玄黄",)], "text string")
    grams = lambda m: {r.g for r in ngrams.table(m, 2).collect()}
    assert grams(ngrams.train(d, "han")) == {"天地", "地玄", "玄黄"}
    assert grams(ngrams.train(d, "han", per_line=True)) == {"天地", "玄黄"}
    many = spark.range(2000).select(F.concat(F.lit("天地"), F.col("id").cast("string")).alias("text"))
    kept = ngrams.table(ngrams.train(many, "han", holdout=0.2), 1).agg(F.sum("c")).first()[0] / 2
    assert 1500 < kept < 1700


def test_features(spark):
    rows = [(0, "天地玄黄。" * 40), (1, "天地"), (2, None), (3, "\n\n".join(["今天我们去河边看水。明天我们上山看花看树看云。后天在家里休息读书。"] * 3))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = ngrams.train(d, "han")
    a = scoring.analyzed(d, {"primary": m, "human": m}, alphabet="han").collect()
    by = {r.doc_id: r for r in a}
    assert set(by) == {0, 1, 2, 3}
    assert all(by[i][f] == 0 for i in (1, 2) for f in scoring.FEATURES)
    assert by[0].bino_lp_diff == 0 and by[0].wiki_vs_human == 0 and by[0].sent_len_cv == 0 and by[0].sent_len_short_frac == 1
    assert by[3].paragraph_length_cv == 0 and by[3].cross_para_3gram_repeat == 1 and by[3].entropy_cv == 0
    sizes = [9, 12, 9]
    mean = sum(sizes) / 3
    assert abs(by[3].para_sent_len_cv_avg - math.sqrt(sum((s - mean) ** 2 for s in sizes) / 3) / mean) < 1e-9
    flags = {r.doc_id: r for r in scoring.indicators(spark.createDataFrame(a)).collect()}
    assert flags[0].low_sentence_length_cv == 1 and flags[0].low_short_sentence_fraction == 0 and flags[1].low_sentence_length_cv == 0
    assert flags[3].uniform_entropy == 1 and flags[3].low_para_sent_len_cv == 1
    assert all(r.high_curvature == r.low_char_mattr == 0 for r in flags.values())
    assert {r.low_char_mattr for r in scoring.indicators(spark.createDataFrame(a), ("low_char_mattr",)).collect()} == {0, 1}


def test_models(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, float(y := i % 2) * 2 + rng.gauss(0, 1), rng.gauss(0, 1), 5.0, y) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, a double, b double, c double, y int")
    m = scoring.fit(d, "y", ("a", "b", "c"), trained_on="test")
    assert m["coef"][0] > 1 > abs(m["coef"][1]) and m["scale"][2] == 1.0 and m["holdout_accuracy"] > 0.75 and m["n_train"] + m["n_holdout"] == 600
    scoring.write_model(m, f"{tmp_path}/m.json")
    assert scoring.read_model(f"{tmp_path}/m.json") == m
    flat = {"mean": [1.0, 0.0], "scale": [2.0, 0.0], "coef": [1.0, 3.0], "intercept": -1.0}
    zero = spark.createDataFrame([(1, 10, *[5.0, 1.0, *[0.0] * 23])], "doc_id long, char_count int, " + ", ".join(f"{f} double" for f in scoring.FEATURES))
    r = scoring.model_scores(zero, {"general": flat}).first()
    # (5 - 1) / 2 + 3 x 1 - 1; a scale of 0 counts as 1
    assert abs(r.logit - 4) < 1e-12 and r.lr_score == 98 and [x.feature for x in r.top] == ["burstiness", "perplexity"]
    rule = spark.createDataFrame([(1, 50), (2, 30)], "doc_id long, score int")
    got = {x.doc_id: x.score for x in scoring.fused(rule, scoring.model_scores(zero, {"general": flat})).collect()}
    assert got == {1: 88, 2: 30}  # 0.2 x 50 + 0.8 x 98 = 88.4; no model score for the second
    assert {x.doc_id: x.score for x in scoring.fused(rule, None).collect()} == {1: 50, 2: 30}


def test_secondary(spark):
    row = spark.createDataFrame([(1, -3.4, 0.6, 0.61, 1.8), (2, 0.0, 9.0, 0.1, 0.0)], "doc_id long, bino_lp_diff double, curv_mean double, char_mattr double, starter_entropy double")
    assert [r.value for r in scoring.secondary(row).orderBy("doc_id").collect()] == [50.0, 100.0]


def plain_signals(text, model, words):
    """The eleven signals of a Han text, one after another."""
    han = lambda s: "".join(c for c in s if "一" <= c <= "鿿")
    cv = lambda a: math.sqrt(sum((x - sum(a) / len(a)) ** 2 for x in a) / len(a)) / (sum(a) / len(a))
    paras = [p.strip() for p in re.split(r"\n\s*\n", text) if len(han(p)) >= 20]
    many = len(paras) >= 3
    sents = [[h for s in re.split("[。！？]", p) if len(h := han(s)) >= 5] for p in paras]
    every = [s for a in sents for s in a]
    out = dict.fromkeys(reports.SIGNALS)
    if many:
        out["paragraph_length_cv"] = cv([len(han(p)) for p in paras])
        counts = [len(a) for a in sents if a]
        out["para_sent_count_cv"] = cv(counts) if len(counts) >= 3 else None
        tf = [Counter(han(p)[i : i + 2] for i in range(len(han(p)) - 1)) for p in paras]
        df = Counter(g for t in tf for g in t)
        vec = [{g: n * math.log(len(tf) / df[g]) for g, n in t.items()} for t in tf]
        norm = [math.sqrt(sum(v * v for v in t.values())) for t in vec]
        sims = [sum(a[g] * b[g] for g in a.keys() & b.keys()) / (m * n) for a, b, m, n in zip(vec, vec[1:], norm, norm[1:]) if m and n]
        out["cross_para_tfidf_cohesion"] = sum(sims) / len(sims) if sims else None
        grams = [{han(p)[i : i + 3] for i in range(len(han(p)) - 2)} for p in paras]
        union = set().union(*grams)
        out["cross_para_3gram_repeat"] = sum(sum(g in x for x in grams) >= 2 for g in union) / len(union)
        density = [len(re.findall("[，。、！？；：“”‘’（）,.!?;:()]", p)) / len(han(p)) for p in paras]
        out["para_punct_density_cv"] = cv(density) if sum(density) else None
        inner = [cv([len(s) for s in a]) for a in sents if len(a) >= 3]
        out["para_sent_len_cv_avg"] = sum(inner) / len(inner) if len(inner) >= 2 else None
        first, mid = (model.series(h) for h in (han(paras[0]), han(" ".join(paras[1:-1]))))
        ppl = [2 ** -(sum(x) / len(x)) for x in (first, mid)]
        out["first_vs_mid_ppl"] = abs(ppl[0] - ppl[1]) / ppl[1]
    if len(every) >= 5:
        out["starter3_diversity"] = len({s[:3] for s in every}) / len(every)
        out["starter2_max_freq"] = max(Counter(s[:2] for s in every).values()) / len(every)
    h = han(text)
    if len(h) >= 200:
        a, b = (Counter(c for c in x if c in words) for x in (h[: len(h) // 2], h[len(h) // 2 :]))
        share = lambda c, w: (c[w] + 0.5) / ((sum(c.values()) or 1) + 0.5 * len(words))
        out["function_word_kl"] = sum(share(a, w) * math.log(share(a, w) / share(b, w)) for w in words)
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        out["heading_list_density"] = sum(bool(re.match(r"\s*(#{1,6}\s|[-*•]\s|\d+\.\s|（[一二三四五六七八九十]+）|[一二三四五六七八九十]+、)", x)) for x in lines) / len(lines)
    return out


def test_signals(spark):
    rng = random.Random(6)
    words = ["的", "了", "是"]
    sent = lambda: "".join(rng.choice(HAN + "的了是，") for _ in range(rng.randrange(3, 20))) + rng.choice("。！？")
    rows = [(i, "\n\n".join(rng.choice(("", "# ", "一、")) + "".join(sent() for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(7)))) for i in range(25)] + [(98, None), (99, "短")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngrams.train(d, "han")
    plain = Plain(["".join(c for c in t or "" if "一" <= c <= "鿿") for _, t in rows])
    got = {r.doc_id: r for r in reports.signals(d, model, "han", words).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        want = plain_signals(t or "", plain, words)
        for k in reports.SIGNALS:
            assert (got[i][k] is None) == (want[k] is None), (i, k, got[i][k], want[k])
            assert want[k] is None or abs(got[i][k] - want[k]) < 2e-4, (i, k)
    assert sum(got[i].first_vs_mid_ppl is not None for i, _ in rows) > 5


def test_grams_stay_where_their_text_is(spark, made, monkeypatch):
    """No gram is shuffled; a model past the bound is joined, with the same results."""
    d, _, model = made
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    every = {"perplexity": ngrams.perplexity, "moments": ngrams.moments, "series": ngrams.series, "curvature": ngrams.curvature, "buckets": ngrams.rank_buckets, "unigrams": ngrams.unigram_perplexity}
    frames = {k: f(d, model, "han") for k, f in every.items()} | {"entropy": ngrams.entropy(d, "han"), "spread": ngrams.paragraph_entropy_spread(d, "han"), "repeats": ngrams.cross_paragraph_repeats(d, "han")}
    frames["differences"] = ngrams.model_differences(d, dict.fromkeys(ngrams.NAMES, model), "han")
    frames["analyzed"] = scoring.analyzed(d, dict.fromkeys(ngrams.NAMES, model), alphabet="han")
    assert not [k for k, x in frames.items() if "Exchange" in plan(x)]
    looked = {k: {r.doc_id: tuple(r) for r in x.collect()} for k, x in frames.items()}
    monkeypatch.setattr(ngrams, "MOST_GRAMS", 5)
    for k, x in {k: f(d, model, "han") for k, f in every.items()}.items():
        joined = {r.doc_id: tuple(r) for r in x.collect()}
        assert set(joined) == set(looked[k])
        assert all(a == b or abs(a - b) < 2e-4 for i, r in joined.items() for a, b in zip(r, looked[k][i], strict=True)), k


def test_indicators_judge_reported_digits(spark):
    """the thresholds hold for measures as they are reported, of four digits (perplexity three)."""
    row = dict.fromkeys(scoring.FEATURES, 9.0) | {"doc_id": 1, "char_count": 500, "n_windows": 9, "n_paras": 9, "n_sentences": 9, "sentence_n": 9, "char_mattr": 0.9}
    at = row | {"perplexity": 50.0004, "burstiness": 0.11996, "entropy_cv": 0.04996, "diveye_skew": 1.34996, "diveye_excess_kurt": 0.34996, "sent_len_cv": 0.39996, "sent_len_short_frac": 0.07996, "punct_comma_density": 4.49996, "gltr_top10_frac": 0.2, "para_sent_len_cv_avg": 0.34996}
    below = at | {"doc_id": 2, "perplexity": 50.0006, "burstiness": 0.1199, "entropy_cv": 0.0499, "diveye_skew": 1.3499, "diveye_excess_kurt": 0.3499, "sent_len_cv": 0.3999, "sent_len_short_frac": 0.0799, "punct_comma_density": 4.4999, "para_sent_len_cv_avg": 0.3499}
    got = {r.doc_id: sum(r[k] for k in scoring.INDICATORS) for r in scoring.indicators(spark.createDataFrame([at, below])).collect()}
    assert got == {1: 0, 2: 9}
