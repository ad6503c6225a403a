"""The feature vector of a document, its indicators, and scores from it: fitted logistic models, fused and secondary scores, routing."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.rowwise import added
from quillspark.operators import ngrams
from quillspark.sources import lexicons

# Names and order of the features, the indicators, thresholds and scales.
FEATURES = (
    "perplexity", "burstiness", "entropy_cv", "diveye_skew", "diveye_excess_kurt", "diveye_spectral_flatness", "diveye_autocorr_lag1", "gltr_top10_frac", "gltr_top100_frac",
    "sent_len_cv", "sent_len_short_frac", "sent_len_long_frac", "sent_len_equal_mid_frac", "punct_comma_density", "punct_density", "trans_density", "curv_mean", "bino_lp_diff",
    "uni_tri_ratio", "wiki_vs_human", "wiki_vs_primary", "news_vs_human", "para_sent_len_cv_avg", "paragraph_length_cv", "cross_para_3gram_repeat",
)
INDICATORS = (
    "low_perplexity", "low_burstiness", "uniform_entropy", "low_surprisal_skew", "low_surprisal_kurt", "high_top10_bucket", "low_sentence_length_cv", "low_short_sentence_fraction",
    "low_comma_density", "high_transition_density", "high_curvature", "low_binoculars_diff", "low_char_mattr", "low_para_sent_len_cv",
)
PUNCTUATION = "，。、；：！？（）「」『』“”‘’\"'.,:;!?()[]{}《》—…·"
SECONDARY = {"bino_lp_diff": (0.35, -4.6, -2.2, False), "curv_mean": (0.25, 0.0, 1.2, False), "char_mattr": (0.25, 0.50, 0.72, True), "starter_entropy": (0.15, 1.2, 2.4, True)}
LONG, LEAST = 1500, 30
RULE_SHARE, MODEL_SHARE = 0.2, 0.8


def sentence_lengths(docs: DataFrame, alphabet: str = "letters", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc_id, n, mean_len, cv, short_frac, long_frac, mid_frac) over sentences of three characters or more; zeros under three such sentences."""
    t = F.coalesce("text", F.lit(""))
    parts = T.by_alphabet(t, alphabet, F.split(t, "[。！？\n]", -1), F.split(t, "[.!?\n]+", -1))
    sizes = F.filter(F.transform(parts, lambda s: T.size(s, alphabet)), lambda n: n >= 3)
    d = docs.select(*keep, sizes.alias("a"))
    few = F.size("a") < 3
    share = lambda f: F.when(few, F.lit(0.0)).otherwise(F.size(F.filter("a", f)) / F.size("a"))
    return d.select(*keep, F.size("a").alias("n"), F.when(few, F.lit(0.0)).otherwise(T.mean(F.col("a"))).alias("mean_len"), F.when(few, F.lit(0.0)).otherwise(T.spread(F.col("a"))).alias("cv"), share(lambda n: n < 10).alias("short_frac"), share(lambda n: n > 30).alias("long_frac"), share(lambda n: (n >= 15) & (n <= 25)).alias("mid_frac"))


def densities(docs: DataFrame, lex: dict | None = None, alphabet: str = "letters", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc_id, char_count, comma_density, punct_density, trans_density): marks per hundred characters that aren't white space, transitions per thousand that count."""
    words = (lex or lexicons.load())["transitions"]

    def one(t: str, size: int) -> tuple[float, float, float]:
        n = sum(map(len, t.split()))
        share = lambda marks: sum(map(t.count, set(marks))) / n * 100 if n else 0.0
        return share("，,"), share(PUNCTUATION), sum(map(t.count, words)) / size * 1000 if size >= 50 else 0.0

    t = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, t.alias("_t"), T.size(t, alphabet).alias("char_count"))
    return added(rows, ("_t", "char_count"), one, "comma_density double, punct_density double, trans_density double", ("_t",))


def char_mattr(c: np.ndarray, window: int = 100) -> float:
    """Mean share of distinct characters in windows that overlap by half; 0 under one window."""
    parts = [len(set(c[i : i + window].tolist())) / window for i in range(0, len(c) - window + 1, window // 2)]
    return sum(parts) / len(parts) if parts else 0.0


def paragraph_spreads(docs: DataFrame, alphabet: str = "letters", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc_id, length_cv, sentence_cv, sentence_n): spread of paragraph lengths, mean spread of sentence lengths within paragraphs and how many had one; zeros where too few."""
    t = F.coalesce("text", F.lit(""))
    long = T.paragraphs_by(t, "\n\\s*\n", 20, alphabet)
    longer = T.paragraphs_by(t, "\n\\s*\n", 30, alphabet)
    ends = lambda p: T.by_alphabet(p, alphabet, F.split(p, "[。！？]", -1), F.split(p, "[.!?]+", -1))
    sizes = lambda p: F.filter(F.transform(ends(p), lambda s: T.size(s, alphabet)), lambda n: n >= 5)
    inner = F.transform(F.filter(F.transform("longer", sizes), lambda a: F.size(a) >= 3), T.spread)
    d = docs.select(*keep, F.transform(long, lambda p: T.size(p, alphabet)).alias("long"), longer.alias("longer")).withColumn("inner", F.when(F.size("longer") >= 3, inner).otherwise(F.array().cast("array<double>")))
    return d.select(*keep, F.when(F.size("long") < 3, 0.0).otherwise(T.spread(F.col("long"))).alias("length_cv"), F.when(F.size("inner") < 2, 0.0).otherwise(T.mean(F.col("inner"))).alias("sentence_cv"), F.size("inner").alias("sentence_n"))


def starter_entropy(docs: DataFrame, alphabet: str = "letters", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc_id, starter_entropy): bits over the first two characters of sentences that have two; 0 under five of them."""
    t = F.coalesce("text", F.lit(""))
    heads = F.transform(F.filter(F.transform(F.split(t, "[。！？!?；;.\n]+" if alphabet != "han" else "[。！？!?；;\n]+", -1), lambda s: F.lower(T.extract(s, alphabet))), lambda h: F.length(h) >= 2), lambda h: F.left(h, F.lit(2)))
    d = docs.select(*keep, heads.alias("a"))
    return d.select(*keep, F.when(F.size("a") < 5, 0.0).otherwise(F.log2(F.size("a")) - T.counted(F.col("a"))["e"] / F.size("a")).alias("starter_entropy"))


def analyzed(docs: DataFrame, models: dict[str, DataFrame], lex: dict | None = None, alphabet: str = "letters", own: bool = False) -> DataFrame:
    """A row for each document with everything the vector and the indicators need; all zero under LEAST characters.

    models: by the names of ngrams.NAMES; `primary` is needed, features of missing ones are 0; own: it was trained on these documents. All is worked out where
    the document is, without a shuffle.
    """
    lex = lex or lexicons.load()
    keys = [n for n in ngrams.NAMES if n in models]
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", t.alias("text"), F.lower(T.extract(t, alphabet)).alias("h"), ngrams.counting_parts(t, "\n\\s*\n|\n", 20, alphabet).alias("lines"))
    d = d.withColumn("blocks", F.col("lines") if alphabet == "letters" else ngrams.counting_parts(F.col("text"), "\n\\s*\n", 20, alphabet))
    places, pairs = ngrams.alternatives(models["primary"]), ngrams.ranked_pairs(models["primary"])

    def one(c: np.ndarray, lps: np.ndarray, lines: list[str], blocks: list[str]) -> tuple:
        """Everything that depends on grams; nulls where a text is too short."""
        n = lps.shape[1]
        look = places.value
        return (
            *(map(float, lps.mean(1)) if n else [None] * len(keys)), *(ngrams.shape(lps[0]) if n else (None, None)), *(map(float, ngrams.series_features(lps[0]) if n else [0] * len(ngrams.SERIES))), ngrams.unigram_mean(c, look),
            *(ngrams.ranked_places(c, *pairs.value) or [None] * 4), ngrams.entropy_spread(lines), ngrams.repeated_share(blocks), ngrams.curved(c, lps[0], look), char_mattr(c), len(lines),
        )

    kind = ", ".join(f"{k} double" for k in (*(f"m_{n}" for n in keys), "skew", "kurt", "positions", *ngrams.SERIES[1:], "m_uni")) + ", top10 long, top100 long, top1000 long, beyond long, entropy_cv double, cross_p3 double, curv double, char_mattr double, n_paras int"
    out = ngrams.placed(d, {n: models[n] for n in keys}, one, kind, ("lines", "blocks"), ("h", "lines", "blocks"), own)
    out = densities(out, lex, alphabet, out.columns)
    out = starter_entropy(out, alphabet, out.columns)
    out = sentence_lengths(out, alphabet, out.columns).withColumnsRenamed({"n": "n_sentences", "cv": "sent_cv"})
    out = paragraph_spreads(out, alphabet, out.columns)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    two = lambda c: F.pow(F.lit(2.0), -c)
    buckets = F.col("top10") + F.col("top100") + F.col("top1000") + F.col("beyond")
    diff = lambda a, b: z(F.col(f"m_{a}") - F.col(f"m_{b}")) if a in keys and b in keys else F.lit(0.0)
    shaped = F.col("positions") >= 16
    values = {
        "perplexity": z(two(F.col("m_primary"))), "burstiness": z(F.col("burst")), "entropy_cv": z(F.col("entropy_cv")), "diveye_skew": z(F.col("skew")), "diveye_excess_kurt": z(F.col("kurt")),
        "diveye_spectral_flatness": z(F.col("flatness")), "diveye_autocorr_lag1": z(F.when(shaped, F.col("lag1"))), "gltr_top10_frac": z(F.col("top10") / buckets), "gltr_top100_frac": z(F.col("top100") / buckets),
        "sent_len_cv": z(F.col("sent_cv")), "sent_len_short_frac": z(F.col("short_frac")), "sent_len_long_frac": z(F.col("long_frac")), "sent_len_equal_mid_frac": z(F.col("mid_frac")), "punct_comma_density": F.col("comma_density"),
        "punct_density": F.col("punct_density"), "trans_density": F.col("trans_density"), "curv_mean": z(F.col("curv")), "bino_lp_diff": diff("primary", "human"), "uni_tri_ratio": z(two(F.col("m_uni") - F.col("m_primary"))),
        "wiki_vs_human": diff("wiki", "human"), "wiki_vs_primary": diff("primary", "wiki"), "news_vs_human": diff("news", "human") if "wiki" in keys else F.lit(0.0), "para_sent_len_cv_avg": z(F.col("sentence_cv")), "paragraph_length_cv": z(F.col("length_cv")), "cross_para_3gram_repeat": z(F.col("cross_p3")),
    }
    enough = F.col("char_count") >= LEAST
    gated = [F.when(enough, values[k]).otherwise(0.0).alias(k) for k in FEATURES]
    more = [F.col("char_count"), *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("n_windows", "n_paras", "n_sentences", "sentence_n")], F.col("char_mattr"), F.col("starter_entropy")]
    return out.select("doc_id", *gated, *more)


def vector(a: DataFrame) -> DataFrame:
    """(doc_id, FEATURES)"""
    return a.select("doc_id", *FEATURES)


def indicators(a: DataFrame, enabled: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, INDICATORS as 0/1). Four have no live threshold and are 0 unless named in enabled, which sets their calibrated thresholds.

    Thresholds are held against measures of four digits (perplexity three), as the statistics report them; shares of buckets as they are.
    """
    n = F.col("char_count")
    c = lambda k: F.col(k) if k in ("gltr_top10_frac", "n_windows", "n_paras", "n_sentences", "sentence_n") else F.round(k, 3 if k == "perplexity" else 4)
    off = {"high_transition_density": c("trans_density") > 8, "high_curvature": c("curv_mean") > 0.9, "low_binoculars_diff": c("bino_lp_diff") < -2.2, "low_char_mattr": (c("char_mattr") > 0) & (c("char_mattr") < 0.65)}
    on = {
        "low_perplexity": (c("perplexity") > 50) & (c("perplexity") < 500) & (n >= 200), "low_burstiness": (c("burstiness") < 0.12) & (c("n_windows") >= 6), "uniform_entropy": (c("entropy_cv") < 0.05) & (c("n_paras") >= 3),
        "low_surprisal_skew": (c("diveye_skew") < 1.35) & (n >= 150), "low_surprisal_kurt": (c("diveye_excess_kurt") < 0.35) & (n >= 150), "high_top10_bucket": (c("gltr_top10_frac") > 0.21) & (n >= 150),
        "low_sentence_length_cv": (c("sent_len_cv") < 0.40) & (c("n_sentences") >= 5), "low_short_sentence_fraction": (c("sent_len_short_frac") < 0.08) & (c("n_sentences") >= 5), "low_comma_density": (c("punct_comma_density") < 4.5) & (n >= 100),
        "low_para_sent_len_cv": (c("para_sent_len_cv_avg") > 0) & (c("para_sent_len_cv_avg") < 0.35) & (c("sentence_n") >= 2),
    }
    flags = on | {k: v if k in enabled else F.lit(False) for k, v in off.items()}
    return a.select("doc_id", *[F.when((n >= LEAST) & flags[k], 1).otherwise(0).alias(k) for k in INDICATORS])


def read_model(path: str) -> dict:
    """A fitted model's JSON file: features, mean, scale, coef, intercept and more."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    if not len(model["mean"]) == len(model["scale"]) == len(model["coef"]):
        raise ValueError("mean, scale and coef differ in length")
    return model


def write_model(model: dict, path: str) -> None:
    Path(path).write_text(json.dumps(model, ensure_ascii=False, indent=2), encoding="utf-8")


def fit(rows: DataFrame, label: str, features: tuple[str, ...] = FEATURES, c: float = 1.0, holdout: float = 0.2, **about) -> dict:
    """A model of the file's schema from rows (doc_id, features, label 0/1): standardised by the training rows, L2 penalty 1 / (n c).

    Of each class, the share holdout by hash of doc_id is held out, and its accuracy reported.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    held = F.pmod(F.xxhash64("doc_id"), F.lit(10_000)) < int(holdout * 10_000)
    rows = rows.select("doc_id", *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label")).withColumn("held", held)
    train = rows.where("NOT held")
    s = train.agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_samp(f).alias(f"s_{f}") for f in features]).first()
    mean, scale = [s[f"m_{f}"] or 0.0 for f in features], [s[f"s_{f}"] or 1.0 for f in features]
    z = rows.withColumns({f: (F.col(f) - m) / d for f, m, d in zip(features, mean, scale, strict=True)})
    z = VectorAssembler(inputCols=list(features), outputCol="features").transform(z).select("features", "label", "held")
    lr = LogisticRegression(regParam=1 / (s.n * c), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9).fit(z.where("NOT held"))
    right = lr.transform(z.where("held")).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()
    return {"features": list(features), "mean": mean, "scale": scale, "coef": lr.coefficients.tolist(), "intercept": float(lr.intercept), "n_train": s.n, "n_holdout": right.n, "holdout_accuracy": right.a, "backend": "spark"} | about


def auto_scene(char_count: Column) -> Column:
    return F.when(char_count >= LONG, "novel").otherwise("general")


def routed(scene: Column, char_count: Column, models: dict[str, dict]) -> Column:
    """The key of the model for a scene: academic, or longform for novel and longform, where there is one; general else. auto goes by length and never to academic."""
    s = F.when(scene == "auto", auto_scene(char_count)).otherwise(scene)
    out = F.lit("general")
    if "academic" in models:
        out = F.when(s == "academic", "academic").otherwise(out)
    return F.when(s.isin("novel", "longform"), "longform").otherwise(out) if "longform" in models else out


def model_scores(a: DataFrame, models: dict[str, dict], scene: Column | None = None, top: int = 5) -> DataFrame:
    """(doc_id, model, logit, p, lr_score, top): a row for each document whose model exists; a model of fewer weights than FEATURES uses the first ones."""
    rows = a.withColumn("model", routed(F.lit("general") if scene is None else scene, F.col("char_count"), models))
    parts = {}
    for key, m in models.items():
        used = list(zip(FEATURES, m["mean"], m["scale"], m["coef"], strict=False))
        parts[key] = F.array(*[F.struct(F.lit(f).alias("feature"), ((F.col(f) - mean) / (scale or 1.0) * w).alias("part")) for f, mean, scale, w in used]), float(m["intercept"])
    pick = lambda i: F.coalesce(*[F.when(F.col("model") == k, p[0] if i == 0 else F.lit(p[1])) for k, p in parts.items()])
    rows = rows.withColumns({"parts": pick(0), "base": pick(1)}).where("parts IS NOT NULL")
    rows = rows.withColumn("logit", F.col("base") + F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]))
    p = F.when(F.col("logit") > 500, 1.0).when(F.col("logit") < -500, 0.0).otherwise(1 / (1 + F.exp(-F.col("logit"))))
    best = F.slice(F.array_sort(F.transform("parts", lambda x, i: F.struct((-F.abs(x["part"])).alias("o"), i.alias("i"), x["feature"].alias("feature"), x["part"].alias("part")))), 1, top)
    return rows.select("doc_id", "model", "logit", p.alias("p"), F.rint(100 * p).cast("int").alias("lr_score"), F.transform(best, lambda x: F.struct(x["feature"].alias("feature"), x["part"].alias("part"))).alias("top"))


def fused(rule: DataFrame, model: DataFrame | None, mode: str = "fused") -> DataFrame:
    """(doc_id, rule_stat, lr, score): a fifth of the rule score and four fifths of the model's, the rule score alone where there is no model's; mode `lr` or `rule` takes one of them."""
    out = rule.select("doc_id", F.col("score").alias("rule_stat"))
    out = out.join(model.select("doc_id", F.col("lr_score").alias("lr")), "doc_id", "left") if model is not None else out.withColumn("lr", F.lit(None).cast("int"))
    both = {"fused": F.rint(RULE_SHARE * F.col("rule_stat") + MODEL_SHARE * F.col("lr")).cast("int"), "lr": F.col("lr"), "rule": F.lit(None).cast("int")}[mode]
    return out.select("doc_id", "rule_stat", "lr", F.coalesce(both, F.col("rule_stat")).alias("score"))


def secondary(a: DataFrame) -> DataFrame:
    """(doc_id, value): four signals, each on a linear scale from 0 to 100, by weight."""
    parts = []
    for name, (weight, lo, hi, inverse) in SECONDARY.items():
        x = (F.col(name) - lo) / (hi - lo)
        parts.append(weight * F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (1 - x if inverse else x))))
    return a.select("doc_id", F.round(T.total(parts), 2).alias("value"))


def scene_of_model(docs: DataFrame, lex: dict | None = None, alphabet: str = "auto") -> DataFrame:
    """(doc_id, scene): longform from LONG characters on, else academic with two of its markers, else general."""
    lex = lex or lexicons.load()
    t = F.coalesce("text", F.lit(""))
    hits = T.total([F.when(F.contains(t, F.lit(m)), 1).otherwise(0) for m in lex["academic_scene_markers"]])
    return docs.select("doc_id", F.when(T.size(t, alphabet) >= LONG, "longform").when(hits >= 2, "academic").otherwise("general").alias("scene"))


def genre(docs: DataFrame, lex: dict | None = None, alphabet: str = "auto") -> DataFrame:
    """(doc_id, scene): academic, social, novel or general by markers, emoji, length and quotes."""
    return docs.select("doc_id", genre_of(F.coalesce("text", F.lit("")), lex, alphabet).alias("scene"))


def genre_of(t: Column, lex: dict | None = None, alphabet: str = "auto") -> Column:
    lex = lex or lexicons.load()
    count = lambda k: T.total([T.occurrences(t, m) for m in lex[k]])
    strong = count("route_strong")
    academic = strong * 2 + count("route_weak")
    social = count("route_social") + F.regexp_count(t, F.lit(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"))
    quotes = T.occurrences(t, "「") + T.occurrences(t, "“")
    return F.when((strong >= 1) & (academic >= 4) & (academic > social), "academic").when(social >= 3, "social").when((T.size(t, alphabet) >= LONG) & (quotes >= 3), "novel").otherwise("general")
