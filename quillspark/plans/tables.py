"""The queries of the operators that are functions over tables: each over whole tables of the corpus, with the Han fixture under negative ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.scratch import dealt, written
from quillspark.functions.session import prepare
from quillspark.operators import academic, detector, guards, hygiene, ngrams, reports, rewriting, scoring
from quillspark.plans import oracles
from quillspark.sources import fixtures as fx
from quillspark.sources import lexicons

_kept: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of this session and corpus that is made once: models and feature vectors."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def texts(spark: SparkSession, sf_dir: str, fixture: tuple = fx.HAN) -> DataFrame:
    return docs(spark, sf_dir).union(spark.sql(fx.values(fixture, "doc_id, text")).select(-F.col("doc_id").cast("long"), "text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves without numbers and full stops, and the fixture's pairs."""
    own = docs(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.col("text").alias("before"), T.sub(F.col("text"), "[0-9]+(?:[.,][0-9]+)*%?|[.] ", " ").alias("after"))
    return own.union(spark.sql(fx.values(fx.PAIRS, "pair_id, before, after")).select(-F.col("pair_id").cast("long"), "before", "after"))


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The n-gram model of a table: documents, user turns, pages without tags, benchmark items."""
    source = {
        "primary": lambda: read(spark, sf_dir, "documents"), "human": lambda: read(spark, sf_dir, "conversations").where("role = 'user'"),
        "wiki": lambda: read(spark, sf_dir, "pages").select(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ").alias("text")), "news": lambda: read(spark, sf_dir, "benchmark"),
    }[name]
    return once(spark, sf_dir, f"model-{name}", lambda: ngrams.train(source(), name=name))


def models(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: model(spark, sf_dir, n) for n in ngrams.NAMES}


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "analyzed", lambda: written(scoring.analyzed(docs(spark, sf_dir), models(spark, sf_dir), own=True), "analyzed"))


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.rules(texts(spark, sf_dir))


def _flags(spark: SparkSession, sf_dir: str, weights: str) -> DataFrame:
    a = analyzed(spark, sf_dir)
    return detector.statistical(scoring.indicators(a.where("char_count >= 100")), list(lexicons.DEFAULT[weights]))


def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.scores(ruled(spark, sf_dir), _flags(spark, sf_dir, "statistical_weights"))


def academic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return academic.scores(academic.dimensions(texts(spark, sf_dir)), _flags(spark, sf_dir, "academic_statistical_weights"))


def fitted(spark: SparkSession, sf_dir: str) -> dict:
    rows = scoring.vector(analyzed(spark, sf_dir)).join(read(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    return scoring.fit(rows, "quality", trained_on="labels.quality")


def lr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.model_scores(analyzed(spark, sf_dir), {"general": fitted(spark, sf_dir)}).select("doc_id", "model", F.round("logit", 4).alias("logit"), F.round("p", 4).alias("p"), "lr_score", F.to_json("top").alias("top"))


def lr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fitted(spark, sf_dir)
    rows = [(i, f, float(a), float(b), float(c)) for i, (f, a, b, c) in enumerate(zip(m["features"], m["mean"], m["scale"], m["coef"], strict=True))]
    return spark.createDataFrame([*rows, (len(rows), "intercept", 0.0, 1.0, float(m["intercept"]))], "idx int, feature string, mean double, scale double, coef double")


def fused_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.model_scores(analyzed(spark, sf_dir), {"general": fitted(spark, sf_dir)})
    return scoring.fused(rule_score(spark, sf_dir), scored)


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by category before and after an edit, for both detectors."""
    before = texts(spark, sf_dir)
    after = before.select("doc_id", F.replace(T.sub(F.col("text"), r"(?:首先|其次|最后)[，,]\s*|(?:第[一二三四五六]|其[一二三])[，,、]\s*"), F.lit("——"), F.lit("—")).alias("text"))

    def counts(d: DataFrame) -> DataFrame:
        parts = [detector.issues(f(d)).select(F.lit(name).alias("detector"), "category") for name, f in (("general", detector.rules), ("academic", academic.dimensions))]
        return parts[0].union(parts[1]).groupBy("detector", "category").count()

    return reports.compared(counts(before), counts(after), ["detector", "category"])


def scene_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which model each document goes to, by scene and length."""
    some = {k: {} for k in ("general", "academic", "longform")}
    scenes = F.explode(F.array(*map(F.lit, ("general", "academic", "novel", "longform", "auto"))))
    rows = texts(spark, sf_dir).select("doc_id", T.size(F.col("text"), "auto").alias("n"), scenes.alias("scene"))
    return rows.select("doc_id", "scene", scoring.routed(F.col("scene"), F.col("n"), some).alias("model"))


def _lost(tokens: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sides = [pairs(spark, sf_dir).select("pair_id", F.explode(tokens(F.col(c))).alias("token"), F.lit(c).alias("side")) for c in ("before", "after")]
        n = sides[0].union(sides[1]).groupBy("pair_id", "token").agg(F.sum(F.when(F.col("side") == "before", 1).otherwise(-1)).cast("int").alias("lost"))
        return n.where("lost > 0")

    return run


def passages(spark: SparkSession, sf_dir: str, width: int = 20) -> DataFrame:
    return hygiene.passage_survival(read(spark, sf_dir, "benchmark").select("item_id", "text"), read(spark, sf_dir, "documents").select("doc_id", "text"), width)


def votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations as votes on their conversation, and the fixture's votes."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    own = c.select(F.col("conv_id").alias("text_id"), F.concat("role", (F.col("turn") % 3).cast("string")).alias("model"), (1 + F.length("text") % 5).alias("score"), F.split("text", "[.]", -1)[0].alias("quote"))
    whole = c.groupBy(F.col("conv_id").alias("text_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    own = own.union(spark.sql(fx.values(fx.VOTES, "text_id, model, score, quote")).select(-F.col("text_id"), "model", "score", "quote"))
    return own, whole.union(spark.sql(fx.values(fx.VOTED, "text_id, text")).select(-F.col("text_id"), "text"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, y, chars, score): labelled documents with the letters' share of all characters, which stands in for a score; labels.quality stands in for the class."""
    d = dealt(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")).join(read(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("y")), "doc_id")
    n = F.length("text").cast("double")
    return d.select("doc_id", "lang", "source", "y", n.alias("chars"), F.when(n == 0, 0.0).otherwise(100.0 * T.size(F.col("text"), "letters") / n).alias("score"))


def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    parts = s.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("chars"), 3).alias("mean_chars"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.stddev_samp("score"), 4).alias("sd"), F.round(F.min("score"), 4).alias("least"), F.round(F.max("score"), 4).alias("most"))
    return parts.join(reports.medians(s.select("lang", "score"), ["lang"]), "lang").withColumn("median", F.round("median", 4))


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.split(scored(spark, sf_dir), "y").groupBy("y", F.when(F.col("holdout"), "holdout").otherwise("train").alias("part")).agg(F.count("*").alias("n"))


def pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of both classes paired by their places within source; the edit takes digits and full stops out."""
    d = scored(spark, sf_dir).join(docs(spark, sf_dir), "doc_id")
    cut = T.sub(F.col("text"), "[0-9]+(?:[.,][0-9]+)*%?|[.] ", " ")
    size = F.length(cut)
    d = d.withColumns({"after": F.when(size == 0, 0.0).otherwise(100.0 * T.size(cut, "letters") / size), "pb": F.size(F.split("text", "\n")), "pa": F.size(F.split(cut, "\n")), "ca": size})
    r = reports.ranked(d, ["source", "y"])
    one, zero = (r.where(f"y = {y}") for y in (1, 0))
    j = one.join(zero.select("source", "rn", F.col("score").alias("human")), ["source", "rn"])
    return reports.pair_report(j.select("source", "human", F.col("score").alias("model"), "after", F.col("pb").alias("paragraphs_before"), F.col("pa").alias("paragraphs_after"), F.col("chars").alias("chars_before"), F.col("ca").alias("chars_after")))


def longform(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).join(docs(spark, sf_dir), "doc_id")
    cut = T.sub(F.col("text"), "[0-9]+(?:[.,][0-9]+)*%?|[.] ", " ")
    size = F.length(cut)
    after = F.when(size == 0, 0.0).otherwise(100.0 * T.size(cut, "letters") / size)
    return reports.longform_report(d.select(F.col("lang").alias("genre"), F.col("source").alias("model"), F.col("score").alias("before"), after.alias("after"), (F.size(F.split("text", "\n")) == F.size(F.split(cut, "\n"))).cast("int").alias("preserved"), guards.defects(F.col("text"), cut).alias("defects")))


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, whole = votes(spark, sf_dir)
    after = guards.polished(whole.withColumnRenamed("text_id", "doc_id")).withColumnRenamed("doc_id", "text_id")
    return _rounded(reports.acceptance(reports.jury(v, whole), whole, after), "cv", "short_frac")


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("genre"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("provenance"))
    return reports.controls(rows, "general", ["en", "de"], 200, 2000, 50).drop("text")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def _on(f: Callable[[DataFrame], DataFrame], fixture: tuple = fx.HAN) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(texts(spark, sf_dir, fixture))


def _col(name: str, f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return _on(lambda d: d.select("doc_id", f(F.col("text")).alias(name)))


def _model(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(docs(spark, sf_dir), model(spark, sf_dir, "primary"))


def _trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir, "primary")
    return reduce(DataFrame.union, [ngrams.table(m, n).select(F.lit(n).alias("n"), F.col("g").alias("gram"), F.col("c").alias("cnt")) for n in (1, 2, 3)])


#: queries whose SQL is that of the statistics, run here by table functions
REPLACED = {
    "perplexity": _model(lambda d, m: ngrams.perplexity(d, m, own=True)), "gltr_buckets": _model(ngrams.rank_buckets), "surprisal_moments": _model(lambda d, m: ngrams.moments(d, m, own=True)), "ngram_train": _trained,
    "bigram_entropy": lambda s, d: ngrams.entropy(docs(s, d)).where("entropy <> 5 OR entropy IS NOT NULL"), "para_entropy_cv": lambda s, d: ngrams.paragraph_entropy_spread(docs(s, d)), "cross_para_trigram": lambda s, d: ngrams.cross_paragraph_repeats(docs(s, d)),
    "dual_model_diff": lambda s, d: ngrams.model_differences(docs(s, d), models(s, d), own=True),
    "surprisal_autocorr": lambda s, d: _rounded(ngrams.series(docs(s, d), model(s, d, "primary"), own=True).select("doc_id", "lag1", "lag2", "lag4", "lag8"), "lag1", "lag2", "lag4", "lag8"),
    "balanced_sample": lambda s, d: reports.balanced(read(s, d, "documents").select("doc_id", "lang"), "lang"), "class_balance": lambda s, d: reports.balanced(scored(s, d), "y").select("doc_id", "y"), "stratified_split": stratified,
    "exact_dedup": lambda s, d: reports.first_of_equal(docs(s, d)), "group_report": group_report, "auc_rank": lambda s, d: reports.auc(scored(s, d)).select((F.col("n_pos") + F.col("n_neg")).alias("n"), "auc"),
    "cohens_d": lambda s, d: reports.effect_sizes(scored(s, d)),
    "ppl_windows_burstiness": lambda s, d: _rounded(ngrams.series(docs(s, d), model(s, d, "primary"), own=True).where("n_windows > 0").select("doc_id", "n_windows", "burst"), "burst"),
}

#: name -> query and its SQL, None where SQL can't express it
TABLES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "rule_issues": (lambda s, d: detector.issues(ruled(s, d)), f"WITH {oracles.BASE}, {oracles.issues()} SELECT doc_id, category, severity, text, cnt FROM issues"),
    "rule_metrics": (lambda s, d: _rounded(ruled(s, d).select("doc_id", "metrics.*"), "entropy", "emotional_density"), f"WITH {oracles.BASE}, {oracles.METRICS} SELECT doc_id, CAST(char_count AS INTEGER) AS char_count, CAST(sentence_count AS INTEGER) AS sentence_count, CAST(paragraph_count AS INTEGER) AS paragraph_count, round(entropy, 4) AS entropy, round(emotional_density, 4) AS emotional_density FROM metrics"),
    "rule_score": (rule_score, oracles.rule_score()),
    "score_layers": (lambda s, d: rule_score(s, d).select("doc_id", F.col("score").alias("general"), "level").join(academic_score(s, d).select("doc_id", F.col("score").alias("academic")), "doc_id"), f"SELECT g.doc_id, g.score AS general, g.level, a.score AS academic FROM ({oracles.rule_score()}) g JOIN ({oracles.academic_score()}) a ON a.doc_id = g.doc_id"),
    "worst_sentences": (_on(lambda d: detector.worst_sentences(d).drop("reasons")), oracles.worst()),
    "detector_report": (lambda s, d: detector.report(ruled(s, d), rule_score(s, d), detector.worst_sentences(texts(s, d))), None),
    "score_line": (lambda s, d: detector.score_line(rule_score(s, d)), f"SELECT doc_id, concat(score, '/100 (', level, ')') AS line FROM ({oracles.rule_score()})"),
    "academic_issues": (_on(lambda d: detector.issues(academic.dimensions(d))), f"WITH {oracles.BASE}, {oracles.academic()} SELECT doc_id, category, severity, text, cnt FROM dims"),
    "academic_metrics": (_on(lambda d: _rounded(academic.dimensions(d).select("doc_id", "metrics.*"), "entropy", "connector_density")), None),
    "academic_score": (academic_score, oracles.academic_score()),
    "topic_diffusion": (_on(lambda d: academic.diffusion(d).where("used >= 2").select("doc_id", F.round("value", 4).alias("value"), "used")), f"WITH {oracles.BASE}, {oracles.academic()} SELECT doc_id, round(v, 4) AS value, used FROM diffusion"),
    "indicators": (lambda s, d: scoring.indicators(analyzed(s, d)), f"WITH {oracles.flags()} SELECT doc_id, {', '.join(scoring.INDICATORS)} FROM flags"),
    "feature_vector": (lambda s, d: _rounded(scoring.vector(analyzed(s, d)), *scoring.FEATURES), None),
    "spectral_flatness": (lambda s, d: ngrams.series(docs(s, d), model(s, d, "primary"), own=True).select("doc_id", F.round("flatness", 4).alias("value")), None),
    "curvature": (lambda s, d: _rounded(ngrams.curvature(docs(s, d), model(s, d, "primary"), own=True), "value"), None),
    "secondary_signal": (lambda s, d: scoring.secondary(analyzed(s, d)), None),
    "lr_fit": (lr_fit, None), "lr_score": (lr_score, None), "fused_score": (fused_score, None),
    "bigram_log_prob": (lambda s, d: _rounded(ngrams.bigram_log_probs(ngrams.table(model(s, d, "primary"), 2).select("g"), model(s, d, "primary")), "lp"), oracles.bigrams()),
    "unigram_ppl": (_model(lambda d, m: ngrams.unigram_perplexity(d, m, own=True)), oracles.unigrams()),
    "transition_density": (_on(lambda d: _rounded(scoring.densities(d, alphabet="auto"), "comma_density", "punct_density", "trans_density")), oracles.densities()),
    "lenient_json": (lambda s, d: dealt(read(s, d, "documents")).select("doc_id", guards.lenient_json(F.concat(F.lit("reply:\n```json\n"), F.to_json(F.struct("doc_id", "lang")), F.lit("\n``` end"))).alias("json")), "SELECT doc_id, CAST(json_object('doc_id', doc_id, 'lang', lang) AS VARCHAR) AS json FROM documents"),
    "genre_route": (_on(scoring.genre), oracles.genre()), "lr_scene": (_on(scoring.scene_of_model), oracles.lr_scene()),
    "scene_models": (scene_models, f"WITH {oracles.BASE} SELECT doc_id, scene, CASE WHEN scene = 'academic' THEN 'academic' WHEN scene IN ('novel', 'longform') OR (scene = 'auto' AND n >= 1500) THEN 'longform' ELSE 'general' END AS model FROM base, (SELECT unnest(['general', 'academic', 'novel', 'longform', 'auto']) AS scene)"),
    "starter_entropy": (_on(lambda d: scoring.starter_entropy(d, "auto").select("doc_id", F.round("starter_entropy", 4).alias("value"))), oracles.starter_entropy()),
    "sentence_split": (_on(lambda d: d.select("doc_id", F.posexplode(T.sentences(F.col("text"), "auto")).alias("sent_idx", "sent"))), f"WITH {oracles.BASE} SELECT doc_id, CAST(idx AS INTEGER) AS sent_idx, s AS sent FROM sents"),
    "paragraph_split": (_on(lambda d: d.select("doc_id", F.posexplode(T.paragraphs(F.col("text"), "auto")).alias("idx", "para")).select("doc_id", "idx", T.strip(F.col("para")).alias("para"))), f"WITH {oracles.BASE} SELECT doc_id, CAST(idx AS INTEGER) AS idx, p AS para FROM blocks"),
    "phrase_counts": (_on(lambda d: d.select("doc_id", F.inline(F.filter(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(w).alias("phrase"), T.occurrences(F.col("text"), w).alias("cnt")) for c in ("mechanical_connectors", "empty_grand_words", "ai_high_freq_words", "filler_phrases", "hedging", "emotional_words", "personal_markers") for w in lexicons.DEFAULT[c]]), lambda x: x["cnt"] > 0)))), oracles.phrase_counts()),
    "text_tokens": (_on(lambda d: d.select("doc_id", F.round(guards.filler_ratio(F.col("text")), 4).alias("filler_ratio"), F.array_join(guards.latin(F.col("text")), "|").alias("latin"), F.array_join(guards.numbers(F.col("text")), "|").alias("numbers"), guards.strip_punctuation(F.col("text")).alias("bare"))), oracles.projections()),
    "dialogue_density": (_on(lambda d: d.select("doc_id", F.round(guards.dialogue_density(F.col("text")), 4).alias("value"))), oracles.dialogue()),
    "markdown_strip": (_col("body", guards.strip_markdown), oracles.markdown()),
    "block_structure": (_on(lambda d: d.select("doc_id", F.explode(T.paragraphs(F.col("text"), "auto")).alias("p")).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.when(guards.structural(T.strip(F.col("p"))), 1).otherwise(0)).alias("structural"))), oracles.structure()),
    "punct_normalize": (_col("body", guards.normalize), None),
    "punct_profile": (_on(lambda d: d.select("doc_id", guards.punct_profile(F.col("text")).alias("p")).select("doc_id", "p.*")), f"WITH {oracles.BASE} SELECT doc_id, {oracles.times('t', oracles.lit(','))} AS half_comma, {oracles.times('t', oracles.lit('，'))} AS full_comma, CAST(len(regexp_extract_all(t, '[一-鿿][.]')) AS INTEGER) AS half_stop, {oracles.times('t', oracles.lit('。'))} AS full_stop, CAST(length(regexp_replace(t, '[^一-鿿]', '', 'g')) AS INTEGER) AS han_n FROM base"),
    "quote_depth": (_on(lambda d: guards.quote_depths(d).select("doc_id", F.size("depths").alias("chars"), F.array_max("depths").alias("deepest"), F.size(F.filter("depths", lambda x: x > 0)).alias("inside"))), None),
    "rhythm_metrics": (_on(lambda d: _rounded(guards.rhythm(d, "auto"), "cv", "short_frac", "mean_len")), oracles.rhythm()),
    "merge_candidates": (_on(guards.merge_candidates), oracles.merges()), "split_candidates": (_on(guards.split_candidates), None), "rhythm_polish": (_on(guards.polished), None), "guarded_replace": (_on(guards.replace_guarded), None),
    "invariant": (lambda s, d: pairs(s, d).select("pair_id", guards.same_but_punctuation(F.col("before"), F.col("after")).alias("same")), f"WITH {oracles.PAIRS} SELECT pair_id, {oracles.bare('before')} = {oracles.bare('after')} AS same FROM pairs"),
    "guard_numbers": (_lost(guards.numbers), f"WITH {oracles.PAIRS} {oracles.lost(*oracles.NUMBER)}"), "guard_latin": (_lost(guards.latin), f"WITH {oracles.PAIRS} {oracles.lost(*oracles.LATIN)}"),
    "guard_check": (lambda s, d: pairs(s, d).select("pair_id", F.explode(guards.problems(F.col("before"), F.col("after"))).alias("problem")), oracles.guard()),
    "defect_count": (lambda s, d: pairs(s, d).select("pair_id", guards.defects(F.col("before"), F.col("after")).alias("n")), f"WITH {oracles.PAIRS} SELECT pair_id, CAST({' + '.join(f'greatest(0, len({oracles.found("after", p)}) - len({oracles.found("before", p)}))' for p in guards.DEFECTS)} AS INTEGER) AS n FROM pairs"),
    "sequence_similarity": (lambda s, d: _rounded(guards.similar(pairs(s, d)), "ratio"), None),
    "carriers_inspect": (_on(hygiene.inspect, fx.HYGIENE), None), "carriers_clean": (_on(hygiene.clean, fx.HYGIENE), None),
    "carrier_kinds": (_on(hygiene.kinds, fx.HYGIENE), oracles.kinds()),
    "lookalike_fold": (_on(lambda d: d.select("doc_id", hygiene.fold(F.col("text")).alias("folded")), fx.HYGIENE), oracles.fold()),
    "window_survival": (lambda s, d: hygiene.survival(pairs(s, d)), f"WITH {oracles.PAIRS}, {oracles.survival()} SELECT pair_id, width, total, kept, after_total, survival, z_ratio FROM surv"),
    "survival_note": (lambda s, d: hygiene.survival_notes(hygiene.survival(pairs(s, d), (hygiene.HEADLINE,))), oracles.NOTES),
    "passage_survival": (passages, oracles.passages()),
    "green_simulation": (lambda s, d: _rounded(hygiene.simulations(s.range(8).select(F.col("id").alias("sim_id")), model(s, d, "primary"), 600, b"key"), "z"), None),
    "scene_report": (lambda s, d: reports.scene_report(scored(s, d).withColumnRenamed("lang", "scene")), oracles.scene_report()), "margins": (lambda s, d: reports.margins(scored(s, d).withColumnsRenamed({"lang": "scene", "source": "model"})), oracles.margins()),
    "layer_report": (lambda s, d: reports.layer_report(scored(s, d), ["score", "chars"]), oracles.layers()), "pair_report": (pair_report, oracles.pair_report()), "longform_report": (longform, oracles.longform()), "control_build": (controls, oracles.controls()),
    "acceptance": (acceptance, None),
    "jury": (lambda s, d: reports.jury(*votes(s, d)), oracles.jury()),
    "before_after": (before_after, oracles.before_after()),
    "compression_ratio": (lambda s, d: _rounded(reports.compression(docs(s, d), read(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), read(s, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), "text")), "ratio"), None),
    "calibration_signals": (lambda s, d: reports.signals(docs(s, d), model(s, d, "primary")), None),
    "reduce_punctuation": (_col("body", rewriting.reduce_punctuation), oracles.semicolons()),
    "casual_terms": (_col("body", rewriting.casual_words), oracles.casual()),
    "in_sentence_repeats": (_on(guards.in_sentence_repeats), oracles.repeats()),
    "han_count": (_on(lambda d: d.select("doc_id", T.size(F.col("text"), "letters").alias("letters"), T.size(F.col("text")).alias("han_n"))), f"WITH {oracles.BASE} SELECT doc_id, CAST(length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS INTEGER) AS letters, CAST(length(regexp_replace(t, '[^一-鿿]', '', 'g')) AS INTEGER) AS han_n FROM base"),
    "han_entropy": (_on(lambda d: ngrams.entropy(d, "han")), f"WITH {oracles.BASE} SELECT doc_id, CASE WHEN n < 10 THEN 5 ELSE round(entropy, 4) END AS entropy FROM base JOIN ent USING (doc_id) WHERE han UNION ALL SELECT doc_id, 5 FROM base WHERE han AND n BETWEEN 2 AND 9"),
    "formal_strip": (_col("body", lambda t: T.sub(t, r"(?:首先|其次|最后)[，,]\s*|(?:第[一二三四五六]|其[一二三])[，,、]\s*")), f"WITH {oracles.BASE} SELECT doc_id, regexp_replace(t, '(?:首先|其次|最后)[，,]\\s*|(?:第[一二三四五六]|其[一二三])[，,、]\\s*', '', 'g') AS body FROM base"),
    "offline_rewrite": (_on(rewriting.offline), None),
    "guarded_rewrite": (_on(lambda d: rewriting.guarded_rewrite(d, ("remove_enumeration", "replace_phrases", "tidy"))), None),
    "burst_guarded": (lambda s, d: rewriting.burst_guarded(texts(s, d), model(s, d, "primary")), None),
} | {f"rewrite_{n}": (_on(lambda d, n=n: rewriting.rewritten(d, (n,))), None) for n in rewriting.PASSES}
