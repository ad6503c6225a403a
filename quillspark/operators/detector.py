"""The rule detector: issues, metrics, scores and the sentences with most signals, for a table of documents.

All rules are one projection of a document: an array of issues that is then exploded, so a table is read once for all of them.
The statistical categories come from the indicators of the feature vector and are joined by document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.rowwise import added
from quillspark.operators import ngrams
from quillspark.sources import lexicons

ISSUE = "array<struct<category:string,severity:string,text:string,cnt:int>>"
PHRASES = (("mechanical_connectors", "critical"), ("empty_grand_words", "critical"), ("ai_high_freq_words", "high"), ("filler_phrases", "high"))
LEVELS = ((75, "very_high"), (50, "high"), (25, "medium"))  # fixed values
MOST_RULE, MOST_STATISTICAL, MOST_COUNT = 60, 40, 5  # fixed values


def issue(category: str, severity: str, text: Column | str, cnt: Column | int = 1) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), (F.lit(text) if isinstance(text, str) else text).alias("text"), (F.lit(cnt) if isinstance(cnt, int) else cnt).cast("int").alias("cnt"))


def where(condition: Column, *issues: Column) -> Column:
    """The issues where the condition holds, an empty array elsewhere, also where it is null."""
    return F.when(condition, F.array(*issues)).otherwise(F.array()).cast(ISSUE)


def in_han(expected: Column, words: list[str]) -> Column:
    """An array, empty without being worked out in texts without Han characters (column han) if all words or patterns need one."""
    return F.when(F.col("han"), expected).otherwise(F.array().cast(ISSUE)) if all(map(T.needs_han, words)) else expected


def phrases(t: Column, category: str, severity: str, words: list[str]) -> Column:
    found = F.array(*[issue(category, severity, w, T.occurrences(t, w)) for w in words])
    return in_han(F.filter(found, lambda x: x["cnt"] > 0), list(map(re.escape, words)))


def matched(t: Column, regexes: list[str], dotall: bool = False) -> Column:
    """All matches of all patterns, those that need a Han character looked for where the text has any (column han)."""
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(F.col("han"), T.matches(t, r, dotall)).otherwise(none) if T.needs_han(r) else T.matches(t, r, dotall) for r in regexes]))


def patterns(t: Column, category: str, severity: str, regexes: list[str], width: int, dotall: bool) -> Column:
    return F.transform(matched(t, regexes, dotall), lambda m: issue(category, severity, F.left(m, F.lit(width))))


def starters(sentences: Column) -> Column:
    """First two characters of the sentences that aren't headings, bullets, bold or numbered lines."""
    s = F.transform(sentences, T.strip)
    kept = F.filter(s, lambda x: (F.length(x) >= 2) & ~x.rlike(r"^(#|- |\* |\*\*|[0-9]+[.。．)）])"))
    return F.transform(kept, lambda x: F.left(x, F.lit(2)))


def measured(docs: DataFrame, alphabet: str = "auto") -> DataFrame:
    """docs(doc_id, text) with what the rules need: t, whether it has Han characters, n (characters that count), bits (of their bigrams), sentences, their sizes, paragraphs over 20 characters."""
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", t.alias("t"), T.extract(t, alphabet).alias("h")).select("doc_id", "t", F.length("h").alias("n"), F.lower("h").alias("h"))
    d = added(d, ("h",), lambda h: (ngrams.bits(h),), "bits double", ("h",)).withColumns({"han": T.has_han(F.col("t")), "sentences": T.sentences(F.col("t"), alphabet)})
    paragraphs = F.filter(F.transform(T.paragraphs(F.col("t"), alphabet), T.strip), lambda x: F.length(x) > 20)
    return d.withColumns({"sizes": F.transform("sentences", lambda x: T.size(x, alphabet)), "paragraphs": paragraphs})


def emotions(lex: dict) -> Column:
    """Emotional and personal expressions per hundred characters."""
    n = T.counts(F.col("t"), lex["emotional_words"] + lex["personal_markers"], F.col("han"))
    return F.when(F.col("n") > 0, n / F.col("n") * 100).otherwise(0.0)


def rules(docs: DataFrame, lex: dict | None = None, alphabet: str = "auto") -> DataFrame:
    """(doc_id, issues, metrics) for every row; null texts count as empty. entropy, in bits, is null up to 200 characters.

    The text of an issue is what matched, cut as the pattern's kind prescribes, or the measure's name with its value in cnt's place left at 1.
    """
    lex = lex or lexicons.load()
    t, n = F.col("t"), F.col("n")
    d = measured(docs, alphabet).withColumns({"top": T.counted(starters(F.col("sentences"))), "starts": starters(F.col("sentences")), "density": emotions(lex), "entropy": F.when(n < 10, F.lit(5.0)).otherwise(F.col("bits"))})
    hedges = T.counts(t, lex["hedging"], F.col("han"))
    dash, semicolon = (T.occurrences(t, c) / F.when(n > 0, n) * 100 for c in "—；")
    parallels = F.size(T.matches(t, lex["parallel_pattern"]))
    runs = matched(t, lex["list_patterns"])
    every = [
        patterns(t, "three_part_structure", "critical", lex["critical_regex"], 60, True),
        *[phrases(t, c, s, lex[c]) for c, s in PHRASES],
        patterns(t, "balanced_arguments", "high", lex["balanced_arguments"], 80, True),
        patterns(t, "template_sentences", "high", lex["template_sentences"], 60, False),
        where(hedges >= lex["hedging_threshold"], issue("hedging_language", "medium", "hedges", hedges)),
        F.transform(runs, lambda m: issue("list_addiction", "medium", "list")),
        where(dash > 1.0, issue("punctuation_overuse", "medium", "dash")),
        where(semicolon > 0.5, issue("punctuation_overuse", "medium", "semicolon")),
        where(parallels > 2, issue("excessive_rhetoric", "medium", "parallel")),
        where((F.size("paragraphs") >= 3) & (T.spread(F.transform("paragraphs", F.length)) < 0.2), issue("uniform_paragraphs", "style", "paragraph length")),
        where((F.size("sentences") > 5) & (T.spread(F.col("sizes")) < 0.25), issue("low_burstiness", "style", "sentence length")),
        where((n > 300) & (F.col("density") < 0.15), issue("emotional_flatness", "style", "emotional density")),
        where((F.size("sentences") > 5) & (F.col("top.most") >= 3), issue("repetitive_starters", "style", F.get("starts", F.col("top.at")))),
        where((F.col("entropy") < 6.0) & (n > 200), issue("low_entropy", "style", "entropy")),
    ]
    metrics = F.struct(n.alias("char_count"), F.size("sentences").alias("sentence_count"), F.size("paragraphs").alias("paragraph_count"), F.when(n > 200, F.col("entropy")).alias("entropy"), F.col("density").alias("emotional_density"))
    return d.select("doc_id", F.concat(*[e.cast(ISSUE) for e in every]).alias("issues"), metrics.alias("metrics"))


def issues(ruled: DataFrame) -> DataFrame:
    """(doc_id, category, severity, text, cnt): a row for each issue."""
    # not inline: a filter on the array's size would be inferred and pushed below, and all rules would run twice
    return ruled.select("doc_id", F.inline_outer("issues")).where("category IS NOT NULL")


def statistical(indicators: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, stats): the categories `stat_<indicator>` that are set, of those named; indicators has doc_id and 0/1 columns."""
    flags = [F.when(F.col(k.removeprefix("stat_")) == 1, F.lit(k)) for k in names]
    return indicators.select("doc_id", F.array_compact(F.array(*flags)).alias("stats"))


def level(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def scores(ruled: DataFrame, stats: DataFrame | None = None, lex: dict | None = None) -> DataFrame:
    """(doc_id, rule_part, stat_part, score, level): weighted issues up to 60, set categories up to 40, five more for flat emotion in long texts and for low entropy; 100 at most."""
    lex = lex or lexicons.load()
    weight = F.coalesce(F.create_map(*[F.lit(x) for k, v in lex["severity_weights"].items() for x in (k, float(v))]), F.create_map())
    raw = F.aggregate("issues", F.lit(0.0), lambda s, x: s + F.coalesce(weight[x["severity"]], F.lit(2.0)) * F.least(x["cnt"], F.lit(MOST_COUNT)))
    own = F.create_map(*[F.lit(x) for k, v in lex["statistical_weights"].items() for x in (k, v)])
    out = ruled.join(stats, "doc_id", "left") if stats is not None else ruled.withColumn("stats", F.array().cast("array<string>"))
    stat = F.aggregate(F.coalesce("stats", F.array().cast("array<string>")), F.lit(0), lambda s, x: s + F.coalesce(own[x], F.lit(5)))
    out = out.select("doc_id", "metrics", F.least(F.lit(MOST_RULE), raw.cast("int")).alias("rule_part"), F.least(F.lit(MOST_STATISTICAL), stat).alias("stat_part"))
    flat = F.when((F.col("metrics.emotional_density") < 0.1) & (F.col("metrics.char_count") > 500), 5).otherwise(0)
    dull = F.when(F.col("metrics.entropy") < 5.5, 5).otherwise(0)
    out = out.withColumn("score", F.least(F.lit(100), F.col("rule_part") + F.col("stat_part") + flat + dull))
    return out.select("doc_id", "rule_part", "stat_part", "score", level(F.col("score")).alias("level"))


def worst_sentences(docs: DataFrame, top: int = 5, lex: dict | None = None, alphabet: str = "auto") -> DataFrame:
    """(doc_id, rnk, score, sent, reasons): the sentences of most signals, first ones first among equals; sentences cut to 80 characters."""
    lex = lex or lexicons.load()
    words = [w for c, _ in PHRASES for w in lex[c]]
    regexes = lex["critical_regex"] + lex["template_sentences"]
    s = docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")), alphabet)).alias("idx", "s"))
    if all(map(T.needs_han, [*map(re.escape, words), *regexes])):
        s = s.where(T.has_han(F.col("s")))
    reasons = F.array_compact(F.array(*[F.when(F.contains("s", F.lit(w)), F.lit(w)) for w in words], *[F.when(F.col("s").rlike("(?d)" + r), F.lit("pattern: " + r[:20])) for r in regexes]))
    points = F.aggregate("reasons", F.lit(0), lambda a, x: a + F.when(F.startswith(x, F.lit("pattern: ")), 5).otherwise(3))
    s = s.withColumn("reasons", reasons).where(F.size("reasons") > 0).withColumn("score", points)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "idx"))
    return s.withColumn("rnk", rank).where(F.col("rnk") <= top).select("doc_id", "rnk", "score", F.left("s", F.lit(80)).alias("sent"), F.slice("reasons", 1, 3).alias("reasons"))


def report(ruled: DataFrame, scored: DataFrame, worst: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): one JSON object a document: score, level, metrics, total_issues, issues by category, worst sentences."""
    out = ruled.join(scored.select("doc_id", "score", "level"), "doc_id")
    kinds = F.array_distinct(F.transform("issues", lambda x: x["category"]))
    item = lambda x: F.struct(x["text"].alias("text"), x["cnt"].alias("count"), x["severity"].alias("severity"))
    grouped = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.transform(F.filter("issues", lambda x: x["category"] == k), item)))
    columns = ["score", "level", "metrics", F.size("issues").alias("total_issues"), grouped.alias("issues")]
    if worst is not None:
        listed = worst.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rnk", F.col("sent").alias("sentence"), "score", "reasons"))).alias("w"))
        out = out.join(listed, "doc_id", "left")
        columns.append(F.transform("w", lambda x: x.dropFields("rnk")).alias("worst_sentences"))
    return out.select("doc_id", F.to_json(F.struct(*columns)).alias("json"))


def score_line(scored: DataFrame) -> DataFrame:
    """(doc_id, line): `score/100 (level)`"""
    return scored.select("doc_id", F.concat(F.col("score").cast("string"), F.lit("/100 ("), "level", F.lit(")")).alias("line"))
