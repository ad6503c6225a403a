"""The academic detector: eleven dimensions, statistical bridges, metrics and the score."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import pairwise
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.rowwise import added
from quillspark.operators.detector import ISSUE, MOST_COUNT, MOST_RULE, MOST_STATISTICAL, in_han, issue, level, matched, measured, patterns, phrases, where
from quillspark.sources import lexicons

TOP = 20


def diffusion(docs: DataFrame, alphabet: str = "auto") -> DataFrame:
    """(doc_id, value, used): one less the mean Jaccard likeness of neighbouring paragraphs' TOP most frequent bigrams, earlier ones first among equals.

    Paragraphs are of over 20 characters, ten of which count; documents with one of them have the value 1, others no row.
    """
    paragraphs = F.filter(F.transform(T.paragraphs(F.coalesce("text", F.lit("")), alphabet), T.strip), lambda x: F.length(x) > 20)
    return diffused(docs.select("doc_id", paragraphs.alias("paragraphs")), alphabet, ("paragraphs",)).where("used > 0")


def diffused(rows: DataFrame, alphabet: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows with value and used, from their paragraphs; documents without one have the value 1."""
    h = F.filter(F.transform("paragraphs", lambda s: F.lower(T.extract(s, alphabet))), lambda h: F.length(h) >= 10)
    return added(rows.withColumn("_h", h), ("_h",), alike, "value double, used long", (*drop, "_h"))


def alike(paragraphs: list[str]) -> tuple[float, int]:
    """diffusion of one document, from the characters of its paragraphs."""
    # equal counts stay in the order of their first places
    tops = [{a + b for (a, b), _ in Counter(zip(h, h[1:], strict=False)).most_common(TOP)} for h in paragraphs]
    shares = [len(a & b) / len(a | b) for a, b in pairwise(tops)]
    # added one by one, as engines do: sum() would carry rounding errors along, and ties of the fourth digit would go the other way
    return 1 - (reduce(add, shares) / len(shares) if shares else 0.0), len(tops)


def dimensions(docs: DataFrame, lex: dict | None = None, alphabet: str = "auto") -> DataFrame:
    """(doc_id, issues, metrics) for every row; categories are the dimensions. Null texts count as empty."""
    lex = lex or lexicons.load()
    t, n = F.col("t"), F.col("n")
    count = lambda k: T.counts(t, lex[k], F.col("han"))
    d = diffused(measured(docs, alphabet), alphabet)
    d = d.withColumn("short", F.filter(F.transform(T.paragraphs(t, alphabet), T.strip), lambda x: F.length(x) > 10))
    first = lambda p: T.strip(F.when(F.contains(p, F.lit("。")), F.substring_index(p, "。", 1)).otherwise(F.left(p, F.lit(50))))
    opened = F.size(F.filter("short", lambda p: T.total([F.when(first(p).rlike(r"(?U)" + o), 1).otherwise(0) for o in lex["paragraph_openers"]]) > 0))
    opened = F.when(F.col("han"), opened).otherwise(0) if all(map(T.needs_han, lex["paragraph_openers"])) else opened
    numbers = {"connectors": count("logic_connectors"), "certain": count("certainty"), "hedges": count("academic_hedges"), "cites": F.size(matched(t, [lex["citation"]])),
               "templates": F.size(matched(t, lex["citation_templates"])), "passive": patterns(t, "passive_overuse", "high", lex["passive_patterns"], 40, False), "opened": opened}
    d = d.withColumns(numbers).withColumn("connector_density", F.when(n > 0, F.col("connectors") / (n / 100)).otherwise(0.0))
    found = phrases(t, "connector_density", "info", lex["logic_connectors"])
    repeated = F.filter(F.array(*[F.struct((-T.occurrences(t, w)).alias("n"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(lex["academic_repeat_words"])]), lambda x: x["n"] <= -4)
    poor = F.transform(F.slice(F.array_sort(repeated), 1, 5), lambda x: issue("synonym_poverty", "medium", x["w"], -x["n"]))
    tail = F.substr(t, (F.floor(F.length(t) * 0.8) + 1).cast("int"), F.length(t))
    perfect = T.total([F.when((F.col("han") if T.needs_han(p) else F.lit(True)) & tail.rlike("(?d)" + p), 1).otherwise(0) for p in lex["perfect_conclusions"]])
    limited = T.total([F.when((F.col("han") if T.needs_han(re.escape(w)) else F.lit(True)) & F.contains(tail, F.lit(w)), 1).otherwise(0) for w in lex["limitations"]])
    certain, hedges = F.col("certain"), F.col("hedges")
    value, used = F.col("value"), F.col("used")
    every = [
        phrases(t, "ai_academic_phrases", "critical", lex["academic_phrases"]),
        F.slice("passive", 1, 10),
        where((F.size("short") >= 3) & (T.spread(F.transform("short", lambda x: T.size(x, alphabet))) < 0.18), issue("paragraph_uniformity", "high", "paragraph length")),
        where((F.size("short") >= 3) & (F.col("opened") >= 3), issue("paragraph_uniformity", "high", "openers")),
        where(F.col("connector_density") > 3.0, issue("connector_density", "high", "connectors", F.col("connectors"))),
        F.when(F.col("connector_density") > 3.0, F.transform(F.slice(found, 1, 5), lambda x: F.struct(x["category"].alias("category"), x["severity"].alias("severity"), x["text"].alias("text"), F.lit(1).alias("cnt")))).otherwise(F.array()),
        in_han(poor, list(map(re.escape, lex["academic_repeat_words"]))),
        where((F.col("cites") >= 3) & (F.col("templates") >= 3) & (F.col("templates") / F.col("cites") > 0.6), issue("citation_integration", "medium", "citations")),
        phrases(t, "data_template", "medium", lex["data_templates"]),
        patterns(t, "over_enumeration", "medium", lex["enumerations"], 60, True),
        where((perfect >= 2) & (limited == 0), issue("perfect_conclusion", "high", "conclusion")),
        where((n > 200) & (certain >= 3) & (hedges < 2), issue("certainty_overuse", "high", "certainty")),
        where((n > 200) & ~((certain >= 3) & (hedges < 2)) & (certain > 0) & (hedges == 0), issue("certainty_overuse", "medium", "certainty")),
        where((F.size("short") >= 3) & (n >= 300) & (used >= 3) & (value < 0.5) & (value > 0.35), issue("low_topic_diffusion", "medium", "diffusion")),
        where((F.size("short") >= 3) & (n >= 300) & (used >= 3) & (value <= 0.35), issue("low_topic_diffusion", "high", "diffusion")),
    ]
    entropy = F.when(n > 200, F.col("bits"))
    metrics = F.struct(n.alias("char_count"), F.size("sentences").alias("sentence_count"), F.size("short").alias("paragraph_count"), entropy.alias("entropy"), "connector_density", F.size("passive").alias("passive_count"), certain.alias("certainty_count"), hedges.alias("hedging_count"), F.col("cites").alias("citation_count"))
    return d.select("doc_id", F.concat(*[e.cast(ISSUE) for e in every]).alias("issues"), metrics.alias("metrics"))


def scores(found: DataFrame, stats: DataFrame | None = None, lex: dict | None = None) -> DataFrame:
    """(doc_id, rule_part, stat_part, score, level): 0.7 times the weighted issues without info rows up to 60, set categories up to 40."""
    lex = lex or lexicons.load()
    table = lambda k: F.create_map(*[F.lit(x) for a, b in lex[k].items() for x in (a, float(b))])
    weight, factor, own = table("dimension_weights"), table("severity_factors"), table("academic_statistical_weights")
    one = lambda x: F.coalesce(weight[x["category"]], F.lit(3.0)) * F.coalesce(factor[x["severity"]], F.lit(0.6)) * F.least(x["cnt"], F.lit(MOST_COUNT))
    raw = F.aggregate(F.filter("issues", lambda x: x["severity"] != "info"), F.lit(0.0), lambda s, x: s + one(x))
    out = found.join(stats, "doc_id", "left") if stats is not None else found.withColumn("stats", F.array().cast("array<string>"))
    stat = F.aggregate(F.coalesce("stats", F.array().cast("array<string>")), F.lit(0.0), lambda s, x: s + F.coalesce(own[x], F.lit(5.0)))
    # a product of tenths may fall just short of a whole number, which truncation would lose or keep by engine
    rule = F.least(F.lit(MOST_RULE), F.round(raw * 0.7, 9).cast("int"))
    out = out.select("doc_id", rule.alias("rule_part"), F.least(F.lit(MOST_STATISTICAL), stat.cast("int")).alias("stat_part"))
    out = out.withColumn("score", F.least(F.lit(100), F.col("rule_part") + F.col("stat_part")))
    return out.select("*", level(F.col("score")).alias("level"))
