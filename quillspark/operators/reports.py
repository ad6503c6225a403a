"""Reports over tables: comparison of two counts, jury votes, acceptance, compression against seeds, calibration signals, effect sizes."""

from __future__ import annotations

import gzip
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.rowwise import added
from quillspark.operators import guards, ngrams
from quillspark.sources import lexicons

SEED_CHARS, SHORTEST = 20_000, 50


def compared(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before_n, after_n) of two tables (keys, count): every key of either."""
    b, a = before.withColumnRenamed("count", "before_n"), after.withColumnRenamed("count", "after_n")
    return b.join(a, keys, "full").select(*keys, F.coalesce("before_n", F.lit(0)).alias("before_n"), F.coalesce("after_n", F.lit(0)).alias("after_n"))


def backed(votes: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, quote, backers): quotes that their text holds, and how many models named a quote that holds it or lies in it.

    Quotes are compared within a text only, where there are as many as votes.
    """
    named = votes.where("quote <> ''")
    held = named.join(texts.withColumnRenamed("text", "whole"), "text_id").where(F.contains("whole", "quote")).select("text_id", "quote").distinct()
    other = named.select("text_id", F.col("quote").alias("other"), "model")
    return held.join(other, "text_id").where(F.contains("other", "quote") | F.contains("quote", "other")).groupBy("text_id", "quote").agg(F.count_distinct("model").alias("backers"))


def jury(votes: DataFrame, texts: DataFrame, least: float = 4.0) -> DataFrame:
    """(text_id, median, defects, passed) of votes (text_id, model, score, quote): a defect is a quote that a majority of models back; passed needs a median of `least` and no defect."""
    m = votes.groupBy("text_id").agg(F.count_distinct("model").alias("models"), F.median("score").alias("median"))
    d = m.join(backed(votes, texts), "text_id", "left").where("backers IS NULL OR backers >= floor(models / 2) + 1").groupBy("text_id").agg(F.count("quote").cast("int").alias("defects"))
    out = m.join(d, "text_id", "left").withColumn("defects", F.coalesce("defects", F.lit(0)))
    return out.select("text_id", F.col("median").cast("double").alias("median"), "defects", ((F.col("median") >= least) & (F.col("defects") == 0)).alias("passed"))


def marginal(juries: DataFrame, least: float = 4.0) -> DataFrame:
    """text_ids that a second round should judge: median below `least` by one at most, or exactly one defect."""
    return juries.where((F.col("median") < least) & (F.col("median") >= least - 1) | (F.col("defects") == 1)).select("text_id")


def acceptance(juries: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(text_id, status, median, defects, invariant, cv, short_frac, accepted): a row for each text; before and after are (text_id, text); accepted is over all rows."""
    pairs = before.select("text_id", F.col("text").alias("b")).join(after.select("text_id", "text"), "text_id")
    same = pairs.select("text_id", guards.same_but_punctuation(F.col("b"), F.col("text")).alias("invariant"), (F.col("b") == F.col("text")).alias("unchanged"))
    r = guards.rhythm(after.withColumnRenamed("text_id", "doc_id")).withColumnRenamed("doc_id", "text_id")
    rows = juries.join(same, "text_id").join(r, "text_id").withColumn("status", F.when(F.col("unchanged"), "unchanged").otherwise("edited"))
    total = rows.agg(F.bool_and("passed").alias("accepted"))
    return rows.join(F.broadcast(total)).select("text_id", "status", "median", "defects", "invariant", "cv", "short_frac", "accepted")


def _seed(texts: DataFrame, chars: int) -> str:
    """The beginning of the texts in order of their ids, `chars` characters at most; enough rows for that are collected, not more than chars."""
    rows = texts.where("length(text) > 0").orderBy("doc_id").select(F.left("text", F.lit(chars)).alias("text")).limit(max(chars // SHORTEST, 1))
    return "\n".join(r.text for r in rows.collect())[:chars]


def compression(docs: DataFrame, one: DataFrame, other: DataFrame, chars: int = SEED_CHARS) -> DataFrame:
    """(doc_id, ratio): bytes that a text adds to a compressed seed of the first kind over those that it adds to one of the other; null under SHORTEST characters."""
    held = docs.sparkSession.sparkContext.broadcast((_seed(one, chars), _seed(other, chars)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = lambda s: len(gzip.compress(s.encode(), 6, mtime=0))
        seeds = held.value
        own = [bytes_of(s) for s in seeds]
        for batch in it:
            out = []
            for text in batch.column(1).to_pylist():
                extra = [max(1, bytes_of(s + text) - n) for s, n in zip(seeds, own, strict=True)] if text and len(text) >= SHORTEST else None
                out.append(extra and extra[0] / extra[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "ratio"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ratio double")


SIGNALS = ("paragraph_length_cv", "para_sent_count_cv", "cross_para_tfidf_cohesion", "cross_para_3gram_repeat", "starter3_diversity", "starter2_max_freq", "function_word_kl", "first_vs_mid_ppl", "heading_list_density", "para_punct_density_cv", "para_sent_len_cv_avg")


def _cv(a: Column, least: int = 2) -> Column:
    return F.when(F.size(a) >= least, T.spread(a))


def signals(docs: DataFrame, model: DataFrame, alphabet: str = "letters", words: list[str] | None = None) -> DataFrame:
    """(doc_id, SIGNALS), rounded to four digits; a signal is null where a text is too short for it.

    words: function words (single characters in Han texts) whose distribution in both halves is compared; for other alphabets
    give single letters.
    """
    words = words or (lexicons.DEFAULT["function_words"] if alphabet == "han" else list("aeiounrst"))
    t = F.coalesce("text", F.lit(""))
    paras = T.paragraphs_by(t, "\n\\s*\n", 20, alphabet)
    ends = lambda p: T.by_alphabet(p, alphabet, F.split(p, "[。！？]", -1), F.split(p, "[.!?]+", -1))
    sents = lambda p: F.filter(F.transform(ends(p), lambda s: F.lower(T.extract(s, alphabet))), lambda h: F.length(h) >= 5)
    d = docs.select("doc_id", t.alias("t"), paras.alias("paras")).withColumns({"h": F.lower(T.extract(F.col("t"), alphabet)), "sents": F.transform("paras", sents)})
    d = d.withColumns({"all": F.flatten("sents"), "many": F.size("paras") >= 3})
    counts = F.filter(F.transform("sents", F.size), lambda n: n > 0)
    firsts = F.transform("all", lambda h: F.left(h, F.lit(3)))
    twos = F.transform("all", lambda h: F.left(h, F.lit(2)))
    lines = F.filter(F.split("t", "\n", -1), lambda x: T.strip(x) != "")
    marked = F.filter(lines, lambda x: x.rlike(r"^\s*(#{1,6}\s|[-*•]\s|[0-9]+\.\s|（[一二三四五六七八九十]+）|[一二三四五六七八九十]+、)"))
    dense = F.transform("paras", lambda p: F.regexp_count(p, F.lit("[，。、！？；：“”‘’（）,.!?;:()]")) / T.size(p, alphabet))
    inner = F.transform(F.filter("sents", lambda a: F.size(a) >= 3), lambda a: T.spread(F.transform(a, F.length)))
    n = F.length("h")
    half = F.floor(n / 2).cast("int")
    times = lambda x, w: (F.length(x) - F.length(F.replace(x, F.lit(w), F.lit("")))).cast("double")
    a, b = F.left("h", half), F.substr("h", half + 1, n)
    one, two = (F.array(*[times(x, w) for w in words]) for x in (a, b))
    share = lambda c, total: (c + 0.5) / (F.greatest(total, F.lit(1.0)) + 0.5 * len(words))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    kl = T.let(F.struct(one.alias("p"), two.alias("q")), lambda z: F.aggregate(F.zip_with(z["p"], z["q"], lambda p, q: share(p, total(z["p"])) * F.log(share(p, total(z["p"])) / share(q, total(z["q"])))), F.lit(0.0), lambda s, y: s + y))
    own = {
        "paragraph_length_cv": F.when(F.col("many"), T.spread(F.transform("paras", lambda p: T.size(p, alphabet)))), "para_sent_count_cv": F.when(F.col("many"), _cv(counts, 3)),
        "starter3_diversity": F.when(F.size("all") >= 5, F.size(F.array_distinct(firsts)) / F.size(firsts)), "starter2_max_freq": F.when(F.size("all") >= 5, T.counted(twos)["most"] / F.size("all")), "function_word_kl": F.when(n >= 200, kl),
        "heading_list_density": F.when(F.size(lines) > 0, F.size(marked) / F.size(lines)), "para_punct_density_cv": F.when(F.col("many"), _cv(dense, 3)), "para_sent_len_cv_avg": F.when(F.col("many"), T.let(inner, lambda x: F.when(F.size(x) >= 2, T.mean(x)))),
    }
    extracted = lambda p: F.lower(T.extract(p, alphabet))
    first, mid = (F.when(F.col("many"), extracted(p)).otherwise("") for p in (F.get("paras", F.lit(0)), F.array_join(F.slice("paras", 2, F.greatest(F.size("paras") - 2, F.lit(0))), " ")))
    out = d.select("doc_id", *[c.alias(k) for k, c in own.items()], F.transform("paras", extracted).alias("p"), first.alias("h"), mid.alias("mid"))
    out = added(out, ("p",), lambda p: (cohesion(p), ngrams.repeated_share(p)) if len(p) >= 3 else None, "cross_para_tfidf_cohesion double, cross_para_3gram_repeat double", ("p",))
    out = ngrams.placed(out, {"primary": model}, ngrams.means, "a double").withColumnRenamed("mid", "h")
    out = ngrams.placed(out, {"primary": model}, ngrams.means, "b double").withColumn("first_vs_mid_ppl", F.abs(F.pow(F.lit(2.0), F.col("b") - F.col("a")) - 1))
    return out.select("doc_id", *[F.round(k, 4).alias(k) for k in SIGNALS])


def cohesion(p: list[str]) -> float | None:
    """Mean cosine of neighbouring paragraphs' bigrams, weighted by log(paragraphs / paragraphs that hold them)."""
    tf = [Counter(zip(h, h[1:], strict=False)) for h in p]
    df = Counter(g for t in tf for g in t)
    weight = {g: log(len(p) / n) for g, n in df.items()}
    vec = [{g: n * weight[g] for g, n in t.items()} for t in tf]
    norm = [sqrt(sum(v * v for v in t.values())) for t in vec]
    sims = [sum(v * b.get(g, 0.0) for g, v in a.items()) / (m * n) for (a, m), (b, n) in pairwise(zip(vec, norm, strict=True)) if m and n]
    return sum(sims) / len(sims) if sims else None


def effect_sizes(scores: DataFrame) -> DataFrame:
    """(d_pop, d_pooled, d_human_minus_ai) of scores (y 0/1, score): by the mean of population variances (null under five rows a side), by the pooled sample variance, and the latter with its sign turned."""
    s = scores.groupBy("y").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.var_pop("score").alias("p"), F.var_samp("score").alias("v"))
    at = lambda y, c: F.max(F.when(F.col("y") == y, F.col(c)))
    gap = at(1, "m") - at(0, "m")
    pop = F.when(F.least(at(0, "n"), at(1, "n")) >= 5, F.sqrt((at(0, "p") + at(1, "p")) / 2))
    pooled = F.sqrt(F.sum((F.col("n") - 1) * F.col("v")) / F.nullif(F.sum("n") - 2, F.lit(0)))
    some = lambda c: F.when(c > 0, c)
    return s.agg(F.round(gap / some(pop), 4).alias("d_pop"), F.round(gap / some(pooled), 4).alias("d_pooled"), F.round(-gap / some(pooled), 4).alias("d_human_minus_ai"))


BINS = 100  # per unit of a score


def _cumulated(scores: DataFrame, by: list[str], counts: dict[str, Column]) -> DataFrame:
    """(by, score, counts, before_<count>): for each distinct score, sums over the rows of the group and of lower scores.

    Sums below go by bins of a hundredth, so that no task sorts a whole group.
    """
    s = scores.groupBy(*by, "score").agg(*[c.alias(k) for k, c in counts.items()]).withColumn("bin", F.floor(F.col("score") * BINS))
    keys = by or [F.lit(0)]
    bins = s.groupBy(*by, "bin").agg(*[F.sum(k).alias(f"all_{k}") for k in counts])
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*by, "bin", *[F.coalesce(F.sum(f"all_{k}").over(below), F.lit(0)).alias(f"below_{k}") for k in counts])
    inside = Window.partitionBy(*by, "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(*by, "bin", "score", *counts, *[F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"inside_{k}") for k in counts])
    s = s.join(bins, [*by, "bin"])
    return s.select(*by, "score", *counts, *[(F.col(f"below_{k}") + F.col(f"inside_{k}")).alias(f"before_{k}") for k in counts])


def auc(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, n_pos, n_neg, auc) of scores (by, y 0/1, score): the chance that a row of class 1 scores higher, ties half; null without both classes."""
    by = list(by)
    c = _cumulated(scores, by, {f"n{y}": F.sum(F.when(F.col("y") == y, 1).otherwise(0)) for y in (0, 1)})
    won = F.sum(F.col("n1") * (F.col("before_n0") + F.col("n0") / 2))
    n0, n1 = F.sum("n0"), F.sum("n1")
    return c.groupBy(*by).agg(n1.alias("n_pos"), n0.alias("n_neg"), F.round(won / F.nullif(n0.cast("double") * n1, F.lit(0.0)), 6).alias("auc"))


def medians(scores: DataFrame, by: list[str], upper: bool = False) -> DataFrame:
    """(by, median) of scores (by, score): the mean of the two middle ones, or with upper the higher of them."""
    c = _cumulated(scores, by, {"n": F.count("*")}).withColumn("upto", F.col("before_n") + F.col("n"))
    total = c.groupBy(*by).agg(F.sum("n").alias("total"))
    c = c.join(total, by)
    at = lambda r: F.min(F.when(F.col("upto") >= r, F.col("score")))
    high = at(F.floor(F.col("total") / 2) + 1)
    return c.groupBy(*by).agg((high if upper else (at(F.ceil(F.col("total") / 2)) + high) / 2).alias("median"))


VERDICTS = ((0.9, "strong"), (0.75, "useful"), (0.65, "weak"))  # fixed values
LEAST_SIDE = 15


def verdict(a: Column) -> Column:
    out = F.lit("none")
    for least, name in reversed(VERDICTS):
        out = F.when(a >= least, name).otherwise(out)
    return F.when(a.isNotNull(), out)


def scene_report(scores: DataFrame) -> DataFrame:
    """(scene, n_pos, n_neg, mean_pos, mean_neg, auc_raw, lo, hi, m_pos, m_neg, auc_matched, verdict) of scores (scene, y, score, chars): separation of the classes, raw and among rows whose length lies in the overlap of both classes' ranges (null with fewer than LEAST_SIDE rows on a side)."""
    one = lambda y, c: F.when(F.col("y") == y, F.col(c))
    s = scores.groupBy("scene").agg(
        F.round(F.avg(one(1, "score")), 4).alias("mean_pos"), F.round(F.avg(one(0, "score")), 4).alias("mean_neg"),
        F.greatest(F.min(one(0, "chars")), F.min(one(1, "chars"))).alias("lo"), F.least(F.max(one(0, "chars")), F.max(one(1, "chars"))).alias("hi"),
    )
    raw = auc(scores, ["scene"]).withColumnRenamed("auc", "auc_raw")
    inside = scores.join(s.select("scene", "lo", "hi"), "scene").where(F.col("chars").between(F.col("lo"), F.col("hi")))
    m = auc(inside.select("scene", "y", "score"), ["scene"]).select("scene", F.col("n_pos").alias("m_pos"), F.col("n_neg").alias("m_neg"), F.when(F.least("n_pos", "n_neg") >= LEAST_SIDE, F.col("auc")).alias("auc_matched"))
    out = s.join(raw, "scene").join(m, "scene", "left").withColumn("verdict", verdict(F.coalesce("auc_matched", "auc_raw")))
    return out.select("scene", "n_pos", "n_neg", "mean_pos", "mean_neg", "auc_raw", "lo", "hi", F.coalesce("m_pos", F.lit(0)).alias("m_pos"), F.coalesce("m_neg", F.lit(0)).alias("m_neg"), "auc_matched", "verdict")


def margins(scores: DataFrame) -> DataFrame:
    """(scene, model, gid, n, mean, low, high, low_share, very_high_share) of scores (scene, model, score): every combination, both margins and the total (gid as in grouping_id)."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return scores.cube("scene", "model").agg(F.grouping_id().cast("int").alias("gid"), F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.min("score"), 4).alias("low"), F.round(F.max("score"), 4).alias("high"), share(F.col("score") < 25).alias("low_share"), share(F.col("score") >= 75).alias("very_high_share"))


def layer_report(scores: DataFrame, layers: list[str]) -> DataFrame:
    """(layer, n, mean, median, low, high, auc) of scores (y, layers): each score column over all rows, and how well it separates the classes."""
    long = scores.select("y", F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).cast("double").alias("score")) for x in layers])).alias("z")).select("y", "z.*")
    s = long.groupBy("layer").agg(F.count("score").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.min("score"), 4).alias("low"), F.round(F.max("score"), 4).alias("high"))
    return s.join(medians(long, ["layer"]).withColumn("median", F.round("median", 4)), "layer").join(auc(long, ["layer"]).select("layer", "auc"), "layer")


def pair_report(pairs: DataFrame) -> DataFrame:
    """(source, n, correct_rate, gap, delta_avg, delta_median, delta_min, delta_max, preserved, length_ratio, improved) of pairs (source, human, model, after, paragraphs_before, paragraphs_after, chars_before, chars_after), by source and, under a null source, over all.

    correct: the human side scores strictly lower. delta: model less after; the median is the upper one. preserved: as many paragraphs or more.
    """
    d = pairs.withColumns({"delta": F.col("model") - F.col("after")})
    rows = d.union(d.withColumn("source", F.lit(None).cast("string")))
    key = F.coalesce("source", F.lit("\x00"))
    rows = rows.withColumn("k", key)
    yes = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    s = rows.groupBy("k").agg(
        F.first("source").alias("source"), F.count("*").alias("n"), yes(F.col("human") < F.col("model")).alias("correct_rate"), F.round(F.avg(F.col("model") - F.col("human")), 4).alias("gap"), F.round(F.avg("delta"), 4).alias("delta_avg"),
        F.round(F.min("delta"), 4).alias("delta_min"), F.round(F.max("delta"), 4).alias("delta_max"), yes(F.col("paragraphs_after") >= F.col("paragraphs_before")).alias("preserved"), F.round(F.avg(F.col("chars_after") / F.nullif("chars_before", F.lit(0))), 4).alias("length_ratio"), F.sum(F.when(F.col("delta") > 0, 1).otherwise(0)).alias("improved"),
    )
    m = medians(rows.select("k", F.col("delta").alias("score")), ["k"], upper=True)
    return s.join(m, "k").select("source", "n", "correct_rate", "gap", "delta_avg", F.round("median", 4).alias("delta_median"), "delta_min", "delta_max", "preserved", "length_ratio", "improved")


def longform_report(rows: DataFrame) -> DataFrame:
    """(genre, model, n, before, after, delta, preserved, defects) of rows (genre, model, before, after, preserved 0/1, defects): by genre, by model and over all."""
    g = rows.groupingSets([["genre"], ["model"], []], "genre", "model")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("before"), 4).alias("before"), F.round(F.avg("after"), 4).alias("after"), F.round(F.avg(F.col("before") - F.col("after")), 4).alias("delta"), F.round(F.avg("preserved"), 4).alias("preserved"), F.sum("defects").alias("defects"))


def ranked(rows: DataFrame, by: list[str], key: str = "doc_id") -> DataFrame:
    """rows with rn, the place within their group by the MD5 of key, then key.

    Places are counted within 4,096 hash ranges and added up, so that a group of any size spreads over tasks.
    """
    r = rows.withColumn("md5_", F.md5(F.col(key).cast("string"))).withColumn("bin_", F.left("md5_", F.lit(3)))
    n = r.groupBy(*by, "bin_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("at_", F.row_number().over(Window.partitionBy(*by, "bin_").orderBy("md5_", key))).join(n.select(*by, "bin_", before.alias("before_")), [*by, "bin_"])
    return r.withColumn("rn", F.col("before_") + F.col("at_")).drop("md5_", "bin_", "before_", "at_", "n_")


def balanced(rows: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """As many rows of each group as the smallest has, by hash of key."""
    least = rows.groupBy(by).count().agg(F.min("count").alias("least_"))
    return ranked(rows, [by], key).join(F.broadcast(least)).where(F.col("rn") <= F.col("least_")).drop("rn", "least_")


def split(rows: DataFrame, by: str, share: int = 5, key: str = "doc_id") -> DataFrame:
    """rows with holdout: of each group the first 1 / share by hash of key."""
    n = rows.groupBy(by).agg(F.count("*").alias("all_"))
    return ranked(rows, [by], key).join(n, by).withColumn("holdout", F.col("rn") * share <= F.col("all_")).drop("rn", "all_")


def controls(rows: DataFrame, scene: str, genres: list[str], least: int, most: int, n: int, provenance: list[str] | None = None) -> DataFrame:
    """(id, scene, genre, text, chars, provenance): of rows (id, genre, text, provenance) with those genres, provenances and a length in the band, n of each genre by hash of id."""
    r = rows.withColumn("chars", F.length("text")).where(F.col("genre").isin(genres) & F.col("chars").between(least, most))
    r = r if provenance is None else r.where(F.col("provenance").isin(provenance))
    return ranked(r, ["genre"], "id").where(F.col("rn") <= n).select("id", F.lit(scene).alias("scene"), "genre", "text", "chars", "provenance")


def first_of_equal(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, kept): the least id among documents of the same text, but for case and outer spaces; hashes are shuffled, no texts."""
    h = docs.select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("sha"))
    first = h.groupBy("sha").agg(F.min("doc_id").alias("keep_id"))
    return h.join(first, "sha").select("doc_id", "keep_id", (F.col("doc_id") == F.col("keep_id")).alias("kept"))
