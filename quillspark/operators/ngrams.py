"""Character n-gram models and what follows from them for each document.

A model is one table: the counts of padded trigrams, from which the counts of uni-, bi- and trigrams follow. Up to MOST_GRAMS of
them are broadcast as arrays of packed grams, and a document's series of log probabilities is looked up where its text is: no gram
becomes a row, nothing is shuffled. Past that bound the distinct grams of the documents are joined to the model.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.rowwise import added
from quillspark.functions.scratch import dealt, written

PAD = "\u0001"
K, WEIGHT, LEAST_KINDS = 0.01, 0.6, 1000  # fixed values: smoothing, weight of the trigram, least vocabulary
NAMES = ("primary", "human", "wiki", "news")
MOST_GRAMS = 4_000_000  # of a model that is broadcast: 32 MB for its grams and for each model's log probabilities


def letters(docs: DataFrame, alphabet: str = "letters") -> DataFrame:
    """(doc_id, h): the characters that count, lower-cased."""
    return docs.select("doc_id", F.lower(T.extract(F.coalesce("text", F.lit("")), alphabet)).alias("h"))


def codes(h: str) -> np.ndarray:
    return np.frombuffer(h.encode("utf-32-le"), np.uint32).astype(np.int64)


def packed(c: np.ndarray, n: int) -> np.ndarray:
    """The n-grams (three characters at most) of code points, in order, a number of n times 21 bits each."""
    out = c[: len(c) - n + 1]
    for k in range(1, n):
        out = (out << 21) | c[k : len(c) - n + 1 + k]
    return out if len(c) >= n else out[:0]


def unpacked(keys: np.ndarray, n: int) -> list[str]:
    text = np.stack([(keys >> 21 * (n - 1 - k)) & 0x1FFFFF for k in range(n)], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + n] for i in range(0, len(text), n)]


def bags(docs: DataFrame, n: int, alphabet: str = "letters", h: str | None = None) -> DataFrame:
    """(doc_id, g, n): how often each document holds each n-gram."""
    rows = docs.select("doc_id", F.col(h).alias("h")) if h else letters(docs, alphabet)
    return rows.mapInArrow(counted(n), rows.select("doc_id").schema.add("g", "string").add("n", "long"))


def counted(n: int, pad: str = "", whole: bool = False) -> Callable:
    """An Arrow function: (key, h) to (key, g, count) of each h's n-grams, or, with whole, (h) to (g, c) of a batch's."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = [packed(codes(h + pad), n) for h in batch.column(batch.num_columns - 1).to_pylist()]
            if whole:
                g, c = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(g, n), pa.string()), pa.array(c, pa.int64())], names=["g", "c"])
                continue
            for at in range(0, len(keys), 256):
                every = [np.unique(k, return_counts=True) for k in keys[at : at + 256]]
                ids = batch.column(0).slice(at, 256).take(pa.array(np.repeat(np.arange(len(every)), [len(g) for g, _ in every])))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x for g, _ in every for x in unpacked(g, n)], pa.string()), pa.array(np.concatenate([c for _, c in every]), pa.int64())], names=["doc_id", "g", "n"])

    return run


def train(texts: DataFrame, alphabet: str = "letters", per_line: bool = False, holdout: float = 0.0, name: str = "model") -> DataFrame:
    """(g, c): counts of padded trigrams over texts(text).

    per_line: grams don't cross line ends. holdout: that share of lines (or texts), chosen by hash, is left out.
    """
    t = dealt(texts.select(F.coalesce("text", F.lit("")).alias("text")))
    if per_line:
        t = t.select(F.explode(F.split("text", "\n")).alias("text"))
    if holdout:
        t = t.where(F.pmod(F.xxhash64("text"), F.lit(10_000)) >= int(holdout * 10_000))
    h = F.lower(T.extract(F.col("text"), alphabet))
    t = t.select(h.alias("h")).where("h <> ''").mapInArrow(counted(3, PAD * 2, whole=True), "g string, c long")
    return written(t.groupBy("g").agg(F.sum("c").alias("c")), name)


def table(model: DataFrame, n: int) -> DataFrame:
    """(g, c) of a model's n-grams."""
    g = F.substr("g", F.lit(1), F.lit(n))
    rows = model.select(g.alias("g"), "c").where(~F.contains("g", F.lit(PAD)))
    return rows if n == 3 else rows.groupBy("g").agg(F.sum("c").alias("c"))


def kinds(model: DataFrame) -> tuple[int, int]:
    """Vocabulary size for smoothing (LEAST_KINDS at least), and all characters."""
    v, total = table(model, 1).agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    return max(v, LEAST_KINDS), total


def bigram_log_probs(grams: DataFrame, model: DataFrame) -> DataFrame:
    """grams(g) of two characters with lp: log2 P(b | a)."""
    v, _ = kinds(model)
    a = table(model, 1).select(F.col("g").alias("a"), F.col("c").alias("ca"))
    out = grams.withColumn("a", F.left("g", F.lit(1))).join(table(model, 2), "g", "left").join(a, "a", "left")
    return out.select("g", F.log2((F.coalesce("c", F.lit(0)) + K) / (F.coalesce("ca", F.lit(0)) + K * v)).alias("lp"))


def log_probs(grams: DataFrame, model: DataFrame, alias: str = "lp") -> DataFrame:
    """grams(g) of three characters with their log2 probability, a mix of the trigram's and the bigram's."""
    v, _ = kinds(model)
    side = lambda n, g, c: table(model, n).select(F.col("g").alias(g), F.col("c").alias(c))
    out = grams.withColumns({"ab": F.left("g", F.lit(2)), "bc": F.right("g", F.lit(2)), "b": F.substr("g", F.lit(2), F.lit(1))})
    out = out.join(side(3, "g", "c3"), "g", "left").join(side(2, "ab", "cab"), "ab", "left").join(side(2, "bc", "cbc"), "bc", "left").join(side(1, "b", "cb"), "b", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    p = WEIGHT * (n("c3") + K) / (n("cab") + K * v) + (1 - WEIGHT) * (n("cbc") + K) / (n("cb") + K * v)
    return out.withColumn(alias, F.log2(p)).drop("ab", "bc", "b", "c3", "cab", "cbc", "cb")


def scored(docs: DataFrame, models: dict[str, DataFrame], alphabet: str = "letters", own: bool = False, h: str | None = None) -> DataFrame:
    """(doc_id, g, n, lp_<model>): each document's distinct trigrams with their log probabilities.

    own: the primary model was trained on these documents, so its trigrams are all there are.
    """
    bag = bags(docs, 3, alphabet, h)
    grams = table(models["primary"], 3).select("g") if own else bag.select("g").distinct()
    for name, model in models.items():
        grams = log_probs(grams, model, f"lp_{name}")
    return bag.join(written(grams, "grams"), "g")


def find(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The values at x in sorted keys, 0 where there are none."""
    if not len(keys):
        return np.zeros(len(x), values.dtype)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, values[i], 0)


def summed(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys of a sorted array as one, their counts added up."""
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(c, first) if len(first) else c[:0]


class Lookup:
    """The counts of models as sorted arrays; log probabilities of the first model's trigrams are worked out once for all models."""

    def __init__(self, models: dict[str, tuple[list[str], np.ndarray]]):
        self.names, self.counts = list(models), []
        for grams, c in models.values():
            keys = packed(codes("".join(grams)), 3)[::3] if grams else np.zeros(0, np.int64)
            order = np.argsort(keys)
            keys, c = keys[order], c[order].astype(np.int64)
            one, two = summed(keys >> 42, c), (keys >> 21) & 0x1FFFFF != ord(PAD)
            two, three = summed(keys[two] >> 21, c[two]), keys & 0x1FFFFF != ord(PAD)
            self.counts.append((one, two, (keys[three], c[three]), max(len(one[0]), LEAST_KINDS), int(c.sum())))
        self.keys = self.counts[0][2][0]
        self.lps = self.of(self.keys)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of packed trigrams, a row for each model."""
        out = []
        for one, two, three, v, _ in self.counts:
            p = WEIGHT * (find(*three, keys) + K) / (find(*two, keys >> 21) + K * v) + (1 - WEIGHT) * (find(*two, keys & (1 << 42) - 1) + K) / (find(*one, (keys >> 21) & 0x1FFFFF) + K * v)
            out.append(np.log2(p))
        return np.stack(out)

    def series(self, c: np.ndarray) -> np.ndarray:
        """Log probabilities at the places of code points, a row for each model."""
        keys = packed(c, 3)
        if not len(self.keys):
            return self.of(keys)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = self.lps[:, i]
        if (unknown := self.keys[i] != keys).any():
            out[:, unknown] = self.of(keys[unknown])
        return out

    def unigrams(self, c: np.ndarray) -> np.ndarray:
        """Log probabilities of single characters by the first model."""
        one, _, _, v, total = self.counts[0]
        return np.log2((find(*one, c) + K) / (total + K * v))

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Packed bigrams and their ranks, from 1, among those that begin alike."""
        keys, c = self.counts[0][1]
        order = np.lexsort((keys, -c, keys >> 21))
        first = np.flatnonzero(np.diff(keys[order] >> 21, prepend=-1))
        r = np.empty(len(keys), np.int64)
        r[order] = np.arange(len(keys)) - np.repeat(first, np.diff(first, append=len(keys))) + 1
        return keys, r

    def top(self, n: int) -> np.ndarray:
        """The n most frequent characters, by code point among equals."""
        keys, c = self.counts[0][0]
        return keys[np.lexsort((keys, -c))[:n]]


class Known:
    """The series of one document whose grams were joined to the models."""

    def __init__(self, names: list[str], grams: list[str] | None, lps: list[list[float]]):
        self.names, self.at = names, {g: i for i, g in enumerate(grams or ())}
        self.lps = np.array(lps if grams else [[]] * len(names), np.float64)

    def series(self, c: np.ndarray) -> np.ndarray:
        keys = packed(c, 3)
        return self.lps[:, np.array([self.at[g] for g in unpacked(keys, 3)], np.int64)]


def looked_up(model: DataFrame) -> bool:
    return model.count() <= MOST_GRAMS


def collected(models: dict[str, DataFrame]) -> dict[str, tuple[list[str], np.ndarray]]:
    rows = {n: m.select("g", "c").toArrow() for n, m in models.items()}
    return {n: (t.column("g").to_pylist(), t.column("c").to_numpy()) for n, t in rows.items()}


def lookup(models: dict[str, DataFrame]):
    """A broadcast Lookup."""
    return next(iter(models.values())).sparkSession.sparkContext.broadcast(Lookup(collected(models)))


def placed(rows: DataFrame, models: dict[str, DataFrame], f: Callable, kind: str, inputs: tuple[str, ...] = (), drop: tuple[str, ...] = ("h",), own: bool = False) -> DataFrame:
    """rows(doc_id, h, ...) with the columns of kind: what f(code points of h, their log probabilities with a row for each model, *inputs) gives."""
    names = list(models)
    if all(looked_up(m) for m in models.values()):
        held = lookup(models)

        def one(h: str, *more) -> tuple | None:
            c = codes(h)
            return f(c, held.value.series(c), *more)

        return added(rows, ("h", *inputs), one, kind, drop)
    s = scored(rows.select("doc_id", "h"), models, own=own, h="h").groupBy("doc_id").agg(F.collect_list("g").alias("_g"), F.array(*[F.collect_list(f"lp_{n}") for n in names]).alias("_lp"))

    def other(h: str, g: list | None, lp: list, *more) -> tuple | None:
        c = codes(h)
        return f(c, Known(names, g, lp).series(c), *more)

    return added(rows.join(s, "doc_id", "left"), ("h", "_g", "_lp", *inputs), other, kind, (*drop, "_g", "_lp"))


def means(_: np.ndarray, lps: np.ndarray) -> tuple | None:
    return tuple(map(float, lps.mean(1))) if lps.shape[1] else None


def perplexity(docs: DataFrame, model: DataFrame, alphabet: str = "letters", own: bool = False) -> DataFrame:
    """(doc_id, avg_lp, ppl) of documents of three characters or more."""
    s = placed(letters(docs, alphabet), {"primary": model}, means, "m double", own=own).where("m IS NOT NULL")
    return s.select("doc_id", F.round("m", 4).alias("avg_lp"), F.round(F.pow(F.lit(2.0), -F.col("m")), 3).alias("ppl"))


def unigram_mean(h: str | np.ndarray, look: Lookup) -> float | None:
    c = codes(h) if isinstance(h, str) else h
    return float(look.unigrams(c).mean()) if len(c) else None


def unigram_perplexity(docs: DataFrame, model: DataFrame, alphabet: str = "letters", own: bool = False) -> DataFrame:
    """(doc_id, unigram_ppl, ratio): ratio to the perplexity, 0 where there is none."""
    ones = lookup({"primary": table(model, 1).withColumn("g", F.concat("g", F.lit(PAD * 2)))})
    d = added(letters(docs, alphabet), ("h",), lambda h: (unigram_mean(h, ones.value),), "m double")
    s = placed(d, {"primary": model}, means, "t double", own=own).where("m IS NOT NULL")
    ratio = F.pow(F.lit(2.0), F.col("t") - F.col("m"))
    return s.select("doc_id", F.round(F.pow(F.lit(2.0), -F.col("m")), 3).alias("unigram_ppl"), F.round(F.coalesce(ratio, F.lit(0.0)), 4).alias("ratio"))


def shape(x: np.ndarray) -> tuple[float, float]:
    """Skew and excess kurtosis; zeros under 16 positions or without variance."""
    d = x - x.mean() if len(x) else x
    m2 = float(d @ d) / max(len(x), 1)
    if len(x) < 16 or m2 < 1e-12:
        return 0.0, 0.0
    return float((d**3).mean()) / m2**1.5, float((d**4).mean()) / (m2 * m2) - 3


def moments(docs: DataFrame, model: DataFrame, alphabet: str = "letters", own: bool = False) -> DataFrame:
    """(doc_id, n, skew, kurt) of the log probabilities; zeros under 16 positions or without variance."""
    one = lambda _, lps: (lps.shape[1], *shape(lps[0])) if lps.shape[1] else None
    s = placed(letters(docs, alphabet), {"primary": model}, one, "n long, skew double, kurt double", own=own).where("n IS NOT NULL")
    return s.select("doc_id", "n", F.round("skew", 4).alias("skew"), F.round("kurt", 4).alias("kurt"))


def model_differences(docs: DataFrame, models: dict[str, DataFrame], alphabet: str = "letters", own: bool = False) -> DataFrame:
    """(doc_id, d_human, d_wiki_human, d_primary_wiki, d_news_human, d_news_wiki): means of differences of log probabilities."""
    s = placed(letters(docs, alphabet), {n: models[n] for n in NAMES}, means, ", ".join(f"{n} double" for n in NAMES), own=own).where("primary IS NOT NULL")
    pairs = {"d_human": ("primary", "human"), "d_wiki_human": ("wiki", "human"), "d_primary_wiki": ("primary", "wiki"), "d_news_human": ("news", "human"), "d_news_wiki": ("news", "wiki")}
    return s.select("doc_id", *[F.round(F.col(a) - F.col(b), 4).alias(k) for k, (a, b) in pairs.items()])


def ranks(model: DataFrame) -> DataFrame:
    """(g, r): the rank of each bigram among those that begin alike, by count, then by character."""
    from pyspark.sql import Window

    two = table(model, 2)
    return two.select("g", F.row_number().over(Window.partitionBy(F.left("g", F.lit(1))).orderBy(F.col("c").desc(), "g")).alias("r"))


BUCKETS = (10, 100, 1000)


def ranked_places(c: np.ndarray, keys: np.ndarray, r: np.ndarray) -> tuple | None:
    """Positions by the rank of their bigram: up to each of BUCKETS, and beyond; None under 29 positions."""
    x = find(keys, r, packed(c, 2))
    n = [int(((x > 0) & (x <= e)).sum()) for e in BUCKETS]
    return (n[0], n[1] - n[0], n[2] - n[1], len(x) - n[2]) if len(x) >= 29 else None


def ranked_pairs(model: DataFrame):
    """A broadcast of Lookup.ranks; there are far fewer bigrams than MOST_PAIRS, which is checked."""
    two = table(model, 2).limit(MOST_PAIRS + 1)
    if two.count() > MOST_PAIRS:
        raise ValueError("the model has too many bigrams for ranks")
    held = Lookup(collected({"primary": two.withColumn("g", F.concat("g", F.lit(PAD)))}))
    return model.sparkSession.sparkContext.broadcast(held.ranks())


def rank_buckets(docs: DataFrame, model: DataFrame, alphabet: str = "letters") -> DataFrame:
    """(doc_id, top10, top100, top1000, beyond): positions by the rank of their bigram, unseen ones beyond; documents of 30 characters or more."""
    if looked_up(table(model, 2)):
        held = ranked_pairs(model)
        return added(letters(docs, alphabet), ("h",), lambda h: ranked_places(codes(h), *held.value), "top10 long, top100 long, top1000 long, beyond long", ("h",)).where("beyond IS NOT NULL")
    r = F.coalesce("r", F.lit(1 << 30))
    edges = {"top10": (1, 10), "top100": (11, 100), "top1000": (101, 1000), "beyond": (1001, 1 << 30)}
    b = bags(docs, 2, alphabet).join(ranks(model), "g", "left")
    b = b.groupBy("doc_id").agg(*[F.sum(F.when(r.between(lo, hi), F.col("n")).otherwise(0)).cast("long").alias(k) for k, (lo, hi) in edges.items()], F.sum("n").alias("all"))
    return b.where("all >= 29").drop("all")


def bits(h: str) -> float | None:
    """The entropy of a text's bigrams; None under two characters."""
    if len(h) < 2:
        return None
    n = np.unique(packed(codes(h), 2), return_counts=True)[1]
    return float(np.log2(len(h) - 1) - (n * np.log2(n)).sum() / (len(h) - 1))


def entropy(docs: DataFrame, alphabet: str = "letters") -> DataFrame:
    """(doc_id, entropy) of bigrams in bits; 5 under ten characters."""
    d = added(letters(docs, alphabet), ("h",), lambda h: (len(h), bits(h)), "n int, e double", ("h",)).where("e IS NOT NULL")
    return d.select("doc_id", F.when(F.col("n") < 10, F.lit(5.0)).otherwise(F.round("e", 4)).alias("entropy"))


def parts(docs: DataFrame, pattern: str = "\n\\s*\n", least: int = 20, alphabet: str = "letters") -> DataFrame:
    """(doc_id, p): an array of the characters that count, lower-cased, of each paragraph with enough of them; documents without one are left out."""
    return docs.select("doc_id", counting_parts(F.coalesce("text", F.lit("")), pattern, least, alphabet).alias("p")).where("size(p) > 0")


def counting_parts(t: Column, pattern: str = "\n\\s*\n", least: int = 20, alphabet: str = "letters") -> Column:
    return F.transform(T.paragraphs_by(t, pattern, least, alphabet), lambda s: F.lower(T.extract(s, alphabet)))


def entropy_spread(p: list[str]) -> float:
    """Standard deviation over mean of the parts' bigram entropies; 0 under three parts."""
    e = np.array([x for h in p if (x := bits(h)) is not None])
    return 0.0 if len(e) < 3 or e.mean() < 1e-9 else float(e.std() / e.mean())


def paragraph_entropy_spread(docs: DataFrame, alphabet: str = "letters") -> DataFrame:
    """(doc_id, value): standard deviation over mean of the paragraphs' bigram entropies; 0 under three paragraphs."""
    return added(parts(docs, "\n\\s*\n|\n", 20, alphabet), ("p",), lambda p: (entropy_spread(p),), "value double", ("p",)).withColumn("value", F.round("value", 4))


def repeated_share(p: list[str]) -> float:
    """The share of distinct trigrams that two or more parts hold; 0 under three parts."""
    n = np.unique(np.concatenate([np.unique(packed(codes(h), 3)) for h in p]), return_counts=True)[1] if len(p) >= 3 else np.zeros(0)
    return float((n >= 2).sum() / len(n)) if len(n) else 0.0


def cross_paragraph_repeats(docs: DataFrame, alphabet: str = "letters") -> DataFrame:
    """(doc_id, value): the share of distinct trigrams that two or more paragraphs hold; 0 under three paragraphs."""
    return added(parts(docs, "\n\\s*\n", 20, alphabet), ("p",), lambda p: (repeated_share(p),), "value double", ("p",)).withColumn("value", F.round("value", 4))


SERIES = ("n", "lag1", "lag2", "lag4", "lag8", "flatness", "burst", "n_windows")
SERIES_KIND = ", ".join(f"{k} {'long' if k in ('n', 'n_windows') else 'double'}" for k in SERIES)
LAGS, WIDTH, MOST = (1, 2, 4, 8), 50, 256


def series_features(x: np.ndarray) -> tuple:
    """SERIES of one document's log probabilities; zeros where it is too short."""
    n = len(x)
    d = x - x.mean() if n else x
    v = float(d @ d)
    lags = [float(d[k:] @ d[:-k]) / v if n > k + 2 and v >= 1e-12 else 0.0 for k in LAGS]
    flat = 0.0
    if n >= 16:
        y = x[(np.arange(MOST) * (n / MOST)).astype(int)] if n > MOST else x
        power = np.maximum(np.abs(np.fft.rfft(y - y.mean())[1 : len(y) // 2]) ** 2, 1e-12)
        flat = float(np.exp(np.log(power).mean()) / power.mean())
    total = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(0, n - WIDTH + 1, WIDTH // 2)
    ppl = 2.0 ** -((total[at + WIDTH] - total[at]) / WIDTH)
    return n, *lags, flat, float(ppl.std() / ppl.mean()) if len(ppl) >= 3 else 0.0, len(ppl)


def series(docs: DataFrame, model: DataFrame, alphabet: str = "letters", own: bool = False) -> DataFrame:
    """(doc_id, SERIES) of documents of three characters or more: what depends on the order of log probabilities."""
    one = lambda _, lps: series_features(lps[0]) if lps.shape[1] else None
    return placed(letters(docs, alphabet), {"primary": model}, one, SERIES_KIND, own=own).where("n IS NOT NULL")


def curved(c: np.ndarray, lp: np.ndarray, look: Lookup, positions: int = 50, others: int = 10, seed: int = 42) -> float:
    """curvature of one document, from its code points and their log probabilities."""
    if len(c) < 30:
        return 0.0
    at, top = np.arange(2, len(c)), look.top(others + 1)
    if len(at) > positions:
        at = np.array(random.Random(seed).sample(range(2, len(c)), positions))
    same = top[None, :] == c[at][:, None]
    # the most frequent ones without the character itself, without the last one where it isn't among them
    rest = ~same
    rest[:, others:] &= same.any(1)[:, None]
    lps = look.of((((c[at - 2] << 42) | (c[at - 1] << 21))[:, None] | top[None, :]).ravel())[0].reshape(same.shape)
    return float((lp[at - 2] - np.where(rest, lps, 0).sum(1) / np.maximum(rest.sum(1), 1)).mean())


def curvature(docs: DataFrame, model: DataFrame, alphabet: str = "letters", positions: int = 50, others: int = 10, seed: int = 42, own: bool = False) -> DataFrame:
    """(doc_id, value): mean of a character's log probability less that of the most frequent other ones, at up to `positions` places that depend on the length only; 0 under 30 characters.

    The model's counts for the alternatives are broadcast: those of the (others + 1) most frequent characters after any pair, so
    their number is bounded by the model's bigrams; past MOST_PAIRS of them use a smaller model.
    """
    held = alternatives(model, others)
    return placed(letters(docs, alphabet), {"primary": model}, lambda c, lps: (curved(c, lps[0], held.value, positions, others, seed),), "value double", own=own)


def alternatives(model: DataFrame, others: int = 10):
    """A broadcast Lookup of all that curvature asks for; trigrams that end in other than the most frequent characters are cut to their bigrams."""
    if not looked_up(model):
        if table(model, 2).count() > MOST_PAIRS:
            raise ValueError("the model has too many bigrams for curvature")
        top = [r.g for r in table(model, 1).orderBy(F.col("c").desc(), "g").limit(others + 1).collect()]
        cut = F.when(F.right("g", F.lit(1)).isin(top), F.col("g")).otherwise(F.concat(F.left("g", F.lit(2)), F.lit(PAD)))
        model = model.groupBy(cut.alias("g")).agg(F.sum("c").alias("c"))
    return lookup({"primary": model})


MOST_PAIRS = 4_000_000
