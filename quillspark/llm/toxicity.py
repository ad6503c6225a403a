"""Toxicity by class-conditional Kneser-Ney word models.

Two interpolated bigram models, toxic and ordinary, back off to continuation counts of their own class and those to one
shared distribution, counted over the whole corpus, so words that neither class knows well get the same probability in
both. A document is scored by length-normalised log-likelihood differences: of the whole text, and of its most toxic
windows of fixed lengths. Windows are compared at the continuation level, since a context that repeated passages fill
makes every other follower look rare. A logistic curve fitted on rows that the counts have not seen turns them into a probability.

Words and pairs are keyed by their whole 64-bit hashes, and all labelled learning rows are counted, so the tables grow with
them. Of the counts, only those that tell the classes apart are needed: what no class has at more than DISCOUNT
places gives all its mass to the shared counts, which cancel out. Tables of up to MOST_ENTRIES entries are broadcast;
larger ones are joined to the documents' words, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.util import chunks, fold, hashed_words, materialize, mix, table, text_bytes

THRESHOLD = 0.5
MOST_ROWS = 20_000  # for the curve's few weights
MOST_ENTRIES = 4_000_000  # of 24 to 40 bytes each
MOST_IDS = 8_000_000  # labelled ids that are broadcast to the documents; more are joined by a shuffle
DISCOUNT, WINDOWS = 4, (1, 4)  # the discount is high: of words and pairs seen a few times only, nearly all mass goes to the shared counts
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _pairs(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word within its text, 0 before the first, and a key for the pair."""
    before = np.concatenate([np.zeros(1, dtype=np.uint64), word[:-1]]) if len(word) else word
    before[np.concatenate([[True], doc[1:] != doc[:-1]])[: len(word)]] = 0
    return before, mix(before * _SALT + word)


def _places(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The index of each x in sorted keys, len(keys) where it isn't there."""
    at = np.searchsorted(keys, x)
    return np.where(np.append(keys, 0)[at] == x, at, len(keys)) if len(keys) else at


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the words of more than DISCOUNT contexts in a class
    contexts: np.ndarray  # sorted hashes of the words before a pair of more than DISCOUNT places in a class
    pairs: np.ndarray  # sorted keys of such pairs
    own: np.ndarray  # class x word: interpolated continuation probability; here and below, the last entry is for all others
    context: np.ndarray  # class x (count, discounted mass) x context
    pair: np.ndarray  # class x pair: discounted bigram counts

    def likelihoods(self, word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(toxic) - log P(ordinary) of each word after the word before it, and without the word before it."""
        before, key = _pairs(word, doc)
        first, at, context = before == 0, _places(self.pairs, key), _places(self.contexts, before)
        word = _places(self.words, word)
        out = []
        for c in (1, 0):
            count, mass = self.context[c, 0][context], self.context[c, 1][context]
            p = self.own[c][word]
            known = ~first & (count > 0)
            safe = np.maximum(count, 1)
            out.append(np.log(np.where(known, self.pair[c][at] / safe + mass / safe * p, p)))
        return out[0] - out[1], np.log(self.own[1][word] / self.own[0][word])

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """For each text: the mean difference, those of its most toxic windows, and log(1 + words); zeros without words."""
        out = np.zeros((len(texts), 2 + len(WINDOWS)))
        for a, b in chunks(texts):
            word, doc = hashed_words(texts[a:b])
            if not len(word):
                continue
            d, alone = self.likelihoods(word, doc)
            n = np.bincount(doc, minlength=b - a)
            start = np.cumsum(n) - n
            total = np.concatenate([[0], np.cumsum(d)])
            within = np.concatenate([[0], np.cumsum(alone)])
            i = np.arange(len(d))
            out[a:b, 0] = (total[start + n] - total[start]) / np.maximum(n, 1)
            for k, width in enumerate(WINDOWS, 1):
                end = np.minimum(i + width, (start + n)[doc])
                best = np.full(b - a, -np.inf)
                np.maximum.at(best, doc, (within[end] - within[i]) / width)
                out[a:b, k] = np.where(n > 0, best, 0)
            out[a:b, -1] = np.log1p(n)
        return out


@dataclass
class Scorer:
    """Tables of the counts and the weights of the curve; model: the tables as arrays where they are small enough, broadcast."""

    words: DataFrame  # w, p0, p1: interpolated continuation probabilities
    contexts: DataFrame  # u, s0, s1, m0, m1: counts and discounted masses
    pairs: DataFrame  # u, w, s0, s1: discounted counts
    other: float  # log of the ratio of the classes' probabilities of all other words
    model: object | None
    curve: np.ndarray | None = None

    def evidence(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """(keep, a, b, c, d) for each row of docs, which has text as bytes; keep are long columns."""
        return self._mapped(docs, keep) if self.model else self._joined(docs, keep)

    def _mapped(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        held = self.model

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                x = held.value.evidence(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c) for c in x.T)], names=[*keep, *"abcd"])

        return docs.select("text", *keep).mapInArrow(run, ", ".join([*(f"{k} long" for k in keep), *(f"{c} double" for c in "abcd")]))

    def _joined(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                texts, rid = batch.column(1).to_pylist(), batch.column(0)
                for a, b in chunks(texts):
                    word, doc = hashed_words(texts[a:b])
                    before, _ = _pairs(word, doc)
                    for i in range(0, len(word), 1 << 16):
                        j = slice(i, i + (1 << 16))
                        yield pa.RecordBatch.from_arrays([rid.take(pa.array(doc[j] + a)), pa.array(np.arange(len(word))[j]), pa.array(before[j].view(np.int64)), pa.array(word[j].view(np.int64))], names=["rid", "i", "u", "w"])

        rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "text", *keep), "rows")
        t = rows.select("rid", "text").mapInArrow(run, "rid long, i long, u long, w long")
        t = t.join(self.words, "w", "left").join(self.contexts, "u", "left").join(self.pairs.withColumnsRenamed({"s0": "q0", "s1": "q1"}), ["u", "w"], "left")
        alone = F.coalesce(F.log(F.col("p1") / F.col("p0")), F.lit(self.other))
        # of a word in no table, only the ratio of the probabilities counts
        p = {0: F.coalesce("p0", F.lit(1.0)), 1: F.coalesce("p1", F.lit(float(np.exp(self.other))))}
        full = {c: F.when((F.col("u") != 0) & (F.col(f"s{c}") > 0), (F.coalesce(f"q{c}", F.lit(0.0)) + F.col(f"m{c}") * p[c]) / F.col(f"s{c}")).otherwise(p[c]) for c in (0, 1)}
        w = Window.partitionBy("rid").orderBy("i").rowsBetween(0, WINDOWS[1] - 1)
        t = t.select("rid", F.log(full[1] / full[0]).alias("x"), alone.alias("y"), (F.sum(alone).over(w) / WINDOWS[1]).alias("z"))
        t = t.groupBy("rid").agg(F.avg("x").alias("a"), F.max("y").alias("b"), F.max("z").alias("c"), F.log1p(F.count("*")).alias("d"))
        return rows.select("rid", *keep).join(t, "rid", "left").select(*keep, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "abcd"])

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """(keep, score)"""
        logit = reduce(lambda a, b: a + b, [F.col(k) * float(w) for k, w in zip("abcd", self.curve[:-1], strict=True)]) + float(self.curve[-1])
        return self.evidence(docs, keep).select(*keep, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))).alias("score"))


def _shared(docs: DataFrame, words: DataFrame, small: bool) -> tuple[DataFrame, float]:
    """(w, n): the words' places over all documents; and all places of all words."""
    held = docs.sparkSession.sparkContext.broadcast(np.sort(words.toArrow()["w"].to_numpy().view(np.uint64)) if small else None)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, total = held.value, 0
        n = np.zeros(len(keys) + 1 if small else 0, dtype=np.int64)
        for batch in it:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                word = hashed_words(texts[a:b])[0]
                total += len(word)
                if small:
                    n += np.bincount(_places(keys, word), minlength=len(n))
                else:
                    w, k = np.unique(word, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(k)], names=["w", "n"])
        at = np.flatnonzero(n[:-1]) if small else np.zeros(0, dtype=np.int64)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at[i : i + (1 << 16)]].view(np.int64)), pa.array(n[at[i : i + (1 << 16)]])], names=["w", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], names=["w", "n"])

    rows = materialize(docs.select(text_bytes()).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "places")
    total = rows.where("w IS NULL").agg(F.sum("n")).first()[0] or 0
    return rows.where("w IS NOT NULL").join(words.select("w"), "w", "left_semi"), float(max(total, 1))


def _labelled(docs: DataFrame, labels: DataFrame, folds: list[int], most: int | None = None) -> DataFrame:
    """(text, y) of all labelled ids in the folds, or of at most `most` of each class, by least id hash."""
    rows = labels.where(fold(F.col("doc_id")).isin(folds) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    if most is not None:
        parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
        rows = parts[0].union(parts[1])
    small = most is not None or rows.count() <= MOST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(rows) if small else rows, "doc_id").select(text_bytes().alias("text"), "y")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_entries: int = MOST_ENTRIES) -> Scorer | None:
    """Fit on labelled rows of the learning folds: all of folds 2 to 4 give counts, at most most_rows of each class in fold 1 the curve.

    The shared backoff counts come from all documents. None comes back unless both classes are there.
    """

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a, b in chunks(texts):
                word, doc = hashed_words(texts[a:b])
                before, key = _pairs(word, doc)
                _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                toxic = np.bincount(inverse, y[a:b][doc], len(first)).astype(np.int64)
                every = np.bincount(inverse, minlength=len(first))
                yield pa.RecordBatch.from_arrays([pa.array(before[first].view(np.int64)), pa.array(word[first].view(np.int64)), pa.array(every - toxic), pa.array(toxic)], names=["u", "w", "c0", "c1"])

    counted = _labelled(docs, labels, [2, 3, 4]).mapInArrow(pairs, "u long, w long, c0 long, c1 long")
    counted = materialize(counted.groupBy("u", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "bigrams")
    less = [F.least(F.col(f"c{c}"), F.lit(DISCOUNT)) for c in (0, 1)]
    kinds = counted.groupBy("w").agg(*[F.sum((F.col(f"c{c}") > 0).cast("long")).alias(f"n{c}") for c in (0, 1)])
    kinds = materialize(kinds, "kinds")
    sums = kinds.agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)], *[F.sum(F.least(f"n{c}", F.lit(DISCOUNT))).alias(f"m{c}") for c in (0, 1)]).first()
    if not sums.n0 or not sums.n1:
        return None
    contexts = counted.where("u <> 0").groupBy("u").agg(*[F.sum(f"c{c}").alias(f"s{c}") for c in (0, 1)], *[F.sum(less[c]).alias(f"m{c}") for c in (0, 1)]).where("s0 > m0 OR s1 > m1")
    contexts = materialize(contexts, "contexts")
    pair = counted.where(F.greatest("c0", "c1") > DISCOUNT).select("u", "w", *[(F.col(f"c{c}") - less[c]).cast("double").alias(f"s{c}") for c in (0, 1)])
    # a word of few contexts may still end such a pair, and then its shared count doesn't cancel out
    ends = pair.select("w", F.lit(True).alias("ends")).distinct()
    words = materialize(kinds.join(ends, "w", "left").where((F.greatest("n0", "n1") > DISCOUNT) | F.col("ends")).drop("ends"), "kept")
    small = words.count() + contexts.count() + pair.count() <= most_entries
    places, total = _shared(docs, words, small)
    share = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) / total
    p = [F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0)) / sums[f"n{c}"] + sums[f"m{c}"] / sums[f"n{c}"] * share for c in (0, 1)]
    words = materialize(words.join(places, "w", "left").select("w", p[0].alias("p0"), p[1].alias("p1")), "words")
    rest = [sums[f"m{c}"] / sums[f"n{c}"] / total for c in (0, 1)]
    scorer = Scorer(words, contexts, pair, float(np.log(rest[1] / rest[0])), docs.sparkSession.sparkContext.broadcast(_arrays(words, contexts, pair, rest)) if small else None)
    seen = scorer.evidence(_labelled(docs, labels, [1], most_rows).withColumn("y", F.col("y").cast("long")), ["y"]).toArrow()
    scorer.curve = _logistic(np.column_stack([seen[k].to_numpy() for k in "abcd"]), seen["y"].to_numpy())
    return scorer


def _arrays(words: DataFrame, contexts: DataFrame, pairs: DataFrame, rest: list[float]) -> Model:
    """The tables as sorted arrays; at most MOST_ENTRIES rows in all."""
    words, contexts, pairs = words.toArrow(), contexts.toArrow(), pairs.toArrow()
    w, u = words["w"].to_numpy().view(np.uint64), contexts["u"].to_numpy().view(np.uint64)
    k = mix(pairs["u"].to_numpy().view(np.uint64) * _SALT + pairs["w"].to_numpy().view(np.uint64))
    a, b, c = np.argsort(w), np.argsort(u), np.argsort(k)
    end = lambda x, order, last: np.append(x.to_numpy()[order], last)
    own = np.stack([end(words[f"p{y}"], a, rest[y]) for y in (0, 1)])
    context = np.stack([np.stack([end(contexts[f"{x}{y}"], b, 0) for x in "sm"]) for y in (0, 1)]).astype(np.float64)
    return Model(w[a], u[b], k[c], own, context, np.stack([end(pairs[f"s{y}"], c, 0) for y in (0, 1)]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on standardised evidence, the last weight is the constant."""
    if len(set(y.tolist())) < 2:
        return np.append(np.ones(x.shape[1]), -4.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, r = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 0)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (s * (1 - s) + 1e-9)[:, None]).T @ z / len(z) + np.diag(r), z.T @ (s - y) / len(z) + r * w)
        w -= step * min(1, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null texts count as empty; a text without words has zero evidence and is scored by the curve. Repeated rows and null ids
    stay (a null id is not held out). Without rows of both classes to learn from, every score is 0.
    """
    scorer = train(docs, labels, most_entries=most_entries)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    out = scorer.score(rows, ["doc_id"]) if scorer else rows.select("doc_id", F.lit(0.0).alias("score"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
