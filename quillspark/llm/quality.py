"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled rows of quality 1 in the learning folds; the unlabelled set is web text of the same
folds without its labels, and rows labelled 0 are never used as such. The models minimise the non-negative unbiased risk
    pi * E_pos[loss(+)] + max(0, E_unl[loss(-)] - pi * E_pos[loss(-)])
with the logistic loss and a ridge, over quantile-binned style features of the whole text. Each model leaves one part of
the rows out and is averaged into the final one. The scores of the parts left out, which no model has seen, give the class
prior (best-bin estimate) and the posterior: prior times the density ratio of positives to unlabelled rows, kept monotone by
pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.util import chunks, fold, hashed_words, table, text_bytes

THRESHOLD = 0.3
MOST_POSITIVE = MOST_UNLABELLED = 20_000
BINS = 24
FOLDS, RIDGE, INNER_PRIOR = 3, 30.0, 0.5  # ridge: over the number of rows; the inner prior only orders, the posterior sets the level
NAMES = (
    "log_bytes", "upper", "digit", "space", "line", "symbol", "stop", "comma", "pipe", "bang", "other_punct", "high", "word_len",
    "log_words", "distinct", "same_as_previous", "top_word", "line_len", "vowel", "symbol_run",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.float32)
    out[list(chars)] = 1
    return out


_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SYMBOL = np.array([c in b"#$%&*+<>=@^_~\\/{}[]" for c in range(256)])
_COUNTED = np.stack([
    _class(bytes(range(65, 91))), _class(bytes(range(48, 58))), _class(b" \t\r\n\x0b\x0c"), _class(b"\n"), _SYMBOL.astype(np.float32), _class(b"."),
    _class(b","), _class(b"|"), _class(b"!"), _class(bytes(set(_PUNCT) - set(b".,|!#$%&*+<>=@^_~\\/{}[]"))), _class(bytes(range(128, 256))), _class(b"aeiouAEIOU"),
])


def features(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each whole text; an empty text gives zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for a, b in chunks(texts):
        part, n = texts[a:b], b - a
        size = np.array([len(t) for t in part], dtype=np.int64)
        hist = np.stack([np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256) for t in part])
        share = (hist @ _COUNTED.T) / np.maximum(size, 1)[:, None]
        hashes, doc = hashed_words(part)
        words = np.bincount(doc, minlength=n)
        per = np.maximum(words, 1)
        same = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n) / per
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
        kinds = np.bincount(d[first], minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, d[first], np.diff(np.append(first, len(h))))
        lines = hist[:, 10] + 1
        runs = np.array([_symbol_runs(t) for t in part])
        out[a:b] = np.column_stack([
            np.log1p(size), *share[:, :11].T, (size - hist[:, 32] - hist[:, 10]) / per, np.log1p(words), kinds / per, same, top / per,
            np.log1p(size / lines), share[:, 11], runs / np.maximum(size, 1),
        ])
    return out


def _symbol_runs(text: bytes) -> int:
    """How many symbols follow the same symbol."""
    t = np.frombuffer(text, dtype=np.uint8)
    return int(((t[1:] == t[:-1]) & _SYMBOL[t[1:]]).sum())


@dataclass
class Model:
    edges: np.ndarray  # feature x inner bin edges
    weights: np.ndarray  # feature x bin
    bias: float
    levels: tuple[np.ndarray, np.ndarray] | None = None  # logits and their posteriors, both ascending

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        return np.clip(self.weights[np.arange(x.shape[1]), bins].sum(axis=1) + self.bias, -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        own = 1 / (1 + np.exp(-z))
        return own if self.levels is None else 0.98 * np.interp(z, *self.levels) + 0.02 * own  # a little of it orders scores within one level


def edges_of(x: np.ndarray) -> np.ndarray:
    return np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, edges: np.ndarray, rounds: int = 25, ridge: float = RIDGE) -> Model:
    """Minimise the risk by Newton steps; a step that would bring the negative part of the risk below zero is shortened.

    With the logistic loss the risk is E_unl[log(1 + e^z)] - pi * E_pos[z], which is convex in the weights.
    """
    f = positive.shape[1]
    decay = ridge / (len(positive) + len(unlabelled))

    def wide(x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], axis=1)
        out = np.zeros((len(x), f * BINS + 1), dtype=np.float32)
        out[np.arange(len(x))[:, None], bins + np.arange(f) * BINS] = 1
        out[:, -1] = 1
        return out

    xp, xu = wide(positive), wide(unlabelled)
    centre, ridges = prior * xp.mean(axis=0), np.append(np.full(f * BINS, decay), 1e-8)
    w = np.zeros(f * BINS + 1)

    def risk(w: np.ndarray) -> tuple[float, float]:
        zp, zu = xp @ w, xu @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, negative) + 0.5 * (ridges * w * w).sum(), negative

    now, _ = risk(w)
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(xu @ w, -30, 30)))
        g = xu.T @ s / len(xu) - centre + ridges * w
        h = (xu * (s * (1 - s) / len(xu)).astype(np.float32)[:, None]).T @ xu + np.diag(ridges + 1e-9)
        step = np.linalg.solve(h.astype(np.float64), g)
        size = 1.0
        while size > 1e-3:
            new, negative = risk(w - size * step)
            if negative >= 0 and new < now:
                break
            size /= 2
        else:
            break
        w, done, now = w - size * step, now - new < 1e-6, new
        if done:
            break
    return Model(edges, w[:-1].reshape(f, BINS), float(w[-1]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.05) -> float:
    """Best-bin estimate from scores of positives and unlabelled rows: the least ratio of their upper tail shares, with a confidence margin."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 60))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / delta) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / delta) / (2 * len(positive)))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.97))


def posterior(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending scores and prior * p(score | positive) / p(score | unlabelled) there, at most 1, monotone."""
    z = np.concatenate([positive, unlabelled])
    order = np.argsort(z, kind="stable")
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(unlabelled))])[order]
    pools: list[list[float]] = []  # positives, rows, first and last score
    for score, own in zip(z[order].tolist(), y.tolist(), strict=True):
        pools.append([own, 1.0, score, score])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            own, rows, _, last = pools.pop()
            pools[-1][0] += own
            pools[-1][1] += rows
            pools[-1][3] = last
    share = np.array([p / n for p, n, *_ in pools])
    level = np.minimum(prior * share / np.maximum(1 - share, 1e-9) * len(unlabelled) / len(positive), 1)
    return np.array([x for p in pools for x in p[2:]]), np.repeat(level, 2)


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, folds: int = FOLDS) -> Model:
    edges = edges_of(np.concatenate([positive, unlabelled]))
    folds = min(folds, len(positive), len(unlabelled))
    i, j = np.arange(len(positive)) % max(folds, 1), np.arange(len(unlabelled)) % max(folds, 1)
    if folds < 2:
        models = [fit(positive, unlabelled, INNER_PRIOR, edges)]
        zp, zu = models[0].logits(positive), models[0].logits(unlabelled)
    else:
        models = [fit(positive[i != k], unlabelled[j != k], INNER_PRIOR, edges) for k in range(folds)]
        zp, zu = np.empty(len(positive)), np.empty(len(unlabelled))
        for k, m in enumerate(models):
            zp[i == k], zu[j == k] = m.logits(positive[i == k]), m.logits(unlabelled[j == k])
    prior = estimate_prior(zp, zu) if prior is None else prior
    return Model(edges, np.mean([m.weights for m in models], axis=0), float(np.mean([m.bias for m in models])), posterior(zp, zu, prior))


def _featured(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents with the ids, at most the ids' documented bound of them, on the driver, in an order that doesn't depend on partitions."""
    schema = "doc_id long, " + ", ".join(f"f{i} double" for i in range(len(NAMES)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], names=["doc_id", *(f"f{i}" for i in range(len(NAMES)))])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, schema)
    columns = [c.to_numpy() for c in rows.toArrow().columns]
    return np.column_stack(columns[1:])[np.lexsort(columns[::-1])]


def _sample(ids: DataFrame, most: int) -> DataFrame:
    return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, prior: float | None = None) -> Model | None:
    """Fit on at most most_positive trusted positives and most_unlabelled unlabelled documents, both by least id hash, learning folds only.

    prior: by default the best-bin estimate. None comes back where there are no positives or no documents.
    """
    known = labels.where(fold(F.col("doc_id")) != 0).where("quality = 1")
    if known.isEmpty():
        return None
    p = _featured(docs, _sample(known, most_positive))
    u = _featured(docs, _sample(docs.where(fold(F.col("doc_id")) != 0), most_unlabelled))
    return learn(p, u, prior) if len(p) and len(u) else None


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs' columns doc_id and text scored: (doc_id, score). Without a model every score is 0.5."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            s = model.score(features(texts)) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores threshold or more, all columns as they are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [(t or "").encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(model.score(features(texts)) >= threshold)) if model and texts else batch

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null texts count as empty and are scored like any text; repeated rows and null ids stay (a null id is not held out).
    Without positives in the learning folds every score is 0.5.
    """
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
