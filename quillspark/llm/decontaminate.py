"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Each benchmark item is cut into windows of consecutive words. A window occurs in a document only if its rarest word, by
count over all documents, does: that word is the prefix that must be joined. A joined position gives the one place where
the window can lie; the place must fit into the document (length and position bounds) and hold exactly the window's words.
Only the benchmark's side is broadcast, in blocks of a fixed number of bytes, so any benchmark fits.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.util import materialize, previous_max, table

WIDTH = 10
BLOCK_BYTES = 8 << 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """A-Z lowered; runs of digits, letters a-z and code points over 127; null has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    lowered = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(lowered, _BREAK), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id string, win array): every window of width words; an item of fewer words, but not none, is one window."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where("size(w) > 0")
    k = F.least(F.size("w"), F.lit(width))
    return w.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - k + 1))).select("item_id", F.slice("w", F.col("i"), k).alias("win")).distinct()


def _block(tokens: DataFrame, wins: DataFrame) -> DataFrame:
    """(rid, start, stop, win_id) of all occurrences of a block of windows (win_id, win), the block being of bounded size."""
    word = F.explode("words").alias("word")
    held = wins.select("win_id", "win", F.posexplode("win").alias("at", "word"))
    counts = tokens.select(word).join(F.broadcast(held.select("word").distinct()), "word").groupBy("word").count()
    rarest = held.join(counts, "word").groupBy("win_id").agg(F.min(F.struct("count", "word", "at")).alias("p"), F.count("*").alias("found"), F.first("win").alias("win"))
    # a window with a word that no document has can't occur
    prefix = rarest.where(F.col("found") == F.size("win")).select("win_id", "win", F.col("p.word").alias("word"), F.col("p.at").alias("at"), F.size("win").alias("k"))
    placed = tokens.select("rid", "words", F.posexplode("words").alias("pos", "word")).join(F.broadcast(prefix), "word")
    fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("k") <= F.size("words"))
    same = F.slice("words", F.when(fits, F.col("pos") - F.col("at") + 1).otherwise(1), F.col("k")) == F.col("win")
    return placed.where(fits & same).select("rid", (F.col("pos") - F.col("at")).alias("start"), (F.col("pos") - F.col("at") + F.col("k")).alias("stop"), "win_id")


def occurrences(tokens: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """All occurrences of the benchmark's windows, and (win_id, item_id)."""
    items = windows(benchmark, width).withColumn("win_id", F.sha2(F.array_join("win", " "), 256))
    items = materialize(items, "windows")
    wins = items.groupBy("win_id").agg(F.first("win").alias("win"))
    size = wins.agg(F.sum(F.octet_length(F.array_join("win", " ")) + 200)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    parts = [wins.where(F.pmod(F.xxhash64("win_id"), F.lit(blocks)) == b) if blocks > 1 else wins for b in range(blocks)]
    return reduce(DataFrame.union, [_block(tokens, p) for p in parts]), items.select("win_id", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, keep), a row for each row of docs; keep are further columns of docs, of other names.

    Null and wordless texts have no words and no hits; wordless items have no windows. Rows with equal or null doc_id are
    judged apart (rid tells them apart). An empty benchmark contaminates nothing.
    """
    tokens = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), words("text").alias("words"), *keep).withColumn("n_words", F.size("words").cast("long")), "words")
    found, items = occurrences(tokens, benchmark, width, block_bytes)
    found = materialize(found, "hits")
    before = F.coalesce(previous_max("stop", ["rid"], ["start", "stop"]), F.lit(0))
    covered = found.select("rid", "start", "stop").distinct().withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", before))).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    named = found.select("rid", "win_id").distinct().join(items, "win_id").groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    hits = covered.join(named, "rid")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return tokens.select("rid", "doc_id", "n_words", *keep).join(hits, "rid", "left").select(
        "rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), *keep,
    )


def op9_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


_W = rf"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH b AS (SELECT item_id, {_W} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS s FROM
  (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_W} AS w FROM documents),
p AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS s FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
m AS (SELECT doc_id, i, p.k AS k, item_id FROM p JOIN win USING (k, s)),
h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
