"""Scores over streams: per-document expressions carry over as they are; window counts need an event time and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import detector, hygiene
from quillspark.sources import readers


def letter_share(docs: DataFrame) -> DataFrame:
    """docs, batch or stream, with the share of letters in text; stateless."""
    n = F.length("text")
    return docs.withColumn("letter_share", F.when(n > 0, F.length(F.regexp_replace("text", r"[^\p{L}]", "")) / n).otherwise(0.0))


def window_counts(scored: DataFrame, time: str, least: float, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and rows of at least a letter share of `least` by tumbling event-time window."""
    return scored.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.sum((F.col("letter_share") >= least).cast("long")).alias("over")).select("w.start", "w.end", "n", "over")


def detected(docs: DataFrame, lex: dict | None = None, alphabet: str = "auto") -> DataFrame:
    """(doc_id, rule_part, stat_part, score, level) of docs (doc_id, text), batch or stream: the rules alone, stateless."""
    return detector.scores(detector.rules(docs, lex, alphabet), None, lex)


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed, replaced) without invisible characters, batch or stream; stateless."""
    return hygiene.clean(docs)


def latest(docs: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """docs without rows whose doc_id and text were seen within the watermark: exact repeats of a stream."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc_id", "text"])


def append_scores(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Scores of a stream appended to a JSON sink, each key once, over restarts, too: batches go through the same append as tables do."""
    return detected(docs).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: readers.append_new(rows, path, key)).start()
