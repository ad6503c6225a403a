"""Readers and sinks: text files, JSON lines, QA pairs, paired arrays, delimited and labelled corpora, resumable appends, reports, traces, asset checks."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HAN = "[^一-鿿]"
CORPUS = "id string, scene string, model string, label string, topic string, text string, content string, genre string, source string, provenance string"


def han(text: str | Column) -> Column:
    return F.length(F.regexp_replace(text, HAN, ""))


def _blank(text: str | Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "") == ""


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of UTF-8 files, one document each; blank files are left out."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~_blank("text"))


def read_stdin(spark: SparkSession) -> DataFrame:
    """(path, text): what standard input holds, as one document; no row where it is blank."""
    rows = spark.createDataFrame([("-", sys.stdin.read())], "path string, text string")
    return rows.where(~_blank("text"))


def read_corpus(spark: SparkSession, path: str, least_han: int = 0, label: str | None = None, least_paragraphs: int = 0) -> DataFrame:
    """JSON lines with text (or content), malformed lines dropped, filtered by Han length, label and paragraphs of 30 Han or more."""
    rows = spark.read.schema(CORPUS).option("mode", "DROPMALFORMED").json(path).withColumn("text", F.coalesce(F.nullif("text", F.lit("")), "content")).drop("content")
    rows = rows.where(F.col("text").isNotNull() & (han("text") >= least_han))
    if label is not None:
        rows = rows.where(F.col("label") == label)
    return rows.where(F.size(F.filter(F.split("text", r"\n\s*\n"), lambda p: han(p) >= 30)) >= least_paragraphs) if least_paragraphs else rows


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a JSON lines file that are no JSON objects; read_corpus drops these."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    return lines.where(F.coalesce(~kind.startswith("OBJECT"), F.lit(True))).select(F.col("value").alias("line"))


def seeded(rows: DataFrame, seed: int, limit: int | None = None, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows in an order by hash of seed and columns (all by default), `limit` of them at most, or of each group."""
    columns = columns or rows.columns
    order = [F.xxhash64(F.lit(seed), *columns), *columns]
    if by is None:
        out = rows.orderBy(*order)
        return out if limit is None else out.limit(limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank_", rank).where(F.col("rank_") <= (limit if limit is not None else sys.maxsize)).drop("rank_")


def read_answers(spark: SparkSession, path: str, least_han: int = 100, seed: int | None = None, limit: int | None = None) -> DataFrame:
    """(question, source, side, text): QA pairs, a row for each human or model answer that is long enough; with a seed, `limit` of each side in a fixed random order."""
    rows = spark.read.schema("question string, human_answers array<string>, chatgpt_answers array<string>, source string").option("mode", "DROPMALFORMED").json(path)
    sides = [rows.select("question", "source", F.lit(side).alias("side"), F.explode(c).alias("text")) for side, c in (("human", "human_answers"), ("model", "chatgpt_answers"))]
    out = sides[0].union(sides[1]).where(han("text") >= least_han)
    return out if seed is None else seeded(out, seed, limit, by=["side"])


def read_pairs(spark: SparkSession, path: str, least_han: int = 200, most: int | None = None, seed: int = 42) -> DataFrame:
    """(human, model) of one JSON array of paired texts, both sides long enough; `most` of them at most, by hash."""
    rows = spark.read.schema("Human_Content string, AI_Content string").json(path, multiLine=True)
    out = rows.toDF("human", "model").where((han("human") >= least_han) & (han("model") >= least_han))
    return out if most is None else seeded(out, seed, most)


def read_labelled(spark: SparkSession, path: str, source: str | None = None, model: str | None = "human") -> DataFrame:
    """(text, label, model, source) of one JSON array with provenance, of one source and model if named."""
    rows = spark.read.schema("text string, label int, model string, source string").json(path, multiLine=True).where("text IS NOT NULL")
    for name, value in (("source", source), ("model", model)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def chunked(raw: DataFrame, size: int = 500, least_han: int = 200) -> DataFrame:
    """raw(text) cut at lines `=== title ===` and into chunks of size characters; chunks with enough Han."""
    parts = raw.select(F.explode(F.split("text", "(?m)^=== .+? ===$")).alias("part"))
    return parts.select(F.explode(F.regexp_extract_all("part", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("chunk")).where(han("chunk") >= least_han)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_new(rows: DataFrame, path: str, key: str = "id") -> None:
    """Append the rows whose key the sink doesn't hold yet, one for each key (the least of equal ones); rows without a key are left out."""
    rows = rows.where(F.col(key).isNotNull())
    if exists(rows.sparkSession, path):
        done = rows.sparkSession.read.schema(rows.select(key).schema).json(path).select(key).distinct()
        rows = rows.join(done, key, "left_anti")
    first = F.min(F.struct(*[F.col(c) for c in rows.columns if c != key])).alias("first")
    rest = [c for c in rows.columns if c != key]
    once = rows.groupBy(key).agg(first).select(key, *[F.col("first")[c].alias(c) for c in rest]) if rest else rows.distinct()
    once.select(*rows.columns).write.mode("append").json(path)


def write_reports(reports: DataFrame, path: str, column: str = "json") -> None:
    """One line a row: the JSON objects of a report, or score lines."""
    reports.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def traced(stages: list[tuple[str, DataFrame]], key: str = "doc_id") -> DataFrame:
    """(key, stages, trace): for texts that went through named stages, each a table (key, text), an entry for each step: stage, characters in and out, input and output."""
    out = stages[0][1].select(key, F.col("text").alias("t0"))
    for i, (_, df) in enumerate(stages[1:], 1):
        out = out.join(df.select(key, F.col("text").alias(f"t{i}")), key)
    step = lambda i, name: F.struct(F.lit(name).alias("stage"), F.length(f"t{i - 1}").alias("in_chars"), F.length(f"t{i}").alias("out_chars"), F.col(f"t{i - 1}").alias("input"), F.col(f"t{i}").alias("output"))
    names = [n for n, _ in stages[1:]]
    return out.select(key, F.array(*map(F.lit, names)).alias("stages"), F.array(*[step(i, n) for i, n in enumerate(names, 1)]).alias("trace"))


def check_assets(spark: SparkSession, assets: dict[str, int]) -> DataFrame:
    """(path, bytes, status) of files that should be there with at least so many bytes: OK, MISSING or SMALL."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for path, least in assets.items():
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        size = fs.getContentSummary(target).getLength() if fs.exists(target) else None
        rows.append((path, size, "MISSING" if size is None else "OK" if size >= least else "SMALL"))
    return spark.createDataFrame(rows, "path string, bytes long, status string")


def job_grid(scenes: DataFrame, models: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(id, scene, topic, model): every topic of every scene (scene, topic) for every model (model), without ids that are done. The models are the small side: their number is a parameter of the run."""
    jobs = scenes.crossJoin(F.broadcast(models)).withColumn("id", F.concat_ws("-", "scene", F.md5("topic"), "model")).select("id", "scene", "topic", "model")
    return jobs if done is None else jobs.join(done.select("id").distinct(), "id", "left_anti")


def matched_grid(controls: DataFrame, models: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(id, control_id, scene, topic, model, chars): a job for each human control (id, scene, topic, text) and model, at the control's length in Han."""
    jobs = controls.select(F.col("id").alias("control_id"), "scene", "topic", han("text").alias("chars")).crossJoin(F.broadcast(models)).withColumn("id", F.concat_ws("-", "control_id", "model"))
    jobs = jobs.select("id", "control_id", "scene", "topic", "model", "chars")
    return jobs if done is None else jobs.join(done.select("id").distinct(), "id", "left_anti")
