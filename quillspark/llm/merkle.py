r"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame operations only.

A paragraph is a line; one of over 64 code points is cut into blocks of 64, the line's end staying with its last block.
Leaves are the blocks' SHA-256, sections hash 16 leaves each, and the root hashes the sections. Equal roots mean equal
texts; where roots differ, differing sections and in them differing leaves locate the edit. The likeness of two trees is
the Dice coefficient of their sets of leaves.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.util import table

BLOCK, FAN = 64, 16


def leaves(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{BLOCK}}}\n?|\n"), F.lit(0))


def sections(leaf: Column) -> Column:
    """The hashes of the sections over an array of blocks."""
    last = F.greatest(F.ceil(F.size(leaf) / FAN).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.sha2(F.array_join(F.transform(F.slice(leaf, (i - 1) * FAN + 1, F.lit(FAN)), lambda x: F.sha2(x, 256)), ""), 256))


def root(section: Column) -> Column:
    return F.sha2(F.array_join(section, ""), 256)


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of leaves; two empty trees are alike."""
    n = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def first_difference(a: Column, b: Column) -> Column:
    """The first section (from 0) in which two arrays of section hashes differ; null where they are equal."""
    same = F.arrays_zip(a.alias("a"), b.alias("b"))
    at = F.filter(F.transform(same, lambda x, i: F.when(x["a"].eqNullSafe(x["b"]), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    return F.try_element_at(at, F.lit(1))


def following(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, next): next is the text of the row after, by doc_id then text; after the last comes the first. Null ids come last.

    Ids are dealt into ranges of about equal row counts, and the first document of each range is also put at the end of the
    range before, so no task sees more than its ranges and texts are shuffled once.
    """
    spark = docs.sparkSession
    buckets = buckets or max(2048, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], F.lit(10 * buckets))).first()[0] or []
    split = Bucketizer(splits=[-float("inf"), *sorted({float(c) for c in cuts} or {0.0}), float("inf")], inputCol="x", outputCol="bucket", handleInvalid="keep")
    rows = split.transform(rows.withColumn("x", F.col("doc_id").cast("double"))).drop("x")
    # at most one row for each bucket from here on
    heads = rows.groupBy("bucket").agg(F.min("doc_id").alias("head"))
    w = Window.partitionBy(F.lit(0)).orderBy("bucket")
    heads = heads.select("head", F.col("bucket").alias("own"), F.coalesce(F.lag("bucket").over(w), F.max("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    ghosts = rows.join(F.broadcast(heads), (rows.bucket == heads.own) & rows.doc_id.eqNullSafe(heads["head"])).select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_last(), "text")
    return rows.select("doc_id", "text", "bucket", F.lit(False).alias("ghost")).union(ghosts).withColumn("next", F.lead("text").over(order)).where("not ghost").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_section) for every row.

    The edited text has its last half (rounded down) replaced by the next document's beginning. Null texts count as empty.
    Rows with equal ids follow each other by text; a single document is its own next one.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    t = following(docs).withColumn("n_chars", F.length("text").cast("long"))
    t = t.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half)))
    t = t.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), leaves(F.col("text")).alias("a"), leaves(F.col("edited")).alias("b"), leaves(F.col("next")).alias("c"))
    t = t.withColumns({"sa": sections(F.col("a")), "sb": sections(F.col("b"))})
    return t.select(
        "doc_id", "n_chars", "edited_sha256", root(F.col("sa")).alias("fingerprint"), root(F.col("sb")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), first_difference(F.col("sa"), F.col("sb")).cast("long").alias("edited_section"),
    )


def op2_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def _root_sql(a: str) -> str:
    return f"list_transform(range(0, greatest(1, CAST(ceil(len({a}) / {FAN}) AS BIGINT))), lambda i: sha256(array_to_string(list_transform(list_slice({a}, i * {FAN} + 1, i * {FAN} + {FAN}), lambda x: sha256(x)), '')))"


def _near_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(list_distinct({a}), list_distinct({b}))) / (len(list_distinct({a})) + len(list_distinct({b}))) END"


SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
f AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS nxt FROM t),
e AS (SELECT *, substr(text, 1, n - n // 2) || substr(nxt, 1, n // 2) AS edited FROM f),
l AS (SELECT doc_id, n, sha256(edited) AS edited_sha256, regexp_extract_all(text, '[^\n]{{1,{BLOCK}}}\n?|\n') AS a,
  regexp_extract_all(edited, '[^\n]{{1,{BLOCK}}}\n?|\n') AS b, regexp_extract_all(nxt, '[^\n]{{1,{BLOCK}}}\n?|\n') AS c FROM e),
s AS (SELECT *, {_root_sql("a")} AS sa, {_root_sql("b")} AS sb FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256, sha256(array_to_string(sa, '')) AS fingerprint, sha256(array_to_string(sb, '')) AS edited_fingerprint,
  {_near_sql("a", "b")} AS near_edited, {_near_sql("a", "c")} AS near_next,
  CAST(list_filter(range(0, greatest(len(sa), len(sb))), lambda i: sa[i + 1] IS DISTINCT FROM sb[i + 1])[1] AS BIGINT) AS edited_section
FROM s
"""
