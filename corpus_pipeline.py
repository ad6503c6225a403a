"""A corpus pipeline over documents: quality, near-duplicates, benchmark passages, secrets, source mixing.

Each stage takes all that its predecessor kept, as a table written and read again. The first four return the columns of
documents; the last returns them with the reading order. A row is known by a 128-bit hash of all its columns, so rows that
share a doc_id, or have none, are judged apart and only rows equal in all columns are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from quillspark.llm import decontaminate, mixing, quality, secrets, simhash
from quillspark.llm.util import materialize, table


def _identified(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two more columns, the row's hash, and their names."""
    names = ["h0", "h1"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    columns = [F.col(f"`{f.name}`") if not isinstance(f.dataType, (MapType, VariantType)) else F.to_json(f"`{f.name}`") for f in docs.schema.fields]
    # nulls add nothing to a hash: where they are is hashed, too
    where = F.concat_ws("", *[F.when(c.isNull(), "0").otherwise("1") for c in columns])
    return docs.withColumns({n: F.xxhash64(F.lit(seed), where, *columns) for seed, n in enumerate(names)}), names


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, scores at its threshold or more."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the document of the least id (a null id comes last, ties go by hash); of equal rows one."""
    rows, names = _identified(docs)
    rows = rows.withColumn(name := names[0] + "_id", F.col("doc_id").cast("long"))
    groups = simhash.grouped(rows, [name, *names])
    kept = groups.where(reduce(lambda a, b: a & b, [F.col(n) == F.col("least")[n] for n in names])).select(*names).distinct()
    return rows.join(kept, names, "left_semi").dropDuplicates(names).select(*[f"`{c}`" for c in docs.columns])


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null texts have none. Each row is judged by its own text."""
    rows, names = _identified(docs)
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), keep=tuple(names))
    return rows.join(found.where("contaminated").select(*names).distinct(), names, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret's span replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with (block, slot, release, deadline): the order in which to read them is that of slot, 0 to rows - 1.

    Null sources are a source of their own; repeated rows and null ids get slots of their own. The order is worked out on ids
    and hashes only, the texts are joined to it once.
    """
    rows, names = _identified(docs)
    twin = names[0] + "_n"  # equal rows are told apart by number
    rows = rows.withColumn(twin, F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0))))
    order = mixing.schedule(rows, keep=(*names, twin)).select(*names, twin, *[F.col(c).alias(f"{c}_{names[0]}") for c in ORDER])
    own = [f"`{c}`" for c in docs.columns if c not in ORDER]
    return rows.join(order, [*names, twin]).select(*own, *[F.col(f"{c}_{names[0]}").alias(c) for c in ORDER])


ORDER = ("block", "slot", "release", "deadline")

STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_passages),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The first stage is a trained model, which SQL can't express; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
