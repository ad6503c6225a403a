"""All queries of the analytics operators, for Spark and, as SQL text, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.dialect import DuckDB, Spark
from quillspark.plans import tables
from quillspark.plans.bodies import BODIES, PARTS, build


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # a table of fewer partitions than cores (one small file) is dealt over all of them
        cores = spark.sparkContext.defaultParallelism
        few = spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions() < cores
        return spark.sql(build(name, Spark(), sf_dir, f"/*+ REPARTITION({cores}) */" if few else ""))

    return run


QUERIES = {name: _query(name) for name in BODIES if name not in PARTS} | tables.REPLACED | {name: f for name, (f, _) in tables.TABLES.items()}


def oracle() -> dict[str, str]:
    out = {name: build(name, DuckDB()) for name in BODIES if name not in PARTS and name not in tables.TABLES}
    return out | {name: sql for name, (_, sql) in tables.TABLES.items() if sql}
