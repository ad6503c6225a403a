"""What the operators of this subpackage share: scratch tables, folds, vectorised word hashing, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.scratch import dealt
from quillspark.functions.session import prepare


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only where it is unset and Spark is local, an own one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: cuts lineage, and lost executors only cost a reread."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a scratch table that no later step reads."""
    _remove(df.sparkSession, df._scratch)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder belongs to the cluster's own clean-up then
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(df) if name == "documents" else df


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5: remainder 0 is held out from learning."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5).cast("int")


def text_bytes(col: str | Column = "text") -> Column:
    """The text's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def _powers(n: int, p: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = p
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd hash base and of its inverse modulo 2**64."""
    if len(_cache.get("p", ())) < n:
        size = max(n, 1 << 16)
        _cache["p"], _cache["i"] = _powers(size, int(_P)), _powers(size, pow(int(_P), -1, 1 << 64))
    return _cache["p"][:n], _cache["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that low bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, from one prefix sum."""
    p, inv = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=s[1:])
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64))


def chunks(texts: list[bytes], limit: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about limit bytes; one longer text makes a run of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if len(texts) > a:
        yield a, len(texts)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters and digits, bytes over 127 included, A-Z lower-cased), and each word's text index."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = _LOWER[data]
    word = _WORD_BYTE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    return segment_hashes(data, start, end), np.searchsorted(ends, start, side="right")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for undirected edges (a, b): the least node that each one reaches.

    Least labels spread over the edges with pointer jumping, one scratch table a round. Edges should be few and star-like;
    joins on hot nodes are plain equi-joins that adaptive execution splits, sums are combined before the shuffle.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        step = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = materialize(step.join(jump, "component", "left").select("node", "old", F.least("component", "root").alias("component")), "labels")
        label = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def previous_max(col: str, keys: list[str], order: list[str]) -> Column:
    """The largest value of col in the rows before this one."""
    return F.max(col).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
