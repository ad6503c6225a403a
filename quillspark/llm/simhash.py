"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at d <= 3 bits are joined without comparing pairs. The 64 bits are cut into three blocks. Each distinct
fingerprint emits, for every block, its other bits and all their one-bit variants (half the radius): 131 rows. Two
fingerprints at d <= 3 always share such a variant in a block that holds one of their differing bits, or, when all three
differences fall in one block, the unchanged other bits. Members of a variant whose block values are equal differ in at
most two bits, those whose values differ in one bit differ in at most three: both are links by construction. So each
variant needs one link per member and per neighbouring block value, never all pairs. The full ball of radius two would be
2,081 rows a fingerprint; the block turns its second half step into a lookup within a variant.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.llm.util import connected_components, materialize, table, text_bytes

SHINGLE, SEED = 3, 42
_BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit and width


def simhash(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 for a text without words."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only \x20 and \x09-\x0D separate
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _batches(at: int, width: int, seed: int):
    """The fingerprint after the first `at` columns, in place of the text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = np.array([simhash(t, width, seed) for t in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.int64())], names=[*batch.schema.names[:at], "fp"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _balls():
    """One literal for each block and flip: the block, its first bit and width, the bits below it and the block's values, the flip."""
    out = []
    for b, (first, width) in enumerate(_BLOCKS):
        for i in [None, *(i for i in range(64) if not first <= i < first + width)]:
            parts = {"b": b, "first": first, "width": width, "low": (1 << first) - 1, "values": (1 << width) - 1, "f": 0 if i is None else _signed(1 << i)}
            out.append(F.struct(*[F.lit(v).cast("int" if k in ("first", "width") else "long").alias(k) for k, v in parts.items()]))
    return F.explode(F.array(*out))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp long, each once) that connect all those within three bits."""
    # the bits below the block, then those above it in the block's place; the block's number on top
    key = "((fp ^ x.f) & x.low) | (shiftrightunsigned(fp ^ x.f, x.width) & ~x.low) | shiftleft(x.b, 60)"
    # dealt out first, by another hash than that of the aggregation before it, which would be kept and read by a few tasks
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # only keys and fingerprints are shuffled; the block's value and whether a variant is the fingerprint's own follow from them
    rows = fps.repartition(n, F.xxhash64("fp")).select("fp", _balls().alias("x")).select("fp", F.expr(key).alias("key")).repartition(n, "key")
    block = F.shiftrightunsigned("key", 60)
    pick = lambda f: F.coalesce(*[F.when(block == b, f(b, first, width)) for b, (first, width) in enumerate(_BLOCKS)])
    plain = lambda b, first, width: F.expr(f"(fp & {(1 << first) - 1}L) | (shiftrightunsigned(fp, {width}) & ~{(1 << first) - 1}L) | shiftleft({b}L, 60)")
    value = lambda b, first, width: F.expr(f"cast(shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L as int)")
    rows = rows.withColumns({"v": pick(value), "own": pick(plain) == F.col("key")})
    w = Window.partitionBy("key")
    shared = rows.withColumns({"mn": F.min("fp").over(w), "mx": F.max("fp").over(w), "v0": F.min("v").over(w), "v1": F.max("v").over(w)}).where("mn <> mx")
    shared = materialize(shared.select("key", "v", "fp", "own", (F.col("v0") != F.col("v1")).alias("spread")), "balls")
    low = shared.groupBy("key", "v").agg(F.min("fp").alias("low"), F.bool_or("spread").alias("spread"))
    member = shared.join(low.select("key", "v", "low"), ["key", "v"]).select(F.col("fp").alias("a"), F.col("low").alias("b"))
    low = low.where("spread").select("key", "v", "low")
    own = shared.where("own and spread").select("key", "v", F.col("fp").alias("low"))

    def variants(df: DataFrame, most: int) -> DataFrame:
        flips = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(22), k)]
        return df.select("key", "v", "low", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select("key", F.col("v").bitwiseXOR(F.col("flip")).alias("v"), F.col("low").alias("other"))

    step = low.join(variants(low, 1), ["key", "v"]).select(F.col("low").alias("a"), F.col("other").alias("b"))
    # three differences within one block: balls of radius 2 and 1 on the block value; only radius-1 members are centres
    centre = variants(own, 1).groupBy("key", "v").agg(F.min("other").alias("low"))
    inside = centre.join(variants(own, 2), ["key", "v"]).select(F.col("low").alias("a"), F.col("other").alias("b"))
    return member.union(step).union(inside).where("a <> b").distinct()


def grouped(docs: DataFrame, ids: list[str], width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(ids, fp, least) for every row: least is the struct of the least ids, nulls last, among the rows reachable over links of at most three bits."""
    fps = docs.select(*ids, text_bytes()).mapInArrow(_batches(len(ids), width, seed), StructType([*docs.select(*ids).schema.fields, StructField("fp", LongType())]))
    fps = materialize(fps, "simhash")
    order = F.struct(*[x for c in ids for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    least = fps.groupBy("fp").agg(F.min(order).alias("least"))
    parts = connected_components(links(least.select("fp")))
    named = parts.join(least, parts.node == least.fp).select("fp", "component", "least")
    first = named.groupBy("component").agg(F.min("least").alias("least"))
    far = named.join(first.withColumnRenamed("least", "far"), "component").select("fp", "far")
    # as a table, so that the join below is one of two plain shuffles, whose hot fingerprints adaptive execution splits
    name = materialize(least.join(far, "fp", "left").select("fp", F.coalesce("far", "least").alias("least")), "names")
    return fps.join(name, "fp").select(*ids, "fp", "least")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links of at most three bits.

    A text without words has fingerprint 0 and is linked like any other. Null texts count as empty; a null doc_id keeps its
    row and never becomes a component_id unless the whole component has none. Repeated rows stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return grouped(rows, ["doc_id"], width, seed).select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def op8_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
