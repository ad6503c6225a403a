"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Weights are whole parts of a frame. Within a frame of H slots, the j-th block (from 0) of a source with q parts may start
at floor(j*H/q) and must end by ceil((j+1)*H/q); in each slot the released block of the earliest deadline goes. This keeps
every source's count within less than one block of its target at every slot, and exactly on target at the end of a frame,
so frames repeat. When a source has less left than its parts, one closing frame takes what is left, and later frames share
out among the other sources by the same parts; every row is scheduled once. A block is one document.

Only per-source counts and frames, bounded by the number of sources, are worked on in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.util import table

PARTS = 1000
RANK_BITS = 12
_NONE = "\x00none"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(x), f), 1)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _phases(n: Column, parts: Column) -> Column:
    """Array of (times, quota array): frames of one quota repeated, in order, until all counts n are used up."""

    def step(s: Column, _: Column) -> Column:
        quota = F.zip_with(s["left"], parts, lambda r, q: F.when(r > 0, q).otherwise(0))

        def framed(q: Column) -> Column:
            whole = F.array_min(F.zip_with(s["left"], q, lambda r, x: F.when(x > 0, F.floor(r / x))))
            return _let(F.coalesce(whole, F.lit(0)), lambda m: F.struct(F.greatest(m, F.lit(1)).cast("long").alias("times"), F.when(m > 0, q).otherwise(F.zip_with(s["left"], q, lambda a, b: F.least(a, b))).alias("quota")))

        return _let(_let(quota, framed), lambda p: F.struct(F.zip_with(s["left"], p["quota"], lambda r, x: r - x * p["times"]).alias("left"), F.concat(s["out"], F.array(p)).alias("out")))

    start = F.struct(n.alias("left"), F.array().cast("array<struct<times:bigint,quota:array<bigint>>>").alias("out"))
    return F.filter(F.aggregate(F.sequence(F.lit(1), 2 * F.size(n)), start, step)["out"], lambda p: _total(p["quota"]) > 0)


def _frame(quota: Column) -> Column:
    """The source index of each slot of a frame, by earliest deadline among released blocks."""
    h = _total(quota)

    def step(s: Column, t: Column) -> Column:
        due = F.zip_with(quota, s["done"], lambda q, k: F.when((k < q) & (F.floor(k * h / q) <= t), F.ceil((k + 1) * h / q)))
        pick = _let(F.array_min(F.filter(F.transform(due, lambda d, i: F.struct(d.alias("d"), i.alias("i"))), lambda x: x["d"].isNotNull())), lambda x: x["i"])
        return _let(pick, lambda p: F.struct(F.transform(s["done"], lambda k, i: k + F.when(i == p, 1).otherwise(0)).alias("done"), F.concat(s["out"], F.array(p)).alias("out")))

    start = F.struct(F.transform(quota, lambda q: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), h - 1), start, step)["out"]


def plan(counts: DataFrame, weights: dict[str, float] | None = None, parts: int = PARTS) -> DataFrame:
    """For counts (source, n): (source, runs), runs being (c0, c1, s0, q, h, slots): its blocks c0 to c1 - 1 go into frames of h slots from slot s0 on, q a frame, into these slots.

    weights: target weights by source, rounded to whole parts (at least one); sources that aren't named get one part. By
    default weights go with the square root of the counts.
    """
    if weights is None:
        w = F.round(parts * F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy(F.lit(0))))
    else:
        total = sum(weights.values()) or 1
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v) * parts / total)]) if weights else None
        w = F.coalesce(F.round(named[F.col("source")]), F.lit(1)) if weights else F.lit(1)
    rows = counts.withColumn("parts", F.greatest(w.cast("long"), F.lit(1)))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("source", "n", "parts"))).alias("s"))
    phases = one.select("s", F.posexplode(_phases(F.col("s.n"), F.col("s.parts"))).alias("p", "x"))
    w = Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    phases = phases.select("s", "p", F.col("x.times").alias("times"), F.col("x.quota").alias("quota"), _total(F.col("x.quota")).alias("h"))
    phases = phases.withColumn("s0", F.coalesce(F.sum(F.col("times") * F.col("h")).over(w), F.lit(0)))
    slots = phases.repartition("p").select("p", "times", "h", "s0", "s", "quota", F.posexplode(_frame(F.col("quota"))).alias("slot", "i"))
    own = slots.groupBy("p", "i").agg(F.sort_array(F.collect_list("slot")).alias("slots"), *[F.first(c).alias(c) for c in ("times", "h", "s0")], F.first(F.col("s")[F.col("i")]["source"]).alias("source"))
    own = own.withColumn("q", F.size("slots").cast("long"))
    w = Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("c0", F.coalesce(F.sum(F.col("times") * F.col("q")).over(w), F.lit(0))).withColumn("c1", F.col("c0") + F.col("times") * F.col("q"))
    return own.groupBy("source").agg(F.collect_list(F.struct("c0", "c1", "s0", "q", "h", "slots")).alias("runs"))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, parts: int = PARTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, block, slot, release, deadline, keep) for every row: read in the order of slot, 0 to rows - 1; keep are further columns of docs.

    Within a source, documents come by a hash of doc_id, then doc_id. A null source is a source of its own. Rows with equal
    ids are blocks of their own; null ids have one hash and so come together. The rank within a source is counted in 4,096
    hash ranges, so a source of any size spreads over tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit(_NONE)).alias("source"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"), *keep)
    rows = rows.withColumn("bin", F.shiftrightunsigned("h", 64 - RANK_BITS).cast("int"))
    bins = rows.groupBy("source", "bin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("source", "bin").orderBy("h", "doc_id", *keep)) - 1)
    ranked = ranked.join(bins.select("source", "bin", before.alias("before")), ["source", "bin"]).select("doc_id", "source", (F.col("before") + F.col("at")).alias("block"), *keep)
    runs = plan(bins.groupBy("source").agg(F.sum("n").alias("n")), weights, parts)
    k = F.col("block") - F.col("r.c0")
    j, base = k % F.col("r.q"), F.col("r.s0") + F.floor(k / F.col("r.q")) * F.col("r.h")
    placed = ranked.join(runs, "source").select("doc_id", "source", "block", *keep, F.element_at(F.filter("runs", lambda r: (r["c0"] <= F.col("block")) & (F.col("block") < r["c1"])), 1).alias("r"))
    return placed.select(
        "doc_id", F.when(F.col("source") != _NONE, F.col("source")).alias("source"), F.col("block").cast("long").alias("block"), (base + F.col("r.slots")[j.cast("int")]).cast("long").alias("slot"),
        (base + F.floor(j * F.col("r.h") / F.col("r.q"))).cast("long").alias("release"), (base + F.ceil((j + 1) * F.col("r.h") / F.col("r.q"))).cast("long").alias("deadline"), *keep,
    )


def op4_mixing(spark, sf_dir):
    return schedule(table(spark, sf_dir, "documents"))
