"""Removal of repeated byte strings: which bytes lie in a string of `length` bytes that starts elsewhere, too.

A suffix array of every position would shuffle more than eight bytes for each input byte, several times. Here it is sparse
and blocked. Each string of `length` bytes has an anchor, its minimizer: the 50-byte string in it of least hash. Equal strings
have equal anchors at equal offsets, so the blocks are the suffixes that begin with the same anchor, and consecutive starts of
one anchor form a run, about one for 175 bytes. Within a block the suffixes at the anchors are put in suffix order, as are the
reversed texts before them, with the common prefixes of neighbours. From these, the order of the suffixes at every start
follows: at `o` bytes before the anchor, those agree to `length` bytes that share a class of `o` bytes to the left and of the
rest to the right. Among suffixes that agree, ordered by position, the previous smaller position tells that the longest
previous factor reaches `length`: a later copy. Previous and next ones together tell all copies. Bytes are compared, not
hashes. Runs with equal 128-bit digests of all their bytes are one member of the block, and a run whose block
has no other member is repeated as a whole.

A block of more than BLOCK members (a line with many surroundings) is not put in one task: each of its strings is keyed by its
128-bit digest, which deals them out evenly, at a cost in proportion to their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.util import chunks, discard, materialize, mix, previous_max, segment_hashes, table, text_bytes

LENGTH, GRAM = 400, 50
PIECE = 1 << 18
BLOCK = 8192
_BITS = 26
_POSITION = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(texts: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """All runs of the texts: text index, first and last start, key of the anchor and its offset from the first start, digest of the run's bytes and offset."""
    pieces = [(i, a, t[a : a + PIECE + length - 1]) for i, t in enumerate(texts) for a in range(0, max(len(t) - length + 1, 0), PIECE)]
    out: list[tuple] = []
    for p, q in chunks([x[2] for x in pieces], PIECE):
        part = pieces[p:q]
        joined = b"".join(x[2] for x in part)
        data = np.frombuffer(joined, dtype=np.uint8)
        size = np.array([len(x[2]) for x in part])
        stop = np.cumsum(size)
        at = np.arange(len(data) - gram + 1)
        h = segment_hashes(data, at, at + gram)
        least = _sliding_min((h & ~_POSITION) | at.astype(np.uint64), length - gram + 1)
        m = (least & _POSITION).astype(np.int64)
        s = np.arange(len(m))
        own = np.searchsorted(stop, s, side="right")
        ok = s + length <= stop[own]
        s, m, own = s[ok], m[ok], own[ok]
        if not len(s):
            continue
        first = np.concatenate([[True], (m[1:] != m[:-1]) | (own[1:] != own[:-1])])
        a = np.flatnonzero(first)
        b = np.append(a[1:], len(s)) - 1
        start, last, o, k = s[a], s[b], own[a], m[a]
        digest = b"".join([xxhash.xxh3_128_digest(joined[x:y]) for x, y in zip(start.tolist(), (last + length).tolist(), strict=True)])
        digest = np.frombuffer(digest, dtype="<u8").reshape(-1, 2) ^ mix((k - start).astype(np.uint64) + np.uint64(1))[:, None]
        shift = np.array([x[1] for x in part])[o] - (stop - size)[o]
        out.append((np.array([x[0] for x in part])[o], start + shift, last + shift, h[k].view(np.int64), k - start, digest[:, 0].view(np.int64), digest[:, 1].view(np.int64)))
    names = ("text", "start", "last", "key", "offset", "c0", "c1")
    return {n: np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64) for i, n in enumerate(names)}


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each key modulo 2**26: 8 MB, whatever the number of keys. Only a filter: what passes is still joined exactly."""
    bit = F.col("key").bitwiseAND(F.lit((1 << _BITS) - 1))
    rows = keys.groupBy(F.shiftright(bit, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (_BITS - 6), dtype=np.int64)
    out[rows["i"].to_numpy()] = rows["b"].to_numpy()
    return out


def _in(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    k = key & ((1 << _BITS) - 1)
    return (bitmap[k >> 6] >> (k & 63)) & 1 == 1


def _neighbours(group: np.ndarray, sides: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Members in the order of group and bytes, and each one's common prefix with the one before it, -1 where a group begins."""
    order = np.array(sorted(range(len(sides)), key=lambda i: (group[i], sides[i])), dtype=np.int64)
    common = np.full(len(order), -1, dtype=np.int64)
    for lo in range(0, len(order), 1 << 12):
        some = order[max(lo - 1, 0) : lo + (1 << 12)]
        text = np.frombuffer(b"".join([sides[i].ljust(width, b"\0") for i in some.tolist()]), dtype=np.uint8).reshape(-1, width)
        size = np.array([len(sides[i]) for i in some.tolist()])
        unlike = text[1:] != text[:-1]
        agree = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
        agree = np.minimum(agree, np.minimum(size[1:], size[:-1]))
        g = group[some]
        common[max(lo, 1) : lo + (1 << 12)] = np.where(g[1:] == g[:-1], agree, -1)
    return order, common


def block_copies(group: np.ndarray, raw: list[bytes], offset: np.ndarray, length: int, keep_first: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(member, first, last start within it) of the repeated strings; members are ordered by group, then by position."""
    n = len(raw)
    right, left = [x[o:] for x, o in zip(raw, offset.tolist(), strict=True)], [x[:o][::-1] for x, o in zip(raw, offset.tolist(), strict=True)]
    (r, rc), (l, lc) = _neighbours(group, right, length), _neighbours(group, left, length)
    least = offset - (np.array([len(x) for x in raw]) - length)  # the anchor's distance from the last start
    me = np.arange(n)
    every = np.zeros((int(offset.max()) + 2, n), dtype=bool)
    for lo in range(0, len(every) - 1, step := max(1, (1 << 18) // n)):
        o = np.arange(lo, min(lo + step, len(every) - 1))[:, None]
        key = np.empty((len(o), n), dtype=np.int64)
        key[:, r] = np.cumsum(rc[None, :] < length - o, axis=1) - 1
        key *= n
        part = np.empty_like(key)
        part[:, l] = np.cumsum(lc[None, :] < o, axis=1) - 1
        key = np.where((o <= offset) & (o >= least), key + part, n * n + me) * n + me
        key.sort(axis=1)  # suffixes that agree, by position
        who, same = key % n, key[:, 1:] // n == key[:, :-1] // n
        row = np.broadcast_to(o, who.shape)
        every[row[:, 1:][same], who[:, 1:][same]] = True
        if not keep_first:
            every[row[:, :-1][same], who[:, :-1][same]] = True
    edge = np.diff(every.T.astype(np.int8), axis=1, prepend=0)
    member, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    yield member, offset[member] - (end - 1), offset[member] - begin


def _compared(length: int, keep_first: bool):
    """Rows sorted by key and position -> spans; only whole blocks are worked on, several small ones at once."""
    names = ("key", "d", "t", "start", "offset")

    def finish(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        key, d, h, start, offset = (t.column(n).to_numpy() for n in names)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (start[1:] != start[:-1])])
        size = np.bincount(np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])), weights=new)
        new &= np.repeat(size > 1, np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))))
        use = np.flatnonzero(new)
        if not len(use):
            return
        raw = t.column("bytes").take(pa.array(use)).to_pylist()
        group = np.cumsum(np.concatenate([[0], key[use][1:] != key[use][:-1]]))
        for member, a, b in block_copies(group, raw, offset[use].astype(np.int64), length, keep_first):
            i = use[member]
            yield pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(h[i]), pa.array(start[i] + a), pa.array(start[i] + b + length)], names=["d", "t", "start", "stop"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in it:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                key = batch.column(0).to_numpy()
                cut = np.flatnonzero(key != key[-1])
                cut = cut[-1] + 1 if len(cut) else 0  # the last block may go on in the next batch
                if held and (cut or key[0] != held[-1].column(0)[-1].as_py()):
                    yield from finish([*held, batch.slice(0, cut)])
                    held = []
                elif cut:
                    yield from finish([batch.slice(0, cut)])
                held.append(batch.slice(cut))
        if held:
            yield from finish(held)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(d, t, start, stop): byte spans, not yet merged, of strings of `length` bytes that occur elsewhere in docs (d, t, bytes), or, with keep_first, earlier.

    Order is by d, t (id and hash of the text) and position. Two rows equal in d and t count as two documents when all copies
    go, and as one place when the first is kept.
    """
    names = ("start", "last", "key", "offset", "c0", "c1")

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            r = runs(batch.column(2).to_pylist(), length, gram)
            text = pa.array(r["text"])
            kind = {"start": pa.int32(), "last": pa.int32(), "offset": pa.int32()}
            yield pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(1).take(text), *(pa.array(r[n], kind.get(n, pa.int64())) for n in names)], names=["d", "t", *names])

    found = materialize(docs.mapInArrow(emit, "d long, t long, start int, last int, key long, offset int, c0 long, c1 long"), "runs")
    keys = found.groupBy("key").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("c0", "c1")]).where("n > 1")
    keys = materialize(keys.select("key", F.expr("min_c0 <> max_c0 OR min_c1 <> max_c1").alias("several")), "anchors")
    # two plain shuffles, whose hot keys adaptive execution splits
    shared = materialize(found.join(keys.hint("merge"), "key"), "shared")
    discard(found)
    alike, several = shared.where("not several"), shared.where("several")
    if keep_first:
        one = alike.groupBy("key").agg(F.min(F.struct("d", "t", "start")).alias("one"))
        alike = alike.join(one.hint("merge"), "key").where(F.struct("d", "t", "start") != F.col("one"))
    contexts = several.groupBy("key", "c0", "c1").agg(F.count("*").alias("copies"), F.min(F.struct("d", "t", "start", "last", "offset")).alias("one"))
    contexts = materialize(contexts, "contexts")
    # dealt by document first: rows of a hot context would else come from one task, and a skewed join can't split those
    again = several.select("key", "c0", "c1", "d", "t", "start", "last").repartition("d", "t").join(contexts.where("copies > 1").select("key", "c0", "c1", "one").hint("merge"), ["key", "c0", "c1"])
    if keep_first:
        again = again.where(F.struct("d", "t", "start") != F.struct("one.d", "one.t", "one.start"))
    large = materialize(contexts.groupBy("key").count().where(F.col("count") > block).select("key", F.lit(True).alias("large")), "large")
    members = contexts.select("key", "one.*").join(large, "key", "left").select("key", "d", "t", "start", "last", "offset", F.coalesce("large", F.lit(False)).alias("large"))
    wanted = materialize(members.groupBy("d", "t").agg(F.collect_list(F.struct("key", "start", "last", "offset", "large")).alias("parts")), "members")
    texts = held_back(docs, wanted).join(wanted, ["d", "t"]).select("d", "t", "bytes", "parts")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for d, t, raw, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                parts = [x for x in parts if not x["large"]]
                for i in range(0, len(parts), 1024):
                    some = parts[i : i + 1024]
                    size = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([x["key"] for x in some], pa.int64()), pa.array([d] * size, pa.int64()), pa.array([t] * size, pa.int64()), *(pa.array([x[n] for x in some], pa.int32()) for n in ("start", "offset")), pa.array([raw[x["start"] : x["last"] + length] for x in some], pa.binary())], names=["key", "d", "t", "start", "offset", "bytes"])

    def strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for d, t, raw, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for x in parts:
                    if x["large"]:
                        at = list(range(x["start"], x["last"] + 1))
                        h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a : a + length]) for a in at]), dtype="<i8").reshape(-1, 2)
                        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([d] * len(at), pa.int64()), pa.array([t] * len(at), pa.int64()), pa.array(at, pa.int32())], names=["h0", "h1", "d", "t", "start"])

    order = ["key", "d", "t", "start"]
    compared = texts.mapInArrow(cut, "key long, d long, t long, start int, offset int, bytes binary").repartition("key").sortWithinPartitions(*order)
    parts = [alike, again, compared.mapInArrow(_compared(length, keep_first), "d long, t long, start long, stop long")]
    if not large.isEmpty():
        every = materialize(texts.mapInArrow(strings, "h0 long, h1 long, d long, t long, start int").distinct(), "strings")
        twice = every.groupBy("h0", "h1").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "start")).alias("one")).where("n > 1")
        hit = every.join(twice.hint("merge"), ["h0", "h1"])
        parts.append((hit.where(F.struct("d", "t", "start") != F.col("one")) if keep_first else hit).withColumn("last", F.col("start")))
    start, stop = F.col("start").cast("long").alias("start"), (F.col("last") + length).cast("long").alias("stop")
    out = [p.select("d", "t", start, stop if "last" in p.columns else "stop") for p in parts]
    for p in out[1:]:
        out[0] = out[0].union(p)
    return out[0]


def held_back(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs' rows that may be in wanted (d, t): only a filter before a join."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(F.xxhash64("d", "t").alias("key"))))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.drop_columns(["at"]).filter(pa.array(_in(bits.value, batch.column(batch.schema.get_field_index("at")).to_numpy())))

    return docs.withColumn("at", F.xxhash64("d", "t")).mapInArrow(run, docs.schema)


def merged(spans: DataFrame) -> DataFrame:
    """(d, t, spans array of (start, stop)): overlapping and touching spans joined."""
    spans = spans.distinct()
    new = F.when(F.col("start") <= previous_max("stop", ["d", "t"], ["start", "stop"]), 0).otherwise(1)
    w = Window.partitionBy("d", "t").orderBy("start", "stop")
    islands = spans.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy("d", "t", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return islands.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, block: int = BLOCK) -> DataFrame:
    """(doc_id, bytes, spans) for every row of docs: its bytes and the merged byte spans (start, stop) to remove, null where there are none.

    Null texts count as empty; texts under `length` bytes never change. Rows with equal ids are told apart by their texts;
    rows equal in both are copies of each other, and all of them get the same spans (with keep_first, all stay or go as the
    first does). Removed spans may cut characters of several bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("bytes").alias("t"), "bytes")
    spans = repeated_spans(rows.where(F.octet_length("bytes") >= length).select("d", "t", "bytes"), length, keep_first, block=block)
    return rows.join(merged(spans).hint("shuffle_hash"), ["d", "t"], "left").select("doc_id", "bytes", "spans")


def _digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        size, removed, count, digest = [], [], [], []
        for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            h, at = hashlib.sha256(), 0
            for x in spans or ():
                h.update(raw[at : x["start"]])
                at = x["stop"]
            h.update(raw[at:])
            size.append(len(raw))
            removed.append(sum(x["stop"] - x["start"] for x in spans or ()))
            count.append(len(spans or ()))
            digest.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op6_repeats(spark, sf_dir):
    return repeats(table(spark, sf_dir, "documents")).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
