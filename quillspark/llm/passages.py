"""Near-duplicate passages by compact windows.

A document is its sequence of five-word shingles. For each of several hash functions, a compact window is a centre and the
range around it in which it is the least hash: every passage within the range that holds the centre has the same min-hash.
These are the nodes of the Cartesian tree over the hashes, of which only those wide enough for a passage of the least length
are wanted, about two for each least length: sliding minima find them, previous and next smaller values among them and the
minima's own bounds give their ranges. Windows with equal centres join; the overlap of their aligned ranges, as far as passages of
the least length reach, is an interval of equal min-hash, and passages whose intervals join under enough hash functions are
verified by their exact Jaccard similarity.

A centre of up to three places is paired with its first and its last one, which makes all pairs. Passages around more crowded centres
join by rare shingles instead: of two passages that are alike enough, one window of the least
length in each shares two thirds of its shingles with the other passage, so one of those is among the window's rarest third and
one more (the prefix filter of similarity joins), whatever the other documents at their centres hold. Shingles of one document are
never shared and come first; a window with too many of them can't be alike to any. Where a rare shingle is crowded, its places are
paired with the first and the last, and each place that isn't verified with the first is then paired with all others: two places
that are both verified with the first are in one class with it.

Of equal texts only the one with the least id goes through all this; the others are linked to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.repeats import _bitmap, _in, _sliding_min
from quillspark.llm.util import _LOWER, _WORD_BYTE, chunks, connected_components, discard, materialize, mix, previous_max, segment_hashes, table, text_bytes

SHINGLE, LEAST, HASHES, ENOUGH, SIMILARITY = 5, 50, 6, 3, 0.8
GAP = 12
CROWDED = 4  # places of a key from which on first and last don't make all pairs
ROUNDS = 2  # at most, of new representatives for open places, before all that are left are paired with all
# shuffle files go as soon as a table is written, not when the driver happens to collect garbage; pairs of texts come in small batches
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}
_CACHED = 1 << 20  # bytes of texts whose distinct shingles are kept
_PIECE, _PART = 1 << 20, 1 << 22  # bytes of texts and shingles of one text that are worked on at once
_POSITION = np.uint64((1 << 24) - 1)


def _written(df: DataFrame, name: str) -> DataFrame:
    """materialize() with the settings above."""
    conf = df.sparkSession.conf
    was = {k: conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            conf.set(k, v)
        return materialize(df, name)
    finally:
        for k, v in was.items():
            conf.unset(k) if v is None else conf.set(k, v)


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of lower-cased words, each one's text index, and its number within the text."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    h, doc = segment_hashes(data, start, end), np.searchsorted(ends, start, side="right")
    n = max(len(h) - width + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    whole = doc[:n] == doc[width - 1 : width - 1 + n]
    out, doc = mix(out[whole]), doc[:n][whole]
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])[:-1]
    return out, doc, np.arange(len(out)) - first[doc]


def _nearest_smaller(v: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The index of the nearest earlier element of the same group with a smaller value, -1 without one: pointers jump until they fit."""
    at = np.where(np.concatenate([[True], group[1:] != group[:-1]])[: len(v)], -1, np.arange(-1, len(v) - 1))
    todo = np.flatnonzero((at >= 0) & (v[at] > v))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] >= 0) & (v[at[todo]] > v[todo])]
    return at


def compact_windows(texts: list[bytes], least: int, hashes: int, bits: tuple[np.ndarray, np.ndarray] | None = None, enough: int = ENOUGH, whole: bool = True) -> tuple[np.ndarray, ...]:
    """For all hash functions: text index, key of the function and the centre, function, centre, first and last shingle of the window.

    Without `whole`, windows end where passages of the least length that hold the centre do. With bitmaps of shared and of
    crowded keys, also all shingles of passages of which at least `enough` centres are shared and one is crowded: the key is
    the shingle, the function -1, the centre and the window's first are its number, the last is a hash of the text.
    """
    out = []
    for p, q in chunks(texts, _PIECE):
        h, doc, at = shingles(texts[p:q])
        if len(h) < least:
            continue
        for lo in range(0, len(h) - least + 1, _PART):  # a text of any length in pieces that overlap by all but one shingle of a passage
            part = slice(lo, lo + _PART + least - 1)
            x, d, a = h[part], doc[part], at[part]
            i = np.arange(len(x) - least + 1)
            ok = d[i] == d[i + least - 1]
            held, hot = np.zeros(int(ok.sum()), dtype=np.int8), np.zeros(int(ok.sum()), dtype=bool)
            if whole:
                starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                begin = np.repeat(starts, np.diff(np.append(starts, len(d))))
                end = np.repeat(np.append(starts[1:], len(d)) - 1, np.diff(np.append(starts, len(d))))
            for k in range(hashes):
                v = mix(x ^ np.uint64((k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
                order = (v & ~_POSITION) | np.arange(len(v), dtype=np.uint64)
                c = (_sliding_min(order, least) & _POSITION).astype(np.int64)[ok]
                s = i[ok]
                if not len(s):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1] + 1)]))
                last = np.append(first[1:], len(s)) - 1
                size = last - first + 1
                c, s0, s1 = c[first], s[first], s[last]
                if bits is not None:
                    held += np.repeat(_in(bits[0], v[c].view(np.int64)), size)
                    hot |= np.repeat(_in(bits[1], v[c].view(np.int64)), size)
                shift = a[c] - c
                if not whole:
                    out.append((d[c] + p, v[c].view(np.int64), np.full(len(c), k), a[c], s0 + shift, s1 + shift + least - 1))
                    continue
                # a window that reaches as far as a passage can goes on to the next smaller node, any other ends where its minima do
                left, right = _nearest_smaller(order[c], d[c]), len(c) - 1 - _nearest_smaller(order[c][::-1], d[c][::-1])[::-1]
                from_, to = np.where(left >= 0, c[left] + 1, begin[c]), np.where(right < len(c), c[np.minimum(right, len(c) - 1)] - 1, end[c])
                s0, s1 = np.where(s0 > c - least + 1, s0, from_), np.where(s1 < c, s1 + least - 1, to)
                out.append((d[c] + p, v[c].view(np.int64), np.full(len(c), k), a[c], s0 + shift, s1 + shift))
            s = i[ok][hot & (held >= enough)]
            if len(s):
                edge = np.zeros(len(x) + 1, dtype=np.int32)
                edge[s] += 1
                edge[s + least] -= 1
                s = np.flatnonzero(np.cumsum(edge[:-1]))
                text, which = np.unique(d[s] + p, return_inverse=True)
                out.append((d[s] + p, x[s].view(np.int64), np.full(len(s), -1), a[s], a[s], np.array([zlib.crc32(texts[t]) for t in text.tolist()], dtype=np.int64)[which]))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64) for i in range(6))


def rarest(text: np.ndarray, at: np.ndarray, key: np.ndarray, n: np.ndarray, least: int, first: int) -> np.ndarray:
    """Which shingles are among the `first` rarest, by n and key, of a window of `least` in their text; numbers that are missing are rarer than any.

    Rows are ordered by text and number.
    """
    order = np.lexsort((key, n))
    rank = np.empty(len(at), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
    # over a longer gap, as between texts, no window is live
    step = np.where(text[1:] == text[:-1], np.minimum(np.diff(at), first + 1), first + 1)
    place = np.concatenate([[0], np.cumsum(step)]) + least - 1
    dense = np.full(place[-1] + least, -1, dtype=np.int64)
    dense[place] = rank
    windows = np.lib.stride_tricks.sliding_window_view(dense, least)
    known = np.concatenate([[0], np.cumsum(dense >= 0)])
    live = np.flatnonzero(known[least:] - known[:-least] > least - first)
    limit = np.full(len(dense), -1, dtype=np.int64)  # of each window, at its last shingle
    for lo in range(0, len(live), 1 << 14):
        some = live[lo : lo + (1 << 14)]
        limit[some + least - 1] = np.partition(windows[some], first - 1, axis=1)[:, first - 1]
    return -_sliding_min(-limit, least)[place] >= rank


def _held(x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted distinct kinds."""
    return kinds[np.minimum(np.searchsorted(kinds, x), len(kinds) - 1)] == x


def verify(x: np.ndarray, y: np.ndarray, least: int, similarity: float, gap: int = GAP, must: np.ndarray | None = None, known: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int, float]]:
    """Parts of two shingle sequences of at least `least` shingles and enough Jaccard similarity: first, last, other first, other last, similarity.

    Shingles without a partner are trimmed off both ends, and a part is compared with each run of its partners in the other
    sequence; where none is alike enough, the part is cut at its longest gap, and so on. With `must`, only parts that hold one of these
    numbers, in a window that shares two thirds of its shingles, are wanted. `known` are the sorted distinct values of x
    and each one's number among them.
    """
    if len(x) == len(y) >= least and (x == y).all():
        return [(0, len(x) - 1, 0, len(y) - 1, 1.0)]
    if not len(x) or not len(y):
        return []
    kinds, number = known or np.unique(x, return_inverse=True)
    at = np.minimum(np.searchsorted(kinds, y), len(kinds) - 1)
    found = np.zeros(len(kinds), dtype=bool)
    found[at[kinds[at] == y]] = True
    shared = found[number]
    hit = np.flatnonzero(shared)
    count = np.concatenate([np.zeros(least, dtype=np.int64), np.cumsum(shared), np.full(least - 1, len(hit))])
    live = count[least:] - count[:-least] >= least - least // 3 - 1  # of each window, by its last shingle
    near = np.concatenate([[0], np.cumsum(live)])
    plain = len(kinds) == len(x)  # any part that is alike enough then has such a window
    if (plain or must is not None) and not near[-1]:
        return []
    if must is not None:
        must = must[must < len(x)]  # rows of one id may be shorter
        must = must[shared[must] & (near[np.minimum(must + least, len(live))] > near[must])]

    def judged(h: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        if h[-1] - h[0] + 1 < least:
            return []
        some = number[h[0] : h[-1] + 1]
        if len(h) < similarity * len(some) if plain else len(np.unique(number[h])) < similarity * len(np.unique(some)):  # no more can be in both
            return []
        a = np.unique(x[h[0] : h[-1] + 1])
        other, found = np.flatnonzero(_held(y, a)), []
        for run in np.split(other, np.flatnonzero(np.diff(other) > gap) + 1):
            if run[-1] - run[0] + 1 >= least and len(run) >= similarity * least:
                b = np.unique(y[run[0] : run[-1] + 1])
                both = int(_held(b, a).sum())
                j = both / (len(a) + len(b) - both)
                if j >= similarity:
                    found.append((int(h[0]), int(h[-1]), int(run[0]), int(run[-1]), j))
        return found

    out, todo = [], [hit]
    while todo:
        part = todo.pop()
        if len(part) < similarity * least or plain and near[part[-1] + 1] == near[part[0] + least - 1] or must is not None and not ((must >= part[0]) & (must <= part[-1])).any():
            continue
        if r := judged(part):
            out += r
        elif (step := np.diff(part)).max(initial=0) > 1:
            cut = int(step.argmax()) + 1
            todo += [part[cut:], part[:cut]]
    return out


def passages(docs: DataFrame, words: int = LEAST, hashes: int = HASHES, enough: int = ENOUGH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, other_id, class_id, first_word, last_word, other_first_word, other_last_word, similarity): verified passages of at least
    `words` words that doc_id shares with other_id; class_id is the least id that links reach.

    Words are runs of letters and digits, A-Z lowered. Each member of a class is paired with its representatives: the first and
    the last place with the same rare shingle, or any that isn't like the first. Passages repeated within one document aren't reported. Null texts count as empty;
    rows of one id count as one document (their passages are all reported); a null id is replaced by a negative hash of the text.
    Documents without shared passages have no row.
    """
    least = words - SHINGLE + 1
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.xxhash64("text")) - 1).alias("d"), text_bytes().alias("bytes"))
    rows, once, held, copies = _once(rows, least)

    def emit(bits):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                batch = _kept(batch, once.value)
                texts = batch.column(1).to_pylist()
                for p in range(0, len(texts), 256):
                    doc, key, k, c, a, b = compact_windows(texts[p : p + 256], least, hashes, bits and bits.value, enough, whole=False)
                    at = np.zeros(0, dtype=np.int64)
                    if bits is not None:
                        use = (k >= 0) & _in(bits.value[0], key) & ~_in(bits.value[1], key)
                        hot = np.flatnonzero(k < 0)
                        hot = hot[np.lexsort((c[hot], key[hot], doc[hot]))]
                        at = np.flatnonzero(np.concatenate([[True], (doc[hot][1:] != doc[hot][:-1]) | (key[hot][1:] != key[hot][:-1])])[: len(hot)])
                        spots, use = c[hot], np.concatenate([np.flatnonzero(use), hot[at]])
                        doc, key, k, c, a, b = (z[use] for z in (doc, key, k, c, a, b))
                    d = batch.column(0).take(pa.array(doc + p))
                    if bits is None:
                        yield pa.RecordBatch.from_arrays([d, pa.array(key)], names=["d", "key"])
                    else:
                        offsets = np.concatenate([np.zeros(len(doc) - len(at), dtype=np.int64), at, [len(spots)]])
                        spots = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(spots.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([d, pa.array(key), *(pa.array(z.astype(np.int32)) for z in (k, c, a, b)), spots], names=["d", "key", "k", "c", "a", "b", "spots"])

        return run

    sc = docs.sparkSession.sparkContext
    keys = rows.mapInArrow(emit(None), "d long, key long").groupBy("key").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.count("*").alias("n")).where("d0 <> d1")
    keys = _written(keys.select("key", (F.col("n") >= CROWDED).alias("crowded")), "centres")
    bits = sc.broadcast((_bitmap(keys.select("key")), _bitmap(keys.where("crowded").select("key"))))
    windows = _written(rows.mapInArrow(emit(bits), "d long, key long, k int, c int, a int, b int, spots array<int>"), "windows")
    # what a window can reach of a passage that has its misses in the middle
    reach = 2 * least - 1
    rares = _rares(windows, least, reach)
    discard(keys)
    places = windows.where("k >= 0").drop("spots").union(rares.select("d", "key", F.lit(-1), "c", F.col("c") - reach, F.col("z") + reach))
    place = F.struct("d", "c", "a", "b")
    # as a table, so that the join below is one of two plain shuffles, whose hot centres adaptive execution splits
    ends = places.groupBy("key").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.count("*").alias("n"), F.min("k").alias("k")).where("p.d <> q.d")
    ends = _written(ends.select("key", F.array("p", "q").alias("ends"), ((F.col("n") >= CROWDED) & (F.col("k") < 0)).alias("rest")), "ends")
    order = ["start", "stop", "estart"]
    w = Window.partitionBy("d", "e").orderBy(*order)

    def candidates(pairs: DataFrame) -> DataFrame:
        """(d, start, stop, e, estart, estop) of places (d, c, a, b) with the other place as o."""
        pairs = pairs.where("d <> o.d").withColumns({"left": F.least(F.expr("c - a"), F.expr("o.c - o.a")), "right": F.least(F.expr("b - c"), F.expr("o.b - o.c"))}).where(F.col("left") + F.col("right") + 1 >= least)
        # a rare shingle's windows need not be as long on both sides
        side = lambda o, name: (F.expr(f"greatest(if(k < 0, {o}a, {o}c - left), 0)").alias(f"{name}start"), F.expr(f"if(k < 0, {o}b, {o}c + right)").alias(f"{name}stop"))
        pairs = pairs.select("d", F.col("o.d").alias("e"), "k", *side("", ""), *side("o.", "e"))
        island = pairs.withColumn("new", F.when(F.col("start") <= previous_max("stop", ["d", "e"], order), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
        near = island.groupBy("d", "e", "island").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, k + 1)"))).alias("n"), F.min("k").alias("k"), *[F.min(c).alias(c) for c in ("start", "estart")], *[F.max(c).alias(c) for c in ("stop", "estop")])
        return _written(near.where((F.col("n") >= enough) | (F.col("k") < 0)).drop("n", "k", "island"), "candidates")

    near = candidates(places.join(ends.select("key", "ends"), "key").withColumn("o", F.explode("ends")))
    cut = _slices(rows, once, near.select("d", "start", "stop").union(near.select("e", "estart", "estop")).distinct())
    checked = _judged(near, cut, least, similarity)
    for t in (windows, near, cut):
        discard(t)
    checked, classes = _rest(rows, once, rares, ends.where("rest").select("key", F.col("ends")[0]["d"].alias("f")), checked, copies, reach, least, similarity)
    for t in (rares, ends, held):
        discard(t)
    checked = checked.union(copies)
    return checked.join(classes.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")), "doc_id").select("doc_id", "other_id", "class_id", "first_word", "last_word", "other_first_word", "other_last_word", "similarity")


def _kept(batch: pa.RecordBatch, copied: np.ndarray) -> pa.RecordBatch:
    """The rows (d, bytes, h, chosen, ..) that aren't of copied texts, or were chosen among those."""
    return batch.filter(pa.array(~_in(copied, batch.column(2).to_numpy()) | batch.column(3).to_numpy(zero_copy_only=False)))


def _once(rows: DataFrame, least: int) -> tuple[DataFrame, Broadcast, DataFrame, DataFrame]:
    """rows (d, bytes, h, chosen) of which _kept() leaves equal texts of several ids only to the least one, a bitmap for it, the scratch
    table that they read from, and the passages of the others: each is paired with the least, the least with the greatest."""
    marked = rows.select("d", "bytes", F.xxhash64("bytes").alias("h"), F.length("bytes").alias("n"))
    groups = _written(marked.groupBy("h", "n").agg(F.min("d").alias("f"), F.max("d").alias("last")).where("f <> last").select("h", "n", "f"), "groups")
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(groups.select(F.col("h").alias("key"))))

    def sized(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = batch.filter(pa.array(_in(bits.value, batch.column(2).to_numpy())))
            for lo in range(0, len(batch), 256):
                some = batch.slice(lo, 256)
                texts = some.column(1).to_pylist()
                size = np.zeros(len(texts), dtype=np.int32)
                for p, q in chunks(texts, _PIECE):
                    size[p:q] = np.bincount(shingles(texts[p:q])[1], minlength=q - p)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(size)], names=["d", "bytes", "h", "n", "size"])

    held = marked.mapInArrow(sized, "d long, bytes binary, h long, n int, size int").join(groups, ["h", "n"], "left")
    held = _written(held.select("d", "f", "size", F.expr("case when f is null or d = f then bytes end").alias("bytes")), "copies")
    pairs = held.where(f"d <> f and size >= {least}").select("d", "f", "size").distinct()
    pairs = pairs.union(pairs.groupBy("f", "size").agg(F.max("d").alias("last")).select("f", "last", "size"))
    first, last = F.lit(0).cast("long"), (F.col("size") + SHINGLE - 2).cast("long")
    columns = [F.col("d").alias("doc_id"), F.col("f").alias("other_id"), first.alias("first_word"), last.alias("last_word"), first.alias("other_first_word"), last.alias("other_last_word"), F.lit(1.0).alias("similarity")]
    copies = _written(pairs.select(*columns), "copies")
    discard(groups)
    return marked.select("d", "bytes", "h", F.lit(False).alias("chosen")).union(held.where("bytes is not null").select("d", "bytes", F.lit(0).cast("long"), F.lit(True))), bits, held, copies


def _rares(windows: DataFrame, least: int, reach: int) -> DataFrame:
    """(d, key, c, z): the rare shingles of the passages whose shingles are in windows, at the first and the last of places within reach of each other."""
    spots = windows.where("k < 0").select("key", "d", F.col("b").alias("t"), "spots")
    common = spots.groupBy("key").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.count("*").alias("n")).where("d0 <> d1").select("key", "n")
    known = spots.join(common.hint("merge"), "key").select("d", "t", "key", "n", "spots").repartition("d").sortWithinPartitions("d", "t")

    def rare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            spots = rows.column(4).combine_chunks()
            at = np.repeat(np.arange(len(rows)), spots.value_lengths().to_numpy())
            c = spots.flatten().to_numpy().astype(np.int64)
            d, t, key, n = (rows.column(i).to_numpy()[at] for i in range(4))
            text = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
            order = np.lexsort((c, text))
            use = order[rarest(text[order], c[order], key[order], n[order], least, least // 3 + 2)]
            use = use[np.lexsort((c[use], key[use], d[use]))]
            d, key, c = d[use], key[use], c[use]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (key[1:] != key[:-1]) | (np.diff(c) > 2 * reach)])[: len(c)])
            last = np.append(first[1:], len(c))[: len(first)] - 1
            return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(key[first]), pa.array(c[first].astype(np.int32)), pa.array(c[last].astype(np.int32))], names=["d", "key", "c", "z"])

        for batch in it:
            d = batch.column(0).to_numpy()
            cut = np.flatnonzero(d != d[-1])
            cut = cut[-1] + 1 if len(cut) else 0  # the last document may go on in the next batch
            if held and not cut and held[-1].column(0)[-1].as_py() != d[0]:
                yield finish()
                held = []
            elif cut:
                held.append(batch.slice(0, cut))
                yield finish()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield finish()

    return _written(known.mapInArrow(rare, "d long, key long, c int, z int"), "rare")


def _classes(checked: DataFrame) -> DataFrame:
    return connected_components(checked.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b")).distinct())


def _rest(rows: DataFrame, once: Broadcast, rares: DataFrame, firsts: DataFrame, checked: DataFrame, copies: DataFrame, reach: int, least: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The verified passages with those of open places, and the classes: places of crowded shingles (key, f: the first one's document)
    that aren't verified with the first.

    They are compared in parts of documents, runs of places within reach of each other, so that a shingle that one document repeats counts
    once. In rounds, as long as they settle most of them, open places that are within no verified passage are paired with two of them; what
    those leave is paired with all others, save that a place within a passage has its row already: only documents of other classes can still change its class.
    """

    def seen(*by: str) -> DataFrame:
        out = checked.select(F.col("doc_id").alias("d"), F.col("other_id").alias("f"), F.col("first_word").alias("lo"), F.col("last_word").alias("hi"))
        out = out.union(checked.select("other_id", "doc_id", "other_first_word", "other_last_word"))
        return out.groupBy(*by).agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).hint("merge")

    outside = F.expr(f"not coalesce(exists(spans, s -> c >= s.lo and z + {SHINGLE - 1} <= s.hi), false)")
    hot = rares.join(firsts.hint("merge"), "key").join(seen("d", "f"), ["d", "f"], "left").select("key", "d", "c", "z", (F.expr("d <> f") & outside).alias("open"))
    hot = _written(hot, "open")
    if hot.where("open").isEmpty():
        return checked, _classes(checked.union(copies))

    def parts(places: DataFrame) -> DataFrame:
        w = Window.partitionBy("d").orderBy("c")
        places = places.withColumn("new", F.when(F.col("c") - previous_max("z", ["d"], ["c"]) <= 2 * reach, 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
        span = places.groupBy("d", "part").agg(F.greatest(F.min("c") - reach, F.lit(0)).alias("start"), (F.max("z") + reach).alias("stop"))
        return places.join(span.hint("merge"), ["d", "part"]).withColumn("x", F.struct("d", "start", "stop")).drop("new", "part", "start", "stop")

    places = _written(parts(hot.join(hot.where("open").select("key").distinct().hint("merge"), "key")), "parts")
    cut = _slices(rows, once, places.select("x.*").distinct())

    def judged(pairs: DataFrame, mine: DataFrame) -> DataFrame:
        pairs = _written(pairs.distinct().select("x.*", F.col("y.d").alias("e"), F.col("y.start").alias("estart"), F.col("y.stop").alias("estop")), "candidates")
        out = _judged(pairs, mine, least, similarity, cut)
        discard(pairs)
        return out

    def bare() -> DataFrame:
        return _written(places.where("open").join(seen("d"), "d", "left").where(outside).select("key", "d", "c", "z", "x"), "bare")

    # a row in each direction is the same pair
    once = (F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    alone = bare()
    alone_n = alone.count()
    for i in range(ROUNDS):
        by = F.struct(F.xxhash64(F.col("x.d"), F.lit(i)), "x")
        heads = alone.groupBy("key").agg(F.array(F.min(by)["x"], F.max(by)["x"]).alias("heads"))
        more = judged(alone.select("key", "x").distinct().join(heads.hint("merge"), "key").withColumn("y", F.explode("heads")).where("x.d <> y.d").select(*once), cut)
        if more.isEmpty():
            break
        checked = _written(checked.union(more).distinct(), "passages")
        discard(alone)
        before, alone = alone_n, bare()
        alone_n = alone.count()
        if 2 * alone_n > before:
            break
    classes = _classes(checked.union(copies))
    held = places.groupBy("key", "x").agg(F.max("open").alias("open")).join(classes.select("node", "component").hint("merge"), F.col("x.d") == F.col("node"), "left")
    held = _written(held.select("key", "x", "open", F.coalesce("component", "x.d").alias("component")), "held")
    theirs = held.select("key", F.col("x").alias("y"), F.col("component").alias("other"))
    # dealt by part first: the parts of a hot shingle would else come from one task, and a skewed join can't split those
    apart = judged(held.where("open").repartition("x").join(theirs.hint("merge"), "key").where("component <> other").select(*once), cut)
    lone = parts(alone.select("key", "d", "c", "z")).join(classes.select("node", "component").hint("merge"), F.col("x.d") == F.col("node"))
    lone = _written(lone.select("key", "x", "c", "z", "component"), "lone")
    must = lone.groupBy("x").agg(F.collect_set(F.expr("shiftleft(cast(c as long), 32) + z")).alias("must")).select("x.*", "must")
    wide = cut.select("d", F.col("start").alias("from"), F.col("stop").alias("to"), F.col("h").alias("whole"))
    narrow = must.join(wide, "d").where("start >= from and stop <= to").select("d", "start", "stop", "must", F.expr("substring(whole, (start - from) * 8 + 1, (stop - start + 1) * 8)").alias("h"))
    narrow = _written(narrow, "slices")
    new = judged(lone.select("key", "x", "component").distinct().repartition("x").join(theirs.hint("merge"), "key").where("x.d <> y.d and component = other").select("x", "y"), narrow)
    new = new.join(alone.select(F.col("d").alias("doc_id"), "c", "z").distinct().hint("merge"), "doc_id").where(F.expr(f"z >= first_word and c + {SHINGLE - 1} <= last_word")).select(*checked.columns)
    # these are within their classes: the least of their partners stands for all
    rest = [c for c in checked.columns if c not in ("doc_id", "first_word", "last_word")]
    new = new.groupBy("doc_id", "first_word", "last_word").agg(F.min(F.struct(*rest)).alias("least")).select("*", "least.*").select(*checked.columns)
    checked = _written(checked.union(apart).union(new).distinct(), "passages")
    if not apart.isEmpty():
        classes = _classes(checked.union(copies))
    for t in (hot, places, cut, alone, held, lone, narrow):
        discard(t)
    return checked, classes


def _slices(rows: DataFrame, once: Broadcast, parts: DataFrame) -> DataFrame:
    """(d, start, stop, h): the shingles of the parts (d, start, stop) of rows (d, bytes, h, chosen)."""
    wanted = parts.groupBy("d").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))
    some = rows.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(F.xxhash64("d").alias("key"))))

    def filtered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = _kept(batch, once.value)
            yield batch.select(["d", "bytes"]).filter(pa.array(_in(some.value, batch.column(4).to_numpy())))

    def sliced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for d, raw, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = shingles([raw])[0]
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(some)), *(pa.array([x[n] for x in some], pa.int32()) for n in ("start", "stop")), pa.array([h[x["start"] : x["stop"] + 1].tobytes() for x in some], pa.binary())], names=["d", "start", "stop", "h"])

    texts = rows.withColumn("at", F.xxhash64("d")).mapInArrow(filtered, "d long, bytes binary")
    return _written(texts.join(wanted, "d").select("d", "bytes", "parts").mapInArrow(sliced, "d long, start int, stop int, h binary"), "slices")


def _judged(near: DataFrame, cut: DataFrame, least: int, similarity: float, theirs: DataFrame | None = None) -> DataFrame:
    """Verified passages of the pairs (d, start, stop, e, estart, estop) of slices; cut may hold the places that passages `must` hold
    one of, as the first and the last number of a shingle in one long."""
    other = (cut if theirs is None else theirs).select(F.col("d").alias("e"), F.col("start").alias("estart"), F.col("stop").alias("estop"), F.col("h").alias("eh"))

    def places(x: np.ndarray, must: np.ndarray, start: int) -> np.ndarray:
        first, last = (must >> 32) - start, (must & (1 << 32) - 1) - start
        many = np.flatnonzero((last > first) & (first < len(x)))
        return np.unique(np.concatenate([first, *(p + np.flatnonzero(x[p : q + 1] == x[p]) for p, q in zip(first[many].tolist(), last[many].tolist(), strict=True))]))

    def judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, bytes], tuple] = {}  # one text meets many others
        size = 0
        for batch in it:
            out = []
            for d, e, a, b, x, y, m in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if not (one := held.get((d, a, x))):
                    if (size := size + len(x)) > _CACHED:
                        held.clear()
                        size = len(x)
                    words = np.frombuffer(x, dtype=np.uint64)
                    one = held[d, a, x] = words, np.unique(words, return_inverse=True), None if m is None else places(words, np.array(m, dtype=np.int64), a)
                for x0, x1, y0, y1, j in verify(one[0], np.frombuffer(y, dtype=np.uint64), least, similarity, must=one[2], known=one[1]):
                    out.append((d, e, a + x0, a + x1 + SHINGLE - 1, b + y0, b + y1 + SHINGLE - 1, j))
            yield pa.RecordBatch.from_arrays([pa.array(list(z), t) for z, t in zip(zip(*out, strict=True) if out else [[]] * 7, [pa.int64()] * 6 + [pa.float64()], strict=True)], names=["doc_id", "other_id", "first_word", "last_word", "other_first_word", "other_last_word", "similarity"])

    checked = near.join(cut, ["d", "start", "stop"]).join(other, ["e", "estart", "estop"]).select("d", "e", "start", "estart", "h", "eh", "must" if "must" in cut.columns else F.lit(None).cast("array<long>").alias("must"))
    kind = "doc_id long, other_id long, first_word long, last_word long, other_first_word long, other_last_word long, similarity double"
    return _written(checked.mapInArrow(judged, kind).distinct(), "passages")


def op1_passages(spark, sf_dir):
    return passages(table(spark, sf_dir, "documents"))
