"""Invisible and look-alike characters: classes, context rules, inspection, cleaning; how much of a text survives in another; a green-list simulator.

Only texts that hold a suspicious character (one regular expression, in the JVM) go to the Arrow function with the context rules.
"""

from __future__ import annotations

import random
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.rowwise import added

# Code points and ranges of each class, in order of precedence where classes overlap.
TAGS = ((0xE0001, 0xE007F),)
RESERVED = ((0x2065, 0x2065), (0xE0000, 0xE0000), (0xFFF0, 0xFFF8), (0xE0080, 0xE00FF), (0xE01F0, 0xE0FFF))
PRIVATE = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
SELECTORS = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
MONGOLIAN = ((0x180B, 0x180F),)
BIDI = ((0x061C, 0x061C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069))
ZERO_WIDTH = ((0x200B, 0x200D), (0x2060, 0x2060), (0xFEFF, 0xFEFF))
OTHER = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x2061, 0x2064), (0x206A, 0x206F), (0x3164, 0x3164), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB))
SPACES = ((0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F))
LOOK_ALIKE = ((0x2E80, 0x2EF3), (0x2F00, 0x2FD5), (0xF900, 0xFAFF), (0x2F800, 0x2FA1D))
IDEOGRAPHS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
EMOJI = ((0x1F000, 0x1FAFF), (0x2190, 0x27BF), (0x2B00, 0x2BFF), (0x203C, 0x203C), (0x2049, 0x2049), (0x2139, 0x2139), (0x2934, 0x2935), (0xA9, 0xA9), (0xAE, 0xAE), (0x2122, 0x2122), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x23, 0x23), (0x2A, 0x2A), (0x30, 0x39))
FLAG, FLAG_END = 0x1F3F4, 0xE007F
CONFUSABLE = dict(zip("АВЕКМНОРСТХаеорсухіΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEKMHOPCTXaeopcyxiABEZHIKMNOPTYX", strict=True))
WIDTHS, HEADLINE = (2, 3, 4, 5, 8), 5
KINDS = ("tag_char", "noncharacter", "reserved", "private_use", "variation", "bidi", "zero_width", "format", "space", "lookalike", "fullwidth", "confusable")
GAMMA, DELTA, CONTEXT, POOL, FEW = 0.25, 2.0, 4, 400, 8


def within(cp: int, ranges: tuple) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def noncharacter(cp: int) -> bool:
    return 0xFDD0 <= cp <= 0xFDEF or cp & 0xFFFE == 0xFFFE


def classify(cp: int) -> str:
    """The class of a code point that is to be stripped."""
    tests = (("tag_char", within(cp, TAGS)), ("noncharacter", noncharacter(cp)), ("reserved", within(cp, RESERVED)), ("private_use", within(cp, PRIVATE)), ("variation", within(cp, SELECTORS + MONGOLIAN)), ("bidi", within(cp, BIDI)), ("zero_width", within(cp, ZERO_WIDTH)))
    return next((name for name, yes in tests if yes), "format")


def kind_column(cp: Column) -> Column:
    """classify as an expression, null for code points that no rule strips by themselves."""
    inside = lambda ranges: T.total([F.when(cp.between(a, b), 1).otherwise(0) for a, b in ranges]) > 0
    rules = (("tag_char", inside(TAGS)), ("noncharacter", cp.between(0xFDD0, 0xFDEF) | (cp.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)), ("reserved", inside(RESERVED)), ("private_use", inside(PRIVATE)), ("variation", inside(SELECTORS + MONGOLIAN)), ("bidi", inside(BIDI)), ("zero_width", inside(ZERO_WIDTH)), ("format", inside(OTHER)), ("space", inside(SPACES)), ("lookalike", cp.isin([ord(c) for c in look_alikes()])))
    return F.coalesce(*[F.when(yes, name) for name, yes in rules])


@cache
def look_alikes() -> dict[str, str]:
    """Characters of the look-alike blocks whose own compatibility form is one unified ideograph."""
    every = (chr(cp) for a, b in LOOK_ALIKE for cp in range(a, b + 1))
    folded = {c: unicodedata.normalize("NFKC", c) for c in every}
    return {c: f for c, f in folded.items() if f != c and len(f) == 1 and within(ord(f), IDEOGRAPHS)}


@cache
def formats() -> frozenset[int]:
    """Everything else of category Cf."""
    return frozenset(cp for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp)) == "Cf")


def _class(ranges: tuple) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


#: the code points that a rule acts on, as a class without its brackets; none is ASCII
ACTED_ON = _class(TAGS + RESERVED + PRIVATE + SELECTORS + MONGOLIAN + BIDI + ZERO_WIDTH + OTHER + SPACES + LOOK_ALIKE + ((0xFDD0, 0xFDEF),)) + "".join(f"\\x{{{p:X}FFFE}}\\x{{{p:X}FFFF}}" for p in range(1, 17)) + "\\x{FFFE}\\x{FFFF}"


def suspicious(t: Column, fullwidth: bool = False, confusables: bool = False) -> Column:
    """Whether any rule could act on the text."""
    more = ("\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}" if fullwidth else "") + ("".join(CONFUSABLE) if confusables else "")
    return t.rlike(f"[{ACTED_ON}{more}\\p{{Cf}}]")


def flag_tags(text: str) -> set[int]:
    """Places inside complete flag sequences: the black flag, tags, the end tag."""
    return {i for m in re.finditer(f"{chr(FLAG)}[{chr(0xE0020)}-{chr(0xE007E)}]+{chr(FLAG_END)}", text) for i in range(m.start() + 1, m.end())}


def carriers(text: str, fullwidth: bool = False, confusables: bool = False, keep_bidi: bool = False) -> list[tuple[int, str, str]]:
    """(place, class, replacement) of every character to strip (replacement is empty) or to replace.

    Kept are variation selectors after ideographs and emoji ones after emoji, joiners between emoji, tags of complete flags.
    """
    out, flags, base = [], flag_tags(text), ""
    for i, c in enumerate(text):
        cp, before, after = ord(c), text[i - 1] if i else "", text[i + 1 : i + 2]
        if within(cp, SELECTORS) and before and (within(ord(before), IDEOGRAPHS) or (cp in (0xFE0E, 0xFE0F) and within(ord(before), EMOJI))):
            continue
        if cp == 0x200D and base and after and within(ord(base), EMOJI) and within(ord(after), EMOJI):
            continue
        if i in flags or (keep_bidi and within(cp, BIDI)):
            base = base if i in flags else c
            continue
        if within(cp, TAGS + RESERVED + PRIVATE + SELECTORS + MONGOLIAN + BIDI + ZERO_WIDTH + OTHER) or noncharacter(cp):
            out.append((i, classify(cp), ""))
        elif within(cp, SPACES):
            out.append((i, "space", base := " "))
        elif c in look_alikes():
            out.append((i, "lookalike", base := look_alikes()[c]))
        elif fullwidth and (0xFF21 <= cp <= 0xFF3A or 0xFF41 <= cp <= 0xFF5A):
            out.append((i, "fullwidth", base := chr(cp - 0xFEE0)))
        elif confusables and c in CONFUSABLE:
            out.append((i, "confusable", base := CONFUSABLE[c]))
        elif cp in formats():
            out.append((i, "format", ""))
        else:
            base = c
    return out


def cleaned(text: str, **options) -> tuple[str, Counter, Counter]:
    """The text without carriers, what was removed and what was replaced, by class."""
    parts, last, removed, replaced = [], 0, Counter(), Counter()
    for i, kind, by in carriers(text, **options):
        parts += [text[last:i], by]
        last = i + 1
        (replaced if by else removed)[kind] += 1
    return "".join(parts) + text[last:], removed, replaced


def _split(docs: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    yes = suspicious(F.col("text"), options.get("fullwidth", False), options.get("confusables", False))
    return d.where(yes), d.where(~yes)


def inspect(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, rnk, codepoint, name, kind, count, offsets, renders_as): the characters that clean would touch, most frequent first; the first eight places of each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: dict[tuple[int, str], list[int]] = {}
                for i, kind, _ in carriers(text, **options):
                    found.setdefault((ord(text[i]), kind), []).append(i)
                for rank, ((cp, kind), at) in enumerate(sorted(found.items(), key=lambda x: (-len(x[1]), x[0][0])), 1):
                    rows.append((doc, rank, f"U+{cp:04X}", unicodedata.name(chr(cp), ""), kind, len(at), at[:8], look_alikes().get(chr(cp), "")))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "rnk", "codepoint", "name", "kind", "count", "offsets", "renders_as"])

    return _split(docs, options)[0].mapInArrow(run, "doc_id long, rnk int, codepoint string, name string, kind string, count int, offsets array<int>, renders_as string")


def clean(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text, removed, replaced) for every row, the last two maps of counts by class. Cleaning twice changes nothing more."""
    kind = "doc_id long, text string, removed map<string,int>, replaced map<string,int>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [cleaned(t, **options) for t in batch.column(1).to_pylist()]
            maps = pa.map_(pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), *(pa.array([list(r[k].items()) for r in rows], maps) for k in (1, 2))], names=["doc_id", "text", "removed", "replaced"])

    yes, no = _split(docs, options)
    none = F.create_map().cast("map<string,int>")
    return yes.mapInArrow(run, kind).union(no.select("doc_id", "text", none.alias("removed"), none.alias("replaced")))


def fold(t: Column) -> Column:
    """Look-alike ideographs as their unified ones."""
    return F.translate(t, "".join(look_alikes()), "".join(look_alikes().values()))


def survived(before: str, after: str, widths: tuple[int, ...]) -> list[int]:
    """For each width in turn the windows before, those of them that are left, and the windows after."""
    b, a = (np.frombuffer("".join(re.split("[ \t\r\n\u3000]+", t)).encode("utf-32-le"), np.uint32) for t in (before, after))
    alphabet, ids = np.unique(np.concatenate([b, a]), return_inverse=True)
    own = used = max(1, len(alphabet).bit_length())
    keys, out = ids.astype(np.int64), {}
    for w in range(1, max(widths) + 1):
        if w > 1 and len(keys):
            if used + own > 63:
                # the windows so far by their ranks, which need fewer bits
                keys, used = np.unique(keys, return_inverse=True)[1], len(keys).bit_length()
            keys, used = (keys[:-1] << own) | ids[w - 1 :], used + own
        if w in widths:
            # windows over the seam of both texts belong to neither
            (kb, nb), (ka, na) = (np.unique(x, return_counts=True) for x in (keys[: max(len(b) - w + 1, 0)], keys[len(b) :]))
            at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
            left = np.minimum(nb, np.where(ka[at] == kb, na[at], 0)).sum() if len(ka) else 0
            out[w] = int(nb.sum()), int(left), int(na.sum())
    return [x for w in widths for x in out[w]]


def kinds(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, n): the characters that a rule strips by themselves, counted by class; only they become rows."""
    rest = T.sub(T.sub(F.coalesce("text", F.lit("")), "[\\x00-\\x7f]+"), f"[^{ACTED_ON}]+")
    rows = docs.select("doc_id", rest.alias("rest")).where("rest <> ''").select("doc_id", F.explode(T.chars(F.col("rest"))).alias("c"))
    return rows.select("doc_id", kind_column(F.expr("ascii(c)")).alias("kind")).where("kind IS NOT NULL").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def survival(pairs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(pair_id, width, total, kept, after_total, survival, z_ratio) of pairs (pair_id, before, after): windows of `width` characters, white space dropped, as multisets.

    Both sides are counted where the pair is, so no window becomes a row. Pairs without any window of a width have a row of zeros.
    """
    kept = ", ".join(f"total{w} long, kept{w} long, after{w} long" for w in widths)
    sides = pairs.select("pair_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after")])
    n = added(sides, ("before", "after"), lambda b, a: survived(b, a, widths), kept, ("before", "after"))
    n = n.select("pair_id", F.inline(F.array(*[F.struct(F.lit(w).alias("width"), F.col(f"total{w}").alias("total"), F.col(f"kept{w}").alias("kept"), F.col(f"after{w}").alias("after_total")) for w in widths])))
    share = F.when(F.col("total") > 0, F.col("kept") / F.col("total")).otherwise(0.0)
    z = F.when((F.col("kept") > 0) & (F.col("after_total") > 0), F.col("kept") / F.sqrt(F.col("total").cast("double") * F.col("after_total"))).otherwise(0.0)
    return n.select("pair_id", "width", "total", "kept", "after_total", F.round(share, 4).alias("survival"), F.round(z, 4).alias("z_ratio"))


def survival_notes(survived: DataFrame, headline: int = HEADLINE) -> DataFrame:
    """(pair_id, note, length): a band of the survival at the headline width; whether the text got shorter or longer by over a twentieth."""
    band = F.when(F.col("survival") >= 0.8, "kept").when(F.col("survival") >= 0.5, "mostly").when(F.col("survival") >= 0.25, "partly").when(F.col("survival") >= 0.1, "little").otherwise("gone")
    both = (F.col("total") > 0) & (F.col("after_total") > 0)
    shift = F.col("after_total") / F.when(F.col("total") > 0, F.col("total"))
    return survived.where(F.col("width") == headline).select("pair_id", band.alias("note"), F.when(both & (shift < 0.95), "shorter").when(both & (shift > 1.05), "longer").otherwise("same").alias("length"))


def passage_survival(items: DataFrame, docs: DataFrame, width: int = 20) -> DataFrame:
    """(item_id, doc_id, kept, total, survival): how many of an item's windows a document holds, for pairs that share any.

    Windows of documents are cut down to those of the items by a semi-join before they are counted.
    """
    skip = lambda c: F.translate(F.coalesce(c, F.lit("")), " \t\r\n　", "")
    own = items.select("item_id", F.explode(T.grams(skip("text"), width)).alias("g")).groupBy("item_id", "g").agg(F.count("*").alias("k"))
    total = own.groupBy("item_id").agg(F.sum("k").alias("total"))
    theirs = docs.select("doc_id", F.explode(T.grams(skip("text"), width)).alias("g")).join(own.select("g").distinct(), "g", "left_semi").groupBy("doc_id", "g").agg(F.count("*").alias("n"))
    kept = own.join(theirs, "g").groupBy("item_id", "doc_id").agg(F.sum(F.least("k", "n")).alias("kept"))
    return kept.join(total, "item_id").select("item_id", "doc_id", "kept", "total", F.round(F.col("kept") / F.col("total"), 4).alias("survival"))


def green(key: bytes, context: str, c: str, gamma: float = GAMMA) -> bool:
    """A keyed hash of the characters before and the candidate puts it on the green list with probability gamma."""
    return int.from_bytes(blake2b(key + (context + c).encode(), digest_size=8).digest()[:4], "big") < int(gamma * (1 << 32))


def simulate(vocabulary: list[tuple[str, int]], follow: dict[str, dict[str, int]], n: int, key: bytes, marked: bool = True, seed: int = 7, gamma: float = GAMMA, delta: float = DELTA) -> str:
    """n characters drawn one after another from follower counts (from the most frequent POOL ones where a character has few), green ones e^delta times as likely if marked."""
    rng, known = random.Random(seed), {c for c, _ in vocabulary}
    pool, weights = zip(*vocabulary[:POOL], strict=True)
    out = rng.choices(pool, weights)
    while len(out) < n:
        options = [(c, k) for c, k in follow.get(out[-1], {}).items() if c in known]
        cs, ws = zip(*options, strict=True) if len(options) >= FEW else (pool, weights)
        context = "".join(out[-CONTEXT:])
        if marked:
            ws = [w * exp(delta) if green(key, context, c, gamma) else w for c, w in zip(cs, ws, strict=True)]
        out += rng.choices(cs, ws)
    return "".join(out)


def detect(text: str, vocabulary: list[tuple[str, int]], key: bytes, gamma: float = GAMMA) -> tuple[float, int]:
    """(z, scored places) of green characters after CONTEXT known ones."""
    known = {c for c, _ in vocabulary}
    body = "".join(c for c in text if c in known)
    n = len(body) - CONTEXT
    if n <= 0:
        return 0.0, 0
    hits = sum(green(key, body[i - CONTEXT : i], body[i], gamma) for i in range(CONTEXT, len(body)))
    return (hits - gamma * n) / sqrt(n * gamma * (1 - gamma)), n


def edited(text: str, vocabulary: list[tuple[str, int]], fraction: float, seed: int = 11) -> str:
    """That fraction of the characters replaced by draws from the vocabulary."""
    rng, out = random.Random(seed), list(text)
    cs, ws = zip(*vocabulary, strict=True)
    for i in rng.sample(range(len(out)), int(len(out) * fraction)):
        out[i] = rng.choices(cs, ws)[0]
    return "".join(out)


def simulations(ids: DataFrame, model: DataFrame, n: int, key: bytes, fractions: tuple[float, ...] = (0.0, 0.2, 0.5), most: int = 3000) -> DataFrame:
    """(sim_id, marked, fraction, z, scored): for each id (sim_id, long) a marked and an unmarked text, edited, and its z. The model's most frequent `most` characters and their followers are collected."""
    from quillspark.operators import ngrams

    one = ngrams.table(model, 1).orderBy(F.col("c").desc(), "g").limit(most)
    vocabulary = [(r.g, r.c) for r in one.collect()]
    two = ngrams.table(model, 2).join(F.broadcast(one.select(F.col("g").alias("a"))), F.left("g", F.lit(1)) == F.col("a")).select("g", "c")
    follow: dict[str, dict[str, int]] = {}
    for r in two.orderBy(F.col("c").desc(), "g").limit(most * POOL).collect():
        follow.setdefault(r.g[0], {})[r.g[1]] = r.c
    held = ids.sparkSession.sparkContext.broadcast((vocabulary, follow))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, follow = held.value
        for batch in it:
            rows = []
            for i in batch.column(0).to_pylist():
                for marked in (True, False) if vocabulary else ():
                    text = simulate(vocabulary, follow, n, key, marked, i)
                    rows += [(i, marked, f, *detect(edited(text, vocabulary, f, i), vocabulary, key)) for f in fractions]
            kinds = (pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["sim_id", "marked", "fraction", "z", "scored"])

    return ids.select(F.col("sim_id").cast("long")).mapInArrow(run, "sim_id long, marked boolean, fraction double, z double, scored long")
