"""Guards of an edit, the rhythm of sentences, guarded edits, defects, and the small text primitives that they need.

Column functions where the rule is an expression; where it walks a text or searches for the best edit, a Python function on one
text and its Arrow form over a table.
"""

from __future__ import annotations

import difflib
import random
import re
import statistics
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from quillspark.functions import text as T
from quillspark.operators import scoring
from quillspark.sources import lexicons

# Token patterns, bands, rhythm targets, boundaries, quote pairs, defect patterns.
NUMBER, LATIN = r"\d+(?:[.,]\d+)*%?", r"[A-Za-z][A-Za-z0-9./-]{1,}"
SLACK, FLOOR, MOST_FILLER, SCOPE = 1.3, 0.55, 0.5, 0.78
SHORT, CV_TARGET, SHORT_TARGET, MOST_EDITS = 10, 0.40, 0.08, 6
ENDS = "。！？…"
QUOTES, CLOSERS = "「『（(“", "」』）)”"
PAIRS, PAIR_CLOSERS = "「『（(《〈“‘", "」』）)》〉”’"
BOUNDARY = "。！？；：\n，、 \t"
LEAST_PATTERN = 4
DEFECTS = (
    "地地", "的的", "是是", "的地", "可以地", "有办法地", "有效地能", "跟进着", "留着神", "在[一-鿿]{1,4}左右下", "案[察觉识看][觉破察出]场", "阵地地位", "至关关键", "最最要紧", "到到头来", "在在", "市场场景", "可以以",
)
EMOJI = "\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2702}-\\x{27B0}\\x{24C2}\\x{1F100}-\\x{1F251}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{FE00}-\\x{FE0F}\\x{200D}\\x{2B50}\\x{2764}"
# The enclosed characters are taken as U+24C2 and U+1F100 to U+1F251: one range from the first to the last would hold all Han characters.
HAN = re.compile("[一-鿿]")


# text primitives


def numbers(t: Column) -> Column:
    """Sorted numeric tokens, commas taken out."""
    return F.array_sort(F.transform(F.regexp_extract_all(t, F.lit("(?U)" + NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def latin(t: Column) -> Column:
    """Sorted Latin tokens in capitals."""
    return F.array_sort(F.transform(F.regexp_extract_all(t, F.lit(LATIN), F.lit(0)), F.upper))


def lost(before: Column, after: Column) -> Column:
    """Distinct tokens that occur less often after than before, sorted: one pass over both bags' sorted tokens."""
    side = lambda a, n: F.transform(a, lambda x: F.struct(x.alias("x"), F.lit(n).alias("n")))
    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    out = lambda s: F.when(s["n"] > 0, F.array_append(s["out"], s["x"])).otherwise(s["out"])

    def step(s: Column, y: Column) -> Column:
        same = F.struct(s["x"].alias("x"), (s["n"] + y["n"]).alias("n"), s["out"].alias("out"))
        return F.when(s["x"] == y["x"], same).otherwise(F.struct(y["x"].alias("x"), y["n"].alias("n"), out(s).alias("out")))

    return F.aggregate(F.array_sort(F.concat(side(before, 1), side(after, -1))), start, step, out)


def filler_ratio(t: Column, lex: dict | None = None) -> Column:
    """The share of Han characters inside template phrases, a half at most."""
    every = T.matches(t, "|".join((lex or lexicons.load())["guard_fillers"]))
    hit = T.size(F.array_join(every, ""))
    return F.when(T.size(t) > 0, F.least(F.lit(MOST_FILLER), hit / T.size(t))).otherwise(0.0)


def normalize(t: Column) -> Column:
    """Half-width marks between Han characters, and commas and stops at their line ends, as full-width ones; no space before full-width marks; at most one blank line in a row; stripped."""
    cjk = "[一-鿿]"
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for a, b in (*zip(",;:!?", "，；：！？", strict=True), (".", "。")):
        t = T.sub(t, f"(?<={cjk})[{a}](?={cjk})", b)
    for a, b in ((",", "，"), (".", "。")):
        t = T.sub(t, f"(?m)(?<={cjk})[{a}][{T.SPACE}]*$", b)
    t = T.sub(t, f"[{T.SPACE}]+(?=[，。；：！？、」』）])")
    return T.strip(T.sub(t, "\n{3,}", "\n\n"))


def punct_profile(t: Column) -> Column:
    """Struct of half- and full-width commas, stops after Han characters and full-width stops, Han characters."""
    return F.struct(T.occurrences(t, ",").alias("half_comma"), T.occurrences(t, "，").alias("full_comma"), F.regexp_count(t, F.lit(r"(?<=[一-鿿])[.]")).alias("half_stop"), T.occurrences(t, "。").alias("full_stop"), T.size(t).alias("han_n"))


def strip_markdown(t: Column) -> Column:
    """Heading signs, bold and underline marks and rules taken off, line by line; at most one blank line in a row; stripped."""
    line = lambda s: F.replace(F.replace(F.when(F.startswith(s, F.lit("#")), T.strip(T.sub(s, "^#+"))).otherwise(s), F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    lines = F.transform(F.split(t, "\n", -1), lambda s: line(T.strip(s)))
    rule = lambda s: F.startswith(s, F.lit("---")) & (F.size(F.array_distinct(T.chars(s))) <= 2)
    return T.strip(T.sub(F.array_join(F.filter(lines, lambda s: ~rule(s)), "\n"), "\n{3,}", "\n\n"))


def strip_emoji(t: Column) -> Column:
    return T.sub(t, f"[{EMOJI}]+")


def structural(p: Column, sections: bool = True) -> Column:
    """Whether a paragraph is a heading, bullet, bold-only line, numbered item or dialogue line; with sections also Chinese section numbers."""
    s = T.sub(p, f"^[{T.SPACE}]+")
    own = s.rlike(r"^(#|- |\* |[0-9]+[.。．)）]|[\"“「])") | (F.startswith(s, F.lit("**")) & T.sub(s, f"[{T.SPACE}]+$").rlike(r"\*\*$"))
    return own | s.rlike(r"^[一二三四五六七八九十]+[、,，]|^[（(][一二三四五六七八九十]+[）)]") if sections else own


def dialogue_density(t: Column) -> Column:
    """The share of characters in quoted passages: curly and corner quotes of three characters or more, and every second part between straight quotes."""
    quoted = F.length(F.array_join(F.concat(T.matches(t, "“[^“”]{3,}?”", True), T.matches(t, "「[^「」]{3,}?」", True)), ""))
    parts = F.split(t, '"', -1)
    straight = F.filter(parts, lambda x, i: (i % 2 == 1) & (F.length(x) >= 3))
    return (quoted + F.when(F.size(parts) >= 3, F.length(F.array_join(straight, ""))).otherwise(0)) / F.greatest(F.lit(1), F.length(t))


def strip_punctuation(t: Column, lex: dict | None = None) -> Column:
    return F.translate(t, (lex or lexicons.load())["rhythm_punctuation"], "")


def same_but_punctuation(before: Column, after: Column) -> Column:
    """Whether two texts differ in punctuation and white space only."""
    return strip_punctuation(before) == strip_punctuation(after)


def depths(text: str, opening: str = QUOTES, closing: str = CLOSERS, straight: bool = False) -> list[int]:
    """Nesting depth after each character; closers stop at 0, and with straight a plain double quote opens and closes in turn."""
    plain = accumulate((c == '"' for c in text), initial=0)
    next(plain)

    def step(depth: int, x: tuple[str, int]) -> int:
        c, seen = x
        if straight and c == '"':
            return max(depth + (1 if seen % 2 else -1), 0)
        return depth + 1 if c in opening else max(depth - 1, 0) if c in closing else depth

    return list(accumulate(zip(text, plain, strict=True), step, initial=0))[1:]


def quote_depths(docs: DataFrame, opening: str = QUOTES, closing: str = CLOSERS, straight: bool = False) -> DataFrame:
    """(doc_id, depths): depths of each text, an array of ints."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [depths(t or "", opening, closing, straight) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "depths"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, depths array<int>")


def similarity(before: str, after: str) -> float:
    return difflib.SequenceMatcher(None, before, after).ratio()


# the guard


def problems(before: Column, after: Column, least: float = 0.75, most: float = 1.25, same_paragraphs: bool = True, lex: dict | None = None) -> Column:
    """Array of what an edit broke: lost_numbers, lost_latin, no_han, too_short, too_long, paragraphs, preamble.

    The length band is on Han characters; template phrases in the original lower its floor by SLACK times their share, to FLOOR at least.
    """
    lex = lex or lexicons.load()
    had, has = T.size(before), T.size(after)
    ratio = has / F.when(had > 0, had)
    floor = F.greatest(least - filler_ratio(before, lex) * SLACK, F.lit(FLOOR))
    blocks = lambda t: F.size(F.filter(F.transform(F.split(T.strip(t), "\n[\\s\\x{3000}]*\n", -1), T.strip), lambda p: p != ""))
    # an edit that changed nothing broke none of this
    broke = lambda c: F.when(before == after, False).otherwise(c)
    checks = [("lost_numbers", broke(F.size(lost(numbers(before), numbers(after))) > 0)), ("lost_latin", broke(F.size(lost(latin(before), latin(after))) > 0)), ("no_han", had == 0), ("too_short", ratio < floor), ("too_long", ratio > most), ("preamble", after.rlike("(?U)" + lex["preamble"]))]
    if same_paragraphs:
        checks.insert(5, ("paragraphs", broke(blocks(before) != blocks(after))))
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks]))


def guarded(rows: DataFrame, before: str = "before", after: str = "after", **band) -> DataFrame:
    """rows with problems, and result: the edit where there are none, the original else."""
    return rows.withColumn("problems", problems(F.col(before), F.col(after), **band)).withColumn("result", F.when(F.size("problems") == 0, F.col(after)).otherwise(F.col(before)))


def _problems_of(before: str, after: str, least: float, most: float, lex: dict) -> list[str]:
    """problems for two Python strings, for edits that are judged while they are made."""
    size = lambda s: len(HAN.findall(s))
    out = []
    for name, pattern, norm in (("lost_numbers", NUMBER, lambda x: x.replace(",", "")), ("lost_latin", LATIN, str.upper)):
        a, b = ([norm(x) for x in re.findall(pattern, s)] for s in (before, after))
        if any(b.count(x) < a.count(x) for x in set(a)):
            out.append(name)
    if not size(before):
        out.append("no_han")
    else:
        filler = min(size("".join(m[0] for m in re.finditer("|".join(lex["guard_fillers"]), before))) / size(before), MOST_FILLER)
        ratio = size(after) / size(before)
        out += ["too_short"] * (ratio < max(least - filler * SLACK, FLOOR)) + ["too_long"] * (ratio > most)
    blocks = lambda s: len([p for p in re.split(r"\n\s*\n", s.strip()) if p.strip()])
    out += ["paragraphs"] * (blocks(before) != blocks(after)) + ["preamble"] * bool(re.search(lex["preamble"], after))
    return out


def defects(before: Column, after: Column, patterns: tuple[str, ...] = DEFECTS) -> Column:
    """How many more matches of the defect patterns there are after than before, patterns that got rarer left out."""
    n = lambda t, p: F.regexp_count(t, F.lit(p))
    return T.total([F.greatest(F.lit(0), n(after, p) - n(before, p)) for p in patterns])


def in_sentence_repeats(docs: DataFrame, lex: dict | None = None, gap: int = 20) -> DataFrame:
    """(doc_id, idx, g, n, gap): Han bigrams that a sentence of ten characters or more holds twice at most `gap` apart, with their places and least distance; common bigrams and sentences with a rightful repetition are left out."""
    lex = lex or lexicons.load()
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "[。！？!?\n]+", -1), T.strip), lambda s: F.length(s) >= 10)
    s = docs.select("doc_id", F.posexplode(parts).alias("idx", "s")).where(~F.col("s").rlike("|".join(f"(?:{p})" for p in lex["legit_repeats"])))
    g = s.select("doc_id", "idx", F.posexplode(T.grams(F.col("s"), 2)).alias("pos", "g")).where(F.col("g").rlike("^[一-鿿]{2}$") & ~F.col("g").isin(lex["common_bigrams"]))
    g = g.withColumn("d", F.col("pos") - F.lag("pos").over(Window.partitionBy("doc_id", "idx", "g").orderBy("pos")))
    return g.groupBy("doc_id", "idx", "g").agg(F.count("*").alias("n"), F.min("d").alias("gap")).where(F.col("gap") <= gap)


# rhythm


def walked_sentences(paragraph: str) -> list[str]:
    """Sentences with their end marks, each of which ends one; a rest counts unless blank."""
    parts = re.findall(f"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+$", paragraph)
    return parts if not parts or parts[-1].strip() else parts[:-1]


def _sizes(text: str) -> list[int]:
    return [n for p in re.split(r"\n\s*\n", text) for s in walked_sentences(p) if (n := len(HAN.findall(s)))]


def rhythm(docs: DataFrame, alphabet: str = "han") -> DataFrame:
    """(doc_id, n, cv, short_frac, mean_len) over sentences that hold counted characters; zeros with fewer than two."""
    t = F.coalesce("text", F.lit(""))
    ends = lambda p: T.by_alphabet(p, alphabet, T.matches(p, f"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+", True), T.matches(p, f"[^.!?{ENDS}]*[.!?{ENDS}]|[^.!?{ENDS}]+", True))
    every = F.flatten(F.transform(F.split(t, "\n[\\s]*\n", -1), ends))
    d = docs.select("doc_id", F.filter(F.transform(every, lambda s: T.size(s, alphabet)), lambda n: n > 0).alias("a"))
    some = F.size("a") >= 2
    zero = lambda c: F.when(some, c).otherwise(0.0)
    return d.select("doc_id", F.size("a").alias("n"), zero(T.spread(F.col("a"))).alias("cv"), zero(F.size(F.filter("a", lambda n: n < SHORT)) / F.size("a")).alias("short_frac"), zero(T.mean(F.col("a"))).alias("mean_len"))


def shortfall(text: str) -> float:
    """How far the rhythm falls short of both targets, as shares of them."""
    sizes = _sizes(text)
    cv = statistics.pstdev(sizes) / statistics.mean(sizes) if len(sizes) >= 2 else 0.0
    short = sum(n < SHORT for n in sizes) / len(sizes) if len(sizes) >= 2 else 0.0
    return max(0.0, 1 - cv / CV_TARGET) + max(0.0, 1 - short / SHORT_TARGET)


def split_places(sentence: str, lex: dict) -> list[int]:
    """Commas and semicolons outside quotes and brackets that may become full stops: not between digits, enough text on both sides, no subordinate or dependent clause before, and after a comma a connective that begins sentences."""
    level = depths(sentence, PAIRS, PAIR_CLOSERS, straight=True)
    size = lambda s: len(HAN.findall(s))
    begins = lambda s, heads: s.startswith(tuple(heads))
    out = []
    for m in re.finditer("[，；]", sentence):
        i = m.start()
        before, after = sentence[:i], sentence[i + 1 :].lstrip()
        digits = before[-1:].isdigit() and sentence[i + 1 : i + 2].isdigit()
        if level[i] or digits or size(before) < 8 or size(after.rstrip(ENDS + "，；")) < 6:
            continue
        clause = re.sub(r"^[^，。；：、！？]{1,6}[：:]\s*", "", re.split("[，；]", before)[-1].lstrip()).lstrip()
        dependent = begins(clause, lex["subordinators"]) or begins(clause, lex["dependent_heads"]) or (begins(before.lstrip(), lex["subordinators"]) and "，" not in before)
        if not dependent and (m[0] == "；" or begins(after, lex["sentence_initial"])):
            out.append(i)
    return out


def merge_places(sentences: list[str]) -> list[int]:
    """Places of sentences that end in a full stop and may be joined to the next: 45 characters together, 4 each at least, fewer than three commas."""
    size = lambda s: len(HAN.findall(s))
    pairs = enumerate(zip(sentences, sentences[1:], strict=False))
    return [i for i, (a, b) in pairs if a.rstrip().endswith("。") and size(a) + size(b) <= 45 and min(size(a), size(b)) >= 4 and a.count("，") + b.count("，") < 3]


def merge_candidates(docs: DataFrame, alphabet: str = "han") -> DataFrame:
    """(doc_id, idx): merge_places of each document as rows."""
    ends = F.lit(f"(?s)[^{ENDS}]*[{ENDS}]|[^{ENDS}]+")
    # a sentence without characters that count is in no pair
    docs = docs.where(T.has_han(F.col("text"))) if alphabet == "han" else docs
    s = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), ends, F.lit(0)), lambda x: T.strip(x) != "")
    a = F.transform(s, lambda x: F.struct(T.size(x, alphabet).alias("n"), T.occurrences(x, "，").alias("c"), T.strip(x).endswith("。").alias("e")))
    joined = lambda x, y: x["e"] & (x["n"] + y["n"] <= 45) & (F.least(x["n"], y["n"]) >= 4) & (x["c"] + y["c"] < 3)
    d = docs.select("doc_id", a.alias("a"))
    return d.select("doc_id", F.posexplode(F.zip_with("a", F.slice("a", 2, F.size("a")), lambda x, y: y.isNotNull() & joined(x, y))).alias("idx", "yes")).where("yes").select("doc_id", "idx")


def _polish_paragraph(text: str, lex: dict, most: int) -> tuple[str, int]:
    """The edit that lowers the shortfall most, again and again."""
    now, edits = shortfall(text), 0
    while now > 0 and edits < most:
        s = walked_sentences(text)
        splits = ("".join([*s[:k], x[:i] + "。" + x[i + 1 :].lstrip(), *s[k + 1 :]]) for k, x in enumerate(s) for i in split_places(x, lex))
        merges = ("".join([*s[:k], s[k].rstrip().removesuffix("。") + "，" + s[k + 1].lstrip(), *s[k + 2 :]]) for k in merge_places(s))
        best = min(((shortfall(x), i, x) for i, x in enumerate([*splits, *merges])), default=None)
        if best is None or best[0] >= now:
            break
        now, _, text = best
        edits += 1
    return text, edits


def polish(text: str, lex: dict | None = None, most: int = MOST_EDITS) -> tuple[str, int]:
    """Rhythm by splits and merges within paragraphs, and how many; the text as it was should more than punctuation have changed."""
    lex = lex or lexicons.load()
    parts = re.split(r"(\n\s*\n)", text)
    done = [_polish_paragraph(p, lex, most) if p.strip() else (p, 0) for p in parts]
    out = "".join(p for p, _ in done)
    bare = lambda s: s.translate(dict.fromkeys(map(ord, lex["rhythm_punctuation"])))
    return (out, sum(n for _, n in done)) if bare(out) == bare(text) else (text, 0)


# guarded replacement


def table(scene: str, lex: dict) -> list[tuple[str, list[str], bool]]:
    """(pattern, candidates, whether it is a regular expression), longest first; an academic text has its own table before the general one."""
    tables = ([lex["academic_replacements"]] if scene == "academic" else []) + [lex["replacements"]]
    every = [(p, [c for c in cs if c not in lex["candidate_bans"]], bool(re.search(r"[\\^$*+?()\[\]|{]", p))) for t in tables for p, cs in t.items()]
    return sorted((e for e in every if e[1] and (e[2] or len(e[0]) >= LEAST_PATTERN)), key=lambda e: -len(e[0]))


def replaced(text: str, scene: str, rng: random.Random, lex: dict | None = None) -> tuple[str, int]:
    """Phrases outside quotes, at the beginning of a text or after a boundary, by one of their candidates; how many."""
    n = 0
    for pattern, candidates, regex in table(scene, lex or lexicons.load()):
        level = depths(text)

        def by(m: re.Match, text: str = text, level: list[int] = level, candidates: list[str] = candidates, regex: bool = regex) -> str:
            nonlocal n
            if level[m.start()] or (m.start() and text[m.start() - 1] not in BOUNDARY):
                return m[0]
            n += 1
            choice = rng.choice(candidates)
            return m.expand(choice) if regex and "\\" in choice else choice

        text = re.sub(pattern if regex else re.escape(pattern), by, text)
    return text, n


def on_texts(rows: DataFrame, f: Callable, extra: list[tuple[str, str]] = (), column: str = "text", out: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows' keep columns, and what f(text, *keep values) gives for each row: a text, or a tuple of a text and the extra columns (name, type)."""
    names = [out, *(n for n, _ in extra)]
    kinds = rows.select(*keep).schema
    for n, k in [(out, "string"), *extra]:
        kinds = kinds.add(n, DataType.fromDDL(k))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            args = [c.to_pylist() for c in batch.columns]
            done = [f(t or "", *k) for *k, t in zip(*args, strict=True)]
            done = done if extra else [(x,) for x in done]
            cols = list(zip(*done, strict=True)) if done else [[]] * len(names)
            own = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c), own[k]) for c, k in zip(cols, ["string", *(k for _, k in extra)], strict=True))], names=[*keep, *names])

    return rows.select(*keep, column).mapInArrow(run, kinds)


def replace_guarded(docs: DataFrame, scene: str = "auto", seed: int = 42, with_rhythm: bool = True, lex: dict | None = None) -> DataFrame:
    """(doc_id, scene, text, replacements, rhythm, problems): phrases replaced, rhythm polished, all taken back where a guard of 0.85 to 1.15 finds a problem.

    The draws depend on seed and doc_id, not on partitions.
    """
    lex = lex or lexicons.load()
    picked = scoring.genre_of(F.coalesce("text", F.lit("")), lex, "han") if scene == "auto" else F.lit(scene)

    def one(text: str, doc: int, scene: str) -> tuple[str, int, int]:
        out, n = replaced(text, scene, random.Random(f"{seed}:{doc}"), lex)
        if not with_rhythm:
            return out, n, 0
        out, k = polish(out, lex)
        return out, n, k

    rows = docs.select("doc_id", picked.alias("scene"), F.coalesce("text", F.lit("")).alias("before"))
    done = on_texts(rows.withColumn("t", F.col("before")), lambda text, doc, scene, before: one(text, doc, scene), [("replacements", "int"), ("rhythm", "int")], "t", "after", ("doc_id", "scene", "before"))
    done = guarded(done, least=0.85, most=1.15, lex=lex)
    held = lambda c: F.when(F.size("problems") == 0, F.col(c)).otherwise(0).alias(c)
    return done.select("doc_id", "scene", F.col("result").alias("text"), held("replacements"), held("rhythm"), "problems")


def split_candidates(docs: DataFrame, lex: dict | None = None) -> DataFrame:
    """(doc_id, idx, place): split_places of each sentence (idx from 0, in order of the text)."""
    lex = lex or lexicons.load()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(d, k, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, s in enumerate(s for p in re.split(r"\n\s*\n", t or "") for s in walked_sentences(p)) for i in split_places(s, lex)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "idx", "place"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, idx int, place int")


def polished(docs: DataFrame, lex: dict | None = None) -> DataFrame:
    """(doc_id, text, edits)"""
    lex = lex or lexicons.load()
    return on_texts(docs, lambda t, _: polish(t, lex), [("edits", "int")])


def similar(pairs: DataFrame, least: float = SCOPE) -> DataFrame:
    """(pair_id, ratio, in_scope) of pairs (pair_id, before, after): sequence similarity."""
    rows = pairs.select("pair_id", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    done = on_texts(rows, lambda after, _, before: ("", similarity(before, after)), [("ratio", "double")], "after", "none", ("pair_id", "before"))
    return done.select("pair_id", "ratio", (F.col("ratio") >= least).alias("in_scope"))


class Rewriter(Protocol):
    """An outside rewriter of texts, which must be picklable; feedback names the problems of the last try."""

    def rewrite(self, text: str, feedback: list[str]) -> str: ...


def staged(docs: DataFrame, rewriter: Rewriter, attempts: int = 3, least: float = 0.75, most: float = 1.25, scope: float | None = None, lex: dict | None = None) -> DataFrame:
    """(doc_id, text, status, tries, problems): a rewriter's text where the guards pass within the attempts, the original else.

    scope: least similarity to the original, for proofreading. status: rewritten, unchanged, reverted or failed (the rewriter raised).
    """
    lex = lex or lexicons.load()

    def one(text: str, _: int) -> tuple[str, str, int, list[str]]:
        feedback: list[str] = []
        for k in range(1, attempts + 1):
            try:
                out = rewriter.rewrite(text, feedback).strip()
            except Exception as e:  # whatever an outside service raises
                return text, "failed", k, [type(e).__name__]
            if out == text:
                return text, "unchanged", k, []
            feedback = _problems_of(text, out, least, most, lex) + (["scope"] if scope is not None and similarity(text, out) < scope else [])
            if not feedback:
                return out, "rewritten", k, []
        return text, "reverted", attempts, feedback

    return on_texts(docs, one, [("status", "string"), ("tries", "int"), ("problems", "array<string>")])


def lenient_json(raw: Column) -> Column:
    """The JSON object of a reply: code fences taken off, else the part from the first to the last brace; null where neither is an object."""
    s = T.strip(T.sub(T.sub(T.strip(raw), "^```[^\n]*\n?"), "```$"))
    whole, part = F.try_parse_json(s), F.try_parse_json(F.regexp_extract(s, r"(?s)\{.*\}", 0))
    return F.coalesce(F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.to_json(whole)), F.when(F.schema_of_variant(part).startswith("OBJECT"), F.to_json(part)))
