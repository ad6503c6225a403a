"""Column functions on texts: alphabets, segmenters, counts, moments over arrays.

An alphabet says which characters count: `han` U+4E00 to U+9FFF, `letters` all letters, `auto` Han where a text has any and
letters elsewhere. Segmenters follow it: Han texts end sentences at the full-width marks and line ends and part paragraphs at
blank lines; other texts end sentences at .!? and part paragraphs at line ends.
"""

from __future__ import annotations

import re
import re._parser as sre_parse
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN, LETTERS = "[^一-鿿]+", r"[^\p{L}]+"
SPACE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"  # what str.strip takes off


def sub(t: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(t, F.lit(pattern), F.lit(by))


SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match("[" + re.sub(r"\\x\{?([0-9a-f]+)\}?", lambda m: f"\\u{m[1]:0>4}", SPACE) + "]", c))


def strip(t: Column) -> Column:
    return F.btrim(t, F.lit(SPACES))


def has_han(t: Column) -> Column:
    return t.rlike("[一-鿿]")


def by_alphabet(t: Column, alphabet: str, han: Column, letters: Column) -> Column:
    """One of two expressions on t, by the alphabet."""
    return {"han": han, "letters": letters}[alphabet] if alphabet != "auto" else F.when(has_han(t), han).otherwise(letters)


def extract(t: Column, alphabet: str = "han") -> Column:
    """The characters of t that count, in order."""
    return by_alphabet(t, alphabet, sub(t, HAN), sub(t, LETTERS))


def size(t: Column, alphabet: str = "han") -> Column:
    return F.length(extract(t, alphabet))


def occurrences(t: Column, phrase: str) -> Column:
    """Non-overlapping occurrences, left to right."""
    return ((F.length(t) - F.length(F.replace(t, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def counts(t: Column, phrases: list[str], han: Column) -> Column:
    """The occurrences of all phrases, each counted for itself; those with Han characters are looked for where the text has any."""
    with_han = [w for w in phrases if needs_han(re.escape(w))]
    sums = [F.when(han, total([occurrences(t, w) for w in with_han])).otherwise(0)] if with_han else []
    return total([*sums, *[occurrences(t, w) for w in phrases if w not in with_han]])


def needs_han(pattern: str) -> bool:
    """Whether only texts with a Han character can match; False where that isn't plain."""
    within = lambda c: 0x4E00 <= c <= 0x9FFF

    def need(parsed: Iterable) -> bool:
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL" and within(arg):
                return True
            if name == "IN" and all((str(k) == "LITERAL" and within(v)) or (str(k) == "RANGE" and within(v[0]) and within(v[1])) for k, v in arg):
                return True
            if name == "SUBPATTERN" and need(arg[-1]):
                return True
            if name == "BRANCH" and all(map(need, arg[1])):
                return True
            if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0 and need(arg[2]):
                return True
        return False

    try:
        return need(sre_parse.parse(pattern))
    except re.error:
        return False


def matches(t: Column, pattern: str, dotall: bool = False) -> Column:
    """All matches; without dotall a dot stops at \\n only."""
    return F.regexp_extract_all(t, F.lit(("(?s)" if dotall else "(?d)") + pattern), F.lit(0))


def pieces(t: Column, ends: str) -> Column:
    """(stripped sentence with its end) of more than one character; empty ones are dropped."""
    parts = F.regexp_extract_all(t, F.lit(f"[^{ends}]*[{ends}]|[^{ends}]+"), F.lit(0))
    # only the last character of a part can be an end
    ended = F.transform(parts, lambda x: F.struct(x.alias("x"), F.when(F.contains(F.lit(ends), F.right(x, F.lit(1))), F.right(x, F.lit(1))).otherwise("").alias("end")))
    bodies = F.transform(ended, lambda x: F.struct(strip(F.left(x["x"], F.length(x["x"]) - F.length(x["end"]))).alias("body"), x["end"].alias("end")))
    return F.filter(F.transform(F.filter(bodies, lambda x: x["body"] != ""), lambda x: F.concat(x["body"], x["end"])), lambda x: F.length(x) > 1)


def sentences(t: Column, alphabet: str = "han") -> Column:
    return by_alphabet(t, alphabet, pieces(t, "。！？\n"), pieces(t, ".!?。！？\n"))


def paragraphs(t: Column, alphabet: str = "han") -> Column:
    """Parts between blank lines (or line ends), as they are."""
    return by_alphabet(t, alphabet, F.split(t, "\n[ \t\r]*\n+", -1), F.split(t, "\n+", -1))


def paragraphs_by(t: Column, pattern: str, least: int, alphabet: str = "han") -> Column:
    """Stripped parts of Han texts between pattern, of other texts between line ends, that have enough characters."""
    parts = by_alphabet(t, alphabet, F.split(t, pattern, -1), F.split(t, "\n+", -1))
    return F.filter(F.transform(parts, strip), lambda x: size(x, alphabet) >= least)


def chars(h: Column) -> Column:
    return F.filter(F.split(h, ""), lambda x: x != "")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def grams(h: Column, n: int) -> Column:
    """The n-grams of a string, in order."""
    if n == 1:
        return chars(h)
    one = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[c[i + k] for k in range(n)]))).otherwise(F.array().cast("array<string>"))
    return let(chars(h), one)


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def spread(a: Column) -> Column:
    """Standard deviation over mean of an array of numbers; null for an empty one or a mean of zero."""
    sums = F.aggregate(a, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda s, x: F.struct((s["s"] + x).alias("s"), (s["q"] + x.cast("double") * x).alias("q")))
    n = F.size(a)
    return let(sums, lambda s: F.when(s["s"] != 0, F.sqrt(F.greatest(F.lit(0.0), s["q"] / n - (s["s"] / n) * (s["s"] / n))) / (s["s"] / n)))


def counted(a: Column) -> Column:
    """Of an array of strings, (longest run, its first place, sum of n * log2(n), distinct ones): one pass over the sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("x"), *[F.lit(0).alias(k) for k in ("n", "first", "most", "at")], F.lit(0.0).alias("e"), F.lit(0).alias("kinds"))
    entropy = lambda s: s["e"] + F.when(s["n"] > 1, s["n"] * F.log2(s["n"])).otherwise(0.0)
    better = lambda s: (s["n"] > s["most"]) | ((s["n"] == s["most"]) & (s["first"] < s["at"]))

    def close(s: Column) -> list[Column]:
        return [F.when(better(s), s["n"]).otherwise(s["most"]).alias("most"), F.when(better(s), s["first"]).otherwise(s["at"]).alias("at"), entropy(s).alias("e"), (s["kinds"] + F.when(s["n"] > 0, 1).otherwise(0)).alias("kinds")]

    def step(s: Column, y: Column) -> Column:
        same = F.struct(s["x"].alias("x"), (s["n"] + 1).alias("n"), *[s[k].alias(k) for k in ("first", "most", "at", "e", "kinds")])
        new = F.struct(y["x"].alias("x"), F.lit(1).alias("n"), y["i"].alias("first"), *close(s))
        return F.when(s["x"] == y["x"], same).otherwise(new)

    placed = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.aggregate(placed, start, step, lambda s: F.struct(*close(s)))


def bigram_entropy(h: Column) -> Column:
    """Bits; null for fewer than two characters."""
    g = grams(h, 2)
    return let(g, lambda a: F.when(F.size(a) > 0, F.log2(F.size(a)) - counted(a)["e"] / F.size(a)))
