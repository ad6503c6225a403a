"""Rewriting passes: seeded or fixed edits of one text, their chains, and their form over a table.

A pass takes a text and a random generator and gives a text; the generator is seeded by (seed, pass, doc_id), so results depend
neither on partitions nor on other documents. Passes that search for a lower detector score, and those that add an author's
voice or made-up caveats to academic texts, are left out on purpose.
"""

from __future__ import annotations

import random
import re
import statistics
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import guards, ngrams
from quillspark.sources import lexicons

HAN = re.compile("[一-鿿]")
STRUCTURAL = re.compile(r"\s*(#|- |\* |\*\*.*\*\*\s*$|\d+[.。．)）]|[\"“「]|[一二三四五六七八九十]+[、,，]|[（(][一二三四五六七八九十]+[）)])", re.S)
# Own word lists of the passes, all replaceable by parameters.
SYNONYMS = {"进行": ("做", "开展"), "实现": ("做到", "达到"), "提供": ("给", "带来"), "促进": ("推动", "带动"), "加强": ("增强", "强化"), "提高": ("提升", "增加"), "不断": ("一直", "持续"), "积极": ("主动", "热心")}
CASUAL, PARTICLES, TURNS = ("说实话", "其实", "讲真"), ("吧", "嘛", "呗"), ("话说回来", "说到这个")
REACTIONS = {"neutral": ("这一点很清楚。", "事情大致如此。"), "narrative": ("四周安静下来。", "没有人说话。")}
ASIDES = {"hedge": ("多少", "大致上"), "oral": ("你看", "怎么说呢")}
TEMPLATES = (
    (r"随着(?P<a>[^，。]{2,16})的不断(?:发展|进步)，(?P<b>[^。！？]{4,30})", ("{b}，这与{a}的发展有关", "{a}在发展，{b}")),
    (r"(?P<a>[^，。]{2,10})不仅(?P<b>[^，。]{2,16})，(?:而且|还)(?P<c>[^。！？]{2,20})", ("{a}{b}，也{c}",)),
    (r"对于(?P<a>[^，。]{2,10})而言，(?P<b>[^。！？]{4,30})", ("就{a}来说，{b}", "{b}，这是对{a}说的")),
)
PAUSES = ("但是", "因为", "所以", "并且", "以及", "或者", "如果", "可以", "需要", "通过", "就是")
TIGHT = "不未没别仍还再才都也就"


def size(s: str) -> int:
    return len(HAN.findall(s))


def units(text: str, ends: str = "。！？") -> list[str]:
    """Sentences with their ends; blank ones stay with the one before."""
    out: list[str] = []
    for s in re.findall(f"[^{ends}]*[{ends}]+|[^{ends}]+$", text):
        if out and not s.strip():
            out[-1] += s
        else:
            out.append(s)
    return out


def cut(s: str) -> tuple[str, str]:
    """A sentence's body and its end."""
    m = re.search("[。！？]+\\s*$", s)
    return (s[: m.start()], s[m.start() :]) if m else (s, "")


def variation(sizes: list[int]) -> float:
    return statistics.pstdev(sizes) / statistics.mean(sizes) if len(sizes) > 1 and sum(sizes) else 0.0


def blocks(text: str) -> list[str]:
    return re.split(r"\n[ \t\r]*\n+", text)


def per_block(f: Callable[[str, random.Random], str]) -> Callable[[str, random.Random], str]:
    return lambda text, rng: "\n\n".join(p if not p.strip() or STRUCTURAL.match(p) else f(p, rng) for p in blocks(text))


def per_unit(f: Callable[[str, random.Random], str]) -> Callable[[str, random.Random], str]:
    return per_block(lambda p, rng: "".join(f(s, rng) for s in units(p)))


# structure and phrases


def remove_enumeration(text: str, rng: random.Random) -> str:
    """Ordinal openers go, later ones may become a looser connective."""
    later = {"其次": ("另外，", ""), "最后": ("还有，", ""), "第二": ("接着，", ""), "第三": ("还有，", ""), "其二": ("另外，", ""), "其三": ("还有，", "")}
    pattern = r"(首先|其次|最后|第[一二三四五六七八九]|其[一二三])([，,]|(?<=第.)、|(?<=其.)、)[ \t]*"
    return re.sub(pattern, lambda m: rng.choice(later.get(m[1], ("",))) if m[1] != "第一" else "", text)


def replace_phrases(text: str, rng: random.Random, table: dict[str, list[str]] | None = None) -> str:
    """R2: phrases, longest first, each occurrence by the next of its candidates in turn; candidates that hold the phrase are skipped."""
    table = table or lexicons.DEFAULT["replacements"]
    for phrase in sorted(table, key=lambda p: (-len(p), p)):
        options = [c for c in table[phrase] if phrase not in c]
        if options and phrase in text:
            at = rng.randrange(len(options))
            parts = text.split(phrase)
            text = parts[0] + "".join(options[(at + i) % len(options)] + p for i, p in enumerate(parts[1:]))
    return text


def swap_synonyms(text: str, rng: random.Random, strength: float = 0.3, synonyms: dict = SYNONYMS) -> str:
    """That share of the words of a table by one of their synonyms, unless a doubled character would arise."""

    def by(m: re.Match) -> str:
        new = rng.choice(synonyms[m[0]])
        clash = text[m.start() - 1 : m.start()] == new[0] or text[m.end() : m.end() + 1] == new[-1]
        return m[0] if clash or rng.random() >= strength else new

    return re.sub("|".join(sorted(synonyms, key=len, reverse=True)), by, text)


def reduce_frequent(text: str, rng: random.Random, counts: dict[str, int], strength: float = 0.3, share: float = 0.6, synonyms: dict = SYNONYMS) -> str:
    """Of the table's words in the text, the share `strength` with the most frequent inner bigrams have that share of places replaced by the candidate a third from below in frequency."""
    weight = lambda w: max((counts.get(w[i : i + 2], 0) for i in range(len(w) - 1)), default=0)
    present = sorted((w for w in synonyms if w in text), key=lambda w: (-weight(w), w))
    for word in present[: max(1, round(len(present) * strength))] if present else ():
        options = sorted(synonyms[word], key=lambda w: (weight(w), w))
        new = options[len(options) // 3]
        text = re.sub(word, lambda m, new=new: new if rng.random() < share else m[0], text)
    return text


def vary_vocabulary(text: str, rng: random.Random, synonyms: dict = SYNONYMS) -> str:
    """Of a word used more than twice the first place stays, the others vary."""
    for word, options in synonyms.items():
        first, *rest = text.split(word)
        if len(rest) > 2:
            text = first + word + rest[0] + "".join(rng.choice(options) + p for p in rest[1:])
    return text


def templates(text: str, rng: random.Random, strength: float = 0.6, rules: tuple = TEMPLATES) -> str:
    """At most one template a sentence, filled by its named groups; taken back where the size changes by half or more."""

    def one(s: str, rng: random.Random) -> str:
        for pattern, forms in rules if size(s) >= 10 and rng.random() < strength else ():
            if m := re.search(pattern, s):
                out = s[: m.start()] + rng.choice(forms).format(**m.groupdict()) + s[m.end() :]
                return out if abs(size(out) - size(s)) < size(s) / 2 else s
        return s

    return per_unit(one)(text, rng)


def drop_fillers(text: str, rng: random.Random, share: float = 0.5, fillers: tuple[str, ...] = ()) -> str:
    """Opening fillers with their comma go by chance, unless a doubled character would arise."""
    fillers = fillers or (*lexicons.DEFAULT["mechanical_connectors"], *lexicons.DEFAULT["filler_phrases"])
    pattern = f"(?:{'|'.join(sorted(fillers, key=len, reverse=True))})[，,][ \\t]*"
    keep = lambda m: text[m.start() - 1 : m.start()] == text[m.end() : m.end() + 1] != ""
    return re.sub(pattern, lambda m: m[0] if keep(m) or rng.random() >= share else "", text)


# sentences


def split_long(text: str, rng: random.Random, least: int = 30, share: float = 0.5) -> str:
    """Long sentences end before a connective that can begin one."""

    def one(s: str, rng: random.Random) -> str:
        places = [m for m in re.finditer("，(?=同时|并且|而且|但是|不过|因此|所以)", s) if size(s[: m.start()]) >= 8 and size(s[m.end() :]) >= 8]
        level = guards.depths(s)
        places = [m for m in places if not level[m.start()]]
        if size(s) <= least or not places or rng.random() >= share:
            return s
        m = min(places, key=lambda m: abs(m.start() - len(s) // 2))
        return s[: m.start()] + "。" + s[m.end() :]

    return per_unit(one)(text, rng)


def merge_short(text: str, rng: random.Random, share: float = 0.4, most: int = 45) -> str:
    """Two short neighbours that begin with the same two to six characters become one, the second without them."""

    def one(p: str, rng: random.Random) -> str:
        s, out = units(p), []
        while s:
            a = s.pop(0)
            (body, end), (b, _) = cut(a), cut(s[0]) if s else ("", "")
            same = next((k for k in range(min(6, len(body), len(b)), 1, -1) if body.strip()[:k] == b.strip()[:k] and size(b.strip()[:k]) == k), 0)
            rest = b.strip()[same:].lstrip("，也还更")
            if same and end.strip() == "。" and max(size(body), size(b)) < 20 and size(body) + size(b) < most and size(rest) > 2 and rng.random() < share:
                out.append(f"{body}，也{rest}{cut(s.pop(0))[1]}")
            else:
                out.append(a)
        return "".join(out)

    return per_block(one)(text, rng)


def reorder(text: str, rng: random.Random, share: float = 0.5) -> str:
    """Two inner sentences of a paragraph of four or more change places."""

    def one(p: str, rng: random.Random) -> str:
        s = units(p)
        if len(s) >= 4 and rng.random() < share:
            i, j = rng.sample(range(1, len(s) - 1), 2)
            s[i], s[j] = s[j], s[i]
        return "".join(s)

    return per_block(one)(text, rng)


def vary_lengths(text: str, rng: random.Random, merges: float = 0.15, cuts: float = 0.25) -> str:
    """By chance neighbours of middle length are joined by a comma, and long sentences end at a place where they may."""
    lex = lexicons.DEFAULT

    def one(p: str, rng: random.Random) -> str:
        s, out = units(p), []
        while s:
            a = s.pop(0)
            body, end = cut(a)
            places = guards.split_places(a, lex)
            if s and end.strip() == "。" and 5 <= size(a) <= 25 and 5 <= size(s[0]) <= 25 and rng.random() < merges:
                a = body + "，" + s.pop(0).lstrip()
            elif places and size(a) >= 30 and rng.random() < cuts:
                a = a[: places[0]] + "。" + a[places[0] + 1 :].lstrip()
            out.append(a)
        return "".join(out)

    return per_block(one)(text, rng)


def diversify_lengths(text: str, rng: random.Random, target: float = 0.40, most: int = 6) -> str:
    """The longest sentence that may be cut is cut, until the variation of lengths reaches the target."""
    lex, paragraphs = lexicons.DEFAULT, re.split(r"(\n[ \t\r]*\n+)", text)
    for _ in range(most):
        every = [(size(s), i, k, guards.split_places(s, lex)) for i, p in enumerate(paragraphs) if not STRUCTURAL.match(p) for k, s in enumerate(units(p))]
        best = max((e for e in every if e[3]), default=None)
        if best is None or variation([e[0] for e in every if e[0]]) >= target:
            break
        _, i, k, places = best
        s = units(paragraphs[i])
        at = min(places, key=lambda x: abs(x - len(s[k]) // 2))
        s[k] = s[k][:at] + "。" + s[k][at + 1 :].lstrip()
        paragraphs[i] = "".join(s)
    return "".join(paragraphs)


def boost_commas(text: str, rng: random.Random, target: float = 4.7) -> str:
    """Commas before pause markers within long sentences of few commas, as many as the target per hundred characters needs."""
    n = len(re.sub(r"\s", "", text))
    short = int((target - len(re.findall("[，,]", text)) / n * 100) * n / 100) + 1 if n >= 100 else 0
    if n < 100 or len(re.findall("[，,]", text)) / n * 100 >= target:
        return text
    out = []
    for s in re.split(r"((?<=[。！？\n]))", text):
        if short > 0 and size(s) >= 15 and len(re.findall("[，,]", s)) < 2:
            fits = (m.start() for p in PAUSES for m in re.finditer(p, s) if size(s[: m.start()]) >= 6 and size(s[m.start() :]) >= 4 and not re.search(f"[，,]|[{TIGHT}].?$", s[max(0, m.start() - 6) : m.start()]))
            if (at := next(fits, None)) is not None:
                s, short = s[:at] + "，" + s[at:], short - 1
        out.append(s)
    return "".join(out)


def cap_transitions(text: str, rng: random.Random, target: float = 6.0, words: tuple[str, ...] = ()) -> str:
    """Transitions that begin a sentence go by chance, in proportion to how far their density per thousand characters exceeds the target."""
    words = words or tuple(lexicons.DEFAULT["transitions"])
    n = size(text)
    density = sum(text.count(w) for w in words) / n * 1000 if n >= 100 else 0.0
    if density <= target:
        return text
    gone = min(0.9, 1 - target / density)
    pattern = f"(?:^|(?<=[。！？\n]))(?:{'|'.join(sorted(words, key=len, reverse=True))})[，,、]?"
    return re.sub(pattern, lambda m: "" if rng.random() < gone else m[0], text)


# register


def add_particles(text: str, rng: random.Random, share: float = 0.15) -> str:
    """Statements of 6 to 40 characters get a closing particle by chance."""

    def one(s: str, rng: random.Random) -> str:
        body, end = cut(s)
        fit = end.startswith("。") and 6 <= size(body) <= 40 and body.rstrip()[-1:] not in "吧嘛呗呢啊哦嗯哈的了"
        return body.rstrip() + rng.choice(PARTICLES) + end if fit and rng.random() < share else s

    return per_unit(one)(text, rng)


def add_casual(text: str, rng: random.Random, casualness: float = 0.3) -> str:
    """An opener at the beginning and turns in the second half, few and by chance."""
    s = units(text)
    left = max(1, int(len(s) * casualness * 0.3)) if casualness >= 0.2 else 0
    for i, x in enumerate(s):
        words = CASUAL if i == 0 else TURNS if i > len(s) / 2 else ()
        if left and words and x.strip() and not STRUCTURAL.match(x) and rng.random() < casualness * 0.2:
            lead = len(x) - len(x.lstrip())
            s[i], left = x[:lead] + rng.choice(words) + "，" + x[lead:], left - 1
    return "".join(s)


def add_asides(text: str, rng: random.Random, density: float = 0.15, register: str = "hedge") -> str:
    """At most one aside a paragraph, after the first comma of a sentence outside quotes."""

    def one(p: str, rng: random.Random) -> str:
        s = units(p)
        for i, x in enumerate(s):
            at = x.find("，")
            if at > 4 and not guards.depths(x)[at] and size(x[at:]) >= 6 and rng.random() < density:
                s[i] = x[: at + 1] + rng.choice(ASIDES[register]) + x[at + 1 :]
                break
        return "".join(s)

    return per_block(one)(text, rng)


def add_reactions(text: str, rng: random.Random, share: float = 0.2, register: str = "neutral") -> str:
    """A short sentence at the end of some paragraphs of three sentences or more."""
    return per_block(lambda p, rng: p + rng.choice(REACTIONS[register]) if len(units(p)) >= 3 and p.rstrip().endswith("。") and rng.random() < share else p)(text, rng)


def interjection(text: str, rng: random.Random, target: float = 0.50, register: str = "neutral") -> str:
    """Where paragraph lengths vary little, one short paragraph after one of the longest, not before a heading or list."""
    p = blocks(text)
    sizes = [size(x) for x in p]
    long = [i for i, n in enumerate(sizes) if n >= 20]
    if len(p) < 4 or len(long) < 3 or variation([sizes[i] for i in long]) >= target:
        return text
    at = 1 + rng.choice(sorted(long, key=lambda i: -sizes[i])[: max(2, len(long) // 4)])
    return text if at < len(p) and STRUCTURAL.match(p[at]) else "\n\n".join([*p[:at], rng.choice(REACTIONS[register]), *p[at:]])


def paragraph_rhythm(text: str, rng: random.Random, target: float = 0.40, merges: float = 0.3, cuts: float = 0.3) -> str:
    """Where paragraph lengths vary little, short neighbours are joined and long paragraphs parted by chance; headings, lists and dialogue stay."""
    p = blocks(text)
    if variation([size(x) for x in p if size(x) >= 20]) >= target:
        return text
    mean, out = sum(map(len, p)) / len(p), []
    while p:
        a = p.pop(0)
        free = a.strip() and not STRUCTURAL.match(a)
        if free and p and p[0].strip() and not STRUCTURAL.match(p[0]) and len(a) + len(p[0]) < 1.2 * mean and rng.random() < merges:
            a = a.rstrip() + p.pop(0).lstrip()
        elif free and len(units(a)) >= 4 and len(a) > 1.2 * mean and rng.random() < cuts:
            s = units(a)
            k = rng.randrange(1, len(s))
            out.append("".join(s[:k]).rstrip())
            a = "".join(s[k:]).lstrip()
        out.append(a)
    return "\n\n".join(out)


def spread_by_merge(text: str, rng: random.Random, target: float = 0.40) -> str:
    """In each paragraph of four sentences or more whose lengths vary little, the first two neighbours of middle length are joined."""

    def one(p: str, _: random.Random) -> str:
        s = units(p)
        if size(p) < 60 or len(s) < 4 or variation([n for x in s if (n := size(x)) >= 5]) >= target:
            return p
        for i in range(len(s) - 1):
            a, b = size(s[i]), size(s[i + 1])
            if 5 <= a <= 25 and 5 <= b <= 25 and "\n" not in s[i + 1]:
                return "".join([*s[:i], cut(s[i])[0].rstrip() + "，" + s[i + 1].lstrip(), *s[i + 2 :]])
        return p

    return per_block(one)(text, rng) if len(blocks(text)) > 1 else text


def spread_by_cut(text: str, rng: random.Random, target: float = 0.40) -> str:
    """In each paragraph of three sentences or more whose lengths vary little, the longest sentence ends at its first place where it may."""

    def one(p: str, _: random.Random) -> str:
        s = units(p)
        if size(p) < 60 or len(s) < 3 or variation([n for x in s if (n := size(x)) >= 5]) >= target:
            return p
        k = max(range(len(s)), key=lambda i: size(s[i]))
        places = guards.split_places(s[k], lexicons.DEFAULT) if size(s[k]) >= 18 else []
        return "".join([*s[:k], s[k][: places[0]] + "。" + s[k][places[0] + 1 :].lstrip(), *s[k + 1 :]]) if places else p

    return per_block(one)(text, rng) if len(blocks(text)) > 1 else text


def reduce_cross_repeats(text: str, rng: random.Random, thesaurus: dict = SYNONYMS) -> str:
    """Words of the thesaurus that two or more paragraphs hold vary in the last of them; nothing without a thesaurus."""
    p = blocks(text)
    for word, options in thesaurus.items():
        at = [i for i, x in enumerate(p) if word in x]
        if len(at) >= 2:
            p[at[-1]] = p[at[-1]].replace(word, rng.choice(options), 1)
    return "\n\n".join(p)


def pack(text: str, most: int = 150) -> str:
    """Paragraphs longer than `most` parted between sentences, filled greedily."""
    out = []
    for p in blocks(text):
        line = ""
        for s in units(p) if len(p) > most else [p]:
            if line and len(line) + len(s) > most:
                out.append(line.strip())
                line = ""
            line += s
        out.append(line.strip() if len(p) > most else line)
    return "\n\n".join(x for x in out if x or len(out) == 1)


def drop_connectors(text: str, rng: random.Random, most: int = 6) -> str:
    """Up to `most` connectives with their comma go, each by half chance."""
    left = [most]

    def by(m: re.Match) -> str:
        if not left[0] or rng.random() < 0.5:
            return m[0]
        left[0] -= 1
        return ""

    return re.sub("(?:此外|另外|与此同时|不仅如此|事实上|实际上)，", by, text)


def tidy(text: str, _: random.Random | None = None) -> str:
    """Doubled marks, blank lines, doubled characters and immediate repeats of four to twelve Han characters."""
    for pattern, by in ((r"[，,]{2,}", "，"), (r"。{2,}", "。"), (r"\n{3,}", "\n\n"), ("，。|。，", "。"), (r"([已会了的是在])\1", r"\1"), (r"([一-鿿]{4,12})\1", r"\1")):
        text = re.sub(pattern, by, text)
    return text


# styles


def strip_formal(text: str) -> str:
    """Enumerating openers."""
    return re.sub(r"(?:首先|其次|最后)[，,]\s*|(?:第[一二三四五六]|其[一二三])[，,、]\s*", "", text)


def to_casual(text: str, table: dict[str, str] | None = None) -> str:
    """Formal words by casual ones, in the table's order; words without one go with a comma after them."""
    for formal, casual in (table or lexicons.DEFAULT["formal_to_casual"]).items():
        text = text.replace(formal, casual) if casual else text.replace(formal + "，", "").replace(formal, "")
    return text


def add_emoji(text: str, rng: random.Random, density: float, pool: str = "😊👍🎉✨🔥") -> str:
    """Before the ends of some sentences."""
    return "".join(b + rng.choice(pool) + e if b.strip() and e and rng.random() < density else b + e for b, e in map(cut, units(text)))


def _lead(text: str, words: tuple[str, ...], rng: random.Random) -> str:
    return rng.choice(words) + "，" + text.lstrip() if text.strip() else text


def casual(text: str, rng: random.Random) -> str:
    return add_emoji(add_particles(_lead(to_casual(strip_formal(text)), ("你看", "说起来", "其实"), rng), rng), rng, 0.1, "😂😅🙃")


def zhihu(text: str, rng: random.Random) -> str:
    out = _lead(to_casual(strip_formal(text)), ("从我的经验来看", "说点个人看法"), rng)
    return out + rng.choice(("\n\n欢迎讨论。", "\n\n个人观点，仅供参考。")) if out and rng.random() < 0.3 else out


def xiaohongshu(text: str, rng: random.Random) -> str:
    body = add_emoji("".join(b + ("！" + e[1:] if e and rng.random() < 0.3 else e) for b, e in map(cut, units(to_casual(strip_formal(text))))), rng, 0.4, "✨💕🌸🎀")
    return rng.choice(("姐妹们！今天分享一下", "家人们谁懂啊")) + "～\n\n" + pack(body, 80) + "\n\n" + " ".join(rng.sample(("#好物分享", "#实用推荐", "#干货分享", "#经验分享"), 3))


def wechat(text: str, rng: random.Random) -> str:
    opening = ("你有没有想过这样一个问题——", "说一个真实的故事。")
    out = strip_formal(text)
    out = out if out.startswith(tuple(o[:3] for o in opening)) else rng.choice(opening) + "\n\n" + out
    return out + "\n\n你怎么看？评论区聊聊。" if rng.random() < 0.4 else out


def academic(text: str, rng: random.Random | None = None) -> str:
    """Fixed: casual words by formal ones, no emoji, formal connectives, no particles before marks, exclamations as full stops where there are more than two."""
    out = to_casual(text, lexicons.DEFAULT["casual_to_formal"])
    out = re.sub(f"[{re.sub(r'\\x{([0-9A-F]+)}', lambda m: chr(int(m[1], 16)), guards.EMOJI)}]+", "", out)
    for a, b in (("所以，", "因此，"), ("但是，", "然而，"), ("而且，", "此外，")):
        out = out.replace(a, b)
    out = re.sub("[吧呢啊嘛哦哈](?=[。！？，])", "", out)
    return out.replace("！", "。") if out.count("！") > 2 else out


def literary(text: str, rng: random.Random) -> str:
    images, left = {"开始": "如同晨曦初现", "变化": "如同季节的更迭", "困难": "像是在荆棘中寻路", "美好": "如诗如画"}, 2
    out = to_casual(strip_formal(text))
    for word, image in images.items():
        if left and word in out and rng.random() < 0.3:
            out, left = out.replace(word, image, 1), left - 1
    return out


def novel(text: str, rng: random.Random | None = None) -> str:
    """Fixed: paragraphs of rules, outline bullets and short remarks about the writing go, headings lose their line."""
    out = []
    for p in text.split("\n\n"):
        p = p.strip()
        if re.match(r"#{1,4}\s+", p):
            p = p.partition("\n")[2].strip()
        rule, bullet = re.fullmatch(r"-{3,}|\*{3,}|={3,}", p), re.match(r"[-*]\s+\*\*[^*]+\*\*[:：]", p)
        remark = len(p) < 300 and re.search("|".join(lexicons.DEFAULT["novel_artifacts"]), p[:60])
        out += [p] if p and not (rule or bullet or remark) else []
    return "\n\n".join(out)


def weibo(text: str, rng: random.Random) -> str:
    """The first five sentences, with some emoji."""
    return add_emoji("".join(s.strip() for s in [u for u in units(to_casual(strip_formal(text))) if cut(u)[0].strip()][:5]), rng, 0.15, "😂😅🙃")


STYLES = {"casual": casual, "zhihu": zhihu, "xiaohongshu": xiaohongshu, "wechat": wechat, "academic": academic, "literary": literary, "weibo": weibo, "novel": novel}
SCENES = {"casual": "social", "zhihu": "social", "xiaohongshu": "general", "wechat": "social", "academic": "formal", "literary": "general", "weibo": "social", "novel": "general"}


def restructure(text: str, rng: random.Random) -> str:
    """Templates, splits, merges, reordering, fillers, reactions, then the clean-up, in this order."""
    for f in (templates, split_long, merge_short, reorder, drop_fillers, add_reactions, tidy):
        text = f(text, rng)
    return text


PASSES: dict[str, Callable[[str, random.Random], str]] = {
    "remove_enumeration": remove_enumeration, "replace_phrases": replace_phrases, "swap_synonyms": swap_synonyms, "vary_vocabulary": vary_vocabulary, "templates": templates, "drop_fillers": drop_fillers,
    "split_long": split_long, "merge_short": merge_short, "reorder": reorder, "vary_lengths": vary_lengths, "diversify_lengths": diversify_lengths, "boost_commas": boost_commas, "cap_transitions": cap_transitions,
    "add_particles": add_particles, "add_casual": add_casual, "add_asides": add_asides, "add_reactions": add_reactions, "interjection": interjection, "paragraph_rhythm": paragraph_rhythm,
    "spread_by_merge": spread_by_merge, "spread_by_cut": spread_by_cut, "reduce_cross_repeats": reduce_cross_repeats, "shorten_paragraphs": lambda t, _: pack(t), "drop_connectors": drop_connectors, "tidy": tidy, "restructure": restructure,
} | {f"style_{k}": f for k, f in STYLES.items()}


def rewritten(docs: DataFrame, names: tuple[str, ...], seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, text): the passes of those names one after another on each text; null texts count as empty."""
    chain = [(n, PASSES[n]) for n in names]

    def one(text: str, *key) -> str:
        for name, f in chain:
            text = f(text, random.Random(f"{seed}:{name}:{key[0]}"))
        return text

    return guards.on_texts(docs, one, keep=keep)


def guarded_rewrite(docs: DataFrame, names: tuple[str, ...], seed: int = 42, least: float = 0.75, most: float = 1.25) -> DataFrame:
    """(doc_id, text, problems): the passes' text where the guard finds no problem, the original else."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("before")).withColumn("text", F.col("before"))
    done = rewritten(rows, names, seed, ("doc_id", "before")).withColumnRenamed("text", "after")
    return guards.guarded(done, least=least, most=most).select("doc_id", F.col("result").alias("text"), "problems")


def styled(docs: DataFrame, style: str, seed: int = 42, first: bool = False) -> DataFrame:
    """(doc_id, text): R31, one of STYLES; with first, phrases are replaced and the enumeration is taken out before."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style}, known: {', '.join(STYLES)}")
    return rewritten(docs, (*(("replace_phrases", "remove_enumeration") if first else ()), f"style_{style}"), seed)


def offline(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edits): R32, the rhythm only; nothing but punctuation may change."""
    return guards.polished(docs)


def burst_guarded(docs: DataFrame, model: DataFrame, names: tuple[str, ...] = ("merge_short", "split_long"), least: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, text, kept): R7, the passes, taken back where the burstiness falls below `least` of what it was (texts too short for it keep the edit)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("before")).withColumn("text", F.col("before"))
    d = rewritten(d, names, seed, ("doc_id", "before"))
    burst = ngrams.SERIES.index("burst")
    one = lambda _, lps: (ngrams.series_features(lps[0])[burst],) if lps.shape[1] else None
    for text, name in (("before", "b0"), ("text", "b1")):
        d = ngrams.placed(d.withColumn("h", F.lower(T.extract(F.col(text), "han"))), {"primary": model}, one, f"{name} double")
    kept = F.coalesce(F.col("b1") >= least * F.col("b0"), F.lit(True))
    return d.select("doc_id", F.when(kept, F.col("text")).otherwise(F.col("before")).alias("text"), kept.alias("kept"))


def best_candidates(candidates: DataFrame, model: DataFrame, alphabet: str = "han") -> DataFrame:
    """(id, candidate): R3, of candidates (id, ord, candidate, sentence) the one whose sentence has the second highest perplexity of three or more, else the highest."""
    keyed = candidates.withColumn("doc_id", F.xxhash64("id", "ord"))
    ppl = ngrams.perplexity(keyed.select("doc_id", F.col("sentence").alias("text")), model, alphabet).select("doc_id", "ppl")
    w = Window.partitionBy("id").orderBy(F.coalesce("ppl", F.lit(0.0)), "ord")
    r = keyed.join(ppl, "doc_id", "left").withColumns({"r": F.row_number().over(w), "k": F.count("*").over(Window.partitionBy("id"))})
    return r.where(F.col("r") == F.when(F.col("k") >= 3, F.col("k") - 1).otherwise(F.col("k"))).select("id", "candidate")


def allowed(candidates: Column, banned: Column) -> Column:
    """Candidates without the banned ones, all of them where none is left."""
    left = F.array_except(candidates, banned)
    return F.when(F.size(left) > 0, left).otherwise(candidates)


def expanded(candidates: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """(word, candidates): R6, candidates (word, candidates) with the thesaurus' (word, synonym) added, in order, each once."""
    more = thesaurus.groupBy("word").agg(F.array_sort(F.collect_set("synonym")).alias("more"))
    return candidates.join(more, "word", "left").select("word", F.array_distinct(F.concat("candidates", F.coalesce("more", F.array().cast("array<string>")))).alias("candidates"))


def casual_words(t: Column, table: dict[str, str] | None = None) -> Column:
    """to_casual as an expression."""
    for formal, casual in (table or lexicons.DEFAULT["formal_to_casual"]).items():
        t = F.replace(t, F.lit(formal), F.lit(casual)) if casual else F.replace(F.replace(t, F.lit(formal + "，"), F.lit("")), F.lit(formal), F.lit(""))
    return t


def reduce_punctuation(t: Column) -> Column:
    """Where over three parts lie between semicolons, these become comma and full stop in turn; double dashes become single."""
    parts = F.split(t, "；", -1)
    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).when(i % 2 == 0, F.concat(F.lit("。"), T.sub(p, f"^[{T.SPACE}]+"))).otherwise(F.concat(F.lit("，"), p))), "")
    return F.replace(F.when(F.size(parts) > 3, joined).otherwise(t), F.lit("——"), F.lit("—"))
