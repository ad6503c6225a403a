"""Token counts by a compiled transducer whose transitions carry emitted-token counts.

The vocabulary and the merges of a byte-pair tokenizer are compiled into a deterministic transducer over the letters of a
word. A merge sequence is the word's encoding exactly if each pair of neighbouring tokens is, so the last token of every prefix
follows from the last token where it begins. A state therefore holds, for each end of the prefix read that begins some token,
the place in the vocabulary's trie, the last token before it and the count there against the present one; a transition moves
all of them by one letter and carries the change of the count, a final transition ends the word. States and transitions are
made when they are first met, then kept.

Words of ASCII and Latin-1 letters, nearly all of a text, go through the transducer side by side: one step of all distinct words of
a batch is one lookup in the table of transitions, and only missing entries are compiled one by one. White space resets the machine, and nothing that the normaliser and the splitting rule do reaches across it. A chunk of text is
a map (open head, tokens within, open tail) and maps compose associatively, so long texts are cut into chunks whose maps are
combined in a tree (prefix-scan order), with the same result as one pass. Tokenizers for which any of this doesn't hold are refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.util import chunks, segment_hashes, table

CHUNK, MEMO, STATES, BATCH = 1 << 16, 100_000, 150_000, 1 << 20
LONGEST = 64  # bytes of a word that is stepped with others
_SPACE = "\t\n\x0b\x0c\r "
_SEPARATORS = "\x1c\x1d\x1e\x1f"  # str.split() also cuts at these, which the tokenizer keeps within a piece
# fixed values: the parts of a tokenizer that the compiled class is made for
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_OPTIONS = {"type": "BPE", "dropout": None, "unk_token": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


_LETTER = np.array([97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF for b in range(256)])  # within the words that are stepped together
_CLASS = np.cumsum(_LETTER) - 1
_WIDTH = int(_LETTER.sum())
_BYTES = np.flatnonzero(_LETTER)


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transducer:
    """States and transitions of one tokenizer; at most `states` and `words` are kept, more are compiled anew."""

    def __init__(self, source: str, states: int = STATES, words: int = MEMO):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if (spec.get("normalizer") or {}).get("normalizers") != _NORMALIZER or split[0].get("pattern") != {"Regex": _SPLIT} or [x.get("type") for x in split] != ["Split", "ByteLevel"]:
            raise ValueError("the normaliser or the splitting rule isn't of the compiled class")
        if split[0].get("behavior") != "Removed" or not split[0].get("invert") or split[1].get("use_regex") or split[1].get("add_prefix_space"):
            raise ValueError("the splitting rule isn't of the compiled class")
        if any(spec["model"].get(k) != v for k, v in _OPTIONS.items()) or spec["model"].get("continuing_subword_prefix"):
            raise ValueError("the model isn't of the compiled class")
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or any(c in x["content"] for c in _SPACE) or "<|" not in x["content"] for x in spec["added_tokens"]):
            raise ValueError("the added tokens aren't of the compiled class")
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.most_states, self.most_words = states, words
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.letter = _letters()
        merges = spec["model"]["merges"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges)
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.children: list[dict[str, int]] = [{}]
        self.inner: list[str | None] = [None]
        self.last: list[str | None] = [None]
        for token in spec["model"]["vocab"]:
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            if not body or token in ("<|startoftext|>", "<|endoftext|>"):
                continue
            at = 0
            for c in body:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.inner.append(None)
                    self.last.append(None)
                at = self.children[at][c]
            if body is token or body == token:
                self.inner[at] = token
                if not self.end:
                    self.last[at] = token
            else:
                self.last[at] = token
        missing = [c for c in self.letter.values() if c not in self.children[0] or not self.inner[self.children[0][c]] or not self.last[self.children[0][c]]]
        if missing:
            raise ValueError("the vocabulary doesn't hold every byte")
        self.made: dict[str, tuple | None] = {}
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.words: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        """Only the state at the beginning of a word; a state's transitions are a dictionary by letter, with its number under the empty one."""
        self.number = {((0, None, 0),): 0}
        self.state = [((0, None, 0),)]
        self.moves: list[dict] = [{"": 0}]
        self.ends: list[dict[str, int]] = [{}]
        self._grow(1 << 12)

    def _grow(self, rows: int) -> None:
        """Tables of the next state, the change of the count, and the tokens that end a word, by state and letter; -1 where not compiled yet."""
        old = (self.next, self.change, self.last_tokens) if rows > 1 << 12 else None
        self.next, self.change, self.last_tokens = np.full((rows, _WIDTH), -1, np.int32), np.zeros((rows, _WIDTH), np.int8), np.full((rows, _WIDTH), -1, np.int8)
        for new, kept in zip((self.next, self.change, self.last_tokens), old or (), strict=False):
            new[: len(kept)] = kept

    def _derived(self, token: str) -> tuple | None:
        """The outermost parts of a token while it is merged, on its left and on its right: (part, rank that uses it up). None if merging makes no such token."""
        if token not in self.made:
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) and token != self.end else token
            parts = [*body[:-1], body[-1] + token[len(body) :]]
            left, right = [], []
            while len(parts) > 1:
                rank, i = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                if i == 0:
                    left.append((parts[0], rank))
                if i == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            whole = [(token, 1 << 60)]
            self.made[token] = (left + whole, right + whole) if len(parts) == 1 else None
        return self.made[token]

    def _fit(self, a: str | None, b: str) -> bool:
        """Whether a and b stay apart when their text is merged; a is None at the beginning of a word."""
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            to = self._derived(b)
            if to is None or a is None:
                self.fits[key] = to is not None
            else:
                # of two merges of one rank the one further left goes first
                self.fits[key] = not any((r := self.rank.get((x, y))) is not None and r < gone and r <= used for x, gone in self._derived(a)[1] for y, used in to[0])
        return self.fits[key]

    def _move(self, s: int, c: str) -> tuple[dict, int]:
        parts, change, token = [], 0, None
        for node, before, count in self.state[s]:
            child = self.children[node].get(c)
            if child is not None:
                parts.append((child, before, count))
                if token is None and (t := self.inner[child]) and self._fit(before, t):
                    token, change = t, count + 1
        key = (*((node, before, count - change) for node, before, count in parts if self.children[node]), (0, token, 0))
        if key not in self.number:
            self.number[key] = len(self.state)
            self.state.append(key)
            self.moves.append({"": self.number[key]})
            self.ends.append({})
        self.moves[s][c] = out = (self.moves[self.number[key]], change)
        return out

    def _finish(self, s: int, c: str) -> int:
        for node, before, count in self.state[s]:
            child = self.children[node].get(c)
            if child is not None and (t := self.last[child]) and self._fit(before, t):
                self.ends[s][c] = count + 1
                return count + 1
        raise AssertionError("no token ends the word")

    def word(self, word: str) -> int:
        """Tokens of one word of the splitting rule, given in letters of the vocabulary."""
        if len(self.state) > self.most_states:
            self._reset()
        moves, n = self.moves[0], 0
        for c in word[:-1]:
            moves, change = moves.get(c) or self._move(moves[""], c)
            n += change
        s = moves[""]
        return n + (self.ends[s].get(word[-1]) or self._finish(s, word[-1]))

    def _compiled_for(self, s: np.ndarray, c: np.ndarray, end: bool) -> None:
        """Fill the tables' missing entries at these states and letter classes."""
        for key in np.unique(s.astype(np.int64) * _WIDTH + c).tolist():
            state, k = divmod(key, _WIDTH)
            letter = self.letter[int(_BYTES[k])]
            if end:
                self.last_tokens[state, k] = self._finish(state, letter)
                continue
            moves, change = self._move(state, letter)
            if moves[""] >= len(self.next):
                self._grow(2 * len(self.next))
            self.next[state, k], self.change[state, k] = moves[""], change

    def stepped(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the words data[start : start + size], all stepped together."""
        if len(self.state) > self.most_states:
            self._reset()
        order = np.argsort(-size, kind="stable")
        at, left = start[order], size[order]
        s, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for t in range(int(left[0]) - 1 if len(left) else 0):
            k = int(np.searchsorted(-left, -(t + 1), side="left"))  # words of more than t + 1 letters
            c, now = _CLASS[data[at[:k] + t]], s[:k]
            new = self.next[now, c]
            if (miss := new < 0).any():
                self._compiled_for(now[miss], c[miss], False)
                new = self.next[now, c]
            n[:k] += self.change[now, c]
            s[:k] = new
        c = _CLASS[data[at + left - 1]]
        last = self.last_tokens[s, c]
        if (miss := last < 0).any():
            self._compiled_for(s[miss], c[miss], True)
            last = self.last_tokens[s, c]
        out = np.empty(len(n), np.int64)
        out[order] = n + last
        return out

    def plain(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts cut at white space. Pieces with an apostrophe, a special string or any character beyond Latin-1 letters go one by one."""
        joined = "\n".join(texts).encode() + b"\n"
        data = np.frombuffer(joined, dtype=np.uint8)
        ends = np.cumsum([len(t.encode()) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
        data = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
        after = np.concatenate([np.zeros(1, bool), data[:-1] == 0xC3])
        data = data + np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), 0x20, 0).astype(np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        bad = (data == 39) | (data == 60) | (data < 9) | ((data > 13) & (data < 32)) | (data == 127) | ((data >= 0x80) & (data != 0xC3) & ~after) | (after & ((data == 0x97) | (data == 0xB7) | (data < 0x80)))
        letter = _LETTER[data] & ~space
        n = np.zeros(len(texts), np.int64)
        # pieces between white space that hold something bad
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        first, stop = edge[0::2], edge[1::2]
        total = np.concatenate([[0], np.cumsum(bad)])
        odd = total[stop] > total[first]
        for a, b in zip(first[odd].tolist(), stop[odd].tolist(), strict=True):
            n[np.searchsorted(ends, a, side="right")] += self.pieces(joined[a:b].decode())
        fine = np.zeros(len(data) + 1, np.int8)
        np.add.at(fine, first[~odd], 1)
        np.add.at(fine, stop[~odd], -1)
        fine = np.cumsum(fine)[:-1].astype(bool)
        letter &= fine
        digit = fine & (data >= 48) & (data <= 57)
        mark = fine & ~letter & ~digit
        where = lambda at: np.searchsorted(ends, at, side="right")
        n += np.bincount(where(np.flatnonzero(digit)), minlength=len(texts))[: len(texts)] * self.word("0")
        a, b = _runs(mark)
        one = b - a == 1
        marks = np.zeros(256, np.int64)
        for x in np.unique(data[a[one]]).tolist():
            marks[x] = self.word(self.letter[x])
        n += np.bincount(where(a[one]), marks[data[a[one]]], minlength=len(texts)).astype(np.int64)[: len(texts)]
        for x, y in zip(a[~one].tolist(), b[~one].tolist(), strict=True):
            n[where(x)] += self.piece(joined[x:y].decode())
        a, b = _runs(letter)
        long = b - a > LONGEST
        for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True):
            n[where(x)] += self.pieces(joined[x:y].decode())
        a, b = a[~long], b[~long]
        if len(a):
            _, some, inverse = np.unique(segment_hashes(data, a, b), return_index=True, return_inverse=True)
            n += np.bincount(where(a), self.stepped(data, a[some], b[some] - a[some])[inverse], minlength=len(texts)).astype(np.int64)[: len(texts)]
        return n

    def piece(self, piece: str) -> int:
        """Tokens of a piece without white space."""
        if piece in self.words:
            return self.words[piece]
        if "<|" in piece:
            n = len(self.library.encode(piece, add_special_tokens=False).ids)
        elif piece.isascii():
            n = self.word(piece.lower()) if piece.isalpha() else sum(self.word(w if w.isprintable() else "".join([self.letter[ord(c)] for c in w])) for w in _ASCII_SPLIT.findall(piece.lower()))
        else:
            n = sum(self.word(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece)))
        if len(self.words) >= self.most_words:
            self.words.clear()
        if len(piece) < 64:
            self.words[piece] = n
        return n

    def pieces(self, text: str) -> int:
        """Tokens of a text cut at ASCII white space."""
        if text.isascii() and "<|" not in text:
            text = text.lower()  # what the normaliser makes of it
        if any(c in text for c in _SEPARATORS):
            for c in _SPACE[:-1]:
                text = text.replace(c, " ")
            parts = [x for x in text.split(" ") if x]
        else:
            parts = text.split()  # white space beyond ASCII separates words, too
        known, piece = self.words.get, self.piece
        n = 0
        for p in parts:
            k = known(p)
            n += piece(p) if k is None else k
        return n

    def chunk(self, text: str) -> tuple[str, str, str | None]:
        """(head, body, tail): body begins and ends with white space; tail is None if the chunk has none, and then head is the whole chunk."""
        first = next((i for i, c in enumerate(text) if c in _SPACE), -1)
        if first < 0:
            return text, "", None
        last = next(i for i in range(len(text) - 1, -1, -1) if text[i] in _SPACE)
        return text[:first], text[first:last], text[last + 1 :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.pieces(a[2] + b[0]) + b[1], b[2]

    def counts(self, texts: list[str], size: int = CHUNK) -> list[int]:
        """Tokens of each text; long ones by the maps of their chunks."""
        out = [0] * len(texts)
        raw = [t.encode() for t in texts]
        for a, b in chunks(raw, BATCH):
            parts = [(i, *(("", texts[i], "") if len(texts[i]) <= size else self.chunk(texts[i][j : j + size]))) for i in range(a, b) for j in range(0, max(len(texts[i]), 1), size if len(texts[i]) > size else max(len(texts[i]), 1))]
            for p in range(0, len(parts), 1024):
                some = parts[p : p + 1024]
                parts[p : p + 1024] = [(i, head, int(n), tail) for (i, head, _, tail), n in zip(some, self.plain([x[2] for x in some]), strict=True)]
            maps: dict[int, list[tuple]] = {}
            for i, *m in parts:
                maps.setdefault(i, []).append(tuple(m))
            for i, m in maps.items():
                while len(m) > 1:
                    m = [self.compose(*m[k : k + 2]) if k + 1 < len(m) else m[k] for k in range(0, len(m), 2)]
                head, n, tail = m[0]
                out[i] = n + self.pieces(head) + (self.pieces(tail) if tail else 0)
        return out

    def count(self, text: str, size: int = CHUNK) -> int:
        return self.counts([text], size)[0]


def _runs(yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(yes.view(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


_compiled: dict[int, Transducer] = {}


def transducer(source: str) -> Transducer:
    key = hash(source)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(source)
    return _compiled[key]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; tokenizer: path of a tokenizers JSON file, read on the driver.

    Null texts count as empty (0 tokens). Repeated rows and null ids stay as they are. The file's text goes to the workers
    as one broadcast, bounded by the file's size (about 2 MB). A tokenizer outside the compiled class is refused with a ValueError.
    """
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    transducer(text)  # refused here, not in a task
    source = docs.sparkSession.sparkContext.broadcast(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(source.value)
        for batch in it:
            n = t.counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    out = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
