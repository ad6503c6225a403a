"""Secret scans: three fixed patterns, plus strings that a dictionary-primed zstandard model can't compress.

A candidate is a long mixed string shortly after a sensitive word. Its novelty is the number of bytes that it adds to the
compressed size of the text before it, with the text around it and a dictionary of code identifiers as the compressor's
dictionary, less the candidate's own copies there, so that a repeated secret doesn't vouch for itself. Words and paths add few
bytes; random strings add nearly their entropy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.util import table, text_bytes

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")  # the pattern's runs are maximal: shorter ones fail as a whole
_HEX = re.compile(rb"[0-9a-f]{16,}")
_CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_SENSITIVE = re.compile(rb"(?i:secret|token|passw|pwd|credential|private.?key|access.?key|api.?key|auth|bearer|signature)[^\n]{0,40}$")
IDENTIFIERS = (
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    b"password passwd secret token api_key apikey access_key private_key client_id client_secret authorization bearer "
    b"config default example placeholder changeme your_token_here username database connection string localhost "
    b"import return function class public static void const var let self None true false null undefined "
    b"application authentication authorization certificate character collection column command component connection container "
    b"controller conversion dependency description destination development directory document documentation element encryption "
    b"environment exception execution expiration expression extension generation identifier identifiers identification implementation "
    b"information initialization initialize instance integration interface international internationalization_of_language localization location "
    b"management manager message metadata method migration module network notification number object operation operator option parameter "
    b"partition permission platform position previous process production property protocol provider publication reference registration "
    b"repository resource schedule schema security selection sequence serialization server service session signature specification "
    b"standard statement storage structure subscription template temporary transaction transformation translation validation variable version "
    b"get_value set_value user_name file_path request response http https www com org index html json xml "
)
SHORTEST, BITS_PER_CHAR = 16, 6.4  # random letters and digits measure 7 to 8, strings of known words 2 to 6.5


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the fixed patterns, by start, then by the order of KINDS."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def novelty(candidate: bytes, before: bytes, after: bytes, identifiers: bytes = IDENTIFIERS) -> int:
    """Compressed bytes that the candidate adds to the text before it, primed with identifiers and the text around it."""
    primed = zstandard.ZstdCompressionDict(identifiers + after + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda x: len(zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False).compress(x))
    return size(before[-64:] + candidate) - size(before[-64:])


def _around(text: bytes, a: int, b: int, context: int) -> tuple[bytes, bytes]:
    """The text before and after text[a:b], without copies of it, those that the ends of the context cut included."""
    s, lo, hi = text[a:b], max(0, a - context), b + context
    at = text.rfind(s, max(0, lo - len(s) + 1), min(lo + len(s) - 1, a))
    lo = at + len(s) if at >= 0 else lo
    at = text.find(s, max(b, hi - len(s) + 1), hi + len(s) - 1)
    return text[lo:a].replace(s, b""), text[b : at if at >= 0 else hi].replace(s, b"")


def novel_spans(text: bytes, taken: list[tuple[int, int, str]], context: int = 2048, least_bits: float = BITS_PER_CHAR) -> list[tuple[int, int, str]]:
    """Byte spans of incompressible strings shortly after a sensitive word, apart from those taken already."""
    out, at, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text) if _SENSITIVE_WORD.search(text) else ():
        a, b = m.span()
        s = m[0]
        while at < len(taken) and taken[at][0] < b:  # both are in order: what begins before b, and how far it reaches
            reach, at = max(reach, taken[at][1]), at + 1
        if not (re.search(rb"[0-9]", s) and re.search(rb"[A-Za-z]", s)) or reach > a or not _SENSITIVE.search(text[max(0, a - 64) : a]):
            continue
        if 8 * novelty(s, *_around(text, a, b, context)) >= least_bits * len(s):
            out.append((a, b, "novel"))
    return out


_SENSITIVE_WORD = re.compile(rb"(?i:secret|token|passw|pwd|credential|key|auth|bearer|signature)")


def all_spans(text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = base_spans(text)
    novel = novel_spans(text, base)
    return base, sorted(base + novel, key=lambda x: (x[0], KINDS.index(x[2]))) if novel else base


def _points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte spans, in order of their starts, as code-point spans; no byte before the last start is decoded twice."""
    if not spans or text.isascii():
        return spans
    out, seen, points = [], 0, 0
    for a, b, k in spans:
        points, seen = points + len(text[seen:a].decode()), a
        out.append((points, points + len(text[a:b].decode()), k))
    return out


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        n, digest, written = {k: [] for k in KINDS}, [], []
        for text in batch.column(1).to_pylist():
            base, spans = all_spans(text)
            for k in KINDS:
                n[k].append(sum(x[2] == k for x in spans))
            own = _written(_points(text, base))
            digest.append(hashlib.sha256(own.encode()).hexdigest())
            written.append(own if spans is base else _written(_points(text, spans)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()), pa.array(written, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) for every row; spans are kind:start:end in code points.

    Null texts count as empty: no spans, and the digest of the empty string. Repeated rows and null ids stay.
    """
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span, base and novel, replaced by mark (overlapping spans by one), n_chars counted anew.

    Texts without spans, nulls included, stay as they are, and so do all other columns.
    """
    filler = mark.encode()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, out = batch.schema.get_field_index("text"), []
            for text in batch.column(at).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                raw, last, kept = text.encode(), 0, []
                for a, b, _ in all_spans(raw)[1]:
                    if a >= last:
                        kept += [raw[last:a], filler]
                    last = max(last, b)
                out.append((b"".join(kept) + raw[last:]).decode() if kept else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    clean = docs.mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else clean


def op7_secrets(spark, sf_dir):
    return secret_spans(table(spark, sf_dir, "documents"))
