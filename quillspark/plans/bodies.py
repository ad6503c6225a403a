"""The queries that are one text for both engines, and the texts that they expand to."""

from __future__ import annotations

import re

from quillspark.functions.dialect import Spark
from quillspark.operators import evaluation, segments, statistics, texts

BODIES = statistics.QUERIES | texts.QUERIES | evaluation.QUERIES
TABLES = ("documents", "labels", "conversations", "pages", "benchmark")


def build(name: str, x: Spark, sf_dir: str | None = None, hint: str = "") -> str:
    """The query with the relations that it uses as common table expressions; tables are read from sf_dir, documents with a hint, or taken as registered."""
    body, known = BODIES[name](x), segments.relations(x)
    if sf_dir is not None:
        known = {t: f"SELECT {hint if t == 'documents' else ''} * FROM parquet.`{sf_dir}/{t}.parquet`" for t in TABLES} | known
    need, todo = set(), [body]
    while todo:
        for r in set(re.findall(r"\w+", todo.pop())) & set(known) - need:
            need.add(r)
            todo.append(known[r])
    out = "WITH " + ", ".join(f"{r} AS ({q})" for r, q in known.items() if r in need) + " " + body
    # decimal literals would give decimal sums and averages of few digits
    return re.sub(r"('(?:[^']|'')*')|(?<![\w.])(\d+\.\d+)(?![\w.])", lambda m: m[1] or f"CAST({m[2]} AS DOUBLE)", out)


#: names in BODIES that only serve other queries' SQL
PARTS = ("letter_count", "para_count", "para_sent_n", "unigram_bits", "trigram_bits")
