"""Redaction, duplicates, structure, and keyed green lists of documents, as query texts for both engines."""

from __future__ import annotations

from quillspark.functions.dialect import Spark

GREEN = 0.25


def _dedup(x: Spark) -> str:
    return "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS keep_id, doc_id = min(doc_id) OVER (PARTITION BY sha) AS kept FROM (SELECT doc_id, " + ("sha2" if type(x) is Spark else "sha256") + "(lower(trim(text))" + (", 256" if type(x) is Spark else "") + ") AS sha FROM docs) t"


def _green(x: Spark) -> str:
    """Green tokens by a keyed hash of a character and the four before it: z = (g - gamma T) / sqrt(T gamma (1 - gamma))."""
    grams = x.rows("letters", "doc_id", x.grams(x.chars("h"), 5), "pos, g")
    return f"SELECT doc_id, n, green, round((green - {GREEN} * n) / sqrt(n * {GREEN} * (1 - {GREEN})), 4) AS z FROM (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN substr(md5(concat('key', g)), 1, 1) < '4' THEN 1 ELSE 0 END) AS BIGINT) AS green FROM ({grams}) t GROUP BY doc_id) u"


def _starts(x: Spark) -> str:
    counts = "SELECT doc_id, substr(lower(s), 1, 3) AS g, count(*) AS n FROM sents GROUP BY doc_id, substr(lower(s), 1, 3)"
    return f"SELECT doc_id, CAST(sum(n) AS BIGINT) AS sentences, round(count(*) * 1.0 / sum(n), 4) AS diversity, CAST(max(n) AS BIGINT) AS most FROM ({counts}) t GROUP BY doc_id"


QUERIES = {
    "pii_redact": lambda x: f"SELECT doc_id, {x.sub(x.sub('text', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[EMAIL]'), r'[+]?[0-9][0-9 ()-]{8,}[0-9]', '[PHONE]')} AS redacted FROM docs",
    "length_buckets": lambda x: "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN length(text) < 100 THEN 'under_100' WHEN length(text) < 300 THEN '100_300' WHEN length(text) < 600 THEN '300_600' WHEN length(text) < 1500 THEN '600_1500' ELSE '1500_plus' END AS bucket FROM docs) t GROUP BY bucket",
    "exact_dedup": _dedup,
    "front_matter_strip": lambda x: f"SELECT doc_id, {x.sub('text', r'(?s)^---.*?\n---')} AS body FROM docs",
    "markdown_structure": lambda x: f"SELECT doc_id, count(*) AS lines, CAST(sum(CASE WHEN {x.like('s', r'^(#|- |\* |\*\*.*\*\*$|[0-9]+[.)])')} THEN 1 ELSE 0 END) AS BIGINT) AS structural FROM paras GROUP BY doc_id",
    "numeric_tokens": lambda x: f"SELECT doc_id, {x.join(x.sorted(x.all('text', r'[0-9]+(?:[.,][0-9]+)*%?')), '|')} AS tokens FROM docs",
    "green_list_z": _green,
    "starter_diversity": _starts,
    "duplicate_clauses": lambda x: f"SELECT doc_id, s AS clause, count(*) AS n FROM ({x.rows('docs', 'doc_id', x.keep(x.split('text', r'[,.;!?\n]+'), 'length(x) >= 10'))}) q GROUP BY doc_id, s HAVING count(*) >= 2",
}
