"""Primitive relations that the queries build on: letters, characters, n-grams, sentences, paragraphs, models."""

from __future__ import annotations

from quillspark.functions.dialect import Spark

#: models of the n-gram queries, by the table that they are counted on
MODELS = {"primary": "docs", "human": "user_turns", "wiki": "page_texts", "news": "bench"}


def _letters(x: Spark, source: str) -> str:
    return f"SELECT doc_id, lower({x.sub('text', r'[^\p{L}]')}) AS h FROM {source}"


def relations(x: Spark) -> dict[str, str]:
    """name -> query, in an order in which each uses earlier ones only."""
    n = lambda s: f"CAST(length({x.sub(s, r'[^\p{L}]')}) AS BIGINT)"
    out = {
        "docs": "SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents",
        "user_turns": "SELECT conv_id AS doc_id, coalesce(text, '') AS text FROM conversations WHERE role = 'user'",
        "page_texts": f"SELECT page_id AS doc_id, {x.sub("coalesce(html, '')", '<[^>]*>', ' ')} AS text FROM pages",
        "bench": "SELECT item_id AS doc_id, coalesce(text, '') AS text FROM benchmark",
        "letters": _letters(x, "docs"),
        "sents": x.rows("docs", "doc_id", x.keep(x.map(x.split("text", r"[.!?\n]+"), "trim(x)"), "x <> ''")),
        "slen": f"SELECT doc_id, idx, s, {n('s')} AS n FROM sents",
        "paras": x.rows("docs", "doc_id", x.keep(x.split("text", r"\n"), f"{n('x')} >= 20")),
        "paras30": x.rows("docs", "doc_id", x.keep(x.split("text", r"\n"), f"{n('x')} >= 30")),
        "g1": x.rows("letters", "doc_id", x.chars("h"), "pos, g"),
        "g2": x.rows("letters", "doc_id", x.grams(x.chars("h"), 2), "pos, g"),
        "g3": x.rows("letters", "doc_id", x.grams(x.chars("h"), 3), "pos, g"),
        "pg2": x.rows("paras", "doc_id, idx", x.grams(x.chars(f"lower({x.sub('s', r'[^\p{L}]')})"), 2), "pos, g"),
        "pg3": x.rows("paras", "doc_id, idx", x.grams(x.chars(f"lower({x.sub('s', r'[^\p{L}]')})"), 3), "pos, g"),
    }
    for model, source in MODELS.items():
        out[f"l_{model}"] = _letters(x, source)
        for k in (1, 2, 3):
            out[f"c{k}_{model}"] = f"SELECT g, count(*) AS c FROM ({x.rows(f'l_{model}', 'doc_id', x.grams(x.chars('h'), k), 'pos, g')}) t{k} GROUP BY g"
        out[f"v_{model}"] = f"SELECT greatest(count(*), 1000) AS v, sum(c) AS total FROM c1_{model}"
        # likelihoods of the distinct grams of docs first: four joins of small tables, then one with the positions
        out[f"lp_{model}"] = f"""SELECT a.g, log2(0.6 * (coalesce(t.c, 0) + 0.01) / (coalesce(ab.c, 0) + 0.01 * v) + 0.4 * (coalesce(bc.c, 0) + 0.01) / (coalesce(b.c, 0) + 0.01 * v)) AS lp
            FROM (SELECT g, (SELECT v FROM v_{model}) AS v FROM c3_primary) a LEFT JOIN c3_{model} t ON t.g = a.g LEFT JOIN c2_{model} ab ON ab.g = substr(a.g, 1, 2)
            LEFT JOIN c2_{model} bc ON bc.g = substr(a.g, 2, 2) LEFT JOIN c1_{model} b ON b.g = substr(a.g, 2, 1)"""
        out[f"t_{model}"] = f"SELECT doc_id, pos, g3.g, lp FROM g3 JOIN lp_{model} l ON l.g = g3.g"
    return out
