"""Per-document statistics: lengths, densities, entropies, n-gram likelihoods and their derived features."""

from __future__ import annotations

from quillspark.functions.dialect import Spark
from quillspark.operators.guards import EMOJI


def entropy(keys: str, source: str) -> str:
    """(keys, h): Shannon entropy in bits of the grams g."""
    k = keys.split(", ")
    on = ", ".join(k)
    return f"""SELECT {on}, sum(n) AS total, -sum(n / w * log2(n / w)) AS h FROM
        (SELECT {on}, n, CAST(sum(n) OVER (PARTITION BY {on}) AS DOUBLE) AS w FROM (SELECT {on}, g, count(*) AS n FROM {source} GROUP BY {on}, g) e1) e2 GROUP BY {on}"""


def _punct(x: Spark) -> str:
    n = f"nullif({x.count('text', r'\S')}, 0)"
    return f"SELECT doc_id, coalesce(round(100.0 * {x.count('text', '[,，]')} / {n}, 4), 0) AS comma_density, coalesce(round(100.0 * {x.count('text', r'''[，。、；：！？（）「」『』“”‘’"'.,:;!?()\[\]{}《》—…·]''')} / {n}, 4), 0) AS punct_density FROM docs"


def _moments(_: Spark) -> str:
    return """SELECT doc_id, n, CASE WHEN n < 16 OR m2 < 1e-12 THEN 0 ELSE round(m3 / power(m2, 1.5), 4) END AS skew, CASE WHEN n < 16 OR m2 < 1e-12 THEN 0 ELSE round(m4 / (m2 * m2) - 3, 4) END AS kurt FROM
        (SELECT doc_id, count(*) AS n, avg((lp - m) * (lp - m)) AS m2, avg(power(lp - m, 3)) AS m3, avg(power(lp - m, 4)) AS m4
         FROM (SELECT t.doc_id, lp, m FROM t_primary t JOIN (SELECT doc_id, avg(lp) AS m FROM t_primary GROUP BY doc_id) a ON a.doc_id = t.doc_id) b GROUP BY doc_id) c"""


def _autocorrelation(_: Spark) -> str:
    lags = (1, 2, 4, 8)
    cols = ", ".join(f"CASE WHEN n <= {k + 2} OR v < 1e-12 THEN 0 ELSE round(s{k} / v, 4) END AS lag{k}" for k in lags)
    sums = ", ".join(f"coalesce(sum(d * d{k}), 0) AS s{k}" for k in lags)
    shifts = ", ".join(f"lag(d, {k}) OVER (PARTITION BY doc_id ORDER BY pos) AS d{k}" for k in lags)
    return f"""SELECT doc_id, {cols} FROM (SELECT doc_id, count(*) AS n, sum(d * d) AS v, {sums} FROM (SELECT doc_id, d, {shifts} FROM
        (SELECT t.doc_id, pos, lp - m AS d FROM t_primary t JOIN (SELECT doc_id, avg(lp) AS m FROM t_primary GROUP BY doc_id) a ON a.doc_id = t.doc_id) b) c GROUP BY doc_id) e"""


def _windows(_: Spark) -> str:
    return """SELECT doc_id, count(*) AS n_windows, CASE WHEN count(*) < 3 THEN 0 ELSE round(stddev_pop(ppl) / avg(ppl), 4) END AS burst FROM
        (SELECT doc_id, pos, power(2, -m) AS ppl FROM (SELECT doc_id, pos, n, avg(lp) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS m
         FROM (SELECT doc_id, pos, lp, count(*) OVER (PARTITION BY doc_id) AS n FROM t_primary) a) b WHERE pos % 25 = 0 AND pos <= n - 50) c GROUP BY doc_id"""


def _buckets(_: Spark) -> str:
    return """SELECT g2.doc_id, CAST(sum(CASE WHEN r <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS top10, CAST(sum(CASE WHEN r > 10 AND r <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS top100, CAST(sum(CASE WHEN r > 100 AND r <= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS top1000,
        CAST(sum(CASE WHEN r > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS beyond FROM g2 JOIN (SELECT g, row_number() OVER (PARTITION BY substr(g, 1, 1) ORDER BY c DESC, g) AS r FROM c2_primary) k ON k.g = g2.g GROUP BY g2.doc_id HAVING count(*) >= 29"""


def _sentence_length(_: Spark) -> str:
    shares = ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 4) AS {a}" for c, a in (("n < 10", "short_frac"), ("n > 30", "long_frac"), ("n BETWEEN 15 AND 25", "mid_frac")))
    return f"SELECT doc_id, count(*) AS n, round(avg(n), 4) AS mean_len, round(stddev_pop(n) / avg(n), 4) AS cv, {shares} FROM slen WHERE n >= 3 GROUP BY doc_id HAVING count(*) >= 3"


def _inner(x: Spark) -> str:
    """Letters of the sentences of long paragraphs, of documents that have three of them."""
    return f"SELECT u.doc_id, u.idx, {x.count('s', r'\p{L}')} AS n FROM ({x.rows('paras30', 'doc_id, idx', x.split('s', '[.!?]+'), 'j, s')}) u JOIN (SELECT doc_id FROM paras30 GROUP BY doc_id HAVING count(*) >= 3) k ON k.doc_id = u.doc_id"


QUERIES = {
    "paragraph_stats": lambda x: f"SELECT doc_id, count(*) AS n_para, CASE WHEN count(*) < 3 THEN 0 ELSE round(stddev_pop(n) / avg(n), 4) END AS cv FROM (SELECT doc_id, {x.count('s', r'\p{L}')} AS n FROM paras) t GROUP BY doc_id",
    "sentence_length": _sentence_length,
    "punct_density": _punct,
    "bigram_entropy": lambda x: f"SELECT doc_id, CASE WHEN total < 9 THEN 5.0 ELSE round(h, 4) END AS entropy FROM ({entropy('doc_id', 'g2')}) t",
    "mattr": lambda x: f"SELECT doc_id, coalesce(round({x.mean('w')}, 4), 0) AS mattr FROM (SELECT doc_id, {x.windows('a', 100, 50)} AS w FROM (SELECT doc_id, {x.chars('h')} AS a FROM letters) s) t",
    "para_entropy_cv": lambda x: f"SELECT doc_id, CASE WHEN count(*) < 3 OR avg(h) < 1e-9 THEN 0 ELSE round(stddev_pop(h) / avg(h), 4) END AS value FROM ({entropy('doc_id, idx', 'pg2')}) t GROUP BY doc_id",
    "cross_para_trigram": lambda x: "SELECT doc_id, CASE WHEN max(ps) < 3 THEN 0 ELSE round(avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END), 4) END AS value FROM (SELECT q.doc_id, g, count(*) AS n, max(k) AS ps FROM (SELECT DISTINCT doc_id, idx, g FROM pg3) q JOIN (SELECT doc_id, count(DISTINCT idx) AS k FROM pg3 GROUP BY doc_id) z ON z.doc_id = q.doc_id GROUP BY q.doc_id, g) t GROUP BY doc_id",
    "para_sent_cv": lambda x: f"SELECT doc_id, round(avg(cv), 4) AS value FROM (SELECT doc_id, idx, stddev_pop(n) / avg(n) AS cv FROM ({_inner(x)}) v WHERE n >= 5 GROUP BY doc_id, idx HAVING count(*) >= 3) t GROUP BY doc_id HAVING count(*) >= 2",
    "ngram_train": lambda x: "SELECT 1 AS n, g AS gram, c AS cnt FROM c1_primary UNION ALL SELECT 2, g, c FROM c2_primary UNION ALL SELECT 3, g, c FROM c3_primary",
    "perplexity": lambda x: "SELECT doc_id, round(avg(lp), 4) AS avg_lp, round(power(2, -avg(lp)), 3) AS ppl FROM t_primary GROUP BY doc_id",
    "ppl_windows_burstiness": _windows,
    "gltr_buckets": _buckets,
    "surprisal_moments": _moments,
    "surprisal_autocorr": _autocorrelation,
    "dual_model_diff": lambda x: "SELECT p.doc_id, round(avg(p.lp - h.lp), 4) AS d_human, round(avg(w.lp - h.lp), 4) AS d_wiki_human, round(avg(p.lp - w.lp), 4) AS d_primary_wiki, round(avg(n.lp - h.lp), 4) AS d_news_human, round(avg(n.lp - w.lp), 4) AS d_news_wiki FROM t_primary p JOIN t_human h ON h.doc_id = p.doc_id AND h.pos = p.pos JOIN t_wiki w ON w.doc_id = p.doc_id AND w.pos = p.pos JOIN t_news n ON n.doc_id = p.doc_id AND n.pos = p.pos GROUP BY p.doc_id",
    "emoji_strip": lambda x: f"SELECT doc_id, {x.sub('text', '[' + EMOJI + ']+')} AS body FROM docs",
    "unigram_bits": lambda x: "SELECT doc_id, -avg(log2((c + 0.01) / (total + 0.01 * v))) AS l FROM (SELECT g1.doc_id, c, (SELECT v FROM v_primary) AS v, (SELECT total FROM v_primary) AS total FROM g1 JOIN c1_primary k ON k.g = g1.g) t GROUP BY doc_id",
    "trigram_bits": lambda x: "SELECT doc_id, avg(lp) AS l FROM t_primary GROUP BY doc_id",
    "letter_count": lambda x: "SELECT doc_id, length(h) AS n FROM letters",
    "para_count": lambda x: "SELECT doc_id, count(*) AS np FROM paras GROUP BY doc_id",
    "para_sent_n": lambda x: f"SELECT doc_id, count(*) AS psn FROM (SELECT doc_id, idx FROM ({_inner(x)}) v WHERE n >= 5 GROUP BY doc_id, idx HAVING count(*) >= 3) t GROUP BY doc_id",
}
