"""Scores of document groups: separation, reports, margins. labels.quality stands in for the reference's human and model labels."""

from __future__ import annotations

from quillspark.functions.dialect import Spark

#: (doc_id, lang, source, y, score): one simple score, the letters' share of all characters times 100
SCORED = "(SELECT d.doc_id, lang, source, quality AS y, CAST(length(text) AS DOUBLE) AS chars, CASE WHEN length(text) = 0 THEN 0 ELSE 100.0 * length(h) / length(text) END AS score FROM docs d JOIN letters ON letters.doc_id = d.doc_id JOIN labels ON labels.doc_id = d.doc_id WHERE quality IS NOT NULL) sc"
BAND = "CASE WHEN score >= 83 THEN 'very_high' WHEN score >= 81 THEN 'high' WHEN score >= 79 THEN 'medium' ELSE 'low' END"
def _d(kind: str) -> str:
    m, v = "max(CASE WHEN y = 1 THEN m END) - max(CASE WHEN y = 0 THEN m END)", {"d_pop": "sqrt((max(CASE WHEN y = 1 THEN vp END) + max(CASE WHEN y = 0 THEN vp END)) / 2)", "d_pooled": "sqrt(sum((n - 1) * vs) / (sum(n) - 2))"}
    return f"round(({m}) / nullif({v[kind]}, 0), 4) AS {kind}"


def _auc(source: str = SCORED, more: str = "") -> str:
    """Rank sums over distinct scores: ties are counted together, and the ranks below a score are the sums of whole bins of a
    hundredth (10,001 at most) and those within its own bin, so no task sorts all rows."""
    s = f"(SELECT score, CAST(floor(score * 100) AS BIGINT) AS bin, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n1 FROM {source} GROUP BY score)"
    bins = f"(SELECT bin, sum(m) OVER (ORDER BY bin) - m AS below FROM (SELECT bin, sum(n0) AS m FROM {s} s1 GROUP BY bin) s2)"
    within = f"(SELECT bin, n0, n1, sum(n0) OVER (PARTITION BY bin ORDER BY score) - n0 AS within FROM {s} s3)"
    return f"SELECT CAST(sum(n0 + n1) AS BIGINT) AS n, {more}round(sum(n1 * (below + within + n0 / 2.0)) / nullif(CAST(sum(n0) AS DOUBLE) * sum(n1), 0), 6) AS auc FROM {within} a JOIN {bins} b ON b.bin = a.bin"


def _matched(x: Spark) -> str:
    """AUC over the overlap of both classes' lengths; null with fewer than 15 rows on a side."""
    band = f"(SELECT max(a) AS lo, min(b) AS hi FROM (SELECT min(chars) AS a, max(chars) AS b FROM {SCORED} GROUP BY y) u)"
    inside = f"(SELECT * FROM {SCORED} WHERE chars >= (SELECT lo FROM {band} v) AND chars <= (SELECT hi FROM {band} w)) m"
    more = "CAST(sum(n1) AS BIGINT) AS n_pos, CAST(sum(n0) AS BIGINT) AS n_neg, "
    return f"SELECT n_pos, n_neg, CASE WHEN n_pos >= 15 AND n_neg >= 15 THEN auc END AS auc FROM ({_auc(inside, more)}) t"


def _hashed(x: Spark) -> str:
    return f"md5(CAST(doc_id AS {'STRING' if type(x) is Spark else 'VARCHAR'})), doc_id"


def _layers(_: Spark) -> str:
    """The AUC of each layer: the letters' share and the length (per mille of 20,000 characters)."""
    length = SCORED.replace("CASE WHEN length(text) = 0 THEN 0 ELSE 100.0 * length(h) / length(text) END", "least(100.0, length(text) / 200.0)")
    return f"SELECT 'letters' AS layer, n, auc FROM ({_auc()}) a1 UNION ALL SELECT 'length', n, auc FROM ({_auc(length)}) a2"


QUERIES = {
    "auc_rank": lambda x: _auc(),
    "length_matched_auc": _matched,
    "cohens_d": lambda x: f"SELECT {_d('d_pop')}, {_d('d_pooled')}, -({_d('d_pooled').split(' AS ')[0]}) AS d_human_minus_ai FROM (SELECT y, count(*) AS n, avg(score) AS m, var_pop(score) AS vp, var_samp(score) AS vs FROM {SCORED} GROUP BY y) t",
    "fpr_curve": lambda x: f"SELECT threshold, round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END), 4) AS share FROM ({x.rows(f'(SELECT score FROM {SCORED} WHERE y = 0) z', 'score', 'array(76, 78, 80, 82, 84)' if type(x) is Spark else '[76, 78, 80, 82, 84]', 'i, threshold')}) t GROUP BY threshold",
    "band_dist": lambda x: f"SELECT y, {BAND} AS band, count(*) AS n FROM {SCORED} GROUP BY y, {BAND}",
    "group_report": lambda x: f"SELECT lang, count(*) AS n, round(avg(chars), 3) AS mean_chars, round(avg(score), 4) AS mean, round(median(score), 4) AS median, round(stddev_samp(score), 4) AS sd, round(min(score), 4) AS least, round(max(score), 4) AS most FROM {SCORED} GROUP BY lang",
    "scene_model_cube": lambda x: f"SELECT lang, source, CAST(grouping(lang) * 2 + grouping(source) AS INTEGER) AS gid, count(*) AS n, round(avg(score), 4) AS mean FROM {SCORED} GROUP BY CUBE (lang, source)",
    "grouping_report": lambda x: f"SELECT lang, source, count(*) AS n, round(avg(score), 4) AS mean FROM {SCORED} GROUP BY GROUPING SETS ((lang), (source), ())",
    "balanced_sample": lambda x: f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_hashed(x)}) AS rn FROM docs) t WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM docs GROUP BY lang) q)",
    "standardize": lambda x: f"SELECT feature, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 1), 4) AS sd FROM (SELECT 'score' AS feature, score AS v FROM {SCORED} UNION ALL SELECT 'chars', chars FROM {SCORED}) t GROUP BY feature",
    "accuracy": lambda x: f"SELECT round(avg(CASE WHEN (score >= 80) = (y = 1) THEN 1.0 ELSE 0.0 END), 4) AS accuracy, count(*) AS n FROM {SCORED}",
    "style_report": lambda x: f"SELECT lang, count(*) AS n, round(avg(comma), 4) AS comma_density, round(avg(score), 4) AS mean_score, CAST(sum(CASE WHEN score >= 83 THEN 1 ELSE 0 END) AS BIGINT) AS very_high FROM (SELECT lang, CASE WHEN length(text) = 0 THEN 0 ELSE 100.0 * length(h) / length(text) END AS score, CASE WHEN length(text) = 0 THEN 0 ELSE 100.0 * {x.count('text', ',')} / length(text) END AS comma FROM docs JOIN letters ON letters.doc_id = docs.doc_id) t GROUP BY lang",
    "layer_auc": _layers,
    "class_balance": lambda x: f"SELECT doc_id, y FROM (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY {_hashed(x)}) AS rn FROM {SCORED}) t WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {SCORED} GROUP BY y) q)",
    "stratified_split": lambda x: f"SELECT y, CASE WHEN holdout THEN 'holdout' ELSE 'train' END AS part, count(*) AS n FROM (SELECT y, row_number() OVER (PARTITION BY y ORDER BY {_hashed(x)}) * 5 <= count(*) OVER (PARTITION BY y) AS holdout FROM {SCORED}) t GROUP BY y, holdout",
    "job_grid": lambda x: "SELECT lang, source FROM (SELECT lang, source FROM (SELECT DISTINCT lang FROM docs) a CROSS JOIN (SELECT DISTINCT source FROM docs) b) g WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lang AS l, source AS s FROM docs WHERE length(text) > 2000) d WHERE d.l = g.lang AND d.s = g.source)",
    "pair_summary": lambda x: f"SELECT lang, count(*) AS n, round(avg(CASE WHEN h < a THEN 1.0 ELSE 0.0 END), 4) AS correct_rate, round(avg(a - h), 4) AS gap FROM (SELECT lang, avg(CASE WHEN y = 0 THEN score END) AS h, avg(CASE WHEN y = 1 THEN score END) AS a FROM {SCORED} GROUP BY lang, source) t WHERE h IS NOT NULL AND a IS NOT NULL GROUP BY lang",
    "verdict_bands": lambda x: f"SELECT CASE WHEN auc >= 0.9 THEN 'strong' WHEN auc >= 0.75 THEN 'useful' WHEN auc >= 0.65 THEN 'weak' ELSE 'none' END AS verdict, n FROM ({_auc()}) t",
}
