"""DuckDB SQL for the queries of plans/tables.py, written apart from the Spark code: joins with word tables, unnested rows and grouped counts."""

from __future__ import annotations

from quillspark.functions.dialect import DuckDB
from quillspark.functions.text import SPACE
from quillspark.operators import guards, hygiene, scoring
from quillspark.plans.bodies import build
from quillspark.sources import fixtures as fx
from quillspark.sources import lexicons

LEX = lexicons.DEFAULT
_D = DuckDB()


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rows(items: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in items) + f") AS v({names})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def times(t: str, phrase: str) -> str:
    """Occurrences of a phrase that is an SQL expression."""
    return f"CAST((length({t}) - length(replace({t}, {phrase}, ''))) // length({phrase}) AS INTEGER)"


def counted(t: str) -> str:
    """The characters that count."""
    return f"CASE WHEN regexp_matches({t}, '[一-鿿]') THEN regexp_replace({t}, '[^一-鿿]', '', 'g') ELSE regexp_replace({t}, '[^\\p{{L}}]', '', 'g') END"


def found(t: str, pattern: str, dotall: bool = False) -> str:
    return f"regexp_extract_all({t}, {lit(('(?s)' if dotall else '') + pattern)})"


_HAN = "SELECT -doc_id AS doc_id, text AS t FROM " + rows(list(fx.HAN), "doc_id, text")


def base(text: str = "t") -> str:
    """The common tables over documents and the fixture, each text being an expression on t."""
    return f"""texts AS (SELECT doc_id, {text} AS t FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents UNION ALL {_HAN})),
base AS (SELECT doc_id, t, regexp_matches(t, '[一-鿿]') AS han, {counted("t")} AS h, length({counted("t")}) AS n FROM texts),
ent AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(list_zip(string_split(lower(h), '')[1:length(h) - 1], string_split(lower(h), '')[2:]), lambda z: z[1] || z[2])) AS g FROM base WHERE length(h) >= 10) GROUP BY doc_id, g) GROUP BY doc_id),
pieces AS (SELECT doc_id, han, unnest(range(len(a))) AS idx, unnest(a) AS p FROM (SELECT doc_id, han, CASE WHEN han THEN regexp_extract_all(t, '[^。！？\\n]*[。！？\\n]|[^。！？\\n]+') ELSE regexp_extract_all(t, '[^.!?。！？\\n]*[.!?。！？\\n]|[^.!?。！？\\n]+') END AS a FROM base)),
bodies AS (SELECT doc_id, idx, regexp_extract(p, CASE WHEN han THEN '[。！？\\n]$' ELSE '[.!?。！？\\n]$' END) AS e, p, han FROM pieces),
sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx, s FROM (SELECT doc_id, idx, {strip("left(p, length(p) - length(e))")} || e AS s, {strip("left(p, length(p) - length(e))")} AS b FROM bodies) WHERE b <> '' AND length(s) > 1),
sized AS (SELECT doc_id, idx, s, length({counted("s")}) AS n FROM sents),
blocks AS (SELECT doc_id, unnest(range(len(a))) AS idx, {strip("unnest(a)")} AS p FROM (SELECT doc_id, CASE WHEN han THEN string_split_regex(t, '\\n[ \\t\\r]*\\n+') ELSE string_split_regex(t, '\\n+') END AS a FROM base)),
paras AS (SELECT doc_id, idx, p FROM blocks WHERE length(p) > 20),
starts AS (SELECT doc_id, g, count(*) AS c, min(idx) AS pos FROM (SELECT doc_id, idx, left({strip("s")}, 2) AS g FROM sents WHERE length({strip("s")}) >= 2 AND NOT regexp_matches({strip("s")}, '^(#|- |\\* |\\*\\*|[0-9]+[.。．)）])')) GROUP BY doc_id, g)"""


BASE = base()


def _spread(source: str, value: str, least: int, below: float, strict: bool = True) -> str:
    return f"SELECT doc_id FROM {source} GROUP BY doc_id HAVING count(*) {'>' if strict else '>='} {least} AND avg({value}) > 0 AND stddev_pop({value}) / avg({value}) < {below}"


def _any(category: str, severity: str, patterns: list[str], width: int, dotall: bool) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{category}' AS category, '{severity}' AS severity, left(unnest({found('t', p, dotall)}), {width}) AS text, 1 AS cnt FROM base" for p in patterns)


def _words(items: list[tuple[str, str, str]]) -> str:
    return f"SELECT doc_id, category, severity, w AS text, {times('t', 'w')} AS cnt FROM base, {rows(items, 'category, severity, w')} WHERE contains(t, w)"


def _sum(words: list[str], t: str = "t") -> str:
    return "(" + " + ".join(times(t, lit(w)) for w in words) + ")"


def _one(category: str, severity: str, text: str, source: str, cnt: str = "1") -> str:
    return f"SELECT doc_id, '{category}', '{severity}', '{text}', {cnt} FROM {source}"


def issues() -> str:
    words = [(c, s, w) for c, s in (("mechanical_connectors", "critical"), ("empty_grand_words", "critical"), ("ai_high_freq_words", "high"), ("filler_phrases", "high")) for w in LEX[c]]
    density = f"{_sum(LEX['emotional_words'] + LEX['personal_markers'])} / n * 100"
    parts = [
        _any("three_part_structure", "critical", LEX["critical_regex"], 60, True), _words(words), _any("balanced_arguments", "high", LEX["balanced_arguments"], 80, True), _any("template_sentences", "high", LEX["template_sentences"], 60, False),
        _one("hedging_language", "medium", "hedges", f"base WHERE {_sum(LEX['hedging'])} >= 5", _sum(LEX["hedging"])),
        *[f"SELECT doc_id, 'list_addiction', 'medium', 'list', 1 FROM (SELECT doc_id, unnest({found('t', p)}) AS m FROM base)" for p in LEX["list_patterns"]],
        _one("punctuation_overuse", "medium", "dash", f"base WHERE n > 0 AND {times('t', lit('—'))} / n * 100 > 1.0"), _one("punctuation_overuse", "medium", "semicolon", f"base WHERE n > 0 AND {times('t', lit('；'))} / n * 100 > 0.5"),
        _one("excessive_rhetoric", "medium", "parallel", f"base WHERE len({found('t', LEX['parallel_pattern'])}) > 2"),
        _one("uniform_paragraphs", "style", "paragraph length", f"({_spread('paras', 'length(p)', 3, 0.2, False)})"), _one("low_burstiness", "style", "sentence length", f"({_spread('sized', 'n', 5, 0.25)})"),
        _one("emotional_flatness", "style", "emotional density", f"base WHERE n > 300 AND {density} < 0.15"),
        "SELECT s.doc_id, 'repetitive_starters', 'style', arg_max(g, {'c': c, 'a': -pos}), 1 FROM starts s JOIN (SELECT doc_id FROM sents GROUP BY doc_id HAVING count(*) > 5) k ON k.doc_id = s.doc_id GROUP BY s.doc_id HAVING max(c) >= 3",
        _one("low_entropy", "style", "entropy", "(SELECT doc_id FROM base JOIN ent USING (doc_id) WHERE n > 200 AND entropy < 6.0)"),
    ]
    return "issues AS (" + " UNION ALL ".join(parts) + ")"


METRICS = f"""metrics AS (SELECT b.doc_id, n AS char_count, coalesce(sn, 0) AS sentence_count, coalesce(pn, 0) AS paragraph_count, CASE WHEN n > 200 THEN entropy END AS entropy,
  CASE WHEN n > 0 THEN {_sum(LEX["emotional_words"] + LEX["personal_markers"])} / n * 100 ELSE 0 END AS emotional_density FROM base b LEFT JOIN ent USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS sn FROM sents GROUP BY doc_id) s USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS pn FROM paras GROUP BY doc_id) p USING (doc_id))"""


def _case(table: dict, key: str, other: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


def _level(c: str) -> str:
    return f"CASE WHEN {c} >= 75 THEN 'very_high' WHEN {c} >= 50 THEN 'high' WHEN {c} >= 25 THEN 'medium' ELSE 'low' END"


def flags() -> str:
    """`flags`: the indicators as 0/1 columns, for documents, from the statistics' own SQL."""
    q = {k: build(k, _D) for k in ("perplexity", "ppl_windows_burstiness", "para_entropy_cv", "surprisal_moments", "gltr_buckets", "sentence_length", "punct_density", "para_sent_cv", "letter_count", "para_count", "para_sent_n")}
    c = {
        "low_perplexity": "ppl > 50 AND ppl < 500 AND n >= 200", "low_burstiness": "coalesce(burst, 0) < 0.12 AND coalesce(n_windows, 0) >= 6", "uniform_entropy": "coalesce(pe, 0) < 0.05 AND coalesce(np, 0) >= 3", "low_surprisal_skew": "coalesce(skew, 0) < 1.35 AND n >= 150",
        "low_surprisal_kurt": "coalesce(kurt, 0) < 0.35 AND n >= 150", "high_top10_bucket": "top10 / (top10 + top100 + top1000 + beyond) > 0.21 AND n >= 150", "low_sentence_length_cv": "cv < 0.40 AND sn >= 5",
        "low_short_sentence_fraction": "short_frac < 0.08 AND sn >= 5", "low_comma_density": "comma_density < 4.5 AND n >= 100", "high_transition_density": "false", "high_curvature": "false", "low_binoculars_diff": "false", "low_char_mattr": "false",
        "low_para_sent_len_cv": "ps > 0 AND ps < 0.35 AND psn >= 2",
    }
    cols = ", ".join(f"CASE WHEN n >= 30 AND ({c[k]}) THEN 1 ELSE 0 END AS {k}" for k in scoring.INDICATORS)
    return f"""flags AS (SELECT l.doc_id, {cols} FROM ({q["letter_count"]}) l LEFT JOIN ({q["perplexity"]}) a USING (doc_id) LEFT JOIN ({q["ppl_windows_burstiness"]}) b USING (doc_id)
      LEFT JOIN (SELECT doc_id, value AS pe FROM ({q["para_entropy_cv"]})) e USING (doc_id) LEFT JOIN (SELECT doc_id, np FROM ({q["para_count"]})) k USING (doc_id) LEFT JOIN (SELECT doc_id, skew, kurt FROM ({q["surprisal_moments"]})) m USING (doc_id)
      LEFT JOIN ({q["gltr_buckets"]}) g USING (doc_id) LEFT JOIN (SELECT doc_id, n AS sn, cv, short_frac FROM ({q["sentence_length"]})) s USING (doc_id) LEFT JOIN ({q["punct_density"]}) d USING (doc_id)
      LEFT JOIN (SELECT doc_id, value AS ps FROM ({q["para_sent_cv"]})) r USING (doc_id) LEFT JOIN (SELECT doc_id, psn FROM ({q["para_sent_n"]})) t USING (doc_id))"""


def _stats(weights: dict) -> str:
    return "(SELECT doc_id, least(40, " + " + ".join(f"{v} * {k.removeprefix('stat_')}" for k, v in weights.items()) + ") AS stat_part FROM flags)"


def rule_score() -> str:
    return f"""WITH {BASE}, {issues()}, {METRICS}, {flags()},
    s AS (SELECT m.doc_id, m.char_count, m.entropy, m.emotional_density, CAST(least(60, trunc(coalesce(r, 0))) AS INTEGER) AS rule_part, CAST(coalesce(CASE WHEN m.char_count >= 100 THEN stat_part END, 0) AS INTEGER) AS stat_part FROM metrics m
      LEFT JOIN (SELECT doc_id, sum({_case(LEX["severity_weights"], "severity", 2)} * least(cnt, 5)) AS r FROM issues GROUP BY doc_id) i USING (doc_id) LEFT JOIN {_stats(LEX["statistical_weights"])} f USING (doc_id)),
    z AS (SELECT doc_id, rule_part, stat_part, CAST(least(100, rule_part + stat_part + CASE WHEN emotional_density < 0.1 AND char_count > 500 THEN 5 ELSE 0 END + CASE WHEN entropy < 5.5 THEN 5 ELSE 0 END) AS INTEGER) AS score FROM s)
    SELECT doc_id, rule_part, stat_part, score, {_level("score")} AS level FROM z"""


def worst() -> str:
    words = [w for c in ("mechanical_connectors", "empty_grand_words", "ai_high_freq_words", "filler_phrases") for w in LEX[c]]
    hits = f"SELECT doc_id, idx, s, 3 AS p FROM sents, {rows([(w,) for w in words], 'w')} WHERE contains(s, w)" + "".join(f" UNION ALL SELECT doc_id, idx, s, 5 FROM sents WHERE regexp_matches(s, {lit(p)})" for p in LEX["critical_regex"] + LEX["template_sentences"])
    return f"WITH {BASE}, hits AS ({hits}), x AS (SELECT doc_id, idx, s, CAST(sum(p) AS INTEGER) AS score FROM hits GROUP BY ALL) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS INTEGER) AS rnk, score, left(s, 80) AS sent FROM x QUALIFY rnk <= 5"


def academic() -> str:
    tail = "t[CAST(floor(length(t) * 0.8) AS INTEGER) + 1:]"
    con, cer, hed = _sum(LEX["logic_connectors"]), _sum(LEX["certainty"]), _sum(LEX["academic_hedges"])
    tmpl = "(" + " + ".join(f"len({found('t', p)})" for p in LEX["citation_templates"]) + ")"
    perfect = "(" + " + ".join(f"CASE WHEN regexp_matches({tail}, {lit(p)}) THEN 1 ELSE 0 END" for p in LEX["perfect_conclusions"]) + ")"
    limited = " OR ".join(f"contains({tail}, {lit(w)})" for w in LEX["limitations"])
    first = f"{strip("CASE WHEN contains(p, '。') THEN string_split(p, '。')[1] ELSE left(p, 50) END")}"
    opener = " OR ".join(f"regexp_matches({first}, {lit(o.replace(chr(92) + 'S', f'[^{SPACE}]'))})" for o in LEX["paragraph_openers"])
    passives = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, unnest(range(len({found('t', p)}))) AS j, left(unnest({found('t', p)}), 40) AS text FROM base" for i, p in enumerate(LEX["passive_patterns"]))
    cites = f"len({found('t', LEX['citation'])})"
    parts = [
        _words([("ai_academic_phrases", "critical", w) for w in LEX["academic_phrases"]]),
        f"SELECT doc_id, 'passive_overuse', 'high', text, 1 FROM ({passives}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, j) <= 10",
        _one("paragraph_uniformity", "high", "paragraph length", f"(SELECT doc_id FROM short GROUP BY doc_id HAVING count(*) >= 3 AND avg(n) > 0 AND stddev_pop(n) / avg(n) < 0.18)"),
        _one("paragraph_uniformity", "high", "openers", f"(SELECT doc_id FROM short GROUP BY doc_id HAVING count(*) FILTER ({opener}) >= 3)"),
        _one("connector_density", "high", "connectors", f"base WHERE n > 0 AND {con} / (n / 100) > 3.0", con),
        f"SELECT doc_id, 'connector_density', 'info', w, 1 FROM base, {rows([(i, w) for i, w in enumerate(LEX['logic_connectors'])], 'k, w')} WHERE n > 0 AND {con} / (n / 100) > 3.0 AND contains(t, w) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 5",
        f"SELECT doc_id, 'synonym_poverty', 'medium', w, c FROM (SELECT doc_id, k, w, {times('t', 'w')} AS c FROM base, {rows([(i, w) for i, w in enumerate(LEX['academic_repeat_words'])], 'k, w')}) WHERE c >= 4 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, k) <= 5",
        _one("citation_integration", "medium", "citations", f"base WHERE {cites} >= 3 AND {tmpl} >= 3 AND {tmpl} / {cites} > 0.6"),
        _words([("data_template", "medium", w) for w in LEX["data_templates"]]), _any("over_enumeration", "medium", LEX["enumerations"], 60, True),
        _one("perfect_conclusion", "high", "conclusion", f"base WHERE {perfect} >= 2 AND NOT ({limited})"),
        f"SELECT doc_id, 'certainty_overuse', CASE WHEN {cer} >= 3 AND {hed} < 2 THEN 'high' ELSE 'medium' END, 'certainty', 1 FROM base WHERE n > 200 AND (({cer} >= 3 AND {hed} < 2) OR ({cer} > 0 AND {hed} = 0))",
        "SELECT doc_id, 'low_topic_diffusion', CASE WHEN v > 0.35 THEN 'medium' ELSE 'high' END, 'diffusion', 1 FROM diffusion JOIN base USING (doc_id) JOIN (SELECT doc_id FROM short GROUP BY doc_id HAVING count(*) >= 3) k USING (doc_id) WHERE n >= 300 AND used >= 3 AND v < 0.5",
    ]
    more = f"""short AS (SELECT doc_id, idx, p, length({counted("p")}) AS n FROM blocks WHERE length(p) > 10),
    grams AS (SELECT doc_id, idx, unnest(range(len(a))) AS pos, unnest(a) AS g FROM (SELECT doc_id, idx, list_transform(list_zip(string_split(c, '')[1:length(c) - 1], string_split(c, '')[2:]), lambda z: z[1] || z[2]) AS a FROM (SELECT doc_id, idx, lower({counted("p")}) AS c FROM blocks WHERE length(p) > 20) WHERE length(c) >= 10)),
    tops AS (SELECT doc_id, idx, g FROM (SELECT doc_id, idx, g, count(*) AS c, min(pos) AS pos FROM grams GROUP BY doc_id, idx, g) QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY c DESC, pos) <= 20),
    ord AS (SELECT doc_id, idx, count(*) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS o FROM tops GROUP BY doc_id, idx),
    near AS (SELECT a.doc_id, a.o, a.k + b.k AS k, count(y.g) AS same FROM ord a JOIN ord b ON b.doc_id = a.doc_id AND b.o = a.o + 1 JOIN tops x ON x.doc_id = a.doc_id AND x.idx = a.idx LEFT JOIN tops y ON y.doc_id = b.doc_id AND y.idx = b.idx AND y.g = x.g GROUP BY ALL),
    diffusion AS (SELECT doc_id, 1 - avg(same / (k - same)) AS v, count(*) + 1 AS used FROM near GROUP BY doc_id)"""
    return f"{more}, dims AS ({' UNION ALL '.join(parts)})"


def academic_score() -> str:
    one = f"{_case(LEX['dimension_weights'], 'category', 3)} * {_case(LEX['severity_factors'], 'severity', 0.6)} * least(cnt, 5)"
    return f"""WITH {BASE}, {academic()}, {flags()},
    s AS (SELECT b.doc_id, CAST(least(60, trunc(round(coalesce(r, 0) * 0.7, 9))) AS INTEGER) AS rule_part, CAST(coalesce(CASE WHEN n >= 100 THEN stat_part END, 0) AS INTEGER) AS stat_part FROM base b
      LEFT JOIN (SELECT doc_id, sum(CAST({one} AS DOUBLE)) AS r FROM dims WHERE severity <> 'info' GROUP BY doc_id) i USING (doc_id) LEFT JOIN {_stats(LEX["academic_statistical_weights"])} f USING (doc_id))
    SELECT doc_id, rule_part, stat_part, CAST(least(100, rule_part + stat_part) AS INTEGER) AS score, {_level("least(100, rule_part + stat_part)")} AS level FROM s"""


def genre() -> str:
    strong = _sum(LEX["route_strong"])
    soc = f"({_sum(LEX['route_social'])} + len(regexp_extract_all(t, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]')))"
    aca = f"({strong} * 2 + {_sum(LEX['route_weak'])})"
    return f"WITH {BASE} SELECT doc_id, CASE WHEN {strong} >= 1 AND {aca} >= 4 AND {aca} > {soc} THEN 'academic' WHEN {soc} >= 3 THEN 'social' WHEN n >= 1500 AND {_sum(['「', '“'])} >= 3 THEN 'novel' ELSE 'general' END AS scene FROM base"


def lr_scene() -> str:
    hits = " + ".join(f"CAST(contains(t, {lit(m)}) AS INTEGER)" for m in LEX["academic_scene_markers"])
    return f"WITH {BASE} SELECT doc_id, CASE WHEN n >= 1500 THEN 'longform' WHEN {hits} >= 2 THEN 'academic' ELSE 'general' END AS scene FROM base"


#: before and after: documents against themselves redacted, and the fixture's pairs under negative ids
PAIRS = f"pairs AS (SELECT doc_id AS pair_id, coalesce(text, '') AS before, regexp_replace(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*%?|[.] ', ' ', 'g') AS after FROM documents UNION ALL SELECT -pair_id, before, after FROM {rows(list(fx.PAIRS), 'pair_id, before, after')})"


def _bag(c: str, pattern: str, value: str) -> str:
    return f"SELECT pair_id, {value} AS x, count(*) AS k FROM (SELECT pair_id, unnest({found(c, pattern)}) AS m FROM pairs) GROUP BY ALL"


def lost(pattern: str, value: str) -> str:
    return f"SELECT b.pair_id, b.x AS token, CAST(b.k - coalesce(a.k, 0) AS INTEGER) AS lost FROM ({_bag('before', pattern, value)}) b LEFT JOIN ({_bag('after', pattern, value)}) a ON a.pair_id = b.pair_id AND a.x = b.x WHERE b.k > coalesce(a.k, 0)"


NUMBER, LATIN = (guards.NUMBER, "replace(m, ',', '')"), (guards.LATIN, "upper(m)")


def guard() -> str:
    han = lambda c: f"length(regexp_replace({c}, '[^一-鿿]', '', 'g'))"
    fill = f"least(0.5, {han(f"array_to_string({found('before', '|'.join(LEX['guard_fillers']))}, '')")} / {han('before')})"
    paras = lambda c: f"len(list_filter(list_transform(string_split_regex({strip(c)}, '\\n[\\s\\x{{3000}}]*\\n'), lambda p: {strip('p')}), lambda p: p <> ''))"
    ratio = f"{han('after')} / {han('before')}"
    floor = f"greatest(0.75 - ({fill}) * 1.3, 0.55)"
    rules = [("no_han", f"{han('before')} = 0"), ("too_short", f"{han('before')} > 0 AND {ratio} < {floor}"), ("too_long", f"{han('before')} > 0 AND {ratio} > 1.25"), ("paragraphs", f"{paras('before')} <> {paras('after')}"), ("preamble", f"regexp_matches(after, {lit(LEX['preamble'].replace(chr(92) + 's', f'[{SPACE}]'))})")]
    parts = [f"SELECT DISTINCT pair_id, 'lost_numbers' AS problem FROM ({lost(*NUMBER)})", f"SELECT DISTINCT pair_id, 'lost_latin' FROM ({lost(*LATIN)})", *[f"SELECT pair_id, '{n}' FROM pairs WHERE {c}" for n, c in rules]]
    return f"WITH {PAIRS} " + " UNION ALL ".join(parts)


def survival() -> str:
    skip = lambda c: f"translate({c}, ' \t\r\n　', '')"
    gram = lambda c, w: f"CASE WHEN length({c}) >= {w} THEN list_transform(list_zip({', '.join(f'string_split({c}, {lit("")})[{i + 1}:length({c}) - {w - 1 - i}]' for i in range(w))}), lambda z: {' || '.join(f'z[{i + 1}]' for i in range(w))}) ELSE [] END"
    parts = []
    for w in hygiene.WIDTHS:
        bag = lambda c, w=w: f"SELECT pair_id, g, count(*) AS k FROM (SELECT pair_id, unnest({gram('c', w)}) AS g FROM (SELECT pair_id, {skip(c)} AS c FROM pairs)) GROUP BY pair_id, g"
        parts.append(f"SELECT p.pair_id, {w} AS width, coalesce(total, 0) AS total, coalesce(kept, 0) AS kept, coalesce(after_total, 0) AS after_total FROM pairs p LEFT JOIN (SELECT b.pair_id, sum(b.k) AS total, sum(least(b.k, coalesce(a.k, 0))) AS kept FROM ({bag('before')}) b LEFT JOIN ({bag('after')}) a ON a.pair_id = b.pair_id AND a.g = b.g GROUP BY b.pair_id) x ON x.pair_id = p.pair_id LEFT JOIN (SELECT pair_id, sum(k) AS after_total FROM ({bag('after')}) GROUP BY pair_id) y ON y.pair_id = p.pair_id")
    return f"surv AS (SELECT pair_id, width, CAST(total AS BIGINT) AS total, CAST(kept AS BIGINT) AS kept, CAST(after_total AS BIGINT) AS after_total, CASE WHEN total > 0 THEN round(kept / total, 4) ELSE 0 END AS survival, CASE WHEN kept > 0 AND after_total > 0 THEN round(kept / sqrt(CAST(total AS DOUBLE) * after_total), 4) ELSE 0 END AS z_ratio FROM ({' UNION ALL '.join(parts)}))"


NOTES = f"WITH {PAIRS}, {survival()} SELECT pair_id, CASE WHEN survival >= 0.8 THEN 'kept' WHEN survival >= 0.5 THEN 'mostly' WHEN survival >= 0.25 THEN 'partly' WHEN survival >= 0.1 THEN 'little' ELSE 'gone' END AS note, CASE WHEN total > 0 AND after_total > 0 AND after_total / total < 0.95 THEN 'shorter' WHEN total > 0 AND after_total > 0 AND after_total / total > 1.05 THEN 'longer' ELSE 'same' END AS length FROM surv WHERE width = 5"


def rhythm() -> str:
    sent = f"SELECT doc_id, length({counted('s')}) AS n FROM (SELECT doc_id, unnest(CASE WHEN han THEN regexp_extract_all(p, '[^。！？…]*[。！？…]|[^。！？…]+') ELSE regexp_extract_all(p, '[^.!?。！？…]*[.!?。！？…]|[^.!?。！？…]+') END) AS s FROM (SELECT doc_id, han, unnest(string_split_regex(t, '\\n[\\s]*\\n')) AS p FROM base))"
    return f"WITH {BASE}, q AS (SELECT doc_id, count(*) AS k, stddev_pop(n) / avg(n) AS cv, avg(CASE WHEN n < 10 THEN 1.0 ELSE 0.0 END) AS sf, avg(n) AS m FROM ({sent}) WHERE n > 0 GROUP BY doc_id) SELECT b.doc_id, CAST(coalesce(k, 0) AS INTEGER) AS n, CASE WHEN k >= 2 THEN round(cv, 4) ELSE 0 END AS cv, CASE WHEN k >= 2 THEN round(sf, 4) ELSE 0 END AS short_frac, CASE WHEN k >= 2 THEN round(m, 4) ELSE 0 END AS mean_len FROM base b LEFT JOIN q USING (doc_id)"


def merges() -> str:
    return f"""WITH {BASE}, w AS (SELECT doc_id, unnest(range(len(a))) AS idx, unnest(a) AS s FROM (SELECT doc_id, list_filter(regexp_extract_all(t, '(?s)[^。！？…]*[。！？…]|[^。！？…]+'), lambda x: {strip('x')} <> '') AS a FROM base)),
    k AS (SELECT doc_id, idx, s, length({counted('s')}) AS n, {times('s', lit('，'))} AS c FROM w), j AS (SELECT *, lead(n) OVER o AS n2, lead(c) OVER o AS c2 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY idx))
    SELECT doc_id, CAST(idx AS INTEGER) AS idx FROM j WHERE suffix(regexp_replace(s, '[{SPACE}]+$', ''), '。') AND n + n2 <= 45 AND least(n, n2) >= 4 AND c + c2 < 3"""


def bare(c: str) -> str:
    return f"translate({c}, {lit(LEX['rhythm_punctuation'])}, '')"


def dialogue() -> str:
    straight = "list_filter(list_transform(range(2, len(string_split(t, '\"')) + 1, 2), lambda i: string_split(t, '\"')[i]), lambda x: length(x) >= 3)"
    return f"WITH {BASE} SELECT doc_id, round((length(array_to_string({found('t', '“[^“”]{3,}?”', True)}, '')) + length(array_to_string({found('t', '「[^「」]{3,}?」', True)}, '')) + CASE WHEN len(string_split(t, '\"')) >= 3 THEN length(array_to_string({straight}, '')) ELSE 0 END) / greatest(1, length(t)), 4) AS value FROM base"


def starter_entropy() -> str:
    return f"""WITH {BASE}, q AS (SELECT doc_id, left(lower({counted('s')}), 2) AS g FROM (SELECT doc_id, unnest(string_split_regex(t, '[。！？!?；;.\\n]+')) AS s FROM base) WHERE length({counted('s')}) >= 2),
    e AS (SELECT doc_id, sum(c) AS n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT doc_id, g, count(*) AS c FROM q GROUP BY doc_id, g) GROUP BY doc_id)
    SELECT b.doc_id, CASE WHEN n < 5 OR n IS NULL THEN 0 ELSE round(h, 4) END AS value FROM (SELECT doc_id FROM base) b LEFT JOIN e USING (doc_id)"""


def markdown() -> str:
    line = f"CASE WHEN prefix({strip('l')}, '#') THEN {strip(f"regexp_replace({strip('l')}, '^#+', '')")} ELSE {strip('l')} END"
    return f"""WITH {BASE}, l AS (SELECT doc_id, unnest(range(len(string_split(t, chr(10))))) AS i, unnest(string_split(t, chr(10))) AS l FROM base),
    c AS (SELECT doc_id, i, replace(replace({line}, '**', ''), '__', '') AS s FROM l), k AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS s FROM c WHERE NOT (prefix(s, '---') AND len(list_distinct(string_split(s, ''))) <= 2) GROUP BY doc_id)
    SELECT b.doc_id, {strip("regexp_replace(coalesce(s, ''), '\\n{3,}', chr(10) || chr(10), 'g')")} AS body FROM base b LEFT JOIN k USING (doc_id)"""


def votes() -> str:
    """Turns of conversations as votes, and the fixture's."""
    own = "SELECT conv_id AS text_id, role || CAST(turn % 3 AS VARCHAR) AS model, CAST(1 + length(text) % 5 AS INTEGER) AS score, string_split(text, '.')[1] AS quote FROM conversations WHERE text IS NOT NULL"
    return f"votes AS ({own} UNION ALL SELECT -text_id, model, score, quote FROM {rows(list(fx.VOTES), 'text_id, model, score, quote')}), voted AS (SELECT conv_id AS text_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id UNION ALL SELECT -text_id, text FROM {rows(list(fx.VOTED), 'text_id, text')})"


def jury() -> str:
    return f"""WITH {votes()}, q AS (SELECT DISTINCT v.text_id, quote FROM votes v JOIN voted t ON t.text_id = v.text_id AND quote <> '' AND contains(t.text, quote)),
    b AS (SELECT q.text_id, q.quote, count(DISTINCT v.model) AS backers FROM q JOIN votes v ON v.text_id = q.text_id AND v.quote <> '' AND (contains(v.quote, q.quote) OR contains(q.quote, v.quote)) GROUP BY ALL),
    m AS (SELECT text_id, count(DISTINCT model) AS models, median(score) AS median FROM votes GROUP BY text_id)
    SELECT m.text_id, CAST(median AS DOUBLE) AS median, CAST(count(b.quote) AS INTEGER) AS defects, median >= 4 AND count(b.quote) = 0 AS passed FROM m LEFT JOIN b ON b.text_id = m.text_id AND b.backers >= m.models // 2 + 1 GROUP BY m.text_id, median"""


#: the edit of the before-and-after report: enumerating openers go, double dashes become single
EDIT = "replace(regexp_replace(t, '(?:首先|其次|最后)[，,]\\s*|(?:第[一二三四五六]|其[一二三])[，,、]\\s*', '', 'g'), '——', '—')"


def before_after() -> str:
    side = lambda t, name: f"{name} AS (WITH {base(t)}, {issues()}, {academic()} SELECT 'general' AS detector, category, count(*) AS n FROM issues GROUP BY category UNION ALL SELECT 'academic', category, count(*) FROM dims GROUP BY category)"
    return f"WITH {side('t', 'b')}, {side(EDIT, 'a')} SELECT coalesce(b.detector, a.detector) AS detector, coalesce(b.category, a.category) AS category, coalesce(b.n, 0) AS before_n, coalesce(a.n, 0) AS after_n FROM b FULL OUTER JOIN a ON a.detector = b.detector AND a.category = b.category"


def passages(width: int = 20) -> str:
    """Windows of benchmark items that documents hold."""
    gram = f"list_transform(list_zip({', '.join(f'a[{i + 1}:len(a) - {width - 1 - i}]' for i in range(width))}), lambda z: {' || '.join(f'z[{i + 1}]' for i in range(width))})"
    cut = lambda key, source: f"SELECT {key}, g, count(*) AS c FROM (SELECT {key}, unnest({gram}) AS g FROM (SELECT {key}, string_split(translate(coalesce(text, ''), ' \t\r\n　', ''), '') AS a FROM {source}) WHERE len(a) >= {width}) GROUP BY ALL"
    return f"WITH k AS ({cut('item_id', 'benchmark')}), n AS (SELECT item_id, sum(c) AS total FROM k GROUP BY item_id), d AS (SELECT * FROM ({cut('doc_id', 'documents')}) WHERE g IN (SELECT g FROM k)) SELECT k.item_id, d.doc_id, CAST(sum(least(k.c, d.c)) AS BIGINT) AS kept, CAST(max(total) AS BIGINT) AS total, round(sum(least(k.c, d.c)) / max(total), 4) AS survival FROM k JOIN d USING (g) JOIN n USING (item_id) GROUP BY k.item_id, d.doc_id"


def phrase_counts() -> str:
    words = [(c, w) for c in ("mechanical_connectors", "empty_grand_words", "ai_high_freq_words", "filler_phrases", "hedging", "emotional_words", "personal_markers") for w in LEX[c]]
    return f"WITH {BASE} SELECT doc_id, category, w AS phrase, {times('t', 'w')} AS cnt FROM base, {rows(words, 'category, w')} WHERE contains(t, w)"


def projections() -> str:
    fill = f"length(regexp_replace(array_to_string({found('t', '|'.join(LEX['guard_fillers']))}, ''), '[^一-鿿]', '', 'g'))"
    han = "length(regexp_replace(t, '[^一-鿿]', '', 'g'))"
    return f"WITH {BASE} SELECT doc_id, CASE WHEN {han} = 0 THEN 0 ELSE round(least(0.5, {fill} / {han}), 4) END AS filler_ratio, array_to_string(list_sort(list_transform({found('t', guards.LATIN)}, lambda x: upper(x))), '|') AS latin, array_to_string(list_sort(list_transform({found('t', guards.NUMBER)}, lambda x: replace(x, ',', ''))), '|') AS numbers, {bare('t')} AS bare FROM base"


def structure() -> str:
    p = f"regexp_replace(p, '^[{SPACE}]+', '')"
    yes = f"regexp_matches({p}, '^(#|- |\\* |[0-9]+[.。．)）]|[\"“「])') OR (prefix({p}, '**') AND suffix(regexp_replace({p}, '[{SPACE}]+$', ''), '**')) OR regexp_matches({p}, '^[一二三四五六七八九十]+[、,，]|^[（(][一二三四五六七八九十]+[）)]')"
    return f"WITH {BASE} SELECT doc_id, count(*) AS blocks, CAST(sum(CASE WHEN {yes} THEN 1 ELSE 0 END) AS BIGINT) AS structural FROM blocks GROUP BY doc_id"


def semicolons() -> str:
    parts = "string_split(t, '；')"
    joined = f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda i: CASE WHEN i = 1 THEN {parts}[i] WHEN i % 2 = 1 THEN '。' || regexp_replace({parts}[i], '^[{SPACE}]+', '') ELSE '，' || {parts}[i] END), '')"
    return f"WITH {BASE} SELECT doc_id, replace(CASE WHEN len({parts}) > 3 THEN {joined} ELSE t END, '——', '—') AS body FROM base"


def fold() -> str:
    table = hygiene.look_alikes()
    return f"WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT -doc_id, text FROM {rows(list(fx.HYGIENE), 'doc_id, text')}) SELECT doc_id, translate(t, {lit(''.join(table))}, {lit(''.join(table.values()))}) AS folded FROM texts"


def kinds() -> str:
    """Suspicious characters by their class, without context."""
    inside = lambda ranges: "(" + " OR ".join(f"cp BETWEEN {a} AND {b}" for a, b in ranges) + ")"
    table = ", ".join(str(ord(c)) for c in hygiene.look_alikes())
    rules = (("tag_char", inside(hygiene.TAGS)), ("noncharacter", "(cp BETWEEN 64976 AND 65007 OR cp % 65536 >= 65534)"), ("reserved", inside(hygiene.RESERVED)), ("private_use", inside(hygiene.PRIVATE)), ("variation", inside(hygiene.SELECTORS + hygiene.MONGOLIAN)), ("bidi", inside(hygiene.BIDI)), ("zero_width", inside(hygiene.ZERO_WIDTH)), ("format", inside(hygiene.OTHER)), ("space", inside(hygiene.SPACES)), ("lookalike", f"cp IN ({table})"))
    case = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in rules) + " END"
    return f"WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT -doc_id, text FROM {rows(list(fx.HYGIENE), 'doc_id, text')}), q AS (SELECT doc_id, unicode(unnest(string_split(t, ''))) AS cp FROM texts WHERE t <> '') SELECT doc_id, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, {case} AS kind FROM q) WHERE kind IS NOT NULL GROUP BY doc_id, kind"


SCORED = "scored AS (SELECT d.doc_id, lang, source, quality AS y, CAST(length(coalesce(text, '')) AS DOUBLE) AS chars, coalesce(text, '') AS text, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE 100.0::DOUBLE * length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) END AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL)"
CUT = "regexp_replace(text, '[0-9]+(?:[.,][0-9]+)*%?|[.] ', ' ', 'g')"


def _auc(source: str, by: str) -> str:
    """All pairs of both classes, counted."""
    return f"SELECT p.{by}, round(avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM {source} p JOIN {source} q ON q.{by} = p.{by} WHERE p.y = 1 AND q.y = 0 GROUP BY p.{by}"


def scene_report() -> str:
    return f"""WITH {SCORED}, s AS (SELECT lang, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, round(avg(score) FILTER (y = 1), 4) AS mean_pos, round(avg(score) FILTER (y = 0), 4) AS mean_neg,
      greatest(min(chars) FILTER (y = 0), min(chars) FILTER (y = 1)) AS lo, least(max(chars) FILTER (y = 0), max(chars) FILTER (y = 1)) AS hi FROM scored GROUP BY lang),
    inside AS (SELECT scored.* FROM scored JOIN s USING (lang) WHERE chars BETWEEN lo AND hi), k AS (SELECT lang, count(*) FILTER (y = 1) AS m_pos, count(*) FILTER (y = 0) AS m_neg FROM inside GROUP BY lang),
    x AS (SELECT s.*, a.auc AS auc_raw, coalesce(m_pos, 0) AS m_pos, coalesce(m_neg, 0) AS m_neg, CASE WHEN least(m_pos, m_neg) >= 15 THEN b.auc END AS auc_matched FROM s LEFT JOIN ({_auc('scored', 'lang')}) a USING (lang) LEFT JOIN k USING (lang) LEFT JOIN ({_auc('inside', 'lang')}) b USING (lang))
    SELECT lang AS scene, n_pos, n_neg, mean_pos, mean_neg, auc_raw, lo, hi, m_pos, m_neg, auc_matched, CASE WHEN coalesce(auc_matched, auc_raw) >= 0.9 THEN 'strong' WHEN coalesce(auc_matched, auc_raw) >= 0.75 THEN 'useful' WHEN coalesce(auc_matched, auc_raw) >= 0.65 THEN 'weak' WHEN coalesce(auc_matched, auc_raw) IS NOT NULL THEN 'none' END AS verdict FROM x"""


def margins() -> str:
    cols = "count(*) AS n, round(avg(score), 4) AS mean, round(min(score), 4) AS low, round(max(score), 4) AS high, round(avg(CASE WHEN score < 25 THEN 1.0 ELSE 0.0 END), 4) AS low_share, round(avg(CASE WHEN score >= 75 THEN 1.0 ELSE 0.0 END), 4) AS very_high_share"
    parts = [f"SELECT {a} AS scene, {b} AS model, {g} AS gid, {cols} FROM scored{' GROUP BY ' + ', '.join(x for x in (a, b) if x in ('lang', 'source')) if 'lang' in (a, b) or 'source' in (a, b) else ''}" for a, b, g in (("lang", "source", 0), ("lang", "NULL", 1), ("NULL", "source", 2), ("NULL", "NULL", 3))]
    return f"WITH {SCORED} " + " UNION ALL ".join(parts)


def layers() -> str:
    return f"""WITH {SCORED}, long AS (SELECT y, 'score' AS layer, score FROM scored UNION ALL SELECT y, 'chars', chars FROM scored)
    SELECT l.layer, count(*) AS n, round(avg(score), 4) AS mean, round(median(score), 4) AS median, round(min(score), 4) AS low, round(max(score), 4) AS high, max(a.auc) AS auc FROM long l JOIN ({_auc('long', 'layer')}) a ON a.layer = l.layer GROUP BY l.layer"""


_EDITED = f"SELECT *, CASE WHEN length({CUT}) = 0 THEN 0 ELSE 100.0::DOUBLE * length(regexp_replace({CUT}, '[^\\p{{L}}]', '', 'g')) / length({CUT}) END AS after, length(text) - length(replace(text, chr(10), '')) AS pb, length({CUT}) - length(replace({CUT}, chr(10), '')) AS pa, length({CUT}) AS ca FROM scored"


def pair_report() -> str:
    return f"""WITH {SCORED}, e AS ({_EDITED}), r AS (SELECT *, row_number() OVER (PARTITION BY source, y ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM e),
    j AS (SELECT a.source, b.score AS human, a.score AS model, a.score - a.after AS delta, a.pb, a.pa, a.chars AS cb, a.ca FROM r a JOIN r b ON b.source = a.source AND b.rn = a.rn AND b.y = 0 WHERE a.y = 1)
    SELECT source, count(*) AS n, round(avg(CASE WHEN human < model THEN 1.0 ELSE 0.0 END), 4) AS correct_rate, round(avg(model - human), 4) AS gap, round(avg(delta), 4) AS delta_avg, round(list_sort(list(delta))[count(*) // 2 + 1], 4) AS delta_median, round(min(delta), 4) AS delta_min, round(max(delta), 4) AS delta_max,
      round(avg(CASE WHEN pa >= pb THEN 1.0 ELSE 0.0 END), 4) AS preserved, round(avg(ca / nullif(cb, 0)), 4) AS length_ratio, CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS improved FROM j GROUP BY GROUPING SETS ((source), ())"""


def longform() -> str:
    n = " + ".join(f"greatest(0, len({found('b', p)}) - len({found('text', p)}))" for p in guards.DEFECTS)
    return f"""WITH {SCORED}, e AS (SELECT *, {CUT} AS b FROM ({_EDITED})), k AS (SELECT lang AS genre, source AS model, score, after, CASE WHEN pa = pb THEN 1.0 ELSE 0.0 END AS kept, {n} AS d FROM e)
    SELECT genre, model, count(*) AS n, round(avg(score), 4) AS before, round(avg(after), 4) AS after, round(avg(score - after), 4) AS delta, round(avg(kept), 4) AS preserved, CAST(sum(d) AS BIGINT) AS defects FROM k GROUP BY GROUPING SETS ((genre), (model), ())"""


def controls() -> str:
    return "SELECT doc_id AS id, 'general' AS scene, lang AS genre, length(text) AS chars, source AS provenance FROM documents WHERE lang IN ('en', 'de') AND length(text) BETWEEN 200 AND 2000 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 50"


def bigrams() -> str:
    return f"WITH g AS ({build('ngram_train', _D)}), v AS (SELECT greatest(count(*), 1000) AS v FROM g WHERE n = 1) SELECT b.gram AS g, round(log2((b.cnt + 0.01) / (a.cnt + 0.01 * (SELECT v FROM v))), 4) AS lp FROM g b JOIN g a ON a.n = 1 AND a.gram = left(b.gram, 1) WHERE b.n = 2"


def unigrams() -> str:
    return f"SELECT u.doc_id, unigram_ppl, round(coalesce(power(2, u.lp + p.lp), 0), 4) AS ratio FROM (SELECT doc_id, round(power(2, l), 3) AS unigram_ppl, l AS lp FROM ({build('unigram_bits', _D)})) u LEFT JOIN (SELECT doc_id, l AS lp FROM ({build('trigram_bits', _D)})) p USING (doc_id)"


def densities() -> str:
    n = f"length(regexp_replace(t, '[{SPACE}]', '', 'g'))"
    marks = lambda c: f"({n} - length(translate(regexp_replace(t, '[{SPACE}]', '', 'g'), {lit(c)}, '')))"
    return f"WITH {BASE} SELECT doc_id, CAST(n AS INTEGER) AS char_count, CASE WHEN {n} > 0 THEN round({marks('，,')} / {n} * 100, 4) ELSE 0 END AS comma_density, CASE WHEN {n} > 0 THEN round({marks(scoring.PUNCTUATION)} / {n} * 100, 4) ELSE 0 END AS punct_density, CASE WHEN n < 50 THEN 0 ELSE round({_sum(LEX['transitions'])} / n * 1000, 4) END AS trans_density FROM base"


def repeats() -> str:
    twice = "len(list_filter(range(2, length(s)), lambda i: s[i] = s[i + 1] AND regexp_matches(s[i - 1:i], '^[一-鿿]{2}$'))) > 0"
    legit = " OR ".join(f"regexp_matches(s, {lit(p)})" for p in LEX["legit_repeats"][:-1])
    return f"""WITH {BASE}, p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(t, '[。！？!?\n]+'), lambda x: {strip('x')}), lambda x: length(x) >= 10)) AS s, generate_subscripts(list_filter(list_transform(string_split_regex(t, '[。！？!?\n]+'), lambda x: {strip('x')}), lambda x: length(x) >= 10), 1) - 1 AS idx FROM base WHERE regexp_matches(t, '[一-鿿]')),
    g AS (SELECT doc_id, idx, i, s[i:i + 1] AS g FROM (SELECT doc_id, idx, s, unnest(range(1, length(s))) AS i FROM p WHERE NOT ({legit} OR {twice}))),
    d AS (SELECT doc_id, idx, g, i - lag(i) OVER (PARTITION BY doc_id, idx, g ORDER BY i) AS d FROM g WHERE regexp_matches(g, '^[一-鿿]{{2}}$') AND g NOT IN ({', '.join(map(lit, LEX['common_bigrams']))}))
    SELECT doc_id, CAST(idx AS INTEGER) AS idx, g, count(*) AS n, CAST(min(d) AS INTEGER) AS gap FROM d GROUP BY doc_id, idx, g HAVING min(d) <= 20"""


def casual() -> str:
    t = "t"
    for a, b in LEX["formal_to_casual"].items():
        t = f"replace({t}, {lit(a)}, {lit(b)})" if b else f"replace(replace({t}, {lit(a + '，')}, ''), {lit(a)}, '')"
    return f"WITH {BASE} SELECT doc_id, {t} AS body FROM base"
