"""DuckDB SQL for the queries that SQL can express, from the same rule pack."""

from __future__ import annotations

from spanloom.operators.memory import PARTICLES, TOKEN
from spanloom.operators.rules import CORPUS
from spanloom.plans.base import PICKERS

#: White space of any kind, as a class of RE2.
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SEG = f"""
L AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{WHITE}]')) AS l FROM documents),
seg AS (SELECT doc_id, i::INT AS seg_id, ((i - 1) // 5 + 1)::INT AS slide_no, CASE WHEN i = 1 THEN 'title' ELSE 'body' END AS kind, l[i] AS text
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM L WHERE len(l) > 0))"""


def _q(s: str) -> str:
    return s.replace("'", "''")


def places(pattern: str, source: str = "seg") -> str:
    """(doc_id, seg_id, text, k, s, e, matched) of a pattern's matches."""
    return f"""SELECT *, (s + length(matched))::INT AS e FROM (
  SELECT doc_id, seg_id, slide_no, text, k, m[k] AS matched, (list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT AS s
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS k FROM (SELECT doc_id, seg_id, slide_no, text, regexp_extract_all(text, '{_q(pattern)}', 0) AS m, regexp_split_to_array(text, '{_q(pattern)}') AS p FROM {source}) WHERE len(m) > 0))"""


def _rule(i: int) -> str:
    r = CORPUS.rules[i]
    return f"SELECT doc_id, seg_id, slide_no, text, {i} AS ro, k, '{r.rid}' AS rid, '{r.category}' AS category, {r.weight} AS weight, s, e, matched, {str(r.disclosure).lower()} AS disclosure FROM ({places('(?i)' + r.pattern)})"


HITS = SEG + ",\nhits AS (" + "\nUNION ALL ".join(_rule(i) for i in range(len(CORPUS.rules))) + ")"
NOISE, STATUS = f"(?i){CORPUS.noise}", f"(?i){CORPUS.status}"
_TECH = ", ".join(f"'{c}'" for c in CORPUS.technical)
_IMPLICIT = ", ".join(f"'{c}'" for c in CORPUS.implicit)
LABELS = "'대외비', '목차', '감사합니다', 'Agenda', 'Q&A'"
#: Per segment: score, noise, status, disclosure, best hit.
FACTS = HITS + f""",
per AS (SELECT doc_id, seg_id, count(*) AS n_hits, sum(weight) AS w, count(DISTINCT category) AS kinds, bool_or(disclosure) AS disclosed, bool_or(category IN ({_TECH})) AS tech,
  arg_min(struct_pack(s := s, e := e, category := category), -weight::BIGINT * 1000000000 + ro * 1000000 + k) AS top FROM hits GROUP BY ALL),
facts AS (SELECT seg.*, coalesce(n_hits, 0) AS n_hits, CASE WHEN n_hits IS NULL THEN 0 ELSE greatest(0, w + 4 * (kinds - 1) - 6 * len(regexp_extract_all(text, '{NOISE}', 0))) END::BIGINT AS score,
  regexp_matches(text, '{NOISE}') AND NOT coalesce(tech, false) AS noise, regexp_matches(text, '{STATUS}') AS status, coalesce(disclosed, false) AS disclosed, top
  FROM seg LEFT JOIN per USING (doc_id, seg_id))"""
#: The rescue rule, with the sentence around the best hit.
RESCUE = FACTS + f""",
ends AS (SELECT doc_id, seg_id, list(s) AS stops FROM ({places('[.!?。' + chr(10) + '·]')}) GROUP BY ALL),
saved AS (SELECT *, CASE WHEN length(trim(text)) <= 70 THEN 0 WHEN r - l > 160 THEN greatest(0, top.s - 20) ELSE l END::INT AS s,
    CASE WHEN length(trim(text)) <= 70 THEN length(text) WHEN r - l > 160 THEN least(length(text), top.e + 20) ELSE r END::INT AS e
  FROM (SELECT facts.*, coalesce(list_max(list_filter(stops, lambda x: x < top.s)) + 1, 0) AS l, coalesce(list_min(list_filter(stops, lambda x: x >= top.e)) + 1, length(text)) AS r
    FROM facts LEFT JOIN ends USING (doc_id, seg_id) WHERE n_hits > 0 AND length(text) >= 6 AND trim(text) NOT IN ({LABELS}) AND (score >= 8 OR disclosed) AND (NOT noise OR disclosed)))"""


def merged(source: str) -> str:
    """Marks of (doc_id, seg_id, slide_no, s, e, r, risk)."""
    return f"""
a AS (SELECT *, max(e) OVER (PARTITION BY doc_id, seg_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({source})),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seg_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT doc_id, seg_id, slide_no, min(s) AS s, max(e) AS e, CASE max(r) WHEN 3 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS grade, bool_or(risk) AS risk FROM b GROUP BY doc_id, seg_id, slide_no, island"""


def _case(k: int) -> str:
    whens = " ".join(f"WHEN regexp_matches(text, '(?i){p[0]}') THEN {v}" for p, v in zip(PICKERS, ([f"regexp_extract(text, '(?i){p[0]}')" for p in PICKERS], [f"'{p[1]}'" for p in PICKERS], [f"'{p[2]}'" for p in PICKERS], [str(p[3]).lower() for p in PICKERS])[k]))
    return f"CASE {whens} END"


PICKED = SEG + f""",
picked AS (SELECT doc_id, seg_id, slide_no, text, {_case(0)} AS quote, {_case(1)} AS grade, {_case(2)} AS category, {_case(3)} AS disclosure_risk FROM seg),
found AS (SELECT * FROM picked WHERE quote IS NOT NULL)"""
_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
CORRECTIONS = PICKED + f""",
corrections AS (SELECT (doc_id << 32) + seg_id AS seq, CASE WHEN seg_id % 5 = 0 THEN 'fp' WHEN seg_id % 7 = 0 THEN 'regrade' ELSE 'match' END AS type, trim(text) AS text, trim(quote) AS quote, grade, disclosure_risk AS risk FROM found),
folded AS (SELECT md5({_NORM}) AS para, {_NORM} AS para_key, quote, CASE WHEN type = 'fp' THEN 'neg' ELSE 'gold' END AS kind, grade, risk, seq,
    min(seq) OVER (PARTITION BY {_NORM}) AS para_at, min(seq) OVER (PARTITION BY {_NORM}, quote) AS quote_at FROM corrections WHERE length(text) >= 6 AND length(quote) > 0
  QUALIFY row_number() OVER (PARTITION BY {_NORM}, quote ORDER BY seq DESC) = 1)"""

ORACLE = {
    "segment_lines": f"WITH {SEG} SELECT * FROM seg",
    "prescreen": f"WITH {FACTS} SELECT doc_id, seg_id, n_hits FROM facts WHERE n_hits > 0 AND length(text) >= 6 AND trim(text) NOT IN ({LABELS})",
    "lexicon_scan": f"WITH {HITS} SELECT doc_id, seg_id, rid, category, weight, s, e, matched FROM hits",
    "lexicon_score": f"WITH {FACTS} SELECT doc_id, seg_id, score FROM facts",
    "category_hints": f"WITH {HITS} SELECT doc_id, seg_id, string_agg(DISTINCT category, ',' ORDER BY category) AS hints FROM hits GROUP BY ALL",
    "noise_filter": f"WITH {FACTS} SELECT doc_id, seg_id, noise, status, disclosed FROM facts",
    "readable_span": f"WITH {RESCUE} SELECT doc_id, seg_id, s, e, top.category AS category, disclosed AS disclosure_risk FROM saved",
    "rescue_marks": f"WITH {RESCUE}, {merged('SELECT doc_id, seg_id, slide_no, s, e, 2 AS r, disclosed AS risk FROM saved')}",
    "build_marks": f"WITH {HITS}, {merged('SELECT doc_id, seg_id, slide_no, s, e, CASE WHEN weight >= 6 THEN 3 WHEN weight >= 4 THEN 2 ELSE 1 END AS r, disclosure AS risk FROM hits')}",
    "judge_pick": f"WITH {PICKED} SELECT doc_id, seg_id, quote, grade, category, disclosure_risk FROM found",
    "quote_locate": f"WITH {PICKED} SELECT doc_id, seg_id, (instr(text, quote) - 1)::INT AS s, (instr(text, quote) - 1 + length(quote))::INT AS e FROM found",
    "sentence_split": f"""WITH {SEG}, cut AS ({places('[.!?。][[:space:]]+|' + chr(10))}),
e AS (SELECT doc_id, seg_id, e FROM cut UNION SELECT doc_id, seg_id, length(text)::INT FROM seg)
SELECT doc_id, seg_id, (row_number() OVER w - 1)::INT AS i, coalesce(lag(e) OVER w, 0)::INT AS s, e FROM e WINDOW w AS (PARTITION BY doc_id, seg_id ORDER BY e)""",
    "snippet": f"""WITH {HITS}, f AS (SELECT *, greatest(0, s - 55) AS lo, least(length(text), e + 55) AS hi FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, seg_id ORDER BY ro, k) = 1)
SELECT doc_id, seg_id, CASE WHEN lo > 0 THEN '…' ELSE '' END || replace(substr(text, lo + 1, hi - lo), chr(10), ' ') || CASE WHEN hi < length(text) THEN '…' ELSE '' END AS snippet FROM f""",
    "normal_forms": f"""WITH {SEG}, n AS (SELECT doc_id, seg_id, {_NORM} AS norm, regexp_replace(lower(regexp_replace(text, '\\s+', '', 'g')), '[0-9]', '0', 'g') AS b FROM seg)
SELECT doc_id, seg_id, norm, CASE WHEN length(b) > 1 THEN len(list_distinct(list_transform(generate_series(1, length(b) - 1), lambda i: substr(b, i, 2)))) ELSE length(b) END::BIGINT AS n_bigrams FROM n""",
    "fingerprint": f"WITH {SEG} SELECT doc_id, substr(sha256(string_agg(text, chr(31) ORDER BY seg_id)), 1, 24) AS fingerprint FROM seg GROUP BY doc_id",
    "doc_title": f"WITH {SEG} SELECT doc_id, trim(text) AS title FROM seg WHERE seg_id = 1",
    "lww_fold": f"WITH {CORRECTIONS} SELECT para, quote, kind, grade, risk, seq FROM folded",
    "index_rules": f"""WITH {CORRECTIONS}, q AS (SELECT *, lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) AS norm FROM folded)
SELECT norm, kind, seq FROM q WHERE norm IN (SELECT norm FROM q GROUP BY norm HAVING count(DISTINCT kind) = 1) AND length(norm) >= CASE WHEN kind = 'gold' THEN 3 ELSE 6 END QUALIFY row_number() OVER (PARTITION BY norm ORDER BY para_at, para_key, quote_at) = 1""",
    "pool_upsert": f"""WITH {CORRECTIONS} SELECT substr(quote, 1, 80) AS quote, CASE WHEN type = 'fp' THEN 'exclude' ELSE 'include' END AS kind, seq FROM corrections WHERE type <> 'match' AND length(quote) >= 2
QUALIFY row_number() OVER (PARTITION BY substr(quote, 1, 80) ORDER BY seq DESC) = 1""",
    "apply_excludes": f"""WITH {PICKED}, ex AS (SELECT unnest(['10', 'tional', 'tioned', '4 7']) AS norm, unnest([' *[0-9]+([.,][0-9]+)? *', 'tional', 'tioned', ' *[0-9]+([.,][0-9]+)? * * *[0-9]+([.,][0-9]+)? *']) AS p)
SELECT doc_id, seg_id, quote FROM (SELECT *, lower(trim(quote)) AS q FROM found) f WHERE disclosure_risk OR NOT EXISTS (SELECT 1 FROM ex WHERE contains(q, norm) OR (length(q) >= 6 AND contains(norm, q)) OR (length(norm) >= 3 AND regexp_matches(quote, p)))""",
    "example_topk": """WITH s AS (SELECT q.vec_id AS qid, p.vec_id AS pool_ord, CASE WHEN p.label % 2 = 0 THEN 'include' ELSE 'exclude' END AS kind,
  round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0)
SELECT qid, kind, pool_ord, score FROM s QUALIFY row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, pool_ord) <= CASE WHEN kind = 'include' THEN 8 ELSE 4 END""",
    "run_spans": f"""WITH {SEG}, w AS (SELECT doc_id, seg_id AS para_id, i - 1 AS o, p[i] AS t FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, seg_id, string_split(text, ' ') AS p FROM seg))),
r AS (SELECT *, o % 11 = 10 AS tool, CASE WHEN o % 11 = 10 THEN 0 ELSE length(t) END AS n, CASE WHEN o % 11 = 10 THEN NULL WHEN length(t) % 3 = 0 THEN 'FFFF00' WHEN length(t) % 3 = 1 THEN '00FFFF' END AS c FROM w),
x AS (SELECT *, sum(n) OVER w AS e, c IS DISTINCT FROM lag(c) OVER w OR coalesce(lag(tool) OVER w, false) AS fresh FROM r WINDOW w AS (PARTITION BY doc_id, para_id ORDER BY o)),
y AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, para_id ORDER BY o) AS island FROM x)
SELECT doc_id, para_id, min(e - n)::BIGINT AS s, max(e)::BIGINT AS e, c AS colour FROM y WHERE c IS NOT NULL GROUP BY doc_id, para_id, island, c HAVING max(e) > min(e - n)""",
}

#: The judge's findings reconciled with the scan, from the picked findings and the facts of each segment.
_LO, _HI = "coalesce(s, 0)", "coalesce(e, length(text))"
RESOLVED = RESCUE + f""",
picked AS (SELECT doc_id, seg_id, slide_no, text, {_case(0)} AS quote, {_case(1)} AS grade, {_case(2)} AS category, {_case(3)} AS risk FROM seg WHERE length(text) >= 6 AND trim(text) NOT IN ({LABELS})),
j0 AS (SELECT picked.*, (instr(text, quote) - 1)::INT AS s, (instr(text, quote) - 1 + length(quote))::INT AS e FROM picked WHERE quote IS NOT NULL),
j1 AS (SELECT j0.*, coalesce(bool_or(h.disclosure AND h.e > j0.s AND h.s < j0.e), false) AS real, coalesce(bool_or(h.category IN ({_TECH}) AND h.e > j0.s AND h.s < j0.e), false) AS shield
  FROM j0 LEFT JOIN hits h USING (doc_id, seg_id) GROUP BY ALL),
j2 AS (SELECT * FROM j1 WHERE NOT (risk AND regexp_matches(quote, '{STATUS}') AND NOT real)),
j3 AS (SELECT doc_id, seg_id, slide_no, quote, CASE WHEN NOT risk AND regexp_matches(quote, '{NOISE}') AND NOT shield THEN 'C' ELSE grade END AS grade, category, false AS implicit, risk, 'llm' AS source, s, e FROM j2
  UNION ALL SELECT doc_id, seg_id, slide_no, trim(substr(text, s + 1, e - s)), 'B', top.category, top.category IN ({_IMPLICIT}), disclosed, 'lexicon', s, e FROM saved WHERE (doc_id, seg_id) NOT IN (SELECT (doc_id, seg_id) FROM j2)),
j4 AS (SELECT j3.*, coalesce(bool_or(h.disclosure), false) AND coalesce(bool_or(h.category = '{CORPUS.disclosure_category}' AND h.e > j3.s AND h.s < j3.e), false) AS raised FROM j3 LEFT JOIN hits h USING (doc_id, seg_id) GROUP BY ALL),
resolved AS (SELECT doc_id, seg_id, slide_no, quote, grade, category, implicit, risk OR raised AS disclosure_risk, source, s, e FROM j4 WHERE grade <> 'C' OR risk OR raised)"""
GOLDS = """golds AS (SELECT doc_id, seg_id, i, s, e, CASE WHEN weight >= 6 THEN 'A' ELSE 'B' END AS grade, disclosure AS risk
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seg_id ORDER BY ro, k) - 1 AS i FROM hits) WHERE (seg_id + i) % 3 = 0)"""
BASE = "base AS (SELECT doc_id, seg_id, s, e, 'B' AS grade, disclosed AS risk FROM saved)"
CURRENT = "cur AS (SELECT doc_id, seg_id, s, e, grade, disclosure_risk AS risk FROM resolved)"


def _measured(name: str, preds: str) -> str:
    """One row of the figures of preds (doc_id, seg_id, s, e, grade, risk; one a segment) against golds."""
    return f"""{name}_p AS (SELECT p.doc_id, p.seg_id, g.i, p.grade = g.grade AND p.risk = g.risk AS ok FROM {preds} p JOIN golds g USING (doc_id, seg_id) WHERE p.s IS NULL OR (p.e > g.s AND p.s < g.e)),
{name}_n AS (SELECT (SELECT count(*) FROM {name}_p) AS tp, (SELECT count(*) FROM {name}_p WHERE ok) AS ok, (SELECT count(DISTINCT (doc_id, seg_id)) FROM {name}_p) AS hit, (SELECT count(*) FROM {preds}) AS preds, (SELECT count(*) FROM golds) AS golds),
{name} AS (SELECT tp, golds - tp AS miss, preds - hit AS fp, preds, round_even(tp / golds * 100, 1) AS recall, round_even(hit / preds * 100, 1) AS precision,
  round_even(2 * (tp / golds) * (hit / preds) / (tp / golds + hit / preds) * 100, 1) AS f1, CASE WHEN tp > 0 THEN round_even(ok / tp * 100, 1) END AS grade_acc FROM {name}_n)"""


_WRONG = "SELECT doc_id, seg_id, s, e FROM {0} p WHERE NOT EXISTS (SELECT 1 FROM golds g WHERE g.doc_id = p.doc_id AND g.seg_id = p.seg_id AND (p.s IS NULL OR (p.e > g.s AND p.s < g.e)))"
_MISSED = "SELECT doc_id, seg_id, i FROM golds g WHERE NOT EXISTS (SELECT 1 FROM {0} p WHERE g.doc_id = p.doc_id AND g.seg_id = p.seg_id AND (p.s IS NULL OR (p.e > g.s AND p.s < g.e)))"
_ONLY = "(SELECT count(*) FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {1} b WHERE a.doc_id = b.doc_id AND a.seg_id = b.seg_id AND coalesce(a.e, 2147483647) > coalesce(b.s, 0) AND coalesce(a.s, 0) < coalesce(b.e, 2147483647)))"
_PARTICLES = "|".join(PARTICLES)

ORACLE |= {
    "resolve_findings": f"WITH {RESOLVED} SELECT doc_id, seg_id, grade, category, disclosure_risk, source, s, e FROM resolved",
    "run_summary": f"""WITH {RESOLVED} SELECT count(*) AS n, count(*) FILTER (grade = 'A') AS a, count(*) FILTER (grade = 'B') AS b, count(*) FILTER (disclosure_risk) AS risk, count(*) FILTER (implicit) AS implicit,
count(*) FILTER (source = 'llm') AS llm, count(*) FILTER (source = 'llm' AND s IS NOT NULL) AS located, round_even(count(*) FILTER (source = 'llm' AND s IS NOT NULL) / count(*) FILTER (source = 'llm'), 3) AS located_share FROM resolved""",
    "eval_metrics": f"WITH {RESOLVED}, {GOLDS}, {CURRENT}, {_measured('m', 'cur')} SELECT * FROM m",
    "eval_delta": f"WITH {RESOLVED}, {GOLDS}, {CURRENT}, {BASE}, {_measured('a', 'base')}, {_measured('b', 'cur')} SELECT "
    + ", ".join(f"round(b.{c} - a.{c}, 1) AS {c}_delta" for c in ("recall", "precision", "f1", "grade_acc")) + " FROM a, b",
    "eval_fixes": f"""WITH {RESOLVED}, {GOLDS}, {CURRENT}, {BASE}, bm AS ({_MISSED.format('base')}), cm AS ({_MISSED.format('cur')}), bf AS ({_WRONG.format('base')}), cf AS ({_WRONG.format('cur')})
SELECT (SELECT count(*) FROM (FROM bm EXCEPT FROM cm)) AS miss_fixed, (SELECT count(*) FROM (FROM cm EXCEPT FROM bm)) AS regressed, {_ONLY.format('bf', 'cf')} AS fp_fixed, {_ONLY.format('cf', 'bf')} AS new_fp""",
    "judge_parse": f"WITH {PICKED} SELECT doc_id, seg_id, trim(quote) AS quote, grade, '공개이력' AS category, disclosure_risk, false AS implicit FROM found WHERE length(quote) > 0",
    "colour_grades": """WITH c AS (SELECT doc_id, substr(md5(text), 1, 6) AS colour FROM documents),
v AS (SELECT *, ('0x' || substr(colour, 1, 2))::INT / 255 AS r, ('0x' || substr(colour, 3, 2))::INT / 255 AS g, ('0x' || substr(colour, 5, 2))::INT / 255 AS b FROM c),
w AS (SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS l FROM v),
x AS (SELECT *, CASE WHEN t = l THEN 0 WHEN (t + l) / 2 <= 0.5 THEN (t - l) / (t + l) ELSE (t - l) / (2.0 - t - l) END AS sat,
  CASE WHEN t = l THEN 0 WHEN r = t THEN (g - b) / (t - l) WHEN g = t THEN 2.0 + (b - r) / (t - l) ELSE 4.0 + (r - g) / (t - l) END * 60 AS h0 FROM w),
y AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS hue FROM x),
z AS (SELECT *, least(abs(hue - 52), 360 - abs(hue - 52)) AS d1, least(abs(hue - 190), 360 - abs(hue - 190)) AS d2, least(abs(hue - 10), 360 - abs(hue - 10), abs(hue - 320), 360 - abs(hue - 320)) AS d3 FROM y)
SELECT doc_id, colour, CASE WHEN sat >= 0.15 AND d1 <= least(d2, d3) THEN 'A' ELSE 'B' END AS grade, sat >= 0.15 AND d3 < d1 AND d3 < d2 AS risk FROM z""",
    "batch_pack": f"""WITH RECURSIVE {SEG}, n AS (SELECT doc_id, slide_no, row_number() OVER (PARTITION BY doc_id, slide_no ORDER BY seg_id) AS i, length(text) + 16 AS c FROM seg),
r AS (SELECT doc_id, slide_no, i, c AS size, 1 AS batch FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.slide_no, n.i, CASE WHEN r.size + n.c > 1200 THEN n.c ELSE r.size + n.c END, CASE WHEN r.size + n.c > 1200 THEN r.batch + 1 ELSE r.batch END
  FROM r JOIN n ON n.doc_id = r.doc_id AND n.slide_no = r.slide_no AND n.i = r.i + 1)
SELECT doc_id, slide_no, max(batch)::BIGINT AS n_batches, count(*) FILTER (batch = 1) AS n_first FROM r GROUP BY doc_id, slide_no""",
    "keyword_list": f"""WITH {SEG}, w AS (SELECT doc_id, seg_id, list_distinct(t) AS t, t AS o FROM (SELECT doc_id, seg_id, list_filter(list_transform(regexp_extract_all(text, '{TOKEN}'),
  lambda x: CASE WHEN regexp_matches(x, '[가-힣]') THEN regexp_replace(x, '^(.{{2,}}?)({_PARTICLES})$', '\\1') ELSE x END), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+([.,][0-9]+)?$')) AS t FROM seg)),
u AS (SELECT doc_id, seg_id, x, list_position(o, x) AS i FROM (SELECT doc_id, seg_id, o, unnest(t) AS x FROM w)),
v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, seg_id ORDER BY length(x) DESC, i) <= 4),
a AS (SELECT doc_id, seg_id, string_agg(x, ' ' ORDER BY length(x) DESC, i) AS keywords FROM v GROUP BY ALL)
SELECT seg.doc_id, seg.seg_id, coalesce(keywords, '') AS keywords FROM seg LEFT JOIN a USING (doc_id, seg_id)""",
    "line_join": """WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) > 0) AS p FROM documents)
SELECT doc_id, md5(CASE WHEN len(p) = 0 THEN '' ELSE list_reduce(p, lambda a, x: a || CASE WHEN regexp_matches(a, '[[:space:]]$') OR (regexp_matches(a, '[가-힣]$') AND regexp_matches(x, '^[가-힣]')) THEN '' ELSE ' ' END || x) END) AS joined FROM l""",
}
