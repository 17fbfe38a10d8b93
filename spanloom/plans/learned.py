"""Queries of learned rules, reviews, examples and page colours, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import history, layout, marks, memory, prompt, recall, review, scan
from spanloom.operators.rules import CORPUS
from spanloom.plans import queries as Q
from spanloom.plans.base import findings, scanned, screened, segments, spread, table
from spanloom.plans.more import PHRASES
from spanloom.plans.oracle import GOLDS, HITS, ORACLE as CORE, PICKED, RESOLVED, SEG, merged, places

#: Keywords as a user could have added them.
KEYWORDS = ["the data", "x", "model"]


def scan_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with added keywords and confirmed phrases among its hits."""
    h = recall.scan_learned(segments(spark, sf_dir), CORPUS, KEYWORDS, PHRASES).select("doc_id", "seg_id", F.explode("hits").alias("h"))
    return h.select("doc_id", "seg_id", "h.rid", "h.category", "h.weight", "h.s", "h.e", "h.matched")


def lexicon_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scanned(spark, sf_dir).select("doc_id", "seg_id", "text", "hits").join(findings(spark, sf_dir).select("doc_id", "seg_id", "quote"), ["doc_id", "seg_id"])
    f = f.withColumn("span", T.locate("text", "quote")).withColumn("x", scan.probe(F.col("span.s"), F.col("span.e")))
    return f.select("doc_id", "seg_id", "x.covered", "x.category")


def markable_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of every hit but those in titles, which stand for text that can't be marked."""
    h = scanned(spark, sf_dir).select("doc_id", "seg_id", "slide_no", F.explode("hits").alias("h"))
    f = h.select("doc_id", "seg_id", "slide_no", F.struct("h.s", "h.e").alias("span"), F.lit("B").alias("grade"), F.col("h.disclosure").alias("disclosure_risk"))
    return marks.build_marks(marks.markable(f, segments(spark, sf_dir).withColumn("markable", F.col("kind") != "title")))


def example_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of documents whose id is divisible by 100 against all benchmark items as examples."""
    q = segments(spark, sf_dir).where("doc_id % 100 = 0").select(F.concat_ws("-", "doc_id", "slide_no").alias("qid"), "text")
    pool = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pool_ord"), F.when(F.length("text") % 2 == 0, "include").otherwise("exclude").alias("kind"), "text")
    s = memory.example_scores(q, pool).withColumn("score", F.round("score", 6))
    return memory.top_examples(s).select("qid", "kind", "pool_ord", "score")


def review_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment as a page; every third hit a reviewer's, a tag after hits 2, 6, ..; even documents have an archive."""
    s = scanned(spark, sf_dir).select("doc_id", "seg_id", F.col("seg_id").alias("slide_no"), F.col("doc_id").cast("string").alias("fingerprint"), "text", "hits")
    human = F.filter("hits", lambda h, i: (F.col("seg_id") + i) % 3 == 0)
    human = F.transform(human, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"), F.when(h["weight"] >= 6, "A").otherwise("B").alias("grade"), h["disclosure"].alias("risk")))
    tags = F.transform(F.filter("hits", lambda h, i: i % 4 == 1), lambda h: h["e"])
    f = marks.resolve(findings(spark, sf_dir), screened(spark, sf_dir), CORPUS).where("doc_id % 2 = 0")
    f = f.join(segments(spark, sf_dir).select("doc_id", "seg_id", "text"), ["doc_id", "seg_id"])
    archive = f.select(F.col("doc_id").cast("string").alias("fingerprint"), F.col("seg_id").alias("slide_no"), "text", F.lit(0).alias("mid"), F.col("span.s").alias("s"), F.col("span.e").alias("e"), "grade", F.col("disclosure_risk").alias("risk"), "category")
    return review.diff(s.withColumn("human", human).withColumn("tags", tags), archive)


def _hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id")).withColumn("x", F.md5(F.col("doc_id").cast("string")))


def page_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of one to four numbers, from hashes of the ids, and how each is covered on a ground of another."""
    at = lambda i: F.conv(F.substring("x", 2 * i + 1, 2), 16, 10).cast("int") / 255
    d = _hex(spark, sf_dir).withColumn("v", F.slice(F.array(*[at(i) for i in range(4)]), F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")))
    d = d.withColumn("c", layout.page_rgb("v")).withColumn("k", layout.cover(F.col("c"), layout.page_rgb(F.array(*[at(i) for i in range(4, 7)]))))
    return d.where("c is not null").select("doc_id", *[F.round(F.col("c")[n], 9).alias(n) for n in "rgb"], "k.blend", F.round("k.strength", 9).alias("strength"))


def dark_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _hex(spark, sf_dir)
    own, slide = F.when(F.col("doc_id") % 3 > 0, F.substring("x", 1, 6)), F.when(F.col("doc_id") % 5 > 0, F.substring("x", 7, 6))
    return d.select("doc_id", layout.is_dark(own, slide).alias("dark"))


def list_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document's first line against those of its second."""
    words = lambda k, name: segments(spark, sf_dir).where(F.col("seg_id") == k).select("doc_id", F.split("text", " ").alias(name))
    d = words(1, "before").join(words(2, "after"), "doc_id").withColumn("x", history.list_changes("before", "after"))
    return d.select("doc_id", F.array_join("x.added", " ").alias("added"), F.array_join("x.removed", " ").alias("removed"))


def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = memory.fold(Q.corrections(spark, sf_dir))
    return history.memory_stats(folded, memory.consistent(folded), review.upsert_pool(Q.corrections(spark, sf_dir)))


def slide_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompt.slide_prompts(scanned(spark, sf_dir).withColumn("hints", scan.hints()))
    return p.select("doc_id", "slide_no", F.md5("prompt").alias("prompt"))


def first_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as review files, the last digit of their length as fingerprint and every ninth broken."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "n_chars"))
    f = d.select(F.col("doc_id").alias("ord"), F.concat(F.lit("f"), F.col("doc_id")).alias("filename"), (F.col("n_chars") % 10).cast("string").alias("fingerprint"), F.when(F.col("doc_id") % 9 == 0, "broken").alias("error"))
    return review.first_reviews(f)


QUERIES = {f.__name__: f for f in (scan_learned, lexicon_probe, markable_marks, example_bigrams, review_diff, page_colours, dark_ground, list_changes, memory_stats, slide_prompts, first_reviews)}


def _phrase(rule: recall.PhraseRule) -> str:
    """(doc_id, seg_id, rid, category, s, e, matched) of a phrase of at most 40 characters: itself, else its words in one sentence."""
    told = f"'{rule.rid}' AS rid, '{rule.category}' AS category"
    whole = f"SELECT doc_id, seg_id, {told}, s, (s + length(m))::INT AS e, m AS matched FROM (SELECT *, regexp_replace(matched, '\\s+$', '') AS m FROM ({places(recall.phrase_pattern(rule.quote))}) WHERE k = 1)"
    if len(rule.tokens) < 2:
        return whole
    at = [f"instr(part, '{t}')" for t in rule.tokens]
    lo, hi = f"least({', '.join(at)})", f"greatest({', '.join(f'{a} - 1 + {len(t)}' for a, t in zip(at, rule.tokens))})"
    words = f"""SELECT doc_id, seg_id, {told}, (s + {lo} - 1)::INT AS s, (s + {hi})::INT AS e, substr(part, {lo}, {hi} - {lo} + 1) AS matched FROM sent
WHERE {lo} > 0 AND (doc_id, seg_id) NOT IN (SELECT (doc_id, seg_id) FROM ({whole})) QUALIFY row_number() OVER (PARTITION BY doc_id, seg_id ORDER BY s) = 1"""
    return f"({whole}) UNION ALL ({words})"


_SENT = f"""cut AS ({places('[.!?。][[:space:]]+|' + chr(10))}),
fin AS (SELECT doc_id, seg_id, e FROM cut UNION SELECT doc_id, seg_id, length(text)::INT FROM seg),
sent AS (SELECT doc_id, seg_id, s, substr(text, s + 1, e - s) AS part FROM (SELECT doc_id, seg_id, coalesce(lag(e) OVER (PARTITION BY doc_id, seg_id ORDER BY e), 0) AS s, e FROM fin) JOIN seg USING (doc_id, seg_id))"""
_LEARNT = "phrased AS (" + " UNION ALL ".join(_phrase(r) for r in PHRASES) + ")"


def _keyword(i: int, k: str) -> str:
    return f"SELECT doc_id, seg_id, 'USER_{i}', '사용자추가', 8, s, e, matched FROM ({places('(?i)' + '\\s*'.join(k.split()))})"


def _probed(source: str, columns: str) -> str:
    """columns, covered and category of spans (doc_id, seg_id, s, e)."""
    return f"""SELECT {columns}, bool_or(h.rid IS NOT NULL) AS covered, arg_min(h.category, -h.weight::BIGINT * 1000000000 + h.ro * 1000000 + h.k) AS category
FROM {source} f LEFT JOIN hits h ON h.doc_id = f.doc_id AND h.seg_id = f.seg_id AND h.e > f.s AND h.s < f.e GROUP BY {columns}"""


def _grams(text: str) -> str:
    bare = f"regexp_replace(lower(regexp_replace({text}, '\\s+', '', 'g')), '[0-9]', '0', 'g')"
    return f"list_transform([{bare}], lambda z: list_distinct(CASE WHEN length(z) > 1 THEN list_transform(generate_series(1, length(z) - 1), lambda i: substr(z, i, 2)) WHEN length(z) = 1 THEN [z] ELSE [] END))[1]"


_DICE = "2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g))"
_KEY = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_HEX = "hx AS (SELECT doc_id, md5(doc_id::VARCHAR) AS x FROM documents)"


def _byte(i: int) -> str:
    return f"('0x' || substr(x, {2 * i + 1}, 2))::INT / 255"


def _bright(first: int) -> str:
    return " + ".join(f"{w}::DOUBLE * {_byte(first + i)}" for i, w in enumerate((0.2126, 0.7152, 0.0722)))


_C = [f"CASE n WHEN 1 THEN v[1] WHEN 3 THEN v[{i}] ELSE (1 - v[{i}]) * (1 - v[4]) END AS {c}" for i, c in enumerate("rgb", 1)]
_WORDS = "string_split(min(text) FILTER (seg_id = {0}), ' ')"
_KIND = "CASE kind WHEN 'title' THEN '" + prompt.KINDS["title"] + "' ELSE '" + prompt.KINDS["body"] + "' END"
ORACLE = {
    "slide_prompts": f"""WITH {HITS}, c AS (SELECT doc_id, seg_id, string_agg(DISTINCT category, ', ' ORDER BY category) AS cats FROM hits GROUP BY ALL),
d AS (SELECT doc_id, max(slide_no) AS total, trim(min(text) FILTER (kind = 'title')) AS title FROM seg GROUP BY doc_id),
s AS (SELECT doc_id, slide_no, string_agg('#' || seg_id || ' [' || {_KIND} || '] ' || text, chr(10) ORDER BY seg_id) AS shown, string_agg('#' || seg_id || ' → ' || cats, chr(10) ORDER BY seg_id) AS told FROM seg LEFT JOIN c USING (doc_id, seg_id) GROUP BY ALL)
SELECT doc_id, slide_no, md5(concat_ws(chr(10), '문서: ' || title, '슬라이드 ' || slide_no || ' / 전체 ' || total, '', '{prompt.LIST_HEAD}', shown,
  CASE WHEN told IS NOT NULL THEN concat_ws(chr(10), '', '{prompt.HINT_HEAD}', told, '{prompt.HINT_NOTE}') END, '', '{prompt.REQUEST}')) AS prompt FROM s JOIN d USING (doc_id)""",
    "first_reviews": """WITH f AS (SELECT doc_id AS ord, 'f' || doc_id AS filename, (n_chars % 10)::VARCHAR AS fingerprint, CASE WHEN doc_id % 9 = 0 THEN 'broken' END AS error FROM documents),
g AS (SELECT fingerprint, min(ord) AS o FROM f WHERE error IS NULL GROUP BY fingerprint)
SELECT f.*, CASE WHEN error IS NULL AND o <> ord THEN 'f' || o END AS duplicate_of FROM f LEFT JOIN g USING (fingerprint)""",
    "phrase_rules": f"WITH {SEG}, {_SENT}, {_LEARNT} SELECT doc_id, seg_id, rid, s, e, matched FROM phrased",
    "scan_learned": f"WITH {HITS}, {_SENT}, {_LEARNT} SELECT doc_id, seg_id, rid, category, weight, s, e, matched FROM hits UNION ALL "
    + " UNION ALL ".join(_keyword(i, k) for i, k in enumerate(KEYWORDS, 1) if len(k) >= 2) + " UNION ALL SELECT doc_id, seg_id, rid, category, 8, s, e, matched FROM phrased",
    "lexicon_probe": f"""WITH {HITS}{PICKED.removeprefix(SEG)}, spans AS (SELECT doc_id, seg_id, instr(text, quote) - 1 AS s, instr(text, quote) - 1 + length(quote) AS e FROM found)
SELECT doc_id, seg_id, covered, category FROM ({_probed('spans', 'f.doc_id, f.seg_id, f.s, f.e')})""",
    "markable_marks": f"WITH {HITS}, {merged('SELECT doc_id, seg_id, slide_no, s, e, 2 AS r, disclosure AS risk FROM hits WHERE seg_id > 1')}",
    "example_bigrams": f"""WITH {SEG}, a AS (SELECT doc_id || '-' || slide_no AS qid, {_grams('text')} AS g FROM seg WHERE doc_id % 100 = 0 AND length(trim(text)) >= 6),
b AS (SELECT item_id AS pool_ord, CASE WHEN length(text) % 2 = 0 THEN 'include' ELSE 'exclude' END AS kind, {_grams('text')} AS g FROM benchmark),
s AS (SELECT qid, kind, pool_ord, round(max({_DICE}), 6) AS score FROM a, b GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, pool_ord) <= CASE WHEN kind = 'include' THEN 8 ELSE 4 END""",
    "review_diff": f"""WITH {RESOLVED}, {GOLDS}, arch AS (SELECT * FROM resolved WHERE doc_id % 2 = 0), known AS (SELECT DISTINCT doc_id FROM arch),
ov AS (SELECT doc_id, seg_id, min(i) AS i FROM golds g JOIN arch a USING (doc_id, seg_id) WHERE a.e > g.s AND a.s < g.e GROUP BY ALL),
alone AS (SELECT * FROM golds WHERE (doc_id, seg_id, i) NOT IN (SELECT (doc_id, seg_id, i) FROM ov)),
tags AS (SELECT doc_id, seg_id, greatest(0, e - 30) AS s, e FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seg_id ORDER BY ro, k) - 1 AS i FROM hits) t WHERE i % 4 = 1 AND doc_id NOT IN (FROM known)
  AND NOT EXISTS (SELECT 1 FROM golds g WHERE g.doc_id = t.doc_id AND g.seg_id = t.seg_id AND abs(g.e - t.e) <= 2)),
lost AS (SELECT *, row_number() OVER () AS n FROM tags)
SELECT doc_id, seg_id, 'archive' AS mode, CASE WHEN g.grade = a.grade AND g.risk = a.disclosure_risk THEN 'match' ELSE 'regrade' END AS type, g.s, g.e, g.grade, g.risk, a.category,
  CASE WHEN type = 'regrade' THEN a.grade END AS from_grade, CASE WHEN type = 'regrade' THEN a.disclosure_risk END AS from_risk, NULL::BOOLEAN AS lexicon_gap
FROM ov JOIN golds g USING (doc_id, seg_id, i) JOIN arch a USING (doc_id, seg_id)
UNION ALL SELECT doc_id, seg_id, CASE WHEN doc_id IN (FROM known) THEN 'archive' ELSE 'labels' END, CASE WHEN doc_id IN (FROM known) THEN 'miss' ELSE 'gold' END, s, e, grade, risk, category, NULL, NULL, NOT covered
FROM ({_probed('alone', 'f.doc_id, f.seg_id, f.i, f.s, f.e, f.grade, f.risk')})
UNION ALL SELECT doc_id, seg_id, 'archive', 'fp', s, e, grade, disclosure_risk, category, NULL, NULL, NULL FROM arch WHERE (doc_id, seg_id) NOT IN (SELECT (doc_id, seg_id) FROM ov)
UNION ALL SELECT doc_id, seg_id, 'labels', 'fp', s, e, 'B', false, category, NULL, NULL, NULL FROM ({_probed('lost', 'f.doc_id, f.seg_id, f.n, f.s, f.e')})""",
    "page_colours": f"""WITH {_HEX}, a AS (SELECT doc_id, doc_id % 4 + 1 AS n, [{', '.join(_byte(i) for i in range(4))}] AS v, 0.30::DOUBLE * {_byte(4)} + 0.59::DOUBLE * {_byte(5)} + 0.11::DOUBLE * {_byte(6)} AS lb FROM hx),
b AS (SELECT doc_id, lb, {', '.join(_C)} FROM a WHERE n <> 2), c AS (SELECT *, 0.30::DOUBLE * r + 0.59::DOUBLE * g + 0.11::DOUBLE * b AS lh FROM b)
SELECT doc_id, round(r, 9) AS r, round(g, 9) AS g, round(b, 9) AS b, CASE WHEN lb >= lh THEN 'dodge' ELSE 'multiply' END AS blend, round(CASE WHEN lb >= lh THEN least(0.97::DOUBLE, greatest(0, 1 - lh / lb + 0.03::DOUBLE)) ELSE lb / lh END, 9) AS strength FROM c""",
    "dark_ground": f"""WITH {_HEX} SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN {_bright(0)} < 0.45 WHEN doc_id % 5 > 0 THEN {_bright(3)} < 0.45 ELSE false END AS dark FROM hx""",
    "list_changes": f"""WITH {SEG}, w AS (SELECT doc_id, {_WORDS.format(1)} AS b, {_WORDS.format(2)} AS a FROM seg GROUP BY doc_id HAVING count(*) > 1)
SELECT doc_id, coalesce(array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' '), '') AS added, coalesce(array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ' '), '') AS removed FROM w""",
    "memory_stats": f"""WITH r AS ({CORE['index_rules']}), f AS ({CORE['lww_fold']}), p AS ({CORE['pool_upsert']})
SELECT (SELECT count(DISTINCT para) FROM f) AS paras, (SELECT count(*) FROM r WHERE kind = 'gold') AS rules, (SELECT count(*) FROM r WHERE kind = 'neg') AS excludes, (SELECT count(*) FROM p) AS examples""",
    "memory_match": f"""WITH {SEG}, bl AS (SELECT item_id, unnest(string_split(text, chr(10))) AS text FROM benchmark),
b AS (SELECT DISTINCT {_KEY} AS key FROM bl WHERE length(text) >= 6 AND regexp_matches(text, '[^\\s]')), bg AS (SELECT key, {_grams('key')} AS g FROM b),
a0 AS (SELECT doc_id || '-' || seg_id AS qid, {_KEY} AS key FROM seg WHERE length(text) >= 6), ag AS (SELECT qid, key, {_grams('key')} AS g FROM a0 WHERE key NOT IN (SELECT key FROM b)),
s AS (SELECT qid, b.key, {_DICE} AS score FROM ag a JOIN bg b ON abs(length(b.key) - length(a.key)) <= greatest(20, floor(length(a.key) * 0.3)))
SELECT qid, md5(key) AS para, 1.0::DOUBLE AS score FROM a0 WHERE key IN (SELECT key FROM b)
UNION ALL SELECT qid, md5(key), round(score, 6) FROM (SELECT * FROM s WHERE score >= 0.9 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) = 1)""",
}
