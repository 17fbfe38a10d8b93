"""Queries over whole tables, one for each operator family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import evaluate, judge, marks, memory, review, scan
from spanloom.operators.rules import CORPUS
from spanloom.plans.base import findings, scanned, screened, segments, spread, table


def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir)


def prescreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.prescreen(scanned(spark, sf_dir), scan_all=False).select("doc_id", "seg_id", F.size("hits").cast("long").alias("n_hits"))


def lexicon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = scanned(spark, sf_dir).select("doc_id", "seg_id", F.explode("hits").alias("h"))
    return h.select("doc_id", "seg_id", "h.rid", "h.category", "h.weight", "h.s", "h.e", "h.matched")


def lexicon_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).select("doc_id", "seg_id", scan.score(CORPUS).cast("long").alias("score"))


def category_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scanned(spark, sf_dir).where(F.size("hits") > 0)
    return s.select("doc_id", "seg_id", F.array_join(scan.hints(), ",").alias("hints"))


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).select("doc_id", "seg_id", scan.is_noise(CORPUS).alias("noise"), scan.is_status(CORPUS).alias("status"), scan.disclosed().alias("disclosed"))


def rescue_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: scan, score, rescue what rules alone make worth keeping, and merge the spans into marks."""
    return marks.build_marks(scan.rescue(screened(spark, sf_dir), CORPUS))


def readable_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan.rescue(screened(spark, sf_dir), CORPUS)
    return f.select("doc_id", "seg_id", F.col("span.s").alias("s"), F.col("span.e").alias("e"), "category", "disclosure_risk")


def build_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit as a finding of its own, merged."""
    h = scanned(spark, sf_dir).select("doc_id", "seg_id", "slide_no", F.explode("hits").alias("h"))
    grade = F.when(F.col("h.weight") >= 6, "A").when(F.col("h.weight") >= 4, "B").otherwise("C")
    return marks.build_marks(h.select("doc_id", "seg_id", "slide_no", F.struct("h.s", "h.e").alias("span"), grade.alias("grade"), F.col("h.disclosure").alias("disclosure_risk")))


def judge_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("doc_id", "seg_id", "quote", "grade", "category", "disclosure_risk")


def quote_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).join(segments(spark, sf_dir).select("doc_id", "seg_id", "text"), ["doc_id", "seg_id"])
    f = f.withColumn("span", T.locate("text", "quote"))
    return f.select("doc_id", "seg_id", F.col("span.s").alias("s"), F.col("span.e").alias("e"))


def resolve_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = marks.resolve(findings(spark, sf_dir), screened(spark, sf_dir), CORPUS)
    return f.select("doc_id", "seg_id", "grade", "category", "disclosure_risk", "source", F.col("span.s").alias("s"), F.col("span.e").alias("e"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("doc_id", "seg_id", F.posexplode(T.sentences("text")).alias("i", "x"))
    return s.select("doc_id", "seg_id", "i", "x.s", "x.e")


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = scanned(spark, sf_dir).where(F.size("hits") > 0).withColumn("h", F.get("hits", F.lit(0)))
    return h.select("doc_id", "seg_id", T.snippet("text", F.col("h.s"), F.col("h.e")).alias("snippet"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("doc_id", "seg_id", T.normalise("text").alias("norm"), F.size(T.bigrams("text")).cast("long").alias("n_bigrams"))


def keyword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("doc_id", "seg_id", F.array_join(memory.keywords("text"), " ").alias("keywords"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.fingerprint(segments(spark, sf_dir))


def doc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("kind = 'title'")
    return s.groupBy("doc_id").agg(T.strip(F.min_by("text", "seg_id")).alias("title"))


def batch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = review.pack_batches(segments(spark, sf_dir), 1200)
    return b.select("doc_id", "slide_no", F.size("batches").cast("long").alias("n_batches"), F.size(F.get("batches", F.lit(0))).cast("long").alias("n_first"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic corrections: three of the findings' fates by segment, in order of document and segment."""
    f = findings(spark, sf_dir).join(segments(spark, sf_dir).select("doc_id", "seg_id", "text"), ["doc_id", "seg_id"])
    kind = F.when(F.col("seg_id") % 5 == 0, "fp").when(F.col("seg_id") % 7 == 0, "regrade").otherwise("match")
    return f.select((F.shiftleft("doc_id", 32) + F.col("seg_id")).alias("seq"), kind.alias("type"), "text", "quote", "grade", F.col("disclosure_risk").alias("risk"), "category")


def lww_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.fold(corrections(spark, sf_dir)).select(F.md5("para_key").alias("para"), "quote", "kind", "grade", "risk", "seq")


def index_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.consistent(memory.fold(corrections(spark, sf_dir))).select("norm", "kind", "seq")


def pool_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.upsert_pool(corrections(spark, sf_dir)).select("quote", "kind", "seq")


def memory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the benchmark as memory, segments of all documents as queries."""
    s = segments(spark, sf_dir).where(F.length("text") >= 6)
    q = s.select(F.concat_ws("-", "doc_id", "seg_id").alias("qid"), "text")
    m = scan.segments(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    m = m.where(F.length("text") >= 6).select(T.normalise("text").alias("key")).distinct()
    return memory.match_paragraphs(q, m).select("qid", F.md5("key").alias("para"), F.round("score", 6).alias("score"))


def apply_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.apply_excludes(findings(spark, sf_dir), ["10", "tional", "tioned", "4 7"]).select("doc_id", "seg_id", "quote")


#: Queries that are broadcast at most; above that the vectors of either side are dealt to blocks.
FEW_VECTORS, BLOCKS = 20_000, 64


def example_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 100 against all others, blocks of examples by label parity as kinds."""
    e = spread(table(spark, sf_dir, "embeddings"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a"))
    pool = e.select(F.col("vec_id").alias("pool_ord"), F.col("embedding").alias("b"), F.when(F.col("label") % 2 == 0, "include").otherwise("exclude").alias("kind"))
    if q.count() <= FEW_VECTORS:
        pairs = pool.join(F.broadcast(q), F.col("qid") != F.col("pool_ord"))
    else:
        # every block of queries meets every row of the pool, which stays in its partitions
        held = q.groupBy(F.pmod(F.xxhash64("qid"), F.lit(BLOCKS)).alias("block")).agg(F.collect_list(F.struct("qid", "a")).alias("qs"))
        rows = pool.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
        pairs = rows.join(held, "block").select("pool_ord", "b", "kind", F.inline("qs")).where("qid <> pool_ord")
    s = pairs.select("qid", "pool_ord", "kind", F.round(memory.cosine("a", "b"), 6).alias("score"))
    return memory.top_examples(s).select("qid", "kind", "pool_ord", "score")


def _golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third hit is gold, of the grade that its weight gives."""
    h = scanned(spark, sf_dir).select("doc_id", "seg_id", F.posexplode("hits").alias("i", "h")).where("(seg_id + i) % 3 = 0")
    grade = F.when(F.col("h.weight") >= 6, "A").otherwise("B")
    return h.select("doc_id", "seg_id", F.col("i").cast("long").alias("gid"), "h.s", "h.e", grade.alias("grade"), F.col("h.disclosure").alias("risk"))


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = marks.resolve(findings(spark, sf_dir), screened(spark, sf_dir), CORPUS)
    return f.select("doc_id", "seg_id", F.lit(0).cast("long").alias("pid"), F.col("span.s").alias("s"), F.col("span.e").alias("e"), "grade", F.col("disclosure_risk").alias("risk"))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_preds(spark, sf_dir), _golds(spark, sf_dir))


def eval_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From rules alone to judge and rules."""
    base = scan.rescue(screened(spark, sf_dir), CORPUS)
    base = base.select("doc_id", "seg_id", F.lit(0).cast("long").alias("pid"), F.col("span.s").alias("s"), F.col("span.e").alias("e"), "grade", F.col("disclosure_risk").alias("risk"))
    return evaluate.fixes(base, _preds(spark, sf_dir), _golds(spark, sf_dir))


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer who keeps every third hit changes against the resolved findings."""
    human = _golds(spark, sf_dir).withColumnRenamed("gid", "hid")
    model = _preds(spark, sf_dir).withColumnRenamed("pid", "mid")
    return review.counts(review.pair_spans(human, model))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = marks.resolve(findings(spark, sf_dir), screened(spark, sf_dir), CORPUS)
    n = lambda c, name: F.count_if(c).alias(name)
    return f.agg(F.count("*").alias("n"), n(F.col("grade") == "A", "a"), n(F.col("grade") == "B", "b"), n(F.col("disclosure_risk"), "risk"), n(F.col("implicit"), "implicit"), n(F.col("source") == "llm", "llm"), n((F.col("source") == "llm") & F.col("span").isNotNull(), "located")).withColumn("located_share", F.when(F.col("llm") > 0, F.bround(F.col("located") / F.col("llm"), 3)))


def run_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each segment as runs, coloured by their length, every eleventh a tool run."""
    w = segments(spark, sf_dir).select("doc_id", F.col("seg_id").alias("para_id"), F.posexplode(F.split("text", " ")).alias("run_ord", "text"))
    colour = F.when(F.length("text") % 3 == 0, "FFFF00").when(F.length("text") % 3 == 1, "00FFFF")
    return review.run_spans(w.select("doc_id", "para_id", "run_ord", "text", colour.alias("colour"), (F.col("run_ord") % 11 == 10).alias("is_tool")))


def colour_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 6).alias("colour"))
    return c.select("doc_id", "colour", T.colour_grade("colour").alias("g")).select("doc_id", "colour", "g.grade", "g.risk")


def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers built from the findings, in short keys and with talk around them, parsed back."""
    f = findings(spark, sf_dir).where("length(quote) > 0")
    item = F.to_json(F.struct(F.col("seg_id").alias("i"), F.col("quote").alias("q"), F.lower("grade").alias("g"), F.lit("공개이력").alias("c"), F.col("disclosure_risk").alias("d")))
    a = f.select("doc_id", "slide_no", F.concat(F.lit("<think>{no}</think> Here: {\"findings\": ["), item, F.lit("]} done")).alias("content"))
    return judge.validate(judge.parse_answers(a), segments(spark, sf_dir)).select("doc_id", "seg_id", "quote", "grade", "category", "disclosure_risk", "implicit")


QUERIES = {
    f.__name__: f
    for f in (
        rescue_marks, segment_lines, prescreen, lexicon_scan, lexicon_score, category_hints, noise_filter, readable_span, build_marks, judge_pick, quote_locate, resolve_findings,
        sentence_split, snippet, normal_forms, keyword_list, fingerprint, doc_title, batch_pack, lww_fold, index_rules, pool_upsert, memory_match, apply_excludes, example_topk,
        eval_metrics, eval_fixes, review_counts, run_summary, run_spans, colour_grades, judge_parse,
    )
}
