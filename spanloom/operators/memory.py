"""Learning from corrections: the index, paragraph matches, exclusions, similar examples."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import bigrams, dice, normalise, strip
from spanloom.operators.recall import phrase_pattern

GOLD = ("match", "miss", "regrade", "gold")
#: Particles that end a Korean word, in the order they are tried.
PARTICLES = (
    "으로써", "으로서", "으로는", "에서는", "에서", "에게", "까지", "부터", "이며", "하며", "하고", "되어", "된다", "한다", "하는", "되는", "으로", "로써", "로서", "이다",
    "였다", "된", "한", "들", "의", "을", "를", "이", "가", "은", "는", "도", "과", "와", "에", "로", "만",
)
#: Fixed value: pattern of a word.
TOKEN = "[가-힣A-Za-z0-9㎛㎜%±°~]+"


def keywords(quote: str = "quote", limit: int = 4):
    """The longest words of a quote, without particles, of two characters or more, not mere numbers; equals in order."""

    def bare(t):
        out = t
        for p in reversed(PARTICLES):
            out = F.when(t.endswith(p) & (F.length(t) - len(p) >= 2) & t.rlike("[가-힣]"), F.substr(t, F.lit(1), F.length(t) - len(p))).otherwise(out)
        return out

    words = F.transform(F.regexp_extract_all(F.coalesce(F.col(quote), F.lit("")), F.lit(TOKEN), F.lit(0)), bare)
    words = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^[0-9]+(?:[.,][0-9]+)?$")))
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda x: x["w"]), 1, limit)


def fold(corrections: DataFrame) -> DataFrame:
    """(para_key, quote, kind, grade, risk, category, seq, para_at, quote_at): the last record of each quote of each paragraph.

    ``corrections``: seq, type, text, quote, grade, risk, category. Texts under 6 characters, empty quotes and
    other types don't count; a type outside the gold ones and fp still takes the place of earlier records.
    para_at and quote_at tell where the paragraph and the quote in it came first, which later records don't move.
    """
    c = corrections.withColumn("text", strip("text")).withColumn("quote", strip("quote")).where("length(text) >= 6 and length(quote) > 0")
    c = c.withColumn("para_key", normalise("text"))
    one = Window.partitionBy("para_key", "quote")
    c = c.withColumn("quote_at", F.min("seq").over(one)).withColumn("n", F.row_number().over(one.orderBy(F.desc("seq"))))
    c = c.withColumn("para_at", F.min("quote_at").over(Window.partitionBy("para_key"))).where("n = 1")
    kind = F.when(F.col("type").isin(*GOLD), "gold").when(F.col("type") == "fp", "neg")
    return c.select("para_key", "quote", kind.alias("kind"), F.upper(F.coalesce("grade", F.lit("B"))).alias("grade"), F.coalesce("risk", F.lit(False)).alias("risk"), "category", "seq", "para_at", "quote_at").where("kind is not null")


def paragraphs(corrections: DataFrame) -> DataFrame:
    """(para_key, text, date, grams): of each remembered paragraph its longest text (the first of equals), its last date that is not empty, and its bigrams."""
    c = corrections.withColumn("text", strip("text")).where("length(text) >= 6").withColumn("para_key", normalise("text"))
    dated = F.when(F.length("date") > 0, F.col("seq"))
    p = c.groupBy("para_key").agg(F.max_by("text", F.struct(F.length("text"), -F.col("seq"))).alias("text"), F.max_by("date", dated).alias("date"))
    return p.withColumn("grams", bigrams("text"))


def without_sources(index: DataFrame, exclude_keys: DataFrame) -> DataFrame:
    """An index without what came from the given paragraphs: for scoring a paragraph without itself."""
    return index.join(exclude_keys.select("para_key"), "para_key", "left_anti")


def consistent(folded: DataFrame, least_gold: int = 3, least_neg: int = 6) -> DataFrame:
    """Without quotes that are gold somewhere and wrong elsewhere; the first paragraph of a quote, by where it came first, stands for all.

    Normalised quotes under ``least_gold`` characters make no rule and under ``least_neg`` no exclusion, but still conflict.
    """
    q = folded.withColumn("norm", normalise("quote"))
    clean = q.groupBy("norm").agg(F.count_distinct("kind").alias("kinds")).where("kinds = 1").select("norm")
    q = q.where(F.length("norm") >= F.when(F.col("kind") == "gold", least_gold).otherwise(least_neg))
    first = Window.partitionBy("norm").orderBy("para_at", "para_key", "quote_at")
    return q.join(clean, "norm").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def match_paragraphs(queries: DataFrame, memory: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(qid, key, score): for each query text the remembered paragraph that is equal or most similar.

    ``queries``: qid, text. ``memory``: key (normalised text, distinct). Equal keys first, by an equi join. The
    rest by an exact prefix-filtered join on bigrams, rarest first over the memory: a pair of Dice at least t
    shares at least ceil(c * t / (2 - t)) of the c bigrams of either side, so it shares one of its first
    c minus that plus 1. Lengths may differ by 20 or by 3 tenths of the query's. Ties: the smallest key.
    """
    q = queries.withColumn("key", normalise("text")).withColumn("grams", bigrams("key"))
    exact = q.join(memory.select("key"), "key").select("qid", "key", F.lit(1.0).alias("score"))
    rest = q.join(exact.select("qid"), "qid", "left_anti").where(F.size("grams") > 0)
    m = memory.select("key").withColumn("grams", bigrams("key"))
    seen = m.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        x = df.select(name, F.explode("grams").alias("g"), F.size("grams").alias("c")).join(seen, "g", "left")
        by = Window.partitionBy(name).orderBy(F.coalesce("n", F.lit(0)), "g")
        keep = F.col("c") - F.ceil(F.col("c") * F.lit(similarity / (2 - similarity)) - 1e-9) + 1
        return x.withColumn("i", F.row_number().over(by)).where(F.col("i") <= keep).select(name, "g")

    pairs = prefix(rest, "qid").join(prefix(m, "key"), "g").select("qid", "key").distinct()
    pairs = pairs.join(rest.select("qid", F.col("key").alias("qkey"), F.col("grams").alias("qg")), "qid").join(m, "key")
    n = F.length("qkey")
    pairs = pairs.where(F.abs(F.length("key") - n) <= F.greatest(F.lit(20), F.floor(n * 0.3))).withColumn("score", dice("qg", "grams"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    near = pairs.where(F.col("score") >= similarity).withColumn("i", F.row_number().over(best)).where("i = 1").select("qid", "key", "score")
    return exact.unionByName(near)


def apply_excludes(findings: DataFrame, excludes: Iterable[str]) -> DataFrame:
    """Findings without those whose quote holds an excluded one, lies in it, or is it with other numbers and blanks; memory and disclosure stay.

    ``excludes``: the quotes that people rejected, of a curated list. They become literal conditions of one plan,
    as rules do, so findings keep their row and nothing is joined.
    """
    q = normalise("quote")
    bound = (F.col("source") == "memory") | F.col("disclosure_risk")

    def hit(text: str):
        norm, pattern = " ".join(text.split()).lower(), phrase_pattern(text)
        found = q.contains(norm) | ((F.length(q) >= 6) & F.lit(norm).contains(q))
        return found | F.col("quote").rlike(f"(?U){pattern}") if pattern else found

    told = [hit(x) for x in excludes if x and x.strip()]
    return findings.where(bound | ~reduce(or_, told)) if told else findings


def example_scores(queries: DataFrame, pool: DataFrame, k: int = 8) -> DataFrame:
    """(qid, pool_ord, kind, score): the greatest Dice coefficient of an example's bigrams with those of any text of a query.

    ``queries``: qid, text (several rows a query; under 6 characters they don't count). ``pool``: pool_ord, kind,
    text. Pairs meet by an equi join on bigrams. Examples that share none score 0: of these the first ``k`` of each
    kind come with every query, which is as many as top_examples() can take.
    """
    q = queries.where(F.length(strip("text")) >= 6).withColumn("grams", bigrams("text")).where(F.size("grams") > 0)
    q = q.select("qid", F.xxhash64("grams").alias("part"), "grams").dropDuplicates(["qid", "part"])
    p = pool.withColumn("grams", bigrams("text"))
    told = p.select("pool_ord", "kind", F.size("grams").alias("m"), F.explode("grams").alias("g"))
    both = q.select("qid", "part", F.size("grams").alias("n"), F.explode("grams").alias("g")).join(told, "g")
    both = both.groupBy("qid", "part", "pool_ord", "kind", "n", "m").agg(F.count("*").alias("c"))
    scored = both.groupBy("qid", "pool_ord", "kind").agg(F.max(2.0 * F.col("c") / (F.col("n") + F.col("m"))).alias("score"))
    first = p.withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy("pool_ord"))).where(F.col("i") <= k)
    # at most k rows of each kind, so one array holds them
    first = first.agg(F.collect_list(F.struct("pool_ord", "kind")).alias("x"))
    rest = q.select("qid").distinct().join(F.broadcast(first)).select("qid", F.inline("x")).select("qid", "pool_ord", "kind", F.lit(0.0).alias("score"))
    return scored.unionByName(rest).groupBy("qid", "pool_ord", "kind").agg(F.max("score").alias("score"))


def top_examples(scores: DataFrame, k_include: int = 8, k_exclude: int = 4) -> DataFrame:
    """The best examples of each kind by score, pool order breaking ties. ``scores``: qid, pool_ord, kind, score."""
    w = Window.partitionBy("qid", "kind").orderBy(F.desc("score"), "pool_ord")
    k = F.when(F.col("kind") == "include", k_include).otherwise(k_exclude)
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def cosine(a: str, b: str):
    """Cosine of two vectors; a vector of zeros counts as of length 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    safe = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot / (safe(norm(a)) * safe(norm(b)))
