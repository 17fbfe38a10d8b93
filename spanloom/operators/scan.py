"""Segments of documents, the rule scan with places, and what follows from a segment's hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import overlaps
from spanloom.functions.text import col, matches, readable, strip
from spanloom.operators.rules import Pack, Rule

#: Texts that are no content, fixed values.
SKIP_LABELS = ("대외비", "목차", "감사합니다", "Agenda", "Q&A")


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seg_id, slide_no, kind, text): non-blank lines in order, five to a slide, the first one the title."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(r"(?U)\S"))
    df = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("i", "text"))
    kind = F.when(F.col("i") == 0, "title").otherwise("body")
    return df.select("doc_id", (F.col("i") + 1).alias("seg_id"), (F.floor(F.col("i") / 5) + 1).cast("int").alias("slide_no"), kind.alias("kind"), "text")


def scan(segs: DataFrame, pack: Pack, text_col: str = "text") -> DataFrame:
    """Adds ``hits``: every match of every rule, in rule order, then in text order. Matches of white space alone are none.

    One literal pattern per rule keeps the scan in the JVM and free of joins; hits stay with their row, so what
    follows needs no join either.
    """
    return segs.withColumn("hits", F.flatten(F.array(*[_hits(rule, text_col) for rule in pack.rules])))


def _hits(rule: Rule, text_col: str) -> Column:
    solid = F.filter(matches(text_col, rule.pattern), lambda x: x["matched"].rlike(r"(?U)\S"))
    told = [F.lit(rule.rid).alias("rid"), F.lit(rule.category).alias("category"), F.lit(rule.weight).alias("weight")]
    return F.transform(solid, lambda x: F.struct(*told, x["s"].alias("s"), x["e"].alias("e"), x["matched"].alias("matched"), F.lit(rule.disclosure).alias("disclosure")))


def prescreen(segs: DataFrame, min_chars: int = 6, scan_all: bool = True) -> DataFrame:
    """Segments worth judging; with ``scan_all`` off, only those with hits."""
    df = segs.where(F.length("text") >= min_chars).where(~strip("text").isin(*SKIP_LABELS))
    return df if scan_all else df.where(F.size("hits") > 0)


def score(pack: Pack, text: str = "text", hits: str = "hits") -> Column:
    """Sum of weights, 4 for each further category, less 6 for each noise word; not below 0."""
    total = F.aggregate(hits, F.lit(0), lambda a, h: a + h["weight"])
    kinds = F.size(F.array_distinct(F.transform(hits, lambda h: h["category"])))
    noise = F.regexp_count(F.col(text), F.lit(f"(?iU){pack.noise}"))
    return F.when(F.size(hits) == 0, 0).otherwise(F.greatest(F.lit(0), total + 4 * (kinds - 1) - 6 * noise))


def categories(hits: str | Column = "hits") -> Column:
    """Categories in order of first appearance."""
    return F.array_distinct(F.transform(col(hits), lambda h: h["category"]))


def hints(hits: str | Column = "hits") -> Column:
    """Sorted categories."""
    return F.array_sort(categories(hits))


def disclosed(hits: str | Column = "hits") -> Column:
    return F.exists(col(hits), lambda h: h["disclosure"])


def is_noise(pack: Pack, s: Column | None = None, e: Column | None = None, text: str = "text", hits: str = "hits") -> Column:
    """Whether a span (the whole text without one) has a noise word and no technical hit on it."""
    lo = F.lit(0) if s is None else s
    hi = F.length(text) if e is None else e
    shield = F.exists(hits, lambda h: h["category"].isin(*pack.technical) & overlaps(h["s"], h["e"], lo, hi))
    return F.substr(F.col(text), lo + 1, hi - lo).rlike(f"(?iU){pack.noise}") & ~shield


def is_status(pack: Pack, s: Column | None = None, e: Column | None = None, text: str = "text") -> Column:
    """Whether a span speaks of administrative status."""
    lo = F.lit(0) if s is None else s
    hi = F.length(text) if e is None else e
    return F.substr(F.col(text), lo + 1, hi - lo).rlike(f"(?iU){pack.status}")


def best_hit(hits: str = "hits") -> Column:
    """The hit of the largest weight, the first of equals."""
    order = F.array_max(F.transform(hits, lambda h, i: F.struct(h["weight"].alias("w"), (-i).alias("i"))))
    return F.get(hits, -order["i"])


def probe(s: Column, e: Column, hits: str | Column = "hits") -> Column:
    """(covered, category): whether any hit lies on a span, and the category of the heaviest that does, the first of equals."""
    on = F.filter(col(hits), lambda h: overlaps(h["s"], h["e"], s, e))
    top = F.array_max(F.transform(on, lambda h, i: F.struct(h["weight"].alias("w"), (-i).alias("i"))))
    return F.struct((F.size(on) > 0).alias("covered"), F.get(F.transform(on, lambda h: h["category"]), -top["i"]).alias("category"))


def rescued(pack: Pack, least: int = 8) -> Column:
    """The finding of a scanned segment that rules alone make worth keeping: a score of ``least`` or a disclosure, and no mere noise; else null."""
    risk, top = disclosed(), best_hit()
    span = readable("text", top["s"], top["e"])
    finding = F.struct(
        strip(F.substr(F.col("text"), span["s"] + 1, span["e"] - span["s"])).alias("quote"), F.lit("B").alias("grade"), top["category"].alias("category"),
        top["category"].isin(*pack.implicit).alias("implicit"), risk.alias("disclosure_risk"), F.lit("lexicon").alias("source"), span.alias("span"),
    )
    return F.when((F.size("hits") > 0) & ((score(pack) >= least) | risk) & (~is_noise(pack) | risk), finding)


def rescue(scanned: DataFrame, pack: Pack, least: int = 8) -> DataFrame:
    """The findings of all scanned segments that rules alone make worth keeping. Give it what prescreen() left."""
    return scanned.select("doc_id", "seg_id", "slide_no", rescued(pack, least).alias("f")).where("f is not null").select("doc_id", "seg_id", "slide_no", "f.*")
