"""Answers of a judge: parsing, repair and validation; and a deterministic judge for tests and dry runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import strip

#: Categories an answer may name, and the one that stands for any other.
CATEGORIES = ("구성·구조", "수치·범위한정", "제어·알고리즘", "공정·방법", "효과만기재", "독자성주장", "최적화·조건확립", "문제해결", "비교우위", "블랙박스용어", "공개이력")
FALLBACK = "블랙박스용어"
IMPLICIT = ("효과만기재", "독자성주장", "최적화·조건확립", "문제해결", "비교우위", "블랙박스용어")


def parse_answers(answers: DataFrame) -> DataFrame:
    """Findings of raw answers (doc_id, slide_no, content): JSON, or the outermost braces of what surrounds it.

    Thinking blocks are dropped; the answer is a list or an object with ``findings``; items that are no objects
    don't count. Keys may be short or long; the short one counts if it is there, even with a null. A bad grade
    is C, an unknown category the fallback; implicit follows the category unless given. Flags that are strings
    are true unless empty, whatever they say.
    """
    text = strip(F.regexp_replace("content", r"(?s)<think>.*?</think>", ""))
    whole = F.try_parse_json(text)
    whole = F.coalesce(whole, F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))
    items = F.coalesce(F.try_variant_get(whole, "$.findings", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"))
    x = answers.select("doc_id", "slide_no", F.explode(items).alias("x"))
    x = x.where(F.coalesce(F.schema_of_variant("x"), F.lit("")).startswith("OBJECT"))

    def field(short: str, long: str) -> Column:
        a, b = (F.try_variant_get("x", f"$.{k}", "variant") for k in (short, long))
        return F.when(a.isNotNull(), a).otherwise(b)

    def said(short: str, long: str) -> Column:
        return F.try_variant_get(field(short, long), "$", "string")

    def truth(v: Column) -> Column:
        kind, told = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        filled = F.when(kind == "BOOLEAN", told == "true").when(kind == "STRING", F.length(told) > 0).when(kind == "VOID", False)
        return F.coalesce(filled.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(v).isin("[]", "{}")).otherwise(told.try_cast("double") != 0), F.lit(False))

    grade, category = F.upper(said("g", "grade")), said("c", "category")
    category = F.when(category.isin(*CATEGORIES), category).otherwise(FALLBACK)
    f = x.select(
        "doc_id", "slide_no", said("i", "seg_id").try_cast("int").alias("seg_id"), strip(F.coalesce(said("q", "quote"), F.lit(""))).alias("quote"),
        F.when(grade.isin("A", "B", "C"), grade).otherwise("C").alias("grade"), category.alias("category"), field("m", "implicit").alias("m"),
        truth(field("d", "disclosure_risk")).alias("disclosure_risk"), strip(F.coalesce(said("r", "reason"), F.lit(""))).alias("reason"), F.lit("llm").alias("source"),
    )
    given = F.col("m").isNotNull() & (F.schema_of_variant("m") != "VOID")
    return f.withColumn("implicit", F.when(given, truth(F.col("m"))).otherwise(F.col("category").isin(*IMPLICIT))).drop("m")


def validate(findings: DataFrame, segs: DataFrame) -> DataFrame:
    """Findings whose segment exists."""
    return findings.join(segs.select("doc_id", "seg_id"), ["doc_id", "seg_id"], "left_semi")


def pick_judge(segs: DataFrame, pickers: list[tuple[str, str, str, bool]]) -> DataFrame:
    """A judge without a model: the first picker (pattern, grade, category, risk) that a segment matches makes its one finding."""
    found = None
    for pattern, grade, category, risk in pickers:
        q = F.regexp_extract("text", f"(?iU){pattern}", 0)
        one = F.struct(q.alias("quote"), F.lit(grade).alias("grade"), F.lit(category).alias("category"), F.lit(risk).alias("disclosure_risk"))
        hit = F.when(F.length(q) > 0, one)
        found = hit if found is None else F.coalesce(found, hit)
    f = segs.withColumn("f", found).where("f is not null")
    return f.select("doc_id", "seg_id", "slide_no", "f.*", F.lit(False).alias("implicit"), F.lit("llm").alias("source"))
