"""Reconciling findings with the scan, and planning marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import overlaps
from spanloom.functions.text import locate
from spanloom.operators.rules import Pack
from spanloom.operators.scan import disclosed, is_noise, is_status, rescued

KEYS = ["doc_id", "seg_id"]


def rank(grade: str = "grade"):
    return F.when(F.col(grade) == "A", 3).when(F.col(grade) == "B", 2).otherwise(1)


def build_marks(findings: DataFrame, whole_text: str = "text") -> DataFrame:
    """(doc_id, seg_id, slide_no, s, e, grade, risk): spans of a segment that overlap or touch become one.

    The grade is the best and the risk any of those merged. One finding without a span marks the whole segment
    once (s and e null). Islands by running maximum, within (doc_id, seg_id).
    """
    f = findings.select(*KEYS, "slide_no", F.col("span.s").alias("s"), F.col("span.e").alias("e"), rank().alias("r"), F.col("disclosure_risk").alias("risk"))
    every = Window.partitionBy(*KEYS)
    f = f.withColumn("whole", F.max(F.col("s").isNull()).over(every))
    before = every.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("new", F.when(F.col("whole"), 0).otherwise((F.col("s") > F.coalesce(F.max("e").over(before), F.lit(-1))).cast("int")))
    f = f.withColumn("island", F.when(F.col("whole"), 0).otherwise(F.sum("new").over(every.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))))
    m = f.groupBy(*KEYS, "slide_no", "island").agg(
        F.when(F.max("whole"), None).otherwise(F.min("s")).alias("s"), F.when(F.max("whole"), None).otherwise(F.max("e")).alias("e"), F.max("r").alias("r"), F.max("risk").alias("risk")
    )
    return m.select(*KEYS, "slide_no", "s", "e", F.when(F.col("r") == 3, "A").when(F.col("r") == 2, "B").otherwise("C").alias("grade"), "risk")


def markable(findings: DataFrame, segs: DataFrame) -> DataFrame:
    """Findings whose segment exists and can be marked. ``segs``: doc_id, seg_id, markable; give build_marks() the rest."""
    return findings.join(segs.where("markable").select(*KEYS), KEYS, "left_semi")


def resolve(findings: DataFrame, scanned: DataFrame, pack: Pack, least: int = 8) -> DataFrame:
    """Findings of a judge, reconciled with the scan; the order of the steps counts.

    Locate quotes (not found: the whole text, without a span); drop claims of disclosure that are mere status;
    grade noise down to C; rescue segments without a finding, for which dropped ones don't count but those
    graded down do; raise the risk where a segment has a disclosure and a hit of that category lies on the
    span; drop what is C without risk.

    ``scanned``: the segments that prescreen() left. They are scanned once: one join by segment brings each its
    findings, and a window over the same partitioning tells which segments have none that counts.
    """
    told = ["quote", "grade", "category", "implicit", "disclosure_risk", "source"]
    j = scanned.select(*KEYS, "slide_no", "text", "hits").join(findings.select(*KEYS, F.struct(*told).alias("f")), KEYS, "left")
    f = F.col("f")
    j = j.withColumn("span", F.when(f.isNotNull(), locate("text", f["quote"])))
    s, e = F.col("span.s"), F.col("span.e")
    lo, hi = F.coalesce(s, F.lit(0)), F.coalesce(e, F.length("text"))
    real = F.col("span").isNotNull() & F.exists("hits", lambda h: h["disclosure"] & overlaps(h["s"], h["e"], s, e))
    counts = f.isNotNull() & ~(f["disclosure_risk"] & (f["source"] == "llm") & is_status(pack, lo, hi) & ~real)
    segment = Window.partitionBy(*KEYS)
    j = j.withColumn("counts", F.coalesce(counts, F.lit(False))).withColumn("covered", F.max("counts").over(segment)).withColumn("i", F.row_number().over(segment.orderBy(F.lit(0))))
    grade = F.when(~f["disclosure_risk"] & is_noise(pack, lo, hi), "C").otherwise(f["grade"])
    own = F.struct(
        F.when(F.col("span").isNull(), F.col("text")).otherwise(f["quote"]).alias("quote"), grade.alias("grade"), f["category"].alias("category"), f["implicit"].alias("implicit"),
        f["disclosure_risk"].alias("disclosure_risk"), f["source"].alias("source"), F.col("span"),
    )
    j = j.withColumn("out", F.when(F.col("counts"), own).when(~F.col("covered") & (F.col("i") == 1), rescued(pack, least))).where("out is not null")
    j = j.select(*KEYS, "slide_no", "hits", "out.*")
    raised = disclosed() & F.col("span").isNotNull() & F.exists("hits", lambda h: (h["category"] == pack.disclosure_category) & overlaps(h["s"], h["e"], F.col("span.s"), F.col("span.e")))
    j = j.withColumn("disclosure_risk", F.col("disclosure_risk") | raised)
    return j.where((F.col("grade") != "C") | F.col("disclosure_risk")).drop("hits")


def sorted_findings(findings: DataFrame) -> DataFrame:
    """By slide, segment, start of the span (none: 0), and best grade first."""
    return findings.orderBy("doc_id", "slide_no", "seg_id", F.coalesce(F.col("span.s"), F.lit(0)), -rank())
