"""Scores of predictions against gold spans, and what changed between two configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import overlaps

KEYS = ["doc_id", "seg_id"]


def _pairs(preds: DataFrame, golds: DataFrame) -> DataFrame:
    """Pairs on a segment that overlap; a prediction without a span covers all."""
    p = preds.select(*KEYS, "pid", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("grade").alias("pg"), F.col("risk").alias("pr"))
    g = golds.select(*KEYS, "gid", F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("grade").alias("gg"), F.col("risk").alias("gr"))
    j = p.join(g, KEYS)
    j = j.where(F.col("ps").isNull() | overlaps(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge")))
    shared = F.when(F.col("ps").isNull(), F.col("ge") - F.col("gs")).otherwise(F.least("pe", "ge") - F.greatest("ps", "gs"))
    return j.withColumn("shared", shared)


def percent(a, b):
    """100 a / b to one place, halves to even; null without a base."""
    return F.when(b > 0, F.bround(a / b * 100, 1))


def _by_segment(df: DataFrame, ord_: str, name: str) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.collect_list(F.struct(F.col(ord_).alias("ord"), "s", "e", "grade", "risk")).alias(name))


def _none(name: str):
    return F.coalesce(F.col(name), F.expr("cast(array() as array<struct<ord:bigint,s:int,e:int,grade:string,risk:boolean>>)"))


def _covers(p, g):
    return p["s"].isNull() | overlaps(p["s"], p["e"], g["s"], g["e"])


def metrics(preds: DataFrame, golds: DataFrame) -> DataFrame:
    """One row: tp, miss, fp, preds, recall, precision, f1, grade_acc. Of predictions on a gold the one that shares most counts, the first of equals.

    Both sides are read once: a segment's spans meet as two arrays of one row. ``pid`` and ``gid`` tell the order
    within a segment.
    """
    j = _by_segment(preds, "pid", "p").join(_by_segment(golds, "gid", "g"), KEYS, "full_outer").select(_none("p").alias("p"), _none("g").alias("g"))

    def best(g):
        shared = lambda p: F.when(p["s"].isNull(), g["e"] - g["s"]).otherwise(F.least(p["e"], g["e"]) - F.greatest(p["s"], g["s"]))
        return F.array_max(F.transform(F.filter("p", lambda p: _covers(p, g)), lambda p: F.struct(shared(p).alias("n"), (-p["ord"]).alias("o"), p["grade"].alias("grade"), p["risk"].alias("risk"))))

    n = lambda x, name: F.coalesce(F.sum(F.size(x)), F.lit(0)).alias(name)
    m = j.agg(
        n(F.filter("g", lambda g: F.exists("p", lambda p: _covers(p, g))), "tp"), n(F.filter("p", lambda p: F.exists("g", lambda g: _covers(p, g))), "right"), n("p", "preds"), n("g", "golds"),
        n(F.filter("g", lambda g: (best(g)["grade"] == g["grade"]) & (best(g)["risk"] == g["risk"])), "grade_ok"),
    )
    r, p = F.col("tp") / F.nullif("golds", F.lit(0)), F.col("right") / F.nullif("preds", F.lit(0))
    return m.select(
        "tp", (F.col("golds") - F.col("tp")).alias("miss"), (F.col("preds") - F.col("right")).alias("fp"), "preds",
        percent(F.col("tp"), F.col("golds")).alias("recall"), percent(F.col("right"), F.col("preds")).alias("precision"),
        F.when(r + p > 0, F.bround(2 * r * p / (r + p) * 100, 1)).alias("f1"), percent(F.col("grade_ok"), F.col("tp")).alias("grade_acc"),
    )


def misses(preds: DataFrame, golds: DataFrame) -> DataFrame:
    """Golds that no prediction covers."""
    return golds.join(_pairs(preds, golds).select(*KEYS, "gid").distinct(), [*KEYS, "gid"], "left_anti")


def false_positives(preds: DataFrame, golds: DataFrame) -> DataFrame:
    """Predictions that cover no gold."""
    return preds.join(_pairs(preds, golds).select(*KEYS, "pid").distinct(), [*KEYS, "pid"], "left_anti")


#: Quotes of each kind of change that are kept.
KEEP_QUOTES = 6


def changes(base: DataFrame, current: DataFrame, golds: DataFrame) -> DataFrame:
    """(doc_id, seg_id, change, ord, s, e): miss_fixed and regressed golds, fp_fixed and new_fp predictions, between two sets of predictions.

    A false positive counts as the other side's if the two overlap; one without a span covers its whole segment.
    """
    j = _by_segment(base, "pid", "b").join(_by_segment(current, "pid", "c"), KEYS, "full_outer").join(_by_segment(golds, "gid", "g"), KEYS, "full_outer")
    j = j.select(*KEYS, *(_none(x).alias(x) for x in "bcg"))
    missed = lambda side: F.filter("g", lambda g: ~F.exists(side, lambda p: _covers(p, g)))
    wrong = lambda side: F.filter(side, lambda p: ~F.exists("g", lambda g: _covers(p, g)))
    j = j.select(*KEYS, missed("b").alias("bm"), missed("c").alias("cm"), wrong("b").alias("bf"), wrong("c").alias("cf"))
    lo, hi = (lambda x: F.coalesce(x["s"], F.lit(0))), (lambda x: F.coalesce(x["e"], F.lit(2**31 - 1)))
    only = lambda a, b: F.filter(a, lambda x: ~F.exists(b, lambda y: overlaps(lo(x), hi(x), lo(y), hi(y))))
    gone = lambda a, b: F.filter(a, lambda x: ~F.exists(b, lambda y: x["ord"] == y["ord"]))
    told = lambda name, x: F.transform(x, lambda y: F.struct(F.lit(name).alias("change"), y["ord"].alias("ord"), y["s"].alias("s"), y["e"].alias("e")))
    all_ = F.concat(told("miss_fixed", gone("bm", "cm")), told("regressed", gone("cm", "bm")), told("fp_fixed", only("bf", "cf")), told("new_fp", only("cf", "bf")))
    return j.select(*KEYS, F.explode(all_).alias("x")).select(*KEYS, "x.*")


def fixes(base: DataFrame, current: DataFrame, golds: DataFrame) -> DataFrame:
    """One row: miss_fixed, regressed, fp_fixed, new_fp between two sets of predictions."""
    return changes(base, current, golds).agg(*[F.count_if(F.col("change") == x).alias(x) for x in ("miss_fixed", "regressed", "fp_fixed", "new_fp")])


def kept_quotes(changed: DataFrame, segs: DataFrame, keep: int = KEEP_QUOTES) -> DataFrame:
    """(change, quotes): the quotes of the first ``keep`` changes of each kind, in order of document, segment and place."""
    by = Window.partitionBy("change").orderBy(*KEYS, F.coalesce("s", F.lit(0)), "ord")
    first = changed.withColumn("n", F.row_number().over(by)).where(F.col("n") <= keep).join(segs.select(*KEYS, "text"), KEYS)
    quote = F.when(F.col("s").isNull(), F.col("text")).otherwise(F.substr("text", F.col("s") + 1, F.col("e") - F.col("s")))
    return first.groupBy("change").agg(F.array_sort(F.collect_list(F.struct("n", quote.alias("q")))).alias("x")).select("change", F.transform("x", lambda x: x["q"]).alias("quotes"))
