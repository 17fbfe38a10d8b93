"""Reading a reviewed document back: highlight runs, comparison with what was marked, fingerprints, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import overlaps
from spanloom.functions.text import strip
from spanloom.operators.scan import probe


def run_spans(runs: DataFrame) -> DataFrame:
    """(doc_id, para_id, s, e, colour): neighbouring runs of one colour as one span; tool runs are taken out of the text.

    ``runs``: doc_id, para_id, run_ord, text, colour (null: none), is_tool. A tool run ends a span.
    """
    by = Window.partitionBy("doc_id", "para_id").orderBy("run_ord")
    own = F.when(F.col("is_tool"), 0).otherwise(F.length("text"))
    r = runs.withColumn("n", own).withColumn("e", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    shown = F.when(~F.col("is_tool"), F.col("colour"))
    r = r.withColumn("c", shown).withColumn("new", (~F.col("c").eqNullSafe(F.lag("c").over(by)) | F.lag("is_tool", 1, False).over(by)).cast("int"))
    r = r.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("c is not null")
    spans = r.groupBy("doc_id", "para_id", "island", F.col("c").alias("colour")).agg(F.min(F.col("e") - F.col("n")).alias("s"), F.max("e").alias("e"))
    return spans.where("e > s").select("doc_id", "para_id", "s", "e", "colour")


def fingerprint(segs: DataFrame, kinds: tuple[str, ...] = ("title", "body", "table")) -> DataFrame:
    """(doc_id, fingerprint): the first 24 hex digits of the SHA-256 of the texts in order, joined by U+001F."""
    texts = segs.where(F.col("kind").isin(*kinds)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["text"]), "\u001f")
    return texts.select("doc_id", F.substring(F.sha2(joined.cast("binary"), 256), 1, 24).alias("fingerprint"))


def pair_spans(human: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, seg_id, hid, mid, type): each human span takes the first free model span that it overlaps.

    type: match (grade and risk alike), regrade, miss (no model span), fp (a model span left over). Both tables:
    doc_id, seg_id, hid or mid (their order), s, e, grade, risk. A segment's spans meet as two sorted arrays of
    one row, and one pass over the human ones takes model spans away.
    """
    keys = ["doc_id", "seg_id"]

    def by_segment(df: DataFrame, ord_: str, name: str) -> DataFrame:
        one = F.struct(F.col(ord_).cast("long").alias("ord"), F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "grade", "risk")
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias(name))

    both = by_segment(human, "hid", "h").join(by_segment(model.where("s is not null"), "mid", "m"), keys, "full_outer")
    return both.select(*keys, F.explode(_paired("h", "m")).alias("x")).select(*keys, "x.*")


def _paired(human: str, model: str) -> Column:
    """Array of (hid, mid, type) of two arrays of (ord, s, e, grade, risk), see pair_spans()."""
    none = F.expr("cast(array() as array<struct<ord:bigint,s:int,e:int,grade:string,risk:boolean>>)")
    done = F.expr("cast(array() as array<struct<hid:bigint,mid:bigint,type:string>>)")
    pair = lambda hid, mid, kind: F.array(F.struct(hid.cast("long").alias("hid"), mid.cast("long").alias("mid"), kind.alias("type")))

    def step(acc, x):
        hit = F.get(F.filter(acc["free"], lambda y: overlaps(y["s"], y["e"], x["s"], x["e"])), F.lit(0))
        kind = F.when(hit.isNull(), "miss").when(hit["grade"].eqNullSafe(x["grade"]) & hit["risk"].eqNullSafe(x["risk"]), "match").otherwise("regrade")
        left = F.filter(acc["free"], lambda y: hit.isNull() | (y["ord"] != hit["ord"]))
        return F.struct(left.alias("free"), F.concat(acc["out"], pair(x["ord"], hit["ord"], kind)).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.transform(acc["free"], lambda y: F.struct(F.lit(None).cast("long").alias("hid"), y["ord"].alias("mid"), F.lit("fp").alias("type"))))
    return F.aggregate(F.coalesce(human, none), F.struct(F.coalesce(model, none).alias("free"), done.alias("out")), step, rest)


def diff(paras: DataFrame, archive: DataFrame, near: int = 2, back: int = 30) -> DataFrame:
    """(doc_id, seg_id, mode, type, s, e, grade, risk, category, from_grade, from_risk, lexicon_gap): what a reviewer changed.

    ``paras``: doc_id, seg_id, slide_no, fingerprint, text, hits, human (array of s, e, grade, risk in order), tags (array of
    places). ``archive``: fingerprint, slide_no, text, s, e, grade, risk, category, mid (their order); findings
    without a span (s null) only say that the document is archived. Documents with an archive are paired (match,
    regrade, miss, fp). The others give each human span as gold and each tag with no human span ending within
    ``near`` of it as fp, on the ``back`` characters before it. A paragraph has the archive's findings of its slide
    and text. Misses, golds and orphan tags take their category from the scan; lexicon_gap tells that it has none there.
    """
    one = F.struct(F.col("mid").cast("long").alias("ord"), F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "grade", "risk", "category")
    told = archive.where("s is not null").groupBy("fingerprint", "slide_no", "text").agg(F.array_sort(F.collect_list(one)).alias("model"))
    known = archive.select("fingerprint").distinct().withColumn("archived", F.lit(True))
    p = paras.join(known, "fingerprint", "left").join(told, ["fingerprint", "slide_no", "text"], "left")
    p = p.withColumn("h", F.transform("human", lambda x, i: F.struct(i.cast("long").alias("ord"), x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"), x["grade"].alias("grade"), x["risk"].alias("risk"))))
    p = p.withColumn("m", F.transform("model", lambda x: F.struct(*[x[c].alias(c) for c in ("ord", "s", "e", "grade", "risk")])))

    def item(kind, x, category, was=None, gap=None) -> Column:
        old = lambda c, t: (F.lit(None).cast(t) if was is None else F.when(kind == "regrade", was[c])).alias(f"from_{c}")
        missing = F.lit(None).cast("boolean") if gap is None else gap
        return F.struct(kind.alias("type"), x["s"].alias("s"), x["e"].alias("e"), x["grade"].alias("grade"), x["risk"].alias("risk"), category.alias("category"), old("grade", "string"), old("risk", "boolean"), missing.alias("lexicon_gap"))

    def archived(x: Column) -> Column:
        own = F.get(F.filter("h", lambda y: y["ord"] == x["hid"]), F.lit(0))
        was = F.get(F.filter("model", lambda y: y["ord"] == x["mid"]), F.lit(0))
        span = F.when(x["hid"].isNull(), F.struct(*[was[c].alias(c) for c in ("s", "e", "grade", "risk")])).otherwise(F.struct(*[own[c].alias(c) for c in ("s", "e", "grade", "risk")]))
        found = probe(span["s"], span["e"])
        return item(x["type"], span, F.when(x["type"] == "miss", found["category"]).otherwise(was["category"]), was, F.when(x["type"] == "miss", ~found["covered"]))

    def gold(x: Column) -> Column:
        found = probe(x["s"], x["e"])
        return item(F.lit("gold"), x, found["category"], None, ~found["covered"])

    def orphan(t: Column) -> Column:
        x = F.struct(F.greatest(F.lit(0), t - back).cast("int").alias("s"), t.cast("int").alias("e"), F.lit("B").alias("grade"), F.lit(False).alias("risk"))
        return item(F.lit("fp"), x, probe(x["s"], x["e"])["category"])

    lost = F.filter("tags", lambda t: ~F.exists("h", lambda x: F.abs(x["e"] - t) <= near))
    alone = F.concat(F.transform("h", gold), F.transform(lost, orphan))
    items = F.when(F.col("archived"), F.transform(_paired("h", "m"), archived)).otherwise(alone)
    mode = F.when(F.col("archived"), "archive").otherwise("labels")
    return p.select("doc_id", "seg_id", mode.alias("mode"), F.explode(items).alias("x")).select("doc_id", "seg_id", "mode", "x.*")


def first_reviews(files: DataFrame) -> DataFrame:
    """Adds ``duplicate_of``: the name of the first readable file of the same fingerprint, where that is another.

    ``files``: ord, filename, fingerprint, error. A broken file (error set) stays as it is and stands for no other.
    """
    good = F.col("error").isNull() & F.col("fingerprint").isNotNull()
    first = files.where(good).groupBy("fingerprint").agg(F.min(F.struct("ord", "filename")).alias("first"))
    j = files.join(first, "fingerprint", "left")
    other = F.when(good & (F.col("first.ord") != F.col("ord")), F.col("first.filename"))
    return j.select(*files.columns, other.alias("duplicate_of"))


def counts(paired: DataFrame) -> DataFrame:
    """One row: match, miss, fp, regrade, and agree, the rounded share of matches in percent (halves to even)."""
    n = lambda t: F.count_if(F.col("type") == t).alias(t)
    c = paired.agg(n("match"), n("miss"), n("fp"), n("regrade"), F.count("*").alias("total"))
    return c.select("match", "miss", "fp", "regrade", F.when(F.col("total") > 0, F.bround(F.col("match") / F.col("total") * 100, 0).cast("int")).alias("agree"))


def pack_batches(segs: DataFrame, budget: int, overhead: int = 16) -> DataFrame:
    """(doc_id, slide_no, batches): seg_ids of each slide packed in order, a batch closed before it would exceed the budget.

    A segment costs its length plus ``overhead``; one over the budget is a batch of its own.
    """
    items = segs.groupBy("doc_id", "slide_no").agg(F.array_sort(F.collect_list(F.struct("seg_id", (F.length("text") + overhead).alias("n")))).alias("x"))
    none = F.expr("cast(array() as array<int>)")
    zero = F.struct(F.expr("cast(array() as array<array<int>>)").alias("done"), none.alias("cur"), F.lit(0).alias("size"))

    def step(a, x):
        full = (F.size(a["cur"]) > 0) & (a["size"] + x["n"] > budget)
        one = F.array(x["seg_id"])
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"), F.when(full, one).otherwise(F.concat(a["cur"], one)).alias("cur"), F.when(full, x["n"]).otherwise(a["size"] + x["n"]).alias("size"))

    return items.select("doc_id", "slide_no", F.aggregate("x", zero, step, lambda a: F.concat(a["done"], F.array(a["cur"]))).alias("batches"))


def upsert_pool(corrections: DataFrame) -> DataFrame:
    """Newest record of each quote (its first 80 characters), newest first; matches and quotes under two characters are left out."""
    c = corrections.where(F.col("type").isin("fp", "miss", "gold", "regrade")).withColumn("quote", strip("quote")).where("length(quote) >= 2")
    c = c.withColumn("quote", F.substring("quote", 1, 80))
    last = Window.partitionBy("quote").orderBy(F.desc("seq"))
    c = c.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    return c.withColumn("kind", F.when(F.col("type") == "fp", "exclude").otherwise("include"))
