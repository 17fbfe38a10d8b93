"""Over time: the pick of examples, counts of corrections, evaluation sets and changes between runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import normalise

#: Examples older than so many days give way to newer ones; so many of one batch at first; slots per kind.
WINDOW_DAYS, PER_BATCH, SLOTS = 180, 2, {"include": 8, "exclude": 4}


def diversity_pick(pool: DataFrame, today: str, slots: dict[str, int] | None = None, days: int = WINDOW_DAYS, per_batch: int = PER_BATCH) -> DataFrame:
    """(kind, place, pool_ord, quote): examples of many categories and batches, newest (least pool_ord) first.

    ``pool``: pool_ord, kind, type, quote, category, date, batch. Proven corrections fill the slots before gold
    ones. Each tier goes through the pool four times: recent, of batches with room and of unused categories;
    then of any date; then of any batch; then of any category. A null category counts as one of its own quote.

    Rows alike in tier, age, batch and category are preferred by age alone, so at most a kind's slots of each
    such class can be picked; the rest is dropped before a kind meets in one task. The result is the same.
    """
    slots = slots or SLOTS
    # a record without a category is a class of its own, so only the newest of each quote and batch stay
    c = pool.withColumn("tier", (F.col("type") == "gold").cast("int")).withColumn("cat", F.coalesce(F.nullif("category", F.lit("")), F.concat(F.lit("\u0000"), "quote")))
    c = c.withColumn("old", F.coalesce(F.col("date"), F.lit("")) < F.date_format(F.date_sub(F.to_date(F.lit(today)), days), "yyyy-MM-dd"))
    same = Window.partitionBy("kind", "tier", "old", "batch", "cat").orderBy("pool_ord")
    c = c.withColumn("n", F.row_number().over(same)).where(F.col("n") <= max(slots.values()))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, room = pdf["kind"].iloc[0], slots.get(pdf["kind"].iloc[0], 0)
        rows = list(pdf.sort_values("pool_ord").itertuples())
        got, cats, batches = {}, set(), {}
        for tier in (0, 1):
            for free in range(4):
                for r in (x for x in rows if x.tier == tier and x.pool_ord not in got):
                    barred = (free < 1 and r.old, free < 2 and batches.get(r.batch, 0) >= per_batch, free < 3 and r.cat in cats)
                    if len(got) < room and not any(barred):
                        got[r.pool_ord] = r.quote
                        cats.add(r.cat)
                        batches[r.batch] = batches.get(r.batch, 0) + 1
        return pd.DataFrame([(kind, i + 1, o, q) for i, (o, q) in enumerate(got.items())], columns=["kind", "place", "pool_ord", "quote"])

    c = c.withColumn("batch", F.coalesce("batch", F.lit(-1)))
    return c.select("kind", "tier", "old", "batch", "cat", "pool_ord", "quote").groupBy("kind").applyInPandas(pick, "kind string, place int, pool_ord long, quote string")


def commit_counts(corrections: DataFrame, file_col: str = "file") -> DataFrame:
    """(file, match, miss, fp, regrade, gold, total): corrections of each file by type."""
    kinds = ("match", "miss", "fp", "regrade", "gold")
    return corrections.groupBy(F.col(file_col).alias("file")).agg(*[F.count_if(F.col("type") == k).alias(k) for k in kinds], F.count("*").alias("total"))


def evalset_summary(folded: DataFrame, files: DataFrame) -> DataFrame:
    """One row: paras, golds, neg_only (paragraphs with rejected quotes alone), files (distinct, not empty).

    ``folded``: see memory.fold(). ``files``: file.
    """
    per = folded.groupBy("para_key").agg(F.count_if(F.col("kind") == "gold").alias("g"))
    named = files.where("length(file) > 0").agg(F.count_distinct("file").alias("files"))
    return per.agg(F.count("*").alias("paras"), F.coalesce(F.sum("g"), F.lit(0)).alias("golds"), F.count_if(F.col("g") == 0).alias("neg_only")).crossJoin(named)


def eval_delta(base: DataFrame, current: DataFrame, columns: tuple[str, ...] = ("recall", "precision", "f1", "grade_acc")) -> DataFrame:
    """One row: each figure of the current run less the baseline's, null where either is; both are single rows."""
    b = base.select(*[F.col(c).alias(f"{c}_base") for c in columns])
    return current.select(*columns).crossJoin(b).select(*[F.round(F.col(c) - F.col(f"{c}_base"), 1).alias(f"{c}_delta") for c in columns])


def config_changes(runs: DataFrame, columns: list[str]) -> DataFrame:
    """(run_no, name, before, after, state): what each run's settings changed against the run before.

    state: changed, or unknown where the run before had no such value (which isn't the same as unchanged). The
    first run has no rows. Runs are few, one per evaluation.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("after")) for c in columns])
    x = runs.select("run_no", F.explode(pairs).alias("p")).select("run_no", "p.*")
    by = Window.partitionBy("name").orderBy("run_no")
    x = x.withColumn("before", F.lag("after").over(by)).withColumn("first", F.row_number().over(by) == 1).where(~F.col("first"))
    state = F.when(F.col("before").isNull() & F.col("after").isNotNull(), "unknown").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return x.withColumn("state", state).where("state is not null").select("run_no", "name", "before", "after", "state")


def strip_counts(runs: DataFrame) -> DataFrame:
    """(doc_id, spans, chars, tool_runs): what taking earlier highlights off would remove.

    ``runs``: see review.run_spans(). A span begins where the colour or the maker of a coloured run changes.
    """
    by = Window.partitionBy("doc_id", "para_id").orderBy("run_ord")
    mark = F.when(F.col("colour").isNotNull(), F.concat("colour", F.col("is_tool").cast("string")))
    r = runs.withColumn("m", mark).withColumn("fresh", F.col("m").isNotNull() & ~F.col("m").eqNullSafe(F.lag("m").over(by)))
    return r.groupBy("doc_id").agg(F.count_if("fresh").alias("spans"), F.coalesce(F.sum(F.when(F.col("m").isNotNull(), F.length("text"))), F.lit(0)).alias("chars"), F.count_if("is_tool").alias("tool_runs"))


def entered_and_left(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, quote, change): examples that came in or went between two picks, compared by kind and normal form."""
    keyed = lambda d: d.select("kind", "quote", normalise("quote").alias("q"))
    b, a = keyed(before), keyed(after)
    came = a.join(b, ["kind", "q"], "left_anti").select("kind", "quote", F.lit("entered").alias("change"))
    return came.unionByName(b.join(a, ["kind", "q"], "left_anti").select("kind", "quote", F.lit("left").alias("change")))


def list_changes(before: str, after: str) -> Column:
    """(added, removed): members of two lists that the other has not, in order, repeats kept; a null list is empty."""
    b, a = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (before, after))
    return F.struct(F.filter(a, lambda x: ~F.array_contains(b, x)).alias("added"), F.filter(b, lambda x: ~F.array_contains(a, x)).alias("removed"))


def memory_stats(folded: DataFrame, rules: DataFrame, pool: DataFrame) -> DataFrame:
    """One row: paras, rules, excludes, examples. ``folded``, ``rules``: see memory.fold(), memory.consistent(); ``pool``: the examples."""
    kinds = rules.agg(F.count_if(F.col("kind") == "gold").alias("rules"), F.count_if(F.col("kind") == "neg").alias("excludes"))
    paras = folded.agg(F.count_distinct("para_key").alias("paras"))
    return paras.crossJoin(kinds).crossJoin(pool.agg(F.count("*").alias("examples")))
