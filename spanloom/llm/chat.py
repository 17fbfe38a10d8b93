"""Chat formatting with Spark expressions only.

Template: ``<|turn|>role<|text|>text<|end|>\\n`` per block. Adjacent turns of one role are merged into one
block, their texts set apart by ``<|next|>``. Inside roles and texts every backslash is doubled and every
control string of this or other common templates gets a backslash after its first character, so that no
control string survives and the original can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
#: Strings that this or other common chat templates treat as control.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    """Reversible: double each backslash, then put one behind the first character of each control string."""
    c = _replace(c, "\\", "\\\\")
    for s in CONTROLS:
        c = _replace(c, s, f"{s[0]}\\{s[1:]}")
    return c


def unescape(c: Column) -> Column:
    for s in CONTROLS:
        c = _replace(c, f"{s[0]}\\{s[1:]}", s)
    return _replace(c, "\\\\", "\\")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss)``: one row per conversation.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Rows are ordered by turn (nulls
    first; ties by role, then text), repeated rows are turns of their own, a null role or text is empty, and
    a null conv_id is a conversation like any other. An empty table gives no rows. loss lists the (start, length) in code points, 1-based,
    of the escaped texts of ``loss_role``. One shuffle by conv_id serves the window and the aggregation.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    last, body = F.lag("role").over(w), escape(F.col("text"))
    rows = rows.select("conv_id", "role", F.row_number().over(w).alias("i"), last.alias("before"), escape(F.col("role")).alias("head"), body.alias("body"))
    opening = F.concat(F.when(F.col("before").isNull(), "").otherwise(END), F.lit(TURN), "head", F.lit(TEXT))
    rows = rows.withColumn("lead", F.when(F.col("before") == F.col("role"), NEXT).otherwise(opening))
    rows = rows.withColumn("end", F.sum(F.length("lead") + F.length("body")).over(Window.partitionBy("conv_id").orderBy("i")))
    turn = F.struct("i", (F.col("role") == loss_role).alias("on"), (F.col("end") - F.length("body") + 1).cast("int").alias("start"), F.length("body").alias("length"), F.concat("lead", "body").alias("piece"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.concat(F.array_join(F.transform("turns", lambda t: t["piece"]), ""), F.lit(END))
    loss = F.transform(F.filter("turns", lambda t: t["on"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: str = "formatted") -> Column:
    """The original (role, text) structs of a formatted conversation, in order."""
    blocks = F.split(F.col(formatted), r"<\|end\|>\n")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring_index(block, TEXT, 1), TURN, -1))
        return F.transform(F.split(F.substring_index(block, TEXT, -1), r"<\|next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: str = "formatted", loss: str = "loss") -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(F.col(formatted), s["start"], s["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from the output."""
    d = formatted.select("conv_id", read_turns().alias("turns"), read_loss().alias("under"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
