"""License scans with Spark expressions only: exact phrases, and a set-similarity join of text blocks with templates.

Text blocks are the lines, and the paragraphs (runs of non-blank lines) of more than one line.

A line and a template match if the line holds at least ``threshold`` of the template's distinct words. The
join is exact. Words are put in one order for all, rarest first by how many texts have them. A line that
reaches the threshold shares one of a template's first |T| - need + 1 words (prefix filter), where need is
the least overlap; it has at least need words of the templates (length filter); and after the first shared
word, at least need - 1 words must be left on either side (positional filter). What passes is verified.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, NON_WORD, materialise

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Usual wordings of license notices, and the label each gives.
TEMPLATES = (
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "Released under the MIT License."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)
THRESHOLD = 0.8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def template_sets(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    import re

    return [(label, sorted(set(re.sub(f"[{NON_WORD}]+", " ", text.lower()).split()))) for label, text in templates]


def words_of(text) -> Column:
    """Words of a text already in lower case."""
    return F.array_remove(F.split(text, f"[{NON_WORD}]+"), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_order(lowered: DataFrame, sets) -> list[str]:
    """All words of the templates, rarest first over all texts; at most one count per such word reaches the driver."""
    known = sorted({w for _, s in sets for w in s})
    rows = lowered.select(F.explode(F.array_intersect("words", _strings(known))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row with n_words, n_base, first_word, last_word, base_labels, labels, score and ``blocks``.

    Null text is empty. Only A-Z are lowered before words are judged. base: places where a phrase's words stand in
    sequence; first_word and last_word are null without one. labels: those of the phrases and of every
    template that a line or a paragraph reaches. score: 1 with a phrase, else the best containment of a template that one
    reaches, else 0. blocks: (line number, label, containment) of every such line and template.
    The templates are a fixed list, so what is broadcast doesn't grow. Repeated rows and null ids count as rows;
    an empty table gives no rows; other columns are ignored.
    """
    sets = template_sets(templates)
    need = [math.ceil(threshold * len(s) - 1e-9) for _, s in sets]
    df = docs.select(F.col(id_col).alias("doc_id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower()).alias("text"))
    lowered = df.withColumn("words", words_of("text"))
    order = word_order(lowered, sets)
    rank = {w: i for i, w in enumerate(order)}
    ranked = [sorted(rank[w] for w in s) for _, s in sets]
    prefix = sorted({order[r] for s, n in zip(ranked, need) for r in s[: len(s) - n + 1]})
    spark = docs.sparkSession

    # one pass over the texts: counts, phrase places, and the lines that hold a word of a prefix
    at = F.sequence(F.lit(1), F.size("words"))

    def place(i):
        """Whether a phrase starts at word i, from 1."""
        hits = [[F.get("words", i - 1 + k) == w for k, w in enumerate(p.split())] for p, _ in PHRASES]
        return F.coalesce(reduce(or_, (reduce(and_, h) for h in hits)), F.lit(False))

    first_words = [p.split()[0] for p, _ in PHRASES]
    may = F.col("text").contains("license") | F.col("text").contains("cc")
    none = F.expr("cast(array() as array<int>)")
    df = lowered.withColumn("starts", F.when(may & F.arrays_overlap("words", _strings(first_words)), F.filter(at, place)).otherwise(none))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    # a paragraph has a negative number: -1 for the first
    paragraphs = F.transform(F.split("text", f"\n[{BLANKS}]*\n"), lambda x, i: F.struct((-1 - i).alias("line"), x.alias("text")))
    lines = F.concat(lines, F.filter(paragraphs, lambda x: x["text"].contains("\n")))
    shown = F.filter(lines, lambda x: F.arrays_overlap(words_of(x["text"]), _strings(prefix)))
    df = df.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.transform("starts", lambda i: F.struct((i - 1).cast("long").alias("at"), F.get("words", i - 1).alias("word"))).alias("places"),
        F.when(F.arrays_overlap("words", _strings(prefix)), shown).otherwise(F.expr("cast(array() as array<struct<line:int,text:string>>)")).alias("lines"),
    )
    df = materialise(df.withColumn("row", F.expr("uuid()")), "licenses")

    # the join: prefix words of a line with those of the templates
    rows = [(t, r, i, len(s), n, label) for t, (s, n, (label, _)) in enumerate(zip(ranked, need, sets)) for i, r in enumerate(s[: len(s) - n + 1])]
    index = spark.createDataFrame(rows, "template int, rank int, at_t int, size_t int, need int, label string")
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])
    blocks = df.where(F.size("lines") > 0).select("row", F.explode("lines").alias("x")).select("row", "x.line", F.array_distinct(words_of(F.col("x.text"))).alias("w"))
    known = F.array_sort(F.transform(F.array_intersect("w", _strings(order)), lambda w: F.element_at(ranks, w)))
    blocks = blocks.select("row", "line", known.alias("ranks")).select("row", "line", "ranks", F.posexplode("ranks").alias("at_b", "rank"))
    met = blocks.join(F.broadcast(index), "rank")
    met = met.where((F.size("ranks") >= F.col("need")) & (F.least(F.size("ranks") - F.col("at_b"), F.col("size_t") - F.col("at_t")) >= 1))
    # the first shared word of a pair decides: it comes before any other in the one order
    met = met.groupBy("row", "line", "template", "label", "size_t", "need").agg(F.min(F.struct("rank", "at_b", "at_t")).alias("m"), F.first("ranks").alias("ranks"))
    met = met.where(1 + F.least(F.size("ranks") - F.col("m.at_b") - 1, F.col("size_t") - F.col("m.at_t") - 1) >= F.col("need"))
    whole = F.array(*[F.array(*[F.lit(r) for r in s]) for s in ranked])
    overlap = F.size(F.array_intersect("ranks", F.get(whole, F.col("template"))))
    met = met.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need"))
    found = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line", "label", (F.col("overlap") / F.col("size_t")).alias("containment")))).alias("blocks"))

    labels = F.create_map(*[F.lit(x) for p, label in PHRASES for x in (p.split()[0], label)])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: F.element_at(labels, p["word"]))))
    out = df.join(found, "row", "left").withColumn("base", base)
    more = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.expr("cast(array() as array<string>)"))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places")["at"].alias("first_word"), F.array_max("places")["at"].alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"), F.filter("blocks", lambda b: b["line"] >= 0).alias("blocks"),
    )
