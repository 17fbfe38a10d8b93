"""Quality rules with Spark expressions only: base counts, and divergence from language references.

The histograms of each text over character classes and over common words are compared with those of its
language (all texts of that language together) by Jensen-Shannon distance. Texts below a minimum length
are not judged by divergence, as their histograms say too little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialise

#: Common function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to a in is it that for on as with was are be this by at from "
    "de la le et les des en un du une que dans par pour est au qui sur ce pas "
    "der die und das von zu mit den auf ist nicht ein eine dem im sich als auch "
    "el los del se las y una no con su al lo para como es"
).split()
#: Words a text needs before its histograms count, and the largest distances that are accepted.
MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 100, 0.25, 0.36


def words_of(text: str | Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; at most the first and last part of the split can be empty."""
    return F.array_remove(F.split(text, f"[{BLANKS}]+"), "")


def _hashes(n: int) -> Column:
    """Hash of each run of n words; each word's hash seeds the next, so word limits count."""
    at = F.sequence(F.lit(1), F.size("words") - (n - 1))
    return F.when(F.size("words") >= n, F.transform(at, lambda i: F.xxhash64(*[F.element_at("words", i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(n: int) -> Column:
    """Words covered by the runs in ``again`` (sorted places): each adds what lies beyond the one before."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct((i + n).alias("end"), (a["n"] + i + n - F.greatest(i, a["end"])).alias("n"))
    return F.aggregate("again", zero, step, lambda a: a["n"])


def _histograms(df: DataFrame) -> DataFrame:
    """char_hist: lower-case, upper-case, blank, digit, other. word_hist: each common word, and all other words."""
    df = df.withColumn("t1", F.regexp_replace("text", r"\p{Ll}+", ""))
    df = df.withColumn("t2", F.regexp_replace("t1", r"\p{Lu}+", ""))
    df = df.withColumn("t3", F.regexp_replace("t2", f"[{BLANKS}]+", ""))
    df = df.withColumn("t4", F.regexp_replace("t3", r"\p{Nd}+", ""))
    sizes = ["text", "t1", "t2", "t3", "t4"]
    chars = [F.length(a) - F.length(b) for a, b in zip(sizes, sizes[1:])] + [F.length("t4")]
    common = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w.isin(COMMON_WORDS))
    df = df.withColumn("char_hist", F.array(*chars)).drop("t1", "t2", "t3", "t4").withColumn("common", F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" ")))
    # each word has a blank of its own on either side, so replacing counts every one
    counts = [((F.length("common") - F.length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int") for w in COMMON_WORDS]
    df = df.withColumn("word_hist", F.array(*counts))
    return df.withColumn("word_hist", F.concat("word_hist", F.array(F.greatest(F.lit(0), F.size("words") - F.aggregate("word_hist", F.lit(0), lambda a, x: a + x))))).drop("common")


def _total(hist: str) -> Column:
    return F.aggregate(hist, F.lit(0.0), lambda a, x: a + x)


def _js_distance(hist: str, total: str, ref: str) -> Column:
    """Jensen-Shannon distance (base 2), 0 to 1, of counts with their total from reference shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2)
    terms = F.zip_with(hist, ref, lambda n, y: both(n / F.col(total), y))
    return F.when(F.col(total) > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", window: int = 5) -> DataFrame:
    """Counts and histograms of each whole text, without the text: id, lang, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, char_hist, word_hist."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("words", words_of("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    df = df.withColumn("lines", lines).withColumn("h", _hashes(window))
    df = _histograms(df)
    symbols = F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))
    df = df.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "h", (F.size("h") > F.size(F.array_distinct("h"))).alias("repeats"), "char_hist", "word_hist",
    )
    # only texts with a repeated run sort their runs with places
    placed = F.when(F.col("repeats"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))
    df = df.withColumn("placed", placed).drop("h", "repeats")
    near = lambda k: F.get("placed", k)["h"]
    again = F.filter("placed", lambda x, k: F.coalesce(near(k - 1) == x["h"], F.lit(False)) | F.coalesce(near(k + 1) == x["h"], F.lit(False)))
    df = df.withColumn("again", F.array_sort(F.transform(again, lambda x: x["i"])))
    return df.withColumn("n_repeat_words", _covered(window).cast("long")).drop("placed", "again")


def language_references(measured: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(lang, ref_chars, ref_words): shares over all texts of the language that have min_words words."""
    n_words = len(COMMON_WORDS) + 1
    sums = [F.sum(F.col(h)[k]).alias(f"{h}{k}") for h, n in (("char_hist", 5), ("word_hist", n_words)) for k in range(n)]
    s = measured.where(F.col("n_words") >= min_words).groupBy("lang").agg(*sums)
    s = s.select("lang", F.array(*[f"char_hist{k}" for k in range(5)]).alias("c"), F.array(*[f"word_hist{k}" for k in range(n_words)]).alias("w"))
    s = s.withColumn("nc", _total("c")).withColumn("nw", _total("w"))
    return s.select("lang", F.transform("c", lambda x: x / F.col("nc")).alias("ref_chars"), F.transform("w", lambda x: x / F.col("nw")).alias("ref_words"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Every row with its counts, ``char_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    Null text has no words (and fails the base rules); a null language is a language of its own. A text is
    kept if the base rules pass and it either has fewer than ``min_words`` words or both distances are within
    bounds. A language without a reference judges by the base rules alone. Repeated rows are kept as rows;
    an empty table gives no rows.
    """
    m = materialise(measure(docs, id_col, text_col, lang_col), "measured")
    m = m.join(language_references(m, min_words), "lang", "left")
    m = m.withColumn("nc", _total("char_hist")).withColumn("nw", _total("word_hist"))
    m = m.withColumn("char_distance", _js_distance("char_hist", "nc", "ref_chars")).withColumn("word_distance", _js_distance("word_hist", "nw", "ref_words"))
    m = m.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    far = (F.col("n_words") >= min_words) & ((F.col("char_distance") > max_char) | (F.col("word_distance") > max_word))
    m = m.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
