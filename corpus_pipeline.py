"""A corpus through five operators: quality, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, importance, sentencepiece_codec, shingle_join, suffix_dedup
from spanloom.llm.common import NON_WORD, materialise, table
from spanloom.llm.queries import tokenizer_file

#: Bytes of a passage that counts as repeated: fewer than the fifty-one shortest usual words take.
PASSAGE_BYTES = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws; of rows with one id all stay if one is drawn. Rows without an id stay."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    drawn = importance.classify(docs.select("doc_id", "text"), labels).where("kept").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group whose shingles of five words are similar to 0.8 or more.

    Rows with one id are one document; rows without an id stay.
    """
    return shingle_join.drop_near_duplicates(docs, k=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every passage that occurs more than once; a document of which nothing is left goes.

    A text in which nothing repeats stays as it is, null or empty included. n_chars follows the text.
    """
    cut = suffix_dedup.remove_repeats(docs, window=PASSAGE_BYTES, whole_rows=True).where("n_removed = 0 or n_removed < n_bytes")
    shortened = F.col("n_removed") > 0

    def column(c: str):
        was = F.col("row")[c]
        if c == "text":
            return F.when(shortened, F.col("kept_text")).otherwise(was).alias(c)
        if c == "n_chars":
            return F.when(shortened, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(was).alias(c)
        return was.alias(c)

    return cut.select(*[column(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a full window of a benchmark item, however long they are; rows without an id stay.

    Items of fewer words than a window are common phrases too: they count where at least a twentieth of a
    document's words lie in them.
    """
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    n_words = F.size(F.array_remove(F.split("text", f"[{NON_WORD}]+"), ""))
    full = decontaminate.find_contamination(docs, items.where(n_words >= decontaminate.WINDOW)).where("n_hit > 0")
    short = decontaminate.find_contamination(docs, items.where(n_words < decontaminate.WINDOW)).where("n_hit > 0 and 20 * n_hit >= n_words")
    leaked = full.select("doc_id").unionByName(short.select("doc_id")).where("doc_id is not null").distinct()
    return docs.join(leaked, "doc_id", "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids, their number and CRC-32, and whether decoding gives the text back.

    A column of docs that has the name of one of these gives way to it.
    """
    found = sentencepiece_codec.encode_texts(docs, tokenizer_file("piece_bpe_32k.model"), whole_rows=True)
    new = ("n_pieces", "ids", "ids_crc32")
    back = F.col("decoded") == F.coalesce(F.col("row")["text"], F.lit(""))
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in (*new, "round_trip")], *new, back.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL has no form of importance resampling, SimHash or SentencePiece; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k}")
    return docs
