"""One query per corpus operator, over its whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, importance, licenses, quality_rules, sentencepiece_codec, simhash, suffix_dedup, token_counts, token_files
from .common import shared_dir, spread, table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the package that has them is on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "text", *columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(documents(spark, sf_dir), k=3, radius=2, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir), window=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return found.select("doc_id", F.round("weight", 6).alias("weight"), "kept")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/spanloom-tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_files.token_digests(spark, path)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.encode_texts(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(documents(spark, sf_dir, "lang"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
    hit = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.digest_of().alias("items_sha256"), hit.alias("contaminated"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("blocks")


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_suffix_array, op3_importance, op4_token_files, op5_token_counts, op6_sentencepiece, op7_quality_rules, op8_chat, op9_decontaminate, op10_licenses)
}


def _sql_escape(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for s in chat.CONTROLS:
        c = f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')"
    return c


_OP8 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS i FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_sql_escape("text")}) + CASE WHEN before = role THEN {len(chat.NEXT)}
    ELSE {len(chat.TURN) + len(chat.TEXT) + len(chat.END)} + length({_sql_escape("role")}) END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

_WORDS9 = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS9} AS w FROM documents),
b AS (SELECT item_id, {_WORDS9} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS pat
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM p),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS pat
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT spots.doc_id, n, spots.i, p.item_id FROM spots JOIN p USING (n, pat)),
marked AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE_SQL = {"op8_chat": _OP8, "op9_decontaminate": _OP9}
