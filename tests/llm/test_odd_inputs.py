"""Nulls, repeats, empty tables, clashing columns and long texts, and the pipeline against a plain version."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, importance, licenses, quality_rules, sentencepiece_codec, shingle_join, simhash, suffix_dedup, token_counts, token_files
from spanloom.llm.queries import tokenizer_file

#: Names that the operators use themselves.
CLASH = ["rid", "did", "spans", "kept", "n_removed", "kept_text", "marks", "ids", "n_pieces", "decoded", "round_trip", "row", "key", "weight", "a", "b", "id", "root", "own", "good", "n_words"]


def words(r, n, pool=10**6):
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def odd_rows(seed=31):
    r = random.Random(seed)
    text, passage = words(r, 120), words(r, 60)
    rows = [(1, text), (1, text), (2, text), (3, f"{words(r, 150)} {passage} {words(r, 150)}"), (4, f"{words(r, 100)} {passage} {words(r, 90)}"), (None, words(r, 50)), (None, None), (5, None), (6, ""), (6, ""), (7, " \n\t"), (8, words(r, 40)), (9, words(r, 30_000))]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    return d.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(1).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, r = str(tmp_path_factory.mktemp("tables")), random.Random(32)
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, words(r, 20)), (2, None), (None, "x y")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_pass_odd_rows_and_clashing_columns(spark, odd, tables):
    import corpus_pipeline as P

    d = odd
    for name, stage in P.STAGES[:-1]:
        d = stage(spark, d, tables)
        assert d.columns == odd.columns, name
        d = spark.createDataFrame(d.collect(), odd.schema)
        assert all(x[c] == 1 for x in d.collect() for c in CLASH), name
    ids = sorted(x["doc_id"] for x in d.where("doc_id is not null").collect())
    assert ids == [1, 3, 4, 5, 8, 9]  # one of the copies, one of the texts without words
    assert d.where("doc_id is null").count() == 2
    assert all("w" in x["text"] and x["n_chars"] == len(x["text"]) for x in d.where("doc_id in (3, 4)").collect())
    out = P.tokens(spark, d, tables)
    assert len(set(out.columns)) == len(out.columns) and out.where("not round_trip").count() == 0


def test_stages_pass_empty_tables(spark, odd, tables):
    import corpus_pipeline as P

    for name, stage in P.STAGES:
        assert stage(spark, odd.where("false"), tables).count() == 0, name


def test_operators_keep_every_odd_row(spark, odd, tables, tmp_path):
    n, labels = len(odd_rows()), spark.read.parquet(f"{tables}/labels.parquet")
    items = spark.read.parquet(f"{tables}/benchmark.parquet")
    bpe, piece = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    for f in (
        simhash.near_duplicate_components, lambda d: suffix_dedup.remove_repeats(d, window=130), lambda d: importance.classify(d, labels), lambda d: token_counts.count_tokens(d, bpe),
        lambda d: sentencepiece_codec.encode_texts(d, piece), quality_rules.apply_rules, lambda d: decontaminate.find_contamination(d, items), lambda d: decontaminate.find_contamination(d, items, automaton_chars=100), licenses.scan_licenses,
    ):
        got = f(odd)
        assert got.count() == n and got.where("doc_id is null").count() == 2
        assert f(odd.where("false")).count() == 0
    token_files.write_tokens(odd, f"file://{tmp_path}/t", tokenizer_file("word_bpe_49k.json"))
    assert token_files.token_digests(spark, f"file://{tmp_path}/t").count() == n
    token_files.write_tokens(odd.where("false"), f"file://{tmp_path}/e", tokenizer_file("word_bpe_49k.json"))
    assert spark.read.parquet(f"file://{tmp_path}/e").count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_ids_need_not_be_numbers(spark):
    r = random.Random(33)
    p = words(r, 60)
    d = spark.createDataFrame([("x", p), ("y", p + " " + words(r, 20)), (None, None)], "doc_id string, text string")
    assert sorted(str(x["doc_id"]) for x in suffix_dedup.remove_repeats(d, window=130).where("n_removed > 0").collect()) == ["x", "y"]


def test_huge_texts_go_through_the_query_of_counts(spark):
    r, path = random.Random(34), tokenizer_file("byte_bpe_50k.json")
    texts = [words(r, 9000), "x" * 90_000, " " * 50_000 + "a", "\u3042\u3044 " * 20_000, "<|endoftext|>" + words(r, 8000)]
    t = token_counts.tokenizer(path)[0]
    got = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_long_texts_equal_their_parts(spark):
    # past the pieces that texts are hashed in
    r = random.Random(35)
    text = words(r, 70_000, 3000).encode()
    assert (importance.buckets(text, 14) == np.concatenate([importance.buckets(text, 14)], axis=1)).all()
    old, importance.PIECE = importance.PIECE, 1000
    try:
        assert (np.concatenate([np.frombuffer(b, np.uint8) for b in importance.pieces(text, 1000)]) == np.frombuffer(text, np.uint8)).all()
    finally:
        importance.PIECE = old
    big = text * 3  # over a block of the suffix operator
    assert len(big) > suffix_dedup.BLOCK
    row = suffix_dedup.remove_repeats(spark.createDataFrame([(1, big.decode())], "doc_id long, text string"), window=400).first()
    assert row["n_removed"] >= len(big) - 800


def brute_weights(rows, fitted, bits, window, pseudo, unknown):
    mask, shift = 2**64 - 1, 64 - bits

    def grams(text):
        h = [zlib.crc32(x) for x in re.findall(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]", (text or "").encode().lower())]
        one = [(x * 0x9E3779B97F4A7C15 & mask) >> shift for x in h]
        two = [((((y * 0x9E3779B97F4A7C15 + x) & mask) * 0xD6E8FEB86659FD93 & mask) >> shift) + (1 << bits) for x, y in zip(h, [2, *h])]
        return list(zip(one, two))

    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        flat = [x for pair in grams(t) for x in pair]
        raw.update(flat)
        if i in fitted:
            target.update(flat)
    share = sum(target.values()) / sum(raw.values())
    rare = [b for b in raw if raw[b] * share < unknown]
    alike = math.log((sum(target[b] for b in rare) + pseudo) / (sum(raw[b] for b in rare) * share + pseudo)) if rare else 0.0
    ratio = {b: alike if raw[b] * share < unknown else math.log((target[b] + pseudo) / (raw[b] * share + pseudo)) for b in raw}
    mean = sum(ratio[b] * n for b, n in target.items()) / sum(target.values())
    out = []
    for i, t in rows:
        v = [ratio[a] + ratio[b] - 2 * mean for a, b in grams(t)]
        firsts = [*range(0, max(0, len(v) - window), max(1, window // 2)), max(0, len(v) - window)]
        out.append((i, min(sum(v[k : k + window]) for k in firsts)))
    return out


def test_weights_and_draw_equal_brute_force(spark):
    r = random.Random(36)
    rows = [(i, words(r, r.randint(0, 90), 60) + (" # awful" * 3 if i % 4 == 0 else "")) for i in range(300)] + [(300, None), (301, "")]
    labels = [(i, int(i % 4 > 0), 0) for i in range(200)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted, held = importance.split_labels(lab)
    fitted = {x["doc_id"] for x in fitted.collect()}
    assert all(i % 4 for i in fitted) and not fitted & {x["doc_id"] for x in held.collect()}
    want = dict(brute_weights(rows, fitted, 10, 16, 0.02, 5.0))
    got = importance.classify(d, lab, k=100, bits=10, window=16, unknown=5.0).collect()
    assert all(abs(x["weight"] - want[x["doc_id"]]) < 1e-4 * max(1, abs(want[x["doc_id"]])) for x in got)
    best = sorted((x["key"] for x in got), reverse=True)[99]
    assert {x["doc_id"] for x in got if x["kept"]} == {x["doc_id"] for x in got if x["key"] >= best} and sum(x["kept"] for x in got) == 100
    noise = np.array([x["key"] - x["weight"] for x in got])
    assert abs(noise.mean() - 0.5772) < 0.25 and noise.std() > 0.9
    drawn = {x["doc_id"] for x in importance.classify(d, lab, bits=10, window=16, unknown=5.0).where("kept").collect()}
    assert sum((i in drawn) == (i % 4 > 0) for i in range(200, 300)) >= 90


def test_unigram_models_equal_the_library(tmp_path):
    import glob

    import sentencepiece

    found = [p for p in glob.glob(tokenizer_file("*.model")) if not sentencepiece_codec.Codec(p).bpe]
    for path in found:  # none may be at hand, as tokenizers are never trained here
        s, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
        texts = [words(random.Random(i), 30) for i in range(20)] + ["\u4e00x", "a\u4e00", "", " "]
        assert [x.tolist() for x in c.encode(texts)] == s.encode(texts)


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(37)
    item, passage = words(r, 20), words(r, 70)
    texts = [words(r, r.randint(60, 200)) for _ in range(12)]
    texts += [texts[0], texts[1] + " extra words", f"{texts[2]} {item}", *(f"{words(r, 80)} {passage} {words(r, 90)}" for _ in range(3)), None, "", passage]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shingles = [{tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for t in texts]
    near = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    left = {i: texts[i] for i in range(len(texts)) if not any(near(i, k) for k in range(i))}
    n = collections.Counter((t or "").encode()[k : k + P.PASSAGE_BYTES] for t in left.values() for k in range(len((t or "").encode()) - P.PASSAGE_BYTES + 1))
    want = {}
    for i, t in left.items():
        b = (t or "").encode()
        kept, runs = suffix_dedup._cut(b, [(k, k + P.PASSAGE_BYTES) for k in range(len(b) - P.PASSAGE_BYTES + 1) if n[b[k : k + P.PASSAGE_BYTES]] > 1])
        w = kept.decode().split()
        if (not runs or kept) and not any(" ".join(w[k : k + 13]) in item for k in range(len(w) - 12)):
            want[i] = kept.decode() if runs else t
    got = {x["doc_id"]: x for x in P.run(spark, str(tmp_path)).collect()}
    assert {i: x["text"] for i, x in got.items()} == want
    assert all(x["round_trip"] and x["n_pieces"] == len(x["ids"]) for x in got.values())
