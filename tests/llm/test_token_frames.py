"""Frames of token ids: what order 0 knows, where frames end, damaged headers, words of Latin letters."""

import numpy as np
import pytest

from spanloom.llm import token_counts, token_files
from spanloom.llm.queries import tokenizer_file


def test_order_0_knows_whole_ids():
    # 16 ids of one upper byte in random order have 4 bits each
    ids = np.random.default_rng(3).integers(512, 528, 100_000)
    frame = token_files.pack(ids)
    assert (token_files.unpack(frame) == ids).all()
    assert len(frame) * 8 < 4.5 * len(ids)


@pytest.mark.parametrize("ids", [[0], [65535] * 9000, list(range(65536)), [1, 2] * 5000 + list(range(30000, 40000))])
def test_frames_at_the_limits(ids):
    ids = np.array(ids)
    frame = token_files.pack(ids)
    assert (token_files.unpack(frame) == ids).all()
    for k in range(0, len(ids), token_files.BLOCK):
        assert (token_files.unpack(frame, k // token_files.BLOCK) == ids[k : k + token_files.BLOCK]).all()


def test_damaged_header():
    frame = bytearray(token_files.pack(np.arange(9000)))
    frame[60] ^= 255
    with pytest.raises(ValueError):
        token_files.unpack(bytes(frame))


@pytest.mark.parametrize("n, frames", [(10, [11]), (14, [15]), (15, [10, 6]), (24, [10, 15]), (31, [10, 10, 12])])
def test_a_short_rest_joins_its_frame(spark, tmp_path, n, frames):
    # n texts of one id and its end id in one partition, and an empty one; a frame has 20 ids, a frame and a half 30
    docs = spark.createDataFrame([(i, "the") for i in range(n)] + [(n, None)], "doc_id long, text string")
    path, held = f"file://{tmp_path}/t", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_files.write_tokens(docs, path, tokenizer_file("word_bpe_49k.json"), frame=20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    rows = spark.read.parquet(path).orderBy("part", "seq").collect()
    assert [len(r["doc_ids"]) for r in rows] == frames
    assert [d for r in rows for d in r["doc_ids"]] == list(range(n + 1))
    assert [r["n_tokens"] for r in token_files.read_tokens(spark, path).orderBy("doc_id").collect()] == [2] * n + [1]


def test_words_of_latin_letters():
    path = tokenizer_file("word_bpe_49k.json")
    t, encode = token_counts.tokenizer(path)[0], token_files.WordEncoder(path)
    letters = [chr(c) for c in range(0xAA, 0x250) if chr(c).isalpha()]
    texts = ["".join(letters[k : k + n]) + tail for n in (1, 3) for k in range(0, len(letters), n) for tail in ("", ".", " ab c\u0085d ")]
    texts += [" ".join(texts), "", "  ", "a­b ÿĀ Ångström"]
    for _ in range(2):
        assert encode([x.encode() for x in texts]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts]
