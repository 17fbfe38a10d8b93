"""The rows of op2_suffix_array hold what is left of each text, not only its digest."""

import hashlib
import random
from collections import Counter

from spanloom.llm import suffix_dedup
from spanloom.llm.queries import QUERIES


def test_what_is_left_can_be_read(spark, tmp_path):
    r = random.Random(5)

    def words(n, size=8):
        return " ".join("".join(r.choices("abcdefghijklmnop", k=size)) for _ in range(n))

    long, short, other = words(60), words(60, 4), words(60)
    assert len(long) > 400 > len(short)
    # of é and ũ the last byte is the same
    texts = {1: f"{words(9)}: {long}; {words(9)}", 2: f"{words(9)}, {long}. {words(9)}", 3: f"{words(9)} {short} {words(9)}", 4: f"{words(9)} {short} {words(9)}", 5: words(80), 6: None, 7: f"xé{other}", 8: f"yũ{other}"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = QUERIES["op2_suffix_array"](spark, f"file://{tmp_path}")
    assert found.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = {x["doc_id"]: x for x in found.collect()}
    data = {i: (t or "").encode() for i, t in texts.items()}
    n = Counter(t[a : a + 400] for t in data.values() for a in range(len(t) - 399))
    for i, t in data.items():
        kept, _ = suffix_dedup._cut(t, [(a, a + 400) for a in range(len(t) - 399) if n[t[a : a + 400]] > 1])
        assert rows[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        # of a character cut in two nothing is shown
        assert rows[i]["text"] == kept.decode("utf-8", "ignore")
    assert not any(long[9:90] in x["text"] for x in rows.values())
    # a passage of over 50 words with fewer than 400 bytes stays, by contract
    assert all(short in rows[i]["text"] for i in (3, 4))
    assert (rows[6]["text"], rows[7]["text"], rows[8]["text"]) == ("", "x", "y")
