"""Learned rules, reviews, examples and page colours, on small cases."""

from pyspark.sql import functions as F

from spanloom.operators import history, layout, marks, memory, prompt, recall, review, scan
from spanloom.operators.rules import CORPUS

SEGS = "doc_id long, seg_id int, slide_no int, text string"


def test_learned_hits_come_after_the_rules(spark):
    segs = spark.createDataFrame([(1, 1, 1, "model of 12 rows"), (1, 2, 1, None), (1, 3, 1, "")], SEGS)
    got = recall.scan_learned(segs, CORPUS, ["x", "Model  of"], [recall.PhraseRule("P", "9 rows", "c")]).orderBy("seg_id").collect()
    assert [(h["rid"], h["s"], h["e"]) for h in got[0]["hits"]] == [("NUMBER", 9, 11), ("USER_2", 0, 8), ("P", 9, 16)]
    assert [list(r["hits"] or []) for r in got[1:]] == [[], []]


def test_probe_names_the_heaviest_hit(spark):
    df = scan.scan(spark.createDataFrame([(1, 1, 1, "!! 12 all rights reserved")], SEGS), CORPUS)
    spans = [(0, 6), (6, 10), (2, 3), (2, 2)]
    got = df.select(*[scan.probe(F.lit(s), F.lit(e)).alias(f"p{i}") for i, (s, e) in enumerate(spans)]).first()
    assert [tuple(x) for x in got] == [(True, "emphasis"), (True, "release"), (False, None), (False, None)]


def test_only_markable_segments_are_marked(spark):
    f = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id long, seg_id int")
    segs = spark.createDataFrame([(1, 1, True), (1, 2, False)], "doc_id long, seg_id int, markable boolean")
    assert [r["seg_id"] for r in marks.markable(f, segs).collect()] == [1]


def test_examples_by_bigrams_take_the_best_text_and_fill_up(spark):
    q = spark.createDataFrame([("a", "abcdef"), ("a", "uvwxyz"), ("b", "short"), ("c", None)], "qid string, text string")
    pool = spark.createDataFrame([(1, "include", "nothing"), (2, "include", "uvwxyz"), (3, "exclude", "abcdxx"), (4, "include", "")], "pool_ord int, kind string, text string")
    got = memory.top_examples(memory.example_scores(q, pool), 2, 4).orderBy("kind", "place").collect()
    assert [(r["qid"], r["kind"], r["pool_ord"], round(r["score"], 3)) for r in got] == [("a", "exclude", 3, 0.6), ("a", "include", 2, 1.0), ("a", "include", 1, 0.0)]


def test_review_with_and_without_archive(spark):
    row = lambda d, i, text, human, tags: (d, i, i, f"fp{d}", text, human, tags)
    text = "0123456789 all rights reserved and more text here"
    rows = [row(1, 1, text, [(0, 4, "A", False), (11, 15, "B", True), (44, 48, "B", False)], []), row(1, 2, text, None, None), row(2, 1, text, [(0, 4, "A", False)], [6, 45])]
    paras = scan.scan(spark.createDataFrame(rows, "doc_id long, seg_id int, slide_no int, fingerprint string, text string, human array<struct<s:int,e:int,grade:string,risk:boolean>>, tags array<int>"), CORPUS)
    told = [("fp1", 1, text, 2, 6, "A", False, "x", 0), ("fp1", 1, text, 12, 13, "A", False, "y", 1), ("fp1", 1, text, 20, 30, "B", False, "z", 2), ("fp1", 2, text, None, None, "B", False, "w", 0)]
    archive = spark.createDataFrame(told, "fingerprint string, slide_no int, text string, s int, e int, grade string, risk boolean, category string, mid int")
    got = sorted((r["doc_id"], r["seg_id"], r["type"], r["s"], r["category"], r["from_grade"], r["lexicon_gap"]) for r in review.diff(paras, archive).collect())
    assert got == [(1, 1, "fp", 20, "z", None, None), (1, 1, "match", 0, "x", None, None), (1, 1, "miss", 44, None, None, True), (1, 1, "regrade", 11, "y", "A", None),
                   (2, 1, "fp", 15, "release", None, None), (2, 1, "gold", 0, "number", None, False)]


def test_first_review_of_a_document_counts(spark):
    f = spark.createDataFrame([(1, "a", "x", "broken"), (2, "b", "x", None), (3, "c", "x", None), (4, "d", None, "broken")], "ord int, filename string, fingerprint string, error string")
    assert sorted((r["filename"], r["duplicate_of"]) for r in review.first_reviews(f).collect()) == [("a", None), ("b", None), ("c", "b"), ("d", None)]


def test_page_colours(spark):
    df = spark.createDataFrame([([0.5],), ([2.0, -1.0, 0.5],), ([0.0, 0.5, 1.0, 0.5],), ([1.0, 1.0],), (None,)], "v array<double>")
    got = [tuple(r["c"]) if r["c"] else None for r in df.select(layout.page_rgb("v").alias("c")).collect()]
    assert got == [(0.5, 0.5, 0.5), (1.0, 0.0, 0.5), (0.5, 0.25, 0.0), None, None]
    c = df.limit(1).select(layout.is_dark(F.lit("000000"), F.lit("FFFFFF")).alias("a"), layout.is_dark(F.lit(None).cast("string"), F.lit("101010")).alias("b"), layout.is_dark(F.lit("scheme"), F.lit(None).cast("string")).alias("c"))
    assert tuple(c.first()) == (True, True, False)


def test_list_changes_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["c", "a", "c"]), (None, ["x"])], "b array<string>, a array<string>")
    assert [tuple(map(list, r["x"])) for r in df.select(history.list_changes("b", "a").alias("x")).collect()] == [(["c", "c"], ["b", "b"]), (["x"], [])]


def test_prompts_name_hints_only_where_there_are_any(spark):
    segs = spark.createDataFrame([(1, 1, 1, "body", "one", ["h", "k"]), (1, 2, 2, "other", "two", [])], "doc_id long, seg_id int, slide_no int, kind string, text string, hints array<string>")
    a, b = [r["prompt"].split("\n") for r in prompt.slide_prompts(segs).orderBy("slide_no").collect()]
    assert a == ["문서: " + prompt.NO_TITLE, "슬라이드 1 / 전체 2", "", prompt.LIST_HEAD, "#1 [본문] one", "", prompt.HINT_HEAD, "#1 → h, k", prompt.HINT_NOTE, "", prompt.REQUEST]
    assert b[4:] == ["#2 [other] two", "", prompt.REQUEST]
