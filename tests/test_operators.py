"""Golden cases of the span operators."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import evaluate, judge, marks, memory, review, scan
from spanloom.operators.rules import KOREAN, user_rules

SHIFT = "전극 검사장비 매출 비중이 34% → 51%로 상승. 조립·물류 장비 중심 구조에서 검사 솔루션 중심으로 이동 중."
LIGHT = "450nm 청색광과 660nm 적색광을 200Hz로 교번 점등하고, 파장별 영상을 합성해 표면 결함과 내부 기공을 한 번의 스캔으로 동시 검출."
NOISE = [(SHIFT, "전극 검사장비 매출 비중이 34% → 51%로 상승", True), (SHIFT, "조립·물류 장비 중심 구조에서 검사 솔루션 중심으로 이동 중", False), (LIGHT, "450nm 청색광과 660nm 적색광을 200Hz로 교번 점등", False), ("오검출률 4.2% → 0.7%", "4.2% → 0.7%", False)]


def test_noise_and_places(spark):
    df = spark.createDataFrame([(i, 1, 1, t, q, e) for i, (t, q, e) in enumerate(NOISE)], "doc_id long, seg_id int, slide_no int, text string, quote string, expect boolean")
    df = scan.scan(df, KOREAN).withColumn("span", T.locate("text", "quote"))
    for r in df.withColumn("got", scan.is_noise(KOREAN, F.col("span.s"), F.col("span.e"))).collect():
        assert r["got"] == r["expect"], r["quote"]
        for h in r["hits"]:
            assert r["text"][h["s"] : h["e"]] == h["matched"]


@pytest.mark.parametrize("text, expect", [("관련 기술 특허 출원", True), ("지식재산 검토 미착수", True), ("외부에 공개된 이력", False)])
def test_status(spark, text, expect):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(scan.is_status(KOREAN)).first()[0] is expect


def test_locate_ignores_white_space(spark):
    df = spark.createDataFrame([("a b  c𝄞 d", "bc𝄞"), ("abc", "x"), ("abc", ""), (None, "a")], "t string, q string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(T.locate("t", "q")).collect()]
    assert got == [(2, 7), None, None, None]


def test_similarity_of_numbers(spark):
    a = "코팅 두께 편차 ±0.8㎛ → ±0.3㎛로 축소. 슬롯다이 제어기에 200ms 주기로 반영하는 폐루프 구성."
    df = spark.createDataFrame([(a, a.replace("200", "150"))], "a string, b string")
    assert df.select(T.dice(T.bigrams("a"), T.bigrams("b"))).first()[0] == 1.0
    assert spark.createDataFrame([("",), ("x",), (None,)], "t string").select(F.size(T.bigrams("t"))).collect() == [(0,), (1,), (0,)]


def test_marks_merge_touching_spans_and_whole_segments(spark):
    rows = [(1, 1, 1, (0, 5), "B", False), (1, 1, 1, (5, 9), "A", True), (1, 1, 1, (11, 12), "C", False), (1, 2, 1, (0, 3), "B", False), (1, 2, 1, None, "A", True)]
    f = spark.createDataFrame(rows, "doc_id long, seg_id int, slide_no int, span struct<s:int,e:int>, grade string, disclosure_risk boolean")
    got = sorted((r["seg_id"], r["s"] if r["s"] is not None else -1, r["e"], r["grade"], r["risk"]) for r in marks.build_marks(f).collect())
    assert got == [(1, 0, 9, "A", True), (1, 11, 12, "C", False), (2, -1, None, "A", True)]


def test_last_record_wins(spark):
    rows = [(1, "match", "some text", "text", "a", False, None), (2, "fp", "Some  text", "text", None, None, None), (3, "gold", "some text", "some", "A", True, "x"), (4, "gold", "tiny", "ti", "A", True, "x")]
    c = spark.createDataFrame(rows, "seq long, type string, text string, quote string, grade string, risk boolean, category string")
    assert sorted((r["quote"], r["kind"], r["seq"]) for r in memory.fold(c).collect()) == [("some", "gold", 3), ("text", "neg", 2)]


def test_memory_match_equals_brute_force(spark):
    base = ["alpha beta gamma delta epsilon zeta eta theta", "completely different words are in this line", "alpha beta gamma delta epsilon zeta eta thetas"]
    q = spark.createDataFrame([("1", base[0].upper()), ("2", base[0] + " 1"), ("3", "nothing alike"), ("4", "")], "qid string, text string")
    m = spark.createDataFrame([(b,) for b in base], "key string")
    got = {r["qid"]: r["key"] for r in memory.match_paragraphs(q, m).collect()}
    assert got["1"] == base[0] and set(got) == {"1", "2"}


def test_pairing_takes_each_span_once(spark):
    s = "doc_id long, seg_id int, {} long, s int, e int, grade string, risk boolean"
    human = spark.createDataFrame([(1, 1, 0, 0, 4, "A", False), (1, 1, 1, 2, 6, "A", False), (1, 1, 2, 20, 25, "B", False)], s.format("hid"))
    model = spark.createDataFrame([(1, 1, 0, 3, 5, "A", False), (1, 1, 1, 5, 8, "B", False), (1, 1, 2, 30, 31, "A", True)], s.format("mid"))
    got = review.counts(review.pair_spans(human, model)).first()
    assert tuple(got) == (1, 1, 1, 1, 25)


def test_metrics(spark):
    s = "doc_id long, seg_id int, {} long, s int, e int, grade string, risk boolean"
    p = spark.createDataFrame([(1, 1, 0, 0, 4, "A", False), (1, 1, 1, 50, 60, "A", False), (1, 2, 2, None, None, "B", False)], s.format("pid"))
    g = spark.createDataFrame([(1, 1, 0, 2, 3, "A", False), (1, 2, 1, 2, 3, "A", False), (1, 3, 2, 0, 1, "A", False)], s.format("gid"))
    assert tuple(evaluate.metrics(p, g).first()) == (2, 1, 1, 3, 66.7, 66.7, 66.7, 50.0)


def test_colours_and_batches(spark):
    c = spark.createDataFrame([("FFFF00",), ("00FFFF",), ("FF5050",), ("808080",), ("zz",), (None,), ("FF00FF",)], "c string")
    assert [tuple(r[0]) for r in c.select(T.colour_grade("c")).collect()] == [("A", False), ("B", False), ("B", True), ("B", False), ("B", False), ("B", False), ("B", True)]
    s = spark.createDataFrame([(1, 1, i, "x" * n) for i, n in enumerate([10, 10, 100, 1])], "doc_id long, slide_no int, seg_id int, text string")
    assert review.pack_batches(s, 60).first()["batches"] == [[0, 1], [2], [3]]


def test_answers_are_repaired(spark):
    a = spark.createDataFrame([(1, 1, '<think>x</think> ok {"findings":[{"i":2,"q":" a ","g":"z","c":"?"}]} bye'), (1, 1, "broken"), (1, 1, '[{"seg_id":3,"grade":"a"}]')], "doc_id long, slide_no int, content string")
    got = sorted((r["seg_id"], r["quote"], r["grade"], r["category"]) for r in judge.parse_answers(a).collect())
    assert got == [(2, "a", "C", judge.FALLBACK), (3, "", "A", judge.FALLBACK)]


def test_user_rules_count_skipped_entries():
    assert [r.rid for r in user_rules(["x", "two words", None, "ok."])] == ["USER_2", "USER_4"]


def test_exclusions_take_other_numbers(spark):
    f = spark.createDataFrame([("cost 9% down", False, "llm"), ("cost 9% down", True, "llm"), ("cost 9% down", False, "memory"), ("unlike", False, "llm")], "quote string, disclosure_risk boolean, source string")
    got = sorted((r["quote"], r["disclosure_risk"], r["source"]) for r in memory.apply_excludes(f, ["cost 12% down"]).collect())
    assert got == [("cost 9% down", False, "memory"), ("cost 9% down", True, "llm"), ("unlike", False, "llm")]
    assert memory.apply_excludes(f, []).count() == 4


def test_flags_that_are_strings_are_true_and_a_null_short_key_hides_the_long_one(spark):
    items = '[{"i":1,"d":"false"},{"i":2,"d":false},{"i":3,"d":null,"disclosure_risk":true},{"i":"4","disclosure_risk":1},{"i":5,"m":0,"c":"효과만기재"},7]'
    a = spark.createDataFrame([(1, 1, items)], "doc_id long, slide_no int, content string")
    got = sorted((r["seg_id"], r["disclosure_risk"], r["implicit"]) for r in judge.parse_answers(a).collect())
    assert got == [(1, True, True), (2, False, True), (3, False, True), (4, True, True), (5, False, False)]


def test_false_positives_without_a_span_cover_their_segment(spark):
    s = "doc_id long, seg_id int, {} long, s int, e int, grade string, risk boolean"
    base = spark.createDataFrame([(1, 1, 0, None, None, "A", False), (1, 2, 0, 0, 3, "A", False)], s.format("pid"))
    cur = spark.createDataFrame([(1, 1, 0, 4, 6, "A", False), (1, 3, 0, None, None, "B", False)], s.format("pid"))
    golds = spark.createDataFrame([(1, 3, 0, 2, 3, "A", False), (1, 2, 0, 9, 12, "A", False)], s.format("gid"))
    assert tuple(evaluate.fixes(base, cur, golds).first()) == (1, 0, 1, 0)
    segs = spark.createDataFrame([(1, i, "abcdefghijklm") for i in (1, 2, 3)], "doc_id long, seg_id int, text string")
    got = {r["change"]: r["quotes"] for r in evaluate.kept_quotes(evaluate.changes(base, cur, golds), segs).collect()}
    assert got == {"miss_fixed": ["c"], "fp_fixed": ["abc"]}


def test_index_keeps_the_first_paragraph_and_its_guards(spark):
    rows = [(1, "gold", "first paragraph here", "phrase one"), (2, "gold", "second paragraph here", "phrase one"), (3, "gold", "first paragraph here", "phrase one"), (4, "gold", "second paragraph here", "ab"), (5, "fp", "second paragraph here", "short")]
    c = spark.createDataFrame([(*r, "A", False, None, f"2026-01-0{r[0]}" if r[0] < 3 else "") for r in rows], "seq long, type string, text string, quote string, grade string, risk boolean, category string, date string")
    got = [(r["norm"], r["para_key"], r["seq"]) for r in memory.consistent(memory.fold(c)).collect()]
    assert got == [("phrase one", "first paragraph here", 3)]
    assert {r["para_key"]: r["date"] for r in memory.paragraphs(c).collect()} == {"first paragraph here": "2026-01-01", "second paragraph here": "2026-01-02"}


def test_lines_of_white_space_are_no_segments(spark):
    d = spark.createDataFrame([(1, "a\n\t\n　\n b \n"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in scan.segments(d).orderBy("seg_id").collect()] == ["a", " b "]


def test_resolve_counts_graded_down_segments_as_covered(spark):
    # the claim of mere status goes and its segment is rescued; noise without a rule on it is C and covers its segment
    texts = ["특허 출원 현황, 전시회 공개", "매출 목표 물량 증가 전시회", "알고리즘 구조 개선 방식"]
    segs = scan.scan(spark.createDataFrame([(1, i, 1, t) for i, t in enumerate(texts)], "doc_id long, seg_id int, slide_no int, text string"), KOREAN)
    f = spark.createDataFrame([(1, 0, "특허 출원 현황", "A", "공개이력", False, True, "llm"), (1, 1, "매출", "A", "문제해결", False, False, "llm")], "doc_id long, seg_id int, quote string, grade string, category string, implicit boolean, disclosure_risk boolean, source string")
    got = sorted((r["seg_id"], r["source"], r["grade"]) for r in marks.resolve(f, segs, KOREAN).collect())
    assert got == [(0, "lexicon", "B"), (2, "lexicon", "B")]
