"""Recall, layout, history and the sources, on small cases."""

import zipfile

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import history, layout, recall
from spanloom.sources import records, slides

SEGS = "doc_id long, seg_id int, slide_no int, text string"
FINDINGS = "doc_id long, seg_id int, slide_no int, quote string, grade string, category string, implicit boolean, disclosure_risk boolean, source string, span struct<s:int,e:int>"


def test_phrase_rules_allow_other_numbers_blanks_and_order(spark):
    texts = ["원가 40% 절감", "원가  7.5% 절감 달성.", "절감이 큰 원가 구조", "원가 구조. 절감 없음", "", None]
    segs = spark.createDataFrame([(1, i, 1, t) for i, t in enumerate(texts)], SEGS)
    rule = recall.PhraseRule("R", "원가 40% 절감", "c", ("원가", "절감"))
    got = {r["seg_id"]: [(h["s"], h["e"], h["matched"]) for h in r["phrase_hits"]] for r in recall.phrase_hits(segs, [rule]).collect() if r["phrase_hits"]}
    assert got == {0: [(0, 9, texts[0])], 1: [(0, 11, "원가  7.5% 절감")], 2: [(0, 8, "절감이 큰 원가")]}
    assert recall.phrase_pattern("ab") is None and recall.phrase_pattern(None) is None


def test_fuzzy_locate(spark):
    cases = [
        ("abc def", "def", (4, 7)), ("cost 12 % down", "cost 9% down", (0, 14)), ("xx the long phrase yy", "the long phrasing", (3, 17)),
        ("red apples and many green pears", "red apples plus green pears", (0, 31)), ("nothing", "else matters", None), ("abc", "", None), (None, "abc", None), ("abc", None, None),
    ]
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(cases)], "i int, t string, q string")
    got = {r["i"]: tuple(r["x"]) if r["x"] else None for r in df.select("i", recall.fuzzy_locate("t", "q").alias("x")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_memory_takes_the_place_of_findings(spark):
    segs = spark.createDataFrame([(1, 1, 1, "alpha beta"), (1, 2, 1, "gamma delta"), (1, 3, 1, "other text"), (1, 4, 1, "free text")], SEGS)
    f = spark.createDataFrame([(1, i, 1, "x", "B", "c", False, False, "llm", (0, 1)) for i in (1, 2, 3, 4)], FINDINGS)
    matched = spark.createDataFrame([(1, 1, "p1"), (1, 2, "p2"), (1, 3, "p3")], "doc_id long, seg_id int, para_key string")
    folded = spark.createDataFrame([("p1", "beta", "gold", "A", True, "k"), ("p2", "gamma", "neg", "B", False, "k"), ("p3", "zzzzzz", "gold", "A", False, "k")], "para_key string, quote string, kind string, grade string, risk boolean, category string")
    got = sorted((r["seg_id"], r["source"], tuple(r["span"])) for r in recall.apply_memory(f, segs, matched, folded).collect())
    assert got == [(1, "memory", (6, 10)), (3, "llm", (0, 1)), (4, "llm", (0, 1))]


def test_a_rescued_phrase_covers_later_ones(spark):
    segs = spark.createDataFrame([(1, 1, 1, "one two three"), (1, 2, 1, "one two three")], SEGS)
    hits = recall.phrase_hits(segs, [recall.PhraseRule("a", "one two"), recall.PhraseRule("b", "two three"), recall.PhraseRule("c", "three")])
    f = spark.createDataFrame([(1, 2, 1, "x", "B", "c", False, False, "llm", None)], FINDINGS)
    once = recall.rescue_confirmed(f, hits)
    assert sorted((r["seg_id"], r["quote"]) for r in once.where("source = 'memory'").collect()) == [(1, "one two"), (1, "three")]
    assert recall.rescue_confirmed(once, hits).count() == once.count()


def test_diversity_pick_relaxes_step_by_step(spark):
    rows = [(1, "include", "miss", "a", "x", "2026-02-01", 1), (2, "include", "miss", "b", "x", "2026-02-01", 1), (3, "include", "gold", "c", "y", "2026-02-01", 2), (4, "include", "miss", "d", "z", "2020-01-01", 3), (5, "exclude", "fp", "e", None, None, None)]
    pool = spark.createDataFrame(rows, "pool_ord long, kind string, type string, quote string, category string, date string, batch long")
    got = sorted((r["kind"], r["place"], r["quote"]) for r in history.diversity_pick(pool, "2026-03-01", {"include": 3, "exclude": 2}).collect())
    assert got == [("exclude", 1, "e"), ("include", 1, "a"), ("include", 2, "d"), ("include", 3, "b")]


def test_runs_of_settings(spark):
    runs = spark.createDataFrame([(1, "4", None), (2, "4", "on"), (3, "5", "on")], "run_no int, rules string, flag string")
    got = sorted(tuple(r) for r in history.config_changes(runs, ["rules", "flag"]).collect())
    assert got == [(2, "flag", None, "on", "unknown"), (3, "rules", "4", "5", "changed")]


def test_layout(spark):
    box = lambda x, y: (float(x), float(y), float(x + 6), float(y + 10))
    chars = spark.createDataFrame([(1, 1, 1, "ab cd", [box(0, 0), box(6, 0), None, box(12, 0), box(0, 20)])], f"doc_id long, seg_id int, slide_no int, text string, boxes array<{layout.BOX}>")
    got = chars.select(layout.line_rects("boxes", F.lit(0), F.lit(5)).alias("r")).first()["r"]
    assert [tuple(x) for x in got] == [(0.0, -1.0, 18.0, 11.0), (0.0, 19.0, 6.0, 31.0)]
    rects = spark.createDataFrame([(1, 1, 7, [(6.0, 0.0, 18.0, 10.0)])], f"doc_id long, slide_no int, hl_id int, rects array<{layout.BOX}>")
    assert [(r["s"], r["e"]) for r in layout.rect_spans(chars, rects).collect()] == [(1, 4)]
    pages = spark.createDataFrame([(1, 1, 10.0, 7.5), (1, 2, 1.0, 1.0)], "doc_id long, slide_no int, w double, h double")
    shapes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 7.5, 3.0), (1, 1, 5.0, 4.0, 10.0, 7.5, 3.0)], "doc_id long, slide_no int, x0 double, y0 double, x1 double, y1 double, weight double")
    assert sorted(tuple(r) for r in layout.legend_places(pages, shapes, 2.0, 1.0).collect()) == [(1, 1, 7.75, 3.0), (1, 2, 0.0, 0.0)]


def test_lines_are_joined(spark):
    df = spark.createDataFrame([(["가나", "다라", "ab", "", "cd ", "ef"],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(T.joined_lines("x")).collect()] == ["가나다라 ab cd ef", ""]


def test_decks_are_read(spark, tmp_path):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/slide" Target="slides/slide1.xml"/></Relationships>'
    para = lambda *t: "<a:p>" + "".join(f"<a:r><a:t>{x}</a:t></a:r>" for x in t) + "</a:p>"
    shape = lambda ph, body: f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody>{para('cell')}</a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    tree = shape('<p:ph type="title"/>', para("Ti", "tle")) + f"<p:grpSp>{shape('', para(' in ') + para(' '))}</p:grpSp>" + table
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rel)
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {ns}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>")
    (tmp_path / "b.pptx").write_bytes(b"no deck")
    (tmp_path / "~$c.pptx").write_bytes(b"lock")
    got = sorted(((r["seg_id"] or 0, r["kind"], r["addr"], r["text"], r["error"] is None) for r in slides.read_decks(spark, str(tmp_path)).collect()))
    assert got == [(0, None, None, None, False), (1, "title", "s1/1/p1", "Title", True), (2, "body", "s1/2/1/p1", " in ", True), (3, "table", "s1/3/r1c1/p1", "cell", True)]


def test_broken_records_are_left_out(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\nbroken\n[1]\n{"a": "no", "b": "y"}\n\n')
    got = sorted((r["b"], r["a"]) for r in records.read_records(spark, str(tmp_path), "a int, b string").collect())
    assert got == [("x", 1), ("y", None)]
