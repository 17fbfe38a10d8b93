"""What a judge is asked: the paragraphs of a slide, with the hints of the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import strip

#: Names of kinds and the lines of a request.
KINDS = {"title": "제목", "body": "본문", "table": "표", "chart": "차트", "notes": "발표자노트"}
NO_TITLE = "(제목 없음)"
LIST_HEAD = "## 문단 목록"
HINT_HEAD = "## 규칙 사전이 미리 감지한 신호 (참고용, 오탐 가능)"
HINT_NOTE = "이 신호는 힌트일 뿐이다. 문맥상 기술적 실질이 없으면 무시하고, 신호가 없는 문단에서도 근거가 있으면 직접 찾아내라."
REQUEST = "위 문단들을 검토해 특허 검토가 필요한 구간을 JSON 으로 반환하라."


def slide_prompts(segs: DataFrame) -> DataFrame:
    """(doc_id, slide_no, prompt): a request for each slide. ``segs``: doc_id, seg_id, slide_no, kind, text, hints (array, may be empty).

    The title is the document's first segment of that kind; hints are named only where the slide has any.
    """
    docs = segs.groupBy("doc_id").agg(F.max("slide_no").alias("total"), strip(F.min_by("text", F.when(F.col("kind") == "title", F.col("seg_id")))).alias("title"))
    one = F.struct("seg_id", "kind", "text", F.array_join("hints", ", ").alias("cats"))
    slides = segs.groupBy("doc_id", "slide_no").agg(F.array_sort(F.collect_list(one)).alias("x")).join(docs, "doc_id")
    number = lambda x: F.concat(F.lit("#"), x["seg_id"].cast("string"))

    def name(kind: Column) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv]), kind), kind)

    shown = F.transform("x", lambda x: F.concat(number(x), F.lit(" ["), name(x["kind"]), F.lit("] "), x["text"]))
    told = F.transform(F.filter("x", lambda x: x["cats"] != ""), lambda x: F.concat(number(x), F.lit(" → "), x["cats"]))
    lines = lambda *s: F.array(*[F.lit(x) if isinstance(x, str) else x for x in s])
    title = F.concat(F.lit("문서: "), F.coalesce(F.nullif("title", F.lit("")), F.lit(NO_TITLE)))
    place = F.concat(F.lit("슬라이드 "), F.col("slide_no").cast("string"), F.lit(" / 전체 "), F.col("total").cast("string"))
    hinted = F.when(F.size(told) > 0, F.concat(lines("", HINT_HEAD), told, lines(HINT_NOTE))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(lines(title, place, "", LIST_HEAD), shown, hinted, lines("", REQUEST))
    return slides.select("doc_id", "slide_no", F.array_join(whole, "\n").alias("prompt"))
