"""Slide decks (Office Open XML) as segments, read from the binary files of a folder by Spark's own reader."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A, P = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
C, R = "{http://schemas.openxmlformats.org/drawingml/2006/chart}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "path string, seg_id int, slide_no int, kind string, addr string, text string, markable boolean, error string"


class _Deck:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))

    def part(self, name: str) -> ET.Element:
        return ET.fromstring(self.zip.read(name))

    def links(self, name: str) -> dict[str, tuple[str, str]]:
        """id: (last word of the type, part) of a part's relationships."""
        folder, base = posixpath.split(name)
        try:
            rels = self.part(f"{folder}/_rels/{base}.rels")
        except KeyError:
            return {}
        at = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {r.get("Id"): (r.get("Type").rpartition("/")[2], at(r.get("Target"))) for r in rels}

    def slides(self) -> list[str]:
        links = self.links("ppt/presentation.xml")
        return [links[x.get(f"{R}id")][1] for x in self.part("ppt/presentation.xml").iter(f"{P}sldId")]


def _paragraphs(body: ET.Element) -> Iterator[tuple[int, str]]:
    for k, p in enumerate(body.findall(f"{A}p"), 1):
        text = "".join(t.text or "" for t in p.iter(f"{A}t"))
        if text.strip():
            yield k, text


def _shapes(tree: ET.Element, trail: str = "") -> Iterator[tuple[str, ET.Element]]:
    """Shapes in drawing order with their path; those of groups stand in the group's place."""
    known = [x for x in tree if x.tag in (f"{P}sp", f"{P}grpSp", f"{P}graphicFrame", f"{P}pic", f"{P}cxnSp")]
    for k, shape in enumerate(known, 1):
        if shape.tag == f"{P}grpSp":
            yield from _shapes(shape, f"{trail}{k}/")
        else:
            yield f"{trail}{k}", shape


def _is_title(shape: ET.Element) -> bool:
    ph = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
    return ph is not None and ph.get("type") in ("title", "ctrTitle")


def _chart_text(chart: ET.Element) -> str:
    title = chart.find(f"{C}chart/{C}title")
    bits = ["".join(t.text or "" for t in title.iter(f"{A}t"))] if title is not None else []
    bits += ["".join(v.text or "" for v in tx.iter(f"{C}v")) for tx in chart.iterfind(f".//{C}ser/{C}tx")]
    return " · ".join(b for b in bits if b.strip())


def deck_segments(data: bytes) -> Iterator[tuple[int, str, str, str, bool]]:
    """(slide_no, kind, addr, text, markable) of a deck: paragraphs of shapes, table cells, charts (not markable), notes."""
    deck = _Deck(data)
    for no, name in enumerate(deck.slides(), 1):
        links, titled = deck.links(name), False
        for path, shape in _shapes(deck.part(name).find(f"{P}cSld/{P}spTree")):
            at = f"s{no}/{path}"
            if (table := shape.find(f".//{A}tbl")) is not None:
                for r, row in enumerate(table.findall(f"{A}tr"), 1):
                    for c, cell in enumerate(row.findall(f"{A}tc"), 1):
                        body = cell.find(f"{A}txBody")
                        for k, text in _paragraphs(body) if body is not None else ():
                            yield no, "table", f"{at}/r{r}c{c}/p{k}", text, True
            elif (chart := shape.find(f".//{C}chart")) is not None:
                if text := _chart_text(deck.part(links[chart.get(f"{R}id")][1])):
                    yield no, "chart", f"{at}/chart", text, False
            elif (body := shape.find(f"{P}txBody")) is not None:
                title = not titled and _is_title(shape)
                titled |= title
                for k, text in _paragraphs(body):
                    yield no, "title" if title else "body", f"{at}/p{k}", text, True
        for kind, part in links.values():
            if kind == "notesSlide":
                for shape in deck.part(part).iter(f"{P}sp"):
                    ph, body = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph"), shape.find(f"{P}txBody")
                    if ph is not None and ph.get("type") == "body" and body is not None:
                        for k, text in _paragraphs(body):
                            yield no, "notes", f"s{no}/notes/p{k}", text, True


def read_decks(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of every .pptx of a folder; seg_id counts through a deck from 1.

    Empty files and those whose name starts with ``~$`` or a dot are left out. A file that is no deck gives one
    row with ``error`` and no text, and doesn't stop the others.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").load(folder)
    files = files.where("length > 0").where(~F.element_at(F.split("path", "/"), -1).rlike(r"^(~\$|%7E\$|\.)"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                try:
                    rows = [(path, k, *x, None) for k, x in enumerate(deck_segments(data), 1)]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, AttributeError) as e:
                    rows = [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                df = pd.DataFrame(rows, columns=names)
                yield df.astype({"seg_id": "Int32", "slide_no": "Int32", "markable": "boolean"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
