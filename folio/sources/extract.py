"""Extractors: a file's path to the elements of its pages. DOCX and PPTX are read with the standard library, PDF with PyMuPDF if it
is there. Extractors only parse; what becomes of the elements is decided by columns (operators/geometry.py).
"""

from __future__ import annotations

import inspect
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folio.operators.geometry import assembled
from folio.schema import OCR_PAGE_CHARS, PARSED

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PML = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: A path, or an open file for the formats that are read with the standard library.
Source = str | BinaryIO


class ExtractError(Exception):
    """A file that can't be extracted, with a reason code."""

    def __init__(self, reason: str, message: str = ""):
        super().__init__(message or reason)
        self.reason = reason


def _page(number: int, elements: list[dict], width: float | None = None, height: float | None = None, **more: object) -> dict:
    return {"number": number, "width": width, "height": height, "source": "text", "image_ratio": 0.0, "lines": [], "elements": elements} | more


def _document(extractor: str, pages: list[dict], **more: object) -> dict:
    base = {"extractor": extractor, "layout": None, "page_label": "Page", "total_pages": len(pages), "text_layer": "n/a", "has_tables": False, "partial": False, "reason": None, "message": None, "pages_needing_ocr": [], "image_heavy_pages": [], "warnings": [], "pages": pages}
    return base | more


def _box(kind: str, box: tuple[float, float, float, float], **more: object) -> dict:
    return {"kind": kind, **dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)), **more}


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def docx(source: Source) -> dict:
    """One page without a label: paragraphs with the names of their styles, and tables."""
    with zipfile.ZipFile(source) as archive:
        body = _xml(archive, "word/document.xml").find(f"{W}body")
        styles = {}
        if "word/styles.xml" in archive.namelist():
            styles = {s.get(f"{W}styleId"): n.get(f"{W}val", "") for s in _xml(archive, "word/styles.xml").iter(f"{W}style") if (n := s.find(f"{W}name")) is not None}
    said = lambda e: "".join(t.text or "" if t.tag == f"{W}t" else " " for t in e.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))
    elements = []
    for block in body if body is not None else ():
        if block.tag == f"{W}p":
            style = block.find(f"{W}pPr/{W}pStyle")
            style_id = style.get(f"{W}val", "") if style is not None else ""
            elements.append({"kind": "para", "text": said(block), "style": styles.get(style_id, style_id)})
        elif block.tag == f"{W}tbl":
            elements.append({"kind": "table", "cells": [["".join(t.text or "" for t in c.iter(f"{W}t")) for c in row.findall(f"{W}tc")] for row in block.findall(f"{W}tr")]})
    return _document("docx", [_page(1, elements)], layout="flow", page_label="", total_pages=0)


def _slides(archive: zipfile.ZipFile) -> Iterator[tuple[str, str | None]]:
    """Slide parts in order and their notes."""
    targets = lambda name: {r.get("Id"): (r.get("Type", ""), r.get("Target", "")) for r in _xml(archive, name)} if name in archive.namelist() else {}
    known = targets("ppt/_rels/presentation.xml.rels")
    names = [known[i][1] for s in _xml(archive, "ppt/presentation.xml").iter(f"{PML}sldId") if (i := s.get(f"{R}id")) in known]
    for name in names:
        part = "ppt/" + name.lstrip("/").removeprefix("ppt/")
        rels = targets(f"ppt/slides/_rels/{part.rsplit('/', 1)[-1]}.rels")
        note = next((t for kind, t in rels.values() if kind.endswith("/notesSlide")), None)
        yield part, "ppt/notesSlides/" + note.rsplit("/", 1)[-1] if note else None


def _paras(shape: ElementTree.Element) -> list[dict]:
    out = []
    for p in shape.iter(f"{A}p"):
        level = p.find(f"{A}pPr")
        out.append({"level": int(level.get("lvl", 0)) if level is not None else 0, "text": "".join(t.text or "" if t.tag == f"{A}t" else " " for t in p.iter() if t.tag in (f"{A}t", f"{A}br"))})
    return out


def _offset(shape: ElementTree.Element) -> dict:
    off = next(shape.iter(f"{A}off"), None)
    return {"x0": float(off.get("x", 0)), "y0": float(off.get("y", 0))} if off is not None else {}


def pptx(source: Source) -> dict:
    """A page per slide: its shapes with their places, and the notes."""
    pages = []
    with zipfile.ZipFile(source) as archive:
        for number, (part, note) in enumerate(_slides(archive), 1):
            elements = []
            tree = _xml(archive, part).find(f"{PML}cSld/{PML}spTree")
            for shape in tree if tree is not None else ():
                table = next(shape.iter(f"{A}tbl"), None)
                if table is not None:
                    cells = [[" ".join(p["text"] for p in _paras(c)) for c in row.findall(f"{A}tc")] for row in table.findall(f"{A}tr")]
                    elements.append({"kind": "table", "cells": cells, **_offset(shape)})
                elif shape.tag == f"{PML}pic":
                    elements.append({"kind": "picture", **_offset(shape)})
                else:
                    elements.append({"kind": "text", "paras": _paras(shape), **_offset(shape)})
            if note and note in archive.namelist():
                elements += [{"kind": "notes", "paras": _paras(s)} for s in _xml(archive, note).iter(f"{PML}sp") if (ph := s.find(f"{PML}nvSpPr/{PML}nvPr/{PML}ph")) is not None and ph.get("type") == "body"]
            pages.append(_page(number, elements))
    return _document("pptx", pages, layout="slides", page_label="Slide")


def pictures(source: Source, number: int) -> list[bytes]:
    """The bytes of a slide's pictures, from the top left."""
    far = 1 << 40
    with zipfile.ZipFile(source) as archive:
        part = [p for p, _ in _slides(archive)][number - 1]
        links = f"ppt/slides/_rels/{part.rsplit('/', 1)[-1]}.rels"
        rels = {r.get("Id"): r.get("Target", "") for r in _xml(archive, links)} if links in archive.namelist() else {}
        found = []
        for i, pic in enumerate(_xml(archive, part).iter(f"{PML}pic")):
            place, blip = _offset(pic), next(pic.iter(f"{A}blip"), None)
            if blip is not None:
                found.append((place.get("y0", far), place.get("x0", 0), i, "ppt/media/" + rels[blip.get(f"{R}embed")].rsplit("/", 1)[-1]))
        return [archive.read(name) for *_, name in sorted(found)]


def image(source: Source) -> dict:
    """One empty page that is all image."""
    return _document("image", [_page(1, [], None, 1.0, image_ratio=1.0)], text_layer="none", pages_needing_ocr=[1], image_heavy_pages=[1])


def pdf(path: str) -> dict:
    """Pages with placed lines, tables and images; a page that can't be read is empty and the document partial."""
    try:
        import pymupdf
    except ImportError as error:
        raise ExtractError("missing_dependency", "PDF needs PyMuPDF") from error
    try:
        file = pymupdf.open(path)
    except Exception as error:
        raise ExtractError("corrupt", str(error)) from error
    with file:
        if file.needs_pass:
            raise ExtractError("encrypted", "the PDF needs a password")
        pages, warnings = [], []
        for number in range(1, file.page_count + 1):
            try:
                page = file.load_page(number - 1)
                elements = [_box("table", tuple(t.bbox), cells=t.extract()) for t in page.find_tables().tables]
                elements += [_box("line", tuple(x["bbox"]), text="".join(s["text"] for s in x["spans"])) for b in page.get_text("dict")["blocks"] for x in b.get("lines", ())]
                elements += [_box("image", tuple(i["bbox"])) for i in page.get_image_info()]
                pages.append(_page(number, elements, page.rect.width, page.rect.height))
            except Exception as error:
                pages.append(_page(number, []))
                warnings.append(f"page {number}: {error}")
        if warnings:
            warnings.append(f"{len(warnings)} damaged pages were left out")
    return _document("pdf", pages, layout="placed", partial=bool(warnings), warnings=warnings)


_EXTRACTORS: dict[str, Callable[..., dict]] = {"docx": docx, "pptx": pptx, "image": image, "pdf": pdf}


def register_extractor(kind: str, f: Callable[..., dict]) -> None:
    """f(path) or f(path, config) gives a dictionary like schema.PARSED."""
    _EXTRACTORS[kind] = f


def extract_one(kind: str, path: Source, extractors: dict[str, Callable[..., dict]], config: object = None) -> dict:
    """Never raises: a failure is a document with a reason."""
    failed = lambda reason, message: _document(kind, [], reason=reason, message=message)
    f = extractors.get(kind)
    if f is None:
        return failed("no_extractor", kind)
    try:
        found = f(path, config) if len(inspect.signature(f).parameters) > 1 else f(path)
        return _document(kind, []) | found
    except ExtractError as error:
        return failed(error.reason, str(error))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as error:
        return failed("corrupt", f"{type(error).__name__}: {error}")
    except Exception as error:
        return failed("extractor_error", f"{type(error).__name__}: {error}")


def extracted(files: DataFrame, config: object = None, least: int = OCR_PAGE_CHARS) -> DataFrame:
    """(rel, document) of files (rel, kind, path)."""
    extractors = dict(_EXTRACTORS)
    kind = to_arrow_type(PARSED)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):  # one file at a time, so that batches stay small
                rel, own, path = (batch.column(c)[i].as_py() for c in ("rel", "kind", "path"))
                yield pa.record_batch([pa.array([rel]), pa.array([extract_one(own, path, extractors, config)], kind)], names=["rel", "parsed"])

    parsed = files.select("rel", "kind", "path").mapInArrow(run, f"rel string, parsed {PARSED.simpleString()}")
    return parsed.select("rel", assembled(F.col("parsed"), least).alias("document"))
