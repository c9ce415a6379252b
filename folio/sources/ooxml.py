"""The smallest DOCX, PPTX and XLSX files that hold given texts: for queries and tests that need real containers."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from folio.sources.extract import PML, A, R, W

PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return out.getvalue()


def docx_bytes(paragraphs: list[str], style: str = "", tables: list[list[list[str]]] | None = None) -> bytes:
    """Paragraphs, the first with a style of the given name, then tables."""
    named = '<w:pPr><w:pStyle w:val="S"/></w:pPr>' if style else ""
    para = lambda text, look="": f"<w:p>{look}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"
    body = "".join(para(p, named if i == 0 else "") for i, p in enumerate(paragraphs)) + "".join(map(table, tables or []))
    parts = {"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'}
    if style:
        parts["word/styles.xml"] = f'<w:styles xmlns:w="{W[1:-1]}"><w:style w:styleId="S"><w:name w:val="{escape(style)}"/></w:style></w:styles>'
    return _archive(parts)


def pptx_bytes(title: str, paragraphs: list[str]) -> bytes:
    """One slide whose title stands above the body but after it in the file."""
    shape = lambda texts, y: f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in texts) + "</p:txBody></p:sp>"
    kind = R[1:-1]
    return _archive({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{PML[1:-1]}" xmlns:r="{kind}"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{kind}/slide" Target="slides/slide1.xml"/></Relationships>',
        "ppt/slides/slide1.xml": f'<p:sld xmlns:p="{PML[1:-1]}" xmlns:a="{A[1:-1]}"><p:cSld><p:spTree>{shape(paragraphs, 500)}{shape([title], 10)}</p:spTree></p:cSld></p:sld>',
    })


def xlsx_bytes() -> bytes:
    return _archive({"xl/workbook.xml": "<workbook/>"})
