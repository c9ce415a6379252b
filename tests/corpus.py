"""A folder of small documents, written with the standard library."""

import struct
import zipfile
import zlib
from pathlib import Path

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"


def png(width: int, height: int, fill: int = 0) -> bytes:
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0" * (width + 1) * height)) + part(b"tEXt", b"x" * fill) + part(b"IEND", b"")


def docx(path: Path) -> None:
    para = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda text: f"<w:tc>{para(text)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    narrow = f"<w:tbl><w:tr>{cell('alone')}</w:tr></w:tbl>"
    body = para("Chapter", "H1") + para("A paragraph of text.") + para("   ") + table + narrow
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        archive.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')


def pptx(path: Path) -> None:
    shape = lambda text, y: f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in text) + "</p:txBody></p:sp>"
    slide = f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{shape(["body line one", "body line two is long enough"], 500)}{shape(["A title"], 10)}</p:spTree></p:cSld></p:sld>'
    notes = f'<p:notes xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>spoken words</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:notes>'
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>')
        archive.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{RELS}"><Relationship Id="r1" Type="{R}/slide" Target="slides/slide1.xml"/></Relationships>')
        archive.writestr("ppt/slides/slide1.xml", slide)
        archive.writestr("ppt/slides/_rels/slide1.xml.rels", f'<Relationships xmlns="{RELS}"><Relationship Id="n1" Type="{R}/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>')
        archive.writestr("ppt/notesSlides/notesSlide1.xml", notes)


def make(root: Path) -> None:
    (root / "sub/.git").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "sub/deck").mkdir()
    docx(root / "report.docx")
    pptx(root / "sub/deck/talk.pptx")
    (root / "tiny.png").write_bytes(png(100, 100))
    (root / "sub/scan.png").write_bytes(png(400, 400, 30_000))
    (root / "notes.txt").write_text("one line\n")
    (root / "_under.txt").write_text("kept although it begins with an underscore\n")
    (root / ".hidden.txt").write_text("no\n")
    (root / "node_modules/x.txt").write_text("no\n")
    (root / "sub/.git/x.txt").write_text("no\n")
    (root / "unknown.bin").write_bytes(b"\0\1\2\3")
    (root / "empty.txt").write_bytes(b"")
    (root / "corrupt.docx").write_bytes(b"PK\3\4junk")
    (root / "named.txt").write_bytes(b"%PDF-1.7 not text")
    (root / "book.xlsx").write_bytes(b"anything")
    (root / "ignored.txt").write_text("no\n")
    (root / ".folioignore").write_text("# rules\nignored.*\n")
