import json
import os

import pytest

from folio.cli import main
from folio.config import Config, load_config, parse_size
from folio.engine import Engine, OcrUnavailable
from folio.operators import ocr
from folio.sources.walk import walk
from tests import corpus


@pytest.fixture
def root(tmp_path):
    path = tmp_path / "docs"
    path.mkdir()
    corpus.make(path)
    return path


def statuses(report):
    return {r["rel"]: r["status"] for r in report.records.collect()}


def test_walk_and_plan(spark, root):
    rels = {r["rel"] for r in walk(spark, str(root)).collect()}
    assert rels == {"report.docx", "sub/deck/talk.pptx", "tiny.png", "sub/scan.png", "notes.txt", "_under.txt", "unknown.bin", "empty.txt", "corrupt.docx", "named.txt", "book.xlsx"}
    plan = Engine(spark).build(Config(str(root), ocr="never"), dry_run=True)
    got = {r["rel"]: (r["kind"], r["action"], r["reason"]) for r in plan.items.collect()}
    assert got["report.docx"] == ("docx", "extract", None)
    assert got["sub/deck/talk.pptx"] == ("pptx", "extract", None)
    assert got["tiny.png"] == ("image", "skip", "trivial_image")
    assert got["sub/scan.png"] == ("image", "extract", None)
    assert got["notes.txt"] == ("plaintext", "register", None)
    assert got["unknown.bin"] == got["empty.txt"] == ("unknown", "skip", "unknown_type")
    assert got["book.xlsx"] == ("unsupported", "skip", "unsupported")
    assert got["named.txt"][:2] == ("pdf", "extract")
    assert not os.path.exists(Config(str(root)).meta_dir)


def test_mirror_build_is_idempotent_and_prunes(spark, root):
    config = Config(str(root), ocr="never")
    first = Engine(spark).build(config)
    got = statuses(first)
    assert got["report.docx"] == "low" and got["notes.txt"] == "registered" and got["unknown.bin"] == "skipped" and got["sub/scan.png"] == "empty"
    assert got["named.txt"] == got["corrupt.docx"].replace("skipped", "failed") or got["named.txt"] == "failed"
    text = (root.parent / "docs.folio/text/report.docx.md").read_text()
    assert text.startswith("---\nschema_version: 1\n") and "<!-- para:1 -->" in text and "## Chapter" in text and "| 1 | 2 |" in text and "alone" in text and text.endswith("\n") and not text.endswith("\n\n")
    deck = (root.parent / "docs.folio/text/sub/deck/talk.pptx.md").read_text()
    assert deck.index("A title") < deck.index("body line one") < deck.index("spoken words") and "<!-- page:1 -->" in deck
    assert (root.parent / "docs.folio/text/notes.txt").read_text() == "one line\n"
    manifest = json.loads((root.parent / "docs.folio/MANIFEST.json").read_text())
    assert manifest["schema_version"] == 1 and set(manifest["files"]) == set(got) and manifest["summary"]["written"] == first.written
    assert "report.docx" in (root.parent / "docs.folio/INDEX.md").read_text() and "## failed" in (root.parent / "docs.folio/WARNINGS.md").read_text()

    again = Engine(spark).build(config)
    assert again.written == 0 and statuses(again) == got and again.orphans == []
    os.utime(root / "report.docx", ns=(1, 1))  # another time, the same content
    assert Engine(spark).build(config).written == 0

    (root / "report.docx").unlink()
    left = Engine(spark).build(config)
    assert [os.path.basename(x) for x in left.orphans] == ["report.docx.md"]
    assert [os.path.basename(x) for x in Engine(spark).status(config).orphans] == ["report.docx.md"]
    gone = Engine(spark).build(Config(str(root), ocr="never", prune=True))
    assert [os.path.basename(x) for x in gone.pruned] == ["report.docx.md"] and gone.orphans == []
    assert not (root.parent / "docs.folio/text/report.docx.md").exists()


def test_plans_hash_only_what_is_in_doubt(spark, root):
    config = Config(str(root), ocr="never")
    hashed = lambda: {r["rel"] for r in Engine(spark).plan(config).items.where("content_hash IS NOT NULL").collect()}
    assert hashed() == set()
    records = {r["rel"]: r for r in Engine(spark).build(config).records.collect()}
    assert {r for r, x in records.items() if x["content_hash"] is None} == {r for r, x in records.items() if x["status"] == "skipped"}
    assert hashed() == set()
    os.utime(root / "notes.txt", ns=(5, 5))
    assert hashed() == {"notes.txt"}
    (root / "notes.txt").write_text("other line\n")  # of another length
    assert hashed() == set()


def test_state_survives(spark, root):
    """The state before counts while states are swapped; without either, MANIFEST.json does."""
    from folio.sources import sinks

    config = Config(str(root), ocr="never")
    first = Engine(spark).build(config)
    want, artifacts = sorted(map(str, first.records.collect())), sorted(r["target"] for r in sinks.load_state(spark, config.meta_dir)[1].collect())
    os.rename(f"{config.meta_dir}/state", f"{config.meta_dir}/state.old")
    assert sorted(map(str, sinks.load_state(spark, config.meta_dir)[0].collect())) == want
    os.rename(f"{config.meta_dir}/state.old", f"{config.meta_dir}/elsewhere")
    records, known, found = sinks.load_state(spark, config.meta_dir)
    assert found and sorted(map(str, records.collect())) == want and sorted(r["target"] for r in known.collect()) == artifacts
    assert Engine(spark).build(config).written == 0
    with open(f"{config.meta_dir}/MANIFEST.json", "w") as file:
        file.write("[]")
    os.rename(f"{config.meta_dir}/state", f"{config.meta_dir}/elsewhere2")
    assert not sinks.load_state(spark, config.meta_dir)[2]


def test_walk_deals_out_any_tree(spark, tmp_path, monkeypatch):
    from folio.sources import walk as module

    deep = tmp_path / "a/b/c/d/e"
    deep.mkdir(parents=True)
    for i in range(25):
        (tmp_path / f"f{i:02}.txt").write_text("x")
        (deep / f"g{i:02}.txt").write_text("x")
    os.symlink(tmp_path, tmp_path / "a/loop")
    monkeypatch.setattr(module, "PART_FILES", 10)
    reader = module._Reader(str(tmp_path), True, [], False)
    parts = reader.partitions()
    rels = [r[0] for p in parts for r in reader.read(p)]
    assert len(parts) >= 6 and len(rels) == len(set(rels)) == 50
    monkeypatch.setattr(module, "LEAST_TASKS", 2)
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == sorted(rels)


PDF_STAND_IN = '''
"""Reads pages from JSON: what the real library gives, without it."""
import json
class Rect:
    def __init__(self, w, h): self.width, self.height = w, h
class Table:
    def __init__(self, t): self.bbox, self._cells = t["bbox"], t["cells"]
    def extract(self): return self._cells
class Page:
    def __init__(self, p): self.p, self.rect = p, Rect(*p["size"])
    def find_tables(self): return type("Found", (), {"tables": [Table(t) for t in self.p.get("tables", [])]})
    def get_text(self, kind): return {"blocks": [{"lines": [{"bbox": l[1:], "spans": [{"text": l[0]}]} for l in self.p["lines"]]}]}
    def get_image_info(self): return [{"bbox": b} for b in self.p.get("images", [])]
    def get_pixmap(self, matrix, alpha):
        if self.p.get("no_pixmap"): raise ValueError("no pixmap")
        return type("Pixmap", (), {"tobytes": lambda s, kind: b"png"})()
def Matrix(a, b): return a
class File:
    def __init__(self, pages): self.pages, self.page_count, self.needs_pass = pages, len(pages), pages == [None]
    def __enter__(self): return self
    def __exit__(self, *a): pass
    def load_page(self, i):
        if self.pages[i] == "broken": raise ValueError("bad page")
        return Page(self.pages[i])
def open(path):
    with __builtins__["open"](path, "rb") as f: return File(json.loads(f.read()[8:]))
'''


def test_pdf(spark, tmp_path, monkeypatch):
    """PDF through a stand-in for the library: order, tables, coverage, damage, passwords, OCR and its failures."""
    root, lib = tmp_path / "docs", tmp_path / "lib"
    root.mkdir()
    lib.mkdir()
    (lib / "pymupdf.py").write_text(PDF_STAND_IN)
    body = lambda fruit: [[f"line {i} of a page with a fair number of {fruit}s", 10, 100 + 12 * i, 500, 110 + 12 * i] for i in range(8)]
    pages = [{"size": [600, 800], "lines": [*body(fruit)[::-1], ["inside", 20, 420, 60, 430], [f"Page {n}", 10, 790, 60, 798]]} for n, fruit in enumerate(("apple", "pear", "plum"), 1)]
    pages[0]["tables"] = [{"bbox": [10, 400, 500, 460], "cells": [["k", "v"], ["1", None], ["2", "3"]]}]
    pages += ["broken", {"size": [600, 800], "lines": [], "images": [[0, 0, 600, 700]]}, {"size": [600, 800], "lines": [], "no_pixmap": True}]
    write = lambda name, x: (root / name).write_bytes(b"%PDF-1.7" + json.dumps(x).encode())
    write("good.pdf", pages)
    write("locked.pdf", [None])
    (root / "bad.pdf").write_bytes(b"%PDF-1.7 junk")
    path = str(lib)

    def with_library(files):  # in the workers
        import sys

        sys.path.insert(0, path)
        return extract.pdf(files)

    from folio import engine as engine_module
    from folio.sources import extract

    images_of = engine_module.images_of

    def with_images(*args):
        import sys

        sys.path.insert(0, path)
        return images_of(*args)

    monkeypatch.setattr(engine_module, "images_of", with_images)
    monkeypatch.setitem(extract._EXTRACTORS, "pdf", with_library)
    ocr.register_backend(Mock())
    try:
        config = Config(str(root), ocr_page_threshold=40)
        rows = {r["rel"]: r for r in Engine(spark).build(config).records.collect()}
    finally:
        ocr._BACKENDS.clear()
    assert (rows["locked.pdf"]["status"], rows["locked.pdf"]["skip_reason"]) == ("failed", "encrypted") and rows["bad.pdf"]["skip_reason"] == "corrupt"
    good = rows["good.pdf"]
    assert good["partial"] and good["has_tables"] and good["text_layer"] == "mixed" and good["removed_running_heads"] == ["Page %d"] and good["pages"] == 6
    assert good["ocr"]["pages"] == [5] and "page 4: bad page" in good["warnings"] and "image-heavy pages: 5" in good["warnings"]
    assert any(w.startswith("page 6: ocr_rasterize_failed") for w in good["warnings"])
    text = (tmp_path / "docs.folio/text/good.pdf.md").read_text()
    assert text.index("line 0") < text.index("line 7") < text.index("| k | v |\n|---|---|\n| 1 |  |\n| 2 | 3 |") < text.index("inside") and text.count("inside") == 2 and "Page 1\n" not in text.replace("## Page 1\n", "")


def test_all_pictures_of_a_slide(spark, tmp_path):
    import zipfile

    from folio.engine import images_of

    A, P, R = corpus.A, corpus.P, corpus.R
    pic = lambda i, y: f'<p:pic><p:blipFill><a:blip r:embed="i{i}"/></p:blipFill><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr></p:pic>'
    slide = f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><p:cSld><p:spTree>{pic(1, 90)}{pic(2, 5)}</p:spTree></p:cSld></p:sld>'
    with zipfile.ZipFile(tmp_path / "x.pptx", "w") as archive:
        archive.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="1" r:id="r1"/><p:sldId id="2" r:id="r2"/></p:sldIdLst></p:presentation>')
        archive.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{corpus.RELS}"><Relationship Id="r1" Type="{R}/slide" Target="slides/slide1.xml"/><Relationship Id="r2" Type="{R}/slide" Target="slides/slide2.xml"/></Relationships>')
        archive.writestr("ppt/slides/slide1.xml", slide)
        archive.writestr("ppt/slides/slide2.xml", slide.replace("p:pic>", "p:sp>"))
        archive.writestr("ppt/slides/_rels/slide1.xml.rels", f'<Relationships xmlns="{corpus.RELS}">' + "".join(f'<Relationship Id="i{i}" Type="x/image" Target="../media/{i}.png"/>' for i in (1, 2)) + "</Relationships>")
        for i in (1, 2):
            archive.writestr(f"ppt/media/{i}.png", f"picture {i}")
    assert images_of(str(tmp_path / "x.pptx"), "pptx", 1, 200) == ([b"picture 2", b"picture 1"], None)
    assert images_of(str(tmp_path / "x.pptx"), "pptx", 2, 200)[1].startswith("pptx_render_unavailable")
    assert images_of(str(tmp_path / "x.pptx"), "pptx", 3, 200)[1].startswith("pptx_image_read_failed")


def test_extractors_get_the_settings_and_rules_are_replaceable(spark, root):
    from folio.operators import lines as L
    from folio.sources import extract

    def own(path, config):
        line = {"text": f"read under {config.ocr}", "y0": None, "y1": None}
        return {"extractor": "own", "pages": [{"number": 1, "width": None, "height": None, "source": "text", "image_ratio": 0.0, "lines": [line], "elements": []}]}

    def shout(lines, keys):
        from pyspark.sql import functions as F

        return L.unwrapped(lines, keys).withColumn("text", F.upper("text"))

    before = extract._EXTRACTORS["docx"]
    extract.register_extractor("docx", own)
    try:
        Engine(spark, shout).build(Config(str(root), ocr="never"))
    finally:
        extract.register_extractor("docx", before)
    assert "READ UNDER NEVER" in (root.parent / "docs.folio/text/report.docx.md").read_text()


def test_in_place_never_overwrites(spark, root):
    (root / "report.docx.md").write_text("my own notes\n")
    config = Config(str(root), mode="in-place", ocr="never")
    report = Engine(spark).build(config)
    rows = {r["rel"]: r for r in report.records.collect()}
    assert rows["report.docx"]["status"] == "failed" and rows["report.docx"]["skip_reason"] == "target_exists"
    assert (root / "report.docx.md").read_text() == "my own notes\n"
    assert (root / "sub/deck/talk.pptx.md").exists() and not (root / "notes.txt.md").exists()
    again = Engine(spark).build(config)
    assert not any(r.endswith(".pptx.md") for r in statuses(again)) and "report.docx.md" in statuses(again)
    other = Engine(spark).build(Config(str(root), ocr="never"))
    assert other.stale >= 1 and any(x.endswith("talk.pptx.md") for x in other.orphans)


class Mock:
    name = "mock"

    def recognize(self, image):
        return [("second line of what was read", 0.9, 0.5, 0.6), ("first line of what was read", 0.9, 0.1, 0.2)]


def test_ocr(spark, root):
    with pytest.raises(OcrUnavailable):
        Engine(spark).plan(Config(str(root), ocr="only"))
    ocr.register_backend(Mock())
    try:
        config = Config(str(root))
        row = {r["rel"]: r for r in Engine(spark).build(config).records.collect()}["sub/scan.png"]
        assert row["ocr"]["backend"] == "mock" and row["ocr"]["pages"] == [1] and row["extractor"] == "image+mock"
        text = (root.parent / "docs.folio/text/sub/scan.png.md").read_text()
        assert text.index("first line") < text.index("second line") and "<!-- page:1 ocr -->" in text
        # The cache outlives the state: a backend that fails isn't asked again.
        import shutil

        shutil.rmtree(root.parent / "docs.folio/state")
        Mock.recognize = lambda self, image: 1 / 0
        row = {r["rel"]: r for r in Engine(spark).build(config).records.collect()}["sub/scan.png"]
        assert row["ocr"]["pages"] == [1]
    finally:
        ocr._BACKENDS.clear()


def test_index_shards(spark, tmp_path):
    root = tmp_path / "many"
    for i in range(510):
        (root / f"dir_{i % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"dir_{i % 3}" / f"f{i:04}.txt").write_text(str(i))
    (root / "top.txt").write_text("x")
    Engine(spark).build(Config(str(root), ocr="never"))
    shards = sorted(os.listdir(tmp_path / "many.folio/index"))
    assert shards == ["%root.md", "dir_0.md", "dir_1.md", "dir_2.md"]
    assert (tmp_path / "many.folio/index/dir_0.md").read_text().count("| `dir_0/") == 170


def test_config(tmp_path):
    assert [parse_size(x) for x in ("512MiB", "10k", "1.5g", "7")] == [512 << 20, 10240, 3 << 29, 7]
    (tmp_path / ".folio.toml").write_text('[build]\nocr = "never"\nmax_bytes = "10k"\nunknown = 1\n')
    config = load_config(str(tmp_path), home=tmp_path / "nobody", mode="mirror", ocr=None)
    assert config.ocr == "never" and config.max_bytes == 10240
    assert load_config(str(tmp_path), home=tmp_path / "nobody", ocr="auto").ocr == "auto"
    (tmp_path / ".folio.toml").write_text("ocr = [")
    with pytest.raises(ValueError):
        load_config(str(tmp_path), home=tmp_path / "nobody")
    with pytest.raises(ValueError):
        Config(str(tmp_path), mode="in-place", out="x")
    with pytest.raises(ValueError):
        Config(str(tmp_path / "a"), out=str(tmp_path))
    assert Config("a").digest == Config("b", mode="in-place").digest != Config("a", ocr="never").digest


def test_cli(spark, root, capsys):
    assert main(["build", str(root)], spark) == 2
    assert main(["build", str(root / "none"), "--mirror"], spark) == 2
    assert main(["build", str(root), "--in-place", "--out", "x"], spark) == 2
    assert main(["build", str(root), "--mirror", "--ocr", "only"], spark) == 2
    assert main(["build", str(root), "--mirror", "--ocr", "never", "--dry-run"], spark) == 0
    assert "extract    report.docx" in capsys.readouterr().out
    assert main(["build", str(root), "--mirror", "--ocr", "never"], spark) == 1  # files failed
    assert main(["status", str(root)], spark) == 0
