import random
import statistics
import tempfile

from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import lines as L
from folio.operators import quality
from folio.operators.geometry import in_shape_order, raster_scale
from folio.sources.ignore import IgnoreRules
from folio.streaming.incremental import grade_new_files, latest


def fold(lines):
    """The sequential rule: a line joins what has been put together so far."""
    lengths = [len(x.strip()) for x in lines if x.strip()]
    cut = 0.6 * (statistics.median(lengths) if lengths else 0)
    out = []
    for line in (x.strip() for x in lines):
        before = out[-1] if out else ""
        if not line or not before or before[-1] in X.SENTENCE_END or len(before) < cut:
            out.append(line)
            continue
        cjk = lambda c: "一" <= c <= "鿿" or c in X.CJK_MARKS
        latin, small = before[-1].isascii() and before[-1].isalpha(), "a" <= line[0] <= "z"
        if cjk(before[-1]):
            join = before + line if cjk(line[0]) else None
        elif before[-1] == "-" and len(before) > 1 and before[-2].isascii() and before[-2].isalpha():
            join = before[:-1] + line if small else None
        else:
            join = f"{before} {line}" if (latin or before[-1] == ",") and small else None
        if join is None:
            out.append(line)
        else:
            out[-1] = join
    return "\n".join(out)


def test_soft_wraps_equal_the_fold(spark):
    rng = random.Random(3)
    pages = [["".join(rng.choice("abAB文字，。-, .") for _ in range(rng.choice((0, 1, 2, 5, 9)))) for _ in range(rng.randint(1, 8))] for _ in range(3000)]
    rows = [(i, n, line) for i, page in enumerate(pages) for n, line in enumerate(page)]
    got = L.merge_soft_wraps(spark.createDataFrame(rows, "doc int, line_no int, text string"), ["doc"]).collect()
    assert {r["doc"]: r["text"] for r in got} == {i: fold(p) for i, p in enumerate(pages)}


def test_text_functions(spark):
    row = spark.range(1).select(
        X.clean(F.lit("a\r\nb­​\u0007 c")).alias("clean"), X.head_key(F.lit(" Page  12 of ٣ ")).alias("key"), X.head_key(F.lit("42")).alias("bare"),
        X.yaml_scalar(F.lit("a: b\n\"c\"")).alias("yaml"), X.percent(F.lit(0.1234)).alias("percent"), L.collapse_blanks(F.lit("\n a  \n\n\n\nb\n")).alias("blanks"), raster_scale(F.lit(10_000), F.lit(5)).alias("scale"),
        in_shape_order(F.expr("array(named_struct('top', 5L, 'left', 1L, 'n', 'b'), named_struct('top', cast(null AS BIGINT), 'left', 1L, 'n', 'c'), named_struct('top', 1L, 'left', 9L, 'n', 'a'))")).alias("shapes"),
    ).first()
    assert row["clean"] == "a\nb c" and row["key"] == "Page %d of %d" and row["bare"] == ""
    assert row["yaml"] == '"a: b\\n\\"c\\""' and row["percent"] == "12.3%" and row["blanks"] == " a\n\nb" and row["scale"] == 0.4
    assert [s["n"] for s in row["shapes"]] == ["a", "b", "c"]


def test_quality_tiers(spark):
    texts = {"tiny": "x", "low": "a short page of words here ok " * 4, "ok": "a page with a good number of words on it for all " * 12, "garbled": "words here " * 40 + "�" * 20, "split": "a b c d e f g h i j " * 20, "private": "word " * 60 + "" * 60}
    got = quality.assess(spark.createDataFrame([(k, 1, v) for k, v in texts.items()], "doc string, page_no int, text string"), spark.createDataFrame([(k,) for k in [*texts, "none"]], "doc string"))
    rows = {r["doc"]: (r["status"], [x.split(" ")[0] for x in r["reasons"]]) for r in got.collect()}
    assert rows == {"tiny": ("empty", ["characters"]), "none": ("empty", ["characters"]), "low": ("low", ["median", "characters"]), "ok": ("ok", []), "garbled": ("garbled", ["replacement"]), "split": ("garbled", ["mean"]), "private": ("garbled", ["private-use"])}
    assert {r["doc"]: r["reasons"] for r in got.collect()}["garbled"] == ["replacement characters 4.3% (over 1%)"]


def test_quality_figures_round_as_printf(spark):
    split = lambda n, long: " ".join(["ab"] * long + ["a"] * (n - long))
    texts = {"1.025": split(200, 5), "1.075": split(200, 15), "1.125": split(200, 25), "1.375": split(200, 75), "6.25": "w" * 75 + "\ufffd" * 5, "6.75": "w" * 373 + "\ufffd" * 27, "9.25": "w" * 363 + "\ue000" * 37}
    got = quality.assess(spark.createDataFrame([(k, 1, v) for k, v in texts.items()], "doc string, page_no int, text string"))
    figures = {r["doc"]: [x.split(" (")[0].split(" ")[-1] for x in r["reasons"]] for r in got.collect()}
    assert figures == {k: [f"{float(k):.2f}" if k < "2" else f"{float(k):.1f}%"] for k in texts}
    assert [figures[k] for k in ("1.025", "1.125", "1.375", "6.25", "6.75", "9.25")] == [["1.02"], ["1.12"], ["1.38"], ["6.2%"], ["6.8%"], ["9.2%"]]
    ratios = spark.range(20_000).selectExpr("id", "id / 16000 AS x").select("id", X.fixed(F.col("x"), 2).alias("two"), X.percent(F.col("x")).alias("percent"))
    assert all((r["two"], r["percent"]) == (f"{r['id'] / 16000:.2f}", f"{r['id'] / 16000:.1%}") for r in ratios.collect())


def test_running_heads(spark):
    pages = spark.createDataFrame([("d", i, 100.0) for i in range(1, 5)] + [("few", 1, 100.0)], "doc string, page_no int, height double")
    rows = [("d", i, n, t, y, y + 2) for i in range(1, 5) for n, (t, y) in enumerate([(f"PHYS {i}", 1.0), ("common body", 50.0), (f"Page {i}", 97.0), (str(i), 98.0)])]
    lines = spark.createDataFrame(rows, "doc string, page_no int, line_no int, text string, y0 double, y1 double")
    heads = L.running_heads(pages, lines)
    assert {r["key"] for r in heads.collect()} == {"PHYS %d", "Page %d"}
    assert {r["text"] for r in L.without_heads(pages, lines, heads).collect()} == {"common body", "1", "2", "3", "4"}
    nowhere = lines.withColumns({"y0": F.lit(None).cast("double"), "y1": F.lit(None).cast("double")})
    assert {r["key"] for r in L.running_heads(pages, nowhere).collect()} == {"PHYS %d", "Page %d", "common body"}


def test_ignore_rules(spark):
    rules = IgnoreRules(["*.log", "!keep.log", "/top", "dir/", "a/**/z.txt", "x[0-9].md", r"\#odd", "**/deep/*.c"])
    cases = {"a.log": True, "s/b.log": True, "s/keep.log": False, "top": True, "s/top": False, "dir/f": True, "s/dir/f": True, "a/z.txt": True, "a/b/c/z.txt": True, "x1.md": True, "xx.md": False, "#odd": True, "q/deep/m.c": True}
    assert {k: rules.matches(k) for k in cases} == cases
    got = spark.createDataFrame([(k,) for k in cases], "rel string").select("rel", rules.column(F.col("rel")).alias("i")).collect()
    assert {r["rel"]: r["i"] for r in got} == cases


def test_stream_takes_new_files_once(spark):
    base = tempfile.mkdtemp()
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    docs([(1, "x"), (2, "a good page of words " * 30)]).write.parquet(f"{base}/in")
    run = lambda: grade_new_files(spark, f"{base}/in", docs([]).schema, f"{base}/state", f"{base}/checkpoint")
    run()
    docs([(1, "now a good page of words " * 30)]).write.mode("append").parquet(f"{base}/in")
    run()
    run()
    assert {r["doc_id"]: r["status"] for r in latest(spark, f"{base}/state").collect()} == {1: "ok", 2: "ok"}


def test_image_sizes(tmp_path):
    import struct

    from folio.sources.images import pixels_of

    segment = lambda code, body: bytes((0xFF, code)) + struct.pack(">H", len(body) + 2) + body
    entry = lambda tag, kind, value: struct.pack("<HHI", tag, kind, 1) + struct.pack("<I" if kind == 4 else "<HH", *([value] if kind == 4 else [value, 0]))
    files = {
        "jpeg": (b"\xff\xd8" + segment(0xE0, b"x" * 500) + b"\xff" + segment(0xC2, struct.pack(">BHHB", 8, 30, 50, 3) + b"x" * 9), 1500),
        "broken jpeg": (b"\xff\xd8\xff\xe0\x00", None), "no frame": (b"\xff\xd8" + segment(0xDA, b""), None),
        "extended": (b"RIFF....WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (199).to_bytes(3, "little"), 20_000),
        "lossless": (b"RIFF....WEBPVP8L" + b"\0" * 4 + b"/" + (9 | 19 << 14).to_bytes(4, "little"), 200),
        "lossy": (b"RIFF....WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 16, 9), 144),
        "tiff": (b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + entry(256, 3, 70) + entry(257, 4, 80), 5600), "short tiff": (b"MM\0*", None), "text": (b"hello", None),
    }
    for name, (body, pixels) in files.items():
        (tmp_path / name).write_bytes(body)
        assert pixels_of(str(tmp_path / name), body[:64]) == pixels, name


def test_lines_of_a_placed_page(spark):
    """Rejected tables leave their lines; lines are put in order; accepted tables replace what lies in them."""
    from folio.operators import geometry
    from folio.schema import PARSED

    line = lambda text, x, y: {"kind": "line", "text": text, "x0": x, "y0": y, "x1": x + 10.0, "y1": y + 8.0}
    table = lambda cells, y: {"kind": "table", "cells": cells, "x0": 0.0, "y0": y, "x1": 100.0, "y1": y + 20.0}
    page = {"number": 1, "width": 100.0, "height": 200.0, "source": "text", "image_ratio": 0.0, "lines": [], "elements": [line("below", 5.0, 90.0), line("right", 50.0, 10.0), line("left", 5.0, 10.04), line("cell", 20.0, 45.0), line(" ", 1.0, 1.0), line("loose", 9.0, 125.0), table([["a", None], ["b", "c  d"]], 40.0), table([["", None], [None, "x"]], 120.0), {"kind": "image", "x0": -50.0, "y0": 100.0, "x1": 50.0, "y1": 300.0}]}
    full = {"extractor": "pdf", "layout": "placed", "page_label": "Page", "total_pages": 2, "partial": False, "warnings": [], "pages": [page, page | {"number": 2, "elements": [table([["", ""]], 0.0)]}]}
    found = spark.createDataFrame([(full,)], f"d {PARSED.simpleString()}").select(geometry.assembled(F.col("d"), 12).alias("d")).first()["d"]
    assert [x["text"] for x in found["pages"][0]["lines"]] == ["left", "right", "", "| a |  |", "|---|---|", "| b | c d |", "", "below", "loose"]
    assert found["pages"][0]["image_ratio"] == 0.25 and found["has_tables"] and found["text_layer"] == "mixed" and found["pages_needing_ocr"] == [2] and found["image_heavy_pages"] == []
    assert found["warnings"] == ["page 2: tables can't be relied on, kept as text"]
