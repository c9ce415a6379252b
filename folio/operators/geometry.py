"""Places on pages: what extractors found (elements, see schema.ELEMENT) becomes lines in reading order, by array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.planning import let
from folio.schema import HEAVY_COVERAGE, LINE, OCR_DPI, OCR_PAGE_CHARS, OCR_SIDE, RICH_PAGE_CHARS

NO_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(NO_STRINGS)


def squeezed_cells(cells: Column) -> Column:
    """A table's cells with white space collapsed; null cells are empty."""
    return F.transform(cells, lambda r: F.transform(r, lambda c: X.squeezed(F.coalesce(c, F.lit("")))))


def _width(cells: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(cells, lambda r: F.size(r))), F.lit(0))


def table_rows(cells: Column) -> Column:
    """Markdown rows of a table (array of arrays of cells): short rows padded, a rule under the first; null under two columns."""
    row = lambda r, width: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = lambda width: F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---|"), width), ""))
    rows = lambda width: F.transform(cells, lambda r: row(r, width))
    return F.when(_width(cells) >= 2, let(_width(cells), lambda w: F.concat(F.slice(rows(w), 1, 1), F.array(rule(w)), F.slice(rows(w), F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))))))


def table_accepted(cells: Column) -> Column:
    """Two rows, two columns and more than half of the cells filled."""
    flat = F.flatten(cells)
    filled = F.size(F.filter(flat, lambda c: F.trim(c) != ""))
    return (F.size(cells) >= 2) & (_width(cells) >= 2) & F.coalesce(filled / F.nullif(F.size(flat), F.lit(0)) > 0.5, F.lit(False))


def _lines(texts: Column) -> Column:
    nowhere = F.lit(None).cast("double")
    return F.transform(texts, lambda t: F.struct(t.alias("text"), nowhere.alias("y0"), nowhere.alias("y1")))


def heading_level(style: Column) -> Column:
    """The level that a style's name says, 1 to 6; null for other styles."""
    name = F.trim(style)
    number = F.regexp_extract(F.lower(name), r"^(?:heading |标题\s*)([0-9]+)$", 1)
    return F.when(number != "", F.least(number.cast("int"), F.lit(6))).when(F.lower(name).isin("title") | name.startswith("标题"), 1)


def flowing_lines(elements: Column) -> Column:
    """Lines of paragraphs and tables as they come: a numbered anchor before each paragraph that has text and each table of two
    columns or more; narrower tables stay as text, without a number. A blank line ends each."""

    def heading(e: Column) -> Column:
        level = heading_level(F.coalesce(e["style"], F.lit("")))
        return let(F.struct(level.alias("level"), X.squeezed(F.coalesce(e["text"], F.lit(""))).alias("text")), lambda x: F.when(x["text"] == "", _none()).otherwise(F.array(F.concat(F.when(x["level"].isNotNull(), F.concat(F.repeat(F.lit("#"), x["level"] + 1), F.lit(" "))).otherwise(""), x["text"]))))

    def table(e: Column) -> Column:
        plain = lambda cells: F.filter(F.transform(cells, lambda r: F.trim(F.array_join(r, " "))), lambda t: t != "")
        return let(squeezed_cells(e["cells"]), lambda c: F.coalesce(table_rows(c), plain(c)))

    shown = F.transform(elements, lambda e: F.struct(F.when(e["kind"] == "table", table(e)).otherwise(heading(e)).alias("lines"), ((e["kind"] != "table") | (_width(e["cells"]) >= 2)).alias("counts")))
    kept = F.filter(shown, lambda s: F.size(s["lines"]) > 0)

    def numbered(kept: Column) -> Column:
        places = F.filter(F.transform(kept, lambda s, i: F.when(s["counts"], i)), lambda i: i.isNotNull())
        anchor = lambda i: F.concat(F.lit("<!-- para:"), F.array_position(places, i).cast("string"), F.lit(" -->"))
        return F.flatten(F.transform(kept, lambda s, i: F.concat(F.when(s["counts"], F.array(anchor(i))).otherwise(_none()), s["lines"], F.array(F.lit("")))))

    return _lines(let(kept, numbered))


def in_shape_order(shapes: Column) -> Column:
    """Shapes (top, left, ...) by place, unplaced ones last, else as they came."""
    far = F.lit(1 << 40)
    keyed = F.transform(shapes, lambda s, i: F.struct(F.coalesce(s["top"], far).alias("top"), F.coalesce(s["left"], F.lit(0)).alias("left"), i.alias("i"), s.alias("shape")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(F.struct(a["top"], a["left"], a["i"]) < F.struct(b["top"], b["left"], b["i"]), -1).otherwise(1)), lambda s: s["shape"])


def slide_lines(elements: Column) -> Column:
    """A slide's shapes from the top left: tables, paragraphs indented by level; then the notes. A blank line ends each."""
    shapes = F.transform(F.filter(elements, lambda e: e["kind"] != "notes"), lambda e: F.struct(e["y0"].cast("long").alias("top"), e["x0"].cast("long").alias("left"), e.alias("e")))
    said = lambda e: F.filter(F.transform(e["paras"], lambda p: F.struct(p["level"].alias("level"), X.squeezed(p["text"]).alias("text"))), lambda p: p["text"] != "")
    indented = lambda e: F.transform(said(e), lambda p: F.concat(F.repeat(F.lit("  "), F.greatest(p["level"], F.lit(0))), p["text"]))
    closed = lambda lines: F.when(F.size(lines) > 0, F.concat(lines, F.array(F.lit("")))).otherwise(_none())
    body = F.transform(in_shape_order(shapes), lambda s: F.when(s["e"]["kind"] == "table", closed(F.coalesce(table_rows(squeezed_cells(s["e"]["cells"])), _none()))).otherwise(closed(F.coalesce(indented(s["e"]), _none()))))
    notes = F.transform(F.filter(elements, lambda e: e["kind"] == "notes"), lambda e: let(said(e), lambda x: F.when(F.size(x) > 0, F.concat(F.array(F.lit("**Notes**")), F.transform(x, lambda p: p["text"]), F.array(F.lit("")))).otherwise(_none())))
    return _lines(F.concat(F.flatten(body), F.flatten(notes)))


def placed_lines(elements: Column) -> Column:
    """Lines outside of accepted tables and the tables' rows, blank lines around them, from top to bottom and left to right.

    A line belongs to a table if its middle lies in it.
    """

    def ordered(tables: Column) -> Column:
        middle = lambda e, a, b: (e[a] + e[b]) / 2
        inside = lambda e: F.exists(tables, lambda t: middle(e, "x0", "x1").between(t["x0"], t["x1"]) & middle(e, "y0", "y1").between(t["y0"], t["y1"]))
        place = lambda y, x, arrival, text, y0, y1: F.struct(F.round(y, 1).alias("y"), x.alias("x"), arrival.cast("long").alias("arrival"), F.struct(text.alias("text"), y0.alias("y0"), y1.alias("y1")).alias("line"))
        own = F.filter(elements, lambda e: (e["kind"] == "line") & (X.strip(e["text"]) != "") & ~inside(e))
        own = F.transform(own, lambda e, i: place(e["y0"], e["x0"], i, e["text"], e["y0"], e["y1"]))
        blank = lambda t, y, arrival: place(t[y], t["x0"], arrival, F.lit(""), t[y], t[y])

        def rows(t: Column, k: Column) -> Column:
            base = (k.cast("long") + 1) * (1 << 32)
            shown = F.transform(table_rows(squeezed_cells(t["cells"])), lambda r, i: place(t["y0"], t["x0"] + 1e-6 * i, base + 1 + i, r, t["y0"], t["y1"]))
            return F.concat(F.array(blank(t, "y0", base)), shown, F.array(blank(t, "y1", base + (1 << 31))))

        return F.transform(F.array_sort(F.concat(own, F.flatten(F.transform(tables, rows)))), lambda p: p["line"])

    tables = F.filter(elements, lambda e: (e["kind"] == "table") & table_accepted(squeezed_cells(e["cells"])))
    return let(tables, ordered).cast(f"array<{LINE.simpleString()}>")


def image_coverage(elements: Column, width: Column, height: Column) -> Column:
    """The page's area under images, clipped to the page, at most 1; overlaps count twice. A page without area has none."""
    side = lambda a, b, most: F.greatest(F.lit(0.0), F.least(most, b) - F.greatest(F.lit(0.0), a))
    images = F.filter(elements, lambda e: e["kind"] == "image")
    covered = F.aggregate(images, F.lit(0.0), lambda a, e: a + side(e["x0"], e["x1"], width) * side(e["y0"], e["y1"], height))
    return F.when(width * height > 0, F.least(covered / (width * height), F.lit(1.0))).otherwise(0.0)


def text_layer(counts: Column, least: Column | int = OCR_PAGE_CHARS) -> Column:
    """What a document's pages hold, by their numbers of characters: none, mixed, rich or sparse."""
    empty = F.size(F.filter(counts, lambda n: n < least))
    return F.when(empty == F.size(counts), "none").when(empty > 0, "mixed").when(F.forall(counts, lambda n: n >= RICH_PAGE_CHARS), "rich").otherwise("sparse")


def heavy(ratio: Column) -> Column:
    return ratio > HEAVY_COVERAGE


def raster_scale(width: Column, height: Column, dpi: int = OCR_DPI, side: int = OCR_SIDE) -> Column:
    """The zoom for a page in points: the resolution, or less for large pages."""
    return F.least(F.lit(dpi / 72), side / F.greatest(width, height))


def assembled(document: Column, least: int = OCR_PAGE_CHARS) -> Column:
    """A parsed document (schema.PARSED) as a schema.DOCUMENT: elements become lines by the document's layout (flow, slides or
    placed), and with them coverage, text layer, pages that need OCR, tables and warnings. Without a layout all stays as given.
    """
    layout = document["layout"]
    by_layout = lambda e: F.when(layout == "flow", flowing_lines(e)).when(layout == "slides", slide_lines(e)).otherwise(placed_lines(e))
    n_kind = lambda p, kind: F.size(F.filter(p["elements"], lambda e: e["kind"] == kind))
    some_accepted = lambda p: F.exists(p["elements"], lambda e: (e["kind"] == "table") & table_accepted(squeezed_cells(e["cells"])))
    some_wide = lambda p: F.exists(p["elements"], lambda e: (e["kind"] == "table") & (_width(e["cells"]) >= 2))
    narrow = lambda p: F.exists(p["elements"], lambda e: (e["kind"] == "table") & (_width(e["cells"]) < 2))

    def page(p: Column) -> Column:
        return F.struct(
            p["number"].alias("number"), p["height"].alias("height"), p["source"].alias("source"),
            F.when(layout == "placed", image_coverage(p["elements"], p["width"], p["height"])).otherwise(p["image_ratio"]).alias("image_ratio"),
            F.when(layout.isNull(), p["lines"]).otherwise(by_layout(p["elements"])).alias("lines"),
            (n_kind(p, "picture") > 0).alias("pictures"),
            F.when(layout == "slides", some_wide(p)).otherwise(n_kind(p, "table") > 0).alias("tables"),
            F.when((layout == "placed") & (n_kind(p, "table") > 0) & ~some_accepted(p), F.concat(F.lit("page "), p["number"].cast("string"), F.lit(": tables can't be relied on, kept as text")))
            .when((layout == "flow") & narrow(p), "a table of fewer than two columns is kept as text").alias("note"),
        )

    def counted(p: Column) -> Column:
        chars = X.nonspace(F.array_join(F.transform(p["lines"], lambda line: line["text"]), ""))
        return F.struct(*[p[n].alias(n) for n in ("number", "height", "source", "image_ratio", "lines", "pictures", "tables", "note")], chars.alias("chars"))

    def whole(pages: Column) -> Column:
        given = layout.isNull()
        paged = layout.isin("slides", "placed")
        numbers = lambda test: F.transform(F.filter(pages, test), lambda p: p["number"])
        none = F.array().cast("array<int>")
        # A page that can't be read has no height: there is nothing to recognise either.
        needing = F.when(paged, numbers(lambda p: (p["chars"] < least) & ((layout == "slides") | p["height"].isNotNull()))).otherwise(none)
        image_heavy = F.when(layout == "placed", numbers(lambda p: heavy(p["image_ratio"]))).when(layout == "slides", numbers(lambda p: (p["chars"] < least) & p["pictures"])).otherwise(none)
        notes = F.filter(F.transform(pages, lambda p: p["note"]), lambda t: t.isNotNull())
        fields = {
            "extractor": document["extractor"], "page_label": document["page_label"], "total_pages": document["total_pages"],
            "text_layer": F.when(paged, text_layer(F.transform(pages, lambda p: p["chars"]), least)).otherwise(document["text_layer"]),
            "has_tables": F.when(given, document["has_tables"]).otherwise(F.exists(pages, lambda p: p["tables"])), "partial": document["partial"], "reason": document["reason"], "message": document["message"],
            "pages_needing_ocr": F.when(given, document["pages_needing_ocr"]).otherwise(needing), "image_heavy_pages": F.when(given, document["image_heavy_pages"]).otherwise(image_heavy),
            "warnings": F.concat(F.coalesce(document["warnings"], _none()), notes),
            "pages": F.transform(pages, lambda p: F.struct(*[p[n].alias(n) for n in ("number", "height", "source", "image_ratio", "lines")])),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    return let(F.transform(F.transform(document["pages"], page), counted), whole)
