"""Constants, value domains and table schemas of the document engine."""

from __future__ import annotations

from pyspark.sql import types as T

PIPELINE_VERSION, SCHEMA_VERSION = "0.1.0", 1

# Limits and thresholds.
TRIVIAL_IMAGE_BYTES, TRIVIAL_IMAGE_PIXELS = 20_480, 40_000
SHARD_FILES = 500
LOW_MEDIAN, LOW_CHARS, EMPTY_CHARS = 100, 200, 50
GARBLED_REPLACEMENT, GARBLED_PRIVATE, GARBLED_TOKEN, GARBLED_LATIN = 0.01, 0.05, 1.5, 20
HEAD_PAGES, HEAD_BAND, HEAD_CHARS = 3, 0.08, 120
SHORT_LINE = 0.6
OCR_PAGE_CHARS, OCR_DPI, OCR_PAGES, OCR_SIDE = 30, 200, 500, 4000
RICH_PAGE_CHARS, HEAVY_COVERAGE = 200, 0.6
MATH_MANY, MATH_SOME, MATH_DENSITY = 8, 3, 0.004
MAX_BYTES = 512 * 1024 * 1024
HEAD_BYTES, PROBE_BYTES = 64, 4096

# Domains, in the order in which summaries list them.
STATUSES = ("ok", "low", "empty", "garbled", "failed", "skipped", "registered", "unchanged")
PROBLEMS = ("low", "empty", "garbled", "failed", "skipped")
KINDS = ("pdf", "pptx", "docx", "image", "plaintext", "unsupported", "unknown")
ACTIONS = ("extract", "register", "unchanged", "skip", "collision")
MODES = ("mirror", "in-place")
OCR_MODES = ("auto", "never", "only")
IGNORED_DIRS = ("node_modules", "__pycache__", ".venv", ".git", "venv")

# What an extension says about a file.
EXTENSIONS = {
    ".pdf": "pdf", ".pptx": "pptx", ".docx": "docx",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image", ".tif": "image", ".tiff": "image", ".heic": "image", ".heif": "image",
    ".md": "plaintext", ".markdown": "plaintext", ".txt": "plaintext", ".csv": "plaintext",
    ".xlsx": "unsupported", ".xls": "unsupported", ".html": "unsupported", ".htm": "unsupported", ".doc": "unsupported", ".ppt": "unsupported",
}

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FILES = _struct(rel=_S, path=_S, bytes=_L, mtime_ns=_L)
LINE = _struct(text=_S, y0=_D, y1=_D)
#: What an extractor finds on a page, before any rule: a paragraph (para), table, shape (text), picture, notes, placed line or image.
ELEMENT = _struct(
    kind=_S, text=_S, style=_S, paras=T.ArrayType(_struct(level=_I, text=_S)), cells=T.ArrayType(T.ArrayType(_S)), x0=_D, y0=_D, x1=_D, y1=_D,
)
PARSED_PAGE = _struct(number=_I, width=_D, height=_D, source=_S, image_ratio=_D, lines=T.ArrayType(LINE), elements=T.ArrayType(ELEMENT))
PAGE = _struct(number=_I, height=_D, source=_S, image_ratio=_D, lines=T.ArrayType(LINE))
DOCUMENT = _struct(
    extractor=_S, page_label=_S, total_pages=_I, text_layer=_S, has_tables=_B, partial=_B, reason=_S, message=_S,
    pages_needing_ocr=T.ArrayType(_I), image_heavy_pages=T.ArrayType(_I), warnings=T.ArrayType(_S), pages=T.ArrayType(PAGE),
)
#: A parsed document: layout is flow, slides or placed, or null where the extractor gives lines and all else itself.
PARSED = T.StructType([T.StructField("layout", _S), *(f for f in DOCUMENT if f.name != "pages"), T.StructField("pages", T.ArrayType(PARSED_PAGE))])
BLOCK = _struct(text=_S, confidence=_D, y0=_D, y1=_D)
OCR = _struct(backend=_S, pages=T.ArrayType(_I), chars=_L)
RECORD = _struct(
    rel=_S, kind=_S, status=_S, bytes=_L, mtime_ns=_L, content_hash=_S, text_rel=_S, extractor=_S, skip_reason=_S, error=_S,
    pages=_L, chars=_L, chars_per_page_median=_L, text_layer=_S, quality=_S, has_math=_B, has_tables=_B, partial=_B, ocr=OCR,
    removed_running_heads=T.ArrayType(_S), warnings=T.ArrayType(_S), duration_ms=_L, pipeline_version=_S, config_digest=_S,
)
