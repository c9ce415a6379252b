"""OCR as joins: which pages, what the cache holds, what replaces a page's lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import nonspace, strip
from folio.schema import OCR_PAGE_CHARS, OCR_PAGES, OCR_SIDE

_BACKENDS: dict[str, object] = {}
BLOCKS = "array<struct<text:string,confidence:double,y0:double,y1:double>>"


class OcrBackend(Protocol):
    """name, and recognize(image bytes) -> list of (text, confidence, y0, y1), places from the top in 0 to 1 or None."""

    name: str

    def recognize(self, image: bytes) -> list[tuple]: ...


def register_backend(backend: OcrBackend) -> None:
    _BACKENDS[backend.name] = backend


def get_backend(name: str | None = None) -> OcrBackend | None:
    return _BACKENDS.get(name) if name else next(iter(_BACKENDS.values()), None)


def needing_ocr(pages: DataFrame, least: int = OCR_PAGE_CHARS) -> DataFrame:
    """Pages (doc, page_no, text) with hardly any text."""
    return pages.where(nonspace(F.col("text")) < least)


def cache_digest(config_digest: str, backend: str, dpi: int, side: int = OCR_SIDE) -> str:
    """What results of OCR depend on beside the page: a short hash of settings, backend and resolution."""
    return hashlib.blake2b("\0".join((config_digest, backend, f"dpi={dpi}", f"side={side}")).encode(), digest_size=12).hexdigest()


def place_of(y0: Column) -> Column:
    """Where a block stands for its order: unplaced ones last."""
    return F.coalesce(y0, F.lit(1.0))


def in_order(blocks: Column) -> Column:
    """Blocks by place from the top, else as they came."""
    keyed = F.transform(blocks, lambda b, i: F.struct(place_of(b["y0"]).alias("y"), i.alias("i"), b.alias("block")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(F.struct(a["y"], a["i"]) < F.struct(b["y"], b["i"]), -1).otherwise(1)), lambda x: x["block"])


def capped(pages: DataFrame, most: int = OCR_PAGES, doc: str = "doc", page: str = "page_no") -> DataFrame:
    """The first `most` pages of each document; partial where there are more."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy(page))
    over = F.count(F.lit(1)).over(Window.partitionBy(doc)) > most
    return pages.withColumn("place", place).withColumn("partial", over).where(F.col("place") <= most).drop("place")


def from_cache(work: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with blocks, misses) of work (content_hash, page_no, digest) against a cache with those keys and blocks."""
    keys = ["content_hash", "page_no", "digest"]
    return work.join(cache.select(*keys, "blocks"), keys), work.join(cache.select(*keys), keys, "left_anti")


def recognized(misses: DataFrame, backend: OcrBackend) -> DataFrame:
    """Blocks of missing pages (content_hash, page_no, digest, images): all of a page's images, by place from the top."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [[dict(zip(("text", "confidence", "y0", "y1"), b, strict=True)) for image in images for b in backend.recognize(image)] for images in batch.column("images").to_pylist()]
            kind = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("y0", pa.float64()), ("y1", pa.float64())]))
            yield pa.record_batch([*(batch.column(c) for c in ("content_hash", "page_no", "digest")), pa.array(found, kind)], names=["content_hash", "page_no", "digest", "blocks"])

    found = misses.select("content_hash", "page_no", "digest", "images").mapInArrow(read, f"content_hash string, page_no int, digest string, blocks {BLOCKS}")
    return found.withColumn("blocks", in_order(F.col("blocks")))


def replaced(pages: DataFrame, blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """pages (doc, page_no, height, source, lines, ...) with the lines of pages in blocks (doc, page_no, blocks) replaced by those
    blocks that have text; places are then shares of a height of 1."""
    said = F.transform(F.filter("blocks", lambda b: strip(b["text"]) != ""), lambda b: F.struct(b["text"].alias("text"), b["y0"].alias("y0"), b["y1"].alias("y1")))
    joined = pages.join(blocks.select(doc, "page_no", "blocks"), [doc, "page_no"], "left")
    read = F.col("blocks").isNotNull()
    return joined.withColumns({"height": F.when(read, F.lit(1.0)).otherwise(F.col("height")), "source": F.when(read, "ocr").otherwise(F.col("source")), "lines": F.when(read, said).otherwise(F.col("lines"))}).drop("blocks")


def summary(blocks: DataFrame) -> DataFrame:
    """(doc, pages, chars): the pages that were read, in order, and their characters."""
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"]))
    return blocks.groupBy("doc").agg(F.sort_array(F.collect_set("page_no")).alias("pages"), F.sum(chars).alias("chars"))
