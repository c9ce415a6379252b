"""Reading files on executors: heads, archive kinds, existence, digests."""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.paths import has_artifact_name, is_generated
from folio.schema import HEAD_BYTES, PROBE_BYTES
from folio.sources import images


def head_of(path: str, n: int = HEAD_BYTES) -> bytes:
    try:
        with open(path, "rb") as file:
            return file.read(n)
    except OSError:
        return b""


def archive_kind(source: str | BinaryIO) -> str:
    """What a zip archive's entries say."""
    try:
        with zipfile.ZipFile(source) as archive:
            names = archive.namelist()
    except (zipfile.BadZipFile, OSError):
        return "unknown"
    return next((kind for prefix, kind in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "unsupported")) if any(n.startswith(prefix) for n in names)), "unknown")


def content_hash(path: str) -> str | None:
    """BLAKE2b-256 of a file, read in pieces; null if it can't be read."""
    found = hashlib.blake2b(digest_size=32)
    try:
        with open(path, "rb") as file:
            while piece := file.read(1 << 20):
                found.update(piece)
    except OSError:
        return None
    return "blake2b256:" + found.hexdigest()


def _added(frame: DataFrame, path: str, **columns: tuple) -> DataFrame:
    """Adds columns name=(type, Arrow type, function of a path)."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            values = batch.column(path).to_pylist()
            for name, (_, kind, f) in columns.items():
                batch = batch.append_column(name, pa.array([f(x) for x in values], kind))
            yield batch

    return frame.mapInArrow(add, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in frame.schema)}, " + ", ".join(f"{n} {t}" for n, (t, _, _) in columns.items()))


def _sniffed(path: str, probed: bool) -> tuple[bytes, str | None, int | None, str | None]:
    """A file's first bytes, what a zip archive holds, an image's pixels and, if asked for, the beginning of its text."""
    head = head_of(path, PROBE_BYTES if probed else HEAD_BYTES)
    first = head[:HEAD_BYTES]
    kind = archive_kind(path) if first[:4] == b"PK\x03\x04" else None
    return first, kind, images.pixels_of(path, first), head.decode("utf-8", "ignore") if probed else None


def with_heads(files: DataFrame) -> DataFrame:
    """Adds head, container (of zip archives), file_pixels (of images whose head doesn't tell) and generated, in one pass."""
    names = ("head", "container", "file_pixels", "text_head")
    kinds = (pa.binary(), pa.string(), pa.int64(), pa.string())

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [_sniffed(path, probed) for path, probed in zip(batch.column("path").to_pylist(), batch.column("probed").to_pylist(), strict=True)]
            for k, (name, kind) in enumerate(zip(names, kinds, strict=True)):
                batch = batch.append_column(name, pa.array([x[k] for x in found], kind))
            yield batch

    marked = files.withColumn("probed", has_artifact_name(F.col("rel")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema) + ", head binary, container string, file_pixels long, text_head string"
    found = marked.mapInArrow(add, schema)
    return found.withColumn("generated", F.coalesce(is_generated(F.col("rel"), F.col("text_head")), F.lit(False))).drop("probed", "text_head")


def with_hashes(files: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds content_hash, null where `wanted` doesn't hold: such files aren't opened."""
    path = F.col("path") if wanted is None else F.when(wanted, F.col("path"))
    marked = files.withColumn("hash_path", path)
    return _added(marked, "hash_path", content_hash=("string", pa.string(), lambda x: content_hash(x) if x is not None else None)).drop("hash_path")


def there(paths: DataFrame, column: str = "target") -> DataFrame:
    """(column, generated) of the paths that are files."""
    text = lambda path: head_of(path, PROBE_BYTES).decode("utf-8", "ignore") if os.path.isfile(path) else None
    found = _added(paths.select(column).where(F.col(column).isNotNull()).distinct(), column, text_head=("string", pa.string(), text))
    return found.where(F.col("text_head").isNotNull()).select(column, is_generated(F.col(column), F.col("text_head")).alias("generated"))
