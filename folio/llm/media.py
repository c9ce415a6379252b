"""Media columns: texts stored losslessly in progressive JPEG files, read back as coefficients and RGB tensors.

The payload's unit is the format's own: each byte, plus 64, is one quantised coefficient (samples of a transform with whole
coefficients would not all come back exactly). 64 bytes are a block, six blocks an MCU of a 4:2:0 image. A payload longer than
SLICE_BYTES is stored as several such files in turn, one below the other in the tensor, so memory is bounded at any length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm import progressive_jpeg as jpeg
from folio.llm.util import bounded_batches, only, text_batches

#: Added to a byte to give a coefficient: none is zero, before or after the first approximation.
OFFSET = 64
#: Payload bytes that are encoded, or media bytes that are decoded, together.
ENCODE_BYTES, DECODE_BYTES = 1 << 20, 3 << 19
#: Payload bytes of one file: whole MCUs.
SLICE_BYTES = 3 << 20


def payload_of(text: bytes) -> bytes:
    """The text filled up with zeros to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def to_files(payloads: list[bytes], columns: int | None = None) -> list[bytes]:
    """A file for each payload of at most SLICE_BYTES, of so many MCUs in a row, or about square."""
    images = []
    for payload in payloads:
        blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(np.int64) + OFFSET
        mcus = -(-len(blocks) // 6)
        across = columns or int(np.ceil(np.sqrt(mcus)))
        rows = -(-mcus // across)
        full = np.full((across * rows * 6, 64), OFFSET, np.int64)
        full[: len(blocks)] = blocks
        images.append((full, across, rows, b"payload %d" % len(payload)))
    return jpeg.encode(images)


def to_media(payloads: list[bytes]) -> list[bytes]:
    """What is stored for each payload: a file, or the files of its slices, each encoded alone."""
    if all(len(x) <= SLICE_BYTES for x in payloads):
        return to_files(payloads)
    columns = int(np.ceil(np.sqrt(SLICE_BYTES // 384)))
    return [to_files([x])[0] if len(x) <= SLICE_BYTES else b"".join(to_files([x[i : i + SLICE_BYTES]], columns)[0] for i in range(0, len(x), SLICE_BYTES)) for x in payloads]


def files_in(media: bytes) -> list[bytes]:
    """The files of what to_media() stored: an end marker is never part of a scan, so the next start marker follows it only there."""
    parts = media.split(b"\xff\xd9\xff\xd8")
    last = len(parts) - 1
    return [(b"\xff\xd8" if i else b"") + x + (b"\xff\xd9" if i < last else b"") for i, x in enumerate(parts)]


def payload_in(image: jpeg.Image, blocks: np.ndarray) -> bytes:
    """The payload of a file that to_files() wrote, from its coefficients."""
    columns, rows = image.mcus
    luma = blocks[image.begin[0] : image.begin[0] + columns * rows * 4].reshape(rows, 2, columns, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    chroma = [blocks[image.begin[p] : image.begin[p] + columns * rows][:, None] for p in (1, 2)]
    every = np.concatenate([luma, *chroma], axis=1).reshape(-1, 64) - OFFSET
    return every.astype(np.uint8).tobytes()[: int(image.comment.split()[1])]


def sums_of(rgb: np.ndarray) -> np.ndarray:
    """Sums and sums of squares of red, green and blue: whole numbers."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    return np.stack([flat.sum(axis=0), (flat * flat).sum(axis=0)])


def feature_of(width: int, height: int, sums: np.ndarray) -> str:
    """Size, and for red, green and blue the sum and the sum of squares: equal for equal tensors."""
    return f"{width}x{height}:" + ";".join(f"{a},{b}" for a, b in zip(*sums.tolist(), strict=True))


@dataclass
class Content:
    """What a stored form holds, gathered file by file."""

    digest: object
    size: int = 0
    tail: bytes = b""
    width: int = 0
    height: int = 0
    sums: np.ndarray | int = 0
    rgb: tuple[bytes, ...] = ()

    def add(self, payload: bytes, rgb: np.ndarray, tensors: bool) -> None:
        self.digest.update(payload)
        self.size += len(payload)
        self.tail, self.width, self.height = payload[-64:], rgb.shape[1], self.height + rgb.shape[0]
        self.sums = self.sums + sums_of(rgb)
        if tensors:
            self.rgb += (rgb.tobytes(),)


def contents(media: list[bytes], tensors: bool) -> list[Content]:
    """Stored forms of some bytes in all are decoded together; a long one alone, file by file."""
    split = [files_in(x) for x in media]
    out = [Content(hashlib.sha256()) for _ in media]
    groups = [[(0, f)] for f in split[0]] if len(media) == 1 else [[(i, f) for i, own in enumerate(split) for f in own]]
    for group in groups:
        images = [jpeg.parse(f) for _, f in group]
        blocks = jpeg.coefficients(images)
        pixels = jpeg.samples(images, blocks)
        for (i, _), image in zip(group, images, strict=True):
            out[i].add(payload_in(image, blocks), jpeg.tensor(image, pixels), tensors)
    return out


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a progressive JPEG file) of every document (doc_id, text).

    Null or empty text is stored as 64 zeros; very long texts as several files in turn. Every row gives one row, repeated ones too;
    equal texts are stored alike; an empty table gives none; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(it, most=ENCODE_BYTES):
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(to_media([payload_of(x) for x in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return only(docs, "doc_id", "text").mapInArrow(put, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame, tensors: bool = True) -> DataFrame:
    """What the stored files (doc_id, n_bytes, media) hold: payload digests, features and, with tensors, width, height and rgb."""

    def get(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, files in text_batches(it, "media", DECODE_BYTES):
            found = contents(files, tensors)
            columns = [
                part.column("doc_id"), part.column("n_bytes"), pa.array([x.size for x in found], pa.int64()), pa.array([x.digest.hexdigest() for x in found]),
                pa.array([zlib.crc32(x.tail) for x in found], pa.int64()), pa.array(map(len, files), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in files]), pa.array([feature_of(x.width, x.height, x.sums) for x in found]),
            ]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if tensors:
                columns += [pa.array([x.width for x in found], pa.int32()), pa.array([x.height for x in found], pa.int32()), pa.array([b"".join(x.rgb) for x in found], pa.binary())]
                names += ["width", "height", "rgb"]
            yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return only(media, "doc_id", "n_bytes", "media").mapInArrow(get, schema + ", width int, height int, rgb binary" * tensors)


def op1_media(spark, sf_dir: str) -> DataFrame:
    return read_back(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")))
