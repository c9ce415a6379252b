"""Sizes of images from their headers, for formats whose size doesn't stand in the first bytes: JPEG, WebP and TIFF."""

from __future__ import annotations

import struct
from typing import BinaryIO


def jpeg_size(file: BinaryIO) -> tuple[int, int] | None:
    """Width and height of the frame header, found by going from marker to marker."""
    file.seek(2)
    while True:
        lead = file.read(2)
        if len(lead) < 2 or lead[0] != 0xFF:
            return None
        code = lead[1]
        if code == 0xFF:  # fill byte
            file.seek(-1, 1)
            continue
        if code == 0x01 or 0xD0 <= code <= 0xD8:
            continue
        if code in (0xD9, 0xDA):
            return None
        body = file.read(2)
        if len(body) < 2:
            return None
        length = struct.unpack(">H", body)[0]
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            frame = file.read(5)
            return struct.unpack(">xHH", frame)[::-1] if len(frame) == 5 else None
        file.seek(length - 2, 1)


def webp_size(head: bytes) -> tuple[int, int] | None:
    """Of the first chunk: extended, lossless or lossy."""
    chunk = head[12:16]
    if chunk == b"VP8X" and len(head) >= 30:
        return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
    if chunk == b"VP8L" and len(head) >= 25:
        bits = int.from_bytes(head[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if chunk == b"VP8 " and len(head) >= 30:
        width, height = struct.unpack("<HH", head[26:30])
        return width & 0x3FFF, height & 0x3FFF
    return None


def tiff_size(file: BinaryIO) -> tuple[int, int] | None:
    """Tags 256 and 257 of the first directory."""
    file.seek(0)
    head = file.read(8)
    order = "<" if head[:2] == b"II" else ">"
    file.seek(struct.unpack(order + "I", head[4:8])[0])
    found = {}
    for _ in range(struct.unpack(order + "H", file.read(2))[0]):
        entry = file.read(12)
        tag, kind = struct.unpack(order + "HH", entry[:4])
        if tag in (256, 257):
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return (found[256], found[257]) if len(found) == 2 else None


def pixels_of(path: str, head: bytes) -> int | None:
    """Width times height of a JPEG, WebP or TIFF file; null for other files and broken headers."""
    if not (head[:3] == b"\xff\xd8\xff" or head[:4] in (b"II*\0", b"MM\0*") or (head[:4] == b"RIFF" and head[8:12] == b"WEBP")):
        return None
    try:
        if head[:4] == b"RIFF":
            size = webp_size(head)
        else:
            with open(path, "rb") as file:
                size = jpeg_size(file) if head[:2] == b"\xff\xd8" else tiff_size(file)
    except (OSError, struct.error):
        return None
    return size[0] * size[1] if size else None
