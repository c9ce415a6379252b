import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import media
from folio.llm import progressive_jpeg as jpeg

from .conftest import odd_rows


class Bits:
    """One symbol at a time: a plain progressive writer that the lockstep reader is held against."""

    def __init__(self, restart):
        self.out, self.held, self.n, self.restart, self.units = b"", 0, 0, restart, 0

    def put(self, value, n):
        for i in range(n - 1, -1, -1):
            self.held, self.n = self.held << 1 | value >> i & 1, self.n + 1
            if self.n == 8:
                self.out += bytes([self.held]) + (b"\0" if self.held == 255 else b"")
                self.held = self.n = 0

    def pad(self):
        while self.n:
            self.put(1, 1)


def write(parts, sampling, width, height, script, restart=0, quantiser=1):
    """parts: coefficients (rows, columns, 64) of each part, filled up to MCUs."""
    codes = {ac: jpeg.canonical({s: 8 if s < 192 else 9 for s in range(256)} if ac else jpeg.code_lengths(False)) for ac in (False, True)}
    table = {ac: bytes(sum(n == k for _, n in c.values()) for k in range(1, 17)) + bytes(sorted(c, key=lambda s: (c[s][1], s))) for ac, c in codes.items()}
    marker = lambda code, body: bytes([255, code]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts), *(b for i, (h, v) in enumerate(sampling) for b in (i + 1, h << 4 | v, 0))])
    out = b"\xff\xd8" + marker(0xDB, bytes([0]) + bytes([quantiser]) * 64) + marker(0xC2, frame) + marker(0xC4, b"\x00" + table[False] + b"\x10" + table[True])
    out += marker(0xDD, restart.to_bytes(2, "big")) if restart else b""
    mh, mv = max(h for h, _ in sampling), max(v for _, v in sampling)
    shift = lambda x, n: int(np.sign(x)) * (abs(int(x)) >> n)
    for own, ss, se, ah, al in script:
        w = Bits(restart)
        last, run, pending = [0] * len(parts), 0, []

        def flush():
            nonlocal run, pending
            if run:
                n = run.bit_length() - 1
                w.put(*codes[True][n << 4])
                w.put(run - (1 << n), n)
            for b in pending:
                w.put(b, 1)
            run, pending = 0, []

        def block(p, c):
            nonlocal run, pending
            if ss == 0:
                if ah:
                    w.put(int(c[0]) >> al & 1, 1)
                    return
                change, last[p] = (int(c[0]) >> al) - last[p], int(c[0]) >> al
                size = abs(change).bit_length()
                w.put(*codes[False][size])
                w.put(change if change >= 0 else change + (1 << size) - 1, size)
                return
            zeros, corrections = 0, []
            left = [k for k in range(ss, se + 1) if (shift(c[k], al) if not ah else shift(c[k], al) and not shift(c[k], al + 1))]
            end = left[-1] if left else -1
            for k in range(ss, se + 1):
                value = shift(c[k], al)
                if ah and shift(c[k], al + 1):
                    corrections.append(abs(value) & 1)
                    continue
                if not value:
                    zeros += 1
                    if zeros == 16 and k < end:
                        flush()
                        w.put(*codes[True][0xF0])
                        for b in corrections:
                            w.put(b, 1)
                        zeros, corrections = 0, []
                    continue
                flush()
                size = 1 if ah else abs(value).bit_length()
                w.put(*codes[True][zeros << 4 | size])
                w.put(int(value > 0) if ah else value if value > 0 else value + (1 << size) - 1, size)
                for b in corrections:
                    w.put(b, 1)
                zeros, corrections = 0, []
            if zeros or corrections:
                run, pending = run + 1, pending + corrections
                if run == 0x7FFF:
                    flush()

        def unit(blocks):
            nonlocal last
            if restart and w.units and w.units % restart == 0:
                flush()
                w.pad()
                w.out += bytes([255, 0xD0 + (w.units // restart - 1) % 8])
                last = [0] * len(parts)
            for p, c in blocks:
                block(p, c)
            w.units += 1

        if len(own) > 1:
            for y in range(-(-height // (8 * mv))):
                for x in range(-(-width // (8 * mh))):
                    unit([(p, parts[p][y * sampling[p][1] + dy, x * sampling[p][0] + dx]) for p in own for dy in range(sampling[p][1]) for dx in range(sampling[p][0])])
        else:
            h, v = sampling[own[0]]
            for y in range(-(-(-(-height * v // mv)) // 8)):
                for x in range(-(-(-(-width * h // mh)) // 8)):
                    unit([(own[0], parts[own[0]][y, x])])
        flush()
        w.pad()
        out += marker(0xDA, bytes([len(own), *(b for p in own for b in (p + 1, 0)), ss, se, ah << 4 | al])) + w.out
    return out + b"\xff\xd9"


SCRIPTS = [
    [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0)],
    [((0,), 0, 0, 0, 0), ((1, 2), 0, 0, 0, 0), ((0,), 1, 63, 0, 0), ((1,), 1, 20, 0, 3), ((1,), 1, 20, 3, 2), ((2,), 1, 63, 0, 0), ((1,), 1, 20, 2, 1), ((1,), 1, 20, 1, 0), ((1,), 21, 63, 0, 0)],
]


@pytest.mark.parametrize("script", SCRIPTS)
@pytest.mark.parametrize("sampling", [[(2, 2), (1, 1), (1, 1)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 3])
def test_reader_against_a_plain_writer(script, sampling, restart):
    rng = np.random.default_rng(5)
    width, height = 75, 43
    mh, mv = max(h for h, _ in sampling), max(v for _, v in sampling)
    parts = []
    for h, v in sampling:
        shape = (-(-height // (8 * mv)) * v, -(-width // (8 * mh)) * h, 64)
        c = np.where(rng.random(shape) < rng.choice([0.02, 0.3, 0.9], shape[:2])[:, :, None], rng.integers(-40, 41, shape), 0)
        parts.append(c * (rng.random(shape[:2]) < 0.7)[:, :, None])
    file = write(parts, sampling, width, height, script, restart)
    other = write([p // 2 for p in parts], sampling, width, height, script, restart)
    images = [jpeg.parse(x) for x in (file, other, file)]
    blocks = jpeg.coefficients(images)
    for image, scale in zip(images, (1, 2, 1), strict=True):
        for p, (h, v) in enumerate(sampling):
            columns, rows = image.stored(p)
            got = blocks[image.begin[p] : image.begin[p] + columns * rows].reshape(rows, columns, 64)
            seen_c, seen_r = -(-(-(-width * h // mh)) // 8), -(-(-(-height * v // mv)) // 8)
            want = parts[p] if scale == 1 else parts[p] // 2
            # Scans of one part leave out blocks beyond the picture.
            assert np.array_equal(got[:seen_r, :seen_c], want[:seen_r, :seen_c])
    rgb = jpeg.tensor(images[0], jpeg.samples(images, blocks))
    assert rgb.shape == (height, width, 3)


def test_inverse_transform_and_colour():
    flat = np.zeros((1, 1, 64), int)
    flat[0, 0, 0] = 80  # a mean of 10 above the middle
    grey = jpeg.parse(write([flat], [(1, 1)], 8, 8, [((0,), 0, 0, 0, 0)], quantiser=2))
    rgb = jpeg.tensor(grey, jpeg.samples([grey], jpeg.coefficients([grey])))
    assert rgb.shape == (8, 8, 3) and (rgb == 148).all()
    basis = jpeg.inverse_basis()
    assert np.allclose(basis @ basis.T, np.eye(64))
    u, v = 3, 1
    place = int(np.flatnonzero(jpeg.zigzag() == v * 8 + u)[0])
    want = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) / 4 for x in range(8)] for y in range(8)])
    assert np.allclose(basis[place].reshape(8, 8), want)
    red = [np.zeros((1, 1, 64), int) for _ in range(3)]
    red[2][0, 0, 0] = 8 * 100
    image = jpeg.parse(write(red, [(1, 1)] * 3, 8, 8, [((0, 1, 2), 0, 0, 0, 0)]))
    rgb = jpeg.tensor(image, jpeg.samples([image], jpeg.coefficients([image])))
    assert rgb[0, 0].tolist() == [255, 128 - 71, 128]


def test_other_files_are_refused():
    for bad in (b"", b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00", b"GIF89a"):
        with pytest.raises(ValueError):
            jpeg.parse(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=4))
def test_payloads_come_back(texts):
    payloads = [media.payload_of(t) for t in texts]
    images = [jpeg.parse(f) for f in media.to_files(payloads)]
    blocks = jpeg.coefficients(images)
    assert [media.payload_in(i, blocks) for i in images] == payloads


def test_operator(spark, odd, empty):
    got = media.read_back(media.stored(odd)).collect()
    texts = sorted((t or "").encode() for _, t, *_ in odd_rows())
    by_digest = {hashlib.sha256(media.payload_of(t)).hexdigest(): t for t in texts}
    assert sorted(by_digest[r["payload_sha256"]] for r in got) == texts
    for r in got:
        p = media.payload_of(by_digest[r["payload_sha256"]])
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(by_digest[r["payload_sha256"]]), len(p), zlib.crc32(p[-64:]))
        rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
        assert media.feature_of(rgb.shape[1], rgb.shape[0], media.sums_of(rgb)) == r["feature"]
    equal = {}
    for r in got:  # equal texts, equal values
        assert equal.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert media.read_back(media.stored(empty)).count() == 0


def test_long_payloads_are_sliced(monkeypatch):
    """A long payload is several files, each read back alone; together they give the payload and one tensor."""
    whole = [random.Random(1).randbytes(n) for n in (64 * 1000, 64 * 7, 64 * 24 * 41)]
    monkeypatch.setattr(media, "SLICE_BYTES", 64 * 6 * 40)
    stored = media.to_media(whole)
    assert [len(media.files_in(x)) for x in stored] == [5, 1, 5]
    for payload, form in zip(whole, stored, strict=True):
        (found,) = media.contents([form], True)
        assert (found.size, found.digest.hexdigest(), found.tail) == (len(payload), hashlib.sha256(payload).hexdigest(), payload[-64:])
        rgb = np.frombuffer(b"".join(found.rgb), np.uint8).reshape(found.height, found.width, 3)
        assert (media.sums_of(rgb) == found.sums).all()
    together = media.contents(stored, False)
    assert [x.digest.hexdigest() for x in together] == [hashlib.sha256(x).hexdigest() for x in whole]
