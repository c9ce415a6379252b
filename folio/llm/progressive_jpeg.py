"""Progressive JPEG in numpy: scans of many images at a time.

Decoding accumulates every scan (spectral selection and successive approximation, DC and AC, first and refining) in coefficient
arrays. Huffman codes are sequential, but restart intervals are not: all restart intervals of a scan, over all images of a
batch, advance in lockstep, one symbol each at every step. The inverse transform is one matrix product over all blocks;
chroma is upsampled by repetition and converted to RGB in integers, so that equal files give equal tensors in any batch.

Encoding is for coefficients at hand: first scans of any kind, refining AC scans where every coefficient of the band is
nonzero before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np

#: (index of scanned components, Ss, Se, Ah, Al) in order: the default script of the encoder.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0)]
#: Blocks (or MCUs) between restart markers that the encoder writes.
RESTART = 16
_AFTER_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


@cache
def zigzag() -> np.ndarray:
    """Natural place (row * 8 + column) of each zigzag place."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else -x[0]))
    return np.array([r * 8 + c for r, c in cells])


@cache
def inverse_basis() -> np.ndarray:
    """Row i: the 64 samples of a unit coefficient at zigzag place i."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()]


# Huffman tables


def code_lengths(ac: bool) -> dict[int, int]:
    """The encoder's code lengths by rule: DC sizes 4 bits each; of AC symbols those without a zero run are short."""
    if not ac:
        return {s: 4 for s in range(12)}
    return {s: 3 if 5 <= s <= 9 else 5 if s in (0, 1, 2, 3, 4, 10) else 11 for s in range(256) if s & 15 <= 10}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), codes ascending by length and symbol."""
    out, code, before = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - before
        out[symbol] = (code, n)
        code, before = code + 1, n
    return out


@cache
def encoder_tables(ac: bool) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and lengths by symbol and the table's DHT body without its class byte."""
    codes = canonical(code_lengths(ac))
    value, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        value[s], length[s] = c, n
    order = sorted(codes, key=lambda s: (codes[s][1], s))
    return value, length, bytes(sum(n == k for _, n in codes.values()) for k in range(1, 17)) + bytes(order)


@cache
def lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, np.uint16), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


# Writing


def _packed(values: np.ndarray, lengths: np.ndarray, segment: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments' bits, each segment filled up to a byte with ones, and the segments' byte counts."""
    ends = np.cumsum(lengths)
    bits = np.bincount(segment, lengths, n_segments).astype(np.int64)
    counts = (bits + 7) // 8
    first = np.cumsum(counts) - counts
    at = ends - lengths - (np.cumsum(bits) - bits)[segment] + first[segment] * 8
    word = at >> 5
    placed = values << (64 - lengths - (at & 31)).astype(np.uint64)
    begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sums, words = np.add.reduceat(placed, begins), word[begins]
    out = np.zeros(int(counts.sum()) // 4 + 3, np.uint64)
    out[words] += sums >> np.uint64(32)
    out[words + 1] += sums & np.uint64(0xFFFFFFFF)
    data = out.astype(">u4").view(np.uint8)[: int(counts.sum())]
    data[first + counts - 1] |= ((1 << (counts * 8 - bits)) - 1).astype(np.uint8)
    return data, counts


def _stuffed(data: np.ndarray, counts: np.ndarray, per_image: np.ndarray) -> list[bytes]:
    """Each image's entropy-coded bytes: 00 after FF, restart markers between segments."""
    full = data == 255
    ends = np.cumsum(counts)
    last = np.cumsum(per_image) - 1
    marked = np.ones(len(counts), bool)
    marked[last] = False
    extra = full.astype(np.int64)
    extra[ends[marked] - 1] += 2
    place = np.arange(len(data)) + np.cumsum(extra) - extra
    out = np.zeros(len(data) + int(extra.sum()), np.uint8)
    out[place] = data
    number = np.arange(len(counts)) - np.repeat(last + 1 - per_image, per_image)
    at = place[ends[marked] - 1] + full[ends[marked] - 1] + 1
    out[at], out[at + 1] = 255, 0xD0 + number[marked] % 8
    image_ends = (place[ends - 1] + full[ends - 1] + 1)[last]
    packed = out.tobytes()
    return [packed[i:j] for i, j in zip([0, *image_ends[:-1].tolist()], image_ends.tolist(), strict=True)]


def _sizes(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))) + 1, 0).astype(np.int64)


def _extra(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.where(values < 0, values + (1 << sizes) - 1, values).astype(np.uint64)


def _ac_first(band: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths and block of every item of a first AC scan."""
    codes, lengths, _ = encoder_tables(True)
    shifted = np.sign(band) * (np.abs(band) >> al)
    row, column = np.nonzero(shifted)
    value = shifted[row, column]
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.empty(0, bool)
    run = column - np.where(new, -1, np.concatenate([[-1], column[:-1]])) - 1 if len(row) else column
    size = _sizes(np.abs(value))
    symbol = (run & 15) << 4 | size
    items = codes[symbol] << size.astype(np.uint64) | _extra(value, size), lengths[symbol] + size, row
    last = np.full(len(band), -1)
    last[row] = column
    ended = np.flatnonzero(last < band.shape[1] - 1)
    skips = run >> 4
    if not len(ended) and not skips.any():
        return items
    width = (band.shape[1] + 1) * 8
    jumps = np.repeat(np.arange(len(row)), skips)
    parts = [(*items, row * width + column * 8 + 4), (np.full(len(jumps), codes[0xF0]), np.full(len(jumps), lengths[0xF0]), row[jumps], row[jumps] * width + column[jumps] * 8), (np.full(len(ended), codes[0]), np.full(len(ended), lengths[0]), ended, ended * width + width - 1)]
    value, length, block, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    return value[order], length[order], block[order]


def _marker(code: int, body: bytes) -> bytes:
    return bytes([255, code]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(images: list[tuple[np.ndarray, int, int, bytes]], script: list = SCRIPT, restart: int = RESTART) -> list[bytes]:
    """Files of 4:2:0 images (coefficients, MCU columns, MCU rows, comment).

    Coefficients are (MCUs * 6, 64), zigzag, quantised by 1: an MCU's four luma blocks in rows, Cb, Cr; MCUs in rows.
    """
    mcus = np.array([c * r for _, c, r, _ in images])
    every = np.concatenate([x[0] for x in images]).astype(np.int64).reshape(-1, 6, 64)
    image_of = np.repeat(np.arange(len(images)), mcus)
    within = np.arange(len(every)) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    # Scans of luma alone go by rows of blocks, not by MCUs.
    columns = np.array([c for _, c, _, _ in images])[image_of]
    y, x = within // columns, within % columns
    luma_key = np.stack([(2 * y + r) * 2 * columns + 2 * x + c for r in (0, 1) for c in (0, 1)], axis=1) + (4 * (np.cumsum(mcus) - mcus))[image_of][:, None]
    luma = np.empty((len(every) * 4, 64), np.int64)
    luma[luma_key.ravel()] = every[:, :4].reshape(-1, 64)
    planes = {0: luma, 1: every[:, 4], 2: every[:, 5]}
    dc_codes, dc_lengths, dc_table = encoder_tables(False)
    ac_codes, ac_lengths, ac_table = encoder_tables(True)
    outs = []
    for _, c, r, comment in images:
        frame = bytes([8]) + (16 * r).to_bytes(2, "big") + (16 * c).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        outs.append([b"\xff\xd8", _marker(0xFE, comment), _marker(0xDB, bytes([0]) + bytes([1]) * 64), _marker(0xC2, frame), _marker(0xC4, b"\x00" + dc_table + b"\x10" + ac_table), _marker(0xDD, restart.to_bytes(2, "big"))])
    for parts, ss, se, ah, al in script:
        header = _marker(0xDA, bytes([len(parts), *(b for p in parts for b in (p + 1, 0)), ss, se, ah << 4 | al]))
        units = mcus if len(parts) > 1 or parts[0] else mcus * 4
        per_image = -(-units // restart)
        base = np.cumsum(per_image) - per_image
        unit = np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units)
        segment = np.repeat(base, units) + unit // restart
        total = int(per_image.sum())
        if ss == 0:
            level = every[:, :, 0] >> al
            if ah:
                values, lengths, where = (level & 1).astype(np.uint64).ravel(), np.ones(level.size, np.int64), np.repeat(segment, 6)
            else:
                fresh = unit % restart == 0
                before = np.zeros_like(level)
                before[:, 1:4] = level[:, :3]
                before[1:, [0, 4, 5]] = np.where(fresh[1:, None], 0, level[:-1][:, [3, 4, 5]])
                change = (level - before).ravel()
                size = _sizes(np.abs(change))
                values, lengths, where = dc_codes[size] << size.astype(np.uint64) | _extra(change, size), dc_lengths[size] + size, np.repeat(segment, 6)
        else:
            band = planes[parts[0]][:, ss : se + 1]
            if ah == 0:
                values, lengths, block = _ac_first(band, al)
                where = segment[block]
            else:
                if not (np.abs(band) >> (al + 1)).all():
                    raise ValueError("a refining scan is only written for coefficients that are nonzero before it")
                # One end-of-band run over a whole segment, then a correction bit for every coefficient.
                held = np.bincount(segment, minlength=total)
                n = _sizes(held) - 1
                head = ac_codes[n << 4] << n.astype(np.uint64) | (held - (1 << n)).astype(np.uint64)
                bits = (np.abs(band) >> al & 1).astype(np.uint64)
                width = -(-bits.shape[1] // 21)
                words = np.zeros((len(bits), width), np.uint64)
                sizes = np.zeros(width, np.int64)
                for i in range(bits.shape[1]):
                    words[:, i // 21] = words[:, i // 21] << np.uint64(1) | bits[:, i]
                    sizes[i // 21] += 1
                values = np.insert(words.ravel(), (np.cumsum(held) - held) * width, head)
                lengths = np.insert(np.tile(sizes, len(bits)), (np.cumsum(held) - held) * width, ac_lengths[n << 4] + n)
                where = np.insert(np.repeat(segment, width), (np.cumsum(held) - held) * width, np.arange(total))
        for out, data in zip(outs, _stuffed(*_packed(values, lengths, where, total), per_image), strict=True):
            out += [header, data]
    return [b"".join([*out, b"\xff\xd9"]) for out in outs]


# Reading


@dataclass
class Scan:
    parts: tuple[int, ...]
    tables: tuple[tuple[bytes, bytes], ...]  # DC and AC table of each part
    ss: int
    se: int
    ah: int
    al: int
    restart: int
    data: bytes

    @property
    def kind(self) -> tuple:
        return self.parts, self.tables, self.ss, self.se, self.ah, self.al


@dataclass
class Image:
    width: int = 0
    height: int = 0
    sampling: tuple[tuple[int, int], ...] = ()
    quantisers: tuple[bytes, ...] = ()
    comment: bytes = b""
    scans: list[Scan] = field(default_factory=list)
    begin: tuple[int, ...] = ()  # first block of each part in the batch's coefficients

    @property
    def most(self) -> tuple[int, int]:
        return max(h for h, _ in self.sampling), max(v for _, v in self.sampling)

    @property
    def mcus(self) -> tuple[int, int]:
        """MCU columns and rows."""
        h, v = self.most
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def stored(self, part: int) -> tuple[int, int]:
        """Block columns and rows of a part, filled up to MCUs."""
        (h, v), (c, r) = self.sampling[part], self.mcus
        return c * h, r * v

    def scanned(self, part: int) -> tuple[int, int]:
        """Block columns and rows of a part in a scan of its own."""
        (h, v), (mh, mv) = self.sampling[part], self.most
        return -(-(-(-self.width * h // mh)) // 8), -(-(-(-self.height * v // mv)) // 8)


def parse(file: bytes) -> Image:
    """Markers and scans of a progressive file with 8-bit samples; ValueError for other kinds and for damage."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, tables, quantisers, ids, restart, at = Image(), {}, {}, {}, 0, 2
    while at < len(file):
        if file[at] != 255:
            raise ValueError(f"no marker at {at}")
        code = file[at + 1]
        at += 1 if code == 255 else 2
        if code == 255:
            continue
        if code == 0xD9:
            break
        length = int.from_bytes(file[at : at + 2], "big")
        body, at = file[at + 2 : at + length], at + length
        if code == 0xC2:
            if body[0] != 8:
                raise ValueError("only 8-bit samples")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            own = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
            ids = {x[0]: i for i, x in enumerate(own)}
            image.sampling = tuple((x[1] >> 4, x[1] & 15) for x in own)
            image.quantisers = tuple(quantisers[x[2]] for x in own)
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive Huffman-coded file")
        elif code == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif code == 0xDB:
            while body:
                n = 64 << (body[0] >> 4)
                quantisers[body[0] & 15], body = body[1 : 1 + n], body[1 + n :]
        elif code == 0xDD:
            restart = int.from_bytes(body, "big")
        elif code == 0xFE:
            image.comment = body
        elif code == 0xDA:
            n = body[0]
            parts = [(ids[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
            found = _AFTER_SCAN.search(file, at)
            stop = found.start() if found else len(file)
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            image.scans.append(Scan(tuple(p for p, _ in parts), tuple((tables.get(t >> 4, b""), tables.get(0x10 | t & 15, b"")) for _, t in parts), ss, se, a >> 4, a & 15, restart, file[at:stop]))
            at = stop
    if not image.sampling or not image.scans:
        raise ValueError("no frame or no scan")
    return image


class _Segments:
    """The restart intervals of one scan over all images: their bits, and the blocks they hold in order."""

    def __init__(self, images: list[Image], scans: list[Scan]):
        chunks, counts, blocks, part_of = [], [], [], []
        for image, scan in zip(images, scans, strict=True):
            order, parts = _block_order(tuple(image.sampling), image.width, image.height, scan.parts)
            own = np.asarray(image.begin)[parts] + order if len(scan.parts) > 1 else image.begin[scan.parts[0]] + order
            unit = sum(image.sampling[p][0] * image.sampling[p][1] for p in scan.parts) if len(scan.parts) > 1 else 1
            pieces = _RESTARTS.split(scan.data)
            step = scan.restart * unit or len(own)
            n = -(-len(own) // step)
            pieces = (pieces + [b""] * n)[:n]
            chunks += pieces
            counts += [min(step, len(own) - i * step) for i in range(n)]
            blocks.append(own)
            part_of.append(parts)
        self.counts = np.array(counts)
        self.blocks, self.parts = np.concatenate(blocks), np.concatenate(part_of)
        self.first = np.cumsum(self.counts) - self.counts
        chunks = [x.replace(b"\xff\x00", b"\xff") + bytes(8) for x in chunks]
        lengths = np.array([len(x) for x in chunks])
        self.start = (np.cumsum(lengths) - lengths) * 8
        self.bytes = np.frombuffer(b"".join(chunks) + bytes(16), np.uint8)
        self.limit = len(self.bytes) * 8 - 128

    def windows(self) -> np.ndarray:
        """The eight bytes from each byte on, as one number."""
        wide = self.bytes.astype(np.uint64)
        out = wide[:-7].copy()
        for i in range(1, 8):
            out <<= np.uint64(8)
            out |= wide[i : len(wide) - 7 + i]
        return out


@cache
def _block_order(sampling: tuple, width: int, height: int, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of a scan in order, as places among their part's stored blocks, and their parts."""
    image = Image(width, height, sampling)
    if len(parts) == 1:
        (columns, rows), (stored, _) = image.scanned(parts[0]), image.stored(parts[0])
        order = (np.arange(rows)[:, None] * stored + np.arange(columns)).ravel()
        return order, np.full(len(order), parts[0])
    columns, rows = image.mcus
    y, x = np.divmod(np.arange(columns * rows), columns)
    order, of = [], []
    for p in parts:
        h, v = sampling[p]
        for dy in range(v):
            for dx in range(h):
                order.append((y * v + dy) * columns * h + x * h + dx)
                of.append(np.full(len(y), p))
    return np.stack(order, axis=1).ravel(), np.stack(of, axis=1).ravel()


_ONE = np.uint64(1)


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed values of size-bit magnitudes."""
    bits = bits.astype(np.int64)
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _dc_first(segments: _Segments, scan: Scan, coefficients: np.ndarray) -> None:
    windows, order = segments.windows(), np.argsort(-segments.counts, kind="stable")
    luts = np.stack([lookup(dc) for dc, _ in scan.tables])
    place = {p: i for i, p in enumerate(scan.parts)}
    number = np.array([place.get(i, 0) for i in range(max(scan.parts) + 1)])
    at, first, counts = segments.start[order], segments.first[order], segments.counts[order]
    last = np.zeros((len(order), len(scan.parts)), np.int64)
    rows = np.arange(len(order))
    for k in range(int(counts[0])):
        n = int(np.searchsorted(-counts, -k, side="left"))  # segments with more than k blocks
        own, pos, item = rows[:n], at[:n], first[:n] + k
        which = number[segments.parts[item]]
        v = windows[pos >> 3] << (pos & 7).astype(np.uint64)
        e = luts[which, (v >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        used, size = e >> 8, e & 255
        bits = (v << used.astype(np.uint64)) >> _ONE >> (63 - size).astype(np.uint64)
        last[own, which] += _extended(bits, size)
        coefficients[segments.blocks[item], 0] = last[own, which] << scan.al
        at[:n] = np.minimum(pos + used + size, segments.limit)


def _dc_refine(segments: _Segments, scan: Scan, coefficients: np.ndarray) -> None:
    at = np.repeat(segments.start - segments.first, segments.counts) + np.arange(len(segments.blocks))
    at = np.minimum(at, segments.limit)
    coefficients[segments.blocks, 0] |= (segments.bytes[at >> 3].astype(coefficients.dtype) >> (7 - (at & 7)).astype(coefficients.dtype) & 1) << scan.al


def _ac_first_scan(segments: _Segments, scan: Scan, coefficients: np.ndarray) -> None:
    windows, lut, flat = segments.windows(), lookup(scan.tables[0][1]), coefficients.reshape(-1)
    at, block, stop = segments.start.copy(), segments.first.copy(), segments.first + segments.counts
    k = np.full(len(at), scan.ss)
    base = segments.blocks[block] * 64
    while len(at):
        v = windows[at >> 3] << (at & 7).astype(np.uint64)
        e = lut[v >> np.uint64(48)].astype(np.int64)
        used, run, size = e >> 8, e >> 4 & 15, e & 15
        if e.min() < 256:
            raise ValueError("a code that no table holds")
        plain = size > 0
        skipped = 1
        if plain.all():
            k += run
            if int(k.max()) > 63:
                raise ValueError("a run beyond its block")
            bits = (v << used.astype(np.uint64)) >> _ONE >> (63 - size).astype(np.uint64)
            flat[base + k] = _extended(bits, size) << scan.al
            used += size
            k += 1
            ended = k > scan.se
        else:
            width = np.where(plain, size, np.where(run < 15, run, 0))
            bits = (v << used.astype(np.uint64)) >> _ONE >> (63 - width).astype(np.uint64)
            to = k + run
            if plain.any() and int(to[plain].max()) > 63:
                raise ValueError("a run beyond its block")
            flat[(base + to)[plain]] = _extended(bits, size)[plain] << scan.al
            used += width
            k = to + 1
            over = ~plain & (run < 15)
            skipped = np.where(over, (1 << run) + bits.astype(np.int64), 1)
            ended = over | (k > scan.se)
        at += used
        np.minimum(at, segments.limit, out=at)
        if ended.any():
            block = block + np.where(ended, skipped, 0)
            k[ended] = scan.ss
            alive = block < stop
            if not alive.all():
                at, block, stop, k = at[alive], block[alive], stop[alive], k[alive]
                if not len(at):
                    return
            base = segments.blocks[block] * 64


def _ac_refine(segments: _Segments, scan: Scan, coefficients: np.ndarray) -> None:
    windows, lut = segments.windows(), lookup(scan.tables[0][1])
    at, block, stop = segments.start.copy(), segments.first.copy(), segments.first + segments.counts
    k, run_left = np.full(len(at), scan.ss), np.zeros(len(at), np.int64)
    places = np.arange(64)
    while len(at):
        own = segments.blocks[block]
        v = windows[at >> 3] << (at & 7).astype(np.uint64)
        e = np.where(run_left > 0, 0, lut[v >> np.uint64(48)]).astype(np.int64)
        if ((e < 256) & (run_left == 0)).any():
            raise ValueError("a code that no table holds")
        used, run, size = e >> 8, e >> 4 & 15, e & 15
        opened = (run_left == 0) & (size == 0) & (run < 15)
        width = np.where(size > 0, 1, np.where(opened, run, 0))
        bits = ((v << used.astype(np.uint64)) >> _ONE >> (63 - width).astype(np.uint64)).astype(np.int64)
        at += used + width
        run_left = np.where(opened, (1 << run) + bits, run_left)
        old = coefficients[own]
        span = (places >= k[:, None]) & (places <= scan.se)
        known = (old != 0) & span
        over = run_left > 0
        # The place of the (run + 1)-th coefficient that is still zero; an end-of-band run corrects the rest of its block.
        zeros = np.cumsum(span & ~known, axis=1)
        hit = (zeros == run[:, None] + 1) & span & ~known
        target = np.where(over | ~hit.any(axis=1), scan.se + 1, hit.argmax(axis=1))
        known &= places < target[:, None]
        rank = np.cumsum(known, axis=1)
        row, column = np.nonzero(known)
        where = np.minimum(at[row] + rank[row, column] - 1, segments.limit)
        one = (segments.bytes[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1
        value = old[row, column]
        coefficients[own[row], column] = value + np.sign(value) * (one.astype(value.dtype) << scan.al)
        placed = np.flatnonzero((size > 0) & (target <= scan.se))
        coefficients[own[placed], target[placed]] = (2 * bits[placed] - 1) << scan.al
        at = np.minimum(at + rank[:, -1], segments.limit)
        ended = over | (target >= scan.se)
        run_left = np.maximum(run_left - 1, 0)
        k = np.where(ended, scan.ss, target + 1)
        block = block + ended
        alive = block < stop
        if not alive.all():
            at, block, stop, k, run_left = (x[alive] for x in (at, block, stop, k, run_left))


def coefficients(images: list[Image]) -> np.ndarray:
    """All images' blocks (n, 64) in zigzag order; sets each image's `begin`. Images with like scans are read together."""
    total = 0
    for image in images:
        begin = []
        for p in range(len(image.sampling)):
            columns, rows = image.stored(p)
            begin.append(total)
            total += columns * rows
        image.begin = tuple(begin)
    out = np.zeros((total, 64), np.int32)
    groups: dict[tuple, list[Image]] = {}
    for image in images:
        groups.setdefault(tuple(s.kind for s in image.scans), []).append(image)
    for members in groups.values():
        for i, scan in enumerate(members[0].scans):
            segments = _Segments(members, [x.scans[i] for x in members])
            read = (_dc_refine if scan.ah else _dc_first) if scan.ss == 0 else (_ac_refine if scan.ah else _ac_first_scan)
            read(segments, scan, out)
    return out


def samples(images: list[Image], blocks: np.ndarray) -> np.ndarray:
    """8-bit samples (n, 8, 8) of all blocks: dequantised, inverse-transformed in double precision, rounded half up."""
    scale = np.ones((1, 64))
    if any(max(q) > 1 for image in images for q in image.quantisers):
        scale = np.ones(blocks.shape)
        for image in images:
            for p, begin in enumerate(image.begin):
                q = image.quantisers[p]
                columns, rows = image.stored(p)
                scale[begin : begin + columns * rows] = np.frombuffer(q, np.uint8 if len(q) == 64 else ">u2")
    # The small offset keeps exact halves from falling to either side by the order of a sum.
    found = np.floor((blocks * scale) @ inverse_basis() + (128.5 + 1e-6))
    return np.clip(found, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def tensor(image: Image, blocks: np.ndarray) -> np.ndarray:
    """Full-resolution RGB (height, width, 3) of one image from samples(); one part is grey."""
    planes = []
    mh, mv = image.most
    for p, (h, v) in enumerate(image.sampling):
        columns, rows = image.stored(p)
        plane = blocks[image.begin[p] : image.begin[p] + columns * rows].reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        if v < mv:
            plane = np.repeat(plane, mv // v, axis=0)
        if h < mh:
            plane = np.repeat(plane, mh // h, axis=1)
        planes.append(plane[: image.height, : image.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    # The usual conversion, in 16-bit fixed point.
    out = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=2)
    return np.clip(out + 32768 >> 16, 0, 255).astype(np.uint8)
