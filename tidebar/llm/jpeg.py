"""Progressive JPEG in numpy: scans are accumulated into coefficient arrays, then inverse-transformed to RGB tensors.

The decoder reads spectral selection and successive approximation in any scan order, restart intervals, and any chroma
subsampling. Entropy-coded segments are independent of each other, so all segments of one kind, of all images of a
batch, are decoded side by side: a step of the loop takes one symbol in each of them.

`store` keeps bytes in the format's own unit, the quantised coefficient: byte b is the coefficient whose eight
magnitude bits spell b (size category 8), 48 of them in a block, in 4:2:0 images that are sent as a first pass without
the lowest bit, cut into two spectral bands, and a refinement pass. `read_back` takes the bytes from the decoded arrays.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Fixed values of the format: the zigzag order follows from a rule.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

#: Coefficients of a block that carry payload (zigzag 1..USED), and bytes of a unit of two rows of 16 x 16 pixels.
USED = 48
UNIT = 576
BAND = 20
MAX_ROWS = 4095


class JpegError(ValueError):
    """The bytes are no progressive Huffman JPEG."""


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks stored: whole MCUs
    high: int = 0
    own_wide: int = 0  # blocks that cover the component: what a scan of it alone sends
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Scan:
    components: list[int]
    dc: list[bytes]
    ac: list[bytes]
    ss: int
    se: int
    ah: int
    al: int
    restart: int
    segments: list[bytes]


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]
    scans: list[Scan]
    comment: bytes = b""


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from `at` on, with stuffing removed, and where the next marker stands."""
    begin, out, look = at, [], at
    while True:
        look = data.find(b"\xff", look)
        if look < 0 or look + 1 >= len(data):
            raise JpegError("a scan without an end")
        kind = data[look + 1]
        if kind == 0:
            look += 2
        elif kind == 0xFF:
            look += 1
        elif 0xD0 <= kind <= 0xD7:
            out.append(data[begin:look].replace(b"\xff\x00", b"\xff"))
            begin = look = look + 2
        else:
            out.append(data[begin:look].replace(b"\xff\x00", b"\xff"))
            return out, look


def parse(data: bytes) -> Image:
    """Headers, tables and segments; nothing is decoded yet."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at, image, restart = 2, None, 0
    quant: dict[int, np.ndarray] = {}
    huffman: dict[tuple[int, int], bytes] = {}
    comment = b""
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError("no marker")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.zeros(64, np.int32)
                table[ZIGZAG] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
                quant[body[0] & 15] = table
                body = body[65 + 64 * bool(wide) :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif kind == 0xC2:
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not height or not width:
                raise JpegError("only 8-bit images of known size")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most_h, most_v = max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                c.wide, c.high = -(-width // (8 * most_h)) * c.h, -(-height // (8 * most_v)) * c.v
                c.own_wide, c.own_high = -(-(-(-width * c.h // most_h)) // 8), -(-(-(-height * c.v // most_v)) // 8)
                c.coefficients = np.zeros((c.wide * c.high, 64), np.int32)
            image = Image(width, height, parts, quant, [])
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8:
            raise JpegError("only progressive Huffman images")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xFE:
            comment += body
        elif kind == 0xDA:
            if image is None:
                raise JpegError("a scan before the frame")
            n = body[0]
            by_id = {c.ident: i for i, c in enumerate(image.components)}
            own = [by_id[body[1 + 2 * i]] for i in range(n)]
            use = [body[2 + 2 * i] for i in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            segments, at = _segments(data, at)
            image.scans.append(Scan(own, [huffman.get((0, u >> 4), b"") for u in use], [huffman.get((1, u & 15), b"") for u in use], ss, se, approx >> 4, approx & 15, restart, segments))
    if image is None or not image.scans:
        raise JpegError("no frame or no scan")
    image.comment = comment
    return image


_lookups: dict[bytes, np.ndarray] = {}


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may come: length of the code << 8 | symbol; length 0 where no code fits."""
    if table not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        out, code, at = np.zeros(1 << 16, np.int32), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1] if len(table) >= 16 else 0):
                out[code << 16 - length : code + 1 << 16 - length] = length << 8 | table[at]
                code, at = code + 1, at + 1
            code <<= 1
        _lookups[table] = out
    return _lookups[table]


class Lanes:
    """Segments read side by side; lane i's next bit is bit at[i] of one buffer."""

    def __init__(self, segments: list[bytes]) -> None:
        joined = b"".join(x for s in segments for x in (s, b"\0\0\0\0\0\0\0\0"))
        raw = np.frombuffer(joined, np.uint8).astype(np.uint32)
        self.window = np.zeros(len(raw), np.uint32)
        for k in range(4):
            self.window[: len(raw) - k] |= raw[k:] << np.uint32(24 - 8 * k)
        self.bits = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(s) + 8 for s in segments])
        self.at = (ends - np.array([len(s) + 8 for s in segments])) * 8
        self.end = (ends - 4) * 8

    def peek16(self, lane: np.ndarray) -> np.ndarray:
        p = np.minimum(self.at[lane], self.end[lane])
        return (self.window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    def take(self, lane: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits (at most 16) of each lane, as numbers."""
        value = self.peek16(lane).astype(np.int64) >> (16 - n)
        self.at[lane] += n
        return value

    def symbol(self, lane: np.ndarray, table: np.ndarray, tables: np.ndarray) -> np.ndarray:
        found = tables[table, self.peek16(lane)] if len(tables) > 1 else tables[0][self.peek16(lane)]
        if not found.all():
            raise JpegError("no such code")
        self.at[lane] += found >> 8
        return found & 255


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value that `size` magnitude bits stand for."""
    return np.where((bits << 1 >> size) & 1 == 1, bits, bits - (1 << size) + 1) * (size > 0)


@lru_cache(maxsize=4096)
def _order(parts: tuple, restart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the order sent: each block's place in the scan's components, and its number there; and the blocks of each
    restart interval. parts has (h, v, wide, high, own_wide, own_high) of each component of the scan."""
    if len(parts) == 1:
        _, _, wide, _, own_wide, own_high = parts[0]
        block = (np.arange(own_high)[:, None] * wide + np.arange(own_wide)[None, :]).ravel()
        place, per_mcu = np.zeros(len(block), np.int64), 1
    else:
        h0, v0, wide, high, _, _ = parts[0]
        y, x = (a.ravel()[:, None] for a in np.mgrid[: high // v0, : wide // h0])
        places, blocks = [], []
        for k, (h, v, wide, _, _, _) in enumerate(parts):
            row, col = (a.ravel()[None, :] for a in np.mgrid[:v, :h])
            blocks.append((y * v + row) * wide + x * h + col)
            places.append(np.full(blocks[-1].shape, k))
        block, place = np.concatenate(blocks, 1).ravel(), np.concatenate(places, 1).ravel()
        per_mcu = sum(h * v for h, v, *_ in parts)
    step = restart * per_mcu or len(block)
    return place, block, np.diff(np.append(np.arange(0, len(block), step), len(block)))


def decode(images: list[Image]) -> None:
    """Accumulate all scans into the images' coefficient arrays. The k-th scans of all images go together where they
    are of one kind."""
    for k in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict[tuple, list[Image]] = {}
        for image in images:
            if k < len(image.scans):
                s = image.scans[k]
                kinds.setdefault((s.ss, s.se, s.ah, s.al, len(s.components)), []).append(image)
        for (ss, se, ah, al, _), some in kinds.items():
            _decode_scans(some, k, ss, se, ah, al)


def _decode_scans(images: list[Image], k: int, ss: int, se: int, ah: int, al: int) -> None:
    """One pool of blocks for all images of the group, so that a lane's blocks are positions in one array."""
    segments: list[bytes] = []
    where, parts, sizes, dc_of, ac_of = [], [], [], [], []
    pool, owners, base = [], [], 0
    dc_tables: dict[bytes, int] = {}
    ac_tables: dict[bytes, int] = {}
    for image in images:
        scan = image.scans[k]
        own = [image.components[c] for c in scan.components]
        place, block, lane_blocks = _order(tuple((c.h, c.v, c.wide, c.high, c.own_wide, c.own_high) for c in own), scan.restart)
        if len(lane_blocks) != len(scan.segments):
            raise JpegError(f"{len(scan.segments)} segments where {len(lane_blocks)} were due")
        starts = []
        for c in own:
            starts.append(base)
            pool.append(c.coefficients)
            owners.append((c, base))
            base += len(c.coefficients)
        where.append(block + np.array(starts)[place] if len(own) > 1 else block + starts[0])
        parts.append(place)
        sizes.append(lane_blocks)
        segments += scan.segments
        dc_of.append([dc_tables.setdefault(t, len(dc_tables)) for t in scan.dc])
        ac_of.append([ac_tables.setdefault(t, len(ac_tables)) for t in scan.ac])
    data = np.concatenate(pool)
    lanes = Lanes(segments)
    n = np.concatenate(sizes)
    per_image = [len(x) for x in sizes]
    dc_of, ac_of = np.repeat(np.array(dc_of), per_image, 0), np.repeat(np.array(ac_of), per_image, 0)
    longest = np.argsort(-n, kind="stable")
    dc_luts = np.stack([lookup(t) for t in dc_tables])
    ac_luts = np.stack([lookup(t) for t in ac_tables])
    first = np.cumsum(n) - n
    blocks, part = np.concatenate(where), np.concatenate(parts)
    if ss == 0 and ah:
        lane = np.repeat(np.arange(len(n)), n)
        bit = lanes.at[lane] + np.arange(len(lane)) - np.repeat(first, n)
        data[blocks, 0] |= (lanes.bits[bit >> 3] >> (7 - (bit & 7)) & 1).astype(np.int32) << al
    elif ss == 0:
        _dc_first(data, lanes, blocks, part, first, n, longest, dc_of, dc_luts, al)
    elif ah == 0:
        _ac_first(data, lanes, blocks, first, n, ac_of[:, 0], ac_luts, ss, se, al)
    else:
        _ac_refine(data, lanes, blocks, first, n, ac_of[:, 0], ac_luts, ss, se, al)
    for c, at in owners:
        c.coefficients = data[at : at + len(c.coefficients)]


def _dc_first(data, lanes, blocks, part, first, n, longest, tables, luts, al) -> None:
    before = np.zeros((len(n), tables.shape[1]), np.int64)
    live = longest
    for step in range(int(n.max(initial=0))):
        live = live[: np.searchsorted(-n[live], -step, "left")]
        at = first[live] + step
        c = part[at]
        size = lanes.symbol(live, tables[live, c], luts)
        before[live, c] += _extend(lanes.take(live, size), size)
        data[blocks[at], 0] = before[live, c] << al


def _ac_first(data, lanes, blocks, first, n, tables, luts, ss, se, al) -> None:
    block = np.zeros(len(n), np.int64)
    k = np.full(len(n), ss)
    live = np.flatnonzero(n > 0)
    while len(live):
        code = lanes.symbol(live, tables[live], luts)
        run, size = code >> 4, code & 15
        value = _extend(lanes.take(live, size), size)
        has = size > 0
        at = k[live] + run
        if (at[has] > se).any():
            raise JpegError("a coefficient beyond its band")
        if has.all():
            data[blocks[first[live] + block[live]], ZIGZAG[at]] = value << al
            k[live] = at + 1
        else:
            h = live[has]
            data[blocks[first[h] + block[h]], ZIGZAG[at[has]]] = value[has] << al
            k[live] = at + 1  # also what a run of 16 zeros leads to
            ends = ~has & (run < 15)
            e = live[ends]
            # The rest of this block and of as many more as the run says is zero.
            block[e] += (1 << run[ends]) + lanes.take(e, run[ends])
            k[e] = ss
        over = live[k[live] > se]
        block[over] += 1
        k[over] = ss
        live = live[block[live] < n[live]]


def _ac_refine(data, lanes, blocks, first, n, tables, luts, ss, se, al) -> None:
    """A step is one symbol, or the end of one block, in every lane."""
    block, k = np.zeros(len(n), np.int64), np.full(len(n), ss)
    rest = np.zeros(len(n), np.int64)  # blocks of a run of ends, this one included
    band = ZIGZAG[ss : se + 1]
    place = np.arange(ss, se + 1)

    def corrected(lane: np.ndarray, until: np.ndarray, values: np.ndarray) -> None:
        """A correction bit for every coefficient that has a value, from k on and before `until`."""
        due = (values != 0) & (place >= k[lane, None]) & (place < until[:, None])
        order = np.cumsum(due, 1)
        row, col = np.nonzero(due)
        bit = lanes.at[lane[row]] + order[row, col] - 1
        on = (lanes.bits[bit >> 3] >> (7 - (bit & 7)) & 1).astype(bool)
        row, col = row[on], col[on]
        values[row, col] += np.where(values[row, col] < 0, -1, 1) << al
        lanes.at[lane] += order[:, -1]

    live = np.flatnonzero(n > 0)
    while len(live):
        ask = live[rest[live] == 0]
        if len(ask):
            code = lanes.symbol(ask, tables[ask], luts)
            run, size = code >> 4, code & 15
            end = (size == 0) & (run < 15)
            e = ask[end]
            rest[e] = (1 << run[end]) + lanes.take(e, run[end])
            put, run, size = ask[~end], run[~end], size[~end]
            if len(put):
                if (size > 1).any():
                    raise JpegError("a refined coefficient of more than one bit")
                sign = lanes.take(put, size)
                values = data[blocks[first[put] + block[put]][:, None], band]
                zero = (values == 0) & (place >= k[put, None])
                target = np.cumsum(zero, 1) == (run + 1)[:, None]
                if not target.any(1).all():
                    raise JpegError("a run beyond its band")
                until = target.argmax(1) + ss
                corrected(put, until, values)
                new = np.flatnonzero(size)
                values[new, until[new] - ss] = np.where(sign[new] == 1, 1, -1) << al
                data[blocks[first[put] + block[put]][:, None], band] = values
                k[put] = until + 1
                over = put[k[put] > se]
                block[over] += 1
                k[over] = ss
        ending = live[rest[live] > 0]
        if len(ending):
            at = blocks[first[ending] + block[ending]][:, None]
            values = data[at, band]
            corrected(ending, np.full(len(ending), se + 1), values)
            data[at, band] = values
            rest[ending] -= 1
            block[ending] += 1
            k[ending] = ss
        live = live[block[live] < n[live]]


def _inverse() -> np.ndarray:
    """The two-dimensional inverse cosine transform as one 64 x 64 matrix: pixels = coefficients @ matrix."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.ascontiguousarray(np.kron(one, one).T.astype(np.float32))


INVERSE = _inverse()


def planes(images: list[Image]) -> list[list[np.ndarray]]:
    """Samples 0 to 255 of each image's components, whole blocks; all blocks are transformed together."""
    own = [(image, c) for image in images for c in image.components[:3]]
    if not own:
        return []
    pool = np.empty((sum(len(c.coefficients) for _, c in own), 64), np.float32)
    at = 0
    for image, c in own:
        np.multiply(c.coefficients, image.tables[c.table], out=pool[at : at + len(c.coefficients)], casting="unsafe")
        at += len(c.coefficients)
    pixels = pool @ INVERSE
    pixels += 128.5  # the half rounds when the fraction is cut off
    np.clip(pixels, 0, 255, out=pixels)
    samples = pixels.astype(np.uint8)
    at, out = 0, {}
    for image, c in own:
        part = samples[at : at + len(c.coefficients)]
        at += len(part)
        out.setdefault(id(image), []).append(part.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8))
    return [out[id(image)] for image in images]


# Fixed values of the format: the weights of the colour transform, by sample of Cb or Cr.
_CHROMA = np.arange(256, dtype=np.float64) - 128
_RED, _BLUE = np.rint(1.402 * _CHROMA).astype(np.int16), np.rint(1.772 * _CHROMA).astype(np.int16)
_GREEN = -0.344136 * _CHROMA, -0.714136 * _CHROMA


def tensor(image: Image, samples: list[np.ndarray]) -> np.ndarray:
    """(height, width, 3) RGB of a decoded image and its planes; chroma is upsampled by repeating, one component gives
    grey."""
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)

    def full(p: np.ndarray, c: Component) -> np.ndarray:
        return np.repeat(np.repeat(p, most_v // c.v, 0), most_h // c.h, 1)[: image.height, : image.width]

    y = full(samples[0], image.components[0])
    if len(samples) < 3:
        return np.repeat(y[:, :, None], 3, 2)
    cb, cr = samples[1:]
    luma = y.astype(np.int16)
    # The terms are computed for each chroma sample and upsampled then: a quarter of the work at 4:2:0.
    green = np.rint(_GREEN[0][cb] + _GREEN[1][cr]).astype(np.int16) if cb.shape == cr.shape else None
    if green is None:
        green = np.rint(_GREEN[0][full(cb, image.components[1])] + _GREEN[1][full(cr, image.components[2])]).astype(np.int16)
    else:
        green = full(green, image.components[1])
    out = np.empty((image.height, image.width, 3), np.uint8)
    for k, term in enumerate((full(_RED[cr], image.components[2]), green, full(_BLUE[cb], image.components[1]))):
        out[:, :, k] = np.clip(luma + term, 0, 255)
    return out


def rgb_tensors(files: list[bytes]) -> list[np.ndarray]:
    """Full-resolution RGB of each file; the files are decoded together."""
    images = [parse(f) for f in files]
    decode(images)
    return [tensor(i, p) for i, p in zip(images, planes(images), strict=True)]


# Storing payloads.

_DC = bytes([1] + [0] * 15 + [0])
_FIRST = bytes([1] + [0] * 15 + [0x07])
_RUNS = bytes([0, 0, 5] + [0] * 13 + [0x00, 0x10, 0x20, 0x30, 0x40])


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _joined(segments: np.ndarray) -> bytes:
    """Rows of bytes as segments with restart markers between."""
    rows = [r.tobytes().replace(b"\xff", b"\xff\x00") for r in segments]
    if len(rows) == 1:
        return rows[0]
    return b"".join(x for i, r in enumerate(rows) for x in ((bytes((0xFF, 0xD0 + (i - 1) % 8)) if i else b""), r))


def store(payload: bytes) -> bytes:
    """The payload, a positive multiple of UNIT bytes, as a progressive JPEG whose coefficients spell it."""
    units = len(payload) // UNIT
    across = -(-units // MAX_ROWS)
    down = -(-units // across)
    filled = np.frombuffer(payload + b"\xff" * (across * down * UNIT - len(payload)), np.uint8).reshape(-1, USED)
    n = across * down
    planes = [(1, 8, filled[: 8 * n]), (2, 2, filled[8 * n : 10 * n]), (3, 2, filled[10 * n :])]
    out = [b"\xff\xd8", _marker(0xFE, struct.pack(">Q", len(payload))), _marker(0xDB, b"\0" + b"\1" * 64)]
    frame = struct.pack(">BHHB", 8, 16 * down, 32 * across, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    out += [_marker(0xC2, frame), _marker(0xC4, b"\x00" + _DC + b"\x10" + _FIRST + b"\x11" + _RUNS)]
    # All DC coefficients are zero: one code of one bit for each of an MCU's six blocks.
    zeros = np.packbits(np.pad(np.zeros((n, 12), np.uint8), ((0, 0), (0, 4)), constant_values=1), axis=1)
    out += [_marker(0xDD, struct.pack(">H", 2)), _marker(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, 0, 0, 0x01))), _joined(zeros)]
    for ident, blocks, plane_ in planes:
        out.append(_marker(0xDD, struct.pack(">H", blocks)))
        for low, high in ((1, BAND), (BAND + 1, USED)):
            # A code of one bit, 0, and seven magnitude bits: a byte for each coefficient.
            part = (plane_[:, low - 1 : high] >> 1).reshape(n, -1)
            out += [_marker(0xDA, bytes((1, ident, 0x00, low, high, 0x01))), _joined(part)]
    for ident, blocks, plane_ in planes:
        low_bits = np.where(plane_ >= 128, plane_ & 1, ~plane_ & 1).reshape(n, -1)
        order = blocks.bit_length() - 1  # one run of ends over the whole interval, then the correction bits
        head = np.array([order >> 2 & 1, order >> 1 & 1, order & 1, *[0] * order], np.uint8)
        tail = -(len(head) + low_bits.shape[1]) % 8
        bits = np.concatenate([np.tile(head, (n, 1)), low_bits.astype(np.uint8), np.ones((n, tail), np.uint8)], 1)
        out += [_marker(0xDD, struct.pack(">H", blocks)), _marker(0xDA, bytes((1, ident, 0x01, 1, USED, 0x10))), _joined(np.packbits(bits, axis=1))]
    out.append(b"\xff\xd9")
    return b"".join(out)


def read_back(image: Image) -> bytes:
    """The payload of a decoded image that `store` made."""
    length = struct.unpack(">Q", image.comment)[0]
    spelled = np.concatenate([c.coefficients[:, ZIGZAG[1 : USED + 1]] for c in image.components])
    return np.where(spelled > 0, spelled, spelled + 255).astype(np.uint8).tobytes()[:length]
