"""Media columns: payloads kept in progressive JPEG files, and decoded into full-resolution RGB tensors.

A payload of 64-byte blocks is stored without loss in a progressive JPEG of three components with chroma at half
resolution: byte k of a block is the block's k-th coefficient in zigzag order. JPEG's entropy coding is lossless, so the
accumulated coefficients give the payload back, whatever the pixels round to. A file has, for each component, a first DC
scan, two spectral bands of AC coefficients, and the successive-approximation scans that refine the last bit.

Decoding accumulates the scans into coefficient arrays, dequantises and inverse-transforms them in numpy, upsamples the
chroma, and gives RGB pixels. Restart intervals are independent, so all intervals of all files of a batch are decoded in
lockstep, one symbol of each at a time. Refinement scans in which every coefficient is known already, as in the files
written here (`_to_coefficient` gives none below two in size), are one bit a coefficient. All other scans of progressive
JPEG are decoded one symbol after another: components interleaved, any levels of approximation, new coefficients, runs of
ended bands. So files of other writers are decoded too, of one or three components and any sampling; they have no
payload and its columns are null. A file that is no 8-bit Huffman-coded progressive JPEG is refused.

Defined cases: a null text is empty, and an empty text is one block of zeros. Payloads are whole, never cut; a batch is
worked off in passes of bounded size, and a longer payload makes a pass of its own. Equal texts give equal files. Repeated
rows and null doc_ids are rows like others; an empty table gives no rows. Only doc_id and text (or media) are read, so
further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
#: Payload bytes of a pass, blocks of a restart interval, MCUs of an image's row at most.
PASS_BYTES = 1 << 21
INTERVAL = 16
MAX_COLUMNS = 4095
#: The spectral bands of the first AC scans.
BANDS = ((1, 20), (21, 63))
# fixed values: code lengths by symbol (first DC and AC scans, refinement scans)
DC_LENGTHS = {2: 2, 3: 2, 0: 3, 1: 3, 4: 3, 6: 4, 5: 5, 7: 6, 8: 7, 9: 8, 10: 9, 11: 10}
AC_LENGTHS = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 0x00: 8, 0xF0: 9}
REFINE_LENGTHS = {r << 4: 4 for r in range(15)}


def _zigzag() -> np.ndarray:
    """Row-major places of the zigzag order."""
    places = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in places])


ZIGZAG = _zigzag()
_k = np.arange(8)
#: The inverse transform of one dimension.
IDCT = (np.where(_k == 0, np.sqrt(0.125), 0.5)[None, :] * np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16)).astype(np.float32)


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Canonical codes: code and length by symbol, and the table as a DHT segment holds it."""
    order = sorted(lengths, key=lambda s: lengths[s])
    code, size, codes, sizes = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        codes[s], sizes[s] = code, size
        code += 1
    counts = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17))
    return codes, sizes, counts + bytes(order)


_DC, _AC, _REFINE = _codes(DC_LENGTHS), _codes(AC_LENGTHS), _codes(REFINE_LENGTHS)


# fixed values: bytes in the order of their frequency in prose and padding, then all others; the order in which they have small coefficients
_FREQUENT = b" etaoinsr\x00hldcumpfgyvbwkxjqz\n.,\xc3-'\"TASIHWBCMPDLNERFGOJKUVYXQZ0123456789"
_ORDER = np.array([*_FREQUENT, *sorted(set(range(256)) - set(_FREQUENT))])
_COEFFICIENTS = np.empty(256, np.int64)
_COEFFICIENTS[_ORDER] = np.where(np.arange(256) % 2, -1, 1) * (np.arange(256) // 2 + 2)
_BYTES = np.zeros(260, np.uint8)
_BYTES[_COEFFICIENTS + 130] = np.arange(256)


def _to_coefficient(b: np.ndarray) -> np.ndarray:
    """Bytes as coefficients of 2 to 129 in size, the most frequent the smallest, so that files are small."""
    return _COEFFICIENTS[b]


def _to_byte(c: np.ndarray) -> np.ndarray:
    return _BYTES[c + 130]


def layout(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of MCUs that hold n_blocks blocks, six to an MCU."""
    m = -(-n_blocks // 6)
    columns = min(m, MAX_COLUMNS)
    return columns, -(-m // columns)


# ---- encoding


def _pack(values: np.ndarray, lengths: np.ndarray, unit: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings one after another; each unit is filled up with ones to whole bytes. Bytes, and each unit's first."""
    bits = np.bincount(unit, lengths, n_units).astype(np.int64)
    size = -(-bits // 8)
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.cumsum(lengths) - lengths
    begin = np.cumsum(bits) - bits
    place = place - begin[unit] + first[:-1][unit] * 8
    fill = size * 8 - bits
    words = np.zeros(int(first[-1]) // 4 + 3, np.uint64)
    open_ = fill > 0
    for v, n, p in ((values, lengths, place), ((1 << fill[open_]) - 1, fill[open_], (first[:-1] * 8 + bits)[open_])):
        if not len(v):
            continue
        at = p >> 5
        wide = v.astype(np.uint64) << (64 - (p & 31) - n).astype(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[starts]] += np.add.reduceat(wide >> np.uint64(32), starts)
        words[at[starts] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), starts)
    return words.astype(">u4").view(np.uint8)[: int(first[-1])], first


def _stuff(data: np.ndarray, first: np.ndarray, marker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put a zero after each 255, and a restart marker before each unit whose `marker` is 0 to 7 (-1: none)."""
    ff = np.flatnonzero(data == 255)
    marked = np.flatnonzero(marker >= 0)
    at = np.concatenate([ff + 1, np.repeat(first[marked], 2)])
    what = np.concatenate([np.zeros(len(ff), np.uint8), np.stack([np.full(len(marked), 255), 0xD0 + marker[marked]], 1).astype(np.uint8).reshape(-1)])
    order = np.argsort(at, kind="stable")
    out = np.insert(data, at[order], what[order])
    shift = np.searchsorted(ff, first, "left") + 2 * np.concatenate([[0], np.cumsum(marker >= 0)])
    return out, first + shift


def _units(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut runs of `blocks` blocks into restart intervals: first block, number of blocks, place within the run."""
    n = -(-blocks // INTERVAL)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(np.cumsum(blocks) - blocks, n) + place * INTERVAL
    return begin, np.minimum(INTERVAL, np.repeat(blocks, n) - place * INTERVAL), place


def encode(payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """JPEG files of payloads (multiples of 64 bytes) whose texts have `sizes` bytes."""
    grids = [layout(len(p) // BLOCK) for p in payloads]
    mcus = np.array([c * r for c, r in grids], np.int64)
    parts = [p + bytes(int(m) * 6 * BLOCK - len(p)) for p, m in zip(payloads, mcus, strict=True)]
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, BLOCK)
    coefficients = _to_coefficient(raw)
    runs = np.stack([mcus * 4, mcus, mcus], 1).reshape(-1)  # blocks of a component of a file
    begin, count, place = _units(runs)
    unit_of_block = np.repeat(np.arange(len(begin)), count)
    marker = np.where(place > 0, (place - 1) % 8, -1)
    first_unit = np.concatenate([[0], np.cumsum(-(-runs // INTERVAL))])
    scans = []

    def scan(values: np.ndarray, lengths: np.ndarray, unit: np.ndarray, header: bytes) -> None:
        data, first = _stuff(*_pack(values, lengths, unit, len(begin)), marker)
        scans.append((data.tobytes(), first[first_unit], header))

    magnitude, sign = np.abs(coefficients), coefficients < 0
    # first DC: differences within an interval
    dc = coefficients[:, 0] >> 1
    difference = dc.copy()
    difference[1:] -= dc[:-1]
    difference[begin] = dc[begin]
    s = _sizes(np.abs(difference))
    extra = np.where(difference < 0, difference + (1 << s) - 1, difference)
    scan((_DC[0][s] << s) | extra, _DC[1][s] + s, unit_of_block, bytes([0, 0, 0x01]))
    half = magnitude >> 1
    for lo, hi in BANDS:
        v = half[:, lo : hi + 1].reshape(-1)
        negative = sign[:, lo : hi + 1].reshape(-1)
        s = _sizes(v)
        extra = np.where(negative, (1 << s) - 1 - v, v)
        scan((_AC[0][s] << s) | extra, _AC[1][s] + s, np.repeat(unit_of_block, hi + 1 - lo), bytes([lo, hi, 0x01]))
    scan(coefficients[:, 0] & 1, np.ones(len(raw), np.int64), unit_of_block, bytes([0, 0, 0x10]))
    # refinement of AC: one end-of-band run for the interval, then a bit for each coefficient; 21 bits a string
    r = _sizes(count) - 1
    head = (_REFINE[0][r << 4] << r) | (count - (1 << r))
    strings = (magnitude[:, 1:] & 1).reshape(-1, 3, 21) @ (1 << np.arange(20, -1, -1))
    where = begin * 3
    values = np.insert(strings.reshape(-1), where, head)
    lengths = np.insert(np.full(len(raw) * 3, 21), where, _REFINE[1][r << 4] + r)
    unit = np.insert(np.repeat(unit_of_block, 3), where, np.arange(len(begin)))
    scan(values, lengths, unit, bytes([1, 63, 0x10]))

    tables = b"".join(struct.pack(">BBHB", 255, 0xC4, 19 + len(t) - 16, kind) + t for kind, t in ((0x00, _DC[2]), (0x10, _AC[2]), (0x11, _REFINE[2])))
    quantizers = struct.pack(">BBHB", 255, 0xDB, 67, 0) + bytes([1]) * 64
    restart = struct.pack(">BBHH", 255, 0xDD, 4, INTERVAL)
    out = []
    for i, ((columns, rows), payload, size) in enumerate(zip(grids, payloads, sizes, strict=True)):
        note = f"payload {len(payload)} text {size}".encode()
        frame = struct.pack(">BBHBHHB", 255, 0xC2, 17, 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        file = [b"\xff\xd8", struct.pack(">BBH", 255, 0xFE, 2 + len(note)), note, quantizers, frame, tables, restart]
        for data, first, header in scans:
            refine_ac = header[0] > 0 and header[2] == 0x10
            for c in range(3):
                file += [struct.pack(">BBHBBB", 255, 0xDA, 8, 1, c + 1, 0x01 if refine_ac else 0x00), header, data[first[i * 3 + c] : first[i * 3 + c + 1]]]
        file.append(b"\xff\xd9")
        out.append(b"".join(file))
    return out


_SIZES = np.array([0, *(int(n).bit_length() for n in range(1, 4097))], np.int64)


def _sizes(magnitude: np.ndarray) -> np.ndarray:
    """Bits of non-negative numbers."""
    return _SIZES[magnitude]


# ---- decoding


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length by the next 16 bits, of a DHT segment's table."""
    symbols, lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo = code << (16 - n)
            symbols[lo : lo + (1 << (16 - n))], lengths[lo : lo + (1 << (16 - n))] = table[at], n
            code, at = code + 1, at + 1
        code <<= 1
    return symbols, lengths


@dataclass
class Plane:
    """A component's blocks: rows and columns with the padding of whole MCUs, without it, first block, sampling, quantizer."""

    first: int
    rows: int
    columns: int
    used_rows: int
    used_columns: int
    vertical: int
    horizontal: int
    quantizer: int

    @property
    def blocks(self) -> int:
        return self.rows * self.columns


@dataclass
class Scan:
    components: list[int]
    low: int
    high: int
    before: int
    after: int
    tables: list[bytes]
    interval: int
    begin: int
    end: int


class File:
    """The headers of a progressive JPEG file: planes, quantizers, scans and the payload's note."""

    def __init__(self, data: bytes, markers: np.ndarray, base: int, first: int) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG file")
        self.planes: list[Plane] = []
        self.scans: list[Scan] = []
        self.quantizers: dict[int, np.ndarray] = {}
        self.note: list[str] = []
        self.height = self.width = self.blocks = 0
        names: list[int] = []
        tables: dict[int, bytes] = {}
        interval, at = 0, 2
        while data[at + 1] != 0xD9:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 1 + 64 * (1 + wide)
                    self.quantizers[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.float32)
                    body = body[n:]
            elif kind == 0xC2:
                names = self._frame(body, first)
            elif kind == 0xDD:
                interval = int.from_bytes(body, "big")
            elif kind == 0xFE and body.startswith(b"payload "):
                self.note = body.decode().split()
            elif kind == 0xDA:
                k = int(np.searchsorted(markers, base + at))
                while 0xD0 <= data[markers[k] - base + 1] <= 0xD7:
                    k += 1
                n = body[0]
                low, high, levels = body[1 + 2 * n : 4 + 2 * n]
                of = [body[2 + 2 * c] for c in range(n)]
                used = [tables.get(0x10 | (t & 15) if low else t >> 4, b"") for t in of]
                self.scans.append(Scan([names.index(body[1 + 2 * c]) for c in range(n)], low, high, levels >> 4, levels & 15, used, interval, base + at, int(markers[k])))
                at = int(markers[k]) - base
            elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
                raise ValueError("no progressive JPEG file")

    def _frame(self, body: bytes, first: int) -> list[int]:
        self.height, self.width = struct.unpack(">HH", body[1:5])
        parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        if body[0] != 8 or len(parts) not in (1, 3) or not self.height:
            raise ValueError("no 8-bit image of one or three components")
        h, v = max(p[1] for p in parts), max(p[2] for p in parts)
        down, across = -(-self.height // (8 * v)), -(-self.width // (8 * h))
        for _, ph, pv, quantizer in parts:
            used = -(-(-(-self.height * pv // v)) // 8), -(-(-(-self.width * ph // h)) // 8)
            self.planes.append(Plane(first + self.blocks, down * pv, across * ph, *used, pv, ph, quantizer))
            self.blocks += self.planes[-1].blocks
        self.mcus = down * across
        self.across = across
        return [p[0] for p in parts]

    @property
    def plain(self) -> bool:
        """Whether the image is one as this module writes it: whole MCUs, chroma at half resolution, no quantization."""
        shape = [(p.vertical, p.horizontal) for p in self.planes]
        return shape == [(2, 2), (1, 1), (1, 1)] and self.height % 16 == self.width % 16 == 0 and all((self.quantizers[p.quantizer] == 1).all() for p in self.planes)


class _Bits:
    """Bit readers over the restart intervals of many scans, one position for each."""

    def __init__(self, data: np.ndarray, first: np.ndarray) -> None:
        padded = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint64)
        n = len(data) + 1
        self.window = (padded[:n] << np.uint64(32)) | (padded[1 : n + 1] << np.uint64(24)) | (padded[2 : n + 2] << np.uint64(16)) | (padded[3 : n + 3] << np.uint64(8)) | padded[4 : n + 4]
        self.window = self.window.astype(np.int64)
        self.at = first.astype(np.int64) * 8

    def peek(self, k: slice) -> np.ndarray:
        """The next 32 bits of the first readers."""
        at = self.at[k]
        return (self.window[at >> 3] >> (8 - (at & 7))) & 0xFFFFFFFF


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number that `size` additional bits stand for."""
    return np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)


def _first_scan(reader: _Bits, table: tuple[np.ndarray, np.ndarray], lo: int, hi: int, begin: np.ndarray, count: np.ndarray, out: np.ndarray) -> None:
    """Decode a first scan of coefficients lo to hi of the blocks of each interval; intervals are in falling order of count."""
    symbols, lengths = table
    width = hi - lo + 1
    step, total, flat = np.zeros(len(begin), np.int64), count * width, out.reshape(-1)
    live, k = slice(0, len(begin)), 0
    while True:
        if k % 64 == 0:
            left = np.flatnonzero(step[live] < total[live])
            if not len(left):
                break
            live = slice(0, int(left[-1]) + 1)
        going = step[live] < total[live]
        window = reader.peek(live)
        top = window >> 16
        symbol, used = symbols[top], lengths[top]
        size = symbol & 15
        run = symbol >> 4
        value = _extend((window >> (32 - used - size)) & ((1 << size) - 1), size)
        here = step[live]
        if lo and (run.any() or not size.all()):
            ends = (size == 0) & (run < 15)
            extra = np.where(ends, (window >> np.maximum(32 - used - run, 0)) & ((1 << np.minimum(run, 15)) - 1), 0)
            here = here + np.where(ends, 0, np.where(size == 0, 0, run))
            moved = np.where(ends, (here // width + (1 << np.minimum(run, 14)) + extra) * width, np.where(size == 0, here + 16, here + 1))
            used = used + np.where(ends, run, 0)
            put = going & (size > 0)
        else:
            moved, put = here + 1, going
        where = (begin[live] + here // width) * BLOCK + lo + here % width
        flat[where[put]] = value[put]
        reader.at[live] += np.where(going, used + size, 0)
        step[live] = np.where(going, moved, here)
        k += 1


class _Symbols:
    """A bit reader over one restart interval, for scans that are decoded one symbol after another."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.n = data + b"\xff" * 8, 0, len(data) * 8

    def bits(self, n: int) -> int:
        at = self.at
        self.at += n
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "big") >> (40 - (at & 7) - n)) & ((1 << n) - 1)

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        at = self.at
        top = (int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7))) & 0xFFFF
        if at >= self.n or not table[1][top]:
            raise ValueError("a damaged scan")
        self.at += int(table[1][top])
        return int(table[0][top])

    def number(self, size: int) -> int:
        value = self.bits(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _one_by_one(file: File, scan: Scan, intervals: list[bytes], out: np.ndarray) -> None:
    """Decode any scan of a file, block after block."""
    tables = [_lookup(t) if t else None for t in scan.tables]
    planes = [file.planes[c] for c in scan.components]
    if len(planes) == 1:
        p = planes[0]
        units = [[(0, p.first + y * p.columns + x)] for y in range(p.used_rows) for x in range(p.used_columns)]
    else:
        units = [
            [(k, p.first + (y * p.vertical + i) * p.columns + x * p.horizontal + j) for k, p in enumerate(planes) for i in range(p.vertical) for j in range(p.horizontal)]
            for y, x in (divmod(m, file.across) for m in range(file.mcus))
        ]
    step = scan.interval or len(units)
    for begin, data in zip(range(0, len(units), step), intervals, strict=True):
        reader, ended = _Symbols(data), 0
        last = [0] * len(planes)
        for unit in units[begin : begin + step]:
            for k, block in unit:
                if scan.low == 0:
                    if scan.before:
                        out[block, 0] |= reader.bits(1) << scan.after
                    else:
                        last[k] += reader.number(reader.symbol(tables[k]))
                        out[block, 0] = last[k] * (1 << scan.after)
                else:
                    row = out[block].tolist()
                    ended = (_refined if scan.before else _banded)(reader, tables[k], row, scan, ended)
                    out[block] = row


def _banded(reader: _Symbols, table: tuple[np.ndarray, np.ndarray], row: list[int], scan: Scan, ended: int) -> int:
    """A block of a first AC scan; the blocks that remain ended."""
    if ended:
        return ended - 1
    k = scan.low
    while k <= scan.high:
        run, size = divmod(reader.symbol(table), 16)
        if size == 0 and run < 15:
            return (1 << run) + reader.bits(run) - 1
        k += run
        if size:
            row[k] = reader.number(size) * (1 << scan.after)
        k += 1
    return 0


def _refined(reader: _Symbols, table: tuple[np.ndarray, np.ndarray], row: list[int], scan: Scan, ended: int) -> int:
    """A block of a refinement AC scan: a bit for each known coefficient passed, new ones of the least size between."""
    unit, k = 1 << scan.after, scan.low

    def correct(k: int) -> None:
        if reader.bits(1):
            row[k] += unit if row[k] > 0 else -unit

    while not ended and k <= scan.high:
        run, size = divmod(reader.symbol(table), 16)
        if size == 0 and run < 15:
            ended = (1 << run) + reader.bits(run)
            break
        new = (unit if reader.bits(1) else -unit) if size else 0
        while k <= scan.high:
            if row[k]:
                correct(k)
            elif run:
                run -= 1
            else:
                row[k] = new
                k += 1
                break
            k += 1
    if not ended:
        return 0
    for k in range(k, scan.high + 1):
        if row[k]:
            correct(k)
    return ended - 1


def decode(files: list[bytes]) -> tuple[list[File], np.ndarray]:
    """The files' headers, and all their coefficients: a row for each block in the order of files, planes and rasters."""
    data = np.frombuffer(b"".join(files), np.uint8)
    follows = np.concatenate([data[1:], [0]])
    markers = np.flatnonzero((data == 255) & (follows != 0))
    bases = np.cumsum([0, *map(len, files)])
    parsed: list[File] = []
    n_blocks = 0
    for f, base in zip(files, bases, strict=False):
        parsed.append(File(f, markers, int(base), n_blocks))
        n_blocks += parsed[-1].blocks
    kept = ~((data == 0) & (np.concatenate([[0], data[:-1]]) == 255))
    new_place = np.concatenate([[0], np.cumsum(kept)])
    clean = data[kept]
    out = np.zeros((n_blocks, BLOCK), np.int64)
    restarts = markers[(follows[markers] >= 0xD0) & (follows[markers] <= 0xD7)]
    # scans of one kind of all files are decoded together; a component's scans follow one another
    rounds: dict[tuple, list[tuple[File, Scan]]] = {}
    for f in parsed:
        seen = [0] * len(f.planes)
        for scan in f.scans:
            at = max(seen[c] for c in scan.components)
            for c in scan.components:
                seen[c] = at + 1
            p = f.planes[scan.components[0]]
            together = len(scan.components) == 1 and p.used_rows == p.rows and p.used_columns == p.columns
            rounds.setdefault((at, together, scan.low, scan.high, scan.before, scan.after, scan.tables[0] if together else b""), []).append((f, scan))
    for (_, together, low, high, before, after, table), scans in sorted(rounds.items(), key=lambda x: x[0][0]):
        if not together or not _together(scans, table, low, high, before, after, clean, new_place, restarts, out):
            for f, scan in scans:
                inner = restarts[(restarts >= scan.begin) & (restarts < scan.end)]
                bounds = zip([scan.begin, *(inner + 2)], [*inner, scan.end], strict=True)
                _one_by_one(f, scan, [clean[new_place[a] : new_place[b]].tobytes() for a, b in bounds], out)
    return parsed, out


def _together(scans: list[tuple[File, Scan]], table: bytes, low: int, high: int, before: int, after: int, clean: np.ndarray, new_place: np.ndarray, restarts: np.ndarray, out: np.ndarray) -> bool:
    """Decode scans of one kind in lockstep; False (and nothing done) if they are refinements with new coefficients."""
    planes = [f.planes[s.components[0]] for f, s in scans]
    runs = np.array([p.blocks for p in planes])
    interval = np.array([s.interval or p.blocks for (_, s), p in zip(scans, planes, strict=True)])
    n = -(-runs // interval)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    count = np.minimum(np.repeat(interval, n), np.repeat(runs, n) - place * np.repeat(interval, n))
    begin = np.repeat([p.first for p in planes], n) + place * np.repeat(interval, n)
    lo = np.array([s.begin for _, s in scans])
    byte = np.repeat(lo, n)
    inner = np.repeat(np.searchsorted(restarts, lo), n) + place - 1
    byte[place > 0] = restarts[inner[place > 0]] + 2
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    reader = _Bits(clean, new_place[byte[order]])
    if before:
        return _refine(reader, _lookup(table) if low else None, low, high, begin, count, out, clean, after)
    _first_scan(reader, _lookup(table), low, high, begin, count, out)
    blocks = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if low == 0:
        sums = np.cumsum(out[blocks, 0])
        ends = np.cumsum(count)
        out[blocks, 0] = sums - np.repeat(np.concatenate([[0], sums])[ends - count], count)
    out[blocks, low : high + 1] <<= after
    return True


def payloads(files: list[File], coefficients: np.ndarray) -> list[tuple[bytes, int] | None]:
    """The payload and its text's size of each file that this module wrote, None of others."""
    bytes_of = _to_byte(coefficients)
    return [(bytes_of[f.planes[0].first :][: f.blocks].tobytes()[: int(f.note[1])], int(f.note[3])) if f.note else None for f in files]


def _refine(reader: _Bits, table: tuple[np.ndarray, np.ndarray] | None, lo: int, hi: int, begin: np.ndarray, count: np.ndarray, out: np.ndarray, data: np.ndarray, low_bit: int) -> bool:
    """A refinement scan in which every coefficient of the band is known already: a bit for each, in order. Else False."""
    everywhere = slice(0, len(begin))
    if table is not None:
        window = reader.peek(everywhere)
        symbol, used = table[0][window >> 16], table[1][window >> 16]
        run = symbol >> 4
        if (symbol & 15).any() or (run > 14).any():
            return False
        blocks = (1 << run) + ((window >> (32 - used - run)) & ((1 << run) - 1))
        if (blocks != count).any():
            return False
        reader.at += used + run
    width = hi - lo + 1
    blocks = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    known = out[blocks, lo : hi + 1]
    if lo and not known.all():
        return False
    n = count * width
    bit = np.repeat(reader.at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    bits = ((data[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(np.int64).reshape(-1, width)
    out[blocks, lo : hi + 1] = known | (bits << low_bit) if lo == 0 else known + np.where(known < 0, -bits, bits) * (1 << low_bit)
    return True


def rgb(file: File, coefficients: np.ndarray) -> np.ndarray:
    """The RGB tensor (height, width, 3) of any file."""
    channels = []
    v, h = max(p.vertical for p in file.planes), max(p.horizontal for p in file.planes)
    for p in file.planes:
        natural = np.zeros((p.blocks, BLOCK), np.float32)
        natural[:, ZIGZAG] = coefficients[p.first : p.first + p.blocks] * file.quantizers[p.quantizer]
        pixels = np.matmul(np.matmul(IDCT, natural.reshape(-1, 8, 8)), IDCT.T)
        plane = pixels.reshape(p.rows, p.columns, 8, 8).transpose(0, 2, 1, 3).reshape(p.rows * 8, p.columns * 8)
        channels.append(plane[np.arange(file.height) * p.vertical // v][:, np.arange(file.width) * p.horizontal // h])
    bright = channels[0] + np.float32(128)
    blue, red = channels[1:] if len(channels) == 3 else (np.float32(0), np.float32(0))
    return np.clip(np.rint(np.stack([x + np.zeros_like(bright) for x in _colours(bright, blue, red)], -1)), 0, 255).astype(np.uint8)


def _colours(bright: np.ndarray, blue: np.ndarray, red: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return bright + np.float32(1.402) * red, bright - np.float32(0.344136) * blue - np.float32(0.714136) * red, bright + np.float32(1.772) * blue


def rgb_blocks(coefficients: np.ndarray, grids: list[tuple[int, int]], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """RGB pixels of the luma blocks (n, 8, 8, 3) of all files in raster order of blocks, and each file's first block."""
    natural = np.zeros((len(coefficients), BLOCK), np.float32)
    natural[:, ZIGZAG] = coefficients
    # a product for each block, so that a block's pixels do not depend on its neighbours in the batch
    pixels = np.matmul(np.matmul(IDCT, natural.reshape(-1, 8, 8)), IDCT.T)
    luma, chroma, rows, columns = [], [], [], []
    for (c, r), at in zip(grids, first, strict=False):
        y, x = np.divmod(np.arange(4 * c * r), 2 * c)
        luma.append(at + np.arange(4 * c * r))
        chroma.append(at + 4 * c * r + (y // 2) * c + x // 2)
        rows.append(y % 2)
        columns.append(x % 2)
    chroma_at, y, x = np.concatenate(chroma), np.concatenate(rows), np.concatenate(columns)
    step = np.concatenate([[0], np.cumsum([4 * c * r for c, r in grids])])
    out = np.empty((len(chroma_at), 8, 8, 3), np.uint8)
    half = np.arange(8) // 2
    mcus = np.repeat(np.array([c * r for c, r in grids]), [4 * c * r for c, r in grids])
    i, j = (y[:, None] * 4 + half)[:, :, None], (x[:, None] * 4 + half)[:, None, :]
    blue, red = pixels[chroma_at[:, None, None], i, j], pixels[(chroma_at + mcus)[:, None, None], i, j]
    bright = pixels[np.concatenate(luma)] + np.float32(128)
    for k, channel in enumerate(_colours(bright, blue, red)):
        out[..., k] = np.clip(np.rint(channel), 0, 255)
    return out, step


def image(blocks: np.ndarray, columns: int, rows: int) -> np.ndarray:
    """A file's RGB blocks as one tensor (height, width, 3)."""
    return blocks.reshape(2 * rows, 2 * columns, 8, 8, 3).transpose(0, 2, 1, 3, 4).reshape(16 * rows, 16 * columns, 3)


def padded(text: bytes) -> bytes:
    """A text with zeros up to a positive multiple of 64 bytes."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def _passes(sizes: list[int], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if len(sizes) > at:
        yield at, len(sizes)


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's bytes as a progressive JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).fill_null("").cast(pa.binary())
            for lo, hi in _passes(pc.binary_length(column).to_pylist()):
                texts = column.slice(lo, hi - lo).to_pylist()
                media = encode([padded(t) for t in texts], [len(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TENSOR_SCHEMA = FEATURE_SCHEMA + ", height int, width int, rgb binary"


def decode_media(media: DataFrame, tensors: bool = True) -> DataFrame:
    """Digests of payload and file, a feature and (with tensors) the RGB tensor of each file of doc_id, media.

    The feature is the image's size and the mean of each channel. rgb holds height * width * 3 bytes in row order. A null
    file gives nulls.
    """

    kinds = dict(f.split() for f in (TENSOR_SCHEMA if tensors else FEATURE_SCHEMA).split(", "))
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in kinds.items()])

    def images(files: list[File], coefficients: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
        """Each file's pixels (blocks of a plain one) and size."""
        plain = [f for f in files if f.plain]
        if plain:
            rows = coefficients if len(plain) == len(files) else np.concatenate([coefficients[f.planes[0].first :][: f.blocks] for f in plain])
            first = np.cumsum([0, *(f.blocks for f in plain)])
            blocks, step = rgb_blocks(rows, [(f.width // 16, f.height // 16) for f in plain], first)
        k = 0
        for f in files:
            if f.plain:
                yield blocks[step[k] : step[k + 1]], (f.height, f.width)
                k += 1
            else:
                yield rgb(f, coefficients), (f.height, f.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for lo, hi in _passes(pc.binary_length(column).fill_null(0).to_pylist()):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                there = [(i, f) for i, f in zip(ids, column.slice(lo, hi - lo).to_pylist(), strict=True)]
                files, coefficients = decode([f for _, f in there if f is not None])
                found = iter(zip(payloads(files, coefficients), images(files, coefficients), files, strict=True))
                rows = []
                for i, f in there:
                    if f is None:
                        rows.append((i, *[None] * (len(schema) - 1)))
                        continue
                    kept, (pixels, (height, width)), file = next(found)
                    p, n = kept or (None, None)
                    means = pixels.reshape(-1, 3).sum(0, dtype=np.int64) / (pixels.size // 3)
                    digests = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:])) if kept else (None, None, None)
                    feature = f"{width}x{height} {means[0]:.3f} {means[1]:.3f} {means[2]:.3f}"
                    row = (i, n, *digests, len(f), hashlib.sha256(f).hexdigest(), feature)
                    rows.append((*row, height, width, (image(pixels, width // 16, height // 16) if file.plain else pixels).tobytes()) if tensors else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, TENSOR_SCHEMA if tensors else FEATURE_SCHEMA)
