"""Progressive JPEG (SOF2, 8 bits, Huffman): scans to coefficient arrays and back, and on to RGB.

``read`` takes any such file: spectral selection, successive approximation, interleaved scans, subsampled
components, end-of-band runs and restart intervals. A scan whose code is of fixed width (length of each
Huffman code plus the bits that follow it is the same for every symbol) is decoded with numpy; the
others symbol by symbol. ``write`` stores coefficients that are all positive with such codes, so that what
it writes can be read with numpy, and by any other decoder too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

#: Place in the 8 x 8 block (row * 8 + column) of the k-th coefficient: diagonals, up and down in turn.
ZIGZAG = np.array([i * 8 + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[sum(p) % 2 == 0]))])
_k, _x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
_BASIS = np.where(_k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _x + 1) * _k * np.pi / 16)
#: Row k: the 64 samples that coefficient k (in zigzag order) adds to a block.
INVERSE = np.einsum("ux,vy->uvxy", _BASIS, _BASIS).reshape(64, 64)[ZIGZAG].astype(np.float32)
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
#: Longest run of blocks that one end-of-band symbol stands for.
MOST_BLOCKS = 32_767
#: Bits of every symbol with what follows it in the files that ``write`` makes.
WIDTH = 9


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks across, of whole minimum coded units
    high: int = 0
    own_wide: int = 0  # blocks across that the image covers, as scans of this component alone have them
    own_high: int = 0
    coef: np.ndarray = None  # (blocks, 64), zigzag order


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    h: int = 1
    v: int = 1

    def layout(self) -> None:
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        across, down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.wide, c.high = across * c.h, down * c.v
            c.own_wide, c.own_high = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.coef = np.zeros((c.wide * c.high, 64), np.int32)

    def order(self, c: Component, alone: bool) -> np.ndarray:
        """Indices of a component's blocks as a scan has them: row by row if it is alone in the scan,
        else one row for each minimum coded unit."""
        grid = np.arange(c.wide * c.high).reshape(c.high, c.wide)
        if alone:
            return grid[: c.own_high, : c.own_wide].reshape(-1, 1)
        return grid.reshape(c.high // c.v, c.v, c.wide // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.h * c.v)


# ---------------------------------------------------------------- Huffman codes


@dataclass
class Huffman:
    lengths: bytes  # codes of 1 .. 16 bits
    symbols: bytes

    def __post_init__(self):
        self.code: dict[int, tuple[int, int]] = {}
        code, at = 0, 0
        for n, many in enumerate(self.lengths, 1):
            for s in self.symbols[at : at + many]:
                self.code[s] = (n, code)
                code += 1
            at += many
            code <<= 1
        self.back = {x: s for s, x in self.code.items()}
        widths = {n + (s & 15) for s, (n, _) in self.code.items()}
        self.width = widths.pop() if len(widths) == 1 else 0

    @cached_property
    def values(self) -> np.ndarray | None:
        """For a code of fixed width without runs: the value of each word of that width."""
        if not 0 < self.width <= 16 or any(s >> 4 for s in self.code):
            return None
        out = np.zeros(1 << self.width, np.int32)
        for s, (_, code) in self.code.items():
            more = np.arange(1 << s)
            out[(code << s) + more] = np.where(more >> max(s - 1, 0), more, more - (1 << s) + 1) if s else 0
        return out


@lru_cache(maxsize=64)
def huffman(lengths: bytes, symbols: bytes) -> Huffman:
    return Huffman(lengths, symbols)


class Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def many(self, n: int) -> np.ndarray:
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, table: Huffman) -> int:
        code, back = 0, table.back
        for n in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (n, code) in back:
                return back[n, code]
        raise ValueError("not a Huffman code")

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


# ---------------------------------------------------------------- reading


@dataclass
class Scan:
    parts: list[tuple[Component, int, int]]  # component, DC table, AC table
    first: int
    last: int
    high: int
    low: int


def read(data: bytes) -> Image:
    """Coefficient arrays of all components, accumulated over the scans."""
    at, image, every = 2, None, 0
    quant, comments, tables = {}, [], {}
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(data):
        kind = data[at + 1]
        if data[at] != 0xFF or kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            comments.append(body)
        elif kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC2:
            parts = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts, quant, comments)
            image.layout()
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman JPEG")
        elif kind == 0xDD:
            every = int.from_bytes(body[:2], "big")
        elif kind == 0xDA:
            by_id = {c.ident: c for c in image.components}
            n = body[0]
            parts = [(by_id[body[1 + 2 * k]], body[2 + 2 * k] >> 4, 16 | body[2 + 2 * k] & 15) for k in range(n)]
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            found = _MARKER.search(data, at)
            stop = found.start() if found else len(data)
            _scan(image, Scan(parts, first, last, bits >> 4, bits & 15), tables, data[at:stop], every)
            at = stop
    return image


def _scan(image: Image, scan: Scan, tables: dict, data: bytes, every: int) -> None:
    alone = len(scan.parts) == 1
    orders = [image.order(c, alone) for c, _, _ in scan.parts]
    units = len(orders[0])
    pieces = _RESTART.split(data) if every else [data]
    for k, piece in enumerate(pieces):
        part = [o[k * every : (k + 1) * every] if every else o for o in orders]
        if len(part[0]) == 0 or units == 0:
            break
        bits = Bits(piece.replace(b"\xff\x00", b"\xff"))
        decode = (_dc_refine if scan.high else _dc_first) if scan.first == 0 else (_ac_refine if scan.high else _ac_first)
        decode(scan, part, tables, bits)


def _dc_first(scan: Scan, orders: list, tables: dict, bits: Bits) -> None:
    used = [tables[dc] for _, dc, _ in scan.parts]
    sizes = [o.shape[1] for o in orders]
    values = used[0].values
    if values is not None and all(t is used[0] or t.code == used[0].code for t in used):
        diffs = values[_words(bits, len(orders[0]) * sum(sizes), used[0].width)].reshape(-1, sum(sizes))
        at = 0
        for (c, _, _), order, n in zip(scan.parts, orders, sizes):
            c.coef[order.ravel(), 0] = np.cumsum(diffs[:, at : at + n].ravel()) << scan.low
            at += n
        return
    before = [0] * len(orders)
    for unit in range(len(orders[0])):
        for k, (c, _, _) in enumerate(scan.parts):
            for block in orders[k][unit].tolist():
                before[k] += bits.signed(bits.symbol(used[k]))
                c.coef[block, 0] = before[k] << scan.low


def _dc_refine(scan: Scan, orders: list, tables: dict, bits: Bits) -> None:
    sizes, at = [o.shape[1] for o in orders], 0
    got = bits.many(len(orders[0]) * sum(sizes)).reshape(-1, sum(sizes)).astype(np.int32)
    for (c, _, _), order, n in zip(scan.parts, orders, sizes):
        c.coef[order.ravel(), 0] |= got[:, at : at + n].ravel() << scan.low
        at += n


def _ac_first(scan: Scan, orders: list, tables: dict, bits: Bits) -> None:
    (c, _, ac), order = scan.parts[0], orders[0].ravel()
    table, width = tables[ac], scan.last - scan.first + 1
    if (values := table.values) is not None and 0 not in table.code:
        c.coef[order, scan.first : scan.last + 1] = (values[_words(bits, len(order) * width, table.width)] << scan.low).reshape(-1, width)
        return
    run = 0
    for block in order.tolist():
        if run:
            run -= 1
            continue
        k = scan.first
        while k <= scan.last:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                k += zeros
                c.coef[block, k] = bits.signed(size) * (1 << scan.low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _ac_refine(scan: Scan, orders: list, tables: dict, bits: Bits) -> None:
    (c, _, ac), order = scan.parts[0], orders[0].ravel()
    table, band, step = tables[ac], slice(scan.first, scan.last + 1), 1 << scan.low
    have = c.coef[order, band]
    if have.all() and not any(s & 15 or s == 0xF0 for s in table.code):  # only runs of blocks whose coefficients all exist
        at = 0
        while at < len(order):
            zeros = bits.symbol(table) >> 4
            many = (1 << zeros) + bits.take(zeros)
            part = have[at : at + many]
            part += np.sign(part) * bits.many(part.size).reshape(part.shape) * step
            at += many
        c.coef[order, band] = have
        return
    run = 0
    for block in order.tolist():
        row, k = c.coef[block], scan.first
        if not run:
            while k <= scan.last:
                zeros, size = divmod(bits.symbol(table), 16)
                new = 0
                if size:
                    new = step if bits.take(1) else -step
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= scan.last:
                    if row[k]:
                        row[k] += np.sign(row[k]) * bits.take(1) * step
                    elif zeros == 0:
                        row[k] = new
                        k += 1
                        break
                    else:
                        zeros -= 1
                    k += 1
        if run:
            for k in range(k, scan.last + 1):
                if row[k]:
                    row[k] += np.sign(row[k]) * bits.take(1) * step
            run -= 1


def _words(bits: Bits, n: int, width: int) -> np.ndarray:
    rows = bits.many(n * width).reshape(n, width)
    out = np.zeros(n, np.int32)
    for k in range(width):
        out <<= 1
        out |= rows[:, k]
    return out


def rgb(image: Image) -> np.ndarray:
    """(height, width, 3) uint8: inverse transform, chroma repeated to full resolution, YCbCr to RGB."""
    planes = []
    for c in image.components:
        x = c.coef.astype(np.float32) * image.quant[c.table].astype(np.float32)
        x = (x @ INVERSE).reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8) + 128
        x = np.clip(np.rint(x), 0, 255)
        planes.append(x.repeat(image.v // c.v, axis=0).repeat(image.h // c.h, axis=1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=2).astype(np.uint8)
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    # weights of ITU-R BT.601, as JFIF has them
    return np.clip(np.rint(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- writing


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


#: One symbol of each length: size s has WIDTH - s bits, so that s bits more make up WIDTH.
_DC = Huffman(bytes([1] * WIDTH + [0] * (16 - WIDTH)), bytes(range(WIDTH - 1, -1, -1)))
_AC = Huffman(bytes([1] * (WIDTH - 1) + [0] * (17 - WIDTH)), bytes(range(WIDTH - 1, 0, -1)))


def _word_of(table: Huffman) -> np.ndarray:
    """The word of each value, at value + 2 ** (WIDTH - 1)."""
    values, out = table.values, np.zeros(1 << WIDTH + 1, np.int32)
    for s, (n, code) in table.code.items():
        words = np.arange(code << s, (code + 1) << s)
        out[values[words] + (1 << WIDTH - 1)] = words
    return out


_DC_WORD, _AC_WORD = _word_of(_DC), _word_of(_AC)
_SHIFTS = np.arange(WIDTH - 1, -1, -1)


def _packed(words: np.ndarray) -> bytes:
    return np.packbits(((words.ravel()[:, None] >> _SHIFTS) & 1).astype(np.uint8)).tobytes()


def _as_scan(ids: list[int], first: int, last: int, bits: int, data: bytes) -> bytes:
    head = bytes([len(ids)]) + b"".join(bytes([i, 0]) for i in ids) + bytes([first, last, bits])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def write(image: Image) -> bytes:
    """A progressive file of coefficients from 2 to 257 (DC and AC): all but the lowest bit first, DC of all
    components together and AC in bands, then the lowest bits. The lowest AC bits follow runs of blocks that
    end at once, for no coefficient is new."""
    out = [b"\xff\xd8", *(_segment(0xFE, c) for c in image.comments)]
    out += [_segment(0xDB, bytes([k]) + bytes(q.tolist())) for k, q in image.quant.items()]
    frame = b"".join(bytes([c.ident, c.h << 4 | c.v, c.table]) for c in image.components)
    out.append(_segment(0xC2, bytes([8]) + image.height.to_bytes(2, "big") + image.width.to_bytes(2, "big") + bytes([len(image.components)]) + frame))
    out.append(_segment(0xC4, b"\x00" + _DC.lengths + _DC.symbols + b"\x10" + _AC.lengths + _AC.symbols))
    ids = [c.ident for c in image.components]
    half = [c.coef >> 1 for c in image.components]
    orders = [image.order(c, len(ids) == 1) for c in image.components]
    dc = np.concatenate([np.diff(x[o.ravel(), 0], prepend=0).reshape(o.shape) for x, o in zip(half, orders)], axis=1)
    out.append(_as_scan(ids, 0, 0, 0x01, _packed(_DC_WORD[dc + (1 << WIDTH - 1)])))
    for k, x in enumerate(half):
        for first, last in ((1, 5), (6, 63)) if k == 0 else ((1, 63),):
            out.append(_as_scan([ids[k]], first, last, 0x01, _packed(_AC_WORD[x[:, first : last + 1] + (1 << WIDTH - 1)])))
    low = [(c.coef & 1).astype(np.uint8) for c in image.components]
    out.append(_as_scan(ids, 0, 0, 0x10, np.packbits(np.concatenate([x[o.ravel(), 0].reshape(o.shape) for x, o in zip(low, orders)], axis=1)).tobytes()))
    for k, x in enumerate(low):
        runs = [min(MOST_BLOCKS, len(x) - at) for at in range(0, len(x), MOST_BLOCKS)]
        exps = [n.bit_length() - 1 for n in runs]
        kinds = sorted({e << 4 for e in exps})
        table = huffman(bytes([0, len(kinds)] + [0] * 14), bytes(kinds))
        bits, at = [], 0
        for n, e in zip(runs, exps):
            word = table.code[e << 4][1] << e | n - (1 << e)
            bits += [np.array([word >> j & 1 for j in range(1 + e, -1, -1)], np.uint8), x[at : at + n, 1:].ravel()]
            at += n
        out.append(_segment(0xC4, b"\x10" + table.lengths + table.symbols))
        out.append(_as_scan([ids[k]], 1, 63, 0x10, np.packbits(np.concatenate(bits)).tobytes()))
    return b"".join([*out, b"\xff\xd9"])
