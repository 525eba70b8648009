"""Progressive JPEG: a reader for any 8-bit Huffman-coded progressive file, and a writer that stores bytes in coefficients.

Reading: every scan adds to arrays of coefficients, one a component, be it a spectral selection's first pass or a refinement by one
bit (successive approximation). The arrays are dequantised, inverse-transformed in numpy, chroma is brought to full resolution and
RGB results.

The writer stores a payload losslessly in the format's own unit, the quantised coefficient: byte b is coefficient 256 + b, or, for
DC, 512 + b and -256 + b by turns, so that all coefficients and DC differences of a scan have the same magnitude category. Its
Huffman tables then hold a single code, every coefficient takes as many bits as the next, and both writing and reading are numpy
reshapes of bits, for all files of one shape together. ``decode`` notices such scans and reads all others bit by bit.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
UNIT = 192
MAX_MCUS_HIGH = 4095
MAX_RUN = 32767
#: (components, Ss, Se, Ah, Al) of the writer's scans
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)]


@dataclass
class Component:
    id: int
    h: int
    v: int
    tq: int
    wide: int = 0  # blocks in its own scans
    high: int = 0
    stride: int = 0  # blocks with padding to whole MCUs
    rows: int = 0


@dataclass
class Scan:
    comps: tuple[int, ...]
    tables: tuple[tuple[int, int], ...]
    ss: int
    se: int
    ah: int
    al: int
    data: bytes
    huff: dict
    restart: int


@dataclass
class File:
    width: int
    height: int
    comps: list[Component]
    quant: dict[int, np.ndarray]
    scans: list[Scan] = field(default_factory=list)

    def shape(self) -> tuple:
        return self.width, self.height, tuple((c.h, c.v) for c in self.comps), tuple((s.comps, s.ss, s.se, s.ah, s.al, len(s.data)) for s in self.scans)


def payload(data: bytes) -> bytes:
    """``data`` with blanks up to a positive multiple of 192 bytes."""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


# ---- reading


def parse(data: bytes) -> File:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    quant, huff, f, restart, i = {}, {}, None, 0, 2
    while i < len(data):
        if data[i] != 0xFF:
            raise ValueError("marker expected")
        m, i = data[i + 1], i + 2
        if m == 0xFF:
            i -= 1
            continue
        if m == 0xD9:
            break
        n = data[i] << 8 | data[i + 1]
        s, i = data[i + 2 : i + n], i + n
        if m == 0xDB:
            while s:
                wide, t = s[0] >> 4, s[0] & 15
                size = 128 if wide else 64
                quant[t] = np.frombuffer(s[1 : 1 + size], ">u2" if wide else "u1").astype(np.int32)
                s = s[1 + size :]
        elif m == 0xC4:
            while s:
                counts = s[1:17]
                k = sum(counts)
                huff[s[0] >> 4, s[0] & 15] = (bytes(counts), bytes(s[17 : 17 + k]))
                s = s[17 + k :]
        elif m == 0xC2:
            if s[0] != 8:
                raise ValueError("only 8-bit samples")
            high, wide = struct.unpack(">HH", s[1:5])
            comps = [Component(s[6 + 3 * k], s[7 + 3 * k] >> 4, s[7 + 3 * k] & 15, s[8 + 3 * k]) for k in range(s[5])]
            hm, vm = max(c.h for c in comps), max(c.v for c in comps)
            mw, mh = -(-wide // (8 * hm)), -(-high // (8 * vm))
            for c in comps:
                c.wide, c.high = -(-(-(-wide * c.h // hm)) // 8), -(-(-(-high * c.v // vm)) // 8)
                c.stride, c.rows = mw * c.h, mh * c.v
            f = File(wide, high, comps, quant)
        elif m in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a Huffman-coded progressive file")
        elif m == 0xDD:
            restart = struct.unpack(">H", s)[0]
        elif m == 0xDA:
            k = s[0]
            ids = {c.id: j for j, c in enumerate(f.comps)}
            sel = [(ids[s[1 + 2 * j]], (s[2 + 2 * j] >> 4, s[2 + 2 * j] & 15)) for j in range(k)]
            ss, se, a = s[1 + 2 * k : 4 + 2 * k]
            end = i
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            f.scans.append(Scan(tuple(x for x, _ in sel), tuple(t for _, t in sel), ss, se, a >> 4, a & 15, data[i:end], dict(huff), restart))
            i = end
    return f


class _Bits:
    """Bits of one entropy-coded segment, most significant first; ones after its end."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def one(self) -> int:
        b = self.bits[self.at] if self.at < len(self.bits) else 1
        self.at += 1
        return b

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.one()
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, codes: dict) -> int:
        v = 0
        for n in range(1, 17):
            v = v << 1 | self.one()
            if (n, v) in codes:
                return codes[n, v]
        raise ValueError("bad Huffman code")


def _codes(table: tuple[bytes, bytes]) -> dict:
    out, code, k = {}, 0, 0
    for n, count in enumerate(table[0], 1):
        for _ in range(count):
            out[n, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _blocks_of(f: File, s: Scan) -> list[list[tuple[int, int]]]:
    """Of each MCU the (component, block index) in coding order."""
    if len(s.comps) == 1:
        c = f.comps[s.comps[0]]
        return [[(s.comps[0], y * c.stride + x)] for y in range(c.high) for x in range(c.wide)]
    mw = f.comps[0].stride // f.comps[0].h
    mh = f.comps[0].rows // f.comps[0].v
    return [[(k, (my * f.comps[k].v + v) * f.comps[k].stride + mx * f.comps[k].h + h) for k in s.comps for v in range(f.comps[k].v) for h in range(f.comps[k].h)] for my in range(mh) for mx in range(mw)]


def read_scan(f: File, s: Scan, coefs: list[np.ndarray]) -> None:
    """Adds one scan to ``coefs`` bit by bit; any valid scan."""
    mcus = _blocks_of(f, s)
    parts = [s.data]
    if s.restart:
        parts, start, i = [], 0, 0
        while (i := s.data.find(b"\xff", i)) >= 0 and i + 1 < len(s.data):
            if 0xD0 <= s.data[i + 1] <= 0xD7:
                parts.append(s.data[start:i])
                start = i + 2
            i += 2
        parts.append(s.data[start:])
    tables = {k: (_codes(s.huff[0, t[0]]) if s.ss == 0 and not s.ah else None, _codes(s.huff[1, t[1]]) if s.ss else None) for k, t in zip(s.comps, s.tables, strict=True)}
    bit = 1 << s.al
    for p, part in enumerate(parts):
        r = _Bits(part)
        dc, run = defaultdict(int), 0
        for mcu in mcus[p * s.restart : (p + 1) * s.restart] if s.restart else mcus:
            for k, b in mcu:
                z = coefs[k][b]
                if s.ss == 0:
                    if s.ah:
                        z[0] |= bit * r.one()
                    else:
                        dc[k] += r.signed(r.symbol(tables[k][0]))
                        z[0] = dc[k] << s.al
                elif not s.ah:
                    if run:
                        run -= 1
                        continue
                    i = s.ss
                    while i <= s.se:
                        sym = r.symbol(tables[k][1])
                        zeros, size = sym >> 4, sym & 15
                        if size:
                            i += zeros
                            z[i] = r.signed(size) * bit
                            i += 1
                        elif zeros == 15:
                            i += 16
                        else:
                            run = (1 << zeros) + r.take(zeros) - 1
                            break
                else:
                    i = s.ss
                    while not run and i <= s.se:
                        sym = r.symbol(tables[k][1])
                        zeros, new = sym >> 4, 0
                        if sym & 15:
                            new = bit if r.one() else -bit
                        elif zeros < 15:
                            run = (1 << zeros) + r.take(zeros)
                            break
                        while i <= s.se:
                            if z[i]:
                                if r.one():
                                    z[i] += bit if z[i] > 0 else -bit
                            elif zeros:
                                zeros -= 1
                            else:
                                if new:
                                    z[i] = new
                                i += 1
                                break
                            i += 1
                    if run:
                        for i in range(i, s.se + 1):
                            if z[i] and r.one():
                                z[i] += bit if z[i] > 0 else -bit
                        run -= 1


# ---- scans whose codes all have one length, for many files of one shape


def _only(table: tuple[bytes, bytes] | None) -> int | None:
    return table[1][0] if table and table[0][0] == 1 and sum(table[0]) == 1 else None


def _even_scan(f: File, s: Scan, bits: np.ndarray, coefs: list[np.ndarray]) -> bool:
    """Adds the scan to (files, blocks, 64) arrays if every coefficient takes equally many bits; else False and nothing changes."""
    if s.restart or any(c.wide != c.stride or c.high != c.rows for c in f.comps):
        return False
    d = len(bits)
    order = _order(f, s)
    n = sum(len(x) for x in order)
    if s.ss == 0:
        if s.ah:
            if bits.shape[1] < n:
                return False
            at = 0
            for k, pos in zip(s.comps, order, strict=True):
                coefs[k][:, :, 0] |= bits[:, pos].astype(np.int16) << s.al
            return True
        size = {_only(s.huff.get((0, t[0]))) for t in s.tables}
        size = size.pop() if len(size) == 1 else None
        if not size or bits.shape[1] < n * (size + 1):
            return False
        cells = bits[:, : n * (size + 1)].reshape(d, n, size + 1)
        if cells[:, :, 0].any():
            return False
        v = _value(cells[:, :, 1:], size)
        for k, pos in zip(s.comps, order, strict=True):
            seq = np.argsort(pos)  # blocks of the component in coding order
            diffs = v[:, pos[seq]]
            back = np.empty_like(seq)
            back[seq] = np.arange(len(seq))
            coefs[k][:, :, 0] = (np.cumsum(diffs, 1)[:, back] << s.al).astype(np.int16)
        return True
    k, n = s.comps[0], len(order[0])
    width = s.se - s.ss + 1
    only = _only(s.huff.get((1, s.tables[0][1])))
    if only is None:
        return False
    if not s.ah:
        if only >> 4 or not only or bits.shape[1] < n * width * (only + 1):
            return False
        cells = bits[:, : n * width * (only + 1)].reshape(d, n, width, only + 1)
        if cells[..., 0].any():
            return False
        coefs[k][:, :, s.ss : s.se + 1] = _value(cells[..., 1:], only) << s.al
        return True
    zeros = only >> 4
    band = coefs[k][:, :, s.ss : s.se + 1]
    if only & 15 or zeros == 15 or not (band > 0).all():
        return False
    added, at, done, head = np.empty(band.shape, np.uint8), 0, 0, 1 + zeros
    while done < n:
        if bits.shape[1] < at + head or bits[:, at].any():
            return False
        runs = (1 << zeros) + (_magnitude(bits[:, at + 1 : at + head]) if zeros else np.zeros(d, np.int32))
        run, at = int(runs[0]), at + head
        if (runs != run).any() or done + run > n or bits.shape[1] < at + run * width:
            return False
        added[:, done : done + run] = bits[:, at : at + run * width].reshape(d, run, width)
        done, at = done + run, at + run * width
    band += added.astype(np.int16) << s.al
    return True


def _magnitude(b: np.ndarray) -> np.ndarray:
    v = np.zeros(b.shape[:-1], np.int16 if b.shape[-1] < 15 else np.int32)
    for i in range(b.shape[-1]):
        v <<= 1
        v |= b[..., i]
    return v


def _value(b: np.ndarray, size: int) -> np.ndarray:
    v = _magnitude(b)
    return np.where(b[..., 0] == 1, v, v - (1 << size) + 1)


def _order(f: File, s: Scan) -> list[np.ndarray]:
    """Of each component the place of its blocks, in raster order, within the scan."""
    if len(s.comps) == 1:
        c = f.comps[s.comps[0]]
        return [np.arange(c.stride * c.rows)]
    per = sum(f.comps[k].h * f.comps[k].v for k in s.comps)
    out, at = [], 0
    for k in s.comps:
        c = f.comps[k]
        y, x = np.divmod(np.arange(c.stride * c.rows), c.stride)
        out.append(((y // c.v) * (c.stride // c.h) + x // c.h) * per + at + (y % c.v) * c.h + x % c.h)
        at += c.h * c.v
    return out


def _bits_of(scans: list[Scan]) -> np.ndarray:
    parts = [s.data.replace(b"\xff\x00", b"\xff") for s in scans]
    n = min(map(len, parts))
    return np.unpackbits(np.frombuffer(b"".join(p[:n] for p in parts), np.uint8).reshape(len(parts), n), axis=1)


def coefficients(files: list[File]) -> list[np.ndarray]:
    """Of files of one shape: an array (files, blocks, 64 in zigzag order) a component."""
    f = files[0]
    coefs = [np.zeros((len(files), c.stride * c.rows, 64), np.int16) for c in f.comps]
    for i, s in enumerate(f.scans):
        scans = [x.scans[i] for x in files]
        if all(x.huff == s.huff and x.tables == s.tables and x.restart == s.restart for x in scans) and _even_scan(f, s, _bits_of(scans), coefs):
            continue
        for j, x in enumerate(files):
            read_scan(x, x.scans[i], [c[j] for c in coefs])
    return coefs


def by_shape(datas: list[bytes]) -> list[tuple[list[int], list[File]]]:
    """Files that can be read together: indexes and parsed files."""
    groups: dict = defaultdict(lambda: ([], []))
    for i, data in enumerate(datas):
        f = parse(data)
        w, h, comps, scans = f.shape()
        got = groups[w, h, comps, tuple(x[:5] for x in scans), tuple(sorted((k, v.tobytes()) for k, v in f.quant.items()))]
        got[0].append(i)
        got[1].append(f)
    return list(groups.values())


_BASIS = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_SCALE = 2**15
#: Inverse transform of a block in zigzag order as one matrix of whole numbers: sums in doubles are exact, in whatever order BLAS adds.
_IDCT = np.rint(_SCALE * np.array([np.outer(_BASIS[i // 8], _BASIS[i % 8]).ravel() for i in ZIGZAG]))


def rgb(f: File, coefs: list[np.ndarray]) -> np.ndarray:
    """(files, height, width, 3) bytes from coefficients of one shape."""
    hm, vm = max(c.h for c in f.comps), max(c.v for c in f.comps)
    planes = []
    for c, z in zip(f.comps, coefs, strict=True):
        d = len(z)
        x = (((z.reshape(-1, 64).astype(np.float64) * f.quant[c.tq]) @ _IDCT) / _SCALE).astype(np.float32)
        x = x.reshape(d, c.rows, c.stride, 8, 8).transpose(0, 1, 3, 2, 4).reshape(d, c.rows * 8, c.stride * 8) + 128
        np.clip(x, 0, 255, out=x)
        planes.append(x.repeat(vm // c.v, 1).repeat(hm // c.h, 2)[:, : f.height, : f.width])
    if len(planes) == 1:
        return np.repeat(np.rint(planes[0]).astype(np.uint8)[..., None], 3, -1)
    y, cb, cr = planes
    out = np.empty((*y.shape, 3), np.float32)
    out[..., 0] = y + 1.402 * (cr - 128)
    out[..., 1] = y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)
    out[..., 2] = y + 1.772 * (cb - 128)
    np.rint(np.clip(out, 0, 255, out=out), out=out)
    return out.astype(np.uint8)


# ---- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, t: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | t, 1, *[0] * 15, symbol]))


def layout(units: int) -> tuple[int, int]:
    """MCUs across and down for so many units of 192 bytes; a 4:2:0 MCU holds two."""
    mcus = -(-units // 2)
    across = -(-mcus // MAX_MCUS_HIGH)
    return across, -(-mcus // across)


def _dc_base(order: list[np.ndarray]) -> list[np.ndarray]:
    """Of each component the DC offsets by block: 512 and -256 by turns in coding order."""
    out = []
    for pos in order:
        turn = np.argsort(np.argsort(pos)) % 2
        out.append(np.where(turn == 0, 512, -256).astype(np.int16))
    return out


def _frame(across: int, down: int) -> File:
    comps = [Component(k + 1, 2 if k == 0 else 1, 2 if k == 0 else 1, 0) for k in range(3)]
    for c in comps:
        c.wide = c.stride = across * c.h
        c.high = c.rows = down * c.v
    return File(across * 16, down * 16, comps, {0: np.ones(64, np.int32)})


def _split(f: File, cells: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([c.stride * c.rows for c in f.comps])[:-1]
    return np.split(cells, ends, axis=1)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive file for each payload (a positive multiple of 192 bytes)."""
    out: list[bytes] = [b""] * len(payloads)
    groups = defaultdict(list)
    for i, p in enumerate(payloads):
        groups[len(p)].append(i)
    for size, which in groups.items():
        across, down = layout(size // UNIT)
        f = _frame(across, down)
        room = across * down * 6 * 64
        raw = np.zeros((len(which), room), np.uint8)
        raw[:, :size] = np.frombuffer(b"".join(payloads[i] for i in which), np.uint8).reshape(len(which), size)
        parts = _split(f, raw.reshape(len(which), -1, 64))
        inter = _order(f, Scan((0, 1, 2), ((0, 0),) * 3, 0, 0, 0, 1, b"", {}, 0))
        bases = _dc_base(inter)
        dc = np.empty((len(which), across * down * 6), np.int16)
        for pos, base, z in zip(inter, bases, parts, strict=True):
            dc[:, pos] = base + z[:, :, 0]
        head = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC2, struct.pack(">BHHB", 8, f.height, f.width, 3) + b"".join(bytes([c.id, c.h << 4 | c.v, 0]) for c in f.comps)) + _table(0, 0, 9)
        pieces: list[list[bytes]] = [[head] for _ in which]
        for comps, ss, se, ah, al in SCRIPT:
            table = b""
            if ss == 0 and not ah:
                v = np.empty_like(dc)
                half = dc >> 1
                for pos in inter:
                    seq = np.sort(pos)
                    v[:, seq] = np.diff(half[:, seq], axis=1, prepend=np.int16(0))
                bits = _cells(v, 9)
            elif ss == 0:
                bits = (dc & 1).astype(np.uint8)
            elif not ah:
                bits = _cells((256 + parts[comps[0]][:, :, ss : se + 1].astype(np.int16)) >> 1, 8)
                table = _table(1, 0, 8)
            else:
                low = parts[comps[0]][:, :, ss : se + 1] & 1
                chunks = []
                for at, run in _runs(low.shape[1]):
                    zeros = run.bit_length() - 1
                    prefix = np.array([0, *(run >> b & 1 for b in range(zeros - 1, -1, -1))], np.uint8)
                    chunks += [np.broadcast_to(prefix, (len(which), len(prefix))), low[:, at : at + run].reshape(len(which), -1)]
                bits = np.concatenate(chunks, axis=1)
                table = _table(1, 0, zeros << 4)
            pad = -bits.shape[1] % 8
            packed = np.packbits(np.pad(bits, ((0, 0), (0, pad)), constant_values=1), axis=1)
            n = packed.shape[1]
            data = packed.tobytes()
            sos = table + _segment(0xDA, bytes([len(comps), *(x for k in comps for x in (k + 1, 0)), ss, se, ah << 4 | al]))
            for j, p in enumerate(pieces):
                p.append(sos)
                p.append(data[j * n : (j + 1) * n].replace(b"\xff", b"\xff\x00"))
        for i, p in zip(which, pieces, strict=True):
            out[i] = b"".join(p) + b"\xff\xd9"
    return out


def _runs(n: int) -> list[tuple[int, int]]:
    """End-of-band runs over n blocks as (first, blocks), of one magnitude category: several are of 16384 blocks or more."""
    k = -(-n // MAX_RUN)
    edges = [n * i // k for i in range(k + 1)]
    return [(x, y - x) for x, y in zip(edges, edges[1:], strict=False)]


def _cells(v: np.ndarray, size: int) -> np.ndarray:
    """Code 0 and ``size`` magnitude bits of each value, as rows of bits."""
    m = np.where(v > 0, v, v + (1 << size) - 1).astype(np.uint16)
    b = np.zeros((*v.shape, size + 1), np.uint8)
    for i in range(size):
        b[..., 1 + i] = m >> (size - 1 - i) & 1
    return b.reshape(len(v), -1)


def stored_payload(f: File, coefs: list[np.ndarray], size: int) -> np.ndarray:
    """(files, size) bytes back from coefficients."""
    order = _order(f, Scan(tuple(range(len(f.comps))), ((0, 0),) * len(f.comps), 0, 0, 0, 0, b"", {}, 0))
    out = []
    for base, z in zip(_dc_base(order), coefs, strict=True):
        b = z - 256
        b[:, :, 0] = z[:, :, 0] - base
        out.append(b)
    return np.concatenate(out, axis=1).reshape(len(coefs[0]), -1)[:, :size].astype(np.uint8)
