"""Bytes of WAL files and of LTX change files."""

from __future__ import annotations

import heapq
import itertools
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa

from ..errors import BadCompression, BadIndex, BadMagic, BadPageNumber, BadPageSize, BadTxidRange, BadVarint, BadVersion, ChecksumMismatch, FormatError, NotContiguous, PageOutOfOrder, PrevFrameMismatch, Truncated, UnalignedOffset  # noqa: F401
from ..functions import checksums as cs

#: Fixed values of the two formats.
WAL_HEADER, FRAME_HEADER = 32, 24
WAL_MAGIC_LITTLE, WAL_MAGIC_BIG, WAL_VERSION = 0x377F0682, 0x377F0683, 3007000
LTX_MAGIC, LTX_HEADER, PAGE_HEADER, TRAILER = b"LTX1", 100, 6, 16
NO_CHECKSUM = 2
BLOCK = 1
PENDING_BYTE = 0x40000000
FRAMES_A_BLOCK = 1024
_LTX = struct.Struct(">4sIIIQQqQqqIIQ20x")


def is_page_size(n: int) -> bool:
    return 512 <= n <= 65536 and not n & n - 1


def lock_page(page_size: int) -> int:
    return PENDING_BYTE // page_size + 1


# ---- WAL


@dataclass(frozen=True)
class WalHeader:
    big: bool
    page_size: int
    seq: int
    salt1: int
    salt2: int
    checksum1: int
    checksum2: int

    @property
    def frame_size(self) -> int:
        return FRAME_HEADER + self.page_size


def wal_header(data: bytes) -> WalHeader:
    if len(data) < WAL_HEADER:
        raise Truncated(f"a WAL header has {WAL_HEADER} bytes, not {len(data)}")
    magic, version, page_size, seq, salt1, salt2, c1, c2 = struct.unpack(">8I", data[:WAL_HEADER])
    if magic not in (WAL_MAGIC_LITTLE, WAL_MAGIC_BIG):
        raise BadMagic(f"WAL magic {magic:08x}")
    if version != WAL_VERSION:
        raise BadVersion(f"WAL version {version}")
    if not is_page_size(page_size):
        raise BadPageSize(f"page size {page_size}")
    big = magic == WAL_MAGIC_BIG
    if cs.wal_checksum(data[:24], (0, 0), big) != (c1, c2):
        raise ChecksumMismatch("WAL header")
    return WalHeader(big, page_size, seq, salt1, salt2, c1, c2)


@dataclass(frozen=True)
class Frame:
    frame_no: int
    offset: int
    pgno: int
    commit: int
    salt1: int
    salt2: int
    checksum1: int
    checksum2: int
    data: bytes
    ok: bool


def wal_frames(header: WalHeader, tail: bytes, base: int = WAL_HEADER, seed: tuple[int, int] | None = None) -> list[Frame]:
    """Whole frames in ``tail``, which begins at file offset ``base``; torn bytes at the end are left.

    ``ok`` says that salts match the header and the stored checksum follows from the one stored before. As the stored
    predecessor equals the running value as long as all frames before are ok, every frame can be judged by itself.
    """
    if (base - WAL_HEADER) % header.frame_size:
        raise UnalignedOffset(str(base))
    n = len(tail) // header.frame_size
    if not n:
        return []
    seed = seed or (header.checksum1, header.checksum2)
    rows = np.frombuffer(tail, np.uint8, n * header.frame_size).reshape(n, -1)
    heads = np.ascontiguousarray(rows[:, :24]).view(">u4").astype(np.uint32)
    seeds = np.concatenate([np.array([seed], np.uint32), heads[:-1, 4:6]])
    s0, s1 = cs.wal_checksums(np.concatenate([rows[:, :8], rows[:, 24:]], axis=1), seeds, header.big)
    ok = (heads[:, 2] == header.salt1) & (heads[:, 3] == header.salt2) & (s0 == heads[:, 4]) & (s1 == heads[:, 5])
    first = (base - WAL_HEADER) // header.frame_size
    return [Frame(first + i, base + i * header.frame_size, *(int(x) for x in heads[i]), rows[i, 24:].tobytes(), bool(ok[i])) for i in range(n)]


def wal_frames_from(data: bytes, offset: int) -> list[Frame]:
    """Frames from ``offset`` on, seeded by the frame before it, whose salts must be the header's."""
    h = wal_header(data)
    if offset <= WAL_HEADER:
        return wal_frames(h, data[WAL_HEADER:])
    if (offset - WAL_HEADER) % h.frame_size:
        raise UnalignedOffset(str(offset))
    before = data[offset - h.frame_size : offset]
    if len(before) < h.frame_size or struct.unpack(">2I", before[8:16]) != (h.salt1, h.salt2):
        raise PrevFrameMismatch(str(offset))
    return wal_frames(h, data[offset:], offset, struct.unpack(">2I", before[16:24]))


def frame_blocks(header: WalHeader, file: BinaryIO, start: int, seed: tuple[int, int] | None, end: int | None = None) -> Iterator[list[Frame]]:
    """Frames of an open WAL from an offset on (to ``end``), ``FRAMES_A_BLOCK`` at a time."""
    while True:
        n = FRAMES_A_BLOCK * header.frame_size
        file.seek(start)
        block = wal_frames(header, file.read(n if end is None else min(n, end - start)), start, seed)
        if not block:
            return
        yield block
        seed, start = (block[-1].checksum1, block[-1].checksum2), block[-1].offset + header.frame_size


def seed_before(header: WalHeader, file: BinaryIO, offset: int) -> tuple[int, int] | None:
    """Checksum that the frame at ``offset`` starts from, stored with the frame before it, whose salts must be the header's; None at the first."""
    if offset <= WAL_HEADER:
        return None
    if (offset - WAL_HEADER) % header.frame_size:
        raise UnalignedOffset(str(offset))
    file.seek(offset - header.frame_size)
    before = file.read(FRAME_HEADER)
    if len(before) < FRAME_HEADER or struct.unpack(">2I", before[8:16]) != (header.salt1, header.salt2):
        raise PrevFrameMismatch(str(offset))
    return struct.unpack(">2I", before[16:24])


def committed_offsets(header: WalHeader, file: BinaryIO, start: int = WAL_HEADER) -> tuple[dict[int, int], int, int]:
    """(offset of the newest committed frame of each page, the database's size in pages, the offset after the last committed frame), from ``start`` on; {}, 0, 0 if nothing is committed.

    Only what follows ``start`` is read, a block at a time; memory holds an offset a changed page.
    """
    done: dict[int, int] = {}
    open_: dict[int, int] = {}
    size = end = 0
    for block in frame_blocks(header, file, start, seed_before(header, file, start)):
        for f in block:
            if not f.ok:
                return {k: v for k, v in sorted(done.items()) if k <= size}, size, end
            open_[f.pgno] = f.offset
            if f.commit:
                done |= open_
                open_, size, end = {}, f.commit, f.offset + header.frame_size
    return {k: v for k, v in sorted(done.items()) if k <= size}, size, end


def page_map(header: WalHeader, frames: list[Frame]) -> tuple[dict[int, Frame], int, int]:
    """Newest committed frame of each page, the database's size in pages and the offset after the last committed frame (0, 0 if none)."""
    good: list[Frame] = []
    for f in frames:
        if not f.ok:
            break
        good.append(f)
    last = max((i for i, f in enumerate(good) if f.commit), default=-1)
    if last < 0:
        return {}, 0, 0
    size = good[last].commit
    newest = {f.pgno: f for f in good[: last + 1]}
    return {k: v for k, v in sorted(newest.items()) if k <= size}, size, good[last].offset + header.frame_size


def wal_head(page_size: int, salts: tuple[int, int], big: bool = False) -> tuple[bytes, tuple[int, int]]:
    """(a WAL's header, the checksum that its first frame goes on from)."""
    head = struct.pack(">6I", WAL_MAGIC_BIG if big else WAL_MAGIC_LITTLE, WAL_VERSION, page_size, 0, *salts)
    seed = cs.wal_checksum(head, (0, 0), big)
    return head + struct.pack(">2I", *seed), seed


def checked_rows(pgno: np.ndarray, commit: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """Of each frame the bytes that its checksum is over: page number, commit size, page."""
    head = np.stack([pgno, commit], axis=1).astype(">u4").view(np.uint8)
    return np.concatenate([head, pages], axis=1)


def wal_part(rows: np.ndarray, salts: tuple[int, int], seed: tuple[int, int], big: bool = False) -> np.ndarray:
    """Frames of ``checked_rows`` that follow each other, a row each; ``seed`` is the checksum before the first."""
    rest = np.empty((len(rows), 4), np.uint32)
    rest[:, :2] = salts
    rest[:, 2], rest[:, 3] = cs.wal_chain(rows, seed, big)
    return np.concatenate([rows[:, :8], rest.astype(">u4").view(np.uint8), rows[:, 8:]], axis=1)


def write_wal(frames: Iterable[tuple[int, int, bytes]], page_size: int, salts: tuple[int, int], big: bool = False) -> bytes:
    """A WAL of (pgno, commit, data); each frame's checksum goes on from the one before."""
    head, seed = wal_head(page_size, salts, big)
    out = [head]
    for pgno, commit, data in frames:
        first = struct.pack(">2I", pgno, commit)
        seed = cs.wal_checksum_of(first + data, seed, big)
        out += [first, struct.pack(">4I", *salts, *seed), data]
    return b"".join(out)


# ---- LTX


@dataclass(frozen=True)
class LtxHeader:
    flags: int
    page_size: int
    commit: int
    min_txid: int
    max_txid: int
    timestamp: int
    pre_apply_checksum: int = 0
    wal_offset: int = 0
    wal_size: int = 0
    wal_salt1: int = 0
    wal_salt2: int = 0
    node_id: int = 0

    @property
    def is_snapshot(self) -> bool:
        return self.min_txid == 1

    def validate(self) -> LtxHeader:
        if not is_page_size(self.page_size):
            raise BadPageSize(f"page size {self.page_size}")
        if not 0 < self.min_txid <= self.max_txid:
            raise BadTxidRange(f"transactions {self.min_txid} to {self.max_txid}")
        if self.is_snapshot and self.pre_apply_checksum:
            raise ChecksumMismatch("a snapshot has no checksum before it")
        return self

    def encode(self) -> bytes:
        return _LTX.pack(LTX_MAGIC, self.flags, self.page_size, self.commit, self.min_txid, self.max_txid, self.timestamp, self.pre_apply_checksum, self.wal_offset, self.wal_size, self.wal_salt1, self.wal_salt2, self.node_id)


def ltx_header(data: bytes) -> LtxHeader:
    if len(data) < LTX_HEADER:
        raise Truncated(f"an LTX header has {LTX_HEADER} bytes, not {len(data)}")
    magic, *fields = _LTX.unpack(data[:LTX_HEADER])
    if magic != LTX_MAGIC:
        raise BadMagic(f"LTX magic {magic!r}")
    h = LtxHeader(*fields)
    if not is_page_size(h.page_size):
        raise BadPageSize(f"page size {h.page_size}")
    return h


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadVarint("cut off or too long")
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def index_range(tail: bytes, size: int) -> tuple[int, int]:
    """(start, length) of the page index, from a file's last 24 bytes and its size."""
    n = struct.unpack(">Q", tail[-24:-16])[0]
    start = size - TRAILER - 8 - n
    if start < LTX_HEADER:
        raise BadIndex("longer than the file")
    return start, n


def iter_index(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(pgno, offset, size) of an encoded index, one by one."""
    at = 0
    while True:
        pgno, at = read_uvarint(data, at)
        if not pgno:
            return
        offset, at = read_uvarint(data, at)
        size, at = read_uvarint(data, at)
        yield pgno, offset, size


def page_index(data: bytes) -> list[tuple[int, int, int]]:
    return list(iter_index(data))


def page_frame(frame: bytes, page_size: int) -> tuple[int, bytes]:
    """(pgno, data) of one stored page, compressed as an LZ4 frame or, by its flag, as a sized LZ4 block."""
    pgno, flags = struct.unpack(">IH", frame[:PAGE_HEADER])
    if not pgno:
        raise BadPageNumber("0")
    try:
        if flags & BLOCK:
            n = struct.unpack(">I", frame[6:10])[0]
            return pgno, pa.Codec("lz4_raw").decompress(frame[10 : 10 + n], page_size).to_pybytes()
        return pgno, pa.Codec("lz4").decompress(frame[PAGE_HEADER:], page_size).to_pybytes()
    except (OSError, pa.ArrowException) as e:
        raise BadCompression(f"page {pgno} can't be decompressed") from e


@dataclass(frozen=True)
class LtxFile:
    header: LtxHeader
    pages: list[tuple[int, bytes]]
    index: list[tuple[int, int, int]]
    post_apply_checksum: int
    file_checksum: int


def read_ltx(data: bytes, verify: bool = True) -> LtxFile:
    """A whole file, pages by number; ``verify`` recomputes the file's checksum."""
    h = ltx_header(data)
    start, n = index_range(data[-24:], len(data))
    index = page_index(data[start : start + n])
    pages = [page_frame(data[o : o + s], h.page_size) for _, o, s in index]
    post, stored = struct.unpack(">QQ", data[-TRAILER:])
    if verify:
        by_offset = sorted(zip(index, pages, strict=True), key=lambda x: x[0][1])
        if _file_checksum(data[:LTX_HEADER], [(data[o : o + PAGE_HEADER], p[1]) for (_, o, _), p in by_offset], data[start - PAGE_HEADER : -8]) != stored:
            raise ChecksumMismatch("LTX file")
        if h.is_snapshot and not h.flags & NO_CHECKSUM and cs.rolling(cs.page_checksums([p for p, _ in pages], [d for _, d in pages])) != post and pages:
            raise ChecksumMismatch("pages")
    return LtxFile(h, sorted(pages), index, post, stored)


def _file_checksum(head: bytes, pages: Iterable[tuple[bytes, bytes]], rest: bytes) -> int:
    """Over header, page headers with uncompressed data, and all that follows; from the pages' own checksums."""
    c = cs.crc64(head)
    for heads, data in _batches(pages):
        c = _with_pages(c, heads, data)
    return cs.combine(c, cs.crc64(rest), len(rest)) | cs.FLAG


#: Pages whose checksums are computed together.
BATCH = 256


def _batches(pages: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    pages = iter(pages)
    while got := list(itertools.islice(pages, BATCH)):
        yield [h for h, _ in got], [d for _, d in got]


def _page_crcs(heads: list[bytes], data: list[bytes]) -> tuple[list[int], int]:
    """CRC of each page header with its data, and their length."""
    rows = np.frombuffer(b"".join(h + d for h, d in zip(heads, data, strict=True)), np.uint8).reshape(len(heads), -1)
    return [int(x) for x in cs.crc64_rows(rows)], rows.shape[1]


def _with_pages(c: int, heads: list[bytes], data: list[bytes]) -> int:
    crcs, n = _page_crcs(heads, data)
    for x in crcs:
        c = cs.combine(c, x, n)
    return c


def write_ltx_to(write: Callable[[bytes], object], header: LtxHeader, pages: Iterable[tuple[int, bytes]], post_apply: int | Callable[[], int] = 0) -> int:
    """Writes a file of pages in rising order, piece by piece, and returns its size; a snapshot needs them all but the lock page.

    Memory holds ``BATCH`` pages and the page index. ``post_apply`` may be a function, asked once all pages are through.
    """
    header.validate()
    lock, last, n, head = lock_page(header.page_size), 0, LTX_HEADER, header.encode()
    write(head)
    c, packed = cs.crc64(head), bytearray()

    def checked() -> Iterator[tuple[bytes, bytes]]:
        nonlocal last
        for pgno, data in pages:
            if len(data) != header.page_size:
                raise BadPageSize(f"page {pgno} has {len(data)} bytes")
            if pgno < 1 or pgno > header.commit or pgno == lock:
                raise BadPageNumber(f"{pgno} of {header.commit}")
            due = last + 1 + (last + 1 == lock)
            if pgno <= last or header.is_snapshot and pgno != due:
                raise PageOutOfOrder(f"{pgno} after {last}")
            last = pgno
            yield struct.pack(">IH", pgno, 0), bytes(data)

    for heads, data in _batches(checked()):
        c = _with_pages(c, heads, data)
        for h, d in zip(heads, data, strict=True):
            body = pa.Codec("lz4").compress(d, asbytes=True)
            write(h)
            write(body)
            for x in (int.from_bytes(h[:4], "big"), n, PAGE_HEADER + len(body)):
                packed += uvarint(x)
            n += PAGE_HEADER + len(body)
    packed += uvarint(0)
    rest = bytes(PAGE_HEADER) + bytes(packed) + struct.pack(">QQ", len(packed), post_apply() if callable(post_apply) else post_apply)
    write(rest)
    write(struct.pack(">Q", cs.combine(c, cs.crc64(rest), len(rest)) | cs.FLAG))
    return n + len(rest) + 8


def write_ltx(header: LtxHeader, pages: Iterable[tuple[int, bytes]], post_apply: int | Callable[[], int] = 0) -> bytes:
    """``write_ltx_to`` in memory."""
    out: list[bytes] = []
    write_ltx_to(out.append, header, pages, post_apply)
    return b"".join(out)


def verify_ltx(read: Callable[[int, int], bytes], size: int) -> LtxHeader:
    """Recomputes a stored file's checksum by ranged reads; memory holds ``BATCH`` pages and the page index."""
    head = read(0, LTX_HEADER)
    h = ltx_header(head)
    start, n = index_range(read(size - 24, 24), size)
    c, places = cs.crc64(head), sorted(page_index(read(start, n)), key=lambda x: x[1])
    stored = ((f := read(o, s))[:PAGE_HEADER] + page_frame(f, h.page_size)[1] for _, o, s in places)
    for heads, data in _batches((x[:PAGE_HEADER], x[PAGE_HEADER:]) for x in stored):
        c = _with_pages(c, heads, data)
    rest = read(start - PAGE_HEADER, size - 8 - (start - PAGE_HEADER))
    if cs.combine(c, cs.crc64(rest), len(rest)) | cs.FLAG != struct.unpack(">Q", read(size - 8, 8))[0]:
        raise ChecksumMismatch("LTX file")
    return h


def snapshot_to(write: Callable[[bytes], object], page: Callable[[int], bytes], commit: int, page_size: int, max_txid: int, timestamp: int) -> int:
    """Writes a checksummed snapshot of a database of ``commit`` pages, which ``page`` gives one by one, and returns its size."""
    lock, post = lock_page(page_size), 0

    def pages() -> Iterator[tuple[int, bytes]]:
        nonlocal post
        numbers = (i for i in range(1, commit + 1) if i != lock)
        while some := list(itertools.islice(numbers, BATCH)):
            data = [page(i) for i in some]
            post ^= cs.rolling(cs.page_checksums(some, data)) ^ cs.FLAG
            yield from zip(some, data, strict=True)

    return write_ltx_to(write, LtxHeader(0, page_size, commit, 1, max_txid, timestamp), pages(), lambda: post | cs.FLAG)


def write_snapshot(image: bytes, page_size: int, max_txid: int, timestamp: int) -> bytes:
    """A checksummed snapshot of a whole database image."""
    out: list[bytes] = []
    snapshot_to(out.append, lambda i: image[(i - 1) * page_size : i * page_size], len(image) // page_size, page_size, max_txid, timestamp)
    return b"".join(out)


def read_snapshot(data: bytes) -> bytes:
    f = read_ltx(data)
    lock = lock_page(f.header.page_size)
    if [p for p, _ in f.pages] != [i for i in range(1, f.header.commit + 1) if i != lock]:
        raise PageOutOfOrder("not a whole snapshot")
    return image(f.pages, f.header.page_size, f.header.commit)


def image(pages: Iterable[tuple[int, bytes]], page_size: int, commit: int) -> bytes:
    out = bytearray(commit * page_size)
    for pgno, data in pages:
        if pgno <= commit:
            out[(pgno - 1) * page_size : pgno * page_size] = data
    return bytes(out)


def merge_header(headers: list[LtxHeader]) -> LtxHeader:
    """Header of a merge of files in order, which must be contiguous and of one page size."""
    if not headers:
        raise NotContiguous("nothing to merge")
    for a, b in zip(headers, headers[1:], strict=False):
        if b.page_size != a.page_size:
            raise BadPageSize(f"page size {b.page_size}")
        if b.min_txid > a.max_txid + 1 or b.max_txid <= a.max_txid:
            raise NotContiguous(f"{a.min_txid}-{a.max_txid} then {b.min_txid}-{b.max_txid}")
    first, last = headers[0], headers[-1]
    return LtxHeader(NO_CHECKSUM, first.page_size, last.commit, first.min_txid, last.max_txid, last.timestamp)


Stored = tuple[Callable[[int, int], bytes], int]


def merge_to(write: Callable[[bytes], object], files: list[Stored], verify: bool = True) -> LtxHeader:
    """Writes the merge of stored files (ranged read, size), oldest first: of each page the last version.

    A file that shrinks the database drops what lies beyond its size. Memory holds the files' packed indexes and ``BATCH`` pages.
    """
    headers = [verify_ltx(read, size) if verify else ltx_header(read(0, LTX_HEADER)) for read, size in files]
    header = merge_header(headers)
    # a version counts only up to the smallest size at or after it
    limits = list(itertools.accumulate((h.commit for h in reversed(headers)), min))[::-1]

    def places(k: int) -> Iterator[tuple[int, int, int, int]]:
        read, size = files[k]
        for pgno, offset, length in iter_index(read(*index_range(read(size - 24, 24), size))):
            if pgno <= limits[k]:
                yield pgno, -k, offset, length

    def pages() -> Iterator[tuple[int, bytes]]:
        lock, blank, last = lock_page(header.page_size), bytes(header.page_size), 0

        def blanks(end: int) -> Iterator[tuple[int, bytes]]:  # pages that came back without being written
            if header.is_snapshot:
                yield from ((i, blank) for i in range(last + 1, end) if i != lock)

        for pgno, k, offset, length in heapq.merge(*(places(k) for k in range(len(files)))):
            if pgno != last:
                yield from blanks(pgno)
                yield pgno, page_frame(files[-k][0](offset, length), header.page_size)[1]
                last = pgno
        yield from blanks(header.commit + 1)

    write_ltx_to(write, header, pages())
    return header


def in_memory(data: bytes) -> Stored:
    return lambda offset, length: data[offset : offset + length], len(data)


def merge(files: list[bytes]) -> bytes:
    """``merge_to`` in memory."""
    out: list[bytes] = []
    merge_to(out.append, [in_memory(x) for x in files])
    return b"".join(out)


def iter_pages(read_range, size: int, wanted: set[int] | None = None) -> Iterator[tuple[int, bytes]]:
    """Pages of a stored file by ranged reads; only ``wanted`` ones if given."""
    h = ltx_header(read_range(0, LTX_HEADER))
    start, n = index_range(read_range(size - 24, 24), size)
    for pgno, offset, length in iter_index(read_range(start, n)):
        if wanted is None or pgno in wanted:
            yield page_frame(read_range(offset, length), h.page_size)
