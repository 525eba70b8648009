import os
import random
import sqlite3

import pytest

from palimpsest import errors
from palimpsest.errors import ChecksumMismatch, FormatError, NotContiguous, PageOutOfOrder, UnalignedOffset
from palimpsest.functions import checksums as cs
from palimpsest.sources import formats as fmt

PAGE = 512


def test_crc64_check_value_and_parts():
    assert cs.crc64(b"123456789") == 0xB90956C775A41001
    data = random.Random(1).randbytes(5000)
    for at in (0, 1, 10, 1024, 4999, 5000):
        assert cs.combine(cs.crc64(data[:at]), cs.crc64(data[at:]), len(data) - at) == cs.crc64(data)


@pytest.mark.parametrize(("seed", "big", "data", "want"), [((0, 0), False, "0100000000000000", (1, 1)), ((0, 0), True, "0000000100000000", (1, 1)), ((1, 0), True, "ffffffff00000000", (0, 0))])
def test_wal_checksum(seed, big, data, want):
    assert cs.wal_checksum(bytes.fromhex(data), seed, big) == want


def header(lo, hi, commit, flags=fmt.NO_CHECKSUM):
    return fmt.LtxHeader(flags, PAGE, commit, lo, hi, hi * 1000)


def page(c):
    return c.encode() * PAGE


def test_file_round_trip_and_damage():
    data = fmt.write_ltx(header(5, 5, 10), [(2, page("b")), (7, os.urandom(PAGE))])
    f = fmt.read_ltx(data)
    assert [p for p, _ in f.pages] == [2, 7] and f.pages[0][1] == page("b") and f.header.min_txid == 5
    bad = bytearray(data)
    bad[40] ^= 1
    with pytest.raises(ChecksumMismatch):
        fmt.read_ltx(bytes(bad))
    assert fmt.read_ltx(bytes(bad), verify=False).pages == f.pages
    with pytest.raises(FormatError):
        fmt.ltx_header(b"LTX2" + data[4:])


def test_writer_refuses():
    for h, pages, error in [(header(5, 5, 3), [(2, page("a")), (1, page("b"))], PageOutOfOrder), (header(1, 1, 3), [(2, page("a"))], PageOutOfOrder), (header(5, 5, 3), [(4, page("a"))], FormatError), (header(5, 5, 3), [(1, b"x")], FormatError), (header(5, 4, 3), [], FormatError), (header(5, 5, 3), [(0, page("a"))], FormatError)]:
        with pytest.raises(error):
            fmt.write_ltx(h, pages)
    lock = fmt.lock_page(PAGE)
    with pytest.raises(FormatError):
        fmt.write_ltx(header(5, 5, lock + 1), [(lock, page("a"))])


def test_block_compressed_page():
    import struct

    import pyarrow as pa

    body = pa.Codec("lz4_raw").compress(page("q"), asbytes=True)
    assert fmt.page_frame(struct.pack(">IHI", 3, fmt.BLOCK, len(body)) + body, PAGE) == (3, page("q"))


def test_merge():
    base = fmt.write_ltx(header(1, 1, 3), [(i, page("a")) for i in (1, 2, 3)])
    shrink = fmt.write_ltx(header(2, 2, 2), [(1, page("b"))])
    f = fmt.read_ltx(fmt.merge([base, shrink]))
    assert f.pages == [(1, page("b")), (2, page("a"))] and (f.header.min_txid, f.header.max_txid, f.header.commit) == (1, 2, 2)
    grow = fmt.write_ltx(header(3, 3, 3), [(2, page("c"))])
    assert fmt.read_ltx(fmt.merge([base, shrink, grow])).pages == [(1, page("b")), (2, page("c")), (3, bytes(PAGE))]
    assert fmt.merge([fmt.merge([base, shrink]), grow]) == fmt.merge([base, shrink, grow])
    with pytest.raises(NotContiguous):
        fmt.merge([base, grow])


@pytest.fixture
def wal_db(tmp_path):
    path = str(tmp_path / "w.db")
    c = sqlite3.connect(path, isolation_level=None)
    c.execute("pragma page_size=1024")
    c.execute("pragma journal_mode=wal")
    c.execute("pragma wal_autocheckpoint=0")
    c.execute("create table items(id integer primary key, name text, note text)")
    for lo in (1, 101):
        c.execute("begin")
        c.executemany("insert into items values(?,?,?)", [(i, f"item-{i}", "x" * 60) for i in range(lo, lo + 100)])
        c.execute("commit")
    c.execute("update items set note='y' where id <= 10")
    yield path, c
    c.close()


def test_wal_gives_the_checkpointed_image(wal_db):
    path, c = wal_db
    wal, base = open(path + "-wal", "rb").read(), open(path, "rb").read()
    h = fmt.wal_header(wal)
    frames = fmt.wal_frames_from(wal, 32)
    assert all(f.ok for f in frames)
    pages, commit, end = fmt.page_map(h, frames)
    image = fmt.image({**{i + 1: base[i * 1024 : i * 1024 + 1024] for i in range(len(base) // 1024)}, **{k: f.data for k, f in pages.items()}}.items(), 1024, commit)
    # a torn and a blank frame after the end change nothing
    assert fmt.page_map(h, fmt.wal_frames_from(wal + bytes(h.frame_size), 32))[2] == end
    assert fmt.page_map(h, fmt.wal_frames_from(wal[:-5], 32))[1] <= commit
    with pytest.raises(UnalignedOffset):
        fmt.wal_frames_from(wal, 33)
    assert [f.ok for f in fmt.wal_frames_from(wal, 32 + 5 * h.frame_size)] == [f.ok for f in frames[5:]]
    c.execute("pragma wal_checkpoint(truncate)")
    assert image == open(path, "rb").read()


def test_damage_in_the_middle_ends_the_prefix(wal_db):
    path, _ = wal_db
    wal = bytearray(open(path + "-wal", "rb").read())
    h = fmt.wal_header(bytes(wal))
    n = (len(wal) - 32) // h.frame_size
    for at in range(n):
        bad = bytearray(wal)
        bad[32 + at * h.frame_size + 100] ^= 1
        ok = [f.ok for f in fmt.wal_frames_from(bytes(bad), 32)]
        assert ok.index(False) == at


def test_failures_have_types():
    header = fmt.LtxHeader(0, 512, 3, 1, 1, 0)
    whole = fmt.write_snapshot(bytes(3 * 512), 512, 1, 0)
    wal = fmt.write_wal([(1, 1, bytes(512))], 512, (1, 2))
    cases = [
        (errors.Truncated, lambda: fmt.wal_header(b"x")),
        (errors.Truncated, lambda: fmt.ltx_header(b"x")),
        (errors.BadMagic, lambda: fmt.wal_header(bytes(32))),
        (errors.BadMagic, lambda: fmt.ltx_header(bytes(100))),
        (errors.BadVersion, lambda: fmt.wal_header(wal[:4] + bytes(28))),
        (errors.BadPageSize, lambda: fmt.wal_header(wal[:8] + bytes(24))),
        (errors.ChecksumMismatch, lambda: fmt.wal_header(wal[:31] + b"?")),
        (errors.BadPageSize, lambda: fmt.write_ltx(header, [(1, b"short")])),
        (errors.BadTxidRange, lambda: fmt.LtxHeader(0, 512, 1, 5, 4, 0).validate()),
        (errors.BadPageNumber, lambda: fmt.write_ltx(fmt.LtxHeader(0, 512, 3, 2, 2, 0), [(4, bytes(512))])),
        (errors.PageOutOfOrder, lambda: fmt.write_ltx(header, [(2, bytes(512))])),
        (errors.BadVarint, lambda: fmt.page_index(b"\x80")),
        (errors.BadIndex, lambda: fmt.index_range(b"\xff" * 24, 200)),
        (errors.BadPageNumber, lambda: fmt.page_frame(bytes(6), 512)),
        (errors.BadCompression, lambda: fmt.page_frame(b"\0\0\0\1\0\0junk", 512)),
        (errors.ChecksumMismatch, lambda: fmt.read_ltx(whole[:-1] + bytes([whole[-1] ^ 1]))),
        (errors.ChecksumMismatch, lambda: fmt.verify_ltx(*fmt.in_memory(whole[:-1] + bytes([whole[-1] ^ 1])))),
    ]
    for kind, f in cases:
        with pytest.raises(kind):
            f()
    assert fmt.verify_ltx(*fmt.in_memory(whole)).commit == 3
