"""CRC-64/ISO, rolling page checksums and WAL checksums, vectorised with numpy.

A CRC of joined parts follows from the parts' CRCs, so long inputs are cut into lanes that advance together.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

POLY = 0xD800000000000000
ONES = (1 << 64) - 1
FLAG = 1 << 63


@functools.cache
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        t = np.where(t & np.uint64(1), (t >> np.uint64(1)) ^ np.uint64(POLY), t >> np.uint64(1))
    return t


def _columns(rows: np.ndarray) -> np.ndarray:
    """CRC of each row, column by column."""
    table, c = _table(), np.full(len(rows), ONES, np.uint64)
    for column in np.ascontiguousarray(rows.T):
        c = table[(c ^ column).astype(np.uint8)] ^ (c >> np.uint64(8))
    return c ^ np.uint64(ONES)


def crc64_rows(rows: np.ndarray) -> np.ndarray:
    """CRC of each row of a (n, length) array of bytes. Few long rows are cut in lanes, whose CRCs are joined in pairs."""
    n, length = rows.shape
    lanes = 1
    while n * lanes < 8192 and length // (2 * lanes) >= 64:
        lanes *= 2
    if lanes == 1:
        return _columns(rows)
    size = length // lanes
    first = length - lanes * size
    out = _columns(np.ascontiguousarray(rows[:, first:]).reshape(n * lanes, size)).reshape(n, lanes)
    while out.shape[1] > 1:
        out = _apply_all(_zeros(size), out[:, ::2]) ^ out[:, 1::2]
        size *= 2
    return _apply_all(_zeros(size), _columns(rows[:, :first])) ^ out[:, 0] if first else out[:, 0]


@functools.lru_cache(4096)
def _zeros(length: int) -> tuple[int, ...]:
    """What ``length`` zero bytes do to each of the 64 bits of a CRC state."""
    if length == 1:
        t = _table()
        return tuple(int(t[(1 << i) & 255]) ^ (1 << i) >> 8 for i in range(64))
    half = _zeros(length // 2)
    out = tuple(_apply(half, x) for x in half)
    return tuple(_apply(_zeros(1), x) for x in out) if length % 2 else out


def _apply(op: tuple[int, ...], x: int) -> int:
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= op[i]
        x >>= 1
        i += 1
    return out


def combine(first: int, second: int, second_length: int) -> int:
    """CRC of two joined parts."""
    return _apply(_zeros(second_length), first) ^ second if second_length else first


def crc64(data: bytes) -> int:
    """Long inputs go in lanes, more of them the longer the input; neighbouring lanes' CRCs are then joined in pairs."""
    lanes = 1 << max(0, min(12, (len(data) // 64).bit_length() - 1))
    size = len(data) // lanes
    if lanes < 64:
        t, c = _table(), ONES
        for b in data:
            c = int(t[(c ^ b) & 255]) ^ c >> 8
        return c ^ ONES
    crcs = crc64_rows(np.frombuffer(data, np.uint8, lanes * size).reshape(lanes, size))
    while len(crcs) > 1:
        crcs = _apply_all(_zeros(size), crcs[::2]) ^ crcs[1::2]
        size *= 2
    rest = data[size:]
    return combine(int(crcs[0]), crc64(rest), len(rest)) if rest else int(crcs[0])


def _apply_all(op: tuple[int, ...], x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i, v in enumerate(op):
        out ^= np.where(x >> np.uint64(i) & np.uint64(1), np.uint64(v), np.uint64(0))
    return out


def page_checksums(pgnos: list[int], pages: list[bytes]) -> list[int]:
    """CRC of page number and data with the flag bit set, of pages of one size."""
    if not pages:
        return []
    head = np.array(pgnos, ">u4").view(np.uint8).reshape(-1, 4)
    body = np.frombuffer(b"".join(pages), np.uint8).reshape(len(pages), -1)
    return [int(c) | FLAG for c in crc64_rows(np.concatenate([head, body], axis=1))]


def rolling(checksums: list[int]) -> int:
    """Database checksum: order doesn't matter."""
    return FLAG | functools.reduce(int.__xor__, checksums, 0)


def signed(x: int) -> int:
    """The bit pattern as a Spark BIGINT."""
    return x - (1 << 64) if x >> 63 else x


def wal_checksum(data: bytes, seed: tuple[int, int], big: bool) -> tuple[int, int]:
    """SQLite's running checksum over 8-byte words."""
    return tuple(int(x[0]) for x in wal_checksums(np.frombuffer(data, np.uint8)[None, :], np.array([seed], np.uint32), big))


def wal_checksums(rows: np.ndarray, seeds: np.ndarray, big: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same for each row from its own seed; rows advance together."""
    words = np.ascontiguousarray(rows).view(">u4" if big else "<u4").astype(np.uint32)
    s0, s1 = seeds[:, 0].astype(np.uint32), seeds[:, 1].astype(np.uint32)
    for i in range(0, words.shape[1], 2):
        s0 = s0 + words[:, i] + s1
        s1 = s1 + words[:, i + 1] + s0
    return s0, s1


def wal_checksum_of(data: bytes, seed: tuple[int, int], big: bool) -> tuple[int, int]:
    """``wal_checksum`` for one short input, without arrays."""
    s0, s1 = seed
    for a, b in struct.iter_unpack(">2I" if big else "<2I", data):
        s0 = s0 + a + s1 & 0xFFFFFFFF
        s1 = s1 + b + s0 & 0xFFFFFFFF
    return s0, s1


def wal_chain(rows: np.ndarray, seed: tuple[int, int], big: bool) -> tuple[np.ndarray, np.ndarray]:
    """The running checksum after each row of a (n, length) array, each going on from the row before.

    A row turns the state x into A x + c modulo 2 ** 32, with one A for all rows of a length. So all c are computed together, from
    zero, and then summed up in steps that double.
    """
    s0, s1 = wal_checksums(rows, np.zeros((len(rows), 2), np.uint32), big)
    a = _wal_step(rows.shape[1])
    if len(rows):
        first = _wal_apply(a, *(np.array([x], np.uint32) for x in seed))
        s0[:1] += first[0]
        s1[:1] += first[1]
    k = 1
    while k < len(rows):
        on = _wal_apply(a, s0[:-k], s1[:-k])
        s0[k:] += on[0]
        s1[k:] += on[1]
        a, k = _wal_product(a, a), 2 * k
    return s0, s1


def wal_carry(end: tuple[int, int], seed: tuple[int, int], rows: int, length: int) -> tuple[int, int]:
    """The running checksum after ``rows`` rows from ``seed``, given the one they end in from zero."""
    a, power = _wal_step(length), (1, 0, 0, 1)
    while rows:
        if rows & 1:
            power = _wal_product(power, a)
        a, rows = _wal_product(a, a), rows >> 1
    p, q, r, s = power
    return end[0] + p * seed[0] + q * seed[1] & 0xFFFFFFFF, end[1] + r * seed[0] + s * seed[1] & 0xFFFFFFFF


@functools.cache
def _wal_step(length: int) -> tuple[int, int, int, int]:
    """What ``length`` zero bytes do to a state, as a 2 x 2 matrix, row by row."""
    s0, s1 = wal_checksums(np.zeros((2, length), np.uint8), np.eye(2, dtype=np.uint32), False)
    return int(s0[0]), int(s0[1]), int(s1[0]), int(s1[1])


def _wal_product(x: tuple[int, int, int, int], y: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    a, b, c, d = x
    e, f, g, h = y
    return a * e + b * g & 0xFFFFFFFF, a * f + b * h & 0xFFFFFFFF, c * e + d * g & 0xFFFFFFFF, c * f + d * h & 0xFFFFFFFF


def _wal_apply(a: tuple[int, int, int, int], s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q, r, s = (np.uint32(x) for x in a)
    return s0 * p + s1 * q, s0 * r + s1 * s
