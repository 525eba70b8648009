"""Checksums as column functions. They run in numpy, over Arrow batches; rows of one length are worked on together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import checksums as cs


def _by_length(data: pd.Series, f: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """``f`` over the rows of each length, as an array of bytes; null for null."""
    out = pd.Series([None] * len(data), dtype="Int64")
    sizes = data.map(len, na_action="ignore")
    for n in sizes.dropna().unique():
        at = np.flatnonzero(sizes == n)
        rows = np.frombuffer(b"".join(data.iloc[at]), np.uint8).reshape(len(at), int(n))
        out.iloc[at] = f(rows).astype(np.uint64).view(np.int64)
    return out


@F.pandas_udf(LongType())
def _crc64(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for data in parts:
        yield _by_length(data, cs.crc64_rows)


@F.pandas_udf(LongType())
def _wal_little(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for data in parts:
        yield _by_length(data, lambda rows: _joined(rows, False))


@F.pandas_udf(LongType())
def _wal_big(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for data in parts:
        yield _by_length(data, lambda rows: _joined(rows, True))


def _joined(rows: np.ndarray, big: bool) -> np.ndarray:
    s0, s1 = cs.wal_checksums(rows, np.zeros((len(rows), 2), np.uint32), big)
    return s0.astype(np.uint64) << np.uint64(32) | s1


def crc64(data: Column) -> Column:
    """CRC-64/ISO of binary, as the bit pattern of a BIGINT."""
    return _crc64(data)


def page_checksum(pgno: Column, data: Column) -> Column:
    """CRC of a page's number (4 bytes, big-endian) and data, with the highest bit set."""
    number = F.unhex(F.lpad(F.hex(pgno.cast("long")), 8, "0"))
    return _crc64(F.concat(number, data)).bitwiseOR(F.lit(cs.signed(cs.FLAG)))


def rolling(checksum: Column) -> Column:
    """Aggregate of page checksums to a database's; order doesn't matter."""
    return F.bit_xor(checksum).bitwiseOR(F.lit(cs.signed(cs.FLAG)))


def wal_checksum(data: Column, big: bool = False) -> Column:
    """SQLite's WAL checksum from (0, 0) over whole 8-byte words: the first sum in the upper half, the second in the lower."""
    return (_wal_big if big else _wal_little)(data)
