"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PENDING_BYTE = 0x40000000


def lock_page(page_size: Column) -> Column:
    return F.floor(F.lit(PENDING_BYTE) / page_size).cast("long") + 1


def is_page_size(x: Column) -> Column:
    return x.between(512, 65536) & (F.bit_count(x) == 1)


def is_snapshot(min_txid: Column) -> Column:
    return min_txid == 1


def is_txid_range(min_txid: Column, max_txid: Column) -> Column:
    return (min_txid > 0) & (max_txid >= min_txid)


def hex16(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def file_name(min_txid: Column, max_txid: Column) -> Column:
    return F.concat(hex16(min_txid), F.lit("-"), hex16(max_txid), F.lit(".ltx"))


def level_dir(level: Column) -> Column:
    return F.lower(F.lpad(F.hex(level.cast("long")), 4, "0"))


def parse_file_name(path: Column) -> tuple[Column, Column, Column]:
    """(level, min_txid, max_txid) of a path; null where it isn't one."""
    pattern = r"(?:^|/)([0-9a-f]{4})/([0-9a-f]{16})-([0-9a-f]{16})\.ltx$"

    def part(i: int) -> Column:
        x = F.regexp_extract(path, pattern, i)
        return F.when(x != "", F.conv(x, 16, 10).cast("decimal(20,0)").try_cast("long"))

    return part(1).cast("int"), part(2), part(3)


def epoch_floor(ts: Column, seconds: int) -> Column:
    """Seconds of the window's start, epoch-aligned; times before the epoch count as the epoch. A zero interval gives the time itself."""
    micros = F.greatest(F.unix_micros(ts.cast("timestamp")), F.lit(0))
    return F.floor(micros / 1_000_000).cast("long") if not seconds else (F.floor(micros / (seconds * 1_000_000)) * seconds).cast("long")


def timestamp_ms(text: Column) -> Column:
    """Whole number: epoch milliseconds; else RFC 3339; else null."""
    return F.coalesce(text.try_cast("long"), F.unix_millis(F.try_to_timestamp(text)))


def checkpoint_mode(frames: Column, passive: int = 1000, truncate: int = 121359) -> Column:
    return F.when(frames >= truncate, "TRUNCATE").when(frames >= passive, "PASSIVE").otherwise("NONE")


def live_frames(wal_offset: Column, page_size: Column) -> Column:
    return F.floor(F.greatest(wal_offset - 32, F.lit(0)) / (page_size + 24)).cast("long")


def uvarint(x: Column) -> Column:
    """A non-negative BIGINT as a variable-length integer, seven bits a byte, the lowest first."""
    n = F.greatest(F.ceil(F.length(F.ltrim(F.bin(x), F.lit("0"))) / 7).cast("int"), F.lit(1))
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(F.call_function("shiftright", x, 7 * i).bitwiseAND(F.lit(127)).bitwiseOR(F.when(i < n - 1, 128).otherwise(0)).cast("long")), 2, "0"))
    return F.unhex(F.array_join(each, ""))


def read_uvarint(data: Column) -> Column:
    """The integer of such bytes."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"))
    each = F.transform(pairs, lambda p, i: F.call_function("shiftleft", F.conv(p, 16, 10).cast("long").bitwiseAND(F.lit(127)), 7 * i))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)


def fully_checkpointed(busy: Column, log: Column, checkpointed: Column) -> Column:
    return (busy == 0) & (log == checkpointed)
