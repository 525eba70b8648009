"""Spark data sources: ``wal`` (batch and stream), ``ltx``, ``ltx_headers``, ``sqlite_pages``, and ``ltx`` as a sink.

Paths are files or folders that every executor can open, local or by address (see ``paths``). ``register(spark)`` makes them known
to a session.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..errors import Equivocation, NotContiguous
from ..functions.checksums import signed
from . import formats as fmt
from . import paths
from .store import Store, parse_name

PAGES_A_TASK = 4096
WAL_SCHEMA = "wal string, page_size int, frame_no long, offset long, pgno long, commit long, salt1 long, salt2 long, checksum1 long, checksum2 long, ok boolean, data binary"
HEADER_SCHEMA = "level int, flags long, page_size int, commit long, min_txid long, max_txid long, timestamp long, pre_apply_checksum long, wal_offset long, wal_size long, wal_salt1 long, wal_salt2 long, node_id long, post_apply_checksum long, file_checksum long"
LTX_SCHEMA = "level int, min_txid long, max_txid long, pgno long, offset long, size long, data binary"


@dataclass
class Range(InputPartition):
    path: str
    start: int = 0
    end: int = 0


def _files(path: str) -> list[str]:
    if parse_name(path.rpartition("/")[2]):
        return [path]
    return sorted(p for p, _, _ in paths.listing(path, deep=True) if parse_name(p.rpartition("/")[2]))


def _level(path: str) -> int | None:
    try:
        return int(os.path.basename(os.path.dirname(path)), 16)
    except ValueError:
        return None


def _stored_seed(h: fmt.WalHeader, f, start: int) -> tuple[int, int] | None:
    """Checksum stored with the frame before, whatever its salts: a scan shows all frames and says which are not valid."""
    if start <= fmt.WAL_HEADER:
        return None
    f.seek(start - h.frame_size + 16)
    return tuple(int.from_bytes(f.read(4), "big") for _ in range(2))


def _frames(path: str, start: int, end: int) -> Iterator[tuple]:
    with paths.open_read(path) as f:
        h = fmt.wal_header(f.read(fmt.WAL_HEADER))
        for block in fmt.frame_blocks(h, f, start, _stored_seed(h, f, start), end):
            for x in block:
                yield path, h.page_size, x.frame_no, x.offset, x.pgno, x.commit, x.salt1, x.salt2, x.checksum1, x.checksum2, x.ok, x.data


def _wal_ranges(path: str, start: int, end: int) -> list[Range]:
    with paths.open_read(path) as f:
        h = fmt.wal_header(f.read(fmt.WAL_HEADER))
    step = PAGES_A_TASK * h.frame_size
    return [Range(path, x, min(end, x + step)) for x in range(max(start, fmt.WAL_HEADER), end, step)]


class WalReader(DataSourceReader):
    def __init__(self, path: str, start: int):
        self.path, self.start = path, start

    def partitions(self) -> list[Range]:
        with paths.open_read(self.path) as f:
            h = fmt.wal_header(f.read(fmt.WAL_HEADER))
            fmt.seed_before(h, f, self.start)  # an offset that no frame of this generation ends at is an error
        return _wal_ranges(self.path, self.start, paths.size(self.path))

    def read(self, part: Range) -> Iterator[tuple]:
        return _frames(part.path, part.start, part.end)


class WalStream(DataSourceStreamReader):
    """Offset: generation and end of the whole committed frames seen; a new generation starts at its first frame."""

    def __init__(self, path: str):
        self.path, self.seen = path, self.initialOffset()

    def initialOffset(self) -> dict:
        return {"salt": "", "offset": fmt.WAL_HEADER}

    def latestOffset(self) -> dict:
        """Reads the header and what follows the last offset of the same generation, a block at a time."""
        try:
            with paths.open_read(self.path) as f:
                h = fmt.wal_header(f.read(fmt.WAL_HEADER))
                salt = f"{h.salt1:08x}{h.salt2:08x}"
                start = self.seen["offset"] if self.seen["salt"] == salt else fmt.WAL_HEADER
                _, _, end = fmt.committed_offsets(h, f, start)
        except (FileNotFoundError, fmt.FormatError):
            return self.initialOffset()
        self.seen = {"salt": salt, "offset": max(end, start)}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if not end["salt"]:
            return []
        return _wal_ranges(self.path, start["offset"] if start["salt"] in ("", end["salt"]) else fmt.WAL_HEADER, end["offset"])

    def read(self, part: Range) -> Iterator[tuple]:
        return _frames(part.path, part.start, part.end)


class Wal(DataSource):
    """Options: path; offset (batch), where to start."""

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return WAL_SCHEMA

    def reader(self, schema) -> WalReader:
        return WalReader(self.options["path"], int(self.options.get("offset", fmt.WAL_HEADER)))

    def streamReader(self, schema) -> WalStream:
        return WalStream(self.options["path"])


class LtxReader(DataSourceReader):
    """A task a file. Filters on pgno reach the page index, so only their pages are read (needs spark.sql.python.filterPushdown.enabled).

    Spark keeps a pushed filter with the loaded source, so each point lookup must ``load()`` anew.
    """

    def __init__(self, path: str, verify: bool):
        self.path, self.verify, self.wanted = path, verify, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("pgno",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            yield f  # Spark tests it again

    def partitions(self) -> list[Range]:
        return [Range(x) for x in _files(self.path)]

    def read(self, part: Range) -> Iterator[tuple]:
        level, size = _level(part.path), paths.size(part.path)
        with paths.open_read(part.path) as f:

            def at(offset: int, n: int) -> bytes:
                f.seek(offset)
                return f.read(n)

            if self.verify:
                fmt.verify_ltx(at, size)
            h = fmt.ltx_header(at(0, fmt.LTX_HEADER))
            start, n = fmt.index_range(at(size - 24, 24), size)
            for pgno, offset, length in fmt.iter_index(at(start, n)):
                if self.wanted is None or pgno in self.wanted:
                    yield level, h.min_txid, h.max_txid, pgno, offset, length, fmt.page_frame(at(offset, length), h.page_size)[1]


class HeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        names = _files(self.path)
        return [Range("\n".join(names[i : i + 256])) for i in range(0, len(names), 256)]

    def read(self, part: Range) -> Iterator[tuple]:
        for path in part.path.split("\n"):
            with paths.open_read(path) as f:
                h = fmt.ltx_header(f.read(fmt.LTX_HEADER))
                f.seek(-fmt.TRAILER, os.SEEK_END)
                post, crc = (int.from_bytes(f.read(8), "big") for _ in range(2))
            yield _level(path), h.flags, h.page_size, h.commit, h.min_txid, h.max_txid, h.timestamp, signed(h.pre_apply_checksum), h.wal_offset, h.wal_size, h.wal_salt1, h.wal_salt2, signed(h.node_id), signed(post), signed(crc)


@dataclass
class Written(WriterCommitMessage):
    rows: int
    tmp: str
    path: str


class LtxWriter(DataSourceWriter):
    """One file. Rows (pgno, data) must come in one partition, in any order; the file appears under its name at commit.

    Pages go through a spool file beside the target, so memory holds an index entry a page. A commit over other bytes of the same name is an ``Equivocation`` (or replaces them in mode overwrite).
    """

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, rows: Iterator) -> Written:
        o = self.options
        h = fmt.LtxHeader(fmt.NO_CHECKSUM, int(o["page_size"]), int(o["commit"]), int(o["min_txid"]), int(o["max_txid"]), int(o.get("timestamp", 0)))
        path = Store(o["path"]).path(int(o.get("level", 0)), h.min_txid, h.max_txid)
        spool = paths.Upload(f"{path}.spool")
        places: list[tuple[int, int]] = []
        try:
            for i, r in enumerate(rows):
                if len(r["data"]) != h.page_size:
                    raise fmt.FormatError(f"page {r['pgno']} has {len(r['data'])} bytes")
                spool.write(bytes(r["data"]))
                places.append((r["pgno"], i))
            spool.finish()
            if not places:
                return Written(0, "", "")
            places.sort()
            up = paths.Upload(path)
            try:
                with open(spool.tmp, "rb") if spool.fs is None else spool.fs.open_input_file(spool.tmp) as f:

                    def pages() -> Iterator[tuple[int, bytes]]:
                        for pgno, i in places:
                            f.seek(i * h.page_size)
                            yield pgno, f.read(h.page_size)

                    fmt.write_ltx_to(up.write, h, pages())
                up.finish()
            except BaseException:
                up.abort()
                raise
            return Written(len(places), up.tmp, path)
        finally:
            spool.abort()

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None and m.rows]
        if len(done) > 1:
            self.abort(messages)
            raise NotContiguous("a file needs its pages in one partition")
        for m in done:
            up = paths.Upload.written(m.path, m.tmp)
            if self.overwrite:
                up.publish()
            elif up.publish_if_absent() is False:
                raise Equivocation(m.path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.tmp:
                paths.Upload.written(m.path, m.tmp).abort()


class Ltx(DataSource):
    """Options: path; verify (read); level, page_size, commit, min_txid, max_txid, timestamp (write)."""

    @classmethod
    def name(cls) -> str:
        return "ltx"

    def schema(self) -> str:
        return LTX_SCHEMA

    def reader(self, schema) -> LtxReader:
        return LtxReader(self.options["path"], self.options.get("verify", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> LtxWriter:
        return LtxWriter(dict(self.options), overwrite)


class LtxHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ltx_headers"

    def schema(self) -> str:
        return HEADER_SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options["path"])


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        n = paths.size(self.path) // page_size(self.path)
        return [Range(self.path, i, min(n, i + PAGES_A_TASK)) for i in range(0, n, PAGES_A_TASK)]

    def read(self, part: Range) -> Iterator[tuple]:
        size = page_size(part.path)
        lock = fmt.lock_page(size)
        with paths.open_read(part.path) as f:
            f.seek(part.start * size)
            for i in range(part.start + 1, part.end + 1):
                data = f.read(size)
                if i != lock:
                    yield i, data


def page_size(path: str) -> int:
    with paths.open_read(path) as f:
        n = int.from_bytes(f.read(18)[16:18], "big")
    return 65536 if n == 1 else n


class SqlitePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_pages"

    def schema(self) -> str:
        return "pgno long, data binary"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Also lets filters reach Python sources: with that off, Spark refuses to read ``ltx`` at all."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Wal, Ltx, LtxHeaders, SqlitePages):
        spark.dataSource.register(source)
