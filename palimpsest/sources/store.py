"""Replica store: ``<root>/<level as 4 hex digits>/<min>-<max as 16>.ltx`` on any file system that ``paths`` opens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime

from ..errors import Equivocation
from . import paths

_NAME = re.compile(r"([0-9a-f]{16})-([0-9a-f]{16})\.ltx")
SNAPSHOT_LEVEL = 9
CREATED, IDENTICAL, CONFLICT = "Created", "AlreadyIdentical", "Conflict"


@dataclass(frozen=True, order=True)
class FileInfo:
    level: int
    min_txid: int
    max_txid: int
    size: int = 0
    created_at: datetime | None = None


def parse_name(name: str) -> tuple[int, int] | None:
    m = _NAME.fullmatch(name)
    return (int(m[1], 16), int(m[2], 16)) if m else None


def durable_write(path: str, data: bytes) -> None:
    """Temporary file, sync, rename, sync of the folder."""
    paths.put(path, [data])


class Store:
    def __init__(self, root: str):
        self.root = root.rstrip("/") if root.strip("/") else root

    def path(self, level: int, min_txid: int, max_txid: int) -> str:
        return f"{self.root}/{level:04x}/{min_txid:016x}-{max_txid:016x}.ltx"

    def put(self, level: int, min_txid: int, max_txid: int, data: bytes) -> None:
        self.put_parts(level, min_txid, max_txid, [data])

    def put_parts(self, level: int, min_txid: int, max_txid: int, parts: Iterable[bytes]) -> None:
        """Replaces a file by parts that come one after the other; if one fails the file stays as it was and nothing is left over."""
        paths.put(self.path(level, min_txid, max_txid), parts)

    def put_if_absent(self, level: int, min_txid: int, max_txid: int, data: bytes | Iterable[bytes]) -> str:
        """Created, AlreadyIdentical or Conflict; never changes what is stored. ``data`` whole or in parts."""
        up = paths.Upload(self.path(level, min_txid, max_txid))
        try:
            for x in [data] if isinstance(data, bytes) else data:
                up.write(x)
        except BaseException:
            up.abort()
            raise
        return {True: CREATED, None: IDENTICAL, False: CONFLICT}[up.publish_if_absent()]

    def ship(self, level: int, min_txid: int, max_txid: int, data: bytes | Iterable[bytes]) -> None:
        if self.put_if_absent(level, min_txid, max_txid, data) == CONFLICT:
            raise Equivocation(self.path(level, min_txid, max_txid))

    def get(self, level: int, min_txid: int, max_txid: int) -> bytes:
        with paths.open_read(self.path(level, min_txid, max_txid)) as f:
            return f.read()

    def size(self, level: int, min_txid: int, max_txid: int) -> int:
        return paths.size(self.path(level, min_txid, max_txid))

    def ranged(self, level: int, min_txid: int, max_txid: int) -> Callable[[int, int], bytes]:
        path = self.path(level, min_txid, max_txid)

        def read(offset: int, length: int) -> bytes:
            with paths.open_read(path) as f:
                f.seek(offset)
                return f.read(length)

        return read

    def delete(self, level: int, min_txid: int, max_txid: int) -> None:
        paths.delete(self.path(level, min_txid, max_txid))

    def list(self, level: int) -> list[FileInfo]:
        """Files of a level by (min, max)."""
        out = []
        for path, size, at in paths.listing(f"{self.root}/{level:04x}"):
            if ids := parse_name(path.rpartition("/")[2]):
                out.append(FileInfo(level, *ids, size, None if at is None else datetime.fromtimestamp(at, UTC)))
        return sorted(out, key=lambda f: (f.min_txid, f.max_txid))

    def list_all(self) -> list[FileInfo]:
        return [f for level in range(SNAPSHOT_LEVEL + 1) for f in self.list(level)]
