"""Files on local disks, mounted folders and object stores, by path or address.

Paths without a scheme and ``file:`` addresses are local; others go to pyarrow's file systems (``hdfs:``, ``s3:``, ``gs:``, ...).
"""

from __future__ import annotations

import io
import os
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyarrow import fs as pafs

PART = 8 << 20


def resolve(path: str) -> tuple[pafs.FileSystem | None, str]:
    """(file system, path within it); None for local paths."""
    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme or len(scheme) < 2:
        return None, path
    if scheme == "file":
        return None, "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(path)


def open_read(path: str) -> BinaryIO:
    """A seekable file."""
    fs, p = resolve(path)
    if fs is None:
        return open(p, "rb")
    return fs.open_input_file(p)


def size(path: str) -> int:
    fs, p = resolve(path)
    if fs is None:
        return os.path.getsize(p)
    found = fs.get_file_info(p)
    if found.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return found.size


def exists(path: str) -> bool:
    fs, p = resolve(path)
    return os.path.exists(p) if fs is None else fs.get_file_info(p).type != pafs.FileType.NotFound


def listing(folder: str, deep: bool = False) -> Iterator[tuple[str, int, float | None]]:
    """(path, size, seconds since the epoch or None) of the files in a folder; nothing if there is no such folder."""
    fs, p = resolve(folder)
    if fs is None:
        for d, _, names in os.walk(p):
            for n in names:
                try:
                    s = os.stat(os.path.join(d, n))
                except FileNotFoundError:  # deleted meanwhile
                    continue
                yield os.path.join(d, n), s.st_size, s.st_mtime
            if not deep:
                return
        return
    scheme = folder.partition(":")[0]
    for f in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True, recursive=deep)):
        if f.type == pafs.FileType.File:
            yield f"{scheme}://{f.path.lstrip('/') if scheme != 'hdfs' else f.path}", f.size, None if f.mtime is None else f.mtime.timestamp()


def sync_folder(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


class Upload:
    """A new file under a temporary name next to its place; ``publish`` or ``publish_if_absent`` gives it its own, ``abort`` removes it."""

    def __init__(self, path: str):
        self.path = path
        self.fs, self.target = resolve(path)
        self.tmp = f"{self.target}.{uuid.uuid4().hex}.tmp"
        if self.fs is None:
            os.makedirs(os.path.dirname(self.target), exist_ok=True)
            self.out: BinaryIO = open(self.tmp, "w+b")  # noqa: SIM115
        else:
            self.fs.create_dir(posixpath.dirname(self.target), recursive=True)
            self.out = self.fs.open_output_stream(self.tmp)  # object stores upload it in parts

    @classmethod
    def written(cls, path: str, tmp: str) -> Upload:
        """One that another process has finished."""
        up = cls.__new__(cls)
        up.path, up.tmp, up.out = path, tmp, io.BytesIO()
        up.out.close()
        up.fs, up.target = resolve(path)
        return up

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def finish(self) -> None:
        """All is written and lasts."""
        if self.fs is None and not self.out.closed:
            self.out.flush()
            os.fsync(self.out.fileno())
        self.out.close()

    def publish(self) -> None:
        """Replaces what has the name."""
        self.finish()
        if self.fs is None:
            os.replace(self.tmp, self.target)
            sync_folder(os.path.dirname(self.target))
        else:
            self.fs.move(self.tmp, self.target)

    def publish_if_absent(self) -> bool | None:
        """True: created. None: the same bytes were there. False: others were, and stay.

        Local files are linked, which no other writer can come between; elsewhere the name is looked up first, so two writers of one
        name at one moment are not told apart.
        """
        self.finish()
        try:
            if self.fs is None:
                try:
                    os.link(self.tmp, self.target)
                    sync_folder(os.path.dirname(self.target))
                    return True
                except FileExistsError:
                    pass
            elif not exists(self.path):
                self.fs.move(self.tmp, self.target)
                return True
            return None if self._same() else False
        finally:
            self.abort()

    def _same(self) -> bool:
        with (open(self.tmp, "rb") if self.fs is None else self.fs.open_input_file(self.tmp)) as mine, open_read(self.path) as there:
            while True:
                a, b = mine.read(PART), there.read(PART)
                if a != b:
                    return False
                if not a:
                    return True

    def abort(self) -> None:
        self.out.close()
        if self.fs is None:
            if os.path.exists(self.tmp):
                os.remove(self.tmp)
        elif self.fs.get_file_info(self.tmp).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.tmp)


def parts(path: str) -> Iterator[bytes]:
    with open_read(path) as f:
        while data := f.read(PART):
            yield data


def put(path: str, data: Iterable[bytes]) -> None:
    """Replaces a file by these parts; nothing changes if one of them fails."""
    up = Upload(path)
    try:
        for x in data:
            up.write(x)
        up.publish()
    except BaseException:
        up.abort()
        raise


def delete(path: str) -> None:
    """No error if there is none."""
    fs, p = resolve(path)
    try:
        os.remove(p) if fs is None else fs.delete_file(p)
    except FileNotFoundError:
        pass
