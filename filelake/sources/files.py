"""Bytes of files and of archive members.

A path may be a URI of any file system that Arrow knows, or a plain path mounted on every
executor. A *member* says where an archive keeps an entry: the file, how the entry is coded,
and its byte range, so that any task can read it without the entries before it. Entries of
compressed tar streams have no range of their own; they are read in order from the start.
"""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow.fs as pafs

CHUNK = 1 << 20
MEMBER = "struct<file: string, method: string, offset: long, packed: long, size: long, crc: long, entry: long, piece: long>"
STORED, DEFLATED, BZIP2, LZMA, STREAM = "stored", "deflated", "bzip2", "lzma", "stream"
ZIP_METHODS = {0: STORED, 8: DEFLATED, 12: BZIP2, 14: LZMA}
# What reading an archive may raise; a fault of one entry or archive is a row, not the end of a job.
FAULTS = (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError, ValueError, struct.error)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def open_file(path: str) -> BinaryIO:
    system, inner = file_system(path)
    return open(inner, "rb") if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(inner)


def _inflate(source: BinaryIO, method: str, packed: int) -> Iterator[bytes]:
    coder = {DEFLATED: lambda: zlib.decompressobj(-15), BZIP2: bz2.BZ2Decompressor, LZMA: zipfile.LZMADecompressor}.get(method)
    inflater: Any = coder() if coder else None
    left = packed
    while left > 0:
        data = source.read(min(CHUNK, left))
        if not data:
            raise EOFError("the entry ends before its length")
        left -= len(data)
        if inflater is None:
            yield data
        elif method == DEFLATED:
            # Bounded output, however far the input expands.
            while data:
                yield inflater.decompress(data, CHUNK)
                data = inflater.unconsumed_tail
        else:
            yield inflater.decompress(data)
    if method == DEFLATED:
        yield inflater.flush()


class MemberReader:
    """Reads members; the last file stays open, and a compressed tar is read on from where it stands."""

    def __init__(self) -> None:
        self._path: str | None = None
        self._file: BinaryIO | None = None
        self._tar: tarfile.TarFile | None = None
        self._infos: Iterator[tarfile.TarInfo] = iter(())
        self._entry = 0

    def __enter__(self) -> MemberReader:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    def close(self) -> None:
        for held in (self._tar, self._file):
            if held is not None:
                held.close()
        self._path = self._file = self._tar = None
        self._entry = 0

    def _open(self, path: str) -> BinaryIO:
        if path != self._path or self._file is None:
            self.close()
            self._file, self._path = open_file(path), path
        return self._file

    def chunks(self, member: dict) -> Iterator[bytes]:
        """The entry's bytes in pieces; raises one of ``FAULTS`` if they are damaged."""
        if member["method"] == STREAM:
            yield from self._stream(member)
            return
        file = self._open(member["file"])
        file.seek(member["offset"])
        if member["crc"] is not None:
            head = file.read(30)
            if head[:4] != b"PK\x03\x04":
                raise zipfile.BadZipFile("no entry where the directory says")
            name, extra = struct.unpack("<HH", head[26:30])
            file.seek(member["offset"] + 30 + name + extra)
        check = size = 0
        for data in _inflate(file, member["method"], member["packed"]):
            check, size = zlib.crc32(data, check), size + len(data)
            if data:
                yield data
        if size != member["size"] or (member["crc"] is not None and check != member["crc"]):
            raise zipfile.BadZipFile("length or checksum differs from the directory")

    def _stream(self, member: dict) -> Iterator[bytes]:
        if member["file"] != self._path or self._tar is None or self._entry > member["entry"]:
            self.close()
            self._tar = tarfile.open(fileobj=self._open(member["file"]), mode="r:*")
            self._infos, self._entry = iter(self._tar), 0
        for info in self._infos:
            if info.isfile():
                self._entry += 1
                if self._entry > member["entry"]:
                    stream = self._tar.extractfile(info)
                    while stream is not None and (data := stream.read(CHUNK)):
                        yield data
                    return
        raise EOFError("the archive has fewer entries")

    def read(self, member: dict) -> bytes:
        return b"".join(self.chunks(member))

    def pieces(self, path: str, member: dict | None) -> Iterator[bytes]:
        """Bytes of a file, or of the archive member whose place is given."""
        if member is not None:
            yield from self.chunks(member)
            return
        with open_file(path) as file:
            while data := file.read(CHUNK):
                yield data


class TailFile(io.RawIOBase):
    """The end of a file whose start is not at hand. Reading before it raises :class:`Before`."""

    class Before(Exception):
        def __init__(self, offset: int):
            super().__init__(offset)
            self.offset = offset

    def __init__(self, size: int, tail: bytes):
        self._size, self._tail, self._at = size, tail, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = max(0, (0, self._at, self._size)[whence] + offset)
        return self._at

    def read(self, count: int | None = -1) -> bytes:
        start = self._at - (self._size - len(self._tail))
        if start < 0:
            raise TailFile.Before(self._at)
        end = None if count is None or count < 0 else start + count
        data = self._tail[start:end]
        self._at += len(data)
        return data


def entry_names(file: Any) -> bytes:
    """How the names of a zip file's entries begin: documents are told by them, wherever their entries lie."""
    try:
        with zipfile.ZipFile(file) as archive:
            return b"\0".join(sorted({n[:12].encode("utf-8", "replace") for n in archive.namelist()}))
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
        return b""
