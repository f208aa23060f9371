"""ZIP packages read by ranges: directories, members that are stored as they are, indexes and the records that they name.

Nothing is extracted: the end of the file leads to the central directory, that to a member's place, the
member's index to a record's offset and length, and these are read alone.  Files are opened by URI through
pyarrow's file systems, so that every executor reaches a shared store in the same way.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import NativeFile
from pyarrow.fs import FileSystem

#: Signatures of the format's parts.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
#: The end record and the longest comment after it.
_END_BYTES = 22 + 0xFFFF
#: Bytes that are read at a time.
CHUNK = 1 << 20
_ALL16, _ALL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """A member of a package; its bytes lie from start (after the local header) on."""

    name: str
    method: int
    start: int
    size: int


def opened(uri: str) -> NativeFile:
    files, path = FileSystem.from_uri(uri)
    return files.open_input_file(path)


class Ranges:
    """Reads ranges of a file; those that follow each other share reads of CHUNK bytes."""

    def __init__(self, file: NativeFile) -> None:
        self.file, self.size = file, file.size()
        self._start, self._held = 0, b""

    def read(self, start: int, n: int) -> bytes:
        if start < 0 or start + n > self.size:
            raise ValueError(f"bytes {start} to {start + n} are outside of the file ({self.size} bytes)")
        if not self._start <= start <= start + n <= self._start + len(self._held):
            self._start, self._held = start, self.file.read_at(min(max(n, CHUNK), self.size - start), start)
        at = start - self._start
        return self._held[at : at + n]

    def chunks(self, start: int, n: int) -> Iterator[bytes]:
        for at in range(start, start + n, CHUNK):
            yield self.read(at, min(CHUNK, start + n - at))


def _directory(ranges: Ranges) -> tuple[int, int, int]:
    """Start of the central directory, number of its entries, and the bytes before the package itself."""
    tail_at = max(0, ranges.size - _END_BYTES)
    tail = ranges.read(tail_at, ranges.size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail)):
        at = tail.rfind(END, 0, at)  # the signature may also be part of a comment
    if at < 0:
        raise ValueError("not a ZIP file: no end record")
    entries, size, start = struct.unpack("<10xHII", tail[at : at + 20])
    end = tail_at + at
    locator = ranges.read(end - 20, 20) if end >= 20 else b""
    if locator[:4] != LOCATOR64 and (entries == _ALL16 or size == _ALL32 or start == _ALL32):
        raise ValueError("no ZIP64 locator before an end record that needs one")
    if locator[:4] == LOCATOR64:
        # something may lie before the package: then the record stands just before its locator
        for end in (int.from_bytes(locator[8:16], "little"), end - 20 - 56):
            if 0 <= end <= ranges.size - 56 and (record := ranges.read(end, 56))[:4] == END64:
                break
        else:
            raise ValueError("no ZIP64 end record where its locator points")
        entries, size, start = struct.unpack("<32xQQQ", record)
    before = end - size - start
    if before < 0:
        raise ValueError("the central directory overlaps the end record")
    return start + before, entries, before


def members(ranges: Ranges) -> Iterator[Member]:
    """The members in the order of the central directory."""
    at, entries, before = _directory(ranges)
    for _ in range(entries):
        head = ranges.read(at, 46)
        if head[:4] != CENTRAL:
            raise ValueError(f"no entry of the central directory at byte {at}")
        flags, method, size, plain, name_n, extra_n, comment_n, local = struct.unpack("<8xHH8xIIHHH8xI", head)
        rest = ranges.read(at + 46, name_n + extra_n)
        at += 46 + name_n + extra_n + comment_n
        name, extra = rest[:name_n].decode("utf-8" if flags & 0x800 else "cp437"), rest[name_n:]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the 64-bit values of those fields that are full
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain, size, local = (next(values) if x == _ALL32 else x for x in (plain, size, local))
            extra = extra[4 + n :]
        head = ranges.read(local + before, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name} at byte {local + before}")
        name_n, extra_n = struct.unpack("<26xHH", head)
        yield Member(name, method, local + before + 30 + name_n + extra_n, size)


def _plain(chunks: Iterator[bytes], packed: bool) -> Iterator[bytes]:
    """The chunks, or what these gzip members hold."""
    if not packed:
        yield from chunks
        return
    reader = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield reader.decompress(chunk)
            chunk = reader.unused_data
            if reader.eof:
                reader = zlib.decompressobj(31)


def _lines(chunks: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _walked(ranges: Ranges, member: Member) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of a member without an index: gzip members, or records by the lengths that they state."""
    if member.name.endswith(".gz"):
        at, reader, end = 0, zlib.decompressobj(31), 0
        for chunk in ranges.chunks(member.start, member.size):
            end += len(chunk)
            while chunk:
                reader.decompress(chunk)
                chunk = reader.unused_data
                if reader.eof:
                    yield at, end - len(chunk) - at
                    at, reader = end - len(chunk), zlib.decompressobj(31)
        return
    at = 0
    while at < member.size:
        n, head = 0, b""
        while b"\r\n\r\n" not in head and n < member.size - at:
            n = min(n + 4096, member.size - at)
            head = ranges.read(member.start + at, n)
        found = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", head.partition(b"\r\n\r\n")[0])
        if not found:
            raise ValueError(f"no record of a known length in {member.name} at byte {at}")
        length = head.index(b"\r\n\r\n") + 4 + int(found[1]) + 4
        yield at, length
        at += length


def entries(ranges: Ranges) -> Iterator[tuple[str, int, int]]:
    """(member, start in the file, length) of each record in the package's WARC members, by its indexes (CDXJ lines).

    Members that no index names are walked through.  A WARC member or index that is compressed as a whole can't be read by
    ranges: ValueError.
    """
    found = {m.name: m for m in members(ranges)}
    warcs = {n: m for n, m in found.items() if re.search(r"\.warc(\.gz)?$", n)}
    indexes = [m for n, m in found.items() if re.search(r"\.cdxj?(\.gz)?$", n)]
    for m in (*warcs.values(), *indexes):
        if m.method:
            raise ValueError(f"{m.name} isn't stored as it is")
    indexed = set()
    for index in indexes:
        for line in _lines(_plain(ranges.chunks(index.start, index.size), index.name.endswith(".gz"))):
            if not line.strip() or line.startswith(b"!"):
                continue
            entry = json.loads(line[line.index(b"{") :])
            member = warcs.get(f"archive/{entry['filename']}") or warcs[entry["filename"]]
            indexed.add(member.name)
            yield member.name, member.start + int(entry["offset"]), int(entry["length"])
    for name, member in warcs.items():
        if name not in indexed:
            yield from ((name, member.start + at, n) for at, n in _walked(ranges, member))
