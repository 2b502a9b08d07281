"""ZIP archives by ranges: the end records, the central directory and single members, without holding an archive.

Everything takes a file that can seek and read; `opened` gives one for any path that Spark lists, and `Part` a stretch of
another file, so that an archive stored within an archive is read in place.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from quarrylight.session import filesystem

# Fixed values of the format: signatures and sizes of its records, the id of the 64-bit field, what stands for "see there".
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR64_SIZE = 30, 46, 22, 56, 20
LONG_FIELD, SEE_LONG, SEE_LONG_COUNT, COMMENT = 0x0001, 0xFFFFFFFF, 0xFFFF, 0xFFFF
STORED, DEFLATED = 0, 8
PIECE = 1 << 20


class Damaged(ValueError):
    """No archive, or one whose records contradict each other."""


@dataclass(frozen=True)
class Member:
    """header: where its local header stands."""

    filename: str
    flag_bits: int
    method: int
    crc: int
    compress_size: int
    file_size: int
    external_attr: int
    header: int


@dataclass(frozen=True)
class Ends:
    """Where the central directory stands, its bytes and members, and how far the archive stands behind where its own offsets begin."""

    start: int
    size: int
    members: int
    shift: int


class Part(io.RawIOBase):
    """A stretch of another file."""

    def __init__(self, file, start: int, length: int):
        self.file, self.start, self.length, self.at = file, start, length, 0

    def seek(self, at: int, whence: int = 0) -> int:
        self.at = at + (0, self.at, self.length)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        left = max(0, self.length - self.at)
        n = left if n is None or n < 0 else min(n, left)
        self.file.seek(self.start + self.at)
        got = self.file.read(n)
        self.at += len(got)
        return got


def opened(uri: str):
    """A file that can seek, for a path as Spark gives it."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def size_of(file) -> int:
    file.seek(0, 2)
    return file.tell()


def _at(file, start: int, n: int) -> bytes:
    if start < 0:
        raise Damaged("a record before the beginning")
    file.seek(start)
    got = file.read(n)
    if len(got) < n:
        raise Damaged("a record beyond the end")
    return got


def ends(file) -> Ends:
    """From the end record, the last that fits, and the 64-bit one where that says so."""
    size = size_of(file)
    tail_at = max(0, size - END_SIZE - COMMENT)
    tail = _at(file, tail_at, size - tail_at)
    found = tail.rfind(END)
    while found >= 0 and len(tail) - found < END_SIZE:
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise Damaged("no end record")
    at = tail_at + found
    members, length, start = struct.unpack_from("<HII", tail, found + 10)
    last = at
    if at >= LOCATOR64_SIZE:
        locator = _at(file, at - LOCATOR64_SIZE, LOCATOR64_SIZE)
        if locator[:4] == LOCATOR64:
            told = struct.unpack_from("<Q", locator, 8)[0]
            for place in (told, at - LOCATOR64_SIZE - END64_SIZE):  # the second: something stands before the archive
                if 0 <= place <= size - END64_SIZE and (long := _at(file, place, END64_SIZE))[:4] == END64:
                    members, length, start = struct.unpack_from("<QQQ", long, 32)
                    last = place
                    break
            else:
                raise Damaged("no 64-bit end record")
    if last - length - start < 0:
        raise Damaged("a directory that overlaps the end record")
    return Ends(last - length, length, members, last - length - start)


def directory(file, end: Ends | None = None) -> Iterator[Member]:
    """The members that the central directory names, in its order, read in pieces."""
    end = end or ends(file)
    held, at, stop = b"", end.start, end.start + end.size

    def more(n: int) -> None:
        nonlocal held, at
        while len(held) < n:
            take = min(PIECE, stop - at)
            if take <= 0:
                raise Damaged("a directory that ends too early")
            held += _at(file, at, take)
            at += take

    while held or at < stop:
        more(CENTRAL_SIZE)
        if held[:4] != CENTRAL:
            raise Damaged("no member where one should be")
        flags, method = struct.unpack_from("<HH", held, 8)
        crc, small, large, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", held, 16)
        external, header = struct.unpack_from("<II", held, 38)
        whole = CENTRAL_SIZE + n_name + n_extra + n_comment
        more(whole)
        raw, extra = held[CENTRAL_SIZE : CENTRAL_SIZE + n_name], held[CENTRAL_SIZE + n_name : whole - n_comment]
        held = held[whole:]
        i = 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == LONG_FIELD:
                longs = [x for (x,) in struct.iter_unpack("<Q", extra[i + 4 : i + 4 + n // 8 * 8])]
                try:
                    large = longs.pop(0) if large == SEE_LONG else large
                    small = longs.pop(0) if small == SEE_LONG else small
                    header = longs.pop(0) if header == SEE_LONG else header
                except IndexError:
                    raise Damaged("a 64-bit field that is too short") from None
            i += 4 + n
        try:
            name = raw.decode("utf-8" if flags & 0x800 else "cp437")
        except UnicodeDecodeError:
            raise Damaged("a name that is no text") from None
        yield Member(name.split("\0")[0] if "\0" in name else name, flags, method, crc, small, large, external, header + end.shift)


def data_start(file, m: Member) -> int:
    """Where a member's bytes begin."""
    head = _at(file, m.header, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise Damaged("no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return m.header + LOCAL_SIZE + n_name + n_extra


def pieces(file, m: Member) -> Iterator[bytes]:
    """A member's content, inflated, in pieces of about PIECE; Damaged if size or checksum are not those that the directory names."""
    at = data_start(file, m)
    left, seen, crc = m.compress_size, 0, 0
    if m.method not in (STORED, DEFLATED):
        raise Damaged(f"method {m.method}")
    inflate = zlib.decompressobj(-15) if m.method == DEFLATED else None
    try:
        while left or (inflate and inflate.unconsumed_tail):
            if inflate and inflate.unconsumed_tail:
                piece = inflate.decompress(inflate.unconsumed_tail, PIECE)
            else:
                raw = _at(file, at, min(PIECE, left))
                at, left = at + len(raw), left - len(raw)
                piece = inflate.decompress(raw, PIECE) if inflate else raw
            seen, crc = seen + len(piece), zlib.crc32(piece, crc)
            if seen > m.file_size:
                raise Damaged("more content than the directory names")
            if piece:
                yield piece
            if inflate and inflate.eof:
                break
        if inflate and (rest := inflate.flush()):
            seen, crc = seen + len(rest), zlib.crc32(rest, crc)
            yield rest
    except zlib.error as e:
        raise Damaged(str(e)) from None
    if seen != m.file_size or crc != m.crc:
        raise Damaged("size or checksum")
