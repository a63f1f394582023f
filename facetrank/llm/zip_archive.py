"""ZIP directories and stored members, read by ranges.

`Reader` needs only a function that returns a range of bytes. It finds the end record, follows the ZIP64 locator
where there is one, and parses the central directory. Members that are stored (not compressed, not encrypted) can be
read at any place without extraction; compressed or encrypted ones are listed and refused when they are read.
`Writer` makes such archives, in ZIP64 form throughout.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

_LOCAL = struct.Struct("<4s5H3I2H")
_CENTRAL = struct.Struct("<4s6H3I5H2I")
_END = struct.Struct("<4s4H2IH")
_LOCATOR = struct.Struct("<4sIQI")
_END64 = struct.Struct("<4sQ2H2I4Q")

_FULL_16, _FULL_32 = 0xFFFF, 0xFFFFFFFF
_ZIP64 = 1  # kind of the extra field that holds what does not fit
_UTF8 = 1 << 11
_ENCRYPTED = 1
#: The end record and the longest comment after it.
_TAIL = _END.size + _FULL_16


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    crc: int
    size: int
    packed: int
    header_at: int

    @property
    def is_stored(self) -> bool:
        return self.method == 0 and not self.flags & _ENCRYPTED and self.size == self.packed


class Reader:
    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size

    def _end(self) -> tuple[int, int, int]:
        """Entries, bytes and place of the central directory."""
        begin = max(0, self.size - _TAIL)
        tail = self.read(begin, self.size - begin)
        at = tail.rfind(b"PK\5\6")
        # A comment may hold the same four bytes: the right record's comment ends with the file.
        while at >= 0 and (at + _END.size > len(tail) or at + _END.size + _END.unpack_from(tail, at)[7] != len(tail)):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        _, _, _, _, entries, size, place, _ = _END.unpack_from(tail, at)
        locator_at = begin + at - _LOCATOR.size
        if locator_at >= 0:
            data = self.read(locator_at, _LOCATOR.size)
            if data[:4] == b"PK\6\7":
                record = _END64.unpack(self.read(_LOCATOR.unpack(data)[2], _END64.size))
                if record[0] != b"PK\6\6":
                    raise ValueError("no ZIP64 end record where the locator points")
                entries, size, place = record[7:10]
        return entries, size, place

    def members(self) -> list[Member]:
        entries, size, place = self._end()
        directory = self.read(place, size)
        found, at = [], 0
        for _ in range(entries):
            (mark, _, _, flags, method, _, _, crc, packed, full, name_len, extra_len, comment_len, _, _, _,
             header_at) = _CENTRAL.unpack_from(directory, at)
            if mark != b"PK\1\2":
                raise ValueError("broken central directory")
            at += _CENTRAL.size
            name = directory[at : at + name_len]
            extra = directory[at + name_len : at + name_len + extra_len]
            at += name_len + extra_len + comment_len
            full, packed, header_at = _wide(extra, full, packed, header_at)
            found.append(Member(name.decode("utf-8" if flags & _UTF8 else "cp437"), method, flags, crc, full, packed, header_at))
        return found

    def data_at(self, member: Member) -> int:
        """Place of a stored member's first byte; the local header has names and extra fields of its own."""
        if not member.is_stored:
            raise ValueError(f"{member.name} is compressed or encrypted")
        head = _LOCAL.unpack(self.read(member.header_at, _LOCAL.size))
        if head[0] != b"PK\3\4":
            raise ValueError(f"no local header of {member.name}")
        return member.header_at + _LOCAL.size + head[9] + head[10]


def _wide(extra: bytes, *narrow: int) -> list[int]:
    """Values with those that are full replaced, in order, from the ZIP64 extra field."""
    if _FULL_32 not in narrow:
        return list(narrow)
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == _ZIP64:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return [next(wide) if value == _FULL_32 else value for value in narrow]
        at += 4 + length
    return list(narrow)


class Writer:
    """Stored members, each given as a whole, through a function that appends bytes and returns their place."""

    def __init__(self, append: Callable[[bytes], int]):
        self.append = append
        self.entries: list[bytes] = []

    def add(self, name: str, data: list[bytes]) -> int:
        """Returns the place of the member's first byte."""
        raw, crc, size = name.encode(), 0, sum(map(len, data))
        for part in data:
            crc = zlib.crc32(part, crc)
        extra = struct.pack("<2H2Q", _ZIP64, 16, size, size)
        head = _LOCAL.pack(b"PK\3\4", 45, _UTF8, 0, 0, 33, crc, _FULL_32, _FULL_32, len(raw), len(extra))
        at = self.append(head + raw + extra)
        for part in data:
            self.append(part)
        wide = struct.pack("<2H3Q", _ZIP64, 24, size, size, at)
        self.entries.append(_CENTRAL.pack(b"PK\1\2", 45, 45, _UTF8, 0, 0, 33, crc, _FULL_32, _FULL_32, len(raw),
                                          len(wide), 0, 0, 0, 0, _FULL_32) + raw + wide)
        return at + len(head) + len(raw) + len(extra)

    def finish(self) -> None:
        directory = b"".join(self.entries)
        place = self.append(directory)
        n = len(self.entries)
        end64 = self.append(_END64.pack(b"PK\6\6", _END64.size - 12, 45, 45, 0, 0, n, n, len(directory), place))
        self.append(_LOCATOR.pack(b"PK\6\7", 0, end64, 1))
        self.append(_END.pack(b"PK\5\6", _FULL_16, _FULL_16, _FULL_16, _FULL_16, _FULL_32, _FULL_32, 0))
