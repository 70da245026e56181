"""Joining Parquet files by copying their encoded row groups and writing a new footer; no page is decoded.

The footer is Thrift's compact protocol.  It is read into generic nodes that keep every field, so what this module does not
know is carried over; only positions, counts and the list of row groups change.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass
from typing import BinaryIO

MAGIC = b"PAR1"
#: Bytes that are copied at once.
PIECE = 4 << 20
#: Wire types of Thrift's compact protocol (fixed values).
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
#: Field numbers of parquet.thrift (fixed values): FileMetaData, RowGroup, ColumnChunk, ColumnMetaData.
FILE_SCHEMA, FILE_ROWS, FILE_GROUPS, FILE_KEYS = 2, 3, 4, 5
GROUP_COLUMNS, GROUP_SIZE, GROUP_ROWS, GROUP_AT, GROUP_PACKED, GROUP_ORDINAL = 1, 2, 3, 5, 6, 7
CHUNK_FILE, CHUNK_AT, CHUNK_META, CHUNK_INDEXES = 1, 2, 3, (4, 5, 6, 7)
META_PACKED, META_DATA, META_INDEX, META_DICTIONARY, META_BLOOM = 7, 9, 10, 11, (14, 15)


class Reader:
    """Generic reader: a struct is ``{field: (type, value)}``, a list ``(type, values)``."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        shift = value = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("footer ends early")
        return self.data[self.at - n : self.at]

    def value(self, kind: int, inside: bool = False) -> object:
        if kind in (TRUE, FALSE):
            return self.take(1)[0] if inside else kind
        if kind == BYTE:
            return self.take(1)
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            return self.take(8)
        if kind == BINARY:
            return self.take(self.varint())
        if kind in (LIST, SET):
            head = self.take(1)[0]
            n = head >> 4 if head >> 4 < 15 else self.varint()
            return head & 15, [self.value(head & 15, True) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"unexpected type {kind} in a footer")

    def struct(self) -> dict:
        out, last = {}, 0
        while head := self.take(1)[0]:
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            out[last] = head & 15, self.value(head & 15)
        return out


def packed(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encoded(kind: int, value: object, inside: bool = False) -> bytes:
    """The bytes that ``Reader.value`` reads back."""
    if kind in (TRUE, FALSE):
        return bytes([value]) if inside else b""
    if kind in (BYTE, DOUBLE):
        return value
    if kind in (I16, I32, I64):
        return packed(value << 1 if value >= 0 else (-value << 1) - 1)
    if kind == BINARY:
        return packed(len(value)) + value
    if kind in (LIST, SET):
        sub, items = value
        head = bytes([len(items) << 4 | sub]) if len(items) < 15 else bytes([0xF0 | sub]) + packed(len(items))
        return head + b"".join(encoded(sub, x, True) for x in items)
    out, last = bytearray(), 0
    for number, (sub, x) in sorted(value.items()):
        step = number - last
        out += bytes([step << 4 | sub]) if 0 < step < 16 else bytes([sub]) + packed(number << 1)
        out += encoded(sub, x)
        last = number
    return bytes(out) + b"\0"


@dataclass
class Footer:
    """A file's metadata with what the planner needs to know."""

    meta: dict
    blocks: int
    rows: int
    schema: bytes


def read_footer(file: BinaryIO, length: int) -> Footer:
    """Footer of a Parquet file; ValueError if it is none or its counts disagree."""
    if length < 12:
        raise ValueError("too short for a Parquet file")
    file.seek(length - 8)
    size, magic = struct.unpack("<I4s", file.read(8))
    if magic != MAGIC or size + 12 > length:
        raise ValueError("not a plain Parquet file")
    file.seek(length - 8 - size)
    meta = Reader(file.read(size)).struct()
    groups = meta[FILE_GROUPS][1][1]
    if sum(g[GROUP_ROWS][1] for g in groups) != meta[FILE_ROWS][1]:
        raise ValueError("row groups don't add up to the row total")
    return Footer(meta, len(groups), meta[FILE_ROWS][1], encoded(*meta[FILE_SCHEMA]))


def block_span(group: dict) -> tuple[int, int]:
    """First byte and length of a row group's pages."""
    spans = []
    for chunk in group[GROUP_COLUMNS][1][1]:
        m = chunk[CHUNK_META][1]
        start = min(m[k][1] for k in (META_DATA, META_INDEX, META_DICTIONARY) if k in m and m[k][1] > 0)
        spans.append((start, start + m[META_PACKED][1]))
    return min(a for a, _ in spans), max(b for _, b in spans) - min(a for a, _ in spans)


def moved(group: dict, by: int, ordinal: int) -> dict:
    """The row group ``by`` bytes further on; page indexes and bloom filters stay behind."""
    columns = []
    for chunk in group[GROUP_COLUMNS][1][1]:
        if CHUNK_FILE in chunk:
            raise ValueError("columns in another file can't be joined")
        m = {k: v for k, v in chunk[CHUNK_META][1].items() if k not in META_BLOOM}
        for k in (META_DATA, META_INDEX, META_DICTIONARY):
            if k in m and m[k][1] > 0:
                m[k] = m[k][0], m[k][1] + by
        own = {k: v for k, v in chunk.items() if k not in CHUNK_INDEXES}
        columns.append(own | {CHUNK_AT: (I64, max(0, own[CHUNK_AT][1] + by) if own[CHUNK_AT][1] else 0), CHUNK_META: (STRUCT, m)})
    out = group | {GROUP_COLUMNS: (LIST, (STRUCT, columns))}
    if GROUP_AT in out:
        out[GROUP_AT] = I64, out[GROUP_AT][1] + by
    if GROUP_ORDINAL in out:
        out[GROUP_ORDINAL] = I16, ordinal
    return out


def copied(source: BinaryIO, target: BinaryIO, size: int) -> None:
    """Copy so many bytes in pieces."""
    while size:
        data = source.read(min(size, PIECE))
        if not data:
            raise ValueError("a row group ends early")
        target.write(data)
        size -= len(data)


def join_files(sources: Iterable[tuple[BinaryIO, int]], target: BinaryIO) -> Footer:
    """Copy all row groups of the sources, in order, into one file; schemas must be equal byte for byte.

    Sources are taken one after the other, so a generator can open each when its turn comes and close it after.
    """
    target.write(MAGIC)
    at, groups, first = len(MAGIC), [], None
    for file, length in sources:
        footer = read_footer(file, length)
        first = first or footer
        if footer.schema != first.schema:
            raise ValueError("schemas differ")
        for group in footer.meta[FILE_GROUPS][1][1]:
            start, size = block_span(group)
            file.seek(start)
            copied(file, target, size)
            groups.append(moved(group, at - start, len(groups) % 32768))
            at += size
    if first is None:
        raise ValueError("no file to join")
    rows = sum(g[GROUP_ROWS][1] for g in groups)
    meta = first.meta | {FILE_ROWS: (I64, rows), FILE_GROUPS: (LIST, (STRUCT, groups))}
    tail = encoded(STRUCT, meta)
    target.write(tail + struct.pack("<I", len(tail)) + MAGIC)
    return Footer(meta, len(groups), rows, first.schema)
