"""BGZF files in splits: blocks from any byte on, virtual offsets, and the alignment records that begin in a split.

A virtual offset is (file offset of a block, place in its data). A split of bytes owns the records that begin in blocks whose
first byte it has. Where its first block begins is settled by a block's own checksum; where the first record begins, by the
form of records: sizes that add up, a name that ends in zero, references and operations that exist, tags that end where the record
ends, over ``CHAIN`` records in a row or up to the file's end.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

MAGIC = b"\x1f\x8b\x08\x04"
#: The most bytes that a block has, bytes read at once, records in a row that make a boundary.
BLOCK, READ, CHAIN = 1 << 16, 1 << 20, 8
#: Bytes of a tag's value by its type letter (fixed values).
TAG_BYTES = {65: 1, 99: 1, 67: 1, 115: 2, 83: 2, 105: 4, 73: 4, 102: 4}
_SIZE = struct.Struct("<i")
_NAME = re.compile(rb"[!-~]*\0")


def block_bytes(head: bytes, at: int = 0) -> int | None:
    """Bytes of the block that begins there, or None."""
    if head[at : at + 4] != MAGIC or len(head) < at + 12:
        return None
    extra = struct.unpack_from("<H", head, at + 10)[0]
    place, end = at + 12, at + 12 + extra
    while place + 6 <= min(end, len(head)):
        field, n = head[place : place + 2], struct.unpack_from("<H", head, place + 2)[0]
        if field == b"BC" and n == 2:
            return struct.unpack_from("<H", head, place + 4)[0] + 1
        place += 4 + n
    return None


def inflate(block: bytes) -> bytes:
    """A block's data; an error if its checksum or size is wrong."""
    extra = struct.unpack_from("<H", block, 10)[0]
    data = zlib.decompress(block[12 + extra : -8], -15, BLOCK)
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("a BGZF block is damaged")
    return data


class Window:
    """A file's bytes, ``READ`` at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.have = file, size, 0, b""

    def bytes(self, start: int, n: int) -> bytes:
        if start < self.at or start + n > self.at + len(self.have):
            self.file.seek(start)
            self.at, self.have = start, self.file.read(min(max(n, READ), self.size - start)) if start < self.size else b""
        return self.have[start - self.at : start - self.at + n]


def first_block(window: Window, start: int, end: int) -> int | None:
    """Where the first block at ``start`` or behind begins, if that is before ``end``."""
    at = start
    while at < min(end, window.size):
        found = window.bytes(at, READ).find(MAGIC)
        if found < 0:
            at += READ - len(MAGIC) + 1
            continue
        at += found
        n = block_bytes(window.bytes(at, 1 << 12)) if at < end else None
        if n and at + n <= window.size:
            try:
                inflate(window.bytes(at, n))
                return at
            except (ValueError, struct.error, zlib.error):
                pass
        at += 1
    return None


class Stream:
    """The data of consecutive blocks, and which block a place is of. Data before ``at`` are let go."""

    def __init__(self, window: Window, block: int):
        self.window, self.next = window, block
        self.data, self.at = bytearray(), 0  # ``at``: place in ``data``
        self.blocks: list[tuple[int, int]] = []  # (place of its first byte in ``data``, file offset)

    def more(self) -> bool:
        """Another block's data, unless the file ends."""
        while self.next < self.window.size:
            n = block_bytes(self.window.bytes(self.next, 1 << 12))
            if not n:
                raise ValueError(f"no BGZF block at byte {self.next}")
            block = self.window.bytes(self.next, n)
            if len(block) < n:
                raise ValueError("a BGZF file ends early")
            data, place = inflate(block), self.next
            self.next += n
            if data:
                self.blocks.append((len(self.data), place))
                self.data += data
                return True
        return False

    def need(self, n: int) -> bool:
        """Whether ``n`` bytes follow; all or none of them must."""
        while len(self.data) - self.at < n:
            if not self.more():
                if len(self.data) > self.at:
                    raise ValueError("BAM ends early")
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.need(n):
            return b""
        out = bytes(self.data[self.at : self.at + n])
        self.at += n
        if self.at > READ:
            self.drop()
        return out

    def drop(self) -> None:
        last = max((i for i, (p, _) in enumerate(self.blocks) if p <= self.at), default=0)
        cut = self.blocks[last][0] if self.blocks else 0
        del self.data[:cut]
        self.at -= cut
        self.blocks = [(p - cut, o) for p, o in self.blocks[last:]]

    def offset(self) -> tuple[int, int] | None:
        """The virtual offset of what comes next, or None at the end."""
        if len(self.data) == self.at and not self.more():
            return None
        place, block = next((p, o) for p, o in reversed(self.blocks) if p <= self.at)
        return block, self.at - place


def header(stream: Stream) -> tuple[bytes, list[tuple[str, int]]]:
    """(text, references as (name, length)); the stream is left at the first record."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("no BAM")
    text = stream.take(struct.unpack("<i", stream.take(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        name = stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", stream.take(4))[0]))
    return text, refs


def record_bytes(data: bytes, at: int, refs: list[tuple[str, int]]) -> int | None:
    """Bytes of what could be a whole record there with its size before it; 0 if more data must tell; None if it is none."""
    left = len(data) - at
    if left < 36:
        return 0
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    body = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq
    if n_seq < 0 or n_name < 1 or size < body or not (-1 <= ref < len(refs) and -1 <= next_ref < len(refs)) or pos < -1 or next_pos < -1:
        return None
    name = data[at + 36 : at + 36 + n_name]
    if not (_NAME.fullmatch(name) if len(name) == n_name else re.fullmatch(rb"[!-~]*", name)):
        return None
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_cigar : 4]
    if any(x & 15 > 8 for x in ops):
        return None
    if left < 4 + size:
        return 0
    place, end = at + 4 + body, at + 4 + size
    while place < end:
        if place + 3 > end or not chr(data[place]).isalpha() or not chr(data[place + 1]).isalnum():
            return None
        kind = data[place + 2]
        place += 3
        if kind in b"ZH":
            place = data.find(b"\0", place, end) + 1
            if not place:
                return None
        elif kind == 66:
            if place + 5 > end or data[place] not in TAG_BYTES or data[place] == 65:
                return None
            place += 5 + struct.unpack_from("<I", data, place + 1)[0] * TAG_BYTES[data[place]]
        elif kind in TAG_BYTES:
            place += TAG_BYTES[kind]
        else:
            return None
    return 4 + size if place == end else None


def begins(stream: Stream, at: int, refs: list[tuple[str, int]], chain: int = CHAIN) -> bool:
    """Whether a row of records begins at a place of the stream's data."""
    for _ in range(chain):
        while (n := record_bytes(stream.data, at, refs)) == 0:
            if not stream.more():
                return at == len(stream.data)
        if n is None:
            return False
        at += n
    return True


def runs(window: Window, start: int, end: int, exact: tuple[int, int] | None = None):
    """(references, iterator of runs of whole records) of the split: (data, where each record's size begins in them, and its virtual
    offset as an array of blocks and one of places). ``exact``: a virtual offset to begin at."""
    first = Stream(window, 0)
    _, refs = header(first)

    def own():
        if exact is not None:
            stream = Stream(window, exact[0])
            stream.offset()
            stream.at = exact[1]
        elif start == 0:
            stream = first
        else:
            block = first_block(window, start, end)
            if block is None:
                return
            stream = Stream(window, block)
            while True:
                where = stream.offset()
                if where is None or where[0] >= end:
                    return
                if where >= header_end and begins(stream, stream.at, refs):
                    break
                stream.at += 1
                if stream.at > READ:
                    stream.drop()
        while (where := stream.offset()) is not None and where[0] < end:
            data = stream.data
            while len(data) - stream.at < READ and stream.next < end and stream.more():
                pass
            stream.need(4)
            if (n := _SIZE.unpack_from(data, stream.at)[0]) >= 32:
                stream.need(4 + n)
            stop = next((p for p, o in stream.blocks if o >= end), len(data))
            found, at = [], stream.at
            while at < stop and len(data) - at >= 4:
                n = _SIZE.unpack_from(data, at)[0]
                if n < 32:
                    raise ValueError("no BAM record where one should be")
                if len(data) - at < 4 + n:
                    break
                found.append(at)
                at += 4 + n
            starts = np.array(found, np.int64)
            places, blocks = (np.array(x, np.int64) for x in zip(*stream.blocks, strict=True))
            of = np.searchsorted(places, starts, "right") - 1
            run = bytes(data[stream.at : at])
            yield run, starts - stream.at, blocks[of], starts - places[of]
            stream.at = at
            stream.drop()

    header_end = first.offset() or (window.size, 0)
    return refs, own()


def records(window: Window, start: int, end: int, exact: tuple[int, int] | None = None):
    """(references, iterator of (virtual offset, record bytes)) of the split."""
    refs, found = runs(window, start, end, exact)

    def each():
        for data, starts, blocks, places in found:
            for a, b, block, place in zip(starts.tolist(), [*starts[1:].tolist(), len(data)], blocks.tolist(), places.tolist(), strict=True):
                yield (block, place), data[a + 4 : b]

    return refs, each()
