"""Baseline JPEG: markers, Huffman decoding, DC-only luminance thumbnails, lossless payloads.

The decoder reads baseline (SOF0) files of any component count and sampling: it parses the
markers, decodes the entropy-coded scan into quantised coefficients, and reconstructs a
thumbnail of one pixel for each 8x8 luminance block from the DC terms alone. Restart intervals
are decoded side by side with numpy: step k reads the k-th symbol of every interval still
open. A file without restart markers is one interval, and decodes one symbol at a time.

``encode`` writes a payload losslessly as a grey baseline JPEG whose unit is the quantised
coefficient: 64 bytes are one 8x8 block in zigzag order, byte b is coefficient b + 1 (so that
no zero runs occur), the quantisation table is all ones, and every block is its own restart
interval, so that blocks decode side by side. Blocks stand in rows of 16, and in longer rows where
16 would make a frame higher than its 16-bit field holds (payloads over 8,387,584 bytes); a last row
that is not full is filled with blocks of byte 0, and a comment segment tells the payload's length.

Every value is a function of the bytes stored, so equal texts get equal values. Files that do
not parse give nulls and an error text; null and empty texts are 64 bytes of zero.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Zigzag order of an 8x8 block, made by walking its diagonals.
ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in sorted(((y, s - y) for y in range(8) if 0 <= s - y < 8), reverse=s % 2 == 0)])
ROW_BLOCKS = 16
#: Blocks that the 16 bits of a frame's height or width have room for.
MOST_BLOCKS = 65535 // 8

# Code lengths of our tables: the category of most text bytes gets the shortest code.
DC_LENGTHS = {7: 1, 6: 2, 8: 3, 5: 4, 4: 5, 3: 6, 2: 7, 1: 8, 9: 9, 0: 10}
AC_LENGTHS = {7: 1, 6: 2, 8: 3, 5: 4, 4: 5, 3: 6, 2: 7, 1: 8, 9: 9, 0: 10}


def _table(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """DHT counts and symbols for code lengths by symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(symbols)


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, length, code) of a canonical table."""
    out, code, at = [], 0, 0
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            out.append((s, n, code))
            code += 1
        at += count
        code <<= 1
    return out


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For 16 bits ahead: symbol << 8 | code length, or 0 for no code."""
    out = np.zeros(1 << 16, np.int32)
    for s, n, code in _codes(counts, symbols):
        out[code << 16 - n : (code + 1) << 16 - n] = s << 8 | n
    return out


def _direct(lookup: np.ndarray) -> np.ndarray:
    """For 16 bits ahead, where code and value bits fit in 16 and the symbol has no run:
    (value + 2048) << 8 | bits used; else 0."""
    ahead = np.arange(1 << 16)
    size, n = lookup >> 8, lookup & 255
    fits = (n > 0) & (size > 0) & (size < 16) & (n + size <= 16)
    raw = ahead >> np.where(fits, 16 - n - size, 0) & (1 << np.where(fits, size, 0)) - 1
    value = np.where(raw >> np.maximum(size - 1, 0) & 1, raw, raw - (1 << np.where(fits, size, 0)) + 1)
    return np.where(fits, value + 2048 << 8 | n + size, 0).astype(np.int32)


class Malformed(ValueError):
    pass


# -- encoding ----------------------------------------------------------------------


def _symbol_bits(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its coefficient's code and value bits, and how many these are."""
    code = {s: (n, c) for s, n, c in _codes(*_table(lengths))}
    bits, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for b in range(256):
        category = (b + 1).bit_length()
        n, c = code[category]
        bits[b], size[b] = c << category | (b + 1), n + category
    return bits, size


_DC_BITS, _AC_BITS = _symbol_bits(DC_LENGTHS), _symbol_bits(AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


def _across(blocks: int) -> int:
    """Blocks in a row: as few over 16 as keep the frame's height within its field."""
    return max(min(blocks, ROW_BLOCKS), -(-blocks // MOST_BLOCKS))


def _headers(payload: int, blocks: int, across: int) -> bytes:
    rows = -(-blocks // across)
    wide = across * 8
    dht = b"".join(bytes((cls << 4,)) + b"".join(_table(t)) for cls, t in ((0, DC_LENGTHS), (1, AC_LENGTHS)))
    return (
        b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xFE, b"payload=%d" % payload) + _segment(0xDB, bytes(1) + bytes([1]) * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, wide, 1) + bytes((1, 0x11, 0))) + _segment(0xC4, dht) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes((1, 1, 0x00, 0, 63, 0)))
    )


def _pack_bits(bits: np.ndarray, at: np.ndarray, size: np.ndarray, total: int) -> np.ndarray:
    """Bytes of a bit string with value ``bits[i]`` (at most 32 bits) at place ``at[i]``; places follow
    each other without gaps."""
    word, room = at >> 5, 64 - (at & 31) - size
    both = bits << room.astype(np.uint64)  # 64 bits from the word's start on
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(total // 32 + 3, np.uint64)
    out[word[first]] = np.add.reduceat(both >> np.uint64(32), first)
    last = np.concatenate([first[1:] - 1, [len(word) - 1]])
    out[word[last] + 1] += both[last] & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").view(np.uint8)[: total // 8]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as a JPEG."""
    full, wide = [], []
    for p in payloads:
        if not p or len(p) % 64:
            raise ValueError("a payload is a positive multiple of 64 bytes")
        n = len(p) // 64
        wide.append(_across(n))
        full.append(-(-n // wide[-1]) * wide[-1])
    blocks = np.array(full)
    data = np.frombuffer(b"".join(p + bytes(64 * n - len(p)) for p, n in zip(payloads, full, strict=True)), np.uint8).reshape(-1, 64)
    size, bits = _AC_BITS[1][data], _AC_BITS[0][data]
    size[:, 0], bits[:, 0] = _DC_BITS[1][data[:, 0]], _DC_BITS[0][data[:, 0]]
    used = size.sum(axis=1)
    pad = -used % 8
    # padding is one more symbol of ones
    size = np.concatenate([size, pad[:, None]], axis=1)
    bits = np.concatenate([bits, ((1 << pad) - 1).astype(np.uint64)[:, None]], axis=1)
    flat = size.ravel()
    at = np.cumsum(flat) - flat
    raw = _pack_bits(bits.ravel(), at, flat, int(flat.sum()))
    # FF is followed by 00, each interval but a file's last by a restart marker
    of_block = (used + pad) // 8
    end = np.cumsum(of_block)
    number = np.arange(len(blocks)).repeat(blocks)
    within = np.arange(len(data)) - (np.cumsum(blocks) - blocks)[number]
    marked = within < blocks[number] - 1
    width = np.ones(len(raw), np.int64) + (raw == 0xFF)
    width[end - 1] += 2 * marked
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[place] = raw
    tail = (place + width)[end - 1][marked]
    out[tail - 2], out[tail - 1] = 0xFF, 0xD0 + within[marked] % 8
    cut = np.concatenate([[0], (place + width)[end[np.cumsum(blocks) - 1] - 1]])
    scan = out.tobytes()
    return [_headers(len(p), n, w) + scan[a:b] + b"\xff\xd9" for p, n, w, a, b in zip(payloads, full, wide, cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


# -- decoding ----------------------------------------------------------------------


class Jpeg:
    """The parsed markers of one file; ``scan`` is the place of its entropy-coded data."""

    def __init__(self, data: bytes):
        self.data, self.quant, self.huffman, self.restart, self.comment = data, {}, {}, 0, b""
        self.components: list[list[int]] = []
        self.order: list[tuple[int, int, int]] = []
        if data[:2] != b"\xff\xd8":
            raise Malformed("no SOI")
        at = 2
        while True:
            if at + 4 > len(data):
                raise Malformed("no scan")
            if data[at] != 0xFF:
                raise Malformed("no marker")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            n = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            if n < 2 or len(body) != n - 2:
                raise Malformed("short segment")
            at += 2 + n
            try:
                if self._segment(marker, body):
                    self.scan = at
                    return
            except (IndexError, struct.error, KeyError):
                raise Malformed("bad segment") from None

    def _segment(self, marker: int, body: bytes) -> bool:
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                step = 128 if wide else 64
                if len(body) < 1 + step:
                    raise Malformed("short quantisation table")
                self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + step], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + step :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                if len(body) < 17 + n:
                    raise Malformed("short Huffman table")
                self.huffman[body[0]] = (bytes(counts), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not self.height or not self.width or not n:
                raise Malformed("unsupported frame")
            self.components = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(n)]
            if not all(1 <= c[1] <= 4 and 1 <= c[2] <= 4 for c in self.components):
                raise Malformed("bad sampling")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Malformed("not baseline")
        elif marker == 0xDD:
            self.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            self.comment = bytes(body)
        elif marker == 0xD9:
            raise Malformed("no scan")
        elif marker == 0xDA:
            known = {c[0]: i for i, c in enumerate(self.components)}
            self.order = [(known[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if len(self.order) != len(self.components):
                raise Malformed("scan of some components")
            return True
        return False

    def layout(self) -> tuple[int, int, list[tuple[int, int, int]], int]:
        """MCUs across, MCUs in all, (component, DC table, AC table) of an MCU's blocks, and how many of
        these are luminance."""
        if len(self.components) == 1:
            across, down, h, v = -(-self.width // 8), -(-self.height // 8), 1, 1
            blocks = [(self.order[0][0], *self.order[0][1:])]
        else:
            h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
            across, down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
            blocks = [(c, d, a) for c, d, a in self.order for _ in range(self.components[c][1] * self.components[c][2])]
        return across, across * down, blocks, 0


def _tables(j: Jpeg, cache: dict) -> tuple:
    key = tuple(sorted(j.huffman.items()))
    if key not in cache:
        cache.clear()
        full = {k: _lookup(*t) for k, t in j.huffman.items()}
        cache[key] = (full, {k: _direct(t) for k, t in full.items()})
    return cache[key]


def _intervals(data: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Unstuffed entropy bytes from ``start`` on, the places where intervals begin in them, and
    the place in ``data`` of the marker that ends the scan."""
    part = data[start:]
    ff = np.flatnonzero(part[:-1] == 0xFF)
    follow = part[ff + 1]
    stop = ff[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7)) & (follow != 0xFF)]
    end = int(stop[0]) if len(stop) else len(part)
    ff, follow = ff[ff < end], follow[: np.searchsorted(ff, end)]
    keep = np.ones(end, bool)
    keep[ff[follow == 0] + 1] = False
    marks = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    keep[ff[follow == 0xFF]] = False
    place = np.cumsum(keep)
    return part[:end][keep], np.concatenate([[0], place[marks + 1]]), start + end


def decode(j: Jpeg, cache: dict | None = None) -> np.ndarray:
    """Quantised coefficients in zigzag order, (MCU, block of the MCU, 64), with DC terms summed."""
    full, direct = _tables(j, {} if cache is None else cache)
    across, total, blocks, _ = j.layout()
    raw, begin, _ = _intervals(np.frombuffer(j.data, np.uint8), j.scan)
    # a block takes two bits at least, so that a header alone cannot ask for memory
    if 2 * total * len(blocks) > 8 * len(raw):
        raise Malformed("data ends early")
    each = j.restart or total
    n = -(-total // each)
    if len(begin) < n:
        raise Malformed("missing intervals")
    begin = begin[:n]
    limit = np.concatenate([begin[1:], [len(raw)]]) * 8
    padded = np.concatenate([raw, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    ahead = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    out = np.zeros((n, each, len(blocks), 64), np.int16)
    pos = begin.astype(np.int64) * 8
    pred = np.zeros((n, len(j.components)), np.int64)
    mcus = np.minimum(each, total - np.arange(n) * each)

    def peek(p):
        if len(p) and (p >> 3).max() >= len(ahead):
            raise Malformed("data ends early")
        return (ahead[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(16)

    def symbol(who, table):
        """Reads one symbol and its value bits for each interval in ``who``: run, size, value."""
        w = peek(pos[who])
        got = full[table][w]
        if not got.all():
            raise Malformed("no such code")
        pos[who] += got & 255
        s = got >> 8
        size = s & 15
        v = peek(pos[who]).astype(np.int64) >> (16 - size)
        value = np.where(size == 0, 0, np.where(v >> np.maximum(size - 1, 0) & 1, v, v - (1 << size) + 1))
        pos[who] += size
        return s >> 4, size, value

    for m in range(each):
        who = np.flatnonzero(mcus > m)
        for b, (c, d, a) in enumerate(blocks):
            if d not in full or a + 16 not in full:
                raise Malformed("no Huffman table")
            run, _, value = symbol(who, d)
            pred[who, c] += value
            out[who, m, b, 0] = pred[who, c]
            k = np.ones(len(who), np.int64)
            act = np.arange(len(who))
            quick = direct[a + 16]
            while len(act):
                w = who[act]
                got = quick[peek(pos[w])]
                if got.all():
                    out[w, m, b, k[act]] = (got >> 8) - 2048
                    pos[w] += got & 255
                    k[act] += 1
                else:
                    run, size, value = symbol(w, a + 16)
                    k[act] += run
                    if (k[act][size > 0] > 63).any():
                        raise Malformed("run past the block")
                    put = size > 0
                    out[w[put], m, b, k[act][put]] = value[put]
                    k[act] += 1
                    k[act[(size == 0) & (run < 15)]] = 64  # end of block
                act = act[k[act] < 64]
    if (pos > limit + 7).any():
        raise Malformed("data ends early")
    return out.reshape(n * each, len(blocks), 64)[:total]


def thumbnail(j: Jpeg, coefficients: np.ndarray) -> np.ndarray:
    """One 8-bit pixel for each 8x8 block of the first component, from the DC terms."""
    across, total, blocks, _ = j.layout()
    first = j.order[0][0]
    own = [i for i, b in enumerate(blocks) if b[0] == first]
    h, v = (1, 1) if len(j.components) == 1 else j.components[first][1:3]
    q = j.quant.get(j.components[first][3])
    if q is None:
        raise Malformed("no quantisation table")
    dc = coefficients[:, own, 0].astype(np.int64) * int(q[0])
    grid = dc.reshape(total // across, across, v, h).transpose(0, 2, 1, 3).reshape(total // across * v, across * h)
    wide, high = (j.width, j.height) if len(j.components) == 1 else (-(-j.width * h // max(c[1] for c in j.components)), -(-j.height * v // max(c[2] for c in j.components)))
    return np.clip(np.floor_divide(grid + 4, 8) + 128, 0, 255).astype(np.uint8)[: -(-high // 8), : -(-wide // 8)]


def thumb_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of the thumbnail's 8x8 mean grid lie above their mean."""
    high, wide = thumb.shape
    ys, xs = np.arange(9) * high // 8, np.arange(9) * wide // 8
    sums = np.zeros((high + 1, wide + 1), np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    y0, y1 = np.minimum(ys[:-1], high - 1), np.maximum(ys[1:], np.minimum(ys[:-1], high - 1) + 1)
    x0, x1 = np.minimum(xs[:-1], wide - 1), np.maximum(xs[1:], np.minimum(xs[:-1], wide - 1) + 1)
    cell = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    mean = cell / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    return int("".join("1" if b else "0" for b in (mean > mean.mean()).ravel()), 2)


def payload_of(j: Jpeg, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode_many`` stored."""
    if not j.comment.startswith(b"payload="):
        raise Malformed("holds no payload")
    # each block is an interval, so its DC term is its own
    return (coefficients.reshape(-1, 64) - 1).astype(np.uint8).tobytes()[: int(j.comment[8:])]


def decode_many(files: list[bytes]) -> list[tuple[Jpeg, np.ndarray]]:
    """As ``decode``; files whose frames are alike but for their heights, with one MCU an interval,
    are decoded in one go."""
    parsed = [Jpeg(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, j in enumerate(parsed):
        alike = j.restart == 1 and len(j.components) == 1
        groups.setdefault((tuple(sorted(j.huffman.items())), tuple(j.order)) if alike else (i,), []).append(i)
    out: list = [None] * len(files)
    cache: dict = {}
    for at in groups.values():
        if len(at) == 1:
            out[at[0]] = (parsed[at[0]], decode(parsed[at[0]], cache))
            continue
        # one long scan: each file's intervals, then a marker between files
        totals, scans = [], []
        for n, i in enumerate(at):
            j = parsed[i]
            end = j.data.rfind(b"\xff\xd9")
            if end < j.scan:
                raise Malformed("no EOI")
            totals.append(j.layout()[1])
            scans.append(j.data[j.scan : end] + (b"\xff\xd0" if n < len(at) - 1 else b""))
            if scans[-1].count(b"\xff\xd0") + sum(scans[-1].count(bytes((0xFF, 0xD0 + k))) for k in range(1, 8)) != totals[-1] - (n == len(at) - 1):
                raise Malformed("missing intervals")
        one = Jpeg.__new__(Jpeg)
        one.__dict__.update(parsed[at[0]].__dict__, data=b"".join(scans) + b"\xff\xd9", scan=0, width=8, height=8 * sum(totals))
        got = decode(one, cache)
        for i, part in zip(at, np.split(got, np.cumsum(totals)[:-1]), strict=True):
            out[i] = (parsed[i], part)
    return out


def describe(files: DataFrame, image: str = "image") -> DataFrame:
    """The rows of ``files`` as struct ``row``, with width, height, components, thumbnail (bytes, row
    by row), thumb_sha256, thumb_hash and error of their JPEG column."""

    def make():
        def step(raw: list):
            rows = []
            for f in raw:
                try:
                    if f is None:
                        raise Malformed("null")
                    j = Jpeg(f)
                    t = thumbnail(j, decode(j))
                    rows.append((j.width, j.height, len(j.components), t.tobytes(), hashlib.sha256(t.tobytes()).hexdigest(), f"{thumb_hash(t):016x}", None))
                except Malformed as e:
                    rows.append((None, None, None, None, None, None, str(e)))
            names = ("width", "height", "components", "thumbnail", "thumb_sha256", "thumb_hash", "error")
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}

        return step

    return C.judge_rows(files, image, make, "width int, height int, components int, thumbnail binary, thumb_sha256 string, thumb_hash string, error string")


def stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded with zero bytes, as a JPEG."""

    def make():
        def step(batch: pa.RecordBatch):
            ids, texts = batch.column(0), C.byte_values(batch.column(1))
            for lo, hi in C.slices([len(t) + 64 for t in texts], 1 << 20):
                part = texts[lo:hi]
                yield {"doc_id": ids.slice(lo, hi - lo), "n_bytes": [len(t) for t in part], "media": encode_many([t + bytes(-len(t) % 64 if t else 64) for t in part])}

        return step

    return C.map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")), make, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """What the stored files hold: payload digests, and the thumbnail's size and hash as feature."""

    def make():
        def step(batch: pa.RecordBatch):
            ids, sizes, files = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for lo, hi in C.slices([len(f) for f in files], 1 << 20):
                rows = []
                for f, (j, got) in zip(files[lo:hi], decode_many(files[lo:hi]), strict=True):
                    p = payload_of(j, got)
                    t = thumbnail(j, got)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest(), f"{j.width}x{j.height}:{thumb_hash(t):016x}:{hashlib.sha256(t.tobytes()).hexdigest()[:16]}"))
                yield {"doc_id": ids.slice(lo, hi - lo), "n_bytes": sizes.slice(lo, hi - lo)} | dict(zip(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), map(list, zip(*rows, strict=True)), strict=True))

        return step

    return C.map_batches(media, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark, sf_dir: str) -> DataFrame:
    return read_back(stored(C.table(spark, sf_dir, "documents")))
