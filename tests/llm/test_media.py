import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from strandloom.llm import media as M


def colour_jpeg(width, height, sampling, restart, seed):
    """A plain writer of baseline files with given random coefficients, runs and ends of block."""
    rng = np.random.default_rng(seed)
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    if len(sampling) == 1:
        hmax = vmax = 1
        sampling = [(1, 1)]
    mcus = -(-width // (8 * hmax)) * -(-height // (8 * vmax))
    blocks = [c for c, (h, v) in enumerate(sampling) for _ in range(h * v)]
    coefficients = rng.integers(-300, 300, (mcus, len(blocks), 64)) * (rng.random((mcus, len(blocks), 64)) < rng.choice([0.02, 0.3, 1]))
    coefficients[..., 0] = rng.integers(-500, 500, coefficients.shape[:2])
    symbols = bytes(range(252))
    counts = bytes([0] * 8 + [252] + [0] * 7)  # all codes have nine bits
    out = b"\xff\xd8" + M._segment(0xE1, b"x" * 9) + M._segment(0xDB, bytes(1) + bytes([3]) * 64)
    frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes((i + 1, h << 4 | v, 0)) for i, (h, v) in enumerate(sampling))
    out += M._segment(0xC0, frame) + M._segment(0xC4, b"\0" + counts + symbols) + M._segment(0xC4, b"\x10" + counts + symbols)
    out += M._segment(0xDD, struct.pack(">H", restart)) + M._segment(0xDA, bytes([len(sampling)]) + b"".join(bytes((i + 1, 0)) for i in range(len(sampling))) + b"\0\x3f\0")
    bits, pred, mark = "", [0] * len(sampling), 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return b"".join(bytes([int(bits[i : i + 8], 2)]) + (b"\0" if bits[i : i + 8] == "1" * 8 else b"") for i in range(0, len(bits), 8))

    def put(symbol, value, size):
        return f"{symbol:09b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    for m in range(mcus):
        if restart and m and m % restart == 0:
            out += flush(bits) + bytes((0xFF, 0xD0 + mark % 8))
            bits, pred, mark = "", [0] * len(sampling), mark + 1
        for b, c in enumerate(blocks):
            z = coefficients[m, b].tolist()
            d = z[0] - pred[c]
            pred[c] = z[0]
            bits += put(abs(d).bit_length(), d, abs(d).bit_length())
            run = 0
            for x in z[1:]:
                if x == 0:
                    run += 1
                    continue
                while run > 15:
                    bits += put(0xF0, 0, 0)
                    run -= 16
                bits += put(run << 4 | abs(x).bit_length(), x, abs(x).bit_length())
                run = 0
            if run:
                bits += put(0, 0, 0)
    return out + flush(bits) + b"\xff\xd9", coefficients


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_general_files_decode(sampling, restart):
    data, want = colour_jpeg(45, 37, sampling, restart, 7)
    j = M.Jpeg(data)
    got = M.decode(j)
    assert (got == want).all()
    t = M.thumbnail(j, got)
    assert t.shape == (5, 6)
    assert t[0, 0] == np.clip((int(want[0, 0, 0]) * 3 + 4) // 8 + 128, 0, 255)
    if sampling[0] == (2, 2):
        assert t[1, 1] == np.clip((int(want[0, 3, 0]) * 3 + 4) // 8 + 128, 0, 255)


def test_payloads_round_trip():
    rng = random.Random(1)
    payloads = [bytes(64), bytes([255]) * 64, bytes(range(256)) * 3, rng.randbytes(64 * 777), b"text " * 640, bytes(64)]
    files = M.encode_many(payloads)
    assert files[0] == files[-1]
    for p, (j, c), f in zip(payloads, M.decode_many(files), files):
        assert M.payload_of(j, c) == p
        alone = M.Jpeg(f)
        assert (M.decode(alone) == c).all()


def test_payloads_over_the_height_of_rows_of_16():
    rng = random.Random(2)
    for n in (16 * 8191, 16 * 8191 + 1, 17 * 8191 + 5):  # 8,387,584 bytes fill rows of 16
        p = rng.randbytes(64 * n)
        [f] = M.encode_many([p])
        [(j, c)] = M.decode_many([f])
        assert M.payload_of(j, c) == p
        assert j.width == 8 * -(-n // 8191) and j.height <= 65528


def test_broken_files(spark):
    good, _ = colour_jpeg(45, 37, [(1, 1)], 0, 7)
    rows = [(1, good, "a"), (2, None, "b"), (3, b"", "c"), (4, good[:200], "d"), (5, good[: len(good) // 2], "e"), (6, b"\xff\xd8\xff\xd9", "f"), (7, good.replace(b"\xff\xc0", b"\xff\xc2"), "g")]
    got = {r.row.width: r for r in M.describe(spark.createDataFrame(rows, "width int, image binary, thumbnail string")).collect()}
    assert (got[1].width, got[1].height, got[1].components, len(got[1].thumbnail), got[1].error) == (45, 37, 1, 30, None)
    assert all(got[i].thumbnail is None and got[i].error for i in range(2, 8))


def test_query_columns(spark):
    texts = [None, "", "x", "é" * 32, "a" * 64, "long " * 30000, "x", "nul\0 ퟿"]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id or 0: r for r in M.read_back(M.stored(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[2][2:] == got[6][2:] and got[2].feature != got[5].feature
    assert M.read_back(M.stored(df.limit(0))).count() == 0


def test_header_of_more_than_the_data_holds(spark):
    """65528 x 65528 pixels in a file of a few bytes: an error row, and no memory asked for."""
    good = M.encode_many([bytes(range(64)) * 9])[0]
    at = good.index(b"\xff\xc0")
    bad = good[: at + 5] + (65528).to_bytes(2, "big") * 2 + good[at + 9 :]
    rows = M.describe(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(bad))], "id long, image binary")).select("row.id", "width", "error").collect()
    assert sorted((r.id, r.width, r.error) for r in rows) == [(1, M.Jpeg(good).width, None), (2, None, "data ends early")]
