"""BAM records encoded and decoded by whole batches have the bytes and the values of those done one by one."""

import io
import struct

import numpy as np
import pyarrow as pa
import pytest

from strandloom.sources import alignments as L
from strandloom.sources import bgzf as B

from .test_bam_files import REFS, plain, rows

KIND = pa.schema([("read", pa.string()), ("ref", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("flags", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("seq", pa.string()), ("qual", pa.list_(pa.int32())), ("tags", pa.map_(pa.string(), pa.string()))])
NUMBER = {"r1": 0, "r2": 1}


def batch(records):
    return pa.RecordBatch.from_pylist([r | {"tags": None if r["tags"] is None else list(r["tags"].items())} for r in records], schema=KIND)


def made():
    """Every length, no letters, no qualities, no tags, unknown references, lower case and letters that BAM lacks."""
    out = rows(40, seed=9, longest=3) + rows(6, seed=2, longest=3000)
    out[1] |= {"seq": "*", "qual": None, "cigar": None, "ref": "*"}
    out[2] |= {"seq": "acgtn=xZ!", "qual": [], "tags": {}}
    out[3] |= {"seq": None, "qual": [], "tags": {"XA": "-12", "XB": "--", "XC": "", "XD": "7x"}, "read": "née"}
    return [r | {"qual": r["qual"] if r["seq"] and len(r["qual"] or ()) == len(r["seq"]) else []} for r in out]


def test_bytes_of_batches_and_of_slices_are_those_of_records(monkeypatch):
    records = made()
    want = [L._record(r, NUMBER) for r in records]
    monkeypatch.setattr(L, "_record", lambda *_: pytest.fail("one by one"))
    for long in (0, 256):
        monkeypatch.setattr(L, "LONG", long)
        assert L.encode_records(batch(records), NUMBER) == b"".join(want)
        for a, b in ((0, 0), (3, 17), (40, 46), (2, 3)):
            assert L.encode_records(batch(records).slice(a, b - a), NUMBER) == b"".join(want[a:b])


@pytest.mark.parametrize("odd", [{"seq": "ACGé", "qual": []}, {"tags": None}, {"seq": "ACGT", "qual": [1]}])
def test_what_has_no_form_as_arrays_is_whole(odd):
    records = [r | odd if i == 5 else r for i, r in enumerate(made())]
    assert L.encode_records(batch(records), NUMBER) == b"".join(L._record(r, NUMBER) for r in records)


@pytest.mark.parametrize("odd", [{"pos": None}, {"mapq": 256}, {"flags": -1}, {"read": "n" * 300}, {"qual": [None], "seq": "A"}, {"cigar": [{"op": "Q", "len": 1}]}])
def test_fields_that_do_not_fit_are_errors(odd):
    with pytest.raises((struct.error, TypeError, ValueError)):
        L.encode_records(batch([*made()[:4], made()[0] | odd]), NUMBER)


@pytest.mark.parametrize("long", [0, 256])
def test_runs_come_back_as_they_were(monkeypatch, long):
    monkeypatch.setattr(L, "LONG", long)
    monkeypatch.setattr(B, "READ", 5000)
    records = rows(70, seed=3, longest=1500)
    raw = b"".join([*L.blocks_of([L.header_bytes(REFS), L.encode_records(batch(records), NUMBER)], size=700), L.END])
    refs, found = B.runs(B.Window(io.BytesIO(raw), len(raw)), 0, len(raw))
    decoder, got, many = L.Decoder("x", refs), [], 0
    for data, starts, _, _ in found:
        many += 1
        got += decoder.batch(data, starts).to_pylist()
    assert many > 5 and len(got) == 70
    assert [plain(r) for r in got] == [plain(r) for r in records]
    with pytest.raises(ValueError, match="longer than its size"):
        short = bytearray(L._record(records[2], NUMBER))
        struct.pack_into("<i", short, 20, 10**6)
        decoder.batch(bytes(short), np.array([0]))
