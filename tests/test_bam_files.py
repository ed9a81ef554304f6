"""BAM files in splits, and written with a commit."""

import io
import os
import random
import struct

import pyarrow as pa
import pytest

from strandloom.sources import alignments as L
from strandloom.sources import bgzf as B
from strandloom.sources.python_sources import BamSource, _BamWriter

REFS = [("r1", 5000), ("r2", 900)]


def rows(n=60, seed=1, longest=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 50, longest])))
        out.append({"read": f"read{i}", "ref": rng.choice(["r1", "r2", None]), "pos": rng.randrange(800), "mapq": i % 60, "flags": i % 2 * 16, "cigar": [{"op": "M", "len": len(seq)}] if seq else [], "seq": seq, "qual": [rng.randrange(60) for _ in seq], "tags": {"NM": str(i), "XZ": "text"}})
    return out


def owned(raw, cuts):
    edges = [0, *cuts, len(raw)]
    return [x for a, b in zip(edges, edges[1:]) for x in B.records(B.Window(io.BytesIO(raw), len(raw)), a, b)[1]]


@pytest.mark.parametrize("size", [90, 700, 60_000])
def test_every_split_offset_gives_the_records_of_one_task(size):
    """Blocks shorter than a record, of several records, and one for all."""
    raw = b"".join(L.bam_blocks(rows(24), REFS, size=size))
    want = owned(raw, [])
    assert len(want) == 24 and want == sorted(want)
    for cut in range(1, len(raw), 1 if size == 700 else 13):
        assert owned(raw, [cut]) == want, cut
    for step in (1, 64, 1000) if size == 700 else (1000,):
        assert owned(raw, range(step, len(raw), step)) == want


def test_records_placed_behind_their_reference_belong_to_splits_too():
    raw = b"".join(L.bam_blocks([r | {"pos": 4000 + 200 * i} for i, r in enumerate(rows(24))], REFS, size=700))
    want = owned(raw, [])
    assert len(want) == 24
    for cut in range(1, len(raw), 13):
        assert owned(raw, [cut]) == want, cut


def test_long_records_and_damage():
    raw = b"".join(L.bam_blocks(rows(6, longest=200_000), REFS))
    assert owned(raw, range(5000, len(raw), 5000)) == owned(raw, [])
    assert owned(b"".join(L.bam_blocks([], REFS)), [40]) == []
    with pytest.raises(ValueError):
        owned(raw[: len(raw) // 2], [])
    broken = bytearray(raw)
    broken[len(raw) // 2] ^= 255
    with pytest.raises((ValueError, Exception)):
        owned(bytes(broken), [])


def plain(r):
    return (r["read"], r["ref"], r["pos"], r["mapq"], r["flags"], "".join(f"{c['len']}{c['op']}" for c in r["cigar"]), r["seq"], tuple(r["qual"]), tuple(sorted(dict(r["tags"]).items())))


def test_one_file_by_many_tasks_and_back(spark, tmp_path):
    want = rows(900, seed=4)
    df = spark.createDataFrame(want, L.ALN.replace("file string, ", "").replace("ref_len int, ", ""), verifySchema=False).repartition(5, "read")
    L.write_bam(df, REFS, f"{tmp_path}/one.bam", single=True)
    assert os.listdir(tmp_path) == ["one.bam"]
    got = L.read_bam(spark, f"{tmp_path}/one.bam", split_bytes=8_000)
    assert got.rdd.getNumPartitions() > 10
    assert sorted(plain(r.asDict(True)) for r in got.collect()) == sorted(map(plain, want))
    assert {(r.ref, r.ref_len) for r in got.select("ref", "ref_len").distinct().collect()} == {("r1", 5000), ("r2", 900), (None, None)}
    L.write_bam(df, REFS, f"{tmp_path}/many")
    names = sorted(os.listdir(f"{tmp_path}/many"))
    assert len(names) == 5 and all(n.startswith("part-") for n in names)
    assert L.read_bam(spark, f"file://{tmp_path}/many").count() == 900 and L.read_bam(spark, f"{tmp_path}/m*/*.bam").count() == 900
    L.write_bam(df.limit(0), REFS, f"{tmp_path}/none.bam", single=True)
    assert L.read_bam(spark, f"{tmp_path}/none.bam").collect() == []


def batch(records):
    return pa.RecordBatch.from_pylist([r | {"tags": list(r["tags"].items())} for r in records])


def test_a_repeated_task_leaves_one_copy_and_a_failed_job_none(spark, tmp_path):
    options = {"path": f"{tmp_path}/out", "refs": '[["r1", 5000], ["r2", 900]]'}
    writer = _BamWriter(options, False)

    def fails():
        yield batch(rows(10))
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(fails())
    first, second = writer.write(iter([batch(rows(10))])), writer.write(iter([batch(rows(10))]))
    assert len(os.listdir(writer.pending)) == 3 and first.path != second.path
    writer.commit([second])
    assert len(os.listdir(tmp_path / "out")) == 1 and L.read_bam(spark, f"{tmp_path}/out").count() == 10
    writer = _BamWriter(options, False)
    writer.abort([writer.write(iter([batch(rows(10))])), None])
    assert len(os.listdir(tmp_path / "out")) == 1
    writer = _BamWriter(options, True)
    writer.commit([writer.write(iter([batch(rows(7))]))])
    assert L.read_bam(spark, f"{tmp_path}/out").count() == 7


def test_region_by_index(spark, tmp_path):
    """An index of the linear kind, one chunk a bin of 16,384 letters, over sorted records."""
    refs = [("a", 10**6), ("b", 10**6)]
    recs = [{"read": f"{ref}{pos}", "ref": ref, "pos": pos, "mapq": 1, "flags": 0, "cigar": [{"op": "M", "len": 60}], "seq": "A" * 60, "qual": [], "tags": {}} for ref in "ab" for pos in range(0, 200_000, 50)]
    raw = b"".join(L.bam_blocks(recs, refs, size=5000))
    (tmp_path / "x.bam").write_bytes(raw)
    found = owned(raw, [])
    ends = [o for o, _ in found[1:]] + [(len(raw), 0)]
    bins = {0: {}, 1: {}}
    for (o, b), e in zip(found, ends):
        ref, pos = struct.unpack_from("<ii", b)
        low, high = pos >> 14, (pos + 59) >> 14
        key = 4681 + low if low == high else 585 + (pos >> 17) if pos >> 17 == (pos + 59) >> 17 else 0
        bins[ref].setdefault(key, []).append((o[0] << 16 | o[1], e[0] << 16 | e[1]))
    index = b"BAI\1" + struct.pack("<i", 2)
    for ref in (0, 1):
        index += struct.pack("<i", len(bins[ref])) + b"".join(struct.pack("<Ii", k, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for k, c in bins[ref].items()) + struct.pack("<i", 0)
    (tmp_path / "x.bam.bai").write_bytes(index)
    for ref, a, b in (("a", 0, 10), ("b", 16_380, 16_390), ("b", 100_000, 150_000), ("a", 199_990, 10**6), ("none", 0, 5)):
        got = sorted(r.read for r in L.read_bam(spark, str(tmp_path), region=(ref, a, b)).collect())
        assert got == sorted(r["read"] for r in recs if r["ref"] == ref and r["pos"] < b and r["pos"] + 60 > a)
    assert len(L.region_chunks(index, 1, 16_380, 16_390)) < 20


def test_format_by_name(spark, tmp_path):
    spark.dataSource.register(BamSource)
    (tmp_path / "x.bam").write_bytes(L.encode_bam(rows(5), REFS))
    assert spark.read.format("bam").load(str(tmp_path / "x.bam")).count() == 5
    with pytest.raises(Exception):
        spark.read.format("bam").load(str(tmp_path / "missing.bam")).count()
