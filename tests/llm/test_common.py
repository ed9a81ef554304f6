import numpy as np
import pytest

from strandloom.llm import common as C


def plain_hash(raw: bytes, seed: int) -> int:
    """The polynomial of one span, as Python integers."""
    codes, h, power = C._byte_codes(seed), 0, 1
    for b in raw:
        h, power = (h + int(codes[b]) * power) % 2**64, power * C.SpanHash.BASE % 2**64
    return int(C.mix(np.array([(h + len(raw)) % 2**64], np.uint64))[0])


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_span_hash_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(C.SpanHash, "PIECE", piece)
    monkeypatch.setattr(C, "_POWERS", {})
    rng = np.random.default_rng(3)
    buf = rng.integers(0, 256, 300).astype(np.uint8)
    start = np.sort(rng.integers(0, 299, 80))
    end = np.minimum(300, start + rng.integers(0, 40, 80))
    got = C.SpanHash(buf, seed=5).of(start, end).tolist()
    assert got == [plain_hash(buf[a:b].tobytes(), 5) for a, b in zip(start, end, strict=True)]


def test_scratch_is_deleted_by_its_owner_alone(spark):
    import os

    with C.Scratch(spark) as mine:
        a = C.written(spark.range(3), "a")
        with C.Scratch(spark) as inner:
            b = C.written(spark.range(4), "b")
    c = C.written(spark.range(5), "c")
    place = lambda s: s.paths[0].replace("file://", "").replace("file:", "")
    first, second = place(mine), place(inner)
    inner.delete()
    assert os.path.exists(first) and not os.path.exists(second)
    assert a.count() == 3 and c.count() == 5
    mine.delete()
    assert not os.path.exists(first) and c.count() == 5
    del b


def test_scratch_tables_have_few_files(spark):
    """A small table of many partitions is not as many files."""
    cores = spark.sparkContext.defaultParallelism
    kept = C.written(spark.range(0, 5000, 1, 3).repartition(90, "id"), "many")
    got = C.written(kept.repartition(90, "id"), "few", in_few=True)
    assert len(kept.inputFiles()) > cores >= len(got.inputFiles()) and got.count() == 5000
