import struct

import pytest
from pyspark.sql import functions as F

from strandloom.operators import transform as T
from strandloom.sources import alignments as L

KIND = "file string, file_idx int, pos long, id string, `desc` string, name string, seq string, qual string"


def recs(spark, *rows):
    return spark.createDataFrame([("f", 0, i, n.split()[0] if n else n, "", n, s, q) for i, (n, s, q) in enumerate(rows)], KIND)


def mutated(df, **how):
    return [r.seq for r in T.mutate(df, points=((1, "N"),), **how).orderBy("pos").collect()]


def test_mutate_only_what_patterns_choose(spark):
    df = recs(spark, ("a one", "ACGT", None), ("B two", "ACGT", None), ("c|d", "ACGT", None), (None, "ACGT", None))
    old, new = "ACGT", "NCGT"
    assert mutated(df, patterns=["a", "b"]) == [new, old, old, old]
    assert mutated(df, patterns=["a", "b"], ignore_case=True) == [new, new, old, old]
    assert mutated(df, patterns=["a"], invert=True) == [old, new, new, new]
    assert mutated(df, patterns=["B two"], by_name=True) == [old, new, old, old]
    assert mutated(df, patterns=["^a$", "D$"], use_regexp=True, ignore_case=True) == [new, old, new, old]
    assert mutated(df, patterns=["x|a", "^B"], use_regexp=True, invert=True) == [old, old, new, new]
    assert mutated(df, patterns=[]) == mutated(df, patterns=[], use_regexp=True) == [old] * 4
    table = spark.createDataFrame([("a",), ("a",), ("C|D",), (None,)], "pattern string")
    assert mutated(df, patterns=table) == [new, old, old, old]
    assert mutated(df, patterns=table, ignore_case=True) == [new, old, new, old]
    assert mutated(df, patterns=table, invert=True) == [old, new, new, new]
    assert mutated(df, patterns=["a"], matched=F.col("pos") > 0) == [old] * 4
    assert T.mutate(df, points=((1, "N"),), patterns=table).columns == df.columns
    with pytest.raises(TypeError):
        T.mutate(df, invert=True)


def test_encodings_of_whole_tables(spark):
    quals = ["IIII", "!!!!", "hhhh", "BBBh", "BfhB", "", None, "J", "~"]
    for q in [[x] for x in quals] + [["hhhh", "BBhf"], ["hhhh"] * 10 + ["BBhf"], ["efgB", "Behf"]]:
        df = recs(spark, *[("a", "ACGT", x) for x in q])
        got = T.guess_encodings(df).collect()
        want = T.guess_encoding(df, len(q))
        assert [r.encodings for r in got] == ([",".join(want)] if any(q) else []), q


def test_reports_of_an_index(spark, tmp_path):
    refs = [("r1", 50), ("r2", 20), ("r3", 9)]
    bam = str(tmp_path / "x.bam")
    (tmp_path / "x.bam").write_bytes(L.encode_bam([], refs))
    (tmp_path / "x.bam.bai").write_bytes(L.encode_summary([(4, 1), None, (0, 2)], 3))
    assert [tuple(r)[:4] for r in L.index_stat(spark, bam + ".bai").collect()] == [(400 / 7, 4, 3, 7)]
    assert sorted((r.Ref, r.Count) for r in L.index_count(spark, bam + ".bai").collect()) == [("r1", 4), ("r3", 0)]
    assert sorted((r.ref_number, r.mapped, r.unmapped) for r in L.read_bai(spark, bam + ".bai").collect()) == [(0, 4, 1), (1, 0, 0), (2, 0, 2)]
    # chunks of a real index stand before, between and behind the summary
    real = b"BAI\1" + struct.pack("<i", 1) + struct.pack("<i", 2) + struct.pack("<IiQQ", 4681, 1, 9, 99) + struct.pack("<IiQQQQ", 37450, 2, 0, 9, 7, 2) + struct.pack("<iQQ", 2, 1, 2)
    assert L.index_summary(real) == ([(0, 7, 2)], None)
    assert L.index_summary(real + struct.pack("<Q", 5)) == ([(0, 7, 2)], 5)
    (tmp_path / "old.bam.bai").write_bytes(real)
    with pytest.raises(Exception, match="does not count unmapped"):
        L.index_stat(spark, str(tmp_path / "old.bam.bai")).collect()
    (tmp_path / "e.bai").write_bytes(L.encode_summary([], 0))
    assert [tuple(r)[:4] for r in L.index_stat(spark, str(tmp_path / "e.bai")).collect()] == [(0.0, 0, 0, 0)]
