import io
import random

import pytest

from strandloom.operators import relate
from strandloom.sources import faidx, read_fasta


def brute(text: bytes):
    """(head, letters, offset, first line's letters and width) by reading from the start."""
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        at += len(line)
        bare = line.rstrip(b"\r\n")
        if line.startswith(b">"):
            out.append([bare[1:].decode(), 0, at, None, None])
        else:
            out[-1][1] += len(bare)
            if out[-1][3] is None:
                out[-1][3:] = [len(bare), len(line) + (not line.endswith(b"\n"))]
    return [(h, n, o, b or 0, w or 0) for h, n, o, b, w in out]


def made(seed: int, width: int, end: bytes, last_newline=True) -> bytes:
    rng, out = random.Random(seed), []
    for i in range(12):
        s = "".join(rng.choices("ACGT", k=rng.choice([0, 1, width - 1, width, width + 1, 3 * width, 7 * width + 2]))).encode()
        out.append(b">r%d some words" % i + end + b"".join(s[j : j + width] + end for j in range(0, len(s), width)))
    text = b"".join(out)
    return text if last_newline else text[: -len(end)]


@pytest.mark.parametrize("piece", [1, 3, 17, 1 << 20])
def test_lines_are_owned_once_at_every_split(piece):
    for end in (b"\n", b"\r\n"):
        for newline in (True, False):
            text = made(3, 7, end, newline)
            whole = [tuple(x) for x in map(lambda p: (p[0], p[1], p[2], tuple(p[3])), faidx.pieces(io.BytesIO(text), 0, len(text), len(text)))]
            assert [x[:3] for x in whole] == [(h, o, n) for h, n, o, _, _ in brute(text)]
            for cut in range(1, len(text), 1 if piece > 3 else 13):
                parts = [list(faidx.pieces(io.BytesIO(text), a, b, len(text), piece)) for a, b in ((0, cut), (cut, len(text)))]
                assert sum(p[2] for q in parts for p in q) == sum(x[2] for x in whole)
                assert [p[:2] for q in parts for p in q if p[0] is not None] == [[x[0], x[1]] for x in whole]


@pytest.mark.parametrize("split", [41, 300, 1 << 20])
def test_index_of_given_files(spark, tmp_path, split):
    (tmp_path / "in").mkdir()
    texts = {"a.fa": made(1, 7, b"\n"), "b.fa": made(2, 70, b"\r\n"), "c.fa": made(5, 9, b"\n", False), "e.fa": b""}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text)
    got = faidx.index_files(spark, str(tmp_path / "in"), full_head=True, split_bytes=split).collect()
    want = sorted((n, *row) for n, t in texts.items() for row in brute(t))
    assert sorted((r.file.rsplit("/", 1)[1], *r[1:]) for r in got) == want


@pytest.mark.parametrize("text,fault", [("ACGT\n>a\nAC\n", "before the first header"), (">a\nACG\nAC\nACG\n", "different"), (">a\nAC\nACG\n", "different"), (">a\nAC\n\nAC\n", "different"), (">a\nAC\r\nAC\nA\n", "different")])
@pytest.mark.parametrize("split", [4, 1 << 20])
def test_uneven_files_are_rejected(spark, tmp_path, text, fault, split):
    (tmp_path / "x.fa").write_bytes(text.encode())
    with pytest.raises(Exception, match=fault):
        faidx.index_files(spark, str(tmp_path / "x.fa"), split_bytes=split).collect()


def test_blank_lines_at_the_end_of_a_record(spark, tmp_path):
    (tmp_path / "x.fa").write_text("\n>a\nACG\nAC\n\n\n>b\n\n>c\nA")
    got = faidx.index_files(spark, str(tmp_path / "x.fa"), split_bytes=6).orderBy("offset").collect()
    assert [tuple(r[1:]) for r in got] == [("a", 5, 4, 3, 4), ("b", 0, 16, 0, 1), ("c", 1, 20, 1, 2)]


def test_many_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (width, end) in enumerate([(7, b"\n"), (70, b"\r\n")]):
        (tmp_path / "in" / f"{i}.fa").write_bytes(made(i, width, end).replace(b">r", b">f%dr" % i))
    index = faidx.index_files(spark, str(tmp_path / "in"), split_bytes=200)
    seqs = {r.id: r.seq for r in read_fasta(spark, str(tmp_path / "in")).collect()}
    rng, asked = random.Random(4), []
    for i in range(3000):
        name = rng.choice([*seqs, "absent"])
        a, b = rng.choice([None, rng.randint(1, 80)]), rng.choice([None, rng.randint(1, 80)])
        asked.append((i, name, a, b))
    got = {r.request: (r.name, r.seq) for r in faidx.read_ranges(index, spark.createDataFrame(asked, faidx.ASKED)).collect()}
    for i, name, a, b in asked:
        if name not in seqs:
            assert i not in got
            continue
        s = seqs[name]
        x, y = a or 1, len(s) if b is None else b
        want = s[x - 1 : y] if not (a and x > y) else s[max(y, 1) - 1 : x][::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert got[i][1] == want, (name, a, b)


def test_ranges_as_the_operator_on_records_has_them(spark, tmp_path):
    rng = random.Random(6)
    with open(tmp_path / "x.fa", "w") as f:
        for i in range(9):
            letters = "".join(rng.choices("ACGT", k=30 + i))
            f.write(f">r{i} x\n" + "".join(letters[j : j + 11] + "\n" for j in range(0, len(letters), 11)))
    asked = ["r1", "r3:2-9", "r3:9-2", "r5:4", "r6:3-", "r7:-5", "none:1-2", "r8:1-1000", "r2:25-12"]
    index = faidx.index_files(spark, str(tmp_path / "x.fa"), split_bytes=64)
    got = faidx.read_ranges(index, faidx.requests(spark, asked)).orderBy("request").collect()
    want = relate.faidx(read_fasta(spark, str(tmp_path / "x.fa")), asked).collect()
    assert [(r.request, r.seq) for r in got] == [(r.request, r.seq) for r in want]
    assert len(got) == 8


def test_no_files_and_no_requests(spark, tmp_path):
    (tmp_path / "x.fa").write_text("")
    index = faidx.index_files(spark, str(tmp_path / "x.fa"))
    assert index.count() == 0
    assert faidx.read_ranges(index, spark.createDataFrame([], faidx.ASKED)).count() == 0


def test_tasks_of_ranges_grow_in_number_not_in_size(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.fa").write_bytes(made(i, 7, b"\n").replace(b">r", b">f%dr" % i))
    index = faidx.index_files(spark, str(tmp_path))
    lengths = {r.name: r.length for r in index.collect()}
    asked = spark.createDataFrame([(i, f"f{i % 3}r{i % 12}", 1, 1 + i % 9) for i in range(3000)], faidx.ASKED)
    told = faidx.read_ranges(index, asked, task=100)
    assert told.rdd.getNumPartitions() == 30  # and they are not merged again
    sizes = told.rdd.glom().map(len).collect()
    assert sum(sizes) == 3000 and max(sizes) < 300
    got = {r.request: r.seq for r in told.collect()}
    assert all(len(got[i]) == min(1 + i % 9, lengths[f"f{i % 3}r{i % 12}"]) for i in range(3000))
    assert got == {r.request: r.seq for r in faidx.read_ranges(index, asked).collect()}
