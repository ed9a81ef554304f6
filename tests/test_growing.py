import os
import random
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from strandloom.streaming import Reports, follow, stop_when_idle, tee
from strandloom.streaming.follow import _Range, _Reader, complete, end_of


def fastq(rng, n, first=0):
    """Records whose qualities often begin with @ or +."""
    out = []
    for i in range(first, first + n):
        k = rng.choice([1, 3, 20])
        out.append(f"@r{i} x\n{''.join(rng.choices('ACGT', k=k))}\n+\n{''.join(rng.choices('@+I', k=k))}\n")
    return "".join(out)


def read(reader, start):
    end = reader.latestOffset()
    rows = [r for p in reader.partitions(start, end) for batch in reader.read(p) for r in batch.to_pylist()]
    return end, rows


def reader(folder, **options):
    r = _Reader({"path": str(folder), **{k: str(v) for k, v in options.items()}})
    r.initialOffset()
    return r


@pytest.mark.parametrize("split", [7, 33, 1 << 20])
def test_every_growth_and_every_split_gives_each_record_once(tmp_path, split):
    rng = random.Random(split)
    text = fastq(rng, 40)
    names = [f"r{i} x" for i in range(40)]
    (tmp_path / "sub").mkdir()
    path = tmp_path / "sub" / "a.fq"
    path.write_text("")
    r, at, got = reader(tmp_path, splitBytes=split), {}, []
    done = 0
    while done < len(text):
        done = min(len(text), done + rng.randint(1, 90))
        path.write_text(text[:done])
        at, rows = read(r, at)
        assert all(x["error"] is None for x in rows)
        got += [x["name"] for x in rows]
    assert got == names


@pytest.mark.parametrize("split", [5, 64])
def test_fasta_waits_for_the_next_header(tmp_path, split):
    text = "".join(f">s{i}\nACGT\nAC\n" for i in range(20))
    path = tmp_path / "a.fa"
    r, at, got = reader(tmp_path, kind="fasta", splitBytes=split), {}, []
    for done in (3, 17, 40, 41, 100, len(text)):
        path.write_text(text[:done])
        at, rows = read(r, at)
        got += [(x["name"], x["seq"]) for x in rows]
    assert got == [(f"s{i}", "ACGTAC") for i in range(19)]
    last = reader(tmp_path, kind="fasta", final=True)
    assert [x["name"] for x in read(last, at)[1]] == ["s19"]


def test_limit_of_a_batch_and_a_record_longer_than_it(tmp_path):
    rng = random.Random(1)
    (tmp_path / "a.fq").write_text(fastq(rng, 30))
    (tmp_path / "b.fq").write_text("@long\n" + "A" * 500 + "\n+\n" + "I" * 500 + "\n" + fastq(rng, 3, 50))
    r, at, batches = reader(tmp_path, maxBytes=100), {}, []
    for _i in range(60):
        at, rows = read(r, at)
        batches.append([x["name"] for x in rows])
    names = [n for b in batches for n in b]
    assert sorted(names) == sorted([f"r{i} x" for i in range(30)] + ["long"] + [f"r{i} x" for i in range(50, 53)])
    assert max(map(len, batches)) <= 10


def test_shrunk_removed_and_restarted(tmp_path):
    a, b = tmp_path / "a.fq", tmp_path / "b.fq"
    rng = random.Random(3)
    a.write_text(fastq(rng, 5))
    b.write_text(fastq(rng, 4, 10) + "@half\nAC")
    r = reader(tmp_path)
    at, rows = read(r, {})
    assert len(rows) == 9
    a.write_text(fastq(rng, 2, 100))  # shrank: read anew
    at, rows = read(r, at)
    assert [x["name"] for x in rows] == ["r100 x", "r101 x"]
    again = _Reader({"path": str(tmp_path)})  # a query that starts again does not know what was read
    at, rows = read(again, at)
    assert rows == []
    a.unlink()
    at, rows = read(again, at)
    assert rows == [] and list(at) == [str(b)]
    a.write_text(fastq(rng, 1, 7))
    at, rows = read(again, at)
    assert [x["name"] for x in rows] == ["r7 x"]
    assert read(reader(tmp_path / "absent"), {}) == ({}, [])


def test_malformed_lines_come_once(tmp_path):
    bad = "junk\n@x\nACG\n+\nII\n"
    text = "@a\nA\n+\nI\n" + bad + "@b\nC\n+\n@\n" + bad * 3 + "@c\nG\n+\n+\n"
    (tmp_path / "a.fq").write_text(text)
    whole = read(reader(tmp_path), {})[1]
    assert [x["name"] for x in whole if x["error"] is None] == ["a", "b", "c"]
    for split in (1, 4, 9, 30):
        rows = read(reader(tmp_path, splitBytes=split), {})[1]
        assert [(x["name"], x["line"]) for x in rows] == [(x["name"], x["line"]) for x in whole]
    (tmp_path / "a.fq").write_text(text + "@d\nAC")
    assert [x["error"] for x in read(reader(tmp_path, final=True), {})[1]][-2:] == ["record ends early"] * 2


def test_end_is_found_from_behind(tmp_path, monkeypatch):
    monkeypatch.setattr(sys.modules["strandloom.streaming.follow"], "TAIL", 3)
    text = fastq(random.Random(8), 12)
    path = tmp_path / "a.fq"
    path.write_text(text)
    ends = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"][3::4]
    for high in range(len(text) + 1):
        want = max(e for e in ends if e <= high)
        assert end_of(str(path), "fastq", 0, high) == want == complete(text[:high].encode(), "fastq")


def test_parsing_is_in_tasks(tmp_path):
    (tmp_path / "a.fq").write_text(fastq(random.Random(2), 50))
    r = reader(tmp_path, splitBytes=100)
    parts = r.partitions({}, r.latestOffset())
    assert len(parts) > 5 and all(isinstance(p, _Range) for p in parts)


def test_reports_after_every_n_records(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = follow(spark, str(folder), splitBytes=60)
    sinks = [Reports(spark, str(tmp_path / f"reports{k}"), F.length("seq"), 2, 4, reset=k) for k in (False, True)]
    (folder / "a.fq").write_text("".join(f"@r{i}\n{'A' * k}\n+\n{'I' * k}\n" for i, k in enumerate([1, 1, 2, 3, 5])))
    query = tee(stream, *sinks, checkpoint=str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, sinks[0].table().collect())) == [(1, 0.0, 2), (1, 2.0, 2)]
        with open(folder / "a.fq", "a") as f:
            f.write("".join(f"@s{i}\n{'A' * k}\n+\n{'I' * k}\n" for i, k in enumerate([5, 1, 1, 9])))
        query.processAllAvailable()
        assert sorted(map(tuple, sinks[0].table().collect())) == [(1, 0.0, 2), (1, 2.0, 2), (2, 0.0, 4), (2, 2.0, 2), (2, 4.0, 2)]
        assert sorted(map(tuple, sinks[1].table().collect())) == [(1, 0.0, 2), (1, 2.0, 2), (2, 0.0, 2), (2, 4.0, 2)]
        sinks[0](spark.createDataFrame([("a", 0, i, "n", "A", "I", None, None) for i in range(2)], stream.schema), 1)  # a batch that runs again
        assert sinks[0].table().where("report = 2").count() == 0
    finally:
        query.stop()
    assert Reports(spark, str(tmp_path / "none"), F.length("seq"), 2, 4).table().count() == 0


def test_idle_stop_and_a_process_that_ends(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fq").write_text("@a\nA\n+\nI\n")
    writer = lambda n: follow(spark, str(tmp_path / "in")).writeStream.format("memory").queryName(n).option("checkpointLocation", str(tmp_path / n)).start()
    query, began = writer("idle"), time.monotonic()
    stop_when_idle(query, seconds=2)
    assert not query.isActive and time.monotonic() - began >= 2 and spark.sql("select * from idle").count() == 1
    child = subprocess.Popen(["sleep", "1"])
    query = writer("pid")
    os.waitpid(child.pid, 0)
    stop_when_idle(query, pid=child.pid)
    assert not query.isActive and spark.sql("select * from pid").count() == 1
    with pytest.raises(ValueError):
        stop_when_idle(query)


@pytest.mark.parametrize("most", [1, 3, 7, 1000])
def test_a_task_reads_several_splits_where_there_are_many(tmp_path, monkeypatch, most):
    rng = random.Random(12)
    (tmp_path / "a.fq").write_text(fastq(rng, 90))
    (tmp_path / "b.fq").write_text(fastq(rng, 40, 90))
    r = reader(tmp_path, splitBytes=30, maxTasks=most)
    parts = r.partitions({}, r.latestOffset())
    assert len(parts) <= most + 2 if most < 1000 else len(parts) > 60
    assert all((p.start - p.low) % 30 == 0 for p in parts)
    want = [f"r{i} x" for i in range(130)]
    assert [x["name"] for x in read(r, {})[1]] == want
    monkeypatch.setattr(_Reader, "WIDE", 90)
    r = reader(tmp_path, splitBytes=30, maxTasks=most)
    assert max(p.end - p.start for p in r.partitions({}, r.latestOffset())) <= 90
    assert [x["name"] for x in read(r, {})[1]] == want


def test_tasks_of_a_batch_do_not_grow_with_it(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fq").write_text(fastq(random.Random(3), 300))
    seen = []
    query = tee(follow(spark, str(tmp_path / "in"), splitBytes=60), lambda batch, _: seen.append((batch.rdd.getNumPartitions(), batch.count())), checkpoint=str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sum(n for _, n in seen) == 300 and max(k for k, _ in seen) <= 2 * spark.sparkContext.defaultParallelism + 1
