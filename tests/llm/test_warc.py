import gzip
import hashlib
from collections import Counter, defaultdict

from strandloom.llm import warc as W

BIG = "<p>é" + "x" * 1200


def pages():
    rows = [(i, f"https://www{i % 7}.Example.com:80/p/{i}?q#f", f"<html>{i}" * (i % 400)) for i in range(300)]
    rows += [(1000 + i, f"http://a.b/{i}", BIG) for i in range(20)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "no scheme \r\n\"x\" é", "short"), (2003, "u", "short"), (None, "http://n.o/", BIG), (1003, "http://a.b/3", BIG), (2004, "http://x.y", "y" * 500_000)]
    return rows


def plain(rows):
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[h or ""].append(p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        best = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = len(raw) >= 1000 and p != best
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return out


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


def test_round_trip_and_lookup(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    segments, captures = W.write(W.decide(df), segment_bytes=20_000)
    blocks = W.index(captures, block_rows=25)
    got = W.read(segments, captures).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(plain(rows), key=key)
    assert sorted(r.url for r in got) == sorted(u or "" for _, u, _ in rows)
    asked = df.select(W.capture_key("page_id", "url").alias("key"))
    told = W.read(segments, W.locate(asked.union(asked.limit(5)), blocks)).collect()
    assert Counter(map(tuple, told)) == Counter(map(tuple, got))
    few = df.where("page_id in (5, 1003, 2000)").select(W.capture_key("page_id", "url").alias("key")).union(spark.createDataFrame([("no,such)/ 1",), (None,)], "key string"))
    assert sorted(r.page_id for r in W.read(segments, W.locate(few, blocks)).collect()) == [5, 1003, 1003, 2000]
    directory = W.Directory(blocks)
    assert directory.first == sorted(directory.first) and len(directory.first) >= 10
    found = W.fetch(segments, directory.lookup(blocks, "com,example,www3)/p/"))
    assert {r["page_id"] for r in found} == {i for i in range(300) if i % 7 == 3}
    assert directory.lookup(blocks, "zz") == []
    one = W.fetch(segments, directory.lookup(blocks, "com,example,www5)/p/5?"))
    assert [r["payload"].decode() for r in one] == ["<html>5" * 5]
    files = W.export(segments, str(tmp_path)).collect()
    text = b"".join(gzip.open(f.path).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(rows)


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    segments, captures = W.write(W.decide(df))
    assert W.read(segments, W.locate(df.select(W.capture_key("page_id", "url").alias("key")), W.index(captures))).count() == 0


def test_whole_rows_that_repeat(spark):
    """One of the rows with the largest page id stays the response, wherever they lie."""
    rows = [(1, "http://a.b/1", BIG)] * 3 + [(2, "http://a.b/2", BIG)] * 9 + [(3, "u", "y" * 2000)] + [(4, "v", "short")] * 2 + [(None, None, "z" * 1500)] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    decided = W.decide(df)
    segments, captures = W.write(decided)
    got = W.read(segments, W.locate(df.select(W.capture_key("page_id", "url").alias("key")), W.index(captures, block_rows=2)))
    told = Counter((r.page_id, r.record_type, r.refers_to) for r in got.collect())
    assert told == {(1, "revisit", 2): 3, (2, "response", None): 1, (2, "revisit", 2): 8, (3, "response", None): 1, (4, "response", None): 2, (None, "response", None): 1, (None, "revisit", None): 2}


def test_archives_are_few_files(spark, monkeypatch):
    """A small table of many partitions becomes as many segments and blocks as cores, not as partitions, with places that hold."""
    rows = [(i, f"http://h{i % 7}.example.com/{i}", "word " * (i % 5) + str(i)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(60)
    pages = W.C.written(pages, "pages")
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(W.C, "FILE_BYTES", 1 << 40)
    segments, captures = W.write(W.decide(pages))
    assert segments.select("segment").distinct().count() == segments.count() <= cores
    blocks = W.index(captures)
    assert len(blocks.inputFiles()) <= cores
    got = W.read(segments, W.locate(pages.select(W.capture_key("page_id", "url").alias("key")), blocks))
    assert sorted((r.page_id, r.payload_bytes) for r in got.collect()) == sorted((i, len(h)) for i, _, h in rows)
