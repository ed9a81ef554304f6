"""The ``.fai`` index of given FASTA files, and ranges of them, both by executors.

A task owns the lines that begin in its split of bytes. It gives a row for each record, or part of one, that its lines
make: letters, and runs of equal lines. Only the first and the last of a split can go on in another; these meet by
their record, and its runs tell whether all lines but the last are of one length. A line longer than a split is
counted in pieces by the task that it begins in. Files must be plain: letters have to stand where the index says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import columns as S
from ..functions.layout import scratch_path
from . import store
from .formats import ID

RUNS = pa.list_(pa.struct([("b", pa.int64()), ("w", pa.int64()), ("c", pa.int64())]))
KINDS = {"file": pa.string(), "split": pa.int64(), "k": pa.int64(), "head": pa.string(), "offset": pa.int64(), "n": pa.int64(), "runs": RUNS, "open": pa.bool_()}
PIECE = "file string, split long, k long, head string, offset long, n long, runs array<struct<b: long, w: long, c: long>>, open boolean"
#: Runs that a record keeps; even lines have three kinds (full, last, blank), so that more are an error anyway.
MOST_RUNS = 16
#: Bytes that a task reads at once, to count and to fetch.
READ, NEAR = 8 << 20, 1 << 18


def lines_of(f, start: int, end: int, size: int, piece: int = READ) -> Iterator[tuple]:
    """Batches (begin, letters, width, headers) of the lines that begin in [start, end); headers by place in the batch.
    The width has the line's end, and a last line without one as if it had it."""
    pos = max(0, start - 1)
    begin = 0 if start == 0 else None
    first = last = None
    head = bytearray()
    f.seek(pos)
    while data := f.read(piece):
        if begin is None:
            skip = data.find(b"\n") + 1
            if not skip:
                pos += len(data)
                if pos >= end:
                    return
                continue
            data, pos = data[skip:], pos + skip
            begin = pos
            if begin >= end:
                return
            if not data:
                continue
        raw = np.frombuffer(data, np.uint8)
        nl = np.flatnonzero(raw == 10)
        if not len(nl):
            first = raw[0] if first is None else first
            if first == 62:
                head += data
            last, pos = raw[-1], pos + len(data)
            continue
        begins = np.concatenate(([begin], pos + nl[:-1] + 1))
        firsts = np.concatenate(([raw[0] if first is None else first], raw[nl[:-1] + 1]))
        before = raw[nl - 1]
        if nl[0] == 0:
            before[0] = 0 if last is None else last
        width = pos + nl + 1 - begins
        heads = {}
        for i in np.flatnonzero(firsts == 62):
            heads[int(i)] = bytes(head) + data[: nl[0]] if i == 0 else data[nl[i - 1] + 1 : nl[i]]
        mine = int((begins < end).sum())
        yield begins[:mine], (width - 1 - (before == 13))[:mine], width[:mine], {i: h for i, h in heads.items() if i < mine}
        begin = int(pos + nl[-1] + 1)
        if begin >= end:
            return
        rest = data[nl[-1] + 1 :]
        first, last = (rest[0], rest[-1]) if rest else (None, None)
        head = bytearray(rest if first == 62 else b"")
        pos += len(data)
    if begin is not None and begin < min(size, end):
        width = size - begin + 1
        yield np.array([begin]), np.array([width - 1 - (last == 13)]), np.array([width]), {0: bytes(head)} if first == 62 else {}


def pieces(f, start: int, end: int, size: int, piece: int = READ) -> Iterator[list]:
    """[head or None, offset, letters, runs] of the records, or parts, of a split's lines, in order."""
    now: list = [None, start, 0, []]
    for begins, letters, width, heads in lines_of(f, start, end, size, piece):
        is_head = np.zeros(len(begins), bool)
        is_head[list(heads)] = True
        new = np.ones(len(begins), bool)
        new[1:] = is_head[1:] | is_head[:-1] | (letters[1:] != letters[:-1]) | (width[1:] != width[:-1])
        at = np.flatnonzero(new)
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(begins)]):
            b, w = int(letters[i]), int(width[i])
            if i in heads:
                if now[0] is not None or now[3]:
                    yield now
                now = [heads[i][1:].rstrip(b"\r").decode(errors="replace"), min(int(begins[i]) + w, size), 0, []]
                continue
            now[2] += b * (j - i)
            if now[3] and now[3][-1][:2] == (b, w):
                now[3][-1] = (b, w, now[3][-1][2] + j - i)
            elif len(now[3]) < MOST_RUNS:
                now[3].append((b, w, j - i))
    if now[0] is not None or now[3]:
        yield now


class _Bytes(InputPartition):
    def __init__(self, path: str, size: int, number: int, start: int, end: int):
        self.path, self.size, self.number, self.start, self.end = path, size, number, start, end


class _Reader(DataSourceReader):
    ROWS = 20_000

    def __init__(self, options):
        self.paths, self.most = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self):
        return [_Bytes(p, n, i, a, b) for p, n in store.files(self.paths) for i, (a, b) in enumerate(store.splits(n, self.most))]

    def read(self, partition):
        if partition is None:  # what a task gets where nothing is to be read
            return
        p, rows = partition, []

        def batch(rows):
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS.values(), strict=True)], names=list(KINDS))

        with store.open_file(p.path) as f:
            held = None
            for k, (head, offset, n, runs) in enumerate(pieces(f, p.start, p.end, p.size)):
                if held:
                    rows.append(held)
                runs = [dict(zip("bwc", r, strict=True)) for r in runs]
                held = (p.path, p.number, k, head, offset, n, runs, head is None)
                if len(rows) >= self.ROWS:
                    yield batch(rows)
                    rows = []
            if held:  # a split's last record may go on in the next
                rows.append((*held[:-1], True))
        if rows:
            yield batch(rows)


class PieceSource(DataSource):
    """``path`` (files, folders or globs, comma-separated), ``splitBytes``."""

    @classmethod
    def name(cls):
        return "fasta_pieces"

    def schema(self):
        return PIECE

    def reader(self, schema):
        return _Reader(self.options)


def index_files(spark: SparkSession, paths, id_regexp: str = ID, full_head=False, split_bytes: int = 64 << 20) -> DataFrame:
    """(file, name, length, offset, line_bases, line_width) of each record of plain FASTA files, which may be wrapped at
    any width and end lines with ``\\r\\n``. A record whose lines differ, but for a shorter last one, is an error, and so
    are letters before a file's first header; blank lines are allowed at a record's end. Names may repeat, and then have a row each."""
    spark.dataSource.register(PieceSource)
    found = spark.read.format("fasta_pieces").option("path", paths if isinstance(paths, str) else ",".join(paths)).option("splitBytes", str(split_bytes)).load()
    # at most two rows a split go on: a file's are numbered in one window, by the record that they belong to
    edge = found.where("open").withColumn("of", F.last(F.when(F.col("head").isNotNull(), F.col("offset")), ignorenulls=True).over(Window.partitionBy("file").orderBy("split", "k")))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("split", "k", "runs"))), lambda x: x["runs"]))
    joined = edge.groupBy("file", "of").agg(F.max("head").alias("head"), F.sum("n").alias("n"), whole.alias("runs")).withColumnRenamed("of", "offset")
    all_ = found.where("not open").select("file", "head", "offset", "n", "runs").union(joined.select("file", "head", "offset", "n", "runs"))
    lost = F.col("head").isNull() & (F.col("n") > 0)
    all_ = all_.where(F.col("head").isNotNull() | lost)
    lb, lw = F.coalesce(F.get("runs", F.lit(0))["b"], F.lit(0)), F.coalesce(F.get("runs", F.lit(0))["w"], F.lit(0))
    last = F.array_max(F.transform("runs", lambda x, i: F.when(x["b"] > 0, i).otherwise(-1)))
    all_ = all_.withColumns({"lb": lb, "lw": lw, "last": F.coalesce(last, F.lit(-1)), "most": F.size("runs") == MOST_RUNS})
    other = lambda x: (x["b"] != F.col("lb")) | (x["w"] != F.col("lw"))
    odd = F.exists(F.transform("runs", lambda x, i: other(x) & ((i < F.col("last")) | ((i == F.col("last")) & ((x["c"] > 1) | (x["b"] > F.col("lb")))))), lambda x: x)
    head = F.when(lost, F.raise_error(F.concat(F.lit("letters before the first header of "), "file"))).when(odd | F.col("most"), F.raise_error(F.concat(F.lit("lines of different lengths in "), "head", F.lit(" of "), "file"))).otherwise(F.col("head"))
    name = F.col("name") if full_head else S.seq_id("name", id_regexp)
    return all_.withColumn("name", head).select("file", name.alias("name"), F.col("n").alias("length"), "offset", F.col("lb").alias("line_bases"), F.col("lw").alias("line_width"))


ASKED = "request long, name string, first long, last long"


def requests(spark: SparkSession, asked: list[str]) -> DataFrame:
    """(request, name, first, last) of ``id``, ``id:b-e``, ``id:b``, ``id:b-`` and ``id:-e``, as a caller writes them."""
    rows = []
    for i, q in enumerate(asked):
        m = re.fullmatch(r"(.+):(?:(\d+)-(\d+)|(\d+)-|-(\d+)|(\d+))", q)
        if not m:
            rows.append((i, q, None, None))
        elif m[2]:
            rows.append((i, m[1], int(m[2]), int(m[3])))
        elif m[4]:
            rows.append((i, m[1], int(m[4]), None))
        else:
            rows.append((i, m[1], 1 if m[5] else int(m[6]), int(m[5] or m[6])))
    return spark.createDataFrame(rows, ASKED)


def _fetch(batches, files: list[str]):
    """Letters of byte ranges of the numbered files; neighbours come out of one reading."""
    path, f, at, held = None, None, 0, b""
    try:
        for batch in batches:
            texts, size, begin = [], 0, 0
            cols = {n: batch.column(n).to_pylist() for n in ("number", "from", "to")}
            for i, (file, a, b) in enumerate(zip(cols["number"], cols["from"], cols["to"], strict=True)):
                if a is None or b is None or b < a:
                    texts.append("")
                    continue
                if file != path:
                    if f is not None:
                        f.close()
                    path, f, held = file, store.open_file(files[file]), b""
                if not (at <= a and b < at + len(held)):
                    f.seek(a)
                    at, held = a, f.read(max(b - a + 1, NEAR))
                texts.append(held[a - at : b - at + 1].translate(None, b"\r\n").decode())
                size += len(texts[-1])
                if size > READ:
                    yield _with(batch, begin, texts)
                    texts, size, begin = [], 0, i + 1
            if texts:
                yield _with(batch, begin, texts)
    finally:
        if f is not None:
            f.close()


def _with(batch, begin: int, texts: list[str]):
    part = batch.slice(begin, len(texts))
    return pa.RecordBatch.from_arrays([part.column("request"), part.column("name"), part.column("flip"), pa.array(texts, pa.string())], names=["request", "name", "flip", "seq"])


#: Requests that a task sorts.
TASK = 1 << 20


def read_ranges(index: DataFrame, asked: DataFrame, task: int = TASK) -> DataFrame:
    """(request, name, seq) of the regions of a table (request, name, first, last; 1-based), which may be as large as any:
    null bounds are the record's own, an end behind it is cut, first > last asks for the reverse complement, and a region that
    starts behind the record is empty. A name that the index lacks has no row. Requests meet the index by name and
    are dealt over tasks by their place in the files, some ``task`` each however many there are, where each reads its bytes only.
    The index is stored once in the shared folder, with its files by number: a list of paths is what the driver gets of it."""
    spark = asked.sparkSession
    path = scratch_path(spark, "index")
    index.select("name", "file", "length", "offset", "line_bases", "line_width").write.parquet(path)
    stored = spark.read.parquet(path)
    files = sorted(r[0] for r in stored.select("file").distinct().collect())
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(files)), "number int, file string"))
    index = stored.join(numbers, "file").drop("file")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // task))
    n = F.col("length")
    rows = asked.select("request", "name", "first", "last").join(index, "name")
    b, e = F.greatest(F.coalesce("first", F.lit(1)), F.lit(1)), F.coalesce("last", n)
    flip = F.col("first").isNotNull() & (b > e)
    rows = rows.withColumns({"flip": flip, "lo": F.when(flip, F.greatest(e, F.lit(1))).otherwise(b), "hi": F.least(F.when(flip, b).otherwise(e), n)})
    place = lambda c: F.when((F.col("lo") <= F.col("hi")) & (F.col("line_bases") > 0), F.col("offset") + F.floor((F.col(c) - 1) / F.col("line_bases")) * F.col("line_width") + (F.col(c) - 1) % F.col("line_bases"))
    label = F.when(F.col("first").isNull() & F.col("last").isNull(), F.col("name")).otherwise(F.concat("name", F.lit(":"), b, F.lit("-"), e))
    rows = rows.select("request", label.alias("name"), "flip", "number", place("lo").cast("long").alias("from"), place("hi").cast("long").alias("to"))
    # a number of tasks that is given is not merged to fewer, larger ones
    dealt = rows.repartitionByRange(tasks, "number", "from", "request").sortWithinPartitions("number", "from", "to")
    told = dealt.mapInArrow(lambda batches: _fetch(batches, files), "request long, name string, flip boolean, seq string")
    return told.select("request", "name", F.when(F.col("flip"), S.revcomp("seq")).otherwise(F.col("seq")).alias("seq"))
