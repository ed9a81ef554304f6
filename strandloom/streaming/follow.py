"""Growing sequence files as a stream: each micro-batch reads from every file what complete
records were added since the last.

Spark's own file source takes whole new files only, so this is a source of its own whose offset is each file's bytes
read. The driver lists names and sizes and looks at the end of each file that grew for the last complete record; the
bytes between are cut into splits, which tasks read and parse. A cut is moved on to the next record, so that neighbours agree
on it. A record that is half written is read when the rest is there; a file that shrank is read anew, one that is gone is
forgotten. Malformed lines come as rows with ``error``. Paths are those of mounts and of the stores that Arrow reaches.

Where a record ends depends on the bytes before alone (four lines of the form of a FASTQ record; a line before a FASTA
header), so that the end found in a file that grows never moves back, and a query that starts again reads no record twice.
"""

from __future__ import annotations

import io
import math
import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.ordering import ranked
from ..operators import sana
from ..sources import store

ROWS = "file string, start_byte long, number long, name string, seq string, qual string, error string, line string"
KINDS = {"file": pa.string(), "start_byte": pa.int64(), "number": pa.int64(), "name": pa.string(), "seq": pa.string(), "qual": pa.string(), "error": pa.string(), "line": pa.string()}
#: Bytes at a file's end that the driver looks at first; twice as many each time that no record ends there.
TAIL = 1 << 16


def record_at(lines: list[bytes], i: int) -> bool:
    """Whether four lines from ``i`` have the form of a FASTQ record. A quality that begins with @ is no header:
    two lines on is the next record's sequence, which has no +."""
    four = lines[i : i + 4]
    return len(four) == 4 and four[0][:1] == b"@" and four[2][:1] == b"+" and len(four[1].rstrip(b"\r")) == len(four[3].rstrip(b"\r"))


def complete(data: bytes, kind: str) -> int:
    """Where the last complete record of ``data`` ends; 0 without one. ``data`` begins at a line."""
    if kind == "fasta":  # a record is known to be over when the next begins
        return data.rfind(b"\n>") + 1
    lines = data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]
    end = next((i + 4 for i in range(len(lines) - 4, -1, -1) if record_at(lines, i)), 0)
    return sum(map(len, lines[:end])) + end


def end_of(path: str, kind: str, low: int, high: int) -> int:
    """Where the last complete record within [low, high) ends, or ``low``: from the file's end backwards."""
    with store.open_file(path) as f:
        tail = TAIL
        while True:
            a = max(low, high - tail)
            f.seek(a)
            data = f.read(high - a)
            skip = 0
            if a > low:  # a piece of a line; for FASTA the newline before a header stays
                skip = data.find(b"\n") + (kind == "fastq") if b"\n" in data else len(data)
            if end := complete(data[skip:], kind):
                return a + skip + end
            if a == low:
                return low
            tail *= 2


def lines_from(f, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(begin, line with its end) from the first line that begins at ``start`` or behind."""
    buffer = io.BufferedReader(f, 1 << 20)
    at = max(0, start - 1)
    buffer.seek(at)
    if start:
        at += len(buffer.readline())
    while at < size and (line := buffer.readline()):
        yield at, line
        at += len(line)
    buffer.detach()


def cut_at(path: str, kind: str, near: int, end: int) -> int:
    """The first record at ``near`` or behind that begins before ``end``, or ``end``."""
    if near >= end:
        return end
    with store.open_file(path) as f:
        last: list[tuple[int, bytes]] = []
        for at, line in lines_from(f, near, end):
            if kind == "fasta":
                if line.startswith(b">"):
                    return at
                continue
            last = [*last[-3:], (at, line.rstrip(b"\n"))]
            if record_at([x for _, x in last], 0):
                return last[0][0]
    return end


class _Range(InputPartition):
    """Bytes of a file: cuts to be moved on to records, within what the batch has of it."""

    def __init__(self, path: str, low: int, high: int, start: int, end: int):
        self.path, self.low, self.high, self.start, self.end = path, low, high, start, end


class _Reader(DataSourceStreamReader):
    #: Rows, and bytes of lines, that leave a task at once.
    BATCH, BYTES = 5000, 8 << 20
    #: Bytes of a task that starting it does not weigh on.
    WIDE = 64 << 20

    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.kind = options.get("kind", "fastq")
        self.regexp = options.get("regexp", r"\.(fq|fastq)$" if self.kind == "fastq" else r"\.(fa|fas|fasta)$")
        self.least = int(options.get("delta", "1"))
        self.last = options.get("final", "false").lower() == "true"
        self.gaps = options.get("gaps", "false").lower() == "true"
        self.most, self.split = int(options.get("maxBytes", str(1 << 60))), int(options.get("splitBytes", str(64 << 20)))
        self.tasks = int(options.get("maxTasks", str(1 << 60)))
        self.done: dict[str, int] | None = None

    def initialOffset(self):
        self.done = {}
        return {}

    def latestOffset(self):
        """Files by name share ``maxBytes``. Right after a restart it is not known what was read, and that batch has no limit."""
        known, end, left = self.done or {}, {}, self.most if self.done is not None else 1 << 60
        for path, size in store.below(self.root, self.regexp):
            at = known.get(path, 0)
            at = 0 if size < at else at
            end[path] = at
            if size - at < max(self.least, 1) or left <= 0:
                continue
            high = min(size, at + left)
            to = size if self.last and high == size else end_of(path, self.kind, at, high)
            if to == at and high < size:  # a record longer than the limit is read whole
                to = cut_at(path, self.kind, high, size)
                to = to if to < size or self.last else end_of(path, self.kind, at, size)
            end[path], left = to, left - (to - at)
        return end

    def partitions(self, start, end):
        """A task has one split, or where the batch has more of them than ``maxTasks`` those that follow each other in a file, up to ``WIDE`` bytes."""
        self.done = dict(end)
        new = [(path, 0 if start.get(path, 0) > to else start.get(path, 0), to) for path, to in sorted(end.items())]
        share = min(sum(to - at for _, at, to in new) / self.tasks, max(self.WIDE, self.split))
        step = self.split * max(1, math.ceil(share / self.split))
        return [_Range(path, at, to, at + a, at + b) for path, at, to in new for a, b in store.splits(to - at, step)]

    def read(self, partition):
        if partition is None:  # what a task gets where nothing is to be read
            return
        p = partition
        start = p.low if p.start == p.low else cut_at(p.path, self.kind, p.start, p.high)
        end = p.high if p.end == p.high else cut_at(p.path, self.kind, p.end, p.high)
        size, rows = 0, []

        def lines(f):
            nonlocal size
            for at, line in lines_from(f, start, end):
                size += len(line)
                yield line[: end - at].decode(errors="replace")

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS.values(), strict=True)], names=list(KINDS))

        if start >= end:
            return
        with store.open_file(p.path) as f:
            parse = sana.fastq if self.kind == "fastq" else sana.fasta
            for n, name, seq, qual, error, line in parse(lines(f), self.gaps):
                rows.append((p.path, start, n, name, seq, qual, error, line))
                if len(rows) >= self.BATCH or size >= self.BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    def commit(self, end):
        self.done = dict(end)


class GrowingSource(DataSource):
    @classmethod
    def name(cls):
        return "growing_fx"

    def schema(self):
        return ROWS

    def streamReader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingSource)


def follow(spark: SparkSession, folder: str, kind: str = "fastq", **options) -> DataFrame:
    """The stream of a folder's records and rejects; ``number`` is the line counted from ``start_byte``, where a task
    began. Options: regexp, delta (bytes that a file has to grow by), final (what is there is complete), gaps,
    maxBytes (of a batch), splitBytes (what files are cut into), maxTasks (of a batch, else two a core; with more splits, a task
    reads several that follow each other; beside it each file that grew has a task at least)."""
    register(spark)
    options = {"maxTasks": 2 * spark.sparkContext.defaultParallelism} | options
    reader = spark.readStream.format("growing_fx").option("path", folder).option("kind", kind)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def watch_stream(records: DataFrame, value, width: float) -> DataFrame:
    """A running histogram: (bin, count), for output mode complete."""
    return records.where("error is null").groupBy((F.floor(value / width) * width).alias("bin")).count()


class Reports:
    """A sink for ``tee``: a histogram reported after every so many records, over all batches.

    Records of a batch are numbered in the order of file and place by a distributed sort; those of one report and bin are
    counted, and these few rows are stored as the batch's. A batch that is run again replaces its own rows. ``table``
    has the reports that are complete: all records until then or, with ``reset``, those since the report before."""

    def __init__(self, spark: SparkSession, folder: str, value, width: float, every: int, reset=False):
        self.spark, self.folder, self.value, self.width, self.every, self.reset = spark, folder.rstrip("/"), value, width, every, reset

    def _stored(self) -> DataFrame:
        kind = "report long, bin double, count long, batch long"
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(kind).parquet(self.folder) if there else self.spark.createDataFrame([], kind)

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = self._stored().where(F.col("batch") < number).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        bin_ = (F.floor(self.value / self.width) * self.width).cast("double").alias("bin")
        placed = ranked(batch.where("error is null").select("file", "start_byte", "number", bin_), "file", "start_byte", "number")
        report = F.floor((F.col("rank") - 1 + before) / self.every).cast("long").alias("report")
        placed.groupBy(report, "bin").agg(F.count("*").alias("count")).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def table(self) -> DataFrame:
        """(report, from 1; bin; count)."""
        stored = self._stored()
        whole = stored.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] // self.every
        each = stored.groupBy("report", "bin").agg(F.sum("count").alias("count"))
        if not self.reset and whole:  # a bin is in all reports from its first on
            last = F.lit(whole - 1).cast("long")
            grid = each.groupBy("bin").agg(F.min("report").alias("from")).where(F.col("from") <= last).select("bin", F.explode(F.sequence("from", last)).alias("report"))
            until = Window.partitionBy("bin").orderBy("report").rowsBetween(Window.unboundedPreceding, 0)
            each = grid.join(each, ["report", "bin"], "left").withColumn("count", F.sum(F.coalesce("count", F.lit(0))).over(until))
        return each.where(F.col("report") < whole).select((F.col("report") + 1).alias("report"), "bin", "count")


def tee(stream: DataFrame, *sinks: Callable[[DataFrame, int], None], checkpoint: str | None = None, every: str | None = None):
    """Starts a query that gives every micro-batch to each sink (a pass-through beside a report, say), at once or ``every`` interval."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(each)
    writer = writer.trigger(processingTime=every) if every else writer
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def stop_when_idle(query, seconds: float | None = None, pid: int | None = None, poll: float = 0.2) -> None:
    """Stops a query that has read no rows for so many seconds, or after a process of this machine has ended and all
    that it wrote has been read. An error of the query is raised."""
    if seconds is None and pid is None:
        raise ValueError("one of seconds and pid")
    seen, since = None, time.monotonic()
    while not query.awaitTermination(poll):
        told = [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
        last = told[-1] if told else None
        if last != seen or query.status["isDataAvailable"] or query.lastProgress is None:  # none: it is still starting
            seen, since = last, time.monotonic()
        if pid is not None and not os.path.exists(f"/proc/{pid}"):
            query.processAllAvailable()
            break
        if seconds is not None and time.monotonic() - since >= seconds:
            break
    query.stop()
