"""Data sources for ``spark.read.format("fx")``, a partition a file, and ``("bam")``, a partition a split of a file."""

from __future__ import annotations

import glob
import json
import os
import uuid

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .. import schema
from . import alignments, bgzf, store
from .formats import parse_fx, unpack


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _ByFile(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for q in options["path"].split(",") for p in glob.glob(q))

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(self.paths)]


class _Fx(_ByFile):
    def read(self, partition):
        with open(partition.path, "rb") as f:
            for n, (name, seq, qual) in enumerate(parse_fx(unpack(partition.path, f.read()))):
                head, _, desc = name.partition(" ")
                yield partition.path, partition.number, n, head, desc.lstrip(), name, seq, qual


class FxSource(DataSource):
    @classmethod
    def name(cls):
        return "fx"

    def schema(self):
        return schema.RECORD

    def reader(self, schema):
        return _Fx(self.options)


class _Split(InputPartition):
    """Bytes of a file, or virtual offsets from an index."""

    def __init__(self, path: str, size: int, start, end, exact=False):
        self.path, self.size, self.start, self.end, self.exact = path, size, start, end, exact


class _Bam(DataSourceReader):
    #: Records that leave a task at once, of those of one run.
    ROWS = 10_000

    def __init__(self, options):
        self.paths, self.most, self.region = options["path"], int(options.get("splitBytes", 64 << 20)), options.get("region")

    def partitions(self):
        found = [(p, n) for p, n in store.files(self.paths) if not p.endswith(".bai")]
        if self.region is None:
            return [_Split(p, n, a, b) for p, n in found for a, b in store.splits(n, self.most)]
        name, _, span = self.region.rpartition(":")
        start, end = map(int, span.split("-"))
        out = []
        for path, size in found:
            with store.open_file(path) as f, store.open_file(path + ".bai") as index:
                names = [n for n, _ in bgzf.header(bgzf.Stream(bgzf.Window(f, size), 0))[1]]
                chunks = alignments.region_chunks(index.read(), names.index(name), start, end) if name in names else []
            out += [_Split(path, size, a, b, True) for a, b in chunks]
        return out

    def read(self, partition):
        if partition is None:  # what a task gets where nothing is to be read
            return
        with store.open_file(partition.path) as f:
            window = bgzf.Window(f, partition.size)
            if partition.exact:
                refs, found = bgzf.runs(window, 0, partition.size, partition.start)
            else:
                refs, found = bgzf.runs(window, partition.start, partition.end)
            out = alignments.Decoder(partition.path, refs)
            for data, starts, blocks, places in found:
                if partition.exact:  # virtual offsets grow with the records
                    starts = starts[: ((blocks < partition.end[0]) | ((blocks == partition.end[0]) & (places < partition.end[1]))).sum()]
                for i in range(0, len(starts), self.ROWS):
                    yield out.batch(data, starts[i : i + self.ROWS])
                if len(starts) < len(blocks):
                    break


class _Written(WriterCommitMessage):
    def __init__(self, path: str, partition: int, records: int):
        self.path, self.partition, self.records = path, partition, records


class _BamWriter(DataSourceArrowWriter):
    """Files under names of attempts, then renamed by the driver to ``part-<number>.bam``. ``bare``: records alone, neither header nor end."""

    def __init__(self, options, overwrite):
        self.folder, self.refs, self.header = options["path"].rstrip("/"), [tuple(r) for r in json.loads(options["refs"])], options.get("header", "")
        self.bare, self.overwrite = options.get("bare", "false").lower() == "true", overwrite
        self.pending = f"{self.folder}/_attempts-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        context, n = TaskContext.get(), 0
        number = {name: i for i, (name, _) in enumerate(self.refs)}

        def parts():
            nonlocal n
            if not self.bare:
                yield alignments.header_bytes(self.refs, self.header)
            for batch in iterator:
                n += len(batch)
                yield alignments.encode_records(batch, number)

        partition = context.partitionId() if context else 0
        path = f"{self.pending}/{partition}-{uuid.uuid4().hex}"
        with store.open_new(path) as f:
            for block in alignments.blocks_of(parts()):
                f.write(block)
            if not self.bare:
                f.write(alignments.END)
        return _Written(path, partition, n)

    def commit(self, messages):
        if self.overwrite:
            for path, _ in store.files(self.folder) if messages else ():
                store.remove(path)
        run = "" if self.bare or self.overwrite else f"-{uuid.uuid4().hex[:12]}"
        for m in messages:
            if m is not None:
                store.move(m.path, f"{self.folder}/part-{m.partition:06d}{run}.bam")
        store.remove_folder(self.pending)

    def abort(self, messages):
        store.remove_folder(self.pending)


def assemble(spark, folder: str, path: str, head: bytes, tail: bytes) -> None:
    """One file of a folder's parts in order: each task copies a part to its place in a file of another name, which is then renamed."""
    if "Local" not in type(store.at(path)[0]).__name__:
        raise ValueError("one file needs a mounted folder; a store of objects keeps a folder of files")
    target = store.at(path)[1]
    pending = f"{target}.{uuid.uuid4().hex}"
    rows, at = [], len(head)
    for part, size in store.files(folder):
        rows.append((part, at))
        at += size
    with open(pending, "wb") as f:
        f.write(head)
        f.truncate(at)
        f.seek(at)
        f.write(tail)

    def copy(batches):
        for batch in batches:
            for part, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_file(part) as source, open(pending, "r+b") as f:
                    f.seek(place)
                    while piece := source.read(8 << 20):
                        f.write(piece)
            yield batch

    if rows:
        kind = "part string, place long"
        spark.createDataFrame(rows, kind).repartition(min(len(rows), 10_000)).mapInArrow(copy, kind).write.format("noop").mode("overwrite").save()
    os.replace(pending, target)
    store.remove_folder(folder)


class BamSource(DataSource):
    """``path`` (files, folders or globs, comma-separated), ``splitBytes``, ``region``; to write, ``refs`` (JSON), ``header``, ``bare``."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return alignments.ALN

    def reader(self, schema):
        return _Bam(self.options)

    def writer(self, schema, overwrite):
        return _BamWriter(self.options, overwrite)
