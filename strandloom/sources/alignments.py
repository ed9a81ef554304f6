"""SAM and BAM files: BAM in splits of bytes, by records; a file or a folder of files written with a commit."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import bgzf, store

OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
ALN = "file string, " + schema.ALN


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    sizes = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    while at + 3 <= len(raw):
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            out[tag] = raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            f = f"<{n}{sizes[sub]}"
            out[tag] = ",".join(map(str, struct.unpack_from(f, raw, at + 5)))
            at += 5 + struct.calcsize(f)
        else:
            v = struct.unpack_from("<" + sizes[kind], raw, at)[0]
            out[tag] = v.decode() if kind == "A" else str(v)
            at += struct.calcsize(sizes[kind])
    return out


#: Two letters a byte.
PAIRS = np.array([[ord(a), ord(b)] for a in BASES for b in BASES], np.uint8)
#: A letter's code; of both cases, and 15 for any that has none.
CODES = np.full(256, 15, np.uint8)
for _i, _c in enumerate(BASES):
    CODES[ord(_c)] = CODES[ord(_c.lower())] = _i
#: A record's size and its fields of fixed size.
HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flags", "<u2"), ("n_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("span", "<i4")])
#: Pieces of more bytes than this on average move one by one, shorter ones by an index of their bytes.
LONG = 256


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ``data``, one behind the other."""
    ends = _ends(sizes)
    if ends[-1] > LONG * len(sizes):
        return np.concatenate([data[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
    return data[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]


def _scatter(out: np.ndarray, starts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> None:
    """Puts the pieces that follow each other in ``data`` to their places."""
    ends = _ends(sizes)
    if ends[-1] > LONG * len(sizes):
        for to, a, n in zip(starts.tolist(), ends.tolist(), sizes.tolist(), strict=False):
            out[to : to + n] = data[a : a + n]
    else:
        out[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])] = data


_tag_items = lru_cache(1 << 16)(lambda raw: tuple(_tags(raw).items()))


class Decoder:
    """Records as Arrow batches with the columns of ``ALN``, many records at a time."""

    def __init__(self, path: str, refs: list[tuple[str, int]]):
        self.path = path
        self.names, self.lengths = pa.array([n for n, _ in refs], pa.string()), pa.array([k for _, k in refs], pa.int32())

    def batch(self, data: bytes, starts: np.ndarray) -> pa.RecordBatch:
        """The records of ``data`` that begin, with their sizes, at ``starts``."""
        n, raw = len(starts), np.frombuffer(data, np.uint8)
        head = raw[starts[:, None] + np.arange(HEAD.itemsize)].view(HEAD)[:, 0]
        n_name, n_cigar, n_seq = (head[f].astype(np.int64) for f in ("n_name", "n_cigar", "n_seq"))
        packed = (n_seq + 1) // 2
        at_cigar = starts + HEAD.itemsize + n_name
        at_seq = at_cigar + 4 * n_cigar
        at_qual, end = at_seq + packed, starts + 4 + head["size"]
        at_tags = at_qual + n_seq
        if n and (at_tags > end).any():
            raise ValueError(f"a record of {self.path} is longer than its size")
        text = lambda values, sizes: pa.StringArray.from_buffers(n, pa.py_buffer(_ends(sizes).astype(np.int32)), pa.py_buffer(values))
        lists = lambda kind, sizes, *values: kind.from_arrays(pa.array(_ends(sizes).astype(np.int32)), *values)
        ops = _gather(raw, at_cigar, 4 * n_cigar).view("<u4")
        letters = pa.DictionaryArray.from_arrays(pa.array((ops & 15).astype(np.int32)), pa.array(list(OPS))).dictionary_decode()
        cigar = pa.StructArray.from_arrays([letters, pa.array((ops >> 4).astype(np.int32))], names=["op", "len"])
        seq = PAIRS[_gather(raw, at_seq, packed)].reshape(-1)
        if (n_seq & 1).any():  # the last half of a byte is no letter
            keep = np.ones(len(seq), bool)
            keep[_ends(2 * packed)[1:][n_seq & 1 == 1] - 1] = False
            seq = seq[keep]
        n_qual = np.where((n_seq > 0) & (raw[np.minimum(at_qual, len(raw) - 1)] != 255), n_seq, 0) if n else n_seq
        tags = [_tag_items(data[a:b]) for a, b in zip(at_tags.tolist(), end.tolist(), strict=True)]
        items = list(chain.from_iterable(tags))
        keys, values = pa.array([k for k, _ in items], pa.string()), pa.array([v for _, v in items], pa.string())
        ref = pa.array(head["ref"].astype(np.int64), mask=head["ref"] < 0)
        ints = lambda f: pa.array(head[f].astype(np.int32))
        read = text(_gather(raw, starts + HEAD.itemsize, n_name - 1), n_name - 1)
        read.validate(full=True)
        columns = [pa.repeat(pa.scalar(self.path), n), read, self.names.take(ref), self.lengths.take(ref), ints("pos"), ints("mapq"), ints("flags"), lists(pa.ListArray, n_cigar, cigar), text(seq, n_seq), lists(pa.ListArray, n_qual, pa.array(_gather(raw, at_qual, n_qual).astype(np.int32))), lists(pa.MapArray, np.fromiter(map(len, tags), np.int64, n), keys, values)]
        return pa.RecordBatch.from_arrays(columns, names=["file", "read", "ref", "ref_len", "pos", "mapq", "flags", "cigar", "seq", "qual", "tags"])


def _tag(k: str, v: str) -> bytes:
    return k.encode() + (b"i" + struct.pack("<i", int(v)) if v.lstrip("-").isdigit() else b"Z" + v.encode() + b"\0")


def _record(r: dict, number: dict[str, int]) -> bytes:
    name, seq = r["read"].encode() + b"\0", "" if r["seq"] in (None, "*") else r["seq"]
    cigar = b"".join(struct.pack("<I", c["len"] << 4 | OPS.index(c["op"])) for c in r["cigar"] or [])
    codes = [BASES.index(c) if c in BASES else 15 for c in seq.upper()] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    qual = bytes(r["qual"]) if r["qual"] else b"\xff" * len(seq)
    tags = b"".join(_tag(k, v) for k, v in (r["tags"] or {}).items())
    body = struct.pack("<iiBBHHHiiii", number.get(r["ref"], -1), r["pos"], len(name), r["mapq"], 0, len(r["cigar"] or []), r["flags"], len(seq), -1, -1, 0) + name + cigar + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, sizes) of a column of texts; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8))[ends[0] : ends[-1]], np.diff(ends)


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode_records(batch: pa.RecordBatch, number: dict[str, int]) -> bytes:
    """The records of a batch; ``number`` is that of each reference. What the arrays below have no form for (letters that are not
    ASCII, nulls, qualities of another length, fields out of range, tags that are no map) goes record by record."""
    n, column = len(batch), {k: batch.column(k) for k in batch.schema.names}
    cigar, qual, tags = column["cigar"], column["qual"], column["tags"]
    ops, steps = pc.struct_field(cigar.flatten(), "op").dictionary_encode(), pc.struct_field(cigar.flatten(), "len")
    scores = qual.flatten()
    name, n_name = _bytes_of(column["read"])
    n_name = n_name + 1
    seq, n_seq = _bytes_of(pc.if_else(pc.equal(column["seq"], "*"), "", column["seq"]))
    n_cigar, n_qual = _sizes(cigar), _sizes(qual)
    known = np.array([OPS.find(o) if o and len(o) == 1 else -1 for o in ops.dictionary.to_pylist()] or [0], np.int64)
    within = lambda x, low, high: not len(x) or (not x.null_count and pc.min(x).as_py() >= low and pc.max(x).as_py() <= high)
    plain = pa.types.is_map(tags.type) and not (column["read"].null_count or tags.null_count or ops.null_count) and (known >= 0).all() and (n_name < 256).all() and (n_cigar < 1 << 16).all() and not (seq > 127).any() and ((n_qual == n_seq) | (n_qual == 0)).all()
    plain = plain and within(steps, 0, (1 << 28) - 1) and within(scores, 0, 255) and within(column["mapq"], 0, 255) and within(column["flags"], 0, 65535) and within(column["pos"], -(1 << 31), (1 << 31) - 1)
    if not plain:
        return b"".join(_record(r | {"tags": dict(r["tags"] or ())}, number) for r in batch.to_pylist())
    at = tags.offsets.to_numpy()
    low, high = (int(at[0]), int(at[-1])) if n else (0, 0)
    keys, values = tags.keys[low:high].dictionary_encode(), tags.items[low:high].dictionary_encode()
    if values.null_count:
        raise ValueError("a tag without a value")
    wide = max(len(values.dictionary), 1)
    kinds, kind = np.unique(keys.indices.to_numpy().astype(np.int64) * wide + values.indices.to_numpy(), return_inverse=True)
    names, texts = keys.dictionary.to_pylist(), values.dictionary.to_pylist()
    told = [_tag(names[i // wide], texts[i % wide]) for i in kinds.tolist()]
    each = np.fromiter(map(len, told), np.int64, len(told))
    tag_bytes = _gather(np.frombuffer(b"".join(told), np.uint8), _ends(each)[kind], each[kind])
    upto = _ends(each[kind])
    n_tags = upto[at[1:] - low] - upto[at[:-1] - low]
    packed = (n_seq + 1) // 2
    size = HEAD.itemsize + n_name + 4 * n_cigar + packed + n_seq + n_tags
    ends = _ends(size)
    starts, out = ends[:-1], np.zeros(ends[-1], np.uint8)
    head = np.zeros(n, HEAD)
    refs = column["ref"].dictionary_encode()
    numbers = np.array([*(number.get(r, -1) for r in refs.dictionary.to_pylist()), -1], np.int64)
    head["ref"] = numbers[pc.fill_null(refs.indices, len(numbers) - 1).to_numpy(zero_copy_only=False)]
    for field, values in (("size", size - 4), ("n_name", n_name), ("n_cigar", n_cigar), ("n_seq", n_seq), ("next_ref", -1), ("next_pos", -1), *((f, column[f].to_numpy(zero_copy_only=False)) for f in ("pos", "mapq", "flags"))):
        head[field] = values
    out[starts[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(n, HEAD.itemsize)
    place = starts + HEAD.itemsize
    _scatter(out, place, name, n_name - 1)
    place = place + n_name
    steps = steps.to_numpy(zero_copy_only=False).astype(np.uint32) << 4 | known[ops.indices.to_numpy(zero_copy_only=False)].astype(np.uint32)
    _scatter(out, place, steps.astype("<u4").view(np.uint8), 4 * n_cigar)
    place = place + 4 * n_cigar
    codes = CODES[seq]
    if (n_seq & 1).any():
        codes = np.insert(codes, _ends(n_seq)[1:][n_seq & 1 == 1], 0)
    _scatter(out, place, codes[::2] << 4 | codes[1::2], packed)
    place = place + packed
    values = np.full(n_seq.sum(), 255, np.uint8)
    values[np.repeat(n_qual > 0, n_seq)] = scores.to_numpy(zero_copy_only=False)
    _scatter(out, place, values, n_seq)
    _scatter(out, place + n_seq, tag_bytes, n_tags)
    return out.tobytes()


def _bgzf(part: bytes) -> bytes:
    d = zlib.compressobj(6, zlib.DEFLATED, -15)
    z = d.compress(part) + d.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(z) + 25) + z + struct.pack("<II", zlib.crc32(part), len(part))


def header_bytes(refs: list[tuple[str, int]], header: str = "") -> bytes:
    text = (header or "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in refs)).encode()
    have = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    return have + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in refs)


#: The empty block that ends a file.
END = _bgzf(b"")


def blocks_of(parts: Iterable[bytes], size: int = 60_000) -> Iterator[bytes]:
    """BGZF blocks of the data, as they fill."""
    have = b""
    for part in parts:
        have = have + part if have else part
        at = 0
        while len(have) - at > size:
            yield _bgzf(have[at : at + size])
            at += size
        have = have[at:]
    if have:
        yield _bgzf(have)


def bam_blocks(rows: Iterable[dict], refs: list[tuple[str, int]], header: str = "", size: int = 60_000) -> Iterator[bytes]:
    """The blocks of a BAM file of records in the given order, as they fill."""
    number = {n: i for i, (n, _) in enumerate(refs)}
    yield from blocks_of(chain([header_bytes(refs, header)], (_record(r, number) for r in rows)), size)
    yield END


def encode_bam(rows: Iterable[dict], refs: list[tuple[str, int]], header: str = "") -> bytes:
    return b"".join(bam_blocks(rows, refs, header))


def read_bam(spark: SparkSession, paths, split_bytes: int = 64 << 20, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Records of BAM files (paths, folders, globs), by splits of ``split_bytes`` that read their own part of a file; of a
    region (reference, start, end; 0-based, half-open) those parts alone that the ``.bai`` beside each file names."""
    from .python_sources import BamSource

    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("path", paths if isinstance(paths, str) else ",".join(paths)).option("splitBytes", split_bytes)
    if region is None:
        return reader.load()
    name, start, end = region
    rows = reader.option("region", f"{name}:{start}-{end}").load()
    span = F.aggregate("cigar", F.lit(0), lambda n, x: n + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0))
    return rows.where((F.col("ref") == name) & (F.col("pos") < end) & (F.col("pos") + F.greatest(span, F.lit(1)) > start))


def write_bam(df: DataFrame, refs: list[tuple[str, int]], path: str, single: bool = False, header: str = "") -> None:
    """Alignment records as BAM: a folder of files, one a partition in its order, or with ``single`` one file in the order of
    partitions. ``refs`` (name, length) is the header's list. Tasks write under names of their own; what shows in the end is the
    commit of one attempt a partition, or nothing.

    One file is put together by tasks that copy parts to their places, known from the parts' sizes; its store must be a
    mount that can write at a place."""
    from .python_sources import BamSource, assemble

    spark = df.sparkSession
    spark.dataSource.register(BamSource)
    rows = df.select("read", "ref", "pos", "mapq", "flags", "cigar", "seq", "qual", "tags")
    folder = f"{path}.parts-{uuid.uuid4().hex}" if single else path
    rows.write.format("bam").option("path", folder).option("refs", json.dumps(refs)).option("header", header).option("bare", single).mode("append").save()
    if single:
        assemble(spark, folder, path, b"".join(blocks_of([header_bytes(refs, header)])), END)


def sam_rows(lines: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """SAM lines (``value``) as alignment records; ``refs`` (ref, ref_len) tells lengths."""
    c = F.col("c")
    rows = lines.where((F.col("value") != "") & ~F.col("value").startswith("@")).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 11)
    lengths, ops = F.regexp_extract_all(c[5], F.lit(r"(\d+)([MIDNSHP=X])"), 1), F.regexp_extract_all(c[5], F.lit(r"(\d+)([MIDNSHP=X])"), 2)
    cigar = F.zip_with(ops, lengths, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))
    qual = F.when(c[10] == "*", F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.split(c[10], ""), lambda x: x != ""), lambda x: F.ascii(x) - 33))
    tags = F.map_from_entries(F.transform(F.slice(c, F.lit(12), F.size(c)), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(6), F.length(t)))))
    out = rows.select(c[0].alias("read"), F.when(c[2] != "*", c[2]).alias("ref"), (c[3].cast("int") - 1).alias("pos"), c[4].cast("int").alias("mapq"), c[1].cast("int").alias("flags"), cigar.alias("cigar"), c[9].alias("seq"), qual.alias("qual"), tags.alias("tags"))
    if refs is not None:
        return out.join(refs, "ref", "left")
    return out.withColumn("ref_len", F.lit(None).cast("int"))


def sam_references(lines: DataFrame) -> DataFrame:
    head = lines.where(F.col("value").startswith("@SQ"))
    return head.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("ref"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("ref_len"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return sam_rows(lines, sam_references(lines))


def as_sam(df: DataFrame) -> DataFrame:
    """``value``: SAM lines of alignment records."""
    cigar = F.when(F.size("cigar") > 0, F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), x["op"])), "")).otherwise("*")
    qual = F.when(F.size("qual") > 0, F.array_join(F.transform("qual", lambda q: F.chr((q + 33).cast("long"))), "")).otherwise("*")
    tags = F.transform(F.map_entries("tags"), lambda t: F.concat(t["key"], F.when(t["value"].rlike(r"^-?\d+$"), F.lit(":i:")).otherwise(F.lit(":Z:")), t["value"]))
    return df.select(F.concat_ws("\t", "read", F.col("flags").cast("string"), F.coalesce("ref", F.lit("*")), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), "seq", qual, tags).alias("value"))


def region_chunks(content: bytes, ref: int, start: int, end: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Virtual offsets (from, to) of a .bai file that hold the records of a region, merged where they touch. Bins are the
    format's: 8 for each one above, from 2^29 letters down to 2^14."""
    if content[:4] != b"BAI\1":
        raise ValueError("no BAI")
    at, chunks, floor = 8, [], 0
    bins = {0}
    for level in range(1, 6):
        shift, first = 29 - 3 * level, (8**level - 1) // 7
        bins |= set(range(first + (start >> shift), first + (max(end - 1, start) >> shift) + 1))
    for number in range(struct.unpack_from("<i", content, 4)[0]):
        n_bins = struct.unpack_from("<i", content, at)[0]
        at += 4
        for _ in range(n_bins):
            b, n = struct.unpack_from("<Ii", content, at)
            if number == ref and b in bins:
                chunks += [struct.unpack_from("<QQ", content, at + 8 + 16 * i) for i in range(n)]
            at += 8 + 16 * n
        n_steps = struct.unpack_from("<i", content, at)[0]
        if number == ref and n_steps:
            floor = struct.unpack_from("<Q", content, at + 4 + 8 * min(start >> 14, n_steps - 1))[0]
        at += 4 + 8 * n_steps
    out: list[list[int]] = []
    for a, b in sorted(c for c in chunks if c[1] > floor):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [((a >> 16, a & 0xFFFF), (b >> 16, b & 0xFFFF)) for a, b in out]


def index_summary(content: bytes) -> tuple[list[tuple[int, int, int] | None], int | None]:
    """(mapped, unmapped) of each reference from a .bai file's summary bins, or None without one, with the reference's
    number first; and the records without a place, or None in an index that does not have them."""
    if content[:4] != b"BAI\1":
        raise ValueError("no BAI")
    n, at, out = struct.unpack_from("<i", content, 4)[0], 8, []
    for ref in range(n):
        told = None
        bins = struct.unpack_from("<i", content, at)[0]
        at += 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", content, at)
            at += 8
            if number == 37450:
                told = (ref, *struct.unpack_from("<QQ", content, at + 16))
            at += 16 * chunks
        at += 4 + 8 * struct.unpack_from("<i", content, at)[0]
        out.append(told)
    return out, struct.unpack_from("<Q", content, at)[0] if len(content) >= at + 8 else None


def index_counts(content: bytes) -> list[tuple[int, int, int]]:
    """(reference number, mapped, unmapped) from a .bai file's summary bins."""
    return [x or (i, 0, 0) for i, x in enumerate(index_summary(content)[0])]


def encode_summary(counts: list[tuple[int, int] | None], unplaced: int | None) -> bytes:
    """A .bai of summaries alone: counts without chunks."""
    one = lambda c: struct.pack("<i", 0) if c is None else struct.pack("<iIiQQQQ", 1, 37450, 2, 0, 0, *c)
    return b"BAI\1" + struct.pack("<i", len(counts)) + b"".join(one(c) + struct.pack("<i", 0) for c in counts) + (b"" if unplaced is None else struct.pack("<Q", unplaced))


def _by_index(spark: SparkSession, paths, rows_of, kind: str) -> DataFrame:
    names = [part.split()[0] for part in kind.split(",")]

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows := rows_of(path.removesuffix(".bai"), content):
                    yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, kind)


def index_stat(spark: SparkSession, paths) -> DataFrame:
    """(AlnPerc, Aligned, Unmapped, TotalRec, File) of .bai files, a row for each; no record is read. Unmapped are the records
    without a place; an index that does not count them is an error."""

    def rows_of(path, content):
        counts, unplaced = index_summary(content)
        if unplaced is None:
            raise ValueError(f"the index of {path} does not count unmapped records")
        return [(sum(c[1] for c in counts if c), unplaced, path)]

    told = _by_index(spark, paths, rows_of, "Aligned long, Unmapped long, File string")
    total = F.col("Aligned") + F.col("Unmapped")
    return told.select(F.coalesce(F.try_divide(F.col("Aligned") * 100.0, total), F.lit(0.0)).alias("AlnPerc"), "Aligned", "Unmapped", total.alias("TotalRec"), "File")


def index_count(spark: SparkSession, paths) -> DataFrame:
    """(Ref, Count, File) of the references that .bai files count; names are in the headers of the BAM files beside them."""

    def rows_of(path, content):
        size = store.files([path])[0][1]
        with store.open_file(path) as f:
            names = [n for n, _ in bgzf.header(bgzf.Stream(bgzf.Window(f, size), 0))[1]]
        return [(names[c[0]], c[1], path) for c in index_summary(content)[0] if c]

    return _by_index(spark, paths, rows_of, "Ref string, Count long, File string")


def read_bai(spark: SparkSession, paths) -> DataFrame:
    """(file, ref_number, mapped, unmapped) of index files: their summaries, not the records."""

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = index_counts(content)
                yield pa.RecordBatch.from_pydict({"file": [path] * len(rows), "ref_number": pa.array([r[0] for r in rows], pa.int32()), "mapped": pa.array([r[1] for r in rows], pa.int64()), "unmapped": pa.array([r[2] for r in rows], pa.int64())})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "file string, ref_number int, mapped long, unmapped long")
