"""Helpers shared by the corpus operators.

Scratch tables go to the folder that ``spark.checkpoint.dir`` names, which driver and executors
share. They are deleted when the session's JVM ends, or before that by the ``Scratch`` that was open
when they were written: no operator deletes tables of another's result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.layout import scratch_path, spread


class Scratch:
    """The scratch tables written while it is open (``with``), until ``delete``."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)

    def delete(self) -> None:
        """For callers that have stored every result built on these tables."""
        while self.paths:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of inputs for which a scratch table of few files has one.
FILE_BYTES = 32 << 20


def few(df: DataFrame) -> int:
    """How many files are few for ``df``: one for each ``FILE_BYTES`` that its plan reads, or one a core."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return min(max(df.sparkSession.sparkContext.defaultParallelism, -(-read // FILE_BYTES)), 2**31 - 1)


def written(df: DataFrame, tag: str, in_few: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the
    lineage and survives lost executors. ``in_few``: in few files, each of which is several calls of its store,
    and on a local disk as many processes that an executor starts. Tasks then run several
    partitions in turn, so not for rows that their task numbers or sorts."""
    spark = df.sparkSession
    df = df.coalesce(few(df)) if in_few else df
    path = scratch_path(spark, tag)
    if Scratch._open:
        Scratch._open[-1].paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a Python worker keeps from task to task, by owner.
KEPT: dict[str, dict] = {}
#: Bytes of rows that reach a Python worker at once, where the session does not say itself.
BATCH_BYTES = "16m"
#: Partitions of an exchange of hashes; each holds its buckets one after the other.
MOST_PARTITIONS = 8192


def worker_cache(owner: str) -> dict:
    """``owner``'s cache in this worker; those of other operators are dropped."""
    for other in [k for k in KEPT if k != owner]:
        del KEPT[other]
    return KEPT.setdefault(owner, {})


def tidy() -> None:
    """Gives memory that a task has freed back to the system; workers live on."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: A text that a sample cuts counts for at most this part of the sample's bytes.
SAMPLE_PART = 64


def within_bytes(rows: DataFrame, keys: list[str], order: list[str], text: str, group: str, groups: int, max_rows: int, max_bytes: int) -> list:
    """At most ``max_rows`` rows, the first in ``order``, of at most ``max_bytes`` of text, collected. Rows are chosen by
    keys and lengths alone; texts of the chosen ones are fetched afterwards, so that no task gathers more than the result.
    Each of ``groups`` values of ``group`` has its own part of the bytes. A text of more than a ``SAMPLE_PART``-th of the bytes, or a
    quarter of a group's, is cut to as many characters as surely fit: no text, however long, leaves a group without rows.
    Rows equal in ``keys`` and text count once."""
    own = max_bytes // max(1, groups)
    one = max(4, min(max_bytes // SAMPLE_PART, own // 4))
    keyed = rows.withColumns({"_d": F.xxhash64(text), "_n": F.octet_length(text)})
    keys, held = [*keys, "_d"], F.least(F.col("_n"), F.lit(one))
    thin = keyed.select(*keys, *[c for c in [*order, group, "_n"] if c not in keys]).distinct().orderBy(*order, "_d").limit(max_rows)
    upto = F.sum(held).over(Window.partitionBy(group).orderBy(*order, "_d").rowsBetween(Window.unboundedPreceding, 0))
    chosen = thin.withColumn("_upto", upto).where(F.col("_upto") <= own).select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)]
    cut = F.when(F.col("_n") > one, F.substring(F.col(text).cast("string"), 1, one // 4)).otherwise(F.col(text).cast("string"))
    met = keyed.join(F.broadcast(chosen), same).withColumn(text, cut.cast("binary"))  # at most max_rows keys
    return met.dropDuplicates(keys).select(*rows.columns).orderBy(*order, text).collect()


def judge_rows(docs: DataFrame, text: str, make, fields: str, rows: int = 512) -> DataFrame:
    """``docs`` as a struct column ``row``, beside columns (``fields``) made from each whole
    text. ``make`` runs once a task and returns a function of the texts (bytes, null as None)
    that gives columns by name. Narrow: no row moves, and no name clashes."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    made = _parse_datatype_string(fields)
    schema = StructType([StructField("row", StructType.fromJson(docs.schema.jsonValue())), *made.fields])
    place = docs.columns.index(text)

    def start():
        judge = make()

        def step(batch: pa.RecordBatch):
            row = batch.column(0)
            return {"row": row, **judge(row.field(place).cast(pa.binary()).to_pylist())}

        return step

    return map_batches(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), start, schema, rows)


def small_batches(spark: SparkSession) -> None:
    """Holds batches of rows for Python workers to ``BATCH_BYTES``. A session's setting of its own stays;
    without one the setting is for the whole session, for a plan has none of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_BYTES)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict | None]], schema: str, rows: int = 1024, owner: str = "") -> DataFrame:
    """``mapInArrow`` by a function of at most ``rows`` rows that returns columns by
    name (a dict) or several such dicts. ``make`` runs once a task."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    small_batches(df.sparkSession)

    def run(batches):
        worker_cache(owner)
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = step(batch.slice(at, rows))
                for out in [got] if isinstance(got, dict) else got or ():
                    cols = [out[f.name] for f in arrow]
                    cols = [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type, from_pandas=isinstance(c, np.ndarray) and c.dtype.kind == "f") for c, f in zip(cols, arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=arrow)
        del step
        tidy()

    return df.mapInArrow(run, kind)


def byte_values(column: pa.Array) -> list[bytes]:
    """Binary values with null as empty."""
    return [v if v is not None else b"" for v in column.to_pylist()]


# -- text as one buffer -------------------------------------------------------


class Words:
    """The words of many texts in one byte buffer.

    ``buf`` holds each text's words joined by one space and the texts joined by one
    newline (neither byte occurs in a word); ``start``/``end`` are the words' places in
    it, ``doc`` their text's number and ``first`` each text's first word's number.
    Words are runs of bytes other than blank and 0x09-0x0D.
    """

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.count = np.fromiter(map(len, split), np.int64, len(split))
        self.buf = np.frombuffer(b"\n".join([b" ".join(w) for w in split]) + b"\n", np.uint8)
        gaps = np.flatnonzero((self.buf == 32) | (self.buf == 10))
        starts = np.concatenate([[0], gaps[:-1] + 1]) if len(gaps) else gaps
        full = starts < gaps
        self.start, self.end = starts[full], gaps[full]
        self.doc = np.repeat(np.arange(len(split)), self.count)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64) if len(split) else np.zeros(0, np.int64)


def _byte_codes(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class SpanHash:
    """64-bit hashes of any byte spans of a buffer, from prefix sums of a polynomial with an odd base
    over random byte codes, modulo 2**64. Sums are made for ``PIECE`` bytes at a time, and beyond that as
    far as the spans that start there reach. Texts can be made that collide: what must not err compares
    words or digests after it."""

    BASE = 0x9E3779B97F4A7C15 | 1
    PIECE = 1 << 20

    def __init__(self, buf: np.ndarray, seed: int = 1):
        self.buf, self.codes = buf, _byte_codes(seed)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of spans whose starts do not descend."""
        out = np.empty(len(start), np.uint64)
        inverse = pow(self.BASE, -1, 1 << 64)
        at = 0
        while at < len(start):
            base = int(start[at])
            to = int(np.searchsorted(start, base + self.PIECE))
            last = int(end[at:to].max())
            powers, back = _powers(self.BASE, last - base), _powers(inverse, last - base + 1)
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes[self.buf[base:last]] * powers, dtype=np.uint64)])
            a, b = start[at:to] - base, end[at:to] - base
            out[at:to] = mix((prefix[b] - prefix[a]) * back[a] + (b - a).astype(np.uint64))
            at = to
        return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ...; those of up to 2 * PIECE places are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base & (2**64 - 1), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 2 * SpanHash.PIECE:
            _POWERS[base] = have
    return have[:n]


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    import zstandard

    raw = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8")


# -- XXH64 of many spans ----------------------------------------------------------

#: The five primes of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each buf[start:end]; spans of 32 bytes and more go to the C library."""
    import xxhash

    out = np.empty(len(start), np.uint64)
    whole = np.concatenate([buf, np.zeros(8, np.uint8)])
    words8 = np.ndarray((len(buf) + 1,), "<u8", whole, strides=(1,))
    words4 = np.ndarray((len(buf) + 1,), "<u4", whole, strides=(1,))
    raw = None
    for at in range(0, len(start), 1 << 15):
        a, n = start[at : at + (1 << 15)], (end - start)[at : at + (1 << 15)]
        h = np.uint64((seed + int(P5)) & (2**64 - 1)) + n.astype(np.uint64)
        pos, left = a.copy(), n.copy()
        for _ in range(3):
            i = np.flatnonzero(left >= 8)
            if not len(i):
                break
            k = _rotl(words8[pos[i]] * P2, 31) * P1
            h[i] = _rotl(h[i] ^ k, 27) * P1 + P4
            pos[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        h[i] = _rotl(h[i] ^ (words4[pos[i]].astype(np.uint64) * P1), 23) * P2 + P3
        pos[i] += 4
        left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(left > 0)
            h[i] = _rotl(h[i] ^ (whole[pos[i]].astype(np.uint64) * P5), 11) * P1
            pos[i] += 1
            left[i] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[at : at + (1 << 15)] = h ^ (h >> np.uint64(32))
        for i in np.flatnonzero(n >= 32).tolist():
            raw = raw or buf.tobytes()
            out[at + i] = xxhash.xxh64_intdigest(raw[a[i] : a[i] + n[i]], seed)
    return out


def slices(sizes, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of items with sizes that sum to about ``most`` at most."""
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            out.append((at, i))
            at, total = i, 0
        total += n
    return out + [(at, len(sizes))] if len(sizes) else []
