"""Removal of repeated word windows by level-wise doubling.

A window of ``window`` = base * 2**k words can only repeat where both of its halves
repeat. So all windows of ``base`` words are tested first; those repeated are extended to
twice that length where the following window repeats too, and so on until the asked
length is reached or no candidate is left.

Documents are kept in *chunks* (compressed rows of about 2 MB of text). For each level a
chunk sends each hash bucket one block: its sorted distinct window hashes, as compressed
byte planes (about 3 bytes a window). A bucket answers each block with one bit a hash. So a
phrase that occurs everywhere counts once a chunk, and what a task holds is bounded by the bucket
size, which sets the number of buckets. A block is a row of many windows as long as a chunk's windows
outnumber the buckets; beyond that (some 10 TB) rows come to hold about one window each.

Filter levels use hashes just long enough for the corpus: a false repeat there costs a later test and
nothing else. The last level compares windows by the 128-bit BLAKE2b digests of their words (joined by
one space, which no word has): equal digests are equal words, for texts that collide cannot be made and
10^13 windows meet by chance once in 10^12 runs. The first occurrence of a window is the smallest
(doc_id, start); documents with equal ids come in chunk order; null ids come first. Null and empty
texts have no words and are kept as they are.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 24 << 20
#: Bits of the last level's hashes: the first half of a digest, beside which its rest travels.
EXACT = 64
CHUNK = "chunk long, n_bytes long, docs binary, marks binary"
WORD = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


def _store(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _load(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def _texts(t: pa.Table, text: str) -> list[bytes]:
    return C.byte_values(t.column(text).cast(pa.binary()))


def _bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), count=n).astype(bool)


def chunks(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Whole rows of ``docs`` in chunks, each sorted by id. A chunk's number is its
    partition's and its place there, which a repeated task gives again."""

    def run(batches):
        from pyspark import TaskContext

        number, have, size = TaskContext.get().partitionId() << 32, [], 0

        def close():
            t = pa.Table.from_batches(have)
            keys = t.column(doc_id).combine_chunks()
            order = pa.compute.sort_indices(pa.table({"k": keys}), sort_keys=[("k", "ascending")], null_placement="at_start")
            t = t.take(order)
            return pa.RecordBatch.from_pydict({"chunk": [number], "n_bytes": [size], "docs": [_store(t)], "marks": pa.array([None], pa.binary())})

        for batch in batches:
            sizes = [x or 0 for x in pa.compute.binary_length(batch.column(text)).to_pylist()]
            for a, b in C.slices(sizes, chunk_bytes):
                n = sum(sizes[a:b])
                if have and size + n > chunk_bytes:
                    yield close()
                    number, have, size = number + 1, [], 0
                have.append(batch.slice(a, b - a))
                size += n
        if have:
            yield close()

    return docs.mapInArrow(run, CHUNK)


def window_digests(words: C.Words, width: int, at: np.ndarray) -> np.ndarray:
    """A row of two 64-bit halves of the BLAKE2b digest of each window."""
    raw, blake = words.buf.tobytes(), hashlib.blake2b
    ends = words.end[at + width - 1].tolist()
    told = b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(words.start[at].tolist(), ends, strict=True)])
    return np.frombuffer(told, "<u8").reshape(-1, 2)


class Level:
    """One chunk's windows of ``width`` words at the places in ``at``: their distinct hashes of ``bits``
    bits in order or, with bits = EXACT, their digests as ``distinct`` and ``rest``; ``first`` is the first
    place of each, ``which`` the one of each place, ``times`` how often it stands there."""

    def __init__(self, words: C.Words, width: int, at: np.ndarray, bits: int):
        self.at = at
        h = np.zeros((len(at), 2), np.uint64)
        if len(at) and bits == EXACT:
            h = window_digests(words, width, at)
        elif len(at):
            h[:, 0] = C.SpanHash(words.buf, seed=width).of(words.start[at], words.end[at + width - 1]) >> np.uint64(64 - bits)
        order = np.lexsort((h[:, 1], h[:, 0])) if bits == EXACT else np.argsort(h[:, 0], kind="stable")
        ordered = h[order]
        new = np.ones(len(at), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        self.first = order[new]
        self.distinct, self.rest = ordered[new, 0], ordered[new, 1]
        self.which = np.empty(len(at), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.times = np.bincount(self.which, minlength=len(self.distinct))


def _places(words: C.Words, width: int) -> np.ndarray:
    n = len(words.start) - width + 1
    return np.flatnonzero(words.doc[: max(n, 0)] == words.doc[width - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _bucket_of(h: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    top = h >> np.uint64(max(0, bits - 32))
    return ((top * np.uint64(buckets)) >> np.uint64(min(bits, 32))).astype(np.int64)


def _blocks(chunk: int, level: Level, ids: np.ndarray | None, bits: int, buckets: int):
    """(bucket, chunk, block) of a level's distinct hashes; ``ids`` orders documents."""
    if not len(level.distinct):
        return
    bucket = _bucket_of(level.distinct, bits, buckets)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:]):
        h = level.distinct[a:b]
        parts = [np.concatenate([h[:1], np.diff(h)])]
        if ids is not None:
            parts += [level.rest[a:b], ids[level.first[a:b]].view(np.uint64)]
        yield int(bucket[a]), chunk, C.pack(np.concatenate(parts))


def answer(have: list[tuple[int, bytes]], last: bool) -> list[tuple[int, bytes]]:
    """For each block a bit a hash: whether another block has it, or at the last level
    whether another has it with a smaller (doc id, chunk)."""
    values = [C.unpack(b) for _, b in have]
    sizes = np.array([len(v) // (3 if last else 1) for v in values])
    h = np.concatenate([np.cumsum(v[:n], dtype=np.uint64) for v, n in zip(values, sizes, strict=True)])
    if last:
        rest = np.concatenate([v[n : 2 * n] for v, n in zip(values, sizes, strict=True)])
        ids = np.concatenate([v[2 * n :].view(np.int64) for v, n in zip(values, sizes, strict=True)])
        chunk = np.repeat(np.array([c for c, _ in have]), sizes)
        order = np.lexsort((chunk, ids, rest, h))
        told = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (rest[order][1:] == rest[order][:-1])])
    else:
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        told = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    flags = np.empty(len(h), bool)
    flags[order] = told
    return [(c, _bits(f)) for (c, _), f in zip(have, np.split(flags, np.cumsum(sizes)[:-1]), strict=True)]


def answers(blocks: DataFrame, buckets: int, last: bool) -> DataFrame:
    """Each chunk's answers, by bucket."""

    def run(batches):
        def flush(bucket, have):
            if have:
                told = answer(have, last)
                yield pa.RecordBatch.from_pydict({"chunk": [c for c, _ in told], "bucket": [bucket] * len(told), "told": [t for _, t in told]})

        now, have = None, []
        for batch in batches:
            for bucket, chunk, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from flush(now, have)
                    now, have = bucket, []
                have.append((chunk, block))
        yield from flush(now, have)

    told = blocks.select("bucket", "chunk", "block").repartition(min(buckets, C.MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, bucket long, told binary")
    return told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told")).alias("told"))


def _told(level: Level, told, bits: int, buckets: int) -> np.ndarray:
    """The answers for each distinct hash of a chunk."""
    out = np.zeros(len(level.distinct), bool)
    bucket = _bucket_of(level.distinct, bits, buckets)
    for x in told or ():
        a, b = np.searchsorted(bucket, x["bucket"]), np.searchsorted(bucket, x["bucket"], "right")
        out[a:b] = _flags(x["told"], b - a)
    return out


def _by_chunk(df: DataFrame, step, schema: str) -> DataFrame:
    C.small_batches(df.sparkSession)

    def run(batches):
        C.worker_cache("")
        for batch in batches:
            for i in range(batch.num_rows):
                yield from step(batch.slice(i, 1).to_pylist()[0])
        C.tidy()

    return df.mapInArrow(run, schema)


def repeats(docs: DataFrame, window: int = 20, base: int = 10, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, settle=None):
    """Chunk tables: (settled, open, told, width, bits, buckets). No window of a settled
    chunk's documents repeats, and of these ``settle`` has made what is stored; an open chunk's
    ``marks`` are its candidate windows and ``told`` the answers for them."""
    levels = [base]
    while levels[-1] < window:
        levels.append(levels[-1] * 2)
    if levels[-1] != window:
        raise ValueError("window must be base * 2**k words")
    state = C.written(chunks(docs, doc_id, text, chunk_bytes), "chunks")
    total = state.agg(F.sum("n_bytes")).first()[0] or 1
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    short = min(62, math.ceil(math.log2(total + 2)) + 11)

    def order_of(t: pa.Table) -> np.ndarray:
        ids = t.column(doc_id).combine_chunks().cast(pa.int64())
        return ids.fill_null(-(2**63)).to_numpy()

    def blocks_of(level_width: int, bits: int, last: bool):
        def step(row):
            t = _load(row["docs"])
            words = C.Words(_texts(t, text))
            at = _places(words, level_width)
            if row["marks"] is not None:
                at = at[_flags(row["marks"], len(at))]
            level = Level(words, level_width, at, bits)
            out = list(_blocks(row["chunk"], level, order_of(t)[words.doc[at]] if last else None, bits, buckets))
            if out:
                yield pa.RecordBatch.from_pydict({"bucket": [x[0] for x in out], "chunk": [x[1] for x in out], "block": [x[2] for x in out]})

        return step

    def extend(width: int, bits: int):
        """A chunk's documents with candidates for twice ``width`` words, and those without."""

        def step(row):
            t = _load(row["docs"])
            texts = _texts(t, text)
            words = C.Words(texts)
            places = _places(words, width)
            at = places if row["marks"] is None else places[_flags(row["marks"], len(places))]
            level = Level(words, width, at, bits)
            good = ((level.times > 1) | _told(level, row["told"], bits, buckets))[level.which]
            repeated = np.zeros(len(words.start) + width, bool)
            repeated[at[good]] = True
            twice = _places(words, 2 * width)
            marks = repeated[twice] & repeated[twice + width]
            opened = np.zeros(t.num_rows, bool)
            opened[words.doc[twice[marks]]] = True
            for is_open in (False, True):
                part = t.filter(pa.array(opened == is_open))
                if part.num_rows:
                    flags = _bits(marks[opened[words.doc[twice]]]) if is_open else None
                    yield pa.RecordBatch.from_pydict({"chunk": [row["chunk"]], "n_bytes": [part.num_rows], "docs": [_store(part if is_open or settle is None else settle(part))], "marks": pa.array([flags], pa.binary())})

        return step

    settled = []
    for width in levels[:-1]:
        told = answers(_by_chunk(state, blocks_of(width, short, False), "bucket long, chunk long, block binary"), buckets, False)
        state = C.written(_by_chunk(state.join(told, "chunk", "left"), extend(width, short), CHUNK), "level")
        settled.append(state.where("marks is null"))
        state = state.where("marks is not null")
    told = answers(_by_chunk(state, blocks_of(window, EXACT, True), "bucket long, chunk long, block binary"), buckets, True)
    return settled, state, told, window, EXACT, buckets


def covered(words: C.Words, width: int, at: np.ndarray) -> np.ndarray:
    """Which words the windows that start at ``at`` cover."""
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(docs: DataFrame, finish, schema, window: int, base: int, doc_id: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``finish(table, texts, removed)`` over all chunks; ``removed`` flags each text's words, or
    is None if no word goes."""

    def settle(t):
        return pa.Table.from_batches(finish(t, texts := _texts(t, text), [None] * len(texts)))

    filtered = window > base
    settled, opened, told, width, bits, buckets = repeats(docs, window, base, doc_id, text, chunk_bytes, settle)

    def step(row):
        t = _load(row["docs"])
        if row["marks"] is None and filtered:
            yield from t.to_batches()
            return
        texts = _texts(t, text)
        words = C.Words(texts)
        at = _places(words, width)
        at = at[_flags(row["marks"], len(at))] if row["marks"] is not None else at
        level = Level(words, width, at, bits)
        later = np.ones(len(at), bool)
        later[level.first] = False
        gone = covered(words, width, at[later | _told(level, row["told"], bits, buckets)[level.which]])
        removed = [f if f.any() else None for f in np.split(gone, np.cumsum(words.count)[:-1])]
        yield from finish(t, texts, removed)

    none = F.lit(None).cast("array<struct<bucket:bigint,told:binary>>")
    parts = [s.withColumn("told", none) for s in settled] + [opened.join(told, "chunk", "left")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _by_chunk(rows, step, schema)


def remove_repeats(docs: DataFrame, window: int = 20, base: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words that repeat an earlier window cut from ``text``, blanks
    before them too; other texts stay byte for byte. All columns and rows stay."""

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.schema)
    place = docs.columns.index(text)

    def finish(t, texts, removed):
        if any(f is not None for f in removed):
            new = [None if v is None else v.as_py() if f is None else b"".join(w for w, gone in zip(WORD.findall(x), f.tolist(), strict=True) if not gone).lstrip().decode() for v, x, f in zip(t.column(place), texts, removed, strict=True)]
            t = t.set_column(place, t.schema.field(place), pa.array(new, t.schema.field(place).type))
        yield from t.cast(arrow).to_batches()

    return _apply(docs, finish, StructType.fromJson(docs.schema.jsonValue()), window, base, doc_id, text)


def digest(docs: DataFrame, window: int = 20, base: int = 10, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def finish(t, texts, removed):
        split = [x.split() for x in texts]
        kept = [w if f is None else [x for x, gone in zip(w, f.tolist(), strict=True) if not gone] for w, f in zip(split, removed, strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": t.column(doc_id).combine_chunks().cast(pa.int64()), "n_words": [len(w) for w in split], "n_removed": [len(w) - len(k) for w, k in zip(split, kept, strict=True)], "kept_sha256": [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]})

    return _apply(docs.select(doc_id, text), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", window, base, doc_id, text, chunk_bytes)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(C.table(spark, sf_dir, "documents"))
