"""SimHash near-duplicates found with Golay-code fuzzy keys.

A document's 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The
perfect [23, 12, 7] code maps each (zero-extended) segment to the index of its one
nearest codeword. A segment's *neighbour keys* are the indices of the words at
distance 0 or 1; where two segments differ in one bit at most, the index of either is
among the neighbour keys of the other.

Two fingerprints that differ in 3 bits or fewer fall in one of two cases:

* all three segments differ by one bit at most: key (neighbour of s0, index of s1,
  index of s2) of the one meets (index of s0, neighbour of s1, neighbour of s2) of the
  other;
* otherwise one segment is equal and some other differs by one bit at most (3 = 3+0+0 =
  2+1+0): key (equal segment's bits, index or neighbour of the other) meets.

The first kind of key has 36 bits, the second 33 and more, so buckets hold little besides
true neighbours. Distinct fingerprints alone are dealt to buckets; every pair in a bucket
is verified, and a bucket gives a spanning forest of its links, never all pairs.
Components come from alternating large-star and small-star rounds on written tables.

Texts are whole; null and empty ones have no words and fingerprint zero. Rows with a null
doc_id take part; the component's id is the smallest non-null doc_id. Equal doc_ids are
rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common as C

#: Generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the perfect Golay code (fixed value).
GOLAY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
ONE = np.uint64(1)


# -- fingerprints -------------------------------------------------------------


def majority(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of each group of hashes (``n`` of them, one at least, from ``start``): the bits set in over half of them."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cuts = np.unique(np.concatenate([start, np.arange(0, len(h), 128)]))
    part = np.add.reduceat(bits, cuts, axis=0, dtype=np.uint8).astype(np.int64)
    ones = np.add.reduceat(part, np.searchsorted(cuts, start), axis=0)
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_texts(texts: list[bytes], k: int = 3, seed: int = 42) -> np.ndarray:
    """For each text the majority bits (as uint64) of the XXH64 hashes of its k-word
    shingles, repeats included."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi in C.slices([len(t) for t in texts], 1 << 20):
        words = C.Words([t.lower() for t in texts[lo:hi]])
        n = np.where(words.count == 0, 0, np.maximum(words.count - k + 1, 1))
        if not n.sum():
            continue
        some = np.flatnonzero(n)
        offset = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(offset, n) + np.repeat(words.first, n)
        last = at + np.repeat(np.minimum(words.count, k), n) - 1
        h = C.xxh64_spans(words.buf, words.start[at], words.end[last], seed)
        out[lo + some] = majority(h, offset[some], n[some])
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp bigint) of every row."""

    def make():
        def step(batch: pa.RecordBatch):
            fps = fingerprint_texts(C.byte_values(batch.column(1)), k)
            return {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

        return step

    return C.map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")), make, "doc_id long, fp long")


# -- Golay keys ---------------------------------------------------------------


def _syndromes(words: np.ndarray) -> np.ndarray:
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GOLAY << (bit - 11)), words)
    return words


def _leaders() -> np.ndarray:
    """The one error of weight 3 or less for each of the 2048 syndromes."""
    bits = [0] + [1 << i for i in range(23)]
    errors = np.unique([a | b | c for a in bits for b in bits for c in bits])
    out = np.zeros(2048, np.int64)
    out[_syndromes(errors)] = errors
    return out


class Golay:
    def __init__(self):
        self.leader = _leaders()
        self.parts = [_syndromes(np.arange(256) << s & 0x7FFFFF) for s in (0, 8, 16)]

    def index(self, words: np.ndarray) -> np.ndarray:
        """12-bit index of each 23-bit word's nearest codeword."""
        a, b, c = self.parts
        s = a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16]
        return (words ^ self.leader[s]) >> 11

    def around(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbour keys: a row of width+1 indices for each word, and which of them
        are the first of their value."""
        near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(width)])[None, :]
        keys = np.sort(self.index(near), axis=1)
        return keys, np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)


def fuzzy_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, row number) pairs of all fingerprints, without repeats of a pair."""
    fps = fps.view(np.uint64)
    rows = np.arange(len(fps))
    seg = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    own = [golay.index(x) for x in seg]
    near = []
    for x, (_, w) in zip(seg, SEGMENTS, strict=True):
        keys, new = golay.around(x, w)
        r, c = np.nonzero(new)
        near.append((r, keys[r, c], new.sum(axis=1)))
    out_k, out_r = [], []
    for i in range(3):  # an equal segment and a near one
        for j in range(3):
            if i != j:
                r, key, _ = near[j]
                out_k.append(seg[i][r] << 15 | key << 3 | i * 2 + (j > 3 - i - j))
                out_r.append(r)
    # all three near: the first expanded, then the other two
    r0, k0, _ = near[0]
    out_k.append(k0 << 27 | own[1][r0] << 15 | own[2][r0] << 3 | 7)
    out_r.append(r0)
    r1, k1, _ = near[1]
    r2, k2, n2 = near[2]
    from2 = np.concatenate([[0], np.cumsum(n2)[:-1]])
    times = n2[r1]
    a = np.repeat(np.arange(len(r1)), times)
    b = from2[r1[a]] + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    out_k.append(own[0][r1[a]] << 27 | k1[a] << 15 | k2[b] << 3 | 7)
    out_r.append(r1[a])
    keys, rows = np.concatenate(out_k), np.concatenate(out_r)
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[new], rows[new]


# -- verification within buckets ------------------------------------------------


def forest(fps: np.ndarray, bits: int, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fps``; with ``head``, of those among
    ``head`` and ``fps`` that have an end in each. Memory is linear."""
    left = fps if head is None else head
    both = fps if head is None else np.concatenate([head, fps])
    label = np.arange(len(both))
    a, b = [], []
    for i in range(len(left)):
        other = fps[i + 1 :] if head is None else fps
        at = np.flatnonzero(np.bitwise_count(other ^ left[i]) <= bits)
        at = at + (i + 1 if head is None else len(head))
        at = at[label[at] != label[i]]
        if len(at):
            labels, first = np.unique(label[at], return_index=True)
            a += [both[i]] * len(first)
            b += both[at[first]].tolist()
            label[np.isin(label, labels)] = label[i]
    return np.array(a, np.uint64), np.array(b, np.uint64)


SMALL, BLOCK = 6, 8192


def bucket_links(keys: np.ndarray, fps: np.ndarray, bits: int, block: int = BLOCK):
    """Links of all keys' buckets (rows sorted by key): arrays of ends, then the runs too
    large for one task as (key, fingerprints)."""
    change = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([change, [len(keys)]]))
    run = np.repeat(size, size)
    ends = [[], []]
    small = (run > 1) & (run <= SMALL)
    k, f = keys[small], fps[small]
    for d in range(1, SMALL):
        hit = (k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= bits)
        ends[0].append(f[:-d][hit])
        ends[1].append(f[d:][hit])
    large = []
    for at, n in zip(change[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        if n > block:
            large.append((int(keys[at]), fps[at : at + n]))
            continue
        x, y = forest(fps[at : at + n], bits)
        ends[0].append(x)
        ends[1].append(y)
    x, y = np.concatenate(ends[0]), np.concatenate(ends[1])
    pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pair[0], pair[1], large


def links(distinct: DataFrame, n_distinct: int, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b) links among distinct fingerprints, enough to connect all that are linked."""
    if bits > 3:
        raise ValueError("the keys meet up to 3 differing bits")
    spark = distinct.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_distinct * 66 // 500_000))

    def make_keys():
        golay = Golay()

        def step(batch: pa.RecordBatch):
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, rows = fuzzy_keys(fps, golay)
            bucket = ((C.mix(keys.astype(np.uint64)) >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, f, bucket = keys[order], fps[rows[order]], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
            ends = [*cut[1:].tolist(), len(bucket)]
            return {"bucket": bucket[cut], "keys": [keys[a:b].astype("<i8").tobytes() for a, b in zip(cut.tolist(), ends, strict=True)], "fps": [f[a:b].astype("<u8").tobytes() for a, b in zip(cut.tolist(), ends, strict=True)]}

        return step

    blobs = C.map_batches(distinct.select("fp"), make_keys, "bucket long, keys binary, fps binary", rows=10_000)

    def by_bucket(batches):
        def flush(have):
            if not have:
                return
            keys = np.concatenate([np.frombuffer(x[0], "<i8") for x in have])
            fps = np.concatenate([np.frombuffer(x[1], "<u8") for x in have])
            order = np.argsort(keys, kind="stable")
            a, b, large = bucket_links(keys[order], fps[order], bits, block)
            big = [(k, i // block, f[i : i + block]) for k, f in large for i in range(0, len(f), block)]
            none = [None] * len(big)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64).tolist() + none, pa.int64()), "b": pa.array(b.view(np.int64).tolist() + none, pa.int64()), "key": pa.array([None] * len(a) + [x[0] for x in big], pa.int64()), "block": pa.array([None] * len(a) + [x[1] for x in big], pa.int64()), "fps": pa.array([None] * len(a) + [x[2].astype("<u8").tobytes() for x in big], pa.binary())})

        now, have = None, []
        for batch in batches:
            for bucket, k, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from flush(have)
                    now, have = bucket, []
                have.append((k, f))
        yield from flush(have)

    found = C.written(blobs.repartition(min(buckets, C.MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket, "a long, b long, key long, block long, fps binary"), "links")
    # buckets of more than ``block`` fingerprints: block against block, dealt over the cluster
    blocks = found.where("fps is not null")
    x, y = blocks.select("key", F.col("block").alias("i"), F.col("fps").alias("f")), blocks.select("key", F.col("block").alias("j"), F.col("fps").alias("g"))

    def make_pairs():
        def step(batch: pa.RecordBatch):
            for f, g, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f, g = np.frombuffer(f, "<u8"), np.frombuffer(g, "<u8")
                a, b = forest(f, bits) if same else forest(g, bits, f)
                yield {"a": a.view(np.int64), "b": b.view(np.int64)}

        return step

    # numbers of blocks meet first, 16 bytes each; the blocks come to their pairs by (key, number)
    pairs = x.select("key", "i").join(y.select("key", "j"), "key").where("i <= j").join(x, ["key", "i"]).join(y, ["key", "j"])
    pairs = pairs.select("f", "g", (F.col("i") == F.col("j")).alias("same"))
    far = C.map_batches(pairs.repartition(min(buckets, C.MOST_PARTITIONS)), make_pairs, "a long, b long")
    near = found.where("fps is null").select("a", "b")
    return near.union(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# -- components ----------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node's smallest reachable node, for nodes that have links, by
    alternating large-star and small-star rounds, as many as it takes: each but the last
    brings some node to a smaller one, and their number grows with the logarithm of the nodes."""
    edges = C.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", in_few=True)
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = state(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = C.written(small, "stars", in_few=True)
        now = state(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _labelled(docs: DataFrame, doc_id: str, text: str, k: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every fingerprint."""
    marked = C.written(fingerprints(docs, doc_id, text, k), "fingerprints")
    distinct = C.written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(distinct, distinct.count(), bits))
    return marked, lowest(distinct, roots)


def lowest(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every row (fp, rep) of ``distinct``."""
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    return C.written(labelled.join(least, "root").select("fp", "root", "component_id"), "labels", in_few=True)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp bigint, component_id (smallest doc_id reachable) of every row of ``docs``."""
    marked, label = _labelled(docs, doc_id, text, k, bits)
    return marked.join(label, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, bits: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: that with its smallest doc_id. Where several rows
    of a component have that id, or none has an id, any one of them by a hash."""
    return choose(docs, *_labelled(docs, doc_id, text, k, bits), doc_id, text, lambda texts: fingerprint_texts(texts, k))


def choose(docs: DataFrame, marked: DataFrame, label: DataFrame, doc_id: str, text: str, of_texts) -> DataFrame:
    """The rows that stand for their components; ``of_texts`` gives the fp (uint64) of each text."""
    odd = C.written(marked.groupBy("doc_id").count().where("doc_id is null or count > 1").select(F.col("doc_id").alias("odd_id")), "odd", in_few=True)
    keep = marked.join(label, "fp").where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("own_id"))
    if not odd.head(1):
        return rows.join(keep, rows.own_id == keep.kept_id, "left_semi").select("row.*")
    # ids that are null or repeat: these rows alone are told apart by their fingerprints
    met = rows.own_id.eqNullSafe(odd.odd_id)
    plain = rows.join(odd, met, "left_anti").join(keep, F.col("own_id") == keep.kept_id, "left_semi").select("row.*")
    place = docs.columns.index(text)

    def make():
        return lambda batch: {"row": batch.column(0), "own_id": batch.column(1), "fp": of_texts(C.byte_values(batch.column(0).field(place).cast(pa.binary()))).view(np.int64)}

    apart = rows.join(odd, met, "left_semi")
    apart = C.map_batches(apart, make, StructType([*apart.schema.fields, StructField("fp", LongType())]))
    apart = apart.join(label, "fp").where("own_id <=> component_id")
    apart = apart.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64(F.to_json("row")))))
    return plain.unionByName(apart.where("n = 1").select("row.*"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(C.table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
