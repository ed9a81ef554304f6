"""Near copies: SimHash finds them, the exact Jaccard similarity of word shingles tells them.

A text's set holds the hashes of its shingles of ``k`` words, in lower case; a text of fewer words
is one shingle. A shingle's hash mixes the XXH64 of its words, each by its place. Texts of equal sets are one node. A set has ``SIMS`` SimHash fingerprints of 64 bits,
each over hashes of its own. Every fingerprint is cut into the segments of ``near_dedup``; a key is the
Golay index of one segment, so that segments near the same codeword agree, with ``PIECE`` bits of
the segment after it, ``PIECES`` such keys a segment. Nodes that share a key and differ in ``NEAR``
bits or fewer of their first two fingerprints (128 bits) are candidates. Two sets of similarity 0.8
differ in 0.15 of the bits (a smaller share above that): 19 of 128 on average with a standard deviation
of 4, where unrelated ones differ in 64 with one of 5.7.

A bucket links its candidates to the least one that they are connected to, and leaves out what the keys
of its first two fingerprints connect in other buckets. So links grow with the nodes and not with their pairs,
nor with how many keys these share; the sets of each component of candidates are then compared, and pairs of similarity
``least`` and more are linked. No bucket is capped: large components are compared block against
block over the cluster.

Null and empty texts have the empty set and are one node, as in ``near_dedup``; its fingerprints,
its components and its choice among rows are used here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import near_dedup as N

SIMS, PIECES, PIECE = 16, 3, 5
KEYS = SIMS * len(N.SEGMENTS) * PIECES
NEAR = 35
#: Sets and bytes of sets in a block.
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: Runs of one key up to this size are compared all at once.
SMALL = 64

#: Odd factors of a word's places in a shingle.
_PLACE = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.Generator(np.random.PCG64(10)).integers(0, 2**64, SIMS, dtype=np.uint64)


# -- sets, nodes and keys --------------------------------------------------------


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one text after the other, and how many each has."""
    words = C.Words([t.lower() for t in texts])
    n = np.where(words.count == 0, 0, np.maximum(words.count - k + 1, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.first, n)
    last = at + np.repeat(np.minimum(words.count, k), n) - 1
    word = C.xxh64_spans(words.buf, words.start, words.end, seed=10)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        there = at + j <= last
        h += np.where(there, C.mix(word[np.minimum(at + j, last)] + _PLACE[j]) * _PLACE[j], np.uint64(0))
    h = C.mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))


def node_ids(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; the empty set's is zero."""
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = C.mix(np.add.reduceat(C.mix(h ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(size) - size)[some]) + size[some].astype(np.uint64))
    return out


def text_nodes(texts: list[bytes], k: int = 5) -> np.ndarray:
    out = [node_ids(*shingle_sets(texts[lo:hi], k)) for lo, hi in C.slices([len(t) for t in texts], 1 << 20)]
    return np.concatenate([np.zeros(0, np.uint64), *out])


def sketches(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``SIMS`` SimHash fingerprints of each set that is not empty."""
    some = size > 0
    start, n = (np.cumsum(size) - size)[some], size[some]
    if not len(n):
        return np.zeros((0, SIMS), np.uint64)
    return np.stack([N.majority(C.mix(h ^ salt), start, n) for salt in _SALT], axis=1)


def sim_keys(sims: np.ndarray, golay: N.Golay) -> np.ndarray:
    """The keys of each row of fingerprints, ``KEYS`` of all ``SIMS``, each with its number in front."""
    out = np.empty((len(sims), sims.shape[1] * len(N.SEGMENTS) * PIECES), np.uint32)
    at = 0
    for sim in sims.T:
        parts = [((sim >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in N.SEGMENTS]
        for i, part in enumerate(parts):
            index, after = golay.index(part), parts[(i + 1) % len(parts)]
            for j in range(PIECES):
                out[:, at] = at << (12 + PIECE) | index << PIECE | after >> (j * PIECE) & ((1 << PIECE) - 1)
                at += 1
    return out


def nodes(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(doc_id, fp bigint, sim bigint, sims binary) of every row; fp is the node, by ``near_dedup``'s name, and sim
    the first fingerprint; the empty set has none."""

    def make():
        def step(batch: pa.RecordBatch):
            ids, texts = batch.column(0), C.byte_values(batch.column(1))
            for lo, hi in C.slices([len(t) for t in texts], 1 << 20):
                h, size = shingle_sets(texts[lo:hi], k)
                sims = iter(sketches(h, size).astype("<u8"))
                rows = [next(sims) if n else None for n in size.tolist()]
                first = pa.array([None if x is None else int(x[:1].view("<i8")[0]) for x in rows], pa.int64())
                yield {"doc_id": ids.slice(lo, hi - lo), "fp": node_ids(h, size).view(np.int64), "sim": first, "sims": [None if x is None else x.tobytes() for x in rows]}

        return step

    return C.map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")), make, "doc_id long, fp long, sim long, sims binary")


# -- candidates ------------------------------------------------------------------


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= NEAR


def forest(sims: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among these rows of two fingerprints, as row numbers. Rows that are
    connected are not compared again; memory is linear."""
    label = np.arange(len(sims))
    a, b = [], []
    for i in range(len(sims)):
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        others = others[others > i]
        at = others[near(sims[others], sims[i])]
        if len(at):
            labels, first = np.unique(label[at], return_index=True)
            a += [i] * len(first)
            b += at[first].tolist()
            label[np.isin(label, labels)] = label[i]
    return a, b


def near_rows(keys: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links, as row numbers, that connect all rows which share a key and are near."""
    order = np.lexsort((sims[:, 1], sims[:, 0], keys))
    keys, sims = keys[order], sims[order]
    change = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([change, [len(keys)]]))
    small = np.flatnonzero(np.repeat(size, size) <= SMALL)
    k, f = keys[small], sims[small]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, SMALL):
        at = np.flatnonzero(k[d:] == k[:-d])
        if not len(at):
            break
        at = at[near(f[at], f[at + d])]
        a.append(small[at])
        b.append(small[at + d])
    for at, n in zip(change[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        x, y = forest(sims[at : at + n])
        a.append(at + np.array(x, np.int64))
        b.append(at + np.array(y, np.int64))
    return order[np.concatenate(a)], order[np.concatenate(b)]


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that these links connect it to."""
    label, last = np.arange(n), None
    while last is None or (label != last).any():
        last = label.copy()
        least = np.minimum(label[a], label[b])
        for x in (a, b, last[a], last[b]):
            np.minimum.at(label, x, least)
        label = label[label]
    return label


def bucket_links(keys: np.ndarray, sims: np.ndarray, golay: N.Golay | None = None) -> np.ndarray:
    """Pairs of first fingerprints; those of all buckets connect all rows which share a key and are near.

    Near rows that share a key are connected by that key's bucket and need no link of a key with a higher
    number. The two fingerprints at hand give the keys of the lowest numbers, so rows that these connect here
    count as one when a higher number links them. A link is left out only for what lower numbers
    connect, and of the first number none is left out."""
    a, b = near_rows(keys, sims)
    number = keys[a] >> np.uint32(12 + PIECE)
    rows = np.unique(np.concatenate([a, b]))
    ends, end = np.unique(sims[rows], axis=0, return_inverse=True)
    a, b = (end.ravel()[np.searchsorted(rows, x)] for x in (a, b))
    label, own = np.arange(len(ends)), sim_keys(ends, golay or N.Golay())
    pairs = []
    for i in range(own.shape[1] + 1):
        at = number == i if i < own.shape[1] else number >= i
        root = connected(len(ends), label[a[at]], label[b[at]])
        new = np.flatnonzero(root != np.arange(len(ends)))
        pairs.append(np.stack([ends[new, 0], ends[root[new], 0]], axis=1))
        label = root[label]
        if i < own.shape[1]:
            label = connected(len(ends), *(label[x] for x in near_rows(own[:, i], ends)))[label]
    pairs = np.sort(np.concatenate(pairs), axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def stars(pairs: np.ndarray) -> np.ndarray:
    """Each row that these pairs connect with the least one that it is connected to."""
    ends, pairs = np.unique(pairs, return_inverse=True)
    label = connected(len(ends), *pairs.reshape(-1, 2).T)
    other = label != np.arange(len(ends))
    return np.stack([ends[other], ends[label[other]]], axis=1)


def sim_links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b): first fingerprints, linked so that all near nodes which share a key are connected."""
    buckets = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * KEYS // 500_000))

    def make():
        golay = N.Golay()

        def step(batch: pa.RecordBatch):
            sims = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").reshape(-1, SIMS)
            keys, sims = sim_keys(sims, golay).ravel(), np.repeat(sims[:, :2], KEYS, axis=0)
            bucket = ((C.mix(keys.astype(np.uint64)) >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, sims, bucket = keys[order], sims[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
            spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True)) if len(cut) else []
            return {"bucket": bucket[cut], "keys": [keys[a:b].astype("<u4").tobytes() for a, b in spans], "sims": [sims[a:b].astype("<u8").tobytes() for a, b in spans]}

        return step

    blobs = C.map_batches(distinct.where("sim is not null").select("sims"), make, "bucket long, keys binary, sims binary", rows=5_000)

    def by_bucket(batches):
        golay = N.Golay()

        def flush(have):
            if have:
                keys, sims = np.concatenate([np.frombuffer(x[0], "<u4") for x in have]), np.concatenate([np.frombuffer(x[1], "<u8") for x in have]).reshape(-1, 2)
                pairs = stars(bucket_links(keys, sims, golay)).view(np.int64)
                yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

        now, have = None, []
        for batch in batches:
            for bucket, k, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from flush(have)
                    now, have = bucket, []
                have.append((k, f))
        yield from flush(have)

    return blobs.repartition(min(buckets, C.MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(by_bucket, "a long, b long")


def candidates(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b): links that connect all nodes which are near and share a key, and those of one first fingerprint."""
    first = distinct.where("sim is not null").select("fp", "sim")
    least = first.groupBy("sim").agg(F.min("fp").alias("least"))
    met = sim_links(distinct, n).distinct().join(least.select(F.col("sim").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("sim").alias("b"), F.col("least").alias("y")), "b")
    same = first.join(least, "sim").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return met.select(F.col("x").alias("a"), F.col("y").alias("b")).union(same)


# -- verification ----------------------------------------------------------------


def similar(left: list, right: list | None, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among ``left``; with ``right``, of those with an end in each.
    Both are lists of (node, sorted distinct hashes). Sets that are connected are not compared again."""
    both = left if right is None else left + right
    size = np.array([len(s) for _, s in both])
    words, code = np.unique(np.concatenate([s for _, s in both]), return_inverse=True)
    start = np.cumsum(size) - size
    mine = np.zeros(len(words), bool)
    label = np.arange(len(both))
    a, b = [], []
    for i in range(len(left)):
        others = np.arange(i + 1 if right is None else len(left), len(both))
        small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        others = others[small >= least * large]
        own = code[start[i] : start[i] + size[i]]
        mine[own] = True
        step = 8
        while len(others := others[label[others] != label[i]]):
            now, others, step = others[:step], others[step:], step * 2
            n = size[now]
            at = np.arange(n.sum()) + np.repeat(start[now] - (np.cumsum(n) - n), n)
            shared = np.add.reduceat(mine[code[at]], np.cumsum(n) - n, dtype=np.int64)
            for j in now[shared >= least * (n + size[i] - shared)].tolist():
                if label[j] != label[i]:
                    a.append(both[i][0])
                    b.append(both[j][0])
                    label[label == label[j]] = label[i]
        mine[own] = False
    return a, b


def verified(docs: DataFrame, distinct: DataFrame, groups: DataFrame, doc_id: str, text: str, k: int, least: float) -> DataFrame:
    """(a, b): links of similarity ``least`` and more among the nodes of each group (node, root)."""
    wanted = distinct.join(groups, F.col("fp") == F.col("node"), "left_semi").select(F.col("rep").alias("wanted")).distinct()
    rows = docs.select(F.col(doc_id).cast("long").alias("own_id"), F.col(text).cast("binary").alias("t"))
    rows = rows.join(wanted, rows.own_id.eqNullSafe(wanted.wanted), "left_semi").select("t")

    def make_sets():
        def step(batch: pa.RecordBatch):
            texts = C.byte_values(batch.column(0))
            for lo, hi in C.slices([len(t) for t in texts], 1 << 20):
                h, size = shingle_sets(texts[lo:hi], k)
                end = np.cumsum(size).tolist()
                yield {"node": node_ids(h, size).view(np.int64), "set": [h[e - n : e].astype("<u8").tobytes() for e, n in zip(end, size.tolist(), strict=True)]}

        return step

    sets = C.map_batches(rows, make_sets, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))
    sets = C.written(sets.join(groups, "node"), "sets", in_few=True)
    sizes = sets.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("set")) / BLOCK_BYTES)).cast("long").alias("n"))
    dealt = sets.join(sizes, "root").select("root", "node", "set", F.pmod(F.xxhash64("node"), "n").alias("i"))
    blocks = C.written(dealt.groupBy("root", "i").agg(F.collect_list(F.struct("node", "set")).alias("f")), "blocks", in_few=True)
    right = blocks.select("root", F.col("i").alias("j"), F.col("f").alias("g"))
    alone = blocks.select("f", F.lit(None).cast(blocks.schema["f"].dataType).alias("g"))
    pairs = alone.union(blocks.join(right, "root").where("i < j").select("f", "g"))

    def make_links():
        def step(batch: pa.RecordBatch):
            for f, g in zip(batch.column(0), batch.column(1), strict=True):
                f, g = ([(x["node"], np.frombuffer(x["set"], "<u8")) for x in v.as_py()] if v.is_valid else None for v in (f, g))
                a, b = similar(f, g, least)
                yield {"a": np.array(a, np.int64), "b": np.array(b, np.int64)}

        return step

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return C.map_batches(pairs.repartition(n), make_links, "a long, b long", rows=64)


def labelled(docs: DataFrame, doc_id: str, text: str, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every node."""
    marked = C.written(nodes(docs, doc_id, text, k), "nodes", in_few=True)
    distinct = C.written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("sim").alias("sim"), F.first("sims").alias("sims")), "distinct", in_few=True)
    groups = N.components(candidates(distinct, distinct.count()))
    roots = N.components(verified(docs, distinct, groups, doc_id, text, k, least))
    return marked.select("doc_id", "fp"), N.lowest(distinct.select("fp", "rep"), roots)


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each component of near copies, as ``near_dedup.representatives``."""
    return N.choose(docs, *labelled(docs, doc_id, text, k, least), doc_id, text, lambda texts: text_nodes(texts, k))
