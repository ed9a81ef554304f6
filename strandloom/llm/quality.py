"""Quality scores from a factorisation machine.

A text's features are hashed words with damped counts (unit length a text), statistics of its
structure in bins, and, where asked for, categorical metadata columns. The machine adds to a
linear score the pairwise interactions of all features through factors of low rank, in linear
time: half of (sum of v x)^2 minus the sum of (v x)^2, for each factor. It is trained by Adam on
logistic loss over at most ``max_rows`` labelled rows that are not held out and ``max_bytes`` of their
text, chosen by a hash of the id, half of each label at most where there are enough (of a text longer than a 64th of the bytes
the beginning); the constant is
then set so that scores are probabilities under the labels' true shares. An id that ``labels`` has
with both labels counts as 1; one that ``documents`` has several times trains with each text.

Scores read whole texts. Null texts count as empty and get the score of an empty one; a model
without labelled rows gives every text 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORD_BITS = 15
#: Slots: hashed words, then binned statistics, then hashed metadata.
BINS = 16
STATS = ("length", "upper", "digit", "punctuation", "symbol", "space", "newline", "word_length", "long_words", "repeated_words", "repeated_lines", "non_ascii", "bars", "urls")
STAT_BASE = 1 << WORD_BITS
META_BASE = STAT_BASE + len(STATS) * BINS
META_BITS = 8
SLOTS = META_BASE + (1 << META_BITS)

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 punctuation, 5 symbol, 6 space, 7 newline, 8 non-ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 8 if _b >= 128 else 7 if _b == 10 else 6 if _b in b" \t\r\x0b\x0c" else 3 if _c.isdigit() else 2 if _c.isupper() else 1 if _c.islower() else 4 if _c in ".,;:!?'\"()-" else 5 if _b > 32 else 0


def _shares(text_of: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text_of * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)


def features(texts: list[bytes], meta: list[tuple] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of all texts, sorted by row."""
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    count = _shares(np.repeat(np.arange(n), size), _KIND[raw], n)
    words = C.Words([t.lower() for t in texts])
    h = (C.SpanHash(words.buf, seed=5).of(words.start, words.end) if len(words.start) else np.zeros(0, np.uint64)) >> np.uint64(64 - WORD_BITS)
    key, times = np.unique(words.doc << WORD_BITS | h.astype(np.int64), return_counts=True)
    row, slot = key >> WORD_BITS, key & (STAT_BASE - 1)
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, value**2, n))
    value = value / norm[row]
    distinct = np.bincount(row, minlength=n)
    wl = words.end - words.start
    n_words, n_bytes = np.maximum(words.count, 1), np.maximum(size, 1)
    lines = [t.split(b"\n") for t in texts]
    repeated_lines = np.array([1 - len(set(x)) / len(x) for x in lines])
    bars = np.array([t.count(b"|") for t in texts]) / n_words
    urls = np.array([t.count(b"://") for t in texts]) / n_words
    of_letters = np.maximum(count[:, 1] + count[:, 2], 1)
    stats = np.stack([
        np.log2(1 + words.count) / 16, count[:, 2] / of_letters, count[:, 3] / n_bytes * 5, count[:, 4] / n_bytes * 4, count[:, 5] / n_bytes * 8, count[:, 6] / n_bytes * 3,
        count[:, 7] / n_words * 4, np.bincount(words.doc, wl, n) / n_words / 16, np.bincount(words.doc, wl > 14, n) / n_words * 2,
        1 - distinct / n_words, repeated_lines, count[:, 8] / n_bytes * 4, bars, urls * 4,
    ], axis=1)
    bin_ = np.where(stats <= 0, 0, 1 + np.minimum(BINS - 2, (np.sqrt(np.clip(stats, 0, 1)) * (BINS - 1)).astype(np.int64)))
    parts = [(row, slot, value), (np.repeat(np.arange(n), len(STATS)), (STAT_BASE + np.arange(len(STATS)) * BINS + bin_).ravel(), np.full(n * len(STATS), 0.5))]
    if meta:
        k = [(i, META_BASE + int(C.mix(np.array([hash_of(j, v)], np.uint64))[0] >> np.uint64(64 - META_BITS))) for i, m in enumerate(meta) for j, v in enumerate(m)]
        parts.append((np.array([x[0] for x in k], np.int64), np.array([x[1] for x in k], np.int64), np.full(len(k), 0.5)))
    row, slot, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], slot[order], value[order]


def hash_of(column: int, value) -> int:
    import zlib

    return zlib.crc32(f"{column}:{value}".encode())


class Machine:
    """constant + linear + pairwise factors, through a sigmoid."""

    def __init__(self, constant: float, linear: np.ndarray, factors: np.ndarray, uses_meta: bool = False):
        self.constant, self.linear, self.factors, self.uses_meta = constant, linear, factors, uses_meta

    def raw(self, row, slot, value, n: int) -> np.ndarray:
        vx = self.factors[slot] * value[:, None]
        cut = np.searchsorted(row, np.arange(n))
        total = np.add.reduceat(vx, cut, axis=0)
        squares = np.add.reduceat((vx**2).sum(axis=1), cut)
        return self.constant + np.add.reduceat(self.linear[slot] * value, cut) + 0.5 * ((total**2).sum(axis=1) - squares)

    def scores(self, texts: list[bytes], meta: list[tuple] | None = None) -> np.ndarray:
        out = []
        for lo, hi in C.slices([len(t) + 200 for t in texts], 1 << 20):
            row, slot, value = features(texts[lo:hi], meta[lo:hi] if meta else None)
            out.append(1 / (1 + np.exp(-np.clip(self.raw(row, slot, value, hi - lo), -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[bytes], labels: np.ndarray, share: float | None = None, meta: list[tuple] | None = None, rank: int = 8, epochs: int = 12, rate: float = 0.03, decay: float = 1e-5, batch: int = 64, seed: int = 1) -> Machine:
    """``share``: how many of all rows have label 1, where the sample does not tell."""
    n = len(texts)
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(SLOTS), rng.normal(0, 0.02, (SLOTS, rank)), meta is not None)
    if not n:
        return model
    parts = []
    for lo, hi in C.slices([len(t) + 200 for t in texts], 1 << 20):
        r, s, v = features(texts[lo:hi], meta[lo:hi] if meta else None)
        parts.append((r + lo, s, v))
    row, slot, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.searchsorted(row, np.arange(n + 1))
    y = labels.astype(float)
    ones = y.sum()
    weight = np.where(y == 1, n / 2 / max(ones, 1), n / 2 / max(n - ones, 1))
    moments = [np.zeros(SLOTS), np.zeros(SLOTS), np.zeros((SLOTS, rank)), np.zeros((SLOTS, rank))]
    c1 = c2 = 0.0
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            take = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            size = first[rows + 1] - first[rows]
            b = np.repeat(np.arange(len(rows)), size)
            s, x = slot[take], value[take]
            vx = model.factors[s] * x[:, None]
            cut = np.cumsum(size) - size
            total = np.add.reduceat(vx, cut, axis=0)
            z = model.constant + np.add.reduceat(model.linear[s] * x, cut) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), cut))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            own, at_own = np.unique(s, return_inverse=True)
            grad_w = np.bincount(at_own, g[b] * x, len(own)) + decay * model.linear[own]
            each = g[b, None] * x[:, None] * (total[b] - vx)
            grad_v = np.stack([np.bincount(at_own, each[:, f], len(own)) for f in range(rank)], axis=1) + decay * model.factors[own]
            step += 1
            lr = rate * np.sqrt(1 - 0.999 ** min(step, 5000)) / (1 - 0.9 ** min(step, 500))
            for grad, m, v2, target in ((grad_w, moments[0], moments[1], model.linear), (grad_v, moments[2], moments[3], model.factors)):
                m[own] = 0.9 * m[own] + 0.1 * grad
                v2[own] = 0.999 * v2[own] + 0.001 * grad**2
                target[own] -= lr * m[own] / (np.sqrt(v2[own]) + 1e-8)
            c1, c2 = 0.9 * c1 + 0.1 * g.sum(), 0.999 * c2 + 0.001 * g.sum() ** 2
            model.constant -= lr * c1 / (np.sqrt(c2) + 1e-8)
    if share is None:
        share = ones / n
    if 0 < share < 1:  # the loss weighed both labels alike
        model.constant += np.log(share / (1 - share))
    return model


def train(docs: DataFrame, labels: DataFrame, meta: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 6000, max_bytes: int = 64 << 20) -> Machine:
    """A machine of the labelled rows that are not held out; ``meta`` names columns of ``docs``
    to use, never those the labels come from."""
    known = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y")).where(~C.held_out("k"))
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not share:
        return fit([], np.zeros(0), meta=[] if meta else None)
    each = max_rows / len(share)
    u = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("quality sample")), F.lit(1 << 30)) / (1 << 30)
    limit = F.when(F.col("y") == 1, F.lit(min(1.0, each / share.get(1, 1)))).otherwise(F.lit(min(1.0, each / share.get(0, 1))))
    sample = known.withColumn("u", u).where(F.col("u") < limit).orderBy("u", "k").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("k"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"), F.array(*[F.col(c).cast("string") for c in meta]).alias("m"))
    drawn = rows.join(F.broadcast(sample), "k").select("k", "u", "y", "t", "m")  # the sample has max_rows ids
    got = C.within_bytes(drawn, ["k", "m"], ["u", "k"], "t", "y", len(share), max_rows, max_bytes)
    return fit([bytes(r["t"]) for r in got], np.array([r["y"] for r in got]), share.get(1, 0) / sum(share.values()), [tuple(r["m"]) for r in got] if meta else None)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, meta: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SLOTS x (rank + 1) floats

    def make():
        m = shared.value

        def step(batch: pa.RecordBatch):
            got = m.scores(C.byte_values(batch.column(1)), [tuple(x) for x in batch.column(2).to_pylist()] if m.uses_meta else None)
            return {"doc_id": batch.column(0), "score": got, "predicted": (got >= threshold).astype(np.int32)}

        return step

    return C.map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"), F.array(*[F.col(c).cast("string") for c in meta]).cast("array<string>").alias("m")), make, "doc_id long, score double, predicted int")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    machine = train(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", C.held_out().alias("held_out"), "score", "predicted")
