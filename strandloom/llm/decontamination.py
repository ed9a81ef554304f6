"""Benchmark decontamination: BM25 retrieval with block-max WAND, then verification.

Benchmark items are the indexed side. An item of more than ``part`` words is indexed in
parts of that many. Each posting holds the item's BM25 weight for the term over the sum of the
item's weights, so a passage that holds all of an item's terms scores 1, whatever the item's
length. Every document is cut into passages of twice the longest part's words that overlap by
half, so that each part that occurs lies whole in one (fewer words than a shingle's, left at an item's end, are with the part before). Every passage is a query: the sums of
its terms' maxima over each block of items bound its scores; where some block's bound
reaches ``threshold``, a block-max WAND traversal retrieves all items that reach it.

An item of which a part is retrieved counts as contained if at least ``overlap`` of the 5-word shingles of its whole
question, and of its whole answer, occur in the passage and as many words around it as the item has around that part. An item's answer is its last sentence, or the
last third of its words where that leaves too little. Words are runs of letters, digits and
non-ASCII characters, in lower case.

The index is broadcast in shards of about ``shard_bytes`` of item text, counted first, and every
passage meets every shard. Document frequencies, the number of parts, their mean and greatest length
are Spark aggregates over all parts of the benchmark, so that scores and passages do not depend on how
many shards there are. Null and empty texts contain nothing and are found nowhere; equal items are
found each for itself; items with a null id are found under null. An item of fewer than five words is
compared by shingles of its own length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
#: Everything but digits, lower-case letters and non-ASCII bytes is a blank.
BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SENTENCE = re.compile(r"[.?!:\n]+")
END = 1 << 60
#: Sums of equal terms in another order may differ by so much: of doubles, and of the float32 bounds.
SLACK, BOUND_SLACK = 1e-9, 1e-4


def plain(text: bytes) -> bytes:
    return text.decode().lower().encode().translate(BLANK)


def words_of(text: bytes) -> tuple[list[bytes], int]:
    """An item's words, and how many of these are its question's."""
    words = plain(text).split()
    raw = text.decode()
    spans = [m.end() for m in SENTENCE.finditer(raw)] if words else []
    return words, max((n for n in (len(plain(raw[:e].encode()).split()) for e in spans) if SHINGLE <= n <= len(words) - SHINGLE), default=-(-2 * len(words) // 3))


def spans_of(n: int, part: int) -> list[tuple[int, int]]:
    """The parts of ``n`` words; fewer than a shingle's at the end go with the part before them."""
    cuts = [*range(0, n, part), n]
    if len(cuts) > 2 and n - cuts[-2] < SHINGLE:
        del cuts[-2]
    return list(zip(cuts, cuts[1:]))


def sides_of(words: list[bytes], cut: int) -> tuple[set[bytes], set[bytes]]:
    """The shingles of a whole item's question and of its answer: those that end after the question."""
    grams = [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    q = max(1, min(cut - SHINGLE + 1, len(grams)))
    return set(grams[:q]), set(grams[q:]) or set(grams)


def entries_of(item: int | None, text: bytes, part: int) -> list[tuple]:
    """(item, words, place of the first in the item, key of the whole item, its words, words of the question) of each part."""
    words, cut = words_of(text)
    return [(item, words[a:b], a, (item, text), words, cut) for a, b in spans_of(len(words), part)]


class Counts:
    """What scores need of the whole benchmark: the number of parts, their mean and greatest length, and
    how many parts have each word."""

    def __init__(self, n: int, mean: float, longest: int, df: dict[bytes, int]):
        self.n, self.mean, self.longest, self.df = n, mean, longest, df

    @classmethod
    def of(cls, entries: list[tuple]) -> Counts:
        df: dict[bytes, int] = {}
        for _, words, *_ in entries:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
        sizes = [len(e[1]) for e in entries]
        return cls(len(entries), sum(sizes) / len(sizes) if sizes else 1.0, max(sizes, default=0), df)


def weights(words: list[bytes], counts: Counts, k1: float = 1.2, b: float = 0.75) -> dict[bytes, float]:
    """A part's BM25 weight for each of its words, over their sum."""
    tf: dict[bytes, int] = {}
    for w in words:
        tf[w] = tf.get(w, 0) + 1
    got = {w: math.log(1 + (counts.n - counts.df[w] + 0.5) / (counts.df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(words) / counts.mean)) for w, f in tf.items()}
    total = sum(got.values())
    return {w: x / total for w, x in got.items()}


class Index:
    """Impacts of the terms of item parts (``entries_of``), with maxima by term and by block, and the shingles of
    whole items. ``counts`` are the whole benchmark's; without them the parts given are all."""

    def __init__(self, entries: list[tuple], counts: Counts | None = None, blocks: int = 64):
        # neighbours share words, so that block maxima are tight
        entries = sorted(entries, key=lambda e: (min(e[1], key=lambda w: (-len(w), w)), e[0] is not None, e[0] or 0))
        counts = counts or Counts.of(entries)
        self.items = [e[0] for e in entries]
        self.longest = counts.longest
        vocab = sorted({w for _, words, *_ in entries for w in words})
        n = len(entries)
        number = {w: i for i, w in enumerate(vocab)}
        self.per_block = max(1, -(-n // blocks))
        self.n_blocks = -(-n // self.per_block) if n else 0
        self.bound = np.zeros((len(vocab), self.n_blocks), np.float32)
        self.ids: list[list[int]] = [[] for _ in vocab]
        self.impact: list[list[float]] = [[] for _ in vocab]
        for e, (_, words, *_) in enumerate(entries):
            for w, x in weights(words, counts).items():
                t = number[w]
                self.ids[t].append(e)
                self.impact[t].append(x)
                self.bound[t, e // self.per_block] = max(self.bound[t, e // self.per_block], np.nextafter(np.float32(x), np.float32(2)))
        self.most = self.bound.max(axis=1) if n else np.zeros(len(vocab), np.float32)
        for ids in self.ids:
            ids.append(END)
        self.hashes, self.terms = self._hash_words(vocab)
        #: Words by themselves, should two of them share a hash.
        self.number = number if len(np.unique(self.hashes)) < len(self.hashes) else None
        #: A whole item's question and answer, words in its shingles (an item of fewer than SHINGLE is one of its own length), its words.
        whole = {key: (*sides_of(words, cut), min(len(words), SHINGLE), len(words)) for _, _, _, key, words, cut in entries}
        #: Of each part: its whole item, and how many of the item's words lie before and behind it.
        self.whole = [(whole[key], at, len(item) - at - len(words)) for _, words, at, key, item, _ in entries]

    @staticmethod
    def _hash_words(vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not vocab:
            return np.zeros(1, np.uint64), np.zeros(1, np.int64)
        words = C.Words([b" ".join(vocab)])
        h = C.SpanHash(words.buf, seed=8).of(words.start, words.end)
        order = np.argsort(h)
        return h[order], order

    def wand(self, terms: list[int], theta: float) -> list[tuple[int, float]]:
        """All entries whose score for a query of these terms is ``theta`` or more, but for the last bits of a sum."""
        theta -= SLACK
        lists = [[0, self.ids[t], self.impact[t], float(self.most[t]), self.bound[t], 0] for t in terms]
        for x in lists:
            x[0] = x[1][0]
        out = []
        while True:
            lists.sort(key=lambda x: x[0])
            total, k = 0.0, 0
            for k, x in enumerate(lists):
                total += x[3]
                if total >= theta:
                    break
            else:
                return out
            pivot = lists[k][0]
            if pivot == END:
                return out
            while k + 1 < len(lists) and lists[k + 1][0] == pivot:
                k += 1
            block = pivot // self.per_block
            if sum(float(x[4][block]) for x in lists[: k + 1]) < theta:
                to = min((block + 1) * self.per_block, lists[k + 1][0] if k + 1 < len(lists) else END)
            elif lists[0][0] == pivot:
                score = sum(x[2][x[5]] for x in lists[: k + 1])
                if score >= theta:
                    out.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            for x in lists[: k + 1]:
                if x[0] < to:
                    x[5] = bisect_left(x[1], to, x[5])
                    x[0] = x[1][x[5]]

    def term_of(self, words: C.Words) -> np.ndarray:
        """Each word's term, or -1."""
        if self.number is not None:
            raw = words.buf.tobytes()
            return np.array([self.number.get(raw[a:b], -1) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)], np.int64)
        h = C.SpanHash(words.buf, seed=8).of(words.start, words.end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.terms[at], -1)

    def search(self, texts: list[bytes], threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """Best (score, question overlap, answer overlap) of each (text, item) contained."""
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not self.items:
            return found
        half = max(self.longest, 32)
        words = C.Words([plain(t) for t in texts])
        term = self.term_of(words)
        known = np.flatnonzero(term >= 0)
        if not len(known):
            return found
        # passage p of a text has its words p*half to (p+2)*half; passages are numbered through
        n_pass = np.maximum(-(-words.count // half) - 1, 1)
        base = np.cumsum(n_pass) - n_pass
        doc = words.doc[known]
        own = (known - words.first[doc]) // half
        second = np.minimum(own, n_pass[doc] - 1)
        pair = [base[doc] + second]
        terms = [term[known]]
        both = np.flatnonzero((own > 0) & (own - 1 != second))
        pair.append(base[doc[both]] + own[both] - 1)
        terms.append(term[known[both]])
        width = np.int64(len(self.most))
        key = np.unique(np.concatenate(pair) * width + np.concatenate(terms))
        passage, term = key // width, key % width
        cut = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        keep = np.add.reduceat(self.most[term], cut) >= threshold - BOUND_SLACK
        size = np.diff(np.concatenate([cut, [len(key)]]))
        left = np.repeat(keep, size)
        passage, term, size = passage[left], term[left], size[keep]
        if not len(term):
            return found
        cut = np.cumsum(size) - size
        for lo, hi in C.slices(size.tolist(), 1 << 15):
            a, b = cut[lo], cut[hi - 1] + size[hi - 1]
            sums = np.add.reduceat(self.bound[term[a:b]], cut[lo:hi] - a, axis=0)
            for i in (lo + np.flatnonzero(sums.max(axis=1) >= threshold - BOUND_SLACK)).tolist():
                p = passage[cut[i]]
                for entry, score in self.wand(term[cut[i] : cut[i] + size[i]].tolist(), threshold):
                    d = int(np.searchsorted(base, p, "right") - 1)
                    first = words.first[d] + (p - base[d]) * half
                    last = min(first + 2 * half, words.first[d] + words.count[d])
                    # the item around its part: as far as its other words reach
                    (question, answer, n, _), before, behind = self.whole[entry]
                    first, last = max(first - before, words.first[d]), min(last + behind, words.first[d] + words.count[d])
                    around = words.buf[words.start[first] : words.end[last - 1]].tobytes().split()
                    grams = {b" ".join(around[j : j + n]) for j in range(max(1, len(around) - n + 1))}
                    q, s = len(question & grams) / len(question), len(answer & grams) / len(answer)
                    if min(q, s) >= overlap:
                        pair = (d, self.items[entry])
                        found[pair] = max(found.get(pair, (0.0, 0.0, 0.0)), (score, q, s))
        return found


def _parts(benchmark: DataFrame, part: int, item_id: str, item_text: str) -> DataFrame:
    """(item, words joined by blanks, at, key, cut) of every part of every item; key is a digest of the item's text."""

    def make():
        import hashlib

        def step(batch: pa.RecordBatch):
            rows = [(i, b" ".join(words).decode(), at, hashlib.blake2b(t, digest_size=16).digest(), cut) for i, t in zip(batch.column(0).to_pylist(), C.byte_values(batch.column(1)), strict=True) for _, words, at, _, _, cut in entries_of(i, t, part)]
            kinds = (("item", pa.int64()), ("words", pa.string()), ("at", pa.int64()), ("key", pa.binary()), ("cut", pa.int64()))
            return {name: pa.array([r[j] for r in rows], kind) for j, (name, kind) in enumerate(kinds)}

        return step

    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t"))
    return C.map_batches(items, make, "item long, words string, at long, key binary, cut long")


def _indexes(benchmark: DataFrame, part: int, shard_bytes: int, item_id: str, item_text: str) -> list:
    """The broadcast index of each shard of the items' parts; an item's parts are in one shard."""
    parts = C.written(_parts(benchmark, part, item_id, item_text), "benchmark")
    size = F.size(F.split("words", " "))
    n, mean, longest, total = parts.agg(F.count("*"), F.avg(size), F.max(size), F.sum(F.octet_length("words"))).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    terms = lambda rows: rows.select(F.explode(F.array_distinct(F.split("words", " "))).alias("w"))
    df = terms(parts).groupBy("w").agg(F.count("*").alias("n"))
    df = df if shards == 1 else C.written(df, "frequencies")
    out = []
    for s in range(shards):
        own = parts.where(F.pmod(F.xxhash64("item", "key"), F.lit(shards)) == s)
        # both of about ``shard_bytes`` at most, or one item: a shard's parts and its words
        rows = [(r["item"], r["words"].encode().split(), r["at"], (r["item"], bytes(r["key"])), r["cut"]) for r in own.collect()]
        pieces: dict[tuple, dict[int, list[bytes]]] = {}
        for _, words, at, key, _ in rows:
            pieces.setdefault(key, {})[at] = words  # equal items have equal parts
        whole = {key: [w for at in sorted(p) for w in p[at]] for key, p in pieces.items()}
        entries = [(item, words, at, key, whole[key], cut) for item, words, at, key, cut in rows]
        counts = {r["w"].encode(): r["n"] for r in df.join(terms(own).distinct(), "w", "left_semi").collect()}
        out.append(benchmark.sparkSession.sparkContext.broadcast(Index(entries, Counts(n, mean or 1.0, longest or 0, counts))))
    return out


def _finder(index, threshold: float, overlap: float):
    """Columns with, for each text, its items and their scores and overlaps."""

    def make():
        def step(raw: list):
            texts = [t or b"" for t in raw]
            hits: list[list[dict]] = [[] for _ in texts]
            for lo, hi in C.slices([len(t) for t in texts], 1 << 20):
                for (d, item), x in index.value.search(texts[lo:hi], threshold, overlap).items():
                    hits[lo + d].append(dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), (item, *x), strict=True)))
            return {"hits": hits}

        return step

    return make


HITS = "hits array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double>>"


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part: int = 256, shard_bytes: int = 16 << 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every contained item."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in _indexes(benchmark, part, shard_bytes, item_id, item_text):
        told = C.judge_rows(rows, "text", _finder(index, threshold, overlap), HITS)
        got = told.select(F.col("row.doc_id").alias("doc_id"), F.explode("hits").alias("h")).select("doc_id", "h.*")
        out = got if out is None else out.union(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part: int = 256, shard_bytes: int = 16 << 20, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item. Narrow: no row moves."""
    for index in _indexes(benchmark, part, shard_bytes, item_id, item_text):
        docs = C.judge_rows(docs, text, _finder(index, threshold, overlap), HITS).where(F.size("hits") == 0).select("row.*")
    return docs


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
