"""Packing of tokenised documents into sequences by minimum bin slack.

Documents become token ids and an end id; only those longer than a sequence are cut.
What matters for packing is the number of pieces of each length, a table of at most
``size`` rows whatever the corpus. On it, each step takes the longest length left and finds,
by subset sums over the available lengths in one bitset, the fullest feasible combination for
the room beside it; the combination is removed as many times as its lengths last. So the plan
has at most one step for each length that runs out, and grows with ``size``, not with the corpus.

Pieces meet the plan by their rank among the pieces of their length. Ranks come from
counts by (share of ids, length) and a row number within each share, so a length that a third
of all pieces has is ranked in many tasks.

Where a tokenizer's steps are those of ``APART``, a word's ids do not depend on other words, so each
distinct word of a worker is tokenised once (a bounded cache) and a document's ids are the joined ids of its
words; any other tokenizer gets whole texts. Null and empty texts are one end id, and bytes that are no UTF-8
count as U+FFFD. Rows with equal or null ids are packed each for itself.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SIZE, END = 4096, 1
#: Lower-case words that split alike in every step of the tokenizer's pipeline.
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

#: The steps of a tokenizer file that keep words apart (fixed values).
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def keeps_apart(path: str) -> bool:
    """Whether a tokenizer's words can be tokenised each for itself: its steps are known to keep them apart, and no
    token is added that could hold a blank or plain letters."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    added = [t["content"] for t in told.get("added_tokens") or ()]
    return told["model"].get("type") == "BPE" and not told["model"].get("dropout") and all(told.get(k) == v for k, v in APART.items()) and all(t.startswith("<|") and not re.search(r"\s", t) for t in added)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 for itself, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordIds(dict):
    """Little-endian 32-bit ids of a word given as bytes; kept for at most ``most`` words and twice as
    many of the pieces that words split into, which cost more to make and recur more."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.apart = keeps_apart(path)
        self.model, self.letters, self.parts, self.most = self.whole.model, _byte_letters(), {}, most

    def part(self, p: str) -> bytes:
        got = self.parts.get(p)
        if got is None:
            mapped = p if p.isascii() else "".join([self.letters[b] for b in p.encode()])
            got = self.parts[p] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return got

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if len(self.parts) >= 2 * self.most:
            self.parts.clear()
        text = word.decode(errors="replace")
        if PLAIN.fullmatch(text) and "<|" not in text and len(text) <= 64:
            ids = b"".join(map(self.part, PIECES.findall(text.lower())))
        else:
            ids = self.encoded(text)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encoded(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: bytes) -> bytes:
        if not self.apart:
            return self.encoded(text.decode(errors="replace"))
        return b"".join(map(self.__getitem__, text.split()))


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of whole documents."""
    path = tokenizer or default_tokenizer()
    tail = np.array([end], "<u4").tobytes()

    def make():
        kept = C.worker_cache("packing")  # the next task of this worker may need the same words
        if path not in kept:
            kept.clear()
            kept[path] = WordIds(path)
        words = kept[path]

        def step(batch: pa.RecordBatch):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), C.byte_values(batch.column(1)), strict=True):
                ids = words.of(t) + tail
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, size)):
                    rows.append((i, k, at, min(size, n - at), zlib.crc32(ids[4 * at : 4 * (at + size)])))
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*rows, strict=True)), strict=True)) if rows else None

        return step

    return C.map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")), make, "doc_id long, piece int, start long, length long, ids_crc32 long", rows=256, owner="packing")


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths, at most as often as ``counts`` has them, with the largest sum within ``room``."""
    mask, reach = (1 << room + 1) - 1, 1
    before = []  # reachable sums before each group of ``take`` pieces of a length
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            grown = reach | reach << length * take & mask
            if grown != reach:
                before.append((reach, length, take))
                reach = grown
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for was, length, take in reversed(before):
        if not was >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(times, lengths) of every combination, by minimum bin slack."""
    counts = {k: v for k, v in counts.items() if v}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        rest = {k: v for k, v in counts.items() if v and k <= size - longest}
        bin_ = [longest, *fullest(size - longest, rest)]
        counts[longest] += 1
        need: dict[int, int] = {}
        for x in bin_:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
        out.append((times, bin_))
    return out


def slots(steps: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length the runs of its ranks: columns first rank, first sequence, pieces
    of it a sequence, offset of its first there."""
    runs: dict[int, list] = {}
    ranked: dict[int, int] = {}
    sequence = 0
    for times, bin_ in steps:
        at = 0
        bin_ = sorted(bin_, reverse=True)
        for length in dict.fromkeys(bin_):
            n = bin_.count(length)
            runs.setdefault(length, []).append((ranked.get(length, 0), sequence, n, at))
            ranked[length] = ranked.get(length, 0) + n * times
            at += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, doc_id: str = "doc_id", text: str = "text", shares: int | None = None) -> DataFrame:
    """A row for each piece with its sequence and its place there."""
    spark = docs.sparkSession
    shares = shares or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(shares)).cast("int")
    cut = C.written(pieces(docs, tokenizer, size, end, doc_id, text).withColumn("share", share), "pieces")
    counts = C.written(cut.groupBy("length", "share").count(), "counts")
    runs = slots(plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, size))
    held = spark.sparkContext.broadcast(runs)
    # ranks within (length, share), then the counts of the shares before
    base = counts.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(base.select("length", "share", F.coalesce("base", F.lit(0)).alias("base")), ["length", "share"]).withColumn("rank", F.col("rank") + F.col("base"))

    def make():
        def step(batch: pa.RecordBatch):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts):
                if len(at):
                    n = int(length[at[0]])
                    run = held.value[n]
                    k = np.searchsorted(run[:, 0], rank[at], "right") - 1
                    within = rank[at] - run[k, 0]
                    sequence[at] = run[k, 1] + within // run[k, 2]
                    offset[at] = run[k, 3] + within % run[k, 2] * n
            return {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

        return step

    return C.map_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")), make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", rows=10_000)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
