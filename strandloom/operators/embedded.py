"""Texts within texts: short ones by lists that tasks hold, long ones by anchors that few places have.

A list of texts of one length is a sorted table of their letters, eight a word, which every place of a record is looked up in; its
hits stay in the task that has the record. A longer text is told by four hashes: of its first 2**c letters, c = floor(log2 n),
the window of more than half as many letters with the least hash (its anchor); its first and its last 2**c letters; and the whole. Wherever the text
occurs, the same window is the least one among those around it. Holders look the four up in one table of bits, the anchors first, about
4 / 2**c of all places, and send only stretches for which all four have their bits, with digests that tell what is equal.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Letters of records that are looked at together.
LETTERS = 1 << 20
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: A number for each letter; U counts as T, since A is the complement of both.
CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
CODES[ord("U")], CODES[ord("u")] = CODES[ord("T")], CODES[ord("t")]


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive texts of some ``LETTERS`` together, as (from, to)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > LETTERS:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


class Laid:
    """Texts one behind the other, with where the text of each place begins and ends."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.sizes = np.array([len(t) for t in raw], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts, self.n, self.raw = self.ends - self.sizes, int(self.sizes.sum()), b"".join(raw)
        self.owner = np.repeat(np.arange(len(raw)), self.sizes)


class Listed:
    """Texts of a list, by length."""

    def __init__(self, texts: list[str]):
        by = defaultdict(set)
        for t in texts:
            by[len(t.encode())].add(t.encode())
        self.tables = []
        for size, same in sorted(by.items()):
            width, same = -(-size // 8), sorted(same)
            words = np.frombuffer(b"".join(t + bytes(8 * width - size) for t in same), "<u8").reshape(-1, width)
            odd = _ODD
            while len(np.unique(keys := self._keys(words.T, odd))) < len(same):  # until no two share a key
                odd = odd * _MIX | np.uint64(1)
            order = np.argsort(keys)
            some = np.zeros(1 << 20, bool)
            some[(keys * _MIX >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((size, odd, keys[order], words[order], some))

    @staticmethod
    def _keys(words, odd: np.uint64) -> np.ndarray:
        out = words[0]
        for w in words[1:]:
            out = (out ^ out >> np.uint64(29)) * odd + w
        return out

    def hits(self, laid: Laid) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, places within one text each, which text of the list each is, these texts as bytes rows) by rising length."""
        if not laid.n:
            return
        longest = max((t[0] for t in self.tables), default=0)
        raw, left = laid.raw + bytes(longest + 8), laid.ends[laid.owner] - np.arange(laid.n)
        for size, odd, keys, words, some in self.tables:
            width = words.shape[1]
            views = [np.ndarray((laid.n,), "<u8", raw, 8 * j, (1,)) for j in range(width)]
            views[-1] = views[-1] & np.uint64((1 << 8 * (size - 8 * width + 8)) - 1)
            key = self._keys(views, odd)
            at = np.flatnonzero(some[(key * _MIX >> np.uint64(44)).astype(np.int64)] & (left >= size))
            place = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            same = np.logical_and.reduce([v[at] == words[place, j] for j, v in enumerate(views)])
            yield size, at[same], place[same], words


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return np.maximum(h ^ h >> np.uint64(29), np.uint64(1))


def hashes(laid: Laid, k: int, sums: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Of each window of k letters, never 0."""
    return mixed((sums[k:] - sums[:-k]) * inverse[: laid.n - k + 1])


def sums_of(laid: Laid) -> tuple[np.ndarray, np.ndarray]:
    powers = np.cumprod(np.full(laid.n, _ODD)) * _INVERSE
    inverse = np.cumprod(np.full(laid.n, _INVERSE)) * _ODD
    letters = CODES[np.frombuffer(laid.raw, np.uint8)]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers)]), inverse


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """The least or greatest of each w consecutive numbers; w is a power of two."""
    step = 1
    while step < w:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def shape(c: int) -> tuple[int, int]:
    """(letters of a window, windows in a row) of class c."""
    return (1 << c, 1) if c < 2 else ((1 << c - 1) + 1, 1 << c - 1)


def least_places(laid: Laid, c: int, sums, inverse) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of windows that are the least of some row of class c within a text."""
    k, w = shape(c)
    if laid.n < 1 << c:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes(laid, k, sums, inverse)
    least = sliding(h, w, np.minimum)
    row = np.arange(len(least))
    least[row + (1 << c) > laid.ends[laid.owner[: len(least)]]] = 0  # rows over an edge
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), w, np.maximum) == h)
    return at, h[at]


def packed(hashes: pa.Table) -> pa.Table:
    """(piece, bit) of one piece of a table of 2**16 bits a piece, as one row (piece, bits)."""
    bits = np.zeros(1 << 16, np.uint8)
    bits[hashes.column("bit").to_numpy()] = 1
    return pa.table({"piece": hashes.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


#: What is added to the hashes of anchors, beginnings, ends and whole texts, so that one table of bits serves them.
ANCHOR, HEAD, TAIL, WHOLE = (np.uint64(i * 0x1D8E4E27C47D124F & (1 << 64) - 1) for i in range(4))
#: Pairs of a beginning and an end that are looked at together.
PAIRS = 1 << 20


def stretches(laid: Laid, c: int, sums, inverse, marked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lengths) of what may be a text of class c: its anchor, beginning, end and whole have their bits in ``marked``."""
    mask, n, w = np.uint64(8 * len(marked) - 1), 1 << c, shape(c)[1]

    def known(h, what):
        bit = (h + what & mask).astype(np.int64)
        return marked[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1

    def some_of(places, before, after):
        """Of each place where n letters begin within a text: whether one of ``places`` is at -before to after - 1."""
        upto = np.zeros(laid.n + 1, np.int64)
        upto[places + 1] = 1
        upto, x = np.cumsum(upto), np.arange(laid.n - n + 1)
        return np.flatnonzero((upto[np.minimum(x + after, laid.n)] > upto[np.maximum(x - before, 0)]) & (x + n <= laid.ends[laid.owner[: len(x)]]))

    of = lambda x, size: mixed((sums[x + size] - sums[x]) * inverse[x])
    at, h = least_places(laid, c, sums, inverse)
    at = at[known(h, ANCHOR)]
    if not len(at):
        return
    heads = some_of(at, 0, w)
    heads = heads[known(of(heads, n), HEAD)]
    if not len(heads):
        return
    tails = some_of(heads, n - 1, 1)
    tails = tails[known(of(tails, n), TAIL)]
    low = np.searchsorted(tails, heads)
    count = np.searchsorted(tails, np.minimum(heads + n, laid.ends[laid.owner[heads]] - n + 1)) - low
    total = np.cumsum(count)
    x = 0
    while x < len(heads):
        done = int(total[x - 1]) if x else 0
        y = max(x + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        many = count[x:y]
        b = np.repeat(heads[x:y], many)
        size = tails[np.arange(len(b)) + np.repeat(low[x:y] - (total[x:y] - many - done), many)] + n - b
        same = known(of(b, size), WHOLE)
        yield b[same], size[same]
        x = y


def rows_of(at: list[int]) -> Iterator[tuple[int, int, int]]:
    """Rising numbers as rows of equal steps: (first, step, how many)."""
    first, step, n = at[0], 1, 1
    for x, y in zip(at, at[1:]):
        if n == 1:
            step, n = y - x, 2
        elif y - x == step:
            n += 1
        else:
            yield first, step, n
            first, step, n = y, 1, 1
    yield first, step, n


def places(classes: list[int], marked: np.ndarray):
    """A function of batches (key, s): (key, b, step, n, len, minus, digest), b from 1, of what may be a text of ``marked``, as it is (minus 0) and
    with T for U (1). Places of one content in a record are rows of equal steps, so that a run of one letter or one line is one."""
    as_dna = bytes.maketrans(b"Uu", b"Tt")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in groups(texts):
                laid = Laid(texts[x:y])
                longest = int(laid.sizes.max(initial=0))
                if not longest:
                    continue
                sums, inverse = sums_of(laid)
                for c in classes:
                    if longest < 1 << c:
                        continue
                    for b, size in stretches(laid, c, sums, inverse, marked):
                        same = defaultdict(list)
                        for i, k, o in zip(b.tolist(), size.tolist(), laid.owner[b].tolist()):
                            same[o, laid.raw[i : i + k]].append(i)
                        rows = []
                        for (o, t), at in same.items():
                            digests = hashlib.sha256(t).digest(), hashlib.sha256(t.translate(as_dna)).digest()
                            rows += [(o, first - int(laid.starts[o]) + 1, step, n, len(t), minus, digests[minus]) for first, step, n in rows_of(at) for minus in (0, 1)]
                        if rows:
                            own, *ints, digest = zip(*rows)
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(own) + x)), *(pa.array(v, pa.int32()) for v in ints), pa.array(digest, pa.binary())], names=["key", "b", "step", "n", "len", "minus", "digest"])

    return run


def told(batches):
    """Batches (.., s) with a text's class and four hashes beside them, in place of the text."""
    for batch in batches:
        rows = []
        for s in batch.column(batch.num_columns - 1).to_pylist():
            laid = Laid([s])
            c = laid.n.bit_length() - 1
            sums, inverse = sums_of(laid)
            (k, w), n = shape(c), 1 << c
            ends = np.array([0, laid.n - n, 0])
            three = mixed((sums[ends + [n, n, laid.n]] - sums[ends]) * inverse[ends])
            anchor = mixed((sums[k : k + w] - sums[:w]) * inverse[:w]).min(keepdims=True)
            rows.append((c, *(np.concatenate([anchor, three]) + np.array([ANCHOR, HEAD, TAIL, WHOLE]))))
        cls, *four = zip(*rows) if rows else ((),) * 5
        columns = [pa.array(cls, pa.int32()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in four)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "cls", "anchor", "head", "tail", "whole"])


def spans_of(texts: list[str], listed: Listed) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Laid]]:
    """(length, places in the laid texts on the + strand, places within each text, numbers of texts, the laid texts)."""
    from ..functions import iupac

    laid = Laid(texts)
    for minus, way in enumerate((laid, Laid([iupac.revcomp(t) for t in texts]))):
        for size, at, *_ in listed.hits(way):
            own = laid.owner[at]
            b = at - laid.starts[own]
            b = laid.sizes[own] - b - size if minus else b
            yield size, laid.starts[own] + b, b, own, laid


def all_spans(by_file: dict[int, list[str]]):
    """A function of batches (pos, s): (pos, of, b, e), 1-based, for every place of every listed text."""

    def run(batches):
        lists = {of: Listed(texts) for of, texts in by_file.items()}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in groups(texts):
                for of, listed in lists.items():
                    for size, _, b, own, _ in spans_of(texts[x:y], listed):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + x)), pa.array(np.full(len(b), of, np.int32)), pa.array((b + 1).astype(np.int32)), pa.array((b + size).astype(np.int32))], names=["pos", "of", "b", "e"])

    return run


def maximal_stretches(texts_of_other: list[str]):
    """A function of batches (id, s, spans: b, step, n, len): (id, start, end, seq) of stretches that lie in no longer one. Hits of the list and the
    given spans meet here, so that the many short ones never move."""
    from .search import letters_at

    def run(batches):
        listed = Listed(texts_of_other)
        for batch in batches:
            texts, given = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for x, y in groups(texts):
                laid = Laid(texts[x:y])
                far = np.zeros(laid.n, np.int64)  # where the longest stretch from each place ends
                for size, at, *_ in spans_of(texts[x:y], listed):
                    far[at] = np.maximum(far[at], at + size)
                for i, spans in enumerate(given[x:y]):
                    for span in spans or ():
                        at = laid.starts[i] + span["b"] - 1 + span["step"] * np.arange(span["n"])
                        far[at] = np.maximum(far[at], at + span["len"])
                at = np.flatnonzero(far)
                end = far[at]
                at, end = (z[np.diff(np.maximum.accumulate(end), prepend=0) > 0] for z in (at, end))
                base = laid.starts[laid.owner[at]]
                ints = lambda z: pa.array(z.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(laid.owner[at] + x)), ints(at - base + 1), ints(end - base), letters_at([(laid.raw, at, end - at)])], names=["id", "start", "end", "seq"])

    return run


def found_in(texts: list[str]):
    """A function of batches (of, s): (s, of) of the listed texts that occur in a record of file ``of``."""
    from ..functions import iupac

    def run(batches):
        listed, seen = Listed(texts), set()
        for batch in batches:
            ofs, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, y in groups(held):
                for of in set(ofs[x:y]):
                    mine = [t for t, o in zip(held[x:y], ofs[x:y]) if o == of]
                    for way in (Laid(mine), Laid([iupac.revcomp(t) for t in mine])):
                        for size, _, which, words in listed.hits(way):
                            there = np.zeros(len(words), bool)
                            there[which] = True
                            for row in words[there]:
                                seen.add((row.tobytes()[:size].decode(), of))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen], pa.string()), pa.array([o for _, o in seen], pa.int32())], names=["s", "of"])

    return run
