"""Many patterns in one pass over each text: an Aho-Corasick automaton over seeds, and a check of the places they name.

A pattern's seeds are substrings one of which each of its occurrences must have unchanged: the whole of an exact
pattern; with ``m`` mismatches each of its m + 1 pieces (pigeonhole); of a motif with degenerate letters its longest run of
plain ones. The automaton finds all seeds of all patterns at once; the places that they imply are then compared letter by
letter. Patterns whose seeds are shorter than ``LEAST`` letters would be everywhere and have a pass of their own.

A list is cut into shards of at most ``LETTERS`` letters, each an automaton of bounded memory that meets every text; a
worker builds a shard's once and keeps the last ones.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import iupac

#: Letters of seeds that an automaton has at most, letters that a seed has at least, automata that a worker keeps.
LETTERS, LEAST, KEPT = 4_000_000, 4, 4
#: Places of seeds, and pairs of these with patterns, that are compared at once; the low seven bits of each byte of a word.
HITS, PAIRS, LOW = 1 << 16, 1 << 20, np.uint64(0x7F7F7F7F7F7F7F7F)
_BUILT: dict[bytes, Patterns] = {}


def shards(patterns: list[str]) -> list[list[str]]:
    """Consecutive parts of a list, by letters."""
    out, total = [[]], 0
    for p in patterns:
        if out[-1] and total + len(p) > LETTERS:
            out.append([])
            total = 0
        out[-1].append(p)
        total += len(p)
    return out


def seeds_of(pattern: str, mismatches: int, degenerate: bool) -> list[tuple[int, str]]:
    """(place in the pattern, letters) of seeds, none if they would be too short."""
    if degenerate:
        plain = "".join(" " if len(iupac.CODES.get(c.upper(), c)) > 1 or c in "Uu" else c for c in pattern)
        run = max(re.finditer(r"[^ ]+", plain), key=lambda r: len(r[0]), default=None)
        found = [(run.start(), run[0])] if run else []
    else:
        n = mismatches + 1
        edges = [len(pattern) * i // n for i in range(n + 1)]
        found = [(a, pattern[a:b]) for a, b in zip(edges, edges[1:])]
    return found if found and min(len(s) for _, s in found) >= LEAST else []


class Patterns:
    def __init__(self, patterns: list[str], mismatches: int = 0, degenerate: bool = False, ignore_case: bool = False):
        import ahocorasick

        self.mismatches, self.degenerate, self.ignore_case = mismatches, degenerate, ignore_case
        self.patterns = [p.lower() if ignore_case and not degenerate else p for p in patterns]
        self.regexes = [re.compile(iupac.degenerate_regex(p), re.I if ignore_case else 0) for p in patterns] if degenerate else []
        by_seed, self.alone = defaultdict(list), []
        for i, p in enumerate(self.patterns):
            seeds = seeds_of(p, mismatches, degenerate)
            for at, seed in seeds:
                by_seed[seed.lower() if ignore_case else seed].append((i, at, len(seed)))
            if p and not seeds:
                self.alone.append(i)
        self.automaton, self.uses = ahocorasick.Automaton(), list(by_seed.values())
        for number, seed in enumerate(by_seed):
            self.automaton.add_word(seed, number)
        if by_seed:
            self.automaton.make_automaton()
        self.any = bool(by_seed)
        if mismatches:  # the same as flat arrays: a seed's uses, and each pattern's letters in words of eight
            flat = np.array([(i, at + n - 1) for uses in self.uses for i, at, n in uses], np.int64).reshape(-1, 2)
            self.user, self.back = flat[:, 0], flat[:, 1]
            self.n_uses = np.array([len(uses) for uses in self.uses], np.int64)
            self.first_use = np.cumsum(self.n_uses) - self.n_uses
            raw = [p.encode() for p in self.patterns]
            self.sizes = np.array([len(p) for p in raw], np.int64)
            self.first_word = np.cumsum(-(-self.sizes // 8)) + self.sizes // -8
            self.words = np.frombuffer(b"".join(p + bytes(-len(p) % 8) for p in raw), "<u8")
            self.real = np.frombuffer(b"".join(b"\xff" * len(p) + bytes(-len(p) % 8) for p in raw), "<u8")

    @classmethod
    def kept(cls, patterns: list[str], **how) -> Patterns:
        key = hashlib.blake2b(repr((patterns, sorted(how.items()))).encode(), digest_size=16).digest()
        if key not in _BUILT:
            while len(_BUILT) >= KEPT:
                del _BUILT[next(iter(_BUILT))]
            _BUILT[key] = cls(patterns, **how)
        return _BUILT[key]

    def _checked(self, text: str, i: int, starts) -> list[int]:
        """Which starts are occurrences of pattern ``i``."""
        k = len(self.patterns[i])
        if self.degenerate:
            return [a for a in sorted(set(starts)) if a >= 0 and (m := self.regexes[i].match(text, a)) and m.end() == a + k]
        return sorted(starts)

    def near(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(pattern numbers, starts) of all occurrences with mismatches, sorted. What seeds name is compared for all patterns at
        once, some ``HITS`` of the automaton and ``PAIRS`` of places and patterns at a time."""
        folded = text.lower() if self.ignore_case else text
        raw = folded.encode()
        n = len(raw)
        words = np.ndarray((n + 1,), "<u8", raw + bytes(8), strides=(1,))  # the eight letters from each place on
        hits, found = self.automaton.iter(folded) if self.any else iter(()), [np.zeros(0, np.int64)]
        while (some := np.array(list(islice(hits, HITS)), np.int64)).size:
            upto = np.cumsum(self.n_uses[some[:, 1]])
            for part in np.split(some, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS))):
                uses = self.n_uses[part[:, 1]]
                use = np.repeat(self.first_use[part[:, 1]] - (np.cumsum(uses) - uses), uses) + np.arange(uses.sum())
                who, start = self.user[use], np.repeat(part[:, 0], uses) - self.back[use]
                inside = (start >= 0) & (start + self.sizes[who] <= n)
                who, start = self._alike(words, who[inside], start[inside])
                found.append(who * (n + 1) + start)
        for i in self.alone:
            found.append(i * (n + 1) + np.asarray(self._own_pass(folded, np.frombuffer(raw, np.uint8), i), np.int64))
        at = np.sort(np.concatenate(found))
        return np.divmod(at[np.diff(at, prepend=-1) > 0], n + 1)  # several seeds name a place

    def _alike(self, words: np.ndarray, who: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that differ in ``mismatches`` letters at most; of the others no further words are looked at."""
        wrong, done, at = np.zeros(len(who), np.int64), [], 0
        while len(who):
            j = self.first_word[who] + at
            x = (words[start + 8 * at] ^ self.words[j]) & self.real[j]
            wrong = wrong + np.bitwise_count((((x & LOW) + LOW) | x) & ~LOW)
            at += 1
            few, over = wrong <= self.mismatches, self.sizes[who] <= 8 * at
            done.append((who[few & over], start[few & over]))
            who, start, wrong = who[few & ~over], start[few & ~over], wrong[few & ~over]
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (who, start)

    def _own_pass(self, text: str, raw: np.ndarray | None, i: int) -> list[int]:
        from .search import _occurrences, hamming_places

        if self.degenerate:
            out, at = [], 0
            while m := self.regexes[i].search(text, at):
                out.append(m.start())
                at = m.start() + 1
            return out
        return hamming_places(raw.tobytes(), self.patterns[i].encode(), self.mismatches).tolist() if self.mismatches else _occurrences(text, self.patterns[i])

    def places(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(pattern number, its starts in rising order), overlapping ones too, of the patterns that occur."""
        if self.mismatches and not self.degenerate:
            who, start = self.near(text)
            edges = np.flatnonzero(np.diff(who, prepend=-1))
            for i, starts in zip(who[edges].tolist(), np.split(start, edges[1:])):
                yield i, starts.tolist()
            return
        folded = text.lower() if self.ignore_case else text
        found = defaultdict(list)
        if self.any:
            for end, seed in self.automaton.iter(folded):
                for i, at, n in self.uses[seed]:
                    found[i].append(end - n + 1 - at)
        for i, starts in found.items():
            if starts := self._checked(text if self.degenerate else folded, i, starts):
                yield i, starts
        for i in self.alone:
            if starts := self._own_pass(text if self.degenerate else folded, None, i):
                yield i, starts

    def within(self, text: str) -> bool:
        return next(iter(self.places(text)), None) is not None


def _hit(shard: list[str], how: dict):
    @F.pandas_udf(BooleanType())
    def hit(texts: pd.Series) -> pd.Series:
        told = Patterns.kept(shard, **how)
        return pd.Series([t is not None and told.within(t) for t in texts], dtype=bool)

    return hit


def any_within(text: Column, patterns: list[str], **how) -> Column:
    """Whether any of many patterns occurs in a text; null texts have none."""
    out = F.lit(False)
    for shard in shards(patterns):
        out = out | _hit(shard, how)(text)
    return out
