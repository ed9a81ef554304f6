"""Searches: grep, locate, amplicon, fish."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import columns as S
from ..functions import iupac
from . import chunks as K
from . import patterns as P

#: Lists of more patterns are searched by an automaton, in one pass a text; more expressions than that are joined into
#: alternations of so many.
FEW, JOINED = 8, 500


def grep_ids(df: DataFrame, patterns: DataFrame, key: str = "id", invert=False, ignore_case=False, duplicates=False) -> DataFrame:
    """Records whose whole key is in ``patterns`` (column ``pattern``), each once, or with
    ``duplicates`` as often as the list has it. Spark broadcasts a small list by its own size check."""
    fold = F.lower if ignore_case else (lambda c: c)
    p = patterns.select(fold(F.col("pattern")).alias("_p")).where(F.col("_p").isNotNull())
    on = fold(F.col(key)) == F.col("_p")
    if invert:
        return df.join(p, on, "left_anti")
    return df.join(p, on).drop("_p") if duplicates else df.join(p, on, "left_semi")


def grep_first_per_pattern(df: DataFrame, patterns: DataFrame, key: str = "id") -> DataFrame:
    """Each pattern is used up by its first record."""
    hit = grep_ids(df, patterns, key)
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("file_idx", "pos"))).where("_n = 1").drop("_n")


@F.pandas_udf(BooleanType())
def _within(seq: pd.Series, pattern: pd.Series, mismatches: pd.Series) -> pd.Series:
    return pd.Series([s is not None and len(hamming_places(s.encode(), p.encode(), int(m))) > 0 for s, p, m in zip(seq, pattern, mismatches)])


def hamming_places(seq: bytes, pattern: bytes, most: int) -> np.ndarray:
    """Starts where ``pattern`` differs in ``most`` letters at most, in blocks of bounded memory."""
    n, k = len(seq) - len(pattern) + 1, len(pattern)
    if n <= 0 or not k:
        return np.zeros(0, np.int64)
    s = np.frombuffer(seq, np.uint8)
    out = []
    for at in range(0, n, 1 << 20):
        m = min(1 << 20, n - at)
        wrong = np.zeros(m, np.int16)
        for j, c in enumerate(pattern):
            wrong += s[at + j : at + j + m] != c
        out.append(at + np.flatnonzero(wrong <= most))
    return np.concatenate(out)


def match(df_key: Column, patterns, regex=False, by_seq=False, degenerate=False, ignore_case=False, both_strands=True, circular=False, region=None, mismatches=0) -> Column:
    """Whether a key (id, name or sequence) matches any pattern."""
    by_seq = by_seq or degenerate or mismatches > 0 or region is not None
    tests = []
    patterns = list(patterns)
    if len(patterns) > FEW and by_seq and not regex:
        whole = [p for p in patterns if p]
        for s in [df_key, S.revcomp(df_key)] if both_strands else [df_key]:
            s = S.subseq(s, *region) if region else F.concat(s, s) if circular else s
            tests.append(P.any_within(s, whole, mismatches=mismatches, degenerate=degenerate, ignore_case=ignore_case))
        patterns = [""] * (len(whole) < len(patterns))
    elif len(patterns) > FEW and regex and not degenerate:
        # expressions without groups of their own, flags or references can stand in one alternation
        free = [p for p in patterns if p and not re.search(r"\\\d|\\k|\(\?|\\Q", p)]
        patterns = [p for p in patterns if p not in set(free)] + ["|".join(f"(?:{p})" for p in free[a : a + JOINED]) for a in range(0, len(free), JOINED)]
    for p in patterns:
        if p == "":
            tests.append(df_key == "")
            continue
        strands = [df_key, S.revcomp(df_key)] if by_seq and both_strands else [df_key]
        for s in strands:
            if region:
                s = S.subseq(s, *region)
            elif circular and by_seq:
                s = F.concat(s, s)
            if mismatches:
                s, q = (F.lower(s), p.lower()) if ignore_case else (s, p)
                tests.append(_within(s, F.lit(q), F.lit(mismatches)))
            elif regex or degenerate:
                r = iupac.degenerate_regex(p) if degenerate else re.sub(r"\(\?P<", "(?<", p)
                tests.append(s.rlike(("(?i)" if ignore_case else "") + r))
            elif by_seq:
                tests.append(F.lower(s).contains(p.lower()) if ignore_case else s.contains(p))
            else:
                tests.append(F.lower(s) == p.lower() if ignore_case else s == p)
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def grep(df: DataFrame, patterns, key: str | None = None, invert=False, by_seq=False, **how) -> DataFrame:
    """Records that match (or with ``invert`` do not)."""
    seq_like = by_seq or how.get("degenerate") or how.get("mismatches") or how.get("region")
    hit = match(F.col(key or ("seq" if seq_like else "id")), patterns, by_seq=bool(seq_like), **how)
    return df.where(~hit if invert else hit)


def grep_first(df: DataFrame, patterns: list[str], key: str | None = None, by_seq=False, **how) -> DataFrame:
    """As ``grep``, but each pattern is used up by the first record that it matches: a record comes once,
    if it is the first of any. Patterns are as many as a caller writes, and so are the rows that come."""
    key = key or ("seq" if by_seq or how.get("degenerate") or how.get("mismatches") or how.get("region") else "id")
    numbers = F.array(*[F.when(match(F.col(key), [p], by_seq=key == "seq", **how), F.lit(i)) for i, p in enumerate(patterns)])
    hits = df.select("file_idx", "pos", F.explode(F.array_compact(numbers)).alias("_n"))
    first = hits.groupBy("_n").agg(F.min(F.struct("file_idx", "pos")).alias("_f")).select(F.col("_f.file_idx").alias("_fi"), F.col("_f.pos").alias("_fp")).distinct()
    return df.join(first, (F.col("file_idx") == F.col("_fi")) & (F.col("pos") == F.col("_fp")), "left_semi")


# -- locate -----------------------------------------------------------------------------

#: Places that leave a worker at once.
AT_ONCE = 20_000


def find_all(seq: str, name: str, pattern: str, regex=False, degenerate=False, ignore_case=False, both=True, greedy=True, mismatches=0, circular=False) -> list[dict]:
    """All places of one pattern; coordinates on the + strand, 1-based."""
    n, out = len(seq), []
    if not n:
        return out
    fold = (lambda x: x.lower()) if ignore_case else (lambda x: x)
    compiled = re.compile(iupac.degenerate_regex(pattern) if degenerate else pattern, re.I if ignore_case else 0) if regex or degenerate else None
    for strand in "+-" if both else "+":
        s = seq if strand == "+" else iupac.revcomp(seq)
        s = fold(s + s if circular else s)
        spans: list[tuple[int, int]] = []
        if compiled is not None:
            at = 0
            while (m := compiled.search(s, at)) and m.start() < n:
                if m.end() > m.start():
                    spans.append(m.span())
                at = m.start() + 1 if greedy else max(m.end(), m.start() + 1)
        else:
            p = fold(pattern)
            starts = hamming_places(s.encode(), p.encode(), mismatches).tolist() if mismatches else _occurrences(s, p)
            last = -1
            for i in starts:
                if i < n and (greedy or i >= last):
                    spans.append((i, i + len(p)))
                    last = i + len(p)
        for a, b in spans:
            start, end = (a + 1, b) if strand == "+" else (n - b + 1, n - a)
            if start < 1:  # a circular hit on the - strand
                start, end = start + n, end + n
            out.append({"patternName": name, "pattern": pattern, "strand": strand, "start": start, "end": end, "matched": s[a:b]})
    return out


def _occurrences(s: str, p: str) -> list[int]:
    out, at = [], s.find(p)
    while at >= 0 and p:
        out.append(at)
        at = s.find(p, at + 1)
    return out


_HIT = ("patternName", "pattern", "strand", "start", "end", "matched")
_HIT_TYPES = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())


def find_listed(seq: str, items: list[tuple[str, str]], told: P.Patterns, both=True, greedy=True, ignore_case=False, circular=False) -> Iterator[dict]:
    """What ``find_all`` gives for each pattern of a list, by its automaton."""
    n = len(seq)
    for strand in ("+-" if both else "+") if n else "":
        s = seq if strand == "+" else iupac.revcomp(seq)
        s = s + s if circular else s
        shown = s.lower() if ignore_case else s
        for i, starts in told.places(s):
            (name, pattern), last = items[i], -1
            for a in starts:
                if a < n and (greedy or a >= last):
                    b = last = a + len(pattern)
                    start, end = (a + 1, b) if strand == "+" else (n - b + 1, n - a)
                    if start < 1:
                        start, end = start + n, end + n
                    yield {"patternName": name, "pattern": pattern, "strand": strand, "start": start, "end": end, "matched": shown[a:b]}


def near_columns(seq: str, told: P.Patterns, both=True, ignore_case=False) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray, str, np.ndarray]]:
    """The hits of ``find_listed`` with mismatches, a strand's as arrays: pattern numbers, strand, starts and ends on the + strand, the
    letters searched and the places in them."""
    n = len(seq)
    for strand in ("+-" if both else "+") if n else "":
        s = seq if strand == "+" else iupac.revcomp(seq)
        who, a = told.near(s)
        b = a + told.sizes[who]
        start, end = (a + 1, b) if strand == "+" else (n - b + 1, n - a)
        yield who, strand, start, end, s.lower() if ignore_case else s, a


def letters_at(texts: list[tuple[bytes, np.ndarray, np.ndarray]]) -> pa.Array:
    """The substrings of each text (starts, lengths) as one column."""
    base = np.cumsum([0, *[len(t) for t, _, _ in texts]])
    first = np.concatenate([a + x for (_, a, _), x in zip(texts, base)])
    size = np.concatenate([k for _, _, k in texts])
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    places = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
    letters = np.frombuffer(b"".join(t for t, _, _ in texts), np.uint8)[places]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters))


def _searcher(items: list[tuple[str, str]], both: bool, greedy: bool, **how):
    """A function from a text to its hits: pattern by pattern, or for long lists by automata."""
    regex = how.get("regex", False)
    if len(items) <= FEW or regex:
        return lambda seq: (h for name, p in items for h in find_all(seq, name, p, both=both, greedy=greedy, **how))
    parts, at = [], 0
    for shard in P.shards([p for _, p in items]):
        parts.append(items[at : at + len(shard)])
        at += len(shard)
    fold, circular = how.get("ignore_case", False), how.get("circular", False)
    of = {k: how[k] for k in ("mismatches", "degenerate", "ignore_case") if k in how}

    def search(seq):
        for part in parts:
            yield from find_listed(seq, part, P.Patterns.kept([p for _, p in part], **of), both, greedy, fold, circular)

    return search


def locate(df: DataFrame, patterns: dict[str, str], only_positive=False, non_greedy=False, chunk: int | None = None, **how) -> DataFrame:
    """seqID, patternName, pattern, strand, start, end, matched: a row for each place. Arrow
    batches search; overlapping places count unless ``non_greedy``.

    ``chunk``: letters of a sequence that a task takes at once, for genomes; the rows are the same for each length. Regular expressions
    have no longest hit and ``non_greedy`` looks back at the hit before, so both need whole records."""
    items = list(patterns.items())
    both, greedy = not only_positive, not non_greedy
    if chunk and (how.get("regex") or non_greedy):
        raise ValueError("chunks are for hits of fixed length, overlapping ones too")
    circular = how.pop("circular", False) if chunk else False
    search = _searcher(items, both, greedy, **how)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[1][f] for r in rows], t) for f, t in zip(_HIT, _HIT_TYPES, strict=True)]], names=["seqID", *_HIT])

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for i, s, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for h in search(s or ""):
                    if place:
                        at, own = place
                        if h["start"] > own:  # the next chunk's
                            continue
                        h["start"], h["end"] = h["start"] + at, h["end"] + at
                    rows.append((i, h))
                    if len(rows) >= AT_ONCE:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    mismatches, fold = how.get("mismatches", 0), how.get("ignore_case", False)
    arrays = mismatches and len(items) > FEW and greedy and not (how.get("regex") or how.get("degenerate") or how.get("circular")) and all(p.isascii() for _, p in items)

    def run_arrays(batches):
        """The same for lists with mismatches, whose hits may be more than the letters: columns, no objects for each hit."""
        parts = [(items[a : a + len(x)], x) for x, a in zip(shards, np.cumsum([0, *map(len, shards)]))]
        labels = [(pa.array([n for n, _ in part], pa.string()), pa.array([p for _, p in part], pa.string())) for part, _ in parts]
        for batch in batches:
            for (part, listed), (names, patterns) in zip(parts, labels):
                told, found, n = P.Patterns.kept(listed, mismatches=mismatches, ignore_case=fold), [], 0
                for i, s, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if s and not s.isascii():  # places in bytes are not those in letters; once for all shards
                        if listed is not shards[0]:
                            continue
                        yield from run(iter([pa.RecordBatch.from_arrays([pa.array([x], c.type) for x, c in zip((i, s, *place), batch.columns)], names=batch.schema.names)]))
                        continue
                    at, own = place or (0, len(s or ""))
                    for who, strand, start, end, text, a in near_columns(s or "", told, both, fold):
                        mine = start <= own
                        if not mine.all():
                            who, start, end, a = who[mine], start[mine], end[mine], a[mine]
                        for x in range(0, len(who), AT_ONCE):
                            y = slice(x, x + AT_ONCE)
                            low, high = int(a[y].min()), int((a[y] + end[y] - start[y]).max()) + 1
                            found.append((i, who[y], strand, start[y] + at, end[y] + at, text[low:high].encode(), a[y] - low, end[y] - start[y] + 1))
                            n += len(who[y])
                            if n >= AT_ONCE:
                                yield hits_of(found, names, patterns)
                                found, n = [], 0
                if found:
                    yield hits_of(found, names, patterns)

    def hits_of(found, names, patterns):
        ids, who, strands, start, end, texts, a, k = zip(*found)
        each = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in who]))
        who = pa.array(np.concatenate(who))
        ints = lambda x: pa.array(np.concatenate(x).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()).take(each), names.take(who), patterns.take(who), pa.array(strands, pa.string()).take(each), ints(start), ints(end), letters_at(list(zip(texts, a, k)))], names=["seqID", *_HIT])

    if arrays:
        shards = P.shards([p for _, p in items])
    take = run_arrays if arrays else run
    kind = "seqID string, patternName string, pattern string, strand string, start int, end int, matched string"
    if not chunk:
        return df.select("id", "seq").mapInArrow(take, kind)
    longest = max([1, *(len(p) for _, p in items)])
    return K.chunks(df, chunk, longest - 1, circular).select("id", "letters", "at", "own").mapInArrow(take, kind)


def cigar_of(ref: str, query: str, before: int, after: int) -> tuple[str, int]:
    """(CIGAR, edit distance) of two gapped strings, with soft clips around."""
    ops, edits = [], 0
    for r, q in zip(ref, query, strict=True):
        op = "I" if r == "-" else "D" if q == "-" else "M"
        edits += op != "M" or r.upper() != q.upper()
        if ops and ops[-1][0] == op:
            ops[-1][1] += 1
        else:
            ops.append([op, 1])
    text = (f"{before}S" if before else "") + "".join(f"{n}{o}" for o, n in ops) + (f"{after}S" if after else "")
    return text, edits


def as_bed(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("seqID").alias("chrom"), (F.col("start") - 1).alias("start"), "end", F.col("patternName").alias("name"), F.lit(0).alias("score"), "strand")


def as_gtf(hits: DataFrame, source: str = "strandloom") -> DataFrame:
    return hits.select(F.col("seqID").alias("seqname"), F.lit(source).alias("source"), F.lit("location").alias("feature"), "start", "end", F.lit(0).alias("score"), "strand", F.lit(".").alias("frame"), F.concat(F.lit('gene_id "'), "patternName", F.lit('"; ')).alias("attribute"))


# -- amplicon -----------------------------------------------------------------------------


def region_of(length: int, f: int, r: int, a: int, b: int, flanking=False) -> tuple[int, int] | None:
    """0-based half-open region of an amplicon of ``length`` with primers of ``f`` and ``r`` letters;
    inner positions count from its ends, 1-based. Flanking regions count outwards from
    its ends: negative before it, positive after it, and may leave the amplicon."""
    if a == 0 or b == 0 or a > b and (a > 0) == (b > 0):
        raise ValueError("bad region")
    if not flanking:
        start = a if a > 0 else length + a + 1
        end = b if b > 0 else length + b + 1
        return (start - 1, end) if 1 <= start <= end <= length else None
    start = a if a < 0 else length + a - 1
    end = b + 1 if b < 0 else length + b
    return (start, end) if start < end else None


def amplify(seq: str, forward: str, reverse: str, mismatches=0) -> tuple[int, int, int, int] | None:
    """(start, end, mismatches 5', mismatches 3') of the longest span from the first forward to the last
    reverse primer (already reverse-complemented), 0-based half-open."""
    s = seq.upper()
    if mismatches:
        fs = hamming_places(s.encode(), forward.encode(), mismatches)
        rs = hamming_places(s.encode(), reverse.encode(), mismatches)
        if not len(fs) or not len(rs) or rs[-1] < fs[0]:
            return None
        i, j = int(fs[0]), int(rs[-1])
        wrong = lambda at, p: sum(x != y for x, y in zip(s[at : at + len(p)], p))
        return i, j + len(reverse), wrong(i, forward), wrong(j, reverse)
    f = re.search(iupac.degenerate_regex(forward), s)
    if not f:
        return None
    j, last = f.start(), None
    r = re.compile(iupac.degenerate_regex(reverse))
    while m := r.search(s, j):
        last, j = m, m.start() + 1
    return (f.start(), last.end(), 0, 0) if last else None


def amplicon(df: DataFrame, primers: list[tuple[str, str, str]], mismatches=0, region=None, flanking=False, strict=False, only_positive=False, save_unmatched=False) -> DataFrame:
    """chrom, start (0-based), end, primer, score, strand, amplicon, mismatches, mis5, mis3: for each
    record, strand and primer pair (name, forward, reverse; one of both may be empty)."""
    ready = []
    for name, f, r in primers:
        f, r = f.upper(), iupac.revcomp(r.upper()) if r else ""
        ready.append((name, f or r, r or f, bool(f), bool(r)))
    kind = "array<struct<start:int,end:int,primer:string,score:int,strand:string,amplicon:string,mismatches:int,mis5:int,mis3:int>>"

    @F.pandas_udf(kind)
    def spans(seqs: pd.Series) -> pd.Series:
        out = []
        for seq in seqs:
            found = []
            for strand in "+" if only_positive else "+-":
                s = (seq or "") if strand == "+" else iupac.revcomp(seq or "")
                for name, f, r, has_f, has_r in ready:
                    got = amplify(s, f, r, mismatches)
                    if got is None:
                        continue
                    a, b, m5, m3 = got
                    if not (has_f and has_r):
                        b = a + len(f)
                        m3 = 0
                    if region:
                        inner = region_of(b - a, len(f), len(r), *region, flanking=flanking)
                        if inner is None:
                            continue
                        a, b = a + inner[0], a + inner[1]
                        if strict and not (0 <= a and b <= len(s)):
                            continue
                        a, b = max(a, 0), min(b, len(s))
                        if a >= b:
                            continue
                    start, end = (a, b) if strand == "+" else (len(s) - b, len(s) - a)
                    found.append({"start": start, "end": end, "primer": name, "score": 0, "strand": strand, "amplicon": s[a:b], "mismatches": m5 + m3, "mis5": m5, "mis3": m3})
            out.append(found)
        return pd.Series(out)

    explode = F.explode_outer if save_unmatched else F.explode
    return df.select(F.col("id").alias("chrom"), explode(spans("seq")).alias("a")).select("chrom", "a.*")


# -- fish: local alignment ---------------------------------------------------------------


#: Cells of a matrix at once; longer references are aligned in tiles.
CELLS = 1 << 21


def smith_waterman(ref: str, query: str, match_=4, mismatch=-4, gap_open=-2, gap_extend=-1) -> tuple[int, int, int, int, int, str, str] | None:
    """Best local alignment with affine gaps: (score, ref start, ref end, query start, query end, aligned
    ref, aligned query); of equal scores the one that ends first in the query, then in the reference.

    An alignment of positive score spans at most ``reach`` letters of the reference, as each one beyond the
    query's costs a gap. So tiles that overlap by that give what the whole matrix would, in bounded memory."""
    reach = len(query) + len(query) * match_ // -gap_extend + 1
    tile = max(reach, CELLS // (len(query) + 1))
    best = None
    for at in range(0, len(ref), tile):
        lo = max(0, at - reach)
        got = _align(ref[lo : at + tile], query, at - lo, match_, mismatch, gap_open, gap_extend)
        if got:
            got = (got[0], got[1] + lo, got[2] + lo, *got[3:])
            if best is None or (-got[0], got[4], got[2]) < (-best[0], best[4], best[2]):
                best = got
    return best


def _align(ref: str, query: str, after: int, match_, mismatch, gap_open, gap_extend) -> tuple[int, int, int, int, int, str, str] | None:
    """The best alignment that ends behind ``after`` letters of the reference. Rows go over the query, vectors
    over the reference."""
    n, m = len(ref), len(query)
    if not n or not m:
        return None
    r = np.frombuffer(ref.upper().encode(), np.uint8)
    q = query.upper().encode()
    low = -(10**9)
    h = np.zeros((m + 1, n + 1), np.int64)
    up = np.full(n + 1, low, np.int64)
    step = gap_extend * np.arange(n + 1)
    ups = np.zeros((m + 1, n + 1), np.int64)
    for i in range(1, m + 1):
        up = np.maximum(up, h[i - 1] + gap_open) + gap_extend
        ups[i] = up
        best = np.maximum(0, up)
        best[1:] = np.maximum(best[1:], h[i - 1, :-1] + np.where(r == q[i - 1], match_, mismatch))
        # gaps in the query: a running maximum along the row
        run = np.maximum.accumulate(best + gap_open - step)
        left = np.full(n + 1, low, np.int64)
        left[1:] = run[:-1] + step[1:]
        h[i] = np.maximum(best, left)
        h[i, 0] = 0
    ends = h[:, after:]
    score = int(ends.max())
    if score <= 0:
        return None
    i, j = (int(x) for x in np.unravel_index(int(ends.argmax()), ends.shape))
    j += after
    ie, je, a, b = i, j, [], []
    while i and j and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (match_ if r[j - 1] == q[i - 1] else mismatch):
            i, j = i - 1, j - 1
            a.append(ref[j])
            b.append(query[i])
        elif h[i, j] == ups[i, j]:
            while True:
                opened = ups[i, j] == h[i - 1, j] + gap_open + gap_extend
                i -= 1
                a.append("-")
                b.append(query[i])
                if opened or not i:
                    break
        else:
            k = 1
            while h[i, j] != h[i, j - k] + gap_open + gap_extend * k:
                k += 1
            for _ in range(k):
                j -= 1
                a.append(ref[j])
                b.append("-")
    return score, j, je, i, ie, "".join(reversed(a)), "".join(reversed(b))


def fish_one(name: str, ref: str, queries: dict[str, str], params=(4, -4, -2, -1), min_qual=5.0, stranded=False, every=False, ranges=None) -> list[dict]:
    """All hits of short queries in one reference, best score first; with each its CIGAR, edits and the query's
    letters as aligned, which make it an alignment record."""
    out = []
    n = len(ref)
    spans = [(max(0, a + n if a < 0 else a), min(n, b + n if b < 0 else b)) for a, b in ((x or 0, n if y is None else y) for x, y in (ranges or [(0, None)]))]
    limit = 1 - 10 ** (-min_qual / 10)
    for qname, query in queries.items():
        null = params[0] * len(query)
        for strand, q in (("+", query),) if stranded else (("+", query), ("-", iupac.revcomp(query))):
            todo = list(spans)
            while todo:
                a, b = todo.pop()
                got = smith_waterman(ref[a:b], q, *params) if a < b else None
                if got is None or not got[0] / null > limit:
                    continue
                score, rs, re_, qs, qe, x, y = got
                same = sum(c.upper() == d.upper() for c, d in zip(x, y))
                share = score / null
                out.append({"Ref": name, "RefStart": a + rs, "RefEnd": a + re_, "Query": qname, "QueryStart": qs, "QueryEnd": qe, "Strand": strand, "MapQual": 60.0 if share >= 1 else round(-10 * float(np.log10(1 - share)), 2), "RawScore": score, "Acc": round(100 * same / len(x), 2), "ClipAcc": round(100 * same / (len(x) + len(q) - (qe - qs)), 2), "QueryCov": round(100 * (qe - qs) / len(q), 2), **dict(zip(("Cigar", "Edits"), cigar_of(x, y, qs, len(q) - qe), strict=True)), "Letters": q})
                if every:
                    todo += [(a, a + rs), (a + re_, b)]
    return sorted(out, key=lambda r: -r["RawScore"])


FISH = "array<struct<Ref:string,RefStart:int,RefEnd:int,Query:string,QueryStart:int,QueryEnd:int,Strand:string,MapQual:double,RawScore:int,Acc:double,ClipAcc:double,QueryCov:double>>"


def fish(df: DataFrame, queries: dict[str, str], letters=False, **how) -> DataFrame:
    """Local alignments of short queries in every record, in Arrow batches; with ``letters`` the columns Cigar,
    Edits and Letters too, for ``bam.from_fish``."""

    @F.pandas_udf(FISH[:-2] + ",Cigar:string,Edits:int,Letters:string>>" if letters else FISH)
    def hits(ids: pd.Series, seqs: pd.Series) -> pd.Series:
        return pd.Series([fish_one(i, s or "", queries, **how) for i, s in zip(ids, seqs)])

    return df.select(F.explode(hits("id", "seq")).alias("h")).select("h.*")


def amplicon_bed(hits: DataFrame) -> DataFrame:
    """BED6+1 of amplicons: the seventh column is the amplicon."""
    return hits.select("chrom", "start", "end", F.col("primer").alias("name"), "score", "strand", "amplicon")


def fish_none(df: DataFrame, queries: dict[str, str], **how) -> DataFrame:
    """Records without any hit."""
    return df.join(fish(df, queries, **how).select(F.col("Ref").alias("_r")).distinct(), F.col("id") == F.col("_r"), "left_anti")
