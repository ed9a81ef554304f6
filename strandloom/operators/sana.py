"""Sanitising: keeps the well-formed records of broken FASTA and FASTQ text, and tells of the rest."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

LETTERS = re.compile(r"[ACGTURYSWKMBDHVNacgturyswkmbdhvn]*")
GAPPED = re.compile(r"[ACGTURYSWKMBDHVNacgturyswkmbdhvn\-. *]*")
REJECT = "file string, start_line int, error string, line string"


def _fault(head: str, seq: str, plus: str, qual: str, gaps: bool, base: int) -> str | None:
    if not head.startswith("@"):
        return "no header"
    if not plus.startswith("+"):
        return "no separator"
    if len(seq) != len(qual):
        return f"sequence of {len(seq)} and quality of {len(qual)}"
    if not (GAPPED if gaps else LETTERS).fullmatch(seq):
        return "illegal letter"
    return "negative quality" if qual and min(qual) < chr(base) else None


def fastq(lines: Iterable[str], gaps=False, base=33) -> Iterator[tuple]:
    """(line number, name, seq, qual, None, None) of each good record and (line number, None, None, None,
    error, line) of each discarded line. After a bad record reading goes on at the next header-like
    line within it or behind."""
    window: list[tuple[int, str]] = []
    for n, line in enumerate(lines, 1):
        line = line.rstrip("\r\n")
        if not window and not line.startswith("@"):
            if line:
                yield n, None, None, None, "no header", line
            continue
        window.append((n, line))
        while len(window) == 4:
            fault = _fault(*(x for _, x in window), gaps, base)
            if fault is None:
                yield window[0][0], window[0][1][1:], window[1][1], window[3][1], None, None
                window = []
                break
            again = next((i for i in range(1, 4) if window[i][1].startswith("@")), 4)
            for k, x in window[:again]:
                yield k, None, None, None, fault, x
            window = window[again:]
            break
    for k, x in window:
        yield k, None, None, None, "record ends early", x


def fasta(lines: Iterable[str], gaps=False) -> Iterator[tuple]:
    """As ``fastq``: a record is a header and at least one good line; blank lines do not count."""
    head: tuple[int, str] | None = None
    parts: list[tuple[int, str]] = []
    fault = None

    def close():
        if head is None:
            return
        if fault or not parts:
            for k, x in [(head[0], head[1]), *parts]:
                yield k, None, None, None, fault or "no sequence", x
        else:
            yield head[0], head[1][1:], "".join(x for _, x in parts), None, None, None

    for n, line in enumerate(lines, 1):
        line = line.rstrip("\r\n")
        if not line.strip():
            continue
        if line.startswith(">"):
            yield from close()
            head, parts, fault = (n, line), [], None
        elif head is None:
            yield n, None, None, None, "no header", line
        else:
            parts.append((n, line))
            if not (GAPPED if gaps else LETTERS).fullmatch(line):
                fault = "illegal letter"
    yield from close()


SANA = "file string, start_line long, name string, seq string, qual string, error string, line string"


def sana(texts: DataFrame, kind: str = "fastq", gaps=False, base=33, fill_quality: str | None = None) -> DataFrame:
    """Rows of whole files (file, text) as records and rejects; the parser keeps four lines, and a
    file's records leave in batches. FASTA records get ``fill_quality`` where FASTQ is wanted."""
    import pyarrow as pa

    names = ("file", "start_line", "name", "seq", "qual", "error", "line")
    types = [pa.string(), pa.int64(), *[pa.string()] * 5]

    def run(batches):
        for batch in batches:
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                lines = (text or "").split("\n")
                for n, name, seq, qual, error, line in fastq(lines, gaps, base) if kind == "fastq" else fasta(lines, gaps):
                    if fill_quality and seq is not None and qual is None:
                        qual = fill_quality * len(seq)
                    rows.append((file, n, name, seq, qual, error, line))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return texts.select("file", "text").mapInArrow(run, SANA)
