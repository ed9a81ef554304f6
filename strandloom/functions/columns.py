"""Sequence functions as Column expressions. All are native but those that say Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import iupac

GAPS = "- \t."


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seq_id(name, regexp: str = r"^(\S+)") -> Column:
    """A header's id: empty for a header that begins with a blank."""
    return F.regexp_extract(col(name), regexp, 1)


def seq_desc(name) -> Column:
    return F.regexp_extract(col(name), r"^\S*\s+(.*)$", 1)


def complement(seq, rna: bool = False) -> Column:
    return F.translate(col(seq), iupac.RNA_FROM if rna else iupac.DNA_FROM, iupac.RNA_TO if rna else iupac.DNA_TO)


def revcomp(seq, rna: bool = False) -> Column:
    return F.reverse(complement(seq, rna))


def revcomp_dna(seq) -> Column:
    """In upper case, with N for every letter but A, C, G and T."""
    return F.reverse(F.translate(F.regexp_replace(F.translate(col(seq), "acgt", "ACGT"), "[^ACGT]", "N"), "ACGT", "TGCA"))


def uuid7() -> Column:
    """A UUID of version 7: the query's time in milliseconds, then random bits."""
    time, rest = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0"), F.expr("uuid()")
    return F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), F.substring(rest, 16, 21))


def strand_key(seq) -> Column:
    """The same for a sequence and its reverse complement."""
    return F.least(col(seq), revcomp(seq))


def dna2rna(seq) -> Column:
    return F.translate(col(seq), "tT", "uU")


def rna2dna(seq) -> Column:
    return F.translate(col(seq), "uU", "tT")


def remove_gaps(seq, letters: str = GAPS) -> Column:
    return F.translate(col(seq), letters, "")


def count_letters(seq, letters: str, ignore_case: bool = True) -> Column:
    if ignore_case:
        letters = "".join(dict.fromkeys(letters.upper() + letters.lower()))
    return F.length(col(seq)) - F.length(F.translate(col(seq), letters, ""))


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole, null for 0 / 0."""
    return F.try_divide(100.0 * part, whole)


def gc(seq) -> Column:
    return share(count_letters(seq, "GC"), count_letters(seq, "ACGTU"))


def gc_skew(seq) -> Column:
    g, c = count_letters(seq, "G"), count_letters(seq, "C")
    return share(g - c, g + c)


def alphabet(seq) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(col(seq), ""), lambda x: x != ""))), "")


def seq_hash(seq, case_sensitive: bool = False) -> Column:
    return F.md5(col(seq) if case_sensitive else F.lower(col(seq)))


#: What guess_type tries, in order (fixed values).
ALPHABETS = (("DNA", "acgtrymkswhbvdnACGTRYMKSWHBVDN"), ("RNA", "acgurymkswhbvdnACGURYMKSWHBVDN"), ("Protein", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ*_"))


def guess_type(seq, gaps: str = " -.") -> Column:
    """DNA, RNA, Protein or Unlimit by the letters; null where there are none."""
    out = F.lit("Unlimit")
    for name, letters in reversed(ALPHABETS):
        out = F.when(F.length(F.translate(col(seq), letters + gaps + ("*" if name != "Protein" else ""), "")) == 0, name).otherwise(out)
    return F.when(F.length(col(seq)) > 0, out)


def sub_location(length: Column, a: int, b: int) -> tuple[Column, Column, Column]:
    """1-based (start, end, whether any) of region a:b; negative counts from the end."""
    if a == 0 or b == 0 or (a < 0 < b):
        raise ValueError(f"bad region {a}:{b}")
    start = F.greatest(length + (a + 1), F.lit(1)) if a < 0 else F.lit(a)
    end = F.least(length + (b + 1) if b < 0 else F.lit(b), length)
    return start, end, (start <= end) & (start <= length)


def subseq(seq, a: int, b: int) -> Column:
    start, end, any_ = sub_location(F.length(col(seq)), a, b)
    return F.when(any_, F.substring(col(seq), start, end - start + 1)).otherwise(F.when(col(seq).isNotNull(), F.lit("")))


def wrap(seq, width: int = 60) -> Column:
    return col(seq) if width <= 0 else F.regexp_replace(col(seq), f"(.{{{width}}})(?=.)", "$1\n")


def _per_letter(table: np.ndarray):
    """Arrow: for each string the sum of a table's values over its bytes."""

    @F.pandas_udf("double")
    def total(s: pd.Series) -> pd.Series:
        raw = [x.encode() if x is not None else b"" for x in s]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out = np.zeros(len(raw))
        buf = np.frombuffer(b"".join(raw), np.uint8)
        if len(buf):
            full = size > 0
            out[full] = np.add.reduceat(table[buf], (np.cumsum(size) - size)[full])
        return pd.Series(out)

    return total


def error_sum(qual, base: int = 33) -> Column:
    """Arrow: the sum of error probabilities."""
    return _per_letter(10.0 ** (-(np.arange(256) - base) / 10))(col(qual))


def avg_qual(qual, base: int = 33) -> Column:
    """-10 log10 of the mean error probability; 0 without bases."""
    n = F.length(col(qual))
    return F.when(n > 0, -10 * F.log10(F.try_divide(error_sum(qual, base), n))).otherwise(0.0)


def q_count(qual, least: int, base: int = 33) -> Column:
    """How many bases have that quality or more: native, as letters in a range."""
    letters = "".join(chr(c) for c in range(base + least, 127))
    return F.length(col(qual)) - F.length(F.translate(col(qual), letters, ""))


def natural_key(name) -> Column:
    """Orders digit runs as numbers: each is padded to 20 places."""
    return F.array_join(F.transform(F.regexp_extract_all(col(name), F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x)), "")


def parse_size(text: str) -> int:
    """``10``, ``1K``, ``2M``, ``1G``: powers of 1024."""
    t = text.strip().upper().rstrip("B")
    unit = {"K": 1, "M": 2, "G": 3, "T": 4}.get(t[-1:], 0)
    t = t[:-1] if unit else t
    return int(float(t) * 1024**unit) if t else 0


def codon_letters(seq, frame: int, code: dict[str, str], unknown: str = "X") -> Column:
    """The amino acids of one frame; trailing bases that are no codon are dropped."""
    s = F.translate(F.upper(revcomp(seq) if frame < 0 else col(seq)), "U", "T")
    s = F.substring(s, F.lit(abs(frame)), F.length(s))
    table = F.create_map(*[F.lit(x) for pair in code.items() for x in pair])
    n = F.floor(F.length(s) / 3).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(table, F.substring(s, i * 3 + 1, F.lit(3))), F.lit(unknown))), "")).otherwise("")


@F.pandas_udf(StringType())
def _translate_many(seq: pd.Series, frame: pd.Series, number: pd.Series, unknown: pd.Series) -> pd.Series:
    codes: dict[int, dict[str, str]] = {}
    out = []
    for s, f, n, x in zip(seq, frame, number, unknown):
        if s is None:
            out.append(None)
            continue
        if n not in codes:
            codes[n] = iupac.ambiguous_code(n)
        code = codes[n]
        s = s.upper().replace("U", "T")
        s = (iupac.revcomp(s) if f < 0 else s)[abs(f) - 1 :]
        out.append("".join([code.get(s[i : i + 3], x) for i in range(0, len(s) - 2, 3)]))
    return pd.Series(out)


def translate(seq, frame, number: int = 1, unknown: str = "X") -> Column:
    """Arrow: the amino acids of a frame (a Column or number), IUPAC codons included."""
    return _translate_many(col(seq), frame if isinstance(frame, Column) else F.lit(frame), F.lit(number), F.lit(unknown))


# -- alignment fields -----------------------------------------------------------------


def cigar_sum(ops: str, cigar="cigar") -> Column:
    return F.aggregate(F.filter(col(cigar), lambda x: F.lit(ops).contains(x["op"])), F.lit(0), lambda a, x: a + x["len"])
