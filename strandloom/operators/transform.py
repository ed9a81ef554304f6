"""Per-record transforms: each takes and returns a record DataFrame, narrow."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import columns as S
from ..functions import iupac
from ..functions.ordering import numbered


def seq(df: DataFrame, reverse=False, complement=False, remove_gaps=False, gap_letters=S.GAPS, lower=False, upper=False, dna2rna=False, rna2dna=False, min_len=-1, max_len=-1, min_qual=-1.0, max_qual=-1.0, qual_base=33, only_id=False, validate=None, matched: Column | None = None) -> DataFrame:
    """Edits and filters in a fixed order: gaps, length, quality, reverse, complement, RNA/DNA, case.
    Where ``matched`` is given, other records pass unedited and unfiltered. ``validate`` names the
    letters allowed; a record with others fails the query."""
    if lower and upper:
        raise ValueError("lower or upper, not both")
    hit = F.coalesce(matched, F.lit(False)) if matched is not None else F.lit(True)
    s, q = F.col("seq"), F.col("qual")
    if validate:
        s = F.when(hit & (F.length(F.translate(s, validate, "")) > 0), F.raise_error(F.concat(F.lit("invalid letter in "), F.col("id")))).otherwise(s)
    if remove_gaps:
        q = F.when(q.isNull() | (F.length(S.remove_gaps("seq", gap_letters)) == F.length("seq")), q).otherwise(_kept_quality(F.col("seq"), q, F.lit(gap_letters)))
        s = S.remove_gaps(s, gap_letters)
    out = df.withColumns({"_s": s, "_q": q})
    s, q, keep = F.col("_s"), F.col("_q"), F.lit(True)
    n = F.length(s)
    if min_len >= 0:
        keep = keep & (n >= min_len)
    if max_len >= 0:
        keep = keep & (n <= max_len)
    if min_qual > 0 or max_qual > 0:
        out = out.withColumn("_a", S.avg_qual("_q", qual_base))
        if min_qual > 0:
            keep = keep & (F.col("_a") >= min_qual)
        if max_qual > 0:
            keep = keep & (F.col("_a") < max_qual)
    if reverse:
        s, q = F.reverse(s), F.reverse(q)
    if complement:
        is_rna = s.contains("U") | s.contains("u")
        s = F.when(is_rna, S.complement(s, rna=True)).otherwise(S.complement(s))
    s = S.dna2rna(s) if dna2rna else s
    s = S.rna2dna(s) if rna2dna else s
    s = F.lower(s) if lower else F.upper(s) if upper else s
    fields = {"seq": F.when(hit, s).otherwise(F.col("seq")), "qual": F.when(hit, q).otherwise(F.col("qual"))}
    if only_id:
        fields["name"] = F.when(hit, F.col("id")).otherwise(F.col("name"))
    return out.where(~hit | keep).withColumns(fields).select(*df.columns)


@F.pandas_udf(StringType())
def _kept_quality(seq: pd.Series, qual: pd.Series, gaps: pd.Series) -> pd.Series:
    return pd.Series(["".join([q for c, q in zip(s, v) if c not in g]) if s is not None and v is not None else None for s, v, g in zip(seq, qual, gaps)])


def fq2fa(df: DataFrame) -> DataFrame:
    return df.withColumn("qual", F.lit(None).cast("string"))


def fx2tab(df: DataFrame, length=False, gc=False, gc_skew=False, base_count=(), base_content=(), case_sensitive=False, alphabet=False, avg_qual=False, qual_base=33, seq_hash=False, no_qual=False, only_id=False, only_name=False, file_name=False, basename=False) -> DataFrame:
    """name, seq, qual and the metrics asked for, in that order."""
    out = [F.col("id" if only_id else "name").alias("name")]
    if not only_name:
        out.append(F.col("seq"))
        if not no_qual:
            out.append(F.coalesce("qual", F.lit("")).alias("qual"))
    n = F.length("seq")
    out += [n.alias("length")] * length + [S.gc("seq").alias("gc")] * gc + [S.gc_skew("seq").alias("gc_skew")] * gc_skew
    out += [S.count_letters("seq", b, not case_sensitive).alias(f"count_{b}") for b in base_count]
    out += [S.share(S.count_letters("seq", b, not case_sensitive), n).alias(f"content_{b}") for b in base_content]
    out += [S.alphabet("seq").alias("alphabet")] * alphabet + [S.avg_qual("qual", qual_base).alias("avg_qual")] * avg_qual + [S.seq_hash("seq", case_sensitive).alias("seq_hash")] * seq_hash
    if file_name:
        out.append((F.regexp_extract("file", r"([^/]*)$", 1) if basename else F.col("file")).alias("file"))
    return df.select(*out)


def subseq(df: DataFrame, start: int, end: int, ids=(), region_coord=False) -> DataFrame:
    """The region of each record (of those with these ids); with ``region_coord`` its numbers as
    given go into the name."""
    out = df.where(F.col("id").isin(list(ids))) if ids else df
    fields = {"seq": S.subseq("seq", start, end), "qual": S.subseq("qual", start, end)}
    if region_coord:
        fields |= {"id": F.concat("id", F.lit(f":{start}-{end}")), "name": F.rtrim(F.concat("id", F.lit(f":{start}-{end} "), "desc"))}
    return out.withColumns(fields)


def sliding(df: DataFrame, step: int, window: int, greedy=False, circular=False, suffix="_sliding") -> DataFrame:
    """Windows at 1, 1 + step, ...; the last ones wrap (circular), are short (greedy) or are left out. An
    empty sequence has one empty window, 1-0, in greedy mode and none else."""
    if step < 1 or window < 1:
        raise ValueError("step and window are 1 or more")
    n = F.length("seq")
    last = n - 1 if circular else F.greatest(n - 1, F.lit(0)) if greedy else n - window
    at = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>")))
    src = df.where(n >= window) if circular else df
    out = src.withColumn("_i", at).withColumn("_e", F.when(F.col("_i") + window <= n, F.col("_i") + window).otherwise(F.col("_i") + window - n if circular else n))
    cut = lambda c: F.substring(F.concat(c, F.substring(c, 1, window)) if circular else F.col(c), F.col("_i") + 1, F.lit(window))
    new_id = F.concat("id", F.lit(suffix + ":"), F.col("_i") + 1, F.lit("-"), "_e")
    return out.withColumns({"seq": cut("seq"), "qual": cut("qual"), "id": new_id, "name": new_id, "desc": F.lit(""), "start": F.col("_i") + 1, "end": F.col("_e")}).drop("_i", "_e")


def translate(df: DataFrame, table: int = 1, frames=(1,), trim=False, clean=False, allow_unknown=False, init_as_m=False, append_frame=False, min_len=0, subseqs=False) -> DataFrame:
    """A protein record for each frame; frame 6 means all six. ``subseqs`` gives the runs between
    stops, with their places in the record."""
    frames = (1, 2, 3, -1, -2, -3) if 6 in frames else tuple(frames)
    out = df.withColumn("frame", F.explode(F.array(*[F.lit(f) for f in frames])))
    dna = F.translate(F.upper(F.when(F.col("frame") < 0, S.revcomp("seq")).otherwise(F.col("seq"))), "U", "T")
    out = out.withColumn("_dna", F.substring(dna, F.abs("frame"), F.length("seq"))).withColumn("_aa", S.translate("seq", F.col("frame"), table))
    aa = F.col("_aa")
    if init_as_m:
        starts = iupac.STARTS[table].split()
        aa = F.when(F.substring("_dna", 1, 3).isin(starts), F.concat(F.lit("M"), F.substring(aa, F.lit(2), F.length(aa)))).otherwise(aa)
    if not allow_unknown:
        aa = F.when(aa.contains("X"), F.raise_error(F.concat(F.lit("unknown codon in "), F.col("id")))).otherwise(aa)
    out = out.withColumn("_aa", aa)
    if subseqs:
        n = F.length("seq")
        run = F.explode(F.arrays_zip(F.split("_aa", r"\*").alias("part"), _run_starts(F.col("_aa")).alias("at")))
        out = out.withColumn("_r", run).withColumn("_aa", F.col("_r.part")).where(F.length("_aa") >= max(1, min_len))
        b = F.abs("frame") + 3 * F.col("_r.at")
        e = b + 3 * F.length("_aa") - 1
        out = out.withColumns({"begin": F.when(F.col("frame") > 0, b).otherwise(n - b + 1), "end": F.when(F.col("frame") > 0, e).otherwise(n - e + 1)})
        new_id = F.concat("id", F.lit("_frame="), "frame", F.lit("_begin="), "begin", F.lit("_end="), "end")
    else:
        new_id = F.concat("id", F.lit("_frame="), "frame") if append_frame else F.col("id")
    aa = F.col("_aa")
    aa = F.regexp_replace(aa, r"[X*]+$", "") if trim else aa
    aa = F.translate(aa, "*", "X") if clean else aa
    return out.withColumns({"seq": aa, "qual": F.lit(None).cast("string"), "id": new_id, "name": F.rtrim(F.concat(new_id, F.lit(" "), "desc"))}).drop("_dna", "_aa", "_r")


def _run_starts(aa: Column) -> Column:
    """Where each run between stops begins, from 0."""
    parts = F.split(aa, r"\*")
    return F.transform(parts, lambda x, i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y) + 1))


def codon_table(spark, number: int, ambiguous=False) -> DataFrame:
    code = iupac.ambiguous_code(number) if ambiguous else iupac.genetic_code(number)
    starts = set(iupac.STARTS[number].split())
    return spark.createDataFrame([(number, c, a, c in starts) for c, a in code.items()], "code int, codon string, amino string, initiation boolean")


def go_template(replacement: str) -> str:
    """A ``$1``/``${1}``/``$name``/``$$`` template in Java's grammar. ``$1x`` names a group "1x", which no
    pattern has, and so is empty."""
    out, i = [], 0
    for m in re.finditer(r"\$(?:\$|\{(\w+)\}|(\w+))", replacement):
        out.append(replacement[i : m.start()].replace("\\", "\\\\"))
        i = m.end()
        name = m[1] or m[2]
        out.append("\\$" if m[0] == "$$" else f"${name}" if name.isdigit() else f"${{{name}}}" if name[0].isalpha() else "")
    return "".join(out) + replacement[i:].replace("\\", "\\\\")


def replace(df: DataFrame, pattern: str, replacement: str = "", by_seq=False, ignore_case=False, kv: DataFrame | None = None, keep_untouched=False, keep_key=False, key_group=1, miss="", nr_width=1, matched: Column | None = None) -> DataFrame:
    """Edits names (or sequences) by a regular expression. In names ``{nr}`` is the record's number
    in its file, ``{fn}`` ``{fbn}`` ``{fbne}`` its file, and ``{kv}`` the value in ``kv`` (k, v) of the captured
    key: of a repeated k the one of the greatest ``n``, if there is that column, or else the greatest v."""
    java = ("(?i)" if ignore_case else "") + re.sub(r"\(\?P<", "(?<", pattern)
    hit = F.coalesce(matched, F.lit(False)) if matched is not None else F.lit(True)
    if by_seq:
        s = F.when(F.col("qual").isNotNull(), F.raise_error(F.lit("sequences of FASTQ records are not edited"))).otherwise(F.regexp_replace("seq", java, go_template(replacement)))
        return df.withColumn("seq", F.when(hit, s).otherwise(F.col("seq")))
    columns, template = df.columns, go_template(replacement)
    lower = template.lower()
    sign = F.lit(template)
    literal = lambda c: F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    put = lambda sign, key, value: F.replace(F.replace(sign, F.lit(key), value), F.lit(key.upper()), value)
    if "{nr}" in lower:
        df = numbered(df, "_nr", by=("file",))
        sign = put(sign, "{nr}", F.lpad(F.col("_nr").cast("string"), nr_width, "0") if nr_width > 1 else F.col("_nr").cast("string"))
        sign = F.when(F.length(F.col("_nr").cast("string")) > nr_width, put(F.lit(template), "{nr}", F.col("_nr").cast("string"))).otherwise(sign) if nr_width > 1 else sign
    base = F.regexp_extract("file", r"([^/]*)$", 1)
    for key, value in (("{uuid}", S.uuid7()), ("{fn}", F.col("file")), ("{fbne}", F.regexp_extract(base, r"^([^.]*)", 1)), ("{fbn}", base)):
        if key in lower:
            sign = put(sign, key, literal(value))
    if "{kv}" in lower:
        pairs = kv.groupBy("k").agg((F.max_by("v", "n") if "n" in kv.columns else F.max("v")).alias("_v")).withColumnRenamed("k", "_k")
        keys = F.regexp_extract_all("name", F.lit(java), F.lit(key_group))
        df = df.withColumn("_key", F.when(F.size(keys) == 1, F.element_at(keys, 1)).otherwise(F.when(F.size(keys) > 1, F.raise_error(F.lit("a name matches more than once")))))
        df = df.join(pairs, F.col("_key") == F.col("_k"), "left")
        found = F.coalesce(F.col("_v"), F.col("_key") if keep_key else F.lit(miss))
        sign = put(sign, "{kv}", literal(found))
        hit = hit & F.col("_key").isNotNull() & (F.col("_v").isNotNull() if keep_untouched else F.lit(True))
    df = df.withColumns({"_sign": sign, "_pat": F.lit(java)})
    new = F.when(hit, F.regexp_replace(F.col("name"), F.col("_pat"), F.col("_sign"))).otherwise(F.col("name"))
    return df.withColumn("name", new).withColumns({"id": S.seq_id("name"), "desc": S.seq_desc("name")}).select(*columns)


def rename(df: DataFrame, separator="_", start=2, first_too=False, by_name=False) -> DataFrame:
    """Repeated ids (or names) get a number."""
    from pyspark.sql import Window

    key = "name" if by_name else "id"
    order = [c for c in ("file_idx", "pos") if c in df.columns]
    out = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    number = F.col("_k") - (1 if first_too else 2) + (1 if first_too and start == 2 else start)
    new = F.when((F.col("_k") > 1) | F.lit(first_too), F.concat("id", F.lit(separator), number)).otherwise(F.col("id"))
    return out.withColumn("id", new).withColumn("name", F.rtrim(F.concat("id", F.lit(" "), "desc"))).drop("_k")


def selected(df: DataFrame, patterns, by_name=False, use_regexp=False, ignore_case=False, invert=False, out: str = "_hit") -> DataFrame:
    """``df`` with whether a record's id (or name) is one of the patterns, or is matched by one of the expressions. Patterns
    are a list, or a table (pattern) of any size that ids meet in a join; expressions are a list."""
    target = F.col("name" if by_name else "id")
    if use_regexp:
        # each in a group of its own, so that an alternative or an anchor stays within it
        hit = F.lit(False) if not patterns else target.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))
        return df.withColumn(out, F.coalesce(hit, F.lit(False)) != F.lit(invert))
    fold = F.lower if ignore_case else (lambda c: c)
    if isinstance(patterns, DataFrame):
        keys = patterns.select(fold(F.col("pattern")).alias("_pattern")).where("_pattern is not null").distinct()
        return df.join(keys, fold(target) == F.col("_pattern"), "left").withColumn(out, F.col("_pattern").isNotNull() != F.lit(invert)).drop("_pattern")
    hit = fold(target).isin([p.lower() if ignore_case else p for p in patterns])
    return df.withColumn(out, F.coalesce(hit, F.lit(False)) != F.lit(invert))


def mutate(df: DataFrame, points=(), deletion=None, insertion=None, matched: Column | None = None, patterns=None, **how) -> DataFrame:
    """Point mutations (position, base), then a deletion (start, end) or an insertion (position,
    bases; after it, 0 before all). Places out of range leave a record as it is, and so do records that
    ``patterns`` (with the options of ``selected``) do not choose."""
    if patterns is not None:
        marked = selected(df, patterns, **how)
        chosen = F.col("_hit") if matched is None else F.col("_hit") & matched
        return mutate(marked, points, deletion, insertion, chosen).drop("_hit")
    if how:
        raise TypeError(f"{', '.join(how)} without patterns")
    if deletion and insertion:
        raise ValueError("deletion or insertion, not both")
    s = F.col("seq")
    n = F.length("seq")
    cut = lambda x, a, b: F.substring(x, a, b)
    for p, base in points:
        at = F.lit(p) if p > 0 else n + (p + 1)
        s = F.when((at >= 1) & (at <= n), F.concat(cut(s, F.lit(1), at - 1), F.lit(base), cut(s, at + 1, n))).otherwise(s)
    if deletion:
        a, b, any_ = S.sub_location(n, *deletion)
        s = F.when(any_, F.concat(cut(s, F.lit(1), a - 1), cut(s, b + 1, n))).otherwise(s)
    if insertion:
        p, bases = insertion
        at = F.lit(p) if p >= 0 else n + (p + 1)
        s = F.when((at >= 0) & (at <= n), F.concat(cut(s, F.lit(1), at), F.lit(bases), cut(s, at + 1, n))).otherwise(s)
    hit = F.coalesce(matched, F.lit(False)) if matched is not None else F.lit(True)
    return df.withColumn("seq", F.when(hit & F.col("qual").isNull(), s).otherwise(F.col("seq")))


def restart(df: DataFrame, start: int | None = None, motif: str | None = None, ignore_case=False) -> DataFrame:
    """Rotates circular sequences to a position, or to a motif that occurs once; where only the
    minus strand has it, the reverse complement is given. Without a single place a record goes."""
    rotate = lambda s, at: F.concat(F.substring(s, at, F.length(s)), F.substring(s, F.lit(1), at - 1))
    if motif is None:
        n = F.length("seq")
        at = F.lit(start) if start > 0 else n + (start + 1)
        return df.where((at >= 1) & (at <= n)).withColumns({"seq": rotate(F.col("seq"), at), "qual": rotate(F.col("qual"), at)})
    fold = F.lower if ignore_case else (lambda c: c)
    m = F.lit(motif.lower() if ignore_case else motif)
    once = lambda s: F.floor((F.length(s) - F.length(F.replace(s, m, F.lit("")))) / len(motif)) == 1
    out = df.withColumns({"_f": fold(F.col("seq")), "_r": S.revcomp("seq")}).withColumn("_rf", fold(F.col("_r")))
    plus = F.col("_f").contains(m)
    out = out.where(F.when(plus, once(F.col("_f"))).otherwise(once(F.col("_rf"))))
    s = F.when(plus, rotate(F.col("seq"), F.instr("_f", m))).otherwise(rotate(F.col("_r"), F.instr("_rf", m)))
    q = F.when(plus, rotate(F.col("qual"), F.instr("_f", m))).otherwise(rotate(F.reverse("qual"), F.instr("_rf", m)))
    return out.withColumns({"seq": s, "qual": q}).drop("_f", "_r", "_rf")


def duplicate(df: DataFrame, times: int = 1) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))) if times > 0 else df.withColumn("copy", F.lit(0)).limit(0)


# -- quality encodings ------------------------------------------------------------------

#: (offset, least score, greatest score) of the encodings (fixed values).
ENCODINGS = {"Sanger": (33, 0, 40), "Solexa": (64, -5, 40), "Illumina-1.3+": (64, 0, 40), "Illumina-1.5+": (64, 2, 41), "Illumina-1.8+": (33, 0, 41)}


def convert(df: DataFrame, source: str, target: str = "Sanger", force=False) -> DataFrame:
    """Re-encodes qualities. From 1.8 to Sanger nothing changes unless ``force`` cuts scores to 40;
    score 2 of 1.5 becomes 0."""
    (a, low, _), (b, _, top) = ENCODINGS[source], ENCODINGS[target]
    if a == b and not (force or source == "Solexa" or target == "Solexa"):
        return df
    old, new = [], []
    for q in range(low, 63 if a == 64 else 94):
        score = float(q)
        if source == "Solexa" and target != "Solexa":
            score = 10 * np.log10(10 ** (q / 10) + 1)
        elif target == "Solexa" and source != "Solexa":
            score = -5.0 if q == 0 else max(-5.0, 10 * np.log10(10 ** (q / 10) - 1))
        if source == "Illumina-1.5+" and q == 2:
            score = 0.0
        score = int(np.floor(score + 0.5))
        score = min(score, 40) if force or b == 64 and target != "Illumina-1.5+" and score > top else score
        if chr(a + q).isprintable() and 33 <= b + score < 127:
            old.append(chr(a + q))
            new.append(chr(b + score))
    return df.withColumn("qual", F.translate("qual", "".join(old), "".join(new)))


def guess_encoding(df: DataFrame, records: int = 1000, b_most_common: int = 2, b_fraction: float = 0.1) -> list[str]:
    """Encodings that the first records' qualities allow; the query reads that many records only."""
    rows = [r["qual"] or "" for r in df.select("file_idx", "pos", "qual").orderBy("file_idx", "pos").limit(records).collect()]
    seen = [q for q in rows if q]
    if not seen:
        return []
    low, high = min(min(q) for q in seen), max(max(q) for q in seen)
    out = [n for n, (off, a, _) in ENCODINGS.items() if ord(low) >= off + a and ord(high) <= (74 if off == 33 and n == "Illumina-1.8+" else 73 if off == 33 else 105)]
    common = sum("B" in sorted(set(q), key=lambda c: -q.count(c))[:b_most_common] for q in seen) / len(seen)
    return ["Illumina-1.5+"] if "Illumina-1.5+" in out and common >= b_fraction else out


def guess_encodings(df: DataFrame, by=("file",), b_most_common: int = 2, b_fraction: float = 0.1) -> DataFrame:
    """``guess_encoding`` over all records of each group: (by, low, high, encodings), comma-joined in the order of
    ``ENCODINGS``. Ties between frequent letters go to the smaller one; groups without qualities have no row."""
    letters = F.array_distinct(F.filter(F.split("qual", ""), lambda c: c != ""))
    n = lambda c: F.length("qual") - F.length(F.replace(F.col("qual"), c, F.lit("")))
    b = n(F.lit("B"))
    before = F.size(F.filter(letters, lambda c: (n(c) > b) | ((n(c) == b) & (c < "B"))))
    frequent = (b > 0) & (before < b_most_common)
    told = df.where("qual <> ''").groupBy(*by).agg(F.min(F.ascii(F.array_min(letters))).alias("low"), F.max(F.ascii(F.array_max(letters))).alias("high"), F.avg(frequent.cast("int")).alias("_b"))
    top = lambda name, off: 74 if name == "Illumina-1.8+" else 73 if off == 33 else 105
    allowed = F.array_compact(F.array(*[F.when((F.col("low") >= off + least) & (F.col("high") <= top(name, off)), name) for name, (off, least, _) in ENCODINGS.items()]))
    one = F.array_contains(allowed, "Illumina-1.5+") & (F.col("_b") >= b_fraction)
    return told.select(*by, "low", "high", F.when(one, "Illumina-1.5+").otherwise(F.array_join(allowed, ",")).alias("encodings"))


def head_genome(df: DataFrame, min_words: int = 1) -> DataFrame:
    """The first records whose descriptions share their leading words with the first record's, as
    many as the second shares."""
    first = df.orderBy("file_idx", "pos").limit(2).select("desc", "file_idx", "pos").collect()
    if len(first) < 2:
        return df
    words = first[0]["desc"].split()
    shared = lambda d: next((i for i, (x, y) in enumerate(zip(words, d.split())) if x != y), min(len(words), len(d.split())))
    n = shared(first[1]["desc"])
    if n < min_words:
        return df.where((F.col("file_idx") == first[0]["file_idx"]) & (F.col("pos") == first[0]["pos"]))
    prefix = " ".join(words[:n])
    lead = F.array_join(F.slice(F.split("desc", r"\s+"), 1, n + 1), " ")
    follow = words[n] if n < len(words) else None
    same = (lead == prefix) | (lead.startswith(prefix + " ") & (F.lit(True) if follow is None else lead != f"{prefix} {follow}"))
    bad = df.where(~same & ~((F.col("file_idx") == first[0]["file_idx"]) & (F.col("pos") == first[0]["pos"]))).agg(F.min(F.struct("file_idx", "pos")).alias("b"))
    return df.crossJoin(F.broadcast(bad)).where(F.col("b").isNull() | (F.struct("file_idx", "pos") < F.col("b"))).drop("b")
