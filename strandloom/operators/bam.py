"""Alignment records: fields, filters, counts, statistics, tool chains and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as S

UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 4, 16, 256, 2048


def flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(bit) != 0


def _op(i: int, op: str) -> Column:
    """The length of the i-th operation (from 1, or -1 the last) if it is ``op``; else 0."""
    x = F.try_element_at("cigar", F.lit(i))
    return F.coalesce(F.when(x["op"] == op, x["len"]), F.lit(0))


def _soft(first: int, second: int) -> Column:
    """An end's soft clip, within one hard clip."""
    outer = F.try_element_at("cigar", F.lit(first))["op"]
    return F.when(outer == "H", _op(second, "S")).otherwise(_op(first, "S"))


def _fields() -> dict[str, Column]:
    mapped = ~flag(UNMAPPED)
    query = S.cigar_sum("MIS=X")
    hard = _op(1, "H") + F.when(F.size("cigar") > 1, _op(-1, "H")).otherwise(0)
    read_len = F.when((F.col("seq") != "*") & (F.length("seq") > 0), F.length("seq") + hard).otherwise(query + hard)
    ref_aln = S.cigar_sum("MDN=X")
    soft = _soft(1, 2) + F.when(F.size("cigar") > 1, _soft(-1, -2)).otherwise(0)
    clips = hard + soft
    m, ins, dele = S.cigar_sum("M=X"), S.cigar_sum("I"), S.cigar_sum("D")
    al, nm = m + ins + dele, F.col("tags")["NM"].cast("int")
    mean_error = F.aggregate(F.transform("qual", lambda q: F.pow(F.lit(10.0), -q / 10.0)), F.lit(0.0), lambda a, x: a + x) / F.size("qual")
    left_s, right_s = _soft(1, 2), F.when(F.size("cigar") > 1, _soft(-1, -2)).otherwise(0)
    aln_len = F.length("seq") - soft
    return {
        "Read": F.col("read"), "Ref": F.col("ref"), "Pos": F.col("pos"), "EndPos": F.col("pos") + ref_aln, "MapQual": F.col("mapq"),
        "Acc": F.when(al > 0, (1 - nm / al) * 100).otherwise(0.0), "ReadLen": read_len, "RefLen": F.col("ref_len"), "RefAln": ref_aln,
        "RefCov": F.try_divide(ref_aln * 100.0, F.col("ref_len")), "ReadAln": F.when(mapped, read_len - clips).otherwise(0), "ReadCov": F.try_divide(100.0 * (read_len - clips), read_len),
        "Strand": F.when(flag(REVERSE), -1).otherwise(1), "MeanQual": F.when(F.size("qual") > 0, -10 * F.log10(mean_error)).otherwise(0.0),
        "LeftClip": _op(1, "H") + left_s, "RightClip": F.when(F.size("cigar") > 1, _op(-1, "H")).otherwise(0) + right_s, "LeftSoftClip": left_s, "RightSoftClip": right_s,
        "LeftHardClip": _op(1, "H"), "RightHardClip": F.when(F.size("cigar") > 1, _op(-1, "H")).otherwise(0), "Flags": F.col("flags"), "IsSec": flag(SECONDARY).cast("int"), "IsSup": flag(SUPPLEMENTARY).cast("int"),
        "Match": m - nm, "Mismatch": nm, "Ins": ins, "Del": dele, "AlnLen": al, "ReadSeq": F.col("seq"), "ReadAlnSeq": F.substring("seq", left_s + 1, aln_len),
        "LeftSoftClipSeq": F.substring("seq", F.lit(1), left_s), "RightSoftClipSeq": F.substring("seq", F.length("seq") - right_s + 1, right_s),
    }


def fields(df: DataFrame, names=("Read", "Ref", "Pos", "EndPos", "MapQual", "Acc")) -> DataFrame:
    """One column for each field of mapped records; a missing NM tag gives null."""
    known = _fields()
    return df.where(~flag(UNMAPPED)).select(*[known[n].alias(n) for n in names])


def filters(df: DataFrame, map_qual=0, prim_only=False, include: DataFrame | None = None, exclude: DataFrame | None = None, field=None, low=None, high=None) -> DataFrame:
    out = df.where(F.col("mapq") >= map_qual) if map_qual else df
    out = out.where(~flag(SECONDARY) & ~flag(SUPPLEMENTARY)) if prim_only else out
    if include is not None:
        out = out.join(include.select(F.col("pattern").alias("_p")), F.col("read") == F.col("_p"), "left_semi")
    if exclude is not None:
        out = out.join(exclude.select(F.col("pattern").alias("_p")), F.col("read") == F.col("_p"), "left_anti")
    if field:
        v = _fields()[field]
        out = out.where(v >= low) if low is not None else out
        out = out.where(v <= high) if high is not None else out
    return out


def count(df: DataFrame, map_qual=0, prim_only=False) -> DataFrame:
    """Ref, Count, SecCount, SupCount of mapped records, most frequent first."""
    rows = filters(df.where(~flag(UNMAPPED)), map_qual, prim_only)
    return rows.groupBy(F.col("ref").alias("Ref")).agg(F.count("*").alias("Count"), F.sum(flag(SECONDARY).cast("long")).alias("SecCount"), F.sum(flag(SUPPLEMENTARY).cast("long")).alias("SupCount")).orderBy(F.desc("Count"), "Ref")


def stat(df: DataFrame, map_qual=0, by: str = "file") -> DataFrame:
    """Counts by file: supplementary and secondary records first, then those of enough quality."""
    side = flag(SECONDARY) | flag(SUPPLEMENTARY)
    prim = ~side & ~flag(UNMAPPED) & (F.col("mapq") >= map_qual)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    rows = df.groupBy(by).agg(n(prim).alias("PrimAln"), n(flag(SECONDARY) & ~flag(SUPPLEMENTARY)).alias("SecAln"), n(flag(SUPPLEMENTARY)).alias("SupAln"), n(~side & flag(UNMAPPED)).alias("Unmapped"), F.count("*").alias("TotalRecords"), n(prim & (F.col("mapq") == 0)).alias("_m"))
    total = F.col("PrimAln") + F.col("Unmapped")
    return rows.select(S.share(F.col("PrimAln"), total).alias("PrimAlnPerc"), S.share(F.col("_m"), F.col("PrimAln")).alias("MultimapPerc"), "PrimAln", "SecAln", "SupAln", "Unmapped", total.alias("TotalReads"), "TotalRecords", F.col(by).alias("File"))


def coverage_share(df: DataFrame, field: str = "ReadCov", least: float = 80.0) -> DataFrame:
    """The percentage of mapped records whose field reaches ``least``, as a coverage histogram's title has it."""
    v = _fields()[field]
    return df.where(~flag(UNMAPPED)).agg(S.share(F.count(F.when(v >= least, 1)), F.count(v)).alias("share"))


def acc_stats(df: DataFrame) -> DataFrame:
    """Mean accuracy, and weighted by alignment length."""
    known = _fields()
    return df.where(~flag(UNMAPPED)).select(known["Acc"].alias("a"), known["AlnLen"].alias("n")).agg(F.avg("a").alias("AccMean"), F.try_divide(F.sum(F.col("a") * F.col("n")), F.sum("n")).alias("WeightedAccMean"))


def aln_context(df: DataFrame, refs: DataFrame, left=-10, right=10, regex_start=None, regex_end=None, stranded=False, invert=False) -> DataFrame:
    """Mapped records whose reference around their ends matches; with the contexts."""
    r = refs.select(F.col("id").alias("_r"), F.col("seq").alias("_s"))
    out = df.where(~flag(UNMAPPED)).join(r, F.col("ref") == F.col("_r"))
    around = lambda at: F.substring("_s", F.greatest(at + left, F.lit(0)) + 1, F.greatest(F.lit(0), F.least(at + right, F.length("_s")) - F.greatest(at + left, F.lit(0))))
    a, b = around(F.col("pos")), around(F.col("pos") + S.cigar_sum("MDN=X"))
    if stranded:
        a, b = F.when(flag(REVERSE), S.revcomp(b)).otherwise(a), F.when(flag(REVERSE), S.revcomp(a)).otherwise(b)
    out = out.withColumns({"start_context": a, "end_context": b})
    hit = F.lit(True)
    hit = hit & F.col("start_context").rlike(regex_start) if regex_start else hit
    hit = hit & F.col("end_context").rlike(regex_end) if regex_end else hit
    return out.where(~hit if invert else hit).drop("_r", "_s")


def top(df: DataFrame, field: str, k: int = 100) -> DataFrame:
    """The k records with the largest values of a field."""
    return df.orderBy(_fields()[field].desc(), "read").limit(k)


def reference_end() -> Column:
    return F.col("pos") + S.cigar_sum("MDN=X")


def locus_of(places: DataFrame) -> DataFrame:
    """(ref, pos, read, end, ..) with ``locus``; rows may be narrow, since a reference's are sorted in one task."""
    w = Window.partitionBy("ref").orderBy("pos", "read")
    out = places.withColumn("_before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return out.withColumn("locus", F.sum(F.when(F.col("_before") > F.col("pos"), 0).otherwise(1)).over(w)).drop("_before")


def loci(df: DataFrame) -> DataFrame:
    """Mapped records with ``locus``: overlapping alignments of a reference share one."""
    return locus_of(df.where(~flag(UNMAPPED)).withColumn("end", reference_end())).drop("end")


def bundle(df: DataFrame, least: int) -> DataFrame:
    """``bundle``: runs of whole loci with at least so many records; the fold goes over the table of
    loci, not over records."""
    import pandas as pd

    placed = loci(df)
    table = placed.groupBy("ref", "locus").agg(F.count("*").alias("n"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, have, b = pdf.sort_values("locus"), [], 0, 1
        for n in pdf["n"]:
            out.append(b)
            have += n
            if have >= least:
                b, have = b + 1, 0
        return pdf.assign(bundle=out)[["ref", "locus", "bundle"]]

    told = table.groupBy("ref").applyInPandas(fold, "ref string, locus long, bundle long")
    return placed.join(told, ["ref", "locus"])


def from_fish(hits: DataFrame, refs: DataFrame) -> DataFrame:
    """Hits of ``search.fish`` (with letters) as alignment records; the best of each query in a reference is
    primary, others are secondary. ``refs`` are the records searched, for their lengths."""
    best = F.row_number().over(Window.partitionBy("Ref", "Query").orderBy(F.desc("RawScore"), "RefStart", "Strand"))
    flags = F.when(best > 1, SECONDARY).otherwise(0) + F.when(F.col("Strand") == "-", REVERSE).otherwise(0)
    length, op = F.regexp_extract_all("Cigar", F.lit(r"(\d+)([MIDS])"), 1), F.regexp_extract_all("Cigar", F.lit(r"(\d+)([MIDS])"), 2)
    cigar = F.zip_with(op, length, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))
    at = refs.select(F.col("id").alias("Ref"), F.length("seq").alias("ref_len"))
    rows = hits.withColumns({"flags": flags, "cigar": cigar}).join(at, "Ref")
    return rows.select(F.lit("fish").alias("file"), F.col("Query").alias("read"), F.col("Ref").alias("ref"), "ref_len", F.col("RefStart").alias("pos"), F.round("MapQual").cast("int").alias("mapq"), "flags", "cigar", F.col("Letters").alias("seq"), F.array().cast("array<int>").alias("qual"), F.create_map(F.lit("NM"), F.col("Edits").cast("string")).alias("tags"))


TOOLS = {
    "AlnContext": lambda df, a: aln_context(df, a["Ref"], a.get("LeftShift", -10), a.get("RightShift", 10), a.get("RegexStart"), a.get("RegexEnd"), a.get("Stranded", False), a.get("Invert", False)),
    "AccStats": lambda df, a: acc_stats(df),
    "Dump": lambda df, a: fields(df, tuple(a.get("Fields", ("Read", "Ref", "Pos", "EndPos", "MapQual", "Acc", "Match", "Mismatch", "Ins", "Del", "AlnLen")))),
}


def tool_chain(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Named tools one after the other, each with its arguments: a chain that reporting tools end."""
    for name, arguments in steps:
        if name not in TOOLS:
            raise ValueError(f"no tool {name}; there are {', '.join(sorted(TOOLS))}")
        df = TOOLS[name](df, arguments)
    return df
