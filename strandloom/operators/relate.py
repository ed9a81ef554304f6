"""Set and join operators over several record DataFrames, told apart by ``file_idx``."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as S
from ..functions.layout import scratch_path
from . import embedded


def dedup_key(by_seq=False, by_name=False, ignore_case=False, only_positive=False) -> Column:
    """The key that makes records equal; by sequence the strands count as one."""
    c = F.col("seq" if by_seq else "name" if by_name else "id")
    c = F.lower(c) if ignore_case else c
    return S.strand_key(c) if by_seq and not only_positive else c


def _keyed(df: DataFrame, key: Column) -> DataFrame:
    """Long keys meet as 256-bit digests, which shuffle narrow."""
    return df.withColumn("_k", F.sha2(key.cast("binary"), 256))


def rmdup(df: DataFrame, **how) -> DataFrame:
    """The first record of each key. Only the key's digest and the order are aggregated; the
    records come back by a semi join, so a key that many share is combined before it moves."""
    keyed = _keyed(df, dedup_key(**how))
    first = keyed.groupBy("_k").agg(F.min(F.struct("file_idx", "pos")).alias("_f")).select(F.col("_f.file_idx").alias("_fi"), F.col("_f.pos").alias("_fp"))
    return df.join(first, (F.col("file_idx") == F.col("_fi")) & (F.col("pos") == F.col("_fp")), "left_semi")


def rmdup_rejected(df: DataFrame, **how) -> DataFrame:
    keyed = _keyed(df, dedup_key(**how))
    first = keyed.groupBy("_k").agg(F.min(F.struct("file_idx", "pos")).alias("_f")).select(F.col("_f.file_idx").alias("_fi"), F.col("_f.pos").alias("_fp"))
    return df.join(first, (F.col("file_idx") == F.col("_fi")) & (F.col("pos") == F.col("_fp")), "left_anti")


def rmdup_report(df: DataFrame, **how) -> DataFrame:
    """(count, ids in order) of every key that repeats, most frequent first. Keys are counted before any
    id is gathered; a key's ids are one value, as the report has them in one line."""
    keyed = _keyed(df, dedup_key(**how)).select("_k", "file_idx", "pos", "id")
    again = keyed.groupBy("_k").agg(F.count("*").alias("_n")).where("_n > 1").select("_k")
    rows = keyed.join(again, "_k", "left_semi").groupBy("_k").agg(F.count("*").alias("count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "pos", "id"))), lambda x: x["id"]), ", ").alias("ids"), F.min("pos").alias("_o"))
    return rows.orderBy(F.desc("count"), "_o").select("count", "ids")


def common(df: DataFrame, n_files: int, **how) -> DataFrame:
    """Records of the first file whose key occurs in all files."""
    if n_files < 2:
        raise ValueError("two files at least")
    keyed = _keyed(df, dedup_key(**how))
    shared = keyed.groupBy("_k").agg(F.count_distinct("file_idx").alias("_n"), F.min("file_idx").alias("_m")).where((F.col("_n") == n_files) & (F.col("_m") == 0)).select(F.col("_k").alias("_s"))
    return keyed.where("file_idx = 0").join(shared, F.col("_k") == F.col("_s"), "left_semi").drop("_k")


#: Texts that a task's list holds at most, and how long they are at most; others meet by anchors.
LISTED, SHORT = 100_000, 31


def _listed(df: DataFrame) -> tuple[list, int]:
    """((of, s) of the short texts, how long these are at most): as many lengths as ``LISTED`` has room for."""
    texts = df.where(F.length("s") <= SHORT).select("of", "s").distinct()
    room, longest = LISTED, 0
    for n, count in sorted(texts.groupBy(F.length("s")).count().collect()):  # a row for each length
        room -= count
        if room < 0:
            return texts.where(F.length("s") <= longest).collect(), longest
        longest = n
    return texts.collect(), SHORT


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: for rows that many jobs read."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _marked(told: DataFrame) -> np.ndarray:
    """A bit for each hash of ``told`` by its lower bits: 128 bits a row, 2**28 (32 MB) at most; with more rows more stretches pass."""
    bits = min(max((128 * told.count()).bit_length(), 16), 28)
    h = told.select(F.explode(F.array("anchor", "head", "tail", "whole")).alias("h"))
    piece = F.shiftrightunsigned("h", 16).bitwiseAND((1 << bits - 16) - 1)
    rows = h.select(piece.alias("piece"), F.col("h").bitwiseAND(65535).cast("int").alias("bit")).distinct()
    out = np.zeros((1 << bits - 16, 8192), np.uint8)
    for r in rows.groupBy("piece").applyInArrow(embedded.packed, "piece long, bits binary").collect():
        out[r.piece] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _contained(holders: DataFrame, held: DataFrame) -> DataFrame:
    """(key, of, b, step, n, len, tag) of every place where a text of ``held`` (tag, of, s) occurs in a record of
    ``holders`` (key, s) or in its reverse complement: n places on the + strand from b on, step letters apart.

    A text and its reverse complement meet + strands by hashes whose bits the holders' tasks have (``embedded``). What passes there meets
    by SHA-256 digests; no letters move, and neither does a place for each text that is like it in part."""
    told = held.select("tag", "of", F.col("s").rlike("[Uu]").alias("u"), F.posexplode(F.array("s", S.revcomp("s"))).alias("minus", "s"))
    # a text with a U is no reverse complement; any other is one of what its own is, with a U for a T as well
    told = told.where((F.col("minus") == 0) | ~F.col("u")).select("tag", "of", "minus", F.unhex(F.sha2("s", 256)).alias("digest"), "s")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema if f.name != "s")
    told = told.mapInArrow(embedded.told, f"{kind}, cls int, anchor long, head long, tail long, whole long")
    told = _stored(told.dropDuplicates(["of", "minus", "digest"]), "told")
    classes = sorted(r[0] for r in told.select("cls").distinct().collect())  # at most 31 numbers
    key = holders.schema["key"].dataType.simpleString()
    met = holders.select("key", "s").mapInArrow(embedded.places(classes, _marked(told)), f"key {key}, b int, step int, n int, len int, minus int, digest binary")
    return met.join(told.select("minus", "digest", "of", "tag"), ["minus", "digest"]).select("key", "of", "b", "step", "n", "len", "tag")


def common_embedded(df: DataFrame, n_files: int, ignore_case=False, min_len: int = 1) -> DataFrame:
    """Maximal stretches of first-file records that occur in every other file, where either the
    stretch is a whole record of that file or the whole first record lies within one, on either strand:
    (id, start, end, seq). Empty records have no stretch."""
    fold = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    rows = df.select("file_idx", "pos", "id", fold(F.col("seq")).alias("s")).where(F.length("s") >= max(1, min_len))
    rows = _stored(rows, "texts")
    first, others = rows.where("file_idx = 0"), rows.where("file_idx > 0")
    held = others.select(F.lit("").alias("tag"), F.col("file_idx").alias("of"), "s")
    short, longest = _listed(held)
    inner = _contained(first.select(F.col("pos").alias("key"), "s"), held.where(F.length("s") > longest))
    inner = inner.select(F.col("key").alias("pos"), "of", "b", "step", "n", "len")
    digest = F.unhex(F.sha2("s", 256))
    whole = first.select(digest.alias("tag"), F.lit(0).alias("of"), "s")
    few, most = _listed(whole)
    outer = _contained(others.select(F.struct("file_idx", "pos").alias("key"), "s"), whole.where(F.length("s") > most)).select("tag", F.col("key.file_idx").alias("of"))
    if few:
        outer = outer.union(others.select("file_idx", "s").mapInArrow(embedded.found_in([r.s for r in few]), "s string, of int").select(digest, "of"))
    outer = first.select("pos", digest.alias("tag"), F.length("s").alias("len")).join(outer.distinct(), "tag").select("pos", "of", *(F.lit(1).alias(c) for c in ("b", "step", "n")), "len")
    spans = inner.union(outer)
    if n_files == 2:
        each = spans.groupBy("pos").agg(F.collect_set(F.struct("b", "step", "n", "len")).alias("spans"))
        taken = first.join(each, "pos", "left").select("id", "s", "spans")
        return taken.mapInArrow(embedded.maximal_stretches([r.s for r in short]), "id string, start int, end int, seq string")
    by_file: dict[int, list[str]] = {}
    for r in short:
        by_file.setdefault(r.of, []).append(r.s)
    spans = spans.withColumn("b", F.explode(F.expr("sequence(b, b + step * (n - 1), step)"))).select("pos", "of", "b", (F.col("b") + F.col("len") - 1).alias("e"))
    spans = spans.union(first.select("pos", "s").mapInArrow(embedded.all_spans(by_file), "pos long, of int, b int, e int")).distinct()
    kept = spans.select("pos", "b", "e").distinct()
    before = lambda *by: F.max("e").over(Window.partitionBy(*by).orderBy("b", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1))
    maximal = lambda d, *by: d.withColumn("_b", before(*by)).where(F.col("_b").isNull() | (F.col("e") > F.col("_b"))).drop("_b")
    # a stretch counts if every other file has one that covers it
    wide = maximal(spans, "pos", "of").select(F.col("pos").alias("_p"), "of", F.col("b").alias("_wb"), F.col("e").alias("_we"))
    cover = kept.join(wide, (F.col("pos") == F.col("_p")) & (F.col("_wb") <= F.col("b")) & (F.col("_we") >= F.col("e")))
    kept = cover.groupBy("pos", "b", "e").agg(F.count_distinct("of").alias("_n")).where(F.col("_n") == n_files - 1).drop("_n")
    kept = maximal(kept, "pos").join(first.select("pos", "id", "s"), "pos")
    return kept.select("id", F.col("b").alias("start"), F.col("e").alias("end"), F.substring("s", F.col("b"), F.col("e") - F.col("b") + 1).alias("seq"))


def concat(files: list[DataFrame], separator="|", full=False, fill: str | None = None) -> DataFrame:
    """Records of equal id put one after the other, in all combinations. ``full`` keeps ids that
    some files lack; ``fill`` then stands for a lacking part, if a file's records have one length."""
    parts = []
    for i, f in enumerate(files):
        p = f.select(F.col("id"), F.col("seq").alias(f"s{i}"), F.col("qual").alias(f"q{i}"), F.col("desc").alias(f"d{i}"))
        parts.append(p)
    out = reduce(lambda a, b: a.join(b, "id", "full" if full else "inner"), parts)
    n = range(len(files))
    fills: list[tuple] = [("", "")] * len(files)
    if full and fill:
        sizes = [f.agg(F.min(F.length("seq")).alias("a"), F.max(F.length("seq")).alias("b")).first() for f in files]
        if all(s["a"] == s["b"] for s in sizes):
            fills = [(fill * (s["a"] or 0), "B" * (s["a"] or 0)) for s in sizes]
    has_q = reduce(lambda a, b: a | b, [F.col(f"q{i}").isNotNull() for i in n])
    no_q = reduce(lambda a, b: a | b, [F.col(f"q{i}").isNull() & F.col(f"s{i}").isNotNull() for i in n])
    seq = F.concat(*[F.coalesce(f"s{i}", F.lit(fills[i][0])) for i in n])
    seq = F.when(has_q & no_q, F.raise_error(F.lit("FASTA and FASTQ records are mixed"))).otherwise(seq)
    qual = F.when(has_q, F.concat(*[F.coalesce(f"q{i}", F.lit(fills[i][1])) for i in n]))
    given = F.array_compact(F.array(*[F.col(f"d{i}") for i in n]))
    desc = F.when(F.exists(given, lambda x: x != ""), F.array_join(given, separator)).otherwise("")
    out = out.select("id", desc.alias("desc"), seq.alias("seq"), qual.alias("qual"))
    return out.withColumn("name", F.rtrim(F.concat("id", F.lit(" "), "desc")))


def pair(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mates by id and occurrence: (pairs, unpaired of the first, unpaired of the second)."""
    w = Window.partitionBy("id").orderBy("file_idx", "pos")
    a, b = first.withColumn("_n", F.row_number().over(w)), second.withColumn("_n", F.row_number().over(w))
    r = b.select(F.col("id"), F.col("_n"), F.col("name").alias("name2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    pairs = a.join(r, ["id", "_n"]).drop("_n")
    return pairs, a.join(b, ["id", "_n"], "left_anti").drop("_n"), b.join(a, ["id", "_n"], "left_anti").drop("_n")


def fa2fq(fasta: DataFrame, fastq: DataFrame, only_positive=False) -> DataFrame:
    """The FASTQ slice of each FASTA record: the read of equal name that holds its sequence."""
    f = fasta.select("id", "name", "seq")
    q = fastq.select(F.col("name").alias("_n"), F.col("seq").alias("_s"), F.col("qual").alias("_q"))
    out = f.join(q, F.col("name") == F.col("_n"))
    plus = F.instr("_s", F.col("seq"))
    minus = F.lit(0) if only_positive else F.instr(S.revcomp("_s"), F.col("seq"))
    out = out.withColumns({"_p": plus, "_m": minus}).where("_p > 0 or _m > 0")
    n = F.length("seq")
    qual = F.when(F.col("_p") > 0, F.substring("_q", F.col("_p"), n)).otherwise(F.substring(F.reverse("_q"), F.col("_m"), n))
    return out.select("id", F.lit("").alias("desc"), F.col("id").alias("name"), "seq", qual.alias("qual"))


def by_features(df: DataFrame, features: DataFrame, up=0, down=0, only_flank=False, tag: str | None = None) -> DataFrame:
    """A record for each feature (chrom, start, end, name, strand) of a sequence: strand-aware flanks,
    cut to the sequence, the minus strand reverse-complemented."""
    if only_flank and (up > 0) == (down > 0):
        raise ValueError("one of up and down for flanks alone")
    f = features.select(F.col("chrom").alias("_c"), F.col("start").alias("_a"), F.col("end").alias("_b"), F.coalesce("strand", F.lit(".")).alias("_t"), F.coalesce("name", F.lit("")).alias("_n"))
    out = df.withColumn("_len", F.length("seq")).join(f, F.col("id") == F.col("_c"))
    minus, n = F.col("_t") == "-", F.col("_len")
    if only_flank:
        a_up, b_up = F.when(minus, F.col("_b") + 1).otherwise(F.col("_a") - up), F.when(minus, F.col("_b") + up).otherwise(F.col("_a") - 1)
        a_dn, b_dn = F.when(minus, F.col("_a") - down).otherwise(F.col("_b") + 1), F.when(minus, F.col("_a") - 1).otherwise(F.col("_b") + down)
        a, b = (a_up, b_up) if up > 0 else (a_dn, b_dn)
        note = f"_usf:{up}" if up > 0 else f"_dsf:{down}"
    else:
        a = F.when(minus, F.col("_a") - down).otherwise(F.col("_a") - up)
        b = F.when(minus, F.col("_b") + up).otherwise(F.col("_b") + down)
        note = (f"_us:{up}" if up > 0 else "") + (f"_ds:{down}" if down > 0 else "")
    out = out.withColumns({"_x": F.greatest(a, F.lit(1)), "_y": F.least(b, n)})
    cut = lambda c: F.when(F.col("_x") <= F.col("_y"), F.substring(c, F.col("_x"), F.col("_y") - F.col("_x") + 1)).otherwise(F.lit(""))
    s = F.when(minus, S.revcomp(cut("seq"))).otherwise(cut("seq"))
    q = F.when(F.col("qual").isNotNull(), F.when(minus, F.reverse(cut("qual"))).otherwise(cut("qual")))
    new = F.concat("id", F.lit("_"), "_a", F.lit("-"), "_b", F.lit(":"), "_t", F.lit(note))
    return out.withColumns({"seq": s, "qual": q, "id": new, "desc": F.col("_n"), "name": F.rtrim(F.concat(new, F.lit(" "), "_n"))}).drop("_c", "_a", "_b", "_t", "_n", "_x", "_y", "_len")


def gtf_features(gtf: DataFrame, features=(), chroms=(), tag="gene_id") -> DataFrame:
    """GTF rows as features, with an attribute as name; feature kinds in any case."""
    out = gtf
    if features:
        out = out.where(F.lower("feature").isin([f.lower() for f in features]))
    if chroms:
        out = out.where(F.col("seqname").isin(list(chroms)))
    return out.select(F.col("seqname").alias("chrom"), "start", "end", F.coalesce(F.col("attributes")[tag], F.lit("")).alias("name"), "strand")


def faidx(df: DataFrame, requests: list[str], regex=False, ignore_case=False, full_head=False) -> DataFrame:
    """Regions in the order asked: ``id``, ``id:b-e``, ``id:b``, ``id:b-``, ``id:-e``; b > e asks for the reverse
    complement."""
    import re

    rows = []
    for i, q in enumerate(requests):
        m = None if regex else re.fullmatch(r"(.+):(?:(\d+)-(\d+)|(\d+)-|-(\d+)|(\d+))", q)
        if not m:
            rows.append((i, q, None, None))
        elif m[2]:
            rows.append((i, m[1], int(m[2]), int(m[3])))
        elif m[4]:
            rows.append((i, m[1], int(m[4]), None))
        else:
            rows.append((i, m[1], 1 if m[5] else int(m[6]), int(m[5] or m[6])))
    req = F.broadcast(df.sparkSession.createDataFrame(rows, "_i int, _q string, _b int, _e int"))  # as many rows as the caller wrote
    key = F.col("name" if full_head else "id")
    if regex:
        on = F.expr(f"{'name' if full_head else 'id'} rlike concat('{'(?i)' if ignore_case else ''}', _q)")
    else:
        on = F.lower(key) == F.lower("_q") if ignore_case else key == F.col("_q")
    out = df.join(req, on)
    n = F.length("seq")
    e = F.least(F.coalesce("_e", n), n)
    b = F.col("_b")
    flip = F.col("_b") > F.coalesce("_e", n)
    lo, hi = F.when(flip, F.col("_e")).otherwise(b), F.when(flip, F.least(b, n)).otherwise(e)
    cut = lambda c: F.substring(c, lo, F.greatest(hi - lo + 1, F.lit(0)))
    s = F.when(b.isNull(), F.col("seq")).when(flip, S.revcomp(cut("seq"))).otherwise(cut("seq"))
    label = F.when(b.isNull(), key).otherwise(F.concat(key, F.lit(":"), b, F.lit("-"), F.coalesce("_e", n)))
    return out.select(F.col("_i").alias("request"), label.alias("name"), s.alias("seq")).orderBy("request", "name")
