"""Statistics, digests and histograms."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as S
from ..functions import iupac


def stats(df: DataFrame, by: str = "file", kinds: bool = False) -> DataFrame:
    """Number, sum, least, mean and greatest length, by file; with ``kinds`` the format and type of its
    first record before these ("" for an empty sequence's type)."""
    n, at = F.length("seq").cast("long"), F.struct("file_idx", "pos")
    first = [F.min_by(F.when(F.col("qual").isNull(), "FASTA").otherwise("FASTQ"), at).alias("format"), F.min_by(F.coalesce(S.guess_type("seq"), F.lit("")), at).alias("type")] if kinds else []
    return df.groupBy(by).agg(*first, F.count("*").alias("num_seqs"), F.sum(n).alias("sum_len"), F.min(n).alias("min_len"), F.avg(n).alias("avg_len"), F.max(n).alias("max_len"))


def _lengths(df: DataFrame, by: str) -> DataFrame:
    """Each file's table of lengths, longest first, with running counts and sums: what quantiles
    need, and as small as the number of different lengths."""
    t = df.groupBy(by, F.length("seq").cast("long").alias("len")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(by)
    return t.withColumns({"cum": F.sum(F.col("len") * F.col("n")).over(w), "cnt": F.sum("n").over(w), "total": F.sum(F.col("len") * F.col("n")).over(every), "count": F.sum("n").over(every)})


def nx(df: DataFrame, percents=(50,), by: str = "file") -> DataFrame:
    """For each percentage x: nx (the length at which the lengths from the longest on reach x % of
    their sum) and lx (how many records that takes)."""
    t = _lengths(df, by)
    out = []
    for x in percents:
        hit = t.where(F.col("cum") * 100 >= F.col("total") * x)
        best = hit.groupBy(by).agg(F.max(F.struct("len", "cum", "cnt", "n", "total")).alias("b"))
        need = F.greatest(F.lit(1), F.ceil(F.try_divide(F.col("b.total") * x / 100.0 - (F.col("b.cum") - F.col("b.len") * F.col("b.n")), F.col("b.len"))))
        out.append(best.select(by, F.lit(float(x)).alias("x"), F.col("b.len").alias("nx"), (F.col("b.cnt") - F.col("b.n") + F.coalesce(need, F.lit(1))).cast("long").alias("lx")))
    res = out[0]
    for o in out[1:]:
        res = res.union(o)
    return res


def quartiles(df: DataFrame, by: str = "file") -> DataFrame:
    """q1, q2, q3 by inclusive hinges: an odd number's median belongs to both halves."""
    t = _lengths(df, by).withColumn("up", F.col("count") - F.col("cnt") + F.col("n")).withColumn("lo", F.col("up") - F.col("n"))
    n, h = F.col("count"), F.floor((F.col("count") + 1) / 2)

    def at(k: Column) -> Column:  # the k-th smallest length, from 1
        return F.max(F.when((F.col("lo") < k) & (F.col("up") >= k), F.col("len")))

    mid = lambda first, size: (at(first + F.floor((size + 1) / 2) - 1) + at(first + F.floor(size / 2))) / 2.0
    return t.groupBy(by).agg(mid(F.lit(1), h).alias("q1"), mid(F.lit(1), n).alias("q2"), mid(n - h + 1, h).alias("q3"))


def stats_all(df: DataFrame, by: str = "file", gaps: str = "- .", qual_base=33) -> DataFrame:
    """Basic statistics and quartiles, gaps, N50, Q20, Q30, mean quality, GC and unknown letters."""
    n = F.length("seq").cast("long")
    total = F.sum(n)
    prob = F.sum(F.when(F.col("qual").isNotNull(), S.error_sum("qual", qual_base)).otherwise(0.0))
    with_qual = F.sum(F.when(F.col("qual").isNotNull(), n).otherwise(0))
    base = df.groupBy(by).agg(
        F.count("*").alias("num_seqs"), total.alias("sum_len"), F.min(n).alias("min_len"), F.avg(n).alias("avg_len"), F.max(n).alias("max_len"),
        F.sum(S.count_letters("seq", gaps, False)).cast("long").alias("sum_gap"), F.sum(S.count_letters("seq", "N")).cast("long").alias("sum_n"),
        S.share(F.sum(F.coalesce(S.q_count("qual", 20, qual_base), F.lit(0))), total).alias("q20"), S.share(F.sum(F.coalesce(S.q_count("qual", 30, qual_base), F.lit(0))), total).alias("q30"),
        F.when(with_qual > 0, -10 * F.log10(F.try_divide(prob, with_qual))).otherwise(0.0).alias("avg_qual"), S.share(F.sum(S.count_letters("seq", "GC")), total).alias("gc"),
    )
    n50 = nx(df, (50,), by).select(by, F.col("nx").alias("n50"), F.col("lx").alias("n50_num"))
    return base.join(quartiles(df, by), by).join(n50, by, "left")


# -- order-independent digest -------------------------------------------------------------


def _ordered(h: int) -> int:
    """An unsigned 64-bit number as a signed one of the same order."""
    return h - (1 << 63)


def _xx(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, 0)


def digest_sum(df: DataFrame, by: str = "file", circular=False, k: int = 1000, remove_gaps=False, gaps="- \t.*", rna2dna=False, single_strand=False, kind="DNA", every=False) -> DataFrame:
    """A digest of each file's sequences that does not depend on their order (nor, for circular ones,
    on start and strand): XXH64 of each sequence, sorted, hashed together with the length and number.
    Hashes are made by record and sorted by Spark, which spills; a file's digest is a chain over its
    sorted hashes, so that one task streams them, 8 bytes a record (or base) and a batch at a time."""
    letter = {"DNA": "D", "RNA": "R", "Protein": "P"}.get(kind, "N")

    @F.pandas_udf("array<bigint>")
    def hashes(seq: pd.Series) -> pd.Series:
        out = []
        for s in seq:
            raw = (s or "").encode()
            if not circular:
                out.append([_ordered(_xx(raw))])
                continue
            if len(raw) < k:
                raise ValueError("a sequence is shorter than k")
            both, rc = raw + raw[: k - 1], iupac.revcomp(s).encode()
            back = rc + rc[: k - 1]
            n = len(raw)
            own = [_xx(both[i : i + k]) for i in range(n)]
            if not single_strand:
                other = [_xx(back[i : i + k]) for i in range(n)]
                own = [min(own[i], other[(n - i - k) % n]) for i in range(n)]
            out.append([_ordered(h) for h in own])
        return pd.Series(out)

    s = F.lower(F.coalesce("seq", F.lit("")))
    s = F.translate(s, gaps, "") if remove_gaps else s
    s = F.translate(s, "u", "t") if rna2dna and kind != "RNA" else s
    rows = df.select(F.col(by), s.alias("s")).select(by, F.length("s").cast("long").alias("n"), F.posexplode(hashes("s")).alias("i", "h")).select(by, "h", F.when(F.col("i") == 0, F.col("n")).alias("n"))
    prefix = f"v0.1_{letter}{'C' if circular else 'L'}{'S' if single_strand or not circular else 'D'}_k{k if circular else 0}_"

    def fold(batches):
        import xxhash

        now, state, total, count = None, None, 0, 0

        def close():
            state.update(struct.pack("<QQ", total, count))
            told = prefix + hashlib.md5(struct.pack("<Q", state.intdigest())).hexdigest()
            return pa.RecordBatch.from_arrays([now, pa.array([told]), pa.array([count], pa.int64()), pa.array([total], pa.int64())], names=[by, "digest", "num_seqs", "sum_len"])

        for batch in batches:
            keys = batch.column(0)
            at = 0
            while at < batch.num_rows:
                end = at + 1
                while end < batch.num_rows and keys[end] == keys[at]:
                    end += 1
                if now is None or now[0] != keys[at]:
                    if now is not None:
                        yield close()
                    now, state, total, count = keys.slice(at, 1), xxhash.xxh64(seed=0), 0, 0
                part = batch.slice(at, end - at)
                state.update((part.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)).astype("<u8").tobytes())
                count += part.num_rows - part.column(2).null_count
                total += pa.compute.sum(part.column(2)).as_py() or 0
                at = end
        if now is not None:
            yield close()

    kind_of = dict(df.dtypes)[by]
    out = rows.repartition(by).sortWithinPartitions(by, "h").mapInArrow(fold, f"`{by}` {kind_of}, digest string, num_seqs long, sum_len long")
    return out if every else out.select("digest", by)


# -- histograms ---------------------------------------------------------------------------


FIELDS = {
    "ReadLen": lambda: F.length("seq").cast("double"),
    "MeanQual": lambda: S.avg_qual("qual"),
    "GC": lambda: S.share(S.count_letters("seq", "GC"), F.length("seq")),
    "GCSkew": lambda: S.share(S.count_letters("seq", "G") - S.count_letters("seq", "C"), F.length("seq")),
}


def histogram(df: DataFrame, value: Column, width: float, by=(), log=False) -> DataFrame:
    """Counts of values in bins of a width: (bin start, count)."""
    v = F.log10(value + 1) if log else value
    return df.groupBy(*by, (F.floor(v / width) * width).alias("bin")).agg(F.count("*").alias("count"))


def watch(df: DataFrame, field: str = "ReadLen", width: float = 100.0, log=False) -> DataFrame:
    return histogram(df, FIELDS[field](), width, log=log)


def merge_slides(windows: DataFrame, max_gap: int = 0, min_overlap: int = 1, regexp: str = r"^(.+)_sliding:(\d+)\-(\d+)") -> DataFrame:
    """Merged regions (chrom, start from 0, end) of window names in order (name, pos)."""
    w = windows.select("pos", F.regexp_extract("name", regexp, 1).alias("chrom"), F.regexp_extract("name", regexp, 2).alias("b"), F.regexp_extract("name", regexp, 3).alias("e")).where("b <> ''")
    w = w.withColumns({"b": F.col("b").cast("int"), "e": F.col("e").cast("int")})
    return merge_intervals(w, max_gap, min_overlap)


def merge_intervals(w: DataFrame, max_gap: int = 0, min_overlap: int = 1) -> DataFrame:
    """As ``merge_slides`` for (chrom, b, e, pos)."""
    order = Window.partitionBy("chrom").orderBy("pos")
    more = (F.col("b") + (min_overlap - 1) <= F.lag("e").over(order)) & (F.lit(True) if max_gap == 0 else F.col("b") - F.lag("b").over(order) <= max_gap)
    w = w.withColumn("new", F.when(more, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    return w.groupBy("chrom", "island").agg((F.min_by("b", "pos") - 1).alias("start"), F.max_by("e", "pos").alias("end"), F.min("pos").alias("pos")).select("chrom", "start", "end")
