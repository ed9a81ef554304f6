"""Order, limits, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as S
from ..functions.ordering import numbered, running


def head(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n records over all files: a top-n, without a full sort."""
    return df.orderBy("file_idx", "pos").limit(n)


def head_length(df: DataFrame, length: str | int) -> DataFrame:
    """The first records whose lengths reach a sum; the one that reaches it is kept."""
    least = S.parse_size(length) if isinstance(length, str) else length
    n = F.length("seq").cast("long")
    # files before in whole, then the running sum within each
    per_file = df.groupBy("file_idx").agg(F.sum(n).alias("_t"))
    before = per_file.select(F.col("file_idx").alias("_f"), F.coalesce(F.sum("_t").over(Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    out = running(df, n, "_c", by=("file_idx",)).join(before, F.col("file_idx") == F.col("_f"))
    return out.where(F.col("_c") + F.col("_b") - F.length("seq") < least).select(*df.columns)


def range_(df: DataFrame, start: int, end: int) -> DataFrame:
    """Records start to end of each file; both negative count from its end, and end -1 is the last."""
    if not (start > 0 and end > 0 or start > 0 and end == -1 or start < 0 and end < 0):
        raise ValueError(f"bad range {start}:{end}")
    out = numbered(df, "_n", by=("file_idx",))
    if start < 0 or end == -1:
        total = df.groupBy(F.col("file_idx").alias("_f")).agg(F.count("*").alias("_t"))
        out = out.join(total, F.col("file_idx") == F.col("_f"))
    lo = F.lit(start) if start > 0 else F.col("_t") + (start + 1)
    hi = F.lit(end) if end > 0 else F.col("_t") + (end + 1)
    return out.where((F.col("_n") >= lo) & (F.col("_n") <= hi)).select(*df.columns)


def sort_key(by: str = "id", natural=False, ignore_case=False, gaps: str = S.GAPS) -> Column:
    """by: id, name, seq, length or bases."""
    if by in ("length", "bases"):
        return F.length("seq") if by == "length" else F.length(S.remove_gaps("seq", gaps))
    c = F.lower(by) if ignore_case else F.col(by)
    return S.natural_key(c) if natural else c


def sort(df: DataFrame, by: str = "id", reverse=False, **how) -> DataFrame:
    key = sort_key(by, **how)
    return df.orderBy(key.desc() if reverse else key.asc(), "file_idx", "pos")


def draw(seed: int, *keys) -> Column:
    """A hash of position and seed: equal seeds draw alike, mates stay together, and partitions
    do not matter."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys or ("pos",)], F.lit(str(seed))))


def share_of(seed: int, *keys) -> Column:
    """``draw`` as a number from 0 to 1 (exclusive)."""
    return F.conv(F.substring(draw(seed, *keys), 1, 13), 16, 10).cast("double") / float(16**13)


def shuffle(df: DataFrame, seed: int = 23) -> DataFrame:
    return df.orderBy(draw(seed, "file_idx", "pos"), "file_idx", "pos")


def sample(df: DataFrame, proportion: float, seed: int = 11, keys=("pos",)) -> DataFrame:
    """About a proportion of the records."""
    return df.where(share_of(seed, *keys) <= proportion)


def sample_n(df: DataFrame, n: int, seed: int = 11, keys=("pos",)) -> DataFrame:
    """Exactly n records (or all), in input order: the n least draws, as a top-n of narrow rows
    that the records meet again."""
    chosen = df.select(F.col("file_idx").alias("_f"), F.col("pos").alias("_p"), draw(seed, *keys).alias("_d")).orderBy("_d", "_f", "_p").limit(n)
    return df.join(chosen, (F.col("file_idx") == F.col("_f")) & (F.col("pos") == F.col("_p")), "left_semi")


def sample_exact_share(df: DataFrame, proportion: float, seed: int = 11, keys=("pos",)) -> DataFrame:
    return sample_n(df, int(df.count() * proportion), seed, keys)


# -- splits: each adds ``part`` ---------------------------------------------------------


def split_size(df: DataFrame, size: int) -> DataFrame:
    return numbered(df, "_n").withColumn("part", (F.floor((F.col("_n") - 1) / size) + 1).cast("long")).drop("_n")


def split_parts(df: DataFrame, parts: int) -> DataFrame:
    """Contiguous parts of ceil(n / parts) records; there may be fewer."""
    n = df.count()
    return split_size(df, max(1, -(-n // parts)))


def split_round_robin(df: DataFrame, parts: int) -> DataFrame:
    return numbered(df, "_n").withColumn("part", (F.col("_n") - 1) % parts + 1).drop("_n")


def split_id(df: DataFrame, regexp: str = r"^(\S+)", ignore_case=False) -> DataFrame:
    c = F.regexp_extract("id", regexp, 1)
    return df.withColumn("part", F.lower(c) if ignore_case else c)


def split_region(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.withColumn("part", S.subseq("seq", start, end))


def split_length(df: DataFrame, length: str | int) -> DataFrame:
    """Parts that each hold at least so many bases: the record that reaches it closes a part. A fold
    with resets, so a file's (pos, length) rows go through one task in order, without their
    sequences, in batches; records then meet their parts again."""
    import pyarrow as pa

    least = S.parse_size(length) if isinstance(length, str) else length
    narrow = df.select("file_idx", "pos", F.length("seq").cast("long").alias("n")).repartition("file_idx").sortWithinPartitions("file_idx", "pos")

    def fold(batches):
        now, part, have = None, 1, 0
        for batch in batches:
            files, places, sizes = (c.to_pylist() for c in batch.columns)
            parts = []
            for f, n in zip(files, sizes, strict=True):
                if f != now:
                    now, part, have = f, 1, 0
                parts.append(part)
                have += n
                if have >= least:
                    part, have = part + 1, 0
            yield pa.RecordBatch.from_pydict({"_f": pa.array(files, pa.int32()), "_p": pa.array(places, pa.int64()), "part": pa.array(parts, pa.int64())})

    told = narrow.mapInArrow(fold, "_f int, _p long, part long")
    return df.join(told, (F.col("file_idx") == F.col("_f")) & (F.col("pos") == F.col("_p"))).drop("_f", "_p")


def split_pairs(first: DataFrame, second: DataFrame, split, *how) -> DataFrame:
    """Two files of mates split alike, told apart by ``read``: each by its own record numbers, so that
    mates in the same place go to the same part."""
    one, two = (split(f, *how).withColumn("read", F.lit(i)) for i, f in ((1, first), (2, second)))
    return one.unionByName(two)


def part_name(prefix: str, part: Column, width: int = 3, extension: str = "") -> Column:
    text = part.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text), F.lit(extension))


def first_id(df: DataFrame) -> DataFrame:
    """Each part's first id, for naming it: a small aggregate."""
    return df.groupBy("part").agg(F.min_by("id", F.struct("file_idx", "pos")).alias("name"))
