"""Long sequences in overlapping chunks, so that one chromosome is many tasks' work.

A chunk has the letters of a record from ``at`` on, ``length`` of its own and then ``overlap`` of the next ones, which of a circular
record go on at its beginning. A hit belongs to the chunk whose own letters have its first letter on the + strand, so that with an
overlap of one less than the longest hit each hit is found once and whole. Records are cut as bytes, each cut at its
own cost, and chunks are dealt over the cluster by (record, place): letters move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks(df: DataFrame, length: int, overlap: int, circular: bool = False, dealt: bool = True) -> DataFrame:
    """(file_idx, pos, id, n, at, own, letters): n is the record's length, ``own`` how many letters the chunk owns. Sequences
    must be of one-byte letters, as all codes are; empty and null ones have no chunk."""
    if length < 1 or overlap < 0:
        raise ValueError("chunks have letters")
    raw = F.col("seq").cast("binary")
    rows = df.select("file_idx", "pos", "id", raw.alias("raw"), F.length(raw).alias("n")).where("n > 0")
    cut = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(length))))
    own = F.least(F.lit(length), F.col("n") - F.col("at"))
    piece = F.substring("raw", F.col("at") + 1, F.lit(length + overlap))
    if circular:  # what the end lacks, from the beginning, as often as it takes
        lack = F.greatest(F.lit(0), own + overlap - F.length(piece))
        whole = (F.ceil(lack / F.col("n")) + 0).cast("int")
        around = F.substring(F.repeat(F.substring("raw", 1, overlap + length).cast("string"), whole).cast("binary"), F.lit(1), lack)
        piece = F.when(lack > 0, F.concat(piece, around)).otherwise(piece)
    out = cut.select("file_idx", "pos", "id", "n", "at", own.alias("own"), piece.cast("string").alias("letters"))
    return out.repartition("file_idx", "pos", "at") if dealt else out


def slice_of(seq: Column, start: Column, end: Column) -> Column:
    """Letters start (0-based) to end, at the cost of the cut."""
    return F.substring(seq.cast("binary"), start + 1, end - start).cast("string")
