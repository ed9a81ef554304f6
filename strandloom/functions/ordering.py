"""Contiguous numbers and running sums without a single-partition window.

Positions are cut into shares of equal width; a share's total comes from a small aggregate, and a
window within each share does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import shared_dir


#: Files whose edges are broadcast; more meet their records in a shuffled join.
FEW = 10_000


def running(df: DataFrame, value: Column, out: str, by: tuple[str, ...] = (), pos: str = "pos", shares: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the running sum of ``value`` in the order of ``pos`` (numeric) within ``by``."""
    shares = shares or max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.lit(0).alias("_g"), *[F.col(b) for b in by]]
    edge = df.groupBy(*keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    on = F.lit(True)
    edge = edge.select(*[F.col(b).alias(f"_e_{b}") for b in by], "_lo", "_hi")
    # a row for each of ``by``: few files' edges are broadcast after they are counted, so that no sequence moves for them
    few = edge.limit(FEW + 1).collect()
    small = len(few) <= FEW
    edge = df.sparkSession.createDataFrame(few, edge.schema) if small else edge
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_e_{b}"))
    marked = df.join(F.broadcast(edge) if small else edge, on).drop(*[f"_e_{b}" for b in by])
    marked = marked.withColumn("_s", F.floor((F.col(pos) - F.col("_lo")).cast("double") * shares / (F.col("_hi") - F.col("_lo") + 1)).cast("int")).withColumn("_v", value).drop("_lo", "_hi")
    total = marked.groupBy(*by, "_s").agg(F.sum("_v").alias("_t"))
    before = total.withColumn("_b", F.coalesce(F.sum("_t").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(b).alias(f"_e_{b}") for b in by], F.col("_s").alias("_e_s"), "_b")
    on = F.col("_s") == F.col("_e_s")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_e_{b}"))
    within = Window.partitionBy(*by, "_s").orderBy(pos, *ties).rowsBetween(Window.unboundedPreceding, 0)
    before = F.broadcast(before) if small and len(few) * shares <= FEW * 64 else before
    return marked.withColumn("_w", F.sum("_v").over(within)).join(before, on).withColumn(out, F.col("_w") + F.col("_b")).select(*df.columns, out)


def numbered(df: DataFrame, out: str = "nr", by: tuple[str, ...] = (), pos: str = "pos", ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with 1-based record numbers in the order of ``pos``."""
    return running(df, F.lit(1).cast("long"), out, by, pos, ties=ties)


def ranked(df: DataFrame, *order, out: str = "rank") -> DataFrame:
    """``df`` with 1-based ranks in any order: one distributed sort, stored once; ranks are a
    partition's rows before plus the place in it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    placed = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_m", 33)
    sizes = placed.groupBy(part.alias("_p")).count()
    base = sizes.withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return placed.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn(out, F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).select(*df.columns, out)
