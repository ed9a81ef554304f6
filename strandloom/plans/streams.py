"""Queries that write the records of the driver tables into a folder and follow it as a stream until all is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions.layout import scratch_path
from ..sources import formats as X
from .catalog import REC, query, records


def grown(spark, sf_dir) -> str:
    """A folder of FASTQ files whose order by name, and within, is that of the records."""
    path = scratch_path(spark, "grown")
    X.write_fx(records(spark, sf_dir).orderBy("pos"), path)
    return path


@query(f"WITH {REC} SELECT name, seq, qual FROM r")
def follow_folder(spark, sf_dir):
    """Micro-batches of at most 64 MB, cut into splits of 64 KB that tasks share, written as they come."""
    path, out = scratch_path(spark, "followed"), scratch_path(spark, "progress")
    stream = streaming.follow(spark, grown(spark, sf_dir), regexp=r"part-.*\.txt$", maxBytes=64 << 20, splitBytes=64 << 10)
    running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", out).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(path).where("error is null").select("name", "seq", "qual")


EVERY = 40


@query(f"""WITH {REC}, n AS (SELECT floor(length(seq) / 100) * 100 AS bin, (row_number() OVER (ORDER BY pos) - 1) // {EVERY} AS k FROM r), w AS (SELECT DISTINCT k FROM n WHERE k < (SELECT count(*) // {EVERY} FROM n))
 SELECT CAST(k + 1 AS BIGINT) AS report, CAST(bin AS DOUBLE) AS bin, count(*) AS count FROM n JOIN w USING (k) GROUP BY 1, 2""")
def watch_reports(spark, sf_dir):
    """Histograms of lengths after every 40 records, each of the records since the one before, over several batches."""
    stream = streaming.follow(spark, grown(spark, sf_dir), regexp=r"part-.*\.txt$", maxBytes=32 << 20)
    reports = streaming.Reports(spark, scratch_path(spark, "reports"), F.length("seq"), 100, EVERY, reset=True)
    running = streaming.tee(stream, reports, checkpoint=scratch_path(spark, "progress"))
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return reports.table()
