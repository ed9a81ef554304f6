"""Queries of pattern lists and of long sequences in chunks; benchmark items, as sequences, are the patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from .catalog import RC, REC, fasta, query, table

WIDTH = 12
_PAT = f"p AS (SELECT CAST(item_id AS VARCHAR) AS name, substr(s, 1, {WIDTH}) AS pat FROM (SELECT item_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS s FROM benchmark) WHERE length(s) >= {WIDTH})"
#: Every window of each record and strand, with its place on the + strand.
_WIN = f"""t AS (SELECT id, '+' AS strand, seq AS s, length(seq) AS n FROM r UNION ALL SELECT id, '-', {RC.format("seq")}, length(seq) FROM r),
 w AS (SELECT id, strand, substr(s, i, {WIDTH}) AS k, CASE strand WHEN '+' THEN i ELSE n - i - {WIDTH - 2} END AS a FROM (SELECT *, unnest(range(1, n - {WIDTH - 2})) AS i FROM t WHERE n >= {WIDTH}))"""
_ROW = f"""id AS "seqID", name AS "patternName", strand, CAST(a AS INT) AS start, CAST(a + {WIDTH - 1} AS INT) AS "end", k AS matched"""


def listed(spark, sf_dir) -> dict[str, str]:
    """The list that a caller has: the first letters of each benchmark item's sequence."""
    s = F.upper(F.regexp_replace("text", "[^ACGTacgt]", ""))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), s.alias("s")).where(F.length("s") >= WIDTH)
    return {r.name: r.s for r in rows.select("name", F.substring("s", 1, WIDTH).alias("s")).collect()}


@query(f"WITH {REC}, {_PAT} SELECT id FROM r WHERE EXISTS (SELECT 1 FROM p WHERE contains(seq, pat) OR contains({RC.format('seq')}, pat))")
def grep_list(spark, sf_dir):
    return search.grep(fasta(spark, sf_dir), list(listed(spark, sf_dir).values()), by_seq=True).select("id")


@query(f"WITH {REC}, {_PAT}, {_WIN} SELECT {_ROW} FROM w JOIN p ON k = pat")
def locate_list(spark, sf_dir):
    return search.locate(fasta(spark, sf_dir), listed(spark, sf_dir)).drop("pattern")


@query(f"WITH {REC}, {_PAT}, {_WIN} SELECT {_ROW} FROM w JOIN p ON k = pat")
def locate_chunks(spark, sf_dir):
    """The same, of sequences in chunks of 100 letters."""
    return search.locate(fasta(spark, sf_dir), listed(spark, sf_dir), chunk=100).drop("pattern")


@query(f"WITH {REC}, {_PAT}, {_WIN}, d AS (SELECT DISTINCT k FROM w), m AS (SELECT d.k AS near, p.name, p.pat FROM d JOIN p ON hamming(d.k, p.pat) <= 2) SELECT {_ROW} FROM w JOIN m ON k = near")
def locate_list_mismatch(spark, sf_dir):
    return search.locate(fasta(spark, sf_dir), listed(spark, sf_dir), chunk=1000, mismatches=2).drop("pattern")
