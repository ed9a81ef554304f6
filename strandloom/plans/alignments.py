"""Queries of alignment records: line items as alignments without letters, documents as reads with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bam
from .catalog import AVGQ, LANGS, REC, _ALN, alignments, query, r6, records

#: Left and right soft clips of the reads.
LEFT, RIGHT = "ACGT", "GG"


def reads(spark, sf_dir) -> DataFrame:
    """Each document as an aligned read: 4S, its letters, 2S; odd ids are on the minus strand."""
    r = records(spark, sf_dir)
    op = lambda n, o: F.struct(F.lit(o).alias("op"), F.lit(n).cast("int").alias("len") if isinstance(n, int) else n.cast("int").alias("len"))
    cigar = F.array(op(4, "S"), op(F.length("seq"), "M"), op(2, "S"))
    scores = F.transform(F.filter(F.split(F.concat(F.lit("IIII"), "qual", F.lit("55")), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    flags = F.when(F.col("pos") % 2 == 1, 16).otherwise(0)
    return r.select("file", F.col("id").alias("read"), F.col("file").alias("ref"), F.lit(5000).alias("ref_len"), F.col("pos").cast("int").alias("pos"), (F.length("seq") % 60).alias("mapq"), flags.alias("flags"), cigar.alias("cigar"), F.concat(F.lit(LEFT), "seq", F.lit(RIGHT)).alias("seq"), scores.alias("qual"), F.create_map(F.lit("NM"), F.lit("0")).alias("tags"))


@query(f"""WITH {_ALN} SELECT read AS "Read", ref AS "Ref", CAST(q - 1 AS INT) AS "MapQual", 100000 AS "RefLen", CAST(2 * q + 2 AS INT) AS "ReadAln", round(100.0 * (2 * q + 2) / (2 * q + 7), 6) AS "ReadCov", 1 AS "Strand", 2 AS "LeftClip", 3 AS "RightClip", 0 AS "RightSoftClip", 0 AS "LeftHardClip",
 CASE k WHEN 3 THEN 256 WHEN 4 THEN 2048 ELSE 0 END AS "Flags" FROM a""")
def bam_fields_more(spark, sf_dir):
    names = ("Read", "Ref", "MapQual", "RefLen", "ReadAln", "ReadCov", "Strand", "LeftClip", "RightClip", "RightSoftClip", "LeftHardClip", "Flags")
    return bam.fields(alignments(spark, sf_dir), names).withColumn("ReadCov", r6("ReadCov"))


_QUAL = AVGQ.replace("length(seq) = 0", "false").replace("/ length(seq)", "/ (length(seq) + 6)").replace("* 0.0001", "* 0.0001 + 4 * 0.0001 + 2 * 0.01", 1)


@query(f"""WITH {REC} SELECT id AS "Read", CASE WHEN pos % 2 = 1 THEN -1 ELSE 1 END AS "Strand", 'ACGT' || seq || 'GG' AS "ReadSeq", seq AS "ReadAlnSeq", 'ACGT' AS "LeftSoftClipSeq", 'GG' AS "RightSoftClipSeq", CAST(length(seq) AS INT) AS "ReadAln", round({_QUAL}, 6) AS "MeanQual" FROM r""")
def bam_read_letters(spark, sf_dir):
    return bam.fields(reads(spark, sf_dir), ("Read", "Strand", "ReadSeq", "ReadAlnSeq", "LeftSoftClipSeq", "RightSoftClipSeq", "ReadAln", "MeanQual")).withColumn("MeanQual", r6("MeanQual"))


@query(f"""WITH {REC} SELECT id AS "Read", CAST(length(seq) AS INT) AS "RefAln" FROM r ORDER BY length(seq) DESC, id LIMIT 100""")
def bam_top(spark, sf_dir):
    return bam.fields(bam.top(reads(spark, sf_dir), "RefAln", 100), ("Read", "RefAln"))


@query(f"""WITH {REC} SELECT round(100.0 * count(*) FILTER (100.0 * length(seq) / 5000 >= 8) / count(*), 6) AS share FROM r""")
def bam_coverage_share(spark, sf_dir):
    return bam.coverage_share(reads(spark, sf_dir), "RefCov", 8.0).withColumn("share", r6("share"))


@query(f"""WITH {REC} SELECT round(length(seq) / 100.0, 6) AS "RefCov", id AS "Read" FROM r WHERE length(seq) BETWEEN 200 AND 400 AND length(seq) % 60 >= 30 AND id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")
def bam_filters(spark, sf_dir):
    from .catalog import label_ids

    rows = bam.filters(reads(spark, sf_dir), map_qual=30, exclude=label_ids(spark, sf_dir), field="ReadAln", low=200, high=400)
    return bam.fields(rows, ("Read", "RefAln")).select("Read", r6(F.col("RefAln") / 100.0).alias("RefCov"))


@query(f"""WITH RECURSIVE {REC}, m AS (SELECT *, max(pos + length(seq)) OVER (PARTITION BY file ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
 l AS (SELECT file, id, sum(CASE WHEN before > pos THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY pos, id) AS locus FROM m), t AS (SELECT file, locus, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY locus) AS k FROM l GROUP BY file, locus),
 f AS (SELECT file, locus, k, 1 AS bundle, CASE WHEN n >= 20 THEN 0 ELSE n END AS have, CASE WHEN n >= 20 THEN 2 ELSE 1 END AS nxt FROM t WHERE k = 1
 UNION ALL SELECT t.file, t.locus, t.k, f.nxt, CASE WHEN f.have + t.n >= 20 THEN 0 ELSE f.have + t.n END, CASE WHEN f.have + t.n >= 20 THEN f.nxt + 1 ELSE f.nxt END FROM f JOIN t ON t.file = f.file AND t.k = f.k + 1)
 SELECT l.id AS read, l.file AS ref, CAST(bundle AS BIGINT) AS bundle FROM l JOIN f ON l.file = f.file AND l.locus = f.locus""")
def bam_bundle(spark, sf_dir):
    return bam.bundle(reads(spark, sf_dir), 20).select("read", "ref", "bundle")


@query(f"""WITH {REC} SELECT id, substr('ACGT' || seq || 'GG', pos % 9 + 1, 10) AS context FROM r WHERE contains(substr('ACGT' || seq || 'GG', pos % 9 + 1, 10), 'AT')""")
def bam_context(spark, sf_dir):
    """The reference letters around where each read begins: its own sequence is the reference here."""
    a = reads(spark, sf_dir).withColumns({"ref": F.col("read"), "pos": F.col("pos") % 9})
    refs = a.select(F.col("read").alias("id"), "seq")
    got = bam.aln_context(a.drop("seq").withColumn("seq", F.lit("*")), refs, left=0, right=10, regex_start="AT")
    return got.select(F.col("read").alias("id"), F.col("start_context").alias("context"))


@query(f"""WITH {REC} SELECT id AS read, 'ACGT' || seq || 'GG' AS seq, '4S' || length(seq) || 'M2S' AS cigar, CAST(pos AS INT) AS pos, CASE WHEN pos % 2 = 1 THEN 16 ELSE 0 END AS flags FROM r WHERE length(seq) > 0""")
def scan_sam(spark, sf_dir):
    """Alignments as SAM lines, read back; SAM has no operation of no letters."""
    from ..functions.layout import scratch_path
    from ..sources.alignments import as_sam, read_sam

    path = scratch_path(spark, "sam")
    as_sam(reads(spark, sf_dir).where("seq <> 'ACGTGG'")).write.option("compression", "gzip").text(path)
    text = F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return read_sam(spark, path).select("read", "seq", text.alias("cigar"), "pos", "flags")


def cigar_text():
    return F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), x["op"])), "").alias("cigar")


@query(f"""WITH {REC} SELECT id AS read, file AS ref, 5000 AS ref_len, 'ACGT' || seq || 'GG' AS seq, '4S' || length(seq) || 'M2S' AS cigar, CAST(pos AS INT) AS pos, CASE WHEN pos % 2 = 1 THEN 16 ELSE 0 END AS flags FROM r""")
def scan_bam(spark, sf_dir):
    """One BAM file of all reads, read by splits of 64 KB."""
    from ..functions.layout import scratch_path
    from ..sources.alignments import read_bam, write_bam

    path = scratch_path(spark, "bam") + ".bam"
    write_bam(reads(spark, sf_dir), [(lang, 5000) for lang in LANGS], path, single=True)
    return read_bam(spark, path, split_bytes=64 << 10).select("read", "ref", "ref_len", "seq", cigar_text(), "pos", "flags")


@query(f"""WITH {_ALN.replace(" WHERE l_linenumber <> 5", "")} SELECT read, ref, 100000 AS ref_len, CAST(pos AS INT) AS pos, q - 1 AS mapq, CASE k WHEN 3 THEN 256 WHEN 4 THEN 2048 WHEN 5 THEN 4 ELSE 0 END AS flags, '2S' || q || 'M2I3D' || q || 'M3H' AS cigar, '2' AS nm FROM a""")
def write_bam(spark, sf_dir):
    """A folder of BAM files, one a task, of all line items, read back; suppliers are the header's references."""
    from ..functions.layout import scratch_path
    from ..sources import alignments as L
    from .catalog import table

    path = scratch_path(spark, "bams")
    refs = [(str(r.s_suppkey), 100_000) for r in table(spark, sf_dir, "supplier").select("s_suppkey").orderBy("s_suppkey").collect()]
    L.write_bam(alignments(spark, sf_dir), refs, path)
    return L.read_bam(spark, path).select("read", "ref", "ref_len", "pos", "mapq", "flags", cigar_text(), F.col("tags")["NM"].alias("nm"))


_PLACED = "SELECT file AS ref, CASE WHEN pos % 7 = 0 THEN 0 ELSE 1 END AS placed, CASE WHEN pos % 5 = 0 THEN 0 ELSE 1 END AS mapped FROM r"


def indexed(spark, sf_dir) -> str:
    """A BAM file of which every seventh read has no place and every fifth of the others is not mapped, with an index of its counts."""
    from ..functions.layout import scratch_path
    from ..sources import alignments as L
    from ..sources import store

    path = scratch_path(spark, "indexed") + ".bam"
    out = F.col("pos") % 7 == 0
    placed = reads(spark, sf_dir).withColumn("flags", F.when(out | (F.col("pos") % 5 == 0), 4).otherwise(F.col("flags"))).withColumn("ref", F.when(~out, F.col("ref")).otherwise("*"))
    L.write_bam(placed, [(lang, 5000) for lang in LANGS], path, single=True)
    counts = L.read_bam(spark, path, split_bytes=64 << 10).groupBy("ref").agg(F.sum((~bam.flag(4)).cast("long")).alias("mapped"), F.sum(bam.flag(4).cast("long")).alias("unmapped"))
    told = {r.ref: (r.mapped, r.unmapped) for r in counts.collect()}  # a row for each reference of the header
    with store.open_new(path + ".bai") as f:
        f.write(L.encode_summary([told.get(lang) for lang in LANGS], sum(sum(n) for ref, n in told.items() if ref not in LANGS)))
    return path + ".bai"


@query(f"""WITH {REC}, p AS ({_PLACED}), t AS (SELECT count(*) FILTER (placed = 1 AND mapped = 1) AS a, count(*) FILTER (placed = 0) AS u FROM p) SELECT round(100.0 * a / (a + u), 6) AS "AlnPerc", a AS "Aligned", u AS "Unmapped", a + u AS "TotalRec" FROM t""")
def bam_index_stat(spark, sf_dir):
    from ..sources.alignments import index_stat

    return index_stat(spark, indexed(spark, sf_dir)).select(r6("AlnPerc").alias("AlnPerc"), "Aligned", "Unmapped", "TotalRec")


@query(f"""WITH {REC}, p AS ({_PLACED}) SELECT ref AS "Ref", count(*) FILTER (mapped = 1) AS "Count" FROM p WHERE placed = 1 GROUP BY 1""")
def bam_index_count(spark, sf_dir):
    from ..sources.alignments import index_count

    return index_count(spark, indexed(spark, sf_dir)).select("Ref", "Count")
