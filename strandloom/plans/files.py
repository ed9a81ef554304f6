"""Queries that write the records of the driver tables in a file format and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import scratch_path
from ..operators import order as O
from ..operators import relate as R
from ..operators import transform as T
from ..sources import faidx, store
from ..sources import formats as X
from .catalog import FEAT, RC, REC, fasta, features, query, records, table


def lines(df: DataFrame, spark, tag: str, one_file=False, compression="none") -> str:
    """The path of a folder of text files with the rows of ``df`` (value) as lines."""
    path = scratch_path(spark, tag)
    (df.coalesce(1) if one_file else df).write.option("compression", compression).text(path)
    return path


@query(f"WITH {REC} SELECT id, descr, seq FROM r")
def scan_fasta_gz(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    X.write_fx(fasta(spark, sf_dir), path, compression="gzip")
    return X.read_fasta(spark, path).select("id", F.col("desc").alias("descr"), "seq")


@query(f"WITH {REC} SELECT name, seq, qual FROM r")
def scan_fastq_gz(spark, sf_dir):
    path = scratch_path(spark, "fastq")
    X.write_fx(records(spark, sf_dir), path, compression="gzip")
    return X.read_fastq(spark, path).select("name", "seq", "qual")


@query(f"WITH {REC} SELECT name, seq, translate(seq, 'ACGT', '@?5+') AS qual FROM r")
def scan_fastq_split(spark, sf_dir):
    """One file, cut into many tasks; half the letters have the quality that headers begin with."""
    path = scratch_path(spark, "fastq")
    X.write_one(records(spark, sf_dir).withColumn("qual", F.translate("seq", "ACGT", "@?5+")), path)
    return X.read_fastq_lines(spark, path).select("name", "seq", "qual")


@query(f"WITH {REC} SELECT name, seq, nullif(qual, '') AS qual FROM r")
def scan_tab(spark, sf_dir):
    path = scratch_path(spark, "tab")
    X.write_tsv(T.fx2tab(records(spark, sf_dir)), path, header=False, compression="gzip")
    return X.read_tab(spark, path).select("name", "seq", "qual")


@query(f"WITH {REC} SELECT id, file AS source FROM r")
def scan_folder(spark, sf_dir):
    """A folder for each source file, found by a regular expression; their records are one union."""
    path = scratch_path(spark, "folder")
    X.write_fx(fasta(spark, sf_dir).withColumn("part", F.col("file")), path, by_part=True)
    found = X.list_files(spark, path, r"\.txt$")
    return X.read_fasta(spark, found).select("id", F.regexp_extract("file", "part=([a-z]+)", 1).alias("source"))


@query(f"WITH {REC} SELECT count(*) AS records FROM r")
def scan_list(spark, sf_dir):
    path = scratch_path(spark, "listed")
    X.write_fx(fasta(spark, sf_dir), path)
    names = spark.createDataFrame([(p,) for p in X.list_files(spark, path, r"\.txt$")], "value string")
    return X.read_fasta(spark, X.read_list(spark, lines(names, spark, "list", True))).agg(F.count("*").alias("records"))


@query(f"WITH {FEAT} SELECT chrom, a AS start, b AS \"end\", fname AS name, strand FROM f")
def scan_bed(spark, sf_dir):
    bed = features(spark, sf_dir).select(F.concat_ws("\t", "chrom", F.col("start") - 1, "end", "name", F.lit("0"), "strand").alias("value"))
    return X.read_bed(spark, lines(bed, spark, "bed", compression="gzip"))


@query(f"WITH {FEAT} SELECT chrom, a AS start, b AS \"end\", 'g' || fname AS name, strand FROM f WHERE strand = '-'")
def scan_gtf(spark, sf_dir):
    f = features(spark, sf_dir)
    gtf = f.select(F.concat_ws("\t", "chrom", F.lit("x"), F.when(F.col("strand") == "-", "CDS").otherwise("exon"), "start", "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit('transcript_id "t"; gene_id "g'), "name", F.lit('";'))).alias("value"))
    return R.gtf_features(X.read_gtf(spark, lines(gtf, spark, "gtf")), features=["cds"])


@query("SELECT CAST(n_regionkey AS VARCHAR) AS k, max_by(n_name, n_nationkey) AS v FROM nation GROUP BY n_regionkey")
def scan_kv(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    return X.read_kv(spark, lines(rows.select(F.concat_ws("\t", "n_regionkey", "n_name").alias("value")), spark, "kv"))


@query(f"WITH {REC} SELECT id FROM r WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def scan_patterns(spark, sf_dir):
    from ..operators.search import grep_ids

    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("value"))
    return grep_ids(fasta(spark, sf_dir), X.read_patterns(spark, lines(ids, spark, "ids"))).select("id")


@query("SELECT p_brand AS name, count(*) AS primers, min(p_type) AS forward FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY 1")
def scan_primers(spark, sf_dir):
    """Primer files are short and written by hand: one of brands and types stands for one."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    rows = X.read_primers(spark, lines(p.select(F.concat_ws("\t", "p_brand", "p_type").alias("value")), spark, "primers"))
    out = spark.createDataFrame(rows, "name string, forward string, reverse string").where("reverse = ''")
    return out.groupBy("name").agg(F.count("*").alias("primers"), F.min("forward").alias("forward"))


@query(f"WITH {REC} SELECT id, CAST((row_number() OVER (ORDER BY pos) - 1) // ((SELECT count(*) + 6 FROM r) // 7) + 1 AS BIGINT) AS part FROM r")
def split_files(spark, sf_dir):
    """A folder of files for each part, read back."""
    path = scratch_path(spark, "split")
    X.write_fx(O.split_parts(fasta(spark, sf_dir), 7), path, by_part=True)
    return X.read_fasta(spark, path).select("id", F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"))


@query(f"WITH {REC} SELECT id, CAST(length(seq) AS BIGINT) AS length FROM r")
def write_tsv(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    X.write_tsv(T.fx2tab(fasta(spark, sf_dir), only_id=True, only_name=True, length=True), path, compression="gzip")
    return spark.read.option("sep", "\t").option("header", True).csv(path).select(F.col("name").alias("id"), F.col("length").cast("long").alias("length"))


@query(f"WITH {REC} SELECT id, seq FROM r")
def scan_stream(spark, sf_dir):
    """The records as an open text stream on the driver, as standard input is of a file that tasks wrote."""
    path = scratch_path(spark, "stdin")
    X.write_one(fasta(spark, sf_dir), path)
    with open(store.at(path)[1]) as stream:
        return X.from_stream(spark, stream, batch=5000).select("id", "seq")


@query(f"""WITH {REC}, q AS (SELECT CAST(i AS VARCHAR) AS id FROM generate_series(0, 49) t(i)) SELECT id || ':' || 5 || '-' || least(70, length(seq)) AS name, substr(seq, 5, least(70, length(seq)) - 4) AS seq FROM r JOIN q USING (id) WHERE length(seq) >= 5""")
def faidx_ranges(spark, sf_dir):
    """Fifty regions, as a caller writes them, asked of a folder of files by their index."""
    return faidx.read_ranges(given(spark, sf_dir), faidx.requests(spark, [f"{i}:5-70" for i in range(50)])).select(F.concat(F.substring_index("name", "-", 1), F.lit("-"), F.length("seq") + 4).alias("name"), "seq").where("seq <> ''")


def given(spark, sf_dir) -> DataFrame:
    """The index of files that many tasks wrote, wrapped at 60."""
    path = scratch_path(spark, "given")
    X.write_fx(fasta(spark, sf_dir).withColumn("name", F.col("id")), path)
    return faidx.index_files(spark, path)


@query(f"WITH {REC} SELECT id AS name, CAST(length(seq) AS BIGINT) AS length, CAST(least(length(seq), 60) AS BIGINT) AS line_bases, CAST(least(length(seq), 60) + 1 AS BIGINT) AS line_width FROM r")
def faidx_given(spark, sf_dir):
    return given(spark, sf_dir).select("name", "length", "line_bases", "line_width")


@query(f"WITH {REC}, q AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS request, CAST(l_partkey % (SELECT count(*) FROM documents) AS VARCHAR) AS id, 1 + l_suppkey % 90 AS a, 1 + l_partkey % 70 AS b FROM lineitem) SELECT request, CASE WHEN a > b THEN {RC.format('substr(seq, b, a - b + 1)')} ELSE substr(seq, a, b - a + 1) END AS seq FROM r JOIN q USING (id)")
def faidx_table(spark, sf_dir):
    """A region for each line item, many of the minus strand, as a table of requests."""
    n = table(spark, sf_dir, "documents").count()
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("request"), (F.col("l_partkey") % n).cast("string").alias("name"), (F.col("l_suppkey") % 90 + 1).cast("long").alias("first"), (F.col("l_partkey") % 70 + 1).cast("long").alias("last"))
    return faidx.read_ranges(given(spark, sf_dir), asked).select("request", "seq")
