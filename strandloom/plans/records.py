"""More queries of sequence records: kinds, gaps, flanks, mismatching amplicons, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as S
from ..functions import iupac
from ..functions.ordering import ranked
from ..operators import aggregate as A
from ..operators import order as O
from ..operators import relate as R
from ..operators import search as Q
from ..operators import transform as T
from .catalog import FEAT, RC, REC, _HAM, fasta, features, query, records, table


@query(f"""WITH {REC}, k AS (SELECT file, min_by(seq, pos) AS s FROM r GROUP BY file) SELECT r.file, 'FASTQ' AS format, CASE WHEN s = '' THEN '' ELSE 'DNA' END AS type, count(*) AS num_seqs, CAST(sum(length(seq)) AS BIGINT) AS sum_len FROM r JOIN k USING (file) GROUP BY r.file, s""")
def stats_kinds(spark, sf_dir):
    return A.stats(records(spark, sf_dir), kinds=True).select("file", "format", "type", "num_seqs", "sum_len")


@query("""SELECT doc_id AS pos, CASE WHEN coalesce(text, '') = '' THEN NULL WHEN regexp_full_match(text, '(?i)[acgtrymkswhbvdn .*-]+') THEN 'DNA' WHEN regexp_full_match(text, '(?i)[acgurymkswhbvdn .*-]+') THEN 'RNA' WHEN regexp_full_match(text, '[a-zA-Z*_ .-]+') THEN 'Protein' ELSE 'Unlimit' END AS type FROM documents
 UNION ALL SELECT p_partkey, CASE WHEN regexp_full_match(p_type, '(?i)[acgtrymkswhbvdn .*-]+') THEN 'DNA' WHEN regexp_full_match(p_type, '[a-zA-Z*_ .-]+') THEN 'Protein' ELSE 'Unlimit' END FROM part""")
def guess_type(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("seq"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return docs.union(parts).select("pos", S.guess_type("seq").alias("type"))


@query(f"WITH {REC} SELECT file, count(*) AS num_seqs, CAST(sum(length(seq)) AS BIGINT) AS sum_len FROM r GROUP BY file")
def sum_sizes(spark, sf_dir):
    """What ``sum_digest`` counts beside its digests, which SQL lacks the hash for."""
    return A.digest_sum(fasta(spark, sf_dir), every=True).select("file", "num_seqs", "sum_len")


@query(f"WITH {REC} SELECT id, replace(seq, 'T', '') AS seq, replace(qual, '+', '') AS qual FROM r")
def seq_remove_gaps(spark, sf_dir):
    """With T as the gap letter; its quality is +."""
    return T.seq(records(spark, sf_dir), remove_gaps=True, gap_letters="T").select("id", "seq", "qual")


@query(f"WITH {REC} SELECT id, seq FROM r")
def seq_validate(spark, sf_dir):
    return T.seq(fasta(spark, sf_dir), validate="ACGT").select("id", "seq")


@query("SELECT doc_id AS pos, reverse(translate(regexp_replace(translate(coalesce(text, ''), 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS seq FROM documents")
def revcomp_dna(spark, sf_dir):
    """Whole texts, whose other letters all count as unknown."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), S.revcomp_dna(F.coalesce("text", F.lit(""))).alias("seq"))


@query(f"WITH {REC} SELECT CAST(floor(log10(length(seq) + 1) / 0.25) * 0.25 AS DOUBLE) AS bin, count(*) AS count FROM r GROUP BY 1")
def watch_log(spark, sf_dir):
    return A.watch(records(spark, sf_dir), "ReadLen", 0.25, log=True)


@query(f"WITH {REC}, x AS (SELECT length(seq) - length(replace(seq, 'G', '')) AS g, length(seq) - length(replace(seq, 'C', '')) AS c, length(seq) AS n FROM r) SELECT CAST(CASE WHEN n = 0 THEN NULL ELSE floor(100.0 * (g - c) / n / 5) * 5 END AS DOUBLE) AS bin, count(*) AS count FROM x GROUP BY 1")
def watch_gc_skew(spark, sf_dir):
    return A.watch(records(spark, sf_dir), "GCSkew", 5.0)


@query(f"WITH {REC} SELECT id, row_number() OVER (ORDER BY length(replace(seq, 'T', '')), file_idx, pos) AS rank FROM r")
def sort_rank_bases(spark, sf_dir):
    return ranked(fasta(spark, sf_dir), O.sort_key("bases", gaps="T"), "file_idx", "pos").select("id", "rank")


@query(f"WITH {REC} SELECT id FROM r ORDER BY md5(pos || ':' || 11), file_idx, pos LIMIT (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) FROM r)")
def sample_exact_share(spark, sf_dir):
    return O.sample_exact_share(fasta(spark, sf_dir), 0.3).select("id")


@query(f"WITH {REC} SELECT id, read, CAST((row_number() OVER (PARTITION BY read ORDER BY pos) - 1) // 150 + 1 AS BIGINT) AS part FROM r, generate_series(1, 2) t(read)")
def split_pairs(spark, sf_dir):
    r = records(spark, sf_dir)
    return O.split_pairs(r, T.seq(r, reverse=True), O.split_size, 150).select("id", F.col("read").cast("long").alias("read"), "part")


@query(f"WITH {REC}, k AS (SELECT id, pos, (row_number() OVER (ORDER BY pos) - 1) % 7 + 1 AS part FROM r) SELECT CAST(part AS BIGINT) AS part, min_by(id, pos) AS name FROM k GROUP BY 1")
def split_names(spark, sf_dir):
    r = fasta(spark, sf_dir).withColumn("file_idx", F.lit(0))
    return O.first_id(O.split_round_robin(r, 7))


@query(f"WITH {REC} SELECT id, CASE WHEN length(seq) >= 4 THEN substr(seq, 1, length(seq) - 4) || substr(seq, length(seq) - 1) ELSE substr(seq, greatest(length(seq) - 1, 1)) END AS seq FROM r WHERE length(seq) >= 3 UNION ALL SELECT id, seq FROM r WHERE length(seq) < 3")
def mutate_deletion(spark, sf_dir):
    """The fourth and third letter from the end."""
    return T.mutate(fasta(spark, sf_dir), deletion=(-4, -3)).select("id", "seq")


_TESTS = ("^1", "7$", "^[0-4]+$")


@query(f"WITH {REC}, p(n, p) AS (VALUES {', '.join(f'({i}, {p!r})' for i, p in enumerate(_TESTS))}), m AS (SELECT n, id, row_number() OVER (PARTITION BY n ORDER BY file_idx, pos) AS k FROM r JOIN p ON regexp_matches(id, p)) SELECT DISTINCT id FROM m WHERE k = 1")
def grep_first_regex(spark, sf_dir):
    return Q.grep_first(fasta(spark, sf_dir), list(_TESTS), regex=True).select("id")


_FLANK = "SELECT id || '_' || a || '-' || b || ':' || strand || '{note}' AS id, CASE WHEN s > e THEN '' WHEN strand = '-' THEN " + RC.format("substr(seq, s, e - s + 1)") + " ELSE substr(seq, s, e - s + 1) END AS seq FROM x"


@query(f"WITH {REC}, {FEAT}, x AS (SELECT id, seq, a, b, strand, greatest(CASE WHEN strand = '-' THEN b + 1 ELSE a - 20 END, 1) AS s, least(CASE WHEN strand = '-' THEN b + 20 ELSE a - 1 END, length(seq)) AS e FROM r JOIN f ON id = chrom) {_FLANK.format(note='_usf:20')}")
def subseq_upstream(spark, sf_dir):
    return R.by_features(fasta(spark, sf_dir), features(spark, sf_dir), up=20, only_flank=True).select("id", "seq")


@query(f"WITH {REC}, {FEAT}, x AS (SELECT id, seq, a, b, strand, greatest(CASE WHEN strand = '-' THEN a - 20 ELSE b + 1 END, 1) AS s, least(CASE WHEN strand = '-' THEN a - 1 ELSE b + 20 END, length(seq)) AS e FROM r JOIN f ON id = chrom) {_FLANK.format(note='_dsf:20')}")
def subseq_downstream(spark, sf_dir):
    return R.by_features(fasta(spark, sf_dir), features(spark, sf_dir), down=20, only_flank=True).select("id", "seq")


#: Places of a primer on both strands with at most one other letter.
_F, _B = "GATTACA", "TGCATTA"
_STRANDS = f"s AS (SELECT id, '+' AS strand, seq, length(seq) AS n FROM r UNION ALL SELECT id, '-', {RC.format('seq')}, length(seq) FROM r), w AS (SELECT *, unnest(generate_series(0, n - 7)) AS i FROM s WHERE n >= 7)"
_AMPLICON = f"""WITH {REC}, {_STRANDS}, f AS (SELECT id, strand, seq, n, min(i) AS i FROM w WHERE {_HAM(1, _F)} <= 1 GROUP BY ALL), b AS (SELECT id, strand, max(i) AS j FROM w WHERE {_HAM(1, _B)} <= 1 GROUP BY ALL),
 x AS (SELECT *, {_HAM(1, _F)} AS m5, {_HAM(1, _B).replace('i + ', 'j + ')} AS m3 FROM f JOIN b USING (id, strand) WHERE j >= i)"""


@query(f"""{_AMPLICON} SELECT id AS chrom, CAST(CASE strand WHEN '+' THEN i ELSE n - j - 7 END AS INT) AS start, CAST(CASE strand WHEN '+' THEN j + 7 ELSE n - i END AS INT) AS "end", 'p' AS primer, 0 AS score, strand, substr(seq, i + 1, j + 7 - i) AS amplicon, CAST(m5 + m3 AS INT) AS mismatches, CAST(m5 AS INT) AS mis5, CAST(m3 AS INT) AS mis3 FROM x""")
def amplicon_mismatch(spark, sf_dir):
    return Q.amplicon(fasta(spark, sf_dir), [("p", "GATTACA", "TAATGCA")], mismatches=1)


@query(f"""{_AMPLICON} SELECT id AS chrom, CAST(CASE strand WHEN '+' THEN i ELSE n - j - 7 END AS INT) AS start, CAST(CASE strand WHEN '+' THEN j + 7 ELSE n - i END AS INT) AS "end", 'p' AS name, 0 AS score, strand, substr(seq, i + 1, j + 7 - i) AS amplicon FROM x""")
def amplicon_bed(spark, sf_dir):
    return Q.amplicon_bed(Q.amplicon(fasta(spark, sf_dir), [("p", "GATTACA", "TAATGCA")], mismatches=1))


_PLACES = f"WITH {REC}, w AS (SELECT id, seq, unnest(generate_series(1, length(seq) - 4)) AS i FROM r WHERE length(seq) >= 5)"


@query(f"""{_PLACES} SELECT id AS chrom, CAST(i - 1 AS INT) AS start, CAST(i + 4 AS INT) AS "end", 'p' AS name, 0 AS score, '+' AS strand FROM w WHERE substr(seq, i, 5) = 'ATAGA'""")
def locate_bed(spark, sf_dir):
    return Q.as_bed(Q.locate(fasta(spark, sf_dir), {"p": "ATAGA"}, only_positive=True))


@query(f"""{_PLACES} SELECT id AS seqname, 'location' AS feature, CAST(i AS INT) AS start, CAST(i + 4 AS INT) AS "end", 'gene_id "p"; ' AS attribute FROM w WHERE substr(seq, i, 5) = 'ATAGA'""")
def locate_gtf(spark, sf_dir):
    return Q.as_gtf(Q.locate(fasta(spark, sf_dir), {"p": "ATAGA"}, only_positive=True)).select("seqname", "feature", "start", "end", "attribute")


_CODONS = ", ".join(f"({n}, '{c}', '{a}')" for n in (1, 2, 11) for c, a in iupac.genetic_code(n).items())


@query(f"SELECT * FROM (VALUES {_CODONS}) t(code, codon, amino)")
def codon_tables(spark, sf_dir):
    out = [T.codon_table(spark, n).select("code", "codon", "amino") for n in (1, 2, 11)]
    return out[0].union(out[1]).union(out[2])


@query(f"WITH {REC} SELECT count(*) AS records, count(*) AS distinct_ids, CAST(0 AS BIGINT) AS other FROM r")
def replace_uuid(spark, sf_dir):
    """Names become time-ordered UUIDs, all different."""
    r = T.replace(fasta(spark, sf_dir), ".+", "{uuid}")
    form = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return r.agg(F.count("*").alias("records"), F.count_distinct("id").alias("distinct_ids"), F.count(F.when(~F.col("id").rlike(form), 1)).alias("other"))


_CUT = "CASE WHEN length(seq) >= 3 AND {} THEN substr(seq, 1, 2) || 'N' || substr(seq, 4) ELSE seq END AS seq"


@query(f"WITH {REC} SELECT id, {_CUT.format('NOT EXISTS (SELECT 1 FROM labels WHERE CAST(doc_id AS VARCHAR) = id)')} FROM r")
def mutate_unlisted(spark, sf_dir):
    """Records that a table of ids does not have."""
    listed = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("pattern"))
    return T.mutate(fasta(spark, sf_dir), points=((3, "N"),), patterns=listed, invert=True).select("id", "seq")


@query(f"WITH {REC} SELECT id, {_CUT.format(chr(40) + 'regexp_matches(id, ' + chr(39) + '^1.*[02468]$' + chr(39) + ') OR contains(name, ' + chr(39) + ' de ' + chr(39) + '))')} FROM r")
def mutate_by_regexp(spark, sf_dir):
    return T.mutate(fasta(spark, sf_dir), points=((3, "N"),), patterns=[r"^1\d*[02468] ", " DE "], by_name=True, use_regexp=True, ignore_case=True).select("id", "seq")


@query(f"""WITH {REC}, q AS (SELECT lang, unnest(string_split(translate(seq, 'ACGT', CASE lang WHEN 'de' THEN 'h^TJ' WHEN 'es' THEN 'hBBf' WHEN 'en' THEN 'J?5+' ELSE 'I?5+' END), '')) AS c FROM (SELECT file AS lang, seq FROM r WHERE seq <> ''))
 SELECT lang AS file, min(ascii(c)) AS low, max(ascii(c)) AS high, CASE lang WHEN 'de' THEN 'Solexa,Illumina-1.3+,Illumina-1.5+' WHEN 'es' THEN 'Illumina-1.5+' WHEN 'en' THEN 'Illumina-1.8+' ELSE 'Sanger,Illumina-1.8+' END AS encodings FROM q WHERE c <> '' GROUP BY lang""")
def quality_guess(spark, sf_dir):
    """Encodings that the qualities of each file allow, which are written in four of them."""
    r = fasta(spark, sf_dir)
    as_ = lambda to: F.translate("seq", "ACGT", to)
    qual = F.when(F.col("file") == "de", as_("h^TJ")).when(F.col("file") == "es", as_("hBBf")).when(F.col("file") == "en", as_("J?5+")).otherwise(as_("I?5+"))
    return T.guess_encodings(r.withColumn("qual", qual))
