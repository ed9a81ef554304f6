"""Operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import columns as S
from strandloom.functions import iupac
from strandloom.functions.ordering import numbered, ranked
from strandloom.operators import aggregate as A
from strandloom.operators import order as O
from strandloom.operators import relate as R
from strandloom.operators import search as Q
from strandloom.operators import transform as T
from strandloom.operators.sana import fasta as sana_fasta
from strandloom.operators.sana import sana


def recs(spark, *rows, qual=None, file=0):
    data = [(f"f{file}", file, i, n.split(" ")[0], n.partition(" ")[2], n, s, qual[i] if qual else None) for i, (n, s) in enumerate(rows)]
    return spark.createDataFrame(data, "file string, file_idx int, pos long, id string, `desc` string, name string, seq string, qual string")


def one(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


@pytest.mark.parametrize("region,want", [((1, 1), "a"), ((1, -1), "acgtnACGTN"), ((3, 5), "gtn"), ((-5, -3), "ACG"), ((-1, -1), "N"), ((2, -2), "cgtnACGT"), ((-12, -1), "acgtnACGTN"), ((9, 20), "TN"), ((11, 12), "")])
def test_subseq_region(spark, region, want):
    assert one(T.subseq(recs(spark, ("seq", "acgtnACGTN")), *region), "seq") == [want]


def test_subseq_features_and_flanks(spark):
    r = recs(spark, ("seq", "acgtnACGTN"))
    f = spark.createDataFrame([("seq", 4, 6, "A", "+"), ("seq", 4, 6, "B", "-")], "chrom string, start int, end int, name string, strand string")
    by = lambda **k: one(R.by_features(r, f, **k).orderBy("desc"), "seq")
    assert by() == ["tnA", "Tna"]
    assert by(up=3, down=2) == ["acgtnACG", "ACGTnacg"]
    assert by(up=100, down=100) == ["acgtnACGTN", "NACGTnacgt"]
    assert by(up=3, only_flank=True) == ["acg", "ACG"]
    assert one(R.by_features(r, f, up=3).orderBy("desc"), "name") == ["seq_4-6:+_us:3 A", "seq_4-6:-_us:3 B"]


def test_sliding(spark):
    r = recs(spark, ("seq", "ACGTacgtNN"))
    assert one(T.sliding(r, 3, 6), "id", "seq") == [("seq_sliding:1-6", "ACGTac"), ("seq_sliding:4-9", "TacgtN")]
    assert one(T.sliding(r, 3, 6, circular=True), "id", "seq") == [("seq_sliding:1-6", "ACGTac"), ("seq_sliding:4-9", "TacgtN"), ("seq_sliding:7-2", "gtNNAC"), ("seq_sliding:10-5", "NACGTa")]
    assert one(T.sliding(r, 3, 6, greedy=True), "id") == ["seq_sliding:1-6", "seq_sliding:4-9", "seq_sliding:7-10", "seq_sliding:10-10"]


def test_seq_edits(spark):
    r = recs(spark, ("a", "ACGT-ACTGC-ACC"), qual=["IIII!IIIII!II5"])
    assert one(T.seq(r, remove_gaps=True, lower=True), "seq", "qual") == [("acgtactgcacc", "IIIIIIIIIII5")]
    assert one(T.seq(recs(spark, ("x", "UCAUAUGCUU")), rna2dna=True), "seq") == ["TCATATGCTT"]
    assert one(T.seq(recs(spark, ("x", "ACGN")), reverse=True, complement=True), "seq") == ["NCGT"]
    assert one(T.seq(recs(spark, ("x", "ACU")), complement=True), "seq") == ["UGA"]


def test_codes():
    assert iupac.revcomp("ACGTRYSWKMBDHVN") == "NBDHVKMWSRYACGT"
    assert iupac.genetic_code(1)["TGA"] == "*" and iupac.genetic_code(2)["TGA"] == "W"
    assert iupac.ambiguous_code(1)["GCN"] == "A" and iupac.ambiguous_code(1)["YTR"] == "L" and "NNN" not in iupac.ambiguous_code(1)
    assert S.parse_size("10") == 10 and S.parse_size("2K") == 2048 and S.parse_size("1.5M") == 1.5 * 2**20


def test_translate(spark):
    r = recs(spark, ("s", "ATGGCNTAAGGGTT"))
    assert one(T.translate(r), "seq") == ["MA*G"]
    assert one(T.translate(r, frames=(1,), trim=True, clean=True), "seq") == ["MAXG"]
    subs = T.translate(r, subseqs=True, frames=(1,)).orderBy("begin")
    assert one(subs, "id", "seq") == [("s_frame=1_begin=1_end=6", "MA"), ("s_frame=1_begin=10_end=12", "G")]
    assert one(T.translate(recs(spark, ("s", "TTGNNNTAA")), init_as_m=True, allow_unknown=True), "seq") == ["MX*"]
    assert T.codon_table(spark, 11).count() == 64


def test_locate(spark):
    r = recs(spark, ("s", "agctggagctacc"))
    assert one(Q.locate(r, {"p": "agc"}), "strand", "start", "end", "matched") == [("+", 1, 3, "agc"), ("+", 7, 9, "agc"), ("-", 8, 10, "agc"), ("-", 2, 4, "agc")]
    plus = lambda m: one(Q.locate(r, {"p": "agc"}, mismatches=m, only_positive=True), "start")
    assert plus(0) == [1, 7] and plus(1) == [1, 7, 11]
    assert one(Q.locate(recs(spark, ("s", "AAAA")), {"p": "AA"}, only_positive=True), "start") == [1, 2, 3]
    assert one(Q.locate(recs(spark, ("s", "AAAA")), {"p": "AA"}, only_positive=True, non_greedy=True), "start") == [1, 3]
    assert one(Q.locate(recs(spark, ("s", "TTACGG")), {"p": "GGTT"}, only_positive=True, circular=True), "start", "end") == [(5, 8)]
    hits = Q.locate(r, {"p": "agc"}, only_positive=True)
    assert one(Q.as_bed(hits), "start", "end", "name") == [(0, 3, "p"), (6, 9, "p")]
    assert one(Q.as_gtf(hits), "attribute")[0] == 'gene_id "p"; '


def test_grep(spark):
    r = recs(spark, ("s1", "ACGTTGCA"), ("s2 x", ""), (" s3", "AC"))
    assert one(Q.grep(r, [""], key="seq"), "name") == ["s2 x"]
    assert one(Q.grep(r, ["CAACC"], by_seq=True, circular=True), "id") == []
    assert one(Q.grep(r, ["GCAAC"], by_seq=True, circular=True), "id") == ["s1"]
    assert one(Q.grep(r, ["AC"], by_seq=True, invert=True), "name") == ["s2 x"]
    p = spark.createDataFrame([("S1",), ("s1",)], "pattern string")
    assert Q.grep_ids(r, p, ignore_case=True, duplicates=True).count() == 2


def test_amplicon(spark):
    r = recs(spark, ("seq", "acgcccactgaaatga"))
    amp = lambda f, b, **k: [tuple(x) for x in Q.amplicon(r, [(".", f, b)], only_positive=True, **k).select("start", "end", "amplicon").collect()]
    assert amp("ccc", "ttt") == [(3, 13, "cccactgaaa")]
    assert amp("ccc", "ttt", region=(4, 7)) == amp("ccc", "ttt", region=(4, -4)) == [(6, 10, "actg")]
    assert amp("ccc", "", region=(3, 6), flanking=True) == [(8, 12, "tgaa")]
    assert amp("aaa", "", region=(2, 5), flanking=True) == [(14, 16, "ga")]
    assert amp("aaa", "", region=(2, 5), flanking=True, strict=True) == []
    assert amp("cct", "ttt", mismatches=1) == [(3, 14, "cccactgaaat")]


def test_fish(spark):
    hits = Q.fish(recs(spark, ("r", "ACGACGACGA")), {"q": "ACGA"}, every=True, stranded=True)
    assert sorted(one(hits, "RefStart", "RefEnd", "RawScore", "MapQual")) == [(0, 4, 16, 60.0), (6, 10, 16, 60.0)]
    got = Q.smith_waterman("TTTACGTTTT", "ACCGT")
    assert got[:5] == (16 - 3, 3, 7, 0, 5) and got[5:] == ("AC-GT", "ACCGT") or got[0] == 13
    assert one(Q.fish_none(recs(spark, ("r", "CCCC"), ("s", "ACGA")), {"q": "ACGA"}), "id") == ["r"]


def test_smith_waterman_scores_equal_plain_ones():
    import random

    rng = random.Random(3)

    def plain(r, q, m=4, x=-4, go=-2, ge=-1):
        low = -(10**9)
        h = [[0] * (len(r) + 1) for _ in range(len(q) + 1)]
        e = [[low] * (len(r) + 1) for _ in range(len(q) + 1)]
        f = [[low] * (len(r) + 1) for _ in range(len(q) + 1)]
        for i in range(1, len(q) + 1):
            for j in range(1, len(r) + 1):
                e[i][j] = max(e[i][j - 1], h[i][j - 1] + go) + ge
                f[i][j] = max(f[i - 1][j], h[i - 1][j] + go) + ge
                h[i][j] = max(0, h[i - 1][j - 1] + (m if r[j - 1] == q[i - 1] else x), e[i][j], f[i][j])
        return max(map(max, h))

    for _ in range(150):
        r, q = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30))) for _ in range(2))
        got = Q.smith_waterman(r, q)
        assert (got[0] if got else 0) == plain(r, q)
        if got:
            assert got[5].replace("-", "") == r[got[1] : got[2]] and got[6].replace("-", "") == q[got[3] : got[4]]


def test_replace(spark):
    r = recs(spark, ("seq1 abc-123", "ACGT"))
    name = lambda p, t, **k: one(T.replace(r, p, t, **k), "name")
    assert name(r"\-", "=") == ["seq1 abc=123"]
    assert name(r"(\w)", "$1 ") == ["s e q 1  a b c -1 2 3 "]
    assert name(r"^(\w)(\w)", "${1}_$2") == ["s_eq1 abc-123"] and name(r"(\w)$", "$$") == ["seq1 abc-12$"]
    kv = spark.createDataFrame([("abc", "123$4\\")], "k string, v string")
    assert name(r"(\w+)-", "{kv}-", kv=kv) == ["seq1 123$4\\-123"]
    assert name(r" (\d)", " {kv}", kv=kv, keep_untouched=True) == ["seq1 abc-123"]
    assert name(r" (\w+)-", " {kv}", kv=kv.where("k = ''"), keep_key=True) == ["seq1 abc123"]
    assert one(T.replace(recs(spark, ("s", "AC-GT-")), "-", "", by_seq=True), "seq") == ["ACGT"]


def test_rename_mutate_restart_concat(spark):
    r = recs(spark, ("a c1", "acgt"), ("b c2", "actt"), ("a c3", "actt"))
    assert one(T.rename(r).orderBy("pos"), "name") == ["a c1", "b c2", "a_2 c3"]
    assert one(T.rename(r, first_too=True).orderBy("pos"), "id") == ["a_1", "b_1", "a_2"]
    s = recs(spark, ("s", "ACTGNactgn"))
    mut = lambda **k: one(T.mutate(s, **k), "seq")[0]
    assert mut(points=((1, "x"), (-1, "x"))) == "xCTGNactgx" and mut(deletion=(1, 5)) == "actgn" and mut(insertion=(0, "xx")) == "xxACTGNactgn" and mut(insertion=(-1, "xx")) == "ACTGNactgnxx"
    g = recs(spark, ("s", "atggcCACTG"))
    assert one(T.restart(g, start=2), "seq") == ["tggcCACTGa"] and one(T.restart(g, start=-2), "seq") == ["TGatggcCAC"]
    assert one(T.restart(g, motif="CACT"), "seq") == ["CACTGatggc"] and one(T.restart(g, motif="AGTG"), "seq") == ["AGTGgccatC"]
    a, b = recs(spark, ("A x", "AA"), ("B", "C"), ("A y", "TT")), recs(spark, ("A z", "GG"), ("C", "G"))
    assert sorted(one(R.concat([a, b]), "name", "seq")) == [("A x|z", "AAGG"), ("A y|z", "TTGG")]
    assert sorted(one(R.concat([a, b], full=True), "id", "seq")) == [("A", "AAGG"), ("A", "TTGG"), ("B", "C"), ("C", "G")]


def test_orders_and_splits(spark):
    r = recs(spark, *[(f"chr{n}", "A" * n) for n in (11, 2, 1, 10)])
    assert one(O.sort(r, natural=True), "id") == ["chr1", "chr2", "chr10", "chr11"]
    assert one(O.sort(r, by="length", reverse=True), "id") == ["chr11", "chr10", "chr2", "chr1"]
    assert one(O.head(r, 2), "id") == ["chr11", "chr2"] and sorted(one(O.head_length(r, 12), "id")) == ["chr11", "chr2"]
    assert sorted(one(O.range_(r, -2, -1), "id")) == ["chr1", "chr10"] and sorted(one(O.range_(r, 2, -1), "id")) == ["chr1", "chr10", "chr2"]
    assert sorted(one(O.split_length(r, 12), "pos", "part")) == [(0, 1), (1, 1), (2, 2), (3, 2)]
    assert [x[1] for x in sorted(one(O.split_parts(r, 3), "pos", "part"))] == [1, 1, 2, 2]
    assert one(O.split_size(r, 3).select(O.part_name("x.part_", F.col("part"), extension=".fa").alias("n")).distinct().orderBy("n"), "n") == ["x.part_001.fa", "x.part_002.fa"]
    big = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 3).alias("g"))
    n = numbered(big, by=("g",)).collect()
    assert all(x.nr == x.pos // 3 + 1 for x in n)
    assert [x.rank for x in sorted(ranked(big, F.desc("pos")).collect(), key=lambda x: -x.pos)] == list(range(1, 1001))
    assert O.sample_n(r, 2, 7).count() == 2 and one(O.shuffle(r, 5), "id") == one(O.shuffle(r, 5), "id")


def test_statistics(spark):
    r = recs(spark, *[(f"c{n}", "A" * n) for n in range(2, 11)])
    s = A.stats_all(r).first()
    assert (s.num_seqs, s.sum_len, s.q1, s.q2, s.q3, s.n50, s.n50_num) == (9, 54, 4.0, 6.0, 8.0, 8, 3)
    assert A.digest_sum(recs(spark, ("a", "ACGT"), ("b", "GG"))).first().digest == A.digest_sum(recs(spark, ("b", "gg"), ("c", "acgt"))).first().digest
    both = [A.digest_sum(recs(spark, ("a", x)), circular=True, k=5).first().digest for x in ("ACGTTGCAAT", "TTGCAATACG", iupac.revcomp("ACGTTGCAAT"))]
    assert len(set(both)) == 1
    w = spark.createDataFrame([(i, f"a_sliding:{b}-{e}") for i, (b, e) in enumerate([(1, 9), (3, 12), (12, 20), (30, 40), (35, 38)])], "pos long, name string")
    assert sorted(one(A.merge_slides(w), "start", "end")) == [(0, 20), (29, 38)]
    assert one(T.convert(recs(spark, ("s", "ACG"), qual=["BhT"]), "Illumina-1.5+"), "qual") == ["!I5"]
    assert T.guess_encoding(recs(spark, ("s", "ACG"), qual=["!!I"])) [0] == "Sanger"
    assert [x[0] for x in spark.createDataFrame([("ACGTN",), ("ACGU",), ("MKLV*",), ("",)], "s string").select(S.guess_type("s")).collect()] == ["DNA", "RNA", "Protein", None]


def test_common_embedded(spark):
    def f(i, *rows):
        return recs(spark, *rows, file=i)

    a = f(0, ("A_a", "ACTTTGA"), ("A_b", "ACC"), ("A_d", "CCCCCCCCCC"), ("A_c1", "AGGGCCC"))
    b = f(1, ("B_a", "AAA"), ("B_b", "GGT"), ("B_c", "AGGGCC"))
    got = R.common_embedded(a.union(b), 2, ignore_case=True)
    assert sorted(one(got, "id", "start", "end", "seq")) == [("A_a", 3, 5, "ttt"), ("A_b", 1, 3, "acc"), ("A_c1", 1, 6, "agggcc")]


def test_sana(spark):
    text = "@a\nACGT\n+\nIIII\njunk\n@b\nAC\n+\nIII\n@c\nGG\n+\n@I\n@d\nAXZ!\n+\nIIII\n@e\nA\n"
    rows = sana(spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file string, text string")).collect()
    assert [(r.name, r.seq, r.qual) for r in rows if r.error is None] == [("a", "ACGT", "IIII"), ("c", "GG", "@I")]
    assert {r.line for r in rows if r.error} >= {"junk", "@b", "@d", "@e"}
    good = [x for x in sana_fasta([">a", "AC", "", "GT", ">b", ">c", "AC!", "x", ">d", "T"]) if x[4] is None]
    assert [(x[1], x[2]) for x in good] == [("a", "ACGT"), ("d", "T")]


def test_digest_of_one_genome_in_four_presentations(spark):
    one = "TGGTAGGGAGTTGAGTAGCATGGGTATAGTATAGTGTCATGATGCCAGATTTTAAAAAAA"
    forms = [one, one[1:] + one[:1], iupac.revcomp(one), iupac.revcomp(one[7:] + one[:7])]
    for k, digest in ((21, "7efd18ce33380268d3aa335ffd2dd1cc"), (51, "39e267864fddeafd7a5cacd77e0a6a11")):
        got = {A.digest_sum(recs(spark, ("x", s)), circular=True, k=k).first().digest for s in forms}
        assert got == {f"v0.1_DCD_k{k}_{digest}"}


def test_spread(spark, tmp_path):
    from strandloom.functions.layout import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = spread(spark.read.parquet(str(tmp_path / "one")))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 100
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread(many) is many


def test_common_embedded_at_random(spark, monkeypatch):
    """Two and three files, listed texts and anchored ones, on both strands; seeds that move are fewer than the letters."""
    import random

    from strandloom.operators import embedded

    rng = random.Random(4)
    letters = lambda n, of="ACGTU": "".join(rng.choices(of, weights=[9] * (len(of) - 1) + [1], k=n))
    base = [letters(rng.randrange(60, 300)) for _ in range(8)]

    def some(i):
        out = []
        for n in range(14):
            s = rng.choice(base)
            a, k = rng.randrange(len(s) - 20), rng.choice([1, 3, 8, 15, 31, 32, 33, 70, 300])
            s = s[a : a + k] if n % 4 else letters(3) + s + letters(5)
            out.append((f"f{i}r{n}", iupac.revcomp(s) if n % 3 == 0 else s))
        return out

    def brute(files):
        out = []
        for name, s in files[0]:
            per = []
            for f in files[1:]:
                spans = set()
                for _, t in f:
                    if len(t) <= len(s):
                        spans |= {(b, b + len(t)) for b in range(len(s) - len(t) + 1) if t in (s[b : b + len(t)], iupac.revcomp(s[b : b + len(t)]))}
                    if len(s) <= len(t) and any(s in (t[b : b + len(s)], iupac.revcomp(t[b : b + len(s)])) for b in range(len(t) - len(s) + 1)):
                        spans.add((0, len(s)))
                per.append(spans)
            kept = [x for x in set().union(*per) if all(any(a <= x[0] and x[1] <= b for a, b in spans) for spans in per)]
            out += [(name, b + 1, e, s[b:e]) for b, e in kept if not any((x, y) != (b, e) and x <= b and e <= y for x, y in kept)]
        return sorted(out)

    for listed in (100_000, 6):
        monkeypatch.setattr(R, "LISTED", listed)
        for n in (2, 3):
            files = [some(i) for i in range(n)]
            df = recs(spark, *files[0], file=0)
            for i, f in enumerate(files[1:], 1):
                df = df.union(recs(spark, *f, file=i))
            assert sorted(one(R.common_embedded(df, n), "id", "start", "end", "seq")) == brute(files)
    text = letters(4000, "ACGT")
    sent = sum(len(least[0]) for c in range(5, 12) for laid in [embedded.Laid([text])] for least in [embedded.least_places(laid, c, *embedded.sums_of(laid))])
    assert sent < 0.4 * len(text)


def test_common_embedded_of_one_anchor(spark):
    """Many texts that begin alike meet many records that have the beginning: what moves follows the rows, not the pairs."""
    import random

    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("ACGT", k=n))
    start, m = letters(32), 120
    texts = [start + letters(6) for _ in range(m)]
    holders = [letters(9) + start + letters(20) for _ in range(m - 10)] + [letters(9) + t + letters(14) for t in texts[:10]]
    df = recs(spark, *[(f"a{i}", s) for i, s in enumerate(holders)], file=0).union(recs(spark, *[(f"b{i}", s if i % 2 else iupac.revcomp(s)) for i, s in enumerate(texts)], file=1))
    sc = spark.sparkContext
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc.setJobGroup("one_anchor", "common_embedded")
    try:
        got = sorted(one(R.common_embedded(df, 2, min_len=32), "id", "start", "end", "seq"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted((f"a{i}", 10, 47, s[9:47]) for i, s in enumerate(holders) if s[9:47] in texts) and len(got) >= 10
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("one_anchor") for s in sc.statusTracker().getJobInfo(j).stageIds}
    sent = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 0 < sent < m * m / 2


def test_rows_of_places(spark):
    from strandloom.operators import embedded

    assert list(embedded.rows_of([3, 4, 5, 9, 11, 13, 20])) == [(3, 1, 3), (9, 2, 3), (20, 1, 1)]
    for c in ("A", "AT", "ACG"):  # long runs, held and holding
        df = recs(spark, ("x", "C" + c * 200 + "GG" + c * 30), ("y", c * 20), file=0).union(recs(spark, ("p", c * 35), ("q", c * 40), file=1))
        n = len(c)
        got = sorted(one(R.common_embedded(df, 2, min_len=20), "id", "start", "end"))
        text = "C" + c * 200 + "GG" + c * 30
        spans = {(b + 1, b + len(t)) for s in (c * 35, c * 40) for t in (s, iupac.revcomp(s)) for b in range(len(text)) if text.startswith(t, b)}
        want = [("x", b, e) for b, e in spans if not any((x, y) != (b, e) and x <= b and e <= y for x, y in spans)]
        assert got == sorted([*want, ("y", 1, 20 * n)])


def test_loci_of_narrow_rows(spark):
    from strandloom.operators import bam

    places = spark.createDataFrame([("x", 0, "a", 10), ("x", 4, "b", 6), ("x", 9, "c", 12), ("x", 12, "d", 20), ("y", 3, "e", 5)], "ref string, pos int, read string, end int")
    assert {r.read: r.locus for r in bam.locus_of(places).collect()} == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 1}
