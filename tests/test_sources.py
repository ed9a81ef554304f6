"""Files there and back, alignments, and growing folders."""

import gzip
import lzma

import pytest

from strandloom.operators import bam, search
from strandloom.operators.search import cigar_of
from strandloom.sources import alignments as L
from strandloom.sources import formats, read_bed, read_fasta, read_fx, read_gtf, read_kv, read_patterns, read_primers, read_tab, register, write_fx, write_tsv
from strandloom.streaming import follow, watch_stream

FASTA = ">s1 first one\nACGT\nAC\n>s2\n\n>\n>s4 x\r\nGG\r\n"
FASTQ = "@r1 x\nACGT\nAC\n+\n@III\nII\n@r2\nG\n+r2\n+\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b">z\nTT\n"))
    (tmp_path / "c.fa").write_text("\n")
    got = [(r.file_idx, r.id, r.desc, r.seq) for r in read_fasta(spark, [str(tmp_path / x) for x in ("a.fa", "b.fa.gz", "c.fa")]).orderBy("file_idx", "pos").collect()]
    assert got == [(0, "s1", "first one", "ACGTAC"), (0, "s2", "", ""), (0, "", "", ""), (0, "s4", "x", "GG"), (1, "z", "", "TT")]


@pytest.mark.parametrize("suffix,pack", [("", bytes), (".gz", gzip.compress), (".xz", lzma.compress)])
def test_fastq(spark, tmp_path, suffix, pack):
    (tmp_path / f"a.fq{suffix}").write_bytes(pack(FASTQ.encode()))
    want = [("r1 x", "ACGTAC", "@IIIII"), ("r2", "G", "+")]
    assert [(r.name, r.seq, r.qual) for r in read_fx(spark, str(tmp_path)).orderBy("pos").collect()] == want
    register(spark)
    assert [(r.name, r.seq, r.qual) for r in spark.read.format("fx").load(str(tmp_path / "a.*")).orderBy("pos").collect()] == want


def test_broken_fastq_fails():
    with pytest.raises(ValueError):
        list(formats.parse_fastq(["@a", "ACG", "+", "II"]))
    with pytest.raises(ValueError):
        list(formats.parse_fx(["no"]))
    assert list(formats.parse_fx(["\n"])) == []


def test_round_trips(spark, tmp_path):
    (tmp_path / "a.fq").write_text(FASTQ)
    r = read_fx(spark, str(tmp_path / "a.fq"))
    write_fx(r, str(tmp_path / "out"), compression="gzip")
    back = lambda df: sorted((x.name, x.seq, x.qual) for x in df.collect())
    assert back(read_fx(spark, str(tmp_path / "out/part-*"))) == back(r)
    write_tsv(r.select("name", "seq", "qual"), str(tmp_path / "tab"), header=False)
    assert back(read_tab(spark, str(tmp_path / "tab"))) == back(r)
    fa = r.withColumn("part", r.id).withColumn("qual", r.qual.substr(1, 0)).drop("qual").withColumn("qual", formats.F.lit(None).cast("string"))
    write_fx(fa, str(tmp_path / "parts"), width=4, by_part=True)
    assert (sorted(x.name for x in (tmp_path / "parts").iterdir() if x.is_dir())) == ["part=r1", "part=r2"]
    text = next((tmp_path / "parts/part=r1").glob("part-*")).read_text()
    assert text == ">r1 x\nACGT\nAC\n"
    index = formats.fasta_index(read_fasta(spark, str(tmp_path / "parts/part=r1")), 4).first()
    assert tuple(index) == ("r1", 6, 6, 4, 5)


def test_feature_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#c\ntrack x\nchr1\t3\t6\tn\t0\t-\nchr1\t9\t2\n\nchr2\t0\t4\n")
    assert [tuple(r) for r in read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 4, 6, "n", "-"), ("chr1", 3, 9, None, "-"), ("chr2", 1, 4, None, None)]
    (tmp_path / "bad.bed").write_text("chr1\t3\t3\n")
    with pytest.raises(Exception, match="bad BED line"):
        read_bed(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "a.gtf").write_text('#!x\nseq\ttest\tCDS\t4\t6\t.\t+\t.\tgene_id "A"; transcript_id "B"; gene_id "C"\n')
    g = read_gtf(spark, str(tmp_path / "a.gtf")).first()
    assert (g.start, g.end, g.attributes) == (4, 6, {"gene_id": "A", "transcript_id": "B"})
    (tmp_path / "kv").write_text("a\t1\nb\t2\na\t3\n")
    assert sorted(tuple(r) for r in read_kv(spark, str(tmp_path / "kv")).collect()) == [("a", "3"), ("b", "2")]
    (tmp_path / "p").write_text("#c\np1\tccc\tttt\np2\tttt\n\n")
    assert read_primers(spark, str(tmp_path / "p")) == [("p1", "ccc", "ttt"), ("p2", "ttt", "")]
    assert read_patterns(spark, str(tmp_path / "p")).count() == 3


def rows():
    c = lambda *x: [{"op": o, "len": n} for n, o in x]
    base = {"ref_len": 50, "mapq": 30, "qual": [40] * 8, "tags": {"NM": "1"}}
    return [
        base | {"read": "a", "ref": "r1", "pos": 4, "flags": 0, "cigar": c((2, "S"), (5, "M"), (1, "I")), "seq": "ACGTACGT"},
        base | {"read": "b", "ref": "r1", "pos": 6, "flags": 16, "cigar": c((3, "H"), (8, "M")), "seq": "ACGTACGN", "mapq": 0, "tags": {"NM": "2", "XA": "z"}},
        base | {"read": "b", "ref": "r1", "pos": 30, "flags": 256, "cigar": c((8, "M")), "seq": "ACGTACGN", "tags": {}},
        base | {"read": "c", "ref": "r2", "pos": 0, "flags": 2048, "cigar": c((4, "M"), (2, "D"), (4, "M")), "seq": "ACGTACGT", "ref_len": 20},
        base | {"read": "u", "ref": None, "pos": -1, "flags": 4, "cigar": [], "seq": "ACGTACGT", "ref_len": None, "mapq": 0, "tags": {}},
    ]


def test_bam_and_sam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(L.encode_bam(rows(), [("r1", 50), ("r2", 20)]))
    df = L.read_bam(spark, str(tmp_path / "x.bam"))
    plain = lambda d: sorted(({k: [tuple(x) for x in v] if k == "cigar" else v for k, v in r.asDict().items() if k != "file"} for r in d.collect()), key=lambda r: (r["read"], r["pos"]))
    got = plain(df)
    assert got == sorted(({k: [(x["op"], x["len"]) for x in v] if k == "cigar" else v for k, v in r.items()} for r in rows()), key=lambda r: (r["read"], r["pos"]))
    L.as_sam(df).write.text(str(tmp_path / "sam"))
    lengths = spark.createDataFrame([("r1", 50), ("r2", 20)], "ref string, ref_len int")
    assert plain(L.sam_rows(spark.read.text(str(tmp_path / "sam")), lengths)) == got
    register(spark)
    assert spark.read.format("bam").load(str(tmp_path / "x.bam")).count() == 5
    f = {r.Read: r for r in bam.fields(df.where("flags in (0, 16)"), ("Read", "EndPos", "Acc", "ReadLen", "LeftSoftClip", "LeftHardClip", "MeanQual", "ReadAlnSeq", "Strand")).collect()}
    assert (f["a"].EndPos, round(f["a"].Acc, 3), f["a"].ReadLen, f["a"].LeftSoftClip, round(f["a"].MeanQual, 6), f["a"].ReadAlnSeq) == (9, 83.333, 8, 2, 40.0, "GTACGT")
    assert (f["b"].ReadLen, f["b"].LeftHardClip, f["b"].Strand) == (11, 3, -1)
    s = bam.stat(df).first()
    assert (s.PrimAln, s.SecAln, s.SupAln, s.Unmapped, s.TotalReads, s.TotalRecords, round(s.PrimAlnPerc, 2), s.MultimapPerc) == (2, 1, 1, 1, 3, 5, 66.67, 50.0)
    assert [tuple(r) for r in bam.count(df).collect()] == [("r1", 3, 1, 0), ("r2", 1, 0, 1)]
    assert sorted((r.read, r.locus) for r in bam.loci(df).where("ref = 'r1'").collect()) == [("a", 1), ("b", 1), ("b", 2)]
    assert sorted((r.locus, r.bundle) for r in bam.bundle(df.where("ref = 'r1'"), 3).select("locus", "bundle").distinct().collect()) == [(1, 1), (2, 1)]
    refs = spark.createDataFrame([("r1", "ACGTACGTAC" * 5)], "id string, seq string")
    assert bam.aln_context(df, refs, -2, 2, regex_start="^GTAC$").count() + bam.aln_context(df, refs, -2, 2, regex_start="^GTAC$", invert=True).count() == 3
    assert [r.read for r in bam.top(df, "ReadLen", 1).collect()] == ["b"]
    assert bam.acc_stats(df.where("flags = 0")).first().AccMean == pytest.approx(250 / 3)


def test_growing_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fastq").write_text("@a\nAC\n+\nII\n@b\nA")
    stream = follow(spark, str(folder))
    q = stream.writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "cp")).start()
    h = watch_stream(stream, formats.F.length("seq"), 10).writeStream.format("memory").queryName("hist").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:
        q.processAllAvailable()
        assert [r.name for r in spark.sql("select name from grown").collect()] == ["a"]
        with open(folder / "a.fastq", "a") as f:
            f.write("C\n+\nII\n")
        (folder / "b.fastq").write_text("@x\nACG\n+\nII\n@y\nT\n+\nI\n")
        q.processAllAvailable()
        h.processAllAvailable()
        rows = spark.sql("select * from grown").collect()
        assert sorted(r.name for r in rows if r.error is None) == ["a", "b", "y"]
        assert any(r.error for r in rows)
        assert [tuple(r) for r in spark.sql("select * from hist").collect()] == [(0, 3)]
    finally:
        q.stop()
        h.stop()


def test_tools_and_index(spark, tmp_path):
    import struct

    (tmp_path / "x.bam").write_bytes(L.encode_bam(rows(), [("r1", 50), ("r2", 20)]))
    df = L.read_bam(spark, str(tmp_path / "x.bam"))
    assert [r.Match for r in bam.tool_chain(df.where("flags = 0"), [("Dump", {})]).collect()] == [4]
    with pytest.raises(ValueError, match="no tool"):
        bam.tool_chain(df, [("Nothing", {})])
    assert cigar_of("AC-GT", "ACCGA", 1, 0) == ("1S2M1I2M", 2)
    summary = struct.pack("<Ii", 37450, 2) + struct.pack("<QQQQ", 0, 9, 4, 1)
    (tmp_path / "x.bai").write_bytes(b"BAI\1" + struct.pack("<ii", 2, 2) + struct.pack("<IiQQ", 1, 1, 0, 9) + summary + struct.pack("<iQ", 1, 7) + struct.pack("<ii", 0, 0))
    assert [(r.ref_number, r.mapped, r.unmapped) for r in L.read_bai(spark, str(tmp_path / "x.bai")).collect()] == [(0, 4, 1), (1, 0, 0)]


def test_one_fastq_file_is_read_by_many_tasks(spark, tmp_path):
    """Qualities that begin with @, or are @ alone, empty records and partition edges everywhere."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(600):
        n = rng.choice([0, 1, 1, 2, 30])
        rows.append((f"r{i} d@{i}", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@@@+I5", k=n))))
    path = str(tmp_path / "one.fq")
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (300, 1024, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for content in (text, text.rstrip("\n") if rows[-1][1] else text, "\n" + text + "\n\n"):
                with open(path, "w") as f:
                    f.write(content)
                df = formats.read_fastq_lines(spark, path)
                assert [(r.name, r.seq, r.qual) for r in df.orderBy("pos").collect()] == rows
            assert size == 1 << 20 or spark.read.option("lineSep", "\n@").text(path).rdd.getNumPartitions() > 10
        for bad in ("@a\nAC\n+\nI\n", "@a\nAC\n+\n", "@a\nAC\nGT\n+\nIIII\n", "@a\nAC\nx\nII\n"):
            with open(path, "w") as f:
                f.write(bad)
            with pytest.raises(Exception, match="FASTQ"):
                formats.read_fastq_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ranges_by_index(spark, tmp_path):
    seqs = {"a": "ACGT" * 40, "b": "", "c": "GATTACA", "d": "T" * 120}
    path = str(tmp_path / "x.fa")
    with open(path, "w") as f:
        for n, s in seqs.items():
            f.write(f">{n} desc\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) + ("" if s else "\n"))
    r = formats.read_fasta(spark, path).coalesce(1)
    formats.write_fai(formats.fasta_index(r), str(tmp_path / "x.fai"))
    index = formats.read_fai(spark, str(tmp_path / "x.fai"))
    asked = [("c", 2, 4), ("a", 55, 130), ("none", 1, 2), ("d", 120, 500), ("a", 1, 60), ("b", 1, 1)]
    assert formats.fetch_ranges(spark, path, index, asked) == [("c:2-4", "ATT"), ("a:55-130", seqs["a"][54:130]), ("d:120-120", "T"), ("a:1-60", seqs["a"][:60])]


def test_streams_lists_and_folders(spark, tmp_path):
    import io

    got = formats.from_stream(spark, io.StringIO(">a x\nAC\nGT\n>b\n\n"), batch=1)
    assert [(r.pos, r.id, r.desc, r.seq) for r in got.orderBy("pos").collect()] == [(0, "a", "x", "ACGT"), (1, "b", "", "")]
    assert formats.from_stream(spark, io.StringIO("")).count() == 0
    for name in ("u.fa", "v.fq.gz", "w.txt", "sub/z.fasta"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    found = [p.rsplit("/", 1)[1] for p in formats.list_files(spark, str(tmp_path))]
    assert sorted(found) == ["u.fa", "v.fq.gz", "z.fasta"]
    (tmp_path / "list").write_text("a.fa\n\n b.fa \n")
    assert formats.read_list(spark, str(tmp_path / "list")) == ["a.fa", "b.fa"]


def test_fish_hits_as_bam_files(spark, tmp_path):
    kind = "file string, file_idx int, pos long, id string, `desc` string, name string, seq string, qual string"
    refs = spark.createDataFrame([("f", 0, i, n, "", n, s, None) for i, (n, s) in enumerate([("r1", "TTGATTACATTTTGATTCCATT"), ("r2", "CCCCCCCC"), ("r3", "TGTAATC")])], kind)
    hits = search.fish(refs, {"q": "GATTACA"}, letters=True, every=True, min_qual=2.0)
    records = bam.from_fish(hits, refs)
    L.write_bam(records.coalesce(1), [("r1", 22), ("r2", 8), ("r3", 7)], str(tmp_path / "out"))
    got = sorted((r.ref, r.pos, r.flags, "".join(f"{c.len}{c.op}" for c in r.cigar), r.seq, r.tags["NM"], r.ref_len) for r in L.read_bam(spark, str(tmp_path / "out")).collect())
    assert ("r1", 2, 0, "7M", "GATTACA", "0", 22) in got and ("r3", 0, 16, "7M", "TGTAATC", "0", 7) in got
    assert [x[2] for x in got if x[0] == "r1"].count(0) == 1 and all(x[0] != "r2" for x in got)


def test_local_alignment_in_tiles(monkeypatch):
    import random

    rng = random.Random(2)
    for _ in range(60):
        query = "".join(rng.choices("ACG", k=rng.randint(1, 9)))
        ref = "".join(rng.choices("ACG", k=rng.randint(1, 400)))
        monkeypatch.setattr(search, "CELLS", 1 << 21)
        whole = search.smith_waterman(ref, query)
        monkeypatch.setattr(search, "CELLS", 1)
        assert search.smith_waterman(ref, query) == whole


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    rows = [("f", 0, i, f"r{i}", "", f"r{i}", "ACGT" * i, "@?5+" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "file string, file_idx int, pos long, id string, desc string, name string, seq string, qual string").repartitionByRange(5, "pos").sortWithinPartitions("pos")
    path = str(tmp_path / "one.fastq")
    formats.write_one(df, path)
    with open(path) as f:
        assert f.read() == "".join(f"@{r[5]}\n{r[6]}\n+\n{r[7]}\n" for r in rows)
    assert [p.name for p in tmp_path.iterdir()] == ["one.fastq"] and df.rdd.getNumPartitions() == 5
    assert sorted((r.name, r.seq) for r in formats.read_fastq_lines(spark, path).collect()) == sorted((r[5], r[6]) for r in rows)
