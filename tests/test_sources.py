"""Readers, sinks, round trips, command line and streams."""

import pytest
from conftest import rows

from spanloom import cli
from spanloom.sources import blocks, sinks, text
from spanloom.streaming import intervals as stream


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_bed(spark, tmp_path):
    p = put(tmp_path, "a.bed", "chr1\t5\t9\n\n chr2 \t1\t2\tn \t7\t-\textra\n")
    assert rows(text.read_bed(spark, p)) == [("chr1", 5, 9, None, None, None), ("chr2", 1, 2, "n", 7, "-")]
    assert text.read_bed(spark, p, drop_after=4).where("score is not null").count() == 0
    assert text.count_lines(spark, p) == 2
    for bad, why in (("chr1\t5\n", "fewer"), ("chr1\tx\t5\n", "invalid start"), ("c\t1\t2\tn\t1\t?\n", "unknown strand")):
        q = put(tmp_path, "b.bed", bad + "chr1\t5\t9\n")
        with pytest.raises(Exception, match=why):
            text.read_bed(spark, q).collect()
        assert text.read_bed(spark, q, strict=False).count() == 1
    head = put(tmp_path, "h.bed", "track name=x\n#c\nchr1\t1\t2\n")
    assert text.read_bed(spark, head, skip_headers=True).count() == 1
    out = [r.value for r in sinks.to_bed(text.read_bed(spark, p)).collect()]
    assert sorted(out) == ["chr1\t5\t9", "chr2\t1\t2\tn\t7\t-"]
    sinks.write_text(sinks.to_bed(text.read_bed(spark, p)), str(tmp_path / "out"))
    assert rows(text.read_bed(spark, str(tmp_path / "out"))) == rows(text.read_bed(spark, p))


def test_wig(spark, tmp_path):
    a = put(tmp_path, "chr1.wig", "chr1\t1\t5\t0.5\nchr1\t5\t9\t2\n")
    b = put(tmp_path, "chr2.wig", "track x\nfixedStep chrom=chr2 start=10 step=5\n1\n2.5\nfixedStep chrom=chr3 start=0 step=1\n7\n")
    assert rows(text.read_wig(spark, a)) == [("chr1", 1, 5, 0.5), ("chr1", 5, 9, 2.0)]
    fixed = [("chr2", 10, 15, 1.0), ("chr2", 15, 20, 2.5), ("chr3", 0, 1, 7.0)]
    assert rows(blocks.read_fixed_wig(spark, b)) == fixed
    c = put(tmp_path, "chr4.wig", "fixedStep chrom=chr4 start=0 step=1\n7\n")
    assert rows(text.read_wig_any(spark, [a, c])) == rows(text.read_wig(spark, a)) + [("chr4", 0, 1, 7.0)]
    assert text.read_wig_directory(spark, str(tmp_path), ["chr1"]).count() == 2
    assert text.read_wig_any(spark, put(tmp_path, "e.wig", "\n")).count() == 0
    for bad in ("5\n", "variableStep chrom=c\n1 2\n", "fixedStep chrom=c start=1 step=5 span=2\n1\n"):
        with pytest.raises(blocks.FormatError):
            list(blocks.parse_fixed_wig(bad))


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">one first\nACT\nGGA\n>two\n\nAC>GT\n>three\n")
    got = rows(blocks.read_fasta(spark, p))
    assert got == [("one first", "ACTGGA"), ("three", ""), ("two", "AC>GT")]
    assert blocks.count_sequences(spark, p) == 3
    assert blocks.read_fasta(spark, put(tmp_path, "e.fa", "")).count() == 0
    df = spark.createDataFrame([("s", "A" * 120, 5, 125, 9)], "name string, seq string, start long, end long, remaining long")
    assert sinks.to_fasta(df, coords=True).first().value.split("\n") == [">s:5-125 (9)", "A" * 50, "A" * 50, "A" * 20]
    sinks.write_text(sinks.to_fasta(df, 7), str(tmp_path / "f"))
    assert rows(blocks.read_fasta(spark, str(tmp_path / "f"))) == [("s", "A" * 120)]


def test_fastq(spark, tmp_path):
    p = put(tmp_path, "a.fq", "@r1\nACGT\n+r1\n@III\n\n@r2\nAC\n+r2\n+I\n")
    assert rows(blocks.read_fastq(spark, p)) == [("r1", "ACGT", "@III"), ("r2", "AC", "+I")]
    wrapped = put(tmp_path, "w.fq", "@r1\nAC\nGT\n+\n@I\nII\n@r2\nA\n+\nI\n")
    assert rows(blocks.read_fastq(spark, wrapped, wrapped=True)) == [("r1", "ACGT", "@III"), ("r2", "A", "I")]
    for bad, why in (("@r\nA\n+x\nI\n", "differ"), ("@r\nA\n+r\n", "truncated"), ("@r\nAC\n+r\nI\n", "length")):
        with pytest.raises(blocks.FormatError, match=why):
            list(blocks.parse_fastq(bad))
    assert list(blocks.parse_fastq("@r\nA\n+\nI\n", True)) == [("r", "A", "I")]
    for bad in ("r\nA\n", "@r\nAC\n+\nI\n", "@r\nA\n+\nIII\n"):
        with pytest.raises(blocks.FormatError):
            list(blocks.parse_fastq_wrapped(bad))
    sinks.write_text(sinks.to_fastq(blocks.read_fastq(spark, p)), str(tmp_path / "q"))
    assert sorted(r for f in (tmp_path / "q").glob("part*") for r in blocks.parse_fastq(f.read_text())) == rows(blocks.read_fastq(spark, p))


MAF = """##maf version=1
# comment

a score=5 pass=2
s A.chr1 10 4 + 100 AC-GT
s B.chr2 5 4 - 50 ACTG-
q B.chr2 9876-
i B.chr2 N 0 C 0
e C.chr3 7 9 + 70 I

a score=6.5
s A.chr1 88 2 + 100 AC
s B.chr2 1 2 + 50 AT
"""


def test_maf(spark, tmp_path):
    p = put(tmp_path, "a.maf", MAF)
    got = blocks.read_maf(spark, p)
    r = {(x.name, x.start): x for x in got.collect()}
    assert len(r) == 5 and got.select("block").distinct().count() == 2
    b = r[("B.chr2", 41)]
    assert (b.seq, b.end, b.strand, b.remaining, b.meta["quality"], b.meta["left_status"]) == ("ACTG-", 45, "-", 5, "9876-", "N")
    assert r[("C.chr3", 7)].seq is None and b.block_meta == {"score": "5", "pass": "2"} and b.ord == 1
    out = sorted(x.value.strip() for x in sinks.to_maf(got).collect())
    blocks_in = sorted(x.strip() for x in MAF.split("\n\n")[1:])
    assert [sorted(x.replace("pass=2 score=5", "score=5 pass=2").split("\n")) for x in out] == [sorted(x.split("\n")) for x in blocks_in]
    ga = blocks.genome_alignment(spark, str(tmp_path), "A", [".maf"])
    assert {(x.ref_chrom, x.ref_start, x.ref_end) for x in ga.collect()} == {("chr1", 10, 14), ("chr1", 88, 90)}
    with pytest.raises(blocks.FormatError):
        list(blocks.parse_maf("x", "a\nz foo\n"))
    with pytest.raises(blocks.FormatError):
        list(blocks.parse_maf("x", "a\ni A N 0 C 0\n"))
    files = ["/d/chr1:10-20.maf", "/d/chr2.maf", "/d/chr3.txt"]
    assert [f[1:] for f in blocks.locus_files(files, [".maf"])] == [("chr1", 10, 20), ("chr2", None, None)]
    with pytest.raises(blocks.FormatError):
        blocks.locus_files(["/a/chr2.maf", "/b/chr2.maf"])
    q = put(tmp_path, "chr1:10-20.maf", MAF)
    assert blocks.read_locus_alignment(spark, [q], "chr1", 15, 16).count() == 5
    assert blocks.read_locus_alignment(spark, [q], "chr1", 25, 26).count() == 0


OUT = """   SW  perc perc perc  query      position in query           matching       repeat              position in  repeat
score  div. del. ins.  sequence    begin     end    (left)    repeat         class/family         begin  end (left)   ID

  463   1.3  0.6  1.7  chr1        10001   10468 (249240153) +  (TAACCC)n      Simple_repeat            1  463    (0)      1
 3612  11.4 21.5  1.3  chr1        10469   11447 (249239174) C  TAR1           Satellite/telo       (399) 1712    483      2
"""

ALIGN = """283 23.92 4.33 3.28 chr1 15 28 (772) C L1 (1) 15 3 m_b1s502i1 4

  chr1 15 ACT-GCAA 21
          i  -  v
C L1   15 ACTTGGAA  8

  chr1 22 ACTGCAA 28

C L1    7 ACTG-AA  2

Matrix = 25p41g.matrix
Kimura (with divCpGMod) = 26.53
"""


def test_repeats(spark, tmp_path):
    p = put(tmp_path, "a.out", OUT)
    got = {r.uniq_id: r for r in text.read_repeats(spark, p).collect()}
    assert (got["1"].start, got["1"].end, got["1"].c_start, got["1"].c_end, got["1"].c_len, got["1"].strand) == (10001, 10469, 1, 464, 464, "+")
    assert (got["2"].c_start, got["2"].c_end, got["2"].c_len, got["2"].strand, got["2"].family) == (483, 1713, 2112, "-", "Satellite/telo")
    q = put(tmp_path, "a.align", ALIGN)
    r = blocks.read_repeat_alignments(spark, q).first()
    assert (r.q_seq, r.r_seq, r.annotation) == ("ACT-GCAAACTGCAA", "ACTTGGAAACTG-AA", "i  -  v " + " " * 7)
    assert (r.q_start, r.q_end, r.r_start, r.r_end, r.r_remaining, r.r_strand, r.uniq_id) == (15, 29, 3, 16, 1, "-", "4")
    assert r.meta["Matrix"] == "25p41g.matrix" and r.meta["source"] == "m_b1s502i1"
    again = next(blocks.parse_repeat_alignments(sinks.to_repeat_alignments(blocks.read_repeat_alignments(spark, q), 8).first().value))
    assert again[3:14] == tuple(r)[3:14]
    for bad in ("nonsense\n", ALIGN.replace("i  -  v", "i  -  z"), ALIGN.replace("ACTTGGAA  8", "ACTTGGA  8")):
        with pytest.raises(blocks.FormatError):
            list(blocks.parse_repeat_alignments(bad))


def test_tables(spark, tmp_path):
    p = put(tmp_path, "t.tsv", "a\tb\tc\n\t1\t\n\nx\t2\ty\n")
    df = text.read_table(spark, p)
    assert sorted(tuple(r)[:3] for r in df.collect()) == [("", "1", ""), ("x", "2", "y")]
    assert text.read_table(spark, p, header=False).columns == ["c1", "c2", "c3", "ord"]
    with pytest.raises(Exception, match="ragged"):
        text.read_table(spark, put(tmp_path, "r.tsv", "a\tb\n1\n")).collect()
    with pytest.raises(ValueError):
        text.read_table(spark, put(tmp_path, "e.tsv", ""))
    c = put(tmp_path, "c.tsv", "n_exon_1_0_chr1_5_f\t7\nchr1\t1\t2\tm\t8\t+\n")
    assert rows(text.read_exon_counts(spark, c)) == [("m", 8), ("n_exon_1_0_chr1_5_f", 7)]
    d = put(tmp_path, "d.tsv", "\t".join(["Category", "Term", *["x"] * 11]) + "\n" + "\t".join(["BP", "GO:1~cell death", *["0"] * 9, "0.01", "z"]) + "\n")
    assert rows(text.read_enrichment(spark, d)) == [("BP", "GO:1", "cell death", 0.01)]


def lines(capsys):
    return capsys.readouterr().out.strip().split("\n")


def test_command_line(spark, tmp_path, capsys):
    a = put(tmp_path, "a.bed", "chr1\t10\t20\tx\t0\t+\nchr1\t15\t30\ty\t0\t+\nchr1\t70\t80\tz\t0\t-\n")
    b = put(tmp_path, "b.bed", "chr1\t18\t25\tp\t0\t+\nchr1\t75\t85\tq\t0\t+\n")
    run = lambda *x: (cli.main(list(x)), lines(capsys))[1]
    assert run("regionCollapse", a) == ["chr1\t10\t30\tX\t0\t+", "chr1\t70\t80\tX\t0\t+"]
    assert run("readCounts", b, a) == ["chr1\t18\t25\tp\t2\t+", "chr1\t75\t85\tq\t1\t+"]
    assert run("genomicIntersection", a, b) == ["chr1\t18\t25\tX\t0\t+", "chr1\t75\t80\tX\t0\t+"]
    assert float(run("genomicIntJaccard", a, b)[0]) == pytest.approx(12 / 35)
    assert run("overlapProfile", a, b)[-1] == "8\t1.0"
    t, u = put(tmp_path, "t.tsv", "k\tv\n1\ta\n2\tb\n"), put(tmp_path, "u.tsv", "w\tk\nc\t2\nd\t3\n")
    assert run("join", t, u, "-a", "k") == ["k\tv\tw", "2\tb\tc"]
    assert sorted(run("join", t, u, "-a", "k", "-p", "-m", "NA"))[-1] == "k\tv\tw"
    p = put(tmp_path, "p.tsv", "a\t0.01\nb\t0.04\nc\t0.03\n")
    assert [float(x.split("\t")[1]) for x in run("fdr", p, "-f", "2")] == pytest.approx([0.03, 0.04, 0.04])
    g, e = put(tmp_path, "g.bed", "chr1\t1\t9\tN\t0\t+\n"), put(tmp_path, "e.tsv", "N_exon_1_0_chr1_5_f\t7\n")
    assert run("exonToGeneReadCounts", e, "-r", g)[0].split("\t")[-1] in ("7", "+")
    j = put(tmp_path, "j.bed", "chr1_100_140_200_260\t5\t60\tr\t1\t+\n")
    assert run("convertJunctionReads", j, "-s", "FIRST") == ["chr1\t104\t140\tr%1\t1\t+"]
    cli.main(["remDupsBED", a, b, "-f", str(tmp_path / "o1"), "-s", str(tmp_path / "o2")])
    assert text.read_bed(spark, str(tmp_path / "o1")).count() == 3
    q = put(tmp_path, "q.fq", "@r\nAC\n+\nII\n")
    assert run("fastqNucDist", q) == ["0\tA\t1", "1\tC\t1"]
    m = put(tmp_path, "m.maf", MAF)
    roi = put(tmp_path, "roi.bed", "chr1\t10\t12\tx\t0\t+\n")
    assert run("consprofile", m, roi, "-w", "2", "-f", "A") == ["1.0", "1.0"]
    cli.main(["indexBuild", m, "-f", "A", "-o", str(tmp_path / "ix")])
    assert len(run("indexLookup", str(tmp_path / "ix"), "-k", "chr1 88 90")) == 2


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    schema = "chrom string, start long, end long, ts timestamp"
    batch = lambda i, *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(str(src))
    from datetime import datetime as dt

    batch(0, ("a", 1, 5, dt(2024, 1, 1)), ("a", 4, 9, dt(2024, 1, 1)), ("b", 3, 3, dt(2024, 1, 1)))
    read = spark.readStream.schema(schema).parquet(str(src))
    q = stream.stream_periods(read, "chrom").writeStream.outputMode("update").format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "cp")).start()
    over = stream.stream_overlaps(read, spark.createDataFrame([("a", 8, 12, "r"), ("a", 0, 10**7, "s")], "chrom string, start long, end long, name string")).writeStream.outputMode("append").format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:
        q.processAllAvailable()
        batch(1, ("a", 20, 22, dt(2024, 1, 1)), ("a", 9, 12, dt(2024, 1, 1)))
        q.processAllAvailable()
        over.processAllAvailable()
        rows_ = spark.table("segs").collect()
        last = max(r.n_rows for r in rows_)
        assert sorted((r.seg_kind, r.seg_start, r.seg_end) for r in rows_ if r.n_rows == last) == [("gap", 12, 20), ("period", 1, 12), ("period", 20, 22)]
        assert sorted((r.a_start, r.b_name) for r in spark.table("hits").collect()) == [(1, "s"), (4, "r"), (4, "s"), (9, "r"), (9, "s"), (20, "s")]
    finally:
        q.stop()
        over.stop()
    counts = stream.stream_counts(read, "ts", "1 hour", "1 hour", ["chrom"])
    assert counts.isStreaming and counts.columns == ["window_start", "chrom", "n"]


def test_contract_without_training_text():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {"p1_found", "p2_found", "p3_found", "p4_found"} <= set(q) and len(q) > 60


@pytest.mark.parametrize("size", [17, 150, 64 << 20])
def test_fastq_in_ranges(spark, tmp_path, size):
    import random

    rnd = random.Random(size)
    want = []
    for i in range(30):
        seq = "".join(rnd.choice("ACGTN") for _ in range(rnd.randrange(1, 20)))
        want.append((f"r{i}", seq, "".join(rnd.choice("@+I#") for _ in seq)))
    text = "".join(f"@{n}\n{s}\n+{n}\n{q}\n" + "\n" * (k % 5 == 0) for k, (n, s, q) in enumerate(want))
    p = put(tmp_path, "a.fastq", text)
    got = blocks.read_fastq(spark, p, range_bytes=size)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert sorted(tuple(r) for r in blocks.read_fastq(spark, put(tmp_path, "b.fastq", text[:-1].replace("\n", "\r\n")), range_bytes=size).collect()) == sorted(want)
    with pytest.raises(Exception, match="truncated|differ"):
        blocks.read_fastq(spark, put(tmp_path, "c.fastq", text.rstrip() + "\n@x\nAC\n"), range_bytes=64 << 20).collect()


def test_interval_state_is_dropped_once_the_watermark_has_passed(spark, tmp_path):
    from datetime import datetime, timedelta

    from spanloom.streaming import intervals

    began = datetime(2024, 5, 1)
    schema = "k string, start long, end long, t timestamp"

    def put_rows(i, rows):
        spark.createDataFrame([(k, s, e, began + timedelta(hours=h)) for k, s, e, h in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    put_rows(0, [("a", 1, 5, 0), ("a", 4, 9, 0), ("b", 1, 2, 0)])
    read = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    q = intervals.stream_periods(read, "k", time="t", late="1 hour", idle_ms=3_600_000).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda d, i: seen.append(sorted(tuple(r) for r in d.collect()))).start()
    try:
        q.processAllAvailable()
        put_rows(1, [("b", 7, 8, 30)])
        q.processAllAvailable()
        put_rows(2, [("a", 20, 21, 31)])
        q.processAllAvailable()
    finally:
        q.stop()
    rows = [r for batch in seen for r in batch]
    assert ("a", 0, "period", 1, 9, 2) in rows and ("b", 0, "gap", 2, 7, 2) in rows
    # the state of a was dropped before its next row, which begins anew
    assert ("a", 0, "period", 20, 21, 1) in rows and ("a", 0, "gap", 9, 20, 3) not in rows
