"""Sequence and read functions, alignments, liftover and statistics: fixed cases."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.functions import sequence as sq
from spanloom.functions import stats
from spanloom.operators import alignment, liftover, profile


def one(spark, value, *cols):
    got = spark.createDataFrame([(value,)], "s string").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return tuple(got) if len(cols) > 1 else got[0]


def test_scalars(spark):
    assert one(spark, "ACTGCTAGCATGCGNN", sq.reverse_complement("s")) == "NNCGCATGCTAGCAGT"
    assert one(spark, "ACGU", sq.reverse_complement("s", rna=None)) == "ACGU"
    with pytest.raises(Exception, match="no complement"):
        one(spark, "AC-T", sq.reverse_complement("s"))
    assert one(spark, "ACTNCTANCGATNNACT", sq.effective_len("s"), sq.mask_region("s", 1, 4)) == (13, "ANNNNTANCGATNNACT")
    assert one(spark, "ACTGACTG", sq.ns_left("s", 5), sq.ns_right("s", 5), sq.ns_right("s", 0), sq.ns_left("s", 99)) == ("NNNNNCTG", "ACTNNNNN", "ACTGACTG", "NNNNNNNN")
    with pytest.raises(Exception, match="out of range"):
        one(spark, "ACT", sq.mask_region("s", 1, 3))
    regions = F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e")), F.struct(F.lit(3).alias("s"), F.lit(3).alias("e")))
    assert one(spark, "ACTGT", sq.mask_regions("s", regions)) == "NNTNT"
    assert one(spark, "AC-GN", sq.ungapped_len("s"), sq.gapped_len("s"), sq.nucleotide("s", 2), sq.is_dna(F.lit("ACgn")), sq.is_rna(F.lit("ACT"))) == (4, 5, "-", True, False)
    with pytest.raises(Exception, match="out of range"):
        one(spark, "AC", sq.nucleotide("s", 2))
    assert one(spark, "TtU", sq.to_rna("s"), sq.to_dna("s")) == ("UtU", "TtT")
    assert one(spark, "AAAAAAAAAC", sq.percent_nuc("s", "A"), sq.is_poly("s", "A"), sq.is_low_quality("s")) == (0.9, True, False)
    assert one(spark, "", sq.percent_nuc("s", "A")) is None
    assert one(spark, "ACTGA", sq.similarity("s", 0, 2, F.lit("GACAG"), 1, 3), sq.truncate("s", 2)) == (2, "AC")
    assert one(spark, "ACTGA", sq.mask_match("s", F.lit("NCn")), sq.mask_match("s", F.lit("ACTGAA")), sq.mask_match("s", F.lit("AG")), sq.mask_match("s", F.lit(""))) == (True, False, False, True)
    halves = one(spark, "ACTGA", sq.split_at("s", F.lit("r")))
    assert [tuple(h) for h in halves] == [("r.1", "AC"), ("r.2", "TGA")]
    assert one(spark, "x", sq.meta_to_string(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == "a=1 b=2"
    assert one(spark, None, sq.reverse_complement("s"), sq.mask_region("s", 0, 0), sq.percent_nuc("s", "A")) == (None, None, None)


def test_pieces_of_gapped_sequences(spark):
    x = sq.gapped_subsequence("s", F.lit(46).cast("long"), F.lit("+"), F.lit(10).cast("long"), 2, 7)
    assert tuple(one(spark, "A--CTGC-TAGC-GATCGACT", x)) == ("--CTG", 47, 50, 23)
    assert one(spark, "-A--CTGC-TAGC-", sq.subsequence("s", F.lit(46), F.lit(47), F.lit(52))) == "CTGC-T"
    assert one(spark, "ACGT", sq.subsequence("s", F.lit(1), F.lit(1), F.lit(5))) == "ACGT"


def test_adaptors_and_reads(spark):
    assert one(spark, "ACTGCTAGCGATCGACT", sq.clip_adaptor("s", F.lit("AGCGATAGACT")), sq.contains_adaptor("s", F.lit("AGCGATAGACT"))) == ("ACTGCTNNNNNNNNNNN", True)
    assert one(spark, "AAAAAAAAAAAAAAA", sq.contains_adaptor("s", F.lit("CCCCCCCCCC"))) is False
    assert one(spark, "B", sq.relative_quality("s", 0), sq.relative_quality(F.lit("F"), 0), sq.relative_quality(F.lit("h"), 0, "64")) == (33, 37, 40)
    with pytest.raises(Exception, match="out of range"):
        one(spark, "B", sq.relative_quality("s", 1))
    assert one(spark, "ACTG", sq.trim_left("s", 1), sq.trim_right("s", 1), sq.trim_right("s", 9)) == ("CTG", "ACT", "")
    assert one(spark, "5?", sq.mean_quality("s")) == 25.0
    bad = spark.createDataFrame([("AC", "I")], "seq string, qual string")
    with pytest.raises(Exception, match="differ in length"):
        sq.check_read(bad).collect()
    reads = spark.createDataFrame([("ACGAC",), ("TCGAC",), (None,), ("",)], "seq string")
    assert rows(profile.nucleotide_distribution(reads)) == [(0, "A", 1), (0, "T", 1), (1, "C", 2), (2, "G", 2), (3, "A", 2), (4, "C", 2)]


BLOCK = "block long, name string, seq string, start long, end long, strand string"
S1, S2 = "-TCGCGTAGC---CGC-TAGCTGATGCGAT-CTGA", "ATCGCGTAGCTAGCGCG-AGCTG---CGATGCT--"


def blocks(spark):
    return spark.createDataFrame([(1, "s1", S1, 100, 129, "+"), (1, "s2", S2, 1000, 1029, "+"), (1, "s3", S2, 969, 998, "-")], BLOCK)


def test_alignment_coordinates(spark):
    b = blocks(spark)
    q = spark.createDataFrame([(1, "s1", 103, 112), (1, "s3", 972, 977)], "block long, name string, first long, stop long")
    got = sorted((r.name, r.col_start, r.col_end) for r in alignment.sequence_to_columns(b, q).collect())
    assert got == [("s1", 5, 11), ("s1", 14, 17), ("s3", 23, 24), ("s3", 27, 31)]
    q = spark.createDataFrame([(1, "s1", 9, 19), (1, "s3", 9, 19), (1, "s2", 24, 27)], "block long, name string, first long, stop long")
    got = {r.name: (r.seq_start, r.seq_end) for r in alignment.column_to_sequence(b, q).collect()}
    assert got == {"s1": (107, 113), "s3": (981, 990), "s2": (None, None)}
    q = spark.createDataFrame([(1, "s1", "s2", 103, 113), (1, "s1", "s3", 103, 113), (1, "s2", "s1", 1010, 1013)], "block long, origin string, dest string, first long, stop long")
    got = sorted((r.origin, r.dest, r.piece, r.dest_start, r.dest_end) for r in alignment.liftover(b, q).collect())
    assert got == [("s1", "s2", 1, 1004, 1010), ("s1", "s2", 2, 1013, 1016), ("s1", "s3", 1, 988, 994), ("s1", "s3", 2, 982, 985)]
    with pytest.raises(Exception, match="outside"):
        alignment.column_to_sequence(b, spark.createDataFrame([(1, "s1", 30, 99)], "block long, name string, first long, stop long")).collect()
    with pytest.raises(Exception, match="outside"):
        alignment.sequence_to_columns(b, spark.createDataFrame([(1, "s1", 1, 99)], "block long, name string, first long, stop long")).collect()
    assert alignment.check_blocks(b).count() == 0
    odd = spark.createDataFrame([(1, "a", "AC", 0, 2, "+"), (1, "b", "A", 0, 1, "+"), (2, "a", "AC", 0, 2, "+"), (2, "a", "AC", 0, 2, "+"), (3, "a", "A-", 0, 2, "+")], BLOCK)
    assert rows(alignment.check_blocks(odd)) == [(1, "sequences of unequal length"), (2, "a name occurs twice"), (3, "coordinates don't fit")]


def test_columns_and_missing_sequences(spark):
    b = spark.createDataFrame([(1, "a", "AC-T" * 40, 5, 125, "+"), (1, "b", None, 0, 9, "+")], BLOCK)
    want = spark.createDataFrame([(1, 66)], "block long, col int")
    assert [tuple(r) for r in alignment.columns_at(b, want).collect()] == [(1, 66, "a", "C")]
    got = sorted((r.name, r.nuc) for r in alignment.columns_at(b, want, alignment.GAPS).collect())
    assert got == [("a", "C"), ("b", "-")]
    c = {r.col: r.pos for r in alignment.cells(b).where("name = 'a'").collect()}
    ref, pos = 5, {}
    for i, ch in enumerate("AC-T" * 40, 1):
        pos[i] = None if ch == "-" else ref
        ref += ch != "-"
    assert c == pos
    with pytest.raises(ValueError):
        alignment.cells(b, "OTHER")


def test_conservation_and_lookup(spark):
    b = spark.createDataFrame([(1, "A.chr1", "AC-GT", 10, 14, "+"), (1, "B.x", "ACTG-", 0, 4, "+"), (1, "C.y", "TCTG-", 0, 4, "-"), (2, "A.chr1", "GG", 12, 14, "+"), (2, "B.x", "GA", 0, 2, "+"), (3, "A.chr2", "-", 5, 5, "+")], BLOCK)
    g = alignment.genome_cells(b, "A")
    pid = {(r.chrom, r.pos): r.pid for r in alignment.pid_by_position(g).collect()}
    # 12 and 13 lie in two blocks
    assert pid == {("chr1", 10): pytest.approx(2 / 3), ("chr1", 11): 1.0}
    regions = spark.createDataFrame([("chr1", 10, 12, "+"), ("chr1", 10, 12, "-"), ("chr9", 1, 2, "+")], "chrom string, start long, end long, strand string")
    got = {r.offset: r.pid for r in alignment.conservation_profile(regions, b, "A", 2).collect()}
    assert got == {0: pytest.approx((2 / 3 + 1) / 2), 1: pytest.approx((2 / 3 + 1) / 2)}
    at = lambda p: spark.createDataFrame([("chr1", p)], "chrom string, pos long")
    assert sorted((r.name, r.nuc) for r in alignment.unique_column(g, at(10)).collect()) == [("A.chr1", "A"), ("B.x", "A"), ("C.y", "T")]
    with pytest.raises(Exception, match="no unique"):
        alignment.unique_column(g, at(12)).collect()
    with pytest.raises(Exception, match="no alignment"):
        alignment.unique_column(g, at(99)).collect()
    only = alignment.genome_cells(b, "A", only=["A", "B"])
    assert {r.name for r in only.collect()} == {"A.chr1", "B.x"}
    with pytest.raises(Exception, match="without one reference"):
        alignment.genome_blocks(b, "Q").collect()


@pytest.mark.parametrize(
    ("occ", "query", "want"),
    [
        ((10001, 10468, "+", 1, 468, 468), (10005, 10015), [(5, 15)]),
        ((10001, 10468, "+", 1, 468, 468), (9995, 10015), [(1, 15)]),
        ((10001, 10468, "+", 1, 468, 468), (10460, 10470), [(460, 468)]),
        ((10469, 11447, "-", 469, 1447, 3000), (10470, 10480), [(1436, 1446)]),
        ((10469, 11447, "-", 469, 1447, 3000), (11440, 11450), [(469, 476)]),
        ((10001, 10468, "+", 1, 463, 463), (9990, 10200), [(1, 198)]),
        ((10001, 10468, "+", 1, 463, 463), (10090, 10100), [(90, 99)]),
        ((10001, 10468, "+", 1, 463, 463), (10093, 10094), []),
        ((10, 50, "-", 10, 40, 196), (8, 20), [(32, 40)]),
        ((10, 50, "-", 10, 40, 196), (40, 55), [(10, 17)]),
        ((10, 50, "-", 10, 40, 196), (13, 14), []),
        ((10, 18, "+", 110, 121, 196), (11, 14), [(111, 113), (114, 115)]),
        ((10, 18, "+", 110, 121, 196), (8, 20), [(110, 113), (114, 117), (118, 120)]),
        ((11505, 11675, "-", 5452, 5648, 196), (11508, 11520), [(5641, 5645), (5633, 5640), (5631, 5632)]),
        ((10, 18, "+", 110, 121, 196), (18, 20), []),
    ],
)
def test_coordinate_liftover(spark, occ, query, want):
    df = spark.createDataFrame([(*occ, *query)], "g_start long, g_end long, strand string, c_start long, c_end long, c_len long, q_start long, q_end long")
    assert [(r.lift_start, r.lift_end) for r in liftover.liftover_coordinates(df).orderBy("piece").collect()] == want


def adjust(p, method):
    n, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    out, run = [0.0] * n, None
    harmonic = sum(1 / i for i in range(1, n + 1)) if method == "BY" else 1
    for k in reversed(range(n)) if method != "holm" else range(n):
        raw = p[order[k]] * (n - k) if method == "holm" else p[order[k]] * n / (k + 1) * harmonic
        run = raw if run is None else max(run, raw) if method == "holm" else min(run, raw)
        out[order[k]] = min(1.0, run)
    return out


@pytest.mark.parametrize("method", ["BH", "BY", "holm", "bonferroni"])
def test_corrected_pvalues(spark, method):
    rnd = random.Random(1)
    p = [rnd.choice([rnd.random(), rnd.random() ** 9, 0.5, 0.0, 1.0]) for _ in range(500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(900, None)], "i long, p double")
    got = {r.i: r.q for r in stats.correct_pvalues(df, "p", method=method).collect()}
    want = adjust(p, method) if method != "bonferroni" else [min(1.0, x * len(p)) for x in p]
    assert got.pop(900) is None and got == {i: pytest.approx(q, rel=1e-9) for i, q in enumerate(want)}
    with pytest.raises(ValueError):
        stats.correct_pvalues(df, "p", method="none")


def test_exact_test_and_beta(spark):
    df = spark.createDataFrame([(857, 310487, 43058, 28058896), (3, 1, 1, 3), (None, 1, 1, 1)], "a long, b long, c long, d long")
    got = df.select("a", stats.fisher_exact("a", "b", "c", "d", "greater").alias("x")).select("a", "x.*").collect()
    assert got[0].p == pytest.approx(1.2056e-54, rel=1e-4) and got[0].odds_ratio == pytest.approx(1.79862, abs=1e-3)
    assert got[1].p == pytest.approx(17 / 70) and got[2].p is None
    two = df.where("a = 3").select(stats.fisher_exact("a", "b", "c", "d").alias("x")).first().x
    assert two.p == pytest.approx(34 / 70)
    assert stats.beta_values(np.array([1, 0.01]), np.array([1, 800])).tolist() == [pytest.approx(1), pytest.approx(93.00376, abs=1e-5)]
    assert stats.log_gamma(np.array([0.01, 0.5, 1, 31.9, 32, 1e6])).tolist() == pytest.approx([math.lgamma(x) for x in (0.01, 0.5, 1, 31.9, 32, 1e6)], rel=1e-13, abs=1e-13)
    b = spark.createDataFrame([(10.0, 13.0, 0.245), (11.0, 16.0, 0.76), (None, 1.0, 0.5)], "a double, b double, x double")
    r = b.select(stats.reg_incomplete_beta("a", "b", "x").alias("i"), stats.beta_pdf("x", "a", "b").alias("p"), stats.beta_cdf("x", "a", "b").alias("c"), stats.beta("a", "b").alias("v")).collect()
    assert r[0].i == pytest.approx(0.02579353, abs=1e-8) and r[1].i == pytest.approx(0.9999495, abs=1e-7) and r[0].p == pytest.approx(0.7055451, abs=1e-7) and r[0].c == r[0].i and r[2].v is None


def test_running_mean_and_draws(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 5.0), (4, 55.0)], "o long, v double").withColumn("g", F.lit(1))
    assert [r.mean for r in stats.running_mean(df, "v", "o", ["g"]).orderBy("o").collect()][-1] == 20.0
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "c string, w double")
    n = {r.c: r["count"] for r in stats.weighted_choice(w, "c", "w", 20_000).groupBy("c").count().collect()}
    assert sum(n.values()) == 20_000 and abs(n["a"] / 20_000 - 0.25) < 0.02 and "c" not in n
    p = [r.p for r in stats.random_probabilities(spark, 9).collect()]
    assert len(p) == 10 and sum(p) == pytest.approx(1) and min(p) >= 0
