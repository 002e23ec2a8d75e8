"""Key joins, paired streams, exon counts and junction reads: fixed cases."""

import pytest
from conftest import rows

from spanloom.operators import exons, keyjoin, paired


def tab(spark, cols, *data):
    return spark.createDataFrame([tuple(d) for d in data], ", ".join(f"{c} {'long' if c == 'o' else 'string'}" for c in cols))


def left(spark, keys, order=False):
    cols = ["A", "B", "C", "D"] + ["o"] * order
    return tab(spark, cols, *[(f"A{i}", k, f"C{i}", f"D{i}", *([i] * order)) for i, k in enumerate(keys, 1)])


def right(spark, keys, order=False):
    cols = ["X", "B", "Y", "Z"] + ["o"] * order
    return tab(spark, cols, *[(f"X{i}", k, f"Y{i}", f"Z{i}", *([i] * order)) for i, k in enumerate(keys, 1)])


def test_inner_join_and_names(spark):
    got = keyjoin.join_tables(left(spark, ["B1", "B2", "B3"]), right(spark, ["B3", "B1", "B9"]), "B")
    assert got.columns == ["A", "B", "C", "D", "X", "Y", "Z"]
    assert rows(got) == [("A1", "B1", "C1", "D1", "X2", "Y2", "Z2"), ("A3", "B3", "C3", "D3", "X1", "Y1", "Z1")]
    clash = keyjoin.join_tables(left(spark, ["B1"]), left(spark, ["B1"]), "B")
    assert clash.columns == ["A", "B", "C", "D", "A_2", "C_2", "D_2"]


def test_duplicate_policies(spark):
    keys, other = ["B1", "B1", "B3", "B3", "B5"], ["B1", "B3", "B5"]
    with pytest.raises(keyjoin.DuplicateKeyError):
        keyjoin.join_tables(left(spark, keys), right(spark, other), "B")
    with pytest.raises(keyjoin.DuplicateKeyError):
        keyjoin.join_tables(right(spark, other), left(spark, [*keys]), "B")
    pairs = keyjoin.join_tables(left(spark, keys), right(spark, other), "B", policy="all_pairwise_combinations")
    assert pairs.count() == 5
    fold = keyjoin.join_tables(left(spark, keys, True), right(spark, other, True), "B", policy="column_wise_join", order="o", right_order="o")
    assert rows(fold) == [("A1;A2", "B1", "C1;C2", "D1;D2", "X1", "Y1", "Z1"), ("A3;A4", "B3", "C3;C4", "D3;D4", "X2", "Y2", "Z2"), ("A5", "B5", "C5", "D5", "X3", "Y3", "Z3")]
    bare = keyjoin.join_tables(left(spark, keys, True), right(spark, other, True), "B", policy="column_wise_join", order="o", right_order="o", header=False)
    assert ("A1;A2", "B1;B1", "C1;C2", "D1;D2", "X1", "Y1", "Z1") in rows(bare)
    with pytest.raises(keyjoin.TableJoinError):
        keyjoin.join_tables(left(spark, keys), right(spark, other), "B", policy="other")


def test_shared_seen_values(spark):
    a = tab(spark, ["k", "p", "q", "o"], ("1", "x", "y", 1), ("1", "y", "z", 2), ("1", "z", "w", 3), ("1", "1", "x", 4))
    got = keyjoin.fold_columns(a, "k", "o", ["k", "p", "q"], True).first()
    # y was there in q, z came in q before p, 1 is the key, x was there in p
    assert tuple(got) == ("1", "1", "x", "y;z;w")


def test_unpaired_and_missing(spark):
    a, b = left(spark, ["B1", "B3"]), right(spark, ["B1", "B2", "B4"])
    with pytest.raises(keyjoin.MissingValueError):
        keyjoin.join_tables(a, b, "B", unpaired=True)
    got = rows(keyjoin.join_tables(a, b, "B", missing="MV", unpaired=True))
    assert ("MV", "MV", "MV", "MV", "X2", "Y2", "Z2") in got and ("A2", "B3", "C2", "D2", "MV", "MV", "MV") in got and len(got) == 4
    blank, other = left(spark, ["B1", "  "]), right(spark, ["B1", ""])
    with pytest.raises(keyjoin.MissingKeyError):
        keyjoin.join_tables(blank, other, "B")
    assert keyjoin.join_tables(blank, other, "B", skip_blank_keys=True).count() == 1
    assert ("A2", "MV", "C2", "D2", "X2", "Y2", "Z2") in rows(keyjoin.join_tables(blank, other, "B", missing="MV"))
    with pytest.raises(keyjoin.InvalidHeaderError):
        keyjoin.join_tables(a, b, "Q")
    for bad in (["a", ""], ["a", "a"]):
        with pytest.raises(keyjoin.InvalidHeaderError):
            keyjoin.check_header(bad, "a")


IV = "chrom string, start long, end long, name string, score long, strand string"


def test_paired_streams(spark):
    f1 = spark.createDataFrame([("chr1", 10, 15, "a", 1, "+"), ("chr1", 20, 25, "b", 2, "+"), ("chr1", 40, 47, "c", 3, "+"), ("chr2", 10, 15, "d", 4, "-")], IV)
    f2 = spark.createDataFrame([("chr1", 20, 25, "e", 5, "-"), ("chr1", 40, 47, "f", 6, "+"), ("chr2", 10, 15, "g", 7, "-"), ("chr3", 20, 25, "h", 8, "+")], IV)
    f3 = spark.createDataFrame([("chr1", 40, 47, "i", 9, "+"), ("chr2", 10, 15, "j", 10, "+")], IV)
    got = paired.paired([f1, f2, f3], ignore_strand=True)
    assert sorted((r.s0_chrom, r.s0_start, r.s0_score, r.s1_score, r.s2_score) for r in got.collect()) == [("chr1", 40, 3, 6, 9), ("chr2", 10, 4, 7, 10)]
    full = paired.paired([f1, f2, f3], mirror=True, mirror_score=0).collect()
    assert len(full) == 7 and all(r.s0_start == r.s1_start == r.s2_start for r in full)
    one = next(r for r in full if r.s0_chrom == "chr3")
    assert (one.s0_name, one.s0_score, one.s1_score, one.s2_score) == ("h", 0, 8, 0)
    own = paired.paired([f1, f2], mirror=True).collect()
    assert next(r for r in own if r.s0_chrom == "chr3").s0_score == 8
    twice = paired.paired([f1.unionByName(f1), f1], mirror=True, mirror_score=-1).collect()
    assert len(twice) == 8 and sum(r.s1_score == -1 for r in twice) == 4
    assert paired.paired([f1.limit(0), f2.limit(0)], mirror=True).count() == 0
    with pytest.raises(ValueError):
        paired.paired([f1])


READ = "name string, score long"


def test_duplicates_and_unique(spark):
    a = spark.createDataFrame([("read3.1", 0), ("read9.1%1", 0), ("read9.1%2", 0), ("read1.1", 0)], READ)
    b = spark.createDataFrame([("read3.2%1", 0), ("read3.2%2", 0), ("read9.2", 0), ("read7.2", 0)], READ)
    got = {r.name: (r.first, r.second) for r in paired.duplicates(a, b, True, True).collect()}
    assert got == {"read3": (["read3.1"], ["read3.2%1", "read3.2%2"]), "read9": (["read9.1%1", "read9.1%2"], ["read9.2"]), "read1": (["read1.1"], []), "read7": ([], ["read7.2"])}
    with pytest.raises(ValueError):
        paired.duplicates(a, b, paired_end=True)
    x = spark.createDataFrame([("read1", 1), ("read4", 1), ("read5", 1), ("read6", 1)], READ)
    y = spark.createDataFrame([("read3", 1), ("read5", 2)], READ)
    one, two = paired.remove_duplicates(x, y)
    assert [r.name for r in one.orderBy("name").collect()] == ["read1", "read4", "read6"] and [r.name for r in two.collect()] == ["read3"]
    best, _ = paired.remove_duplicates(x, y, best=True)
    assert "read5" in [r.name for r in best.collect()]
    ties, other = paired.remove_duplicates(x, x, best=True)
    assert ties.count() == 0 and other.count() == 0


def test_exons_to_genes(spark):
    genes = spark.createDataFrame([("chr1", 10, 80, "NM_001", 0, "+"), ("chr1", 20, 120, "NM_002", 0, "-"), ("chr2", 5, 6, "NM_009", 0, "+"), ("chr2", 5, 6, "NM_009", 0, "+")], IV)
    counts = spark.createDataFrame([("NM_001_exon_1_0_chr1_10_f", 10), ("NM_001_exon_2_0_chr1_80_f", 20), ("NM_001_exon_3_0_chr1_81_f", 40), ("NM_002_exon_1_0_chr1_60_r", 60), ("NM_002_exon_1_0_chr1_60_f", 7), (None, 3)], "name string, count long")
    got = sorted((r.name, r.score) for r in exons.exons_to_genes(genes, exons.parse_exons(counts)).collect())
    assert got == [("NM_001", 30), ("NM_002", 60), ("NM_009", 0), ("NM_009", 0)]
    bad = spark.createDataFrame([("nonsense", 1), ("N_exon_2_0_chr11_random_v2_5_r", 2)], "name string, count long")
    assert [tuple(r) for r in exons.parse_exons(bad, strict=False).collect()] == [("N", 2, "chr11_random_v2", 5, "-", 2)]
    with pytest.raises(Exception, match="not an exon name"):
        exons.parse_exons(bad).collect()


def test_junctions(spark):
    df = spark.createDataFrame([("chr_1_100_140_200_260", 5, 60, "r", 1, "+"), ("chr2_10_20_50_90", 1, 35, "q", 2, "-"), ("chr2_10_20_50_90", 1, 35, "n", 2, None)], IV)
    want = {"r%1": ("chr_1", 104, 140), "r%2": ("chr_1", 200, 219), "q%1": ("chr2", 10, 20), "q%2": ("chr2", 50, 74), "n%1": ("chr2", 10, 20), "n%2": ("chr2", 50, 74)}
    get = lambda scheme: {r.name: (r.chrom, r.start, r.end) for r in exons.junctions_to_exons(df, scheme).collect()}
    assert get("BOTH") == want
    assert set(get("FIRST")) == {"r%1", "q%1", "n%1"} and set(get("SECOND")) == {"r%2", "q%2", "n%2"}
    assert set(get("BIGGEST")) == {"r%1", "q%2", "n%2"} and set(get("FIVE_PRIME_END")) == {"r%1", "q%2", "n%1"}
    with pytest.raises(ValueError):
        exons.junctions_to_exons(df, "NONE")
    with pytest.raises(Exception, match="not a junction"):
        exons.junctions_to_exons(df.selectExpr("'chr1' as chrom", "start", "end", "name", "score", "strand")).collect()
