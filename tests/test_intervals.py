"""Interval operators: fixed cases and brute force."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import overlap, predicates, profile, setops
from spanloom.operators.islands import islands, members

IV = "chrom string, start long, end long, name string, score long, strand string"


def iv(spark, *items):
    return spark.createDataFrame([(c, s, e, n, sc, st) for c, s, e, n, sc, st in (tuple(x) + ("x", 0, "+")[len(x) - 3 :] for x in items)], IV)


COLLAPSE = [("chr1", 10, 20, "R1", 0, "+"), ("chr1", 30, 40, "R2", 0, "+"), ("chr1", 35, 50, "R3", 0, "+"), ("chr1", 45, 65, "R4", 0, "+"), ("chr1", 55, 60, "R5", 0, "-"), ("chr1", 70, 80, "R6", 0, "+"), ("chr1", 75, 95, "R7", 0, "+"), ("chr1", 85, 90, "R8", 0, "-"), ("chr2", 40, 60, "R9", 0, "+"), ("chr3", 10, 20, "R10", 0, "+"), ("chr3", 20, 30, "R11", 0, "-")]


@pytest.mark.parametrize("width", [8, 1 << 20])
def test_collapse(spark, width):
    df = iv(spark, *COLLAPSE, ("chr9", 1, 5, "n", 0, None))
    got = [r[:3] for r in rows(setops.collapse(df, width=width))]
    assert got == [("chr1", 10, 20), ("chr1", 30, 65), ("chr1", 70, 95), ("chr2", 40, 60), ("chr3", 10, 30)]
    got = sorted((r.strand, r.chrom, r.start, r.end) for r in setops.collapse(df, True, width).collect())
    plus = [("+", "chr1", 10, 20), ("+", "chr1", 30, 65), ("+", "chr1", 70, 95), ("+", "chr2", 40, 60), ("+", "chr3", 10, 20)]
    assert got == plus + [("-", "chr1", 55, 60), ("-", "chr1", 85, 90), ("-", "chr3", 20, 30)]
    names = {(r.chrom, r.start): r.name for r in setops.collapse_names(df, width=width).collect()}
    assert names[("chr1", 30)] == "R2;R3;R4;R5" and names[("chr3", 10)] == "R10;R11"


@pytest.mark.parametrize("width", [4, 32, 1 << 20])
def test_islands_against_brute_force(spark, width):
    rnd = random.Random(width)
    items = [(rnd.choice(["a", "b", None]), s, s + rnd.choice([0, 1, 3, 40, -2])) for s in (rnd.randrange(-60, 400) for _ in range(300))]
    df = spark.createDataFrame(items, "chrom string, start long, end long")
    want, of = [], {}
    for k in ("a", "b", None):
        last = None
        for s, e in sorted((s, e) for c, s, e in items if c == k and s < e):
            if last and s <= last[1]:
                last[1] = max(last[1], e)
            else:
                last = [s, e]
                want.append((k, last))
            of[(k, s, e)] = last
    got = islands(df, ["chrom"], width=width)
    assert sorted(((r.chrom, r.start, r.end) for r in got.collect()), key=str) == sorted(((k, *x) for k, x in want), key=str)
    for r in members(df, ["chrom"], width=width).collect():
        assert r.island == of[(r.chrom, r.start, r.end)][0]


def test_collapse_exact(spark):
    data = [("chr1", 10, 20, "R01", 0, "+"), ("chr1", 10, 20, "R02", 0, "+"), ("chr1", 10, 20, "R01", 0, "+"), ("chr1", 45, 65, "R04", 0, "+"), ("chr1", 55, 60, "R05", 3, "-"), ("chr1", 55, 60, "R06", 0, "+"), ("chr3", 10, 20, "R11", 4, "+"), ("chr3", 10, 20, "R12", 0, "-")]
    df = iv(spark, *data).withColumn("o", F.monotonically_increasing_id())
    got = {(r.chrom, r.start): (r.name, r.score, r.strand) for r in setops.collapse_exact(df, "o").collect()}
    assert got[("chr1", 10)] == ("R01;R02", 0, "+") and got[("chr1", 55)] == ("R05;R06", 3, "-") and got[("chr3", 10)] == ("R11;R12", 4, "+")
    assert setops.collapse_exact(df, "o", stranded=True).count() == 6


def test_intersection_and_jaccard(spark):
    a = iv(spark, ("chr1", 10, 20), ("chr1", 70, 80), ("chr2", 5, 10), ("chr2", 70, 75), ("chr2", 90, 95))
    b = iv(spark, ("chr1", 7, 12), ("chr1", 67, 70), ("chr1", 75, 85), ("chr2", 20, 30), ("chr2", 73, 92))
    got = [r[:3] for r in rows(setops.intersection(a, b))]
    assert got == [("chr1", 10, 12), ("chr1", 75, 80), ("chr2", 73, 75), ("chr2", 90, 92)]
    assert abs(setops.jaccard(a, b).first().jaccard - 0.1549296) < 1e-7
    assert setops.jaccard(a.limit(0), b.limit(0)).first().jaccard is None


def test_subtract(spark):
    a = iv(spark, ("chr1", 10, 100, "x"), ("chr4", 1, 5, "pass"), ("chr1", 16, 18, "gone"))
    b = iv(spark, ("chr1", 1, 8), ("chr1", 15, 20), ("chr1", 50, 60), ("chr1", 90, 120), ("chr2", 30, 40))
    assert [(r[3], r[1], r[2]) for r in rows(setops.subtract(a, b))] == [("x", 10, 15), ("x", 20, 50), ("x", 60, 90), ("pass", 1, 5)]
    assert setops.subtract(a, b.limit(0)).count() == 3


def test_bucket_join(spark):
    buckets = iv(spark, ("chr1", 1, 6, "g1"), ("chr1", 4, 10, "g2"), ("chr1", 5, 19, "g3"), ("chr1", 9, 15, "g4"), ("chr1", 18, 22, "g5"), ("chr2", 1, 12, "g6"), ("chr2", 4, 7, "g7"), ("chr7", 1, 2, "g8"))
    e = iv(spark, *[("chr1", s, t, f"e{i}") for i, (s, t) in enumerate([(2, 3), (4, 5), (4, 5), (7, 9), (7, 8), (10, 14), (12, 20), (20, 23), (24, 26)], 1)], *[("chr2", s, t, f"e{i}") for i, (s, t) in enumerate([(1, 3), (2, 6), (4, 8), (10, 15)], 10)])
    got = {r.name: r.hits for r in overlap.bucket_join(buckets, e).collect()}
    assert got == {"g1": ["e1", "e2", "e3"], "g2": ["e2", "e3", "e5", "e4"], "g3": ["e5", "e4", "e6", "e7"], "g4": ["e6", "e7"], "g5": ["e7", "e8"], "g6": ["e10", "e11", "e12", "e13"], "g7": ["e11", "e12"], "g8": []}
    counts = {r.name: r.n_overlaps for r in overlap.count_overlaps(buckets, e).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert {r.name: r.score for r in profile.read_counts(buckets, e).collect()} == counts


def _random(rnd, n):
    return [(rnd.choice(["c1", "c2"]), s, s + rnd.choice([0, 1, 5, 900, 1100, 20_000, 400_000]), f"i{i}") for i, s in enumerate(rnd.randrange(-5000, 500_000) for _ in range(n))]


@pytest.mark.parametrize("closed", [False, True])
def test_overlap_join_against_all_pairs(spark, closed):
    rnd = random.Random(closed)
    x, y = _random(rnd, 300), _random(rnd, 200)
    a, b = iv(spark, *x, (None, 1, 2, "n"), ("c1", None, 2, "n"), x[0]), iv(spark, *y)
    k = 1 if closed else 0
    want = sorted((p[3], q[3]) for p in [*x, x[0]] for q in y if p[0] == q[0] and p[1] < q[2] + k and q[1] < p[2] + k)
    assert sorted((r.a_name, r.b_name) for r in overlap.overlap_join(a, b, closed=closed).collect()) == want
    hit = {p for p, _ in want}
    left = overlap.overlap_join(a, b, how="left", closed=closed).collect()
    assert sorted((r.a_name, r.b_name) for r in left if r.b_name) == want
    assert sorted(r.a_name for r in left if not r.b_name) == sorted([p[3] for p in x if p[3] not in hit] + ["n", "n"] + ([x[0][3]] if x[0][3] not in hit else []))
    assert sorted(r.a_name for r in overlap.overlap_join(a, b, how="left_semi", closed=closed).collect()) == sorted(p[3] for p in [*x, x[0]] if p[3] in hit)
    assert overlap.overlap_join(a.limit(0), b).count() == 0 and overlap.overlap_join(a, b.limit(0), how="left_anti").count() == a.count()


def test_points(spark):
    t = spark.createDataFrame([("c", 10, 15, 1.0), ("c", 15, 20, 2.0)], "chrom string, start long, end long, score double")
    p = spark.createDataFrame([("c", x) for x in (9, 10, 15, 20, 21)], "chrom string, pos long")
    assert sorted((r.a_pos, r.b_score) for r in overlap.stab_join(p, t).collect()) == [(10, 1.0), (15, 2.0)]
    assert sorted((r.a_pos, r.b_score) for r in overlap.stab_join(p, t, closed=True).collect()) == [(10, 1.0), (15, 1.0), (15, 2.0), (20, 2.0)]
    assert sorted(tuple(r)[1:] for r in overlap.lookup(p, t).collect() if r.covered) == [(10, True, 1.0), (15, True, 2.0)]
    with pytest.raises(Exception, match="point in 0"):
        overlap.lookup(p, t, strict=True).collect()
    with pytest.raises(Exception, match="point in 2"):
        overlap.lookup(p, t.unionByName(t)).collect()


@pytest.mark.parametrize(("a", "b", "want"), [((15, 18), (18, 25), False), ((16, 18), (10, 16), False), ((15, 18), (10, 16), True), ((15, 18), (17, 26), True), ((15, 18), (1, 30), True), ((15, 18), (15, 15), True), ((15, 18), (18, 18), True), ((15, 18), (14, 14), False)])
def test_intersects(spark, a, b, want):
    df = spark.createDataFrame([("c", *a, "c", *b)], "a_chrom string, a_start long, a_end long, b_chrom string, b_start long, b_end long")
    assert df.select(predicates.intersects()).first()[0] is want


def test_interval_scalars(spark):
    df = spark.createDataFrame([("c", 10, 20, "c", 30, 40), ("c", 30, 40, "c", 10, 20), ("c", 10, 20, "c", 20, 25), ("c", 10, 20, "c", 15, 18)], "a_chrom string, a_start long, a_end long, b_chrom string, b_start long, b_end long")
    got = [tuple(r) for r in df.select(predicates.distance(), predicates.signed_distance(), predicates.overlap_size(), predicates.before()).collect()]
    assert got == [(10, 10, 0, True), (10, -10, 0, False), (0, 0, 0, True), (0, 0, 3, False)]
    with pytest.raises(Exception, match="different chromosomes"):
        spark.createDataFrame([("c", 1, 2, "d", 1, 2)], df.schema).select(predicates.distance()).collect()


@pytest.mark.parametrize(("strand", "size", "want"), [("+", 11, (17, 28)), ("-", 11, (17, 28)), ("+", 10, (17, 27)), ("-", 10, (18, 28)), ("+", 15, (15, 30)), (None, 10, (17, 27))])
def test_transform_center(spark, strand, size, want):
    df = spark.createDataFrame([(15, 30, strand)], "start long, end long, strand string")
    assert tuple(df.select(*predicates.transform_center(size)).first()) == want
    if size == 10:
        back = spark.createDataFrame([(*want, strand)], df.schema)
        assert tuple(back.select(*predicates.transform_center(15)).first()) == (15, 30)
    with pytest.raises(ValueError):
        predicates.transform_center(0)


def test_overlap_profile(spark):
    regions = iv(spark, ("chr1", 10, 20, "a", 0, "-"), ("chr1", 50, 70, "b", 0, "+"), ("chr2", 15, 30, "c", 0, "+"))
    hits = iv(spark, *[("chr1", s, s + 3) for s in (11, 15, 40, 51, 55, 65)], *[("chr2", s, s + 3) for s in (10, 16, 33)])
    got = {r.pos: r.value for r in profile.overlap_profile(regions, hits, "START", True).collect()}
    assert got == {i: pytest.approx({1: 1.0, 5: 2 / 3, 15: 1.0}.get(i, 0.0)) for i in range(16)}
    got = {r.pos: r.value for r in profile.overlap_profile(regions, hits, "5PRIME", True).collect()}
    assert got == {i: pytest.approx({1: 2 / 3, 4: 1 / 3, 5: 1 / 3, 8: 1 / 3, 15: 1.0}.get(i, 0.0)) for i in range(16)}
    assert profile.overlap_profile(regions, hits.limit(0)).count() == 0


def test_consensus_coverage_and_gaps(spark):
    df = spark.createDataFrame([("r", 1, 4), ("r", 2, 6), ("s", 5, 5)], "name string, start long, end long")
    assert rows(profile.consensus_coverage(df)) == [("r", 1, 1), ("r", 2, 2), ("r", 3, 2), ("r", 4, 1), ("r", 5, 1)]
    assert rows(setops.gaps(iv(spark, ("c", 1, 3), ("c", 7, 9), ("c", 2, 5)))) == [("c", 5, 7)]


def test_counts_without_pairs_equal_pairs(spark):
    import random

    from spanloom.operators import overlap, sweep

    rnd = random.Random(11)

    def some(n, odd):
        return [(rnd.choice(["a", "b", None]) if i % 4 else "hot", s := rnd.randrange(-40, 300), s + rnd.choice([1, 2, 9, 80, *odd]), i % 7) for i in range(n)]

    for odd_a, odd_b in (([], []), ([], [0]), ([0, -3], [0]), ([0, -3], [0, -2])):
        a, b = some(200, odd_a), some(400, odd_b)
        a += a[:9]
        want = sorted((str(c), s, e, k, sum(1 for d, x, y, _ in b if c is not None and c == d and x < e and s < y)) for c, s, e, k in a)
        ra, rb = spark.createDataFrame(a, "chrom string, start long, end long, k int"), spark.createDataFrame(b, "chrom string, start long, end long, k int")
        got = sorted((str(r[0]), *r[1:]) for r in overlap.count_overlaps(ra, rb).collect())
        assert got == want
    got = sorted((str(r[0]), *r[1:]) for r in sweep.counts(ra.where("start < end"), rb.where("start <= end"), width=8).collect())
    assert got == sorted((str(c), s, e, k, sum(1 for d, x, y, _ in b if c is not None and c == d and x <= y and x < e and s < y)) for c, s, e, k in a if s < e)


def test_stretches_and_depths_across_slices(spark):
    import random

    from spanloom.operators import islands, setops, sweep

    rnd = random.Random(2)
    sides = [[(rnd.choice("ab"), s := rnd.randrange(-30, 400), s + rnd.choice([0, 1, 3, 9, 120, -4]), "+") for _ in range(60)] for _ in range(2)]
    covered = [{(c, x) for c, s, e, _ in side for x in range(s, e)} for side in sides]
    a, b = (spark.createDataFrame(s, "chrom string, start long, end long, strand string") for s in sides)
    bits = lambda rows: {(r.chrom, x) for r in rows for x in range(r.start, r.end)}
    for width in (4, 1 << 20):
        rows = islands.islands(a, ["chrom"], width=width).collect()
        assert bits(rows) == covered[0] and sum(r.end - r.start for r in rows) == len(covered[0])
        assert all((c, r.start - 1) not in covered[0] and (c, r.end) not in covered[0] for r in rows for c in [r.chrom])
    shared = setops.intersection(a, b).collect()
    assert bits(shared) == covered[0] & covered[1] and all((r.chrom, r.end) not in covered[0] & covered[1] for r in shared)
    j = setops.jaccard(a, b).first()
    assert (j.shared, j.total) == (len(covered[0] & covered[1]), len(covered[0] | covered[1]))
    d = sweep.depths(sweep.events(a, ["chrom"], 0, 1), ["chrom"], 1, width=4).where("until is not null").collect()
    for r in d:
        assert r.depth0 == sum(1 for c, s, e, _ in sides[0] if c == r.chrom and s <= r.pos < e)
    assert setops.jaccard(a.limit(0), b.limit(0)).first().jaccard is None
