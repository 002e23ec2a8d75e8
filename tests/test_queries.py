"""Registered queries against their own SQL in DuckDB on the smallest tables, and the operators' odd corners."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import overlap, predicates, skew

DATA = "/root/testdata/sf0.001"
CHOSEN = ["p1_found", "p1_report", "p2_found", "p2_edits", "p2_loaded_bed", "p3_found", "p4_found", "j02_overlap_join", "j05_bucket_counts", "j10_unpaired", "j13_paired_mirror", "j18_exons_to_genes", "i01_collapse", "i05_intersection", "i06_jaccard", "i07_subtract",
          "l05_occurrence_liftover", "l06_liftover_coordinates", "m01_bh", "m01_by", "m03_fisher", "m04_beta", "m07_weighted_choice", "sc03_wig_any", "sc12_maf", "sc12_maf_lines", "sc18_repeat_alignments", "q04_subsequence", "q15_clip_adaptor", "a02_nucleotide_distribution", "a03_profile_start", "a04_conservation_profile", "a05_region_profiles", "a06_pid", "a07_running_mean", "a10_lifted_coverage", "c01_join_mixed_headers", "c10_fdr", "st2_interval_state"]


def cell(x):
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df = e.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(x) for x in r) for r in df.select(*[f"`{x}`" for x in cols]).collect())
    want = c.sql(e.oracle_sql()[name])
    at = [want.columns.index(x) for x in cols]
    assert sorted(want.columns) == cols
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall()) and got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["chrom", "start", "end", "name", "strand", "score"] and df.count() > 0


@pytest.mark.parametrize(("anchor", "width", "want"), [("start", 4, (8, 12)), ("start", 5, (7, 12)), ("end", 4, (19, 23)), ("end", 5, (19, 24)), ("middle", 4, (13, 17)), ("middle", 5, (13, 18))])
def test_anchor_window(spark, anchor, width, want):
    df = spark.createDataFrame([(10, 21, "-")], "start long, end long, strand string")
    assert tuple(df.select(*predicates.anchor_window(anchor, width)).first()) == want


def test_equality_of_intervals(spark):
    schema = ", ".join(f"{p}_{c}" for p in "ab" for c in ("chrom string", "start long", "end long", "name string", "score long", "strand string"))
    df = spark.createDataFrame([("c", 1, 2, None, 5, "+", "c", 1, 2, None, 6, "+"), ("c", 1, 2, "x", 5, "+", "c", 1, 2, "x", 5, None)], schema)
    assert [tuple(r) for r in df.select(predicates.same_region(), predicates.equal()).collect()] == [(True, False), (False, False)]


def test_levels_and_sortedness(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 0, 5000), ("c", 3, 3), ("c", None, 3)], "chrom string, start long, end long")
    assert overlap.levels(df, df.limit(0)) == ([8, 14], [])
    ok = spark.createDataFrame([(1, "c", 1), (2, "c", 4), (3, "d", 2)], "o long, chrom string, start long")
    assert overlap.assert_sorted(ok, "start", lambda: F.col("o")).count() == 3
    with pytest.raises(Exception, match="not sorted"):
        overlap.assert_sorted(ok.withColumn("start", -F.col("start")), "start", lambda: F.col("o")).collect()


def test_hot_keys_with_clashing_column_names(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i, i, i) for i in range(300)], "chrom string, id long, _rank long, __salt long")
    got = skew.top_per_key(df, "chrom", [F.col("id").desc()], 1, F.col("id"))
    assert got.columns == df.columns
    best = {}
    for i in range(300):
        best["hot" if i % 3 else f"k{i % 7}"] = i
    assert rows(got) == sorted((k, i, i, i) for k, i in best.items())


def test_heavy_keys_are_found(spark):
    df = spark.createDataFrame([("a" if i % 2 else f"r{i}",) for i in range(4000)] + [(None,)] * 4000, "k string")
    found = skew.heavy_keys(df, "k", 0.1)
    assert [x[0] for x in found] == ["a"] and found[0][2] == 4000
    assert skew.heavy_keys(df.limit(0), "k") == []
