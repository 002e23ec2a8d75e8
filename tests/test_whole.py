"""Queries over whole tables and texts: against their SQL, and that nothing is left out."""

import os

import pytest
from test_queries import DATA, test_query_equals_its_sql as equals_its_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_every_reference_position_is_looked_up(spark):
    from spanloom.operators import alignment
    from spanloom.plans import reference, views

    equals_its_sql(spark, "j20_column_lookup")
    got = reference.j20_column_lookup(spark, DATA)
    bases = {(r.start, r.end) for r in alignment.genome_blocks(views.blocks(spark, DATA), "A").collect()}
    assert got.select("pos").distinct().count() == sum(e - s for s, e in bases)


def test_positions_in_several_blocks_are_left_out(spark):
    from spanloom.operators import alignment

    rows = [(1, "A.c", "AC-G", 10, 13, "+"), (1, "B.c", "ATTG", 0, 4, "+"), (2, "A.c", "GT", 12, 14, "+"), (2, "B.c", "G-", 7, 8, "+"), (3, "A.c", "C-A", 30, 32, "-"), (3, "B.c", None, 5, 9, "+")]
    b = spark.createDataFrame(rows, "block long, name string, seq string, start long, end long, strand string")
    got = alignment.unique_columns(b, "A")
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(10, "A.c", "A"), (10, "B.c", "A"), (11, "A.c", "C"), (11, "B.c", "T"), (13, "A.c", "T"), (13, "B.c", "-"), (30, "A.c", "A"), (30, "B.c", "-"), (31, "A.c", "C"), (31, "B.c", "-")]


def test_every_order_is_joined(spark):
    from spanloom.common import table
    from spanloom.plans import reference

    equals_its_sql(spark, "j10_unpaired")
    got = reference.j10_unpaired(spark, DATA)
    assert got.where("o_orderkey <> 'NA'").select("o_orderkey").distinct().count() == table(spark, DATA, "orders").count()
    assert got.where("c_name = 'NA'").count() > 0 and got.where("o_orderkey = 'NA'").count() > 0


def test_whole_sequences_are_sliced_and_compared(spark):
    from spanloom.plans import reference, views

    equals_its_sql(spark, "q06_gapped_subsequence")
    equals_its_sql(spark, "q07_similarity")
    got = {}
    for r in reference.q06_gapped_subsequence(spark, DATA).orderBy("k").collect():
        got[r.doc_id] = got.get(r.doc_id, "") + r.piece
    assert got == {r.doc_id: r.seq.replace("N", "-") for r in views.seqs(spark, DATA).collect()}


def clipped(seq, adaptor="AGATCGGAAG", least=8):
    n, k = len(seq), len(adaptor)
    for i in [*range(n - k, -1, -1), *range(-1, -k, -1)] if n >= k else range(-1, -k, -1):
        a = max(i, 0)
        if sum(x == y for x, y in zip(seq[a : i + k], adaptor[a - i :])) >= least:
            return seq[:a] + "N" * (n - a)
    return seq


def test_adaptors_are_clipped_anywhere(spark, tmp_path):
    from spanloom.plans import reference, views

    texts = ["T" * 90 + "AGATCGGAAG" + "T" * 9, "T" * 200 + "AGCTCGGATG", "ATCGGAAG" + "T" * 20, "AGATCGGA", "AGAT"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (DATA, str(tmp_path)):
        want = {r.doc_id: clipped(r.seq) for r in views.seqs(spark, d).collect()}
        got = {r.doc_id: r.clipped for r in reference.q15_clip_adaptor(spark, d).collect()}
        assert got == want
    assert got == {0: "T" * 90 + "N" * 19, 1: "T" * 200 + "N" * 10, 2: "N" * 28, 3: "AGATCGGA", 4: "AGAT"}


def test_all_edits_are_spelled_out(spark):
    from spanloom.operators import parse_errors

    df = spark.createDataFrame([(1, "bed", "\t".join("a" * 300)), (2, "bed", 'a"b\t' * 150 + "c")], "line_id long, record_kind string, line string")
    for r in parse_errors.parse_lines(df).collect():
        assert r.n_edits > 100 and len(r.edits.split(",")) == r.n_edits


def test_table_of_several_files(spark, tmp_path):
    from spanloom.sources import sinks, text

    equals_its_sql(spark, "sc20_table")
    want = [("a", "b"), *((str(i), "x" * (i % 9)) for i in range(1, 400))]  # a row like the header stays
    df = spark.createDataFrame(want, "a string, b string")
    sinks.write_table(df.where("length(a) < 9").repartition(5), f"{tmp_path}/t")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "300b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = text.read_table(spark, f"{tmp_path}/t")
        assert sorted(tuple(r) for r in got.drop("ord").collect()) == sorted(want)
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("name", ["l01_columns", "l02_column_to_sequence", "l03_sequence_to_columns", "l04_liftover"])
def test_whole_blocks_are_mapped(spark, name):
    equals_its_sql(spark, name)
