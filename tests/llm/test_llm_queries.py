"""The registered training-text queries on the smallest tables."""

import os

import pytest

pytest.importorskip("spanloom.llm")

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def registered():
    from spanloom.llm import queries

    return queries


def test_pieces_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    q, c = registered(), duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = sorted(map(tuple, q.QUERIES["p5_found"](spark, DATA).select("region_id", "piece_no", "piece_start", "piece_end").collect()))
    assert got and got == sorted(c.sql(f"select region_id, piece_no, piece_start, piece_end from ({q.SQL['p5_found']})").fetchall())


def test_ids_of_every_document(spark):
    pytest.importorskip("tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in registered().QUERIES["p6_ids"](spark, DATA).collect()}
    assert got == {k: e.ids for k, e in zip(texts, t.encode_batch(list(texts.values()), add_special_tokens=False))}


def test_pieces_of_every_text_join_to_it(spark):
    from spanloom.llm import queries, split

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    joined = {}
    for r in split.split_texts(docs, queries.TEXT_LIMIT, queries.TEXT_OVERLAP).orderBy("doc_id", "piece_no").collect():
        assert len(r.piece) <= queries.TEXT_LIMIT
        joined[r.doc_id] = joined.get(r.doc_id, "") + r.piece[queries.TEXT_OVERLAP if r.piece_no > 1 else 0 :]
    assert joined == texts


@pytest.mark.parametrize("name", ["p7_found", "p7_items", "p8_found"])
def test_searches_run_over_all_documents(spark, name):
    df = registered().QUERIES[name](spark, DATA)
    got = df.collect()
    assert len(got) == len({tuple(r) for r in got})
