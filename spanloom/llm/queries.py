"""Queries of the training-text operators and, where it can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.common import table
from spanloom.llm import leakage, split, stuffing, tokenize

TEXT_LIMIT, TEXT_OVERLAP = 1000, 100


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_regions(table(spark, d, "regions"), table(spark, d, "contig_breaks"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_texts(table(spark, d, "documents"), TEXT_LIMIT, TEXT_OVERLAP)
    return pieces.select("doc_id", "piece_no", "piece_start", F.length("piece").alias("piece_chars"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked test item: how many documents carry it, and the largest share of it that one carries."""
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.round(F.max("share"), 6).alias("most"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.find_stuffed(table(spark, d, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_found, p5_texts, p6_ids, p7_found, p7_items, p8_found)}

SQL = {
    "p5_found": """
with recursive b as (select distinct trim(chrom) as chrom, pos from contig_breaks where chrom is not null and pos is not null),
r as (select region_id, trim(chrom) as chrom, "start" as s0, "end" as e0 from regions where chrom is not null and "end" - "start" > 100000),
p as (
  select region_id, chrom, e0, 1 as piece_no, s0 as s, coalesce((select max(pos) from b where b.chrom = r.chrom and pos > s0 + 50000 and pos <= s0 + 100000), s0 + 100000) as e from r
  union all
  select region_id, chrom, e0, piece_no + 1, e - 2000,
    case when e0 <= e + 98000 then e0 else coalesce((select max(pos) from b where b.chrom = p.chrom and pos > p.e + 48000 and pos <= p.e + 98000), e + 98000) end
  from p where e < e0)
select region_id, piece_no, s as piece_start, e as piece_end from p""",
    "p5_texts": f"""
with b as (select doc_id, case when length(text) <= {TEXT_LIMIT} then [text] else regexp_extract_all(text, '{split.text_pattern(TEXT_LIMIT - TEXT_OVERLAP, TEXT_OVERLAP)}') end as bodies from documents where length(text) > 0),
p as (select doc_id, unnest(bodies) as body, generate_subscripts(bodies, 1) as i from b),
s as (select *, coalesce(sum(length(body)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as before from p)
select doc_id, cast(i as int) as piece_no, cast(before - case when i > 1 then {TEXT_OVERLAP} else 0 end as int) as piece_start, cast(length(body) + case when i > 1 then {TEXT_OVERLAP} else 0 end as int) as piece_chars from s""",
}
