"""The driver's tables seen as intervals, reads, sequences and alignments: each as a DataFrame and as SQL.

The SQL is a common table expression of the same name and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.common import table


def reads(spark: SparkSession, d: str) -> DataFrame:
    at = "l_partkey * 50 + l_orderkey % 50"
    return table(spark, d, "lineitem").selectExpr(
        "concat('chr', l_suppkey % 22 + 1) as chrom", f"{at} as start", f"{at} + cast(floor(l_quantity) as bigint) as end",
        "concat(l_orderkey, '_', l_linenumber) as name", "cast(l_linenumber as bigint) as score", "if(l_linestatus = 'F', '+', '-') as strand",
    )


def regions(spark: SparkSession, d: str) -> DataFrame:
    at = "(o_orderkey % 2000) * 50"
    return table(spark, d, "orders").selectExpr(
        "concat('chr', o_custkey % 22 + 1) as chrom", f"{at} as start", f"{at} + 50 + o_custkey % 400 as end",
        "concat('r', o_orderkey) as name", "cast(0 as bigint) as score", "if(o_orderkey % 2 = 0, '+', '-') as strand",
    )


def visits(spark: SparkSession, d: str) -> DataFrame:
    at = "cast(floor(unix_timestamp(cast(ts as timestamp)) - 1704067200) as bigint)"
    return table(spark, d, "events").selectExpr(
        "event_type as chrom", f"{at} as start", f"{at} + 1 + cast(floor(value) as bigint) as end", "cast(user_id as string) as name",
        "cast(user_id as bigint) as score", "if(user_id % 5 = 0, null, if(user_id % 2 = 0, '+', '-')) as strand", "event_id",
    )


def wig(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_brand as chrom", "p_partkey * 10 as start", "p_partkey * 10 + 10 as end", "p_retailprice as score")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Places of parts, half of them on another brand's axis, so about half are covered by the wig."""
    return table(spark, d, "lineitem").selectExpr("concat('Brand#', l_suppkey % 25 + 1) as chrom", "l_partkey * 10 + l_orderkey % 10 as pos").distinct()


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").selectExpr("doc_id", "cast(doc_id as string) as name", "upper(regexp_replace(text, '[^ACGTNacgtn]', '')) as seq").where("seq <> ''")


def fastq(spark: SparkSession, d: str) -> DataFrame:
    return seqs(spark, d).selectExpr("doc_id", "name", "seq", "translate(seq, 'ACGTN', 'IHGF#') as qual")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Two documents' sequences a block, N as gap, padded to one length; the second is on the negative strand in every other block."""
    s = seqs(spark, d).selectExpr("doc_id div 2 as block", "doc_id % 2 as i", "replace(seq, 'N', '-') as raw")
    both = s.groupBy("block").agg(F.count("*").alias("n"), F.max(F.length("raw")).alias("w")).where("n = 2")
    rows = s.join(both, "block").selectExpr("block", "i", "rpad(raw, w, '-') as seq")
    return rows.selectExpr("block", "if(i = 0, 'A.chr1', 'B.chr1') as name", "seq", "block * 200000 as start", "block * 200000 + length(replace(seq, '-', '')) as end", "if(i = 1 and block % 2 = 0, '-', '+') as strand")


def pvals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", "((o_orderkey * 7919) % 100003 + 1) / 100004.0D as p")


def junctions(spark: SparkSession, d: str) -> DataFrame:
    s1 = "l_partkey * 100"
    e1 = f"({s1} + 20 + l_suppkey % 30)"
    s2 = f"({e1} + 500 + l_orderkey % 50)"
    return table(spark, d, "lineitem").selectExpr(
        f"concat('chr_', l_suppkey % 22 + 1, '_', {s1}, '_', {e1}, '_', {s2}, '_', {s2} + 40) as chrom", "l_orderkey % 10 + 1 as start", "l_orderkey % 10 + 41 + l_linenumber as end",
        "concat(l_orderkey, '_', l_linenumber) as name", "cast(l_linenumber as bigint) as score", "if(l_linestatus = 'F', '+', '-') as strand",
    )


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Orders as repeats' occurrences whose consensus span is shorter, equal or longer."""
    return regions(spark, d).selectExpr("chrom", "start", "end", "strand", "name", "end - start as n", "cast(substring(name, 2) as bigint) as k").selectExpr(
        "chrom", "start", "end", "strand", "concat('L', k % 17) as name", "10 + k % 7 as c_start", "10 + k % 7 + n + (k % 13 - 6) * 3 as c_end", "10 + k % 7 + n + (k % 13 - 6) * 3 + k % 5 as c_len")


CTE = {
    "reads": """reads as (select 'chr' || (l_suppkey % 22 + 1) as chrom, l_partkey * 50 + l_orderkey % 50 as "start", l_partkey * 50 + l_orderkey % 50 + cast(floor(l_quantity) as bigint) as "end",
        l_orderkey || '_' || l_linenumber as name, cast(l_linenumber as bigint) as score, case when l_linestatus = 'F' then '+' else '-' end as strand from lineitem)""",
    "rois": """rois as (select 'chr' || (o_custkey % 22 + 1) as chrom, (o_orderkey % 2000) * 50 as "start", (o_orderkey % 2000) * 50 + 50 + o_custkey % 400 as "end",
        'r' || o_orderkey as name, cast(0 as bigint) as score, case when o_orderkey % 2 = 0 then '+' else '-' end as strand, o_orderkey as k from orders)""",
    "visits": """visits as (select event_type as chrom, cast(floor(epoch(ts)) as bigint) - 1704067200 as "start", cast(floor(epoch(ts)) as bigint) - 1704067200 + 1 + cast(floor(value) as bigint) as "end",
        cast(user_id as varchar) as name, user_id as score, case when user_id % 5 = 0 then null when user_id % 2 = 0 then '+' else '-' end as strand, event_id from events)""",
    "wig": """wig as (select p_brand as chrom, p_partkey * 10 as "start", p_partkey * 10 + 10 as "end", p_retailprice as score from part)""",
    "points": """points as (select distinct 'Brand#' || (l_suppkey % 25 + 1) as chrom, l_partkey * 10 + l_orderkey % 10 as pos from lineitem)""",
    "seqs": """seqs as (select * from (select doc_id, cast(doc_id as varchar) as name, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) as seq from documents where text is not null) where seq <> '')""",
    "blocks": """blocks as (with s as (select doc_id // 2 as block, doc_id % 2 as i, replace(seq, 'N', '-') as raw from seqs), w as (select block, max(length(raw)) as w from s group by 1 having count(*) = 2)
        select block, case when i = 0 then 'A.chr1' else 'B.chr1' end as name, rpad(raw, cast(w as int), '-') as seq, block * 200000 as "start", block * 200000 + length(replace(raw, '-', '')) as "end",
        case when i = 1 and block % 2 = 0 then '-' else '+' end as strand from s join w using (block))""",
    "cells": """cells as (with c as (select block, name, "start", "end", strand, unnest(generate_series(1, length(seq))) as col, seq from blocks),
        n as (select *, substr(seq, cast(col as int), 1) as nuc from c),
        r as (select *, sum(case when nuc <> '-' then 1 else 0 end) over (partition by block, name order by col rows unbounded preceding) as rk from n)
        select block, name, col, nuc, case when nuc <> '-' then cast(case when strand = '-' then "end" - rk else "start" + rk - 1 end as bigint) end as pos from r)""",
    "occ": """occ as (with z as (select *, "end" - "start" as n from rois)
        select chrom, "start", "end", strand, 'L' || (k % 17) as name, 10 + k % 7 as c_start, 10 + k % 7 + n + (k % 13 - 6) * 3 as c_end, 10 + k % 7 + n + (k % 13 - 6) * 3 + k % 5 as c_len from z)""",
}


def with_(*names: str) -> str:
    """``with`` clause of the named views."""
    return "with " + ",\n".join(CTE[n] for n in names)
