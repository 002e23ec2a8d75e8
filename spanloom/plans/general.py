"""Queries of the general problems (references, unreadable rows, coverage, hot keys) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.common import strip, table
from spanloom.operators import covered, orphans, parse_errors, skew


def _references(spark: SparkSession, d: str) -> DataFrame:
    exon = table(spark, d, "exon_counts").select(F.lit("exon_counts").alias("src_table"), F.col("exon_id").alias("row_id"), orphans.exon_reference(F.col("name")).alias("ref"), "loaded_at")
    region = table(spark, d, "regions").select(F.lit("regions").alias("src_table"), F.col("region_id").alias("row_id"), F.col("refseq").alias("ref"), "loaded_at")
    return exon.union(region)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(_references(spark, d), table(spark, d, "genes"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p1_found(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_errors.rejected(parse_errors.parse_lines(table(spark, d, "raw_lines")))


def p2_edits(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_errors.parse_lines(table(spark, d, "raw_lines")).where("reason is not null")
    return parsed.groupBy("record_kind", "reason").agg(F.count("*").alias("n_lines"), F.min("n_edits").cast("long").alias("least_edits"))


def p2_loaded_bed(spark: SparkSession, d: str) -> DataFrame:
    loaded = parse_errors.loaded_bed(parse_errors.parse_lines(table(spark, d, "raw_lines")))
    return loaded.selectExpr("line_id", "chrom", "start", "end", "name", "round(score, 6) as score", "strand")


def p2_loaded_counts(spark: SparkSession, d: str) -> DataFrame:
    return parse_errors.loaded_counts(parse_errors.parse_lines(table(spark, d, "raw_lines")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return covered.covered_runs(table(spark, d, "coverage_runs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    reads = table(spark, d, "mapped_reads").where("score is not null").select(strip(F.col("chrom")).alias("chrom"), "score", "read_id")
    return skew.top_per_key(reads, "chrom", [F.col("score").desc(), F.col("read_id").asc_nulls_last()], 3, F.col("read_id")).select("chrom", "read_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p2_edits, p2_loaded_bed, p2_loaded_counts, p3_found, p4_found)
}

_KEY = "trim(regexp_replace(lower(trim({})), '\\.[0-9]+$', ''))"
_ORPHANS = f"""
refs as (
  select 'exon_counts' as src_table, exon_id as row_id, case when position('_exon_' in name) > 0 then split_part(name, '_exon_', 1) end as ref, loaded_at from exon_counts
  union all select 'regions', region_id, refseq, loaded_at from regions),
r as (select src_table, row_id, {_KEY.format('ref')} as k, loaded_at as t from refs where trim(ref) <> ''),
g as (select {_KEY.format('name')} as k, loaded_at as l, coalesce(deleted_at, timestamp '9999-12-31') as u from genes where trim(name) <> ''),
j as (select src_table, row_id, t, count(g.k) as n, coalesce(bool_or(l <= t), false) as loaded, coalesce(bool_or(l <= t and u > t), false) as alive
      from r left join g on r.k = g.k group by all),
o as (select src_table, row_id, strftime(t, '%Y-%m') as period, case when n = 0 then 'missing' when loaded then 'deleted' else 'late' end as cause from j where not alive)
"""
_F = r'("(?:[^"]|"")*"|[^"\t]*)'
_VAL = "trim(case when {0} like '\"%' then replace({0}[2:-2], '\"\"', '\"') else {0} end)"


def _lines() -> str:
    parts = ", ".join(f"""regexp_extract(x, '^{_F}{(chr(92) + "t" + _F) * i}(?:\\t|$)', {i + 1}) as f{i + 1}""" for i in range(6))
    vals = ", ".join(f"{_VAL.format(f'f{i}')} as v{i}" for i in range(1, 7))
    return f"""
l as (select line_id, record_kind, regexp_replace(line, '\\r$', '') as x from raw_lines where line is not null),
k as (select * from l where regexp_matches(x, '\\S') and not (x like '#%' or x like 'track %' or x like 'browser %')),
w as (select *, regexp_full_match(x, '{_F}(?:\\t{_F})*') as sound, length(regexp_replace(regexp_replace(x, '"(?:[^"]|"")*"', 'q', 'g'), '[^\\t]', '', 'g')) + 1 as n from k),
p as (select *, {parts} from w),
v as (select *, {vals} from p),
z as (select *, case when not sound then 'quoting'
  when record_kind = 'bed' and n not between 3 and 6 or record_kind = 'exon_counts' and n <> 2 then 'column_count'
  when record_kind = 'bed' and (not regexp_full_match(v2, '[0-9]+') or try_cast(v2 as hugeint) is null or try_cast(v2 as hugeint) > 9223372036854775807
    or regexp_full_match(v3, '[0-9]+') and try_cast(v2 as hugeint) > coalesce(try_cast(v3 as hugeint), 170141183460469231731687303715884105727)) then 'start'
  when record_kind = 'bed' and n > 4 and not regexp_full_match(v5, '[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?') then 'score'
  when record_kind = 'exon_counts' and (not regexp_full_match(v2, '[0-9]+') or try_cast(v2 as hugeint) is null or try_cast(v2 as hugeint) > 2147483647) then 'count' end as reason from v)
"""


_RUNS = """
c as (select track_id, trim(chrom) as chrom, trim(strand) as strand, "start" as s, "end" as e from coverage_runs
      where chrom is not null and trim(strand) in ('+', '-') and "start" < "end"),
p as (select *, max(e) over (partition by track_id, chrom, strand order by s, e rows between unbounded preceding and 1 preceding) as pe from c),
i as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by track_id, chrom, strand order by s, e rows between unbounded preceding and current row) as isl from p),
m as (select track_id, chrom, strand, isl, min(s) as s, max(e) as e from i group by all),
g as (select *, lag(e) over (partition by track_id, chrom, strand order by s) as pe from m)
"""

SQL = {
    "p1_found": f"with {_ORPHANS} select * from o",
    "p1_report": f"with {_ORPHANS} select src_table, period, cause, count(*) as n_orphans from o group by all",
    "p2_found": f"with {_lines()} select line_id, reason from z where reason is not null",
    "p2_edits": f"""with {_lines()} select record_kind, reason, count(*) as n_lines,
        cast(min(case when reason <> 'column_count' then 1 when record_kind = 'bed' then greatest(3 - n, n - 6) else abs(n - 2) end) as bigint) as least_edits from z where reason is not null group by all""",
    "p2_loaded_bed": f"""with {_lines()} select line_id, v1 as chrom, cast(v2 as bigint) as start, try_cast(v3 as bigint) as "end", case when n > 3 then v4 end as name,
        round(case when n > 4 then cast(v5 as double) end, 6) as score, case when n > 5 then v6 end as strand from z where reason is null and record_kind = 'bed'""",
    "p2_loaded_counts": f"with {_lines()} select line_id, v1 as name, cast(v2 as int) as count from z where reason is null and record_kind = 'exon_counts'",
    "p3_found": f"""with {_RUNS} select track_id, chrom, strand, 'period' as seg_kind, s as seg_start, e as seg_end from g
        union all select track_id, chrom, strand, 'gap', pe, s from g where pe is not null""",
    "p4_found": """select chrom, read_id from (select trim(chrom) as chrom, read_id, row_number() over (partition by trim(chrom) order by score desc, read_id) as rn
        from mapped_reads where chrom is not null and score is not null) where rn <= 3""",
}
