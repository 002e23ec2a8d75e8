"""Streaming operators over the driver's tables read as streams; each query gives what stands once all rows have come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.common import fresh
from spanloom.plans import views as v
from spanloom.plans.views import with_
from spanloom.streaming import intervals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    at = f"{d}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = spark.readStream.schema(spark.read.parquet(at).schema)
    return source.option("pathGlobFilter", "*.parquet").parquet(at) if folder else source.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _run(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """What the stream has written by its end; in complete and update mode the last rows replace those before."""
    at = fresh(spark, "stream")

    def store(batch: DataFrame, i: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(at)

    df.writeStream.outputMode(mode).option("checkpointLocation", fresh(spark, "progress")).trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(at)


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n from events group by all")
def st1_windowed_counts(spark, d):
    e = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = _run(spark, intervals.stream_counts(e, "ts", "1 hour", "10 minutes", ["event_type"]), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""with c as (select track_id, floor("start" / 1048576.0)::bigint as slice, "start" as s, "end" as e from coverage_runs where "start" < "end" and track_id is not null),
p as (select *, max(e) over (partition by track_id, slice order by s, e rows between unbounded preceding and 1 preceding) as pe from c),
i as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by track_id, slice order by s, e rows between unbounded preceding and current row) as isl from p),
m as (select track_id, slice, isl, min(s) as s, max(e) as e from i group by all), g as (select *, lag(e) over (partition by track_id, slice order by s) as pe from m)
select track_id as entity, slice, 'period' as seg_kind, s as seg_start, e as seg_end from g union all select track_id, slice, 'gap', pe, s from g where pe is not null""")
def st2_interval_state(spark, d):
    runs = _stream(spark, d, "coverage_runs").where("track_id is not null").select("track_id", "start", "end")
    return _run(spark, intervals.stream_periods(runs, "track_id"), "update").drop("n_rows")


@query(f"{with_('reads', 'rois')} select b.name as region, count(*) as n from reads a join rois b on {'a.chrom = b.chrom and a.\"start\" < b.\"end\" and b.\"start\" < a.\"end\"'} group by 1")
def st3_overlaps(spark, d):
    at = "l_partkey * 50 + l_orderkey % 50"
    reads = _stream(spark, d, "lineitem").selectExpr("concat('chr', l_suppkey % 22 + 1) as chrom", f"{at} as start", f"{at} + cast(floor(l_quantity) as bigint) as end")
    pairs = _run(spark, intervals.stream_overlaps(reads, v.regions(spark, d).select("chrom", "start", "end", "name")).select("b_name"), "append")
    return pairs.groupBy(F.col("b_name").alias("region")).agg(F.count("*").alias("n"))
