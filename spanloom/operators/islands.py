"""Gaps and islands over half-open intervals without a window over a whole key.

A key (a chromosome, a track) may hold any share of the rows, so its axis is cut into slices of ``width`` by start. Rows
are ordered only within (key, slice); what a slice must know of those before it (the furthest end so far) and after it
(where the next island begins) comes from one row per slice. The slice rows of a key are bounded by the axis' length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.common import floor_div

WIDTH = 1 << 20


def sliced(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return df.where(F.col(start) < F.col(end)).withColumn("_slice", floor_div(F.col(start), width))


def _heads(rows: DataFrame, keys: list[str], start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_prev``, the furthest end of all that starts earlier; slice rows with ``_reach`` and ``_before``)."""
    at = [*keys, "_slice"]
    by_key = Window.partitionBy(*keys).orderBy("_slice")
    reach = rows.groupBy(*at).agg(F.max(end).alias("_reach"))
    reach = reach.withColumn("_before", F.max("_reach").over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
    slices = reach.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(at)], "_before")
    same = F.lit(True)
    for i, c in enumerate(at):
        same &= rows[c].eqNullSafe(slices[f"_k{i}"])
    run = Window.partitionBy(*at).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(slices, same).drop(*[f"_k{i}" for i in range(len(at))])
    return joined.withColumn("_prev", F.greatest(F.max(end).over(run), F.col("_before"))), reach


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """One row per maximal stretch without a break: ``keys``, start, end, and ``prev_end``, the end of the one before.

    Touching intervals are one stretch. Null, empty and reversed intervals take no part; null keys are a key. One sweep
    over the ends (``sweep.runs``).
    """
    from spanloom.operators.sweep import events, runs

    rows = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end"))
    return runs(events(rows, keys, 0, 1), keys, 1, F.col("depth0") > 0, F.col("_was0") > 0, width)


def members(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """The rows that take part, with ``island``: the start of the stretch they belong to."""
    rows = sliced(df, start, end, width)
    at = [*keys, "_slice"]
    seen, _ = _heads(rows, keys, start, end)
    head = F.when(F.col("_prev").isNull() | (F.col(start) > F.col("_prev")), F.col(start))
    marked = seen.withColumn("_head", head)
    by_key = Window.partitionBy(*keys).orderBy("_slice")
    last = marked.groupBy(*at).agg(F.max("_head").alias("_last"))
    last = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(at)], F.max("_last").over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    same = F.lit(True)
    for i, c in enumerate(at):
        same &= marked[c].eqNullSafe(last[f"_k{i}"])
    upto = Window.partitionBy(*at).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked.join(last, same).withColumn("island", F.coalesce(F.max("_head").over(upto), F.col("_carried")))
    return out.select(*df.columns, "island")
