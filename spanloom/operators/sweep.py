"""One sweep over the ends of intervals, without pairs: how many cover each place, where that changes, how many a region meets.

Each interval becomes two events; events of a place are summed before the shuffle, so repeated intervals cost nothing. An
axis is cut into slices of ``width`` bases. Events are ordered within (key, slice) only; what a slice must know of those
before it comes from one row per slice, whose number is bounded by the axis' length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.common import cut, floor_div

WIDTH = 1 << 20


def events(df: DataFrame, keys: list[str], side: int, sides: int) -> DataFrame:
    """``keys``, pos, d0, d1, ...: +1 at each start and -1 at each end, in the column of ``side``; empty and null ones give none."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    steps = F.array(F.struct(F.col("start").cast("long").alias("pos"), one.alias("d")), F.struct(F.col("end").cast("long").alias("pos"), (-one).alias("d")))
    rows = df.where(F.col("start") < F.col("end")).select(*keys, F.explode(steps).alias("e"))
    return rows.select(*keys, F.col("e.pos").alias("pos"), *[(F.col("e.d") if i == side else zero).alias(f"d{i}") for i in range(sides)])


def same(a: DataFrame, b: DataFrame, at: list[str]) -> Column:
    """Equality of ``at`` with the columns ``_k0``, ``_k1``, ... of ``b``; nulls are equal."""
    out = F.lit(True)
    for i, c in enumerate(at):
        out &= a[c].eqNullSafe(b[f"_k{i}"])
    return out


def _keyed(df: DataFrame, at: list[str], *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(at)], *more)


def depths(evs: DataFrame, keys: list[str], sides: int, width: int = WIDTH) -> DataFrame:
    """``keys``, pos, until, depth0, depth1, ...: how many intervals of each side cover [pos, until).

    One row per place where something begins or ends; ``until`` is null after a key's last event.
    """
    ds = [f"d{i}" for i in range(sides)]
    at = [*keys, "_slice"]
    e = evs.groupBy(*keys, "pos").agg(*[F.sum(x).alias(x) for x in ds])
    e = e.where(" or ".join(f"{x} <> 0" for x in ds)).withColumn("_slice", floor_div(F.col("pos"), width))
    by_key = Window.partitionBy(*keys).orderBy("_slice")
    sl = e.groupBy(*at).agg(*[F.sum(x).alias(x) for x in ds], F.min("pos").alias("_first"))
    sl = sl.select(*at, *[F.coalesce(F.sum(x).over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b{i}") for i, x in enumerate(ds)], F.lead("_first").over(by_key).alias("_after"))
    sl = _keyed(sl, at, *[f"_b{i}" for i in range(sides)], "_after")
    rows = e.join(sl, same(e, sl, at)).drop(*[f"_k{i}" for i in range(len(at))])
    run = Window.partitionBy(*at).orderBy("pos")
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*at, "pos", F.coalesce(F.lead("pos").over(run), F.col("_after")).alias("until"), *[(F.col(f"_b{i}") + F.sum(x).over(upto)).alias(f"depth{i}") for i, x in enumerate(ds)], *[(F.col(f"_b{i}") + F.sum(x).over(upto) - F.col(x)).alias(f"_was{i}") for i, x in enumerate(ds)])


def runs(evs: DataFrame, keys: list[str], sides: int, inside: Column, was: Column, width: int = WIDTH) -> DataFrame:
    """Maximal stretches: ``keys``, start, end, prev_end. ``inside`` says by the depths whether [pos, until) belongs to one,
    ``was`` by the depths before (``_was0``, ...) whether what stands before pos does."""
    at = [*keys, "_slice"]
    # where a stretch begins or ends: as many rows as the result has ends; read twice, so written once
    edges = depths(evs, keys, sides, width).withColumns({"_in": inside, "_out": was}).where("_in <> _out").select(*at, "pos", "_in")
    edges = cut(edges)
    by_key, run = Window.partitionBy(*keys).orderBy("_slice"), Window.partitionBy(*at).orderBy("pos")
    sl = edges.groupBy(*at).agg(F.min("pos").alias("_f"), F.max("pos").alias("_l"))
    sl = sl.select(*at, F.lead("_f").over(by_key).alias("_next"), F.lag("_l").over(by_key).alias("_prev"))
    sl = _keyed(sl, at, "_next", "_prev")
    rows = edges.withColumns({"_n": F.lead("pos").over(run), "_p": F.lag("pos").over(run)}).where("_in")
    rows = rows.join(sl, same(rows, sl, at))
    return rows.select(*keys, F.col("pos").alias("start"), F.coalesce("_n", "_next").alias("end"), F.coalesce("_p", "_prev").alias("prev_end"))


def counts(regions: DataFrame, reads: DataFrame, into: str = "n_overlaps", width: int = WIDTH) -> DataFrame:
    """``regions`` with how many reads overlap each, by two running counts: starts before its end less ends up to its start.

    Both sides need start < end for regions and start <= end for reads; others are left out of the count. Null chroms meet
    nothing. No pair is formed, so a region that meets a million reads costs as much as one that meets none.
    """
    cols = regions.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    long = lambda c: F.col(c).cast("long")
    marks = F.array(F.struct(F.lit(0).alias("side"), long("start").alias("pos")), F.struct(F.lit(1).alias("side"), long("end").alias("pos")))
    values = reads.where("chrom is not null and start <= end").select("chrom", F.explode(marks).alias("m")).groupBy("chrom", "m.side", "m.pos").agg(F.count("*").alias("w"))
    # at one place a start comes after the question for starts before it, an end before the question for ends up to it
    asks = F.array(F.struct(F.lit(0).alias("side"), long("end").alias("pos")), F.struct(F.lit(1).alias("side"), long("start").alias("pos")))
    asked = regions.select(F.col("chrom"), F.explode(asks).alias("m"), row.alias("row")).select("chrom", "m.side", "m.pos", "row", F.lit(None).cast("long").alias("w"))
    line = values.select("chrom", "side", "pos", F.lit(None).cast(asked.schema["row"].dataType).alias("row"), "w").unionByName(asked).withColumn("_slice", floor_div(F.col("pos"), width))
    at = ["chrom", "side", "_slice"]
    upto = Window.partitionBy(*at).orderBy("pos", F.when(F.col("side") == 0, F.col("w").isNotNull()).otherwise(F.col("w").isNull())).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = line.groupBy(*at).agg(F.sum("w").alias("_t"))
    sums = sums.select(*at, F.coalesce(F.sum("_t").over(Window.partitionBy("chrom", "side").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    sums = _keyed(sums, at, "_b")
    got = line.withColumn("_s", F.coalesce(F.sum("w").over(upto), F.lit(0))).where("row is not null")
    got = got.join(sums, same(got, sums, at)).select("row", F.when(F.col("side") == 0, F.col("_s") + F.col("_b")).otherwise(-F.col("_s") - F.col("_b")).alias("n"))
    out = got.groupBy("row").agg(F.sum("n").alias("n"), (F.count("*") / 2).cast("int").alias("copies"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("row.*", (F.col("n") / F.col("copies")).cast("long").alias(into))
