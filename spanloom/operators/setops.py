"""Set operations on half-open intervals: union, exact collapse, intersection, Jaccard index, subtraction.

All of them run on ``sweep``, ``islands`` and ``overlap_join``, so no chromosome is ever one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.common import cut
from spanloom.operators.islands import islands, members
from spanloom.operators.overlap import overlap_join
from spanloom.operators.sweep import depths, events, runs


def collapse(df: DataFrame, stranded: bool = False, width: int = 1 << 20) -> DataFrame:
    """Union of the intervals of each chrom (and strand): chrom, start, end, name ``X``, score 0, strand.

    Touching intervals merge. Rows whose strand is not + or - take no part in either mode, and without ``stranded`` the
    result's strand is +; both are kept as the operation is defined. No input order is asked for.
    """
    rows = df.where(F.col("strand").isin("+", "-"))
    out = islands(rows, ["chrom", "strand"] if stranded else ["chrom"], width=width)
    strand = F.col("strand") if stranded else F.lit("+")
    return out.select("chrom", "start", "end", F.lit("X").alias("name"), F.lit(0).cast("long").alias("score"), strand.alias("strand"))


def collapse_names(df: DataFrame, stranded: bool = False, width: int = 1 << 20) -> DataFrame:
    """``collapse`` with the distinct names of the merged rows, sorted and joined by ``;``."""
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    rows = members(df.where(F.col("strand").isin("+", "-")).select("chrom", "start", "end", "name", "strand"), keys, width=width)
    # names are made distinct before they are gathered
    out = rows.groupBy(*keys, "island", "name").agg(F.max("end").alias("end")).groupBy(*keys, "island")
    out = out.agg(F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_list("name")), ";").alias("name"))
    strand = F.col("strand") if stranded else F.lit("+")
    return out.select("chrom", F.col("island").alias("start"), "end", "name", F.lit(0).cast("long").alias("score"), strand.alias("strand"))


def collapse_exact(df: DataFrame, order: str, stranded: bool = False, combine_names: bool = True) -> DataFrame:
    """One row per (chrom, start, end[, strand]): the first row's score and strand by ``order``, names distinct and joined."""
    keys = ["chrom", "start", "end"] + (["strand"] if stranded else [])
    first = [F.min_by(c, order).alias(c) for c in ("score", "strand") if c not in keys]
    names = F.array_join(F.array_sort(F.collect_set("name")), ";") if combine_names else F.min_by("name", order)
    return df.groupBy(*keys).agg(names.alias("name"), *first).select("chrom", "start", "end", "name", "score", "strand")


def _two_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = [x.where(F.col("strand").isin("+", "-")) for x in (a, b)]
    return events(rows[0], ["chrom"], 0, 2).unionByName(events(rows[1], ["chrom"], 1, 2))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection of the two unions; touching stretches share nothing. One sweep over the ends of both sides.

    Where one stretch of a union ends and the next begins at once, they are one stretch, as in ``collapse``.
    """
    both = lambda x: (F.col(f"{x}0") > 0) & (F.col(f"{x}1") > 0)
    out = runs(_two_sides(a, b), ["chrom"], 2, both("depth"), both("_was"))
    return out.select("chrom", "start", "end", F.lit("X").alias("name"), F.lit(0).cast("long").alias("score"), F.lit("+").alias("strand"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared bases over bases of the union, with both numbers; null if both sides are empty.

    One sweep over the ends of both sides gives the depth of either over each stretch.
    """
    d = depths(_two_sides(a, b), ["chrom"], 2).where("until is not null")
    n = F.col("until") - F.col("pos")
    out = d.agg(F.sum(F.when((F.col("depth0") > 0) & (F.col("depth1") > 0), n).otherwise(0)).alias("s"), F.sum(F.when((F.col("depth0") > 0) | (F.col("depth1") > 0), n).otherwise(0)).alias("t"))
    out = out.select(F.coalesce("s", F.lit(0)).cast("long").alias("shared"), F.coalesce("t", F.lit(0)).cast("long").alias("total"))
    return out.select("shared", "total", F.try_divide(F.col("shared"), F.col("total")).alias("jaccard"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` without the bases of ``b``: no, one or several fragments per row, with the row's other columns.

    Strand is ignored. A fragment is the overlap of a row with a gap of ``b``'s union, so rows are joined to the gaps
    between its stretches; what lies before its first and after its last stretch of a chrom comes from one row per chrom.
    Rows of ``a`` that meet nothing pass through (those of a null chrom too), repeated ones each; empty ones vanish.
    """
    # null strands count here, so the union is taken without the strand rule
    holes = cut(islands(b.where("chrom is not null"), ["chrom"]))
    rows = a.where("start < end")
    ends = holes.groupBy(F.col("chrom").alias("_c")).agg(F.min("start").alias("_first"), F.max("end").alias("_last"))
    outer = rows.join(ends, rows["chrom"] == ends["_c"], "left")
    piece = lambda s, e: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))
    rims = F.when(F.col("_c").isNull(), F.array(piece(F.col("start"), F.col("end")))).otherwise(F.array(piece(F.col("start"), F.least("end", "_first")), piece(F.greatest("start", "_last"), F.col("end"))))
    outer = outer.withColumn("_f", F.explode(F.filter(rims, lambda x: x["s"] < x["e"])))
    outer = outer.select(*[(F.col("_f.s") if c == "start" else F.col("_f.e") if c == "end" else rows[c]).alias(c) for c in a.columns])
    inner = overlap_join(rows, holes.where("prev_end is not null").select("chrom", F.col("prev_end").alias("start"), F.col("start").alias("end")))
    cuts = {"start": F.greatest("a_start", "b_start"), "end": F.least("a_end", "b_end")}
    return outer.unionByName(inner.select(*[cuts.get(c, F.col(f"a_{c}")).alias(c) for c in a.columns]))


def gaps(df: DataFrame) -> DataFrame:
    """The holes between neighbouring stretches of each chrom."""
    return islands(df, ["chrom"]).where("prev_end is not null").select("chrom", F.col("prev_end").alias("start"), F.col("start").alias("end"))
