"""Overlap (range) joins of half-open intervals by multi-level bins.

Spark has no interval join, and an equi-join on the sequence name alone compares all pairs of a chromosome. Here each
interval has a level by its length (bins of 2**8, 2**10, 2**12, 2**14, 2**18, ... bases) and lies in at most two bins of its own level or of a
coarser one. Two intervals meet at the coarser of their levels: the shorter one is also laid into the other side's
coarser levels that really occur there (a handful, found by one small aggregation). So long intervals never multiply into
many bins, short ones never meet intervals far away, and the join is an ordinary equi-join that shuffles on
(chrom, level, bin). A pair is kept only in the first bin both share, so none comes twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = (8, 10, 12, 14, 18, 22, 26, 30, 34, 38, 42, 46, 50, 54, 58, 62)


def _level(start: Column, end: Column) -> Column:
    size, out = F.greatest(end - start, F.lit(1)), F.lit(BITS[-1])
    for b in reversed(BITS[:-1]):
        out = F.when(size <= (1 << b), b).otherwise(out)
    return out.cast("int")


def _levels_of(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(_level(F.col(start), F.col(end)).alias("l"))


def _present(df: DataFrame, start: str, end: str) -> list[int]:
    return sorted(r.l for r in _levels_of(df, start, end).distinct().collect())


def _shift(c: Column, bits: Column) -> Column:
    return F.call_function("shiftright", c.cast("long"), bits)


def _laid(df: DataFrame, start: str, end: str, other: list[int], tag: str) -> DataFrame:
    """``df`` once per bin: own level if the other side has one as fine, and the other side's coarser levels."""
    own = f"_{tag}_level"
    levels = F.filter(F.array(*[F.lit(x) for x in other]).cast("array<int>"), lambda x: x > F.col(own))
    if other:
        levels = F.when(F.col(own) >= other[0], F.array_append(levels, F.col(own))).otherwise(levels)
    df = df.withColumn(own, _level(F.col(start), F.col(end))).withColumn("_level", F.explode(levels))
    first, last = _shift(F.col(start), F.col("_level")), _shift(F.greatest(F.col(end) - 1, F.col(start)), F.col("_level"))
    return df.withColumn(f"_{tag}_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def prefixed(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{tag}_{c}") for c in df.columns])


def levels(a: DataFrame, b: DataFrame, closed: bool = False) -> tuple[list[int], list[int]]:
    """The levels that occur on either side: one job, a scan of two columns each. Take it from the cheapest form of a side."""
    reach = 1 if closed else 0
    sides = [_levels_of(d.withColumn("_end", F.col("end") + reach), "start", "_end").select("l", F.lit(i).alias("side")) for i, d in enumerate((a, b))]
    found = sides[0].unionByName(sides[1]).distinct().collect()
    return tuple(sorted(r.l for r in found if r.side == i) for i in (0, 1))


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", closed: bool = False, strand: bool = False, known: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """All pairs of ``a`` and ``b`` (chrom, start, end, anything else) that overlap; columns come back as a_* and b_*.

    Half-open: ``a.start < b.end and b.start < a.end``; ``closed``: ``<=`` for both. ``how``: inner, left (rows of ``a``
    without a partner once, with nulls), left_semi or left_anti. ``strand`` also asks for equal strands. Rows with a null
    chrom, start or end have no partner. An empty side gives no pairs. ``known``: what ``levels`` gives, where the caller
    has it already.
    """
    in_a, in_b = known or levels(a, b, closed)
    a, b = prefixed(a, "a"), prefixed(b, "b")
    reach = 1 if closed else 0
    ea, eb = "_a_end", "_b_end"
    left, right = a.withColumn(ea, F.col("a_end") + reach), b.withColumn(eb, F.col("b_end") + reach)
    cut = left.where("a_chrom is not null and a_start is not null and a_end is not null") if how == "inner" else left
    la = _laid(cut, "a_start", ea, in_b, "a") if how == "inner" else None
    lb = _laid(right.where("b_chrom is not null and b_start is not null and b_end is not null"), "b_start", eb, in_a, "b")
    meets = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("a_start") < F.col(eb)) & (F.col("b_start") < F.col(ea))
    once = (F.col("_level") == F.greatest("_a_level", "_b_level")) & (F.col("_bin") == F.greatest("_a_first", "_b_first"))
    if strand:
        meets &= F.col("a_strand") == F.col("b_strand")
    if how == "inner":
        lb = lb.withColumnsRenamed({"_level": "_level_b", "_bin": "_bin_b"})
        return la.join(lb, (F.col("_level") == F.col("_level_b")) & (F.col("_bin") == F.col("_bin_b")) & meets & once).select(*a.columns, *b.columns)
    # rows of ``a`` are numbered by their content and copies, which survives a recomputed task
    keyed = a.groupBy(*a.columns).agg(F.count("*").alias("_copies"))
    pairs = overlap_join(_unprefixed(keyed.select(*a.columns), "a"), _unprefixed(b, "b"), closed=closed, strand=strand, known=(in_a, in_b))
    same = F.lit(True)
    renamed = pairs.select(*[F.col(c).alias(f"_p_{c}") for c in a.columns], *b.columns)
    for c in a.columns:
        same &= keyed[c].eqNullSafe(renamed[f"_p_{c}"])
    kind = {"left": "left", "left_semi": "left_semi", "left_anti": "left_anti"}[how]
    out = keyed.join(renamed, same, kind).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*a.columns, *(b.columns if how == "left" else []))


def _unprefixed(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c.removeprefix(f"{tag}_")) for c in df.columns])


def stab_join(points: DataFrame, intervals: DataFrame, pos: str = "pos", closed: bool = False, how: str = "inner") -> DataFrame:
    """Points (chrom, ``pos``) with the intervals they lie in: ``start <= pos < end``, or ``<= end`` if ``closed``."""
    at = points.withColumns({"start": F.col(pos), "end": F.col(pos) + (0 if closed else 1)})
    out = overlap_join(at, intervals, how=how, closed=closed)
    return out.drop("a_start", "a_end")


def count_overlaps(regions: DataFrame, reads: DataFrame) -> DataFrame:
    """``regions`` with ``n_overlaps``, how many reads overlap each; zero where none does. Equal regions stay apart.

    Counted by a sweep over both sides' ends, without pairs (``sweep.counts``). Only where there are empty or reversed
    regions or reversed reads (one small aggregation tells) are those joined and counted as pairs.
    """
    from spanloom.operators import sweep

    reads = reads.select("chrom", "start", "end")
    proper, upright = F.col("start") < F.col("end"), F.col("start") <= F.col("end")
    odd = regions.agg(F.count(F.when(~F.coalesce(proper, F.lit(False)), 1)).alias("n"), F.lit(0).alias("side")).unionByName(reads.agg(F.count(F.when(~upright, 1)).alias("n"), F.lit(1).alias("side")))
    odd = {r.side: r.n for r in odd.collect()}
    if not odd[0] and not odd[1]:
        return sweep.counts(regions, reads)
    out = sweep.counts(regions.where(proper), reads)
    if odd[1]:
        out = _added(out, _count_pairs(regions.where(proper), reads.where(~upright)), regions.columns)
    rest = regions.where(~F.coalesce(proper, F.lit(False)))
    return out.unionByName(_count_pairs(rest, reads)) if odd[0] else out


def _added(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Two counts of the same rows added up."""
    both = a.select(*cols, "n_overlaps", F.lit(1).alias("_one")).unionByName(b.select(*cols, "n_overlaps", F.lit(0).alias("_one")))
    out = both.groupBy(*cols).agg(F.sum("n_overlaps").alias("n"), F.sum("_one").cast("int").alias("_copies")).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return out.select(*cols, (F.col("n") / F.col("_copies")).cast("long").alias("n_overlaps"))


def _count_pairs(regions: DataFrame, reads: DataFrame) -> DataFrame:
    cols = regions.columns
    keyed = regions.groupBy(*cols).agg(F.count("*").alias("_copies"))
    hits = overlap_join(keyed.select(*cols), reads, known=levels(regions, reads))
    counts = hits.groupBy(*[f"a_{c}" for c in cols]).agg(F.count("*").alias("n_overlaps"))
    same = F.lit(True)
    for c in cols:
        same &= keyed[c].eqNullSafe(counts[f"a_{c}"])
    out = keyed.join(counts, same, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*cols, F.coalesce("n_overlaps", F.lit(0)).cast("long").alias("n_overlaps"))


def bucket_join(buckets: DataFrame, elements: DataFrame, value: str = "name") -> DataFrame:
    """Every bucket, also empty ones, with the overlapping elements' ``value`` as an array ordered by start.

    The array grows with what overlaps one bucket; use ``count_overlaps`` where only the number matters.
    """
    out = overlap_join(buckets, elements, how="left")
    item = F.when(F.col("b_start").isNotNull(), F.struct("b_start", "b_end", f"b_{value}"))
    cols = [f"a_{c}" for c in buckets.columns]
    got = out.groupBy(*cols).agg(F.array_sort(F.collect_list(item)).alias("hits"))
    return got.select(*[F.col(f"a_{c}").alias(c) for c in buckets.columns], F.transform("hits", lambda x: x[f"b_{value}"]).alias("hits"))


def lookup(points: DataFrame, wig: DataFrame, strict: bool = False) -> DataFrame:
    """Point lookups in scored intervals: each point (chrom, pos) with ``covered`` and ``score``.

    A point in no interval is not covered and has a null score, or fails with ``strict``; one in several intervals fails.
    """
    hits = stab_join(points, wig, how="left").groupBy("a_chrom", "a_pos").agg(F.count("b_start").alias("n"), F.max("b_score").alias("score"))
    bad = (F.col("n") > 1) | (F.lit(strict) & (F.col("n") == 0))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("point in "), F.col("n").cast("string"), F.lit(" elements: "), F.col("a_chrom"), F.lit(":"), F.col("a_pos").cast("string")))).otherwise(F.col("score"))
    return hits.select(F.col("a_chrom").alias("chrom"), F.col("a_pos").alias("pos"), (F.col("n") > 0).alias("covered"), checked.alias("score"))


def assert_sorted(df: DataFrame, order: str, by: Callable[[], Column]) -> DataFrame:
    """``df``, failing at run time where ``order`` decreases in the sequence given by ``by`` within a chromosome."""
    from pyspark.sql import Window

    before = F.lag(order).over(Window.partitionBy("chrom").orderBy(by()))
    return df.withColumn("_b", before).withColumn("_ok", F.when(F.col(order) < F.col("_b"), F.raise_error(F.lit(f"not sorted by {order}"))).otherwise(F.lit(1))).where("_ok = 1").drop("_b", "_ok")
