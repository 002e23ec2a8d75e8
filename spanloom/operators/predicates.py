"""Scalar functions and predicates of intervals, as columns.

Each takes the names' prefixes of the two sides (``a_`` and ``b_`` by default), so it works on any joined row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(prefix: str, *names: str) -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def length(prefix: str = "") -> Column:
    s, e = _c(prefix, "start", "end")
    return e - s


def intersects(a: str = "a_", b: str = "b_") -> Column:
    """Overlap of two intervals of one chrom; strand is ignored. A zero-length b at p meets a if ``a.start <= p <= a.end``."""
    (ac, s1, e1), (bc, s2, e2) = _c(a, "chrom", "start", "end"), _c(b, "chrom", "start", "end")
    begins = (s2 >= s1) & (s2 < e1)
    ends = (e2 > s1) & (e2 <= e1)
    return (ac == bc) & (begins | ends | ((s2 < s1) & (e2 > e1)))


def same_region(a: str = "a_", b: str = "b_") -> Column:
    """Equal chrom, start, end, name and strand (nulls equal); the score is ignored."""
    out = F.lit(True)
    for x, y in zip(_c(a, "chrom", "start", "end", "name", "strand"), _c(b, "chrom", "start", "end", "name", "strand")):
        out &= x.eqNullSafe(y)
    return out


def equal(a: str = "a_", b: str = "b_") -> Column:
    return same_region(a, b) & _c(a, "score")[0].eqNullSafe(_c(b, "score")[0])


def before(a: str = "a_", b: str = "b_") -> Column:
    """Order of intervals: chrom, then end."""
    (ac, ae), (bc, be) = _c(a, "chrom", "end"), _c(b, "chrom", "end")
    return (ac < bc) | ((ac == bc) & (ae < be))


def distance(a: str = "a_", b: str = "b_") -> Column:
    """Bases between two intervals: 0 if they overlap or touch. Different chroms fail."""
    (ac, s1, e1), (bc, s2, e2) = _c(a, "chrom", "start", "end"), _c(b, "chrom", "start", "end")
    gap = F.greatest(F.lit(0).cast("long"), F.greatest(s1, s2) - F.least(e1, e2))
    return F.when(ac == bc, gap).when(ac != bc, F.raise_error(F.lit("distance between different chromosomes")).cast("long"))


def signed_distance(a: str = "a_", b: str = "b_") -> Column:
    """``distance``, negative where b comes first (by its end)."""
    d = distance(a, b)
    return F.when(_c(b, "end")[0] < _c(a, "end")[0], -d).otherwise(d)


def overlap_size(a: str = "a_", b: str = "b_") -> Column:
    (ac, s1, e1), (bc, s2, e2) = _c(a, "chrom", "start", "end"), _c(b, "chrom", "start", "end")
    return F.when(ac == bc, F.greatest(F.lit(0).cast("long"), F.least(e1, e2) - F.greatest(s1, s2))).otherwise(F.lit(0).cast("long"))


def is_positive(strand: Column) -> Column:
    """A strand that is not given counts as positive."""
    return F.coalesce(strand, F.lit("+")) == "+"


def transform_center(size: int, start: Column | None = None, end: Column | None = None, strand: Column | None = None) -> tuple[Column, Column]:
    """(start, end) grown or shrunk to ``size`` about the centre; an odd base goes to the 3' side, so the strand matters."""
    if size < 1:
        raise ValueError("size must be positive")
    start, end = F.col("start") if start is None else start, F.col("end") if end is None else end
    strand = F.col("strand") if strand is None else strand
    diff = F.lit(size).cast("long") - (end - start)
    extra = F.abs(diff)
    small, large = F.floor(extra / 2).cast("long"), F.floor((extra + 1) / 2).cast("long")
    grown = F.when(is_positive(strand), start - small).otherwise(start - large)
    shrunk = F.when(is_positive(strand), start + small).otherwise(start + large)
    new = F.when(diff == 0, start).when(diff > 0, grown).otherwise(shrunk)
    return new, new + size


def anchor_window(anchor: str, width: int, start: Column | None = None, end: Column | None = None) -> tuple[Column, Column]:
    """(start, end) of a window of ``width`` about a region's ``start``, ``end`` or ``middle``, whatever its strand.

    Halves are rounded down: an odd window has its longer half before a start and after an end or a middle.
    """
    start, end = F.col("start") if start is None else start, F.col("end") if end is None else end
    half = width // 2
    if anchor == "start":
        return start + half - width, start + half
    if anchor == "end":
        return end - half, end - half + width
    if anchor == "middle":
        mid = start + F.floor((end - start) / 2).cast("long")
        return mid - half, mid - half + width
    raise ValueError(f"unknown anchor {anchor}")


def relative_position(pos: Column, anchor: str, start: Column, end: Column, strand: Column) -> Column:
    """Place of ``pos`` in its region: from the start, or from the 5' end (a strand not given counts as negative here)."""
    if anchor == "START":
        return pos - start
    if anchor == "5PRIME":
        return F.when(F.coalesce(strand, F.lit("-")) == "+", pos - start).otherwise(end - pos - 1)
    raise ValueError(f"unknown anchor {anchor}")
