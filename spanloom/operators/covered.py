"""Overlapping and gapped intervals: continuous periods and the gaps between them, per entity.

Each entity keeps an ordered map of disjoint intervals; an insertion finds what it overlaps or touches by binary search
and merges it, which also closes gaps. The map works in three places:

1. Before the shuffle each task folds its rows into a map per entity, so what is shuffled is disjoint per task, however
   often an entity repeats.
2. After it, a map per entity and *slice* of the axis merges what the tasks found. Intervals are cut at the slices' rims,
   so no entity, however large, is one task's work, and a slice knows its own periods and gaps.
3. Only a slice's first and last period may go on in a neighbour slice. These edges, two rows a slice at most, are put
   together per entity; their number is bounded by the axis' length (``MOST_SLICES``), not by the number of rows.

On a stream the same map lives in Spark's state store (``streaming.intervals``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.common import cut, strip

WIDTH = 1 << 20
#: Most slices of an axis; on a longer axis the slices are wider.
MOST_SLICES = 1 << 16
#: Intervals held by a task's maps before it hands them on.
HELD = 500_000


class IntervalMap:
    """Disjoint, non-touching half-open intervals in order: parallel lists of starts and ends."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = starts or [], ends or []

    def insert(self, s: int, e: int) -> None:
        """Adds [s, e), merged with all that it overlaps or touches; empty and reversed ones are ignored."""
        if s >= e:
            return
        i, j = bisect_left(self.ends, s), bisect_right(self.starts, e)
        if i < j:
            s, e = min(s, self.starts[i]), max(e, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [s], [e]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))


def _batch(kind: pa.Schema, keys: list[tuple], sizes: list[int], columns: list) -> pa.RecordBatch:
    """A batch of the entities' columns, each repeated by its size, and further columns."""
    at = np.repeat(np.arange(len(keys)), sizes)
    n = len(kind) - len(columns)
    arrays = [pa.array([k[i] for k in keys], kind.field(i).type).take(pa.array(at)) for i in range(n)]
    return pa.RecordBatch.from_arrays([*arrays, *[pa.array(c, kind.field(n + i).type) for i, c in enumerate(columns)]], schema=kind)


def _combine(width: int, n: int, kind: pa.Schema):
    """Rows (entity columns, s, e) -> the task's disjoint intervals per entity, cut at the slices' rims."""

    def emit(maps: dict[tuple, IntervalMap]) -> pa.RecordBatch:
        keys = list(maps)
        sizes = [len(maps[k].starts) for k in keys]
        s = np.array([x for k in keys for x in maps[k].starts], np.int64)
        e = np.array([x for k in keys for x in maps[k].ends], np.int64)
        first, last = s // width, (e - 1) // width
        pieces = last - first + 1
        at = np.repeat(np.arange(len(s)), pieces)
        sl = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        # rims beyond 64 bits are never used: an interval's own start and end bind there
        lo = np.where(sl == first[at], s[at], sl * width)
        hi = np.where(sl == last[at], e[at], (sl + 1) * width)
        owner = np.repeat(np.arange(len(keys)), sizes)
        return _batch(kind, keys, np.bincount(owner[at], minlength=len(keys)).tolist(), [sl, lo, hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple, IntervalMap] = {}
        rows = 0
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(n + 2)]
            for key, s, e in zip(zip(*columns[:n]), columns[n], columns[n + 1]):
                m = maps.get(key)
                if m is None:
                    m = maps[key] = IntervalMap()
                m.insert(s, e)
            rows += b.num_rows
            if rows > HELD:
                rows = sum(len(m.starts) for m in maps.values())
                if rows > HELD // 2:
                    yield emit(maps)
                    maps, rows = {}, 0
        if maps:
            yield emit(maps)

    return run


def _fold(n: int, kind: pa.Schema):
    """Rows (entity columns, slice, s, e) sorted by entity and slice -> the slice's periods, gaps and edges.

    ``edge``: the first and the last period, which may go on in another slice; ``linked`` says that the next edge is of
    the same slice. One map is alive at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, IntervalMap()
        keys, sizes, out = [], [], ([], [], [], [])

        def close() -> None:
            if key is None:
                return
            m, gaps = state, state.gaps()
            k = len(m.starts)
            keys.append(key[:n]), sizes.append(k + len(gaps))
            out[0].extend(["edge", *["period"] * (k - 2), *["edge"] * (k > 1), *["gap"] * len(gaps)])
            out[1].extend(m.starts), out[1].extend(a for a, _ in gaps)
            out[2].extend(m.ends), out[2].extend(b for _, b in gaps)
            out[3].extend([k > 1, *[False] * (k - 1 + len(gaps))])

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(n + 3)]
            for k, s, e in zip(zip(*columns[: n + 1]), columns[n + 1], columns[n + 2]):
                if k != key:
                    close()
                    key, state = k, IntervalMap()
                state.insert(s, e)
            if len(out[0]) > 50_000:
                yield _batch(kind, keys, sizes, list(out))
                keys, sizes, out = [], [], ([], [], [], [])
        close()
        if out[0]:
            yield _batch(kind, keys, sizes, list(out))

    return run


def periods_and_gaps(df: DataFrame, entity: list[str], start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """``entity`` columns, seg_kind (``period`` or ``gap``), seg_start, seg_end.

    A period is a maximal stretch covered without a break (touching stretches are one), a gap the hole between two
    neighbouring periods. Rows with a null start or end, and empty or reversed ones, take no part; nulls in ``entity``
    are a value like any other. Repeated rows change nothing. An empty table gives an empty result. ``width`` of a slice
    is doubled until the axis has at most ``MOST_SLICES`` of them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n, keys = len(entity), [f"_k{i}" for i in range(len(entity))]
    rows = df.where(F.col(start) < F.col(end)).select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    span = rows.agg(F.min("s").alias("s"), F.max("e").alias("e")).first()
    while span.s is not None and (span.e - span.s) // width >= MOST_SLICES:
        width *= 2
    base = StructType(rows.schema.fields[:n])
    cut_kind = StructType([*base.fields]).add("slice", "long").add("s", "long").add("e", "long")
    seg_kind = StructType([*base.fields]).add("kind", "string").add("s", "long").add("e", "long").add("linked", "boolean")
    pieces = rows.mapInArrow(_combine(width, n, to_arrow_schema(cut_kind)), cut_kind)
    pieces = pieces.repartition(*keys, "slice").sortWithinPartitions(*keys, "slice")
    # read twice below, so it is written once to the shared folder
    found = cut(pieces.mapInArrow(_fold(n, to_arrow_schema(seg_kind)), seg_kind))
    by = Window.partitionBy(*keys).orderBy("s")
    edges = found.where("kind = 'edge'").select(*keys, "s", "e", F.lag("e").over(by).alias("before"), F.coalesce(F.lag("linked").over(by), F.lit(False)).alias("linked"))
    edges = edges.withColumn("head", F.when(F.col("before").isNull() | (F.col("s") > F.col("before")), F.col("s")))
    edges = edges.withColumn("head", F.max("head").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = edges.groupBy(*keys, "head").agg(F.max("e").alias("e"), F.max(F.when((F.col("s") == F.col("head")) & ~F.col("linked"), F.col("before"))).alias("before"))
    both = F.array(F.struct(F.lit("period").alias("kind"), F.col("head").alias("s"), F.col("e").alias("e")), F.struct(F.lit("gap").alias("kind"), F.col("before").alias("s"), F.col("head").alias("e")))
    out = whole.select(*keys, F.explode(both).alias("x")).where("x.s is not null").select(*keys, "x.kind", "x.s", "x.e")
    out = out.unionByName(found.where("kind <> 'edge'").select(*keys, "kind", "s", "e"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, entity)], F.col("kind").alias("seg_kind"), F.col("s").alias("seg_start"), F.col("e").alias("seg_end"))


def covered_runs(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """Periods and gaps per track_id, chrom and strand of stretches whose chrom is known and whose strand is + or -."""
    clean = df.select("track_id", strip(F.col("chrom")).alias("chrom"), strip(F.col("strand")).alias("strand"), "start", "end")
    return periods_and_gaps(clean.where("chrom is not null and strand in ('+', '-')"), ["track_id", "chrom", "strand"], width=width)
