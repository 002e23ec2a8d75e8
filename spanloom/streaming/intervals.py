"""Streaming counterparts: interval maps in keyed state, and running counts per region bin.

The batch operators of ``operators.covered`` and ``operators.overlap`` hold for data at rest. On a stream the same
interval map lives in Spark's state store, one per entity and slice of the axis, so state per key is bounded by the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.common import floor_div
from spanloom.operators.covered import IntervalMap

OUT = "entity string, slice long, seg_kind string, seg_start long, seg_end long, n_rows long"
STATE = "starts array<long>, ends array<long>, n_rows long"


def _rows(key: tuple, m: IntervalMap, n: int) -> pd.DataFrame:
    rows = [("period", s, e) for s, e in zip(m.starts, m.ends)] + [("gap", s, e) for s, e in m.gaps()]
    out = pd.DataFrame(rows, columns=["seg_kind", "seg_start", "seg_end"])
    out.insert(0, "slice", key[1])
    out.insert(0, "entity", key[0])
    out["n_rows"] = n
    return out


def _update(idle_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, n = state.get if state.exists else ([], [], 0)
        m = IntervalMap(list(starts), list(ends))
        if state.hasTimedOut:
            state.remove()
            yield _rows(key, m, n)
            return
        last = 0
        for b in batches:
            for s, e in zip(b["s"].tolist(), b["e"].tolist()):
                m.insert(s, e)
            n += len(b)
            if idle_ms is not None and len(b):
                last = max(last, int(b["t"].max().timestamp() * 1000))
        state.update((m.starts, m.ends, n))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield _rows(key, m, n)

    return run


def stream_periods(stream: DataFrame, entity: str, start: str = "start", end: str = "end", width: int = 1 << 20, time: str | None = None, late: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """Periods and gaps of each entity and slice as they stand after each micro-batch (update mode).

    A row comes for every segment of every (entity, slice) that a batch touched; the latest rows of a slice (greatest
    n_rows) replace the ones before. Empty, reversed and null intervals take no part. Stretches that cross slices are put
    together by ``operators.islands.islands`` over the latest rows. With an event ``time``, rows later than ``late`` are left
    out, and a slice's state is dropped, after its rows came once more, when the watermark has passed its last row by
    ``idle_ms``; without it state is kept for good.
    """
    rows = stream.withWatermark(time, late) if time else stream
    cols = [F.col(entity).cast("string").alias("entity"), floor_div(F.col(start), width).alias("slice"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")]
    rows = rows.where(F.col(start) < F.col(end)).select(*cols, *([F.col(time).alias("t")] if time else []))
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return rows.groupBy("entity", "slice").applyInPandasWithState(_update(idle_ms if time else None), OUT, STATE, "update", timeout)


def stream_counts(stream: DataFrame, time: str, window: str, late: str, keys: list[str]) -> DataFrame:
    """Rows per key and time window; rows later than ``late`` are left out, and windows are final once it has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def stream_overlaps(stream: DataFrame, regions: DataFrame) -> DataFrame:
    """Each arriving interval with the regions (a table at rest) it overlaps; no state is kept."""
    from spanloom.operators.overlap import BITS, _laid, _present, prefixed

    b = prefixed(regions, "b")
    present = _present(b, "b_start", "b_end")
    a = prefixed(stream, "a")
    # the stream's levels can't be known beforehand, so the table is laid for all of them
    la = _laid(a.where("a_start < a_end"), "a_start", "a_end", present, "a")
    lb = _laid(b, "b_start", "b_end", list(BITS), "b").withColumnsRenamed({"_level": "_level_b", "_bin": "_bin_b"})
    meets = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    once = (F.col("_level") == F.greatest("_a_level", "_b_level")) & (F.col("_bin") == F.greatest("_a_first", "_b_first"))
    return la.join(lb, (F.col("_level") == F.col("_level_b")) & (F.col("_bin") == F.col("_bin_b")) & meets & once).select(*a.columns, *b.columns)
