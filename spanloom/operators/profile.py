"""Counts and positional profiles of hits over regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.common import cut
from spanloom.operators.overlap import count_overlaps, overlap_join
from spanloom.operators.predicates import relative_position


def read_counts(regions: DataFrame, reads: DataFrame) -> DataFrame:
    """``regions`` with the number of overlapping reads as their score; regions without a read stay, with 0."""
    return count_overlaps(regions.drop("score"), reads).withColumnRenamed("n_overlaps", "score")


def overlap_profile(regions: DataFrame, hits: DataFrame, anchor: str = "START", normalize: bool = False) -> DataFrame:
    """pos, value: hits whose start lies at each relative position of a region; dense from 0 to the greatest position hit.

    ``normalize`` divides by the number of regions longer than the position. The profile's length is bounded by the
    longest region; regions and hits are only joined by bins and counted.
    """
    points = hits.where("start is not null").select("chrom", "start", (F.col("start") + 1).alias("end"))
    pairs = overlap_join(points, regions.select("chrom", "start", "end", "strand"))
    rel = relative_position(F.col("a_start"), anchor, F.col("b_start"), F.col("b_end"), F.col("b_strand"))
    # one row per position hit, read twice: written once
    counts = cut(pairs.select(rel.alias("pos")).groupBy("pos").agg(F.count("*").alias("n")))
    top = counts.agg(F.max("pos")).first()[0]
    dense = regions.sparkSession.range(0 if top is None else top + 1).select(F.col("id").alias("pos"))
    out = dense.join(counts, "pos", "left").select("pos", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    if not normalize:
        return out.select("pos", F.col("n").alias("value"))
    # how many regions are longer than each position: a running count over lengths, within slices of positions
    lengths = regions.where("start < end").select((F.col("end") - F.col("start")).alias("pos")).groupBy("pos").agg(F.count("*").alias("m"))
    line = out.select("pos", "n", F.lit(0).cast("long").alias("m")).unionByName(lengths.select("pos", F.lit(None).cast("double").alias("n"), "m"))
    line = line.groupBy("pos").agg(F.max("n").alias("n"), F.sum("m").alias("m")).withColumn("_slice", F.shiftright("pos", 12))
    # one row a slice: regions over all, and those that end before it
    ends = lengths.groupBy(F.shiftright("pos", 12).alias("_s")).agg(F.sum("m").alias("m"))
    slices = line.select("_slice").distinct().join(ends, F.col("_slice") == F.col("_s"), "left")
    slices = slices.select(F.col("_slice").alias("_k"), F.coalesce(F.sum("m").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("m").over(Window.partitionBy(F.lit(1))).alias("_all"))
    upto = Window.partitionBy("_slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("_m", F.sum("m").over(upto)).where("n is not null").join(slices, F.col("_slice") == F.col("_k"))
    return line.select("pos", F.try_divide(F.col("n"), F.col("_all") - F.col("_before") - F.col("_m")).alias("value"))


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences -> (pos, nuc, n) of the batch, counted over one flat array of their symbols."""
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        if not texts:
            continue
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(t) for t in texts])
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        cell, n = np.unique(pos << 21 | flat, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cell >> 21, pa.int32()), pa.array([chr(c) for c in (cell & 0x1FFFFF).tolist()], pa.string()), pa.array(n, pa.int64())], ["pos", "nuc", "n"])


def nucleotide_distribution(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """pos (from 0), nuc, n: how often each symbol stands at each position of the reads, by case."""
    cells = reads.where(F.length(seq) > 0).select(seq).mapInArrow(_symbols, "pos int, nuc string, n long")
    return cells.groupBy("pos", "nuc").agg(F.sum("n").alias("n"))


def consensus_coverage(occurrences: DataFrame) -> DataFrame:
    """name, pos, depth: how many occurrences cover each position of a repeat's consensus [start, end)."""
    # a difference array: +1 where one begins, -1 where it ends; only places where the depth changes are shuffled
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))
    steps = occurrences.where("start < end").select("name", F.explode(ends).alias("x")).groupBy("name", F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d"))
    by = Window.partitionBy("name").orderBy("pos")
    runs = steps.select("name", "pos", F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("depth"), F.lead("pos").over(by).alias("stop"))
    return runs.where("depth > 0").select("name", F.explode(F.sequence("pos", F.col("stop") - 1)).alias("pos"), "depth")
