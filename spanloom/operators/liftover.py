"""Liftover of genome intervals to a repeat's consensus by coordinates alone.

An occurrence spans [g_start, g_end) of the genome and [c_start, c_end) of a consensus of length c_len, on one strand.
Where the two spans differ in length, the difference is spread evenly: every so many bases one base is taken to be
inserted in (or deleted from) the genome. All of it is closed-form arithmetic on columns; only a stretch with deletions
is exploded, into as many pieces as it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def liftover_coordinates(df: DataFrame) -> DataFrame:
    """Rows (g_start, g_end, c_start, c_end, c_len, strand, q_start, q_end, ...) with pieces lift_start, lift_end.

    Queries that don't overlap their occurrence, and those that fall into an insertion, have no piece. Pieces of one query
    are numbered in the genome's order.
    """
    long = lambda c: F.col(c).cast("long")
    gs, ge, cs, ce, cl = map(long, ("g_start", "g_end", "c_start", "c_end", "c_len"))
    n, neg = ge - gs, F.col("strand") == "-"
    d = (ce - cs) - n
    a, b = F.greatest(long("q_start") - gs, F.lit(0)), F.greatest(long("q_end") - gs, F.lit(0))

    def whole(x, y):
        return F.floor(x / y).cast("long")

    def piece(k, x, y):
        return F.struct(k.alias("piece"), x.alias("s"), y.alias("e"))

    one = F.lit(1).cast("long")
    equal = piece(one, F.when(neg, ce - F.least(b, n)).otherwise(a + cs), F.when(neg, ce - a).otherwise(F.least(b + cs, cl)))
    # bases too many in the genome: one in ``gi`` has no counterpart
    gi = whole(n, F.greatest(-d, one))
    gi = F.greatest(gi, one)
    ins = piece(
        one,
        F.when(neg, F.greatest(ce - b + whole(b, gi), cs)).otherwise(a + cs - whole(a, gi)),
        F.when(neg, F.least(ce - a + whole(a, gi), ce)).otherwise(F.least(b + cs - whole(b, gi), cl)),
    )
    # bases missing in the genome: the k-th chunk of ``gd`` bases is shifted by k
    gd = F.greatest(F.ceil(n / F.greatest(d, one)).cast("long"), one)
    top = F.least(b, n)
    chunks = F.when(top > a, F.sequence(whole(a, gd), whole(top - 1, gd))).otherwise(F.array().cast("array<bigint>"))

    def chunk(k):
        x, y = F.greatest(a, k * gd), F.least(top, (k + 1) * gd)
        return piece(k + 1, F.when(neg, F.greatest(ce - y - k, cs)).otherwise(cs + x + k), F.when(neg, ce - x - k).otherwise(F.least(cs + y + k, ce)))

    pieces = F.when(d == 0, F.array(equal)).when(d < 0, F.array(ins)).otherwise(F.transform(chunks, chunk))
    hit = df.where((F.col("q_start") < F.col("g_end")) & (F.col("g_start") < F.col("q_end")))
    out = hit.withColumn("_p", F.explode(F.filter(pieces, lambda p: p["s"] < p["e"])))
    return out.select(*df.columns, F.col("_p.piece").alias("piece"), F.col("_p.s").alias("lift_start"), F.col("_p.e").alias("lift_end"))


def liftover_alignments(queries: DataFrame, alignments: DataFrame) -> DataFrame:
    """``queries`` (uniq_id, q_start, q_end) through the alignments of their occurrences: uniq_id, q_start, q_end, piece,
    lift_start, lift_end.

    ``alignments`` are rows as ``read_repeat_alignments`` gives them; positions outside an alignment are cut off. Each
    gap-free run of the genome side gives one piece.
    """
    from spanloom.operators.alignment import liftover

    side = lambda p, strand, name: alignments.select(F.col("uniq_id").alias("block"), F.lit(name).alias("name"), F.col(f"{p}_seq").alias("seq"), F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end"), strand.alias("strand"))
    blocks = side("q", F.lit("+"), "genome").unionByName(side("r", F.col("r_strand"), "consensus"))
    q = queries.select(F.col("uniq_id").alias("block"), F.lit("genome").alias("origin"), F.lit("consensus").alias("dest"), F.col("q_start").cast("long").alias("first"), F.col("q_end").cast("long").alias("stop"))
    out = liftover(blocks, q)
    return out.select(F.col("block").alias("uniq_id"), F.col("first").alias("q_start"), F.col("stop").alias("q_end"), "piece", F.col("dest_start").alias("lift_start"), F.col("dest_end").alias("lift_end"))


def liftover_occurrences(regions: DataFrame, occurrences: DataFrame, alignments: DataFrame | None = None) -> DataFrame:
    """Every overlap of a region (chrom, start, end) with an occurrence (chrom, start, end, strand, c_start, c_end, c_len,
    name), lifted to the occurrence's consensus.

    With ``alignments``, occurrences also have a uniq_id; those with an alignment of that id are lifted through it, the
    others by their coordinates.
    """
    from spanloom.operators.overlap import overlap_join

    pairs = overlap_join(regions.select("chrom", "start", "end"), occurrences)
    cols = [F.col("b_name").alias("name"), F.col("b_chrom").alias("chrom"), F.col("b_start").alias("g_start"), F.col("b_end").alias("g_end"), F.col("b_strand").alias("strand"), F.col("b_c_start").alias("c_start"), F.col("b_c_end").alias("c_end"), F.col("b_c_len").alias("c_len"), F.col("a_start").alias("q_start"), F.col("a_end").alias("q_end")]
    if alignments is None:
        return liftover_coordinates(pairs.select(*cols))
    named = pairs.select(*cols, F.col("b_uniq_id").alias("uniq_id"))
    have = alignments.select("uniq_id").where("uniq_id is not null").distinct().select(F.col("uniq_id").alias("_u"), F.lit(True).alias("_aligned"))
    marked = named.join(have, F.col("uniq_id") == F.col("_u"), "left").drop("_u")
    plain = liftover_coordinates(marked.where("_aligned is null").drop("_aligned"))
    aligned = marked.where("_aligned").drop("_aligned")
    lifted = liftover_alignments(aligned.select("uniq_id", "q_start", "q_end").distinct(), alignments).withColumnsRenamed({"uniq_id": "_u", "q_start": "_qs", "q_end": "_qe"})
    through = aligned.join(lifted, (F.col("uniq_id") == F.col("_u")) & (F.col("q_start") == F.col("_qs")) & (F.col("q_end") == F.col("_qe"))).drop("_u", "_qs", "_qe")
    return plain.unionByName(through.select(*plain.columns))


def repeat_name() -> Column:
    return F.concat("family", F.lit("#"), "name")
