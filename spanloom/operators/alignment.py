"""Gapped multiple alignments: columns, coordinates, liftover through an alignment, conservation.

An alignment block is a set of rows (block, name, seq, start, end, strand); ``seq`` is gapped text, null where only the
coordinates are known. Columns are counted from 1. Sequence positions are [start, end) on the positive strand; a sequence
on the negative strand runs through them downwards.

Coordinates are mapped by ``stretches``: one row per gap-free run of a sequence, so the cost follows the gaps, not the
bases. Conservation is computed over a block's rows side by side and stands in tiles of ``TILE`` positions. Only
``cells`` lays an alignment out as one row per block, sequence and column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.common import cut, once

SKIP, GAPS = "SKIP", "TREAT_AS_ALL_GAPS"
#: Positions of a tile of conservation values.
TILE = 1024


def check_blocks(blocks: DataFrame) -> DataFrame:
    """What is wrong with each bad block: sequences of unequal length, a name twice, ends that don't fit the bases."""
    bases = F.length(F.replace("seq", F.lit("-"), F.lit("")))
    out = blocks.groupBy("block").agg(
        F.count_distinct(F.length("seq")).alias("lengths"),
        (F.count("name") - F.count_distinct("name")).alias("repeats"),
        F.sum(F.when(F.col("seq").isNotNull() & (F.col("end") - F.col("start") != bases), 1).otherwise(0)).alias("misfits"),
    )
    why = F.when(F.col("lengths") > 1, "sequences of unequal length").when(F.col("repeats") > 0, "a name occurs twice").when(F.col("misfits") > 0, "coordinates don't fit")
    return out.select("block", why.alias("reason")).where("reason is not null")


def block_sizes(blocks: DataFrame) -> DataFrame:
    """block, size (columns), num_seqs of each block."""
    return blocks.groupBy("block").agg(F.max(F.length("seq")).cast("long").alias("size"), F.count("*").alias("num_seqs"))


def block_key(chrom: Column, start: Column, end: Column) -> Column:
    """A block's key by its place: chrom, start and end with tabs between them."""
    return F.concat_ws("\t", chrom, start.cast("string"), end.cast("string"))


def parse_block_key(key: Column) -> Column:
    """Struct (chrom, start, end) of a key; another form fails."""
    part = lambda i: F.regexp_extract(key, r"\A([^\t]*)\t(\d+)\t(\d+)\z", i)
    ok = F.when(part(2) != "", key).when(key.isNotNull(), F.raise_error(F.concat(F.lit("not a block key: "), key)).cast("string"))
    return F.struct(F.when(ok.isNotNull(), part(1)).alias("chrom"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end"))


def cells(blocks: DataFrame, missing: str = SKIP) -> DataFrame:
    """block, name, col, nuc, pos: one row per symbol; ``pos`` is null at a gap.

    ``missing``: sequences without symbols are left out, or stand as gaps throughout.
    """
    if missing not in (SKIP, GAPS):
        raise ValueError(f"unknown handling of missing sequences {missing}")
    rows = blocks
    if missing == GAPS:
        width = F.max(F.length("seq")).over(Window.partitionBy("block"))
        rows = rows.withColumn("seq", F.coalesce("seq", F.repeat(F.lit("-"), width.cast("int"))))
    rows = rows.where("seq is not null and seq <> ''")
    # a base's position is its rank among the bases of its sequence: counted up to its chunk, then within the chunk
    chunks = F.regexp_extract_all("seq", F.lit("(?s).{1,64}"), F.lit(0))
    bases = F.aggregate(F.transform(chunks, _bases), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    kept = ["block", "name", "start", "end", "strand"]
    out = rows.select(*kept, F.posexplode(F.arrays_zip(chunks.alias("text"), bases.alias("base"))).alias("j", "c")).where("c.text is not null")
    out = out.select(*kept, "j", "c", F.posexplode(F.split("c.text", "")).alias("i", "nuc"))
    rank = F.col("c.base") + _bases(F.substring("c.text", F.lit(1), F.col("i") + 1))
    up, down = F.col("start") + rank - 1, F.col("end") - rank
    pos = F.when(F.col("nuc") != "-", F.when(F.coalesce("strand", F.lit("+")) == "-", down).otherwise(up))
    return out.select("block", "name", (F.col("j") * 64 + F.col("i") + 1).alias("col"), "nuc", pos.alias("pos"))


def _bases(c: Column) -> Column:
    return F.length(F.replace(c, F.lit("-"), F.lit("")))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def stretches(blocks: DataFrame) -> DataFrame:
    """block, name, col, col_end, pos, pos_end, neg: one row per run of columns without a gap in a sequence.

    [col, col_end) are its columns, [pos, pos_end) its bases on the positive strand; ``neg`` says that they run downwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], ([], [], [], [], [])
            for r, (seq, start, end, strand) in enumerate(zip(*(b.column(i).to_pylist() for i in range(2, 6)))):
                base = np.r_[0, (_codes(seq) != ord("-")).view(np.int8), 0]
                edge = np.flatnonzero(np.diff(base))
                first, stop = edge[::2], edge[1::2]
                done = np.cumsum(stop - first)
                before, neg = done - (stop - first), strand == "-"
                row.append(np.full(len(first), r))
                places = (first + 1, stop + 1, *((end - done, end - before) if neg else (start + before, start + done)), np.full(len(first), neg))
                for column, x in zip(out, places):
                    column.append(x)
            at = pa.array(np.concatenate(row or [np.zeros(0)]).astype(np.int64))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array(np.concatenate(x or [np.zeros(0)]).astype(k.to_pandas_dtype()), k) for x, k in zip(out, kinds)]], ["block", "name", "col", "col_end", "pos", "pos_end", "neg"])

    rows = blocks.where("seq is not null and seq <> ''").select("block", "name", "seq", F.col("start").cast("long"), F.col("end").cast("long"), F.coalesce("strand", F.lit("+")).alias("strand"))
    return rows.mapInArrow(run, f"block {blocks.schema['block'].dataType.simpleString()}, name string, col long, col_end long, pos long, pos_end long, neg boolean")


def columns_at(blocks: DataFrame, wanted: DataFrame, missing: str = SKIP) -> DataFrame:
    """Symbols (name, nuc) in the wanted (block, col); only those places are read."""
    if missing not in (SKIP, GAPS):
        raise ValueError(f"unknown handling of missing sequences {missing}")
    rows = blocks.select("block", "name", "seq")
    if missing == GAPS:
        width = F.max(F.length("seq")).over(Window.partitionBy("block"))
        rows = rows.withColumn("seq", F.coalesce("seq", F.repeat(F.lit("-"), width.cast("int"))))
    out = wanted.groupBy("block").agg(F.collect_set("col").alias("_cols")).join(rows.where("seq is not null"), "block")
    # the text is laid out once a row, so many wanted columns cost no more than its length
    symbols = F.transform("_cols", lambda c: F.struct(c.alias("col"), F.get("_text", c.cast("int") - 1).alias("nuc")))
    out = once(out.select("block", "name", "_cols", "seq"), _text=F.split("seq", "")).select("block", "name", F.explode(symbols).alias("x"))
    return out.where("x.nuc is not null and x.nuc <> ''").select("block", "x.col", "name", "x.nuc")


def _stretches_of(blocks: DataFrame, queries: DataFrame, name: str, tag: str) -> tuple[DataFrame, Column]:
    """The stretches with columns prefixed by ``tag``, and the condition that they are of a query's block and sequence."""
    s = stretches(blocks)
    s = s.select(*[F.col(c).alias(f"{tag}{c}") for c in s.columns])
    return s, (F.col("block") == F.col(f"{tag}block")) & (F.col(name) == F.col(f"{tag}name"))


def column_to_sequence(blocks: DataFrame, queries: DataFrame, trim: bool = False) -> DataFrame:
    """(block, name, first, stop) in columns -> seq_start, seq_end on the sequence; null where all of it is gaps.

    Columns beyond the alignment fail unless ``trim``.
    """
    width = blocks.groupBy("block").agg(F.max(F.length("seq")).alias("_w"))
    q = queries.withColumn("_q", F.struct("block", "name", "first", "stop")).distinct().join(width, "block")
    outside = (F.col("first") < 1) | (F.col("stop") > F.col("_w") + 1) | (F.col("first") >= F.col("stop"))
    if not trim:
        q = q.withColumn("first", F.when(outside, F.raise_error(F.lit("columns outside the alignment")).cast("long")).otherwise(F.col("first")))
    s, on = _stretches_of(blocks, q, "name", "_c_")
    out = q.join(s, on & (F.col("_c_col") < F.col("stop")) & (F.col("first") < F.col("_c_col_end")), "left")
    skip, more = F.greatest(F.col("first") - F.col("_c_col"), F.lit(0)), F.greatest(F.col("_c_col_end") - F.col("stop"), F.lit(0))
    lo = F.col("_c_pos") + F.when(F.col("_c_neg"), more).otherwise(skip)
    hi = F.col("_c_pos_end") - F.when(F.col("_c_neg"), skip).otherwise(more)
    out = out.groupBy("_q").agg(F.min(lo).alias("seq_start"), F.max(hi).alias("seq_end"))
    return out.select("_q.*", "seq_start", "seq_end")


def _pieces(blocks: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    """The queries' positions as gap-free runs of columns: the queries' columns, col_start and col_end."""
    s, on = _stretches_of(blocks, queries, name, "_c_")
    out = queries.join(s, on & (F.col("_c_pos") < F.col("stop")) & (F.col("first") < F.col("_c_pos_end")))
    low, high = F.greatest(F.col("first") - F.col("_c_pos"), F.lit(0)), F.greatest(F.col("_c_pos_end") - F.col("stop"), F.lit(0))
    begin = F.col("_c_col") + F.when(F.col("_c_neg"), high).otherwise(low)
    end = F.col("_c_col_end") - F.when(F.col("_c_neg"), low).otherwise(high)
    return out.select(*queries.columns, begin.alias("col_start"), end.alias("col_end")).where("col_start < col_end")


def sequence_to_columns(blocks: DataFrame, queries: DataFrame, trim: bool = False) -> DataFrame:
    """(block, name, first, stop) in sequence positions -> gap-free runs of columns, col_start and col_end.

    For a negative strand the runs come in the order of the columns all the same. Positions outside the sequence fail
    unless ``trim``.
    """
    span = blocks.select("block", "name", F.col("start").alias("_s"), F.col("end").alias("_e"))
    q = queries.join(span, ["block", "name"])
    if not trim:
        outside = (F.col("first") < F.col("_s")) | (F.col("stop") > F.col("_e")) | (F.col("first") >= F.col("stop"))
        q = q.withColumn("first", F.when(outside, F.raise_error(F.lit("positions outside the sequence")).cast("long")).otherwise(F.col("first")))
    return _pieces(blocks, q.select("block", "name", "first", "stop").distinct(), "name")


def liftover(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """(block, origin, dest, first, stop) -> pieces on the other sequence, dest_start and dest_end, numbered in column order.

    Each gap-free run of the origin gives one piece, from its least to its greatest base on the other side; a run that
    meets only gaps gives none.
    """
    by = ["block", "origin", "dest", "first", "stop"]
    here = _pieces(blocks, queries.select(*by).distinct(), "origin")
    s, on = _stretches_of(blocks, here, "dest", "_d_")
    both = here.join(s, on & (F.col("_d_col") < F.col("col_end")) & (F.col("col_start") < F.col("_d_col_end")))
    skip, more = F.greatest(F.col("col_start") - F.col("_d_col"), F.lit(0)), F.greatest(F.col("_d_col_end") - F.col("col_end"), F.lit(0))
    lo = F.col("_d_pos") + F.when(F.col("_d_neg"), more).otherwise(skip)
    hi = F.col("_d_pos_end") - F.when(F.col("_d_neg"), skip).otherwise(more)
    out = both.groupBy(*by, "col_start").agg(F.min(lo).alias("dest_start"), F.max(hi).alias("dest_end"))
    return out.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("col_start")).alias("piece"), "dest_start", "dest_end")


# --- genome alignments: blocks with a reference sequence named ``assembly.chrom``


def genome_blocks(blocks: DataFrame, reference: str) -> DataFrame:
    """block, chrom, start, end of the reference sequence of each block; a block with none or several fails."""
    ref = blocks.withColumn("_ref", F.col("name").startswith(f"{reference}."))
    out = ref.groupBy("block").agg(F.sum(F.col("_ref").cast("int")).alias("n"), *[F.max(F.when(F.col("_ref"), F.col(c))).alias(c) for c in ("name", "start", "end")])
    bad = (F.col("n") == 1) & ~F.col("name").rlike(r"\A[^.]+\.[^.]+\z")
    chrom = F.when(bad, F.raise_error(F.concat(F.lit("not assembly.chromosome: "), F.col("name"))).cast("string")).when(F.col("n") == 1, F.substring_index("name", ".", -1)).otherwise(F.raise_error(F.concat(F.lit("block without one reference sequence: "), F.col("block").cast("string"))).cast("string"))
    return out.select("block", chrom.alias("chrom"), "start", "end")


def species(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def genome_cells(blocks: DataFrame, reference: str, missing: str = GAPS, only: list[str] | None = None) -> DataFrame:
    """chrom, pos, block, name, nuc: every column of every block that holds a reference base, at its genome position."""
    c = cells(blocks, missing)
    place = genome_blocks(blocks, reference).select("block", "chrom")
    at = c.where(F.col("name").startswith(f"{reference}.") & F.col("pos").isNotNull()).select("block", "col", F.col("pos").alias("_pos")).join(place, "block")
    rows = c if only is None else c.where(species(F.col("name")).isin(*only))
    return rows.join(at, ["block", "col"]).select("chrom", F.col("_pos").alias("pos"), "block", "name", "nuc")


def pid_by_position(gcells: DataFrame, ignore_gaps: bool = False) -> DataFrame:
    """chrom, pos, pid: share of the commonest symbol of the column at each genome position.

    Gaps never are the commonest; they count in the denominator unless ignored. A position in several blocks, or with gaps
    only, has none.
    """
    counts = gcells.groupBy("chrom", "pos", "nuc").agg(F.count("*").alias("n"), F.min("block").alias("b0"), F.max("block").alias("b1"))
    gap = F.col("nuc") == "-"
    out = counts.groupBy("chrom", "pos").agg(F.max(F.when(~gap, F.col("n"))).alias("best"), F.sum(F.when(~gap | F.lit(not ignore_gaps), F.col("n"))).alias("all"), F.min("b0").alias("b0"), F.max("b1").alias("b1"))
    return out.where("b0 = b1 and best is not null").select("chrom", "pos", (F.col("best") / F.col("all")).alias("pid"))


def pid_tiles(blocks: DataFrame, reference: str, missing: str = GAPS, only: list[str] | None = None, ignore_gaps: bool = False) -> DataFrame:
    """chrom, start, end, block, pids: the share of the commonest symbol at each reference base, ``TILE`` bases a row.

    The rows of a block come together once and are compared column by column as whole arrays. Gaps never are the
    commonest; they count in the denominator unless ignored. A value is null where all that counts is gaps.
    """
    if missing not in (SKIP, GAPS):
        raise ValueError(f"unknown handling of missing sequences {missing}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, starts, ends, pids = [], [], [], []
            for r, (ref, start, neg, seqs) in enumerate(zip(*(b.column(i).to_pylist() for i in range(2, 6)))):
                ref = _codes(ref)
                at = np.flatnonzero(ref != ord("-"))
                best, seen, filled = (np.zeros(len(at), np.int64) for _ in range(3))
                symbols: dict[int, np.ndarray] = {}
                for s in seqs:
                    if s is None and missing == SKIP:
                        continue
                    x = np.full(len(ref), ord("-"), np.uint32) if s is None else _codes(s)
                    x = np.pad(x, (0, max(0, len(ref) - len(x))))[: len(ref)][at]
                    seen += x != 0
                    filled += (x != 0) & (x != ord("-"))
                    for c in np.unique(x).tolist():
                        if c not in (0, ord("-")):
                            symbols[c] = symbols.get(c, 0) + (x == c)
                for n in symbols.values():
                    best = np.maximum(best, n)
                share = np.where(best > 0, best / np.maximum(filled if ignore_gaps else seen, 1), np.nan)
                share = share[::-1] if neg else share
                for k in range(0, len(share), TILE):
                    row.append(r), starts.append(start + k), ends.append(start + min(k + TILE, len(share))), pids.append(pa.array(share[k : k + TILE], pa.float64(), from_pandas=True))
            at = pa.array(row, pa.int64())
            offsets = pa.array(np.cumsum([0, *map(len, pids)]), pa.int32())
            values = pa.concat_arrays(pids) if pids else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(1).take(at), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), b.column(0).take(at), pa.ListArray.from_arrays(offsets, values)], ["chrom", "start", "end", "block", "pids"])

    rows = _sided(blocks, reference)
    counted = F.col("rows") if only is None else F.filter("rows", lambda r: F.substring_index(r["name"], ".", 1).isin(*only))
    rows = rows.select("block", "chrom", F.col("r.seq").alias("ref"), F.col("s").cast("long"), "neg", F.transform(counted, lambda r: r["seq"]).alias("seqs"))
    return rows.mapInArrow(run, f"chrom string, start long, end long, block {blocks.schema['block'].dataType.simpleString()}, pids array<double>")


def _asked(windows: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, pos, pid at the bases of windows (``keys`` with chrom, start, end) that exactly one block holds."""
    from spanloom.operators.overlap import overlap_join

    pairs = overlap_join(windows, cut(tiles))
    lo, hi = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    part = F.slice("b_pids", (lo - F.col("b_start") + 1).cast("int"), (hi - lo).cast("int"))
    cells = pairs.select(*[F.col(f"a_{k}").alias(k) for k in keys], F.col("b_block").alias("_block"), lo.alias("_lo"), F.posexplode(part).alias("_i", "pid"))
    one = cells.groupBy(*keys, (F.col("_lo") + F.col("_i")).alias("pos")).agg(F.min("_block").alias("_a"), F.max("_block").alias("_b"), F.min("pid").alias("pid"))
    return one.where("_a = _b and pid is not null").select(*keys, "pos", "pid")


def region_profiles(regions: DataFrame, blocks: DataFrame, reference: str, key: str = "name", missing: str = GAPS, only: list[str] | None = None, ignore_gaps: bool = False) -> DataFrame:
    """``key``, offset (from 0, 5' to 3'), pid at every base of each region; null where no single column holds the base.

    ``key`` names a column that is unique in ``regions``. Only the tiles that regions meet are opened.
    """
    from spanloom.operators.predicates import is_positive

    rows = regions.where("start < end").select(key, "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), is_positive(F.col("strand")).alias("_up"))
    keys = [key, "chrom", "start", "end", "_up"]
    pid = _asked(rows, pid_tiles(blocks, reference, missing, only, ignore_gaps), keys)
    offset = F.when(F.col("_up"), F.col("pos") - F.col("start")).otherwise(F.col("end") - 1 - F.col("pos"))
    pid = pid.select(key, offset.alias("offset"), "pid")
    spread = rows.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - F.col("start") - 1)).alias("offset"))
    return spread.join(pid, [key, "offset"], "left").select(key, "offset", "pid")


def conservation_profile(regions: DataFrame, blocks: DataFrame, reference: str, window: int, missing: str = GAPS, only: list[str] | None = None, ignore_gaps: bool = False) -> DataFrame:
    """offset (from 0, 5' to 3'), pid: mean share of the commonest symbol over all regions' windows of that size.

    Regions are re-centred to ``window``; positions without one alignment column are left out of the mean. Without any
    region there is no row.
    """
    from spanloom.operators.predicates import is_positive, transform_center

    s, e = transform_center(window)
    # equal windows are looked up once
    asked = regions.select("chrom", s.cast("long").alias("start"), e.cast("long").alias("end"), is_positive(F.col("strand")).alias("_up"))
    asked = asked.groupBy("chrom", "start", "end", "_up").agg(F.count("*").alias("_n"))
    pid = _asked(asked, pid_tiles(blocks, reference, missing, only, ignore_gaps), ["chrom", "start", "end", "_up", "_n"])
    offset = F.when(F.col("_up"), F.col("pos") - F.col("start")).otherwise(F.col("end") - 1 - F.col("pos"))
    means = pid.groupBy(offset.cast("int").alias("offset")).agg((F.sum(F.col("pid") * F.col("_n")) / F.sum("_n")).alias("pid"))
    every = asked.limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("offset"))
    return every.join(means, "offset", "left").select("offset", "pid")


def pids(blocks: DataFrame, reference: str, missing: str = GAPS, only: list[str] | None = None, ignore_gaps: bool = False) -> DataFrame:
    """chrom, pos, pid at every reference base that exactly one block holds. Positions of several blocks are told by the
    blocks' places alone, so no base is shuffled."""
    tiles = pid_tiles(blocks, reference, missing, only, ignore_gaps)
    twice = _twice(_sided(blocks, reference))
    out = tiles.join(twice, F.col("block") == F.col("_tb"), "left").select("chrom", "start", "twice", F.posexplode("pids").alias("i", "pid"))
    out = out.select("chrom", (F.col("start") + F.col("i")).alias("pos"), "twice", "pid")
    return out.where(F.col("pid").isNotNull() & _alone()).select("chrom", "pos", "pid")


def unique_column(gcells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Symbols at wanted (chrom, pos); a position in no block, or in several, fails."""
    hits = wanted.join(gcells, ["chrom", "pos"], "left")
    n = F.size(F.collect_set("block").over(Window.partitionBy("chrom", "pos")))
    ok = F.when(n == 1, F.col("nuc")).otherwise(F.raise_error(F.concat(F.when(n == 0, "no").otherwise("no unique"), F.lit(" alignment column at "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))).cast("string"))
    return hits.select("chrom", "pos", "name", ok.alias("nuc"))


def _sided(blocks: DataFrame, reference: str) -> DataFrame:
    """block, rows (all its sequences), r (the reference one), chrom, s (its first base), n, neg; blocks without exactly
    one reference sequence fail, those whose reference has no symbols are left out."""
    rows = blocks.groupBy("block").agg(F.collect_list(F.struct("name", "seq", "start", "end", "strand")).alias("rows"))
    refs = F.filter("rows", lambda r: r["name"].startswith(f"{reference}."))
    wrong = F.raise_error(F.concat(F.lit("block without one reference sequence: "), F.col("block").cast("string"))).cast(rows.select(refs[0]).dtypes[0][1])
    rows = rows.select("block", "rows", F.when(F.size(refs) == 1, F.get(refs, F.lit(0))).otherwise(wrong).alias("r")).where("r.seq is not null and r.seq <> ''")
    n, neg = _bases(F.col("r.seq")), F.coalesce("r.strand", F.lit("+")) == "-"
    return rows.withColumns({"chrom": F.substring_index("r.name", ".", -1), "s": F.when(neg, F.col("r.end") - n).otherwise(F.col("r.start")), "neg": neg, "n": n})


def _twice(rows: DataFrame) -> DataFrame:
    """_tb (a block), twice: where other blocks hold the same bases."""
    from spanloom.operators.overlap import overlap_join

    places = cut(rows.select("block", "chrom", F.col("s").alias("start"), (F.col("s") + F.col("n")).alias("end")).where("start < end"))
    return overlap_join(places, places).where("a_block <> b_block").groupBy(F.col("a_block").alias("_tb")).agg(F.collect_set(F.struct(F.greatest("a_start", "b_start").alias("s"), F.least("a_end", "b_end").alias("e"))).alias("twice"))


def _alone() -> Column:
    return F.col("twice").isNull() | ~F.exists("twice", lambda t: (F.col("pos") >= t["s"]) & (F.col("pos") < t["e"]))


def unique_columns(blocks: DataFrame, reference: str) -> DataFrame:
    """chrom, pos, name, nuc: the column of every genome position that exactly one block holds.

    Sequences without symbols stand as gaps throughout; a block without one reference sequence fails. The rows of a block
    are brought together once and laid out side by side, so no cells are shuffled; which positions lie in several blocks
    is told by the blocks' places alone.
    """
    rows = _sided(blocks, reference)
    twice = _twice(rows)
    pieces = lambda c: F.regexp_extract_all(c, F.lit("(?s).{1,64}"), F.lit(0))
    ref = pieces(F.col("r.seq"))
    before = F.aggregate(F.transform(ref, _bases), F.array(F.lit(0)), lambda a, k: F.array_append(a, F.element_at(a, -1) + k))
    gaps = F.repeat(F.lit("-"), F.length("r.seq"))
    out = rows.join(twice, F.col("block") == F.col("_tb"), "left").select("chrom", "s", "neg", "n", "twice", ref.alias("ref"), before.alias("before"), gaps.alias("gaps"), F.explode("rows").alias("row"))
    kept = ["chrom", "s", "neg", "n", "twice", F.col("row.name").alias("name")]
    out = out.select(*kept, F.explode(F.arrays_zip("ref", "before", pieces(F.coalesce("row.seq", "gaps")).alias("text"))).alias("c")).where("c.ref is not null and c.text is not null")
    out = out.select(*kept[:-1], "name", "c", F.posexplode(F.arrays_zip(F.split("c.ref", "").alias("ref"), F.split("c.text", "").alias("nuc"))).alias("i", "x")).where("x.ref <> '-' and x.nuc is not null")
    rank = F.col("c.before") + _bases(F.substring("c.ref", F.lit(1), F.col("i") + 1))
    out = out.select("chrom", "twice", "name", F.col("x.nuc").alias("nuc"), F.when(F.col("neg"), F.col("s") + F.col("n") - rank).otherwise(F.col("s") + rank - 1).alias("pos"))
    return out.where(_alone()).select("chrom", "pos", "name", "nuc")
