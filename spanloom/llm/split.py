"""Splitting oversized items at natural boundaries, with a fixed overlap between consecutive pieces.

Texts are split by one regular expression of bounded quantifiers: its alternatives, strongest boundary first, consume at
most the whole limit; the last alternative takes any character. ``regexp_extract_all`` gives the bodies, sums over the
array give their offsets, and each piece looks back ``overlap`` characters into the body before it.

Intervals are split by the same rule over positions. The regular expression would read one character a base, a thousand
characters for each byte of input (its figures are in the README), so the alternatives are array functions instead: the
greatest break in reach, else the limit itself, folded over a bounded sequence with the next start looked back from each
end. Breaks stand in small bins, so a step looks at two of them, however many breaks a region has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.common import once, strip

#: Bodies whose lengths are summed one by one; longer arrays have a sum per block.
BLOCK = 128
#: Fixed value: what counts as a blank.
BLANK = "[ \\t\\n\\r\\f]"


def text_pattern(body: int, overlap: int = 0) -> str:
    """Paragraph end, line end, sentence end, blank, any character: each with at most ``body`` characters.

    The first four are sought in the window's second half, then the last blank in its first half. What is left over at
    the end may be shorter than that and stays whole.
    """
    least = max(body // 2, overlap)
    ends = ("\\n\\n", "\\n", f"[.!?]{BLANK}", BLANK)
    widths = (2, 1, 2, 1)
    early = [f".{{{max(overlap - 1, 0)},{least}}}{BLANK}"] if overlap < least else []
    return "(?s)" + "|".join([f".{{1,{body}}}\\z", *[f".{{{least},{body - w}}}{e}" for e, w in zip(ends, widths)], *early, f".{{1,{body}}}"])


def split_texts(df: DataFrame, limit: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, piece_no (from 1), piece_start (0-based, in characters), piece: all pieces of every text.

    A piece has at most ``limit`` characters, of which the first ``overlap`` (none in the first piece) repeat the end of
    the one before; bodies joined give back the text. Texts within the limit are one piece. Null and empty texts have no
    piece. Repeated rows are split each. No shuffle; work and memory are linear in a text's length, however long.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    body = F.regexp_extract_all(F.col("_text"), F.lit(text_pattern(limit - overlap, overlap)), F.lit(0))
    # a text within the limit stays whole even where its body would not
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = once(rows, bodies=F.when(F.length("_text") <= limit, F.array("_text")).otherwise(body)).drop("_text")
    rows = once(rows, sizes=F.transform("bodies", F.length))
    last = F.floor((F.size("sizes") - 1) / BLOCK).cast("int")

    def total(first: Column, n: Column) -> Column:
        return F.aggregate(F.slice("sizes", first, n), F.lit(0).cast("long"), lambda a, x: a + x)

    sums = F.transform(F.sequence(F.lit(0), last), lambda k: total(k * BLOCK + 1, F.lit(BLOCK)))
    rows = once(rows, before=F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)))

    def piece(b: Column, i: Column) -> Column:
        back = F.when(i > 0, overlap).otherwise(0)
        block = F.floor(i / BLOCK).cast("int")
        start = F.get("before", block) + total(block * BLOCK + 1, i % BLOCK) - back
        return F.struct(start.cast("int").alias("start"), F.concat(F.when(i > 0, F.right(F.get("bodies", i - 1), back)).otherwise(F.lit("")), b).alias("piece"))

    out = rows.select("_key", F.posexplode(F.transform("bodies", piece)).alias("i", "x"))
    return out.select(F.col("_key").alias(key), (F.col("i") + 1).alias("piece_no"), F.col("x.start").alias("piece_start"), F.col("x.piece").alias("piece"))


def _shift(c: Column, bits: int) -> Column:
    return F.shiftright(c.cast("long"), bits)


def split_regions(regions: DataFrame, breaks: DataFrame, limit: int = 100_000, least: int = 50_000, overlap: int = 2_000) -> DataFrame:
    """region_id, piece_no, piece_start, piece_end of every region (region_id, chrom, start, end) longer than ``limit``.

    A piece that begins at s ends at the region's end if that is within ``limit``, else at the greatest break (chrom,
    pos) in (s + least, s + limit], else at s + limit; the next piece begins ``overlap`` before that end. Names of
    sequences compare without surrounding blanks. Regions with a null chrom, start or end and those within the limit
    (empty and reversed ones too) have no piece; null and repeated breaks change nothing; a repeated region row is split
    as often as it occurs. Breaks are joined by sequence and
    bin, so no row carries more than a region's own.
    """
    bits = (limit - least).bit_length()  # a window of breaks lies in two bins at most
    long = regions.select("region_id", strip(F.col("chrom")).alias("chrom"), F.col("start").cast("long").alias("s0"), F.col("end").cast("long").alias("e0"))
    long = long.where(F.col("chrom").isNotNull() & (F.col("e0") - F.col("s0") > limit))
    marks = breaks.select(strip(F.col("chrom")).alias("chrom"), F.col("pos").cast("long").alias("pos")).where("chrom is not null and pos is not null")
    marks = marks.groupBy("chrom", _shift(F.col("pos"), bits).alias("bin")).agg(F.collect_set("pos").alias("in_bin"))
    first, last = _shift(F.col("s0"), bits), _shift(F.col("e0"), bits)
    spread = long.withColumn("bin", F.explode(F.sequence(first, last)))
    keys = ["region_id", "chrom", "s0", "e0"]
    joined = spread.join(marks, ["chrom", "bin"], "left").select(*keys, F.struct("bin", "in_bin").alias("b"))
    # pieces are made where the bins of a region come together, so that step is spread over all tasks
    tasks = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = joined.repartition(tasks, *keys).groupBy(*keys).agg(F.array_sort(F.collect_set("b")).alias("bins"), F.count("*").alias("n"))
    near = once(near.withColumnRenamed("bins", "sorted"), bins=F.transform("sorted", lambda b: b["in_bin"]), origin=first, copies=(F.col("n") / (last - first + 1)).cast("int"))

    def step(acc: Column, _: Column) -> Column:
        s = acc["s"]
        reach = _shift(s + limit, bits) - F.col("origin")

        def greatest(back: int) -> Column:
            return F.array_max(F.filter(F.get("bins", (reach - back).cast("int")), lambda x: (x > s + least) & (x <= s + limit)))

        stop = F.when(F.col("e0") - s <= limit, F.col("e0")).otherwise(F.coalesce(greatest(0), greatest(1), s + limit))
        return F.when(s.isNull(), acc).otherwise(_next(acc, s, stop))

    def _next(acc: Column, s: Column, stop: Column) -> Column:
        # the stop is made once: a lambda over one element binds it
        return F.get(F.transform(F.array(stop), lambda e: F.struct(F.when(e < F.col("e0"), e - overlap).alias("s"), F.array_append(acc["out"], F.struct(s.alias("a"), e.alias("b"))).alias("out"))), F.lit(0))

    zero = F.struct(F.col("s0").alias("s"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out"))
    steps = F.sequence(F.lit(1), F.ceil((F.col("e0") - F.col("s0")) / F.lit(least + 1 - overlap)).cast("int") + 1)
    out = near.select("region_id", "copies", F.aggregate(steps, zero, step)["out"].alias("out"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("region_id", F.posexplode("out").alias("i", "x"))
    return out.select("region_id", (F.col("i") + 1).alias("piece_no"), F.col("x.a").alias("piece_start"), F.col("x.b").alias("piece_end"))
