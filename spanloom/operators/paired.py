"""Matching of several interval or read streams: by key and ordinal, by name, or what only one of them has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("chrom", "start", "end", "name", "score", "strand")


def _numbered(df: DataFrame, keys: list[str], order: list[Column], into: str = "_ord") -> DataFrame:
    """The i-th of equal keys gets the number i."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _same(a: DataFrame, b: DataFrame, keys: list[str], tag: str) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{tag}{k}"]) for k in keys])


def paired(
    streams: list[DataFrame],
    mirror: bool = False,
    mirror_score: float | None = None,
    ignore_strand: bool = False,
    ignore_score: bool = True,
    ignore_name: bool = True,
    order: list[str] | None = None,
) -> DataFrame:
    """Rows of several interval streams matched by place: one row per match, the columns of stream i as s{i}_*.

    The key is chrom, start, end and what is not ignored; the i-th duplicate in one stream matches the i-th in another
    (by ``order``, else by all columns). Without ``mirror`` a match needs all streams. With it any stream will do, and a
    stream without the row gets the place, name and strand of the first stream that has it, with that row's score or
    ``mirror_score``. Streams may be empty.
    """
    if len(streams) < 2:
        raise ValueError("at least two streams")
    keys = ["chrom", "start", "end"] + [c for c, skip in (("strand", ignore_strand), ("name", ignore_name), ("score", ignore_score)) if not skip]
    fields = [f for f in FIELDS if f in streams[0].columns]
    keys = [k for k in keys if k in fields]
    # all streams as one, numbered; windows and groups then work on the one shuffle by key
    every = reduce(DataFrame.unionByName, [s.select(*fields, *(c for c in (order or []) if c not in fields), F.lit(i).alias("_i")) for i, s in enumerate(streams)])
    every = _numbered(every.repartition(*keys), [*keys, "_i"], [F.col(c).asc_nulls_first() for c in (order or fields)])
    row = F.struct(*fields)
    out = every.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], "_ord").agg(*[F.max(F.when(F.col("_i") == i, row)).alias(f"_s{i}") for i in range(len(streams))])
    if not mirror:
        out = out.where(" and ".join(f"_s{i} is not null" for i in range(len(streams))))
    out = out.select(*[x for i in range(len(streams)) for x in (F.col(f"_s{i}").isNotNull().alias(f"_has{i}"), *[F.col(f"_s{i}")[c].alias(f"s{i}_{c}") for c in fields])])
    cols = []
    for i in range(len(streams)):
        for c in fields:
            at = F.col(f"s{i}_{c}")
            if mirror:
                other = F.lit(None)
                for j in reversed(range(len(streams))):
                    other = F.when(F.col(f"_has{j}"), F.col(f"s{j}_{c}")).otherwise(other)
                if c == "score" and mirror_score is not None:
                    other = F.lit(mirror_score)
                at = F.when(F.col(f"_has{i}"), at).otherwise(other)
            cols.append(at.alias(f"s{i}_{c}"))
    return out.select(*cols)


def with_next(df: DataFrame, by: list[str], order: list[str], tag: str = "next_") -> DataFrame:
    """Each row with the one after it in its group, as ``next_*`` columns; nulls for a group's last (give bounded groups)."""
    following = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *[F.lead(c).over(following).alias(f"{tag}{c}") for c in df.columns if c not in by])


def trimmed_name(name: Column, junction: bool, paired_end: bool) -> Column:
    """Read names without a trailing ``%x`` and then a trailing ``.x`` (one character each)."""
    if paired_end and not junction:
        raise ValueError("paired-end tags can only be trimmed together with junction tags")
    if junction:
        name = F.regexp_replace(name, "%.$", "")
    if paired_end:
        name = F.regexp_replace(name, r"\..$", "")
    return name


def duplicates(a: DataFrame, b: DataFrame, junction: bool = False, paired_end: bool = False) -> DataFrame:
    """Full co-group by read name: name, and the original names of either side, sorted."""
    both = a.select(F.lit(1).alias("side"), "name").unionByName(b.select(F.lit(2).alias("side"), "name")).withColumn("key", trimmed_name(F.col("name"), junction, paired_end))
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("name"))))
    return both.groupBy("key").agg(of(1).alias("first"), of(2).alias("second")).withColumnRenamed("key", "name")


def unique(a: DataFrame, b: DataFrame, best: bool = False, order: str | None = None) -> DataFrame:
    """Reads whose name only one side has, as ``side`` (1 or 2) and the read's columns.

    Names match ordinally: the i-th read of a name meets the i-th of the other side. ``best`` also keeps, of two that
    match, the one with the strictly lower score; equal scores drop both.
    """
    cols = a.columns
    by = [F.col(c).asc_nulls_first() for c in ([order] if order else cols)]
    x, y = (_numbered(d.select(*cols), ["name"], by) for d in (a, b))
    y = y.select(*[F.col(c).alias(f"_2{c}") for c in [*cols, "_ord"]])
    j = x.join(y, x["name"].eqNullSafe(y["_2name"]) & (x["_ord"] == y["_2_ord"]), "full")
    first = F.struct(F.lit(1).alias("side"), *[F.col(c) for c in cols])
    second = F.struct(F.lit(2).alias("side"), *[F.col(f"_2{c}").alias(c) for c in cols])
    none = F.lit(None)
    pick = F.when(F.col("_2_ord").isNull(), first).when(F.col("_ord").isNull(), second)
    if best:
        pick = pick.when(F.col("score") < F.col("_2score"), first).when(F.col("_2score") < F.col("score"), second)
    return j.select(pick.otherwise(none).alias("r")).where("r is not null").select("r.*")


def remove_duplicates(a: DataFrame, b: DataFrame, best: bool = False, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The two sides without the reads that both have."""
    out = unique(a, b, best, order)
    return out.where("side = 1").drop("side"), out.where("side = 2").drop("side")
