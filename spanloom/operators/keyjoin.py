"""Key joins of delimited tables with explicit policies for duplicate keys, blank keys and unmatched rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("error_on_dups", "all_pairwise_combinations", "column_wise_join")


class TableJoinError(ValueError):
    """What all errors of a table join are."""


class InvalidHeaderError(TableJoinError):
    pass


class DuplicateKeyError(TableJoinError):
    pass


class MissingKeyError(TableJoinError):
    pass


class MissingValueError(TableJoinError):
    pass


def check_header(names: list[str], key: str) -> None:
    """Names must be there and differ; the key must be one of them."""
    if any(not n or n.isspace() for n in names):
        raise InvalidHeaderError("empty column name")
    if len(set(names)) < len(names):
        raise InvalidHeaderError("column name occurs twice")
    if key not in names:
        raise InvalidHeaderError(f"no column {key}")


def joined_header(first: list[str] | None, second: list[str] | None, n_first: int, n_second: int, missing: str | None = None) -> list[str] | None:
    """The joined table's header: none if neither table has one; a table without one gets ``missing`` in each cell.

    ``n_second`` counts the second table's columns in the result. Tables of which one has a header need ``missing``.
    """
    if first is None and second is None:
        return None
    if (first is None or second is None) and missing is None:
        raise InvalidHeaderError("one table with and one without a header need a missing value")
    return [*(first if first is not None else [missing] * n_first), *(second if second is not None else [missing] * n_second)]


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _prepared(df: DataFrame, key: str, order: str | None, missing: str | None, skip_blank: bool) -> DataFrame:
    """Blank cells become the missing value, the key's too; keys still blank fail or are left out."""
    cols = [c for c in df.columns if c != order]
    check_header(cols, key)
    if missing is not None:
        return df.select(*[F.when(_blank(F.col(f"`{c}`")), missing).otherwise(F.col(f"`{c}`")).alias(c) for c in cols], *([order] if order else []))
    if skip_blank:
        return df.where(~_blank(F.col(f"`{key}`")))
    if df.where(_blank(F.col(f"`{key}`"))).limit(1).count():
        raise MissingKeyError(f"blank key in column {key}")
    return df


def _no_duplicates(df: DataFrame, key: str) -> None:
    if df.groupBy(f"`{key}`").count().where("count > 1").limit(1).count():
        raise DuplicateKeyError(f"a key occurs more than once in column {key}")


def fold_columns(df: DataFrame, key: str, order: str, cols: list[str], shared_seen: bool) -> DataFrame:
    """One row per key: each column's values in order, joined by ``;``.

    ``shared_seen``: a value is left out if the key's rows had it before *in any column*; else every value is kept, the
    key's repeats included.
    """
    group = df.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.array(*[f"`{c}`" for c in cols]).alias("v")))).alias("rows"))
    group = group.withColumn("rows", F.transform("rows", lambda r: r["v"]))
    if not shared_seen:

        def column(i: int) -> Column:
            return F.array_join(F.transform("rows", lambda r: r[i]), ";")

        return group.select("_key", *[column(i).alias(c) for i, c in enumerate(cols)])

    def one(acc: Column, row: Column) -> Column:
        def cell(a: Column, i: Column) -> Column:
            v, seen, out = F.get(row, i), a["seen"], a["out"]
            old = F.get(out, i)
            fresh = ~F.array_contains(seen, v)
            new = F.transform(out, lambda x, j: F.when((j == i) & fresh, F.concat(old, F.lit(";"), v)).otherwise(x))
            return F.struct(F.when(fresh, F.array_append(seen, v)).otherwise(seen).alias("seen"), new.alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(cols) - 1)), acc, cell)

    first = F.get("rows", F.lit(0))
    init = F.struct(F.array_distinct(first).alias("seen"), first.alias("out"))
    folded = group.withColumn("_out", F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), init, one)["out"])
    return folded.select("_key", *[F.get("_out", F.lit(i)).alias(c) for i, c in enumerate(cols)])


def join_tables(
    left: DataFrame,
    right: DataFrame,
    key: str,
    right_key: str | None = None,
    policy: str = "error_on_dups",
    missing: str | None = None,
    skip_blank_keys: bool = False,
    unpaired: bool = False,
    order: str | None = None,
    right_order: str | None = None,
    header: bool = True,
) -> DataFrame:
    """All columns of ``left`` and those of ``right`` without its key, for rows of equal keys.

    Cells are strings. ``policy``: a key that occurs twice in either table fails; or gives all pairs; or each table is
    first folded to one row per key (``fold_columns``; ``order`` columns say which row came first and are dropped). With
    ``missing``, blank cells and keys become that value. Blank keys fail without it, or are left out with
    ``skip_blank_keys``. ``unpaired`` adds rows without a partner, the other side filled with ``missing``, which it needs.
    A column of ``right`` whose name ``left`` has gets the suffix ``_2``. ``header`` only matters for the fold's rule.
    Output order is not promised; sort by an order column of your own.
    """
    if policy not in POLICIES:
        raise TableJoinError(f"unknown policy {policy}; one of {', '.join(POLICIES)}")
    if unpaired and missing is None:
        raise MissingValueError("unmatched rows need a missing value")
    right_key = right_key or key
    left, right = _prepared(left, key, order, missing, skip_blank_keys), _prepared(right, right_key, right_order, missing, skip_blank_keys)
    lcols, rcols = [c for c in left.columns if c != order], [c for c in right.columns if c not in (right_order, right_key)]
    if policy == "error_on_dups":
        _no_duplicates(left, key)
        _no_duplicates(right, right_key)
    if policy == "column_wise_join":
        if order is None or right_order is None:
            raise TableJoinError("folding rows needs order columns")
        a, b = fold_columns(left, key, order, lcols, header), fold_columns(right, right_key, right_order, rcols, header) if rcols else right.select(F.col(f"`{right_key}`").alias("_key")).distinct()
    else:
        a, b = left.select(F.col(f"`{key}`").alias("_key"), *[f"`{c}`" for c in lcols]), right.select(F.col(f"`{right_key}`").alias("_key"), *[f"`{c}`" for c in rcols])
    named = []
    for c in rcols:
        n = c
        while n in lcols or n in named:
            n += "_2"
        named.append(n)
    b = b.select(F.col("_key").alias("_rkey"), F.lit(1).alias("_r"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rcols, named)])
    a = a.withColumn("_l", F.lit(1))
    out = a.join(b, a["_key"] == b["_rkey"], "full" if unpaired else "inner")
    if not unpaired:
        return out.select(*[f"`{c}`" for c in [*lcols, *named]])
    fill = lambda c, side: F.when(F.col(side).isNull(), missing).otherwise(F.col(f"`{c}`")).alias(c)
    return out.select(*[fill(c, "_l") for c in lcols], *[fill(c, "_r") for c in named])


def min_over_files(tables: list[DataFrame], key: str, value: str, below: float) -> DataFrame:
    """Least ``value`` per ``key`` over several tables, where it is under ``below``."""
    every = reduce(DataFrame.unionByName, [t.select(key, value) for t in tables])
    return every.groupBy(key).agg(F.min(value).alias(value)).where(F.col(value) < below)
