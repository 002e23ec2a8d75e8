"""Top rows per key when a few keys hold most rows.

Heavy keys are found by a mergeable frequent-items sketch over the key column alone. Their rows are picked out by a
broadcast join with the short list of heavy keys (its length is bounded by the sketch) and ranked per salt first, so a
key's rows spread over as many tasks as its share needs; the remaining keys go through an ordinary shuffle. Both
branches are exact for any list of keys, the sketch only decides which way a key takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, tracked: int = 4096) -> list[tuple[object, int, int]]:
    """(key, estimated rows, all rows) of keys that hold at least ``share`` of the rows; at most ``1 / share`` entries."""
    most = min(int(1 / share) + 1, 1000)
    row = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {most}, {max(tracked, most)})").alias("top"), F.count("*").alias("n")).first()
    n = row["n"] or 0
    return [(x["item"], x["count"], n) for x in (row["top"] or []) if x["count"] >= share * n] if n else []


def task_share(df: DataFrame) -> float:
    """The share of the rows at which a key is heavy: twice that of a shuffle task, between a thousandth and a fiftieth."""
    return min(0.02, max(0.001, 2 / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int, spread: Column, share: float | None = None, rows_per_task: int = 2_000_000) -> DataFrame:
    """The first ``k`` rows of every key by ``order`` (all columns of ``df`` are kept); null keys take no part.

    ``spread`` is any well-distributed column (a row id); rows equal in ``order`` are interchangeable, so give a total
    order where the choice matters. ``share`` of the rows makes a key heavy (``task_share``). Fewer than ``k`` rows of a key all come out. An empty table gives an empty result.
    """
    df = df.where(F.col(key).isNotNull())
    heavy = heavy_keys(df, key, share or task_share(df))
    # helper columns whose names no column of df has
    tag = "_"
    while any(c.startswith(tag) for c in df.columns):
        tag += "_"
    rank, salt, salts, hot_key = (f"{tag}{n}" for n in ("rank", "salt", "salts", "key"))

    def first(d: DataFrame, *by: str) -> DataFrame:
        return d.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k).drop(rank)

    if not heavy:
        return first(df, key)
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    listed = spark.createDataFrame([(x, max(8, -(-n // rows_per_task))) for x, n, _ in heavy], f"{hot_key} {kind}, {salts} long")
    marked = df.join(F.broadcast(listed), df[key] == listed[hot_key], "left")
    light = first(marked.where(F.col(hot_key).isNull()).select(*df.columns), key)
    hot = marked.where(F.col(hot_key).isNotNull()).withColumn(salt, F.pmod(F.xxhash64(spread), F.col(salts)))
    return light.unionByName(first(first(hot, key, salt), key).select(*df.columns))
