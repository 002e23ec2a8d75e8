"""References to records that do not exist: a bounded Bloom filter first, an exact as-of check after it.

``find_orphans`` works in three steps.

1. The parents' keys are folded into a blocked Bloom filter (16 words of 64 bits a page) by one hash aggregation. The
   filter's size follows the number of distinct keys up to ``max_pages`` (64 MB at most), so what is broadcast is
   bounded; beyond that bound it only grows less selective, the result stays exact.
2. A reference whose bits are not all set has no parent at any time: a definite orphan, found without a shuffle.
3. Only filter-positive references are verified, by an exact join. Parents become one row per key and time slice (a day
   by default): the moments at which rows were loaded in it with their ends, and the furthest end handed over from the
   slices before. A reference meets the row of its own key and slice, so each has one partner at most; keys and slices
   with very many references are salted, their one row repeated per salt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.common import cut, once, strip

WORDS = 16
MIN_PAGES, MAX_PAGES = 1 << 8, 1 << 19
#: Fixed value: stands for "never deleted".
NEVER = "9999-12-31 00:00:00"


def reference_key(c: Column) -> Column:
    """Key without surrounding blanks, letter case and a version suffix (``.`` and digits at the end); null if blank."""
    bare = strip(F.regexp_replace(F.lower(strip(c)), r"\.[0-9]+$", ""))
    return F.when(strip(c) != "", bare)


def exon_reference(c: Column) -> Column:
    """What stands before the first ``_exon_``; null where there is none."""
    return F.when(F.instr(c, "_exon_") > 0, F.substring_index(c, "_exon_", 1))


@dataclass(frozen=True)
class Bloom:
    pages: DataFrame
    n_pages: int

    @staticmethod
    def _place(key: Column, n_pages: int) -> tuple[Column, Column, Column]:
        a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
        mask = F.lit(0).cast("long")
        for i in range(5):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(b, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
        return a.bitwiseAND(F.lit(n_pages - 1)), F.shiftrightunsigned(a, 32).bitwiseAND(F.lit(WORDS - 1)).cast("int"), mask

    @classmethod
    def of(cls, keys: DataFrame, col: str, bits_per_key: int = 16, max_pages: int = MAX_PAGES) -> Bloom:
        n = keys.agg(F.approx_count_distinct(col)).first()[0] or 0
        n_pages = MIN_PAGES
        while n_pages < max_pages and n_pages * WORDS * 64 < n * bits_per_key:
            n_pages *= 2
        page, word, mask = cls._place(F.col(col), n_pages)
        rows = keys.where(F.col(col).isNotNull()).select(page.alias("bloom_page"), word.alias("w"), mask.alias("m"))
        # word by word first, so that the second step's 16 conditions stand on plain columns
        rows = rows.groupBy("bloom_page", "w").agg(F.bit_or("m").alias("m"))
        words = [F.coalesce(F.max(F.when(F.col("w") == i, F.col("m"))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(WORDS)]
        pages = rows.groupBy("bloom_page").agg(*words).select("bloom_page", F.array(*[f"w{i}" for i in range(WORDS)]).alias("bloom_words"))
        return cls(pages, n_pages)

    def probe(self, df: DataFrame, col: str, into: str) -> DataFrame:
        """``df`` with the boolean ``into``: false proves that the key is not among the parents."""
        page, word, mask = self._place(F.col(col), self.n_pages)
        out = df.withColumns({"bloom_page": page, "bloom_mask": mask, "bloom_word": word}).join(F.broadcast(self.pages), "bloom_page", "left")
        have = F.element_at("bloom_words", F.col("bloom_word") + 1).bitwiseAND(F.col("bloom_mask"))
        return out.withColumn(into, F.coalesce(have == F.col("bloom_mask"), F.lit(False))).drop("bloom_page", "bloom_mask", "bloom_word", "bloom_words")


def find_orphans(refs: DataFrame, parents: DataFrame, slice_unit: str = "day", max_pages: int = MAX_PAGES, rows_per_task: int = 2_000_000) -> DataFrame:
    """Orphans of ``refs`` (src_table, row_id, ref, loaded_at) among ``parents`` (name, loaded_at, deleted_at).

    Returns src_table, row_id, period (``YYYY-MM`` of loaded_at), cause: ``missing`` if no parent row has the key at any
    time, ``deleted`` if one was loaded at or before the row's time but none is alive then, else ``late``.

    Null and blank references refer to nothing. Null or blank parent keys match nothing; a parent without loaded_at never
    counts as loaded, yet its key is known. A reference without loaded_at is reported only if its key is missing, with a
    null period. Repeated rows are each reported. Empty tables give an empty result or only ``missing``. A key's distinct
    load moments within one slice stand in one array; all else is spread by key, slice and salt.
    """
    never = F.lit(NEVER).cast("timestamp_ntz" if dict(parents.dtypes)["loaded_at"] == "timestamp_ntz" else "timestamp")
    keyed = once(refs.select("src_table", "row_id", "ref", F.col("loaded_at").alias("t")), key=reference_key(F.col("ref"))).drop("ref").where("key is not null")
    par = once(parents.select("name", F.col("loaded_at").alias("t"), F.coalesce("deleted_at", never).alias("until")), key=reference_key(F.col("name"))).where("key is not null")
    par = par.groupBy("key", "t").agg(F.max("until").alias("until"))
    # the parents' keys are read for the filter's size, its bits and the check, so they are written once
    par = cut(par.withColumn("slice", F.date_trunc(slice_unit, "t")))
    probed = Bloom.of(par.select("key"), "key", max_pages=max_pages).probe(keyed, "key", "maybe")
    definite = probed.where(~F.col("maybe")).select("src_table", "row_id", "t", F.lit("missing").alias("cause"))
    child = probed.where("maybe").drop("maybe").withColumn("slice", F.date_trunc(slice_unit, "t"))

    kind = par.schema["until"].dataType
    loads = par.groupBy("key", "slice").agg(F.max(F.when(F.col("t").isNotNull(), F.col("until"))).alias("last"), F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "until"))).alias("loads"))
    asked = child.groupBy("key", "slice").agg(F.count("*").alias("n"))
    both = loads.select("key", "slice", "last", "loads", F.lit(True).alias("known"), F.lit(0).cast("long").alias("n"))
    both = both.unionByName(asked.select("key", "slice", F.lit(None).cast(kind).alias("last"), F.lit(None).cast(loads.schema["loads"].dataType).alias("loads"), F.lit(False).alias("known"), "n"))
    both = both.groupBy("key", "slice").agg(F.max("last").alias("last"), F.first("loads", ignorenulls=True).alias("loads"), F.max("known").alias("known"), F.sum("n").alias("n"))
    by_key = Window.partitionBy("key")
    before = by_key.orderBy(F.col("slice").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    marks = both.select("key", "slice", "loads", "n", F.max("last").over(before).alias("before"), F.max("known").over(by_key).alias("known")).where("n > 0")
    marks = cut(marks.withColumn("salts", F.ceil(F.col("n") / rows_per_task).cast("int")))
    # as many entries as there are references over rows_per_task, at most
    heavy = marks.where("salts > 1").select(F.col("key").alias("_hk"), F.col("slice").alias("_hs"), "salts")
    if heavy.isEmpty():
        child, marks = child.withColumn("salt", F.lit(0)), marks.withColumn("salt", F.lit(0))
    else:
        child = child.join(F.broadcast(heavy), (F.col("key") == F.col("_hk")) & F.col("slice").eqNullSafe(F.col("_hs")), "left")
        child = child.withColumn("salt", F.pmod(F.xxhash64("row_id", "src_table"), F.coalesce("salts", F.lit(1))).cast("int")).drop("_hk", "_hs", "salts")
        marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    marks = marks.select(F.col("key").alias("_mk"), F.col("slice").alias("_ms"), F.col("salt").alias("_msalt"), "loads", "before", "known")
    pairs = child.join(marks, (F.col("key") == F.col("_mk")) & F.col("slice").eqNullSafe(F.col("_ms")) & (F.col("salt") == F.col("_msalt")))
    so_far = F.array_max(F.transform(F.filter("loads", lambda x: x["t"] <= F.col("t")), lambda x: x["until"]))
    checked = pairs.select("src_table", "row_id", "t", "known", F.greatest("before", so_far).alias("alive_until"))
    cause = F.when(~F.col("known"), "missing").when(F.col("t").isNull(), None).when(F.col("alive_until").isNull(), "late").when(F.col("alive_until") <= F.col("t"), "deleted")
    verified = once(checked, cause=cause).where("cause is not null").select("src_table", "row_id", "t", "cause")
    return definite.union(verified).select("src_table", "row_id", F.date_format("t", "yyyy-MM").alias("period"), "cause")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, period and cause."""
    return orphans.groupBy("src_table", "period", "cause").agg(F.count("*").alias("n_orphans"))
