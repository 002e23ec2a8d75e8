"""Statistics: corrected p-values, exact test, beta distribution, running means, weighted draws."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def correct_pvalues(df: DataFrame, p: str, into: str = "q", method: str = "BH") -> DataFrame:
    """``df`` with corrected p-values: BH (false discovery rate), bonferroni, holm or BY. Null p-values stay null.

    No global sort: p-values fall into buckets in their order (some 70,000 at most), each bucket is ranked by itself with
    an offset from the counts before it, and running minima are carried over from bucket to bucket.
    """
    if method not in ("BH", "BY", "bonferroni", "holm"):
        raise ValueError(f"unknown method {method}")
    rows = df.where(F.col(p).isNotNull())
    total = rows.agg(F.count("*").alias("n"))
    pv = F.col(p)
    if method == "bonferroni":
        done = rows.join(F.broadcast(total)).withColumn(into, F.least(F.lit(1.0), pv * F.col("n"))).drop("n")
        return done.unionByName(df.where(F.col(p).isNull()).withColumn(into, F.lit(None).cast("double")))
    # equal p-values have one result, so what is ranked are the distinct values with their counts; these fall into even
    # buckets if large, by the logarithm if small, where they crowd
    values = rows.groupBy(pv.alias("_p")).agg(F.count("*").alias("_c"))
    pv = F.col("_p")
    small = F.lit(63) - F.floor((-F.log2(F.greatest(pv, F.lit(1e-300))) - 6) * 64)
    values = values.withColumn("_b", F.when(pv >= 1 / 64, F.floor(pv * 4096)).otherwise(small).cast("long"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = values.groupBy("_b").agg(F.sum("_c").alias("_m")).select(F.col("_b").alias("_bk"), F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_before"))
    up = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.join(F.broadcast(sizes), F.col("_b") == F.col("_bk")).drop("_bk").join(F.broadcast(total))
    ranked = ranked.withColumn("_r", F.col("_before") + F.sum("_c").over(up))
    if method == "holm":
        raw, inside, carried, pick, both = pv * (F.col("n") - F.col("_r") + F.col("_c")), up, upto, F.max, F.greatest
    else:
        raw = pv * F.col("n") / F.col("_r") * (harmonic(F.col("n")) if method == "BY" else 1)
        down = Window.partitionBy("_b").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside, carried, pick, both = down, Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1), F.min, F.least
    ranked = ranked.withColumn("_q", raw)
    edge = ranked.groupBy("_b").agg(pick("_q").alias("_e")).select(F.col("_b").alias("_bk"), pick("_e").over(carried).alias("_c0"))
    out = ranked.withColumn("_q", pick("_q").over(inside)).join(F.broadcast(edge), F.col("_b") == F.col("_bk")).select("_p", F.least(F.lit(1.0), both("_q", "_c0")).alias("_q"))
    done = rows.join(out, rows[p] == out["_p"]).select(*[rows[c] for c in df.columns], F.col("_q").alias(into))
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(into, F.lit(None).cast("double")))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: the terms up to 32, then the expansion about the logarithm (exact to 1e-13 from there on)."""
    few = sum((F.when(n >= i, F.lit(1.0) / i).otherwise(0.0) for i in range(1, 33)), F.lit(0.0))
    x = n.cast("double")
    return F.when(n <= 32, few).otherwise(F.log(x) + 0.57721566490153286 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers: Stirling's series from 32 on, and down to it by the recurrence."""
    x = np.asarray(x, float)
    y = np.where(x < 32, x + 32, x)
    s = (y - 0.5) * np.log(y) - y + 0.91893853320467274 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if (x < 32).any():
        low = np.where(x < 32, x, 1.0)
        s = np.where(x < 32, s - np.log(low[..., None] + np.arange(32)).sum(-1), s)
    return s


def _fisher(a: int, b: int, c: int, d: int, alternative: str) -> tuple[float, float]:
    m, n, k = a + c, b + d, a + b  # column sums and the first row's
    lo, hi = max(0, k - n), min(k, m)
    x = np.arange(lo, hi + 1, dtype=float)
    log_w = -(log_gamma(x + 1) + log_gamma(m - x + 1) + log_gamma(k - x + 1) + log_gamma(n - k + x + 1))
    log_w -= log_w.max()
    w = np.exp(log_w)
    total, at = w.sum(), a - lo
    part = w[at:] if alternative == "greater" else w[: at + 1] if alternative == "less" else w[w <= w[at] * (1 + 1e-7)]
    p = float(min(1.0, part.sum() / total))
    if a == lo:
        return p, 0.0
    if a == hi:
        return p, math.inf
    # the ratio under which the mean is a: Newton's steps on its logarithm, kept within what is known
    left, right, at_log = -700.0, 700.0, math.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
    for _ in range(200):
        v = log_w + x * at_log
        v = np.exp(v - v.max())
        v /= v.sum()
        mean = float((v * x).sum())
        left, right = (at_log, right) if mean < a else (left, at_log)
        spread = float((v * (x - mean) ** 2).sum())
        new = at_log + (a - mean) / spread if spread > 0 else left
        if not left < new < right:
            new = (left + right) / 2
        if abs(new - at_log) < 1e-13 * max(1.0, abs(new)):
            break
        at_log = new
    return p, math.exp(min(at_log, 700.0))


def fisher_exact(a: Column | str, b: Column | str, c: Column | str, d: Column | str, alternative: str = "two.sided") -> Column:
    """Struct (p, odds_ratio) of a 2x2 table given by columns: [[a, c], [b, d]]; the ratio is the conditional estimate.

    The sums run over the whole support in log space, so tiny p-values keep their precision.
    """
    if alternative not in ("two.sided", "greater", "less"):
        raise ValueError(f"unknown alternative {alternative}")

    @pandas_udf("p double, odds_ratio double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        out = [(None, None) if pd.isna([w, x, y, z]).any() else _fisher(int(w), int(x), int(y), int(z), alternative) for w, x, y, z in zip(a, b, c, d)]
        return pd.DataFrame(out, columns=["p", "odds_ratio"])

    return run(a, b, c, d)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, eps: float = 3e-14, most: int = 10_000) -> np.ndarray:
    """The incomplete beta function's continued fraction by Lentz's method, for all elements at once."""
    tiny = 1e-300
    kept = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1.0 / kept(1.0 - (a + b) * x / (a + 1))
    h, on = d.copy(), np.arange(len(x))
    for m in range(1, most + 1):
        if not len(on):
            return h
        p, q, z = a[on], b[on], x[on]
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d[on] = 1.0 / kept(1.0 + num * d[on])
            c[on] = kept(1.0 + num / c[on])
            step = d[on] * c[on]
            h[on] *= step
        on = on[np.abs(step - 1.0) >= eps]
    if len(on):
        raise ArithmeticError("continued fraction doesn't converge")
    return h


def beta_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.exp(log_gamma(a) + log_gamma(b) - log_gamma(a + b))


def incomplete_beta_values(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    if ((x < 0) | (x > 1)).any():
        raise ValueError("x outside [0, 1]")
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    turn = inner >= (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - inner, inner)
    part = front * _beta_fraction(p, q, z) / p
    return np.where((x == 0) | (x == 1), x, np.where(turn, 1 - part, part))


def beta_pdf_values(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x ** (a - 1) * (1 - x) ** (b - 1) / beta_values(a, b)


def _mapped(f, *cols: Column | str) -> Column:
    """``f`` over whole batches of numbers; a row with a null gives null."""

    def run(columns: list[pd.Series]) -> pd.Series:
        have = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
        out = np.full(len(have), np.nan)
        if have.any():
            out[have] = f(*(c[have].to_numpy(float) for c in columns))
        return pd.Series(pd.arrays.FloatingArray(out, ~have))

    @pandas_udf("double")
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run([a, b])

    @pandas_udf("double")
    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run([a, b, c])

    return (two if len(cols) == 2 else three)(*cols)


def beta(a: Column | str, b: Column | str) -> Column:
    return _mapped(beta_values, a, b)


def reg_incomplete_beta(a: Column | str, b: Column | str, x: Column | str) -> Column:
    return _mapped(incomplete_beta_values, a, b, x)


def beta_pdf(x: Column | str, a: Column | str, b: Column | str) -> Column:
    return _mapped(beta_pdf_values, x, a, b)


def beta_cdf(x: Column | str, a: Column | str, b: Column | str) -> Column:
    return _mapped(lambda x, a, b: incomplete_beta_values(a, b, x), x, a, b)


def running_mean(df: DataFrame, value: str, order: str, by: list[str], into: str = "mean", width: int | None = None) -> DataFrame:
    """Mean of all values so far, per group.

    With ``width`` (for a whole-number ``order``) a group is ordered in slices of that width, and what the slices before
    have comes from one row per slice; without it a group is one task's work. Nulls count for nothing; rows of equal
    order in one slice are taken one after the other.
    """
    if width is None:
        return df.withColumn(into, F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = [*by, "_slice"]
    rows = df.withColumn("_slice", F.floor(F.col(order) / width))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*at).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(at)], F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_bs"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_bn"))
    same = F.lit(True)
    for i, c in enumerate(at):
        same &= rows[c].eqNullSafe(sums[f"_k{i}"])
    upto = Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(sums, same).withColumns({"_cs": F.coalesce(F.sum(value).over(upto), F.lit(0)) + F.col("_bs"), "_cn": F.count(value).over(upto) + F.col("_bn")})
    return out.select(*df.columns, F.try_divide(F.col("_cs"), F.col("_cn")).alias(into))


def weighted_choice(df: DataFrame, candidate: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """draw (from 0), ``candidate``: ``n`` independent draws in proportion to the weights. Weights of 0 are never drawn.

    Candidates stand one after the other on a line, each as long as its weight; the line has as many bins as there are
    candidates, and a draw meets those of its bin, one or two on average. A candidate ends exactly where the next begins.
    """
    rows = df.where(F.col(weight) > 0).select(candidate, weight).withColumn("_slot", F.pmod(F.xxhash64(candidate), F.lit(256)))
    # 256 sums; within a slot a running sum
    parts = rows.groupBy("_slot").agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    by_slot = Window.orderBy("_slot")
    parts = parts.select(F.col("_slot").alias("_s"), F.coalesce(F.sum("_w").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_from"), F.sum("_w").over(by_slot.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"), F.sum("_n").over(by_slot.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_bins"))
    parts = parts.withColumn("_to", F.lead("_from").over(Window.orderBy("_s")))
    in_slot = Window.partitionBy("_slot").orderBy(candidate)
    line = rows.join(F.broadcast(parts), F.col("_slot") == F.col("_s"))
    line = line.withColumn("_lo", F.col("_from") + F.coalesce(F.sum(weight).over(in_slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    line = line.withColumn("_hi", F.coalesce(F.lead("_lo").over(in_slot), F.col("_to")))
    bin_of = lambda x: F.least(F.floor(x / F.col("_all") * F.col("_bins")), F.col("_bins") - 1).cast("long")
    line = line.select(candidate, "_lo", "_hi", F.explode(F.sequence(bin_of(F.col("_lo")), F.coalesce(F.greatest(bin_of(F.col("_hi")), bin_of(F.col("_lo"))), F.col("_bins") - 1))).alias("_b1"))
    whole = parts.select("_all", "_bins").limit(1)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.rand(seed).alias("_u")).join(F.broadcast(whole)).select("draw", (F.col("_u") * F.col("_all")).alias("_x"), "_all", "_bins")
    draws = draws.select("draw", "_x", bin_of(F.col("_x")).alias("_b2"))
    return draws.join(line, (F.col("_b1") == F.col("_b2")) & (F.col("_x") >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col("_x") < F.col("_hi")))).select("draw", candidate)


def random_probabilities(df_session, n: int, seed: int = 0) -> DataFrame:
    """i (0 to n), p: n + 1 probabilities that sum to 1, the spacings of n sorted uniform draws. ``n`` is a small number."""
    points = df_session.range(n).select(F.rand(seed).alias("x"))
    ends = points.unionByName(df_session.createDataFrame([(0.0,), (1.0,)], "x double"))
    w = Window.orderBy("x")
    return ends.select((F.row_number().over(w) - 2).alias("i"), (F.col("x") - F.lag("x").over(w)).alias("p")).where("p is not null")
