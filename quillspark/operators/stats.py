"""Statistical tests as window queries: Benjamini-Hochberg, Mann-Whitney, chi-square."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.numeric import chi2_tail1, chi2_tail2, chi2_tail3, erfc, finite
from ..schema import BASELINE


def bh_adjust(df: DataFrame, family: Sequence[str] = (), p: str = "p", out: str = "p_adj", ties: Sequence[str] = (), few: bool = False) -> DataFrame:
    """Benjamini-Hochberg: the least of p * n / rank over the ranks from here on, at most 1.

    Null and NaN p count as 1. ``family`` columns say which tests belong together.

    Equal p have one result, that of the last of their ranks, so ranks are worked out over the counts
    of distinct p, in stretches of p (see ``_stretch``), and looked up by p; ``ties`` don't matter
    then. So no task sorts a family, but ``df`` is read twice. Where families are known to be a few
    tests that are costly to work out, ``few`` ranks the rows themselves.
    """
    value = F.coalesce(finite(F.col(p)), F.lit(1.0))
    if few:
        order = Window.partitionBy(*family).orderBy(value, *ties)
        ranked = df.withColumn("_p", value).withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*family)))
        # from the greatest p down, so the running minimum is one pass
        tail = Window.partitionBy(*family).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return ranked.withColumn(out, F.least(F.min(F.col("_p") * F.col("_n") / F.col("_r")).over(tail), F.lit(1.0))).drop("_p", "_r", "_n")
    names = [f"_f{i}" for i in range(len(family))]
    counts = df.select(*[F.col(c).alias(f) for c, f in zip(family, names)], (value + F.lit(0.0)).alias("_p")).groupBy(*names, "_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_s", _stretch(F.col("_p")))
    whole = Window.partitionBy(*names)
    alike = lambda x, y: [F.col(f"{x}.{f}").eqNullSafe(F.col(f"{y}.{f}")) for f in names]
    # the stretches of a family are a few thousand rows at most
    stretches = counts.groupBy(*names, "_s").agg(F.sum("_c").alias("_t"))
    stretches = stretches.withColumn("_before", F.sum("_t").over(whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_t")).withColumn("_n", F.sum("_t").over(whole)).drop("_t")
    inside = Window.partitionBy(*names, "_s")
    ranked = counts.alias("c").join(stretches.alias("s"), [*alike("c", "s"), F.col("c._s") == F.col("s._s")]).select("c.*", "_before", "_n")
    ranked = ranked.withColumn("_r", F.col("_before") + F.sum("_c").over(inside.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_v", F.col("_p") * F.col("_n") / F.col("_r"))
    after = ranked.groupBy(*names, "_s").agg(F.min("_v").alias("_m"))
    after = after.withColumn("_m", F.min("_m").over(whole.orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)))
    least = ranked.alias("c").join(after.alias("s"), [*alike("c", "s"), F.col("c._s") == F.col("s._s")]).select("c.*", "_m")
    least = least.withColumn("_v", F.least(F.min("_v").over(inside.orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_m", F.lit(1.0))).select(*names, F.col("_p").alias("_q"), F.col("_v").alias(out))
    rows = df.drop(out).withColumn("_p", value + F.lit(0.0))
    return rows.join(least, [*[F.col(c).eqNullSafe(F.col(f)) for c, f in zip(family, names)], F.col("_p") == F.col("_q")]).drop("_p", "_q", *names)


def _stretch(p: Column) -> Column:
    """A whole number that grows with p: 4096 even stretches above 1/4096, one for each halving below."""
    return F.when(p >= 1 / 4096, F.least(F.floor(p * 4096), F.lit(4096))).when(p > 0, F.greatest(F.floor(F.log2(p)), F.lit(-1100))).otherwise(F.lit(-1101)).cast("int")


def rank_sums(df: DataFrame, keys: Sequence[str], side: str, value: str, group: str = "dataset", baseline: str = BASELINE) -> DataFrame:
    """For each of ``keys`` and each group but the baseline: the sizes, the means, the rank sum of the
    baseline among both, and the tie term; ``side`` names the column that tells groups apart.

    Values are counted first, in one pass over the rows, so ranks are running sums over distinct
    values and the rows that are sorted are as many as there are distinct values. The baseline's
    counts are then copied to each group of their key. Groups without a finite value have n2 = 0.
    """
    x = finite(F.col(value))
    counts = df.groupBy(*keys, F.col(side).alias(group), x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    is_base = F.col(group) == baseline
    others = F.collect_set(F.when(F.col(group) != baseline, F.col(group))).over(Window.partitionBy(*keys))
    spread = counts.withColumn("others", others).withColumn("n", F.when(F.col("x").isNotNull(), F.col("n")).otherwise(F.lit(0)))
    zero = F.lit(0).cast("long")
    spread = spread.select(*keys, F.explode(F.when(is_base, F.col("others")).otherwise(F.array(group))).alias(group), "x", F.when(is_base, F.col("n")).otherwise(zero).alias("a"), F.when(is_base, zero).otherwise(F.col("n")).alias("b"))
    both = spread.where(F.col(group).isNotNull()).groupBy(*keys, group, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    before = Window.partitionBy(*keys, group).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    t = (F.col("a") + F.col("b")).cast("double")
    ranked = both.withColumn("rank", F.coalesce(F.sum(F.col("a") + F.col("b")).over(before), F.lit(0)).cast("double") + (t + F.lit(1.0)) / F.lit(2.0))
    mean = lambda n: F.try_divide(F.sum(F.col("x").cast("double") * F.col(n)), F.sum(n).cast("double"))
    return ranked.groupBy(*keys, group).agg(
        F.sum("a").cast("double").alias("n1"), F.sum("b").cast("double").alias("n2"), F.sum(F.col("rank") * F.col("a")).alias("r1"), F.sum(t * t * t - t).alias("ties"), F.max(t).alias("most"), mean("a").alias("base_mean"), mean("b").alias("mean")
    )


def u_counts(a: int, b: int) -> np.ndarray:
    """How many of the orders of a and b values without ties have each U from 0 to a * b: the
    coefficients of the Gaussian binomial, by its product formula, in whole numbers of any size."""
    counts = np.zeros(a * b + 1, object)
    counts[0] = 1
    for i in range(1, a + 1):
        if b + i <= a * b:
            counts[b + i :] = counts[b + i :] - counts[: a * b + 1 - b - i]
        for r in range(min(i, a * b + 1)):
            counts[r::i] = np.cumsum(counts[r::i])
    return counts


@F.pandas_udf(DoubleType())
def _exact_mwu(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    """Two-sided p of U from its exact distribution without ties."""

    def one(a: float, b: float, x: float) -> float:
        a, b = sorted((int(a), int(b)))
        return min(1.0, 2 * int(u_counts(a, b)[math.ceil(x) :].sum()) / math.comb(a + b, a))

    return pd.Series([one(a, b, x) for a, b, x in zip(n1, n2, u)])


def mann_whitney(df: DataFrame, keys: Sequence[str] = ("question",), side: str = "dataset", value: str = "value", baseline: str = BASELINE, least: int = 3, exact: bool = True, means: bool = False) -> DataFrame:
    """keys, dataset, n1, n2, u, z and two-sided p of every group against the baseline; with
    ``means`` also base_mean and mean, and rows of groups without a finite value.

    Normal approximation with tie and continuity correction; with ``exact``, the exact
    distribution where a side has at most 8 values and there are no ties. p is null where a side
    has fewer than ``least`` finite values, and 1 where all values are equal.
    """
    s = rank_sums(df, keys, side, value, baseline=baseline)
    if not means:
        s = s.where("n2 > 0")
    n = F.col("n1") + F.col("n2")
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + F.lit(1.0)) / F.lit(2.0)
    product = F.col("n1") * F.col("n2")
    variance = product / F.lit(12.0) * ((n + F.lit(1.0)) - F.try_divide(F.col("ties"), n * (n - F.lit(1.0))))
    z = F.try_divide(F.greatest(u1, product - u1) - product / F.lit(2.0) - F.lit(0.5), F.sqrt(F.greatest(variance, F.lit(0.0))))
    enough = (F.col("n1") >= least) & (F.col("n2") >= least)
    s = s.withColumn("u", u1).withColumn("z", F.when(enough, z))
    p = F.when(enough, F.when(F.col("z").isNull(), F.lit(1.0)).otherwise(F.least(erfc(F.greatest(F.col("z"), F.lit(0.0)) / F.lit(math.sqrt(2.0))), F.lit(1.0))))
    p = F.when(F.col("z") < 0, F.when(enough, F.lit(1.0))).otherwise(p)
    out = s.withColumn("p", p)
    if exact:
        small = enough & (F.least("n1", "n2") <= 8) & (F.col("most") == 1)
        top = F.greatest(F.col("u"), product - F.col("u"))
        dummy = F.when(small, F.col("n1")).otherwise(F.lit(1.0))
        out = out.withColumn("p", F.when(small, _exact_mwu(dummy, F.when(small, F.col("n2")).otherwise(F.lit(1.0)), F.when(small, top).otherwise(F.lit(0.0)))).otherwise(F.col("p")))
    return out.select(*keys, F.col("dataset"), F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "u", "z", "p", *(("base_mean", "mean") if means else ()))


def chi_square(counts: DataFrame, keys: Sequence[str] = ("question",), side: str = "dataset", category: str = "option", n: str = "n", baseline: str = BASELINE) -> DataFrame:
    """keys, dataset, statistic, dof and p of every group's counts against the baseline's.

    ``counts`` has a row for each category, zeros included. Categories that are zero on both sides
    are dropped; p is null where a side has no answers. Up to 4 categories (3 degrees of freedom).
    """
    base = counts.where(F.col(side) == baseline).select(*keys, category, F.col(n).cast("double").alias("a"))
    both = counts.where(F.col(side) != baseline).select(*keys, side, category, F.col(n).cast("double").alias("b")).join(base, [*keys, category])
    w = Window.partitionBy(*keys, side)
    both = both.withColumn("na", F.sum("a").over(w)).withColumn("nb", F.sum("b").over(w)).withColumn("t", F.col("a") + F.col("b"))
    ea, eb = (F.col("t") * F.col(x) / (F.col("na") + F.col("nb")) for x in ("na", "nb"))
    part = F.when((F.col("t") > 0) & (F.col("na") > 0) & (F.col("nb") > 0), (F.col("a") - ea) * (F.col("a") - ea) / ea + (F.col("b") - eb) * (F.col("b") - eb) / eb)
    out = both.groupBy(*keys, side).agg(F.sum(part).alias("statistic"), (F.sum((F.col("t") > 0).cast("long")) - 1).alias("dof"))
    x = F.col("statistic")
    p = F.when(F.col("dof") == 3, chi2_tail3(x)).when(F.col("dof") == 2, chi2_tail2(x)).when(F.col("dof") == 1, chi2_tail1(x)).when(F.col("dof") == 0, F.lit(1.0))
    return out.withColumn("p", F.when(x.isNotNull(), p))


def mean_shift(df: DataFrame, keys: Sequence[str] = ("question",), side: str = "dataset", value: str = "value", baseline: str = BASELINE) -> DataFrame:
    """keys, dataset, mean, base_mean and shift: each group's mean of finite values less the
    baseline's."""
    means = df.groupBy(*keys, side).agg(F.avg(finite(F.col(value))).alias("mean"))
    base = F.max(F.when(F.col(side) == baseline, F.col("mean"))).over(Window.partitionBy(*keys))
    return means.withColumn("base_mean", base).where(F.col(side) != baseline).withColumn("shift", F.col("mean") - F.col("base_mean"))
