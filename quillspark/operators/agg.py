"""Descriptive aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite


def coverage(df: DataFrame, valid: Column, keys: Sequence[str] = ("dataset", "question")) -> DataFrame:
    """n_total, n_kept and keep_rate of the rows ``valid`` holds for."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.sum(valid.cast("long")).alias("n_kept"), F.avg(valid.cast("double")).alias("keep_rate"))


def proportions(df: DataFrame, domain: Sequence[int] = (1, 2, 3, 4), keys: Sequence[str] = ("question", "dataset"), value: str = "score") -> DataFrame:
    """n and prop of each option of the domain, zero where it wasn't chosen; other values don't
    count. Groups whose answers are all outside the domain have zeros."""
    options = F.explode(F.array(*[F.lit(d) for d in domain]))
    sums = [F.sum((F.col(value) == d).cast("long")).alias(f"n_{d}") for d in domain]
    wide = df.groupBy(*keys).agg(*sums)
    n = F.coalesce(F.element_at(F.array(*[F.col(f"n_{d}") for d in domain]), F.array_position(F.array(*[F.lit(d) for d in domain]), F.col("option")).cast("int")), F.lit(0))
    total = sum((F.coalesce(F.col(f"n_{d}"), F.lit(0)) for d in domain), F.lit(0))
    return wide.withColumn("option", options).select(*keys, "option", n.alias("n"), F.coalesce(F.try_divide(n, total), F.lit(0.0)).alias("prop"))


def distinct_share(df: DataFrame, keys: Sequence[str] = ("question", "dataset"), value: str = "key") -> DataFrame:
    """total_n, unique_n and unique_pct of non-null keys; a group without any has a null share."""
    out = df.groupBy(*keys, value).agg(F.count(value).alias("n")).groupBy(*keys)
    out = out.agg(F.sum("n").alias("total_n"), F.count(value).alias("unique_n"))
    return out.withColumn("unique_pct", F.try_divide(F.lit(100.0) * F.col("unique_n"), F.col("total_n").cast("double")))


def normalized_entropy(df: DataFrame, keys: Sequence[str] = ("question", "dataset"), value: str = "key", weight: str | None = None) -> DataFrame:
    """-sum p ln(p + 1e-12) / ln(K + 1e-12) of non-null keys: null below two, 0 with one distinct."""
    one = F.col(weight) if weight else F.lit(1)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(one).cast("double").alias("c"))
    p = F.col("c") / F.col("n")
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("n", F.sum("c").over(w))
    sums = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(-p * F.ln(p + F.lit(1e-12))).alias("h"))
    value_of = F.when(F.col("n") < 2, F.lit(None).cast("double")).when(F.col("k") == 1, F.lit(0.0)).otherwise(F.col("h") / F.ln(F.col("k") + F.lit(1e-12)))
    return sums.select(*keys, F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), value_of.alias("entropy"))


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the non-null values of a row, null without any."""
    present = F.filter(F.array(*[c.cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def noise_band(df: DataFrame, keys: Sequence[str] = ("question",), value: str = "value") -> DataFrame:
    """What a plot of a noise floor needs: n, least, mean, most, population deviation, quartiles,
    95th percentile, and that of the absolute values."""
    x = finite(F.col(value))
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.avg(x).alias("mean"), F.max(x).alias("high"), F.stddev_pop(x).alias("sd"), q.alias("_q"), F.percentile(F.abs(x), F.lit(0.95)).alias("abs_q95"))
    names = ("q25", "median", "q75", "q95")
    return out.select(*keys, "n", "low", "mean", "high", "sd", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)], "abs_q95")


def box_summary(df: DataFrame, keys: Sequence[str] = ("question", "dataset"), value: str = "value") -> DataFrame:
    """Quartiles and whiskers: the outermost values within 1.5 interquartile ranges."""
    # missing values are left out after the count: a filter before it would work out the value again
    counts = df.groupBy(*keys, finite(F.col(value)).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    # one pass over the rows; what follows works on counts of distinct values. Quartiles are looked up by
    # rank, as a percentile over a window would be worked out again for every row
    group = Window.partitionBy(*keys)
    counts = counts.withColumn("_n", F.when(F.col("_x").isNotNull(), F.col("_n")).otherwise(F.lit(0)))
    counts = counts.withColumn("_c", F.sum("_n").over(group.orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_t", F.sum("_n").over(group))
    ranks = {p: F.lit(p) * (F.col("_t") - 1) for p in (0.25, 0.5, 0.75)}
    ranked = lambda r: F.min(F.when(F.col("_c") > r, F.col("_x"))).over(group)
    low = {p: ranked(F.floor(r)) for p, r in ranks.items()}
    between = [low[p] + (r - F.floor(r)) * (F.coalesce(ranked(F.floor(r) + 1), low[p]) - low[p]) for p, r in ranks.items()]
    counts = counts.withColumn("_q", F.array(*between))
    reach = F.lit(1.5) * (F.col("_q")[2] - F.col("_q")[0])
    inside = F.when((F.col("_x") >= F.col("_q")[0] - reach) & (F.col("_x") <= F.col("_q")[2] + reach), F.col("_x"))
    out = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.first("_q").alias("_q"), F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))
    return out.where("n > 0").select(*keys, "n", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"), "whisker_low", "whisker_high")


def run_summary(df: DataFrame, attempts: str = "attempts", ok: str = "ok") -> DataFrame:
    """respondents, attempts, failures and success_pct of a simulation run."""
    n = F.count(F.lit(1))
    good = F.sum(F.col(ok).cast("long"))
    return df.agg(n.alias("respondents"), F.sum(attempts).alias("attempts"), (n - good).alias("failures"), (F.lit(100.0) * good / n).alias("success_pct"))
