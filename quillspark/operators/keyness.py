"""Keyness: tokens that one side uses more than the other, by smoothed log odds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import two_sided
from ..schema import ALPHA, BASELINE, MIN_TOTAL, PRIOR, TOP
from .stats import bh_adjust


def token_counts(df: DataFrame, keys: Sequence[str] = ("question",), side: str = "dataset", tokens: str = "tokens", baseline: str = BASELINE) -> DataFrame:
    """keys, token, count_a (baseline) and count_b (all others)."""
    t = df.select(*keys, (F.col(side) == baseline).alias("_base"), F.explode(tokens).alias("token"))
    return t.groupBy(*keys, "token").agg(F.sum(F.col("_base").cast("long")).alias("count_a"), F.sum((~F.col("_base")).cast("long")).alias("count_b"))


def log_odds(counts: DataFrame, keys: Sequence[str] = ("question",), prior: float = PRIOR, min_total: int = MIN_TOTAL) -> DataFrame:
    """token, counts, log_odds, z, p and p_adj; positive: more with the others than the baseline.

    Vocabulary and totals are those of all tokens; those with fewer than ``min_total`` uses are
    left out afterwards, and the adjustment is over what is kept. An empty table stays empty.
    """
    totals = counts.groupBy(*keys).agg(F.sum("count_a").cast("double").alias("na"), F.sum("count_b").cast("double").alias("nb"), F.count(F.lit(1)).cast("double").alias("v"))
    kept = counts.where(F.col("count_a") + F.col("count_b") >= min_total).join(totals, list(keys))
    a = F.lit(prior)

    def logit(c: str, n: str):
        p = (F.col(c) + a) / (F.col(n) + a * F.col("v"))
        return F.ln(p / (F.lit(1.0) - p))

    kept = kept.withColumn("log_odds", logit("count_b", "nb") - logit("count_a", "na"))
    kept = kept.withColumn("z", F.col("log_odds") / F.sqrt(F.lit(1.0) / (F.col("count_b") + a) + F.lit(1.0) / (F.col("count_a") + a)))
    kept = kept.withColumn("p", two_sided(F.col("z"))).drop("na", "nb", "v")
    return bh_adjust(kept, keys, ties=("token",))


def top_terms(kdf: DataFrame, keys: Sequence[str] = ("question",), k: int = TOP, alpha: float = ALPHA) -> DataFrame:
    """keys, human and system: each side's k strongest significant tokens, ``;``-joined, strongest
    first; ties go by token."""
    sig = kdf.where((F.col("p_adj") < alpha) & (F.col("z") != 0)).withColumn("side", F.when(F.col("z") > 0, "system").otherwise("human"))
    w = Window.partitionBy(*keys, "side").orderBy(F.abs("z").desc(), "token")
    top = sig.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    joined = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("r", "token")))), lambda s: s["token"]), ";")
    found = top.groupBy(*keys).agg(joined("human").alias("human"), joined("system").alias("system"))
    return kdf.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.coalesce("human", F.lit("")).alias("human"), F.coalesce("system", F.lit("")).alias("system"))
