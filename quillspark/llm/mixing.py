"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule, a piecewise-linear density over training time [0, 1].
The weight fixes how many words the mix takes from the source (its target); the schedule fixes
when. The schedule's integral is the source's cumulative demand; a document copy that starts
after ``c`` words of its source's supply is due when demand reaches ``c``, so its position is
the inverse of the integral at ``c / target``. Documents are range-sorted by position.

Supply order within a source is the order of the md5 of doc_id and text, so rows that repeat a doc_id
or have none are spread like others; rows equal in both may change places with no effect. The running sum is taken in two
levels, buckets of the digest and documents of a bucket, so that a source holding most of the
rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, dropped, written

WEIGHTS = (5, 2, 1)
CAP = 3
#: One density for each weight of WEIGHTS: values at equally spaced knots over [0, 1].
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
BUCKET_ROWS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], name: str) -> tuple[DataFrame, str]:
    """Adds, under each name, the sum of a column over all rows before in order; and the path of the
    table behind it. In two levels, so that no task sorts all rows: the rows are written in ranges,
    and a range begins with the sums of those before it, of which there are as many as shuffle partitions."""
    spread, path = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    starts = spread.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = starts.select("_range", *[before(n, earlier).alias(f"_{n}") for n in sums])
    out = spread.join(F.broadcast(starts), "_range")
    return out.select(*df.columns, *[(before(c, inside) + F.col(f"_{n}")).alias(n) for n, c in sums.items()]), path


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets of a table (source, source_size), one row a source.

    Sources in code point order, null last, take the weights in turn. The targets share the sum
    of all sizes by weight but none passes ``cap`` times its source; what is cut off is shared
    again, by weight, until none passes. With rates ``cap * size / weight`` in ascending order
    the level of that water-filling is the largest of (total - caps before) / weights from here.
    Empty table: no rows. Runs actions; there may be any number of sources.
    """
    kind = (F.col("idx") % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)
    capped = F.col("source_size") * F.lit(cap)
    named, names = running_sums(sizes, [F.col("source").asc_nulls_last()], {"idx": F.lit(1).cast("long")}, "mix-names")
    rates = named.withColumn("kind", kind).withColumn("weight", weight).withColumn("rate", capped.cast("double") / F.col("weight"))
    rated, _ = running_sums(rates, [F.col("rate"), F.col("idx")], {"before": capped, "weight_before": F.col("weight")}, "mix-rates")
    dropped(sizes.sparkSession, names)
    total, weighs = rated.agg(F.sum("source_size"), F.sum("weight")).first()
    from_here = F.lit(weighs).cast("double") - F.col("weight_before")
    (level,) = rated.agg(F.max((F.lit(total).cast("long") - F.col("before")).cast("double") / from_here)).first()
    return rated.select("source", "source_size", "kind", F.least(capped.cast("double"), F.lit(level).cast("double") * F.col("weight")).alias("target"))


def inverse_demand(share: Column, kind: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """Training time at which the schedule's integral (scaled to 1) reaches ``share``."""
    result = F.lit(None).cast("double")
    for k, density in enumerate(schedules):
        step = 1.0 / (len(density) - 1)
        area = sum((a + b) / 2 * step for a, b in zip(density, density[1:]))
        scaled = [w / area for w in density]
        done, expr = 0.0, None
        parts = []
        for j, (a, b) in enumerate(zip(scaled, scaled[1:])):
            part = (a + b) / 2 * step
            y = share - F.lit(done)
            slope = (b - a) / step
            root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * y, F.lit(0.0)))
            parts.append((done + part, F.lit(j * step) + F.lit(2.0) * y / (F.lit(a) + root)))
            done += part
        for limit, at in reversed(parts):
            expr = at if expr is None else F.when(share <= F.lit(limit), at).otherwise(expr)
        result = F.when(kind == k, F.least(F.greatest(expr, F.lit(0.0)), F.lit(1.0))).otherwise(result)
    return result


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, schedules: Sequence[Sequence[float]] = SCHEDULES, bucket_rows: int = BUCKET_ROWS, keep: Sequence[str] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken, position.

    ``copies`` whole copies are taken: the whole part of target / source_size of every document,
    and one more of the documents whose middle comes before the remainder in supply order, so a
    source's taken words miss its target by at most half its longest document. ``position`` is
    that of the first copy, null where none is taken.

    Nulls: a null text has size 0, a null source is a source of its own, a null doc_id is
    ordered as the empty string. Documents of size 0 take 0 words. Repeated rows each count.
    Columns in ``keep`` are carried along; further ones are ignored. Empty table: no rows. Runs
    actions: it writes the (doc_id, source, size) table to the shared folder.
    """
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))).alias("order_key"), *keep)
    whole, slim = slim, cut(slim.drop(*keep), "mix-sizes")
    buckets = max(1, math.ceil(slim.count() / bucket_rows))
    bucket = F.floor(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") * buckets / 2**32).cast("long")
    whole, slim = (whole if keep else slim).withColumn("bucket", bucket), slim.withColumn("bucket", bucket)
    per_bucket = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = lambda df: df.withColumn("source_key", F.coalesce("source", F.lit(""))).withColumn("source_null", F.col("source").isNull())
    starts = keys(per_bucket.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(along), F.lit(0))))
    starts = starts.drop("source", "bucket_size").join(keys(targets).drop("source"), ["source_key", "source_null"])
    within = Window.partitionBy("source_key", "source_null", "bucket").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keys(whole).join(starts, ["source_key", "source_null", "bucket"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        rows.withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("remainder", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("extra", ((F.col("start") + F.col("size") / 2.0) <= F.col("remainder")) & (F.col("whole") < cap))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("long")).otherwise(F.lit(0)).cast("long"))
        .withColumn("share", F.least(F.try_divide("start", "target"), F.lit(1.0)))
        .withColumn("position", F.when(F.col("copies") > 0, F.round(inverse_demand(F.col("share"), F.col("kind"), schedules), 9)))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "start", "kind", "position", *keep)
    )


def range_sorted(plan: DataFrame) -> DataFrame:
    """Documents in order of their first position; those not taken come last."""
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, **options) -> DataFrame:
    """One row for each copy taken, in order of position: doc_id, copy, position, size, source,
    target and text. Edge cases are as in :func:`mix_plan`.
    """
    plan = mix_plan(docs, schedules=schedules, keep=("text",), **options)
    along = F.least(F.try_divide(F.col("copy") * F.col("source_size") + F.col("start"), F.col("target")), F.lit(1.0))
    return (
        plan.where(F.col("copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("position", F.round(inverse_demand(along, F.col("kind"), schedules), 9))
        .select("doc_id", "copy", "position", "size", "source", "target", "text")
        .orderBy("position", "doc_id", "copy")
    )
