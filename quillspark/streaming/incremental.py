"""Counts of a stream of answers, and the proportions, shares and entropies that follow from them.

Every micro-batch adds its counts to a table of its own, named by the batch, so a batch that is
run again after a failure replaces what it wrote before and counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import agg

KEYS = ("question", "dataset", "key")


def count_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the counting of a stream with the columns question, dataset and key; ``once`` takes
    what there is and ends."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counted(spark: SparkSession, path: str) -> DataFrame:
    """question, dataset, key, n of all batches so far."""
    return spark.read.parquet(path).groupBy(*KEYS).agg(F.sum("n").alias("n"))


def entropy_so_far(spark: SparkSession, path: str) -> DataFrame:
    return agg.normalized_entropy(counted(spark, path), weight="n")


def unique_so_far(spark: SparkSession, path: str) -> DataFrame:
    out = counted(spark, path).where(F.col("key").isNotNull()).groupBy("question", "dataset").agg(F.sum("n").alias("total_n"), F.count(F.lit(1)).alias("unique_n"))
    return out.withColumn("unique_pct", F.lit(100.0) * F.col("unique_n") / F.col("total_n"))


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Answers by window, question and dataset of a stream with event times; what is later than
    ``late`` is dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), "question", "dataset").agg(F.count(F.lit(1)).alias("n"))
