"""Connected components by alternating large-star and small-star rounds, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, written


def _nearest(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the smallest of u and its neighbours as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) but the roots themselves; a root is
    the smallest node of its component.

    Null ends and loops are ignored; repeated edges and either direction are fine. Every round
    is written to the shared folder, so no round depends on what an executor holds.
    """
    spark = edges.sparkSession
    held, path = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(held)
    while seen[0]:
        after, new = written(_small_star(_large_star(held)), "edges")
        now = mark(after)
        dropped(spark, path)
        held, path = after, new
        if now == seen:
            break
        seen = now
    return held.select(F.col("u").alias("node"), F.col("v").alias("root"))
