"""Joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are no more hot keys than its inverse.
SHARE = 1 / 4096


def split_join(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, a table with one row a key whose column ``n`` says how
    many of the ``total`` rows have it.

    Rows of hot keys meet a broadcast of these, 4096 rows at most, where they are; the others are
    dealt out by key. Both tables are read twice, so they should be written ones.
    """
    least = max(1000, int(total * SHARE))
    hot, rest = keyed.where(F.col(n) > least), keyed.where(F.col(n) <= least)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)
