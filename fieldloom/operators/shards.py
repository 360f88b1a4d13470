"""Contiguous shards and segments of an ordered axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shard_bounds(df: DataFrame, by: list[str], index: str, shards: int) -> DataFrame:
    """Adds shard: so many contiguous pieces of 0 ... n - 1 in each group, the first n % shards one longer.

    In closed form from the group's size (a small aggregate), so that no group is sorted in one task.
    """
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    out = df.join(n, by) if by else df.crossJoin(F.broadcast(n))
    base, rest = F.floor(F.col("_n") / shards), F.col("_n") % shards
    long = rest * (base + 1)
    i = F.col(index)
    shard = F.when(i < long, F.floor(i / (base + 1))).otherwise(rest + F.floor((i - long) / F.greatest(base, F.lit(1))))
    return out.withColumn("shard", shard).drop("_n")


def shard_bounds_rounded(sizes: DataFrame, shards: int) -> DataFrame:
    """lo and hi of shards of an axis of n by bounds i * n / shards, rounded half to even."""
    rows = sizes.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    at = lambda i: F.bround(i * F.col("n") / shards, 0).cast("long")
    return rows.withColumns({"lo": at(F.col("shard")), "hi": at(F.col("shard") + 1)})


def contiguous(segments: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Adds follows: whether a segment begins at the end of the one before (at 0 for the first)."""
    w = Window.partitionBy(*by).orderBy(lo)
    return segments.withColumn("follows", F.coalesce(F.lag(hi).over(w), F.lit(0)) == F.col(lo))
