"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, join_summary


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b). A hot node is a minimum over partial minima and a join that Spark can split."""
    if large:
        both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        near = edges.select(F.inline(both))  # not a union: the join below can split only what one exchange brings
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = join_summary(near, least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), F.col("m")))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> Stage:
    """Stage of (a, b): each node but the least of its component, with that least node.

    edges(a, b) are undirected; loops and repeated edges are harmless, ends must not be null. Each round is
    written to the shared folder, and the one before is deleted.
    """
    # repeated edges go in the first round; to drop them here would tie the rows of a hot key to one task of a join below
    now = Stage(edges.select("a", "b").where("a <> b"), "components")
    state = _state(now.df)
    while state[0]:
        new = Stage(_star(_star(now.df, True), False), "components")
        now.drop()
        now, before, state = new, state, _state(new.df)
        if state == before:
            break
    return now
