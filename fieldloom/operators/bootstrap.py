"""Circular moving-block bootstrap as joins over a compact table of block starts.

A replicate is ceil(n / block) starts, not n day numbers. How often each day occurs in a replicate is one small
aggregate, and any additive series then takes one join and one sum a replicate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

M = 2147483647
SEED = 20260715
BLOCK = 60


def _draw(rep: Column, blk: Column, seed: int) -> Column:
    """A number in 1 ... M - 1 from integer arithmetic that any engine repeats; quadratic, so that blocks don't move in step."""
    m = F.lit(M).cast("long")
    y = ((rep * 19 + blk + seed) * 48271) % m
    x = ((y * y % m) * 16807) % m + 1
    return x * x % m


def block_starts(sizes: DataFrame, reps: int, block: Column | int = BLOCK, seed: int = SEED) -> DataFrame:
    """(..., n, rep, blk, len, start) for every row of sizes(..., n): ceil(n / len) starts in 0 ... n - 1 a replicate."""
    length = F.least(block if isinstance(block, Column) else F.lit(block), F.col("n")).cast("long")
    out = sizes.withColumn("len", length).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    out = out.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("len")) - 1)))
    return out.withColumn("start", _draw(F.col("rep"), F.col("blk"), seed) % F.col("n"))


def generator_starts(spark: SparkSession, sizes: dict[str, int], reps: int, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The starts of one NumPy generator drawn climate after climate, as a table of ceil(n / block) numbers a replicate."""
    rng, parts = np.random.default_rng(seed), []
    for climate, n in sizes.items():
        blocks = -(-n // block)
        drawn = rng.integers(0, n, size=(reps, blocks), dtype=np.int64)
        count = reps * blocks
        columns = [pa.array([climate] * count), *(pa.array(np.full(count, v, np.int64)) for v in (n, block))]
        columns += [pa.array(v) for v in (np.repeat(np.arange(reps), blocks), np.tile(np.arange(blocks), reps), drawn.ravel())]
        parts.append(pa.table(columns, ["climate", "n", "len", "rep", "blk", "start"]))
    return spark.createDataFrame(pa.concat_tables(parts)) if parts else spark.createDataFrame([], "climate string, n long, len long, rep long, blk long, start long")


def day_counts(starts: DataFrame, by: list[str]) -> DataFrame:
    """(..., rep, day_idx, times): how often each day is in each replicate, cut to n days."""
    days = starts.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)))
    days = days.where(F.col("blk") * F.col("len") + F.col("o") < F.col("n")).withColumn("day_idx", F.pmod(F.col("start") + F.col("o"), F.col("n")))
    return days.groupBy(*by, "rep", "day_idx").agg(F.count("*").alias("times"))


def resampled_sums(daily: DataFrame, counts: DataFrame, by: list[str], sums: list[str], extra: list[str] | None = None) -> DataFrame:
    """Sums of additive series a replicate."""
    rows = counts.join(daily, [*by, "day_idx"])
    return rows.groupBy(*by, *(extra or []), "rep").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in sums])


def block_sums(daily: DataFrame, starts: DataFrame, by: list[str], sums: list[str], extra: list[str] | None = None) -> DataFrame:
    """resampled_sums from the starts alone: a block's sum is the difference of two prefix sums of the series, put twice
    end to end so that blocks may wrap. A replicate costs two lookups a block and not one a day."""
    twice = daily.join(daily.groupBy(*by).agg(F.count("*").alias("_n")), by)
    twice = twice.withColumn("k", F.explode(F.array(F.col("day_idx"), F.col("day_idx") + F.col("_n")))).select(*by, "k", *sums)
    before = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    prefix = twice.select(*by, "k", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in sums])  # one table for both ends
    # the starts are the larger side, though Spark takes exploded rows for no more than their origins and would broadcast them
    at = lambda end: prefix.select(*by, F.col("k").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in sums]).hint("shuffle_hash")
    stop = F.col("start") + F.least(F.col("len"), F.col("n") - F.col("blk") * F.col("len"))
    rows = starts.withColumn("stop", stop).join(at("start"), [*by, "start"]).join(at("stop"), [*by, "stop"])
    return rows.groupBy(*by, *(extra or []), "rep").agg(*[F.sum(F.col(f"{c}_stop") - F.col(f"{c}_start")).alias(c) for c in sums])


def drawn_starts(n: int, first: int, last: int, block: int = BLOCK, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of block_starts() for replicates first to last (exclusive), a row each, by the same arithmetic."""
    length = min(block, n)
    rep, blk = np.arange(first, last, dtype=np.int64)[:, None], np.arange(-(-n // length), dtype=np.int64)
    y = (rep * 19 + blk + seed) * 48271 % M
    x = y * y % M * 16807 % M + 1
    return x * x % M % n, np.minimum(length, n - blk * length)


#: Bytes of one group's days by a range of a vector's entries, and replicates that are summed together.
PANEL_BYTES, TOGETHER = 1 << 23, 256


def vector_replicates(daily: DataFrame, by: str, x: str, reps: int, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(by, rep, b, m): for each replicate the squared length of its mean vector and its mean squared length, of
    daily(by, day_idx, x) with days 0 ... n - 1 of each group.

    A task has all days of one group and one range of the vectors' entries, and their prefix sums; it draws the starts
    itself and sends two numbers a replicate. Neither day counts nor replicates' vectors are shuffled.
    """
    most, size = daily.groupBy(by).agg(F.count("*").alias("n"), F.max(F.size(x)).alias("s")).agg(F.max("n"), F.max("s")).first()
    width = max(1, PANEL_BYTES // (8 * (most or 1)))
    ranges = F.transform(F.sequence(F.lit(0), F.lit(max(0, (size or 1) - 1) // width)), lambda k: F.slice(x, k * width + 1, F.lit(width)))
    parts = daily.select(by, "day_idx", F.posexplode(ranges).alias("s", "v"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("day_idx").combine_chunks()
        n = len(table)
        if table.column("day_idx").to_pylist() != list(range(n)):
            raise ValueError("the days of a group aren't 0, 1, 2, ...")
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        sums = np.concatenate((np.zeros((1, v.shape[1])), np.cumsum(np.concatenate((v, v)), axis=0)))
        squares = np.einsum("ij,ij->i", v, v)
        of_squares = np.concatenate(([0.0], np.cumsum(np.concatenate((squares, squares)))))
        b, m = np.empty(reps), np.empty(reps)
        for first in range(0, reps, TOGETHER):
            start, length = drawn_starts(n, first, min(reps, first + TOGETHER), block, seed)
            some = slice(first, first + len(start))
            mean = sum(sums[start[:, k] + length[k]] - sums[start[:, k]] for k in range(start.shape[1])) / n
            b[some] = np.einsum("ij,ij->i", mean, mean)
            m[some] = (of_squares[start + length] - of_squares[start]).sum(axis=1) / n
        group = pa.array([table.column(by)[0].as_py()] * reps, table.schema.field(by).type)
        return pa.table([group, pa.array(np.arange(reps)), pa.array(b), pa.array(m)], [by, "rep", "b", "m"])

    kind = daily.schema[by].dataType.simpleString()
    found = parts.groupBy(by, "s").applyInArrow(run, f"{by} {kind}, rep long, b double, m double")
    return found.groupBy(by, "rep").agg(F.sum("b").alias("b"), F.sum("m").alias("m"))


def paired_metrics(sums: DataFrame) -> DataFrame:
    """rmse of baseline, a and b; their difference; skills of both forms. All from one set of days a replicate."""
    rms = {m: F.sqrt(F.col(f"{m}_e2") / F.col("w")) for m in ("base", "a", "b")}
    return sums.withColumns(
        {f"{m}_rmse": v for m, v in rms.items()}
        | {"delta_rmse": rms["a"] - rms["b"]}
        | {f"{m}_skill_mse": 1 - F.col(f"{m}_e2") / F.col("base_e2") for m in ("a", "b")}
        | {f"{m}_skill": 1 - rms[m] / rms["base"] for m in ("a", "b")}
        | {"b_vs_a_mse": 1 - F.col("b_e2") / F.col("a_e2"), "b_vs_a": 1 - rms["b"] / rms["a"]}
    )


def interval(x: str, low: float = 0.025, high: float = 0.975) -> list[Column]:
    """lo and hi of the percentile interval."""
    both = F.percentile(x, F.array(F.lit(low), F.lit(high)))  # one pass over the replicates for the two
    return [F.get(both, F.lit(k)).alias(f"{x}_{n}") for k, n in enumerate(("lo", "hi"))]


def comparison(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Interval, median, deviation, share above 0 and whether 0 is outside, over the finite replicates."""
    ok = F.when(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.col(x))
    s = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.percentile(ok, F.lit(0.025)).alias("lo"), F.percentile(ok, F.lit(0.975)).alias("hi"), F.percentile(ok, F.lit(0.5)).alias("median"), F.stddev_samp(ok).alias("sd"), F.avg((ok > 0).cast("double")).alias("p_above"), (F.count("*") - F.count(ok)).alias("n_bad")
    )
    return s.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def season_aligned_starts(days: DataFrame, reps: int, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Starts drawn among the days whose month is the month at the block's own position; days(climate, day_idx, month)."""
    n = days.groupBy("climate").agg(F.count("*").alias("n"))
    month = days.groupBy("climate", "month").agg(F.count("*").alias("held"))
    ranked = days.withColumn("place", F.row_number().over(Window.partitionBy("climate", "month").orderBy("day_idx")) - 1)
    blocks = block_starts(n, reps, block, seed).withColumn("at", F.pmod(F.col("blk") * F.lit(block), F.col("n")))
    own = days.select("climate", F.col("day_idx").alias("at"), "month")
    wanted = blocks.join(own, ["climate", "at"]).join(month, ["climate", "month"]).withColumn("place", _draw(F.col("rep"), F.col("blk"), seed) % F.col("held"))
    hit = ranked.select("climate", "month", "place", F.col("day_idx").alias("aligned"))
    return wanted.join(hit, ["climate", "month", "place"]).select("climate", "n", "len", "rep", "blk", F.col("aligned").alias("start"))
