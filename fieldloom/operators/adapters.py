"""Fields, grids, series and matrices from the star-schema and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalars import grid_weight, is_leap_day, row_latitude, season_name

#: The field grid: 16 latitude rows of 24 columns, and the dense grid of the embeddings: 4 rows of 16.
ROWS, COLUMNS, CELLS = 16, 24, 384
DENSE_ROWS, DENSE_COLUMNS = 4, 16
CLIMATES = ("pd", "mh", "ssp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession) -> DataFrame:
    """cell, row, col, lat, lsm, oro_m and the mean-one cosine weight w of each cell."""
    c = F.col("cell")
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    cells = cells.withColumn("row", F.floor(c / COLUMNS).cast("int")).withColumn("col", (c % COLUMNS).cast("int"))
    return cells.select(
        "cell",
        "row",
        "col",
        row_latitude("row", ROWS).alias("lat"),
        ((c * 7) % 11 / F.lit(10.0)).alias("lsm"),
        (((c * 37) % 50 + 1) * F.lit(50.0)).alias("oro_m"),
        grid_weight(row_latitude("row", ROWS), ROWS).alias("w"),
    )


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day and cell: target, base (the baseline), pred_a and pred_b. Days keep their climate and season."""
    e, d, x = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    cell = ((F.col("l_partkey") * 97) % CELLS).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"), cell.alias("cell"))
    out = rows.agg(F.avg(e).alias("target"), F.avg(e * (1 - 2 * d)).alias("base"), F.avg(e * (1 - d)).alias("pred_a"), F.avg(e * (1 - d) * (1 + x)).alias("pred_b"))
    year = F.year("day")
    climate = F.when(year < 1997, "pd").when(year < 1999, "mh").otherwise("ssp")
    return out.withColumns({"climate": climate, "season": season_name("day"), "leap_day": is_leap_day("day")})


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field joined with its grid cell (a broadcast of fixed size), with the errors of the three predictions."""
    t = F.col("target")
    joined = field(spark, sf_dir).join(F.broadcast(grid(spark)), "cell")
    return joined.withColumns({"err_base": F.col("base") - t, "err_a": F.col("pred_a") - t, "err_b": F.col("pred_b") - t})


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sums a day: w, base_e2, a_e2, b_e2, and day_idx, the day's place within its climate."""
    sums = {n: F.sum(F.col("w") * F.col(f"err_{p}") ** 2) for n, p in (("base_e2", "base"), ("a_e2", "a"), ("b_e2", "b"))}
    days = errors(spark, sf_dir).groupBy("climate", "season", "day", "leap_day").agg(F.sum("w").alias("w"), *[v.alias(k) for k, v in sums.items()])
    return days.withColumn("day_idx", F.row_number().over(Window.partitionBy("climate").orderBy("day")).cast("long") - 1)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as days of a complete grid: day_idx, row, vals (16 floats), population."""
    vec = table(spark, sf_dir, "embeddings")
    rows = vec.select(F.col("vec_id").alias("day_idx"), F.col("label").alias("population"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(DENSE_ROWS - 1))).alias("row"))
    return rows.select("day_idx", "population", "row", F.slice("embedding", F.col("row") * DENSE_COLUMNS + 1, F.lit(DENSE_COLUMNS)).alias("vals"))


def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense() as one row a cell: day_idx, population, p (0 to 63), row, col, val (double)."""
    vec = table(spark, sf_dir, "embeddings")
    cells = vec.select(F.col("vec_id").alias("day_idx"), F.col("label").alias("population"), F.posexplode("embedding").alias("p", "v"))
    return cells.select("day_idx", "population", "p", F.floor(F.col("p") / DENSE_COLUMNS).cast("int").alias("row"), (F.col("p") % DENSE_COLUMNS).alias("col"), F.col("v").cast("double").alias("val"))


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day_idx, population, split (val: every fifth), x and y (32 doubles each)."""
    vec = table(spark, sf_dir, "embeddings")
    half = lambda a: F.transform(F.slice("embedding", a, 32), lambda v: v.cast("double"))
    split = F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train")
    return vec.select(F.col("vec_id").alias("day_idx"), F.col("label").alias("population"), split.alias("split"), half(1).alias("x"), half(33).alias("y"))


# The same adapters for DuckDB, as common table expressions.
GRID_SQL = """grid AS (SELECT CAST(i AS INTEGER) AS cell, CAST(i // 24 AS INTEGER) AS row, CAST(i % 24 AS INTEGER) AS col, -90.0::DOUBLE + ((i // 24) + 0.5::DOUBLE) * 11.25::DOUBLE AS lat,
 ((i * 7) % 11) / 10.0::DOUBLE AS lsm, ((i * 37) % 50 + 1) * 50.0::DOUBLE AS oro_m,
 cos(radians(-90.0::DOUBLE + ((i // 24) + 0.5::DOUBLE) * 11.25::DOUBLE)) / (SELECT avg(cos(radians(-90.0::DOUBLE + (k + 0.5::DOUBLE) * 11.25::DOUBLE))) FROM range(16) r(k)) AS w FROM range(384) t(i))"""
FIELD_SQL = """field AS (SELECT *, CASE WHEN year(day) < 1997 THEN 'pd' WHEN year(day) < 1999 THEN 'mh' ELSE 'ssp' END AS climate,
 CASE WHEN month(day) IN (12, 1, 2) THEN 'DJF' WHEN month(day) IN (3, 4, 5) THEN 'MAM' WHEN month(day) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, month(day) = 2 AND day(day) = 29 AS leap_day
 FROM (SELECT CAST(l_shipdate AS DATE) AS day, CAST((l_partkey * 97) % 384 AS INTEGER) AS cell, avg(l_extendedprice) AS target, avg(l_extendedprice * (1 - 2 * l_discount)) AS base,
 avg(l_extendedprice * (1 - l_discount)) AS pred_a, avg(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS pred_b FROM lineitem GROUP BY 1, 2))"""
ERRORS_SQL = f"{GRID_SQL}, {FIELD_SQL}, errors AS (SELECT *, base - target AS err_base, pred_a - target AS err_a, pred_b - target AS err_b FROM field JOIN grid USING (cell))"
DAILY_SQL = f"""{ERRORS_SQL}, daily AS (SELECT *, row_number() OVER (PARTITION BY climate ORDER BY day) - 1 AS day_idx FROM (SELECT climate, season, day, leap_day, sum(w) AS w, sum(w * err_base * err_base) AS base_e2,
 sum(w * err_a * err_a) AS a_e2, sum(w * err_b * err_b) AS b_e2 FROM errors GROUP BY ALL))"""
DENSE_SQL = """cells AS (SELECT vec_id AS day_idx, label AS population, CAST(unnest(range(64)) AS INTEGER) AS p, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings),
dense AS (SELECT *, p // 16 AS row, p % 16 AS col FROM cells)"""
MATRIX_SQL = f"{DENSE_SQL}, x AS (SELECT day_idx, population, CASE WHEN day_idx % 5 = 0 THEN 'val' ELSE 'train' END AS split, p AS k, val FROM cells WHERE p < 32), y AS (SELECT day_idx, population, CASE WHEN day_idx % 5 = 0 THEN 'val' ELSE 'train' END AS split, p - 32 AS k, val FROM cells WHERE p >= 32)"


def q(expression: str, digits: int = 6) -> str:
    """The SQL twin of quantize()."""
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"
