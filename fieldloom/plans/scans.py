"""Scan queries: shards and manifests, segments, slices, lookups, top-k and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalars import quantize
from fieldloom.operators import adapters as A
from fieldloom.operators import masks, metrics
from fieldloom.operators.adapters import DAILY_SQL, DENSE_SQL, ERRORS_SQL, FIELD_SQL, GRID_SQL
from fieldloom.operators.shards import contiguous, shard_bounds, shard_bounds_rounded
from fieldloom.operators.staging import shared_folder
from fieldloom.sources.netcdf import write_netcdf
from fieldloom.sources.stores import read_stores, write_store

from .registry import ask, pick, query

#: Where the second segment of stored vectors begins.
BORDER = 256


@query(f"WITH {DAILY_SQL}, n AS (SELECT climate, count(*) AS n FROM daily GROUP BY climate) SELECT climate, shard, day_idx FROM (SELECT climate, day_idx, ntile(20) OVER (PARTITION BY climate ORDER BY day_idx) - 1 AS shard FROM daily)")
def even_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI11: 20 contiguous shards a climate, the first ones a day longer, in closed form."""
    d = A.daily(spark, sf_dir).select("climate", "day_idx")
    return shard_bounds(d, ["climate"], "day_idx", 20).select("climate", "shard", "day_idx")


@query(f"WITH {DAILY_SQL}, n AS (SELECT climate, count(*) AS n FROM daily GROUP BY climate) SELECT climate, CAST(i AS INTEGER) AS shard, CAST(round_even(i * n / 7.0, 0) AS BIGINT) AS lo, CAST(round_even((i + 1) * n / 7.0, 0) AS BIGINT) AS hi FROM n, range(7) t(i)")
def rounded_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI12: the other split rule, bounds rounded half to even."""
    n = A.daily(spark, sf_dir).groupBy("climate").agg(F.count("*").alias("n"))
    return shard_bounds_rounded(n, 7).select("climate", "shard", "lo", "hi")


@query(f"WITH {DAILY_SQL}, s AS (SELECT climate, shard, min(day_idx) AS lo, max(day_idx) + 1 AS hi FROM (SELECT climate, day_idx, ntile(20) OVER (PARTITION BY climate ORDER BY day_idx) - 1 AS shard FROM daily) GROUP BY ALL) SELECT climate, shard, lo, hi, coalesce(lag(hi) OVER (PARTITION BY climate ORDER BY lo), 0) = lo AS follows FROM s")
def manifest_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8, WI14: each segment begins where the one before ends."""
    s = shard_bounds(A.daily(spark, sf_dir).select("climate", "day_idx"), ["climate"], "day_idx", 20).groupBy("climate", "shard").agg(F.min("day_idx").alias("lo"), (F.max("day_idx") + 1).alias("hi"))
    return contiguous(s, ["climate"], "lo", "hi").select("climate", "shard", "lo", "hi", "follows")


@query(f"WITH {DAILY_SQL} SELECT climate, day, CASE climate WHEN 'pd' THEN 0 WHEN 'mh' THEN (SELECT count(*) FROM daily WHERE climate = 'pd') ELSE (SELECT count(*) FROM daily WHERE climate <> 'ssp') END + day_idx AS place FROM daily")
def segmented_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9: segments in order with a running offset."""
    d = A.daily(spark, sf_dir).withColumn("segment", F.when(F.col("climate") == "pd", 0).when(F.col("climate") == "mh", 1).otherwise(2))
    n = d.groupBy("segment").agg(F.count("*").alias("n"))
    offset = n.select("segment", (F.sum("n").over(Window.orderBy("segment")) - F.col("n")).alias("offset"))  # three rows
    return d.join(F.broadcast(offset), "segment").select("climate", "day", (F.col("offset") + F.col("day_idx")).alias("place"))


@query(ask("day_idx p | val:6", DENSE_SQL, "SELECT day_idx, p, val FROM cells WHERE day_idx BETWEEN 100 AND 109"))
def day_range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, SC10: days by index; the filter is pushed to the scan."""
    return pick(A.dense_cells(spark, sf_dir).where("day_idx between 100 and 109"), "day_idx p | val:6")


@query(ask("day_idx p | val:6", DENSE_SQL, "SELECT day_idx, p, val FROM cells WHERE day_idx BETWEEN 250 AND 259"))
def stored_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, SC2, SC9, SC10, SK1: all vectors written as two segments of chunked stores; of these, ten days across the border are
    read, and only their chunks opened. A store that is incomplete or of another shape is refused."""
    folder = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    vec = A.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vals"))
    parts = {"early": (vec.where(f"vec_id < {BORDER}"), 0), "late": (vec.where(f"vec_id >= {BORDER}"), BORDER)}
    for name, (rows, first) in parts.items():
        write_store(rows.select((F.col("vec_id") - first).alias("day"), "vals"), f"{folder}/{name}", "field", (A.DENSE_ROWS, A.DENSE_COLUMNS))
    want = {"arrays": {"field": {"shape": [A.DENSE_ROWS, A.DENSE_COLUMNS], "dtype": "float32"}}, "attributes": {"complete": True}}
    days = read_stores(spark, [f"{folder}/{n}" for n in parts], ["field"], want=want, first=250, last=260)
    cells = days.select(F.col("place").alias("day_idx"), F.posexplode("field").alias("p", "val"))
    return pick(cells.withColumn("val", F.col("val").cast("double")), "day_idx p | val:6")


@query(ask("day cell | target:6", FIELD_SQL, "SELECT day, cell, target FROM field WHERE day = DATE '1996-02-29'"))
def netcdf_day_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11, SC12, SK7: daily fields of all line items exported as NetCDF files of a month or so each, on the grid's rows and
    columns; one date is found by the files' decoded times, and only its file's records are read."""
    f = A.field(spark, sf_dir).groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("cell", "target"))).alias("m"))  # at most a grid's cells
    vals = F.transform(F.sequence(F.lit(0), F.lit(A.CELLS - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(float("nan"))))
    days = f.select(F.datediff("day", F.lit("1992-01-01").cast("date")).alias("day"), vals.alias("vals"))
    folder = f"{shared_folder(spark)}/netcdf-{uuid.uuid4().hex}"
    names = write_netcdf(days, folder, {"lat": A.ROWS, "lon": A.COLUMNS}, "target", start="1992-01-01", attributes={"long_name": "mean extended price"})
    one = read_stores(spark, names, ["target"], "time", among=["1996-02-29"])
    cells = one.select(F.col("date").cast("date").alias("day"), F.posexplode("target").alias("cell", "target")).where(~F.isnan("target"))
    return pick(cells, "day cell | target:6")


@query(ask("day cell | target:6 pred_b:6", FIELD_SQL, "SELECT day, cell, target, pred_b FROM field WHERE day = DATE '1996-02-29'"))
def day_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC12, SC15: one day across all shards."""
    return pick(A.field(spark, sf_dir).where("day = date '1996-02-29'"), "day cell | target:6 pred_b:6")


@query(ask("year region n_days | e2:0", ERRORS_SQL, f"SELECT CAST(year(day) AS INTEGER) AS year, region, count(DISTINCT day) AS n_days, sum(w * err_b * err_b) / sum(w) AS e2 FROM ({masks.regions_sql('errors', ('global', 'land', 'tropics'))}) GROUP BY ALL"))
def population_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16: additive members of the yearly partials, with their day coverage."""
    e = masks.by_region(A.errors(spark, sf_dir), ("global", "land", "tropics")).withColumn("year", F.year("day"))
    return pick(e.groupBy("year", "region").agg(F.countDistinct("day").alias("n_days"), (metrics.wsum(F.col("err_b") ** 2) / F.sum("w")).alias("e2")), "year region n_days | e2:0")


@query(ask("day cell row col | target:6 err_a:6 err_b:6", ERRORS_SQL, "SELECT day, cell, row, col, target, err_a, err_b FROM errors WHERE day BETWEEN DATE '1997-07-01' AND DATE '1997-07-07' AND abs(lat) < 40 AND col BETWEEN 5 AND 12"))
def case_study_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK6: a cropped field for export."""
    e = A.errors(spark, sf_dir).where("day between date '1997-07-01' and date '1997-07-07' and abs(lat) < 40 and col between 5 and 12")
    return pick(e, "day cell row col | target:6 err_a:6 err_b:6")


# --- SO: sorts, limits and top-k


@query(ask("day cell place | err:2", ERRORS_SQL, "SELECT day, cell, place, err FROM (SELECT day, cell, floor(abs(err_b) * 100 + 0.5) / 100 AS err, row_number() OVER (ORDER BY floor(abs(err_b) * 100 + 0.5) / 100 DESC, day, cell) AS place FROM errors) WHERE place <= 25"))
def largest_cell_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO1: the 25 largest errors of all cells and days, ties by day and cell: a top-k of each task, then of those."""
    e = A.errors(spark, sf_dir).select("day", "cell", quantize(F.abs("err_b"), 2).alias("err"))
    top = e.orderBy(F.desc("err"), "day", "cell").limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("err"), "day", "cell")).cast("long")).select("day", "cell", "place", "err")


_GRID = "g AS (SELECT o_orderkey % 13 AS kx, o_orderkey % 9 AS ky, CAST(o_orderkey % 5 AS INTEGER) AS r, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS mse FROM orders GROUP BY 1, 2, 3)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = A.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.groupBy((k % 13).alias("kx"), (k % 9).alias("ky"), (k % 5).cast("int").alias("r")).agg(quantize(F.avg("o_totalprice"), 2).alias("mse"))


@query(f"WITH {_GRID} SELECT kx, ky, r, mse FROM g ORDER BY mse, r, kx, ky LIMIT 1")
def best_grid_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO3."""
    return _grid(spark, sf_dir).orderBy("mse", "r", "kx", "ky").limit(1).select("kx", "ky", "r", "mse")


@query(f"WITH {_GRID} SELECT kx, ky, r, mse, n FROM (SELECT *, row_number() OVER (PARTITION BY kx, ky ORDER BY mse, r) AS k, count(*) OVER (PARTITION BY kx, ky) AS n FROM g) WHERE k = 1")
def best_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO4: the best setting of each pair, as an aggregate (a hot pair combines on the map side)."""
    best = _grid(spark, sf_dir).groupBy("kx", "ky").agg(F.min(F.struct("mse", "r")).alias("b"), F.count("*").alias("n"))
    return best.select("kx", "ky", "b.r", "b.mse", "n")


@query(f"WITH {_GRID}, b AS (SELECT kx AS bx, ky AS bk, r AS br FROM g ORDER BY mse, r, kx, ky LIMIT 1) SELECT 'kx' AS axis, kx, ky, r, mse FROM g, b WHERE ky = bk AND r = br UNION ALL SELECT 'ky', kx, ky, r, mse FROM g, b WHERE kx = bx AND r = br UNION ALL SELECT 'r', kx, ky, r, mse FROM g, b WHERE kx = bx AND ky = bk")
def slices_around_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO5: one factor at a time around the selected row."""
    g = _grid(spark, sf_dir)
    b = g.agg(F.min(F.struct("mse", "r", "kx", "ky")).alias("b"))
    x = g.crossJoin(F.broadcast(b))  # one row
    axes = {"kx": ("ky", "r"), "ky": ("kx", "r"), "r": ("kx", "ky")}
    same = F.array_compact(F.array(*[F.when((F.col(u) == F.col(f"b.{u}")) & (F.col(v) == F.col(f"b.{v}")), F.lit(a)) for a, (u, v) in axes.items()]))
    return x.withColumn("axis", F.explode(same)).select("axis", "kx", "ky", "r", "mse")


@query(f"WITH {_GRID} SELECT kx, ky, r, mse FROM g ORDER BY mse, r, kx, ky LIMIT 5")
def five_best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO6."""
    return _grid(spark, sf_dir).orderBy("mse", "r", "kx", "ky").limit(5).select("kx", "ky", "r", "mse")


@query(f"WITH {_GRID}, s(kx, ky) AS (VALUES (0, 0), (12, 8), (77, 1)) SELECT s.kx, s.ky, count(g.kx) AS n FROM s LEFT JOIN g ON g.kx = s.kx AND g.ky = s.ky AND g.r = 0 GROUP BY ALL")
def expected_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO11: a lookup with the number of rows that each key finds."""
    s = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("kx"), F.lit(b).alias("ky")) for a, b in ((0, 0), (12, 8), (77, 1))])))
    g = _grid(spark, sf_dir).where("r = 0").select("kx", "ky", F.lit(1).alias("hit"))
    return F.broadcast(s).join(g, ["kx", "ky"], "left").groupBy("kx", "ky").agg(F.count("hit").alias("n"))


# --- set operations


@query("SELECT DISTINCT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey % 3 <> 0")
def unsupported_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one table that the other, without every third, lacks."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return c.distinct().join(s.where("nationkey % 3 <> 0").distinct(), "nationkey", "left_anti")


@query(f"WITH {DAILY_SQL}, m AS (SELECT climate, day_idx FROM daily WHERE day_idx % 7 = 0 UNION ALL SELECT 'mh', -1), lost AS (SELECT DISTINCT climate FROM (SELECT climate, day_idx FROM m EXCEPT SELECT climate, day_idx FROM daily)) SELECT climate, count(*) AS n_pool, count(*) FILTER (day_idx NOT IN (SELECT m.day_idx FROM m WHERE m.climate = daily.climate)) AS n_train, climate NOT IN (SELECT climate FROM lost) AS contained FROM daily GROUP BY climate")
def pool_minus_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training pool without the monitored days, and whether the pool contains all of these. One climate is asked for a day
    that it lacks."""
    d = A.daily(spark, sf_dir)
    monitor = d.where("day_idx % 7 = 0").select("climate", "day_idx")
    monitor = monitor.union(spark.range(1).select(F.lit("mh"), F.lit(-1).cast("long")))
    left = d.join(monitor, ["climate", "day_idx"], "left_anti").groupBy("climate").agg(F.count("*").alias("n_train"))
    lost = monitor.join(d.select("climate", "day_idx"), ["climate", "day_idx"], "left_anti").groupBy("climate").agg(F.count("*").alias("lost"))
    pool = d.groupBy("climate").agg(F.count("*").alias("n_pool"))
    return pool.join(left, "climate").join(lost, "climate", "left").select("climate", "n_pool", "n_train", (F.coalesce("lost", F.lit(0)) == 0).alias("contained"))


_MAPS = f"""{ERRORS_SQL}, one AS (SELECT cell, any_value(lat) AS lat, count(*) AS n FROM errors WHERE climate = 'pd' AND month(day) < 7 GROUP BY cell),
other AS (SELECT cell, -90.0::DOUBLE + row * 11.25::DOUBLE / 2 + (row + 1) * 11.25::DOUBLE / 2 + CASE WHEN cell % 97 = 5 THEN 0.5 ELSE 0 END AS lat, count(*) AS n FROM errors WHERE climate = 'ssp' AND month(day) = 3 GROUP BY cell, row)"""


@query(f"WITH {_MAPS} SELECT count(*) FILTER (o.lat = g.lat) AS n_common, count(*) FILTER (g.lat IS NULL OR o.lat IS NULL) AS n_lone, count(*) FILTER (g.lat <> o.lat) AS n_unlike, CAST(sum(coalesce(g.n, 0) + coalesce(o.n, 0)) AS BIGINT) AS n_values FROM one g FULL JOIN other o USING (cell)")
def grid_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO16: the cells of two maps of daily values compared: one of the present-day half years, one of the later climate's Marches,
    which has its latitudes from cell edges and some that are off by half a degree."""
    e = A.errors(spark, sf_dir)
    one = e.where("climate = 'pd' AND month(day) < 7").groupBy("cell").agg(F.first("lat").alias("lat"), F.count("*").alias("n"))
    off = F.when(F.col("cell") % 97 == 5, 0.5).otherwise(0.0)
    other = e.where("climate = 'ssp' AND month(day) = 3").groupBy("cell", "row").agg(F.count("*").alias("n2"))
    other = other.select("cell", "n2", (F.lit(-90.0) + F.col("row") * 11.25 / 2 + (F.col("row") + 1) * 11.25 / 2 + off).alias("lat2"))
    both = one.join(other, "cell", "full_outer")
    lone = F.col("lat").isNull() | F.col("lat2").isNull()
    counts = {"n_common": F.col("lat") == F.col("lat2"), "n_lone": lone, "n_unlike": F.col("lat") != F.col("lat2")}
    return both.agg(*[F.count_if(v).alias(k) for k, v in counts.items()], F.sum(F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n_values"))


@query("SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS n_users, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total FROM events GROUP BY event_type")
def tagged_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D18, SK5: a log of tagged records, aggregated by its discriminator."""
    e = A.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), quantize(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 2")
def top_events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO1 by group: the two largest values of each user."""
    e = A.table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return e.withColumn("k", k).where("k <= 2").select("user_id", "event_id")
