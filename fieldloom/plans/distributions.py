"""Distribution queries: histograms, quantiles, ranks, windows of series, sample distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalars import quantize
from fieldloom.operators import adapters as A
from fieldloom.operators import distributions as D
from fieldloom.operators import metrics
from fieldloom.operators.adapters import DAILY_SQL, DENSE_SQL, ERRORS_SQL

from .registry import ask, pick, query

LO, HI, BINS = -20000.0, 0.0, 40
_BIN = f"CASE WHEN v = {HI} THEN {BINS - 1} WHEN floor((v - {LO}) / 500) < 0 THEN -1 WHEN floor((v - {LO}) / 500) >= {BINS} THEN {BINS} ELSE CAST(floor((v - {LO}) / 500) AS INTEGER) END"
_HIST = f"h AS (SELECT climate, {_BIN} AS bin, sum(w) AS weight, count(*) AS n FROM (SELECT climate, floor(err_base * 1e4 + 0.5) / 1e4 AS v, w FROM errors) GROUP BY ALL)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.errors(spark, sf_dir).select("climate", quantize("err_base", 4).alias("v"), "w", "cell", "day")


@query(ask("climate bin n | weight:4", f"{ERRORS_SQL}, {_HIST}", "SELECT * FROM h"))
def uniform_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QU1: floor bins, the upper edge in the last one, under- and overflow as bins -1 and 40."""
    return pick(D.weighted_histogram(_values(spark, sf_dir), ["climate"], D.uniform_bin(F.col("v"), LO, HI, BINS)), "climate bin n | weight:4")


_EDGES = [-20000.0, -9000.0, -4000.0, -1500.0, -500.0, 0.0]


@query(ask("climate bin n | weight:4", ERRORS_SQL, f"SELECT climate, CASE WHEN v = 0 THEN 4 ELSE {' + '.join(f'CAST(v >= {e} AS INTEGER)' for e in _EDGES)} - 1 END AS bin, sum(w) AS weight, count(*) AS n FROM (SELECT climate, floor(err_base * 1e4 + 0.5) / 1e4 AS v, w FROM errors) GROUP BY ALL"))
def edge_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QU1b: explicit edges, the last bin closed."""
    return pick(D.weighted_histogram(_values(spark, sf_dir), ["climate"], D.edge_bin(F.col("v"), _EDGES)), "climate bin n | weight:4")


@query(ask("climate bin | density:10 fraction:8 under_share:8 over_share:8", f"{ERRORS_SQL}, {_HIST}, t AS (SELECT climate, sum(weight) FILTER (bin >= 0 AND bin < {BINS}) AS inside, sum(weight) AS whole, coalesce(sum(weight) FILTER (bin < 0), 0) AS under, coalesce(sum(weight) FILTER (bin >= {BINS}), 0) AS over FROM h GROUP BY climate)", f"SELECT h.climate, CAST(bin // 10 AS INTEGER) AS bin, sum(weight) / any_value(inside * 5000) AS density, sum(weight) / any_value(inside) AS fraction, any_value(under / whole) AS under_share, any_value(over / whole) AS over_share FROM h JOIN t USING (climate) WHERE bin >= 0 AND bin < {BINS} GROUP BY h.climate, bin // 10"))
def coarse_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QU3, QU4: ten fine bins to a coarse one, as density and as fraction."""
    h = D.weighted_histogram(_values(spark, sf_dir), ["climate"], D.uniform_bin(F.col("v"), LO, HI, BINS))
    return pick(D.density(h, ["climate"], BINS, 500.0, 10), "climate bin | density:10 fraction:8 under_share:8 over_share:8")


@query(ask("bin | pd:8 mh:8 ssp:8 mh_minus_pd:8", f"{ERRORS_SQL}, {_HIST}, f AS (SELECT climate, bin, weight / sum(weight) OVER (PARTITION BY climate) AS f FROM h WHERE bin >= 0 AND bin < {BINS})", "SELECT bin, coalesce(sum(f) FILTER (climate = 'pd'), 0) AS pd, coalesce(sum(f) FILTER (climate = 'mh'), 0) AS mh, coalesce(sum(f) FILTER (climate = 'ssp'), 0) AS ssp, coalesce(sum(f) FILTER (climate = 'mh'), 0) - coalesce(sum(f) FILTER (climate = 'pd'), 0) AS mh_minus_pd FROM f GROUP BY bin"))
def climate_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QU5: bin fractions of the three climates side by side."""
    h = D.weighted_histogram(_values(spark, sf_dir), ["climate"], D.uniform_bin(F.col("v"), LO, HI, BINS)).where(f"bin >= 0 and bin < {BINS}")
    f = h.withColumn("f", F.col("weight") / F.sum("weight").over(Window.partitionBy("climate")))
    wide = f.groupBy("bin").pivot("climate", list(A.CLIMATES)).agg(F.sum("f")).na.fill(0.0)
    return pick(wide.withColumn("mh_minus_pd", F.col("mh") - F.col("pd")), "bin | pd:8 mh:8 ssp:8 mh_minus_pd:8")


_MAP_SQL = "map AS (SELECT climate, cell, any_value(w) AS w, floor(sqrt(avg(err_base * err_base)) * 1e4 + 0.5) / 1e4 AS rmse, floor(sqrt(avg(err_a * err_a)) * 1e4 + 0.5) / 1e4 AS rmse_a, floor(sqrt(avg(err_b * err_b)) * 1e4 + 0.5) / 1e4 AS rmse_b FROM errors GROUP BY climate, cell)"


def rmse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """climate, cell, w and the rmse of the baseline and both predictions."""
    e = A.errors(spark, sf_dir).groupBy("climate", "cell").agg(F.first("w").alias("w"), *[F.sqrt(F.avg(F.col(f"err_{m}") ** 2)).alias(n) for m, n in (("base", "rmse"), ("a", "rmse_a"), ("b", "rmse_b"))])
    return e.select("climate", "cell", "w", *[quantize(c, 4).alias(c) for c in ("rmse", "rmse_a", "rmse_b")])


def quantile_sql(source: str, by: str, x: str, q: float) -> str:
    return f"""SELECT {by}, CASE WHEN pc IS NULL THEN {x} ELSE px + ({q} - pc) / (c - pc) * ({x} - px) END AS quantile FROM (SELECT *, lag(c) OVER (PARTITION BY {by} ORDER BY {x}, cell) AS pc, lag({x}) OVER (PARTITION BY {by} ORDER BY {x}, cell) AS px
 FROM (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY {x}, cell ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY {by}) AS c FROM {source})) WHERE c >= {q} - 1e-15 AND (pc IS NULL OR pc < {q} - 1e-15)"""


@query(ask("climate | quantile:2", f"{ERRORS_SQL}, {_MAP_SQL}", quantile_sql("map", "climate", "rmse", 0.9)))
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QU2, WI1."""
    return pick(D.weighted_quantiles(rmse_map(spark, sf_dir), ["climate"], "rmse", "cell", 0.9), "climate | quantile:2")


_FROZEN = f"""frozen AS (SELECT e.cell, any_value(e.w) AS w, floor(sqrt(avg(err_base * err_base)) * 1e4 + 0.5) / 1e4 AS rmse FROM errors e JOIN daily d ON d.climate = 'pd' AND d.day = e.day AND d.day_idx % {{step}} = 0 GROUP BY e.cell),
t AS (SELECT floor(quantile * 100 + 0.5) / 100 AS th FROM ({quantile_sql("(SELECT *, 0 AS one FROM frozen)", "one", "rmse", 0.99)})), hard AS (SELECT cell, th FROM frozen, t WHERE rmse >= th)"""
#: The validation days: every so manyth of the present-day climate.
VALIDATION_STEP = 5


def frozen_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, w and the baseline's rmse over the validation days."""
    days = A.daily(spark, sf_dir).where((F.col("climate") == "pd") & (F.col("day_idx") % VALIDATION_STEP == 0)).select("day")
    e = A.errors(spark, sf_dir).join(days, "day").groupBy("cell").agg(F.first("w").alias("w"), F.sqrt(F.avg(F.col("err_base") ** 2)).alias("rmse"))
    return e.select("cell", "w", quantize("rmse", 4).alias("rmse"))


@query(ask("climate n_cells | threshold:2 area:6 b_rmse:2", f"{DAILY_SQL}, {_MAP_SQL}, {_FROZEN.format(step=5)}", "SELECT m.climate, count(*) AS n_cells, any_value(th) AS threshold, sum(m.w) / 384 AS area, sqrt(sum(m.w * m.rmse_b * m.rmse_b) / sum(m.w)) AS b_rmse FROM map m JOIN hard USING (cell) GROUP BY m.climate"))
def hard_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI11, TR5: the cells at or over the 99th percentile (by area) of the validation days' own map, frozen and used for every
    climate."""
    f = frozen_map(spark, sf_dir)
    t = D.weighted_quantiles(f.withColumn("one", F.lit(0)), ["one"], "rmse", "cell", 0.99).select(quantize("quantile", 2).alias("threshold"))
    hard = f.crossJoin(F.broadcast(t)).where("rmse >= threshold").select("cell", "threshold")
    found = rmse_map(spark, sf_dir).join(hard, "cell").groupBy("climate")
    out = found.agg(F.count("*").alias("n_cells"), F.first("threshold").alias("threshold"), (F.sum("w") / A.CELLS).alias("area"), F.sqrt(metrics.wsum(F.col("rmse_b") ** 2) / F.sum("w")).alias("b_rmse"))
    return pick(out, "climate n_cells | threshold:2 area:6 b_rmse:2")


@query(ask("climate | mean:3 median:3 p95:3 max:3 lo:3 hi:3", DAILY_SQL, "SELECT climate, avg(x) AS mean, median(x) AS median, quantile_cont(x, 0.95) AS p95, max(x) AS max, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM (SELECT climate, sqrt(b_e2 / w) AS x FROM daily) GROUP BY climate"))
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18, AG19: exact percentiles with linear interpolation."""
    d = A.daily(spark, sf_dir).select("climate", F.sqrt(F.col("b_e2") / F.col("w")).alias("x"))
    p = F.percentile("x", F.array(*[F.lit(v) for v in (0.5, 0.95, 0.025, 0.975)]))
    s = d.groupBy("climate").agg(F.avg("x").alias("mean"), F.max("x").alias("max"), p.alias("p"))
    return pick(s.select("*", *[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(("median", "p95", "lo", "hi"))]), "climate | mean:3 median:3 p95:3 max:3 lo:3 hi:3")


@query(ask("climate | spearman:7 weighted:7", f"{ERRORS_SQL}, {_MAP_SQL}, r AS (SELECT climate, w, rank() OVER (PARTITION BY climate ORDER BY rmse_a) + (count(*) OVER (PARTITION BY climate, rmse_a) - 1) / 2.0 AS x, rank() OVER (PARTITION BY climate ORDER BY rmse_b) + (count(*) OVER (PARTITION BY climate, rmse_b) - 1) / 2.0 AS y FROM map), m AS (SELECT climate AS c, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM r GROUP BY 1)", "SELECT climate, corr(x, y) AS spearman, sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))) AS weighted FROM r JOIN m ON c = climate GROUP BY climate"))
def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17, WI8: Spearman by average ranks, plain and weighted."""
    r = D.average_ranks(D.average_ranks(rmse_map(spark, sf_dir), ["climate"], "rmse_a", "x"), ["climate"], "rmse_b", "y")
    plain = r.groupBy("climate").agg(F.corr("x", "y").alias("spearman"))
    weighted = metrics.weighted_correlation(r, ["climate"], "x", "y").select("climate", F.col("corr").alias("weighted"))
    return pick(plain.join(weighted, "climate"), "climate | spearman:7 weighted:7")


_SERIES = "series AS (SELECT climate, day_idx, day, floor(a_e2 / w / 1e4 + 0.5) / 100 AS x FROM daily)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily(spark, sf_dir).select("climate", "day_idx", "day", (F.floor(F.col("a_e2") / F.col("w") / 1e4 + 0.5) / 100).alias("x"))


@query(ask("climate day | smooth:4", f"{DAILY_SQL}, {_SERIES}", "SELECT * FROM (SELECT climate, day, avg(x) OVER w AS smooth, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY climate ORDER BY day_idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) WHERE n = 31"))
def boxcar_31_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI5: only whole windows."""
    s = _series(spark, sf_dir).withColumn("smooth", D.boxcar(["climate"], "day_idx", F.col("x"), 31))
    return pick(s.where("smooth is not null"), "climate day | smooth:4")


_ACF = "y AS (SELECT climate, day_idx AS t, x - avg(x) OVER (PARTITION BY climate) AS y FROM series), acf AS (SELECT climate, lag, c / max(CASE WHEN lag = 0 THEN c END) OVER (PARTITION BY climate) AS acf FROM (SELECT a.climate, b.t - a.t AS lag, sum(a.y * b.y) AS c FROM y a JOIN y b ON a.climate = b.climate AND b.t >= a.t GROUP BY ALL))"


@query(ask("climate lag | acf:8", f"{DAILY_SQL}, {_SERIES}, {_ACF}", "SELECT climate, lag, acf FROM acf"))
def series_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI6: all lags from 0 to n - 1."""
    return pick(D.autocorrelation(_series(spark, sf_dir), ["climate"], "day_idx", "x"), "climate lag | acf:8")


@query(ask("climate lags | tau:7 tau_60:7 n_over_tau:6", f"{DAILY_SQL}, {_SERIES}, {_ACF}, t AS (SELECT climate, lag, 1 + 2 * sum(acf) OVER (PARTITION BY climate ORDER BY lag) AS tau, max(lag) OVER (PARTITION BY climate) AS last FROM acf WHERE lag >= 1)", "SELECT climate, min(lag) FILTER (lag >= 5 * tau OR lag = last) AS lags, min_by(tau, lag) FILTER (lag >= 5 * tau OR lag = last) AS tau, max(tau) FILTER (lag = least(60, last)) AS tau_60, (max(last) + 1) / min_by(tau, lag) FILTER (lag >= 5 * tau OR lag = last) AS n_over_tau FROM t GROUP BY climate"))
def integrated_autocorrelation_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI7: the self-consistent window over all lags, the sum over 60 lags, and the number of independent days."""
    s = _series(spark, sf_dir)
    n = s.groupBy("climate").agg(F.count("*").alias("n"))
    t = D.integrated_time(D.autocorrelation(s, ["climate"], "day_idx", "x"), ["climate"]).join(n, "climate")
    return pick(t.select("climate", F.col("window").alias("lags"), "tau", F.col("fixed").alias("tau_60"), (F.col("n") / F.col("tau")).alias("n_over_tau")), "climate lags | tau:7 tau_60:7 n_over_tau:6")


@query("WITH y AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem), n AS (SELECT *, row_number() OVER (ORDER BY year) - 1 AS k FROM y) SELECT a.year AS first_year, a.year + 2 AS last_year, k % 3 = 0 AS separate FROM n a WHERE EXISTS (SELECT 1 FROM y WHERE year = a.year + 2)")
def rolling_year_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI9: three-year blocks, rolling, and which of them don't overlap (a handful of years)."""
    y = A.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    w = Window.orderBy("year")
    block = y.select("year", (F.row_number().over(w) - 1).alias("k"), F.collect_list("year").over(w.rowsBetween(0, 2)).alias("block"))
    return block.where(F.size("block") == 3).select(F.col("year").alias("first_year"), F.get("block", F.lit(2)).alias("last_year"), (F.col("k") % 3 == 0).alias("separate"))


_SAMPLE = f"{DAILY_SQL}, {_SERIES}, v AS (SELECT climate, median(x) AS v FROM series GROUP BY climate), pds AS (SELECT x AS s FROM series WHERE climate = 'pd')"


@query(ask("climate rank n_blocks beyond | value:4 percentile:6 robust_z:5 p5:3 p95:3", f"{_SAMPLE}, med AS (SELECT median(s) AS m FROM pds), mad AS (SELECT median(abs(s - m)) AS d FROM pds, med)", "SELECT climate, CAST(count(*) FILTER (s < v) + 1 AS BIGINT) AS rank, count(*) AS n_blocks, v < min(s) OR v > max(s) AS beyond, any_value(v) AS value, 100.0 * avg(CAST(s < v AS INTEGER)) + 50.0 / count(*) * avg(CAST(s = v AS INTEGER)) * 2 AS percentile, any_value((v - m) / nullif(1.4826 * d, 0)) AS robust_z, quantile_cont(s, 0.05) AS p5, quantile_cont(s, 0.95) AS p95 FROM v, pds, med, mad GROUP BY climate, v"))
def block_percentile_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QU11, QU12, QU13: where each climate's median lies within the pd sample."""
    s = _series(spark, sf_dir)
    v = s.groupBy("climate").agg(F.percentile("x", F.lit(0.5)).alias("value"))
    sample = s.where("climate = 'pd'").select(F.col("x").alias("s"))
    med = sample.agg(F.percentile("s", F.lit(0.5)).alias("m"))
    mad = sample.crossJoin(F.broadcast(med)).groupBy("m").agg(F.percentile(F.abs(F.col("s") - F.col("m")), F.lit(0.5)).alias("d"))
    at = F.col("value")
    out = sample.crossJoin(F.broadcast(v.crossJoin(F.broadcast(mad)))).groupBy("climate", "value", "m", "d").agg(
        (F.count_if(F.col("s") < at) + 1).alias("rank"), F.count("*").alias("n_blocks"), ((at < F.min("s")) | (at > F.max("s"))).alias("beyond"), D.percentile_of(at, "s").alias("percentile"), F.percentile("s", F.lit(0.05)).alias("p5"), F.percentile("s", F.lit(0.95)).alias("p95")
    )
    return pick(out.withColumn("robust_z", F.try_divide(at - F.col("m"), F.nullif(1.4826 * F.col("d"), F.lit(0.0)))), "climate rank n_blocks beyond | value:4 percentile:6 robust_z:5 p5:3 p95:3")


@query(ask("n n_finite | p50:4 mean:4", "x AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE WHEN event_id % 10 = 1 THEN 'inf'::DOUBLE ELSE value END AS v FROM events)", "SELECT count(*) AS n, count(*) FILTER (isfinite(v)) AS n_finite, quantile_cont(v, 0.5) FILTER (isfinite(v)) AS p50, avg(v) FILTER (isfinite(v)) AS mean FROM x"))
def finite_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI10: NaN and infinities are left out before percentiles."""
    k = F.col("event_id") % 10
    x = A.table(spark, sf_dir, "events").select(F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("value")).alias("v"))
    ok = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    p50 = D.exact_quantile(x.select(ok.alias("v")), "v", 0.5)
    return pick(x.agg(F.count("*").alias("n"), F.count(ok).alias("n_finite"), F.avg(ok).alias("mean")).withColumn("p50", F.lit(p50).cast("double")), "n n_finite | p50:4 mean:4")


# --- distances between samples


def _points(spark: SparkSession, sf_dir: str, label: int) -> DataFrame:
    return A.table(spark, sf_dir, "embeddings").where(F.col("label") == label).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


_PAIRS = f"{DENSE_SQL}, pairs AS (SELECT a.day_idx AS i, b.day_idx AS j, a.population AS gi, b.population AS gj, sum((a.val - b.val) * (a.val - b.val)) AS d2 FROM cells a JOIN cells b ON a.p = b.p AND a.population < 2 AND b.population < 2 GROUP BY ALL)"


@query(ask("id k | distance:6", f"{DENSE_SQL}, d AS (SELECT a.day_idx AS id, sqrt(sum((a.val - b.val) * (a.val - b.val))) AS d FROM cells a JOIN cells b ON a.p = b.p AND a.population = 0 AND b.population = 1 GROUP BY a.day_idx, b.day_idx)", "SELECT id, CAST(k AS INTEGER) AS k, d AS distance FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM d) WHERE k IN (1, 5, 20)"))
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QU8, SO9, JO14."""
    return pick(D.nearest_distances(_points(spark, sf_dir, 0), _points(spark, sf_dir, 1), (1, 5, 20)), "id k | distance:6")


def _two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "embeddings").where("label < 2").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("g"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query(ask("| bandwidth:6 energy:6 mmd2:6", f"{_PAIRS}, s AS (SELECT median(sqrt(d2)) AS s FROM pairs WHERE i < j), c AS (SELECT gi, gj, avg(sqrt(d2)) AS d, avg(exp(-d2 / (2 * s * s))) AS k FROM pairs, s GROUP BY gi, gj)", "SELECT s AS bandwidth, (SELECT 2 * sum(d) FILTER (gi = 0 AND gj = 1) - sum(d) FILTER (gi = gj) FROM c) AS energy, (SELECT sum(k) FILTER (gi = gj) - 2 * sum(k) FILTER (gi = 0 AND gj = 1) FROM c) AS mmd2 FROM s"))
def energy_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QU9: with the median distance of unordered pairs as bandwidth; diagonals count. All vectors of both populations."""
    s = _two_samples(spark, sf_dir)
    bandwidth = D.median_distance(s)
    energy, mmd2 = D.energy_and_kernel(s, bandwidth)
    values = {"bandwidth": bandwidth, "energy": energy, "mmd2": mmd2}
    return pick(spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in values.items()]), "| bandwidth:6 energy:6 mmd2:6")


#: Permutations, and days of a block whose labels are swapped together.
PERMUTATIONS, PERMUTED_DAYS = 4000, 60
_PERMUTED = f"""{_PAIRS}, sg AS (SELECT median(sqrt(d2)) AS s FROM pairs WHERE i < j),
bl AS (SELECT i // {PERMUTED_DAYS} AS bi, j // {PERMUTED_DAYS} AS bj, gi, gj, count(*) AS n, sum(sqrt(d2)) AS d, sum(exp(-d2 / (2 * s * s))) AS k FROM pairs, sg GROUP BY ALL),
sw AS (SELECT r, b, CASE WHEN r < 0 THEN 0 ELSE ((r * 7919 + b * 104729 + 31) * 48271) % 2147483647 % 2 END AS s FROM range(-1, {PERMUTATIONS}) t(r), (SELECT DISTINCT bi AS b FROM bl)),
e AS (SELECT u.r, (bl.gi + u.s) % 2 AS gi, (bl.gj + v.s) % 2 AS gj, sum(d) / sum(n) AS d, sum(k) / sum(n) AS k FROM bl JOIN sw u ON u.b = bl.bi JOIN sw v ON v.b = bl.bj AND v.r = u.r GROUP BY ALL),
st AS (SELECT r, 2 * max(d) FILTER (gi = 0 AND gj = 1) - sum(d) FILTER (gi = gj) AS energy, sum(k) FILTER (gi = gj) - 2 * max(k) FILTER (gi = 0 AND gj = 1) AS mmd2, count(*) = 4 AS whole FROM e GROUP BY r),
ob AS (SELECT energy AS e0, mmd2 AS k0 FROM st WHERE r = -1)"""


@query(ask("n_perm | energy:6 mmd2:6 p_energy:6 p_mmd2:6", _PERMUTED, f"SELECT CAST({PERMUTATIONS} AS BIGINT) AS n_perm, any_value(e0) AS energy, any_value(k0) AS mmd2, (1 + count(*) FILTER (whole AND floor(energy * 1e8) >= floor(e0 * 1e8))) / {PERMUTATIONS + 1}.0::DOUBLE AS p_energy, (1 + count(*) FILTER (whole AND floor(mmd2 * 1e8) >= floor(k0 * 1e8))) / {PERMUTATIONS + 1}.0::DOUBLE AS p_mmd2 FROM st, ob WHERE r >= 0"))
def block_permutation_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QU10: both p-values from 4,000 permutations that swap the labels of whole blocks of 60 days or leave them. The
    statistics of all permutations are one job over pairs of blocks of days, from sums by those blocks and populations. All
    vectors of both populations."""

    def labels(ids: np.ndarray, g: np.ndarray) -> np.ndarray:
        m, r = 2147483647, np.arange(PERMUTATIONS, dtype=np.int64)
        block, place = np.unique(ids.astype(np.int64) // PERMUTED_DAYS, return_inverse=True)
        drawn = ((r * 7919 + block[:, None] * 104729 + 31) * 48271) % m % 2
        return (g[:, None] + np.hstack((np.zeros((len(block), 1), np.int64), drawn))[place]) % 2

    sample = _two_samples(spark, sf_dir)
    alike = F.col("id") - F.pmod("id", F.lit(PERMUTED_DAYS)) + F.col("g")
    both = D.relabelled_statistics(sample, D.median_distance(sample), labels, alike)
    p = [float((1 + (np.floor(x[1:] * 1e8) >= np.floor(x[0] * 1e8)).sum()) / (1 + PERMUTATIONS)) for x in both]
    row = [(PERMUTATIONS, *(float(x[0]) for x in both), *p)]
    return pick(spark.createDataFrame(row, "n_perm long, energy double, mmd2 double, p_energy double, p_mmd2 double"), "n_perm | energy:6 mmd2:6 p_energy:6 p_mmd2:6")
