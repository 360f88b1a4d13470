"""Verification queries: scalar columns, regions, joins and error aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.operators import adapters as A
from fieldloom.operators import distributions as D
from fieldloom.operators import masks, metrics
from fieldloom.operators.adapters import DAILY_SQL, DENSE_SQL, ERRORS_SQL, FIELD_SQL, GRID_SQL

from .registry import ask, pick, query

_SUMS = "sum(w) AS w, " + ", ".join(f"sum(w * err_{m} * err_{m}) AS {m}_e2, sum(w * abs(err_{m})) AS {m}_ea, sum(w * err_{m}) AS {m}_e1" for m in ("a", "b", "base"))
_METRICS = ", ".join(f"sqrt({m}_e2 / w) AS {m}_rmse, {m}_ea / w AS {m}_mae, {m}_e1 / w AS {m}_bias" for m in ("a", "b", "base")) + ", " + ", ".join(f"1 - sqrt({m}_e2) / nullif(sqrt(base_e2), 0) AS {m}_skill, 1 - {m}_e2 / nullif(base_e2, 0) AS {m}_skill_mse" for m in ("a", "b"))
_PERIODS = "(SELECT *, 'annual' AS period FROM {0} UNION ALL SELECT *, season AS period FROM {0})"
_METRIC_SPEC = "a_rmse:3 a_mae:3 a_bias:3 b_rmse:3 b_mae:3 b_bias:3 base_rmse:3 base_mae:3 base_bias:3 a_skill:7 a_skill_mse:7 b_skill:7 b_skill_mse:7"


def _regional(land: bool) -> str:
    return f"SELECT region, period, {_METRICS} FROM (SELECT region, period, {_SUMS} FROM {_PERIODS.format(f'({masks.regions_sql("errors", land_inclusive=land)})')} GROUP BY ALL)"


# --- AG1, AG2, AG5, JO1 to JO4: weighted metrics by region and period


@query(ask(f"region period | {_METRIC_SPEC}", ERRORS_SQL, _regional(True)))
def regional_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = metrics.error_sums(A.errors(spark, sf_dir), ["cell", "season"])
    return pick(metrics.error_metrics(metrics.roll_up(sums, A.grid(spark), [], periods=True)), f"region period | {_METRIC_SPEC}")


@query(ask(f"region period | {_METRIC_SPEC}", ERRORS_SQL, _regional(False)))
def regional_rmse_strict_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI1b: half-land cells are in neither land nor ocean."""
    sums = metrics.error_sums(A.errors(spark, sf_dir), ["cell", "season"])
    return pick(metrics.error_metrics(metrics.roll_up(sums, A.grid(spark), [], land_inclusive=False, periods=True)), f"region period | {_METRIC_SPEC}")


_CLASS_SQL = """class AS (SELECT *, (CASE WHEN abs(lat) < 23.5 THEN 0 WHEN lat >= 23.5 AND lat < 60 THEN 1 WHEN lat <= -23.5 AND lat > -60 THEN 2 WHEN lat >= 60 AND lat < 80 THEN 3 WHEN lat <= -60 AND lat > -80 THEN 4
 WHEN lat >= 80 THEN 5 ELSE 6 END * 4 + CASE WHEN lsm <= 0.05 THEN 0 WHEN lsm < 0.5 THEN 1 WHEN lsm < 0.95 THEN 2 ELSE 3 END) * 3 + CASE WHEN oro_m > 2000 THEN 2 WHEN oro_m > 1000 THEN 1 ELSE 0 END AS cell_class FROM grid)"""


@query(f"WITH {ERRORS_SQL}, {_CLASS_SQL} SELECT cell, CAST(cell_class AS INTEGER) AS cell_class, count(*) AS n_values FROM class JOIN errors USING (cell) GROUP BY ALL")
def cell_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI3, D15: the 84-class partition of all daily values: the class of every cell that has any, and how many it has."""
    return A.errors(spark, sf_dir).withColumn("cell_class", masks.cell_class()).groupBy("cell", "cell_class").agg(F.count("*").alias("n_values"))


@query(ask("region | a_rmse:3 b_rmse:3", ERRORS_SQL, f"SELECT region, sqrt(sum(w * err_a * err_a) / sum(w)) AS a_rmse, sqrt(sum(w * err_b * err_b) / sum(w)) AS b_rmse FROM ({masks.regions_sql('errors', masks.REGIONS + masks.DERIVED)}) GROUP BY region"))
def class_rollup_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO5: sums over 84 disjoint classes, rolled up to 14 overlapping regions: the field is aggregated once."""
    sums = metrics.error_sums(A.errors(spark, sf_dir).withColumn("cell_class", masks.cell_class()), ["cell_class"])
    rolled = sums.join(F.broadcast(masks.class_regions(spark)), "cell_class").groupBy("region")
    totals = rolled.agg(*[F.sum(c).alias(c) for c in ("w", "a_e2", "b_e2")])
    return pick(totals.select("region", F.sqrt(F.col("a_e2") / F.col("w")).alias("a_rmse"), F.sqrt(F.col("b_e2") / F.col("w")).alias("b_rmse")), "region | a_rmse:3 b_rmse:3")


@query(ask("region n_cells n_values | area:6", ERRORS_SQL, f"SELECT region, count(DISTINCT cell) AS n_cells, count(*) AS n_values, sum(w) / 384 AS area FROM ({masks.regions_sql('errors', masks.REGIONS + masks.DERIVED)}) GROUP BY region"))
def region_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI1, FI2, D14: cells, daily values and their summed area in each of the 14 regions."""
    rows = masks.by_region(A.errors(spark, sf_dir), masks.REGIONS + masks.DERIVED).groupBy("region")
    return pick(rows.agg(F.count_distinct("cell").alias("n_cells"), F.count("*").alias("n_values"), (F.sum("w") / A.CELLS).alias("area")), "region n_cells n_values | area:6")


@query(ask("climate day season | w:6 base_e2:1 a_e2:1 b_e2:1 base_rmse:2 a_rmse:2 b_rmse:2", DAILY_SQL, "SELECT *, sqrt(base_e2 / w) AS base_rmse, sqrt(a_e2 / w) AS a_rmse, sqrt(b_e2 / w) AS b_rmse FROM daily"))
def daily_global_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3, AG9: additive series a day, and their metrics."""
    d = A.daily(spark, sf_dir)
    return pick(d.withColumns({f"{m}_rmse": F.sqrt(F.col(f"{m}_e2") / F.col("w")) for m in ("base", "a", "b")}), "climate day season | w:6 base_e2:1 a_e2:1 b_e2:1 base_rmse:2 a_rmse:2 b_rmse:2")


@query(ask("climate cell n | rmse:3 mae:3 bias:3 base_rmse:3 skill:7", ERRORS_SQL, "SELECT climate, cell, count(*) AS n, sqrt(sum(err_b * err_b) / count(*)) AS rmse, avg(abs(err_b)) AS mae, avg(err_b) AS bias, sqrt(sum(err_base * err_base) / count(*)) AS base_rmse, CASE WHEN sum(err_base * err_base) > 0 THEN 1 - sum(err_b * err_b) / sum(err_base * err_base) END AS skill FROM errors GROUP BY climate, cell"))
def cell_error_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4, AG11: error maps over the finite days of each cell."""
    return pick(metrics.cell_maps(A.errors(spark, sf_dir), ["climate", "cell"]), "climate cell n | rmse:3 mae:3 bias:3 base_rmse:3 skill:7")


_CORRECTION = "sum(w) AS w, count(*) AS n, sum(w * err_a * err_a) AS err2, sum(w * abs(err_a)) AS abs_err, sum(w * err_a) AS err, sum(w * err_base * err_base) AS err2_base, sum(w * abs(err_base)) AS abs_base, sum(w * err_base) AS eb, sum(w * (pred_a - base) * (pred_a - base)) AS rh2, sum(w * (pred_a - base) * (target - base)) AS crosses"
_CORRECTED = "n, sqrt(err2 / w) AS rmse, abs_err / w AS mae, err / w AS bias, sqrt(greatest(err2 / w - err * err / w / w, 0)) AS error_std, sqrt(err2_base / w) AS base_rmse, abs_base / w AS base_mae, eb / w AS base_bias, 1 - err2 / nullif(err2_base, 0) AS skill, CASE WHEN rh2 > 0 AND err2_base > 0 THEN crosses / sqrt(rh2 * err2_base) END AS correction_corr, CASE WHEN err2_base > 0 THEN sqrt(rh2 / err2_base) END AS amplitude_ratio"
_CORRECTED_SPEC = "rmse:3 mae:3 bias:3 error_std:3 base_rmse:3 base_mae:3 base_bias:3 skill:7 correction_corr:7 amplitude_ratio:7"


@query(ask(f"climate n | {_CORRECTED_SPEC}", ERRORS_SQL, f"SELECT climate, {_CORRECTED} FROM (SELECT climate, {_CORRECTION} FROM errors GROUP BY climate)"))
def global_correction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6, AG7: the eight accumulators and what follows from them."""
    return pick(metrics.correction_metrics(metrics.correction_sums(A.errors(spark, sf_dir), ["climate"])), f"climate n | {_CORRECTED_SPEC}")


@query(ask(f"region n_cells | weight_fraction:7 {_CORRECTED_SPEC}", ERRORS_SQL + f", rg AS ({masks.regions_sql('grid')})", f"SELECT c.region, n_cells, weight_fraction, {_CORRECTED} FROM (SELECT region, count(*) AS n_cells, sum(w) / 384 AS weight_fraction FROM rg GROUP BY region) c LEFT JOIN (SELECT region, {_CORRECTION} FROM ({masks.regions_sql('errors')}) GROUP BY region) USING (region)"))
def regional_correction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8: a row for every region, with its share of the weight, empty ones included."""
    cells = masks.by_region(A.grid(spark)).groupBy("region").agg(F.count("*").alias("n_cells"), (F.sum("w") / A.CELLS).alias("weight_fraction"))
    sums = metrics.correction_sums(A.errors(spark, sf_dir), ["cell"])
    found = metrics.correction_metrics(metrics.roll_up(sums, A.grid(spark), []))
    return pick(cells.join(found, "region", "left"), f"region n_cells | weight_fraction:7 {_CORRECTED_SPEC}")


@query(ask("climate | correction_mean:3 correction_std:3 correction_rms:3 required_mean:3 required_std:3 required_rms:3 corr:7 correction_absmax:3 required_absmax:3", ERRORS_SQL, """SELECT climate, c AS correction_mean, sqrt(greatest(cc - c * c, 0)) AS correction_std, sqrt(cc) AS correction_rms, r AS required_mean, sqrt(greatest(rr - r * r, 0)) AS required_std, sqrt(rr) AS required_rms,
 (cr - c * r) / sqrt(greatest(cc - c * c, 0) * greatest(rr - r * r, 0)) AS corr, correction_absmax, required_absmax FROM (SELECT climate, sum(w * (pred_b - base)) / sum(w) AS c, sum(w * (target - base)) / sum(w) AS r, sum(w * (pred_b - base) * (pred_b - base)) / sum(w) AS cc,
 sum(w * (target - base) * (target - base)) / sum(w) AS rr, sum(w * (pred_b - base) * (target - base)) / sum(w) AS cr, max(abs(pred_b - base)) AS correction_absmax, max(abs(target - base)) AS required_absmax FROM errors GROUP BY climate)"""))
def centred_correction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10: centred correlation, deviations and masked maxima of the corrections."""
    return pick(metrics.centred_correction(A.errors(spark, sf_dir), ["climate"]), "climate | correction_mean:3 correction_std:3 correction_rms:3 required_mean:3 required_std:3 required_rms:3 corr:7 correction_absmax:3 required_absmax:3")


@query(ask("season | wmean:3 wmeansq:0 wrms:3 wstd:3", ERRORS_SQL, "SELECT season, m AS wmean, m2 AS wmeansq, sqrt(m2) AS wrms, sqrt(greatest(m2 - m * m, 0)) AS wstd FROM (SELECT season, sum(w * err_a) / sum(w) AS m, sum(w * err_a * err_a) / sum(w) AS m2 FROM errors GROUP BY season)"))
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13."""
    return pick(metrics.weighted_moments(A.errors(spark, sf_dir), ["season"], "err_a"), "season | wmean:3 wmeansq:0 wrms:3 wstd:3")


@query(ask("climate | pearson:6 uncentred:6 plain:6", ERRORS_SQL, """SELECT climate, sum(w * (target - mt) * (pred_b - mp)) / sqrt(sum(w * (target - mt) * (target - mt)) * sum(w * (pred_b - mp) * (pred_b - mp))) AS pearson,
 sum(w * target * pred_b) / sqrt(sum(w * target * target) * sum(w * pred_b * pred_b)) AS uncentred, corr(target, pred_b) AS plain FROM errors JOIN (SELECT climate, sum(w * target) / sum(w) AS mt, sum(w * pred_b) / sum(w) AS mp FROM errors GROUP BY climate) USING (climate) GROUP BY climate"""))
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14, AG15, AG16."""
    e = A.errors(spark, sf_dir)
    centred = metrics.weighted_correlation(e, ["climate"], "target", "pred_b").select("climate", F.col("corr").alias("pearson"))
    plain = metrics.weighted_correlation(e, ["climate"], "target", "pred_b", centred=False).select("climate", F.col("corr").alias("uncentred"))
    return pick(centred.join(plain, "climate").join(e.groupBy("climate").agg(F.corr("target", "pred_b").alias("plain")), "climate"), "climate | pearson:6 uncentred:6 plain:6")


@query(ask("season n n_finite n_below n_above | min:3 max:3 pct_below:6 pct_above:6", ERRORS_SQL, "SELECT season, count(*) AS n, count(*) AS n_finite, count(*) FILTER (err_base < -10000) AS n_below, count(*) FILTER (err_base > -100) AS n_above, min(err_base) AS min, max(err_base) AS max, 100.0 * count(*) FILTER (err_base < -10000) / count(*) AS pct_below, 100.0 * count(*) FILTER (err_base > -100) / count(*) AS pct_above FROM errors GROUP BY season"))
def saturation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG20."""
    return pick(metrics.finite_summary(A.errors(spark, sf_dir), ["season"], "err_base", -10000.0, -100.0), "season n n_finite n_below n_above | min:3 max:3 pct_below:6 pct_above:6")


@query(f"WITH {DAILY_SQL} SELECT c.climate, s.season, coalesce(n, 0) AS n_days FROM (SELECT DISTINCT climate FROM daily) c CROSS JOIN (VALUES ('DJF'), ('MAM'), ('JJA'), ('SON')) s(season) LEFT JOIN (SELECT climate, season, count(*) AS n FROM daily GROUP BY ALL) USING (climate, season)")
def season_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21: days a season of every climate, with zeros."""
    n = A.daily(spark, sf_dir).groupBy("climate").pivot("season", ["DJF", "MAM", "JJA", "SON"]).agg(F.count("day"))
    seasons = F.array(*[F.struct(F.lit(s).alias("season"), F.coalesce(F.col(s), F.lit(0)).cast("long").alias("n_days")) for s in ("DJF", "MAM", "JJA", "SON")])
    return n.select("climate", F.inline(seasons))


_THIRTEEN = {"q_w": "w", "q_r2": "w * (target - base) * (target - base)", "q_ea2": "w * err_a * err_a", "q_eb2": "w * err_b * err_b", "q_ab": "w * err_a * err_b", "q_ca2": "w * (pred_a - base) * (pred_a - base)", "q_cb2": "w * (pred_b - base) * (pred_b - base)", "q_ra": "w * (pred_a - base) * (target - base)", "q_rb": "w * (pred_b - base) * (target - base)", "q_t2": "w * target * target", "q_b2": "w * base * base", "q_tb": "w * target * base", "q_pab": "w * pred_a * pred_b"}
_THIRTEEN_SPEC = "region climate | " + " ".join(f"{k}:{6 if k == 'q_w' else -2}" for k in _THIRTEEN)


@query(ask(_THIRTEEN_SPEC.replace(":-2", ":0"), ERRORS_SQL, f"SELECT region, climate, {', '.join(f'{"sum(w)" if k == "q_w" else f"sum({v}) / sum(w)"} AS {k}' for k, v in _THIRTEEN.items())} FROM ({masks.regions_sql('errors', masks.REGIONS + masks.DERIVED)}) GROUP BY ALL"))
def thirteen_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG23: thirteen weighted contractions for each of 14 regions, through the class roll-up."""
    sums = A.errors(spark, sf_dir).withColumn("cell_class", masks.cell_class()).groupBy("climate", "cell_class").agg(*[F.sum(F.expr(v)).alias(k) for k, v in _THIRTEEN.items()])
    rolled = sums.join(F.broadcast(masks.class_regions(spark)), "cell_class").groupBy("region", "climate").agg(*[F.sum(k).alias(k) for k in _THIRTEEN])
    means = rolled.withColumns({k: F.col(k) / F.col("q_w") for k in _THIRTEEN if k != "q_w"})
    return pick(means, _THIRTEEN_SPEC.replace(":-2", ":0"))


_CELL_SUMS = {"t_sum": "target", "base_sum": "base", "r_sum": "target - base", "e_sum": "err_a", "t_sq": "target * target", "base_sq": "base * base", "r_sq": "(target - base) * (target - base)", "a_sq": "err_a * err_a", "b_sq": "err_b * err_b", "u_sum": "pred_b - base", "u_sq": "(pred_b - base) * (pred_b - base)", "v_sq": "(pred_a - base) * (pred_a - base)", "cross_sum": "err_a * err_b", "t_base_sum": "target * base"}
_CELL_SPEC = "year season cell n | " + " ".join(f"{n}:{2 if '*' not in x else -2}" for n, x in _CELL_SUMS.items())


@query(ask(_CELL_SPEC, ERRORS_SQL, f"SELECT CAST(year(day) AS INTEGER) AS year, season, cell, count(*) AS n, {', '.join(f'sum(w * ({x})) AS {n}' for n, x in _CELL_SUMS.items())} FROM errors GROUP BY ALL"))
def season_cell_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24, AG25: fourteen additive sums a year, season and cell: fields, corrections, errors, squares and cross terms."""
    e = A.errors(spark, sf_dir).withColumn("year", F.year("day"))
    return pick(e.groupBy("year", "season", "cell").agg(F.count("*").alias("n"), *[metrics.wsum(F.expr(x)).alias(n) for n, x in _CELL_SUMS.items()]), _CELL_SPEC)


@query(ask("climate | pop:3 samp:3", ERRORS_SQL, "SELECT climate, stddev_pop(err_b) AS pop, stddev_samp(err_b) AS samp FROM errors GROUP BY climate"))
def standard_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG26: both conventions."""
    return pick(A.errors(spark, sf_dir).groupBy("climate").agg(F.stddev_pop("err_b").alias("pop"), F.stddev_samp("err_b").alias("samp")), "climate | pop:3 samp:3")


@query(ask("climate | norm_raw:0 norm_centred:0", ERRORS_SQL + ", m AS (SELECT climate AS mc, avg(err_base) AS m FROM errors GROUP BY 1)", "SELECT climate, sum(w * err_base * err_base) / sum(w) AS norm_raw, sum(w * (err_base - m) * (err_base - m)) / sum(w) AS norm_centred FROM errors JOIN m ON mc = climate GROUP BY climate"))
def residual_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22: raw and centred weighted norms."""
    e = A.errors(spark, sf_dir)
    m = e.groupBy("climate").agg(F.avg("err_base").alias("m"))
    r, c = F.col("err_base"), F.col("err_base") - F.col("m")
    return pick(e.join(F.broadcast(m), "climate").groupBy("climate").agg((metrics.wsum(r * r) / F.sum("w")).alias("norm_raw"), (metrics.wsum(c * c) / F.sum("w")).alias("norm_centred")), "climate | norm_raw:0 norm_centred:0")


@query("WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey FROM lineitem) SELECT count(*) AS n, count(DISTINCT day) AS n_days, count(*) - count(DISTINCT (day, l_orderkey)) AS n_repeats FROM d")
def duplicate_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG30, WI14."""
    d = A.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), "l_orderkey")
    return d.agg(F.count("*").alias("n"), F.countDistinct("day").alias("n_days"), (F.count("*") - F.countDistinct("day", "l_orderkey")).alias("n_repeats"))


# --- AG12, WI10: the seam between the last and the first column


_SEAM = """s AS (SELECT day_idx, row, max(CASE WHEN col = 0 THEN val END) - max(CASE WHEN col = 15 THEN val END) AS jump FROM dense GROUP BY ALL),
i AS (SELECT day_idx, row, abs(val - lag(val) OVER (PARTITION BY day_idx, row ORDER BY col)) AS step FROM dense)"""


@query(ask("| seam_abs_mean:6 seam_abs_median:6 interior_abs_mean:6 interior_median:6 seam_to_interior:6 seam_percentile:4", f"{DENSE_SQL}, {_SEAM}, sm AS (SELECT median(abs(jump)) AS med FROM s)", """SELECT a.m AS seam_abs_mean, med AS seam_abs_median, b.m AS interior_abs_mean, b.med2 AS interior_median, a.m / b.m AS seam_to_interior, 100.0 * b.below AS seam_percentile
 FROM sm, (SELECT avg(abs(jump)) AS m FROM s) a, (SELECT avg(step) AS m, median(step) AS med2, avg(CASE WHEN step <= med THEN 1.0 ELSE 0.0 END) AS below FROM i, sm WHERE step IS NOT NULL) b"""))
def seam_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12: the jump across the seam against steps between neighbours, within each row array: no shuffle of cells."""
    rows = A.dense(spark, sf_dir)
    v = F.transform("vals", lambda x: x.cast("double"))
    rows = rows.select(F.abs(F.element_at(v, 1) - F.element_at(v, -1)).alias("seam"), F.zip_with(F.slice(v, 2, 15), F.slice(v, 1, 15), lambda a, b: F.abs(a - b)).alias("steps"))
    steps = rows.select(F.explode("steps").alias("step"))
    middle, inner = D.exact_quantile(rows, "seam", 0.5), D.exact_quantile(steps, "step", 0.5)
    seam = rows.agg(F.avg("seam").alias("seam_abs_mean"))
    below = 100 * F.avg((F.col("step") <= F.lit(middle)).cast("double"))
    out = steps.agg(F.avg("step").alias("interior_abs_mean"), below.alias("seam_percentile")).crossJoin(F.broadcast(seam))  # one row each
    out = out.withColumns({"seam_abs_median": F.lit(middle).cast("double"), "interior_median": F.lit(inner).cast("double")})
    return pick(out.withColumn("seam_to_interior", F.col("seam_abs_mean") / F.col("interior_abs_mean")), "| seam_abs_mean:6 seam_abs_median:6 interior_abs_mean:6 interior_median:6 seam_to_interior:6 seam_percentile:4")


@query(ask("day_idx row | step_max:6", f"{DENSE_SQL}", "SELECT day_idx, row, max(abs(nxt - val)) AS step_max FROM (SELECT *, coalesce(lead(val) OVER (PARTITION BY day_idx, row ORDER BY col), first_value(val) OVER (PARTITION BY day_idx, row ORDER BY col)) AS nxt FROM dense) GROUP BY day_idx, row"))
def zonal_gradient_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI10: the largest step to the next column, around the circle."""
    v = F.transform("vals", lambda x: x.cast("double"))
    ring = F.concat(F.slice(v, 2, 15), F.slice(v, 1, 1))
    return pick(A.dense(spark, sf_dir).select("day_idx", "row", F.array_max(F.zip_with(ring, v, lambda a, b: F.abs(a - b))).alias("step_max")), "day_idx row | step_max:6")


# --- PR: scalar columns


@query("SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'DJF' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'MAM' WHEN month(l_shipdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, month(l_shipdate) = 2 AND day(l_shipdate) = 29 AS leap_day, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem")
def calendar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR1, PR16."""
    d = A.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return d.select("day", S.season_name("day").alias("season"), S.is_leap_day("day").alias("leap_day"), F.year("day").alias("year"))


_ROWS_SQL = f"{ERRORS_SQL}, r AS (SELECT row, any_value(lat) AS lat, count(*) AS n, avg(target) AS target FROM errors GROUP BY row)"


def _field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, lat, n and the mean target of the latitude rows that have values (at most a grid's)."""
    return A.errors(spark, sf_dir).groupBy("row").agg(F.first("lat").alias("lat"), F.count("*").alias("n"), F.avg("target").alias("target"))


@query(ask("row n | lat:6 lon_first:6 w_cos:9 w_single:5 w_area:9 target:2", _ROWS_SQL, "SELECT row, n, lat, 7.5::DOUBLE AS lon_first, cos(radians(lat)) / avg(cos(radians(lat))) OVER () AS w_cos, cos(radians(lat)) / avg(cos(radians(lat))) OVER () AS w_single, sin(radians(-90 + (row + 1) * 11.25::DOUBLE)) - sin(radians(-90 + row * 11.25::DOUBLE)) AS w_area, target FROM r"))
def row_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR2, PR3, PR4, PR8: the three weight conventions over the latitude rows of the daily values; the single one agrees to five
    digits."""
    rows = _field_rows(spark, sf_dir)
    return pick(rows.select("row", "n", "lat", S.column_longitude(F.lit(0), A.COLUMNS).alias("lon_first"), S.cosine_weight("lat").alias("w_cos"), S.cosine_weight_single("lat").alias("w_single"), S.cell_area_weight("row", A.ROWS).alias("w_area"), "target"), "row n | lat:6 lon_first:6 w_cos:9 w_single:5 w_area:9 target:2")


_SCALE = S.INPUT_STD / S.TARGET_STD
_OFFSET = (S.INPUT_MEAN - S.TARGET_MEAN) / S.TARGET_STD


@query(f"SELECT o_orderkey, floor((o_totalprice / 1000 * {_SCALE!r} + {_OFFSET!r}) * 1e8 + 0.5) / 1e8 AS baseline, floor((o_totalprice / 1000 * {S.TARGET_STD!r} + {S.TARGET_MEAN!r}) * 1e6 + 0.5) / 1e6 AS physical, floor((o_totalprice / 1000 - {S.INPUT_MEAN!r}) / {S.INPUT_STD!r} * 1e6 + 0.5) / 1e6 AS norm FROM orders")
def normalisation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR5, PR6."""
    x = F.col("o_totalprice") / 1000
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", S.baseline_in_target_units(x).alias("baseline"), S.denormalize(x).alias("physical"), S.normalize(x, S.INPUT_MEAN, S.INPUT_STD).alias("norm"))
    return pick(o, "o_orderkey | baseline:8 physical:6 norm:6")


@query(f"SELECT o_orderkey, floor(CAST(CAST(CAST(o_totalprice / 1000 AS FLOAT) * CAST({_SCALE!r} AS FLOAT) AS FLOAT) + CAST({_OFFSET!r} AS FLOAT) AS DOUBLE) * 1e4 + 0.5) / 1e4 AS baseline FROM orders")
def baseline_single_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR5b: rounded to float at every step."""
    o = A.table(spark, sf_dir, "orders")
    return pick(o.select("o_orderkey", S.baseline_in_target_units(F.col("o_totalprice") / 1000, single=True).cast("double").alias("baseline")), "o_orderkey | baseline:4")


@query(f"WITH {ERRORS_SQL} SELECT col, n, floor(((((lon + 180) % 360) + 360) % 360 - 180) * 1e6 + 0.5) / 1e6 AS lon, CAST(row_number() OVER (ORDER BY (((lon + 180) % 360) + 360) % 360) - 1 AS INTEGER) AS place FROM (SELECT col, count(*) AS n, (col + 0.5::DOUBLE) * 15 AS lon FROM errors GROUP BY col)")
def longitude_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR7, SO8: longitudes in [-180, 180) of the daily values' columns, their order by them, and how many values each has (at
    most a grid's columns meet in the window)."""
    c = A.errors(spark, sf_dir).groupBy("col").agg(F.count("*").alias("n")).withColumn("lon", S.lon180(S.column_longitude("col", A.COLUMNS)))
    return c.select("col", "n", S.quantize("lon").alias("lon"), (F.row_number().over(Window.orderBy("lon")) - 1).alias("place"))


@query(ask("k below | edge:9", _ROWS_SQL, "SELECT row AS k, CAST(coalesce(sum(n) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below, CASE WHEN lag(lat) OVER (ORDER BY row) IS NULL THEN lat - (lead(lat) OVER (ORDER BY row) - lat) / 2 ELSE (lag(lat) OVER (ORDER BY row) + lat) / 2 END AS edge FROM r UNION ALL SELECT max(row) + 1, CAST(sum(n) AS BIGINT), max(lat) + (max(lat) - max(CASE WHEN row = (SELECT max(row) FROM r WHERE row < (SELECT max(row) FROM r)) THEN lat END)) / 2 FROM r"))
def edges_from_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR9: midpoints between the centres of the rows that have values, mirrored at both ends, and how many values lie below each
    (at most a grid's rows meet in the window)."""
    w = Window.orderBy("k")
    rows = _field_rows(spark, sf_dir).select(F.col("row").alias("k"), "lat", "n")
    before = F.lag("lat").over(w)
    low = F.when(before.isNull(), F.col("lat") - (F.lead("lat").over(w) - F.col("lat")) / 2).otherwise((before + F.col("lat")) / 2)
    inner = rows.select("k", (F.sum("n").over(w) - F.col("n")).alias("below"), low.alias("edge"), "lat", before.alias("before"), "n")
    last = F.max_by(F.struct("lat", "before"), "k")
    top = inner.agg((F.max("k") + 1).alias("k"), F.sum("n").alias("below"), (last["lat"] + (last["lat"] - last["before"]) / 2).alias("edge"))
    return pick(inner.select("k", "below", "edge").union(top), "k below | edge:9")


@query(ask("climate cell | ratio:7", ERRORS_SQL, "SELECT climate, cell, CASE WHEN sum(err_a * err_a) > 0 THEN sqrt(sum(err_b * err_b)) / sqrt(sum(err_a * err_a)) ELSE -1 END AS ratio FROM errors GROUP BY climate, cell"))
def cell_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR14: the NaN mask of a cell ratio, shown as -1."""
    s = A.errors(spark, sf_dir).groupBy("climate", "cell").agg(F.sqrt(F.sum(F.col("err_b") ** 2)).alias("b"), F.sqrt(F.sum(F.col("err_a") ** 2)).alias("a"))
    return pick(s.select("climate", "cell", F.nanvl(S.masked_ratio("b", "a"), F.lit(-1.0)).alias("ratio")), "climate cell | ratio:7")


@query(ask("climate | mse_norm2:0 rmse_norm:3 rmse_K:2 mse_K2:0", ERRORS_SQL, f"SELECT climate, m AS mse_norm2, sqrt(m) AS rmse_norm, sqrt(m) * {S.TARGET_STD!r} AS rmse_K, m * {S.TARGET_STD * S.TARGET_STD!r} AS mse_K2 FROM (SELECT climate, avg(err_a * err_a) / 1e6 AS m FROM errors GROUP BY climate)"))
def unit_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR11: physical columns derived from the names of normalised ones."""
    s = A.errors(spark, sf_dir).groupBy("climate").agg((F.avg(F.col("err_a") ** 2) / 1e6).alias("mse_norm2")).withColumn("rmse_norm", F.sqrt("mse_norm2"))
    return pick(s.withColumns(S.unit_columns(s.columns)), "climate | mse_norm2:0 rmse_norm:3 rmse_K:2 mse_K2:0")


@query(ask("climate | angle:4", DAILY_SQL, "SELECT climate, degrees(acos(greatest(-1, least(1, sum(a_e2 * b_e2) / (sqrt(sum(a_e2 * a_e2)) * sqrt(sum(b_e2 * b_e2))))))) AS angle FROM daily GROUP BY climate"))
def series_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR15."""
    s = A.daily(spark, sf_dir).groupBy("climate").agg(F.sum(F.col("a_e2") * F.col("b_e2")).alias("ab"), F.sum(F.col("a_e2") ** 2).alias("aa"), F.sum(F.col("b_e2") ** 2).alias("bb"))
    return pick(s.select("climate", S.vector_angle("ab", "aa", "bb").alias("angle")), "climate | angle:4")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR21."""
    return A.table(spark, sf_dir, "documents").select("doc_id", S.sha256("text").alias("digest"))


@query(ask("climate | err_sum:1 correction_sum:1 required_sum:1", ERRORS_SQL, "SELECT climate, sum(pred_b - target) AS err_sum, sum(pred_b - base) AS correction_sum, sum(target - base) AS required_sum FROM errors GROUP BY climate"))
def error_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR10, PR12, PR13."""
    e = A.errors(spark, sf_dir)
    return pick(e.groupBy("climate").agg(F.sum(F.col("pred_b") - F.col("target")).alias("err_sum"), F.sum(F.col("pred_b") - F.col("base")).alias("correction_sum"), F.sum(F.col("target") - F.col("base")).alias("required_sum")), "climate | err_sum:1 correction_sum:1 required_sum:1")


# --- FI: filters


@query(ask("day cell | target:6", FIELD_SQL, "SELECT day, cell, target FROM field WHERE day BETWEEN DATE '1996-02-20' AND DATE '1996-03-05' AND NOT leap_day"))
def date_range_without_leap_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI4, FI5: the date range is filtered before the aggregate."""
    f = A.field(spark, sf_dir).where("day between date '1996-02-20' and date '1996-03-05' and not leap_day")
    return pick(f, "day cell | target:6")


@query(ask("inside n | a_rmse:3", ERRORS_SQL, f"SELECT abs(lat) <= {masks.BELT} AS inside, count(*) AS n, sqrt(sum(w * err_a * err_a) / sum(w)) AS a_rmse FROM errors GROUP BY 1"))
def belt_and_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI6."""
    e = A.errors(spark, sf_dir).withColumn("inside", F.abs("lat") <= masks.BELT)
    return pick(e.groupBy("inside").agg(F.count("*").alias("n"), F.sqrt(metrics.wsum(F.col("err_a") ** 2) / F.sum("w")).alias("a_rmse")), "inside n | a_rmse:3")


@query(ask("cell row col n | target:2", f"{ERRORS_SQL}, e AS (SELECT CAST(i AS INTEGER) AS k, -90 + i * 11.25::DOUBLE AS edge FROM range(17) t(i)), lo AS (SELECT min_by(edge, (abs(edge + 31), k)) AS x FROM e), hi AS (SELECT min_by(edge, (abs(edge - 47), k)) AS x FROM e)", "SELECT cell, row, col, count(*) AS n, avg(target) AS target FROM errors, lo, hi WHERE lat > lo.x AND lat < hi.x AND col BETWEEN 3 AND 9 GROUP BY cell, row, col"))
def window_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI7, FI8: all daily values in a latitude window snapped to the nearest cell edges, cell by cell."""
    e = spark.range(A.ROWS + 1).select(F.col("id").alias("k"), (F.lit(-90.0) + F.col("id") * 11.25).alias("edge"))
    snap = e.agg(*[F.min_by("edge", F.struct(F.abs(F.col("edge") - v).alias("d"), "k")).alias(n) for n, v in (("lo", -31.0), ("hi", 47.0))])
    g = A.errors(spark, sf_dir).where(F.col("col").between(3, 9)).crossJoin(F.broadcast(snap))  # one row
    inside = g.where((F.col("lat") > F.col("lo")) & (F.col("lat") < F.col("hi")))
    return pick(inside.groupBy("cell", "row", "col").agg(F.count("*").alias("n"), F.avg("target").alias("target")), "cell row col n | target:2")


# --- JO: joins that the aggregates above don't show


@query(ask("day_idx day_pd day_ssp | ratio:4", DAILY_SQL, "SELECT p.day_idx, p.day AS day_pd, s.day AS day_ssp, s.a_e2 / s.w / (p.a_e2 / p.w) AS ratio FROM daily p JOIN daily s ON p.day_idx = s.day_idx AND p.climate = 'pd' AND s.climate = 'ssp' WHERE p.a_e2 > 0"))
def positional_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO8: days of two climates paired by their place, not by date."""
    d = A.daily(spark, sf_dir)
    p = d.where("climate = 'pd' and a_e2 > 0").select("day_idx", F.col("day").alias("day_pd"), (F.col("a_e2") / F.col("w")).alias("p"))
    s = d.where("climate = 'ssp'").select("day_idx", F.col("day").alias("day_ssp"), (F.col("a_e2") / F.col("w")).alias("s"))
    return pick(p.join(s, "day_idx").withColumn("ratio", F.col("s") / F.col("p")), "day_idx day_pd day_ssp | ratio:4")


@query(f"WITH {DAILY_SQL}, x AS (SELECT CAST(unnest(range(DATE '1996-12-20', DATE '1998-12-20', INTERVAL 1 DAY)) AS DATE) AS day), h AS (SELECT day FROM daily WHERE climate = 'mh') SELECT coalesce(x.day, h.day) AS day, CASE WHEN h.day IS NULL THEN 'missing' ELSE 'unexpected' END AS state FROM x FULL JOIN h ON x.day = h.day WHERE x.day IS NULL OR h.day IS NULL")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO9, JO17: expected days that no shard has (left anti), and days that none expects. The expected range is twelve days
    early, so both kinds occur."""
    want = spark.range(1).select(F.explode(F.sequence(F.lit("1996-12-20").cast("date"), F.lit("1998-12-19").cast("date"))).alias("day"))
    have = A.daily(spark, sf_dir).where("climate = 'mh'").select("day")
    lost = want.join(have, "day", "left_anti").withColumn("state", F.lit("missing"))
    return lost.union(have.join(want, "day", "left_anti").withColumn("state", F.lit("unexpected")))


@query(f"WITH {DAILY_SQL}, v AS (SELECT unnest([100.0, 700.5, 5000.0]::DOUBLE[]) AS v), c AS (SELECT v, day, sqrt(b_e2 / w) AS r FROM daily, v WHERE climate = 'mh') SELECT CAST(v AS DOUBLE) AS v, day FROM (SELECT v, day, row_number() OVER (PARTITION BY v ORDER BY abs(floor(r * 100 + 0.5) / 100 - v), day) AS k FROM c) WHERE k = 1")
def nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO12, SO10: the day whose rmse is nearest to each wanted value."""
    wanted = F.explode(F.array(*[F.lit(v) for v in (100.0, 700.5, 5000.0)])).alias("v")
    d = A.daily(spark, sf_dir).where("climate = 'mh'").select("day", S.quantize(F.sqrt(F.col("b_e2") / F.col("w")), 2).alias("r"), wanted)
    return d.groupBy("v").agg(F.min_by("day", F.struct(F.abs(F.col("r") - F.col("v")).alias("d"), "day")).alias("day"))


@query("WITH t AS (SELECT p_partkey, p_retailprice % 179 - 89.5 AS v FROM part), s AS (SELECT CAST(i AS INTEGER) AS j, -90 + (i + 0.5::DOUBLE) * 11.25::DOUBLE AS lat FROM range(16) x(i)) SELECT p_partkey, CAST(least(greatest((SELECT count(*) FROM s WHERE lat < v) - 2, 0), 12) AS INTEGER) AS base FROM t")
def bracketing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO13: the first of the four rows around a latitude, ends clamped; a regular grid needs no join."""
    v = F.col("p_retailprice") % 179 - 89.5
    below = F.greatest(F.ceil((v + 90.0) / 11.25 - 0.5), F.lit(0))
    return A.table(spark, sf_dir, "part").select("p_partkey", F.least(F.greatest(below - 2, F.lit(0)), F.lit(12)).cast("int").alias("base"))


@query("SELECT label AS population, n, CAST(kx AS INTEGER) AS kx, CAST(ky AS INTEGER) AS ky, CAST(r AS INTEGER) AS r FROM (SELECT label, count(*) AS n, max(len(embedding)) // 2 AS width FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label), (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS kx), (SELECT unnest([2, 8, 32]) AS ky), (SELECT unnest([1, 2, 8, 16, 32]) AS r) WHERE r <= least(kx, ky) AND kx <= least(width, n - 1)")
def grid_row_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI13: for each population, the settings that its training days allow: no more scores than there are, fewer than days, and
    no rank above the scores."""
    x = A.table(spark, sf_dir, "embeddings").where("vec_id % 5 <> 0").groupBy(F.col("label").alias("population"))
    x = x.agg(F.count("*").alias("n"), F.floor(F.max(F.size("embedding")) / 2).alias("width"))
    for n, v in (("kx", (1, 2, 4, 8, 16, 32, 64)), ("ky", (2, 8, 32)), ("r", (1, 2, 8, 16, 32))):
        x = x.withColumn(n, F.explode(F.array(*[F.lit(k) for k in v])))
    return x.where((F.col("r") <= F.least("kx", "ky")) & (F.col("kx") <= F.least("width", F.col("n") - 1))).select("population", "n", "kx", "ky", "r")


@query(f"WITH {DAILY_SQL} SELECT climate, day, year(day) % 2 = 0 AS even_year FROM (SELECT climate, day, row_number() OVER (PARTITION BY climate, year(day) ORDER BY day) AS k FROM daily) WHERE k % 2 = 1")
def every_other_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI14."""
    d = A.daily(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("climate", F.year("day")).orderBy("day")))
    return d.where("k % 2 = 1").select("climate", "day", (F.year("day") % 2 == 0).alias("even_year"))


@query(f"WITH {DAILY_SQL} SELECT climate, season, day FROM (SELECT *, row_number() OVER (PARTITION BY climate, season ORDER BY md5(CAST(day AS VARCHAR))) AS k FROM daily) WHERE k <= 10 + CASE season WHEN 'DJF' THEN 1 WHEN 'MAM' THEN 1 ELSE 0 END")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI15: 42 days a climate without replacement, the remainder to the first seasons; the order is by hash."""
    d = A.daily(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("climate", "season").orderBy(F.md5(F.col("day").cast("string").cast("binary")))))
    return d.where(F.col("k") <= 10 + F.col("season").isin("DJF", "MAM").cast("int")).select("climate", "season", "day")


@query(ask("climate | scale:9", ERRORS_SQL, f"SELECT climate, {S.TARGET_STD!r} / sqrt(sum(w)) AS scale FROM errors GROUP BY climate"))
def coefficient_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR19: what takes scores of weighted anomalies to physical units."""
    return pick(A.errors(spark, sf_dir).groupBy("climate").agg((F.lit(S.TARGET_STD) / F.sqrt(F.sum("w"))).alias("scale")), "climate | scale:9")
