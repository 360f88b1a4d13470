"""Bootstrap, transfer and sensitivity queries of 10,000 replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import adapters as A
from fieldloom.operators import bootstrap as B
from fieldloom.operators import distributions as D
from fieldloom.operators import masks, metrics
from fieldloom.operators.adapters import DAILY_SQL, ERRORS_SQL

from .distributions import _MAP_SQL, quantile_sql, rmse_map
from .registry import ask, pick, query

REPS = 10_000
_STARTS = """SELECT *, (x * x % 2147483647) % n AS start FROM (SELECT *, ((y * y % 2147483647) * 16807) % 2147483647 + 1 AS x FROM (SELECT *, ((rep * 19 + blk + 20260715) * 48271) % 2147483647 AS y FROM
 (SELECT *, unnest(range(CAST(ceil(n * 1.0 / len) AS BIGINT))) AS blk FROM (SELECT *, unnest(range({reps})) AS rep FROM (SELECT *, least({block}, n) AS len FROM {sizes})))))"""


def starts_sql(sizes: str, block: str = "60", reps: int = REPS) -> str:
    return _STARTS.format(sizes=sizes, block=block, reps=reps)


def sums_sql(columns: list[str], by: str = "climate", daily: str = "daily", starts: str = "starts", extra: str = "") -> str:
    """The SQL twin of block_sums: tables twice, pre and sums."""
    names, keys = ", ".join(columns), by.split(", ")
    lo = ", ".join(f"coalesce(sum({c}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {c}_lo, sum({c}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}_hi" for c in columns)
    on = lambda t: " AND ".join(f"{t}.{k} = s.{k}" for k in keys)
    total = ", ".join(f"sum(z.{c}_hi - a.{c}_lo) AS {c}" for c in columns)
    groups = ", ".join(f"s.{k}" for k in [*keys, *(extra.split(", ") if extra else [])])
    return f"""twice AS (SELECT {by}, day_idx AS k, {names} FROM {daily} UNION ALL SELECT {by}, day_idx + count(*) OVER (PARTITION BY {by}), {names} FROM {daily}),
pre AS (SELECT {by}, k, {lo.replace("(w ROWS", f"(PARTITION BY {by} ORDER BY k ROWS")} FROM twice),
sums AS (SELECT {groups}, s.rep, {total} FROM {starts} s JOIN pre a ON {on("a")} AND a.k = s.start JOIN pre z ON {on("z")} AND z.k = s.start + least(s.len, s.n - s.blk * s.len) - 1 GROUP BY ALL)"""


_PLAIN = f"{DAILY_SQL}, sizes AS (SELECT climate, count(*) AS n FROM daily GROUP BY climate), starts AS ({starts_sql('sizes')}), {sums_sql(['w', 'base_e2', 'a_e2', 'b_e2'])}"
_PAIRED = "*, sqrt(base_e2 / w) AS base_rmse, sqrt(a_e2 / w) AS a_rmse, sqrt(b_e2 / w) AS b_rmse, sqrt(a_e2 / w) - sqrt(b_e2 / w) AS delta_rmse, 1 - a_e2 / base_e2 AS a_skill_mse, 1 - b_e2 / base_e2 AS b_skill_mse, 1 - sqrt(a_e2 / w) / sqrt(base_e2 / w) AS a_skill, 1 - sqrt(b_e2 / w) / sqrt(base_e2 / w) AS b_skill, 1 - b_e2 / a_e2 AS b_vs_a_mse, 1 - sqrt(b_e2 / w) / sqrt(a_e2 / w) AS b_vs_a"
_QUANTITIES = ("base_rmse", "a_rmse", "b_rmse", "delta_rmse", "a_skill_mse", "b_skill_mse", "a_skill", "b_skill", "b_vs_a_mse", "b_vs_a")
_DIGITS = {n: 2 if n.endswith("rmse") else 6 for n in _QUANTITIES}
SUMS = ["w", "base_e2", "a_e2", "b_e2"]


def _sizes(d: DataFrame, by: list[str]) -> DataFrame:
    return d.groupBy(*by).agg(F.count("*").alias("n"))


def _replicates(spark: SparkSession, sf_dir: str, block: int = B.BLOCK) -> DataFrame:
    d = A.daily(spark, sf_dir)
    return B.paired_metrics(B.block_sums(d, B.block_starts(_sizes(d, ["climate"]), REPS, block), ["climate"], SUMS))


@query(f"WITH {DAILY_SQL}, sizes AS (SELECT climate, count(*) AS n FROM daily GROUP BY climate) SELECT climate, rep, blk, start FROM ({starts_sql('sizes')})")
def block_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO1, BO4, D17: the compact table of starts."""
    return B.block_starts(_sizes(A.daily(spark, sf_dir), ["climate"]), REPS).select("climate", "rep", "blk", "start")


_SPEC = "climate rep | " + " ".join(f"{n}:{d}" for n, d in _DIGITS.items())


@query(ask(_SPEC, _PLAIN, f"SELECT {_PAIRED} FROM sums"))
def paired_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO2, JO10: ten quantities a replicate."""
    return pick(_replicates(spark, sf_dir), _SPEC)


@query()
def generator_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO3, BO4: intervals from the starts of one NumPy generator, drawn for pd, mh and ssp in that order."""
    d = A.daily(spark, sf_dir)
    held = {r.climate: r.n for r in _sizes(d, ["climate"]).collect()}
    starts = B.generator_starts(spark, {c: held[c] for c in A.CLIMATES if c in held}, REPS)
    s = B.paired_metrics(B.block_sums(d, starts, ["climate"], SUMS))
    return pick(s.groupBy("climate").agg(*[c for n in _QUANTITIES for c in B.interval(n)]), _CI)


_CI = "climate | " + " ".join(f"{n}_lo:{d} {n}_hi:{d}" for n, d in _DIGITS.items())
_CI_SQL = ", ".join(f"quantile_cont({n}, 0.025) AS {n}_lo, quantile_cont({n}, 0.975) AS {n}_hi" for n in _QUANTITIES)


@query(ask(_CI, _PLAIN, f"SELECT climate, {_CI_SQL} FROM (SELECT {_PAIRED} FROM sums) GROUP BY climate"))
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO3."""
    return pick(_replicates(spark, sf_dir).groupBy("climate").agg(*[c for n in _QUANTITIES for c in B.interval(n)]), _CI)


@query(ask("climate block | delta_rmse_lo:2 delta_rmse_hi:2", f"{DAILY_SQL}, sizes AS (SELECT climate, count(*) AS n, unnest([30, 45, 60, 90]) AS block FROM daily GROUP BY climate), starts AS ({starts_sql('sizes', 'block')}), {sums_sql(['w', 'a_e2', 'b_e2'], extra='block')}, r AS (SELECT climate, block, rep, sqrt(a_e2 / w) - sqrt(b_e2 / w) AS d FROM sums)", "SELECT climate, block, quantile_cont(d, 0.025) AS delta_rmse_lo, quantile_cont(d, 0.975) AS delta_rmse_hi FROM r GROUP BY ALL"))
def block_length_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO7: four block lengths in one job."""
    d = A.daily(spark, sf_dir)
    sizes = _sizes(d, ["climate"]).withColumn("block", F.explode(F.array(*[F.lit(b) for b in (30, 45, 60, 90)])))
    sums = B.block_sums(d, B.block_starts(sizes, REPS, F.col("block")), ["climate"], SUMS, ["block"])
    return pick(B.paired_metrics(sums).groupBy("climate", "block").agg(*B.interval("delta_rmse")), "climate block | delta_rmse_lo:2 delta_rmse_hi:2")


_SEASONAL = f"{DAILY_SQL}, sd AS (SELECT * REPLACE (row_number() OVER (PARTITION BY climate, season ORDER BY day) - 1 AS day_idx) FROM daily), sizes AS (SELECT climate, season, count(*) AS n FROM sd GROUP BY ALL), starts AS ({starts_sql('sizes')}), {sums_sql(['w', 'b_e2'], 'climate, season', 'sd')}"


@query(ask("climate | b_rmse_lo:2 b_rmse_hi:2", _SEASONAL, "SELECT climate, quantile_cont(x, 0.025) AS b_rmse_lo, quantile_cont(x, 0.975) AS b_rmse_hi FROM (SELECT climate, rep, sqrt(sum(b_e2) / sum(w)) AS x FROM sums GROUP BY ALL) GROUP BY climate"))
def seasonal_block_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO5: blocks within each season, whose day counts stay as observed."""
    from pyspark.sql import Window

    d = A.daily(spark, sf_dir)
    d = d.withColumn("day_idx", F.row_number().over(Window.partitionBy("climate", "season").orderBy("day")) - 1)
    s = B.block_sums(d, B.block_starts(_sizes(d, ["climate", "season"]), REPS), ["climate", "season"], ["w", "b_e2"])
    s = s.groupBy("climate", "rep").agg(F.sqrt(F.sum("b_e2") / F.sum("w")).alias("b_rmse"))
    return pick(s.groupBy("climate").agg(*B.interval("b_rmse")), "climate | b_rmse_lo:2 b_rmse_hi:2")


_ALIGNED = f"""{DAILY_SQL}, sizes AS (SELECT climate, count(*) AS n FROM daily GROUP BY climate), drawn AS ({starts_sql('sizes')}), m AS (SELECT climate, day_idx, month(day) AS month, row_number() OVER (PARTITION BY climate, month(day) ORDER BY day_idx) - 1 AS place, count(*) OVER (PARTITION BY climate, month(day)) AS held FROM daily),
starts AS (SELECT d.climate, d.n, d.len, d.rep, d.blk, h.day_idx AS start FROM drawn d JOIN m o ON o.climate = d.climate AND o.day_idx = (d.blk * 60) % d.n JOIN m h ON h.climate = d.climate AND h.month = o.month AND h.place = (d.x * d.x % 2147483647) % o.held), {sums_sql(['w', 'b_e2'])}"""


@query(ask("climate | b_rmse_lo:2 b_rmse_hi:2", _ALIGNED, "SELECT climate, quantile_cont(x, 0.025) AS b_rmse_lo, quantile_cont(x, 0.975) AS b_rmse_hi FROM (SELECT climate, rep, sqrt(b_e2 / w) AS x FROM sums) GROUP BY climate"))
def season_aligned_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO6: each block begins on a day of the month that its place has."""
    d = A.daily(spark, sf_dir)
    starts = B.season_aligned_starts(d.select("climate", "day_idx", F.month("day").alias("month")), REPS)
    s = B.paired_metrics(B.block_sums(d, starts, ["climate"], SUMS))
    return pick(s.groupBy("climate").agg(*B.interval("b_rmse")), "climate | b_rmse_lo:2 b_rmse_hi:2")


@query(ask("climate excludes_zero n_bad | lo:2 hi:2 median:2 sd:2 p_above:6", f"{_PLAIN}, r AS (SELECT {_PAIRED} FROM sums), d AS (SELECT c.climate, c.rep, c.delta_rmse - p.delta_rmse AS x FROM r c JOIN r p ON p.climate = 'pd' AND p.rep = c.rep AND c.climate <> 'pd')", "SELECT climate, lo > 0 OR hi < 0 AS excludes_zero, n_bad, lo, hi, median, sd, p_above FROM (SELECT climate, CAST(0 AS BIGINT) AS n_bad, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, median(x) AS median, stddev_samp(x) AS sd, avg(CAST(x > 0 AS INTEGER)) AS p_above FROM d GROUP BY climate)"))
def climate_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO9, BO10: differences across climates (unpaired draws, joined by replicate) with the comparison record."""
    r = _replicates(spark, sf_dir)
    p = r.where("climate = 'pd'").select("rep", F.col("delta_rmse").alias("p"))
    d = r.where("climate <> 'pd'").join(p, "rep").withColumn("x", F.col("delta_rmse") - F.col("p"))
    return pick(B.comparison(d, ["climate"], "x"), "climate excludes_zero n_bad | lo:2 hi:2 median:2 sd:2 p_above:6")


@query(ask("climate | a_change:4 b_change:4 transfer:4 transfer_lo:4 transfer_hi:4", f"{_PLAIN}, r AS (SELECT {_PAIRED} FROM sums), o AS (SELECT climate, 1 - sqrt(sum(a_e2)) / sqrt(sum(base_e2)) AS sa, 1 - sqrt(sum(b_e2)) / sqrt(sum(base_e2)) AS sb FROM daily GROUP BY climate), t AS (SELECT c.climate, 100 * ((c.b_skill - p.b_skill) - (c.a_skill - p.a_skill)) AS t FROM r c JOIN r p ON p.climate = 'pd' AND p.rep = c.rep AND c.climate <> 'pd')", "SELECT c.climate, any_value(100 * (c.sa - p.sa)) AS a_change, any_value(100 * (c.sb - p.sb)) AS b_change, any_value(100 * ((c.sb - p.sb) - (c.sa - p.sa))) AS transfer, quantile_cont(t, 0.025) AS transfer_lo, quantile_cont(t, 0.975) AS transfer_hi FROM o c JOIN o p ON p.climate = 'pd' JOIN t ON t.climate = c.climate GROUP BY c.climate"))
def skill_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR1, TR7: changes of the rmse skill in percentage points, and how differently the two predictions transfer."""
    r = _replicates(spark, sf_dir).select("climate", "rep", "a_skill", "b_skill")
    p = r.where("climate = 'pd'").select("rep", F.col("a_skill").alias("pa"), F.col("b_skill").alias("pb"))
    t = r.where("climate <> 'pd'").join(p, "rep").withColumn("transfer", 100 * ((F.col("b_skill") - F.col("pb")) - (F.col("a_skill") - F.col("pa"))))
    ci = t.groupBy("climate").agg(*B.interval("transfer"))
    o = A.daily(spark, sf_dir).groupBy("climate").agg(*[(1 - F.sqrt(F.sum(f"{m}_e2")) / F.sqrt(F.sum("base_e2"))).alias(f"s{m}") for m in ("a", "b")])
    op = o.where("climate = 'pd'").select(F.col("sa").alias("pa"), F.col("sb").alias("pb"))
    c = o.where("climate <> 'pd'").crossJoin(F.broadcast(op)).select("climate", (100 * (F.col("sa") - F.col("pa"))).alias("a_change"), (100 * (F.col("sb") - F.col("pb"))).alias("b_change"))
    return pick(c.join(ci, "climate").withColumn("transfer", F.col("b_change") - F.col("a_change")), "climate | a_change:4 b_change:4 transfer:4 transfer_lo:4 transfer_hi:4")


_STAT = f"{ERRORS_SQL}, {_MAP_SQL}, st AS (SELECT c.climate, c.cell, c.w, p.rmse_b / nullif(p.rmse_a, 0) - c.rmse_b / nullif(c.rmse_a, 0) AS stat, c.rmse_b > c.rmse_a AS worse FROM map c JOIN map p ON p.climate = 'pd' AND p.cell = c.cell AND c.climate <> 'pd')"


def _stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rmse_map(spark, sf_dir)
    p = m.where("climate = 'pd'").select("cell", F.try_divide("rmse_b", F.nullif(F.col("rmse_a"), F.lit(0.0))).alias("before"))
    now = F.try_divide("rmse_b", F.nullif(F.col("rmse_a"), F.lit(0.0)))
    return m.where("climate <> 'pd'").join(p, "cell").select("climate", "cell", "w", (F.col("before") - now).alias("stat"), (F.col("rmse_b") > F.col("rmse_a")).alias("worse"))


@query(ask("climate n_cells n_used n_worse n_negative | min:6 max:6", _STAT, "SELECT climate, count(*) AS n_cells, count(stat) AS n_used, count(*) FILTER (stat IS NOT NULL AND worse) AS n_worse, count(*) FILTER (stat <= 0) AS n_negative, min(stat) AS min, max(stat) AS max FROM st GROUP BY climate"))
def cell_transfer_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR2: ratio before minus ratio now, with its mask and counts."""
    s = _stat(spark, sf_dir).groupBy("climate").agg(F.count("*").alias("n_cells"), F.count("stat").alias("n_used"), F.count_if(F.col("stat").isNotNull() & F.col("worse")).alias("n_worse"), F.count_if(F.col("stat") <= 0).alias("n_negative"), F.min("stat").alias("min"), F.max("stat").alias("max"))
    return pick(s, "climate n_cells n_used n_worse n_negative | min:6 max:6")


@query(ask("climate cell | stat:6", _STAT, "SELECT climate, cell, stat FROM st WHERE stat <= 0"))
def negative_transfer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO11: all cells whose transfer isn't positive, the worst first."""
    return pick(_stat(spark, sf_dir).where("stat <= 0"), "climate cell | stat:6").orderBy("stat", "climate", "cell")


@query(ask("climate | quantile:6", f"{_STAT}, ab AS (SELECT climate, cell, w, floor(abs(stat) * 1e8 + 0.5) / 1e8 AS v FROM st WHERE stat IS NOT NULL)", quantile_sql("ab", "climate", "v", 0.99)))
def transfer_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR3."""
    s = _stat(spark, sf_dir).where("stat is not null").withColumn("v", F.floor(F.abs("stat") * 1e8 + 0.5) / 1e8)
    return pick(D.weighted_quantiles(s, ["climate"], "v", "cell", 0.99), "climate | quantile:6")


@query(ask("climate season | change:7", ERRORS_SQL, "SELECT c.climate, c.season, c.s - p.s AS change FROM (SELECT climate, season, 1 - sqrt(sum(w * err_b * err_b)) / sqrt(sum(w * err_a * err_a)) AS s FROM errors GROUP BY ALL) c JOIN (SELECT season, 1 - sqrt(sum(w * err_b * err_b)) / sqrt(sum(w * err_a * err_a)) AS s FROM errors WHERE climate = 'pd' GROUP BY ALL) p USING (season) WHERE c.climate <> 'pd'"))
def skill_change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR4, JO7: skill changes from the mean-square table, by season."""
    s = A.errors(spark, sf_dir).groupBy("climate", "season").agg((1 - F.sqrt(metrics.wsum(F.col("err_b") ** 2)) / F.sqrt(metrics.wsum(F.col("err_a") ** 2))).alias("s"))
    p = s.where("climate = 'pd'").select("season", F.col("s").alias("p"))
    return pick(s.where("climate <> 'pd'").join(p, "season").withColumn("change", F.col("s") - F.col("p")), "climate season | change:7")


def _weighted_sql(name: str, x: str, y: str) -> str:
    m = f"(SELECT climate AS k, sum(w * {x}) / sum(w) AS mx, sum(w * {y}) / sum(w) AS my FROM j GROUP BY 1)"
    return f"{name} AS (SELECT climate, corr({x}, {y}) AS plain, sum(w * ({x} - mx) * ({y} - my)) / sqrt(sum(w * ({x} - mx) * ({x} - mx)) * sum(w * ({y} - my) * ({y} - my))) AS weighted FROM j JOIN {m} ON k = climate GROUP BY climate)"


_BOTH = f"""{ERRORS_SQL}, {_MAP_SQL}, j AS (SELECT *, rank() OVER (PARTITION BY climate ORDER BY x) + (count(*) OVER (PARTITION BY climate, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY climate ORDER BY y) + (count(*) OVER (PARTITION BY climate, y) - 1) / 2.0 AS ry
 FROM (SELECT c.climate, c.w, c.rmse_b AS x, p.rmse_b AS y FROM map c JOIN map p ON p.climate = 'pd' AND p.cell = c.cell AND c.climate <> 'pd')), {_weighted_sql("p", "x", "y")}, {_weighted_sql("s", "rx", "ry")}"""


@query(ask("climate | pearson:7 weighted:7 spearman:7 weighted_spearman:7", _BOTH, "SELECT climate, p.plain AS pearson, p.weighted, s.plain AS spearman, s.weighted AS weighted_spearman FROM p JOIN s USING (climate)"))
def map_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR6: Pearson and Spearman, each plain and weighted by area, of each climate's map with the pd map."""
    m = rmse_map(spark, sf_dir)
    j = m.where("climate <> 'pd'").select("climate", "cell", "w", F.col("rmse_b").alias("x")).join(m.where("climate = 'pd'").select("cell", F.col("rmse_b").alias("y")), "cell")
    j = D.average_ranks(D.average_ranks(j, ["climate"], "x", "rx"), ["climate"], "y", "ry")
    out = j.groupBy("climate").agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    for x, y, name in (("x", "y", "weighted"), ("rx", "ry", "weighted_spearman")):
        out = out.join(metrics.weighted_correlation(j, ["climate"], x, y).select("climate", F.col("corr").alias(name)), "climate")
    return pick(out, "climate | pearson:7 weighted:7 spearman:7 weighted_spearman:7")


# --- sensitivity to a uniform shift: the error of d + delta * u is a quadratic in delta


_QUAD = f"{ERRORS_SQL}, quad AS (SELECT climate, day, sum(w) AS w, sum(w * err_a * err_a) AS dd, sum(w * err_a * (pred_a - base)) AS du, sum(w * (pred_a - base) * (pred_a - base)) AS uu FROM errors GROUP BY climate, day), shift AS (SELECT unnest(range(-12, 13)) * 0.5::DOUBLE AS delta)"


def _quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("pred_a") - F.col("base")
    return A.errors(spark, sf_dir).groupBy("climate", "day").agg(F.sum("w").alias("w"), metrics.wsum(F.col("err_a") ** 2).alias("dd"), metrics.wsum(F.col("err_a") * u).alias("du"), metrics.wsum(u * u).alias("uu"))




@query(ask("climate delta | rmse:2", _QUAD, "SELECT climate, delta, sqrt(greatest((sum(dd) + 2 * delta * sum(du) + delta * delta * sum(uu)) / sum(w), 0)) AS rmse FROM quad, shift GROUP BY climate, delta"))
def uniform_shift_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE1: 25 shifts from three sums, without another pass over the field."""
    deltas = F.explode(F.array(*[F.lit(k * 0.5) for k in range(-12, 13)])).alias("delta")
    s = _quadratic(spark, sf_dir).groupBy("climate").agg(*[F.sum(c).alias(c) for c in ("w", "dd", "du", "uu")]).select("*", deltas)
    d = F.col("delta")
    return pick(s.withColumn("rmse", F.sqrt(F.greatest((F.col("dd") + 2 * d * F.col("du") + d * d * F.col("uu")) / F.col("w"), F.lit(0.0)))), "climate delta | rmse:2")


@query(ask("climate delta | rmse_lo:2 rmse_hi:2", f"{_QUAD}, qd AS (SELECT *, row_number() OVER (PARTITION BY climate ORDER BY day) - 1 AS day_idx FROM quad), sizes AS (SELECT climate, count(*) AS n FROM qd GROUP BY climate), starts AS ({starts_sql('sizes')}), {sums_sql(['w', 'dd', 'du', 'uu'], daily='qd')}, r AS (SELECT climate, delta, sqrt(greatest((dd + 2 * delta * du + delta * delta * uu) / w, 0)) AS x FROM sums, shift)", "SELECT climate, delta, quantile_cont(x, 0.025) AS rmse_lo, quantile_cont(x, 0.975) AS rmse_hi FROM r GROUP BY ALL"))
def uniform_shift_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE3: all shifts share one set of replicates."""
    from pyspark.sql import Window

    quad = _quadratic(spark, sf_dir).withColumn("day_idx", F.row_number().over(Window.partitionBy("climate").orderBy("day")) - 1)
    s = B.block_sums(quad, B.block_starts(_sizes(quad, ["climate"]), REPS), ["climate"], ["w", "dd", "du", "uu"])
    d = F.col("delta")
    r = s.select("*", F.explode(F.array(*[F.lit(k * 0.5) for k in range(-12, 13)])).alias("delta")).withColumn("rmse", F.sqrt(F.greatest((F.col("dd") + 2 * d * F.col("du") + d * d * F.col("uu")) / F.col("w"), F.lit(0.0))))
    return pick(r.groupBy("climate", "delta").agg(*B.interval("rmse")), "climate delta | rmse_lo:2 rmse_hi:2")


@query(ask("climate method | alpha:8 aligned_mse:0 row_aligned_mse:0 stationary_mse:0", f"{ERRORS_SQL}, st AS (SELECT climate, cell, any_value(row) AS row, any_value(w) AS w, any_value(oro_m) AS t, avg(err_a) AS e_a, avg(err_b) AS e_b FROM errors GROUP BY climate, cell), m AS (SELECT climate, 'a' AS method, row, w, t, e_a AS e FROM st UNION ALL SELECT climate, 'b', row, w, t, e_b FROM st), rig AS (SELECT climate, method, sum(w * e * t) / sum(w * t * t) AS alpha, sum(w * t * t) AS tt, sum(w) AS ws, sum(w * e * e) / sum(w) AS stationary_mse FROM m GROUP BY ALL), rw AS (SELECT climate, method, row, any_value(w) AS w, sum(e * t) AS et, sum(t * t) AS tt FROM m GROUP BY ALL)", "SELECT climate, method, any_value(alpha) AS alpha, any_value(alpha * alpha * rig.tt / ws) AS aligned_mse, sum(rw.w * et * et / rw.tt) / any_value(ws) AS row_aligned_mse, any_value(stationary_mse) AS stationary_mse FROM rig JOIN rw USING (climate, method) GROUP BY ALL"))
def template_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA21, SE5: how much of the mean error a template (height) explains, rigidly and by latitude row."""
    st = A.errors(spark, sf_dir).groupBy("climate", "cell").agg(F.first("row").alias("row"), F.first("w").alias("w"), F.first("oro_m").alias("t"), F.avg("err_a").alias("a"), F.avg("err_b").alias("b"))
    m = st.select("climate", "row", "w", "t", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("a", "b"))).alias("method", "e"))
    e, t = F.col("e"), F.col("t")
    rows = m.groupBy("climate", "method", "row").agg(F.first("w").alias("wr"), F.sum(e * t).alias("et"), F.sum(t * t).alias("tt"), metrics.wsum(e * t).alias("wet"), metrics.wsum(t * t).alias("wtt"), metrics.wsum(e * e).alias("wee"), F.sum("w").alias("ws"))
    per = F.when(F.col("tt") > 0, F.col("wr") * F.col("et") * F.col("et") / F.col("tt")).otherwise(0.0)
    s = rows.groupBy("climate", "method").agg(*[F.sum(c).alias(c) for c in ("wet", "wtt", "wee", "ws")], F.sum(per).alias("per"))
    alpha = F.when(F.col("wtt") > 0, F.col("wet") / F.col("wtt")).otherwise(0.0)
    return pick(s.withColumns({"alpha": alpha, "aligned_mse": alpha * alpha * F.col("wtt") / F.col("ws"), "row_aligned_mse": F.col("per") / F.col("ws"), "stationary_mse": F.col("wee") / F.col("ws")}), "climate method | alpha:8 aligned_mse:0 row_aligned_mse:0 stationary_mse:0")


# --- SE5: what is left of the errors when a template is taken out of their mean


_PERIOD_SQL = "SELECT *, 'annual' AS period FROM errors UNION ALL SELECT *, season AS period FROM errors"
_ADJUST_SQL = f"""{ERRORS_SQL}, pe AS ({_PERIOD_SQL}), ce AS (SELECT climate, period, cell, count(*) AS n, avg(err_a) AS ea, avg(err_b) AS eb, sum(err_a * err_a) AS sa, sum(err_b * err_b) AS sb FROM pe GROUP BY ALL),
cg AS (SELECT ce.*, row, lat, lsm, oro_m, w FROM ce JOIN grid USING (cell)), cr AS ({masks.regions_sql("cg", masks.REGIONS + masks.DERIVED)}),
cm AS (SELECT *, 'a' AS method, ea AS e, sa AS s2 FROM cr UNION ALL SELECT *, 'b', eb, sb FROM cr),
rw AS (SELECT climate, period, region, method, row, any_value(w) AS wr, sum(e * oro_m) AS et, sum(oro_m * oro_m) AS tt, sum(w * e * oro_m) AS wet, sum(w * oro_m * oro_m) AS wtt, sum(w * e * e) AS wee, sum(w) AS ws, sum(w * s2) AS total, sum(w * n) AS wn FROM cm GROUP BY ALL),
rg AS (SELECT climate, period, region, method, sum(wet) / sum(wtt) AS alpha, sum(wet) * sum(wet) / sum(wtt) / sum(ws) AS rigid, sum(wr * et * et / tt) / sum(ws) AS by_row, sum(wee) / sum(ws) AS stationary, sum(total) / sum(wn) AS mse FROM rw GROUP BY ALL)"""
_ADJUST = "climate period region method | alpha:8 stationary_rms:2 rigid_rms:2 row_rms:2 rmse:2 rmse_rigid:2 rmse_row:2 skill:6 skill_rigid:6 skill_row:6"


@query(ask(_ADJUST, _ADJUST_SQL, "SELECT g.climate, g.period, g.region, g.method, g.alpha, sqrt(g.stationary) AS stationary_rms, sqrt(g.rigid) AS rigid_rms, sqrt(g.by_row) AS row_rms, sqrt(g.mse) AS rmse, sqrt(greatest(g.mse - g.rigid, 0)) AS rmse_rigid, sqrt(greatest(g.mse - g.by_row, 0)) AS rmse_row, 1 - g.mse / a.mse AS skill, 1 - greatest(g.mse - g.rigid, 0) / greatest(a.mse - a.rigid, 0) AS skill_rigid, 1 - greatest(g.mse - g.by_row, 0) / greatest(a.mse - a.by_row, 0) AS skill_row FROM rg g JOIN rg a ON a.method = 'a' AND a.climate = g.climate AND a.period = g.period AND a.region = g.region"))
def template_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE5: by climate, period, region and method: a template's coefficient in the mean error, rigid and by latitude row, and
    rmse and skill (against method a) with and without what it explains. Cells are summed once; regions roll up."""
    e = A.errors(spark, sf_dir).withColumn("period", F.explode(F.array(F.lit("annual"), "season")))
    sums = {f"{k}{m}": f(m) for m in "ab" for k, f in (("e", lambda m: F.avg(f"err_{m}")), ("s", lambda m: F.sum(F.col(f"err_{m}") ** 2)))}
    cells = e.groupBy("climate", "period", "cell").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])
    cells = masks.by_region(cells.join(F.broadcast(A.grid(spark)), "cell"), masks.REGIONS + masks.DERIVED)
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"e{m}").alias("e"), F.col(f"s{m}").alias("s2")) for m in "ab"])
    x, t, w = F.col("e"), F.col("oro_m"), F.col("w")
    by = ["climate", "period", "region", "method"]
    rows = cells.select("*", F.inline(methods)).groupBy(*by, "row").agg(F.first("w").alias("wr"), F.sum(x * t).alias("et"), F.sum(t * t).alias("tt"), F.sum(w * x * t).alias("wet"), F.sum(w * t * t).alias("wtt"), F.sum(w * x * x).alias("wee"), F.sum("w").alias("ws"), F.sum(w * F.col("s2")).alias("total"), F.sum(w * F.col("n")).alias("wn"))
    area = F.sum("ws")
    g = rows.groupBy(*by).agg((F.sum("wet") / F.sum("wtt")).alias("alpha"), (F.sum("wet") * F.sum("wet") / F.sum("wtt") / area).alias("rigid"), (F.sum(F.col("wr") * F.col("et") * F.col("et") / F.col("tt")) / area).alias("row"), (F.sum("wee") / area).alias("stationary"), (F.sum("total") / F.sum("wn")).alias("mse"))
    left = lambda c: F.greatest(F.col("mse") - F.col(c), F.lit(0.0))
    g = g.withColumns({"left_rigid": left("rigid"), "left_row": left("row")})
    ref = g.where("method = 'a'").select(*by[:3], *[F.col(c).alias(f"ref_{c}") for c in ("mse", "left_rigid", "left_row")])
    skills = {n: 1 - F.col(c) / F.col(f"ref_{c}") for n, c in (("skill", "mse"), ("skill_rigid", "left_rigid"), ("skill_row", "left_row"))}
    roots = {n: F.sqrt(c) for n, c in (("stationary_rms", "stationary"), ("rigid_rms", "rigid"), ("row_rms", "row"), ("rmse", "mse"), ("rmse_rigid", "left_rigid"), ("rmse_row", "left_row"))}
    return pick(g.join(ref, by[:3]).withColumns(roots | skills), _ADJUST)


_ADJUSTED_SQL = f"""{ERRORS_SQL}, st AS (SELECT climate, cell, any_value(row) AS row, any_value(w) AS w, any_value(oro_m) AS t, avg(err_a) AS ea, avg(err_b) AS eb FROM errors GROUP BY climate, cell),
rigid AS (SELECT climate, sum(w * ea * t) / sum(w * t * t) AS ra, sum(w * eb * t) / sum(w * t * t) AS rb FROM st GROUP BY climate),
prof AS (SELECT climate, row, sum(ea * t) / sum(t * t) AS pa, sum(eb * t) / sum(t * t) AS pb FROM st GROUP BY climate, row),
dr AS (SELECT climate, day, row, sum(w) AS w, sum(w * err_a * err_a) AS a2, sum(w * err_b * err_b) AS b2, sum(w * err_a * oro_m) AS a_t, sum(w * err_b * oro_m) AS b_t, sum(w * oro_m * oro_m) AS tt FROM errors GROUP BY ALL),
adj AS (SELECT climate, day, row_number() OVER (PARTITION BY climate ORDER BY day) - 1 AS day_idx, sum(w) AS w, sum(a2) AS a_e2, sum(b2) AS b_e2, sum(a2 - 2 * ra * a_t + ra * ra * tt) AS a_rigid, sum(b2 - 2 * rb * b_t + rb * rb * tt) AS b_rigid,
 sum(a2 - 2 * pa * a_t + pa * pa * tt) AS a_row, sum(b2 - 2 * pb * b_t + pb * pb * tt) AS b_row FROM dr JOIN rigid USING (climate) JOIN prof USING (climate, row) GROUP BY climate, day)"""
_SERIES = ("a_e2", "b_e2", "a_rigid", "b_rigid", "a_row", "b_row")


def adjusted_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of squares, as they are and with the template taken out: d - 2 alpha (e.T) + alpha**2 (T.T)."""
    e = A.errors(spark, sf_dir)
    t = F.col("oro_m")
    cells = e.groupBy("climate", "cell").agg(F.first("row").alias("row"), F.first("w").alias("w"), F.first("oro_m").alias("oro_m"), F.avg("err_a").alias("ea"), F.avg("err_b").alias("eb"))
    rigid = cells.groupBy("climate").agg(*[(metrics.wsum(F.col(f"e{m}") * t) / metrics.wsum(t * t)).alias(f"rigid_{m}") for m in "ab"])
    profile = cells.groupBy("climate", "row").agg(*[(F.sum(F.col(f"e{m}") * t) / F.sum(t * t)).alias(f"row_{m}") for m in "ab"])
    dots = [c for m in "ab" for c in (metrics.wsum(F.col(f"err_{m}") ** 2).alias(f"{m}2"), metrics.wsum(F.col(f"err_{m}") * t).alias(f"{m}t"))]
    rows = e.groupBy("climate", "day", "row").agg(F.sum("w").alias("w"), *dots, metrics.wsum(t * t).alias("tt")).join(rigid, "climate").join(profile, ["climate", "row"])
    out = lambda m, kind: F.sum(F.col(f"{m}2") - 2 * F.col(f"{kind}_{m}") * F.col(f"{m}t") + F.col(f"{kind}_{m}") ** 2 * F.col("tt")).alias(f"{m}_{kind}")
    return rows.groupBy("climate", "day").agg(F.sum("w").alias("w"), *[F.sum(f"{m}2").alias(f"{m}_e2") for m in "ab"], *[out(m, k) for k in ("rigid", "row") for m in "ab"])


@query(ask("climate day | " + " ".join(f"{c}:0" for c in _SERIES), _ADJUSTED_SQL, "SELECT * FROM adj"))
def template_adjusted_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE5: the adjusted daily series."""
    return pick(adjusted_daily(spark, sf_dir), "climate day | " + " ".join(f"{c}:0" for c in _SERIES))


_KINDS = ("e2", "rigid", "row")
_ADJ_CI = "climate kind | delta_rmse_lo:2 delta_rmse_hi:2 skill_lo:6 skill_hi:6"
_KIND_SQL = " UNION ALL ".join(f"SELECT climate, rep, '{k}' AS kind, sqrt(a_{k} / w) - sqrt(b_{k} / w) AS d, 1 - b_{k} / a_{k} AS s FROM sums" for k in _KINDS)


@query(ask(_ADJ_CI, f"{_ADJUSTED_SQL}, sizes AS (SELECT climate, count(*) AS n FROM adj GROUP BY climate), starts AS ({starts_sql('sizes')}), {sums_sql(['w', *_SERIES], daily='adj')}, r AS ({_KIND_SQL})", "SELECT climate, kind, quantile_cont(d, 0.025) AS delta_rmse_lo, quantile_cont(d, 0.975) AS delta_rmse_hi, quantile_cont(s, 0.025) AS skill_lo, quantile_cont(s, 0.975) AS skill_hi FROM r GROUP BY ALL"))
def template_adjusted_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE5: intervals of the rmse difference and of the skill of b against a, as they are and adjusted, from one set of starts."""
    from pyspark.sql import Window

    d = adjusted_daily(spark, sf_dir).withColumn("day_idx", F.row_number().over(Window.partitionBy("climate").orderBy("day")).cast("long") - 1)
    s = B.block_sums(d, B.block_starts(_sizes(d, ["climate"]), REPS), ["climate"], ["w", *_SERIES])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (F.sqrt(F.col(f"a_{k}") / F.col("w")) - F.sqrt(F.col(f"b_{k}") / F.col("w"))).alias("delta_rmse"), (1 - F.col(f"b_{k}") / F.col(f"a_{k}")).alias("skill")) for k in _KINDS])
    return pick(s.select("climate", F.inline(kinds)).groupBy("climate", "kind").agg(*B.interval("delta_rmse"), *B.interval("skill")), _ADJ_CI)
