"""Spectra queries over the dense grid of 4 rows and 16 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import arrays
from fieldloom.functions.scalars import grid_weight, resolved_degree, row_latitude
from fieldloom.operators import adapters as A
from fieldloom.operators import spectra as S
from fieldloom.operators.adapters import DENSE_SQL, ERRORS_SQL

from .registry import ask, pick, query

_PI = "3.141592653589793::DOUBLE"
_W = "cos(radians(-90 + (row + 0.5::DOUBLE) * 45)) / ((cos(radians(22.5::DOUBLE)) + cos(radians(67.5::DOUBLE))) / 2)"
_DFT = f"""{DENSE_SQL}, z AS (SELECT *, val - avg(val) OVER (PARTITION BY day_idx, row) AS dev, {_W} AS w FROM dense),
f AS (SELECT day_idx, population, row, any_value(w) AS w, k, sum(dev * cos(2 * {_PI} * k * col / 16)) AS dr, sum(dev * sin(2 * {_PI} * k * col / 16)) AS di, sum(val * cos(2 * {_PI} * k * col / 16)) AS vr, sum(val * sin(2 * {_PI} * k * col / 16)) AS vi FROM (SELECT *, unnest(range(9)) AS k FROM z) GROUP BY ALL),
one AS (SELECT *, (dr * dr + di * di) / 16 * CASE WHEN k BETWEEN 1 AND 7 THEN 2 ELSE 1 END AS p1, (vr * vr + vi * vi) / 256 AS p2 FROM f)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dense(spark, sf_dir).withColumn("w", grid_weight(row_latitude("row", A.DENSE_ROWS), A.DENSE_ROWS))


@query(ask("population k | power:8", _DFT, "SELECT population, CAST(k AS INTEGER) AS k, sum(w * p1) / sum(w) AS power FROM one GROUP BY population, k"))
def zonal_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP1, SP2, SP3: one-sided power of rows without their mean, averaged with row weights."""
    p = S.zonal_power(_rows(spark, sf_dir), "vals", ["population", "w"])
    return pick(S.weighted_spectrum(p, ["population"], "w"), "population k | power:8")


@query(ask("population k | power:8", _DFT, "SELECT population, CAST(k AS INTEGER) AS k, sum(w * p2) / sum(w) AS power FROM one GROUP BY population, k"))
def mean_amplitude_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP4: the second convention."""
    p = S.zonal_power(_rows(spark, sf_dir), "vals", ["population", "w"], "mean_amplitude")
    return pick(S.weighted_spectrum(p, ["population"], "w"), "population k | power:8")


@query(ask("k | base:8 model:8 skill:7", f"{_DFT}, b AS (SELECT k, sum(w * p1) FILTER (population = 0) / sum(w) FILTER (population = 0) AS base, sum(w * p1) FILTER (population = 1) / sum(w) FILTER (population = 1) AS model FROM one GROUP BY k)", "SELECT CAST(k AS INTEGER) AS k, base, model, CASE WHEN base > 1e-12 THEN 1 - model / base END AS skill FROM b WHERE k BETWEEN 1 AND 7"))
def spectral_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP5, FI9, JO6: skill by wavenumber within a band."""
    s = S.weighted_spectrum(S.zonal_power(_rows(spark, sf_dir).where("population < 2"), "vals", ["population", "w"]), ["population"], "w").where("k between 1 and 7")
    b = s.where("population = 0").select("k", F.col("power").alias("base")).join(s.where("population = 1").select("k", F.col("power").alias("model")), "k")
    return pick(b.withColumn("skill", F.when(F.col("base") > 1e-12, 1 - F.col("model") / F.col("base"))), "k | base:8 model:8 skill:7")


@query(ask("worst_k | worst:7 total_change:7", f"{_DFT}, b AS (SELECT k, sum(w * p1) FILTER (population = 0) / sum(w) FILTER (population = 0) AS base, sum(w * p1) FILTER (population = 1) / sum(w) FILTER (population = 1) AS model FROM one WHERE k BETWEEN 1 AND 8 GROUP BY k)", "SELECT CAST(max_by(k, floor(abs(model - base) / base * 1e9)) AS INTEGER) AS worst_k, max(abs(model - base) / base) AS worst, sum(model - base) / sum(base) AS total_change FROM b"))
def spectral_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP11: the bin that changes most, and the whole change."""
    s = S.weighted_spectrum(S.zonal_power(_rows(spark, sf_dir).where("population < 2"), "vals", ["population", "w"]), ["population"], "w").where("k between 1 and 8")
    b = s.where("population = 0").select("k", F.col("power").alias("base")).join(s.where("population = 1").select("k", F.col("power").alias("model")), "k")
    r = F.abs(F.col("model") - F.col("base")) / F.col("base")
    return pick(b.agg(F.max_by("k", F.floor(r * 1e9)).alias("worst_k"), F.max(r).alias("worst"), (F.sum(F.col("model") - F.col("base")) / F.sum("base")).alias("total_change")), "worst_k | worst:7 total_change:7")


@query(f"WITH {ERRORS_SQL}, f AS (SELECT climate AS name, count(DISTINCT row) AS n_rows, count(DISTINCT col) AS n_cols, count(*) AS n FROM errors GROUP BY climate UNION ALL SELECT CAST(label AS VARCHAR), max(len(embedding)) // 16, 16, count(*) FROM embeddings GROUP BY label) SELECT name, n, CAST(floor(360.0 / (6.0 * greatest(180.0 / n_rows, 360.0 / n_cols))) AS INTEGER) AS degree FROM f")
def spherical_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP10: the largest degree that the rows and columns with values resolve, of each climate's fields and each population of
    dense ones."""
    fields = A.errors(spark, sf_dir).groupBy(F.col("climate").alias("name")).agg(F.count_distinct("row").alias("n_rows"), F.count_distinct("col").alias("n_cols"), F.count("*").alias("n"))
    dense = A.table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("name"))
    dense = dense.agg(F.floor(F.max(F.size("embedding")) / A.DENSE_COLUMNS).alias("n_rows"), F.lit(A.DENSE_COLUMNS).cast("long").alias("n_cols"), F.count("*").alias("n"))
    return fields.union(dense).select("name", "n", resolved_degree(180.0 / F.col("n_rows"), 360.0 / F.col("n_cols")).alias("degree"))


@query()
def spherical_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP6, SP7, SP8, SP9, PR25: power by spherical degree, a day and a range of orders a group."""
    return pick(S.spherical_spectrum(A.dense(spark, sf_dir), A.DENSE_ROWS, 1, 16), "day_idx ell | power:8")


# --- PR22, PR23, PR24: array columns of rows


@query(ask("day_idx row c | ghost:6 wide:6", DENSE_SQL, """SELECT d.day_idx, d.row, CAST(d.c AS INTEGER) AS c, g.val AS ghost, 0.75 * a.val + 0.25 * b.val AS wide FROM (SELECT day_idx, row, unnest(range(32)) AS c FROM dense WHERE col = 0) d
 JOIN dense g ON g.day_idx = d.day_idx AND g.row = d.row AND g.col = (d.c + 8) % 16 JOIN dense a ON a.day_idx = d.day_idx AND a.row = d.row AND a.col = d.c // 2
 JOIN dense b ON b.day_idx = d.day_idx AND b.row = d.row AND b.col = (d.c // 2 + CASE WHEN d.c % 2 = 0 THEN -1 ELSE 1 END + 16) % 16"""))
def ghost_and_upsampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR22, PR23: the row beyond the pole, and twice the columns around the circle."""
    r = A.dense(spark, sf_dir)
    v = F.transform("vals", lambda x: x.cast("double"))
    ghost = arrays.ghost_row(v, 16)
    wide = r.select("day_idx", "row", F.concat(ghost, ghost).alias("g"), arrays.upsample_circular(v, 16).alias("u"))
    return pick(wide.select("day_idx", "row", F.posexplode(F.arrays_zip("g", "u")).alias("c", "z")).select("day_idx", "row", "c", F.col("z.g").alias("ghost"), F.col("z.u").alias("wide")), "day_idx row c | ghost:6 wide:6")


@query(ask("day_idx row c | circular:6 replicated:6", DENSE_SQL, "SELECT d.day_idx, d.row, CAST(d.c AS INTEGER) AS c, a.val AS circular, b.val AS replicated FROM (SELECT day_idx, row, unnest(range(20)) AS c FROM dense WHERE col = 0) d JOIN dense a ON a.day_idx = d.day_idx AND a.row = d.row AND a.col = (d.c - 2 + 16) % 16 JOIN dense b ON b.day_idx = d.day_idx AND b.row = d.row AND b.col = greatest(0, least(15, d.c - 2))"))
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR24, PR26: circular and replicated padding."""
    v = F.transform("vals", lambda x: x.cast("double"))
    r = A.dense(spark, sf_dir).select("day_idx", "row", arrays.circular_pad(v, 2, 16).alias("p"), arrays.replicate_pad(v, 2).alias("q"))
    return pick(r.select("day_idx", "row", F.posexplode(F.arrays_zip("p", "q")).alias("c", "z")).select("day_idx", "row", "c", F.col("z.p").alias("circular"), F.col("z.q").alias("replicated")), "day_idx row c | circular:6 replicated:6")


_BANDS = {"low": (1, 2), "middle": (3, 5), "high": (6, 8)}


@query(ask("population band | truth:7 predicted:7 ratio:7", f"{_DFT}, b AS (SELECT population, CASE WHEN k <= 2 THEN 'low' WHEN k <= 5 THEN 'middle' ELSE 'high' END AS band, row < 2 AS south, sum(w * p1) / sum(w) AS p FROM one WHERE k BETWEEN 1 AND 8 GROUP BY ALL)", "SELECT population, band, max(p) FILTER (south) AS truth, max(p) FILTER (NOT south) AS predicted, max(p) FILTER (NOT south) / max(p) FILTER (south) AS ratio FROM b GROUP BY ALL"))
def band_power_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG28: power by bands of wavenumbers, and the ratio of the two half fields in each."""
    cells = S.zonal_power(_rows(spark, sf_dir), "vals", ["population", "row", "w"]).select("population", (F.col("row") < 2).alias("south"), "w", F.posexplode("power").alias("k", "p"))
    band = F.lit(None).cast("string")
    for name, (lo, hi) in _BANDS.items():
        band = F.when(F.col("k").between(lo, hi), name).otherwise(band)
    b = cells.withColumn("band", band).where("band is not null").groupBy("population", "band", "south").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))
    side = lambda south: F.max(F.when(F.col("south") == south, F.col("p")))
    out = b.groupBy("population", "band").agg(side(True).alias("truth"), side(False).alias("predicted"))
    return pick(out.withColumn("ratio", F.col("predicted") / F.col("truth")), "population band | truth:7 predicted:7 ratio:7")
