"""Linear-algebra and decomposition queries over the embedding matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.functions.arrays import dot, subtract
from fieldloom.operators import adapters as A
from fieldloom.operators import bootstrap as B
from fieldloom.operators import linalg as L
from fieldloom.operators.adapters import DENSE_SQL, MATRIX_SQL
from fieldloom.operators.strips import Strips, fit_wide_basis
from fieldloom.operators.tall import TallCanonical, rank_errors

from .registry import ask, pick, query
from .resampling import REPS, starts_sql, sums_sql

_PI = "3.141592653589793::DOUBLE"
MODES = 6
#: Pixels of a tile of the Gram matrix: few, as these fields are small.
PIXELS = 24
#: Columns that are orthonormalised together.
BLOCK = 32
_BASIS = f"basis AS (SELECT CAST(k AS INTEGER) AS k, CAST(p AS INTEGER) AS p, CASE WHEN k = 0 THEN sqrt(1 / 64.0::DOUBLE) ELSE sqrt(2 / 64.0::DOUBLE) * cos({_PI} * k * (p + 0.5::DOUBLE) / 64) END AS e FROM range({MODES}) a(k), range(64) b(p))"
_SCORES = f"{DENSE_SQL}, {_BASIS}, scores AS (SELECT day_idx, population, k, sum(val * e) AS s FROM cells JOIN basis USING (p) GROUP BY ALL)"


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("day_idx"), F.col("label").alias("population"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.apply_matrix(_fields(spark, sf_dir), "x", L.dct_basis(MODES, 64).T, "s", ["day_idx", "population", "x"])


@query(ask("i j | value:6", DENSE_SQL, "SELECT CAST(a.day_idx AS INTEGER) AS i, CAST(b.day_idx AS INTEGER) AS j, sum(a.val * b.val) AS value FROM cells a JOIN cells b USING (p) GROUP BY ALL"))
def temporal_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA1, LA2: the Gram matrix of all days, from products of pairs of stored blocks of days that are written as rows."""
    fields = _fields(spark, sf_dir).withColumn("day_idx", F.col("day_idx").cast("long"))
    days, pixels = fields.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    blocks = L.gram_blocks(days, spark.sparkContext.defaultParallelism)
    g = L.gram(L.tiles(fields, "day_idx", "x", blocks, PIXELS), blocks, days, pixels)
    return pick(g.withColumns({c: F.col(c).cast("int") for c in ("i", "j")}), "i j | value:6")


@query(ask("day_idx k | score:6", _SCORES, "SELECT day_idx, k, s AS score FROM scores"))
def score_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA6, JO15: blocked matrix products against a basis of fixed size."""
    return pick(_scores(spark, sf_dir).select("day_idx", F.posexplode("s").alias("k", "score")), "day_idx k | score:6")


@query(ask("day_idx | inside:6 outside:6 total:6 recon:6", f"{_SCORES}, t AS (SELECT day_idx, sum(val * val) AS t FROM cells GROUP BY day_idx), i AS (SELECT day_idx, sum(s * s) AS i FROM scores GROUP BY day_idx), r AS (SELECT day_idx, sum(v * v) AS r FROM (SELECT day_idx, p, sum(s * e) AS v FROM scores JOIN basis USING (k) GROUP BY ALL) GROUP BY day_idx)", "SELECT day_idx, i AS inside, greatest(t - i, 0) AS outside, t AS total, r AS recon FROM t JOIN i USING (day_idx) JOIN r USING (day_idx)"))
def span_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA7, LA17, LA18, DE9: energy within and outside the span, and of the reconstruction."""
    s = _scores(spark, sf_dir)
    r = L.apply_matrix(s, "s", L.dct_basis(MODES, 64), "r", ["day_idx", "x", "s"])
    i, t = dot(F.col("s"), F.col("s")), dot(F.col("x"), F.col("x"))
    return pick(r.select("day_idx", i.alias("inside"), F.greatest(t - i, F.lit(0.0)).alias("outside"), t.alias("total"), dot(F.col("r"), F.col("r")).alias("recon")), "day_idx | inside:6 outside:6 total:6 recon:6")


@query(ask("k | norm:5 relative:6 cumulative:6", f"{_SCORES}, n AS (SELECT k, sum(s * s) AS n2 FROM scores GROUP BY k), tr AS (SELECT sum(val * val) AS t FROM cells)", "SELECT k, sqrt(n2) AS norm, sqrt(n2) / sqrt(max(n2) OVER ()) AS relative, sum(n2) OVER (ORDER BY k) / t AS cumulative FROM n, tr"))
def mode_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA8, WI2, WI4: column norms and the cumulative share of the trace (a few modes)."""
    s = _scores(spark, sf_dir)
    n = s.select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v") ** 2).alias("n2"))
    t = s.agg(F.sum(dot(F.col("x"), F.col("x"))).alias("t"))
    w = Window.orderBy("k")
    out = n.crossJoin(F.broadcast(t)).select("k", F.sqrt("n2").alias("norm"), (F.sqrt("n2") / F.sqrt(F.max("n2").over(Window.partitionBy()))).alias("relative"), (F.sum("n2").over(w) / F.col("t")).alias("cumulative"))
    return pick(out, "k | norm:5 relative:6 cumulative:6")


_BLOCKS = " UNION ALL ".join(f"SELECT '{a}{b}' AS block, a.k AS i, b.k AS j, covar_samp(a.val, b.val) AS value FROM {a} a JOIN {b} b USING (day_idx) WHERE a.split = 'train' GROUP BY ALL" for a, b in ("xx", "xy", "yy"))


@query(ask("block i j | value:8", MATRIX_SQL, _BLOCKS))
def score_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA9: all of Sxx, Sxy and Syy with 1 / (n - 1), from partitions' products of blocks of columns."""
    m = A.matrices(spark, sf_dir).where("split = 'train'").select(F.concat("x", "y").alias("xy"))
    cells, i, j = L.covariance_cells(m, "xy"), F.col("i"), F.col("j")
    block = F.concat(F.when(i < 32, "x").otherwise("y"), F.when(j < 32, "x").otherwise("y"))
    out = cells.select(block.alias("block"), (i % 32).alias("i"), (j % 32).alias("j"), "value").where("block <> 'yx'")
    return pick(out, "block i j | value:8")


def _canonical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TallCanonical]:
    m = A.matrices(spark, sf_dir)
    return m, TallCanonical(m.where("split = 'train'"), block=BLOCK)


@query()
def canonical_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA3, LA9, LA10, LA11, LA16: canonical correlations from a tree of triangular factors; no covariance is made."""
    _, c = _canonical(spark, sf_dir)
    rho = c.pair().rho
    c.drop()
    return pick(spark.createDataFrame([(k, float(r)) for k, r in enumerate(rho)], "k int, rho double"), "k | rho:8")


@query()
def canonical_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR17, LA19: validation errors of the regression on eight canonical pairs by population."""
    m, c = _canonical(spark, sf_dir)
    p = c.pair(rank=8).predict(m.where("split = 'val'"), ["day_idx", "population", "y"]).withColumn("e", subtract(F.col("y_hat"), F.col("y")))
    c.drop()
    return pick(p.groupBy("population").agg(F.count("*").alias("n"), F.avg(dot(F.col("e"), F.col("e"))).alias("mse"), F.avg(dot(F.col("y"), F.col("y"))).alias("raw")), "population n | mse:6 raw:6")


#: Leading scores of x and of y, canonical pairs and ridges that are compared.
GRID_SCORES, GRID_RANKS, GRID_RIDGES = (4, 8, 12, 16, 20, 24, 28, 32), (1, 2, 4, 8, 12, 16, 24, 32), (0.0, 0.01)


@query()
def canonical_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA12, LA14, SE4: validation errors of 624 settings. A ridge is one factorisation, a pair of sizes is read off its
    panels, and one pass over the validation days gives the errors of all ranks of all pairs of sizes."""
    m = A.matrices(spark, sf_dir)
    sizes, rows = [(kx, ky, None) for kx in GRID_SCORES for ky in GRID_SCORES], []
    for ridge in GRID_RIDGES:
        c = TallCanonical(m.where("split = 'train'"), ridge, BLOCK)
        errors = rank_errors(m.where("split = 'val'"), c.pairs(sizes))
        c.drop()
        rows += [(kx, ky, r, ridge, float(e[r - 1])) for (kx, ky, _), e in zip(sizes, errors, strict=True) for r in GRID_RANKS if r <= len(e)]
    return pick(spark.createDataFrame(rows, "kx int, ky int, rank int, ridge double, mse double"), "kx ky rank ridge | mse:8")


@query()
def fitted_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA4, LA5, SO7: modes fitted to the field, with explained shares."""
    b = L.fit_basis(_fields(spark, sf_dir), "x", np.ones(64), 10)
    rows = [F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("share"), F.lit(b.orthonormality_error() < 1e-8).alias("orthonormal")) for k, v in enumerate(b.explained())]
    return pick(spark.range(1).select(F.inline(F.array(*rows))), "k orthonormal | share:8")


_ANOMALY = f"""{DENSE_SQL}, lat AS (SELECT r AS row, cos(radians(-90 + (r + 0.5::DOUBLE) * 45)) AS c FROM range(4) t(r)), sw AS (SELECT CAST(row AS INTEGER) AS row, sqrt(c / (SELECT avg(c) FROM lat)) AS sw FROM lat),
an AS (SELECT day_idx, p, (val - avg(val) OVER (PARTITION BY p)) * sw AS a FROM cells JOIN sw ON cells.p // 16 = sw.row)"""


def _lits(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _roots(spark: SparkSession) -> DataFrame:
    """Roots of the mean-one cosine weights of the dense grid's pixels."""
    row = F.floor(F.col("id") / A.DENSE_COLUMNS)
    return spark.range(A.DENSE_ROWS * A.DENSE_COLUMNS).select(F.col("id").alias("pixel"), F.sqrt(S.grid_weight(S.row_latitude(row, A.DENSE_ROWS), A.DENSE_ROWS)).alias("root"))


def _strips(spark: SparkSession, sf_dir: str) -> Strips:
    """PR18: (x - mean) * sqrt(w) by ranges of pixels over all days."""
    return Strips.of(_fields(spark, sf_dir), "day_idx", "x", _roots(spark))


def _cosines(spark: SparkSession) -> DataFrame:
    """The cosine basis as (mode, pixel, value)."""
    pixels = A.DENSE_ROWS * A.DENSE_COLUMNS
    k, p = F.col("mode"), F.col("pixel")
    cells = spark.range(MODES * pixels).select(F.floor(F.col("id") / pixels).cast("int").alias("mode"), (F.col("id") % pixels).alias("pixel"))
    return cells.withColumn("value", F.when(k == 0, float(np.sqrt(1.0 / pixels))).otherwise(float(np.sqrt(2.0 / pixels)) * F.cos(F.lit(np.pi) * k * (p + 0.5) / pixels)))


@query(ask("i j | value:6", _ANOMALY, "SELECT CAST(a.day_idx AS INTEGER) AS i, CAST(b.day_idx AS INTEGER) AS j, sum(a.a * b.a) AS value FROM an a JOIN an b USING (p) GROUP BY ALL"))
def anomaly_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA1, LA2, PR18: the Gram matrix of weighted anomalies of all days, from products of tiles of days and pixels."""
    strips = _strips(spark, sf_dir)
    blocks = L.gram_blocks(len(strips.keys), spark.sparkContext.defaultParallelism)
    days = -(-len(strips.keys) // blocks)
    g = L.gram(strips.tiles(days), -(-len(strips.keys) // days), len(strips.keys), strips.pixels)
    return pick(g.withColumns({c: F.col(c).cast("int") for c in ("i", "j")}), "i j | value:6")


@query()
def spatial_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA3, LA4, LA5: modes of the weighted anomalies by the eigenpairs of their Gram matrix, with each mode's share of the
    variance and how far the set is from orthonormal. Neither that matrix nor one of pixels by pixels is made."""
    e, modes = fit_wide_basis(_fields(spark, sf_dir), "day_idx", "x", 10, _roots(spark))
    share = F.get(_lits(e.values / e.trace), F.col("mode")).alias("share")
    off = F.max(F.abs(F.col("value") - (F.col("a") == F.col("b")).cast("double")))
    check = L.mode_products(modes).groupBy(F.col("a").alias("mode")).agg((off < 1e-8).alias("orthonormal"))
    norm = modes.groupBy("mode").agg(F.max(F.abs("value")).alias("largest"))
    return pick(check.join(norm, "mode").withColumn("share", share), "mode orthonormal | share:8 largest:8")


@query(ask("day_idx | error:5 total:5", f"{_ANOMALY}, {_BASIS}, sc AS (SELECT day_idx, k, sum(a * e) AS s FROM an JOIN basis USING (p) GROUP BY ALL), rc AS (SELECT day_idx, p, sum(s * e) AS v FROM sc JOIN basis USING (k) GROUP BY ALL), mf AS (SELECT p, avg(val) AS m FROM cells GROUP BY p), fl AS (SELECT day_idx, p, m + v / sw AS f FROM rc JOIN mf USING (p) JOIN sw ON rc.p // 16 = sw.row)", "SELECT day_idx, sum((f - val) * (f - val)) AS error, sum(f * f) AS total FROM fl JOIN cells USING (day_idx, p) GROUP BY day_idx"))
def field_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA7, LA18: fields from scores, mean + (s @ E) / sqrt(w), a range of pixels at a time, against the fields themselves."""
    strips = _strips(spark, sf_dir)
    sums = strips.reconstruction_sums(strips.scores(_cosines(spark), MODES), _cosines(spark), MODES)
    return pick(sums.select(F.col("key").alias("day_idx"), F.get("s", F.lit(0)).alias("error"), F.get("s", F.lit(1)).alias("total")), "day_idx | error:5 total:5")


def sweep(fit: L.ScoreMoments, groups: dict, sizes: tuple[int, ...], ky: int, rank: int, shift: np.ndarray) -> list[tuple]:
    """(kx, group, n, retention, response, mse, bias, variance, cosine, delta) for each truncation and group, from moments alone."""
    out = []
    for kx in sizes:
        m = fit.canonical(kx, ky, rank)
        answer = shift[:kx] @ m.b
        for g, (n, mean, second) in groups.items():
            w = fit.width
            # the residual is z @ c + d, with z = (x, y)
            c = np.zeros((2 * w, ky))
            c[:kx], c[w : w + ky] = m.b, -np.eye(ky)
            d = m.y_mean - m.x_mean @ m.b
            bias = mean @ c + d
            mse = float(np.einsum("ij,ik,kj->", c, second, c) + 2 * (mean @ c) @ d + d @ d)
            length, along = float(np.linalg.norm(answer)), float(bias @ answer)
            cosine = along / (length * float(np.linalg.norm(bias))) if length and bias.any() else None
            out.append((kx, g, n, float(shift[:kx] @ shift[:kx] / (shift @ shift)), length / ky**0.5, mse / ky, float(bias @ bias) / ky, (mse - float(bias @ bias)) / ky, cosine, along / length**2 if length else None))
    return out


@query()
def truncation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE4: the regression refitted at each number of input scores: its answer to a uniform shift of the inputs by one, the
    share of the shift that the truncation keeps, and, by population, persistent and varying error, the cosine between the
    persistent error and the answer, and the shift that would explain it best. Two passes over the data in all."""
    z = A.matrices(spark, sf_dir).select("split", F.col("population").cast("int").alias("population"), F.concat("x", "y").alias("xy"))
    fit = L.ScoreMoments(z.where("split = 'train'"))
    rows = sweep(fit, L.moments_by(z.where("split = 'val'"), "population", "xy"), (4, 8, 16, 24, 32), 32, 8, np.ones(32))
    names = "kx int, population int, n long, retention double, response double, mse double, bias double, variance double, cosine double, delta double"
    return pick(spark.createDataFrame(rows, names), "kx population n | retention:6 response:8 mse:6 bias:6 variance:6 cosine:6 delta:6")


@query(ask("n | constant:4 crossed:4 sse:4 mse:8", MATRIX_SQL, "SELECT count(DISTINCT day_idx) AS n, sum(y.val * y.val) AS constant, sum(x.val * y.val) AS crossed, sum(y.val * y.val) + sum(x.val * x.val) - 2 * sum(x.val * y.val) AS sse, (sum(y.val * y.val) + sum(x.val * x.val) - 2 * sum(x.val * y.val)) / (count(DISTINCT day_idx) * 32) AS mse FROM x JOIN y USING (day_idx, k)"))
def score_space_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA13, LA15: the squared error from two sums, never from fields."""
    m = A.matrices(spark, sf_dir)
    s = m.agg(F.count("*").alias("n"), F.sum(dot(F.col("y"), F.col("y"))).alias("constant"), F.sum(dot(F.col("x"), F.col("x"))).alias("pred"), F.sum(dot(F.col("x"), F.col("y"))).alias("crossed"))
    sse = F.greatest(F.col("constant") + F.col("pred") - 2 * F.col("crossed"), F.lit(0.0))
    return pick(s.withColumn("sse", sse).withColumn("mse", F.col("sse") / (F.col("n") * 32)), "n | constant:4 crossed:4 sse:4 mse:8")


@query(ask("day_idx k | score:6", f"{MATRIX_SQL}, b AS (SELECT CAST(i AS INTEGER) AS kx, CAST(j AS INTEGER) AS ky, ((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE AS b FROM range(32) r(i), range(4) s(j))", "SELECT day_idx, ky AS k, sum(x.val * b) AS score FROM x JOIN b ON kx = k WHERE split = 'val' GROUP BY ALL"))
def linear_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR17, PR18 with given coefficients."""
    b = np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(4)] for i in range(32)])
    p = L.apply_matrix(A.matrices(spark, sf_dir).where("split = 'val'"), "x", b, "s", ["day_idx"])
    return pick(p.select("day_idx", F.posexplode("s").alias("k", "score")), "day_idx k | score:6")


_SCALE, _OFFSET = S.INPUT_STD / S.TARGET_STD, (S.INPUT_MEAN - S.TARGET_MEAN) / S.TARGET_STD


@query(ask("day_idx | error:4 correction:4", f"{MATRIX_SQL}, b AS (SELECT CAST(i AS INTEGER) AS kx, CAST(j AS INTEGER) AS ky, ((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE AS b FROM range(32) r(i), range(32) s(j)), r AS (SELECT day_idx, ky AS k, sum(x.val * b) AS r FROM x JOIN b ON kx = k WHERE split = 'val' GROUP BY ALL)", f"SELECT day_idx, sum((x.val * {_SCALE!r}::DOUBLE + {_OFFSET!r}::DOUBLE + r - y.val) * (x.val * {_SCALE!r}::DOUBLE + {_OFFSET!r}::DOUBLE + r - y.val)) AS error, sum(r * r) AS correction FROM x JOIN y USING (day_idx, k) JOIN r USING (day_idx, k) GROUP BY day_idx"))
def shard_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA19: predictions of held-out days as the baseline in target units plus a regressed residual, batch by batch."""
    b = np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(32)] for i in range(32)])
    r = L.apply_matrix(A.matrices(spark, sf_dir).where("split = 'val'"), "x", b, "r", ["day_idx", "x", "y"])
    p = F.zip_with(F.transform("x", lambda v: S.baseline_in_target_units(v)), "r", lambda a, c: a + c)
    r = r.withColumn("e", F.zip_with(p, "y", lambda a, c: a - c))
    return pick(r.select("day_idx", dot(F.col("e"), F.col("e")).alias("error"), dot(F.col("r"), F.col("r")).alias("correction")), "day_idx | error:4 correction:4")


@query(ask("population kx | response:6", f"{MATRIX_SQL}, m AS (SELECT population, k, avg(val) AS m FROM x GROUP BY ALL)", "SELECT population, k + 1 AS kx, sum(m * m) OVER (PARTITION BY population ORDER BY k) AS response FROM m"))
def nested_partial_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI3: the response of the first k scores, for every k at once."""
    m = A.matrices(spark, sf_dir).select("population", F.posexplode("x").alias("k", "v")).groupBy("population", "k").agg(F.avg("v").alias("m"))
    return pick(m.select("population", (F.col("k") + 1).alias("kx"), F.sum(F.col("m") ** 2).over(Window.partitionBy("population").orderBy("k")).alias("response")), "population kx | response:6")


# --- decompositions: x predicts y; a pair of neighbours has one direction within the span and one outside


ROOT = "0.7071067811865476::DOUBLE"
_SPLIT = f"""{MATRIX_SQL}, e AS (SELECT x.day_idx, x.population, x.k, x.val AS xv, y.val AS yv, x.val - y.val AS ea, 0.3 * (r.val - y.val) AS eb FROM x JOIN y USING (day_idx, k) JOIN x r ON r.day_idx = x.day_idx AND r.k = 31 - x.k),
h AS (SELECT a.day_idx, a.population, a.k // 2 AS j, (a.ea + b.ea) * {ROOT} AS a_in, (a.ea - b.ea) * {ROOT} AS a_out, (a.eb + b.eb) * {ROOT} AS b_in, (a.eb - b.eb) * {ROOT} AS b_out, (a.yv - b.yv) * {ROOT} AS t_out, (a.xv - b.xv) * {ROOT} AS p_out, (a.xv + b.xv) * {ROOT} AS p_in, (a.yv + b.yv) * {ROOT} AS t_in FROM e a JOIN e b ON a.day_idx = b.day_idx AND b.k = a.k + 1 AND a.k % 2 = 0),
d AS (SELECT day_idx, population, sum(a_in * a_in + a_out * a_out) AS a2, sum(b_in * b_in + b_out * b_out) AS b2, sum(a_in * a_in) AS ain, sum(a_out * a_out) AS aout, sum(b_in * b_in) AS bin, sum(b_out * b_out) AS bout, sum(t_out * t_out) AS tout, sum(p_out * p_out) AS pout, sum(t_out * p_out) AS cout FROM h GROUP BY ALL)"""


def _half(v: Column, sign: int) -> Column:
    """The 16 components of a 32-vector along or across its pairs of neighbours."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: (F.get(v, 2 * j) + sign * F.get(v, 2 * j + 1)) * F.lit(0.7071067811865476))


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of both predictions within (in) and outside (out) the span, and the outside parts of truth and prediction."""
    m = A.matrices(spark, sf_dir)
    ea = subtract(F.col("x"), F.col("y"))
    eb = F.zip_with(F.reverse("x"), "y", lambda u, v: (u - v) * 0.3)
    m = m.select("day_idx", "population", ea.alias("ea"), eb.alias("eb"), "x", "y")
    parts = {"a_in": _half(F.col("ea"), 1), "a_out": _half(F.col("ea"), -1), "b_in": _half(F.col("eb"), 1), "b_out": _half(F.col("eb"), -1), "t_out": _half(F.col("y"), -1), "p_out": _half(F.col("x"), -1), "t_in": _half(F.col("y"), 1), "p_in": _half(F.col("x"), 1)}
    return m.select("day_idx", "population", *[v.alias(k) for k, v in parts.items()])


def _daily_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _residuals(spark, sf_dir)
    sq = {n: dot(F.col(c), F.col(c)) for n, c in (("ain", "a_in"), ("aout", "a_out"), ("bin", "b_in"), ("bout", "b_out"), ("tout", "t_out"), ("pout", "p_out"))}
    r = r.select("day_idx", "population", *[v.alias(k) for k, v in sq.items()], dot(F.col("t_out"), F.col("p_out")).alias("cout"))
    return r.withColumns({"a2": F.col("ain") + F.col("aout"), "b2": F.col("bin") + F.col("bout")})


_PARTS = ("a2", "b2", "ain", "aout", "bin", "bout", "tout", "pout", "cout")
_ROW = "ain / a2 AS a_in_share, aout / a2 AS a_out_share, bin / b2 AS b_in_share, a2 - b2 AS gap, ain - bin AS within, aout - bout AS outside, (2 * cout - pout) / tout AS recovered, cout / sqrt(greatest(pout, 1e-30) * tout) AS out_corr, abs(a2 - ain - aout) < 1e-9 AS closes"
_ROW_SPEC = "population n closes | a2:6 b2:6 a_in_share:7 a_out_share:7 b_in_share:7 gap:6 within:6 outside:6 recovered:6 out_corr:6"


@query(ask(_ROW_SPEC, _SPLIT, f"SELECT population, n, a2, b2, {_ROW} FROM (SELECT population, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in _PARTS)} FROM d GROUP BY population)"))
def span_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DE1, DE2, DE6: errors split within and outside the span, shares, gaps, closure and recovery."""
    s = _daily_parts(spark, sf_dir).groupBy("population").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in _PARTS])
    return pick(s.withColumns({"a_in_share": F.col("ain") / F.col("a2"), "a_out_share": F.col("aout") / F.col("a2"), "b_in_share": F.col("bin") / F.col("b2"), "gap": F.col("a2") - F.col("b2"), "within": F.col("ain") - F.col("bin"), "outside": F.col("aout") - F.col("bout"), "recovered": (2 * F.col("cout") - F.col("pout")) / F.col("tout"), "out_corr": F.col("cout") / F.sqrt(F.greatest(F.col("pout"), F.lit(1e-30)) * F.col("tout")), "closes": F.abs(F.col("a2") - F.col("ain") - F.col("aout")) < 1e-9}), _ROW_SPEC)


@query(ask("quarter | total:6 three_term:6 cross_share:6", _SPLIT, "SELECT j // 4 AS quarter, sum(power(a_in + a_out, 2)) / count(*) AS total, (sum(a_in * a_in) + sum(a_out * a_out) + 2 * sum(a_in * a_out)) / count(*) AS three_term, 2 * sum(a_in * a_out) / sum(power(a_in + a_out, 2)) AS cross_share FROM h GROUP BY j // 4"))
def regional_three_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DE3: in a part of the field the two components aren't orthogonal, so the cross term counts."""
    r = _residuals(spark, sf_dir).select(F.posexplode(F.arrays_zip("a_in", "a_out")).alias("j", "z")).select(F.floor(F.col("j") / 4).alias("quarter"), F.col("z.a_in").alias("i"), F.col("z.a_out").alias("o"))
    s = r.groupBy("quarter").agg(F.avg((F.col("i") + F.col("o")) ** 2).alias("total"), F.avg(F.col("i") ** 2).alias("ii"), F.avg(F.col("o") ** 2).alias("oo"), F.avg(F.col("i") * F.col("o")).alias("io"))
    return pick(s.withColumns({"three_term": F.col("ii") + F.col("oo") + 2 * F.col("io"), "cross_share": 2 * F.col("io") / F.col("total")}), "quarter | total:6 three_term:6 cross_share:6")


@query(ask("population | d_gap:6 d_within:6 d_outside:6 closure:6", _SPLIT + ", s AS (SELECT population, avg(a2 - b2) AS gap, avg(ain - bin) AS within, avg(aout - bout) AS outside FROM d GROUP BY population)", "SELECT t.population, t.gap - b.gap AS d_gap, t.within - b.within AS d_within, t.outside - b.outside AS d_outside, abs(t.gap - b.gap - (t.within - b.within) - (t.outside - b.outside)) AS closure FROM s t JOIN s b ON b.population = 0 AND t.population <> 0"))
def gap_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DE4: how much of a wider gap is within the span and how much outside."""
    s = _daily_parts(spark, sf_dir).groupBy("population").agg(F.avg(F.col("a2") - F.col("b2")).alias("gap"), F.avg(F.col("ain") - F.col("bin")).alias("within"), F.avg(F.col("aout") - F.col("bout")).alias("outside"))
    b = s.where("population = 0").select(*[F.col(c).alias(f"{c}0") for c in ("gap", "within", "outside")])
    t = s.where("population <> 0").crossJoin(F.broadcast(b)).select("population", *[(F.col(c) - F.col(f"{c}0")).alias(f"d_{c}") for c in ("gap", "within", "outside")])
    return pick(t.withColumn("closure", F.abs(F.col("d_gap") - F.col("d_within") - F.col("d_outside"))), "population | d_gap:6 d_within:6 d_outside:6 closure:6")


@query(ask("population method | b_in:7 v_in:6 b_out:7 v_out:6 total:6", f"{_SPLIT}, u AS (SELECT population, j, day_idx, 'a' AS method, a_in AS i, a_out AS o FROM h UNION ALL SELECT population, j, day_idx, 'b', b_in, b_out FROM h), c AS (SELECT population, method, j, avg(i) AS mi, avg(o) AS mo, avg(i * i) AS ii, avg(o * o) AS oo FROM u GROUP BY ALL)", "SELECT population, method, sum(mi * mi) AS b_in, sum(ii - mi * mi) AS v_in, sum(mo * mo) AS b_out, sum(oo - mo * mo) AS v_out, sum(ii + oo) AS total FROM c GROUP BY ALL"))
def four_way_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DE5, DE7, DE8: persistent and varying parts, within and outside the span; they add up to the whole."""
    r = _residuals(spark, sf_dir)
    u = r.select("population", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_in").alias("i"), F.col(f"{m}_out").alias("o")) for m in ("a", "b")])))
    z = u.select("population", "method", F.posexplode(F.arrays_zip("i", "o")).alias("j", "z")).groupBy("population", "method", "j")
    c = z.agg(F.avg("z.i").alias("mi"), F.avg("z.o").alias("mo"), F.avg(F.col("z.i") ** 2).alias("ii"), F.avg(F.col("z.o") ** 2).alias("oo"))
    s = c.groupBy("population", "method").agg(F.sum(F.col("mi") ** 2).alias("b_in"), F.sum(F.col("ii") - F.col("mi") ** 2).alias("v_in"), F.sum(F.col("mo") ** 2).alias("b_out"), F.sum(F.col("oo") - F.col("mo") ** 2).alias("v_out"), F.sum(F.col("ii") + F.col("oo")).alias("total"))
    return pick(s, "population method | b_in:7 v_in:6 b_out:7 v_out:6 total:6")


@query(ask("population modes | bias_rms:6 rmse:6 variance_ratio:6 mean_corr:6 mean_slope:6 mean_intercept:6", f"{MATRIX_SQL}, z AS (SELECT x.population, k, avg(x.val - y.val) AS b, avg((x.val - y.val) * (x.val - y.val)) AS e2, var_pop(x.val) AS vx, var_pop(y.val) AS vy, corr(x.val, y.val) AS c, regr_slope(y.val, x.val) AS sl, regr_intercept(y.val, x.val) AS ic FROM x JOIN y USING (day_idx, k) GROUP BY ALL)", "SELECT population, m AS modes, sqrt(avg(b * b)) AS bias_rms, sqrt(avg(e2)) AS rmse, sum(vx) / sum(vy) AS variance_ratio, avg(c) AS mean_corr, avg(sl) AS mean_slope, avg(ic) AS mean_intercept FROM z, (SELECT unnest([1, 5, 20, 32]) AS m) WHERE k < m GROUP BY ALL"))
def score_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG27, AG28, LA20: calibration of the first 1, 5, 20 and 32 scores."""
    z = A.matrices(spark, sf_dir).select("population", F.posexplode(F.arrays_zip("x", "y")).alias("k", "z")).select("population", "k", F.col("z.x").alias("x"), F.col("z.y").alias("y"))
    e = F.col("x") - F.col("y")
    g = z.groupBy("population", "k").agg(F.avg(e).alias("b"), F.avg(e * e).alias("e2"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.corr("x", "y").alias("c"), F.regr_slope("y", "x").alias("sl"), F.regr_intercept("y", "x").alias("ic"))
    m = g.withColumn("modes", F.explode(F.array(*[F.lit(v) for v in (1, 5, 20, 32)]))).where("k < modes").groupBy("population", "modes")
    s = m.agg(F.sqrt(F.avg(F.col("b") ** 2)).alias("bias_rms"), F.sqrt(F.avg("e2")).alias("rmse"), (F.sum("vx") / F.sum("vy")).alias("variance_ratio"), F.avg("c").alias("mean_corr"), F.avg("sl").alias("mean_slope"), F.avg("ic").alias("mean_intercept"))
    return pick(s, "population modes | bias_rms:6 rmse:6 variance_ratio:6 mean_corr:6 mean_slope:6 mean_intercept:6")


@query(ask("k | before:6 after:6 increase:6 share:6", f"{MATRIX_SQL}, z AS (SELECT x.population, k, avg((x.val - y.val) * (x.val - y.val)) AS e2 FROM x JOIN y USING (day_idx, k) WHERE x.population < 2 GROUP BY ALL), w AS (SELECT k, max(CASE WHEN population = 0 THEN e2 END) AS before, max(CASE WHEN population = 1 THEN e2 END) AS after FROM z GROUP BY k)", "SELECT k, before, after, after - before AS increase, (after - before) / (SELECT sum(after - before) FROM w) AS share FROM w ORDER BY floor((after - before) * 1e9) DESC, k LIMIT 20"))
def top_mode_increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO2: the 20 modes whose error grew most, with their share of the whole."""
    z = A.matrices(spark, sf_dir).where("population < 2").select("population", F.posexplode(F.arrays_zip("x", "y")).alias("k", "z"))
    e = F.avg((F.col("z.x") - F.col("z.y")) ** 2)
    w = z.groupBy("k").pivot("population", [0, 1]).agg(e).select("k", F.col("0").alias("before"), F.col("1").alias("after"))
    w = w.withColumn("increase", F.col("after") - F.col("before")).withColumn("share", F.col("increase") / F.sum("increase").over(Window.partitionBy()))
    return pick(w.orderBy(F.floor(F.col("increase") * 1e9).desc(), "k").limit(20), "k | before:6 after:6 increase:6 share:6")


# --- bootstrap of vector quantities by counts


_VEC = f"""{_SPLIT}, v AS (SELECT population, dense_rank() OVER (PARTITION BY population ORDER BY day_idx) - 1 AS day_idx, j, a_in, a_in * a_in AS a_sq FROM h), sizes AS (SELECT population, count(DISTINCT day_idx) AS n FROM v GROUP BY population),
drawn AS ({starts_sql('sizes')}), starts AS (SELECT drawn.*, j FROM drawn, (SELECT DISTINCT j FROM v)), {sums_sql(['a_in', 'a_sq'], 'population, j', 'v')},
rb AS (SELECT sums.population, rep, sum((a_in / n) * (a_in / n)) AS b, sum(a_sq / n) AS m FROM sums JOIN sizes USING (population) GROUP BY ALL)"""


def _bias_replicates(spark: SparkSession, sf_dir: str, populations: str = "true") -> tuple[DataFrame, DataFrame]:
    r = _residuals(spark, sf_dir).where(populations).select("population", (F.row_number().over(Window.partitionBy("population").orderBy("day_idx")) - 1).alias("day_idx"), "a_in")
    return r.select("population", "day_idx", F.posexplode("a_in").alias("j", "a_in")), B.vector_replicates(r, "population", "a_in", REPS)


@query(ask("population rep | b:7 m:6 v:6", _VEC, "SELECT population, rep, b, m, m - b AS v FROM rb"))
def bias_variance_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO8: squared mean vectors of 10,000 replicates of 60-day blocks, from prefix sums of the vectors."""
    return pick(_bias_replicates(spark, sf_dir)[1].withColumn("v", F.col("m") - F.col("b")), "population rep | b:7 m:6 v:6")


@query(ask("population | b:7 v:6 floor:7 shift:7 debiased:7 p_below:6", f"{_VEC}, pt AS (SELECT population, sum(mu * mu) AS b, sum(m2 - mu * mu) AS v, any_value(n) AS n FROM (SELECT population, j, avg(a_in) AS mu, avg(a_in * a_in) AS m2, count(*) AS n FROM v GROUP BY ALL) GROUP BY population)", "SELECT pt.population, any_value(pt.b) AS b, any_value(pt.v) AS v, any_value(pt.v / (pt.n / 60.0)) AS floor, avg(rb.b) - any_value(pt.b) AS shift, 2 * any_value(pt.b) - avg(rb.b) AS debiased, avg(CAST(floor(rb.b * 1e9) < floor(pt.b * 1e9) AS INTEGER)) AS p_below FROM pt JOIN rb USING (population) GROUP BY pt.population"))
def bias_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO11: the persistent part against what resampling alone puts there."""
    v, rb = _bias_replicates(spark, sf_dir)
    j = v.groupBy("population", "j").agg(F.avg("a_in").alias("mu"), F.avg(F.col("a_in") ** 2).alias("m2"), F.count("*").alias("n"))
    pt = j.groupBy("population").agg(F.sum(F.col("mu") ** 2).alias("b0"), F.sum(F.col("m2") - F.col("mu") ** 2).alias("v0"), F.max("n").alias("n"))
    s = pt.join(rb, "population").groupBy("population", "b0", "v0", "n").agg(F.avg("b").alias("mean_b"), F.avg((F.floor(F.col("b") * 1e9) < F.floor(F.col("b0") * 1e9)).cast("double")).alias("p_below"))
    return pick(s.select("population", F.col("b0").alias("b"), F.col("v0").alias("v"), (F.col("v0") / (F.col("n") / float(B.BLOCK))).alias("floor"), (F.col("mean_b") - F.col("b0")).alias("shift"), (2 * F.col("b0") - F.col("mean_b")).alias("debiased"), "p_below"), "population | b:7 v:6 floor:7 shift:7 debiased:7 p_below:6")


@query(ask("n_used | median:3 p_lt_30:6 p_gt_90:6", f"{_VEC}, w AS (SELECT rep, max(CASE WHEN population = 0 THEN b END) AS b0, max(CASE WHEN population = 0 THEN m END) AS m0, max(CASE WHEN population = 1 THEN b END) AS b1, max(CASE WHEN population = 1 THEN m END) AS m1, max(CASE WHEN population = 2 THEN b END) AS b2, max(CASE WHEN population = 2 THEN m END) AS m2 FROM rb GROUP BY rep), g AS (SELECT floor(degrees(acos(greatest(-1, least(1, ((b1 - b0) * (b2 - b0) + (m1 - m0) * (m2 - m0)) / (sqrt((b1 - b0) * (b1 - b0) + (m1 - m0) * (m1 - m0)) * sqrt((b2 - b0) * (b2 - b0) + (m2 - m0) * (m2 - m0))))))) * 1e5 + 0.5) / 1e5 AS a FROM w)", "SELECT count(a) AS n_used, median(a) AS median, avg(CAST(a < 30 AS INTEGER)) AS p_lt_30, avg(CAST(a > 90 AS INTEGER)) AS p_gt_90 FROM g"))
def change_angle_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO12: the angle between two populations' changes, replicate by replicate."""
    from fieldloom.functions.scalars import quantize, vector_angle

    rb = _bias_replicates(spark, sf_dir, "population < 3")[1]
    w = rb.groupBy("rep").pivot("population", [0, 1, 2]).agg(F.first("b").alias("b"), F.first("m").alias("m"))
    x1, y1, x2, y2 = F.col("1_b") - F.col("0_b"), F.col("1_m") - F.col("0_m"), F.col("2_b") - F.col("0_b"), F.col("2_m") - F.col("0_m")
    a = quantize(vector_angle(x1 * x2 + y1 * y2, x1 * x1 + y1 * y1, x2 * x2 + y2 * y2), 5)
    g = w.select(a.alias("a"))
    return pick(g.agg(F.count("a").alias("n_used"), F.percentile("a", F.lit(0.5)).alias("median"), F.avg((F.col("a") < 30).cast("double")).alias("p_lt_30"), F.avg((F.col("a") > 90).cast("double")).alias("p_gt_90")), "n_used | median:3 p_lt_30:6 p_gt_90:6")


_RATIOS = f"""{_VEC}, w AS (SELECT rep, max(b) FILTER (population = 0) AS b0, max(m) FILTER (population = 0) AS m0, max(b) FILTER (population = 1) AS b1, max(m) FILTER (population = 1) AS m1, max(b) FILTER (population = 2) AS b2, max(m) FILTER (population = 2) AS m2 FROM rb WHERE population < 3 GROUP BY rep),
c AS (SELECT 'persistent_share_of_change' AS name, CASE WHEN m2 <> m0 THEN (b2 - b0) / (m2 - m0) END AS x FROM w UNION ALL SELECT 'difference_of_changes', (m1 - m0) - (m2 - m0) FROM w UNION ALL SELECT 'persistent_share', CASE WHEN m0 <> 0 THEN b0 / m0 END FROM w)"""


@query(ask("name excludes_zero n_bad | lo:6 hi:6 median:6 sd:6 p_above:6", _RATIOS, "SELECT name, lo > 0 OR hi < 0 AS excludes_zero, n_bad, lo, hi, median, sd, p_above FROM (SELECT name, count(*) - count(x) AS n_bad, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, median(x) AS median, stddev_samp(x) AS sd, avg(CAST(x > 0 AS INTEGER)) AS p_above FROM c GROUP BY name)"))
def ratio_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO10: the comparison record of heavy-tailed ratios. The persistent share of a change (populations 0 and 2, whose replicates are
    unpaired, so its denominator may come near zero), the difference of two changes that share population 0's replicate, and a
    paired ratio. Replicates without a finite value are counted and left out. It compares three populations by design."""
    rb = _bias_replicates(spark, sf_dir, "population < 3")[1]
    w = rb.groupBy("rep").pivot("population", [0, 1, 2]).agg(F.first("b").alias("b"), F.first("m").alias("m"))
    v = {n: F.col(f"{n[1]}_{n[0]}") for n in ("b0", "m0", "b1", "m1", "b2", "m2")}
    values = {
        "persistent_share_of_change": F.when(v["m2"] != v["m0"], (v["b2"] - v["b0"]) / (v["m2"] - v["m0"])),
        "difference_of_changes": (v["m1"] - v["m0"]) - (v["m2"] - v["m0"]),
        "persistent_share": F.when(v["m0"] != 0, v["b0"] / v["m0"]),
    }
    rows = w.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), x.alias("x")) for k, x in values.items()])))
    return pick(B.comparison(rows, ["name"], "x"), "name excludes_zero n_bad | lo:6 hi:6 median:6 sd:6 p_above:6")


_SHARE = f"""{_SPLIT}, v AS (SELECT population, row_number() OVER (PARTITION BY population ORDER BY day_idx) - 1 AS day_idx, a2, ain FROM d WHERE population < 2), sizes AS (SELECT population, count(*) AS n FROM v GROUP BY population), starts AS ({starts_sql('sizes')}), {sums_sql(['a2', 'ain'], 'population', 'v')},
m AS (SELECT population, rep, a2 / n AS a2, ain / n AS ain FROM sums JOIN sizes USING (population)), s AS (SELECT o.rep, o.a2 - b.a2 AS dc, (o.ain - b.ain) / nullif(o.a2 - b.a2, 0) AS share FROM m o JOIN m b ON o.rep = b.rep AND o.population = 1 AND b.population = 0)"""


@query(ask("n n_valid | lo:4 hi:4", _SHARE, "SELECT count(*) AS n, count(*) FILTER (dc > 0) AS n_valid, quantile_cont(share, 0.025) FILTER (dc > 0) AS lo, quantile_cont(share, 0.975) FILTER (dc > 0) AS hi FROM s"))
def attribution_share_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BO13: shares of the change from population 0 to 1, only from replicates whose denominator is positive."""
    v = _daily_parts(spark, sf_dir).where("population < 2").withColumn("day_idx", F.row_number().over(Window.partitionBy("population").orderBy("day_idx")) - 1)
    sizes = v.groupBy("population").agg(F.count("*").alias("n"))
    s = B.block_sums(v.withColumn("one", F.lit(1.0)), B.block_starts(sizes, REPS), ["population"], ["a2", "ain", "one"])
    m = s.select("population", "rep", (F.col("a2") / F.col("one")).alias("a2"), (F.col("ain") / F.col("one")).alias("ain"))
    b = m.where("population = 0").select("rep", F.col("a2").alias("a20"), F.col("ain").alias("ain0"))
    x = m.where("population = 1").join(b, "rep").select((F.col("a2") - F.col("a20")).alias("dc"), (F.col("ain") - F.col("ain0")).alias("di"))
    share = F.when(F.col("dc") > 0, F.col("di") / F.col("dc"))
    return pick(x.agg(F.count("*").alias("n"), F.count_if(F.col("dc") > 0).alias("n_valid"), F.percentile(share, F.lit(0.025)).alias("lo"), F.percentile(share, F.lit(0.975)).alias("hi")), "n n_valid | lo:4 hi:4")


@query(ask("population | total_rms:6 inside_rms:6 outside_fraction:7 p95:5", f"{_SPLIT}, m AS (SELECT population, j, avg(p_in - t_in) AS i, avg(p_out - t_out) AS o FROM h GROUP BY ALL)", "SELECT population, sqrt(sum(i * i + o * o)) AS total_rms, sqrt(sum(i * i)) AS inside_rms, sum(o * o) / sum(i * i + o * o) AS outside_fraction, quantile_cont(abs(o), 0.95) AS p95 FROM m GROUP BY population"))
def displacement_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DE10: a mean displacement projected on the span."""
    z = _residuals(spark, sf_dir).select("population", F.posexplode(F.arrays_zip("p_in", "t_in", "p_out", "t_out")).alias("j", "z"))
    m = z.groupBy("population", "j").agg(F.avg(F.col("z.p_in") - F.col("z.t_in")).alias("i"), F.avg(F.col("z.p_out") - F.col("z.t_out")).alias("o"))
    i2, o2 = F.sum(F.col("i") ** 2), F.sum(F.col("o") ** 2)
    return pick(m.groupBy("population").agg(F.sqrt(i2 + o2).alias("total_rms"), F.sqrt(i2).alias("inside_rms"), (o2 / (i2 + o2)).alias("outside_fraction"), F.percentile(F.abs("o"), F.lit(0.95)).alias("p95")), "population | total_rms:6 inside_rms:6 outside_fraction:7 p95:5")


#: What a step along a pixel without variance counts.
FLAT = 1e15


@query()
def shrinkage_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QU6, QU7: Mahalanobis and diagonal distances to population 0 under a shrunk covariance."""
    f = _fields(spark, sf_dir)
    own = f.where("population = 0")
    n, mean, cov = L.moments(own, "x")
    z = F.zip_with("x", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b)
    fourth = own.agg(F.coalesce(F.sum(dot(z, z) ** 2), F.lit(0.0))).first()[0]
    _, factor = L.shrunk_factor(n, cov, fourth)
    d = L.apply_matrix(f, "x", factor.whitening(), "z", ["day_idx", "population", "x"], mean)
    variance = np.diag(cov)
    per = np.divide(1.0, np.sqrt(variance), out=np.full(len(variance), FLAT), where=variance > 0)
    diag = F.zip_with(z, F.array(*[F.lit(float(v)) for v in per]), lambda a, s: a * s)
    return pick(d.select("day_idx", "population", F.sqrt(dot(F.col("z"), F.col("z"))).alias("mahalanobis"), F.sqrt(dot(diag, diag)).alias("diagonal")), "day_idx population | mahalanobis:6 diagonal:6")
