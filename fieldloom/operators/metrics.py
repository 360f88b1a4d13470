"""Weighted error statistics as algebraic sums and their finishing steps.

Every statistic is a ratio of sums, so Spark combines partial sums on the map side and one small exchange on the group
keys is all that is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalars import is_finite, skill_mse, skill_rmse


def wsum(x: Column | str) -> Column:
    return F.sum(F.col("w") * (F.col(x) if isinstance(x, str) else x))


def with_periods(df: DataFrame) -> DataFrame:
    """Every row once for 'annual' and once for its season: grouping sets for overlapping periods."""
    return df.withColumn("period", F.explode(F.array(F.lit("annual"), F.col("season"))))


def error_sums(df: DataFrame, by: list[str], methods: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """w and, for each method and the baseline, sums of weighted squared (e2), absolute (ea) and plain (e1) errors."""
    out = [F.sum("w").alias("w")]
    for m in (*methods, "base"):
        e = F.col(f"err_{m}")
        out += [wsum(e * e).alias(f"{m}_e2"), wsum(F.abs(e)).alias(f"{m}_ea"), wsum(e).alias(f"{m}_e1")]
    return df.groupBy(*by).agg(*out)


def roll_up(sums: DataFrame, grid: DataFrame, by: list[str], land_inclusive: bool = True, periods: bool = False) -> DataFrame:
    """Sums by cell (and season) added up to overlapping regions (and periods).

    The field is aggregated once, to a row a cell at most; only these few rows are multiplied by their regions.
    """
    from .masks import by_region

    keys = [c for c in ("cell", "season", *by) if c in sums.columns]
    cells = by_region(sums.join(F.broadcast(grid.select("cell", "lat", "lsm", "oro_m")), "cell"), land_inclusive=land_inclusive)
    cells = with_periods(cells) if periods else cells
    out = ["region", *(["period"] if periods else []), *by]
    return cells.groupBy(*out).agg(*[F.sum(c).alias(c) for c in sums.columns if c not in keys])


def error_metrics(sums: DataFrame, methods: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """rmse, mae, bias of each method and the baseline, and skills of both forms against the baseline."""
    new = {}
    for m in (*methods, "base"):
        new |= {f"{m}_rmse": F.sqrt(F.col(f"{m}_e2") / F.col("w")), f"{m}_mae": F.col(f"{m}_ea") / F.col("w"), f"{m}_bias": F.col(f"{m}_e1") / F.col("w")}
    for m in methods:
        new |= {f"{m}_skill": skill_rmse(f"{m}_e2", "base_e2"), f"{m}_skill_mse": skill_mse(f"{m}_e2", "base_e2")}
    return sums.withColumns(new)


def correction_sums(df: DataFrame, by: list[str], method: str = "a") -> DataFrame:
    """The eight accumulators: squared, absolute and plain errors of method and baseline, rh2 and cross of the corrections."""
    e, b = F.col(f"err_{method}"), F.col("err_base")
    correction, required = F.col(f"pred_{method}") - F.col("base"), F.col("target") - F.col("base")
    sums = {"err2": wsum(e * e), "abs_err": wsum(F.abs(e)), "err": wsum(e), "err2_base": wsum(b * b), "abs_base": wsum(F.abs(b)), "err_base": wsum(b), "rh2": wsum(correction * correction), "cross": wsum(correction * required)}
    return df.groupBy(*by).agg(F.sum("w").alias("w"), F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])


def correction_metrics(sums: DataFrame) -> DataFrame:
    """rmse, mae, bias, error_std, skill, uncentred correlation and amplitude ratio of the corrections."""
    mse, bias = F.col("err2") / F.col("w"), F.col("err") / F.col("w")
    return sums.withColumns(
        {
            "rmse": F.sqrt(mse),
            "mae": F.col("abs_err") / F.col("w"),
            "bias": bias,
            "error_std": F.sqrt(F.greatest(mse - bias * bias, F.lit(0.0))),
            "base_rmse": F.sqrt(F.col("err2_base") / F.col("w")),
            "base_mae": F.col("abs_base") / F.col("w"),
            "base_bias": F.col("err_base") / F.col("w"),
            "skill": skill_mse("err2", "err2_base"),
            "correction_corr": F.when((F.col("rh2") > 0) & (F.col("err2_base") > 0), F.col("cross") / F.sqrt(F.col("rh2") * F.col("err2_base"))),
            "amplitude_ratio": F.when(F.col("err2_base") > 0, F.sqrt(F.col("rh2") / F.col("err2_base"))),
        }
    )


def centred_correction(df: DataFrame, by: list[str], method: str = "b") -> DataFrame:
    """Means, deviations, rms and largest sizes of correction and requirement, and their centred correlation.

    Null where the weights sum to nothing or a variance is at most 1e-20.
    """
    c, r = F.col(f"pred_{method}") - F.col("base"), F.col("target") - F.col("base")
    s = df.groupBy(*by).agg(F.sum("w").alias("w"), *[wsum(x).alias(n) for n, x in (("c", c), ("r", r), ("cc", c * c), ("rr", r * r), ("cr", c * r))], F.max(F.abs(c)).alias("correction_absmax"), F.max(F.abs(r)).alias("required_absmax"))
    s = s.where("w > 1e-20")
    mean = {n: F.col(n) / F.col("w") for n in ("c", "r", "cc", "rr", "cr")}
    vc, vr = (F.greatest(mean[n * 2] - mean[n] * mean[n], F.lit(0.0)) for n in ("c", "r"))
    corr = F.when((vc > 1e-20) & (vr > 1e-20), (mean["cr"] - mean["c"] * mean["r"]) / F.sqrt(vc * vr))
    return s.withColumns({"correction_mean": mean["c"], "correction_std": F.sqrt(vc), "correction_rms": F.sqrt(mean["cc"]), "required_mean": mean["r"], "required_std": F.sqrt(vr), "required_rms": F.sqrt(mean["rr"]), "corr": corr})


def cell_maps(df: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted error sums a cell over its finite days: n, rmse, mae, bias, base_rmse, skill."""
    ok = is_finite("err_b") & is_finite("err_base")
    e, b = F.when(ok, F.col("err_b")), F.when(ok, F.col("err_base"))
    s = df.groupBy(*by).agg(F.count(e).alias("n"), F.sum(e).alias("e1"), F.sum(F.abs(e)).alias("ea"), F.sum(e * e).alias("e2"), F.sum(b * b).alias("b2"))
    n = F.nullif(F.col("n"), F.lit(0))
    return s.withColumns({"rmse": F.sqrt(F.col("e2") / n), "mae": F.col("ea") / n, "bias": F.col("e1") / n, "base_rmse": F.sqrt(F.col("b2") / n), "skill": F.when(F.col("b2") > 0, 1 - F.try_divide(F.col("e2"), F.nullif(F.col("b2"), F.lit(0.0))))})


def weighted_moments(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Weighted mean, mean square, rms and standard deviation."""
    s = df.groupBy(*by).agg(F.sum("w").alias("w"), wsum(x).alias("s1"), wsum(F.col(x) * F.col(x)).alias("s2"))
    m, m2 = F.col("s1") / F.col("w"), F.col("s2") / F.col("w")
    return s.withColumns({"wmean": m, "wmeansq": m2, "wrms": F.sqrt(m2), "wstd": F.sqrt(F.greatest(m2 - m * m, F.lit(0.0)))})


def weighted_correlation(df: DataFrame, by: list[str], x: str, y: str, centred: bool = True) -> DataFrame:
    """Weighted Pearson correlation (corr); uncentred if asked. Null without variance.

    The centred form shifts both columns by a group's weighted means first, so that large means lose no digits.
    """
    if centred:
        means = df.groupBy(*by).agg((wsum(x) / F.sum("w")).alias("_mx"), (wsum(y) / F.sum("w")).alias("_my"))
        df = df.join(means, by) if by else df.crossJoin(F.broadcast(means))
        a, b = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    else:
        a, b = F.col(x), F.col(y)
    s = df.groupBy(*by).agg(wsum(a * a).alias("aa"), wsum(b * b).alias("bb"), wsum(a * b).alias("ab"))
    return s.withColumn("corr", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))))


def finite_summary(df: DataFrame, by: list[str], x: str, lo: float, hi: float) -> DataFrame:
    """Counts and percentages outside [lo, hi], range and number of the finite values."""
    v = F.when(is_finite(x), F.col(x))
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(v).alias("n_finite"), F.count_if(v < lo).alias("n_below"), F.count_if(v > hi).alias("n_above"), F.min(v).alias("min"), F.max(v).alias("max"))
    share = lambda c: F.try_divide(F.lit(100.0) * F.col(c), F.nullif(F.col("n_finite"), F.lit(0)))
    return s.withColumns({"pct_below": share("n_below"), "pct_above": share("n_above")})
