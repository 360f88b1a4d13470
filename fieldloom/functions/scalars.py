"""Column functions: calendar, weights, grids, normalisation, skills and rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ColumnLike = Column | str

# Fixed normalisation constants: field = mean + norm * std.
INPUT_MEAN, INPUT_STD = 277.8568272051984, 21.581598298286263
TARGET_MEAN, TARGET_STD = 277.8518781731243, 21.627892139211994
TISR_MEAN, TISR_STD = 3223042.5108223786, 1786193.5906606768
OROGRAPHY_MEAN, OROGRAPHY_STD = 378.4575587133781, 850.5399656115172

SEASONS = ("DJF", "MAM", "JJA", "SON")


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quantize(x: ColumnLike, digits: int = 6) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits: the same in every engine, unlike round()."""
    scale = float(10**digits)
    return F.floor(col(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def season_name(date: ColumnLike) -> Column:
    """DJF, MAM, JJA or SON by month alone: a December belongs to its own year's DJF."""
    m = F.month(col(date))
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def is_leap_day(date: ColumnLike) -> Column:
    return (F.month(col(date)) == 2) & (F.dayofmonth(col(date)) == 29)


def cosine_weight(lat: ColumnLike, over: WindowSpec | None = None) -> Column:
    """cos(lat) over its mean; over is the window of one row per latitude row (not per cell)."""
    c = F.cos(F.radians(col(lat)))
    return c / F.avg(c).over(over or W.partitionBy())


def cosine_weight_single(lat: ColumnLike, over: WindowSpec | None = None) -> Column:
    """The single-precision convention: float cosine over a float mean, then widened."""
    c = F.cos(F.radians(col(lat))).cast("float")
    return (c / F.avg(c).over(over or W.partitionBy()).cast("float")).cast("float").cast("double")


def grid_weight(lat: ColumnLike, rows: int) -> Column:
    """cosine_weight on the regular grid of so many rows, with the mean as a constant: no window needed."""
    mean = math.fsum(math.cos(math.radians(-90 + (k + 0.5) * 180 / rows)) for k in range(rows)) / rows
    return F.cos(F.radians(col(lat))) / F.lit(mean)


def cell_area_weight(row: ColumnLike, rows: int) -> Column:
    """sin(upper edge) - sin(lower edge) of a regular latitude row; all rows sum to 2."""
    step = 180.0 / rows
    lo = F.lit(-90.0) + col(row) * F.lit(step)
    return F.sin(F.radians(lo + F.lit(step))) - F.sin(F.radians(lo))


def row_latitude(row: ColumnLike, rows: int) -> Column:
    return F.lit(-90.0) + (col(row) + F.lit(0.5)) * F.lit(180.0 / rows)


def column_longitude(column: ColumnLike, columns: int) -> Column:
    return (col(column) + F.lit(0.5)) * F.lit(360.0 / columns)


def lon180(lon: ColumnLike) -> Column:
    """Longitude in [-180, 180); the modulo is never negative."""
    return F.pmod(col(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def normalize(x: ColumnLike, mean: float, std: float) -> Column:
    return (col(x).cast("double") - F.lit(mean)) / F.lit(std)


def denormalize(x: ColumnLike, mean: float = TARGET_MEAN, std: float = TARGET_STD) -> Column:
    return col(x).cast("double") * F.lit(std) + F.lit(mean)


def baseline_in_target_units(x: ColumnLike, single: bool = False) -> Column:
    """An input-normalised value in target-normalised units; single rounds to float at every step."""
    scale, offset = INPUT_STD / TARGET_STD, (INPUT_MEAN - TARGET_MEAN) / TARGET_STD
    if single:
        product = (col(x).cast("float") * F.lit(scale).cast("float")).cast("float")
        return (product + F.lit(offset).cast("float")).cast("float")
    return col(x).cast("double") * F.lit(scale) + F.lit(offset)


def skill_mse(mse: ColumnLike, reference: ColumnLike) -> Column:
    """1 - mse / reference; null where the reference is 0."""
    return F.lit(1.0) - F.try_divide(col(mse), F.nullif(col(reference), F.lit(0.0)))


def skill_rmse(mse: ColumnLike, reference: ColumnLike) -> Column:
    """1 - rmse / reference rmse, from the two mean squares."""
    return F.lit(1.0) - F.try_divide(F.sqrt(col(mse)), F.nullif(F.sqrt(col(reference)), F.lit(0.0)))


def masked_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b; NaN where either is missing or not finite, or b is 0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    bad = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")) | (F.abs(b) == float("inf")) | (b == 0)
    return F.when(bad, F.lit(float("nan"))).otherwise(F.try_divide(a, b))


def is_finite(x: ColumnLike) -> Column:
    """Neither null, NaN nor infinite."""
    x = col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def vector_angle(dot: ColumnLike, aa: ColumnLike, bb: ColumnLike) -> Column:
    """Degrees between vectors of squared lengths aa and bb; the cosine is clipped. Null if either has no length."""
    c = F.try_divide(col(dot), F.sqrt(col(aa)) * F.sqrt(col(bb)))
    return F.when((col(aa) > 0) & (col(bb) > 0), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))))


def percentage_points(now: ColumnLike, before: ColumnLike) -> Column:
    return F.lit(100.0) * (col(now) - col(before))


def sha256(x: ColumnLike) -> Column:
    return F.sha2(col(x).cast("string"), 256)


def spherical_degree_max(dlat: float, dlon: float) -> int:
    return int(math.floor(360.0 / (6.0 * max(dlat, dlon))))


def resolved_degree(dlat: Column, dlon: Column) -> Column:
    """spherical_degree_max of columns."""
    return F.floor(F.lit(360.0) / (6.0 * F.greatest(dlat, dlon))).cast("int")


def unit_columns(names: list[str], std: float = TARGET_STD) -> dict[str, Column]:
    """Physical twins of normalised columns by suffix: _norm2 to _K2 (times std squared), _norm to _K (times std)."""
    out = {}
    for n in names:
        if n.endswith("_norm2"):
            out[n[:-6] + "_K2"] = F.col(n) * F.lit(std * std)
        elif n.endswith("_norm"):
            out[n[:-5] + "_K"] = F.col(n) * F.lit(std)
    return out
