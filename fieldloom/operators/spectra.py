"""Zonal and spherical power spectra of row arrays, as Arrow batches of FFTs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import _rows


def one_sided_power(x: np.ndarray, detrend: bool = True) -> np.ndarray:
    """Power by wavenumber whose sum is the row's sum of squares; inner wavenumbers count twice."""
    x = x - x.mean(-1, keepdims=True) if detrend else x
    c = np.fft.rfft(x, axis=-1, norm="ortho")
    p = c.real**2 + c.imag**2
    p[..., 1 : (-1 if x.shape[-1] % 2 == 0 else None)] *= 2.0
    return p


def mean_amplitude_power(x: np.ndarray) -> np.ndarray:
    """The other convention: squared amplitudes of rfft / width, not detrended and not doubled."""
    return np.abs(np.fft.rfft(x, axis=-1) / x.shape[-1]) ** 2


CONVENTIONS = {"one_sided": one_sided_power, "mean_amplitude": mean_amplitude_power}


def zonal_power(df: DataFrame, column: str, keep: list[str], convention: str = "one_sided") -> DataFrame:
    """keep and power (array by wavenumber) of each row array."""
    f = CONVENTIONS[convention]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b, column)
            if len(x):
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(list(f(x)), pa.list_(pa.float64()))], [*keep, "power"])

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, column).mapInArrow(run, f"{fields}, power array<double>")


def weighted_spectrum(power: DataFrame, by: list[str], weight: str, k_max: int | None = None) -> DataFrame:
    """(by, k, power): weighted mean over rows and days."""
    cells = power.select(*by, weight, F.posexplode("power").alias("k", "p"))
    if k_max is not None:
        cells = cells.where(F.col("k") <= k_max)
    return cells.groupBy(*by, "k").agg((F.sum(F.col(weight) * F.col("p")) / F.sum(weight)).alias("power"))


def cubic_rows(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rows of four-point Lagrange weights that take values on source latitudes to target latitudes."""
    out = np.zeros((len(target), len(source)))
    base = np.clip(np.searchsorted(source, target) - 2, 0, len(source) - 4)
    for r, (b, v) in enumerate(zip(base, target, strict=True)):
        x = source[b : b + 4]
        for p in range(4):
            others = np.delete(x, p)
            out[r, b + p] = np.prod((v - others) / (x[p] - others))
    return out


#: Orders whose row operators a task holds together: at degree 426 and 640 rows some 35 MB.
ORDERS = 16


def legendre_functions(m: int, ell_max: int, x: np.ndarray) -> np.ndarray:
    """Orthonormal associated Legendre functions of one order, a row a degree from m to ell_max, up to a sign."""
    k = np.arange(1, m + 1)
    log_size = 0.5 * (math.log((2 * m + 1) / (4 * math.pi)) + np.log((2 * k - 1) / (2 * k)).sum())
    out = np.empty((ell_max + 1 - m, len(x)))
    out[0] = np.exp(log_size + 0.5 * m * np.log1p(-(x**2)))
    for n in range(1, len(out)):
        ell = m + n
        scale = math.sqrt((4 * ell * ell - 1) / (n * (ell + m)))
        out[n] = scale * x * out[n - 1]
        if n > 1:
            out[n] -= scale * math.sqrt((n - 1) * (ell + m - 1) / ((2 * ell - 1) * (2 * ell - 3))) * out[n - 2]
    return out


@lru_cache(maxsize=2)
def row_operators(first: int, last: int, rows: int, ell_max: int, gauss: int, remove_mean: bool, single: bool) -> list[np.ndarray]:
    """For each order from first to last (exclusive) the matrix from a zonal wave's values on latitude rows to its coefficients
    of degree: interpolation to Gauss latitudes and quadrature in one.

    Only order 0 knows a field's mean. Taking the mean off at the Gauss latitudes takes off any constant, so it is part of
    that order's matrix and nothing is subtracted from fields.
    """
    lat = -90 + (np.arange(rows) + 0.5) * 180 / rows
    nodes, weights = np.polynomial.legendre.leggauss(gauss)
    mix = cubic_rows(lat, np.degrees(np.arcsin(nodes)))
    out = []
    for m in range(first, last):
        onto = mix - 0.5 * weights @ mix if m == 0 and remove_mean else mix
        out.append(((2 * math.pi * weights * legendre_functions(m, ell_max, nodes)) @ onto).astype(np.float32 if single else np.float64))
    return out


def zonal_waves(x: np.ndarray, ell_max: int, single: bool = False) -> np.ndarray:
    """Fourier coefficients of orders 0 to ell_max of values around latitude rows."""
    x = np.asarray(x, np.float32 if single else np.float64)
    return (np.fft.rfft(x, axis=-1) / x.dtype.type(x.shape[-1]))[..., : ell_max + 1]


def order_power(waves: np.ndarray, first: int, ell_max: int, gauss: int, remove_mean: bool = True, single: bool = False) -> np.ndarray:
    """What orders first, first + 1, ... add to the power of each degree: waves is (row, order). Negative orders count as well."""
    out = np.zeros(ell_max + 1)
    for k, onto in enumerate(row_operators(first, first + waves.shape[1], len(waves), ell_max, gauss, remove_mean, single)):
        size = np.abs(onto @ waves[:, k]).astype(np.float64) ** 2
        out[first + k :] += size if first + k == 0 else 2 * size
    return out / (2 * np.arange(ell_max + 1) + 1)


def degree_power(field: np.ndarray, ell_max: int, gauss: int, remove_mean: bool = True, single: bool = False) -> np.ndarray:
    """Power by spherical degree (mean over orders) of fields (field, row, column)."""
    waves = zonal_waves(field, ell_max, single)
    parts = range(0, waves.shape[-1], ORDERS)
    return np.stack([sum(order_power(w[:, m : m + ORDERS], m, ell_max, gauss, remove_mean, single) for m in parts) for w in waves])


def spherical_spectrum(rows: DataFrame, height: int, ell_max: int, gauss: int, remove_mean: bool = True, single: bool = False) -> DataFrame:
    """(day_idx, ell, power) of fields given as rows (day_idx, row, vals).

    Each row becomes zonal waves by itself. One shuffle brings the rows of a day and a range of orders together; groups
    come range by range, so a task holds the row operators of ORDERS orders and never those of all. single computes waves
    and coefficients in single precision, powers in double. A day that lacks rows is refused.
    """

    def waves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            w = zonal_waves(b.column("vals").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1), ell_max, single)
            for m in range(0, w.shape[1], ORDERS):
                part = w[:, m : m + ORDERS]
                lists = [pa.array(list(v.astype(np.float64)), pa.list_(pa.float64())) for v in (part.real, part.imag)]
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(b), pa.int32()), b.column("day_idx"), b.column("row"), *lists], ["m", "day_idx", "row", "re", "im"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        if len(table) != height:
            raise ValueError("a day lacks rows of its field")
        re, im = (table.column(c).combine_chunks().flatten().to_numpy().reshape(height, -1) for c in ("re", "im"))
        w = (re + 1j * im).astype(np.complex64 if single else np.complex128)
        p = order_power(w, table.column("m")[0].as_py(), ell_max, gauss, remove_mean, single)
        return pa.table([pa.array([table.column("day_idx")[0].as_py()] * len(p), pa.int64()), pa.array(np.arange(len(p)), pa.int32()), pa.array(p)], ["day_idx", "ell", "power"])

    row = rows.select(F.col("day_idx").cast("long").alias("day_idx"), F.col("row").cast("int").alias("row"), "vals")
    parts = row.mapInArrow(waves, "m int, day_idx long, row int, re array<double>, im array<double>")
    return parts.groupBy("m", "day_idx").applyInArrow(run, "day_idx long, ell int, power double").groupBy("day_idx", "ell").agg(F.sum("power").alias("power"))
