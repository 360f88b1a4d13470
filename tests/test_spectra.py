"""Spherical power split by order: against scipy-free formulas, whole fields, and what a task holds."""

import math

import numpy as np
import pytest

from fieldloom.operators import spectra


def test_legendre_functions_are_orthonormal():
    x, w = np.polynomial.legendre.leggauss(80)
    for m in (0, 1, 7, 30):
        p = spectra.legendre_functions(m, 60, x)
        assert np.abs(2 * math.pi * (p * w) @ p.T - np.eye(61 - m)).max() < 1e-12
    assert np.allclose(spectra.legendre_functions(0, 1, x)[1], math.sqrt(3 / (4 * math.pi)) * x) and np.allclose(np.abs(spectra.legendre_functions(1, 1, x)[0]), math.sqrt(3 / (8 * math.pi)) * np.sqrt(1 - x**2))


def test_operators_of_a_range_of_orders_are_small_at_degree_426():
    held = spectra.row_operators(400, 408, 640, 426, 640, True, False)
    assert [k.shape for k in held] == [(427 - m, 640) for m in range(400, 408)] and all(np.isfinite(k).all() for k in held)
    assert spectra.ORDERS * 427 * 640 * 8 < 36e6  # the widest range, in double precision


@pytest.mark.parametrize("single", [False, True])
def test_days_split_by_order_equal_whole_fields(spark, single):
    r = np.random.default_rng(1)
    x = r.normal(size=(20, 24, 96)) + 3
    rows = spark.createDataFrame([(d, k, v.tolist()) for d, f in enumerate(x) for k, v in enumerate(f)], "day_idx long, row int, vals array<double>").repartition(5)
    got = np.zeros((20, 41))
    for row in spectra.spherical_spectrum(rows, 24, 40, 48, single=single).collect():
        got[row.day_idx, row.ell] = row.power
    want = spectra.degree_power(x, 40, 48)
    assert np.abs(got - want).max() < (1e-5 if single else 1e-13) * want.max()
    with pytest.raises(Exception, match="lacks rows"):
        spectra.spherical_spectrum(rows.where("day_idx < 1 AND row <> 3"), 24, 40, 48).collect()


def test_a_constant_has_no_power_and_its_mean_can_stay():
    x = np.full((1, 32, 64), 5.0)
    assert spectra.degree_power(x, 6, 32)[0].max() < 1e-25
    assert np.isclose(spectra.degree_power(x, 6, 32, remove_mean=False)[0, 0], 25 * 4 * math.pi)
