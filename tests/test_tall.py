"""Canonical correlation by triangular factors against NumPy."""

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.operators import adapters as A
from fieldloom.operators import linalg, tall
from fieldloom.plans import algebra, registry

from .test_queries import DATA


def made(spark, n: int, kx: int, ky: int, shared: int, seed: int):
    """(x, y) frames and matrices: y shares some directions with x."""
    r = np.random.default_rng(seed)
    mix = r.normal(size=(shared, kx)) / np.sqrt(kx)

    def rows(k: np.ndarray) -> np.ndarray:
        out = np.empty((len(k), kx + ky))
        for at, seed_ in enumerate(k.tolist()):
            out[at] = np.random.default_rng(seed_).normal(size=kx + ky)
        out[:, kx : kx + shared] += 2 * out[:, :kx] @ mix.T * np.linspace(2, 0.2, shared)
        return out + 3.0

    def make(batches):
        for b in batches:
            v = rows(b.column("id").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(v[:, :kx]), pa.list_(pa.float64())), pa.array(list(v[:, kx:]), pa.list_(pa.float64()))], ["k", "x", "y"])

    v = rows(np.arange(n))
    return spark.range(n).mapInArrow(make, "k long, x array<double>, y array<double>"), v[:, :kx], v[:, kx:]


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    q = [np.linalg.qr(v - v.mean(0))[0] for v in (x, y)]
    return np.linalg.svd(q[0].T @ q[1], compute_uv=False)


def least_squares(x: np.ndarray, y: np.ndarray, rank: int, new: np.ndarray) -> np.ndarray:
    """The regression on the leading canonical pairs, by its definition."""
    qx, qy = (np.linalg.qr(v - v.mean(0))[0] for v in (x, y))
    u, rho, vt = np.linalg.svd(qx.T @ qy)
    k = min(rank, len(rho))
    b = np.linalg.lstsq(x - x.mean(0), qx @ (u[:, :k] * rho[:k]) @ vt[:k] @ (qy.T @ (y - y.mean(0))), rcond=None)[0]
    return (new - x.mean(0)) @ b + y.mean(0)


def test_triangular_solves():
    r = np.random.default_rng(1)
    u, w = np.triu(r.normal(size=(200, 200))) + 20 * np.eye(200), r.normal(size=(30, 200))
    assert np.abs(tall.solve_right(w, u) @ u - w).max() < 1e-12 and np.abs(u @ tall.solve_upper(u, w.T) - w.T).max() < 1e-12


@pytest.mark.parametrize("block", [5, 16, 512])
def test_correlations_of_leading_scores(spark, monkeypatch, block):
    monkeypatch.setattr(tall, "CHUNK_BYTES", 8 * 50 * 37)
    df, x, y = made(spark, 400, 40, 10, 6, 2)
    c = tall.TallCanonical(df, block=block)
    for kx, ky in ((40, 10), (33, 7), (4, 10), (16, 1)):
        p = c.pair(kx, ky)
        assert np.abs(p.rho - correlations(x[:, :kx], y[:, :ky])).max() < 1e-11
        z = (x[:, :kx] - p.x_mean) @ p.into
        assert np.abs(np.cov(z.T) - np.eye(p.rank)).max() < 1e-10
        for rank in (1, p.rank):
            few = c.pair(kx, ky, rank)
            got = np.array([r.y_hat for r in few.predict(df, ["k"]).orderBy("k").collect()])
            assert np.abs(got - least_squares(x[:, :kx], y[:, :ky], rank, x[:, :kx])).max() < 1e-9
    pairs = [c.pair(40, 10), c.pair(12, 4)]
    for p, errors in zip(pairs, tall.rank_errors(df, pairs), strict=True):
        kx, ky = len(p.x_mean), len(p.y_mean)
        for rank in range(1, p.rank + 1):
            hat = np.zeros_like(y)
            hat[:, :ky] = least_squares(x[:, :kx], y[:, :ky], rank, x[:, :kx])
            assert abs(errors[rank - 1] - ((hat - y) ** 2).mean()) < 1e-9
    c.drop()


def test_dependent_and_ill_conditioned_columns(spark):
    _, x, y = made(spark, 300, 20, 6, 4, 3)
    x[:, 7] = x[:, 1] + x[:, 2]
    x[:, 9] = 4.0
    x[:, 12] = x[:, 3] + 1e-7 * x[:, 12]
    y[:, 2] = y[:, 0] * 2
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x array<double>, y array<double>")
    apart_x, apart_y = np.delete(x, [7, 9], axis=1), np.delete(y, 2, axis=1)
    for block in (4, 20):
        p = tall.TallCanonical(df, block=block).pair()
        assert np.abs(p.rho - correlations(apart_x, apart_y)).max() < 1e-8 and not p.into[[7, 9]].any()
        got = np.array([r.y_hat for r in p.predict(df, ["k"]).orderBy("k").collect()])
        want = np.column_stack([np.ones(300), apart_x])
        assert np.abs(got - want @ np.linalg.lstsq(want, y, rcond=None)[0]).max() < 1e-6


def test_ridge_equals_the_regularised_covariances(spark):
    df, x, y = made(spark, 200, 12, 5, 3, 4)
    got = tall.TallCanonical(df, ridge=0.3, block=5).pair(9, 4)
    cov = np.cov(np.hstack((x, y)).T)
    roots = []
    for a, n in ((0, 9), (12, 4)):
        values, vectors = np.linalg.eigh(cov[a : a + n, a : a + n] + 0.3 * np.eye(n))
        roots.append((vectors / np.sqrt(values)) @ vectors.T)
    assert np.abs(got.rho - np.linalg.svd(roots[0] @ cov[:9, 12:16] @ roots[1], compute_uv=False)).max() < 1e-10


def test_scores_beyond_one_matrix(spark, monkeypatch):
    """6,000 and 512 scores of 7,000 days: their covariance would take 339 MB. Panels come to the driver, of 32 MB at most."""
    df, x, y = made(spark, 7_000, 6_000, 512, 20, 5)
    sizes, collect = [], tall.TallCanonical._collect
    monkeypatch.setattr(tall.TallCanonical, "_collect", staticmethod(lambda *a: (lambda m: (sizes.append(m.nbytes), m)[1])(collect(*a))))
    c = tall.TallCanonical(df)
    p = c.pair(rank=20)
    assert np.abs(p.rho - correlations(x, y)).max() < 1e-8 and max(sizes) <= tall.PANEL_BYTES
    z = (x - p.x_mean) @ p.into
    assert np.abs(np.cov(z.T) - np.eye(20)).max() < 1e-8
    c.drop()


def test_odd_tables_are_refused(spark):
    schema = "x array<double>, y array<double>"
    for rows in ([], [([1.0], [1.0]), ([1.0, 2.0], [1.0])], [([], [1.0])], [(None, [1.0])]):
        with pytest.raises(ValueError, match="equal sizes"):
            tall.TallCanonical(spark.createDataFrame(rows, schema))


def test_canonical_queries(spark):
    m = A.matrices(spark, DATA)
    z, v = ([(np.array(r.x), np.array(r.y)) for r in m.where(f"split = '{s}'").collect()] for s in ("train", "val"))
    (x, y), (vx, vy) = (tuple(np.array(k) for k in zip(*part, strict=True)) for part in (z, v))
    got = registry.queries()["canonical_spectrum"](spark, DATA).orderBy("k").collect()
    assert np.abs([r.rho for r in got] - correlations(x, y)).max() < 1e-7
    rows = registry.queries()["canonical_grid"](spark, DATA).collect()
    assert len(rows) == len({(r.kx, r.ky, r["rank"], r.ridge) for r in rows}) > 465
    plain = linalg.ScoreMoments(m.where("split = 'train'").select(linalg.F.concat("x", "y").alias("xy")))
    for r in rows[:: len(rows) // 40]:
        f = plain.canonical(r.kx, r.ky, r["rank"], r.ridge)
        hat = np.zeros_like(vy)
        hat[:, : r.ky] = (vx[:, : r.kx] - f.x_mean) @ f.b + f.y_mean
        assert abs(r.mse - ((hat - vy) ** 2).mean()) < 1e-7
    assert algebra.GRID_SCORES[-1] == 32
