"""Whitening against NumPy's eigenvectors, and the eigensolver alone."""

import numpy as np
import pytest
from fieldloom.llm import whitening


def test_solver_finds_the_largest_pairs_of_a_wide_spectrum():
    r = np.random.default_rng(1)
    for spectrum in (np.geomspace(1, 1e-6, 300), np.r_[1.0, np.full(40, 0.5), np.linspace(0.4, 0.1, 259)], np.r_[np.ones(3), np.zeros(297)], np.zeros(300)):
        q = np.linalg.qr(r.normal(size=(300, 300)))[0]
        a, calls = (q * spectrum) @ q.T, []
        c = whitening.lobpcg(lambda x: (calls.append(x.shape[1]) or a @ x, float(np.trace(a))), 300, 20)
        assert np.abs(c.values - spectrum[:20]).max() < 1e-11 and c.residual <= 1e-12 and abs(c.trace - spectrum.sum()) < 1e-9
        assert np.abs(c.vectors.T @ c.vectors - np.eye(20)).max() < 1e-12 and max(calls) <= 28


def test_solver_says_so_when_it_cannot_certify():
    noise = np.random.default_rng(2)
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda x: (np.diag(np.arange(50.0)) @ x + 1e-3 * noise.normal(size=x.shape), 1.0), 50, 5)


def plain(rows: list[tuple]) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    usable = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in usable], np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in usable], ((n * x - s) ** 2).sum(axis=1), c @ vectors[:, ::-1][:, :32], values[::-1]


@pytest.mark.parametrize("size", [3, 50])
def test_whitening_equals_the_plain_one(spark, size):
    r = np.random.default_rng(size)
    x = (r.normal(size=(300, size)) * np.linspace(3, 1, size) @ r.normal(size=(size, size))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, []), (902, [None] * size), (903, [float("nan")] * size), (904, [1.0] * (size - 1) + [float("-inf")])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double")
    got = whitening.Whitening.fit(df).apply().collect()
    ids, deviation, along, values = plain(rows)
    many = min(32, size)
    assert len(got) == len(ids) * many and {g.n for g in got} == {len(ids)} and sorted({g.component for g in got}) == list(range(1, many + 1))
    key = lambda i: (i is None, i)
    order = sorted(range(len(ids)), key=lambda k: (key(ids[k]), deviation[k]))
    of = [sorted((g for g in got if g.component == c), key=lambda g: (key(g.vec_id), g.deviation)) for c in range(1, many + 1)]
    got = [g for row in zip(*of, strict=True) for g in row]  # equal rows follow one another whole
    white = np.array([g.whitened for g in got]).reshape(-1, many)
    want = (along[:, :many] / np.sqrt(values[:many]))[order]
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-7
    assert [g.deviation for g in got[::many]] == deviation[order].tolist() and [g.vec_id for g in got[::many]] == [ids[k] for k in order]
    assert np.abs(np.array([g.explained for g in got[:many]]) - values[:many] / values.sum()).max() < 1e-10 and {g.identity_error for g in got}.pop() < 1e-9


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.Whitening.fit(spark.createDataFrame([], schema)).apply().collect() == []
    assert whitening.Whitening.fit(spark.createDataFrame([(1, None), (2, [])], schema)).apply().collect() == []
    one = whitening.Whitening.fit(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).apply().collect()
    assert [(g.component, g.deviation, g.whitened, g.explained, g.identity_error) for g in one] == [(1, 0, None, 0.0, 0.0), (2, 0, None, 0.0, 0.0)] * 2
    flat = [(k, [float(k), 2.0 * k, 5.0]) for k in range(6)] + [(9, [1.0, 2.0])]
    got = whitening.Whitening.fit(spark.createDataFrame(flat, schema)).apply().collect()
    assert len(got) == 18 and [g.whitened is None for g in got[:3]] == [False, True, True] and abs(got[0].explained - 1) < 1e-9
