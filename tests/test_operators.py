"""Numerical operators against NumPy twins, invariants and published identities."""

import json
import zlib

import numpy as np
import pytest
from fieldloom.operators import bootstrap, distributions, linalg, masks, provenance, spectra, strips
from fieldloom.operators import adapters as A
from fieldloom.plans import algebra, registry
from fieldloom.sources import arrays, tables
from fieldloom.streaming.accumulate import accumulated, stream_error_sums
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def vectors(spark):
    rows = sorted(A.table(spark, DATA, "embeddings").select("vec_id", "embedding").collect())
    return np.array([r.embedding for r in rows], float)


def test_power_obeys_parseval():
    for width in (16, 15, 2, 1):
        x = np.random.default_rng(width).normal(size=(5, width))
        assert np.allclose(spectra.one_sided_power(x, detrend=False).sum(-1), (x**2).sum(-1))


def test_spherical_power_of_pure_harmonics():
    lat = np.radians(-90 + (np.arange(64) + 0.5) * 180 / 64)[:, None]
    lon = np.radians((np.arange(128)) * 360 / 128)[None, :]
    y10 = np.sqrt(3 / (4 * np.pi)) * np.sin(lat) * np.ones_like(lon)
    y21 = np.sqrt(15 / (4 * np.pi)) * np.sin(lat) * np.cos(lat) * np.cos(lon)
    p = spectra.degree_power(np.stack([y10, y21, np.full((64, 128), 5.0)]), 6, 32)
    assert np.allclose(p[0], [0, 1 / 3, 0, 0, 0, 0, 0], atol=1e-6)
    assert np.allclose(p[1], [0, 0, 1 / 5, 0, 0, 0, 0], atol=1e-5)
    assert np.allclose(p[2], 0, atol=1e-20)


def test_moments_and_basis(spark):
    x = vectors(spark)
    df = A.table(spark, DATA, "embeddings").repartition(5)
    n, mean, cov = linalg.moments(df, "embedding")
    assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    b = linalg.fit_basis(df, "embedding", np.ones(64), 12)
    assert b.orthonormality_error() < 1e-9
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)[:12]
    assert np.allclose(np.sqrt(b.eigen.values), s) and b.explained().sum() < 1
    g = (x - x.mean(0)) @ (x - x.mean(0)).T
    e = linalg.temporal_modes(g, 12)
    modes = linalg.rotation(e).T @ (x - x.mean(0))
    assert np.allclose(np.abs(np.sum(modes * b.modes, 1)), 1)
    assert linalg.moments(df.where("false"), "embedding")[0] == 0


def test_canonical_regression(spark):
    m = A.matrices(spark, DATA)
    z = m.select(F.concat("x", "y").alias("xy"))
    fit = linalg.ScoreMoments(z)
    full = fit.canonical(32, 32, 32)
    v = vectors(spark)
    xc, yc = v[:, :32] - v[:, :32].mean(0), v[:, 32:] - v[:, 32:].mean(0)
    assert np.allclose(full.b, np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-8)
    assert (np.diff(full.rho) <= 1e-12).all() and full.rho[0] <= 1 + 1e-9
    rows = linalg.grid_search(z, z, [(32, 32, 32), (8, 8, 2), (4, 4, 1)])
    assert abs(rows[0]["mse"] - ((yc - xc @ full.b) ** 2).mean()) < 1e-9 and rows[0]["mse"] <= rows[1]["mse"] <= rows[2]["mse"]
    out = {r.day_idx: r.y_hat for r in full.predict(m, ["day_idx"]).collect()}
    assert np.allclose(np.array([out[k] for k in sorted(out)]), xc @ full.b + v[:, 32:].mean(0))
    c = np.cov(np.vstack((xc.T, yc.T)))
    root = lambda m, p: (lambda w, q: (q * w**p) @ q.T)(*np.linalg.eigh(m))
    u, rho, vt = np.linalg.svd(root(c[:8, :8], -0.5) @ c[:8, 32:48] @ root(c[32:48, 32:48], -0.5))
    want = root(c[:8, :8], -0.5) @ u[:, :3] @ np.diag(rho[:3]) @ vt[:3] @ root(c[32:48, 32:48], 0.5)
    assert np.allclose(fit.canonical(8, 16, 3).b, want, atol=1e-9) and np.allclose(fit.canonical(8, 16, 3).rho, rho)
    with pytest.raises(ValueError, match="variance"):
        linalg.Factor.of(np.zeros((3, 3)))


def test_factor_of_a_singular_covariance():
    x = np.random.default_rng(3).normal(size=(50, 3)) @ np.random.default_rng(4).normal(size=(3, 5))
    c = np.cov(x.T)
    f = linalg.Factor.of(c)
    assert f.lost == 2 and np.allclose(f.whitening().T @ c @ f.whitening(), np.eye(3)) and np.allclose(f.colouring().T @ f.colouring(), c)
    assert np.allclose(linalg.Factor.of(c, ridge=0.5).colouring().T @ linalg.Factor.of(c, ridge=0.5).colouring(), c + 0.5 * np.eye(5))


def test_shrinkage_equals_its_definition():
    x = np.random.default_rng(5).normal(size=(40, 6)) * np.arange(1, 7)
    z = x - x.mean(0)
    c = np.cov(x.T)
    m = np.trace(c) / 6
    apart = ((c - m * np.eye(6)) ** 2).sum() / 6
    noise = sum(((np.outer(v, v) - c) ** 2).sum() for v in z) / 40**2 / 6
    share, f = linalg.shrunk_factor(40, c, (z**2).sum(1) @ (z**2).sum(1))
    assert np.isclose(share, min(1, noise / apart))
    assert np.allclose(f.colouring().T @ f.colouring(), (1 - share) * c + share * m * np.eye(6))


def test_truncation_sweep_equals_plain_fits(spark):
    v = vectors(spark)
    ids = np.array(sorted(r.vec_id for r in A.table(spark, DATA, "embeddings").select("vec_id").collect()))
    pop = np.array([r.label for r in A.table(spark, DATA, "embeddings").select("vec_id", "label").orderBy("vec_id").collect()])
    train, val = ids % 5 != 0, ids % 5 == 0
    fit = linalg.ScoreMoments(A.matrices(spark, DATA).where("split = 'train'").select(F.concat("x", "y").alias("xy")))
    rows = registry.queries()["truncation_sweep"](spark, DATA).collect()
    assert len(rows) == 5 * len(set(pop[val]))
    for r in rows:
        m = fit.canonical(r.kx, 32, 8)
        at = val & (pop == r.population)
        e = (v[at, : r.kx] - v[train, : r.kx].mean(0)) @ m.b + v[train, 32:].mean(0) - v[at, 32:]
        answer, bias = np.ones(r.kx) @ m.b, e.mean(0)
        want = [at.sum(), r.kx / 32, np.linalg.norm(answer) / 32**0.5, (e**2).sum() / at.sum() / 32, bias @ bias / 32, ((e - bias) ** 2).sum() / at.sum() / 32, answer @ bias / np.linalg.norm(answer) / np.linalg.norm(bias), answer @ bias / (answer @ answer)]
        assert np.allclose([r.n, r.retention, r.response, r.mse, r.bias, r.variance, r.cosine, r.delta], want, atol=2e-6)


def test_gram_matrices_shuffle_tiles_alone(spark, monkeypatch):
    """Products never leave the task that made them, however many blocks and ranges of pixels there are."""
    rng = np.random.default_rng(5)
    x, keys = rng.normal(size=(90, 11)), rng.permutation(np.arange(-45, 45)) * 1_000_003
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, x, strict=True)], "k long, x array<double>")
    monkeypatch.setattr(linalg, "SLAB_DAYS", 7)
    for t, blocks in ((linalg.tiles(df, "k", "x", 5, 4), 5), (linalg.tiles(df, "k", "x", 1, 64), 1), (strips.Strips.of(df, "k", "x", centred=False, strip_bytes=3000).tiles(20), 5)):
        g = linalg.gram_tiles(t, blocks)
        assert "ArrowInPandas" not in (plan := g._jdf.queryExecution().executedPlan().toString()) and "FlatMapGroups" not in plan
        rows = g.toPandas().sort_values(["i", "j"])
        order = np.argsort(keys)
        assert rows.i.tolist() == np.repeat(keys[order], 90).tolist() and rows.j.tolist() == np.tile(keys[order], 90).tolist()
        assert np.allclose(rows.value, (x @ x.T)[np.ix_(order, order)].ravel(), atol=1e-12)
    none = linalg.gram_tiles(linalg.tiles(df.where("false"), "k", "x", linalg.gram_blocks(0, 8), 4), 1)
    assert none.count() == 0
    assert all(-(-n // linalg.gram_blocks(n, 12)) <= linalg.MOST_DAYS for n in (1, 500, 20_000, 102_564, 1_000_000))


@pytest.mark.parametrize("name", ["anomaly_gram", "temporal_gram"])
def test_gram_queries_shuffle_nothing_for_pairs(spark, name):
    """A block of days is stored once and read again for each other block: it isn't sent to each pair that it is in."""
    from fieldloom.plans import registry

    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("most", [linalg.BLOCK_BYTES, 100])
def test_gram_matrix_of_stored_or_sent_blocks(spark, monkeypatch, most):
    rng = np.random.default_rng(5)
    x, keys = rng.normal(size=(90, 11)), rng.permutation(np.arange(-45, 45)) * 1_000_003
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, x, strict=True)], "k long, x array<double>")
    monkeypatch.setattr(linalg, "SLAB_DAYS", 7)
    monkeypatch.setattr(linalg, "BLOCK_BYTES", most)
    for t, blocks in ((linalg.tiles(df, "k", "x", 5, 4), 5), (linalg.tiles(df, "k", "x", 1, 64), 1), (strips.Strips.of(df, "k", "x", centred=False, strip_bytes=3000).tiles(20), 5)):
        g = linalg.gram(t, blocks, 90, 11)
        assert ("CartesianProduct" in g._jdf.queryExecution().executedPlan().toString()) == (most > 100)
        rows = g.toPandas().sort_values(["i", "j"])
        order = np.argsort(keys)
        assert rows.i.tolist() == np.repeat(keys[order], 90).tolist() and rows.j.tolist() == np.tile(keys[order], 90).tolist()
        assert np.allclose(rows.value, (x @ x.T)[np.ix_(order, order)].ravel(), atol=1e-12)
    assert linalg.gram(linalg.tiles(df.where("false"), "k", "x", 1, 4), 1, 0, 0).count() == 0


def test_matrices_too_large_for_one_place_are_refused(spark):
    wide = spark.range(2).select(F.transform(F.sequence(F.lit(1), F.lit(7000)), lambda v: v.cast("double")).alias("x"))
    with pytest.raises(ValueError, match="too large"):
        linalg.moments(wide, "x")


def test_exact_quantiles_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(distributions, "ROUND_CELLS", 8)
    monkeypatch.setattr(distributions, "LAST_VALUES", 20)
    x = np.round(np.random.default_rng(6).normal(size=5000) ** 3, 2)
    x[:900] = 0.25
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(7)
    for q in (0.0, 0.1, 0.5, 0.503, 0.999, 1.0):
        assert np.isclose(distributions.exact_quantile(df, "x", q), np.quantile(x, q), rtol=1e-12)
    assert distributions.exact_quantile(df.where("x is null"), "x", 0.5) is None
    odd = df.union(spark.createDataFrame([(float(v),) for v in [np.nan] * 40 + [np.inf] * 60 + [-np.inf] * 50 + [1e308, -1e308]], "x double"))
    y = np.sort(np.r_[x, [np.inf] * 60, [-np.inf] * 50, 1e308, -1e308])
    for k in (0, 49, 50, 51, 2000, len(y) - 61, len(y) - 60, len(y) - 1):
        assert distributions.order_statistics(odd, "x", lambda n: [k]) == {k: y[k]}  # noqa: B023
    assert distributions.exact_quantile(odd, "x", 0.0) == -np.inf


def test_cells_are_written_as_c_does(spark):
    rng = np.random.default_rng(9)
    x = [0.0, 1.0, -1.0, 10.0, 123456789.0, 1234567890.0, 12345678901.0, -0.0001234, 0.00001234, 1e-300, 1e300, 0.1, 2 / 3, -1e10, 99999999999.0, 9999999999.6, float("inf"), float("-inf"), float("nan")]
    x += [float(v) for v in rng.normal(size=300) * 10.0 ** rng.integers(-12, 14, 300)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, v double")
    got = {r.k: r.s for r in df.select("k", provenance.cell_format(F.col("v")).alias("s")).collect()}
    assert [got[k] for k in range(len(x))] == [f"{v:.10g}" for v in x]


def test_bootstrap_equals_gathering(spark):
    n, reps, block = 37, 20, 8
    x = np.random.default_rng(4).normal(size=n)
    daily = spark.createDataFrame([("c", i, float(v), 1.0) for i, v in enumerate(x)], "climate string, day_idx long, x double, one double")
    starts = bootstrap.generator_starts(spark, {"c": n}, reps, block)
    got = {r.rep: r.x for r in bootstrap.resampled_sums(daily, bootstrap.day_counts(starts, ["climate"]), ["climate"], ["x"]).collect()}
    drawn = np.random.default_rng(bootstrap.SEED).integers(0, n, size=(reps, 5), dtype=np.int64)
    index = ((drawn[:, :, None] + np.arange(block)) % n).reshape(reps, -1)[:, :n]
    assert np.allclose([got[r] for r in range(reps)], x[index].sum(1))
    got = {r.rep: r.x for r in bootstrap.block_sums(daily, starts, ["climate"], ["x"]).collect()}
    assert np.allclose([got[r] for r in range(reps)], x[index].sum(1))


def test_generator_intervals_equal_numpy(spark):
    daily = sorted(A.daily(spark, DATA).collect(), key=lambda r: r.day_idx)
    rng, got = np.random.default_rng(bootstrap.SEED), {r.climate: r for r in registry.queries()["generator_intervals"](spark, DATA).collect()}
    for climate in A.CLIMATES:
        rows = [r for r in daily if r.climate == climate]
        n = len(rows)
        starts = rng.integers(0, n, size=(10_000, -(-n // 60)), dtype=np.int64)
        index = ((starts[:, :, None] + np.arange(60)) % n).reshape(10_000, -1)[:, :n]
        w, a, b = (np.array([r[c] for r in rows])[index].sum(1) for c in ("w", "a_e2", "b_e2"))
        want = np.percentile(np.sqrt(a / w) - np.sqrt(b / w), [2.5, 97.5])
        assert np.allclose([got[climate].delta_rmse_lo, got[climate].delta_rmse_hi], want, atol=0.006)


def test_starts_are_spread(spark):
    sizes = spark.createDataFrame([("c", 1096)], "climate string, n long")
    rows = bootstrap.block_starts(sizes, 500).collect()
    starts = np.array([r.start for r in rows])
    assert len(rows) == 500 * 19 and 0 <= starts.min() and starts.max() < 1096 and abs(starts.mean() - 547.5) < 15
    by = {(r.rep, r.blk): r.start for r in rows}
    assert len({(by[r, 1] - by[r, 0]) % 1096 for r in range(500)}) > 300


def test_weighted_quantile_and_histogram(spark):
    rng = np.random.default_rng(2)
    v, w = np.round(rng.normal(size=80), 1), rng.random(80) + 0.1
    df = spark.createDataFrame([("c", k, float(a), float(b)) for k, (a, b) in enumerate(zip(v, w, strict=True))], "g string, cell int, v double, w double")
    order = np.lexsort((np.arange(80), v))
    c = np.cumsum(w[order]) / w.sum()
    for q in (0.001, 0.25, 0.5, 0.99, 1.0):
        got = distributions.weighted_quantiles(df, ["g"], "v", "cell", q).first().quantile
        assert abs(got - np.interp(q, c, v[order])) < 1e-9
    lo, hi, n = -1.0, 1.0, 8
    got = {r.bin: r.weight for r in distributions.weighted_histogram(df, ["g"], distributions.uniform_bin(F.col("v"), lo, hi, n)).collect()}
    k = np.floor((v - lo) / ((hi - lo) / n)).astype(int)
    k[v == hi] = n - 1
    k = np.clip(k, -1, n)
    assert np.allclose([got.get(b, 0) for b in range(-1, n + 1)], [w[k == b].sum() for b in range(-1, n + 1)])


def test_nearest_distances(spark):
    x = vectors(spark)
    df = A.table(spark, DATA, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    got = {(r.id, r.k): r.distance for r in distributions.nearest_distances(df.where("id < 9"), df.where("id >= 9"), (1, 5), most_queries=4).collect()}
    d = np.sort(np.sqrt(((x[:9, None] - x[None, 9:]) ** 2).sum(2)), 1)
    assert all(abs(got[i, k] - d[i, k - 1]) < 1e-6 for i in range(9) for k in (1, 5))


def test_classes_cover_every_region(spark):
    g = A.grid(spark).withColumn("cell_class", masks.cell_class())
    assert g.where("cell_class is null").count() == 0
    rolled = {r.region: r.n for r in g.join(masks.class_regions(spark), "cell_class").groupBy("region").agg(F.count("*").alias("n")).collect()}
    direct = {r.region: r.n for r in masks.by_region(A.grid(spark), masks.REGIONS + masks.DERIVED).groupBy("region").agg(F.count("*").alias("n")).collect()}
    assert rolled == direct


# --- services


def test_gates_and_identity(spark, tmp_path):
    log = provenance.CheckLog()
    assert log.record("a", True) and not log.record("b", False, "x")
    with pytest.raises(ValueError):
        log.record("c", False, "stop", hard=True)
    assert [r.status for r in log.frame(spark).orderBy("name").collect()] == ["pass", "warn", "fail"]
    assert provenance.identity({"a": 1, "b": 2}) == provenance.identity({"b": 2, "a": 1})
    assert provenance.decide(None, {}, False) == "proceed" and provenance.decide(None, {}, True) == "refuse"
    assert provenance.decide({"m": 1, "k": 2}, {"m": 9, "k": 2}, True, ("m",)) == "skip" and provenance.decide({"k": 1}, {"k": 2}, True) == "refuse"
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/step"
    for _ in range(2):
        assert provenance.resumable(spark, path, {"k": 1}, make).count() == 3
    assert len(made) == 1
    with pytest.raises(ValueError):
        provenance.resumable(spark, path, {"k": 2}, make)
    with pytest.raises(ValueError):
        provenance.guard_path("/data/test_set/x", ("test",))
    assert provenance.guard_path("/data/train/x", ("test",)) == "/data/train/x"


def test_slices_of_array_files(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(23, 2, 3))
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", other=np.arange(3), x=x.astype(np.float32))
    np.savez_compressed(tmp_path / "c.npz", x=x)
    for lo, hi in ((0, None), (5, 17), (22, 99), (7, 7)):
        got = sorted((r.i, r.vals) for r in arrays.slice_npy(spark, f"file://{tmp_path}/a.npy", lo, hi, task_bytes=100).collect())
        assert [i for i, _ in got] == list(range(23))[lo:hi] and np.array_equal([v for _, v in got], x[lo:hi].reshape(-1, 6)) or lo == hi and not got
    df = arrays.slice_npy(spark, f"file://{tmp_path}/b.npz", 3, 9, "x")
    assert df.schema["vals"].dataType.simpleString() == "array<float>"
    assert np.array_equal([r.vals for r in df.orderBy("i").collect()], x[3:9].reshape(6, 6).astype(np.float32))
    with pytest.raises(ValueError, match="compressed"):
        arrays.slice_npy(spark, f"file://{tmp_path}/c.npz", member="x")
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    with pytest.raises(ValueError, match="C order"):
        arrays.slice_npy(spark, f"file://{tmp_path}/f.npy")


@pytest.mark.parametrize("pack", ["raw", "zlib", "gzip", "zstd"])
def test_chunks_cut_along_all_axes(spark, tmp_path, pack):
    import gzip

    import zstandard

    x = np.random.default_rng(2).normal(size=(7, 5, 4))
    packed = {"raw": bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[pack]
    folder = tmp_path / "z" / "t"
    folder.mkdir(parents=True)
    meta = {"shape": [7, 5, 4], "chunks": [3, 2, 4], "dtype": "<f8", "order": "C", "fill_value": -1.5, "filters": None, "compressor": None if pack == "raw" else {"id": pack}}
    (folder / ".zarray").write_text(json.dumps(meta))
    want = x.copy()
    for a in range(3):
        for b in range(3):
            part = np.full((3, 2, 4), 9.0)
            block = x[3 * a : 3 * a + 3, 2 * b : 2 * b + 2]
            part[: block.shape[0], : block.shape[1]] = block
            if (a, b) == (1, 2):
                want[3:6, 4:5] = -1.5  # a missing chunk
                continue
            (folder / f"{a}.{b}.0").write_bytes(packed(part.tobytes()))
    got = [r.vals for r in arrays.read_chunked(spark, f"file://{tmp_path}/z", "t").orderBy("i").collect()]
    assert np.array_equal(got, want.reshape(7, 20))


def test_written_texts_and_tables(spark, tmp_path):
    path = f"file://{tmp_path}/a.json"
    for value in ({"b": 1, "a": [2.5]}, {"a": "é"}):
        tables.write_json(spark, path, value)
        assert json.loads((tmp_path / "a.json").read_text()) == value
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".tmp")] == []
    df = spark.createDataFrame([(1, 2 / 3, 0.5, "x"), (2, None, None, None)], "k int, v double, w double, s string")
    tables.write_csv(df, f"file://{tmp_path}/t", {"w": "%.3f"})
    rows = sorted(tuple(r) for r in spark.read.csv(f"file://{tmp_path}/t", header=True).collect())
    assert rows == [("1", "0.6666666667", "0.500", "x"), ("2", None, None, None)]


def test_array_files(spark, tmp_path):
    x = np.arange(24.0).reshape(4, 2, 3)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", first=x, other=x[:1])
    rows = arrays.read_npy(spark, f"file://{tmp_path}/a.npy").orderBy("i").collect()
    assert np.allclose([r.vals for r in rows], x.reshape(4, 6))
    assert arrays.read_npy(spark, f"file://{tmp_path}/b.npz", member="other").count() == 1
    assert arrays.npy_header((tmp_path / "a.npy").read_bytes())[0] == (4, 2, 3)
    with pytest.raises(Exception, match="at most 10"):
        arrays.read_npy(spark, f"file://{tmp_path}/a.npy", most_bytes=10).collect()
    store = tmp_path / "z" / "t"
    store.mkdir(parents=True)
    (store / ".zarray").write_text(json.dumps({"shape": [5, 2], "chunks": [2, 2], "dtype": "<f4", "order": "C", "compressor": {"id": "zlib"}, "fill_value": 7}))
    y = np.arange(12, dtype="<f4").reshape(6, 2)
    for k in (0, 2):
        (store / f"{k}.0").write_bytes(zlib.compress(y[2 * k : 2 * k + 2].tobytes()))
    got = [r.vals for r in arrays.read_chunked(spark, f"file://{tmp_path}/z", "t").orderBy("i").collect()]
    assert got == [[0, 1], [2, 3], [7, 7], [7, 7], [8, 9]]


def test_manifests_and_logs(spark, tmp_path):
    head = "split\tstart\tend\theight\twidth\ttask_id\tbaseline_path\tresidual_path\n"
    line = lambda a, b: f"train\t{a}\t{b}\t2\t3\tt\tp\tq\n"
    (tmp_path / "ok.tsv").write_text(head + line(4, 9) + line(0, 4) + "val\t7\t9\t2\t3\tt\tp\tq\n")
    (tmp_path / "gap.tsv").write_text(head + line(0, 4) + line(5, 9))
    assert [r.start for r in tables.read_manifest(spark, f"file://{tmp_path}/ok.tsv", "train").collect()] == [0, 4]
    with pytest.raises(ValueError):
        tables.read_manifest(spark, f"file://{tmp_path}/gap.tsv", "train")
    (tmp_path / "log.jsonl").write_text('{"kind": "step", "loss": 1.5}\n{"kind": "note", "text": "x"}\n')
    rows = tables.read_events(spark, f"file://{tmp_path}/log.jsonl", {"step": "loss double", "note": "text string"}).collect()
    assert rows[0].step.loss == 1.5 and rows[0].note is None and rows[1].note.text == "x"
    assert tables.first_existing(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/ok.tsv"]).endswith("ok.tsv")


def test_stream_adds_up_to_the_batch(spark, tmp_path):
    e = A.errors(spark, DATA).select("climate", "w", "err_a", "err_b", "err_base")
    for k in range(3):
        e.where(F.pmod(F.floor(F.col("err_a") * 100), F.lit(3)) == k).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_error_sums(stream, f"{tmp_path}/partials", f"{tmp_path}/checkpoint", ["climate"])
    q.awaitTermination()
    got = {r.climate: r.b_e2 for r in accumulated(spark, f"{tmp_path}/partials", ["climate"]).collect()}
    want = {r.climate: r.x for r in e.groupBy("climate").agg(F.sum(F.col("w") * F.col("err_b") ** 2).alias("x")).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-6 * want[c] for c in want)


def test_stream_of_events_counts_windows(spark, tmp_path):
    from fieldloom.streaming.accumulate import stream_event_counts

    e = A.table(spark, DATA, "events").select("ts", "event_type", "value")
    e.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    q = stream_event_counts(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("event_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window.start, r.event_type): r.n for r in spark.table("event_counts").collect()}
    want = {(r.window.start, r.event_type): r.n for r in e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want and len(got) > 10


def test_schemas_are_required(spark):
    from pyspark.sql import types as T

    df = spark.range(2).withColumn("v", F.lit(1.0).cast("float"))
    want = T.StructType([T.StructField("v", T.FloatType())])
    assert arrays.require_schema(df, want).columns == ["v"]
    with pytest.raises(ValueError, match="DoubleType"):
        arrays.require_schema(df, T.StructType([T.StructField("v", T.DoubleType())]))
