"""Ordered operators that no single task carries: ranks, quantiles, autocorrelation, pairs and replicates against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bootstrap, distributions


@pytest.fixture(scope="module")
def values(spark):
    r = np.random.default_rng(1)
    v = np.round(r.normal(size=600) * 3, 1)
    v[:150] = 0.5  # a value that a quarter of the rows share
    rows = [("ab"[k % 2], k, float(x), float(w)) for k, (x, w) in enumerate(zip(v, r.random(600) + 0.1, strict=True))]
    return rows, spark.createDataFrame([*rows, ("a", 900, None, 1.0)], "g string, cell int, v double, w double")


@pytest.mark.parametrize("rows", [distributions.RANGE_ROWS, 11])
def test_quantiles_and_ranks_over_ranges(values, rows):
    plain, df = values
    ranks = {r.cell: r["rank"] for r in distributions.average_ranks(df, ["g"], "v", "rank", rows).collect()}
    assert ranks[900] is None and len(ranks) == 601
    for g in "ab":
        mine = sorted((v, c, w) for h, c, v, w in plain if h == g)
        v = np.array([x for x, *_ in mine])
        for value, cell, _ in mine:
            assert ranks[cell] == (v < value).sum() + ((v == value).sum() + 1) / 2
        share = np.cumsum([w for *_, w in mine]) / sum(w for *_, w in mine)
        for q in (1e-4, 0.1, 0.3, 0.5, 0.77, 0.99, 1.0):
            got = {r.g: r.quantile for r in distributions.weighted_quantiles(df, ["g"], "v", "cell", q, rows=rows).collect()}
            assert abs(got[g] - np.interp(q, share, v)) < 1e-9
    assert distributions.weighted_quantiles(df.where("false"), ["g"], "v", "cell", 0.5).count() == 0 == distributions.average_ranks(df.where("false"), ["g"], "v", "rank").count()


@pytest.mark.parametrize("segment", [4096, 16, 7])
def test_autocorrelation_of_all_lags(spark, segment):
    r = np.random.default_rng(2)
    series = {"p": np.convolve(r.normal(size=220), np.ones(9), "valid"), "q": r.normal(size=5), "gap": r.normal(size=40)}
    rows = [(g, 100 + t, float(x)) for g, y in series.items() for t, x in enumerate(y) if not (g == "gap" and 10 <= t < 25)]
    acf = distributions.autocorrelation(spark.createDataFrame(rows, "g string, t long, x double"), ["g"], "t", "x", segment)
    got: dict = {}
    for row in acf.collect():
        got.setdefault(row.g, {})[row.lag] = row.acf
    for g, y in series.items():
        held = np.ones(len(y), bool)
        held[10:25] &= g != "gap"
        z = np.where(held, y - y[held].mean(), 0.0)
        want = np.array([z[: len(z) - k] @ z[k:] for k in range(len(z))]) / (z @ z)
        assert sorted(got[g]) == list(range(len(y))) and np.abs(np.array([got[g][k] for k in range(len(y))]) - want).max() < 1e-12
    for rows_ in (distributions.RANGE_ROWS, 13):
        times = {r.g: r for r in distributions.integrated_time(acf, ["g"], rows=rows_).collect()}
        for g, y in series.items():
            tau, window = 1.0, len(y) - 1
            for k in range(1, len(y)):
                tau += 2 * got[g][k]
                if k >= 5 * tau:
                    window = k
                    break
            assert times[g].window == window and abs(times[g].tau - tau) < 1e-9
            assert abs(times[g].fixed - 1 - 2 * sum(got[g][k] for k in range(1, min(61, len(y))))) < 1e-9


@pytest.fixture(scope="module")
def two_samples(spark):
    r = np.random.default_rng(3)
    x, g = r.normal(size=(330, 4)), (np.arange(330) % 3 == 0).astype(int)
    x[g == 1] += 0.2
    return x, g, spark.createDataFrame([(k, int(b), a.tolist()) for k, (a, b) in enumerate(zip(x, g, strict=True))], "id long, g long, x array<double>")


def test_pairs_are_met_once_for_both_orders(two_samples, monkeypatch):
    x, g, df = two_samples
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    median = np.median(d[np.triu_indices(330, 1)])
    over = distributions._over_pairs
    for rows in (2048, 50):
        monkeypatch.setattr(distributions, "_over_pairs", lambda s, v, rows=rows: over(s, v, rows))
        assert abs(distributions.median_distance(df) - median) < 1e-12
        energy, mmd2 = distributions.energy_and_kernel(df, median)
        mean = lambda m, a, b: m[np.ix_(g == a, g == b)].mean()
        k = np.exp(-(d**2) / (2 * median**2))
        assert abs(energy - (2 * mean(d, 0, 1) - mean(d, 0, 0) - mean(d, 1, 1))) < 1e-12 and abs(mmd2 - (mean(k, 0, 0) + mean(k, 1, 1) - 2 * mean(k, 0, 1))) < 1e-12


def test_pairs_are_looked_at_in_small_squares(spark):
    """Of 1,300 rows in one block each ordered pair counts once, and no square has more than PART_ROWS of either side."""
    df = spark.range(1300).select("id", (F.col("id") % 2).alias("g"), F.array(F.col("id").cast("double")).alias("x"))
    at = distributions._over_pairs(df, lambda d2, i, gi, j, gj: (np.array([max(d2.shape), -1]), np.array([1, d2.size])))
    assert at.pop(-1) == 1300**2 and max(at) <= 512


def test_blocks_of_rows_are_stored_once_and_close_rows_are_exact(spark):
    """Distances come from products of blocks that no pair shuffles, and those of near copies from differences."""
    from fieldloom.operators.staging import beside

    r = np.random.default_rng(6)
    x = 1e4 + r.normal(size=(1200, 5))
    x[600:] = x[:600] + 1e-7 * r.integers(0, 2, (600, 1))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(distributions._squares(x[:700], x[500:]), d[:700, 500:] ** 2, rtol=1e-12, atol=0)
    assert np.isinf(distributions._squares(np.array([[np.inf, 1.0]]), np.ones((1, 2)))).all()
    df = spark.createDataFrame([(k, k % 2, v.tolist()) for k, v in enumerate(x)], "id long, g long, x array<double>")
    assert distributions.median_distance(df) == pytest.approx(np.median(d[np.triu_indices(1200, 1)]), rel=1e-12)
    plan = beside(spark.range(9).select(F.struct("id").alias("a")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


@pytest.mark.parametrize("parts", [distributions.PART_ROWS, 40])
def test_labels_meet_the_sums_of_rows_that_are_labelled_alike(two_samples, monkeypatch, parts):
    monkeypatch.setattr(distributions, "PART_ROWS", parts)
    monkeypatch.setattr(distributions, "LABELLED", parts)
    x, g, df = two_samples
    drawn, seen = np.random.default_rng(7).integers(0, 2, (34, 50)), df.sparkSession.sparkContext.accumulator(0)

    def labels(ids, own):
        seen.add(len(ids))
        return (own[:, None] + drawn[ids // 10]) % 2

    plain = distributions.relabelled_statistics(df, 1.3, labels)
    by_row, seen.value = seen.value, 0
    alike = distributions.relabelled_statistics(df, 1.3, labels, F.col("id") - F.pmod("id", F.lit(10)) + F.col("g"))
    assert all(np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(plain, alike, strict=True)) and seen.value * 3 < by_row


def test_relabelled_statistics_equal_plain_ones(two_samples):
    x, g, df = two_samples
    swaps = np.hstack((np.zeros((330, 1), int), np.random.default_rng(4).integers(0, 2, (330, 20)), np.ones((330, 1), int), (1 - g)[:, None]))
    e, m = distributions.relabelled_statistics(df, 1.3, lambda ids, own: (own[:, None] + swaps[ids]) % 2)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    k = np.exp(-(d**2) / (2 * 1.3**2))
    for r in range(swaps.shape[1] - 1):
        u = (g + swaps[:, r]) % 2 == 1
        mean = lambda t, a, b: t[np.ix_(a, b)].mean()
        assert abs(e[r] - (2 * mean(d, u, ~u) - mean(d, u, u) - mean(d, ~u, ~u))) < 1e-12  # noqa: B023
        assert abs(m[r] - (mean(k, u, u) + mean(k, ~u, ~u) - 2 * mean(k, u, ~u))) < 1e-12
    assert np.isnan(e[-1]) and np.isnan(m[-1])  # all rows on one side


@pytest.mark.parametrize("panel", [bootstrap.PANEL_BYTES, 8 * 130 * 3])
def test_vector_replicates_equal_resampled_days(spark, monkeypatch, panel):
    monkeypatch.setattr(bootstrap, "PANEL_BYTES", panel)
    r = np.random.default_rng(5)
    data = {0: r.normal(size=(130, 7)) + 1, 1: r.normal(size=(20, 7)), 2: r.normal(size=(61, 7))}
    df = spark.createDataFrame([(g, k, v.tolist()) for g, x in data.items() for k, v in enumerate(x)], "g int, day_idx long, x array<double>")
    sizes = df.groupBy("g").agg(F.count("*").alias("n"))
    starts: dict = {}
    for s in bootstrap.block_starts(sizes, 300).collect():
        starts.setdefault((s.g, s.rep), []).append((s.blk, s.start, s.len))
    rows = bootstrap.vector_replicates(df, "g", "x", 300).collect()
    assert len(rows) == 900
    for row in rows:
        x = data[row.g]
        days = [(start + o) % len(x) for blk, start, size in sorted(starts[row.g, row.rep]) for o in range(size) if blk * size + o < len(x)]
        assert len(days) == len(x)
        picked = x[days]
        assert abs(row.b - (picked.mean(0) ** 2).sum()) < 1e-12 and abs(row.m - (picked**2).sum(1).mean()) < 1e-11
    with pytest.raises(Exception, match="0, 1, 2"):
        bootstrap.vector_replicates(df.where("day_idx <> 3"), "g", "x", 3).collect()
