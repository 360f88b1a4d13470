"""Score covariances of whole tables against NumPy."""

import numpy as np

from fieldloom.plans import registry

from .test_queries import DATA


def test_score_covariance_has_all_blocks(spark):
    x = np.array([r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 5 <> 0").collect()], float)
    cov, got = np.cov(x.T), {"xx": np.full((32, 32), np.nan), "xy": np.full((32, 32), np.nan), "yy": np.full((32, 32), np.nan)}
    for r in registry.queries()["score_covariance"](spark, DATA).collect():
        got[r.block][r.i, r.j] = r.value
    for name, want in (("xx", cov[:32, :32]), ("xy", cov[:32, 32:]), ("yy", cov[32:, 32:])):
        assert np.abs(got[name] - want).max() < 1e-7
