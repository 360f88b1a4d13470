"""Runs that resume by shard: what is made anew, and what is refused."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators.resume import ShardRun


@pytest.fixture
def run_of(spark, tmp_path):
    calls: list[list[int]] = []

    def make(numbers):
        calls.append(list(numbers))
        rows = spark.range(200).withColumn("shard", F.col("id") % 20).where(F.col("shard").isin(numbers) & (F.col("shard") != 13))
        return rows.groupBy("shard").agg(F.sum("id").alias("total"), F.count("*").alias("n"))

    return lambda settings=None, shards=20, free=(): ShardRun(spark, f"file://{tmp_path}/run", settings or {"k": 1, "place": "a"}, shards, make, free), calls, tmp_path / "run"


def test_only_missing_shards_are_made(spark, run_of):
    new, calls, folder = run_of
    assert new().complete(8) == list(range(20)) and [len(c) for c in calls] == [8, 8, 4]
    rows = {r.shard: r.total for r in new().read().collect()}
    assert rows == {k: sum(range(k, 200, 20)) for k in range(20) if k != 13}  # a shard without rows is done, too
    calls.clear()
    assert new().complete() == [] == calls
    (folder / "shard=7").rename(folder / "gone")  # one partial of 20 is lost
    (folder / "_records" / "4.json").unlink()  # and another has no record, as if a failure came between
    with pytest.raises(ValueError, match=r"\[4, 7\] are missing"):
        new().read()
    assert new().complete() == [4, 7] and calls == [[4, 7]]
    assert {r.shard: r.total for r in new().read().collect()} == rows


def test_a_run_of_other_settings_is_refused(run_of):
    new, calls, _ = run_of
    new(shards=3).complete()
    for settings in ({"k": 2, "place": "a"}, {"k": 1, "place": "b"}):
        with pytest.raises(ValueError, match="other settings"):
            new(settings).complete()
    assert new({"k": 1, "place": "b"}, free=("place",)).complete() == list(range(3, 20))


def test_rows_of_strange_shards_are_refused(spark, tmp_path):
    run = ShardRun(spark, f"file://{tmp_path}/x", {}, 2, lambda numbers: spark.range(3).withColumn("shard", F.col("id") + 1))
    with pytest.raises(ValueError, match=r"\[2, 3\] among"):
        run.complete()
    with pytest.raises(ValueError, match="are missing"):
        run.read()
    empty = ShardRun(spark, f"file://{tmp_path}/y", {}, 2, lambda numbers: spark.range(0).withColumn("shard", F.col("id")))
    assert empty.complete() == [0, 1] and empty.read().collect() == []
