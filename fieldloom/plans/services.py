"""Check tables: tolerance gates, closures and reproduction of one path by another; runs that resume by shard."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import adapters as A
from fieldloom.operators import metrics
from fieldloom.functions.arrays import dot
from fieldloom.functions.scalars import quantize
from fieldloom.operators.adapters import DAILY_SQL, MATRIX_SQL, q
from fieldloom.operators.provenance import tolerance
from fieldloom.operators.resume import ShardRun
from fieldloom.operators.shards import shard_bounds
from fieldloom.operators.staging import shared_folder

from .registry import ask, pick, query


_BY_CELL = "mc AS (SELECT climate, sum(x) AS maps FROM (SELECT climate, cell, sum(w * err_b * err_b) AS x FROM errors GROUP BY ALL) GROUP BY climate), md AS (SELECT climate, sum(b_e2) AS days FROM daily GROUP BY climate)"


@query(f"WITH {DAILY_SQL}, {_BY_CELL} SELECT climate, {q('maps', -2)} AS maps, abs(maps - days) <= 1e-9 * abs(days) AS pass, abs(maps - days * (1 + 1e-7)) <= 1e-9 * abs(days) AS off_pass FROM mc JOIN md USING (climate)")
def maps_against_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PV3, PV9: sums over cell maps and over days agree to 1e-9, and a sum that is off by 1e-7 doesn't."""
    e = A.errors(spark, sf_dir)
    by_cell = e.groupBy("climate", "cell").agg(metrics.wsum(F.col("err_b") ** 2).alias("x")).groupBy("climate").agg(F.sum("x").alias("maps"))
    by_day = e.groupBy("climate", "day").agg(metrics.wsum(F.col("err_b") ** 2).alias("x")).groupBy("climate").agg(F.sum("x").alias("days"))
    both = by_cell.join(by_day, "climate")
    gate = lambda d: tolerance(F.col("maps"), d, 1e-9, relative=True)
    right = both.select("climate", "maps", "days", *gate(F.col("days")))
    right = right.select("climate", "maps", "days", "pass")
    out = right.select("climate", "maps", F.col("pass").alias("ok"), *gate(F.col("days") * (1 + 1e-7)))
    return out.select("climate", quantize("maps", -2).alias("maps"), F.col("ok").alias("pass"), F.col("pass").alias("off_pass"))


_GATES = f"""{MATRIX_SQL}, {DAILY_SQL}, {_BY_CELL},
g AS (SELECT 'dense_against_scores' AS name, sum((x.val - y.val) * (x.val - y.val)) AS got, sum(y.val * y.val) + sum(x.val * x.val) - 2 * sum(x.val * y.val) AS want FROM x JOIN y USING (day_idx, k)
 UNION ALL SELECT 'rmse_' || climate, sqrt(days / w), sqrt(maps / w) FROM mc JOIN md USING (climate) JOIN (SELECT climate, sum(w) AS w FROM errors GROUP BY climate) USING (climate)
 UNION ALL SELECT 'rmse_' || climate || '_of_a', sqrt(sum(b_e2) / sum(w)), sqrt(sum(a_e2) / sum(w)) FROM daily GROUP BY climate)"""


@query(f"WITH {_GATES} SELECT name, {q('got', 4)} AS got, {q('want', 4)} AS want, abs(got - want) <= 1e-9 * abs(want) AS pass FROM g")
def reproduction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PV8, PV10: quantities reproduced by another path: dense errors against the score-space identity, the rmse of daily sums
    against that of maps; and gates that must fail, the rmse of one method against the other's."""
    m = A.matrices(spark, sf_dir)
    e = F.zip_with("x", "y", lambda a, b: a - b)
    s = m.agg(*[F.sum(dot(a, b)).alias(n) for n, a, b in (("e", e, e), ("xx", F.col("x"), F.col("x")), ("yy", F.col("y"), F.col("y")), ("xy", F.col("x"), F.col("y")))])
    gates = s.select(F.lit("dense_against_scores").alias("name"), F.col("e").alias("got"), (F.col("yy") + F.col("xx") - 2 * F.col("xy")).alias("want"))
    errors = A.errors(spark, sf_dir)
    maps = errors.groupBy("climate", "cell").agg(metrics.wsum(F.col("err_b") ** 2).alias("x"), F.sum("w").alias("w")).groupBy("climate").agg(F.sqrt(F.sum("x") / F.sum("w")).alias("want"))
    days = A.daily(spark, sf_dir).groupBy("climate").agg(*[F.sqrt(F.sum(f"{k}_e2") / F.sum("w")).alias(k) for k in "ab"])
    gates = gates.union(days.join(maps, "climate").select(F.concat(F.lit("rmse_"), "climate"), F.col("b"), F.col("want")))
    gates = gates.union(days.select(F.concat(F.lit("rmse_"), "climate", F.lit("_of_a")), F.col("b"), F.col("a")))
    return gates.select("name", quantize("got", 4).alias("got"), quantize("want", 4).alias("want"), (F.abs(F.col("got") - F.col("want")) <= 1e-9 * F.abs("want")).alias("pass"))


#: Shards of a climate's days, and how many of them the first, unfinished run makes.
SHARDS, MADE_FIRST = 20, 9


@query(ask("climate shard n_days resumed | w:6 a_e2:0 b_e2:0", f"{DAILY_SQL}, s AS (SELECT *, ntile({SHARDS}) OVER (PARTITION BY climate ORDER BY day_idx) - 1 AS shard FROM daily)", f"SELECT climate, shard, count(*) AS n_days, shard >= {MADE_FIRST} AS resumed, sum(w) AS w, sum(a_e2) AS a_e2, sum(b_e2) AS b_e2 FROM s GROUP BY ALL"))
def resumed_error_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5, PV4, PV5, PV6: additive partials of 20 shards of days. A run makes the first nine; one of the same settings finds
    their records, makes the other eleven only, and reads all."""

    def make(numbers: list[int]) -> DataFrame:
        d = shard_bounds(A.daily(spark, sf_dir), ["climate"], "day_idx", SHARDS).where(F.col("shard").isin(numbers))
        return d.groupBy("climate", "shard").agg(F.count("*").alias("n_days"), *[F.sum(c).alias(c) for c in ("w", "a_e2", "b_e2")])

    path, settings = f"{shared_folder(spark)}/error-sums-{uuid.uuid4().hex}", {"table": f"{sf_dir}/lineitem.parquet", "shards": SHARDS}
    ShardRun(spark, path, settings, MADE_FIRST, make).complete(MADE_FIRST)
    run = ShardRun(spark, path, settings, SHARDS, make)
    made = run.complete(SHARDS)
    return pick(run.read().withColumn("resumed", F.col("shard").isin(made)), "climate shard n_days resumed | w:6 a_e2:0 b_e2:0")
