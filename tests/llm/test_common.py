"""Helpers that the text operators share."""

from fieldloom.llm.common import join_rows, join_summary, widen


def test_few_files_are_dealt_out_to_the_cores(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS doc_id", "if(id % 7 = 0, null, repeat('x', 5)) AS text")
    one, many = f"{tmp_path}/one", f"{tmp_path}/many"
    rows.coalesce(1).write.parquet(one)
    cores = spark.sparkContext.defaultParallelism
    rows.repartition(2 * cores).write.parquet(many)
    few = widen(spark.read.parquet(one))
    assert few.rdd.getNumPartitions() == cores
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(few)
    assert "Repartition" not in plan(widen(spark.read.parquet(many)))
    assert "Repartition" not in plan(widen(rows))  # no files


def test_a_large_input_is_not_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        assert "Repartition" not in widen(spark.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_summaries_of_many_rows_are_not_sent_through_the_driver(spark, tmp_path):
    """Their files are under the broadcast limit, as repeated numbers pack well."""
    spark.range(200_000).selectExpr("id AS rep", "0 AS a", "0 AS b").write.parquet(f"{tmp_path}/summary")
    summary = spark.read.parquet(f"{tmp_path}/summary")
    rows = spark.range(1000).selectExpr("id AS rep", "id AS x")
    for out in (join_rows(rows, summary, "rep"), join_rows(rows, summary, "rep", "left_anti"), join_summary(rows, summary, "rep")):
        assert out.count() in (0, 1000)
        out.write.format("noop").mode("overwrite").save()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
