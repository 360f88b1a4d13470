"""Day-at-a-time accumulation as a stream: each micro-batch adds its partial sums to a table of partials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.operators.metrics import error_sums


def stream_error_sums(rows: DataFrame, partials: str, checkpoint: str, by: list[str]) -> StreamingQuery:
    """Write error sums of every micro-batch of a stream of weighted errors under partials, one folder a batch.

    A batch that is run again overwrites its own folder, so sums are counted once.
    """

    def add(batch: DataFrame, number: int) -> None:
        error_sums(batch, by).write.mode("overwrite").parquet(f"{partials}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, partials: str, by: list[str]) -> DataFrame:
    """The sums so far."""
    p = spark.read.parquet(partials)
    return p.groupBy(*by).agg(*[F.sum(c).alias(c) for c in p.columns if c not in (*by, "batch")])


def stream_event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and totals by window and type of a stream of events(ts, event_type, value), closed by a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
