"""Tables in the folder that the driver and all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. One of our own is made only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


class Staged:
    """A table written to the shared folder and read from there. As a context manager it is dropped at the end."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def beside(rows: DataFrame, blocks: int) -> DataFrame:
    """(a, b): each row of a stored table (a) of so many large rows beside each other one and itself, without a shuffle: a task
    reads its part of the table twice. Both sides have at most so many parts."""
    one = rows.coalesce(blocks)
    return one.select("a").hint("shuffle_replicate_nl").crossJoin(one.select(F.col("a").alias("b")))
