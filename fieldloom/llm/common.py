"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 spelling of "a run of ASCII white space", the word separator of the contracts.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    A folder of our own is set only where the session names none (tests in local mode).
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="fieldloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


class Stage:
    """A table written to the shared folder: it cuts lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files once nothing reads them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Stages that a computation needs only until its result is written."""

    def __init__(self):
        self.stages: list[Stage] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.stages.append(Stage(df, name))
        return self.stages[-1].df

    def clear(self) -> None:
        for s in self.stages:
            s.drop()
        self.stages.clear()


def fresh(df: DataFrame, *names: str) -> str | list[str]:
    """Names that no column of df has, whatever its case: the given ones with as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out[0] if len(out) == 1 else out


def join_rows(rows: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """rows joined with a table that grows with the input: both are shuffled.

    Spark judges a table by its bytes in files, which packed numbers keep small, and would send one of many rows through the
    driver.
    """
    return rows.join(other.hint("shuffle_merge"), on, how)


def join_summary(rows: DataFrame, summary: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with an aggregate that has one row a key.

    The wrapped key makes Spark exchange the aggregate anew instead of joining where it was made: adaptive execution
    can then split the rows of a hot key over several tasks.
    """
    mine = fresh(rows, "key")
    other = summary.withColumnRenamed(key, mine)
    wrapped = lambda c: F.struct(F.col(c).alias("k"))
    return join_rows(rows, other, wrapped(key) == wrapped(mine), how).drop(mine)


def widen(df: DataFrame) -> DataFrame:
    """df, dealt out to as many partitions as there are cores where its few files would keep most of them idle.

    A file may be one row group, which one task reads. Only inputs of fewer files than cores and of fewer bytes than
    the cores' scan partitions are dealt out, so a large table is never shuffled for it. Rows stay as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * split:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text; a null text is empty. Other columns are left behind, so none can clash."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def blob_key(text) -> F.Column:
    """Content address: the first 128 bits of SHA-256 as 16 bytes."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))
