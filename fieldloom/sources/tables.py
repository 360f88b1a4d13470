"""Manifests, result tables and event logs with explicit schemas."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "split string, start long, `end` long, height int, width int, task_id string, baseline_path string, residual_path string"


def read_manifest(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The tab-separated segments of a split in order; gaps and overlaps end the run."""
    from fieldloom.operators.provenance import require
    from fieldloom.operators.shards import contiguous

    rows = spark.read.csv(path, sep="\t", header=True, schema=MANIFEST).where(F.col("split") == split)
    require(contiguous(rows, ["split"], "start", "end"), "follows")
    return rows.orderBy("start")


def read_result_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_events(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """A JSON log of tagged records: kind, and a struct column for each kind, null on other kinds' rows."""
    raw = spark.read.text(path).withColumn("kind", F.get_json_object("value", "$.kind"))
    return raw.select("kind", *[F.when(F.col("kind") == k, F.from_json("value", schema)).alias(k) for k, schema in kinds.items()])


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists in its store."""
    from fieldloom.operators.provenance import _filesystem

    for p in paths:
        fs, path = _filesystem(spark, p)
        if fs.exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def write_partial_table(df: DataFrame, path: str, by: list[str]) -> None:
    """Additive partials, partitioned for later pruning; the commit protocol makes the write whole or absent."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, whole or absent: written beside its place and then renamed."""
    from fieldloom.operators.provenance import _filesystem

    fs, target = _filesystem(spark, path)
    _, beside = _filesystem(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"{path} can't be written")


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A JSON file with sorted keys, whole or absent."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True) + "\n")


def write_csv(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    """Rows as CSV. formats: a printf form for a column; other fractions are written to ten significant digits."""
    from fieldloom.operators.provenance import cell_format

    formats, columns = formats or {}, []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name in formats:
            c = F.when(c.isNotNull(), F.format_string(formats[f.name], c))
        elif f.dataType.typeName() in ("double", "float"):
            c = cell_format(c)
        columns.append(c.alias(f.name))
    df.select(*columns).write.mode("overwrite").csv(path, header=True)
