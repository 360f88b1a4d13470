"""Runs that resume by shard: each shard's partial has a record of its own, written once the partial is in place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .provenance import _filesystem, compatible, identity


class ShardRun:
    """Partials of numbered shards under a path, made in waves of several shards a job.

    make(numbers) gives the rows of these shards with a column shard. A wave is written beside the run; then each shard's
    folder is moved to its place and gets a record with the run's settings and its number of rows. A partial without a
    record is what a failure left and is made anew; one of other settings is refused, free keys aside.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict, shards: int, make: Callable[[list[int]], DataFrame], free: tuple[str, ...] = ()):
        self.spark, self.path, self.settings, self.shards, self.make, self.free = spark, path.rstrip("/"), settings, shards, make, free

    def _folder(self, shard: int) -> str:
        return f"{self.path}/shard={shard}"

    def records(self) -> dict[int, dict]:
        """The records by shard: one small file each, read as one table."""
        fs, folder = _filesystem(self.spark, f"{self.path}/_records")
        if not fs.exists(folder):
            return {}
        rows = [json.loads(r.value) for r in self.spark.read.text(f"{self.path}/_records/*.json").collect()]
        return {r["shard"]: r for r in rows}

    def _record(self, shard: int, rows: int) -> None:
        fs, target = _filesystem(self.spark, f"{self.path}/_records/{shard}.json")
        _, beside = _filesystem(self.spark, f"{self.path}/_records/_{shard}.{uuid.uuid4().hex}")
        stream = fs.create(beside)
        stream.write(bytearray(json.dumps({"shard": shard, "rows": rows, "identity": identity(self.settings), "settings": self.settings}, sort_keys=True, default=str).encode()))
        stream.close()
        fs.rename(beside, target)

    def missing(self) -> list[int]:
        """Shards without a valid partial. Raises ValueError where a record has other settings or its partial is gone for good."""
        done, out = self.records(), []
        for shard in range(self.shards):
            record = done.get(shard)
            fs, folder = _filesystem(self.spark, self._folder(shard))
            if record is not None and not compatible(record["settings"], json.loads(json.dumps(self.settings, default=str)), self.free):
                raise ValueError(f"{self.path}: shard {shard} belongs to a run of other settings")
            if record is None or record["rows"] and not fs.exists(folder):
                out.append(shard)
        return out

    def complete(self, wave: int = 8) -> list[int]:
        """Make the missing shards; returns their numbers."""
        todo = self.missing()
        for first in range(0, len(todo), wave):
            numbers = todo[first : first + wave]
            beside = f"{self.path}/_wave-{uuid.uuid4().hex}"
            rows = self.make(numbers)
            rows.withColumn("_shard", F.col("shard")).write.partitionBy("_shard").parquet(beside)
            held = {r.shard: r.n for r in self.spark.read.schema(rows.schema).parquet(beside).groupBy("shard").agg(F.count("*").alias("n")).collect()}
            if strange := set(held) - set(numbers):
                raise ValueError(f"rows of shards {sorted(strange)} among those of {numbers}")
            for shard in numbers:
                fs, target = _filesystem(self.spark, self._folder(shard))
                _, made = _filesystem(self.spark, f"{beside}/_shard={shard}")
                if fs.exists(target):
                    fs.delete(target, True)
                if held.get(shard):
                    fs.rename(made, target)
                self._record(shard, held.get(shard, 0))
            fs, left = _filesystem(self.spark, beside)
            fs.delete(left, True)
        return todo

    def read(self) -> DataFrame:
        """The rows of all shards. Raises ValueError while some are missing."""
        if todo := self.missing():
            raise ValueError(f"{self.path}: shards {todo} are missing")
        held = sorted(s for s, r in self.records().items() if r["rows"])
        return self.spark.read.parquet(*(self._folder(s) for s in held)) if held else self.make([]).limit(0)
