"""Gates, identities and resumable steps around a run."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tolerance(value: Column, reference: Column, tol: float, relative: bool = False) -> list[Column]:
    """deviation and pass of a value against its reference."""
    d = F.abs(value - reference)
    d = d / F.greatest(F.abs(reference), F.lit(1e-300)) if relative else d
    return [d.alias("deviation"), (d <= tol).alias("pass")]


def require(df: DataFrame, flag: str = "pass") -> DataFrame:
    """df, unless a row's flag is false: then the run ends, naming the rows."""
    bad = df.where(~F.col(flag)).limit(5).collect()
    if bad:
        raise ValueError(f"checks failed: {bad}")
    return df


@dataclass
class CheckLog:
    """Checks as they are made; a hard one that fails ends the run after it is recorded."""

    rows: list[tuple] = field(default_factory=list)

    def record(self, name: str, ok: bool, detail: str = "", hard: bool = False) -> bool:
        self.rows.append((name, "pass" if ok else "fail" if hard else "warn", detail))
        if hard and not ok:
            raise ValueError(f"{name}: {detail}")
        return ok

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "name string, status string, detail string")


def identity(settings: dict) -> str:
    """A digest of settings that doesn't depend on the order of keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def compatible(a: dict, b: dict, free: tuple[str, ...] = ()) -> bool:
    """Equal but for the keys that are free to differ."""
    cut = lambda d: {k: v for k, v in d.items() if k not in free}
    return cut(a) == cut(b)


def decide(done: dict | None, wanted: dict, outputs_exist: bool, free: tuple[str, ...] = ()) -> str:
    """skip a finished step of the same identity, proceed where there is nothing, refuse to overwrite anything else."""
    if done is None:
        return "refuse" if outputs_exist else "proceed"
    return "skip" if outputs_exist and compatible(done, wanted, free) else "refuse"


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def resumable(spark: SparkSession, path: str, settings: dict, make: Callable[[], DataFrame], free: tuple[str, ...] = ()) -> DataFrame:
    """The table at path, made unless a step of the same identity has left it. Any store that Spark reads will do."""
    record = f"{path}.done"
    fs, p = _filesystem(spark, record)
    done = json.loads("\n".join(r.value for r in spark.read.text(record).collect())) if fs.exists(p) else None
    _, table = _filesystem(spark, path)
    step = decide(done, settings, fs.exists(table), free)
    if step == "refuse":
        raise ValueError(f"{path} holds the output of another run")
    if step == "proceed":
        make().write.parquet(path)
        spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.text(record)
    return spark.read.parquet(path)


def guard_path(path: str, denied: tuple[str, ...], read_only: tuple[str, ...] = ()) -> str:
    """path, unless one of its tokens is denied (held-out data) or it lies in a read-only root."""
    tokens = set(re.split(r"[/_.\\-]+", path.lower()))
    if found := tokens & set(denied):
        raise ValueError(f"{path} names held-out data: {sorted(found)}")
    if any(path == r or path.startswith(r.rstrip("/") + "/") for r in read_only):
        raise ValueError(f"{path} is read-only")
    return path


def cell_format(x: Column, digits: int = 10) -> Column:
    """At most so many significant digits without trailing zeros, as C's %.10g: in exponent form below 1e-4 and from 1e10 on."""
    said = F.format_string(f"%.{digits - 1}e", x.cast("double"))
    sign = F.when(said.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    figures = F.regexp_replace(F.substring_index(said, "e", 1), "[-.]", "")
    power = F.substring_index(said, "e", -1).try_cast("int")
    strip = lambda c: F.regexp_replace(c, r"\.?0*$", "")
    whole = F.concat(F.substring(figures, F.lit(1), power + 1), F.lit("."), F.substring(figures, power + 2, F.lit(digits)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
    far = F.concat(strip(F.concat(F.substring(figures, 1, 1), F.lit("."), F.substring(figures, 2, digits))), F.lit("e"), F.substring_index(said, "e", -1))
    out = F.when(power.isNull(), F.lower(said)).when((power < -4) | (power >= digits), far).when(power >= 0, strip(whole)).otherwise(strip(small))
    odd = F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("inf")))
    return F.when(x.isNotNull(), F.coalesce(odd, F.concat(sign, out)))
