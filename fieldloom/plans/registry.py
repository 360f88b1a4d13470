"""All queries of the engine by name, with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from fieldloom.functions.scalars import quantize
from fieldloom.operators.adapters import q

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
MODULES = ("verification", "scans", "distributions", "resampling", "algebra", "spectral", "services")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _parse(spec: str) -> tuple[list[str], list[tuple[str, int]]]:
    keys, _, values = spec.partition("|")
    return keys.split(), [(v.split(":")[0], int(v.split(":")[1])) for v in values.split()]


def pick(df: DataFrame, spec: str) -> DataFrame:
    """Columns of a result: keys as they are, then name:digits of doubles to quantize."""
    keys, values = _parse(spec)
    return df.select(*keys, *[quantize(v, d).alias(v) for v, d in values])


def ask(spec: str, tables: str, body: str) -> str:
    """The SQL twin of pick over a body that follows the common tables."""
    keys, values = _parse(spec)
    columns = ", ".join([*keys, *(f"{q(v, d)} AS {v}" for v, d in values)])
    return f"WITH {tables}, answer AS ({body}) SELECT {columns} FROM answer"


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"fieldloom.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
