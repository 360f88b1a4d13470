"""Every query against its SQL twin in DuckDB on the smallest tables."""

import math

import __spark_entry__ as driver
import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from fieldloom.plans import registry  # noqa: E402

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float) and not math.isnan(x):
        return x + 0.0
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=key)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=key)
    assert mine == theirs and mine


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
