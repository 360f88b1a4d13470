"""The text queries that SQL can express against their SQL on the smallest tables."""

import __spark_entry__ as driver
import duckdb
import pytest
from fieldloom.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_text_query_equals_its_sql(spark, name):
    assert driver.oracle_sql()[name] == registry.oracle_sql()[name]
    c = duckdb.connect()
    for table in ("documents", "labels"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = c.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(x) for x in columns]
    want = sorted(tuple(map(str, (r[k] for k in at))) for r in cursor.fetchall())
    got = registry.queries()[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert sorted(tuple(str(r[x]) for x in columns) for r in got.collect()) == [tuple("None" if x == "None" else x for x in r) for r in want] and want


def test_all_queries_are_registered():
    assert len([n for n in driver.queries() if n.startswith("op") and n[2].isdigit()]) == 13 and "pipeline" in driver.queries()
    assert all(f.__doc__ for f in registry.queries().values())
