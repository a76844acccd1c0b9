"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest
from skyledger.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, data, duck, name):
    frame = registry.QUERIES[name](spark, data)
    relation = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    order = [relation.columns.index(c) for c in columns]
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    assert ours == theirs


def test_entry(spark, monkeypatch):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
