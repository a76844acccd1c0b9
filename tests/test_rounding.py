"""Halves are rounded to even numbers, as the SQL's cast does."""

import duckdb
import pytest
from skyledger.plans import registry


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """A part of 37 * 200 by 900.5 * 3 pixels: 7400 * 2700 is below 20 million, 7400 * 2703 isn't."""
    folder = str(tmp_path_factory.mktemp("halves"))
    duckdb.sql(f"COPY (SELECT 1::BIGINT AS p_partkey, 37::INT AS p_size, 900.5::DOUBLE AS p_retailprice) TO '{folder}/part.parquet'")
    duckdb.sql(f"COPY (SELECT 1::BIGINT AS page_id, 'u' AS url) TO '{folder}/pages.parquet'")
    return folder


@pytest.mark.parametrize("name", ["path_outcomes", "path_coverage", "coverage_maps"])
def test_sizes_of_halves(spark, halves, name):
    duck = duckdb.connect()
    for table in ("part", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{halves}/{table}.parquet'")
    frame = registry.QUERIES[name](spark, halves)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in frame.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(want, key=str)
    assert "whole" in str(want)
