"""Rows whose ids are equal too: one of them is the first, as the SQL numbers them."""

import duckdb
import pytest
from skyledger.plans import registry


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Pages 10 and 40 name one path, page 1 another; pages 1, 3 and 10 stand there more than once."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    duckdb.sql(f"COPY (SELECT 1::BIGINT AS p_partkey, 10::INT AS p_size, 900.5::DOUBLE AS p_retailprice) TO '{folder}/part.parquet'")
    duckdb.sql(f"COPY (SELECT unnest([1, 1, 3, 3, 10, 10, 10, 40, NULL])::BIGINT AS page_id, 'u' AS url) TO '{folder}/pages.parquet'")
    return folder


@pytest.mark.parametrize("name", ["path_coverage", "path_outcomes"])
def test_repeated_pages(spark, repeated, name):
    duck = duckdb.connect()
    for table in ("part", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{repeated}/{table}.parquet'")
    frame = registry.QUERIES[name](spark, repeated)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in frame.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(want, key=str)
    assert "duplicate" in str(want)
