"""Parts without a key name a file too, as in the SQL, whose concat leaves nulls out."""

import duckdb
import pytest
from skyledger.plans import registry


@pytest.fixture(scope="module")
def keyless(tmp_path_factory):
    """Pages 0 and 6 name the file of a part without a key; page 12 names that of page 7, whose part stands there twice."""
    folder = str(tmp_path_factory.mktemp("keyless"))
    duckdb.sql(f"COPY (SELECT unnest([NULL, 7, 7])::BIGINT AS p_partkey, unnest([10, 10, 50])::INT AS p_size, 900.5::DOUBLE AS p_retailprice) TO '{folder}/part.parquet'")
    duckdb.sql(f"COPY (SELECT unnest([0, 6, 7, 12])::BIGINT AS page_id, unnest(['train/images/.png', 'train/images/.png', 'u', 'train/images/7.png']) AS url) TO '{folder}/pages.parquet'")
    return folder


@pytest.mark.parametrize("name", ["path_outcomes", "path_coverage", "coverage_maps"])
def test_parts_without_a_key(spark, keyless, name):
    duck = duckdb.connect()
    for table in ("part", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{keyless}/{table}.parquet'")
    frame = registry.QUERIES[name](spark, keyless)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in frame.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(want, key=str)
    assert "whole" in str(want)
