"""Registered queries and the pipeline on the smallest tables."""

from collections import Counter

import duckdb
import pytest
from skyledger.llm import queries

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, data, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    frame, relation = queries.QUERIES[name](spark, data), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(frame.columns)
    order = [relation.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == Counter(tuple(r[i] for i in order) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_ids_are_whole(spark, data, name):
    rows = queries.QUERIES[name](spark, data)
    if name.startswith("op5"):
        assert rows.count() == spark.read.parquet(f"{data}/embeddings.parquet").count()
    elif not name.startswith("op10"):
        assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    sizes, now = [docs.count()], docs
    for i, (name, stage) in enumerate(pipeline.STAGES):
        now = stage(spark, now, data)
        if i < len(pipeline.STAGES) - 1:
            assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), now.schema)
        sizes.append(now.count())
        if name == "quality":
            kept = {r.doc_id for r in now.collect()}
            good = [d for d, q in labels.items() if q]
            assert sum(d in kept for d in good) / len(good) >= 0.97
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] == sizes[5]
    assert sorted({r.position for r in now.collect()}) == list(range(now.select("position").distinct().count()))
