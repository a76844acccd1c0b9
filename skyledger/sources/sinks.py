"""Sinks: content-addressed files, reports that never overwrite, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_addressed(rows: DataFrame, path: str, *, content: str = "content") -> DataFrame:
    """Write each content once, in folders of the hash's first two digits; gives ``sha256, prefix``.

    Repeated writes of the same content add nothing.
    """
    spark = rows.sparkSession
    new = rows.withColumn("sha256", F.sha2(content, 256)).withColumn("prefix", F.substring("sha256", 1, 2))
    new = new.select("sha256", content, "prefix").dropDuplicates(["sha256"])
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").partitionBy("prefix").parquet(path)
    return spark.read.parquet(path).select("sha256", "prefix")


def report(rows: DataFrame, path: str) -> None:
    """Write a report; an existing one is an error."""
    rows.write.mode("errorifexists").json(path)


def append_events(rows: DataFrame, path: str, *, scope: str = "scope_id") -> None:
    """Append events to a log, clustered by scope; :mod:`chained` has logs with chains and expected heads."""
    rows.repartition(scope).sortWithinPartitions(scope).write.mode("append").parquet(path)
