"""Folders for what a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: the root where the session names none, and the folders made.
_roots: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only in local mode, where one machine does all, may the setting be missing.
    """
    root, application = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # A running session refuses to have the setting changed, so the folder is kept here.
        root = _roots.get(application) or "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        _roots[application] = root
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    _made.setdefault(application, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Hadoop's file systems have it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete every folder made in this application: for after the results are stored elsewhere."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in such a folder: a lost executor reads files instead of computing again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
