"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Folders made by :func:`scratch`, by application, for :func:`clear`; and the root where the session has none.
_made: dict[str, list[str]] = {}
_roots: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session.  Only in local mode, where one machine does all, a
    temporary folder is taken if it is unset; on a cluster that is an error.
    """
    root, application = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # The setting can't be changed in a running session, so the folder is kept here.
        root = _roots.get(application) or "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        _roots[application] = root
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    _made.setdefault(application, []).append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete all folders that operators made in this application: for after their results are written."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        drop_written(spark, path)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage: a lost executor re-reads files instead of recomputing everything, and
    the planner sees the true size of what comes next.
    """
    path = path or scratch(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete one folder made by :func:`scratch` (through Hadoop's file system API)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place`` within their group by ``order`` (nulls first) and its size ``n``, without one task for a group."""
    keys = [*group, *order]
    dealt = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    ranges = dealt.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    w = W.partitionBy(*group)  # a row for each range of a group
    before = F.coalesce(F.sum("size").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*(F.col(c).alias(f"{c}_") for c in group), F.col("part").alias("part_"), (before - F.col("first")).alias("shift"), F.sum("size").over(w).alias("n"))
    same = reduce(Column.__and__, (dealt[c].eqNullSafe(ranges[f"{c}_"]) for c in group), dealt["part"] == ranges["part_"])
    return dealt.join(ranges, same).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift", "part_", *(f"{c}_" for c in group))


def docs_only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; nulls in ``text`` become empty text."""
    picked = df.select(*columns)
    return picked.withColumn("text", F.coalesce("text", F.lit(""))) if "text" in columns else picked


def bounded_sample(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The ``n`` rows of the smallest hashes of ``key``.

    A threshold on the hash, from one count, leaves about four times ``n`` rows before they are
    ordered, so what reaches the driver doesn't grow with the number of tasks.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(place < int((1 << 40) * 4 * n / total))
    return rows.orderBy(place, key).limit(n)


#: Values of a text column taken at once from an Arrow batch.
SLICE_ROWS = 512


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short slices, so that few Python strings live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """``mapInArrow`` of a row function: ``make()`` is called once a task and gives it.

    The function gets one value of each column of ``df`` and returns one value of each
    field of ``schema``.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        function = make()
        for part in slices(batches):
            rows = [function(*values) for values in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, map(list, zip(*rows, strict=True)), strict=True)), schema=arrow)

    return df.mapInArrow(run, schema)
