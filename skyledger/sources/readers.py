"""Sources: guarded Parquet columns, Arrow shards, file listings, JSON documents and logs."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths

# Words of the names of columns that hold answers, not inputs.
GUARDED = {"label", "labels", "answer", "answers", "mask", "masks", "annotation", "annotations", "bbox", "gt", "groundtruth"}


def guard(columns: list[str], column: str) -> str:
    """The column if it has a plain name, exists, and has no guarded word in its name."""
    if not column.isascii() or not column.isidentifier() or column.startswith("_"):
        raise ValueError(f"column_name_not_allowed: {column}")
    if column not in columns:
        raise ValueError(f"column_missing: {column}")
    if GUARDED.intersection(column.lower().split("_")):
        raise ValueError(f"answer_column_not_allowed: {column}")
    return column


def parquet_column(spark: SparkSession, path: str, column: str, *, max_rows: int | None = None) -> DataFrame:
    """One column of a Parquet table; Catalyst reads no other."""
    table = spark.read.parquet(path)
    picked = table.select(guard(table.columns, column))
    return picked if max_rows is None else picked.limit(max_rows)


def shards(spark: SparkSession, path: str, *, glob: str = "*", max_shards: int | None = None) -> DataFrame:
    """Files below a folder in path order, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")
    if max_shards is None:
        return files
    return files.orderBy("path").limit(max_shards)


def arrow_column(spark: SparkSession, path: str, column: str, kind: str, *, glob: str = "*.arrow", max_shards: int | None = None) -> DataFrame:
    """One field of Arrow IPC shards (file or stream framing); a task reads a shard at a time.

    A shard is one value in memory, of at most 2 GB (the limit of ``binaryFile``); larger ones are to be split.
    """
    guard([column], column)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    if max_shards is not None:
        files = files.join(F.broadcast(shards(spark, path, glob=glob, max_shards=max_shards).select("path")), "path", "left_semi")

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                framed = data.slice(0, 6).to_pybytes() == b"ARROW1"
                reader = pa.ipc.open_file(data) if framed else pa.ipc.open_stream(data)
                if column not in reader.schema.names:
                    raise ValueError(f"column_missing: {column} in {name}")
                parts = (reader.get_batch(i) for i in range(reader.num_record_batches)) if framed else reader
                for part in parts:
                    values = part.column(column)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), values], names=["path", column])

    return files.mapInArrow(read, f"path string, `{column}` {kind}")


def parquet_shards(spark: SparkSession, path: str, column: str, *, max_shards: int) -> DataFrame:
    """Rows of the first shards in path order with their shard number and name."""
    table = spark.read.option("recursiveFileLookup", "true").parquet(path)
    rows = table.select(F.col("_metadata.file_path").alias("shard"), guard(table.columns, column))
    names = rows.select("shard").distinct()
    names = names.withColumn("shard_number", F.row_number().over(W.orderBy("shard")))
    return rows.join(F.broadcast(names.where(F.col("shard_number") <= max_shards)), "shard")


def listing(spark: SparkSession, root: str, *, skip: tuple[str, ...] = (".git", ".cache", "__pycache__", "logs")) -> DataFrame:
    """Files below ``root`` without skipped folders: ``relative_path, size_bytes, is_image, is_archive, is_marker``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    relative = F.regexp_replace("path", rf"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    rows = rows.select(relative.alias("relative_path"), F.col("length").alias("size_bytes"))
    rows = rows.where(~F.arrays_overlap(F.split("relative_path", "/"), F.array(*map(F.lit, skip))))
    name = F.lower(paths.name_of(F.col("relative_path")))
    return rows.withColumns({"is_image": paths.ends_with(name, paths.IMAGE_SUFFIXES), "is_archive": paths.ends_with(name, paths.ARCHIVE_SUFFIXES), "is_marker": name.contains("download_failed")})


def json_lines(spark: SparkSession, path: str, schema: str, *, max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSONL log and its rejected lines ``value, code``."""
    lines = spark.read.text(path)
    parsed = lines.withColumn("_row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    code = F.when(F.octet_length("value") > max_bytes, "line_too_long").when(F.col("_row").isNull() | F.col("_row._bad").isNotNull(), "invalid_json")
    parsed = parsed.withColumn("code", code)
    return parsed.where("code IS NULL").select("_row.*").drop("_bad"), parsed.where("code IS NOT NULL").select("value", "code")


def json_documents(spark: SparkSession, path: str, schema: str, *, max_bytes: int = 8 << 20) -> DataFrame:
    """JSON documents, one a file, none over a bound; too long ones have a null document and a code."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.when(F.col("length") <= max_bytes, F.decode("content", "UTF-8"))
    rows = files.select("path", "length", F.from_json(text, schema).alias("document"))
    return rows.withColumn("code", F.when(F.col("length") > max_bytes, "document_too_long").when(F.col("document").isNull(), "invalid_json"))
