"""Hash-chained logs that several writers append to.

A log is a folder: ``data/`` has one folder a batch, with its events and the new heads of its scopes, and
``batches/`` one small file for each batch that counts, named by number.  A writer reads the heads, chains its
events to them, writes them aside, and then claims the next number by a rename that fails if the number is taken;
so of two writers one is first, and the other reads the heads again.  What no number names doesn't exist for a
reader.  The rename has to be atomic, as in HDFS and local file systems; a plain object store needs a committer in front.

A batch of a scope is taken whole or not at all.  A batch id that is there already adds nothing, so a stream may send
its micro-batches again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import build_chain

#: Batches between two that hold the heads of all scopes, so that few folders are read for them.
SNAPSHOT = 64


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[dict]:
    """``number, batch_id, folder, all_heads`` of each batch that counts, in order."""
    jvm, where, files = _files(spark, f"{path}/batches")
    if not files.exists(where):
        return []
    out = []
    for status in files.listStatus(where):
        name = status.getPath().getName()
        if name.isdigit():
            stream = files.open(status.getPath())
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            out.append({"number": int(name), **json.loads(text)})
    return sorted(out, key=lambda b: b["number"])


def _claim(spark: SparkSession, path: str, number: int, entry: dict) -> bool:
    """Name a batch by the next number; False if another writer was first."""
    jvm, _, files = _files(spark, path)
    aside, name = (jvm.org.apache.hadoop.fs.Path(f"{path}/batches/{n}") for n in (f"_{uuid.uuid4().hex}", f"{number:012d}"))
    stream = files.create(aside, False)
    try:
        stream.write(json.dumps(entry).encode())
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(name), never)
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        files.delete(aside, False)
        return False
    return True


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All events of the log; an empty log needs a ``schema``."""
    folders = [f"{b['folder']}/events" for b in batches(spark, path)]
    return spark.read.parquet(*folders) if folders else spark.createDataFrame([], schema)


def _heads(spark: SparkSession, found: list[dict], scope: str, kind: str) -> DataFrame:
    start = max((i for i, b in enumerate(found) if b["all_heads"]), default=0)
    folders = [f"{b['folder']}/heads" for b in found[start:]]
    if not folders:
        return spark.createDataFrame([], f"`{scope}` {kind}, sequence long, event_sha256 string")
    last = F.max(F.struct("sequence", "event_sha256")).alias("x")
    return spark.read.parquet(*folders).groupBy(scope).agg(last).select(scope, "x.sequence", "x.event_sha256")


def heads(spark: SparkSession, path: str, scope: str, kind: str = "string") -> DataFrame:
    """``scope, sequence, event_sha256`` of the last event of each scope."""
    return _heads(spark, batches(spark, path), scope, kind)


def append(events: DataFrame, path: str, *, scope: str, order: str, content: Column, batch_id: str, expected: DataFrame | None = None, most_bytes: int = 1 << 20, tries: int = 10) -> DataFrame:
    """Chain ``events`` to the log; ``scope, events, code`` of each scope of the batch.

    ``order`` is the order of a scope's events in the batch, ``content`` what is hashed.  ``expected`` has ``scope,
    event_sha256`` as the writer last saw them (null or no row: an empty scope); a scope whose head is another is refused with
    ``stale_head``.  Without it events follow whatever is there.  A scope with an event over ``most_bytes`` is refused with
    ``event_too_large``; a batch id that counts already gives ``repeated_batch`` and adds nothing.  The log has the events'
    columns (``order`` excepted) with ``sequence, previous_event_sha256, event_sha256``.
    """
    spark, kind = events.sparkSession, dict(events.dtypes)[scope]
    rows = events.withColumn("_content", content)
    sizes = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("events"), F.max(F.octet_length("_content")).alias("_bytes"))
    for _ in range(tries):
        found = batches(spark, path)
        if any(b["batch_id"] == batch_id for b in found):
            return sizes.select(scope, "events", F.lit("repeated_batch").alias("code"))
        known = _heads(spark, found, scope, kind)
        judged = sizes.join(known.withColumnRenamed("event_sha256", "_head"), scope, "left")
        stale = F.lit(False)
        if expected is not None:
            judged = judged.join(expected.select(scope, F.col("event_sha256").alias("_expected")), scope, "left")
            stale = ~F.col("_head").eqNullSafe(F.col("_expected"))
        folder = f"{path}/data/{uuid.uuid4().hex}"
        code = F.when(stale, "stale_head").when(F.col("_bytes") > most_bytes, "event_too_large")
        # Written before the heads move.
        judged.select(scope, "events", code.alias("code"), F.col("sequence").alias("_at"), "_head").write.parquet(f"{folder}/verdicts")
        verdicts = spark.read.parquet(f"{folder}/verdicts")
        taken = verdicts.where("code IS NULL")
        chain = build_chain(rows.join(taken.select(scope, "_at", "_head"), scope), scope, order, F.col("_content"), after=("_at", "_head"))
        chain.drop(order, "_content").write.parquet(f"{folder}/events")
        new = spark.read.parquet(f"{folder}/events").groupBy(scope).agg(F.max(F.struct("sequence", "event_sha256")).alias("x")).select(scope, "x.*")
        whole = (len(found) + 1) % SNAPSHOT == 0
        if whole:
            new = known.unionByName(new).groupBy(scope).agg(F.max(F.struct("sequence", "event_sha256")).alias("x")).select(scope, "x.*")
        new.write.parquet(f"{folder}/heads")
        if _claim(spark, path, len(found), {"batch_id": batch_id, "folder": folder, "all_heads": whole}):
            return verdicts.select(scope, "events", "code")
        _, where, files = _files(spark, folder)
        files.delete(where, True)
    raise RuntimeError(f"other writers were first {tries} times")


def append_stream(stream: DataFrame, path: str, checkpoint: str, *, name: str, scope: str, order: str, content: Column, trigger: dict | None = None):
    """Append each micro-batch of ``stream``, once even if it is sent again; the started query."""

    def one(batch: DataFrame, number: int) -> None:
        append(batch, path, scope=scope, order=order, content=content, batch_id=f"{name}:{number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
