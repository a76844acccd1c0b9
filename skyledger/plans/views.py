"""Derived views over the supplied tables, in Spark; ``SQL`` has the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Rasters of 20 by 20 pixels: red and near-infrared numbers, scene class, manual label, mask."""
    e = F.col("event_id")
    return read(spark, d, "events").select(
        F.floor(e / 400.0).alias("raster_id"),
        F.floor((e % 400) / 20.0).alias("row_idx"),
        (e % 20).alias("col_idx"),
        (800 + F.floor(F.col("value") * 10) % 4000).alias("red_dn"),
        (900 + (F.col("user_id") * 137 + e * 31) % 6000).alias("nir_dn"),
        (900 + (F.col("user_id") * 53 + e * 17) % 5000).alias("swir_dn"),
        (e % 12).alias("scl"),
        ((e * 7) % 4).alias("manual"),
        (e % 17 != 0).alias("mask"),
    )


RING = [(0, 0.5, 0.5), (1, 7.5, 0.5), (2, 7.5, 4.0), (3, 4.0, 7.5), (4, 0.5, 7.5), (5, 0.5, 0.5)]


def zones(spark: SparkSession, d: str) -> DataFrame:
    """One ring of a five-cornered zone for each nation, in pixel units."""
    n = F.col("n_nationkey")
    ring = F.array(*(F.struct((n % 5 * 3 + dx).cast("double").alias("x"), (n % 4 * 3 + dy).cast("double").alias("y")) for _, dx, dy in RING))
    return read(spark, d, "nation").select(n.cast("long").alias("zone_id"), ring.alias("ring"))


def scenes(spark: SparkSession, d: str) -> DataFrame:
    west, south = (F.col("o_custkey") % 20).cast("double") / 10, (F.col("o_custkey") % 15).cast("double") / 10
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_orderdate").alias("acquired"),
        F.col("o_orderpriority").alias("platform"),
        F.col("o_orderstatus").alias("instrument"),
        west.alias("west"),
        south.alias("south"),
        (west + 2.0).alias("east"),
        (south + 2.0).alias("north"),
        ((F.floor("o_totalprice") % 100).cast("double") / 100).alias("cloud"),
    )


def assets(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return read(spark, d, "documents").select(
        F.concat(F.lit("asset-"), F.sha2(F.concat("source", F.lit("|"), doc), 256)).alias("asset_id"),
        F.col("source").alias("dataset_id"),
        "doc_id",
        F.concat("lang", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, "labels").otherwise("img"), F.lit("/"), doc).alias("relative_path"),
        F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").alias("size_bytes"),
    )


def paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    text = p.cast("string")
    path = (
        F.when(p % 6 == 0, F.col("url"))
        .when(p % 6 == 1, F.concat(F.lit("train/images/"), text, F.lit(".png")))
        .when(p % 6 == 2, F.concat(F.lit("/abs/"), text))
        .when(p % 6 == 3, F.concat(F.lit("train/../"), text))
        .when(p % 6 == 4, F.concat(F.lit("val/images/"), (p % 5).cast("string"), F.lit(".tif")))
        .otherwise("")
    )
    return read(spark, d, "pages").select("page_id", path.alias("path"))


def log(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select(F.col("user_id").alias("episode_id"), (F.row_number().over(w).cast("long") - 1).alias("sequence"), "event_id", "event_type", F.col("ts").alias("created_at"), "value", "props")


def files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    tail = F.when(k % 5 == 0, ".log").when(k % 5 == 1, ".sqlite3").when(k % 5 == 2, ".pt").when(k % 5 == 3, ".sqlite3-wal").otherwise(".bin")
    return read(spark, d, "part").select(
        F.concat(F.lit("s"), (F.col("p_size") % 8).cast("string"), F.lit("/d"), (k % 6).cast("string"), F.lit("/f"), k.cast("string"), tail).alias("path"),
        (F.floor("p_retailprice") * 100).alias("size_bytes"),
        (k % 300).alias("blocks"),
        F.lit(1).alias("dev"),
        F.floor(k / 2.0).alias("inode"),
    )


def reservations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    scope = F.concat(F.lit("s"), (k % 8).cast("string"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("/d"), (k % 6).cast("string"))))
    return read(spark, d, "supplier").select(k.alias("reservation_id"), scope.alias("scope"), (k * 1000000).alias("capacity"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    part = lambda x, n: (x % n).cast("double") / 100
    return read(spark, d, "labels").select(
        "doc_id",
        part(k, 50).alias("west"),
        part(k, 40).alias("south"),
        (part(k, 50) + 0.3).alias("east"),
        (part(k, 40) + 0.3).alias("north"),
        part(k * 3, 50).alias("a_west"),
        part(k * 3, 40).alias("a_south"),
        (part(k * 3, 50) + 0.25).alias("a_east"),
        (part(k * 3, 40) + 0.25).alias("a_north"),
    )


_RING_SQL = ",".join(f"({i},{x},{y})" for i, x, y in RING)
SQL = {
    "v_pixels": """SELECT CAST(floor(event_id/400.0) AS BIGINT) AS raster_id, CAST(floor((event_id%400)/20.0) AS BIGINT) AS row_idx, event_id%20 AS col_idx,
  800+CAST(floor(value*10) AS BIGINT)%4000 AS red_dn, 900+(user_id*137+event_id*31)%6000 AS nir_dn, 900+(user_id*53+event_id*17)%5000 AS swir_dn, event_id%12 AS scl, (event_id*7)%4 AS manual, event_id%17<>0 AS mask FROM events""",
    "v_zone_vertices": f"SELECT CAST(n_nationkey AS BIGINT) AS zone_id, i, CAST(n_nationkey%5*3+dx AS DOUBLE) AS x, CAST(n_nationkey%4*3+dy AS DOUBLE) AS y FROM nation CROSS JOIN (VALUES {_RING_SQL}) AS t(i,dx,dy)",
    "v_scenes": """SELECT o_orderkey AS item_id, o_orderdate AS acquired, o_orderpriority AS platform, o_orderstatus AS instrument,
  CAST(o_custkey%20 AS DOUBLE)/10 AS west, CAST(o_custkey%15 AS DOUBLE)/10 AS south, CAST(o_custkey%20 AS DOUBLE)/10+2.0 AS east, CAST(o_custkey%15 AS DOUBLE)/10+2.0 AS north,
  CAST(CAST(floor(o_totalprice) AS BIGINT)%100 AS DOUBLE)/100 AS cloud FROM orders""",
    "v_assets": """SELECT concat('asset-',sha256(concat(source,'|',CAST(doc_id AS VARCHAR)))) AS asset_id, source AS dataset_id, doc_id,
  concat(lang,'/',CASE WHEN doc_id%7=0 THEN 'labels' ELSE 'img' END,'/',CAST(doc_id AS VARCHAR)) AS relative_path, sha256(text) AS sha256, n_chars AS size_bytes FROM documents""",
    "v_paths": """SELECT page_id, CASE page_id%6 WHEN 0 THEN url WHEN 1 THEN concat('train/images/',CAST(page_id AS VARCHAR),'.png') WHEN 2 THEN concat('/abs/',CAST(page_id AS VARCHAR))
  WHEN 3 THEN concat('train/../',CAST(page_id AS VARCHAR)) WHEN 4 THEN concat('val/images/',CAST(page_id%5 AS VARCHAR),'.tif') ELSE '' END AS path FROM pages""",
    "v_log": "SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1 AS sequence, event_id, event_type, ts AS created_at, value, props FROM events",
    "v_files": """SELECT concat('s',CAST(p_size%8 AS VARCHAR),'/d',CAST(p_partkey%6 AS VARCHAR),'/f',CAST(p_partkey AS VARCHAR),
  CASE p_partkey%5 WHEN 0 THEN '.log' WHEN 1 THEN '.sqlite3' WHEN 2 THEN '.pt' WHEN 3 THEN '.sqlite3-wal' ELSE '.bin' END) AS path,
  CAST(floor(p_retailprice) AS BIGINT)*100 AS size_bytes, p_partkey%300 AS blocks, 1 AS dev, CAST(floor(p_partkey/2.0) AS BIGINT) AS inode FROM part""",
    "v_reservations": "SELECT s_suppkey AS reservation_id, concat('s',CAST(s_suppkey%8 AS VARCHAR),CASE WHEN s_suppkey%2=0 THEN '' ELSE concat('/d',CAST(s_suppkey%6 AS VARCHAR)) END) AS scope, s_suppkey*1000000 AS capacity FROM supplier",
    "v_boxes": """SELECT doc_id, CAST(doc_id%50 AS DOUBLE)/100 AS west, CAST(doc_id%40 AS DOUBLE)/100 AS south, CAST(doc_id%50 AS DOUBLE)/100+0.3 AS east, CAST(doc_id%40 AS DOUBLE)/100+0.3 AS north,
  CAST((doc_id*3)%50 AS DOUBLE)/100 AS a_west, CAST((doc_id*3)%40 AS DOUBLE)/100 AS a_south, CAST((doc_id*3)%50 AS DOUBLE)/100+0.25 AS a_east, CAST((doc_id*3)%40 AS DOUBLE)/100+0.25 AS a_north FROM labels""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views that it names put before it."""
    named = [f"{k} AS ({v})" for k, v in SQL.items() if k in sql]
    if not named:
        return sql
    sql = sql.strip()
    head = "WITH RECURSIVE " if sql.upper().startswith("WITH RECURSIVE") else "WITH "
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"{head}{', '.join(named)}, {sql[14:].strip()}"
    if sql.upper().startswith("WITH"):
        return f"{head}{', '.join(named)}, {sql[4:].strip()}"
    return f"{head}{', '.join(named)} {sql}"
