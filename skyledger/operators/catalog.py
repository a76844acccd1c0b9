"""Catalog operators: search with paging, best pairs of scenes, STAC admission, evidence checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, paths
from . import ranges

def in_windows(requests: DataFrame, scenes: DataFrame, start: str, end: str, *, anywhere: Column | None = None) -> DataFrame:
    """Requests with the scenes acquired in their window ``start`` to ``end`` whose boxes meet theirs.

    Where ``anywhere`` is true the scene may lie outside the request's box.
    """
    far = {"west": -720.0, "south": -90.0, "east": 720.0, "north": 90.0}
    area = {f"_{c}": F.col(f"q_{c}").cast("double") if anywhere is None else F.when(anywhere, F.lit(x)).otherwise(F.col(f"q_{c}")) for c, x in far.items()}
    asked = requests.withColumns({**area, "_from": ranges.micros(F.col(start)), "_until": ranges.micros(F.col(end))})
    shot = scenes.withColumn("_at", ranges.micros(F.col("acquired")))
    axes = [("west", "east", "_west", "_east"), ("south", "north", "_south", "_north")]
    return ranges.meeting(shot, asked, [(ranges.DEGREES, 2, axes), (ranges.HOUR, 8, [("_at", "_at", "_from", "_until")])]).drop("_at", "_from", "_until", *area)


def search(assets: DataFrame, queries: DataFrame, *, page: int = 20) -> DataFrame:
    """Pages of assets for many queries at once.

    ``queries``: ``query_id``, a box ``q_west``..``q_north``, ``q_start, q_end``, ``max_cloud`` and
    ``offset``; assets have a box, ``acquired`` and ``cloud``.  Unknown cloud is no match.  Equal queries are searched once.
    Gives ``query_id, item_id, position, matched_count, next_offset``.
    """
    queries, members = ranges.alike(queries, "query_id")
    met = in_windows(queries, assets, "q_start", "q_end").where(F.coalesce(F.col("cloud") <= F.col("max_cloud"), F.lit(False)))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("item_id"))
    met = met.withColumns({"position": rank, "matched_count": F.count(F.lit(1)).over(W.partitionBy("query_id"))})
    met = met.where((F.col("position") > F.col("offset")) & (F.col("position") <= F.col("offset") + page))
    after = F.col("offset") + page
    met = ranges.shared(met.select("query_id", "item_id", "position", "matched_count", "offset"), members, "query_id")
    return met.select("query_id", "item_id", F.col("position").cast("long").alias("position"), "matched_count", F.when(after < F.col("matched_count"), after).alias("next_offset"))


def _candidates(requests: DataFrame, scenes: DataFrame, side: str) -> DataFrame:
    """Scenes in the window of one side that cover enough, with coverage and whether they are clear."""
    # No coverage is enough for a request that asks for none.
    met = in_windows(requests, scenes, f"{side}_start", f"{side}_end", anywhere=F.col("min_coverage") <= 0)
    met = met.withColumn("coverage", geo.coverage(geo.box(), geo.box("q_"))).where(F.col("coverage") >= F.col("min_coverage"))
    return met.withColumn("clear", F.coalesce(F.col("cloud") <= F.col("max_cloud"), F.lit(False)))


def select_pairs(requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """The best scene before and after for each request, or why there is none.

    ``requests``: ``request_id``, a box ``q_*``, ``before_start/end``, ``after_start/end``,
    ``min_coverage``, ``max_cloud``.  Every request gives one row ``request_id, status, reason,
    before_id, after_id``.  Equal requests are judged once.
    """
    requests, members = ranges.alike(requests, "request_id")
    sides, flags = {}, requests.select("request_id")
    for side in ("before", "after"):
        met = _candidates(requests, scenes, side)
        dated = ranges.count_within(scenes, requests, "request_id", "acquired", f"{side}_start", f"{side}_end").withColumnRenamed("n", f"{side}_dated")
        seen = met.groupBy("request_id").agg(F.count(F.lit(1)).alias(f"{side}_covered"), F.count_if("clear").alias(f"{side}_clear"))
        flags = flags.join(dated, "request_id", "left").join(seen, "request_id", "left")
        # Of equal clouds and coverages the earliest scene, of the least id, is in the best pair whatever the other side has.
        group = ["request_id", "platform", "instrument"]
        met = met.where("clear").groupBy(*group, "cloud", "coverage").agg(F.min(F.struct("acquired", "item_id")).alias("_x"))
        # The least sum of clouds takes the least cloud of either side, so no other scene can be in the best pair
        # (the margin is for sums that round to one number).
        met = met.withColumn("least", F.min("cloud").over(W.partitionBy(*group))).where(F.col("cloud") <= F.col("least") + 1e-9)
        sides[side] = met.select(*group, F.col("_x.item_id").alias(f"{side}_id"), F.col("_x.acquired").alias(f"{side}_at"), F.col("cloud").alias(f"{side}_cloud"), F.col("coverage").alias(f"{side}_coverage"))
    pairs = sides["before"].join(sides["after"], ["request_id", "platform", "instrument"])
    order = F.struct((F.col("before_cloud") + F.col("after_cloud")).alias("c"), (-F.least("before_coverage", "after_coverage")).alias("v"), "before_at", "after_at", "before_id", "after_id")
    best = pairs.groupBy("request_id").agg(F.min(order).alias("best"))
    rows = flags.join(best, "request_id", "left")
    none = lambda step: (F.coalesce(F.col(f"before_{step}"), F.lit(0)) == 0) | (F.coalesce(F.col(f"after_{step}"), F.lit(0)) == 0)
    reason = F.when(none("dated"), "wrong_date").when(none("covered"), "insufficient_coverage").when(none("clear"), "cloudy").when(F.col("best").isNull(), "sensor_mismatch").otherwise("selected")
    rows = rows.select("request_id", F.when(reason == "selected", "selected").otherwise("rejected").alias("status"), reason.alias("reason"), F.col("best.before_id").alias("before_id"), F.col("best.after_id").alias("after_id"))
    return ranges.shared(rows, members, "request_id")


def check_evidence(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """The first rule that each piece of evidence breaks, or null, in this order.

    ``evidence``: ``evidence_id, source_ref, frozen_sha256``, a box ``e_*``, ``e_start, e_end``, ``e_bands``; where there are such columns,
    ``e_geometry`` (null: none) and ``e_window``, an array of x, y, width and height in pixels.  ``sources``: ``source_ref, sha256``, a
    box ``s_*`` (null: not georeferenced), ``s_start, s_end, s_bands``; where there are such columns ``s_kind`` (``pixel_asset``,
    ``pixel_artifact`` or another, whose bands aren't known; without the column all are assets) and ``s_width, s_height``.
    """
    rows = evidence.join(sources, "source_ref", "left")
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    window, geometry = have("e_window", "array<long>"), have("e_geometry", "string")
    width, height = have("s_width", "long"), have("s_height", "long")
    kind = F.col("s_kind") if "s_kind" in rows.columns else F.lit("pixel_asset")
    named = F.size(F.coalesce("e_bands", F.array().cast("array<string>"))) > 0
    code = (
        F.when(F.col("sha256").isNull(), "missing_source")
        .when(~F.col("frozen_sha256").eqNullSafe(F.col("sha256")), "hash_mismatch")
        .when(geometry.isNotNull() & F.col("s_west").isNull(), "source_not_georeferenced")
        .when(window.isNotNull() & (width.isNull() | height.isNull()), "no_source_dimensions")
        .when((F.get(window, 0) + F.get(window, 2) > width) | (F.get(window, 1) + F.get(window, 3) > height), "outside_window")
        .when((kind == "pixel_asset") & named & (F.size(F.array_except("e_bands", F.coalesce("s_bands", F.array().cast("array<string>")))) > 0), "unknown_bands")
        .when((kind == "pixel_artifact") & named, "unnamed_bands")
        .when(F.col("e_west").isNotNull() & ~F.coalesce(geo.contains(geo.box("s_"), geo.box("e_")), F.lit(False)), "outside_extent")
        .when(F.col("e_start").isNotNull() & F.col("s_start").isNull(), "no_source_time")
        .when((F.col("e_start") < F.col("s_start")) | (F.col("e_end") > F.col("s_end")), "outside_time")
    )
    return rows.select("evidence_id", code.alias("code"))


#: Fixed values of the 20 m short-wave band of a catalog item.
SWIR16 = {"key": "swir16", "file": "B11.tif", "side": 20000, "step": 20.0, "type": "uint16", "nodata": 0.0, "scale": 0.0001, "offset": -0.1}
SWIR_SCHEMA = "id string, assets map<string, struct<href:string, type:string, roles:array<string>, `proj:shape`:array<int>, `proj:transform`:array<double>, `raster:bands`:array<struct<data_type:string, nodata:double, scale:double, offset:double, spatial_resolution:double>>, `eo:bands`:array<struct<name:string, common_name:string>>>>"


def swir16_codes(items: DataFrame, *, host: str, column: str = "item", pinned: str = "pinned_sha256") -> DataFrame:
    """``items`` with the first rule that their short-wave asset breaks: ``snapshot_mismatch, missing_asset, asset_identity, grid, radiometry``.

    ``column`` is the item as JSON text, ``pinned`` the hash of the admitted text; the asset's place is below ``host``.
    """
    x = F.from_json(column, SWIR_SCHEMA)
    rows = items.withColumn("x", x).withColumn("asset", F.col("x.assets")[SWIR16["key"]])
    a, t = F.col("asset"), F.col("asset.`proj:transform`")
    band, eo = F.get("asset.`raster:bands`", 0), F.get("asset.`eo:bands`", 0)
    no = lambda *tests: ~reduce(Column.__and__, (F.coalesce(c, F.lit(False)) for c in tests))
    identity = [a["href"].startswith(host), a["href"].endswith(F.concat(F.lit("/"), F.col("x.id"), F.lit(f"/{SWIR16['file']}"))), a["type"].startswith("image/tiff"), a["roles"] == F.array(F.lit("data"), F.lit("reflectance"))]
    grid = [F.size(a["proj:shape"]) == 2, F.forall(a["proj:shape"], lambda n: n.between(1, SWIR16["side"])), F.size(t) >= 6, F.get(t, 0) == SWIR16["step"], F.get(t, 1) == 0, F.get(t, 3) == 0, F.get(t, 4) == -SWIR16["step"], F.forall(F.slice(t, 1, 6), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))]
    radiometry = [F.size(a["raster:bands"]) == 1, band["data_type"] == SWIR16["type"], *(band[k] == SWIR16[k] for k in ("nodata", "scale", "offset")), band["spatial_resolution"] == SWIR16["step"], F.size(a["eo:bands"]) == 1, eo["name"] == SWIR16["key"], eo["common_name"] == SWIR16["key"]]
    code = F.when(~F.sha2(column, 256).eqNullSafe(F.col(pinned)), "snapshot_mismatch").when(a.isNull(), "missing_asset").when(no(*identity), "asset_identity").when(no(*grid), "grid").when(no(*radiometry), "radiometry")
    return rows.withColumn("code", code).drop("x", "asset")


STAC_SCHEMA = "type string, collection string, id string, bbox array<double>, properties struct<datetime:string, `eo:cloud_cover`:double, `proj:epsg`:int>, assets map<string, struct<href:string, type:string, roles:array<string>, `proj:shape`:array<int>>>"


def stac_violations(items: DataFrame, *, collection: str, box: tuple[float, ...], start: str, end: str, max_cloud: float, bands: list[str], column: str = "item") -> DataFrame:
    """Items as JSON text with the array of rules that each breaks (empty if admitted)."""
    x = F.from_json(column, STAC_SCHEMA)
    rows = items.withColumn("x", x)
    at = F.try_to_timestamp(F.col("x.properties.datetime"))
    cloud, epsg = F.col("x.properties.`eo:cloud_cover`"), F.col("x.properties.`proj:epsg`")
    b, area = [F.get("x.bbox", i) for i in range(4)], [F.lit(v) for v in box]
    not_true = lambda c: ~F.coalesce(c, F.lit(False))
    band = lambda k: F.col("x.assets")[k]
    good_asset = lambda a: a["type"].startswith("image/tiff") & (a["roles"] == F.array(F.lit("data"), F.lit("reflectance"))) & (F.size(a["proj:shape"]) == 2) & F.forall(a["proj:shape"], lambda n: n.between(1, 20000))
    found = [
        F.when(not_true((F.col("x.type") == "Feature") & (F.col("x.collection") == collection) & F.col("x.id").isNotNull()), "identity"),
        F.when(not_true(at.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))), "time"),
        F.when(not_true(cloud.between(0, max_cloud)), "cloud"),
        F.when(not_true((F.size("x.bbox") == 4) & geo.contains(b, area)), "extent"),
        F.when(not_true(epsg.between(32601, 32660) | epsg.between(32701, 32760)), "crs"),
        *(F.when(not_true(good_asset(band(k))), f"asset:{k}") for k in bands),
    ]
    return rows.withColumn("violations", F.filter(F.array(*found), lambda v: v.isNotNull())).drop("x")


def public_view(assets: DataFrame, private: tuple[str, ...] = ("uri", "source", "roles", "episode_id")) -> DataFrame:
    """Assets without private fields and without those whose roles or path look like labels."""
    shown = assets.where(~paths.label_like(F.col("relative_path"))) if "relative_path" in assets.columns else assets
    return shown.drop(*private)
