"""Queries over rasters: products, resampling, stacks, zones, confusion, change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import raster as R
from ..operators import confusion as C
from ..operators import raster as P
from ..operators import tiles as T
from . import views as V
from .registry import query

CELL = ["raster_id", "row_idx", "col_idx"]
BAD = "(1,3,8,9,10,11)"
#: Physical values, validity and single-precision ratio of v_pixels, as SQL.
ND = f"""
px AS (SELECT *, red_dn*0.0001::DOUBLE + -0.1::DOUBLE AS r, nir_dn*0.0001::DOUBLE + -0.1::DOUBLE AS n FROM v_pixels),
nd AS (SELECT *, mask AND red_dn<>0 AND nir_dn<>0 AND r>=0 AND n>=0 AND r+n>1e-6 AS ok, mask AND scl NOT IN {BAD} AS clear FROM px),
ndvi AS (SELECT *, CASE WHEN ok THEN CAST(CAST((n-r)/(n+r) AS FLOAT) AS DOUBLE) END AS v FROM nd)"""
STATS = """count(*) FILTER (WHERE {ok}) AS valid_pixels, count(*) AS total_pixels, round(count(*) FILTER (WHERE {ok})::DOUBLE/count(*),6) AS valid_fraction,
 round(min(CASE WHEN {ok} THEN {v} END),6) AS min_value, round(max(CASE WHEN {ok} THEN {v} END),6) AS max_value, round(avg(CASE WHEN {ok} THEN {v} END),6) AS mean_value"""


def band(spark, d, column):
    return V.pixels(spark, d).select(*CELL, F.col(column).alias("dn"), "mask")


def classes(spark, d):
    return V.pixels(spark, d).select(*CELL, F.col("scl").alias("scene_class"), "mask")


def ndvi(spark, d, masked=False):
    return P.band_ratio(band(spark, d, "nir_dn"), band(spark, d, "red_dn"), classes(spark, d) if masked else None)


@query(f"WITH {ND} SELECT raster_id, {STATS.format(ok='(ok AND clear)', v='v')} FROM ndvi GROUP BY raster_id")
def masked_ndvi_summary(spark, d):
    """Per scene, NDVI after cloud masking: the flagship query."""
    return P.summary(ndvi(spark, d, True), ["raster_id"])


@query(f"WITH {ND} SELECT raster_id, {STATS.format(ok='ok', v='v')} FROM ndvi GROUP BY raster_id")
def ndvi_summary(spark, d):
    """Without a cloud mask."""
    return P.summary(ndvi(spark, d), ["raster_id"])


NDMI = ND.replace("red_dn", "swir_dn")


@query(f"WITH {NDMI} SELECT raster_id, {STATS.format(ok='ok', v='v')} FROM ndvi GROUP BY raster_id")
def ndmi_summary(spark, d):
    """Near-infrared against short-wave infrared."""
    return P.summary(P.band_ratio(band(spark, d, "nir_dn"), band(spark, d, "swir_dn")), ["raster_id"])


#: Near-infrared and red assets of each order's raster; some pairs don't fit.
BANDS = """n AS (SELECT o_orderkey AS raster_id, concat('n',o_orderkey) AS asset_id, 'nir' AS band, o_custkey AS item_id, o_orderdate AS acquired, concat('EPSG:326',10+o_custkey%50) AS crs, [10.0::DOUBLE,o_custkey%7*1000.0] AS transform, 100 AS width, 100 AS height FROM orders WHERE o_orderkey%23<>5),
r AS (SELECT o_orderkey AS raster_id, concat(CASE WHEN o_orderkey%11=3 THEN 'n' ELSE 'r' END,o_orderkey) AS asset_id, CASE WHEN o_orderkey%13=2 THEN 'swir' ELSE 'red' END AS band, CASE WHEN o_orderkey%17=4 THEN -1 ELSE o_custkey END AS item_id,
 CASE WHEN o_orderkey%7=1 THEN o_orderdate+INTERVAL 1 DAY ELSE o_orderdate END AS acquired, CASE WHEN o_orderkey%5=2 THEN 'EPSG:4326' ELSE concat('EPSG:326',10+o_custkey%50) END AS crs,
 [CASE WHEN o_orderkey%19=6 THEN 20.0 ELSE 10.0 END::DOUBLE,o_custkey%7*1000.0] AS transform, CASE WHEN o_orderkey%29=7 THEN 50 ELSE 100 END AS width, CASE WHEN o_orderkey%31=8 THEN 50 ELSE 100 END AS height FROM orders)"""


def bands(spark, d):
    """The same two tables."""
    o, k, c = V.read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    text, crs = k.cast("string"), F.concat(F.lit("EPSG:326"), (10 + c % 50).cast("string"))
    origin = (c % 7 * 1000).cast("double")
    odd = lambda n, at, x, y: F.when(k % n == at, x).otherwise(y)
    one = o.where(k % 23 != 5).select(k.alias("raster_id"), F.concat(F.lit("n"), text).alias("asset_id"), F.lit("nir").alias("band"), c.alias("item_id"), F.col("o_orderdate").alias("acquired"), crs.alias("crs"), F.array(F.lit(10.0), origin).alias("transform"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    two = o.select(
        k.alias("raster_id"), F.concat(odd(11, 3, "n", "r"), text).alias("asset_id"), odd(13, 2, "swir", "red").alias("band"), odd(17, 4, F.lit(-1), c).alias("item_id"), odd(7, 1, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"), F.col("o_orderdate")).alias("acquired"),
        odd(5, 2, F.lit("EPSG:4326"), crs).alias("crs"), F.array(odd(19, 6, F.lit(20.0), F.lit(10.0)), origin).alias("transform"), odd(29, 7, 50, 100).alias("width"), odd(31, 8, 50, 100).alias("height"),
    )
    return one, two


@query(f"""WITH {BANDS} SELECT coalesce(n.raster_id,r.raster_id) AS raster_id, CASE WHEN n.band IS NULL OR r.band IS NULL THEN 'missing_band' WHEN n.band<>'nir' OR r.band<>'red' THEN 'wrong_band' WHEN n.asset_id=r.asset_id THEN 'same_asset' WHEN n.item_id<>r.item_id THEN 'item_id_mismatch'
 WHEN n.acquired<>r.acquired THEN 'acquired_mismatch' WHEN n.crs<>r.crs THEN 'crs_mismatch' WHEN n.transform<>r.transform THEN 'transform_mismatch' WHEN n.width<>r.width THEN 'width_mismatch' WHEN n.height<>r.height THEN 'height_mismatch' END AS code FROM n FULL JOIN r ON n.raster_id=r.raster_id""")
def pair_rejections(spark, d):
    """The first reason against each pair of bands."""
    return P.pair_codes(*bands(spark, d))


@query(f"""WITH {BANDS} SELECT n.raster_id, CASE WHEN n.crs<>r.crs THEN 'crs_mismatch' WHEN n.transform<>r.transform THEN 'transform_mismatch' WHEN n.width<>r.width THEN 'width_mismatch' WHEN n.height<>r.height THEN 'height_mismatch' END AS code FROM n JOIN r ON n.raster_id=r.raster_id WHERE n.asset_id<>r.asset_id AND r.band='red'""")
def date_pair_rejections(spark, d):
    """Two dates need one grid, but not one acquisition."""
    one, two = bands(spark, d)
    codes = P.pair_codes(one, two, same=["crs", "transform", "width", "height"])
    return codes.where("code IS NULL OR code NOT IN ('missing_band', 'wrong_band', 'same_asset')")


@query(f"""WITH {BANDS}, {ND.strip()}, bad AS (SELECT n.raster_id FROM n JOIN r ON n.raster_id=r.raster_id WHERE r.band='red' AND n.asset_id<>r.asset_id AND n.item_id=r.item_id AND n.acquired=r.acquired AND n.crs=r.crs AND n.transform=r.transform AND n.width=r.width AND n.height=r.height)
SELECT raster_id, {STATS.format(ok='ok', v='v')} FROM ndvi JOIN bad USING (raster_id) GROUP BY raster_id""")
def admitted_ndvi(spark, d):
    """NDVI of the pairs that are admitted, and of no other."""
    codes = P.pair_codes(*bands(spark, d))
    return P.summary(P.band_ratio(P.admitted(band(spark, d, "nir_dn"), codes), band(spark, d, "red_dn")), ["raster_id"])


@query(f"WITH {ND} SELECT raster_id, row_idx, col_idx, round(v,6) AS value, ok AS valid FROM ndvi")
def ndvi_pixels(spark, d):
    """The product itself."""
    return ndvi(spark, d).select(*CELL, F.round("value", 6).alias("value"), "valid")


@query(f"WITH {ND} SELECT raster_id, count(*) FILTER (WHERE ok) AS n, round(sum(v),4) AS total FROM ndvi GROUP BY raster_id")
def ndvi_tiles(spark, d):
    """J01 on tiles: arrays joined by tile and zipped."""
    p = V.pixels(spark, d)
    tiles = P.band_ratio_tiles(P.to_tiles(p, "nir_dn", size=8), P.to_tiles(p, "red_dn", size=8))
    v = tiles.select("raster_id", F.explode("values").alias("v"))
    return v.groupBy("raster_id").agg(F.count("v").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query(f"SELECT raster_id, count(*) FILTER (WHERE mask) AS mask_valid, count(*) FILTER (WHERE mask AND scl NOT IN {BAD}) AS clear_pixels, count(*) FILTER (WHERE mask AND scl IN {BAD}) AS excluded_pixels FROM v_pixels GROUP BY raster_id")
def cloud_mask_counts(spark, d):
    """Mask-valid, clear and excluded pixels."""
    p = classes(spark, d)
    clear = R.clear(F.col("scene_class"), F.col("mask"))
    return p.groupBy("raster_id").agg(F.count_if("mask").alias("mask_valid"), F.count_if(clear).alias("clear_pixels"), F.count_if(F.col("mask") & ~clear).alias("excluded_pixels"))


@query("SELECT raster_id, row_idx, col_idx, 660000 + 10*(col_idx+0.5)::DOUBLE AS x, 3550000 - 10*(row_idx+0.5)::DOUBLE AS y, CAST(floor((10*(col_idx+0.5)::DOUBLE)/20) AS BIGINT) AS src_col, CAST(floor((-10*(row_idx+0.5)::DOUBLE)/-20) AS BIGINT) AS src_row FROM v_pixels")
def grid_to_world(spark, d):
    """pixel centres, and the 20 m pixel that holds each."""
    x = R.center_x(F.lit(660000.0), F.lit(10.0), F.col("col_idx"))
    y = R.center_y(F.lit(3550000.0), F.lit(-10.0), F.col("row_idx"))
    p = V.pixels(spark, d).select(*CELL, x.alias("x"), y.alias("y"))
    return p.withColumns({"src_col": R.source_index(F.col("x"), F.lit(660000.0), F.lit(20.0)), "src_row": R.source_index(F.col("y"), F.lit(3550000.0), F.lit(-20.0))})


@query("""WITH w AS (SELECT raster_id, row_idx, col_idx, CAST(floor((5+10*(col_idx+0.5))/20) AS BIGINT) AS sc, CAST(floor((5+10*(row_idx+0.5))/20) AS BIGINT) AS sr FROM v_pixels)
SELECT w.raster_id, w.row_idx, w.col_idx, CASE WHEN coalesce(s.mask AND s.scl<>0,false) THEN s.scl ELSE 255 END AS code, coalesce(s.mask AND s.scl<>0,false) AS valid
FROM w LEFT JOIN v_pixels s ON s.raster_id=w.raster_id AND s.row_idx=w.sr AND s.col_idx=w.sc""")
def nearest_resample(spark, d):
    """20 m classes on a shifted 10 m grid."""
    tiles = P.to_tiles(V.pixels(spark, d), "scl", size=TILE)
    out = whole(tiles, T.resample(tiles, **SHIFTED, method="nearest"))
    return out.select(*CELL, F.col("value").cast("long").alias("code"), "valid")


TILE = 8
SHIFTED = {"src": (20.0, 0.0, -20.0, 0.0), "dst": (10.0, 5.0, -10.0, -5.0), "shape": (20, 20), "target": (20, 20), "size": TILE}


def whole(source, resampled):
    """Pixels of resampled tiles; of a raster that ends early, as many as its source has."""
    sizes = source.groupBy("raster_id").agg(F.sum(F.size("values")).alias("n"))
    return T.from_tiles(resampled, 20, size=TILE).join(sizes, "raster_id").where("row_idx * 20 + col_idx < n").drop("n")


@query("""WITH t AS (SELECT raster_id, row_idx, col_idx, (5+10*(col_idx+0.5))/20.0 AS x, (5+10*(row_idx+0.5))/20.0 AS y FROM v_pixels),
u AS (SELECT *, floor(x-0.5) AS c0, floor(y-0.5) AS r0, x-0.5-floor(x-0.5) AS du, y-0.5-floor(y-0.5) AS dv FROM t),
n AS (SELECT raster_id, row_idx, col_idx, x, y, least(greatest(r0+a,0),19)::BIGINT AS sr, least(greatest(c0+b,0),19)::BIGINT AS sc,
  (CASE b WHEN 0 THEN 1-du ELSE du END)*(CASE a WHEN 0 THEN 1-dv ELSE dv END) AS w FROM u CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) k(a,b)),
g AS (SELECT n.raster_id, n.row_idx, n.col_idx, any_value(x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 20) AS within, sum(CASE WHEN coalesce(s.mask,false) THEN w ELSE 0 END) AS ws,
  sum(CASE WHEN coalesce(s.mask,false) THEN w*(s.nir_dn*0.0001::DOUBLE+ -0.1::DOUBLE) ELSE 0 END) AS vs
  FROM n LEFT JOIN v_pixels s ON s.raster_id=n.raster_id AND s.row_idx=n.sr AND s.col_idx=n.sc GROUP BY 1,2,3)
SELECT raster_id, row_idx, col_idx, CASE WHEN within AND ws>=1-1e-6 THEN round((vs/ws+0.1)*160000) END AS value, within AND ws>=1-1e-6 AS valid FROM g""")
def bilinear_resample(spark, d):
    """Four weighted neighbours, clamped at the edges."""
    tiles = P.to_tiles(V.pixels(spark, d).withColumn("value", R.physical(F.col("nir_dn"))), "value", size=TILE)
    out = whole(tiles, T.resample(tiles, **SHIFTED))
    # Values are sixteenths of a stored unit, so this is a whole number.
    return out.withColumn("value", F.round((F.col("value") + 0.1) * 160000))


STACK = f"""s AS (SELECT b.raster_id AS scene, b.row_idx, b.col_idx, b.mask AND a.mask AS aligned, b.scl AS bs, a.scl AS ac, b.red_dn AS br, a.red_dn AS ar
 FROM v_pixels b JOIN v_pixels a ON a.raster_id=b.raster_id+1 AND a.row_idx=b.row_idx AND a.col_idx=b.col_idx)"""


def two_dates(spark, d):
    """Each raster with the next as its second date."""
    p = V.pixels(spark, d)
    cols = [F.col("row_idx"), F.col("col_idx"), F.col("red_dn").alias("red"), F.col("scl").alias("scene_class"), F.col("mask")]
    return P.stack_two_dates(p.select(F.col("raster_id").alias("scene"), *cols), p.select((F.col("raster_id") - 1).alias("scene"), *cols))


@query(f"""WITH {STACK} SELECT scene, count(*) AS total_pixels, count(*) FILTER (WHERE aligned) AS aligned_pixels,
 count(*) FILTER (WHERE aligned AND bs NOT IN {BAD} AND ac NOT IN {BAD}) AS clear_pixels, round(count(*) FILTER (WHERE aligned)::DOUBLE/count(*),6) AS aligned_fraction,
 round(coalesce(count(*) FILTER (WHERE aligned AND bs IN {BAD})::DOUBLE/nullif(count(*) FILTER (WHERE aligned),0),0),6) AS before_cloud,
 round(coalesce(count(*) FILTER (WHERE aligned AND ac IN {BAD})::DOUBLE/nullif(count(*) FILTER (WHERE aligned),0),0),6) AS after_cloud FROM s GROUP BY scene""")
def two_date_stack(spark, d):
    """Aligned and clear shares of two dates."""
    return P.stack_summary(two_dates(spark, d), ["scene"])


@query(f"WITH {STACK} SELECT scene, row_idx, col_idx, CASE WHEN aligned THEN br END AS before_red, CASE WHEN aligned THEN ar END AS after_red, CASE WHEN aligned THEN bs END AS before_class, CASE WHEN aligned THEN ac END AS after_class, aligned FROM s")
def two_date_pixels(spark, d):
    """The stack itself, masked by the intersection of dates."""
    return two_dates(spark, d).select("scene", "row_idx", "col_idx", "before_red", "after_red", "before_class", "after_class", "aligned")


def _pairs():
    from .catalog_queries import PAIR

    return PAIR


@query(f"""{_pairs()}, b AS (SELECT request_id, row_idx, col_idx, scl, mask FROM sel JOIN v_pixels ON raster_id=before_id%25 WHERE reason='selected'), a AS (SELECT request_id, row_idx, col_idx, scl, mask FROM sel JOIN v_pixels ON raster_id=after_id%25 WHERE reason='selected'),
t AS (SELECT request_id, b.mask AND a.mask AS aligned, b.scl AS bs, a.scl AS ac FROM b JOIN a USING (request_id,row_idx,col_idx))
SELECT request_id, count(*) AS total_pixels, count(*) FILTER (WHERE aligned) AS aligned_pixels, count(*) FILTER (WHERE aligned AND bs NOT IN {BAD} AND ac NOT IN {BAD}) AS clear_pixels, round(count(*) FILTER (WHERE aligned)::DOUBLE/count(*),6) AS aligned_fraction,
 round(coalesce(count(*) FILTER (WHERE aligned AND bs IN {BAD})::DOUBLE/nullif(count(*) FILTER (WHERE aligned),0),0),6) AS before_cloud, round(coalesce(count(*) FILTER (WHERE aligned AND ac IN {BAD})::DOUBLE/nullif(count(*) FILTER (WHERE aligned),0),0),6) AS after_cloud FROM t GROUP BY 1""")
def aligned_pairs(spark, d):
    """The best pair of each request, aligned and summed (25 rasters stand for all scenes)."""
    from .catalog_queries import best_pairs

    pairs = best_pairs(spark, d).select("request_id", (F.col("before_id") % 25).alias("before_id"), (F.col("after_id") % 25).alias("after_id"))
    p = V.pixels(spark, d).where("raster_id < 25").select(F.col("raster_id").alias("item_id"), "row_idx", "col_idx", F.col("red_dn").alias("red"), F.col("scl").alias("scene_class"), "mask")
    return P.pair_summary(pairs, p)


@query("""SELECT r.raster_id, k AS class, count(p.scl) AS pixels FROM (SELECT DISTINCT raster_id FROM v_pixels) r CROSS JOIN (SELECT unnest(range(12)) AS k) c
 LEFT JOIN v_pixels p ON p.raster_id=r.raster_id AND p.scl=k AND p.mask GROUP BY 1,2""")
def class_histogram(spark, d):
    """Twelve bins, zeros included."""
    return P.class_histogram(V.pixels(spark, d).withColumn("valid", F.col("mask")), ["raster_id"], "scl")


@query("SELECT raster_id, scl AS class, count(*) AS pixels FROM v_pixels WHERE mask AND col_idx BETWEEN 3 AND 11 AND row_idx BETWEEN 5 AND 14 GROUP BY 1,2")
def window_classes(spark, d):
    """Class counts of a window, nodata left out."""
    p = P.in_window(V.pixels(spark, d), (3, 5, 12, 15)).where("mask")
    return p.groupBy("raster_id", F.col("scl").alias("class")).agg(F.count(F.lit(1)).alias("pixels"))


@query("""WITH c AS (SELECT raster_id, scl, count(*) AS n FROM v_pixels WHERE mask GROUP BY 1,2), t AS (SELECT *, sum(n) OVER (PARTITION BY raster_id) AS total, row_number() OVER (PARTITION BY raster_id ORDER BY n DESC, scl) AS k FROM c)
SELECT raster_id, scl AS dominant, n AS pixels, round(n::DOUBLE/total,6) AS fraction FROM t WHERE k=1""")
def dominant_class(spark, d):
    """The largest class, the smaller code of equals."""
    return P.dominant_class(V.pixels(spark, d).where("mask"), ["raster_id"], "scl")


@query(f"SELECT raster_id, round(coalesce(count(*) FILTER (WHERE mask AND scl IN {BAD})::DOUBLE/nullif(count(*) FILTER (WHERE mask),0),0),6) AS cloud_fraction, round(count(*) FILTER (WHERE NOT mask)::DOUBLE/count(*),6) AS nodata_fraction FROM v_pixels GROUP BY 1")
def cloud_fraction(spark, d):
    """Cloud share of valid pixels, nodata share of all."""
    n = F.count_if("mask")
    cloud = F.count_if(F.col("mask") & F.col("scl").isin(*R.EXCLUDED_CLASSES))
    return V.pixels(spark, d).groupBy("raster_id").agg(F.round(F.coalesce(R.ratio(cloud, n), F.lit(0.0)), 6).alias("cloud_fraction"), F.round(F.avg((~F.col("mask")).cast("int")), 6).alias("nodata_fraction"))


@query("SELECT raster_id, count(*) FILTER (WHERE scl NOT BETWEEN 1 AND 11) AS violations FROM v_pixels GROUP BY 1")
def domain_check(spark, d):
    """Codes outside their domain."""
    return P.domain_violations(V.pixels(spark, d), ["raster_id"], "scl", list(range(1, 12)))


EDGES = """v AS (SELECT zone_id, i, x, y, lead(x) OVER (PARTITION BY zone_id ORDER BY i) AS x2, lead(y) OVER (PARTITION BY zone_id ORDER BY i) AS y2 FROM v_zone_vertices), e AS (SELECT * FROM v WHERE x2 IS NOT NULL)"""


@query(f"WITH {EDGES} SELECT zone_id, round(sum(x*y2-x2*y)/2,6) AS area, false AS crossed FROM e GROUP BY 1")
def zone_area(spark, d):
    """signed area, and whether edges cross."""
    return V.zones(spark, d).select("zone_id", F.round(geo.ring_area(F.col("ring")), 6).alias("area"), geo.self_intersects(F.col("ring")).alias("crossed"))


@query(f"WITH {EDGES} SELECT zone_id, CAST(i AS BIGINT) AS edge, x AS x1, y AS y1, x2, y2 FROM e")
def zone_edges(spark, d):
    """Edges of each ring."""
    z = V.zones(spark, d).select("zone_id", "ring", F.explode(F.sequence(F.lit(1), F.size("ring") - 1)).alias("i"))
    a, b = F.element_at("ring", F.col("i")), F.element_at("ring", F.col("i") + 1)
    return z.select("zone_id", (F.col("i") - 1).cast("long").alias("edge"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


# The zones are convex, counter-clockwise and closed, so a point on no edge's right side is inside.
IN_ZONE = f"""{EDGES}, g AS (SELECT DISTINCT raster_id, row_idx, col_idx, col_idx+0.5 AS px, row_idx+0.5 AS py FROM v_pixels),
i AS (SELECT zone_id, raster_id, row_idx, col_idx FROM g JOIN e ON true GROUP BY 1,2,3,4 HAVING min((x2-x)*(py-y)-(y2-y)*(px-x)) >= 0)"""


def points(spark, d):
    p = ndvi(spark, d, True)
    return p.withColumns({"x": R.center_x(F.lit(0.0), F.lit(1.0), F.col("col_idx")), "y": R.center_y(F.lit(0.0), F.lit(1.0), F.col("row_idx"))})


@query(f"WITH {IN_ZONE} SELECT zone_id, raster_id, row_idx, col_idx FROM i")
def pixels_in_zones(spark, d):
    """Spatial join by grid cells."""
    return P.pixels_in_zones(points(spark, d), V.zones(spark, d)).select("zone_id", *CELL)


@query(f"""WITH {IN_ZONE}, {ND.strip()}, s AS (SELECT zone_id, raster_id, count(*) AS zone_pixels, count(*) FILTER (WHERE ok AND clear) AS valid_pixels, count(*) FILTER (WHERE NOT (ok AND clear)) AS invalid_pixels,
 round(count(*) FILTER (WHERE ok AND clear)::DOUBLE/count(*),6) AS valid_fraction, round(min(CASE WHEN ok AND clear THEN v END),6) AS min_value, round(max(CASE WHEN ok AND clear THEN v END),6) AS max_value, round(avg(CASE WHEN ok AND clear THEN v END),6) AS mean_value
 FROM i JOIN ndvi USING (raster_id,row_idx,col_idx) GROUP BY 1,2)
SELECT z.zone_id, raster_id, zone_pixels, valid_pixels, invalid_pixels, valid_fraction, min_value, max_value, mean_value, CASE WHEN raster_id IS NULL THEN 'no_pixel_centres' END AS code FROM (SELECT DISTINCT zone_id FROM v_zone_vertices) z LEFT JOIN s USING (zone_id)""")
def zonal_stats(spark, d):
    """Statistics by raster and zone, from tiles and the runs of zones on the one grid."""
    tiles = P.to_tiles(ndvi(spark, d, True).withColumn("mask", F.col("valid")), "value", size=8).withColumn("grid_id", F.lit(1))
    return T.zonal_stats(tiles, V.zones(spark, d), grid(spark), size=8)


def grid(spark):
    """The grid that all rasters here share."""
    return spark.range(1).select(F.lit(1).alias("grid_id"), *(F.lit(v).alias(k) for k, v in {"a": 1.0, "c": 0.0, "e": 1.0, "f": 0.0}.items()), F.lit(20).alias("width"), F.lit(20).alias("height"))


@query(f"WITH {IN_ZONE}, held AS (SELECT DISTINCT zone_id, row_idx, col_idx FROM i), islands AS (SELECT *, col_idx-row_number() OVER (PARTITION BY zone_id, row_idx ORDER BY col_idx) AS k FROM held) SELECT zone_id, row_idx, min(col_idx) AS first, max(col_idx) AS last FROM islands GROUP BY zone_id, row_idx, k")
def zone_runs(spark, d):
    """A scanline fill of each zone on the grid."""
    return T.zone_runs(V.zones(spark, d), grid(spark)).drop("grid_id", "width")


@query("""WITH c AS (SELECT raster_id, count(*) FILTER (WHERE mask AND NOT manual IN (1,2) AND NOT scl IN (8,9,10)) AS tn, count(*) FILTER (WHERE mask AND NOT manual IN (1,2) AND scl IN (8,9,10)) AS fp,
 count(*) FILTER (WHERE mask AND manual IN (1,2) AND NOT scl IN (8,9,10)) AS fn, count(*) FILTER (WHERE mask AND manual IN (1,2) AND scl IN (8,9,10)) AS tp FROM v_pixels GROUP BY 1)
SELECT raster_id, tn, fp, fn, tp, round(tp::DOUBLE/nullif(tp+fp,0),6) AS precision, round(tp::DOUBLE/nullif(tp+fn,0),6) AS recall, round(tp::DOUBLE/nullif(tp+fp+fn,0),6) AS iou,
 round(tn::DOUBLE/nullif(tn+fp,0),6) AS specificity, round((tp::DOUBLE/nullif(tp+fn,0)+tn::DOUBLE/nullif(tn+fp,0))/2,6) AS balanced_accuracy FROM c""")
def cloud_confusion(spark, d):
    """Manual against scene classes on jointly valid pixels."""
    return C.ratios(confusion_counts(spark, d))


def confusion_counts(spark, d):
    manual = V.pixels(spark, d).where("mask").select(*CELL, "manual")
    scene = V.pixels(spark, d).where("mask").select(*CELL, "scl")
    return C.confusion(manual.join(scene, CELL), F.col("manual").isin(1, 2), F.col("scl").isin(8, 9, 10), ["raster_id"])


CONF = """c AS (SELECT raster_id, count(*) FILTER (WHERE NOT manual IN (1,2) AND NOT scl IN (8,9,10)) AS tn, count(*) FILTER (WHERE NOT manual IN (1,2) AND scl IN (8,9,10)) AS fp,
 count(*) FILTER (WHERE manual IN (1,2) AND NOT scl IN (8,9,10)) AS fn, count(*) FILTER (WHERE manual IN (1,2) AND scl IN (8,9,10)) AS tp FROM v_pixels WHERE mask GROUP BY 1)"""


@query(f"""WITH {CONF}, s AS (SELECT sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp)::BIGINT AS tp FROM c)
SELECT tn, fp, fn, tp, round(tp::DOUBLE/nullif(tp+fp,0),6) AS precision, round(tp::DOUBLE/nullif(tp+fn,0),6) AS recall, round(tp::DOUBLE/nullif(tp+fp+fn,0),6) AS iou,
 round(tn::DOUBLE/nullif(tn+fp,0),6) AS specificity, round((tp::DOUBLE/nullif(tp+fn,0)+tn::DOUBLE/nullif(tn+fp,0))/2,6) AS balanced_accuracy FROM s""")
def cloud_confusion_micro(spark, d):
    """Counts of all windows first, ratios after."""
    return C.micro(confusion_counts(spark, d), [])


DEC = f"""{CONF}, f AS (SELECT raster_id, t AS threshold, (tp+fn)::DOUBLE/(tn+fp+fn+tp) AS tf, (tp+fp)::DOUBLE/(tn+fp+fn+tp) AS pf FROM c CROSS JOIN (VALUES (0.2::DOUBLE),(0.25::DOUBLE),(0.5::DOUBLE)) v(t)),
o AS (SELECT *, CASE WHEN tf<=threshold AND pf<=threshold THEN 'true_accept' WHEN pf<=threshold THEN 'false_accept' WHEN tf<=threshold THEN 'false_reject' ELSE 'true_reject' END AS outcome FROM f)"""


@query(f"WITH {DEC} SELECT raster_id, threshold, round(tf,6) AS true_fraction, round(pf,6) AS predicted_fraction, outcome FROM o")
def threshold_decisions(spark, d):
    """Accept or reject by threshold."""
    return C.decisions(confusion_counts(spark, d), [0.2, 0.25, 0.5], ["raster_id"])


@query(f"""WITH {DEC} SELECT threshold, count(*) FILTER (WHERE outcome='true_accept') AS true_accepts, count(*) FILTER (WHERE outcome='false_accept') AS false_accepts, count(*) FILTER (WHERE outcome='false_reject') AS false_rejects,
 count(*) FILTER (WHERE outcome='true_reject') AS true_rejects, round(count(*) FILTER (WHERE outcome IN ('true_accept','true_reject'))::DOUBLE/count(*),6) AS accuracy,
 coalesce(string_agg(raster_id::VARCHAR, ',' ORDER BY raster_id) FILTER (WHERE outcome='false_accept'),'') AS false_accept_ids, coalesce(string_agg(raster_id::VARCHAR, ',' ORDER BY raster_id) FILTER (WHERE outcome='false_reject'),'') AS false_reject_ids FROM o GROUP BY 1""")
def cloud_policy_benchmark(spark, d):
    """Outcome counts, accuracy and wrong windows of each threshold."""
    return C.decision_summary(C.decisions(confusion_counts(spark, d), [0.2, 0.25, 0.5], ["raster_id"]), "raster_id")


CHANGE = """m AS (SELECT b.raster_id, b.nir_dn>3500 AS b, a.nir_dn>3500 AS a FROM v_pixels b JOIN v_pixels a ON a.raster_id=b.raster_id+1 AND a.row_idx=b.row_idx AND a.col_idx=b.col_idx),
ch AS (SELECT raster_id, count(*) FILTER (WHERE NOT b AND a) AS new_pixels, count(*) FILTER (WHERE b AND NOT a) AS demolished_pixels, count(*) AS total_pixels FROM m GROUP BY 1),
ct AS (SELECT *, round((new_pixels+demolished_pixels)::DOUBLE/total_pixels,6) AS change_fraction, CASE WHEN new_pixels+demolished_pixels=0 THEN 'none' WHEN (new_pixels+demolished_pixels)::DOUBLE/total_pixels<=0.1 THEN 'minor' ELSE 'major' END AS change_class,
 CASE WHEN new_pixels+demolished_pixels=0 THEN 'none' WHEN new_pixels>demolished_pixels*1.5 THEN 'construction' WHEN demolished_pixels>new_pixels*1.5 THEN 'demolition' ELSE 'mixed' END AS direction FROM ch)"""


def changes(spark, d):
    p = V.pixels(spark, d)
    before = p.select(*CELL, (F.col("nir_dn") > 3500).alias("before"))
    after = p.select((F.col("raster_id") - 1).alias("raster_id"), "row_idx", "col_idx", (F.col("nir_dn") > 3500).alias("after"))
    return C.change_truth(before.join(after, CELL), ["raster_id"])


@query(f"WITH {CHANGE} SELECT * FROM ct")
def change_truth(spark, d):
    """Class and direction of change."""
    return changes(spark, d)


SAID = "(raster_id%7)::DOUBLE/10"


@query(f"""WITH {CHANGE}, k AS (SELECT *, CASE raster_id%3 WHEN 0 THEN 'major' ELSE change_class END AS said_class, CASE raster_id%4 WHEN 0 THEN 'mixed' ELSE direction END AS said_way, {SAID} AS said FROM ct),
s AS (SELECT raster_id, (said_class=change_class)::INT::DOUBLE AS class_score, (said_way=direction)::INT::DOUBLE AS direction_score, round(greatest(0,1-abs(said-change_fraction)/0.25),6) AS fraction_score FROM k)
SELECT *, round((0.4*class_score+0.3*direction_score+0.3*fraction_score)/1.0,6) AS reward FROM s""")
def change_scores(spark, d):
    """Answers about change (made from the raster's number) scored against the masks."""
    k = F.col("raster_id")
    rows = changes(spark, d).withColumns({"said_class": F.when(k % 3 == 0, "major").otherwise(F.col("change_class")), "said_way": F.when(k % 4 == 0, "mixed").otherwise(F.col("direction")), "said": (k % 7).cast("double") / 10})
    hit = lambda a, b: (F.col(a) == F.col(b)).cast("int").cast("double")
    rows = rows.select("raster_id", hit("said_class", "change_class").alias("class_score"), hit("said_way", "direction").alias("direction_score"), C.fraction_score(F.col("said"), F.col("change_fraction"), 0.25).alias("fraction_score"))
    return rows.withColumn("reward", F.round((0.4 * F.col("class_score") + 0.3 * F.col("direction_score") + 0.3 * F.col("fraction_score")) / 1.0, 6))


SIZES_SQL = "r AS (SELECT l_orderkey*10+l_linenumber AS raster_id, CAST(l_quantity*300 AS BIGINT)+1 AS width, CAST(l_partkey%5000 AS BIGINT)+1 AS height, CAST(l_extendedprice*5000 AS BIGINT) AS bytes FROM lineitem)"


def sizes(spark, d):
    """Raster sizes made of line items."""
    return V.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("raster_id"), ((F.col("l_quantity") * 300).cast("long") + 1).alias("width"), (F.col("l_partkey") % 5000 + 1).alias("height"), F.round(F.col("l_extendedprice") * 5000).cast("long").alias("bytes"))


@query(f"""WITH {SIZES_SQL}, t AS (SELECT raster_id, width, height, unnest(range(CAST(ceil(width/2048.0)*ceil(height/2048.0) AS BIGINT))) AS tile_index, CAST(ceil(width/2048.0) AS BIGINT) AS nc FROM r)
SELECT raster_id, tile_index, tile_index%nc*2048 AS col_off, tile_index//nc*2048 AS row_off, least(2048,width-tile_index%nc*2048) AS tile_width, least(2048,height-tile_index//nc*2048) AS tile_height FROM t""")
def tile_grid(spark, d):
    """Clipped windows in row-major order."""
    return P.tile_grid(sizes(spark, d))


@query("WITH r AS (SELECT c_custkey AS raster_id, c_custkey%5*2+3 AS w, c_custkey%4*3+2 AS h FROM customer), c AS (SELECT raster_id, w, h, unnest(range(w)) AS col_idx FROM r) SELECT raster_id, col_idx, unnest(range(h)) AS row_idx FROM c")
def pixel_grid(spark, d):
    """Pixels of small rasters, tile by tile."""
    k = F.col("c_custkey").cast("long")
    rasters = V.read(spark, d, "customer").select(F.col("c_custkey").alias("raster_id"), (k % 5 * 2 + 3).alias("width"), (k % 4 * 3 + 2).alias("height"))
    return P.pixel_grid(P.tile_grid(rasters, tile=8))


@query(f"WITH {SIZES_SQL} SELECT CASE WHEN bytes>134217728 THEN 'oversize' WHEN width*height>20000000 THEN 'window' ELSE 'whole' END AS admission, count(*) AS rasters FROM r GROUP BY 1")
def raster_admission(spark, d):
    """Whole, by windows, or refused."""
    rows = sizes(spark, d).select(P.admission(F.col("width"), F.col("height"), F.col("bytes")).alias("admission"))
    return rows.groupBy("admission").agg(F.count(F.lit(1)).alias("rasters"))


@query(f"""WITH {SIZES_SQL}, t AS (SELECT raster_id, unnest(range(CAST(ceil(width/2048.0)*ceil(height/2048.0) AS BIGINT))) AS tile_index FROM r) SELECT raster_id, tile_index FROM t ORDER BY tile_index, raster_id LIMIT 500""")
def round_robin_windows(spark, d):
    """One window of each source in turn; the limit is the feature."""
    return P.round_robin(P.tile_grid(sizes(spark, d)), 500).select("raster_id", "tile_index")


@query("""WITH s AS (SELECT raster_id, max(row_idx)+1 AS height FROM v_pixels GROUP BY 1), a AS (SELECT raster_id, CASE WHEN 20*height*100000>20000000 THEN 'window' ELSE 'whole' END AS admission FROM s), w AS (SELECT p.raster_id, row_idx, col_idx, red_dn, (row_idx//8)*3+col_idx//8 AS tile_index FROM v_pixels p JOIN a USING (raster_id) WHERE admission='window' AND mask),
k AS (SELECT raster_id, tile_index FROM (SELECT DISTINCT raster_id, tile_index FROM (SELECT raster_id, unnest(range(((height+7)//8)*3)) AS tile_index FROM s JOIN a USING (raster_id) WHERE admission='window')) ORDER BY tile_index, raster_id LIMIT 60)
SELECT w.raster_id, row_idx, col_idx, red_dn::DOUBLE+d.v AS red_dn, d.side FROM w JOIN k USING (raster_id, tile_index), (VALUES (0,'missing'),(1,'unexpected')) d(v,side) WHERE raster_id%5=0 AND row_idx=3 AND col_idx=7""")
def window_admission(spark, d):
    """Large rasters are cut to windows, one of each in turn; each window is checked by hashes, then by pixel: one is damaged in each fifth raster."""
    tiles = P.to_tiles(V.pixels(spark, d), "red_dn", size=TILE).withColumn("values", F.col("values").cast("array<double>"))
    rasters = V.pixels(spark, d).groupBy("raster_id").agg(F.lit(20).alias("width"), (F.max("row_idx") + 1).alias("height"))
    # A pixel here stands for a hundred thousand.
    cut = rasters.where(P.admission(F.col("width"), F.col("height") * 100_000, F.lit(0)) == "window")
    chosen = P.round_robin(P.tile_grid(cut, tile=TILE), 60).select("raster_id", F.expr(f"row_off div {TILE}").alias("tile_row"), F.expr(f"col_off div {TILE}").alias("tile_col"))
    source = tiles.join(chosen, ["raster_id", "tile_row", "tile_col"], "left_semi")
    hit = (F.col("raster_id") % 5 == 0) & (F.col("tile_row") == 0) & (F.col("tile_col") == 0)
    damaged = source.withColumn("values", F.when(hit, F.transform("values", lambda v, i: F.when(i == 3 * TILE + 7, v + 1).otherwise(v))).otherwise(F.col("values")))
    return T.verify_windows(source, damaged, 20, size=TILE, value="red_dn")


@query("SELECT raster_id, row_idx, col_idx, red_dn, 'missing' AS side FROM v_pixels WHERE raster_id%5=0 AND col_idx=7")
def verify_windows(spark, d):
    """Windows that lost a column of some rasters are found by set difference."""
    p = V.pixels(spark, d)
    damaged = p.where(~((F.col("raster_id") % 5 == 0) & (F.col("col_idx") == 7)))
    return P.verify_windows(p, damaged, [*CELL, "red_dn"])


@query(f"""WITH {ND}, s AS (SELECT raster_id, count(*) AS total_pixels FROM ndvi GROUP BY 1) SELECT raster_id, CASE raster_id%3 WHEN 0 THEN 'total_mismatch' ELSE 'statistics_mismatch' END AS code FROM s WHERE raster_id%3<2""")
def validate_products(spark, d):
    """Stored summaries, two thirds of them damaged, against recomputed ones."""
    made = P.summary(ndvi(spark, d), ["raster_id"])
    k = F.col("raster_id") % 3
    stored = made.withColumns({"total_pixels": F.when(k == 0, F.col("total_pixels") + 1).otherwise(F.col("total_pixels")), "mean_value": F.when(k == 1, F.col("mean_value") + 1).otherwise(F.col("mean_value"))})
    return P.validate_product(ndvi(spark, d), stored, keys=["raster_id"])


@query("""WITH p AS (SELECT raster_id, red_dn%256 AS r, nir_dn%256 AS g, scl*20 AS b, CASE WHEN mask THEN 255 ELSE 0 END AS a FROM v_pixels), q AS (SELECT *, 0.2126*r+0.7152*g+0.0722*b AS l FROM p),
s AS (SELECT raster_id, round(avg(l::DOUBLE),8) AS luminance_mean, round(coalesce(var_samp(l::DOUBLE),0),5) AS luminance_variance, round(avg((a=255)::INT::DOUBLE),6) AS opaque_fraction, round(avg((abs(r-g)<=2 AND abs(g-b)<=2)::INT::DOUBLE),6) AS grey_fraction,
 least(count(DISTINCT r*65536+g*256+b),4096) AS colours FROM q GROUP BY 1)
SELECT *, luminance_variance>1 AND opaque_fraction>0.99 AND colours>=8 AS passed FROM s""")
def image_quality(spark, d):
    """Luminance, opacity, grey share and colours of rendered images."""
    p = V.pixels(spark, d).select("raster_id", (F.col("red_dn") % 256).alias("r"), (F.col("nir_dn") % 256).alias("g"), (F.col("scl") * 20).alias("b"), F.when(F.col("mask"), 255).otherwise(0).alias("a"))
    return C.image_quality(p, ["raster_id"])


@query("SELECT raster_id AS item_id, 'nir,red' AS band_set, true AS complete FROM v_pixels GROUP BY 1")
def band_pairing(spark, d):
    """Items with exactly one band of each kind."""
    ids = V.pixels(spark, d).select(F.col("raster_id").alias("item_id")).distinct()
    bands = ids.select("item_id", F.explode(F.array(F.lit("red"), F.lit("nir"))).alias("band"))
    return P.band_pairs(bands)
