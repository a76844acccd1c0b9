"""Queries over catalogs: boxes, intervals, search, pairs of scenes, views, evidence, STAC."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, hashing, paths, times
from ..operators import catalog as K
from . import views as V
from .registry import query


@query("""SELECT doc_id, west<=a_east AND east>=a_west AND south<=a_north AND north>=a_south AS meets, west<=a_west AND south<=a_south AND east>=a_east AND north>=a_north AS holds,
 abs(west-a_west)<=1e-9 AND abs(south-a_south)<=1e-9 AND abs(east-a_east)<=1e-9 AND abs(north-a_north)<=1e-9 AS same, west>=-180 AND east<=180 AND west<east AND south<north AS valid,
 west BETWEEN 0 AND 1 AND east BETWEEN 0 AND 1 AND south BETWEEN 0 AND 1 AND north BETWEEN 0 AND 1 AND west<east AND south<north AS unit_valid FROM v_boxes""")
def box_predicates(spark, d):
    """Meeting, containing, equal and valid boxes."""
    a, b = geo.box(), geo.box("a_")
    return V.boxes(spark, d).select("doc_id", geo.intersects(a, b).alias("meets"), geo.contains(a, b).alias("holds"), geo.same(a, b).alias("same"), geo.valid_box(a).alias("valid"), geo.valid_unit_box(a).alias("unit_valid"))


@query("""WITH x AS (SELECT *, greatest(0,least(east,a_east)-greatest(west,a_west))*greatest(0,least(north,a_north)-greatest(south,a_south)) AS shared FROM v_boxes)
SELECT doc_id, round(shared/((east-west)*(north-south)+(a_east-a_west)*(a_north-a_south)-shared),6) AS iou FROM x""")
def box_iou(spark, d):
    """intersection over union."""
    return V.boxes(spark, d).select("doc_id", F.round(geo.iou(geo.box(), geo.box("a_")), 6).alias("iou"))


@query("""SELECT item_id, CASE WHEN greatest(west,1.0)>=least(east,2.5) OR greatest(south,0.5)>=least(north,2.0) THEN 0.0::DOUBLE ELSE round(least(1,greatest(0,
 radians(least(east,2.5)-greatest(west,1.0))*(sin(radians(least(north,2.0)))-sin(radians(greatest(south,0.5))))/(radians(1.5)*(sin(radians(2.0))-sin(radians(0.5)))))),6) END AS coverage FROM v_scenes""")
def aoi_coverage(spark, d):
    """share of an area on the sphere that a scene covers."""
    area = [F.lit(1.0), F.lit(0.5), F.lit(2.5), F.lit(2.0)]
    return V.scenes(spark, d).select("item_id", F.round(geo.coverage(geo.box(), area), 6).alias("coverage"))


@query("""SELECT item_id, acquired BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AS inside, acquired<=TIMESTAMP '1997-01-01' AND acquired+INTERVAL 30 DAY>=TIMESTAMP '1996-06-01' AS overlaps,
 TIMESTAMP '1996-06-01'>=acquired AND TIMESTAMP '1996-06-01'<acquired+INTERVAL 90 DAY AS current, greatest(epoch_ms(TIMESTAMP '1998-01-01')-epoch_ms(acquired),0) AS elapsed FROM v_scenes""")
def time_predicates(spark, d):
    """Overlap, within, validity and elapsed time."""
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    at = F.col("acquired")
    return V.scenes(spark, d).select(
        "item_id",
        times.within(at, t("1996-01-01"), t("1996-12-31")).alias("inside"),
        times.overlap(at, at + F.expr("INTERVAL 30 DAY"), t("1996-06-01"), t("1997-01-01")).alias("overlaps"),
        times.current(t("1996-06-01"), at, at + F.expr("INTERVAL 90 DAY")).alias("current"),
        times.elapsed_ms(at, t("1998-01-01")).alias("elapsed"),
    )


QUERIES_SQL = """q AS (SELECT c_custkey AS query_id, c_custkey%20/10.0 AS q_west, c_custkey%15/10.0 AS q_south, c_custkey%20/10.0+0.5 AS q_east, c_custkey%15/10.0+0.5 AS q_north,
 TIMESTAMP '1995-01-01'+to_days(CAST(c_custkey*7%2000 AS INT)) AS q_start, TIMESTAMP '1995-01-31'+to_days(CAST(c_custkey*7%2000 AS INT)) AS q_end, (c_custkey%100)/100.0 AS max_cloud, c_custkey%3*5 AS "offset" FROM customer)"""


def catalog_queries(spark, d):
    """A search for each customer."""
    k = F.col("c_custkey")
    x, y = (k % 20) / 10.0, (k % 15) / 10.0
    day = (k * 7 % 2000).cast("int")
    start = lambda s: F.lit(s).cast("timestamp_ntz") + F.make_dt_interval(day)
    return V.read(spark, d, "customer").select(k.alias("query_id"), x.alias("q_west"), y.alias("q_south"), (x + 0.5).alias("q_east"), (y + 0.5).alias("q_north"), start("1995-01-01").alias("q_start"), start("1995-01-31").alias("q_end"), ((k % 100) / 100.0).alias("max_cloud"), (k % 3 * 5).alias("offset"))


@query(f"""WITH {QUERIES_SQL}, m AS (SELECT query_id, item_id, "offset", row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS position, count(*) OVER (PARTITION BY query_id) AS matched_count
 FROM q JOIN v_scenes s ON acquired BETWEEN q_start AND q_end AND west<=q_east AND east>=q_west AND south<=q_north AND north>=q_south AND cloud<=max_cloud)
SELECT query_id, item_id, position, matched_count, CASE WHEN "offset"+5<matched_count THEN "offset"+5 END AS next_offset FROM m WHERE position>"offset" AND position<="offset"+5""")
def catalog_search(spark, d):
    """Pages of five for every customer's search."""
    return K.search(V.scenes(spark, d), catalog_queries(spark, d), page=5)


REQUESTS = """rq AS (SELECT c_custkey AS request_id, c_custkey%20/10.0 AS q_west, c_custkey%15/10.0 AS q_south, c_custkey%20/10.0+1.0 AS q_east, c_custkey%15/10.0+1.0 AS q_north,
 TIMESTAMP '1995-01-01'+to_days(CAST(c_custkey*11%2400 AS INT)) AS before_start, TIMESTAMP '1995-01-04'+to_days(CAST(c_custkey*11%2400 AS INT)) AS before_end,
 TIMESTAMP '1995-01-20'+to_days(CAST(c_custkey*11%2400 AS INT)) AS after_start, TIMESTAMP '1995-01-23'+to_days(CAST(c_custkey*11%2400 AS INT)) AS after_end, (c_custkey%5)/5.0 AS min_coverage, (c_custkey%10)/10.0 AS max_cloud FROM customer),
cand AS (SELECT rq.*, item_id, acquired, platform, instrument, cloud, acquired BETWEEN before_start AND before_end AS is_before, CASE WHEN greatest(west,q_west)>=least(east,q_east) OR greatest(south,q_south)>=least(north,q_north) THEN 0.0::DOUBLE ELSE least(1.0,greatest(0.0,
 radians(least(east,q_east)-greatest(west,q_west))*(sin(radians(least(north,q_north)))-sin(radians(greatest(south,q_south))))/(radians(q_east-q_west)*(sin(radians(q_north))-sin(radians(q_south)))))) END AS coverage
 FROM rq JOIN v_scenes ON acquired BETWEEN before_start AND before_end OR acquired BETWEEN after_start AND after_end),
fl AS (SELECT *, coverage>=min_coverage AS covered, coverage>=min_coverage AND cloud<=max_cloud AS clear FROM cand),
st AS (SELECT request_id, least(count(*) FILTER (WHERE is_before), count(*) FILTER (WHERE NOT is_before)) AS dated, least(count(*) FILTER (WHERE is_before AND covered), count(*) FILTER (WHERE NOT is_before AND covered)) AS cov,
 least(count(*) FILTER (WHERE is_before AND clear), count(*) FILTER (WHERE NOT is_before AND clear)) AS clr FROM fl GROUP BY 1),
pr AS (SELECT b.request_id, b.item_id AS before_id, a.item_id AS after_id, row_number() OVER (PARTITION BY b.request_id ORDER BY b.cloud+a.cloud, -least(b.coverage,a.coverage), b.acquired, a.acquired, b.item_id, a.item_id) AS k
 FROM fl b JOIN fl a ON a.request_id=b.request_id AND a.platform=b.platform AND a.instrument=b.instrument AND b.is_before AND NOT a.is_before AND b.clear AND a.clear)"""
PAIR = f"""WITH {REQUESTS}, sel AS (SELECT rq.request_id, CASE WHEN coalesce(dated,0)=0 THEN 'wrong_date' WHEN cov=0 THEN 'insufficient_coverage' WHEN clr=0 THEN 'cloudy' WHEN k IS NULL THEN 'sensor_mismatch' ELSE 'selected' END AS reason, before_id, after_id
 FROM rq LEFT JOIN st USING (request_id) LEFT JOIN (SELECT * FROM pr WHERE k=1) p USING (request_id))"""


def requests(spark, d):
    """A request for two dates of each customer."""
    k = F.col("c_custkey")
    x, y = (k % 20) / 10.0, (k % 15) / 10.0
    at = lambda s: F.lit(s).cast("timestamp_ntz") + F.make_dt_interval((k * 11 % 2400).cast("int"))
    return V.read(spark, d, "customer").select(
        k.alias("request_id"), x.alias("q_west"), y.alias("q_south"), (x + 1.0).alias("q_east"), (y + 1.0).alias("q_north"),
        at("1995-01-01").alias("before_start"), at("1995-01-04").alias("before_end"), at("1995-01-20").alias("after_start"), at("1995-01-23").alias("after_end"),
        ((k % 5) / 5.0).alias("min_coverage"), ((k % 10) / 10.0).alias("max_cloud"),
    )


@query(f"{PAIR} SELECT request_id, CASE WHEN reason='selected' THEN 'selected' ELSE 'rejected' END AS status, reason, before_id, after_id FROM sel")
def best_pairs(spark, d):
    """The best pair of scenes, or the first reason against."""
    return K.select_pairs(requests(spark, d), V.scenes(spark, d))


@query(f"{PAIR} SELECT reason, count(*) AS requests FROM sel GROUP BY 1")
def pair_reasons(spark, d):
    """How requests ended."""
    return best_pairs(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("requests"))


@query("""WITH a AS (SELECT conv_id, turn, split(regexp_replace(lower(text),'[^a-z]+',' ','g'),' ') AS words FROM conversations)
SELECT conv_id, turn, list_contains(words,'the') AND list_contains(words,'of') AS has_both FROM a""")
def band_subset(spark, d):
    """Required names are a subset (words of a turn stand for bands)."""
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")
    return V.read(spark, d, "conversations").select("conv_id", "turn", (F.size(F.array_except(F.array(F.lit("the"), F.lit("of")), words)) == 0).alias("has_both"))


@query("""SELECT asset_id, len(list_intersect(regexp_split_to_array(lower(relative_path),'[^a-z0-9]+'), ['label','labels','mask','masks','annotation','annotations','gt','groundtruth','ground_truth']))>0 AS label_like FROM v_assets""")
def label_like_paths(spark, d):
    """Paths that look like labels."""
    return V.assets(spark, d).select("asset_id", paths.label_like(F.col("relative_path")).alias("label_like"))


@query("""SELECT asset_id, regexp_full_match(sha256,'[0-9a-f]{64}') AS is_sha, regexp_full_match(concat('1.',doc_id,'.0'),'[0-9]+\\.[0-9]+\\.[0-9]+') AS is_semver,
 regexp_full_match(concat('EPSG:32',600+doc_id%120),'EPSG:32[67](0[1-9]|[1-5][0-9]|60)') AS is_utm FROM v_assets""")
def format_checks(spark, d):
    """Hashes, versions and projections by pattern."""
    k = F.col("doc_id")
    return V.assets(spark, d).select("asset_id", F.col("sha256").rlike(paths.SHA256).alias("is_sha"), F.concat(F.lit("1."), k.cast("string"), F.lit(".0")).rlike(paths.SEMVER).alias("is_semver"), F.concat(F.lit("EPSG:32"), (k % 120 + 600).cast("string")).rlike(paths.UTM_CRS).alias("is_utm"))


@query("SELECT asset_id, doc_id, relative_path, size_bytes FROM v_assets WHERE doc_id%7<>0")
def public_assets(spark, d):
    """Private fields and label-like assets are hidden."""
    return K.public_view(V.assets(spark, d), private=("sha256", "dataset_id"))


@query("SELECT event_id, event_type LIKE 'p%' OR event_type='view' OR event_type='click' AS allowed FROM events")
def allowed_actions(spark, d):
    """Exact names and prefix patterns."""
    name = F.concat(F.substring("event_type", 1, 1), F.lit("."), F.col("event_type"))
    return V.read(spark, d, "events").select("event_id", paths.action_allowed(name, ["p.*", "v.view", "c.click"]).alias("allowed"))


@query("""WITH s AS (SELECT item_id, (west+east)/2+cloud*400 AS x, (south+north)/2-cloud*200 AS y, east-west AS w, north-south AS h FROM v_scenes)
SELECT item_id, round(greatest(CASE WHEN x-w/2 < -180 THEN -180 WHEN x+w/2 > 180 THEN 180-w ELSE x-w/2 END,-180),6) AS west, round(least(CASE WHEN x-w/2 < -180 THEN -180+w WHEN x+w/2>180 THEN 180 ELSE x+w/2 END,180),6) AS east,
 round(CASE WHEN y-h/2 < -90 THEN -90 WHEN y+h/2>90 THEN 90-h ELSE y-h/2 END,6) AS south, round(CASE WHEN y-h/2 < -90 THEN -90+h WHEN y+h/2>90 THEN 90 ELSE y+h/2 END,6) AS north FROM s""")
def panned_views(spark, d):
    """map views moved, and held at the world's edges."""
    out = geo.pan(geo.box(), F.col("cloud") * 400, F.col("cloud") * -200)
    return V.scenes(spark, d).select("item_id", *(F.round(c, 6).alias(n) for c, n in zip(out, geo.SIDES, strict=True)))


@query("""WITH s AS (SELECT item_id, (west+east)/2 AS x, (south+north)/2 AS y, (east-west)*k AS w, (north-south)*k AS h FROM v_scenes CROSS JOIN LATERAL (SELECT CASE WHEN item_id%2=0 THEN 0.25 ELSE 4.0 END AS k) f)
SELECT item_id, round(x-w/2,6) AS west, round(x+w/2,6) AS east, round(y-h/2,6) AS south, round(y+h/2,6) AS north FROM s""")
def zoomed_views(spark, d):
    """map views zoomed in and out by four."""
    out = geo.zoom(geo.box(), F.lit(4.0), F.col("item_id") % 2 == 0)
    return V.scenes(spark, d).select("item_id", *(F.round(c, 6).alias(n) for c, n in zip(out, geo.SIDES, strict=True)))


@query("""SELECT item_id, CAST(floor((west-0.0)/0.03) AS BIGINT) AS col, CAST(floor((north-4.0)/-0.03) AS BIGINT) AS row, CAST(ceil((east-0.0)/0.03) AS BIGINT) AS "right", CAST(ceil((south-4.0)/-0.03) AS BIGINT) AS bottom FROM v_scenes""")
def aoi_windows(spark, d):
    """pixel windows of areas, outward."""
    out = geo.window(geo.box(), F.lit(0.03), F.lit(0.0), F.lit(-0.03), F.lit(4.0))
    return V.scenes(spark, d).select("item_id", *(c.alias(n) for c, n in zip(out, ("col", "row", "right", "bottom"), strict=True)))


@query("""SELECT item_id, CAST(floor((west-0.0)/0.03) AS BIGINT) AS col, CAST(floor((north-4.0)/-0.03) AS BIGINT) AS row, CAST(ceil((east-0.0)/0.03-(west-0.0)/0.03) AS BIGINT) AS width, CAST(ceil((south-4.0)/-0.03-(north-4.0)/-0.03) AS BIGINT) AS height FROM v_scenes""")
def rounded_windows(spark, d):
    """pixel windows with offsets and lengths rounded by themselves."""
    out = geo.rounded_window(geo.box(), F.lit(0.03), F.lit(0.0), F.lit(-0.03), F.lit(4.0))
    return V.scenes(spark, d).select("item_id", *(c.alias(n) for c, n in zip(out, ("col", "row", "width", "height"), strict=True)))


@query()
def utm_boxes(spark, d):
    """WGS84 bounds of UTM boxes (no SQL: tests hold it against published values)."""
    k = F.col("item_id")
    x, y = 300_000.0 + F.col("west") * 100_000, 3_000_000.0 + F.col("south") * 500_000
    rows = V.scenes(spark, d).select("item_id", x.alias("x"), y.alias("y"), (k % 60 + 1).cast("double").alias("zone"))
    out = geo.utm_bounds(rows, [F.col("x"), F.col("y"), F.col("x") + 10_000, F.col("y") + 10_000], F.col("zone"), F.lit(True))
    return out.select("item_id", *(F.round(n, 7).alias(n) for n in geo.SIDES))


@query("""WITH s AS (SELECT s_suppkey AS source_ref, sha256(s_name) AS sha, s_nationkey AS n FROM supplier), e AS (SELECT c_custkey AS evidence_id, c_custkey%120+1 AS source_ref, c_custkey%4 AS k, c_nationkey AS n FROM customer)
SELECT evidence_id, CASE WHEN sha IS NULL THEN 'missing_source' WHEN k=1 THEN 'hash_mismatch' WHEN e.n>20 THEN 'unknown_bands' WHEN e.n>s.n THEN 'outside_extent' WHEN k=2 THEN 'outside_time' END AS code FROM e LEFT JOIN s USING (source_ref)""")
def evidence_checks(spark, d):
    """The first rule that a piece of evidence breaks."""
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    n = F.col("s_nationkey").cast("double")
    sources = V.read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("source_ref"), F.sha2("s_name", 256).alias("sha256"), F.lit(0.0).alias("s_west"), F.lit(0.0).alias("s_south"), n.alias("s_east"), n.alias("s_north"),
        t("2024-01-01").alias("s_start"), t("2024-12-31").alias("s_end"), F.array(F.lit("red"), F.lit("nir")).alias("s_bands"),
    )
    k, e = F.col("c_custkey"), F.col("c_nationkey").cast("double")
    named = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_ref"), F.sha2("s_name", 256).alias("named"))
    evidence = V.read(spark, d, "customer").withColumn("source_ref", k % 120 + 1).join(named, "source_ref", "left")
    evidence = evidence.select(
        k.alias("evidence_id"), "source_ref", F.when(k % 4 == 1, "other").otherwise(F.col("named")).alias("frozen_sha256"), F.lit(0.0).alias("e_west"), F.lit(0.0).alias("e_south"), e.alias("e_east"), e.alias("e_north"),
        t("2024-02-01").alias("e_start"), F.when(k % 4 == 2, t("2025-02-01")).otherwise(t("2024-03-01")).alias("e_end"), F.when(e > 20, F.array(F.lit("swir"))).otherwise(F.array(F.lit("red"))).alias("e_bands"),
    )
    return K.check_evidence(evidence, sources)


@query("""SELECT o_orderkey AS item_id, concat_ws(',', CASE WHEN o_orderstatus='P' THEN 'identity' END, CASE WHEN NOT o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' THEN 'time' END, CASE WHEN o_custkey%100>40 THEN 'cloud' END,
 CASE WHEN o_custkey%20>10 THEN 'extent' END, CASE WHEN 32590+o_custkey%80 NOT BETWEEN 32601 AND 32660 THEN 'crs' END, CASE WHEN o_custkey%9=0 THEN 'asset:red' END) AS violations FROM orders""")
def stac_admission(spark, d):
    """Rules that a catalog item, as JSON text, breaks."""
    k = F.col("o_custkey")
    item = F.struct(
        F.lit("Feature").alias("type"), F.when(F.col("o_orderstatus") == "P", "other").otherwise("scenes").alias("collection"), F.col("o_orderkey").cast("string").alias("id"),
        F.array((k % 20).cast("double"), F.lit(0.0), F.lit(30.0), F.lit(30.0)).alias("bbox"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), (k % 100).cast("double").alias("eo:cloud_cover"), (32590 + k % 80).cast("int").alias("proj:epsg")).alias("properties"),
        F.create_map(F.lit("red"), F.struct(F.lit("x").alias("href"), F.when(k % 9 == 0, "text/html").otherwise("image/tiff; application=geotiff").alias("type"), F.array(F.lit("data"), F.lit("reflectance")).alias("roles"), F.array(F.lit(100), F.lit(200)).alias("proj:shape"))).alias("assets"),
    )
    items = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.to_json(item).alias("item"))
    out = K.stac_violations(items, collection="scenes", box=(10.0, 5.0, 20.0, 15.0), start="1996-01-01", end="1998-12-31", max_cloud=40.0, bands=["red"])
    return out.select("item_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT event_id, CASE WHEN value=floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE 'fraction' END AS printed FROM events")
def json_numbers(spark, d):
    """whole floats print as integers."""
    v = hashing.json_number(F.col("value"))
    return V.read(spark, d, "events").select("event_id", F.when(v.contains("."), "fraction").otherwise(v).alias("printed"))


@query("""WITH e AS (SELECT c_custkey AS evidence_id, c_custkey AS k, c_custkey%13 AS m, c_custkey%4 AS kind, c_nationkey AS n FROM customer)
SELECT evidence_id, CASE WHEN k%17=0 THEN 'missing_source' WHEN k%19=0 THEN 'hash_mismatch' WHEN k%5=0 AND kind=3 THEN 'source_not_georeferenced' WHEN m<6 AND kind=2 THEN 'no_source_dimensions' WHEN m<6 AND (m*40+50>200 OR n*5+30>100) THEN 'outside_window'
 WHEN n>18 AND kind=0 THEN 'unknown_bands' WHEN kind=1 THEN 'unnamed_bands' WHEN kind=3 OR n>20 THEN 'outside_extent' WHEN k%7=0 THEN 'no_source_time' WHEN k%11=0 THEN 'outside_time' END AS code FROM e""")
def pixel_evidence_checks(spark, d):
    """Geometry, pixel windows and bands by kind of source, in their order."""
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    place = lambda x: F.when(k % 4 != 3, x).cast("double")
    rows = V.read(spark, d, "customer")
    sources = rows.where(k % 17 != 0).select(
        k.alias("source_ref"), F.sha2("c_name", 256).alias("sha256"), place(F.lit(0)).alias("s_west"), place(F.lit(0)).alias("s_south"), place(F.lit(20)).alias("s_east"), place(F.lit(20)).alias("s_north"),
        F.when(k % 7 != 0, t("2024-01-01")).alias("s_start"), F.when(k % 7 != 0, t("2024-12-31")).alias("s_end"), F.when(k % 4 == 0, F.array(F.lit("red"), F.lit("nir"))).alias("s_bands"),
        F.when(k % 4 == 0, "pixel_asset").when(k % 4 == 1, "pixel_artifact").otherwise("scene").alias("s_kind"), F.when(k % 4 != 2, 200).alias("s_width"), F.when(k % 4 != 2, 100).alias("s_height"),
    )
    evidence = rows.select(
        k.alias("evidence_id"), k.alias("source_ref"), F.when(k % 19 == 0, "other").otherwise(F.sha2("c_name", 256)).alias("frozen_sha256"), F.when(k % 5 == 0, "ring").alias("e_geometry"),
        F.when(k % 13 < 6, F.array(k % 13 * 40, (n * 5).cast("long"), F.lit(50).cast("long"), F.lit(30).cast("long"))).alias("e_window"), F.when(n > 18, F.array(F.lit("swir"))).otherwise(F.array(F.lit("red"))).alias("e_bands"),
        F.lit(0.0).alias("e_west"), F.lit(0.0).alias("e_south"), n.cast("double").alias("e_east"), n.cast("double").alias("e_north"), t("2024-02-01").alias("e_start"), F.when(k % 11 == 0, t("2025-02-01")).otherwise(t("2024-03-01")).alias("e_end"),
    )
    return K.check_evidence(evidence, sources)


@query("""SELECT o_orderkey AS item_id, CASE WHEN o_orderkey%23=0 THEN 'snapshot_mismatch' WHEN o_custkey%11=0 THEN 'missing_asset' WHEN o_custkey%7=0 OR o_orderstatus='P' THEN 'asset_identity' WHEN o_custkey%5=0 OR o_orderkey%13=0 THEN 'grid' WHEN o_orderkey%8=0 OR o_custkey%9=0 THEN 'radiometry' END AS code FROM orders""")
def swir_admission(spark, d):
    """Identity, grid and radiometry of the short-wave band of pinned items."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asset = F.struct(
        F.concat(F.lit("https://store.example/"), F.when(c % 7 == 0, "other").otherwise(k.cast("string")), F.lit("/B11.tif")).alias("href"), F.when(F.col("o_orderstatus") == "P", "text/html").otherwise("image/tiff; application=geotiff").alias("type"), F.array(F.lit("data"), F.lit("reflectance")).alias("roles"),
        F.when(c % 5 == 0, F.array(F.lit(100))).otherwise(F.array(F.lit(100), F.lit(200))).alias("proj:shape"), F.array(F.when(k % 13 == 0, 10.0).otherwise(20.0), F.lit(0.0), F.lit(600000.0), F.lit(0.0), F.lit(-20.0), F.lit(5.0e6)).alias("proj:transform"),
        F.array(F.struct(F.lit("uint16").alias("data_type"), F.lit(0).alias("nodata"), F.when(k % 8 == 0, 0.001).otherwise(0.0001).alias("scale"), F.lit(-0.1).alias("offset"), F.lit(20).alias("spatial_resolution"))).alias("raster:bands"),
        F.array(F.struct(F.lit("swir16").alias("name"), F.when(c % 9 == 0, "swir22").otherwise("swir16").alias("common_name"))).alias("eo:bands"),
    )
    item = F.to_json(F.struct(k.cast("string").alias("id"), F.create_map(F.when(c % 11 == 0, "red").otherwise("swir16"), asset).alias("assets")))
    items = V.read(spark, d, "orders").select(k.alias("item_id"), item.alias("item"))
    items = items.withColumn("pinned_sha256", F.when(F.col("item_id") % 23 == 0, "another").otherwise(F.sha2("item", 256)))
    return K.swir16_codes(items, host="https://store.example/").select("item_id", "code")
