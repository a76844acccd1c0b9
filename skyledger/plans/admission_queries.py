"""Queries over listings: coverage, duplicates, samples, inventories, storage, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..operators import admission as A
from ..sources import readers
from . import views as V
from .registry import query

PATH_CODE = """CASE WHEN path='' OR path IS NULL OR length(path)>4096 THEN 'invalid_image_path' WHEN contains(path,chr(92)) OR contains(path,'://') THEN 'external_image_reference_not_allowed'
 WHEN starts_with(path,'/') OR regexp_matches(path,'^[A-Za-z]:') THEN 'external_image_reference_not_allowed' WHEN len(list_intersect(string_split(path,'/'),['','.','..']))>0 THEN 'image_path_not_normalized' END"""
UNDER = "(starts_with(path,'train/images/') OR starts_with(path,'val/images/'))"
FILES = "f AS (SELECT concat('train/images/',p_partkey,'.png') AS path, p_size*200 AS width, CAST(p_retailprice AS BIGINT)*3 AS height, CAST(p_retailprice*100000 AS BIGINT) AS bytes FROM part UNION ALL SELECT concat('val/images/',k,'.tif'), 1000, 1000, 1000000 FROM (VALUES (0),(1),(2)) t(k))"
CATEGORY = """CASE WHEN path LIKE '%.sqlite3-wal' THEN 'sqlite_wal' WHEN path LIKE '%.sqlite3' THEN 'sqlite_main' WHEN path LIKE '%.log' THEN 'logs' WHEN path LIKE '%.pt' THEN 'checkpoints' ELSE 'uncategorized' END"""
COVER = f"""WITH p AS (SELECT page_id, path, {PATH_CODE} AS c0 FROM v_paths), q AS (SELECT *, coalesce(c0, CASE WHEN NOT {UNDER} THEN 'outside_reviewed_prefix' END) AS failure, row_number() OVER (PARTITION BY path ORDER BY page_id) AS copy FROM p), {FILES},
o AS (SELECT page_id, q.path, CASE WHEN failure IS NOT NULL THEN failure WHEN copy>1 THEN 'duplicate' WHEN bytes IS NULL THEN 'missing_file' WHEN bytes>134217728 THEN 'oversize' WHEN width*height>20000000 THEN 'window' ELSE 'whole' END AS outcome,
 CASE WHEN failure IS NOT NULL THEN 'failure' WHEN copy>1 THEN 'duplicate' WHEN bytes IS NULL THEN 'failure' ELSE 'admitted' END AS kind FROM q LEFT JOIN f ON q.path=f.path)"""


@query(f"SELECT page_id, {PATH_CODE} AS code, {UNDER} AS reviewed FROM v_paths")
def path_checks(spark, d):
    """Path codes and component-wise prefixes."""
    return V.paths(spark, d).select("page_id", paths.path_code(F.col("path")).alias("code"), paths.under(F.col("path"), ["train/images", "val/images"]).alias("reviewed"))


def coverage(spark, d):
    """Outcomes of page paths against files made of parts."""
    # DuckDB's cast rounds halves to even numbers, as rint does; its concat leaves nulls out, as concat_ws does.
    part = V.read(spark, d, "part").select(F.concat_ws("", F.lit("train/images/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), (F.col("p_size") * 200).alias("width"), (F.rint("p_retailprice").cast("long") * 3).alias("height"), F.rint(F.col("p_retailprice") * 100000).cast("long").alias("bytes"))
    val = spark.range(3).select(F.concat(F.lit("val/images/"), F.col("id").cast("string"), F.lit(".tif")).alias("path"), F.lit(1000).alias("width"), F.lit(1000).cast("long").alias("height"), F.lit(1_000_000).cast("long").alias("bytes"))
    return A.path_coverage(V.paths(spark, d), part.unionByName(val), ["train/images", "val/images"])


@query(f"{COVER} SELECT page_id, path, outcome, kind FROM o")
def path_outcomes(spark, d):
    """What becomes of each path."""
    return coverage(spark, d)


@query(f'{COVER} SELECT kind, outcome, count(*) AS "rows", count(DISTINCT sha256(path)) AS distinct_paths FROM o GROUP BY GROUPING SETS ((kind,outcome),(kind),())')
def path_coverage(spark, d):
    """Accounting by grouping sets; kinds add up to all rows."""
    return A.coverage_report(coverage(spark, d))


@query(f"""{COVER}, x AS (SELECT *, CASE WHEN kind<>'admitted' THEN NULL WHEN ends_with(path,'.png') THEN 'PNG' ELSE 'GTiff' END AS driver, CASE WHEN kind<>'admitted' THEN NULL WHEN starts_with(path,'train/') THEN 'image' ELSE 'geotransform' END AS reference FROM o)
SELECT 'all' AS map, 'rows' AS name, count(*) AS "rows" FROM x UNION ALL SELECT CASE kind WHEN 'failure' THEN 'failures' WHEN 'duplicate' THEN 'duplicates' ELSE 'outcomes' END, outcome, count(*) FROM x GROUP BY 1,2
UNION ALL SELECT 'driver', driver, count(*) FROM x WHERE driver IS NOT NULL GROUP BY 2 UNION ALL SELECT 'reference', reference, count(*) FROM x WHERE reference IS NOT NULL GROUP BY 2""")
def coverage_maps(spark, d):
    """The ordered maps of a coverage report, by outcome, failure, driver and reference."""
    rows = coverage(spark, d).withColumns({"driver": F.when(F.col("path").endswith(".png"), "PNG").otherwise("GTiff"), "reference": F.when(F.col("path").startswith("train/"), "image").otherwise("geotransform")})
    return A.coverage_maps(rows, "driver", "reference")


@query(f"""WITH e AS (SELECT *, {CATEGORY} AS category, CASE WHEN inode%7=0 THEN 'symlink' WHEN inode%50=1 THEN 'error' WHEN inode%9=0 THEN 'directory' ELSE 'file' END AS entry FROM v_files), w AS (SELECT *, entry='file' AND path=min(path) FILTER (WHERE entry='file') OVER (PARTITION BY inode) AS once FROM e)
SELECT CASE WHEN g=0 THEN category END AS category, count(*) FILTER (WHERE entry='file') AS files, count(*) FILTER (WHERE entry='file' AND NOT once) AS aliases, sum(CASE WHEN once THEN blocks*512 ELSE 0 END)::BIGINT AS allocated_bytes, count(*) FILTER (WHERE entry='symlink') AS symlinks,
 count(*) FILTER (WHERE entry='error') AS errors, count(*) FILTER (WHERE entry='error')=0 AS complete FROM w, (VALUES (0),(1)) t(g) WHERE g=1 OR entry='file' GROUP BY CASE WHEN g=0 THEN category END, g""")
def usage_report(spark, d):
    """Bytes by category with links counted and not followed, and whether all could be read."""
    i = F.col("inode")
    kind = F.when(i % 7 == 0, "symlink").when(i % 50 == 1, "error").when(i % 9 == 0, "directory").otherwise("file")
    return A.usage_report(V.files(spark, d).withColumn("kind", kind), root_device=1)


@query("""SELECT page_id, CASE page_id%3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' END AS kind, CASE WHEN page_id%3<2 THEN page_id%300+1 END AS width, CASE WHEN page_id%3<2 THEN 7 END AS height, CASE page_id%3 WHEN 0 THEN CASE page_id%5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 4 END WHEN 1 THEN CASE WHEN page_id%2=0 THEN 1 ELSE 3 END END AS channels FROM pages""")
def image_channels(spark, d):
    """sizes and channels of PNG and JPEG headers, with other segments before the frame."""
    p = F.col("page_id")
    number = lambda n, digits: F.unhex(F.lpad(F.hex(n), digits, "0"))
    colour = F.element_at(F.array(*map(F.lit, ("00", "02", "03", "04", "06"))), (p % 5 + 1).cast("int"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), number(p % 300 + 1, 8), number(F.lit(7), 8), F.unhex(F.lit("08")), F.unhex(colour), F.unhex(F.lit("000000")))
    before = F.when(p % 4 == 1, "FFE100080102030405FF").when(p % 4 == 2, "FFFFDB00040101FFC4000401AA").otherwise("")
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE000104A46494600010100000100010000")), F.unhex(before), F.unhex(F.lit("FFC0000B08")), number(F.lit(7), 4), number(p % 300 + 1, 4), F.unhex(F.when(p % 2 == 0, "01").otherwise("03")), F.unhex(F.lit("01110000")))
    head = F.when(p % 3 == 0, png).when(p % 3 == 1, jpeg).otherwise(F.unhex(F.lit("00010203")))
    return A.image_channels(V.read(spark, d, "pages").select("page_id", head.alias("content")), "page_id")


@query("SELECT asset_id, dataset_id, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS copy FROM v_assets")
def first_distinct_assets(spark, d):
    """Copies by content, the first wins."""
    return A.first_distinct(V.assets(spark, d), "sha256", ["doc_id"]).select("asset_id", "dataset_id", "sha256", "copy")


@query("SELECT dataset_id, count(*) AS assets, count(DISTINCT sha256) AS distinct_contents FROM v_assets GROUP BY 1")
def distinct_contents(spark, d):
    """Distinct contents of each dataset."""
    return V.assets(spark, d).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("assets"), F.count_distinct("sha256").alias("distinct_contents"))


@query("SELECT sha256, count(*) AS copies FROM v_assets GROUP BY 1 HAVING count(*)>1")
def duplicate_contents(spark, d):
    """Contents that are not unique."""
    return V.assets(spark, d).groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("SELECT dataset_id, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY sha256(concat('42',asset_id))) AS n FROM v_assets) WHERE n<=5")
def seeded_sample(spark, d):
    """Five assets of each dataset by seeded hash; the sample is the feature."""
    return A.seeded_sample(V.assets(spark, d), "dataset_id", 5, "42").select("dataset_id", "asset_id")


@query("""WITH f AS (SELECT dataset_id, lower(concat(relative_path,CASE doc_id%5 WHEN 0 THEN '.zip' WHEN 1 THEN '.png' WHEN 2 THEN '.TIF' WHEN 3 THEN '.jpg' ELSE '.txt' END)) AS p, size_bytes FROM v_assets), g AS (SELECT *, regexp_matches(p,'\\.(tif|tiff|jpg|jpeg|png|jp2|bmp|webp)$') AS image, regexp_matches(p,'(^|[^a-z0-9])labels([^a-z0-9]|$)') AS label FROM f),
s AS (SELECT dataset_id, count(*) FILTER (WHERE image AND NOT label) AS candidate_images, count(*) FILTER (WHERE image AND label) AS label_like_images, coalesce(sum(size_bytes) FILTER (WHERE image),0)::BIGINT AS bytes, count(*) FILTER (WHERE p LIKE '%.zip') AS archives, 0::BIGINT AS failure_markers FROM g GROUP BY 1)
SELECT *, CASE WHEN candidate_images>0 THEN 'available' ELSE 'unavailable' END AS status FROM s""")
def dataset_inventory(spark, d):
    """Images, labels, bytes and archives of each dataset."""
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, ".zip").when(k == 1, ".png").when(k == 2, ".TIF").when(k == 3, ".jpg").otherwise(".txt")
    return A.inventory(V.assets(spark, d).withColumn("relative_path", F.concat("relative_path", tail)))


@query("""SELECT dataset_id, asset_id, running_bytes FROM (SELECT dataset_id, asset_id, (sum(size_bytes) OVER (PARTITION BY dataset_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running_bytes FROM v_assets) WHERE running_bytes<=20000""")
def running_byte_cap(spark, d):
    """The prefix of each dataset that fits a byte cap."""
    return A.running_cap(V.assets(spark, d), "dataset_id", ["doc_id"], "size_bytes", 20_000).select("dataset_id", "asset_id", "running_bytes")


@query()
def greedy_byte_cap(spark, d):
    """W08, the skipping form: items that no longer fit are passed over (tests hold it against a loop)."""
    return A.greedy_cap(V.assets(spark, d), "dataset_id", ["doc_id"], "size_bytes", 20_000).select("dataset_id", "asset_id", "size_bytes")


@query(f"SELECT path, {CATEGORY} AS category, greatest(size_bytes, blocks*512) AS charge FROM v_files")
def file_categories(spark, d):
    """category and charge of each file."""
    return V.files(spark, d).select("path", paths.category(F.col("path")).alias("category"), hashing.charge(F.col("size_bytes"), F.col("blocks")).alias("charge"))


@query(f"""WITH w AS (SELECT *, {CATEGORY} AS category, row_number() OVER (PARTITION BY dev,inode ORDER BY path) AS k FROM v_files)
SELECT category, count(*) AS files, count(*) FILTER (WHERE k>1) AS aliases, sum(CASE WHEN k=1 THEN blocks*512 ELSE 0 END)::BIGINT AS allocated_bytes FROM w GROUP BY 1""")
def physical_usage(spark, d):
    """Bytes by category, shared inodes once."""
    return A.physical_usage(V.files(spark, d))


@query("""WITH s AS (SELECT scope, sum(capacity)::BIGINT AS capacity FROM v_reservations GROUP BY 1), u AS (SELECT scope, sum(greatest(size_bytes,blocks*512))::BIGINT AS charged, count(*) AS files FROM s JOIN v_files f ON f.path=s.scope OR starts_with(f.path, concat(s.scope,'/')) GROUP BY 1)
SELECT scope, capacity, coalesce(charged,0) AS charged, coalesce(files,0) AS files, greatest(0, capacity-coalesce(charged,0)) AS headroom FROM s LEFT JOIN u USING (scope)""")
def scope_usage(spark, d):
    """Use and headroom of reserved scopes."""
    return A.scope_usage(V.files(spark, d), V.reservations(spark, d))


@query("""WITH s AS (SELECT scope, sum(capacity)::BIGINT AS capacity FROM v_reservations GROUP BY 1), u AS (SELECT scope, sum(greatest(size_bytes,blocks*512))::BIGINT AS charged FROM s JOIN v_files f ON f.path=s.scope OR starts_with(f.path, concat(s.scope,'/')) GROUP BY 1),
h AS (SELECT count(*) AS scopes, sum(greatest(0,capacity-coalesce(charged,0)))::BIGINT AS reserved FROM s LEFT JOIN u USING (scope)), t AS (SELECT sum(greatest(size_bytes,blocks*512))::BIGINT AS data FROM v_files)
SELECT data, scopes, reserved, data+reserved AS charged, greatest(0,10000000000-data-reserved) AS available FROM t, h""")
def quota_status(spark, d):
    """Totals of a quota of ten gigabytes."""
    files = V.files(spark, d)
    return A.quota_status(A.scope_usage(files, V.reservations(spark, d)), files, total=10_000_000_000)


@query("WITH s AS (SELECT scope FROM v_reservations UNION SELECT concat('s',(reservation_id+1)%8) FROM v_reservations) SELECT o.scope AS outer_scope, i.scope AS inner_scope FROM s o JOIN s i ON starts_with(i.scope, concat(o.scope,'/'))")
def overlapping_scopes(spark, d):
    """Scopes within scopes."""
    rows = V.reservations(spark, d)
    return A.overlapping_scopes(rows.select("scope").union(rows.select(F.concat(F.lit("s"), ((F.col("reservation_id") + 1) % 8).cast("string")))))


@query("""SELECT path, concat_ws('; ', CASE WHEN path LIKE '%.log' OR path LIKE '%.sqlite3' OR path LIKE '%.pt' OR path LIKE '%.bin' THEN 'data_format' END, CASE WHEN size_bytes*20>2097152 THEN 'too_large' END,
 CASE WHEN inode%10=0 THEN 'not_a_plain_file' END) AS errors FROM v_files""")
def payload_policy(spark, d):
    """P20: reasons against files of a source tree."""
    errors = paths.payload_errors(F.col("path"), F.col("size_bytes") * 20, F.when(F.col("inode") % 10 == 0, "120000").otherwise("100644"))
    return V.files(spark, d).select("path", F.array_join(errors, "; ").alias("errors"))


@query("""SELECT concat('part-',p_partkey) AS path, CASE WHEN p_partkey%10=1 THEN 'missing_member' WHEN p_partkey%10=2 THEN 'duplicate_member' WHEN p_partkey%10=3 THEN 'size_mismatch' WHEN p_partkey%10=4 THEN 'hash_mismatch' END AS code FROM part WHERE p_partkey%10 BETWEEN 1 AND 4
UNION ALL SELECT concat('extra-',s_suppkey), 'unexpected_member' FROM supplier""")
def member_checks(spark, d):
    """Members of an archive against its manifest."""
    k = F.col("p_partkey")
    part = V.read(spark, d, "part").select(F.concat(F.lit("part-"), k.cast("string")).alias("path"), F.sha2("p_name", 256).alias("sha256"), F.col("p_size").cast("long").alias("size_bytes"), k)
    bad = part.withColumns({"size_bytes": F.when(k % 10 == 3, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")), "sha256": F.when(k % 10 == 4, "other").otherwise(F.col("sha256"))}).where(k % 10 != 1)
    twice = bad.where(k % 10 == 2)
    extra = V.read(spark, d, "supplier").select(F.concat(F.lit("extra-"), F.col("s_suppkey").cast("string")).alias("path"), F.sha2("s_name", 256).alias("sha256"), F.lit(1).cast("long").alias("size_bytes"))
    members = bad.drop("p_partkey").unionByName(twice.drop("p_partkey")).unionByName(extra)
    return A.member_check(members, part.drop("p_partkey"))


@query("SELECT l_orderkey AS episode_id, l_partkey%3 AS artifact_id, count(DISTINCT l_shipmode_) AS versions FROM (SELECT *, sha256(l_returnflag) AS l_shipmode_ FROM lineitem) GROUP BY 1,2 HAVING count(DISTINCT l_shipmode_)>1")
def artifact_conflicts(spark, d):
    """One key registered with different contents."""
    rows = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), (F.col("l_partkey") % 3).alias("artifact_id"), F.sha2("l_returnflag", 256).alias("content"))
    return A.register_conflicts(rows, ["episode_id", "artifact_id"], "content")


@query("""WITH a AS (SELECT sha256(concat(source,'|',doc_id%97)) AS k, doc_id FROM documents), n AS (SELECT k, count(*) AS m FROM (SELECT sha256(concat('src',c_custkey%25,'|',c_custkey%97)) AS k FROM customer) GROUP BY 1)
SELECT doc_id, coalesce(m,0) AS matches, coalesce(m,0)=1 AS unique_match FROM a LEFT JOIN n USING (k)""")
def unique_matches(spark, d):
    """Records that match exactly once by hash."""
    left = V.read(spark, d, "documents").select(F.sha2(F.concat("source", F.lit("|"), (F.col("doc_id") % 97).cast("string")), 256).alias("k"), "doc_id")
    c = F.col("c_custkey")
    right = V.read(spark, d, "customer").select(F.sha2(F.concat(F.lit("src"), (c % 25).cast("string"), F.lit("|"), (c % 97).cast("string")), 256).alias("k"))
    return A.match_unique(left, right, "k").select("doc_id", "matches", "unique_match")


LINEAGE = "e AS (SELECT p_partkey AS child, p_partkey//3 AS parent FROM part WHERE p_partkey//3>0 UNION SELECT p_partkey, p_partkey//5 FROM part WHERE p_partkey//5>0)"


@query(f"WITH RECURSIVE {LINEAGE}, up AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT up.child, e.parent, up.depth+1 FROM up JOIN e ON e.child=up.ancestor) SELECT child, ancestor, min(depth)::BIGINT AS depth FROM up GROUP BY 1,2")
def lineage_closure(spark, d):
    """Ancestors over many hops."""
    part = V.read(spark, d, "part")
    edge = lambda n: part.select(F.col("p_partkey").alias("child"), F.expr(f"p_partkey div {n}").alias("parent")).where("parent > 0")
    return A.lineage_closure(edge(3).union(edge(5)).distinct())


@query(f"WITH RECURSIVE {LINEAGE}, up AS (SELECT child, parent AS root FROM e UNION SELECT up.child, e.parent FROM up JOIN e ON e.child=up.root) SELECT child AS node, root, false AS is_root FROM up WHERE root NOT IN (SELECT child FROM e) UNION SELECT parent, parent, true FROM e WHERE parent NOT IN (SELECT child FROM e)")
def lineage_roots(spark, d):
    """The inputs that each artifact comes from, by pointer doubling."""
    part = V.read(spark, d, "part")
    edge = lambda n: part.select(F.col("p_partkey").alias("child"), F.expr(f"p_partkey div {n}").alias("parent")).where("parent > 0")
    return A.lineage_roots(edge(3).union(edge(5)).distinct())


@query("SELECT source AS dataset_id, list_sort(list(doc_id)) AS assets FROM documents GROUP BY 1")
def asset_manifest(spark, d):
    """Each dataset's assets as a sorted list."""
    return V.read(spark, d, "documents").groupBy(F.col("source").alias("dataset_id")).agg(F.sort_array(F.collect_list("doc_id")).alias("assets"))


@query("SELECT asset_id, doc_id, sha256(concat(dataset_id,chr(0),relative_path,chr(0),coalesce(size_bytes::VARCHAR,'\\N'))) AS derivation_id FROM v_assets")
def stable_ids(spark, d):
    """Ids that follow from content."""
    return V.assets(spark, d).select("asset_id", "doc_id", hashing.digest(F.col("dataset_id"), F.col("relative_path"), F.col("size_bytes")).alias("derivation_id"))


@query("""SELECT page_id, CASE page_id%4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'tiff' END AS kind, CASE WHEN page_id%4=0 THEN CAST(page_id%300+1 AS INT) END AS width, CASE WHEN page_id%4=0 THEN 7 END AS height FROM pages""")
def image_headers(spark, d):
    """kind and size of images by their first bytes."""
    p = F.col("page_id")
    number = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), number(p % 300 + 1), number(F.lit(7)), F.unhex(F.lit("0802000000")))
    head = F.when(p % 4 == 0, png).when(p % 4 == 1, F.unhex(F.lit("FFD8FFE000104A4649460001"))).when(p % 4 == 2, F.unhex(F.lit("49492A0008000000"))).otherwise(F.unhex(F.lit("47494638")))
    return A.image_sizes(V.read(spark, d, "pages").select("page_id", head.alias("content")), "page_id")


@query("""SELECT vec_id, i.position, CASE WHEN vec_id%5=0 THEN NULL WHEN (vec_id+i.position)%3=0 THEN NULL ELSE 'png' END AS kind, CASE WHEN vec_id%5=0 THEN 'no_image' WHEN (vec_id+i.position)%3=0 THEN 'external_image_reference_not_allowed' END AS code
FROM embeddings CROSS JOIN (VALUES (0),(1)) i(position) WHERE vec_id%5<>0 OR i.position=0""")
def embedded_images(spark, d):
    """images nested in rows, with a code for each that is refused."""
    k = F.col("vec_id")
    one = lambda i: F.struct(F.when((k + i) % 3 != 0, F.unhex(F.lit("89504E470D0A1A0A"))).alias("bytes"), F.lit("a.png").alias("path"))
    rows = V.read(spark, d, "embeddings").select("vec_id", F.when(k % 5 != 0, F.array(one(0), one(1))).alias("images"))
    return A.embedded_images(rows, "images", "vec_id").select("vec_id", F.coalesce("position", F.lit(0)).alias("position"), "kind", "code")


@query("""WITH k AS (SELECT vec_id, vec_id%13 AS k FROM embeddings) SELECT vec_id, CASE WHEN k=4 THEN 'image_nesting_limit' WHEN k IN (7,8) THEN 'image_sequence_limit' WHEN k=5 THEN 'external_image_reference_not_allowed' WHEN k IN (6,10) THEN 'missing_embedded_image' WHEN k=9 THEN 'image_size_limit' END AS code,
CASE WHEN k IN (0,2,3) THEN 1 WHEN k=1 THEN 2 WHEN k=12 THEN 16 ELSE 0 END AS images, CASE WHEN k IN (0,1,2,3,12) THEN 'png' END AS kind FROM k""")
def nested_images(spark, d):
    """images nested up to four deep in lists and objects, and the first failure of each row."""
    k = F.col("vec_id") % 13
    image = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.col("vec_id").cast("string").cast("binary"))
    variant, nest = lambda c: c.cast("variant"), F.to_variant_object
    held = F.struct(image.alias("bytes"), F.lit("a.png").alias("path"))
    many = lambda n, c: F.array_repeat(c, n)
    shapes = [variant(image), nest(many(2, image)), nest(F.array(held)), nest(F.array(F.array(held))), nest(F.array(F.array(F.array(held)))), nest(F.struct(F.lit(None).cast("binary").alias("bytes"), F.lit("a.png").alias("path"))), variant(F.lit(b"")), nest(many(17, image)), nest(many(2, many(9, image))), nest(F.array(image, F.rpad(image, 99, b"x"))), nest(F.array(F.lit("text"))), nest(F.array().cast("array<binary>")), nest(many(2, many(8, held)))]
    value = reduce(lambda rest, i: rest.when(k == i, shapes[i]), range(1, 13), F.when(k == 0, shapes[0]))
    rows = V.read(spark, d, "embeddings").select("vec_id", value.alias("images"))
    found = A.nested_images(rows, "images", "vec_id", most_bytes=64)
    return found.select("vec_id", "code", F.size("images").alias("images"), F.get("images", 0)["kind"].alias("kind"))


@query("SELECT DISTINCT source AS dataset_id FROM documents WHERE source NOT IN (SELECT concat('src', c_nationkey%15) FROM customer)")
def set_difference(spark, d):
    """Expected names that are absent."""
    have = V.read(spark, d, "documents").select(F.col("source").alias("dataset_id"))
    return have.subtract(V.read(spark, d, "customer").select(F.concat(F.lit("src"), (F.col("c_nationkey") % 15).cast("string"))))


@query("SELECT DISTINCT lang AS name FROM documents UNION SELECT DISTINCT source FROM documents")
def set_union(spark, d):
    """Distinct union of names."""
    docs = V.read(spark, d, "documents")
    return docs.select(F.col("lang").alias("name")).union(docs.select("source")).distinct()


@query("SELECT DISTINCT c_nationkey AS nation FROM customer INTERSECT SELECT DISTINCT s_nationkey FROM supplier")
def set_intersection(spark, d):
    """What both sides have."""
    return V.read(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(V.read(spark, d, "supplier").select("s_nationkey"))


@query("SELECT url FROM pages")
def projected_column(spark, d):
    """One guarded column of a table; the plan reads no other."""
    return readers.parquet_column(spark, f"{d}/pages.parquet", "url")


@query("SELECT l_orderkey AS episode_id, l_partkey AS artifact_id, l_linenumber AS line FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey=l_orderkey AND o_custkey%2=0 AND l_partkey%3=0)")
def associated_artifacts(spark, d):
    """Artifacts of an episode, by exact association."""
    lines = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("artifact_id"), F.col("l_linenumber").alias("line"))
    even = V.read(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("episode_id"))
    events = lines.where("artifact_id % 3 = 0").join(even, "episode_id", "left_semi")
    return A.associated(events, lines)


@query("""SELECT doc_id AS question_id, CASE WHEN doc_id%10=0 THEN 'invalid_box' WHEN doc_id%10=1 THEN 'empty_question' WHEN doc_id%10=2 THEN 'size_mismatch' WHEN doc_id%10=3 AND doc_id>3 AND EXISTS (SELECT 1 FROM labels b WHERE b.doc_id%10=3 AND b.doc_id<l.doc_id) THEN 'repeated_question' END AS code FROM labels l""")
def grounding_rows(spark, d):
    """Rows fit for grounding tasks, and why others aren't."""
    k = F.col("doc_id")
    number = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), number(k % 5000 + 1), number(F.lit(9)), F.unhex(F.lit("0802000000")), number(k))
    question = F.when(k % 10 == 1, " ").when(k % 10 == 3, "the same?").otherwise(F.concat(F.lit("q"), k.cast("string")))
    rows = V.read(spark, d, "labels").select(k.alias("question_id"), question.alias("question"), F.when(k % 10 == 0, 0.9).otherwise(0.1).alias("west"), F.lit(0.1).alias("south"), F.lit(0.5).alias("east"), F.lit(0.5).alias("north"), png.alias("content"), F.when(k % 10 == 2, 0).otherwise(k % 5000 + 1).cast("int").alias("image_width"), F.lit(9).alias("image_height"))
    return A.grounding_rows(rows)
