"""Admission of datasets: path coverage, duplicates, inventories, samples, storage accounting."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, hashing, paths
from ..sources.scratch import written


def first_distinct(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows numbered within equal ``key``: ``copy`` is 1 for the first in ``order``."""
    return rows.withColumn("copy", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"))


def path_coverage(found: DataFrame, files: DataFrame, prefixes: list[str]) -> DataFrame:
    """What becomes of each path row: ``outcome`` is ``duplicate``, a failure code or an admission.

    ``files``: ``path, width, height, bytes``.  A path counts once, however often it is named.
    """
    rows = found.withColumn("failure", paths.path_code(F.col("path")))
    rows = rows.withColumn("failure", F.coalesce("failure", F.when(~paths.under(F.col("path"), prefixes), F.lit("outside_reviewed_prefix"))))
    # Broken paths, which are often the same one, don't meet: only good ones are looked up.
    first = rows.where("failure IS NULL").groupBy("path").agg(F.min("page_id").alias("first")).join(files, "path", "left")
    # Of rows that share the id as well, one is the first.
    again = F.row_number().over(W.partitionBy("path_key", "page_id").orderBy("page_id")) > 1
    rows = rows.withColumn("path_key", F.when(F.col("failure").isNull(), F.col("path"))).withColumn("again", again).join(first.withColumnRenamed("path", "path_key"), "path_key", "left")
    rows = rows.withColumn("copy", F.when((F.col("page_id") > F.col("first")) | F.col("again"), 2).otherwise(1))
    size = F.when(F.col("bytes").isNull(), "missing_file").when(F.col("bytes") > 128 << 20, "oversize").when(F.col("width") * F.col("height") > 20_000_000, "window").otherwise("whole")
    outcome = F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("copy") > 1, "duplicate").otherwise(size)
    kind = F.when(F.col("failure").isNotNull(), "failure").when(F.col("copy") > 1, "duplicate").when(F.col("bytes").isNull(), "failure").otherwise("admitted")
    return rows.select("page_id", "path", outcome.alias("outcome"), kind.alias("kind"))


def coverage_report(outcomes: DataFrame) -> DataFrame:
    """Counts by outcome, by kind, and in all, in one pass (grouping sets)."""
    rows = outcomes.groupingSets([["kind", "outcome"], ["kind"], []], "kind", "outcome")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.sha2("path", 256)).alias("distinct_paths"))


def seeded_sample(assets: DataFrame, key: str, k: int, seed: str, identity: str = "asset_id") -> DataFrame:
    """The ``k`` smallest seeded hashes of each group (a sample by definition)."""
    rank = F.sha2(F.concat(F.lit(seed), F.col(identity)), 256)
    # Only k rows of a group leave each partition, so a hot group meets as few rows.
    rows = assets.withColumns({"rank": rank, "part": F.spark_partition_id()})
    some = rows.withColumn("n", F.row_number().over(W.partitionBy(key, "part").orderBy("rank"))).where(F.col("n") <= k)
    return some.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("rank"))).where(F.col("n") <= k).drop("rank", "part", "n")


def inventory(files: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Images, label-like images, bytes, archives and failure markers of each dataset."""
    name = F.lower(paths.name_of(F.col("relative_path")))
    image = paths.ends_with(name, paths.IMAGE_SUFFIXES)
    label = paths.label_like(F.col("relative_path"))
    rows = files.groupBy(key).agg(
        F.count_if(image & ~label).alias("candidate_images"),
        F.count_if(image & label).alias("label_like_images"),
        F.coalesce(F.sum(F.when(image, F.col("size_bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(paths.ends_with(name, paths.ARCHIVE_SUFFIXES)).alias("archives"),
        F.count_if(name.contains("download_failed")).alias("failure_markers"),
    )
    status = F.when(F.col("failure_markers") > 0, "partial").when(F.col("candidate_images") > 0, "available").otherwise("unavailable")
    return rows.withColumn("status", status)


def running_cap(rows: DataFrame, key: str, order: list[str], size: str, cap: int) -> DataFrame:
    """The prefix of each group whose sizes add up to at most ``cap``."""
    total = F.sum(size).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("running_bytes", total).where(F.col("running_bytes") <= cap)


def greedy_cap(rows: DataFrame, key: str, order: list[str], size: str, cap: int) -> DataFrame:
    """Items in order, each taken if it still fits.

    The choice is sequential by nature; each key is a stream of sorted batches, so that a large one
    needs no memory in proportion to its size.
    """

    def run(batches):
        key_now, used = None, None
        for batch in batches:
            keep = []
            for k, n in zip(batch[key], batch[size], strict=True):
                k = None if pd.isna(k) else k
                if used is None or k != key_now:
                    key_now, used = k, 0
                keep.append(bool(used + n <= cap))
                used += n if keep[-1] else 0
            yield batch[keep]

    return rows.repartition(key).sortWithinPartitions(key, *(F.asc_nulls_last(c) for c in order)).mapInPandas(run, rows.schema)


def physical_usage(files: DataFrame) -> DataFrame:
    """Allocated bytes by category; files that share an inode count once, at the smallest path."""
    rows = first_distinct(files.withColumn("node", F.struct("dev", "inode")), "node", ["path"])
    rows = rows.withColumn("category", paths.category(F.col("path")))
    first = F.col("copy") == 1
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.count_if(~first).alias("aliases"), F.sum(F.when(first, F.col("blocks") * 512).otherwise(0)).alias("allocated_bytes"))


def usage_report(entries: DataFrame, *, root_device: int | None = None) -> DataFrame:
    """``category, files, aliases, allocated_bytes, symlinks, errors, complete`` of a walk's entries, and a row of all (null category).

    ``entries``: ``path, kind, dev, inode, blocks``; kinds are ``file, symlink, directory, error`` (could not be read) and others.  Links are
    counted and never followed.  The report is complete if no entry is an error and, with ``root_device``, none lies on another device.
    """
    rows = entries.withColumn("category", F.when(F.col("kind") == "file", paths.category(F.col("path"))))
    first = rows.where("kind = 'file'").groupBy("dev", "inode").agg(F.min("path").alias("_first"))
    rows = rows.join(first, ["dev", "inode"], "left")
    file, once = F.col("kind") == "file", (F.col("kind") == "file") & (F.col("path") == F.col("_first"))
    away = F.lit(False) if root_device is None else F.coalesce(F.col("dev") != root_device, F.lit(True))
    bad = (F.col("kind") == "error") | away
    sums = [F.count_if(file).alias("files"), F.count_if(file & ~once).alias("aliases"), F.sum(F.when(once, F.col("blocks") * 512).otherwise(0)).alias("allocated_bytes"), F.count_if(F.col("kind") == "symlink").alias("symlinks"), F.count_if(bad).alias("errors"), (F.count_if(bad) == 0).alias("complete")]
    by = rows.where("kind = 'file'").groupBy("category").agg(*sums)
    return by.unionByName(rows.agg(*sums).withColumn("category", F.lit(None).cast("string")))


def coverage_maps(outcomes: DataFrame, *maps: str) -> DataFrame:
    """``map, name, rows`` of a coverage report, ordered by map and name: outcomes, failures and duplicates, which add up to all rows, and each of ``maps``.

    ``outcomes`` has ``kind, outcome`` and the columns of ``maps`` (null: not counted), which say something of admitted files only.
    """
    shown = {"failure": "failures", "duplicate": "duplicates", "admitted": "outcomes"}
    kind = reduce(lambda c, k: c.when(F.col("kind") == k, shown[k]), shown, F.when(F.lit(False), ""))
    cells = F.array(F.struct(kind.alias("map"), F.col("outcome").alias("name")), *(F.struct(F.lit(m).alias("map"), name.alias("name")) for m, name in (("all", F.lit("rows")), *((m, F.when(F.col("kind") == "admitted", F.col(m))) for m in maps))))
    rows = outcomes.select(F.explode(cells).alias("c")).select("c.map", "c.name").where("name IS NOT NULL")
    return rows.groupBy("map", "name").agg(F.count(F.lit(1)).alias("rows")).orderBy("map", "name")


def scope_usage(files: DataFrame, reservations: DataFrame) -> DataFrame:
    """Charged bytes under each reserved scope, and the headroom that is left.

    Each path is joined to scopes by its ancestors, an equi-join.
    """
    scopes = reservations.groupBy("scope").agg(F.sum("capacity").alias("capacity"))
    rows = files.select(F.explode(paths.ancestors(F.col("path"))).alias("scope"), hashing.charge(F.col("size_bytes"), F.col("blocks")).alias("charge"))
    used = rows.groupBy("scope").agg(F.sum("charge").alias("charged"), F.count(F.lit(1)).alias("files"))
    out = scopes.join(used, "scope", "left").fillna(0, ["charged", "files"])
    return out.withColumn("headroom", F.greatest(F.lit(0), F.col("capacity") - F.col("charged")))


def quota_status(usage: DataFrame, files: DataFrame, *, total: int) -> DataFrame:
    """One row: bytes in files, reserved headroom, what is charged in all, and what is left of ``total``.

    ``usage`` is :func:`scope_usage`; scopes should not lie within each other (:func:`overlapping_scopes`).
    """
    data = files.agg(F.coalesce(F.sum(hashing.charge(F.col("size_bytes"), F.col("blocks"))), F.lit(0)).cast("long").alias("data"))
    held = usage.agg(F.count(F.lit(1)).alias("scopes"), F.coalesce(F.sum("headroom"), F.lit(0)).cast("long").alias("reserved"))
    charged = F.col("data") + F.col("reserved")
    return data.crossJoin(held).select("data", "scopes", "reserved", charged.alias("charged"), F.greatest(F.lit(0), F.lit(total) - charged).alias("available"))  # one row on either side


def overlapping_scopes(reservations: DataFrame) -> DataFrame:
    """Pairs of different scopes of which one lies within the other."""
    scopes = reservations.select("scope").distinct()
    inner = scopes.select(F.col("scope").alias("inner_scope"), F.explode(paths.ancestors(F.col("scope"))).alias("scope"))
    return inner.join(scopes, "scope").where("scope <> inner_scope").select(F.col("scope").alias("outer_scope"), "inner_scope")


def member_check(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """Members of an archive against a manifest ``path, sha256, size_bytes``: one violation a path."""
    got = members.groupBy("path").agg(F.count(F.lit(1)).alias("times"), F.min("sha256").alias("got_sha"), F.min("size_bytes").alias("got_size"))
    rows = manifest.join(got, "path", "full_outer")
    code = (
        F.when(F.col("times").isNull(), "missing_member")
        .when(F.col("sha256").isNull(), "unexpected_member")
        .when(F.col("times") > 1, "duplicate_member")
        .when(F.col("size_bytes") != F.col("got_size"), "size_mismatch")
        .when(F.col("sha256") != F.col("got_sha"), "hash_mismatch")
    )
    return rows.select("path", code.alias("code")).where("code IS NOT NULL")


def register_conflicts(artifacts: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Keys that were registered with different contents."""
    return artifacts.groupBy(*keys).agg(F.count_distinct(content).alias("versions")).where("versions > 1")


def embedded_images(rows: DataFrame, column: str, key: str, *, most: int = 16) -> DataFrame:
    """Images in an array of structs ``bytes, path``: one row each with a failure code.

    A path without bytes is refused; arrays of more than ``most`` images are refused whole.
    """
    wide = rows.select(key, F.size(column).alias("n"), F.posexplode_outer(column).alias("position", "image"))
    code = F.when(F.col("n") > most, "too_many_images").when(F.col("image").isNull(), "no_image").when(F.col("image.bytes").isNull(), "external_image_reference_not_allowed").when(paths.image_kind(F.col("image.bytes")).isNull(), "unknown_image_format")
    return wide.select(key, "position", paths.image_kind(F.col("image.bytes")).alias("kind"), F.sha2("image.bytes", 256).alias("sha256"), code.alias("code"))


#: Fixed limits of embedded images: how deep they may lie, how many there may be, bytes of one.
IMAGE_DEPTH, IMAGES, IMAGE_BYTES = 3, 16, 128 << 20


def nested_images(rows: DataFrame, column: str, key: str, *, depth: int = IMAGE_DEPTH, most: int = IMAGES, most_bytes: int = IMAGE_BYTES) -> DataFrame:
    """``key, code, images`` of a VARIANT column with images nested in lists and in objects with ``bytes``.

    The walk goes down a level at a time, so plans are as deep as the limit.  ``code`` is the first failure in the order of a
    reader that goes through lists item by item (null: none): ``image_nesting_limit``, ``image_sequence_limit`` (a list of more
    than ``most`` items, or with more images than that so far after an item), ``external_image_reference_not_allowed`` (an object without bytes:
    its path is never followed), ``missing_embedded_image``, ``image_size_limit``.  ``images`` has ``path, kind, sha256`` in order, and is
    empty after a failure.  ``key`` is unique; a null value is a missing image.
    """
    place = lambda i: F.lpad(i.cast("string"), 6, "0")
    # Made once: a filter isn't moved before an explode, so what it tests isn't computed again.
    once = lambda c: F.explode(F.array(c))
    level = rows.select(key, F.lit("").alias("path"), once(F.col(column)).alias("v"))
    leaves = []
    for at in range(depth + 2):
        kind = F.regexp_extract(F.coalesce(F.schema_of_variant("v"), F.lit("VOID")), "^[A-Z]+", 0)
        level = level.withColumn("kind", kind)
        if at > depth:
            leaves.append(level.select(key, "path", F.lit("image_nesting_limit").alias("code"), F.lit(None).cast("binary").alias("bytes")))
            break
        items = F.when(F.col("kind") == "ARRAY", F.expr("try_variant_get(v, '$', 'array<variant>')"))
        held = F.when(F.col("kind") == "OBJECT", F.expr("try_variant_get(v, '$.bytes', 'variant')"))
        binary = F.when(F.col("kind") == "BINARY", F.expr("try_variant_get(v, '$', 'binary')"))
        level = level.select(key, "path", once(F.struct("kind", items.alias("items"), held.alias("held"), binary.alias("bytes"))).alias("x")).select(key, "path", "x.*")
        empty = F.col("held").isNull() | F.is_variant_null("held")
        code = (
            F.when((F.col("kind") == "ARRAY") & (F.size("items") > most), "image_sequence_limit")
            .when((F.col("kind") == "OBJECT") & empty, "external_image_reference_not_allowed")
            .when(F.col("kind").isin("ARRAY", "OBJECT"), "")
            .when(F.coalesce(F.octet_length("bytes"), F.lit(0)) == 0, "missing_embedded_image")
            .when(F.octet_length("bytes") > most_bytes, "image_size_limit")
        )
        level = level.withColumn("code", code)
        leaves.append(level.where("code IS NULL OR code <> ''").select(key, "path", "code", "bytes"))
        inner = F.when(F.col("kind") == "ARRAY", F.col("items")).otherwise(F.array("held"))
        level = level.where("code = ''").select(key, "path", F.posexplode(inner).alias("i", "v")).select(key, F.concat("path", place(F.col("i")), F.lit("/")).alias("path"), "v")
    met = written(reduce(DataFrame.unionByName, leaves).select(key, "path", "code", paths.image_kind(F.col("bytes")).alias("kind"), F.sha2("bytes", 256).alias("sha256")))
    # After an item of a list there are more images than allowed: a failure behind all that the item holds.
    over = []
    for k in range(depth):
        item = met.where(F.col("code").isNull() & (F.length("path") > 7 * k)).groupBy(key, F.substring("path", 1, 7 * k).alias("list"), F.substring("path", 7 * k + 1, 6).alias("item")).agg(F.count(F.lit(1)).alias("n"))
        so_far = F.sum("n").over(W.partitionBy(key, "list").orderBy("item"))
        over.append(item.withColumn("sum", so_far).where(F.col("sum") > most).select(key, F.concat("list", "item", F.lit("~")).alias("path"), F.lit("image_sequence_limit").alias("code")))
    none = F.lit(None).cast("string")
    met = reduce(DataFrame.unionByName, over).withColumns({"kind": none, "sha256": none}).unionByName(met)
    failed = F.min(F.when(F.col("code").isNotNull(), F.struct("path", "code")))
    images = F.array_sort(F.collect_list(F.when(F.col("code").isNull(), F.struct("path", "kind", "sha256"))))
    out = met.groupBy(key).agg(failed["code"].alias("code"), images.alias("images"))
    # An empty list has no node of its own.
    out = rows.select(key).join(out, key, "left")
    return out.select(key, "code", F.when(F.col("code").isNull() & F.col("images").isNotNull(), F.col("images")).otherwise(F.array().cast("array<struct<path:string,kind:string,sha256:string>>")).alias("images"))


def jpeg_size(content: bytes | None) -> tuple[int, int, int] | None:
    """Width, height and channels from the frame header of a JPEG; None if there is none."""
    if not content or content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(content):
        if content[at] != 0xFF:
            return None
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            high, wide = int.from_bytes(content[at + 5 : at + 7], "big"), int.from_bytes(content[at + 7 : at + 9], "big")
            return wide, high, content[at + 9]
        at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def image_sizes(images: DataFrame, key: str, column: str = "content") -> DataFrame:
    """``key, kind, width, height`` from header bytes: PNG in Catalyst, JPEG by a marker walk in Arrow batches."""

    @F.pandas_udf("struct<width:int,height:int>")
    def walk(contents: pd.Series) -> pd.DataFrame:
        sizes = [jpeg_size(c) for c in contents]
        return pd.DataFrame({"width": pd.array([s and s[0] for s in sizes], "Int32"), "height": pd.array([s and s[1] for s in sizes], "Int32")})

    rows = images.select(key, paths.image_kind(F.col(column)).alias("kind"), paths.png_size(F.col(column)).alias("png"), walk(F.when(paths.image_kind(F.col(column)) == "jpeg", F.col(column))).alias("jpeg"))
    return rows.select(key, "kind", F.coalesce("png.width", "jpeg.width").alias("width"), F.coalesce("png.height", "jpeg.height").alias("height"))


def image_channels(images: DataFrame, key: str, column: str = "content") -> DataFrame:
    """``key, kind, width, height, channels`` from header bytes; channels of a PNG by its colour type (a palette is one)."""

    @F.pandas_udf("struct<width:int,height:int,channels:int>")
    def walk(contents: pd.Series) -> pd.DataFrame:
        sizes = [jpeg_size(c) or (None,) * 3 for c in contents]
        return pd.DataFrame({name: pd.array([s[i] for s in sizes], "Int32") for i, name in enumerate(("width", "height", "channels"))})

    rows = images.select(key, paths.image_kind(F.col(column)).alias("kind"), paths.png_size(F.col(column)).alias("png"), walk(F.when(paths.image_kind(F.col(column)) == "jpeg", F.col(column))).alias("jpeg"))
    colours = F.create_map(*(F.lit(x) for pair in ((0, 1), (2, 3), (3, 1), (4, 2), (6, 4)) for x in pair))
    return rows.select(key, "kind", *(F.coalesce(f"png.{c}", f"jpeg.{c}").alias(c) for c in ("width", "height")), F.coalesce(colours[F.col("png.colour")], F.col("jpeg.channels")).alias("channels"))


def match_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with the number of their matches on the right; good if it is exactly one."""
    counts = right.groupBy(key).agg(F.count(F.lit(1)).alias("matches"))
    rows = left.join(counts, key, "left").fillna(0, ["matches"])
    return rows.withColumn("unique_match", F.col("matches") == 1)


def _steps(edges: DataFrame) -> DataFrame:
    return edges.select("child", F.col("parent").alias("ancestor")).where("child IS NOT NULL AND ancestor IS NOT NULL").distinct()


#: Known pairs for each task of a round; a round makes several times as many.
PAIRS = 250_000


def _joined(one: DataFrame, two: DataFrame, depth: Column | None = None, parts: int | None = None) -> DataFrame:
    """Steps of ``one`` and then of ``two``, by ``parts`` tasks: tasks merged by the size of what they read would make too many rows each."""
    on = two.select(F.col("child").alias("step"), F.col("ancestor").alias("next"), *(["depth"] if depth is not None else []))
    if parts:
        one, on = one.repartition(parts, "ancestor"), on.repartition(parts, "step").hint("merge")
    return one.join(on, F.col("ancestor") == F.col("step")).select("child", F.col("next").alias("ancestor"), *([depth.alias("depth")] if depth is not None else []))


def lineage_closure(edges: DataFrame) -> DataFrame:
    """All ancestors of every node in ``edges(child, parent)``, with the least depth.

    Jumps of 1, 2, 4 ... steps: a way of up to twice as many steps as known so far is a jump and a way that is known.  So a depth of
    ``d`` takes about ``log2(d)`` rounds, each written, and a pair is made once for each jump that leads to it.  A round
    without a new pair ends the search, also in cycles: where a way is longer than all known ones, so is one by a single step.
    """
    jumps = _steps(edges)
    known, far = written(jumps.withColumn("depth", F.lit(1).cast("long"))), 1
    count = known.count()
    while True:
        parts = 1 + count // PAIRS
        more = _joined(jumps, known, F.col("depth") + far, parts).unionByName(jumps.withColumn("depth", F.lit(far).cast("long")))
        known = written(known.unionByName(more).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        before, count = count, known.count()
        if far > 1 and count == before:
            return known
        jumps, far = written(_joined(jumps, jumps, parts=parts).distinct()), 2 * far


def lineage_roots(edges: DataFrame) -> DataFrame:
    """``node, root, is_root``: the inputs without a parent that every node comes from; a root has a row with itself.

    Pointer doubling: a node points to where 1, 2, 4 ... steps lead it, and a root to itself.  Only ends of ways are kept, so a
    chain of any length has a row a node in each of its ``log2`` rounds.  Nodes that only a cycle leads to have no row.
    """
    steps = _steps(edges)
    roots = written(steps.select(F.col("ancestor").alias("child")).join(steps.select("child"), "child", "left_anti").distinct().withColumn("ancestor", F.col("child")))
    pointers = written(steps.unionByName(roots))
    nodes = pointers.select("child").distinct().count()
    for _ in range(max(1, nodes.bit_length())):
        open_ = pointers.join(roots.select(F.col("child").alias("root")), F.col("ancestor") == F.col("root"), "left_anti")
        if open_.isEmpty():
            break
        # Ends that are roots stay; the others go on.
        done = pointers.join(roots.select(F.col("child").alias("root")), F.col("ancestor") == F.col("root"), "left_semi")
        pointers = written(done.unionByName(_joined(open_, pointers)).distinct())
    ends = pointers.join(roots.select(F.col("child").alias("root")), F.col("ancestor") == F.col("root"), "left_semi")
    return ends.select(F.col("child").alias("node"), F.col("ancestor").alias("root"), (F.col("child") == F.col("ancestor")).alias("is_root"))


def grounding_rows(rows: DataFrame, *, key: str = "question_id") -> DataFrame:
    """Rows fit for grounding tasks, with the reason against each other row.

    ``rows``: key, ``question``, a unit box ``west..north``, ``content`` (image bytes), ``image_width,
    image_height``.  The box must be valid, the question not blank, the size in the image's header as
    declared, and question and content not seen before (in key order).
    """
    sized = rows.join(image_sizes(rows, key), key).withColumn("content_sha", F.sha2("content", 256))
    code = (
        F.when(~F.coalesce(geo.valid_unit_box(geo.box()), F.lit(False)), "invalid_box")
        .when(F.coalesce(F.trim("question"), F.lit("")) == "", "empty_question")
        .when(F.col("width").isNull() | (F.col("width") != F.col("image_width")) | (F.col("height") != F.col("image_height")), "size_mismatch")
    )
    sized = sized.withColumn("_code", code)
    # Of a question or a content the first row counts, whether it is fit or not; blank questions are refused before.
    first = lambda t, column, name: t.groupBy(column).agg(F.min(key).alias(name))
    sized = sized.join(first(sized.where(F.trim("question") != ""), "question", "_q"), "question", "left").join(first(sized, "content_sha", "_c"), "content_sha", "left")
    repeated = F.when(F.col(key) > F.col("_q"), "repeated_question").when(F.col(key) > F.col("_c"), "repeated_image")
    return sized.select(key, F.coalesce("_code", repeated).alias("code"))


def associated(events: DataFrame, artifacts: DataFrame, keys: tuple[str, ...] = ("episode_id", "artifact_id")) -> DataFrame:
    """Artifacts with the episodes that may use them: exact pairs only."""
    return artifacts.join(events.select(*keys).distinct(), list(keys))
