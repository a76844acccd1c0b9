"""Rasters as tiles: runs of zones, resampling with a halo, and windows checked by hashes.

A tile is a row ``raster_id, tile_row, tile_col, values, mask`` with row-major arrays, clipped at the raster's right and
lower edge; a last tile may end early where pixels lack.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster as R
from . import raster as P
from .ranges import meeting

SIZE = 256


def from_tiles(tiles: DataFrame, width: int, *, size: int = SIZE, value: str = "value", mask: str = "valid") -> DataFrame:
    """Pixels ``raster_id, row_idx, col_idx`` with ``value`` and ``mask`` of tiles of rasters ``width`` wide."""
    across = F.least(F.lit(size), F.lit(width) - F.col("tile_col") * size)
    rows = tiles.select("raster_id", "tile_row", "tile_col", across.alias("across"), F.posexplode(F.arrays_zip("values", "mask")).alias("i", "p"))
    return rows.select("raster_id", (F.col("tile_row") * size + F.expr("i div across")).alias("row_idx"), (F.col("tile_col") * size + F.col("i") % F.col("across")).alias("col_idx"), F.col("p.values").alias(value), F.col("p.mask").alias(mask))


# Zones


def _crossings(ring: Column, y: Column) -> Column:
    """Closed stretches of x on the line ``y`` that the ring holds: between crossings, at edges that touch the line, along those that lie on it."""
    edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")))
    at = lambda e: F.try_divide((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
    crossed = F.array_sort(F.transform(F.filter(edges, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)), at))
    between = F.transform(F.sequence(F.lit(1), F.size(crossed), F.lit(2)), lambda i: F.struct(F.element_at(crossed, i).alias("lo"), F.element_at(crossed, i + 1).alias("hi")))
    flat = lambda e: e["a"]["y"] == e["b"]["y"]
    touching = F.filter(edges, lambda e: (F.least(e["a"]["y"], e["b"]["y"]) <= y) & (y <= F.greatest(e["a"]["y"], e["b"]["y"])))
    touched = F.transform(touching, lambda e: F.struct(F.when(flat(e), F.least(e["a"]["x"], e["b"]["x"])).otherwise(at(e)).alias("lo"), F.when(flat(e), F.greatest(e["a"]["x"], e["b"]["x"])).otherwise(at(e)).alias("hi")))
    return F.concat(F.when(F.size(crossed) > 0, between).otherwise(F.array().cast("array<struct<lo:double,hi:double>>")), touched)


def _zones_on_grids(zones: DataFrame, grids: DataFrame) -> DataFrame:
    """Zones with the grids that their boxes meet (of the same ``crs``, where both have one)."""
    boxes = {}
    for axis, origin, step, n in (("x", "c", "a", "width"), ("y", "f", "e", "height")):
        far = F.col(origin) + F.col(step) * F.col(n)
        boxes |= {f"_{axis}0": F.least(origin, far), f"_{axis}1": F.greatest(origin, far)}
    along = {f"_z{axis}{k}": pick(F.col(f"ring.{axis}")) for axis in "xy" for k, pick in enumerate((F.array_min, F.array_max))}
    axes = [(f"_z{axis}0", f"_z{axis}1", f"_{axis}0", f"_{axis}1") for axis in "xy"]
    crs = ("crs",) if "crs" in zones.columns and "crs" in grids.columns else ()
    return meeting(zones.withColumns(along), grids.withColumns(boxes), [(1.0, 2, axes)], on=crs).drop(*along, *boxes)


def zone_runs(zones: DataFrame, grids: DataFrame) -> DataFrame:
    """``grid_id, zone_id, row_idx, first, last, width`` (of the grid): the columns of each row whose pixel centres a zone holds, boundary included.

    ``grids``: ``grid_id, a, c, e, f, width, height`` (north up: ``e`` below 0, or rows that go up).  A scanline fill: once a grid,
    zone and row, however many rasters have the grid; runs of a row are disjoint.
    """
    ys = F.transform("ring", lambda p: p["y"])
    row_of = lambda y: (y - F.col("f")) / F.col("e") - 0.5
    ends = [row_of(F.array_min(ys)), row_of(F.array_max(ys))]
    slack = 1e-9
    met = _zones_on_grids(zones, grids)
    top, bottom = F.greatest(F.lit(0), F.ceil(F.least(*ends) - slack)), F.least(F.col("height") - 1, F.floor(F.greatest(*ends) + slack))
    lines = met.where(top <= bottom).withColumn("row_idx", F.explode(F.sequence(top.cast("long"), bottom.cast("long"))))
    lines = lines.withColumn("y", R.center_y(F.col("f"), F.col("e"), F.col("row_idx")))
    column = lambda x: (x - F.col("c")) / F.col("a") - 0.5
    parts = F.transform(_crossings(F.col("ring"), F.col("y")), lambda s: F.struct(F.greatest(F.lit(0), F.ceil(F.least(column(s["lo"]), column(s["hi"])) - slack)).cast("long").alias("first"), F.least(F.col("width") - 1, F.floor(F.greatest(column(s["lo"]), column(s["hi"])) + slack)).cast("long").alias("last")))
    parts = F.array_sort(F.filter(parts, lambda p: p["first"] <= p["last"]))
    # Neighbours that overlap or touch become one.
    kind = "array<struct<first:bigint,last:bigint>>"
    joined = F.aggregate(parts, F.array().cast(kind), lambda done, p: F.when((F.size(done) > 0) & (p["first"] <= F.element_at(done, -1)["last"] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], p["last"]).alias("last"))))).otherwise(F.concat(done, F.array(p))))
    return lines.withColumn("run", F.explode(joined)).select("grid_id", "zone_id", "row_idx", "run.first", "run.last", "width")


def zonal_stats(tiles: DataFrame, zones: DataFrame, grids: DataFrame, *, size: int = SIZE, digits: int = 6) -> DataFrame:
    """Statistics of each raster in each zone, from tiles with ``grid_id``; zones without a pixel centre keep a row of nulls.

    Runs are cut at tile edges and join tiles by grid and tile; a zone's pixels of a tile are slices of its arrays.
    """
    runs = zone_runs(zones, grids)
    cut = runs.withColumn("tile_col", F.explode(F.sequence(F.expr(f"first div {size}"), F.expr(f"last div {size}")))).withColumn("tile_row", F.expr(f"row_idx div {size}"))
    first, last = F.greatest("first", F.col("tile_col") * size), F.least("last", (F.col("tile_col") + 1) * size - 1)
    piece = F.struct((F.col("row_idx") - F.col("tile_row") * size).alias("row"), (first - F.col("tile_col") * size).alias("at"), (last - first + 1).alias("n"))
    wanted = cut.groupBy("grid_id", "tile_row", "tile_col", "zone_id", "width").agg(F.collect_list(piece).alias("pieces"))
    met = tiles.join(wanted, ["grid_id", "tile_row", "tile_col"])
    across = F.least(F.lit(size), F.col("width") - F.col("tile_col") * size)
    picked = lambda column: F.flatten(F.transform("pieces", lambda p: F.slice(F.col(column), (p["row"] * across + p["at"] + 1).cast("int"), p["n"].cast("int"))))
    met = met.select("zone_id", "raster_id", F.arrays_zip(picked("values").alias("v"), picked("mask").alias("m")).alias("p"))
    met = met.withColumn("good", F.transform(F.filter("p", lambda p: F.coalesce(p["m"], F.lit(False))), lambda p: p["v"]))
    part = met.select("zone_id", "raster_id", F.size("p").alias("n"), F.size("good").alias("ok"), F.array_min("good").alias("lo"), F.array_max("good").alias("hi"), F.aggregate("good", F.lit(0.0), lambda s, v: s + v).alias("sum"))
    ok, n = F.sum("ok"), F.sum("n")
    stats = part.groupBy("zone_id", "raster_id").agg(
        n.alias("zone_pixels"), ok.alias("valid_pixels"), (n - ok).alias("invalid_pixels"), F.round(R.ratio(ok, n), digits).alias("valid_fraction"),
        F.round(F.min("lo"), digits).alias("min_value"), F.round(F.max("hi"), digits).alias("max_value"), F.round(R.ratio(F.sum("sum"), ok), digits).alias("mean_value"),
    ).where("zone_pixels > 0")
    return zones.select("zone_id").join(stats, "zone_id", "left").withColumn("code", F.when(F.col("raster_id").isNull(), "no_pixel_centres"))


# Resampling


def resample(tiles: DataFrame, *, src: tuple[float, ...], dst: tuple[float, ...], shape: tuple[int, int], target: tuple[int, int], size: int = SIZE, method: str = "bilinear", tolerance: float = 1e-6, nodata: int = 255) -> DataFrame:
    """Tiles of a target grid from tiles of a source grid, each ``(a, c, e, f)``; shapes are ``(width, height)``.

    Every source tile hands each target tile the part that it needs, with a halo of one pixel for ``bilinear``; a target tile
    puts its few parts together and resamples them at once.  ``bilinear``: a masked neighbour with weight makes the result
    invalid, neighbours are clamped at the edges, and targets whose centre lies outside are invalid.  ``nearest``: values are
    codes; outside, masked and 0 give ``nodata``.
    """
    (a, c, e, f), (ta, tc, te, tf) = src, dst
    (width, height), (target_width, target_height) = shape, target
    halo = 1 if method == "bilinear" else 0

    def centres(n: int, start: int, step: float, origin: float, other_step: float, other_origin: float) -> np.ndarray:
        """In pixels of the source grid."""
        return ((origin + step * (np.arange(start, start + n) + 0.5)) - other_origin) / other_step

    def needed(tile: int, step, origin, other_step, other_origin, n: int, most: int) -> tuple[int, int]:
        """First and last source index that a row or column of target tiles needs."""
        at = centres(min(size, n - tile * size), tile * size, step, origin, other_step, other_origin)
        low, high = int(np.floor(at.min() - 0.5 * halo)), int(np.floor(at.max() - 0.5 * halo)) + halo
        return max(0, min(most - 1, low)), max(0, min(most - 1, high))

    rows_of = [needed(t, te, tf, e, f, target_height, height) for t in range(-(-target_height // size))]
    columns_of = [needed(t, ta, tc, a, c, target_width, width) for t in range(-(-target_width // size))]
    by_source: list[dict[int, list[int]]] = [{}, {}]
    for spans, index in zip((rows_of, columns_of), by_source, strict=True):
        for t, (low, high) in enumerate(spans):
            for s in range(low // size, high // size + 1):
                index.setdefault(s, []).append(t)
    columns = "raster_id long, tile_row long, tile_col long, "
    parts = columns + "top long, left long, across long, values array<double>, mask array<boolean>"
    names = [x.split()[0] for x in parts.split(", ")]

    def hand(batches):
        for batch in batches:
            found: list[tuple] = []
            values, masks = batch.column(3), batch.column(4)
            for i, (raster, row, column) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                across = min(size, width - column * size)
                # Pixels that lack at the end are masked.
                whole = min(size, height - row * size) * across
                v, m = np.zeros(whole), np.zeros(whole, bool)
                own = values[i].values
                v[: len(own)] = np.nan_to_num(own.to_numpy(zero_copy_only=False).astype(float))
                m[: len(own)] = masks[i].values.fill_null(False).to_numpy(zero_copy_only=False).astype(bool) & own.is_valid().to_numpy(zero_copy_only=False)
                v, m = v.reshape(-1, across), m.reshape(-1, across)
                for tr in by_source[0].get(row, ()):
                    for tcol in by_source[1].get(column, ()):
                        (r0, r1), (c0, c1) = rows_of[tr], columns_of[tcol]
                        top, left = max(r0, row * size), max(c0, column * size)
                        cut = np.s_[top - row * size : r1 + 1 - row * size, left - column * size : c1 + 1 - column * size]
                        part = v[cut]
                        found.append((raster, tr, tcol, top, left, part.shape[1], part.ravel(), m[cut].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(6)] + [pa.array([x[6] for x in found], pa.list_(pa.float64())), pa.array([x[7] for x in found], pa.list_(pa.bool_()))], names)

    def made(tr: int, tcol: int, found: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        (r0, r1), (c0, c1) = rows_of[tr], columns_of[tcol]
        v, m = np.zeros((r1 - r0 + 1, c1 - c0 + 1)), np.zeros((r1 - r0 + 1, c1 - c0 + 1), bool)
        place = [found.field(k).to_pylist() for k in range(3)]
        for i, (top, left, across) in enumerate(zip(*place, strict=True)):
            part = found.field(3)[i].values.to_numpy().reshape(-1, across)
            cut = np.s_[top - r0 : top - r0 + part.shape[0], left - c0 : left - c0 + across]
            v[cut], m[cut] = part, found.field(4)[i].values.to_numpy(zero_copy_only=False).reshape(-1, across)
        x = centres(min(size, target_width - tcol * size), tcol * size, ta, tc, a, c)[None, :]
        y = centres(min(size, target_height - tr * size), tr * size, te, tf, e, f)[:, None]
        if method == "nearest":
            column, row = np.floor(x).astype(int), np.floor(y).astype(int)
            inside = (column >= 0) & (column < width) & (row >= 0) & (row < height)
            at = np.clip(row - r0, 0, len(v) - 1), np.clip(column - c0, 0, v.shape[1] - 1)
            ok = inside & m[at] & (v[at] != 0)
            out = np.where(ok, v[at], nodata)
        else:
            u, w = x - 0.5, y - 0.5
            left, top = np.floor(u).astype(int), np.floor(w).astype(int)
            total, weight = np.zeros(np.broadcast(x, y).shape), np.zeros(np.broadcast(x, y).shape)
            for down in (0, 1):
                for right in (0, 1):
                    share = np.abs(1 - right - (u - left)) * np.abs(1 - down - (w - top))
                    at = np.clip(top + down, 0, height - 1) - r0, np.clip(left + right, 0, width - 1) - c0
                    at = np.clip(at[0], 0, len(v) - 1), np.clip(at[1], 0, v.shape[1] - 1)
                    weight += share * m[at]
                    total += share * m[at] * v[at]
            ok = (x >= 0) & (x <= width) & (y >= 0) & (y <= height) & (weight >= 1 - tolerance)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(ok, (total / weight).astype(np.float32).astype(float), np.nan)
        return out.ravel(), ok.ravel()

    def together(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [made(tr, tcol, batch.column(3)[i].values) for i, (tr, tcol) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True))]
            ends = pa.array(np.cumsum([0, *(len(ok) for _, ok in rows)]), pa.int32())
            flat = pa.array(np.concatenate([out for out, _ in rows]), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([ok for _, ok in rows])))], ["raster_id", "tile_row", "tile_col", "values", "mask"])

    read = tiles.select("raster_id", "tile_row", "tile_col", F.col("values").cast("array<double>"), "mask")
    found = read.mapInArrow(hand, parts).groupBy("raster_id", "tile_row", "tile_col").agg(F.collect_list(F.struct(*names[3:])).alias("parts"))
    return found.mapInArrow(together, columns + "values array<double>, mask array<boolean>")


# Windows


def tile_hashes(tiles: DataFrame) -> DataFrame:
    """``raster_id, tile_row, tile_col, h``: a hash of each tile's pixels; a short row for each tile."""
    text = F.concat_ws(",", F.transform(F.arrays_zip("values", "mask"), lambda p: F.concat(F.coalesce(p["values"].cast("string"), F.lit("n")), F.when(F.coalesce(p["mask"], F.lit(False)), "").otherwise("!"))))
    return tiles.select("raster_id", "tile_row", "tile_col", F.sha2(text, 256).alias("h"))


def differing_tiles(source: DataFrame, windows: DataFrame) -> DataFrame:
    """``raster_id, tile_row, tile_col`` of tiles whose pixels differ, or that only one side has.

    A tree of two levels: one hash a raster, of the hashes of its tiles in order; tiles are compared for rasters that differ
    only, and only hashes are shuffled.
    """
    keys = ["raster_id", "tile_row", "tile_col"]
    sides = [tile_hashes(t) for t in (source, windows)]
    tops = [s.groupBy("raster_id").agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("tile_row", "tile_col", "h"))), lambda x: F.concat_ws(":", x["tile_row"], x["tile_col"], x["h"]))), 256).alias(n)) for s, n in zip(sides, ("one", "two"), strict=True)]
    changed = tops[0].join(tops[1], "raster_id", "full_outer").where(~F.col("one").eqNullSafe(F.col("two"))).select("raster_id")
    a, b = (s.join(changed, "raster_id", "left_semi").withColumnRenamed("h", n) for s, n in zip(sides, ("one", "two"), strict=True))
    return a.join(b, keys, "full_outer").where(~F.col("one").eqNullSafe(F.col("two"))).select(*keys)


def verify_windows(source: DataFrame, windows: DataFrame, width: int, *, size: int = SIZE, value: str = "value") -> DataFrame:
    """Pixels that differ between a source and its windows, as tiles of one layout: ``raster_id, row_idx, col_idx, value, side``.

    Pixels are compared in tiles that differ only.
    """
    keys = ["raster_id", "tile_row", "tile_col"]
    bad = differing_tiles(source, windows)
    pixels = [from_tiles(t.join(bad, keys, "left_semi"), width, size=size, value=value).where(F.coalesce("valid", F.lit(False))).drop("valid") for t in (source, windows)]
    return P.verify_windows(*pixels, ["raster_id", "row_idx", "col_idx", value])
