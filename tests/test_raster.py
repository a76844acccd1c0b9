"""Hand-computed rasters and properties."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F
from skyledger.functions import geo
from skyledger.operators import confusion as C
from skyledger.operators import ranges
from skyledger.operators import raster as P
from skyledger.operators import tiles as T

CELL = ["raster_id", "row_idx", "col_idx"]


def grid(spark, rows, name="dn", raster=1):
    cells = [(raster, r, c, v, True) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, f"raster_id long, row_idx long, col_idx long, {name} long, mask boolean")


def test_ndvi_by_hand(spark):
    red, nir = [[2000, 1000, 500], [0, 2000, 3000]], [[4000, 1000, 4000], [4000, 2000, 2000]]
    out = {(r.row_idx, r.col_idx): r.value for r in P.band_ratio(grid(spark, nir), grid(spark, red)).collect()}
    assert out[0, 0] == pytest.approx(0.5)
    assert out[0, 1] is None and out[0, 2] is None and out[1, 0] is None
    assert out[1, 1] == 0.0
    assert out[1, 2] == pytest.approx(-1 / 3, abs=1e-6)


def test_no_valid_pixel_gives_nulls(spark):
    zero = [[0, 0], [0, 0]]
    row = P.summary(P.band_ratio(grid(spark, zero), grid(spark, zero)), ["raster_id"]).first()
    assert (row.valid_pixels, row.total_pixels, row.mean_value, row.min_value) == (0, 4, None, None)


def test_resample_to_the_same_grid_is_the_identity(spark):
    values = [[i * 7 % 11 + 1 for i in range(r, r + 6)] for r in range(5)]
    codes = grid(spark, values, "code")
    same = (10.0, 0.0, -10.0, 0.0)
    near = {(r.row_idx, r.col_idx): r.code for r in P.resample_nearest(codes, codes, src=same, dst=same).collect()}
    assert near == {(r, c): v for r, row in enumerate(values) for c, v in enumerate(row)}
    smooth = codes.select(*CELL, F.col("code").cast("double").alias("value"), F.col("mask").alias("valid"))
    out = {(r.row_idx, r.col_idx): r.value for r in P.resample_bilinear(smooth, smooth, src=same, dst=same, width=6, height=5).collect()}
    assert out == {(r, c): float(v) for r, row in enumerate(values) for c, v in enumerate(row)}


def test_bilinear_against_a_loop(spark):
    values = [[(r * 5 + c * 3) % 13 for c in range(6)] for r in range(6)]
    bad = {(2, 3)}
    source = spark.createDataFrame([(1, r, c, float(v), (r, c) not in bad) for r, row in enumerate(values) for c, v in enumerate(row)], "raster_id long, row_idx long, col_idx long, value double, valid boolean")
    target = spark.createDataFrame([(1, r, c) for r in range(12) for c in range(12)], "raster_id long, row_idx long, col_idx long")
    out = {(r.row_idx, r.col_idx): r.value for r in P.resample_bilinear(source, target, src=(20.0, 0.0, -20.0, 0.0), dst=(10.0, 3.0, -10.0, -3.0), width=6, height=6).collect()}
    for r in range(12):
        for c in range(12):
            x, y = (3 + 10 * (c + 0.5)) / 20, (3 + 10 * (r + 0.5)) / 20
            c0, r0 = math.floor(x - 0.5), math.floor(y - 0.5)
            du, dv = x - 0.5 - c0, y - 0.5 - r0
            total = weight = 0.0
            for a, b, w in ((0, 0, (1 - du) * (1 - dv)), (0, 1, du * (1 - dv)), (1, 0, (1 - du) * dv), (1, 1, du * dv)):
                rr, cc = min(max(r0 + a, 0), 5), min(max(c0 + b, 0), 5)
                if (rr, cc) not in bad:
                    weight += w
                    total += w * values[rr][cc]
            inside = 0 <= x <= 6 and 0 <= y <= 6
            if inside and weight >= 1 - 1e-6:
                assert out[r, c] == pytest.approx(total / weight, abs=1e-5)
            else:
                assert out[r, c] is None


def test_nearest_outside_and_masked(spark):
    codes = grid(spark, [[4, 0], [5, 6]], "code").withColumn("mask", F.col("col_idx") + F.col("row_idx") < 2)
    target = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 9, 9)], "raster_id long, row_idx long, col_idx long")
    same = (10.0, 0.0, -10.0, 0.0)
    out = {(r.row_idx, r.col_idx): (r.code, r.valid) for r in P.resample_nearest(codes, target, src=same, dst=same).collect()}
    assert out == {(0, 0): (4, True), (0, 1): (255, False), (1, 1): (255, False), (9, 9): (255, False)}


def test_pair_rejects_dates_grids_bands_and_alias(spark):
    base = ("nir-1", "nir", 7, "2024-01-01", "EPSG:32631", [10.0, 0.0, 5.0, 0.0, -10.0, 9.0], 4, 4)
    red = ("red-1", "red", *base[2:])
    change = lambda at, v: (*red[:at], v, *red[at + 1 :])
    cases = {None: red, "wrong_band": change(1, "swir"), "same_asset": change(0, "nir-1"), "item_id_mismatch": change(2, 8), "acquired_mismatch": change(3, "2024-01-02"), "crs_mismatch": change(4, "EPSG:4326"), "transform_mismatch": change(5, [10.0, 0.0, 6.0, 0.0, -10.0, 9.0]), "width_mismatch": change(6, 5), "height_mismatch": change(7, 5)}
    schema = "raster_id long, asset_id string, band string, item_id long, acquired string, crs string, transform array<double>, width int, height int"
    one = spark.createDataFrame([(i, *base) for i in range(len(cases))], schema)
    two = spark.createDataFrame([(i, *row) for i, row in enumerate(cases.values())] + [(99, *red)], schema)
    codes = P.pair_codes(one, two)
    assert {r.raster_id: r.code for r in codes.collect()} == dict(enumerate(cases)) | {99: "missing_band"}
    pixels = spark.createDataFrame([(i, 0, 0) for i in range(len(cases))], "raster_id long, row_idx long, col_idx long")
    assert [r.raster_id for r in P.admitted(pixels, codes).collect()] == [0]


def test_zone_counts_of_a_partition_add_up(spark):
    square = lambda x0, x1: [(x0, 0.0), (x1, 0.0), (x1, 8.0), (x0, 8.0), (x0, 0.0)]
    zones = spark.createDataFrame([(1, square(0.0, 3.2)), (2, square(3.2, 8.0)), (3, square(90.0, 91.0))], "zone_id long, ring array<struct<x:double,y:double>>")
    cells = spark.createDataFrame([(1, float(x) + 0.5, float(y) + 0.5, 1.0, x != y) for x in range(8) for y in range(8)], "raster_id long, x double, y double, value double, valid boolean")
    out = {r.zone_id: r for r in P.zonal_stats(cells, zones).collect()}
    assert out[1].zone_pixels + out[2].zone_pixels == 64
    assert out[1].valid_pixels + out[2].valid_pixels == 56
    assert out[3].code == "no_pixel_centres" and out[3].zone_pixels is None


def test_rings(spark):
    def row(points):
        return [[(float(x), float(y)) for x, y in points]]

    rings = [row([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]), row([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])]
    frame = spark.createDataFrame([r for r in rings], "ring array<struct<x:double,y:double>>")
    out = frame.select(geo.ring_area(F.col("ring")).alias("a"), geo.self_intersects(F.col("ring")).alias("s"), *(geo.inside(F.col("ring"), F.lit(x), F.lit(y)).alias(n) for n, x, y in (("mid", 1.0, 0.5), ("edge", 2.0, 1.0), ("out", 3.0, 1.0)))).collect()
    assert (out[0].a, out[0].s, out[0].mid, out[0].edge, out[0].out) == (4.0, False, True, True, False)
    assert out[1].s is True


def test_utm_against_a_known_point(spark):
    points = F.array(F.struct(F.lit(448251.8).alias("x"), F.lit(5411943.8).alias("y")))
    (p,) = spark.range(1).select(geo.utm_inverse(points, F.lit(31.0), F.lit(True)).alias("p")).first().p
    assert p.x == pytest.approx(2.2945, abs=1e-4) and p.y == pytest.approx(48.8583, abs=1e-4)


def labels(spark, manual, scene):
    return spark.createDataFrame(list(zip(manual, scene, strict=True)), "manual long, scl long").withColumn("window", F.lit(1))


def test_confusion_by_hand(spark):
    counts = C.confusion(labels(spark, [0, 1, 2, 3], [4, 8, 4, 3]), F.col("manual") > 0, F.col("scl").isin(3, 8), ["window"])
    row = C.ratios(counts).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (1, 0, 1, 2)
    assert (row.precision, row.recall, row.iou, row.balanced_accuracy) == (1.0, 0.666667, 0.666667, 0.833333)
    decided = C.decisions(counts, [0.6], ["window"]).first()
    assert (decided.true_fraction, decided.predicted_fraction, decided.outcome) == (0.75, 0.5, "false_accept")


def test_confusion_without_positives(spark):
    row = C.ratios(C.confusion(labels(spark, [0, 0], [4, 4]), F.col("manual") > 0, F.col("scl") == 8, ["window"])).first()
    assert (row.precision, row.recall, row.iou, row.balanced_accuracy, row.specificity) == (None, None, None, None, 1.0)


def test_published_cloud_counts(spark):
    counts = spark.createDataFrame([(1020884, 46137, 279175, 726452)], "tn long, fp long, fn long, tp long")
    row = C.micro(counts, []).first()
    assert (row.precision, row.recall, row.iou, row.specificity, row.balanced_accuracy) == (0.940283, 0.722387, 0.690699, 0.956761, 0.839574)


def test_micro_doesnt_depend_on_the_split(spark, data):
    from skyledger.plans.raster_queries import confusion_counts

    counts = confusion_counts(spark, data)
    halves = counts.withColumn("part", F.col("raster_id") % 2).groupBy("part").agg(*(F.sum(c).alias(c) for c in C.COUNTS))
    assert C.micro(counts, []).first() == C.micro(halves, []).first()


def test_change_classes(spark):
    cells = [("a", False, False)] * 10 + [("b", False, True)] + [("b", False, False)] * 9 + [("c", True, False)] * 8 + [("c", False, True)] * 2
    out = {r.k: r for r in C.change_truth(spark.createDataFrame(cells, "k string, before boolean, after boolean"), ["k"]).collect()}
    assert (out["a"].change_class, out["a"].direction) == ("none", "none")
    assert (out["b"].change_class, out["b"].direction) == ("minor", "construction")
    assert (out["c"].change_class, out["c"].direction) == ("major", "demolition")


@pytest.mark.parametrize("name", ["pixels_in_zones", "best_pairs", "scope_usage", "zonal_stats", "masked_ndvi_summary"])
def test_no_nested_loops_and_no_python(spark, data, name):
    from skyledger.plans import registry

    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "Arrow" not in plan


def test_runs_against_the_ring_test(spark):
    """Every pixel centre of random and of touching rings, on grids that go down and up."""
    r = random.Random(8)
    rings = [[(0.5, 0.5), (6.5, 0.5), (6.5, 5.5), (0.5, 5.5)], [(1.0, 1.0), (9.0, 4.0), (3.0, 9.5)], [(2.5, 2.5), (5.5, 2.5), (5.5, 4.5), (9.5, 4.5), (9.5, 8.5), (2.5, 8.5)], [(-5.0, -5.0), (-1.0, -5.0), (-3.0, -2.0)], [(4.5, -3.0), (7.5, 3.5), (4.5, 20.0), (1.5, 3.5)]]
    for _ in range(40):
        corners = sorted(((r.uniform(-2, 14), r.uniform(-2, 12)) for _ in range(r.randint(3, 9))), key=lambda p: math.atan2(p[1] - 5, p[0] - 6))
        rings.append(corners)
    zones = spark.createDataFrame([(i, [*ring, ring[0]]) for i, ring in enumerate(rings)], "zone_id long, ring array<struct<x:double,y:double>>")
    grids = spark.createDataFrame([(1, 1.0, 0.0, 1.0, 0.0, 12, 10), (2, 0.5, 1.0, -0.5, 9.0, 15, 16)], "grid_id long, a double, c double, e double, f double, width long, height long")
    found = T.zone_runs(zones, grids)
    rows = found.collect()
    assert all(0 <= x.first <= x.last for x in rows) and len({(x.grid_id, x.zone_id, x.row_idx, x.first) for x in rows}) == len(rows)
    cells = [(g, row, col, c + a * (col + 0.5), f + e * (row + 0.5)) for g, a, c, e, f, w, h in grids.collect() for row in range(h) for col in range(w)]
    points = spark.createDataFrame(cells, "grid_id long, row_idx long, col_idx long, x double, y double")
    want = {tuple(x) for x in P.pixels_in_zones(points, zones).select("grid_id", "zone_id", "row_idx", "col_idx").collect()}
    filled = {(x.grid_id, x.zone_id, x.row_idx, col) for x in rows for col in range(x.first, x.last + 1)}
    assert filled == want and len(want) > 500


def tiled(pixels, value, size):
    return P.to_tiles(pixels, value, size=size)


@pytest.mark.parametrize(("src", "dst", "target", "size"), [((20.0, 0.0, -20.0, 0.0), (10.0, 5.0, -10.0, -5.0), (26, 22), 4), ((10.0, 0.0, -10.0, 0.0), (25.0, -40.0, -25.0, 30.0), (9, 8), 5), ((10.0, 0.0, -10.0, 0.0), (10.0, 0.0, -10.0, 0.0), (13, 11), 4)])
def test_tiles_resample_as_pixels(spark, src, dst, target, size):
    """Tiles with a halo give what joins of pixels give, at edges, holes and outside."""
    r = random.Random(2)
    cells = [(k, row, col, float(r.randrange(9)), r.random() < 0.9) for k in (1, 2) for row in range(11) for col in range(13)]
    pixels = spark.createDataFrame(cells, "raster_id long, row_idx long, col_idx long, value double, mask boolean")
    wanted = spark.createDataFrame([(k, row, col) for k in (1, 2) for row in range(target[1]) for col in range(target[0])], "raster_id long, row_idx long, col_idx long")
    tiles = tiled(pixels, "value", size)
    args = {"src": src, "dst": dst, "shape": (13, 11), "target": target, "size": size}
    smooth = P.resample_bilinear(pixels.withColumnRenamed("mask", "valid"), wanted, src=src, dst=dst, width=13, height=11)
    near = P.resample_nearest(pixels.withColumnRenamed("value", "code"), wanted, src=src, dst=dst)
    for made, right, column in ((T.resample(tiles, **args), smooth, "value"), (T.resample(tiles, **args, method="nearest"), near, "code")):
        one = {(x.raster_id, x.row_idx, x.col_idx): (x.value, x.valid) for x in T.from_tiles(made, target[0], size=size).collect()}
        two = {(x.raster_id, x.row_idx, x.col_idx): (x[column], x.valid) for x in right.collect()}
        assert one.keys() == two.keys() and all(one[k][1] == two[k][1] and one[k][0] == pytest.approx(two[k][0], abs=1e-6) for k in two)


def test_window_hashes(spark):
    cells = [(k, row, col, float(row * 7 + col), (row + col) % 5 > 0) for k in range(6) for row in range(9) for col in range(10)]
    pixels = spark.createDataFrame(cells, "raster_id long, row_idx long, col_idx long, value double, mask boolean")
    whole = tiled(pixels, "value", 4)
    assert T.differing_tiles(whole, whole).count() == 0
    bad = pixels.withColumn("value", F.when((F.col("raster_id") == 3) & (F.col("row_idx") == 5) & (F.col("col_idx") == 9), -1.0).otherwise(F.col("value"))).where("NOT (raster_id = 4 AND row_idx >= 8)")
    windows = tiled(bad, "value", 4)
    assert sorted(tuple(x) for x in T.differing_tiles(whole, windows).collect()) == [(3, 1, 2), (4, 2, 0), (4, 2, 1), (4, 2, 2)]
    found = {(x.raster_id, x.row_idx, x.col_idx, x.value, x.side) for x in T.verify_windows(whole, windows, 10, size=4).collect()}
    assert found == {(3, 5, 9, 44.0, "missing"), (3, 5, 9, -1.0, "unexpected")} | {(4, 8, col, float(56 + col), "missing") for col in range(10) if (8 + col) % 5}


def test_meeting_against_all_pairs(spark):
    """Boxes and intervals of every size, points, and ends that only touch."""
    r = random.Random(1)

    def side(n, kind):
        out = []
        for i in range(n):
            w, h, t = (r.choice([0, 0.01, 0.5, 3, 40, 200]) * r.random() for _ in range(3))
            x, y, s = r.choice([r.uniform(-180, 170), float(r.randrange(-5, 5))]), r.uniform(-80, 80), r.choice([0, r.randrange(0, 10**13)])
            out.append((i, x, x + w, y, y + h, s, s + int(t * 1e11), r.randrange(2)))
        return [*out, (n, 0.0, -1.0, 0.0, 1.0, 0, 1, 0), (n + 1, None, 1.0, 0.0, 1.0, 0, 1, 0)], spark.createDataFrame(out + [(n, 0.0, -1.0, 0.0, 1.0, 0, 1, 0), (n + 1, None, 1.0, 0.0, 1.0, 0, 1, 0)], ", ".join(f"{c} {k}" for c, k in zip([f"{kind}{c}" for c in ("id", "x0", "x1", "y0", "y1", "t0", "t1")] + ["p"], ["long", *["double"] * 4, *["long"] * 3], strict=True)))

    (rows_a, a), (rows_b, b) = side(150, "a"), side(160, "b")
    met = ranges.meeting(a, b, [(ranges.DEGREES, 2, [("ax0", "ax1", "bx0", "bx1"), ("ay0", "ay1", "by0", "by1")]), (ranges.HOUR, 8, [("at0", "at1", "bt0", "bt1")])], on=("p",))
    ok = lambda v: v[1] is not None and v[1] <= v[2]
    want = sorted((u[0], v[0]) for u in rows_a for v in rows_b if ok(u) and ok(v) and u[7] == v[7] and all(u[k] <= v[k + 1] and v[k] <= u[k + 1] for k in (1, 3, 5)))
    assert sorted((x.aid, x.bid) for x in met.select("aid", "bid").collect()) == want and len(want) > 50


def test_counts_within(spark):
    r = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    at = lambda: start + datetime.timedelta(minutes=r.randrange(0, 600))
    points, spans = [(at(),) for _ in range(200)], [(i, at(), at()) for i in range(100)]
    found = {x.k: x.n for x in ranges.count_within(spark.createDataFrame([*points, (None,)], "at timestamp_ntz"), spark.createDataFrame(spans, "k long, a timestamp_ntz, b timestamp_ntz"), "k", "at", "a", "b").collect()}
    assert found == {i: sum(a <= p <= b for (p,) in points) for i, a, b in spans if a <= b}
