"""Outlines in bins of their own size: holes, far and large polygons, areas without buildings."""

import random

from pyspark.sql import functions as F

import umbraline.catalog as catalog
from umbraline.operators import footprints, outlines

EDGES = "area_id int, polygon_id int, ring_no int, x1 double, y1 double, x2 double, y2 double"


def square(polygon, ring, low, high):
    c = [(low, low), (high, low), (high, high), (low, high)]
    return [(1, polygon, ring, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(c, c[1:] + c[:1], strict=True)]


def test_large_outline_lies_in_few_bins_and_holds_its_points(spark):
    edges = spark.createDataFrame(square(1, 0, 0, 5000) + square(1, 1, 100, 200) + square(2, 0, 150, 160), EDGES)
    listed = {r[0]: r[1] for r in outlines.binned(outlines.outline_rows(edges)).groupBy("polygon_id").count().collect()}
    assert all(n <= 4 for n in listed.values())
    points = spark.createDataFrame([(1, 1, 50.0, 50.0), (2, 1, 155.0, 155.0), (3, 1, 120.0, 120.0), (4, 1, 0.0, 2500.0), (5, 1, -1.0, 0.0), (6, 1, 100.0, 150.0)],
                                   "id int, area_id int, px double, py double")
    got = {(r["id"], r["polygon_id"]) for r in outlines.points_in_polygons(points, edges, "id").collect()}
    assert got == {(1, 1), (2, 2), (4, 1)}  # in a hole and on its border: outside; on the outer border: inside


def test_rays_meet_the_nearest_side_once_for_every_outline(spark):
    edges = spark.createDataFrame(square(1, 0, 10, 12) + square(2, 0, 30, 1030) + square(3, 0, -5, 5), EDGES)
    rays = spark.createDataFrame([(1, 1, 0.0, 0.0, 45.0, 1000.0), (2, 1, 0.0, 0.0, 45.0, 20.0), (3, 1, 0.0, 0.0, 225.0, 1000.0)],
                                 "id int, area_id int, px double, py double, azimuth_deg double, reach_m double")
    hits = outlines.ray_hits(rays, edges, ["id"], []).groupBy("id", "polygon_id").agg(F.round(F.min("distance_m"), 6).alias("d")).collect()
    root = 2 ** 0.5
    assert {(r[0], r[1]): r[2] for r in hits} == {
        (1, 1): round(10 * root, 6), (1, 2): round(30 * root, 6), (1, 3): 0.0, (2, 1): round(10 * root, 6), (2, 3): 0.0, (3, 3): 0.0}


def test_coverage_follows_the_area_and_routes_without_pieces_stay(spark):
    blocks = footprints.footprint_heights(spark.createDataFrame([(1, 7, 10.0, None)], "area_id int, polygon_id int, height_m double, levels double"))
    edges = spark.createDataFrame([r[:1] + (7,) + r[2:] for r in square(7, 0, 5, 9)], EDGES)
    points = spark.createDataFrame([(1, 1, 1, 7.0, 0.0, 0.0, 45.0, 12.0), (2, 2, 2, 7.0, 0.0, 0.0, 45.0, 12.0)],
                                   "point_id int, route_id int, area_id int, px double, py double, azimuth_deg double, altitude_deg double, piece_m double")
    shaded = footprints.point_shade(points, edges, blocks)
    routes = spark.createDataFrame([(1,), (2,), (3,)], "route_id int")
    got = {r["route_id"]: (r["distance_m"], r["sun_s"], r["shade_percent"], r["coverage_percent"]) for r in footprints.route_score(shaded, ["route_id"], routes=routes).collect()}
    assert got == {1: (12.0, 0.0, 100.0, 100.0), 2: (12.0, 10.0, 0.0, 0.0), 3: (0.0, 0.0, None, 0.0)}


def test_points_cut_from_lines_are_shaded_as_points(spark):
    """Short and long rays, lines over several tiles, rows that come twice, courtyards, areas without buildings, nights."""
    rng = random.Random(5)
    blocks, sides = [], []
    for k in range(150):
        x, y, w, d = rng.uniform(-400, 700), rng.uniform(-500, 500), rng.uniform(3, 40), rng.uniform(3, 40)
        blocks.append((1, k, rng.choice([None, 9.0, 30.0]), rng.choice([None, 2.0])))
        rings = [[(x, y), (x + w, y), (x + w, y + d), (x, y + d)]]
        if k % 7 == 0:
            rings.append([(x + w / 4, y + d / 4), (x + w / 2, y + d / 4), (x + w / 2, y + d / 2)])
        sides += [(1, k, no, *a, *b) for no, ring in enumerate(rings) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    far = lambda: rng.uniform(-450, 650)
    lines = [(i, rng.choice([1, 1, 1, 2]), x := far(), y := far(), x + rng.uniform(-300, 300), y + rng.uniform(-300, 300)) for i in range(25)]
    lines = spark.createDataFrame([*lines, lines[3], lines[4], (90, None, 0.0, 0.0, 5.0, 5.0)], "line int, area_id int, x1 double, y1 double, x2 double, y2 double")

    def cut(df, along):
        f = F.col("no") / 9.0
        return df.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
            "line", "no", *along, (F.col("x1") + (F.col("x2") - F.col("x1")) * f).alias("px"), (F.col("y1") + (F.col("y2") - F.col("y1")) * f).alias("py"),
            (F.col("no") * 37.0 + 0.5).alias("azimuth_deg"), F.when(F.col("no") == 4, -1.0).when(F.col("no") % 3 == 0, 2.5).otherwise(20.0 + F.col("no")).alias("altitude_deg"))

    buildings = footprints.footprint_heights(spark.createDataFrame(blocks, "area_id int, polygon_id int, height_m double, levels double"))
    edges = spark.createDataFrame(sides, EDGES)
    names = ["line", "no", "daylight", "covered", *(F.round(c, 9).alias(c) for c in ("direct_probability", "shade_probability", "best_direct", "worst_direct", "nearest_m")), "occluders"]
    points = cut(lines, ["area_id"]).withColumn("point_id", F.struct("line", "no"))
    for most in (None, 60.0):
        want = footprints.point_shade(points, edges, buildings, max_shadow_m=most).select(*names)
        got = footprints.cut_shade(lines, cut, edges, buildings, ["line", "no"], [], "line", {}, max_shadow_m=most).select(*names)
        seen = sorted(map(str, got.collect()))
        assert seen == sorted(map(str, want.collect())) and len(seen) == 280


def test_rays_from_routes_are_not_shuffled(spark):
    """Samples are cut in the tile that holds what they meet; only rays longer than its halo travel."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["footprint_route_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "point_id" in line or "_power" in line]
