"""Routes of one vertex, very long routes, and ties."""

import random

from umbraline.operators import context, geometry, progress, scoring


def test_a_long_route_keeps_every_row(spark):
    n = 50_000
    df = spark.range(n).selectExpr("CAST(1 AS BIGINT) AS route_id", "CAST(id AS INT) AS seq", "CAST(id * 4 AS DOUBLE) AS x", "0D AS y")
    segs = geometry.segments(df, x="x", y="y", metric="planar")
    assert segs.count() == n - 1
    last = segs.orderBy("seg_idx", ascending=False).first()
    assert (last.seg_idx, last.start_m, last.total_m) == (n - 2, 4.0 * (n - 2), 4.0 * (n - 1))
    assert geometry.densify(segs).count() == n - 1


def test_lone_vertices_have_amenities(spark):
    df = spark.createDataFrame([("lone", 0, 10.0, 10.0), ("pair", 0, 0.0, 0.0), ("pair", 1, 5.0, 0.0)], "route_id string, seq int, x double, y double")
    segs = geometry.segments(df, x="x", y="y", metric="planar", lone=True).selectExpr("*", "1 AS area_id")
    assert geometry.segments(df, x="x", y="y", metric="planar").count() == 1
    features = spark.createDataFrame([(1, "bench", 11.0, 10.0)], "area_id int, name string, px double, py double")
    got = {r.route_id: (r.raw_m, r.progress_m, r.progress_percent) for r in context.nearby_features(segs, features, 25.0, "planar").collect()}
    assert got["lone"] == (1.0, 0.0, 0.0) and set(got) == {"lone", "pair"}


def test_journeys_without_samples_have_a_score(spark):
    exposed = spark.createDataFrame(
        [("a", 0, 9.0, 9.0, True, True, 0.5, False, True, False, 0)],
        "route_id string, journey int, walk_s double, sample_s double, daylight boolean, covered boolean, shade_fraction double, guaranteed boolean, possible boolean, low_sun boolean, reason_bits int")
    journeys = spark.createDataFrame([("a", 0, 9.0), ("lone", 0, 4.0)], "route_id string, journey int, walk_s double")
    out = scoring.with_unsampled(scoring.score_journeys(exposed, ["route_id", "journey", "walk_s"]), journeys, ["route_id", "journey"])
    got = {r.route_id: r for r in out.collect()}
    assert got["a"].sun_s == 4.5 and got["a"].walk_s == 9.0
    lone = got["lone"]
    assert (lone.walk_s, lone.daylight_s, lone.sun_s, lone.worst_s, lone.shade_percent, lone.coverage_percent, lone.is_daylight, lone.limited) == (4.0, 0.0, 0.0, 0.0, None, 100.0, False, False)
    assert {r.route_id: r.duration_s for r in scoring.score_schedules(out, ["route_id"]).collect()} == {"a": 9.0, "lone": 4.0}


def test_first_segment_wins_ties_whatever_the_row_order(spark):
    """A route that returns along itself passes the place twice at the same distance."""
    rows = [("r", 0, 0.0, 0.0, 100.0, 0.0, 100.0, 0.0, 200.0), ("r", 1, 100.0, 0.0, 0.0, 0.0, 100.0, 100.0, 200.0)]
    shape = "route_id string, seg_idx int, x1 double, y1 double, x2 double, y2 double, length_m double, start_m double, total_m double"
    features = spark.createDataFrame([(1, "tap", 25.0, 5.0)], "area_id int, name string, px double, py double")
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        segs = spark.createDataFrame(rows, shape).repartition(2)
        got = context.nearby_features(segs.selectExpr("*", "1 AS area_id"), features, 25.0, "planar").first()
        assert got.progress_m == 30.0
        spots = spark.createDataFrame([(1, "r", 0.5, 0.0)], "position_id int, route_id string, lon double, lat double")
        flat = spark.createDataFrame([(r[0], r[1], r[2] / 100, 0.0, r[4] / 100, 0.0, *r[6:]) for r in rows], shape)
        routes = spark.createDataFrame([("r", 200.0)], "route_id string, distance_m double")
        assert progress.match_positions(spots, flat, routes).first().along_m == 50.0


def test_cell_numbers_of_a_national_grid_fit(spark):
    from umbraline.functions.geo import with_cell_index

    df = spark.createDataFrame([(575_990.0, 10.0, 0.0, 661_000.0, 4.0, 144_000, 165_250)], "easting double, northing double, west double, north double, res_m double, width int, height int")
    r = with_cell_index(df).first()
    assert (r.x, r.y, r.cell_no) == (143_997, 165_247, 165_247 * 144_000 + 143_997)


def test_rays_work_with_either_type_of_cell_number(spark):
    from pyspark.sql import functions as F
    from tests_support import NORTH, WEST, flat_pack

    from umbraline.operators import rays

    cells, grids, _ = flat_pack(spark, 30)
    points = spark.createDataFrame([("g", WEST + 150.0, NORTH - 4 * 30, 180.0, 30.0), ("g", WEST - 10.0, NORTH, 180.0, 30.0)],
                                   "area_id string, easting double, northing double, azimuth_deg double, altitude_deg double")
    seen = [sorted(map(str, rays.classify_points(points, cells.withColumn("cell_no", F.col("cell_no").cast(kind)), grids).collect())) for kind in ("int", "bigint")]
    assert seen[0] == seen[1] and len(seen[0]) == 2


def test_segments_of_any_length_meet_what_is_near(spark):
    import math

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = []
    for n in range(120):
        reach = rng.choice([0.0, 5.0, 40.0, 170.0, 400.0, 3_000.0])
        x, y = rng.uniform(-900, 900), rng.uniform(-900, 900)
        rows.append((f"r{n}", 0, x, y, x + rng.uniform(-reach, reach), y + rng.uniform(-reach, reach), 1.0, 0.0, 1.0))
    shape = "route_id string, seg_idx int, x1 double, y1 double, x2 double, y2 double, length_m double, start_m double, total_m double"
    spots = [(1, k, rng.uniform(-1_000, 1_000), rng.uniform(-1_000, 1_000)) for k in range(150)]
    segs = spark.createDataFrame(rows, shape).selectExpr("*", "1 AS area_id")
    got = {(r.route_id, r.feature_id) for r in context.nearby_features(segs, spark.createDataFrame(spots, "area_id int, feature_id int, px double, py double"), 25.0, "planar").collect()}

    def away(a, p):
        dx, dy = a[4] - a[2], a[5] - a[3]
        t = max(0, min(1, ((p[2] - a[2]) * dx + (p[3] - a[3]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(a[2] + t * dx - p[2], a[3] + t * dy - p[3])

    assert got == {(a[0], p[1]) for a in rows for p in spots if away(a, p) <= 25.0}
    # A box that reaches over many narrow bins is not listed in all of them.
    listed = context.in_bins(segs, F.lit(25.0), F.lit(25.0), 60.0, 60.0).groupBy("route_id").agg(F.count("*").alias("n"), F.first(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))).alias("m"))
    assert max(r.n for r in listed.collect() if r.m <= 430) <= 4
