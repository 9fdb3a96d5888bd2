import datetime as dt

from pyspark.sql import functions as F

from umbraline.plans import pipelines
from tests_support import flat_pack


def test_score_rank_and_advise(spark):
    # Two parallel streets near the grid origin point; a wall runs just south of the second one.
    cells, grids, lonlat = flat_pack(spark, wall_row=22)
    a = [lonlat(40, 60), lonlat(260, 60)]   # open street
    b = [lonlat(40, 96), lonlat(260, 96)]   # shaded by the wall at noon
    rows = [("a", i, *p) for i, p in enumerate(a)] + [("b", i, *p) for i, p in enumerate(b)]
    vertices = spark.createDataFrame(rows, "route_id string, seq int, lon double, lat double")
    directions = spark.createDataFrame([("a", 0, "Walk on.", 0, 1)], "route_id string, dir_idx int, instruction string, begin_idx int, end_idx int")
    routes = spark.createDataFrame([(1, "a", 0, "g", 200.0, 220.0), (1, "b", 1, "g", 210.0, 220.0)], "request_id int, route_id string, route_pos int, area_id string, duration_s double, distance_m double")
    noon = int(dt.datetime(2026, 6, 21, 12, tzinfo=dt.timezone.utc).timestamp() * 1000)
    requests = spark.createDataFrame([(1, noon, 2, 10, "standard", "worker")], "request_id int, departure_ms bigint, journey_count int, repeat_min int, pace string, profile string")
    scores = pipelines.score_requests(vertices, directions, routes, requests, cells, grids, [0, 15])
    got = {(r.route_id, r.offset_min): r for r in scores.collect()}
    assert len(got) == 4
    for r in got.values():
        assert r.journey_count == 2 and r.best_s <= r.sun_s + 1e-9 <= r.worst_s + 1e-6 and r.coverage_percent == 100
    assert got[("a", 0)].sun_s > 390 and got[("b", 0)].sun_s < 100
    access = spark.createDataFrame([("a", True), ("b", True)], "route_id string, avoids_barriers boolean")
    step = spark.createDataFrame([(1, False)], "request_id int, step_free boolean")
    ranked = {r.route_id: r.labels for r in pipelines.rank_requests(scores, access, step).collect()}
    assert ranked["b"] == ["recommended", "least-sun"] and ranked["a"] == ["fastest"]
    tip = pipelines.advise_requests(scores, access, step).first()
    assert tip.route_id == "b" and tip.scanned == 2 and tip.withheld_reason == "insufficient-saving"


def test_shadow_frames_and_prediction(spark):
    cells, grids, lonlat = flat_pack(spark, wall_row=22)
    noon = int(dt.datetime(2026, 6, 21, 12, tzinfo=dt.timezone.utc).timestamp() * 1000)
    lon, lat = lonlat(150, 100)
    moments = spark.createDataFrame([(1, "g", noon, lon, lat), (2, "g", noon - 12 * 3_600_000, lon, lat)], "frame_id int, area_id string, epoch_ms bigint, lon double, lat double")
    states, summary = pipelines.shadow_frames(cells, grids, moments)
    assert states.filter("frame_id = 1 AND state = 'certain'").count() > 75 and states.filter("frame_id = 2").count() == 0
    assert {r.frame_id: r.daylight for r in summary.collect()} == {1: True, 2: False}
    p = lonlat(150, 96)
    seen = spark.createDataFrame([("o", "g", p[0], p[1], "2026-06-21T13:00")], "observation_id string, pilot_area string, longitude double, latitude double, observed_london_datetime string")
    assert pipelines.predict_at_observations(seen, cells, grids).first().exposure == "shade"


def test_build_grid(spark):
    pixels = spark.range(100).select(F.lit("g").alias("area_id"), (F.col("id") % 10).cast("int").alias("px"), F.floor(F.col("id") / 10).cast("int").alias("py"),
                                     F.when(F.col("id") == 0, -9999.0).otherwise(12.0).alias("dsm"), F.lit(10.0).alias("dtm"), F.lit(-9999.0).alias("nodata_dsm"), F.lit(-9999.0).alias("nodata_dtm"))
    cells, summary = pipelines.build_grid(pixels)
    s = summary.first()
    assert (s.width, s.height, s.coverage_percent, s.any_coverage_percent) == (3, 3, 88.9, 100.0)
    rows = {(r.x, r.y): r for r in cells.collect()}
    assert rows[(0, 0)].validity == 239 and rows[(2, 2)].pixels == 4 and rows[(1, 1)].height_steps == 4
