"""Labels, advice, profiles, progress, calibration and paths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbraline.functions.geo import MEAN_RADIUS_M
from umbraline.functions.lookups import SITE_TYPES
from umbraline.operators import advice, calibration, context, labels, paths, profile, progress

SCORE = ("request_id int, route_pos int, route_id string, profile string, journey_count int, duration_s double, sun_s double, best_s double, "
         "worst_s double, is_daylight boolean, coverage_percent double, low_sun boolean, avoids_barriers boolean")


def scores(spark, rows, profile_="vulnerable", day=True, coverage=100.0, low=False, barriers=()):
    data = [(1, i, r[0], profile_, 1, float(r[1]), float(r[2]), float(r[3]), float(r[4]), day, coverage, low, r[0] not in barriers) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCORE)


def tagged(df):
    return {r.route_id: (r.labels, r.reason_code) for r in df.collect()}


def test_clear_saving_is_recommended(spark):
    df = scores(spark, [("fast", 600, 500, 480, 520), ("cool", 660, 200, 180, 220)])
    got = tagged(labels.label_routes(df))
    assert got["cool"] == (["recommended", "least-sun"], "lower-sun") and got["fast"] == (["fastest"], None)


def test_overlap_detour_and_night(spark):
    got = tagged(labels.label_routes(scores(spark, [("fast", 600, 500, 200, 600), ("cool", 660, 300, 100, 400)])))
    assert got["fast"] == (["recommended", "fastest"], "ranges-overlap") and got["cool"][0] == ["lowest-estimate"]
    got = tagged(labels.label_routes(scores(spark, [("fast", 600, 500, 480, 520), ("far", 800, 100, 90, 110)])))
    assert got["fast"] == (["recommended", "fastest"], "small-saving") and got["far"][0] == ["least-sun"]
    got = tagged(labels.label_routes(scores(spark, [("fast", 600, 0, 0, 0), ("b", 660, 0, 0, 0)], day=False)))
    assert got["fast"][1] == "no-daylight" and got["b"][0] == []
    got = tagged(labels.label_routes(scores(spark, [("fast", 600, 500, 480, 520), ("a", 640, 200, 100, 260), ("b", 620, 220, 120, 280)])))
    assert got["b"] == (["recommended"], "several-lower")


def test_guard(spark):
    extra = ["coverage_percent", "low_sun", "avoids_barriers"]
    rows = [("fast", 600, 500, 480, 520), ("cool", 660, 200, 180, 220)]
    run = lambda df, step: tagged(labels.apply_access_guard(labels.label_routes(df, extra=extra).withColumn("step_free", F.lit(step))))
    assert run(scores(spark, rows), False)["cool"][0] == ["recommended", "least-sun"]
    assert run(scores(spark, rows, coverage=89.9), False)["cool"] == (["least-sun"], None)
    assert run(scores(spark, rows, low=True), True)["cool"] == (["least-sun"], None)
    assert run(scores(spark, rows, barriers=("cool",)), True)["fast"] == (["recommended", "fastest"], "access-fastest")
    assert run(scores(spark, rows, barriers=("cool", "fast")), True)["fast"] == (["fastest"], None)
    assert run(scores(spark, rows), True)["cool"] == (["recommended", "least-sun"], "access-lower-sun")


def options(spark, rows):
    data = [(1, o, 0, "r", 600.0, float(s), float(b), float(w), d, c, low) for o, s, b, w, d, c, low in rows]
    return spark.createDataFrame(data, "request_id int, offset_min int, route_pos int, route_id string, walk_s double, sun_s double, best_s double, worst_s double, is_daylight boolean, coverage_percent double, low_sun boolean")


@pytest.mark.parametrize("rows, reason, best", [
    ([(0, 300, 280, 320, True, 100.0, False), (15, 100, 90, 120, True, 100.0, False)], None, 15),
    ([(0, 300, 280, 320, True, 100.0, False), (15, 250, 240, 260, True, 100.0, False)], "insufficient-saving", 15),
    ([(0, 300, 100, 320, True, 100.0, False), (15, 100, 90, 120, True, 100.0, False)], "sensitivity-overlap", 15),
    ([(0, 300, 280, 320, True, 70.0, False), (15, 100, 90, 120, True, 100.0, False)], "low-model-coverage", 15),
    ([(0, 300, 280, 320, True, 100.0, False), (15, 100, 90, 120, True, 100.0, True)], "low-sun-confidence", 15),
    ([(0, 0, 0, 0, False, 100.0, False), (15, 100, 90, 120, True, 100.0, False)], "no-daylight", 0),
    ([(0, 300, 280, 320, True, 100.0, False), (15, 0, 0, 0, False, 100.0, False)], "insufficient-saving", 0),
])
def test_advice(spark, rows, reason, best):
    got = advice.departure_advice(options(spark, rows)).first()
    assert got.withheld_reason == reason and got.offset_min == best and got.recommended == (reason is None)


def test_advice_scan(spark):
    assert len(advice.slot_minutes()) == 9
    with pytest.raises(ValueError):
        advice.slot_minutes(10, 0)
    asked = spark.createDataFrame([(1,), (2,)], "request_id int")
    full = advice.with_empty_requests(advice.departure_advice(options(spark, [(0, 1, 1, 1, True, 100.0, False)])), asked).filter("request_id = 2").first()
    assert (full.withheld_reason, full.confidence, full.recommended) == ("no-routes", "unavailable", False)


def test_profile_and_coverage(spark):
    df = spark.createDataFrame([(1, i, e, 10.0) for i, e in enumerate(["sun", "sun", "shade", "odd", "unknown"])], "route_id int, sample_idx int, exposure string, length_m double")
    runs = profile.exposure_runs(df.withColumn("route_m", F.lit(60.0)), ["route_id"], supplied="route_m").orderBy("run").collect()
    assert [(r.exposure, r.start_m, r.end_m) for r in runs] == [("sun", 0, 20), ("shade", 20, 30), ("unknown", 30, 60)]
    total = profile.exposure_totals(profile.exposure_runs(df, ["route_id"]), ["route_id"]).first()
    assert (total.sun_percent, total.unknown_m, total.night_percent) == (40, 20, 0)
    spans = spark.createDataFrame([(1, "sun", 10.0, 20.0, 50.0), (1, "shade", 15.0, 30.0, 50.0), (1, "shade", 30.05, 40.0, 50.0), (1, "sun", 40.0, 40.005, 50.0)],
                                  "route_id int, exposure string, start_m double, end_m double, route_m double")
    got = [(r.exposure, r.start_m, r.end_m) for r in profile.complete_coverage(spans, ["route_id"]).orderBy("span_no").collect()]
    assert got[:2] == [("unknown", 0, 10), ("sun", 10, 20)] and got[-1] == ("unknown", 40, 50)
    assert sum(b - a for _, a, b in got) == pytest.approx(50)
    assert profile.longest_sun_run(df, ["route_id"]).first().longest_sun_m == 20


def test_progress_at_the_end(spark):
    spans = spark.createDataFrame([(1, 0, "sun", 0.0, 50.0), (1, 1, "shade", 50.0, 100.0)], "route_id int, span_no bigint, exposure string, start_m double, end_m double")
    at = spark.createDataFrame([(1, 1, 10.0, 100.0), (2, 1, 100.0, 100.0), (3, 1, -4.0, 100.0)], "id int, route_id int, distance_m double, route_m double")
    got = {r.id: (r.exposure, r.exposure_left_m, r.next_exposure) for r in progress.upcoming_exposure(at, spans).collect()}
    assert got == {1: ("sun", 40.0, "shade"), 2: ("unknown", 0.0, None), 3: ("sun", 50.0, "shade")}


def test_long_spans_are_not_copied(spark):
    """A span as long as ten thousand million stretches is one row; positions far from its end still meet it."""
    far = 5e12
    spans = spark.createDataFrame([(1, 0, "sun", 0.0, 10.0), (1, 1, "shade", 10.0, 1_700.0), (1, 2, "sun", 1_700.0, far), (1, 3, "night", far, 2 * far), (2, 0, "sun", 0.0, 700.0)],
                                  "route_id int, span_no bigint, exposure string, start_m double, end_m double")
    at = spark.createDataFrame([(1, 1, 9.995, far * 2), (2, 1, 600.0, far * 2), (3, 1, 1_699.995, far * 2), (4, 1, far / 2, far * 2), (5, 1, far + 1, far * 2), (6, 2, 699.0, 900.0), (7, 2, 800.0, 900.0), (8, 3, 1.0, 9.0)],
                               "id int, route_id int, distance_m double, route_m double")
    got = {r.id: (r.exposure, round(r.exposure_left_m, 3), r.next_exposure) for r in progress.upcoming_exposure(at, spans).collect()}
    assert got == {1: ("shade", 1_690.005, "sun"), 2: ("shade", 1_100.0, "sun"), 3: ("sun", far - 1_699.995, "night"), 4: ("sun", far / 2, "night"), 5: ("night", far - 1, None),
                   6: ("sun", 1.0, None), 7: ("unknown", 100.0, None), 8: ("unknown", 8.0, None)}


def field_rows(spark, change=None):
    rows, n = [], 0
    for area in ("a", "b"):
        for p in range(6):
            for hour in (9, 12, 16):
                n += 1
                rows.append({"observation_id": f"o{n}", "area": area, "point_id": f"p{p}", "site_type": SITE_TYPES[p], "weather": "clear-direct-sun", "local_hour": hour, "predicted": "sun",
                             "observed": "sun", "coordinate_source": "manual", "gps_accuracy_m": None, "lat": 51.5, "lon": -0.1, "protocol_version": "p", "model_version": "m",
                             "data_pack_version": "d", "data_pack_fingerprint": "f" + area})
    if change:
        change(rows)
    schema = "observation_id string, area string, point_id string, site_type string, weather string, local_hour int, predicted string, observed string, coordinate_source string, gps_accuracy_m double, lat double, lon double, protocol_version string, model_version string, data_pack_version string, data_pack_fingerprint string"
    names = [c.strip().split()[0] for c in schema.split(",")]
    plan = calibration.Plan("p", "m", "d", {"a": "fa", "b": "fb"}, SITE_TYPES)
    marked = calibration.mark_observations(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema), plan)
    return marked, plan


def test_full_fixed_point_set_passes(spark):
    gate = calibration.calibration_gate(*field_rows(spark)).first()
    assert (gate.status, gate.gate_met, gate.eligible, gate.agreement_percent, gate.failures, gate.can_claim_accuracy) == ("fixed-point-thresholds-met", True, 36, 100, [], False)


@pytest.mark.parametrize("change, status, code", [
    (lambda rows: rows[0].update(weather="overcast"), "insufficient-evidence", "minimum-total-eligible-observations"),
    (lambda rows: rows[0].update(lat=51.5004), "insufficient-evidence", "a:point-repeat-distance"),
    (lambda rows: [r.update(observed="shade") for r in rows[:9]], "thresholds-not-met", "minimum-overall-classification-agreement"),
    (lambda rows: [r.update(predicted="unknown") for r in rows[:5]], "thresholds-not-met", "maximum-unclassified-prediction-rate"),
    (lambda rows: rows[0].update(site_type="tree-canopy"), "invalid", None),
    (lambda rows: rows.clear(), "no-observations", "minimum-total-eligible-observations"),
])
def test_gate_failures(spark, change, status, code):
    gate = calibration.calibration_gate(*field_rows(spark, change)).first()
    assert gate.status == status and (code is None or code in gate.failures)


def test_spread_decision_matches_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for p in range(40):
        scale = rng.choice([5e-5, 1.2e-4, 1.6e-4, 3e-4])
        rows += [("a", p, 51.5 + rng.uniform(0, scale), -0.1 + rng.uniform(0, scale)) for _ in range(12)]
    rows = [(a, p, round(x, 7), round(y, 7)) for a, p, x, y in rows]
    got = {r.point_id: r.spread_over for r in calibration.wide_points(spark.createDataFrame(rows, "area string, point_id int, lat double, lon double"), 25).collect()}
    import math
    def dist(a, b):
        dp, dl = math.radians(b[2] - a[2]), math.radians(b[3] - a[3])
        h = math.sin(dp / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(dl / 2) ** 2
        return 2 * 6_371_008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h))
    want = {p: any(dist(a, b) > 25 for a in rows if a[1] == p for b in rows if b[1] == p) for p in range(40)}
    assert got == want and {True, False} == set(want.values())


EDGE = "graph_id int, edge_id string, src string, dst string, duration_s double, sun_s double, unknown_s double"


def test_pareto_set(spark):
    edges = spark.createDataFrame([
        (1, "fast", "a", "d", 100.0, 100.0, 0.0), (1, "m1", "a", "b", 60.0, 10.0, 5.0), (1, "m2", "b", "d", 60.0, 15.0, 0.0),
        (1, "s1", "a", "c", 100.0, 0.0, 0.0), (1, "s2", "c", "d", 100.0, 0.0, 0.0), (1, "worse", "a", "d", 130.0, 120.0, 0.0), (1, "loop", "b", "a", 1.0, 0.0, 0.0)], EDGE)
    pairs = spark.createDataFrame([(1, 1, "a", "d"), (2, 1, "a", "a"), (3, 1, "d", "a")], "pair_id int, graph_id int, origin string, destination string")
    got = paths.pareto_paths(edges, pairs).orderBy("pair_id", "rank").collect()
    assert [(r.pair_id, r.exposure_s, r.edge_ids) for r in got] == [(1, 100, ["fast"]), (1, 30, ["m1", "m2"]), (1, 0, ["s1", "s2"]), (2, 0, [])]
    bounded = paths.pareto_paths(edges, pairs.filter("pair_id = 1"), max_expanded=1).collect()
    assert [(r.problem, r.edge_ids) for r in bounded] == [("label-expansion-bound", None)]


def test_labels_are_shuffled_once_a_level(spark, monkeypatch):
    edges = spark.createDataFrame([(1, "x", "a", "b", 2.0, 1.0, 0.0), (1, "y", "b", "c", 2.0, 1.0, 0.0)], EDGE)
    pairs = spark.createDataFrame([(1, 1, "a", "c")], "pair_id int, graph_id int, origin string, destination string")
    plans, cut = [], paths.cut_lineage

    def seen(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df)

    monkeypatch.setattr(paths, "cut_lineage", seen)
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert [r.edge_ids for r in paths.pareto_paths(edges, pairs).collect()] == [["x", "y"]]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    levels = [plan for columns, plan in plans if "_rank" in columns]
    assert len(levels) >= 2 and all(plan.count("Exchange hashpartitioning(pair_id") == 1 for plan in levels)


def test_hot_key_results_stay_whole(spark):
    # One feed holds nearly everything; the counts must not change.
    hot = spark.range(20_000).select(F.lit("hot").alias("gate"), (F.col("id") % 3_000).alias("at_ms"))
    from umbraline.operators import events
    got = events.trailing_counts(hot, ["gate"], 1_000, 10).agg(F.sum("n"), F.max("in_window")).first()
    assert got[0] == 20_000 and got[1] >= 6_666
    reads = spark.range(5_000).select(F.col("id").alias("request_id"), F.lit("hot").alias("feed"), F.col("id").alias("at_ms"))
    fresh = context.feed_freshness(reads, spark.createDataFrame([("hot", 100, True), ("hot", 4_000, False)], "feed string, at_ms bigint, ok boolean"), 1_000, 2_000)
    assert {r.state: r["count"] for r in fresh.groupBy("state").count().collect()} == {"unavailable": 100 + 2_900, "available": 1_000, "stale": 1_000}


def test_trailing_counts_are_running_sums(spark):
    from umbraline.operators import events
    rng = np.random.default_rng(8)
    times = [(g, int(t)) for g in ("a", "b", None) for t in rng.integers(-3_000, 9_000, 400)] + [("a", 0), ("a", 1_000), ("b", 2_000), ("b", None)]
    got = events.trailing_counts(spark.createDataFrame(times, "gate string, at_ms bigint"), ["gate"], 1_000, 30)
    want = {(g, t): sum(h == g and u is not None and t - 1_000 < u <= t for h, u in times) for g, t in times if t is not None}
    assert {(r.gate, r.at_ms): r.in_window for r in got.collect()} == want
    assert all(r.over_limit == (r.in_window > 30) for r in got.collect())
    # A frame that slides is summed anew for every row.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, unboundedpreceding$(), currentrow$()" in plan and "RangeFrame, -" not in plan


def test_outlines_of_points_give_the_farthest_pair():
    rng = np.random.default_rng(5)
    for lat0, count, step in ((51.5, 400, 1e-7), (-33.0, 60, 1e-5), (0.0, 3, 1e-6), (84.0, 300, 1e-9), (51.5, 1, 1e-7)):
        lat = lat0 + rng.integers(-1000, 1000, count) * step
        lon = -0.1 + rng.integers(-1000, 1000, count) * step
        la, lo = np.radians(lat), np.radians(lon)
        a = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la[:, None]) * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
        want = (2 * MEAN_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))).max()
        corners = calibration.convex_outline(lat, lon)
        assert len(corners) < 60 and abs(calibration.outline_width_m(lat[corners], lon[corners]) - want) < 1e-7
    # Equal coordinates, and all on one line.
    assert list(calibration.convex_outline(np.full(9, 51.5), np.full(9, 0.1))) == [0]
    line = calibration.convex_outline(51.5 + np.arange(50) * 1e-6, np.full(50, 0.1))
    assert sorted(line) == [0, 49]


def test_spread_of_many_fine_coordinates_needs_no_group(spark):
    # A disc a little wider than 24.9 m with coordinates of any fineness, and one of 25.1 m; extents alone settle neither.
    disc = lambda point, width: spark.range(60_000).select(
        F.lit("a").alias("area"), F.lit(point).alias("point_id"), (F.rand(1) * 2 * 3.141592653589793).alias("t"), (F.sqrt(F.rand(2)) * (width / 2)).alias("r"), "id").select(
        "area", "point_id", (51.5 + F.when(F.col("id") < 2, (F.col("id") - 0.5) * width * 0.6).otherwise(F.sin("t") * F.col("r")) / 111_195.0).alias("lat"),
        (F.when(F.col("id") < 2, (F.col("id") - 0.5) * width * 0.8).otherwise(F.cos("t") * F.col("r")) / 69_220.0).alias("lon"))
    rows = disc(1, 24.9).unionByName(disc(2, 25.1))
    wide = calibration.wide_points(rows, 25)
    assert {r.point_id: r.spread_over for r in wide.collect()} == {1: False, 2: True}
    assert "FlatMapGroups" not in wide._jdf.queryExecution().toString()
