import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from umbraline.operators import evidence, raster, rays, records, rings, routes, walks
from umbraline.functions.basics import reasons, split_valid
from umbraline.sources import grids as gr
from umbraline.sources import records as rd
from umbraline.sources import sinks


def encode(points):
    out, last = "", (0, 0)
    for lat, lon in points:
        for now, before in zip((lat, lon), last):
            delta = round(now * 1e6) - round(before * 1e6)
            value = ~(delta << 1) if delta < 0 else delta << 1
            while value >= 0x20:
                out += chr((0x20 | (value & 0x1F)) + 63)
                value >>= 5
            out += chr(value + 63)
        last = (lat, lon)
    return out


def test_route_responses_to_distinct_directions(spark, tmp_path):
    line = [(51.53, -0.1233), (51.5295, -0.1251), (51.5249, -0.1365)]
    trip = lambda pts, km: {"summary": {"length": km, "time": 700.4}, "legs": [{"shape": encode(pts), "maneuvers": [
        {"type": 1, "instruction": " Walk on Euston Road. ", "time": 44.6, "length": 0.059, "begin_shape_index": 0, "end_shape_index": 1},
        {"type": 4, "instruction": "", "time": 1, "length": 0.001, "begin_shape_index": 1, "end_shape_index": 2, "rough": True}]}]}
    body = {"trip": trip(line, 1.1), "alternates": [{"trip": trip(line, 0)}] + [{"trip": trip(line[:2] + [line[2]], 1.2)} for _ in range(9)]}
    (tmp_path / "r.json").write_text(json.dumps(body))
    assert rd.read_route_responses(spark, str(tmp_path / "r.json"))[0].count() == 11  # without a limit every alternate is kept
    trips, steps = rd.read_route_responses(spark, str(tmp_path / "r.json"), max_alternates=7)
    assert trips.count() == 8
    good, bad = split_valid(trips, routes.trip_checks())
    assert good.count() == 7 and bad.first().reject_reasons == ["length"]
    vertices, rejected = routes.decode_shapes(good)
    assert rejected.count() == 0
    first = vertices.filter(F.col("route_id").endswith("#0")).orderBy("seq").collect()
    assert [(r.lat, r.lon) for r in first] == [pytest.approx(p) for p in line]
    counted = vertices.groupBy("route_id").agg(F.count("*").alias("points"))
    kept, dropped = routes.project_directions(steps.join(good.select("route_id"), "route_id", "left_semi"), counted)
    assert dropped.count() == 0
    a, b = kept.filter(F.col("route_id").endswith("#0")).orderBy("dir_idx").collect()
    assert (a.instruction, a.distance_m, a.duration_s, b.instruction, b.rough) == ("Walk on Euston Road.", 59, 45, "Continue", True)
    named = good.withColumn("request_id", F.lit(1))
    dup = routes.near_duplicates(vertices, named)
    assert routes.distinct_routes(named, dup).count() == 1


@pytest.mark.parametrize("shape", ["_", "abc def", "?" * 20_002, "?", "~~~~~~~~?" + "?", "\u007f?"])
def test_bad_shapes_are_rejected(spark, shape):
    good, bad = routes.decode_shapes(spark.createDataFrame([("r", shape)], "route_id string, shape string"))
    assert good.count() == 0 and bad.count() == 1


def write_pack(folder, terrain_values, drop=None, short=False):
    meta = {"id": "a", "width": 3, "height": 2, "bboxBng": [0, 0, 12, 8], "resolutionMetres": 4, "heightStepMetres": 0.5, "validityFile": "a-v.bin",
            "terrainFile": "a-t.bin", "minimumSurfaceFile": "a-min.bin", "maximumSurfaceFile": "a-max.bin", "maximumSurfaceElevationMetres": 9}
    if drop:
        meta[drop] = None
    (folder / "a-heights.json").write_text(json.dumps(meta))
    (folder / "a-heights.bin").write_bytes(bytes([1, 2, 3, 4, 5, 255]))
    (folder / "a-v.bin").write_bytes(bytes([255] * (5 if short else 6)))
    for name in ("t", "min", "max"):
        (folder / f"a-{name}.bin").write_bytes(struct.pack("<6f", *terrain_values))


def test_cell_planes(spark, tmp_path):
    values = [0.5, 1.5, float("nan"), 3.5, 4.5, 5.5]
    write_pack(tmp_path, values)
    cells, grids = gr.read_cell_planes(spark, str(tmp_path))
    rows = {r.cell_no: r for r in cells.collect()}
    assert len(rows) == 6 and rows[5].height_steps == 255 and (rows[4].x, rows[4].y) == (1, 1) and rows[1].terrain == 1.5
    assert cells.filter(rays.usable()).count() == 5
    assert grids.first().north == 8
    summary = grids.select("area_id", "width", "height")
    gr.write_cells(cells, summary, str(tmp_path / "pack"))
    again, meta = gr.read_cells(spark, str(tmp_path / "pack"))
    assert again.count() == 6 and meta.count() == 1


@pytest.mark.parametrize("kwargs", [{"drop": "terrainFile"}, {"short": True}])
def test_broken_packs_fail(spark, tmp_path, kwargs):
    write_pack(tmp_path, [0.0] * 6, **kwargs)
    cells, _ = gr.read_cell_planes(spark, str(tmp_path))
    with pytest.raises(Exception):
        cells.collect()


def test_pixel_alignment(spark, tmp_path):
    full = spark.range(16).select(F.lit("a").alias("area_id"), (F.col("id") % 4).cast("int").alias("px"), F.floor(F.col("id") / 4).cast("int").alias("py"),
                                  F.col("id").cast("double").alias("value"), F.lit(-9999.0).alias("nodata"))
    full.write.parquet(str(tmp_path / "dsm"))
    full.withColumn("value", F.lit(1.0)).write.parquet(str(tmp_path / "dtm"))
    full.limit(15).write.parquet(str(tmp_path / "cut"))
    cell = raster.downsample_cells(gr.read_pixels(spark, str(tmp_path / "dsm"), str(tmp_path / "dtm"))).first()
    assert (cell.pixels, cell.valid_pixels, cell.height_steps, cell.validity, cell.surf_max, cell.terrain) == (16, 16, 28, 255, 15.0, 1.0)
    with pytest.raises(Exception):
        gr.read_pixels(spark, str(tmp_path / "dsm"), str(tmp_path / "cut")).collect()


def test_manifest_and_audit(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.bin").write_bytes(b"abc")
    (tmp_path / "f" / "two.bin").write_bytes(b"defg")
    files = spark.read.format("binaryFile").load(str(tmp_path / "f")).withColumn("path", F.element_at(F.split("path", "/"), -1))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("a", "one.bin", 3, sha(b"abc")), ("a", "two.bin", 4, sha(b"zzzz")), ("a", "three.bin", 1, sha(b"q"))], "area_id string, path string, bytes bigint, sha256 string")
    got = {r.path: r.verdict for r in gr.audit_pack_integrity(files, manifest).collect()}
    assert got == {"two.bin": "content", "three.bin": "missing"}
    text = json.dumps(["a", "v1", [["one.bin", 3, sha(b"abc")], ["three.bin", 1, sha(b"q")], ["two.bin", 4, sha(b"zzzz")]]], separators=(",", ":"))
    assert gr.canonical_manifest_id(manifest, "v1").first().manifest_id == "sha256-" + sha(text.encode())


def test_tree_csv(spark, tmp_path):
    head = ",".join(rd.TREE_COLUMNS)
    row = lambda name: f'Camden,51.5,-0.1,7,"{name}",Oak,Quercus,Oak,Oak,F,Council,Highways,a,b,c,1,2,3'
    (tmp_path / "t.csv").write_text(head + "\n" + row('Ash, ""tall""\nsecond line') + "\n" + row("x" * 2_001) + "\n")
    good, bad = rd.read_tree_inventory(spark, str(tmp_path / "t.csv"))
    assert good.first().taxon_species == 'Ash, "tall"\nsecond line' and good.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError):
        rd.check_row_count(good, 2, 3)
    (tmp_path / "w.csv").write_text(head.replace("lat,lon", "lon,lat") + "\n" + row("a") + "\n")
    with pytest.raises(Exception):
        rd.read_tree_inventory(spark, str(tmp_path / "w.csv"))[0].collect()


def test_walk_csv_and_summary(spark, tmp_path):
    def line(c, r, p, o, ranks, unknown="0"):
        shade_p, shade_o = 20 - p, 20 - o - float(unknown)
        return f"s,1,{c},a,2026-06-01T10:00,m1,{r},true,true,clear-direct-sun,20,{p},{shade_p},0,20,{o},{shade_o:g},{unknown},{ranks[0]},{ranks[1]}"
    lines = [line("c1", "r1", 4, 5, (1, 2)), line("c1", "r2", 6, 4, (2, 1)), line("c2", "r1", 3, 3, (1, 1)), line("c2", "r2", 8, 9.5, (2, 2)),
             line("c3", "r1", 2, 2, (1, "unknown"), "1.5"), line("c3", "r2", 5, 5, (2, "unknown"))]
    path = tmp_path / "w.csv"
    path.write_text(",".join(rd.WALK_COLUMNS) + "\n" + "\n".join(lines) + "\n" + lines[0].replace(",20,", ",020,", 1) + "\n")
    good, bad = rd.read_route_walks(spark, str(path))
    assert good.count() == 6 and bad.count() == 1
    assert split_valid(good, walks.row_checks())[1].count() == 0
    assert {r.comparison_id: r.broken_rules for r in walks.group_verdicts(good, ["pilot_area"]).collect()} == {"c1": [], "c2": [], "c3": []}
    s = walks.summarise_walks(walks.compare_walks(good)).first()
    assert (s.walks, s.comparable_walks, s.comparisons, s.comparable, s.agreeing) == (6, 5, 3, 2, 1)
    assert s.mae_min == pytest.approx(round((1 + 2 + 0 + 1.5 + 0) / 5, 3)) and s.agreement_percent == 50 and s.mean_regret_min == 0.5
    assert s.observed_unknown_percent == 1.25 and s.observed_coverage_percent == 98.75
    mixed = good.withColumn("observed_order", F.when(F.col("comparison_id") == "c3", F.col("predicted_order")).otherwise(F.col("observed_order")))
    assert walks.group_verdicts(mixed).filter("comparison_id = 'c3'").first().broken_rules == ["ranked-despite-unknown"]


def test_observation_csv(spark, tmp_path):
    values = ["s", "2", "p", "m", "d", "sha256-" + "0" * 64, "o1", "a", "pt", "open-street", "51.5", "-0.12", "manual", "", "left", "2026-06-01T10:00",
              "clear-direct-sun", "sun", "shade", "true", "", "leaf-on", "=note"]
    (tmp_path / "o.csv").write_text(",".join(rd.OBSERVATION_COLUMNS) + "\n" + ",".join(values) + "\n")
    good, _ = rd.read_observations(spark, str(tmp_path / "o.csv"))
    box = good.withColumns({"west": F.lit(-0.2), "south": F.lit(51.0), "east": F.lit(0.0), "north": F.lit(52.0)})
    assert box.select(reasons(records.observation_checks("s", 2, "p")).alias("r")).first().r == []
    sinks.write_safe_csv(good, str(tmp_path / "out"))
    assert "'=note" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))


def test_feeds(spark, tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(json.dumps(value)) and str(tmp_path / name) or str(tmp_path / name)
    lifts = put("l.json", [{"naptanCode": "S1", "message": " Lift\u0007 out "}, {"naptanCode": "S1", "message": ""}])
    stops = put("d.json", [{"atcoCode": "S1", "description": "Closed", "fromDate": "2026-06-01T00:00:00Z"}, {"stationAtcoCode": "S2", "description": "Busy"}])
    got = {(r.station, r.kind): r.summary for r in rd.read_transit_issues(spark, lifts, stops).collect()}
    assert got == {("S1", "lift"): "Lift out", ("S1", "station-disruption"): "Closed", ("S2", "station-disruption"): "Busy"}
    hour = lambda t, code=3: {"time": t, "screenTemperature": 27.26, "feelsLikeTemperature": 28.0, "uvIndex": 6, "significantWeatherCode": code}
    run = put("f.json", {"type": "FeatureCollection", "features": [{"properties": {"modelRunDate": "2026-06-01T09:00Z", "timeSeries": [hour("2026-06-01T11:00Z"), hour("2026-06-01T12:00Z", 4), hour("2026-06-01T12:00Z")]}}]})
    rows = rd.read_forecasts(spark, run).orderBy("forecast_at").collect()
    assert len(rows) == 2 and rows[1].temperature_c == 27.3 and rows[1].condition == "Partly cloudy day"
    work = {"work_reference_number": "W", "street": "High St", "work_category_string": "Major", "traffic_management_type_string": "Signals", "permit_status_string": "Granted", "start_date": "2026-06-01T00:00:00Z", "end_date": "2026-06-02T00:00:00Z"}
    works = put("w.json", {"type": "FeatureCollection", "features": [{"properties": work}, {"properties": {**work, "street": " "}}]})
    assert rd.read_street_works(spark, works).count() == 1
    heat = {"metric": "m", "geography": "London", "geography_code": "E1", "geography_type": "Region_Type", "metric_value": 9, "date": "2026-06-01"}
    camel = {"metricName": "m", "geographyName": "London", "geographyType": "region type", "metricValue": 12, "date": "2026-06-02"}
    for i, body in enumerate([{"results": [heat]}, [camel], {"data": [heat]}, {"data": {"results": [heat]}}, heat, {**heat, "metric_value": 17}]):
        metrics, pages = rd.read_heat_metrics(spark, put(f"h{i}.json", body), "m", "London", "E1", "Region Type")
        assert metrics.count() == (0 if i == 5 else 1) and not pages.first().empty_page
    _, pages = rd.read_heat_metrics(spark, put("empty.json", {"count": 0, "next": None, "previous": None, "results": []}), "m", "London", "E1", "Region Type")
    assert pages.first().empty_page
    places = put("g.json", {"results": [{"GAZETTEER_ENTRY": {"ID": "1", "NAME1": "Tate", "GEOMETRY_X": 530000.0, "GEOMETRY_Y": 180000.0, "LOCAL_TYPE": "art_gallery"}}]})
    p = rd.read_gazetteer(spark, places, "grid").first()
    assert p.kind == "Art Gallery" and 51.4 < p.lat < 51.6 and -0.2 < p.lon < 0
    other = put("n.json", {"results": [{"place_id": "z", "lon": -0.1, "lat": 51.5, "country_code": "GB", "formatted": "A, B", "result_type": "street"}, {"lon": 1.0, "lat": 1.0, "country_code": "fr", "formatted": "C"}]})
    assert [r.name for r in rd.read_gazetteer(spark, other, "lonlat").collect()] == ["A, B"]


def test_saved_records(spark, tmp_path):
    good = {"id": " a ", "submittedAt": "2026-06-01T10:00:00Z", "routeId": "r", "outcome": "actually-sunny", "predictedState": "haze", "note": "=x", "includeLocation": False, "location": {"latitude": 1, "longitude": 2}}
    (tmp_path / "f.json").write_text(json.dumps({"schemaVersion": 1, "feedback": [good, {**good, "id": ""}, {**good, "includeLocation": True, "location": {"latitude": 99, "longitude": 0}}]}))
    rows, bad = split_valid(rd.read_feedback(spark, str(tmp_path / "f.json")), records.feedback_checks())
    assert bad.count() == 2
    out = sinks.feedback_export(records.clean_feedback(rows)).first()
    assert (out.report_id, out.reported_state, out.modelled_state, out.model_section_latitude, out.report_saved_london_datetime) == ("a", "sun", None, None, "2026-06-01T11:00")
    (tmp_path / "old.json").write_text(json.dumps({"schemaVersion": 2, "feedback": [good]}))
    assert rd.read_feedback(spark, str(tmp_path / "old.json")).count() == 0
    point = {"name": "A", "lat": 51.5, "lon": -0.1}
    setup = {"origin": point, "destination": point, "profile": "worker", "journeyCount": 3, "repeatEveryMinutes": 30, "avoidSteps": False, "walkingPace": "hop"}
    (tmp_path / "s.json").write_text(json.dumps({"schemaVersion": 1, "journeys": [{"id": "1", "label": "x", "setup": setup}, {"id": "2", "label": "y", "setup": {**setup, "journeyCount": 51}}]}))
    rows, bad = split_valid(rd.read_saved_journeys(spark, str(tmp_path / "s.json")), records.saved_journey_checks())
    assert rows.first().pace == "standard" and [r.id for r in bad.collect()] == ["2"]


def plan_json(**change):
    base = {"protocol_version": "p", "model_version": "m", "data_pack_version": "d", "data_pack_fingerprints": {"a": "f"}, "required_pilot_areas": ["a"], "required_site_types": ["open-street"],
            "time_bands": [{"id": i, "start_hour_inclusive": s, "end_hour_exclusive": e} for i, s, e in (("x", 8, 11), ("y", 11, 15), ("z", 15, 19))],
            "minimum_unique_points_per_pilot": 6, "minimum_observations_per_pilot_time_band": 6, "maximum_gps_accuracy_metres": 20, "maximum_point_repeat_distance_metres": 25,
            "minimum_total_eligible_observations": 36, "minimum_classification_agreement_percent": 80, "minimum_per_pilot_classification_agreement_percent": 75, "maximum_unclassified_prediction_rate_percent": 10}
    return {**base, **change}


def test_threshold_plan(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(plan_json()))
    assert rd.read_threshold_plan(spark, str(tmp_path / "p.json")).bands[1] == ("y", 11, 15)
    bands = [{"id": i, "start_hour_inclusive": s, "end_hour_exclusive": e} for i, s, e in (("x", 8, 12), ("y", 11, 15), ("z", 15, 19))]
    for i, change in enumerate([{"time_bands": bands}, {"maximum_gps_accuracy_metres": 0}, {"required_pilot_areas": ["a", "b"]}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(plan_json(**change)))
        with pytest.raises(ValueError):
            rd.read_threshold_plan(spark, str(tmp_path / f"{i}.json"))


def test_osm_to_features(spark, tmp_path):
    nodes = [{"type": "node", "id": i, "lon": x, "lat": y} for i, x, y in ((1, 0, 0), (2, 10, 0), (3, 10, 10), (4, 0, 10), (5, 2, 2), (6, 4, 2), (7, 4, 4), (8, 2, 4), (9, 50, 50))]
    way = lambda i, n, **t: {"type": "way", "id": i, "nodes": n, "tags": t}
    ways = [way(10, [1, 2, 3]), way(11, [1, 4, 3]), way(12, [5, 6, 7, 8, 5], building="yes"), way(13, [1, 9], highway="footway", name="Lane"), way(14, [1, 2, 3], building="yes")]
    rel = {"type": "relation", "id": 20, "tags": {"type": "multipolygon", "building": "yes"}, "members": [
        {"type": "way", "ref": 10, "role": "outer"}, {"type": "way", "ref": 11, "role": "outer"}, {"type": "way", "ref": 12, "role": "inner"}]}
    (tmp_path / "o.json").write_text(json.dumps({"elements": nodes + ways + [rel]}))
    n, w, m = rd.read_osm(spark, str(tmp_path / "o.json"))
    assert (n.count(), w.count(), m.count()) == (9, 5, 3)
    assert sorted((r.way_id, r.kind, r.name) for r in rings.way_features(rings.drop_represented_ways(w, m), n).collect()) == [(13, "road", "Lane")]
    chained = m.join(w.select(F.col("way_id").alias("ref"), "nodes"), "ref").withColumnRenamed("ref", "way_id")
    found, rejected = rings.stitch_rings(chained.select("relation_id", "role", "way_id", "nodes"))
    assert rejected.count() == 0
    lookup = {r.node_id: (r.lon, r.lat) for r in n.collect()}
    shaped = rings.way_coordinates(found.withColumn("way_id", F.concat_ws("-", "relation_id", "role", "ring_id")), n).withColumn("is_outer", F.col("role") == "outer")
    got = {r.role: r for r in rings.normalise_rings(shaped).collect()}
    assert [tuple(p) for p in got["outer"].ring] == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)] and got["outer"].ring_area == 100
    assert [tuple(p) for p in got["inner"].ring] == [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)] and lookup[1] == (0, 0)


def test_evidence_file(spark, tmp_path):
    chosen = spark.createDataFrame([(1, "r1", "worker", 1, 15, "standard", 600.0, 100.4, 50.0, 150.0, 600.0, 500.0, 100.0, 50.0, 95.04, 900.0, 500.0)],
                                   "request_id int, route_id string, profile string, journey_count int, repeat_min int, pace string, walk_s double, sun_s double, best_s double, worst_s double, daylight_s double, modelled_s double, unknown_s double, shade_percent double, coverage_percent double, distance_m double, fastest_s double")
    text = {"created_ms": 0, "area_id": "a", "area_name": "A", "origin_name": "F", "destination_name": "T", "departure_ms": 0, "fastest_id": "r0", "fastest_m": 800.0,
            "avoid_steps": False, "access_evidence": "unavailable", "crossing_evidence": "mapped", "surface_evidence": "not-flagged"}
    chosen = chosen.withColumns({k: F.lit(v) for k, v in text.items()}).withColumn("labels", F.array(F.lit("recommended"), F.lit("fastest")))
    trips = spark.createDataFrame([(1, 0, 600.0, 100.4, 50.0, 150.0, None, 95.0, 0, 3)], "request_id int, journey int, walk_s double, sun_s double, best_s double, worst_s double, shade_percent double, coverage_percent double, departure_ms bigint, reason_bits int")
    constants = {k: k for k in ("schema", "route_source", "route_date", "height_source", "height_date", "height_processed", "model_name", "model_version")} | {"schema_version": "1"}
    good, bad = evidence.decision_evidence(chosen, trips, constants, ["x"])
    sinks.write_evidence(good, str(tmp_path / "e"))
    body = json.loads("".join(p.read_text() for p in (tmp_path / "e").glob("*.json")))
    assert bad.count() == 0 and body["decision"]["selectedRoute"]["labels"] == ["fastest", "recommended"]
    assert body["modelOutput"]["journeys"][0]["arrival"] == "1970-01-01T00:10:00.000Z" and body["modelOutput"]["journeys"][0]["estimatedShadePercent"] is None
    assert body["modelOutput"]["modelledCoveragePercent"] == 95.0 and "lat" not in json.dumps(body["journey"]).replace("latform", "")
    worse = chosen.withColumn("unknown_s", F.lit(1.0))
    assert evidence.decision_evidence(worse, trips, constants, ["x"])[1].first().reject_reasons == ["daylight"]
