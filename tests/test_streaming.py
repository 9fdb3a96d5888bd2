import json
import os

from pyspark.sql import functions as F

from umbraline.operators import geometry, profile
from umbraline.streaming import jobs


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def write_lines(folder, *batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        path = folder / f"{i}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files arrive in this order
    return str(folder)


def event(ts, outcome="success", **more):
    return {"ts": ts, "area": "a", "outcome": outcome, "delivery": "primary", "duration_ms": 70, "status_code": 200, "route_count": 1, "secret": "x", **more}


def test_rollup(spark, tmp_path):
    rows = [event("2026-06-01T10:00:05Z"), event("2026-06-01T10:00:30Z"), event("2026-06-01T10:00:40Z", "teapot"), event("2026-06-01T10:00:50Z", route_count=9), event("2026-06-01T12:00:00Z")]
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(write_lines(tmp_path / "in", rows, [event("2026-06-01T13:00:00Z")]))
    drain(jobs.rollup_stream(jobs.parse_event_lines(lines)), "rolled")
    got = {str(r.window_start): r.events for r in spark.table("rolled").collect()}
    assert got["2026-06-01 10:00:00"] == 2 and set(spark.table("rolled").columns) == {"window_start", "outcome", "delivery", "duration_bucket", "events"}


def test_admission_windows_start_at_the_first_request(spark, tmp_path):
    at = lambda s: f"2026-06-01T10:{s // 60:02d}:{s % 60:02d}.000Z"
    first = [{"client": 1, "ts": at(s)} for s in (50, 55, 55, 100)]
    later = [{"client": 1, "ts": at(s)} for s in (109, 110, 200)] + [{"client": 2, "ts": at(600)}]
    stream = spark.readStream.schema("client bigint, ts timestamp").option("maxFilesPerTrigger", 1).json(write_lines(tmp_path / "in", first, later, [{"client": 9, "ts": at(3000)}]))
    drain(jobs.admission_stream(stream, limit=3), "admitted")
    rows = {(r.client, r.at_ms % 3_600_000 // 1000): (r.requests, r.refused) for r in spark.table("admitted").collect()}
    # Window from 50 s holds four requests by 100 s and a fifth at 109 s; 110 s opens the next.
    assert rows[(1, 50)] == (1, 0) and rows[(1, 55)] == (2, 0) and rows[(1, 100)] == (1, 1) and rows[(1, 109)] == (1, 1) and rows[(1, 110)] == (1, 0)
    assert rows[(1, 200)] == (1, 0)


def test_freshness(spark, tmp_path):
    row = lambda t, read, ok=None, req=None: {"feed": "tube", "at_ms": t, "is_read": read, "ok": ok, "request_id": req}
    a = [row(0, True, req=1), row(10, False, True), row(20, True, req=2)]
    b = [row(400_000, False, False), row(400_001, True, req=3), row(1_900_000, True, req=4)]
    stream = spark.readStream.schema("feed string, at_ms bigint, is_read boolean, ok boolean, request_id bigint").option("maxFilesPerTrigger", 1).json(write_lines(tmp_path / "in", a, b))
    drain(jobs.freshness_stream(stream), "fresh")
    assert {r.request_id: r.state for r in spark.table("fresh").collect()} == {1: "unavailable", 2: "available", 3: "stale", 4: "unavailable"}


def states_left(frame, name):
    query = drain(frame, name)
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_idle_clients_leave_the_state_and_answers_stay(spark, tmp_path):
    at = lambda s: f"2026-06-01T{10 + s // 3600}:{s % 3600 // 60:02d}:{s % 60:02d}.000Z"
    many = [{"client": c, "ts": at(c % 50)} for c in range(200)]
    quiet = [{"client": 1, "ts": at(3 * 3600)}]
    back = [{"client": c, "ts": at(3 * 3600 + 5)} for c in (1, 7, 7, 7)]
    stream = spark.readStream.schema("client bigint, ts timestamp").option("maxFilesPerTrigger", 1).json(write_lines(tmp_path / "in", many, quiet, back))
    left = states_left(jobs.admission_stream(stream, limit=2), "idle_clients")
    assert max(left) >= 200 and left[-1] <= 2
    rows = {(r.client, r.at_ms % 3_600_000 // 1000, r.window_start_ms == r.at_ms): (r.requests, r.refused) for r in spark.table("idle_clients").collect()}
    # Client 7 opened a window at 7 s, was forgotten, and opens a new one; client 1 is still in the window of a trigger ago.
    assert rows[7, 7, True] == (1, 0) and rows[7, 5, True] == (3, 1) and rows[1, 5, False] == (1, 0)


def test_idle_feeds_leave_the_state(spark, tmp_path):
    row = lambda feed, t, read, req=None: {"feed": feed, "at_ms": t, "is_read": read, "ok": None if read else True, "request_id": req}
    many = [row(f"f{n}", 10, False) for n in range(50)]
    late = [row("f1", 9_000_000, False)]
    reads = [row("f2", 9_000_010, True, 1), row("f1", 9_000_020, True, 2), row("f1", 9_000_020, True, 3), row("f1", 9_400_000, True, 4)]
    stream = spark.readStream.schema("feed string, at_ms bigint, is_read boolean, ok boolean, request_id bigint").option("maxFilesPerTrigger", 1).json(
        write_lines(tmp_path / "in", many, late, reads))
    left = states_left(jobs.freshness_stream(stream), "idle_feeds")
    assert max(left) >= 50 and left[-1] <= 1
    assert {r.request_id: r.state for r in spark.table("idle_feeds").collect()} == {1: "unavailable", 2: "available", 3: "available", 4: "stale"}


def test_generations_and_sliding_counts(spark, tmp_path):
    rows = [{"task": "score", "generation": g, "payload": f"p{g}", "gate": "g", "ts": f"2026-06-01T10:00:{g:02d}Z"} for g in (1, 3, 2)]
    schema = "task string, generation int, payload string, gate string, ts timestamp"
    path = write_lines(tmp_path / "in", rows)
    drain(jobs.latest_generation_stream(spark.readStream.schema(schema).json(path).select("task", "generation", "payload"), ["task"]), "newest", "complete")
    assert spark.table("newest").first().payload == "p3"
    drain(jobs.sliding_counts(spark.readStream.schema(schema).json(path)), "slid", "complete")
    assert spark.table("slid").agg(F.max("requests")).first()[0] == 3


def test_intake_keeps_one(spark, tmp_path):
    rows = [{"observation_id": i, "ts": "2026-06-01T10:00:00Z"} for i in ("a", "b", "a")]
    source, table = write_lines(tmp_path / "in", rows), str(tmp_path / "table")
    stream = lambda: spark.readStream.schema("observation_id string, ts timestamp").json(source)
    jobs.intake_stream(stream(), table, str(tmp_path / "c1")).awaitTermination(120)
    # A second run from scratch meets the ids already stored.
    jobs.intake_stream(stream(), table, str(tmp_path / "c2")).awaitTermination(120)
    assert sorted(r.observation_id for r in spark.read.parquet(table).collect()) == ["a", "b"]


def test_live_positions(spark, tmp_path):
    vertices = spark.createDataFrame([(1, 0, 0.0, 51.5), (1, 1, 0.01, 51.5)], "route_id int, seq int, lon double, lat double")
    segs = geometry.segments(vertices)
    routes = spark.createDataFrame([(1, 700.0)], "route_id int, distance_m double")
    spans = profile.complete_coverage(spark.createDataFrame([(1, "sun", 0.0, 300.0, 700.0)], "route_id int, exposure string, start_m double, end_m double, route_m double"), ["route_id"])
    source = write_lines(tmp_path / "in", [{"position_id": 1, "route_id": 1, "lon": 0.001, "lat": 51.5001}, {"position_id": 2, "route_id": 1, "lon": 0.009, "lat": 51.5}])
    stream = spark.readStream.schema("position_id int, route_id int, lon double, lat double").json(source)
    jobs.track_positions(stream, segs, routes, spans, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.position_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1].exposure == "sun" and got[1].next_exposure == "unknown" and 60 < got[1].along_m < 80 and got[2].exposure == "unknown"
