"""Building relations, stored answers, areas, anchored windows, place queries by runs, path bounds that show."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from umbraline.operators import context, events, paths, rings, routes

SQUARE = {1: (0.0, 0.0), 2: (4.0, 0.0), 3: (4.0, 4.0), 4: (0.0, 4.0), 5: (1.0, 1.0), 6: (2.0, 1.0), 7: (2.0, 2.0), 8: (1.0, 2.0), 9: (9.0, 9.0), 10: (10.0, 9.0), 11: (10.0, 10.0)}


def frames(spark, members, lines, tags=None):
    kinds = [(r, {"type": "multipolygon", "building": "yes", **(tags or {})}) for r in sorted({m[0] for m in members})]
    return (spark.createDataFrame(kinds, "relation_id long, tags map<string,string>"), spark.createDataFrame(members, "relation_id long, type string, ref long, role string"),
            spark.createDataFrame([(w, n, {"building": "half"}) for w, n in lines.items()], "way_id long, nodes array<long>, tags map<string,string>"),
            spark.createDataFrame([(n, *xy) for n, xy in SQUARE.items()], "node_id long, lon double, lat double"))


def test_walked_rings_are_those_of_the_joins(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for relation in range(60):
        for role in ("outer", "inner")[: 1 + relation % 2]:
            for ring in range(rng.randint(1, 3)):
                size = rng.randint(1, 9)
                ends = [relation * 1_000 + ring * 50 + i for i in range(size)]
                ids = rng.sample(range(100), size)
                for i in range(size):
                    nodes = [ends[i], 10_000_000 + ends[i], ends[(i + 1) % size]]
                    rows.append((relation, role, ring * 100 + ids[i], nodes if rng.random() < 0.5 else nodes[::-1]))
        if relation % 7 == 3:
            rows.pop()
    rows += [(70, "outer", 1, [1, 2, 3]), (70, "outer", 1, [1, 2, 3]), (70, "outer", 2, [3, 9, 1]), (71, "outer", 1, [1, 2]), (71, "outer", 2, [1, 2]),
             (72, None, 1, [1, 2, 1]), (73, "outer", None, [1, 2]), (73, "outer", 5, [2, 1]), (74, "outer", 1, [7]), (74, "outer", 2, [1, 2, 3, 1]), (None, "outer", 3, [4, 5, 4])]
    ways = spark.createDataFrame(rows, "relation_id bigint, role string, way_id bigint, nodes array<bigint>").repartition(5)
    rows_of = lambda parts: [sorted(map(str, d.collect())) for d in parts]
    want = rows_of(rings.stitch_by_joins(ways))
    assert len(want[0]) > 60 and len(want[1]) >= 8
    for at_once in (rings.NODES_AT_ONCE, 30, 0):
        assert rows_of(rings.stitch_rings(ways, at_once=at_once)) == want
    # Relations of common size are not joined at all.
    monkeypatch.setattr(rings, "stitch_by_joins", None)
    found, refused = rings.stitch_rings(ways.filter("relation_id < 72"))
    assert found.count() > 60 and refused.count() > 5


def test_unfolded_sides_are_not_broadcast(spark):
    """A few rows that unfold into many look small to Spark; nodes of ways and parts of relations stay off the driver."""
    lines = {1: [1, 2, 3], 2: [1, 4, 3], 3: [5, 8, 7, 6, 5]}
    relations, parts, ways, nodes = frames(spark, [(1, "way", 1, ""), (1, "way", 2, ""), (1, "way", 3, "inner")], lines)
    for frame in (rings.way_coordinates(ways, nodes), rings.relation_features(relations, parts, ways, nodes), rings.map_features(ways, nodes, relations, parts)):
        frame.collect()
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_relation_features(spark):
    lines = {1: [1, 2, 3], 2: [1, 4, 3], 3: [5, 8, 7, 6, 5], 4: [9, 10, 11, 9], 5: [9, 10, 99, 9], 6: [1], 7: [9, 9, 9, 9]}
    way = lambda r, ref, role: (r, "way", ref, role)
    members = [
        way(1, 1, None), way(1, 2, "outer"), way(1, 3, "inner"), way(1, 4, ""),           # two polygons, a hole in the first
        way(2, 1, "outer"), way(2, 2, "outer"), way(2, 4, "inner"),                       # a hole in no outer ring
        way(3, 1, "outer"), way(4, 4, "outer"), (4, "node", 1, ""),                       # an open end; a member that is no way
        way(5, 4, "outer"), way(5, 1, "label"), way(6, 4, "outer"), way(6, 77, "outer"),  # a foreign role; a missing way
        way(7, 5, "outer"), way(8, 6, "outer"), way(9, 7, "outer"), way(10, 3, "inner"),  # unknown node; one node; no area; no outer ring
        way(11, 4, "outer"), way(11, 4, "outer"), (12, None, None, None)]                 # a repeated member; nulls
    got = {r.relation_id: r for r in rings.relation_features(*frames(spark, members, lines)).collect()}
    assert set(got) == {1, 11}
    shape = [[[tuple(p) for p in ring] for ring in polygon] for polygon in got[1].polygons]
    assert shape == [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]], [[(9, 9), (10, 9), (10, 10), (9, 9)]]]
    assert (got[1].geometry, got[11].geometry, got[1].name) == ("MultiPolygon", "Polygon", "")
    relations, parts, ways, nodes = frames(spark, members, lines)
    drawn = rings.map_features(ways, nodes, relations, parts).collect()
    # Ways of relations that became no feature stay; open ones and points were never areas.
    assert sorted((r.source, r.feature_id) for r in drawn) == [("relation", 1), ("relation", 11), ("way", 5), ("way", 7)]
    empty = rings.map_features(ways.limit(0), nodes, relations.limit(0), parts.limit(0))
    assert empty.count() == 0


def test_stored_routes_and_areas(spark):
    asks = spark.createDataFrame([(1, 7, "forward"), (2, 7, "reverse"), (3, 7, None), (4, 8, "forward")], "request_id long, area_id long, stored_direction string")
    line = spark.createDataFrame([(7, "a", [(0.0, 1.0), (2.0, 3.0)], [("Go.",), ("Stop.",)]), (7, "b", [(5.0, 5.0)], [])],
                                 "area_id long, route_id string, coordinates array<struct<lon:double,lat:double>>, directions array<struct<instruction:string>>")
    got = {(r.request_id, r.route_id): r for r in routes.stored_routes(asks, line).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a-reversed"), (2, "b-reversed")}
    back = got[2, "a-reversed"]
    assert (back.coordinates[0].lon, back.access_reference, back.directions) == (2.0, "Go. Stop.", [])
    areas = spark.createDataFrame([(1, 2, 0.0, 0.0, 1.0, 1.0), (2, 1, 0.5, 0.5, 2.0, 2.0)], "area_id long, area_pos long, west double, south double, east double, north double")
    trips = spark.createDataFrame([(1, 0.6, 0.6, 1.0, 1.0), (2, 0.1, 0.1, 1.0, 1.0), (3, 0.1, 0.1, 1.5, 1.5), (4, None, 0.1, 0.2, 0.2)],
                                  "request_id long, olon double, olat double, dlon double, dlat double")
    assert {r.request_id: r.area_id for r in routes.assign_areas(trips, areas).collect()} == {1: 2, 2: 1, 3: None, 4: None}


def test_anchored_windows(spark):
    rng = random.Random(5)
    # One client holds a third of all rows and is never quiet.
    rows = [("busy", t * 7) for t in range(400)] + [(f"c{rng.randrange(9)}", rng.randrange(20_000)) for _ in range(800)] + [("c1", 60), ("c1", 60)]
    want: dict[tuple, int] = {}
    for client in {c for c, _ in rows}:
        start = None
        for at in sorted(t for c, t in rows if c == client):
            if start is None or at - start >= 100:
                start = at
            want[client, start] = want.get((client, start), 0) + 1
    got = events.anchored_admission(spark.createDataFrame(rows, "client string, at_ms long"), ["client"], 100, 3).collect()
    assert {(r.client, r.window_start_ms): r.requests for r in got} == want
    assert all(r.refused == max(0, r.requests - 3) for r in got)
    assert events.anchored_admission(spark.createDataFrame([], "client string, at_ms long"), ["client"]).count() == 0


def test_places_by_runs(spark):
    places = spark.createDataFrame([(1, n, name, "shop", float(n), 1.0) for n, name in enumerate(["Ash", "Bash", "ha", "", "Ash"])] + [(1, 9, None, "shop", 0.0, 0.0)],
                                   "area_id long, payload_pos long, name string, kind string, lon double, lat double")
    asked = spark.createDataFrame([(1, 1, "ASH"), (2, 1, "h"), (3, 1, "ha"), (4, 1, "bash sh"), (5, 2, "ash"), (6, 1, "zzz")], "query_id long, area_id long, text string")
    got: dict[int, list[int]] = {}
    for r in context.search_places(places, asked).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.payload_pos)
    assert got == {1: [0, 1, 4], 2: [0, 1, 2, 3, 4], 3: [2], 4: [1]}


def test_places_are_asked_for_by_the_rarest_run(spark):
    # Every place of the area is a street; only one holds "zeb".
    rows = [(1, n, f"Street number {n}", "street", float(n), 1.0) for n in range(300)] + [(1, 300, "Street Zebra", "street", 900.0, 1.0), (2, 0, "Zebra", "zebra", 0.0, 0.0)]
    places = spark.createDataFrame(rows, "area_id long, payload_pos long, name string, kind string, lon double, lat double")
    asked = spark.createDataFrame([(1, 1, "street zebra"), (2, 1, "street"), (3, 1, "street zzz"), (4, 2, "street"), (5, 1, "")], "query_id long, area_id long, text string")
    got: dict[int, list[int]] = {}
    for r in context.search_places(places, asked).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.payload_pos)
    assert got == {1: [300], 2: list(range(8)), 5: list(range(8))}
    postings = places.select("area_id", F.explode(context._runs("lower(name)", 3)).alias("_gram"))
    needles = asked.select(F.struct("area_id", "text").alias("_asked"))
    asks = {r._asked.text: r._gram for r in context.rarest_runs(postings, needles).collect()}
    # A run of the rare word stands for the whole text; runs that no place holds ask for nothing.
    assert asks["street zebra"] in ("zeb", "ebr", "bra", " ze", "t z") and "street zzz" not in asks


def test_windows_ahead_are_running_ones(spark):
    # One client, busy in every millisecond of two windows: quadratic frames would take minutes.
    rows = spark.range(60_000).select(F.lit("c").alias("client"), F.col("id").alias("at_ms"))
    got = events.anchored_admission(rows, ["client"], 30_000, 10).orderBy("window_start_ms").collect()
    assert [(r.window_start_ms, r.requests, r.refused) for r in got] == [(0, 30_000, 29_990), (30_000, 30_000, 29_990)]


def test_path_bounds_show(spark):
    edges = spark.createDataFrame([(1, k, 0, 1, 10.0 + k, 9.0 - k, 0.0) for k in range(4)] + [(1, 9, 1, 2, 5.0, 1.0, 0.0)],
                                  "graph_id long, edge_id long, src int, dst int, duration_s double, sun_s double, unknown_s double")
    pair = spark.createDataFrame([(1, 1, 0, 2)], "pair_id long, graph_id long, origin int, destination int")
    assert [r.problem for r in paths.pareto_paths(edges, pair).collect()] == [None] * 4
    cut = paths.pareto_paths(edges, pair, max_labels=2).collect()
    assert sorted((r.problem or "", r.rank or 0) for r in cut) == [("", 1), ("", 2), ("node-label-bound", 0)]
    short = paths.pareto_paths(edges, pair, max_hops=1).filter(F.col("problem").isNotNull()).collect()
    assert [r.problem for r in short] == ["hop-bound"]
