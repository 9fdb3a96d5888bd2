"""Path sets, skylines, ring stitching and map ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up
from ..operators import paths, polygons, rings
from .registry import Source, VIEWS, given, query, r6
from .scoring import journey_scores, journey_ctes

# Twelve nodes per graph, five edges out of each, leading onwards by one to three nodes.
VIEWS["streets"] = """
    SELECT o_orderkey AS edge_id, CAST(floor(o_orderkey / 60.0) AS BIGINT) AS graph_id, CAST(o_orderkey % 12 AS INT) AS src,
      CAST(CASE WHEN o_orderkey % 12 = 11 THEN 0 ELSE least(11, o_orderkey % 12 + 1 + floor(o_orderkey / 12.0) % 3) END AS INT) AS dst,
      CAST(40 + (o_orderkey * 11) % 50 AS DOUBLE) AS duration_s, CAST((o_orderkey * 7) % 31 AS DOUBLE) AS sun_s, CAST(o_orderkey % 4 AS DOUBLE) AS unknown_s
    FROM {orders}"""
VIEWS["trips_wanted"] = """
    SELECT DISTINCT graph_id AS pair_id, graph_id, CAST(CASE WHEN graph_id % 10 = 9 THEN 10 WHEN graph_id % 2 = 0 THEN graph_id % 3 ELSE 0 END AS INT) AS origin,
      CAST(11 - graph_id % 2 AS INT) AS destination FROM {streets}"""


@query("pareto_paths", f"""WITH RECURSIVE {given('trips_wanted')[5:]},
walk AS (SELECT pair_id, graph_id, destination, origin AS node, [origin] AS nodes, CAST('' AS VARCHAR) AS path, 0.0::DOUBLE AS d, 0.0::DOUBLE AS s, 0.0::DOUBLE AS u FROM trips_wanted
  UNION ALL SELECT w.pair_id, w.graph_id, w.destination, e.dst, list_append(w.nodes, e.dst), CASE WHEN path = '' THEN CAST(e.edge_id AS VARCHAR) ELSE path || ' ' || e.edge_id END, d + duration_s, s + sun_s, u + unknown_s
  FROM walk w JOIN streets e ON e.graph_id = w.graph_id AND e.src = w.node WHERE w.node <> w.destination AND NOT list_contains(w.nodes, e.dst)),
done AS (SELECT *, min(s + u) OVER (PARTITION BY pair_id ORDER BY d, s + u, u, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM walk WHERE node = destination),
front AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY d, s + u, u, path) AS rk FROM done WHERE ahead IS NULL OR s + u < ahead)
SELECT pair_id, CAST(rk AS INT) AS rank, d AS duration_s, s AS sun_s, u AS unknown_s, s + u AS exposure_s, path FROM front WHERE rk <= 8""")
def pareto_paths(src: Source) -> DataFrame:
    out = paths.pareto_paths(src.view("streets"), src.view("trips_wanted"))
    return out.select("pair_id", "rank", "duration_s", "sun_s", "unknown_s", "exposure_s", F.array_join(F.col("edge_ids").cast("array<string>"), " ").alias("path"))


# The best trade-offs between time and sun over all edges of a graph.
@query("skyline", f"""{given('streets')},
f AS (SELECT *, min(sun_s + unknown_s) OVER (PARTITION BY graph_id ORDER BY duration_s, sun_s + unknown_s, edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM streets)
SELECT graph_id, edge_id, duration_s, sun_s + unknown_s AS exposure_s FROM f WHERE ahead IS NULL OR sun_s + unknown_s < ahead""")
def skyline(src: Source) -> DataFrame:
    edges = src.view("streets").withColumn("exposure_s", F.col("sun_s") + F.col("unknown_s"))
    out = paths.skyline(edges, ["graph_id"], ["edge_id"], salt=F.pmod(F.hash("edge_id"), F.lit(paths.SALT)))
    return out.select("graph_id", "edge_id", "duration_s", "exposure_s")


VIEWS["raw_edges"] = """
    SELECT o_custkey AS graph_id, CAST(o_orderkey % 7000 AS BIGINT) AS edge_id, CASE WHEN o_orderkey % 41 = 3 THEN '' ELSE 'n' END AS src, 'm' AS dst,
      CAST((o_orderkey * 11) % 50 AS DOUBLE) AS duration_s, CAST((o_orderkey * 7) % 31 - 1 AS DOUBLE) AS sun_s, CAST(o_orderkey % 4 AS DOUBLE) AS unknown_s FROM {orders}"""


@query("validate_edges", f"""{given('raw_edges')}
SELECT coalesce(CASE WHEN src = '' THEN 'identifiers' WHEN duration_s <= 0 THEN 'duration' WHEN sun_s < 0 OR sun_s + unknown_s > duration_s + 1e-9 THEN 'costs' END,
    CASE WHEN count(*) OVER (PARTITION BY graph_id, edge_id) > 1 THEN 'duplicate-id' END, 'ok') AS problem, count(*) OVER () AS everything, graph_id, edge_id FROM raw_edges""".replace("count(*) OVER () AS everything, ", ""))
def validate_edges(src: Source) -> DataFrame:
    return paths.validate_edges(src.view("raw_edges")).select(F.coalesce("problem", F.lit("ok")).alias("problem"), "graph_id", "edge_id")


@query("bucketed_edge_costs", f"""{journey_ctes(single=False, passages=False)}
SELECT route_id AS edge_id, CAST(journey AS INT) AS bucket, {r6('walk_s')} AS duration_s, {r6('greatest(0, sun_s - unknown_s)')} AS sun_s, {r6('unknown_s')} AS unknown_s FROM scores""")
def bucketed_edge_costs(src: Source) -> DataFrame:
    scores = journey_scores(src, single=False, passages=False)
    return paths.edge_costs(scores).withColumns({c: half_up(c, 6) for c in ("duration_s", "sun_s", "unknown_s")})


# Relations whose members chain into one ring: way i runs from node i to node i+1,
# every other one stored backwards.  One relation in seven lacks its last way.
VIEWS["ring_members"] = """
    SELECT route_id AS relation_id, 'outer' AS role, route_id * 10007 + (seq * 7) % 10007 AS way_id, seq, n,
      CASE WHEN seq % 2 = 0 THEN seq ELSE (seq + 1) % n END AS node_a, 1000 + seq AS node_m, CASE WHEN seq % 2 = 0 THEN (seq + 1) % n ELSE seq END AS node_b
    FROM (SELECT route_id, seq, count(*) OVER (PARTITION BY route_id) AS n FROM {route_vertices}) v
    WHERE NOT (route_id % 7 = 2 AND seq = n - 1)"""


@query("stitch_rings", f"""{given('ring_members')},
r AS (SELECT relation_id, max(n) AS n FROM ring_members GROUP BY relation_id)
SELECT relation_id, relation_id % 7 <> 2 AS stitched, CASE WHEN relation_id % 7 <> 2 THEN CAST(2 * n + 1 AS INT) END AS nodes, CASE WHEN relation_id % 7 <> 2 THEN CAST(2 * n AS INT) END AS distinct_nodes,
  CASE WHEN relation_id % 7 <> 2 THEN array_to_string(list_transform(range(n), lambda i: i || ' ' || (1000 + i)), ' ') || ' 0' END AS walk FROM r""")
def stitch_rings(src: Source) -> DataFrame:
    members = src.view("ring_members").select("relation_id", "role", "way_id", F.array("node_a", "node_m", "node_b").cast("array<bigint>").alias("nodes"))
    found, rejected = rings.stitch_rings(members)
    # Read every ring from node 0 onwards, whichever way round it was found.
    core = F.slice("nodes", 1, F.size("nodes") - 1)
    at = F.array_position("_core", F.lit(0).cast("bigint")).cast("int")
    spun = F.concat(F.slice("_core", at, F.size("_core")), F.slice("_core", F.lit(1), at - 1))
    found = found.withColumn("_core", core).withColumn("_spun", spun)
    ahead = F.when(F.element_at("_spun", 2) == 1000, F.col("_spun")).otherwise(
        F.concat(F.slice("_spun", 1, 1), F.reverse(F.slice("_spun", 2, F.size("_spun")))))
    walk = F.array_join(F.concat(ahead, F.array(F.lit(0).cast("bigint"))).cast("array<string>"), " ")
    good = found.select("relation_id", F.lit(True).alias("stitched"), F.size("nodes").alias("nodes"), F.size(F.array_distinct("nodes")).alias("distinct_nodes"), walk.alias("walk"))
    return good.unionByName(rejected.select("relation_id", F.lit(False).alias("stitched")), allowMissingColumns=True)


# One ring per route over its vertices; many cross themselves, some collapse.
@query("normalise_rings", f"""{given('route_vertices')},
c AS (SELECT route_id, list({{'lon': x_m, 'lat': y_m}} ORDER BY seq) AS p FROM route_vertices GROUP BY route_id),
d AS (SELECT route_id, list_append(p, p[1]) AS p FROM c),
e AS (SELECT route_id, list_filter(p, lambda x, i: i = 1 OR x <> p[i - 1]) AS p FROM d),
f AS (SELECT route_id, p[1:len(p) - 1] AS k FROM e WHERE len(p) >= 4),
g AS (SELECT route_id, k, list_sum(list_transform(k, lambda x, i: x.lon * k[i % len(k) + 1].lat - k[i % len(k) + 1].lon * x.lat)) / 2 AS a FROM f WHERE len(list_distinct(k)) >= 3),
h AS (SELECT route_id, a, CASE WHEN (a > 0) = (route_id % 2 = 0) THEN k ELSE list_reverse(k) END AS k FROM g WHERE a <> 0),
i AS (SELECT route_id, a, list_min(list_transform(range(len(k)), lambda t: list_concat(k[t + 1:len(k)], k[1:t]))) AS k FROM h)
SELECT v.route_id, abs(a) AS ring_area, CAST(len(k) + 1 AS INT) AS points, CAST(k[1].lon AS DOUBLE) AS first_x, CAST(k[2].lon AS DOUBLE) AS second_x FROM (SELECT DISTINCT route_id FROM route_vertices) v LEFT JOIN i ON i.route_id = v.route_id""")
def normalise_rings(src: Source) -> DataFrame:
    points = src.view("route_vertices").groupBy("route_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "x_m", "y_m"))), lambda p: F.struct(p["x_m"].alias("lon"), p["y_m"].alias("lat"))).alias("p"))
    closed = points.withColumns({"coordinates": F.concat("p", F.slice("p", 1, 1)), "is_outer": F.col("route_id") % 2 == 0})
    out = rings.normalise_rings(closed)
    return out.select("route_id", F.when(F.col("ring").isNotNull(), F.col("ring_area")).alias("ring_area"), F.when(F.col("ring").isNotNull(), F.size("ring")).alias("points"),
                      F.element_at("ring", 1)["lon"].alias("first_x"), F.element_at("ring", 2)["lon"].alias("second_x"))


# Ways over the part numbers as nodes; every fifth node is missing its position.
VIEWS["way_nodes"] = """
    SELECT l_orderkey AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS pos, l_partkey AS node_id
    FROM {lineitem}"""
VIEWS["map_nodes"] = """
    SELECT p_partkey AS node_id, CASE WHEN p_partkey % 5 <> 3 THEN -0.12 + (p_partkey * 13 % 200) * 0.0001 END AS lon, 51.5 + (p_partkey * 17 % 160) * 0.0001 AS lat FROM {part}"""
KIND = "CASE way_id % 8 WHEN 0 THEN 'building' WHEN 1 THEN 'road' WHEN 2 THEN 'water' WHEN 3 THEN 'green' WHEN 4 THEN 'green' WHEN 5 THEN 'building' END"


@query("osm_features", f"""{given('way_nodes', 'map_nodes')},
w AS (SELECT *, count(*) OVER (PARTITION BY way_id) AS n FROM way_nodes),
c AS (SELECT way_id, pos, node_id FROM w UNION ALL SELECT way_id, n, node_id FROM w WHERE pos = 0 AND way_id % 3 <> 1),
g AS (SELECT c.way_id, pos, round(lon, 6) AS lon, round(lat, 6) AS lat FROM c JOIN map_nodes m ON m.node_id = c.node_id AND lon IS NOT NULL),
f AS (SELECT way_id, {KIND} AS kind, count(*) AS points, arg_min(lon, pos) AS fx, arg_min(lat, pos) AS fy, arg_max(lon, pos) AS lx, arg_max(lat, pos) AS ly FROM g GROUP BY way_id)
SELECT way_id, kind, CASE way_id % 8 WHEN 0 THEN 'yes' WHEN 1 THEN 'footway' WHEN 2 THEN 'water' WHEN 3 THEN 'park' WHEN 4 THEN 'grass' WHEN 5 THEN 'church' END AS class,
  CASE WHEN way_id % 4 = 0 THEN 'Way ' || way_id ELSE '' END AS name, CAST(points AS INT) AS points, CASE WHEN kind = 'road' THEN 'LineString' ELSE 'Polygon' END AS geometry
FROM f WHERE kind IS NOT NULL AND points >= 2 AND (kind = 'road' OR (fx = lx AND fy = ly)) AND NOT (way_id % 8 = 5 AND way_id % 3 = 0)""")
def osm_features(src: Source) -> DataFrame:
    lists = src.view("way_nodes").groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda p: p["node_id"]).alias("n"))
    tag = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    kind = F.col("way_id") % 8
    tags = (F.when(kind == 0, tag("building", "yes")).when(kind == 1, tag("highway", "footway")).when(kind == 2, tag("natural", "water"))
            .when(kind == 3, tag("leisure", "park")).when(kind == 4, tag("landuse", "grass")).when(kind == 5, tag("building", "church")).otherwise(tag("power", "line")))
    named = F.when(F.col("way_id") % 4 == 0, F.map_concat(tags, F.create_map(F.lit("name"), F.concat(F.lit("Way "), "way_id")))).otherwise(tags)
    ways = lists.select("way_id", F.when(F.col("way_id") % 3 != 1, F.concat("n", F.slice("n", 1, 1))).otherwise(F.col("n")).alias("nodes"), named.alias("tags"))
    # Relations that already draw every third church.
    members = ways.filter((kind == 5) & (F.col("way_id") % 3 == 0)).select(F.lit("way").alias("type"), F.col("way_id").alias("ref"))
    out = rings.way_features(rings.drop_represented_ways(ways, members), src.view("map_nodes"))
    return out.select("way_id", "kind", "class", "name", F.size("coordinates").alias("points"), "geometry")


# Nested squares per relation; holes on odd parts lie outside every outer ring.
@query("holes_to_outers", """
WITH o AS (SELECT CAST(floor(p_partkey / 6.0) AS BIGINT) AS relation_id, p_partkey AS polygon_id, CAST(p_partkey % 6 * 3 + 10 AS DOUBLE) AS half FROM part),
i AS (SELECT CAST(floor(p_partkey / 6.0) AS BIGINT) AS relation_id, p_partkey AS inner_id, CAST(CASE WHEN p_partkey % 2 = 1 THEN 500 ELSE p_size * 0.6 + 0.05 END AS DOUBLE) AS px, 1.0::DOUBLE AS py FROM part),
h AS (SELECT i.inner_id, i.relation_id, arg_min(polygon_id, half) AS polygon_id FROM i JOIN o ON o.relation_id = i.relation_id AND abs(px) <= half AND abs(py) <= half GROUP BY i.inner_id, i.relation_id)
SELECT i.inner_id, i.relation_id, h.polygon_id FROM i LEFT JOIN h ON h.inner_id = i.inner_id""")
def holes_to_outers(src: Source) -> DataFrame:
    base = src.table("part").withColumn("relation_id", F.floor(F.col("p_partkey") / 6))
    half = (F.col("p_partkey") % 6 * 3 + 10).cast("double")
    outers = base.select("relation_id", F.col("p_partkey").alias("polygon_id"), half.alias("half"), (half * half * 4).alias("ring_area"))
    corner = lambda sx, sy: F.struct((F.col("half") * sx).alias("x"), (F.col("half") * sy).alias("y"))
    edges = polygons.ring_edges(outers.withColumn("ring", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))), ["relation_id", "polygon_id"])
    inners = base.select("relation_id", F.col("p_partkey").alias("inner_id"),
                         F.when(F.col("p_partkey") % 2 == 1, 500.0).otherwise(F.col("p_size") * 0.6 + 0.05).alias("px"), F.lit(1.0).alias("py"))
    return polygons.holes_to_outers(outers, inners, edges)


# One building relation per customer: an outer ring of two halves, one stored backwards, a hole in it, and mostly a second outer ring.
# Others are no multipolygon, hold a node, a foreign role, a missing way, a node without position, or a hole outside every outer ring.
VIEWS["site"] = """
    SELECT c_custkey AS relation_id, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(40 + c_custkey % 20 AS DOUBLE) AS y, c_custkey % 5 <> 1 AS paired, c_custkey % 7 <> 3 AS housed,
      CASE WHEN c_custkey % 9 = 2 THEN 'site' ELSE 'multipolygon' END AS type, c_custkey % 11 = 4 AS with_node, c_custkey % 13 = 6 AS lost_way, c_custkey % 17 = 8 AS labelled, c_custkey % 19 = 9 AS blind_node
    FROM {customer}"""
SITE_MEMBERS = """
    SELECT relation_id, 'way' AS type, relation_id * 10 AS ref, '' AS role FROM {site} UNION ALL SELECT relation_id, 'way', relation_id * 10 + 1, 'outer' FROM {site}
    UNION ALL SELECT relation_id, 'way', relation_id * 10 + 2, 'outer' FROM {site} WHERE paired UNION ALL SELECT relation_id, 'way', relation_id * 10 + 3, 'inner' FROM {site}
    UNION ALL SELECT relation_id, 'node', relation_id, '' FROM {site} WHERE with_node UNION ALL SELECT relation_id, 'way', relation_id * 10 + 3, 'label' FROM {site} WHERE labelled"""
SITE_NODES = """
    SELECT relation_id * 100 + k AS node_id, CASE WHEN NOT (blind_node AND k = 1) THEN CASE WHEN k < 4 THEN x + CASE WHEN k IN (1, 2) THEN 4 ELSE 0 END WHEN k < 8 THEN x + 6 + CASE WHEN k IN (5, 6) THEN 1 ELSE 0 END
        ELSE x + CASE WHEN housed THEN 1 ELSE 20 END + CASE WHEN k IN (9, 10) THEN 0.5 ELSE 0 END END END AS lon,
      CASE WHEN k < 4 THEN y + CASE WHEN k >= 2 THEN 4 ELSE 0 END WHEN k < 8 THEN y + CASE WHEN k >= 6 THEN 1 ELSE 0 END ELSE y + 1 + CASE WHEN k >= 10 THEN 0.5 ELSE 0 END END AS lat
    FROM (SELECT s.*, explode(sequence(0, 11)) AS k FROM {site} s)"""
SITE_OK = "type = 'multipolygon' AND housed AND NOT with_node AND NOT lost_way AND NOT labelled AND NOT blind_node"


def _sites(src: Source) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    site = src.view("site")
    tags = F.create_map(F.lit("type"), F.col("type"), F.lit("building"), F.lit("yes"), F.lit("name"), F.concat(F.lit("Site "), "relation_id"))
    relations = site.select("relation_id", tags.alias("tags"))
    base = F.col("relation_id") * 100
    line = lambda *at: F.array(*(base + k for k in at))
    parts = [line(0, 1, 2), line(0, 3, 2), line(4, 5, 6, 7, 4), line(8, 9, 10, 11, 8)]
    way = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), nodes.alias("nodes")) for k, nodes in enumerate(parts))))
    ways = site.select("relation_id", "lost_way", way.alias("w")).filter(~(F.col("lost_way") & (F.col("w.k") == 1)))
    kind = F.when(F.col("w.k") == 2, F.create_map(F.lit("building"), F.lit("annexe"))).when(
        F.col("w.k") == 3, F.create_map(F.lit("leisure"), F.lit("garden"))).otherwise(F.create_map(F.lit("building"), F.lit("half")))
    ways = ways.select((F.col("relation_id") * 10 + F.col("w.k")).alias("way_id"), F.col("w.nodes").alias("nodes"), kind.alias("tags"))
    return relations, src.sql(SITE_MEMBERS), ways, src.sql(SITE_NODES)


@query("relation_features", f"""{given('site')}
SELECT relation_id, 'yes' AS class, 'Site ' || relation_id AS name, CASE WHEN paired THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry, CAST(CASE WHEN paired THEN 2 ELSE 1 END AS INT) AS outers, CAST(1 AS INT) AS holes,
  format('{{:.1f}} {{:.1f}},{{:.1f}} {{:.1f}},{{:.1f}} {{:.1f}},{{:.1f}} {{:.1f}},{{:.1f}} {{:.1f}}', x, y, x + 4, y, x + 4, y + 4, x, y + 4, x, y) AS outer_ring,
  format('{{:.1f}} {{:.1f}},{{:.1f}} {{:.1f}},{{:.1f}} {{:.1f}},{{:.1f}} {{:.1f}},{{:.1f}} {{:.1f}}', x + 1, y + 1, x + 1, y + 1.5, x + 1.5, y + 1.5, x + 1.5, y + 1, x + 1, y + 1) AS hole_ring
FROM site WHERE {SITE_OK}""")
def relation_features(src: Source) -> DataFrame:
    out = rings.relation_features(*_sites(src))
    point = lambda p: F.concat_ws(" ", *(F.format_string("%.1f", p[c]) for c in ("lon", "lat")))
    ring = lambda n: F.array_join(F.transform(F.element_at(F.element_at("polygons", 1), n), point), ",")
    holes = F.aggregate("polygons", F.lit(0), lambda n, p: n + F.size(p) - 1)
    return out.select("relation_id", "class", "name", "geometry", F.size("polygons").alias("outers"), holes.alias("holes"), ring(1).alias("outer_ring"), ring(2).alias("hole_ring"))


@query("map_features", f"""{given('site')}
SELECT 'relation' AS source, relation_id AS feature_id, 'building' AS kind, CASE WHEN paired THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry, CAST(CASE WHEN paired THEN 15 ELSE 10 END AS INT) AS points FROM site WHERE {SITE_OK}
UNION ALL SELECT 'way', relation_id * 10 + 3, 'green', 'Polygon', 5 FROM site
UNION ALL SELECT 'way', relation_id * 10 + 2, 'building', 'Polygon', 5 FROM site WHERE NOT (paired AND {SITE_OK})""")
def map_features(src: Source) -> DataFrame:
    relations, members, ways, nodes = _sites(src)
    out = rings.map_features(ways, nodes, relations, members)
    points = F.coalesce(F.aggregate("polygons", F.lit(0), lambda n, p: n + F.aggregate(p, F.lit(0), lambda m, r: m + F.size(r))), F.size("line"))
    return out.select("source", "feature_id", "kind", "geometry", points.alias("points"))
