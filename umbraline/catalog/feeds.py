"""Context around routes: amenities, works, forecasts, freshness, events, places, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up, reasons
from ..operators import context as cx
from ..operators import events as ev
from ..operators import geometry
from .registry import Source, VIEWS, given, query, r6

NEAR_RADIUS = 15.0
NEAR = f"""{given('features', 'route_vertices')},
h AS (SELECT route_id, area_id, seq AS seg_idx, x_m AS x1, y_m AS y1, CASE WHEN count(*) OVER (PARTITION BY route_id) = 1 THEN x_m ELSE lead(x_m) OVER w END AS x2,
  CASE WHEN count(*) OVER (PARTITION BY route_id) = 1 THEN y_m ELSE lead(y_m) OVER w END AS y2 FROM route_vertices WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
s AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS m FROM h WHERE x2 IS NOT NULL),
t AS (SELECT *, sum(m) OVER (PARTITION BY route_id ORDER BY seg_idx) - m AS so_far, sum(m) OVER (PARTITION BY route_id) AS tot FROM s),
p AS (SELECT t.*, f.feature_id, f.category_no, f.name, f.x_m AS px, f.y_m AS py, CASE WHEN m > 0 THEN greatest(0, least(1, ((f.x_m - x1) * (x2 - x1) + (f.y_m - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) ELSE 0 END AS fr
  FROM t JOIN features f ON f.area_id = t.area_id),
d AS (SELECT *, sqrt((x1 + (x2 - x1) * fr - px) ** 2 + (y1 + (y2 - y1) * fr - py) ** 2) AS away FROM p),
b AS (SELECT route_id, feature_id, category_no, name, min(away) AS raw_m FROM d WHERE away <= {NEAR_RADIUS} GROUP BY ALL)"""


def _nearby(src: Source) -> DataFrame:
    vertices = src.view("route_vertices")
    segs = geometry.segments(vertices, x="x_m", y="y_m", metric="planar", lone=True).withColumn("area_id", F.floor(F.col("route_id") / 15_000).cast("int"))
    features = src.view("features").select("feature_id", "area_id", F.col("category_no").alias("category"), "name", F.col("x_m").alias("px"), F.col("y_m").alias("py"))
    return cx.nearby_features(segs, features, NEAR_RADIUS, "planar")


@query("nearby_features", f"""{NEAR},
r AS (SELECT *, row_number() OVER (PARTITION BY route_id, category_no ORDER BY raw_m, name) AS rk FROM b)
SELECT route_id, category_no AS category, feature_id, CAST(rk AS INT) AS rank, {r6('raw_m')} AS raw_m, CAST(CASE WHEN raw_m > 0 THEN ceil(raw_m / 10) * 10 ELSE 0 END AS DOUBLE) AS distance_m,
  CAST(CASE WHEN raw_m > 0 THEN ceil(raw_m * 2 / 10) * 10 ELSE 0 END AS DOUBLE) AS return_detour_m FROM r WHERE rk <= 3""")
def nearby_features(src: Source) -> DataFrame:
    out = cx.nearest_per_category(_nearby(src))
    return out.select("route_id", "category", "feature_id", "rank", half_up("raw_m", 6).alias("raw_m"), "distance_m", "return_detour_m")


@query("feature_counts", f"""{NEAR},
c AS (SELECT route_id, category_no AS category, count(*) AS n FROM b GROUP BY route_id, category_no), e AS (SELECT DISTINCT route_id, unnest(range(5)) AS category FROM route_vertices)
SELECT e.route_id, CAST(e.category AS INT) AS category, CAST(least(coalesce(n, 0), 3) AS BIGINT) AS shown, CAST(greatest(0, coalesce(n, 0) - 3) AS BIGINT) AS additional FROM e LEFT JOIN c ON c.route_id = e.route_id AND c.category = e.category""")
def feature_counts(src: Source) -> DataFrame:
    return cx.category_counts(_nearby(src), src.view("route_vertices"), categories=list(range(5)))


VIEWS["clock"] = "SELECT CAST(n_nationkey AS INT) AS area_id, CAST(TIMESTAMP '1995-03-01 12:00:00' + n_nationkey * INTERVAL '40' DAY AS TIMESTAMP) AS now FROM {nation}"
WORKS = f"""{given('works', 'clock')},
v AS (SELECT w.*, c.now FROM works w JOIN clock c ON c.area_id = w.area_id WHERE starts_at <= ends_at AND ends_at >= now AND starts_at <= now + INTERVAL 7 DAY)"""


def _works(src: Source) -> DataFrame:
    works = src.view("works")
    stamped = works.withColumns({c: F.col(c).cast("timestamp") for c in ("starts_at", "ends_at", "updated_at")})
    return cx.works_in_window(stamped, src.view("clock"))


@query("works_in_window", f"""{WORKS}, r AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY payload_pos) AS rn FROM v)
SELECT area_id, reference, CAST(rn AS INT) AS position FROM r WHERE rn <= 12""")
def works_in_window(src: Source) -> DataFrame:
    return cx.first_listed(_works(src), "area_id", "payload_pos").select("area_id", "reference", "position")


@query("works_summary", f"""{WORKS}
SELECT c.area_id, count(v.reference) AS records, strftime(max(v.updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at, count(v.reference) > 12 AS limited FROM clock c LEFT JOIN v ON v.area_id = c.area_id GROUP BY c.area_id""")
def works_summary(src: Source) -> DataFrame:
    return cx.works_summary(_works(src), src.view("clock")).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


VIEWS["forecasts"] = """
    SELECT CAST(o_custkey % 25 AS INT) AS area_id, o_orderkey AS run_id, CAST(o_orderkey % 31 AS INT) AS weather_code,
      CASE WHEN o_custkey % 25 = 24 THEN o_orderdate - INTERVAL '9000' DAY ELSE o_orderdate END AS forecast_at FROM {orders}"""


@query("next_forecast", f"""{given('forecasts', 'clock')},
r AS (SELECT f.*, row_number() OVER (PARTITION BY f.area_id ORDER BY CASE WHEN forecast_at >= now THEN 0 ELSE 1 END, CASE WHEN forecast_at >= now THEN forecast_at END, forecast_at DESC,
  CASE WHEN forecast_at >= now THEN run_id ELSE -run_id END) AS rn FROM forecasts f JOIN clock c ON c.area_id = f.area_id)
SELECT area_id, strftime(forecast_at, '%Y-%m-%d') AS forecast_at, run_id, weather_code FROM r WHERE rn = 1""")
def next_forecast(src: Source) -> DataFrame:
    forecasts = src.view("forecasts").withColumn("forecast_at", F.col("forecast_at").cast("timestamp"))
    return cx.next_forecast(forecasts, src.view("clock")).withColumn("forecast_at", F.date_format("forecast_at", "yyyy-MM-dd"))


VIEWS["attempts"] = "SELECT event_id, CAST(user_id % 5 AS INT) AS feed, ts, event_type IN ('view', 'click') AS ok FROM {events}"
VIEWS["reads"] = "SELECT event_id AS request_id, CAST(event_id % 5 AS INT) AS feed, ts FROM {events}"


@query("feed_freshness", f"""{given('attempts', 'reads')},
a AS (SELECT feed, epoch_us(ts) // 1000 AS at_ms FROM attempts WHERE ok), r AS (SELECT request_id, feed, epoch_us(ts) // 1000 AS at_ms FROM reads),
l AS (SELECT r.*, r.at_ms - a.at_ms AS age FROM r ASOF LEFT JOIN a ON a.feed = r.feed AND r.at_ms >= a.at_ms)
SELECT request_id, CASE WHEN age < 600000 THEN 'available' WHEN age < 3600000 THEN 'stale' ELSE 'unavailable' END AS state, CASE WHEN age < 3600000 THEN age END AS age_ms FROM l""")
def feed_freshness(src: Source) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    out = cx.feed_freshness(src.view("reads").select("request_id", "feed", ms.alias("at_ms")), src.view("attempts").select("feed", ms.alias("at_ms"), "ok"), 600_000, 3_600_000)
    return out.select("request_id", "state", "age_ms")


VIEWS["heat"] = """
    SELECT CAST(o_custkey % 30 AS INT) AS region, CAST(CASE WHEN o_custkey % 30 = 24 THEN 0 ELSE o_orderkey % 19 END AS INT) AS metric_value, o_orderdate AS date, o_orderkey AS payload_pos FROM {orders}"""
VIEWS["heat_pages"] = "SELECT CAST(n_nationkey AS INT) AS region, n_nationkey % 6 = 5 AS empty_page FROM {nation}"


@query("latest_heat_metric", f"""{given('heat', 'heat_pages')},
v AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC, payload_pos) AS rn FROM heat WHERE metric_value BETWEEN 1 AND 16)
SELECT p.region, CASE WHEN empty_page THEN 'no_active_alert' WHEN v.region IS NOT NULL THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN NOT empty_page THEN metric_value END AS risk_score,
  CASE WHEN NOT empty_page THEN strftime(date, '%Y-%m-%d') END AS as_of FROM heat_pages p LEFT JOIN v ON v.region = p.region AND rn = 1""")
def latest_heat_metric(src: Source) -> DataFrame:
    return cx.latest_heat_metric(src.view("heat"), src.view("heat_pages")).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


VIEWS["issues"] = """
    SELECT CAST(o_custkey % 50 AS INT) AS station, CASE WHEN o_orderkey % 3 = 0 THEN 'lift' ELSE 'station-disruption' END AS kind,
      concat(CASE WHEN o_orderkey % 2 = 0 THEN 'CLOSED ' ELSE 'closed ' END, o_orderpriority) AS summary, o_orderkey AS payload_pos FROM {orders}"""


@query("station_issues", f"""{given('issues')},
u AS (SELECT station, kind, lower(summary) AS k, min(payload_pos) AS payload_pos, arg_min(summary, payload_pos) AS summary FROM issues GROUP BY station, kind, lower(summary)),
r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY payload_pos) AS rn FROM u)
SELECT station, kind, summary, CAST(rn AS INT) AS position FROM r WHERE rn <= 6""")
def station_issues(src: Source) -> DataFrame:
    return cx.station_issues(src.view("issues"), limit=6).select("station", "kind", "summary", "position")


VIEWS["gazetteer"] = """
    SELECT CAST(floor(p_partkey / 200.0) AS INT) AS area_id, p_partkey AS payload_pos, p_name AS name, p_type AS kind, -0.12 + (p_partkey % 20) * 0.00001 AS lon, 51.5 + (p_partkey % 8) * 0.00001 AS lat FROM {part}"""
VIEWS["searches"] = """
    SELECT c_custkey AS query_id, CAST(floor(c_custkey / 150.0) AS INT) AS area_id, CASE c_custkey % 4 WHEN 0 THEN ' Red ' WHEN 1 THEN 'bolt eco' WHEN 2 THEN 'ro' ELSE 'RING' END AS text FROM {customer}"""


@query("search_places", f"""{given('gazetteer', 'searches')},
q AS (SELECT query_id, area_id, lower(trim(text)) AS t FROM searches WHERE length(trim(text)) BETWEEN 3 AND 80),
m AS (SELECT q.query_id, g.*, row_number() OVER (PARTITION BY q.query_id, lower(name), floor(lon * 1e5 + 0.5), floor(lat * 1e5 + 0.5) ORDER BY payload_pos) AS d FROM q JOIN gazetteer g ON g.area_id = q.area_id WHERE contains(lower(name || ' ' || kind), t)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY payload_pos) AS rn FROM m WHERE d = 1)
SELECT query_id, payload_pos, name, CAST(rn AS INT) AS position FROM r WHERE rn <= 8""")
def search_places(src: Source) -> DataFrame:
    from ..functions.text import place_query
    asked = src.view("searches").withColumn("text", place_query("text")).filter(F.col("text").isNotNull())
    return cx.search_places(src.view("gazetteer"), asked).select("query_id", "payload_pos", "name", "position")


VIEWS["trees_raw"] = """
    SELECT CAST(c_custkey + 1 AS VARCHAR(20)) AS uniqueid, CAST(51.5 + (c_custkey % 200) * 0.0001 AS VARCHAR(30)) AS lat, CAST(-0.15 + (c_custkey % 370) * 0.0001 AS VARCHAR(30)) AS lon,
      CASE WHEN c_custkey % 9 = 0 THEN 'Moon' WHEN c_custkey % 4 = 0 THEN 'Parks' ELSE 'Highways' END AS location FROM {customer}"""
VIEWS["tree_areas"] = """
    SELECT CAST(n_nationkey AS INT) AS area_id, -0.15 + n_nationkey * 0.001 AS b_west, 51.5 AS b_south, -0.14 + n_nationkey * 0.001 AS b_east, 51.51 AS b_north FROM {nation}"""


@query("validate_trees", f"""{given('trees_raw')} SELECT uniqueid, CASE WHEN location = 'Moon' THEN 'location' ELSE '' END AS problems FROM trees_raw""")
def validate_trees(src: Source) -> DataFrame:
    return src.view("trees_raw").select("uniqueid", F.array_join(reasons(cx.tree_checks()), ",").alias("problems"))


@query("tree_extract_counts", f"""{given('trees_raw', 'tree_areas')}
SELECT area_id, count(*) AS trees, CAST(0 AS BIGINT) AS repeated_ids, true AS usable FROM trees_raw JOIN tree_areas ON CAST(lon AS DOUBLE) BETWEEN b_west AND b_east AND CAST(lat AS DOUBLE) BETWEEN b_south AND b_north
WHERE location = 'Highways' GROUP BY area_id""")
def tree_extract_counts(src: Source) -> DataFrame:
    return cx.tree_extract_counts(cx.trees_by_area(src.view("trees_raw"), src.view("tree_areas")), max_trees=None)


VIEWS["context_rows"] = """
    SELECT CAST(c_nationkey AS INT) AS area_id, c_custkey % 1400 AS feature_id, 'public-realm-trees' AS source_kind, c_custkey % 1450 AS source_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'bench' ELSE 'toilet' END AS subtype,
      CASE WHEN c_custkey % 5 = 0 THEN 'toilet' ELSE 'rest' END AS category, CAST(c_custkey % 40 AS DOUBLE) AS lon, CAST(c_custkey % 30 AS DOUBLE) AS lat FROM {customer}"""


@query("validate_features", f"""{given('context_rows')},
f AS (SELECT *, count(*) OVER (PARTITION BY area_id, feature_id) AS n1, count(*) OVER (PARTITION BY area_id, source_id) AS n2 FROM context_rows)
SELECT area_id, feature_id, source_id, concat_ws(',', CASE WHEN NOT ((subtype = 'bench' AND category = 'rest') OR (subtype = 'toilet' AND category = 'toilet')) THEN 'subtype' END, CASE WHEN source_id <= 0 THEN 'source' END,
  CASE WHEN lon > 35 OR lat > 25 THEN 'position' END, CASE WHEN n1 > 1 THEN 'repeated-id' END, CASE WHEN n2 > 1 THEN 'repeated-source' END, CASE WHEN category = 'toilet' AND area_id % 7 = 0 THEN 'not-collected' END) AS problems FROM f""")
def validate_features(src: Source) -> DataFrame:
    box = {"west": 1.0, "south": 1.0, "east": 30.0, "north": 20.0, "b_west": 0.0, "b_south": 0.0, "b_east": 35.0, "b_north": 25.0}
    areas = src.table("nation").select(F.col("n_nationkey").cast("int").alias("area_id"), *[F.lit(v).alias(k) for k, v in box.items()],
                                       F.when(F.col("n_nationkey") % 7 == 0, F.array(F.lit("toilet"))).otherwise(F.array().cast("array<string>")).alias("not_collected"))
    return cx.feature_problems(src.view("context_rows"), areas).select("area_id", "feature_id", "source_id", F.array_join("problems", ",").alias("problems"))


# --- Events --------------------------------------------------------------------

BUCKET = "CASE WHEN duration_ms < 50 THEN 'under_50_ms' WHEN duration_ms < 200 THEN '50_to_199_ms' WHEN duration_ms < 1000 THEN '200_to_999_ms' WHEN duration_ms < 4000 THEN '1_to_3_999_s' ELSE '4_s_or_more' END"


@query("event_rollup", f"""{given('op_events')}
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, outcome, delivery, {BUCKET} AS duration_bucket, count(*) AS events FROM op_events WHERE outcome <> 'teapot' AND route_count <= 3 GROUP BY ALL""")
def event_rollup(src: Source) -> DataFrame:
    events = src.view("op_events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.event_rollup(ev.allow_listed(events), "1 hour").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def _timed(src: Source) -> DataFrame:
    return src.view("op_events").select("event_id", "client", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))


@query("trailing_counts", f"""{given('op_events')}, e AS (SELECT epoch_us(ts) // 1000 AS at_ms, client % 3 AS gate FROM op_events),
w AS (SELECT *, count(*) OVER (PARTITION BY gate ORDER BY at_ms RANGE BETWEEN 21599999 PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT DISTINCT gate, at_ms, n AS in_window, n > 28 AS over_limit FROM w""")
def trailing_counts(src: Source) -> DataFrame:
    gated = _timed(src).withColumn("gate", F.col("client") % 3)
    return ev.trailing_counts(gated, ["gate"], 21_600_000, 28).select("gate", "at_ms", "in_window", "over_limit")


@query("tumbling_admission", f"""{given('op_events')}
SELECT client, CAST(floor((epoch_us(ts) // 1000) / 86400000.0) AS BIGINT) AS window_no, count(*) AS requests, CAST(greatest(0, count(*) - 2) AS BIGINT) AS refused FROM op_events GROUP BY ALL""")
def tumbling_admission(src: Source) -> DataFrame:
    return ev.tumbling_admission(_timed(src), ["client"], 86_400_000, 2)


@query("anchored_admission", f"""WITH RECURSIVE {given('op_events')[5:]},
e AS (SELECT client, epoch_us(ts) // 1000 AS ms, count(*) AS n FROM op_events GROUP BY ALL),
w AS (SELECT client, min(ms) AS s FROM e GROUP BY client UNION ALL SELECT w.client, min(e.ms) FROM w JOIN e ON e.client = w.client AND e.ms >= w.s + 86400000 GROUP BY w.client)
SELECT w.client, s AS window_start_ms, CAST(sum(n) AS BIGINT) AS requests, CAST(greatest(0, sum(n) - 2) AS BIGINT) AS refused FROM w JOIN e ON e.client = w.client AND ms >= s AND ms < s + 86400000 GROUP BY w.client, s""")
def anchored_admission(src: Source) -> DataFrame:
    return ev.anchored_admission(_timed(src), ["client"], 86_400_000, 2)


@query("latest_generation", """SELECT user_id AS task, max(event_id) AS generation, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def latest_generation(src: Source) -> DataFrame:
    rows = src.table("events").select(F.col("user_id").alias("task"), F.col("event_id").alias("generation"), "event_type")
    return ev.latest_generation(rows, ["task"])


@query("reject_known", """WITH i AS (SELECT event_id % 9000 AS observation_id, event_id FROM events), c AS (SELECT *, count(*) OVER (PARTITION BY observation_id) AS n FROM i)
SELECT event_id, n = 1 AND observation_id NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0) AS accepted FROM c""")
def reject_known(src: Source) -> DataFrame:
    incoming = src.table("events").select((F.col("event_id") % 9000).alias("observation_id"), "event_id")
    stored = src.table("orders").filter(F.col("o_custkey") % 3 == 0).select(F.col("o_orderkey").alias("observation_id"))
    fresh, known = ev.reject_known(incoming, stored)
    return fresh.select("event_id", F.lit(True).alias("accepted")).unionByName(known.select("event_id", F.lit(False).alias("accepted")))


@query("first_by_id", "SELECT user_id AS id, min(event_id) AS ingest_pos, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_by_id(src: Source) -> DataFrame:
    return cx.first_by_id(src.table("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ingest_pos"), "event_type"))


@query("missing_members", "SELECT n_nationkey AS area_id, m AS segment FROM nation, (SELECT DISTINCT c_mktsegment AS m FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = m AND c_acctbal > 9500)")
def missing_members(src: Source) -> DataFrame:
    """Nation and segment combinations without a rich customer."""
    kinds = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    required = src.table("nation").select(F.col("n_nationkey").alias("area_id"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("segment"))
    present = src.table("customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("area_id"), F.col("c_mktsegment").alias("segment"))
    return cx.missing_members(present, required, ["area_id", "segment"])


@query("extract_drift", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'missing' ELSE 'unexpected' END AS drift FROM orders WHERE o_orderstatus = 'P'")
def extract_drift(src: Source) -> DataFrame:
    """Two extracts of the orders that disagree on the pending ones."""
    orders = src.table("orders").select("o_orderkey", "o_orderstatus")
    pending, even = F.col("o_orderstatus") == "P", F.col("o_orderkey") % 2 == 0
    return cx.extract_drift(orders.filter(~pending | even), orders.filter(~pending | ~even)).select("o_orderkey", "drift")
