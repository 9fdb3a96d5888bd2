"""Column functions over whole tables: distances, projections, sun, heights, civil time, text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import civil, geo, heights, lookups, solar, text
from ..functions.basics import half_up
from ..operators import geometry, scoring
from .registry import Source, VIEWS, given, haversine_sql, query, r6

VIEWS["pings"] = """
    SELECT event_id, ts, -0.145 + (event_id * 37 % 4000) * 0.00001 AS lon, 51.49 + (event_id * 53 % 5000) * 0.00001 AS lat,
      -0.145 + (event_id * 41 % 4000) * 0.00001 AS lon2, 51.49 + (event_id * 59 % 5000) * 0.00001 AS lat2
    FROM {events}"""


@query("haversine", f"""{given('pings')}
SELECT event_id, {r6(haversine_sql('lat', 'lon', 'lat2', 'lon2'))} AS route_m, {r6(haversine_sql('lat', 'lon', 'lat2', 'lon2', geo.MEAN_RADIUS_M))} AS mean_m FROM pings""")
def haversine(src: Source) -> DataFrame:
    args = ("lat", "lon", "lat2", "lon2")
    return src.view("pings").select("event_id", half_up(geo.haversine_m(*args), 6).alias("route_m"),
                                    half_up(geo.haversine_m(*args, geo.MEAN_RADIUS_M, "atan2"), 6).alias("mean_m"))


@query("local_plane", f"""{given('pings')},
p AS (SELECT event_id, lon, lat, lon2, lat2, {geo.MEAN_RADIUS_M} * radians(lon2 - lon) * cos(radians(lat)) AS x, {geo.MEAN_RADIUS_M} * radians(lat2 - lat) AS y FROM pings)
SELECT event_id, {r6('x')} AS x, {r6('y')} AS y, {r6('lon2')} AS back_lon, {r6('lat2')} AS back_lat FROM p""")
def local_plane(src: Source) -> DataFrame:
    x, y = geo.local_xy("lat2", "lon2", "lat", "lon")
    df = src.view("pings").withColumns({"x": x, "y": y})
    lat, lon = geo.local_lat_lon("x", "y", "lat", "lon")
    return df.select("event_id", half_up("x", 6).alias("x"), half_up("y", 6).alias("y"), half_up(lon, 6).alias("back_lon"), half_up(lat, 6).alias("back_lat"))


def bng_ctes() -> str:
    """Forward projection, written from the published series."""
    a, b, e2w = geo.WGS84_A, geo.WGS84_B, 1 - (geo.WGS84_B / geo.WGS84_A) ** 2
    aa, ab, e2 = geo.AIRY_A, geo.AIRY_B, 1 - (geo.AIRY_B / geo.AIRY_A) ** 2
    n = (aa - ab) / (aa + ab)
    rx, ry, rz = (math.radians(s / 3600) for s in geo.SHIFT_ARCSEC)
    dx, dy, dz = geo.SHIFT_M
    m = 1 + geo.SHIFT_PPM / 1e6
    out = f"""
b0 AS (SELECT *, radians(lat) AS f, radians(lon) AS l FROM pings), b1 AS (SELECT *, {a}::DOUBLE / sqrt(1 - {e2w!r} * sin(f) * sin(f)) AS nw FROM b0),
b2 AS (SELECT *, (nw * cos(f) * cos(l) - {dx}) / {m!r} AS x, (nw * cos(f) * sin(l) - {dy}) / {m!r} AS y, ({1 - e2w!r} * nw * sin(f) - {dz}) / {m!r} AS z FROM b1),
b3 AS (SELECT event_id, x + {rz!r} * y - {ry!r} * z AS x, -{rz!r} * x + y + {rx!r} * z AS y, {ry!r} * x - {rx!r} * y + z AS z FROM b2),
g0 AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(y, x) AS lam, atan2(z, sqrt(x * x + y * y) * {1 - e2!r}) AS phi FROM b3)"""
    for i in range(1, 6):
        out += f""",
g{i} AS (SELECT * REPLACE (atan2(z + {e2!r} * {aa}::DOUBLE / sqrt(1 - {e2!r} * sin(phi) * sin(phi)) * sin(phi), p) AS phi) FROM g{i - 1})"""
    f0, k = math.radians(49), 0.9996012717
    return out + f""",
t0 AS (SELECT *, {aa * k!r} / sqrt(1 - {e2!r} * sin(phi) ** 2) AS nu, {aa * k * (1 - e2)!r} / (1 - {e2!r} * sin(phi) ** 2) ** 1.5 AS rho, tan(phi) ** 2 AS t, cos(phi) AS c, lam - {math.radians(-2)!r} AS d FROM g5),
t1 AS (SELECT *, nu / rho - 1 AS eta, {ab * k!r} * ({1 + n + 1.25 * n**2 + 1.25 * n**3!r} * (phi - {f0!r}) - {3 * n + 3 * n**2 + 2.625 * n**3!r} * sin(phi - {f0!r}) * cos(phi + {f0!r})
    + {1.875 * (n**2 + n**3)!r} * sin(2 * (phi - {f0!r})) * cos(2 * (phi + {f0!r})) - {35 / 24 * n**3!r} * sin(3 * (phi - {f0!r})) * cos(3 * (phi + {f0!r}))) AS arc FROM t0),
bng AS (SELECT event_id, 400000 + nu * c * d + nu * c ** 3 / 6 * (nu / rho - t) * d ** 3 + nu * c ** 5 / 120 * (5 - 18 * t + t * t + 14 * eta - 58 * t * eta) * d ** 5 AS e,
    -100000 + arc + nu / 2 * sin(phi) * c * d ** 2 + nu / 24 * sin(phi) * c ** 3 * (5 - t + 9 * eta) * d ** 4 + nu / 720 * sin(phi) * c ** 5 * (61 - 58 * t + t * t) * d ** 6 AS n FROM t1)"""


@query("national_grid", f"""{given('pings')},{bng_ctes()}
SELECT event_id, floor(e * 1000 + 0.5) / 1000 AS easting, floor(n * 1000 + 0.5) / 1000 AS northing FROM bng""")
def national_grid(src: Source) -> DataFrame:
    return geo.with_bng(src.view("pings")).select("event_id", half_up("easting", 3).alias("easting"), half_up("northing", 3).alias("northing"))


@query("national_grid_inverse", f"{given('pings')} SELECT event_id, {r6('lon')} AS lon, {r6('lat')} AS lat FROM pings")
def national_grid_inverse(src: Source) -> DataFrame:
    there = geo.with_bng(src.view("pings")).select("event_id", "easting", "northing")
    return geo.with_lon_lat(there).select("event_id", half_up("lon", 6).alias("lon"), half_up("lat", 6).alias("lat"))


SOLAR = f"""{given('pings')},
s0 AS (SELECT event_id, lon, lat, (epoch_us(ts) // 1000)::DOUBLE AS ms, ((epoch_us(ts) // 1000) / 86400000.0::DOUBLE + 2440587.5 - 2451545) / 36525 AS t FROM pings),
s1 AS (SELECT *, ((280.46646 + t * (36000.76983 + t * 0.0003032)) % 360 + 360) % 360 AS l0, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m,
    0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS e, radians(125.04 - 1934.136 * t) AS om, 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 AS ob FROM s0),
s2 AS (SELECT *, l0 + sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289 - 0.00569 - 0.00478 * sin(om) AS app, radians(ob + 0.00256 * cos(om)) AS obr FROM s1),
s3 AS (SELECT *, asin(sin(obr) * sin(radians(app))) AS dec, tan(obr / 2) * tan(obr / 2) AS y FROM s2),
s4 AS (SELECT *, 4 * degrees(y * sin(2 * radians(l0)) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * radians(l0)) - 0.5 * y * y * sin(4 * radians(l0)) - 1.25 * e * e * sin(2 * m)) AS eot FROM s3),
s5 AS (SELECT *, ((fmod(ms, 86400000.0) / 60000 + eot + 4 * lon) % 1440 + 1440) % 1440 / 4 - 180 AS ha FROM s4),
sun AS (SELECT event_id, degrees(asin(greatest(-1, least(1, sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(radians(ha)))))) AS altitude_deg,
    (degrees(atan2(sin(radians(ha)), cos(radians(ha)) * sin(radians(lat)) - tan(dec) * cos(radians(lat)))) + 180) % 360 AS azimuth_deg FROM s5)"""


@query("solar_position", f"""{SOLAR}
SELECT event_id, {r6('azimuth_deg')} AS azimuth_deg, {r6('altitude_deg')} AS altitude_deg, altitude_deg > 0 AS daylight,
  CASE CAST(floor(azimuth_deg / 45 + 0.5) AS INT) % 8 WHEN 0 THEN 'north' WHEN 1 THEN 'north-east' WHEN 2 THEN 'east' WHEN 3 THEN 'south-east' WHEN 4 THEN 'south'
    WHEN 5 THEN 'south-west' WHEN 6 THEN 'west' ELSE 'north-west' END AS direction,
  {r6('CASE WHEN altitude_deg > 1 THEN 1.5 + 20 * tan(radians(altitude_deg)) END')} AS needed_m FROM sun""")
def solar_position(src: Source) -> DataFrame:
    placed = solar.with_solar_position(src.view("pings").withColumn("epoch_ms", civil.epoch_ms(F.col("ts").cast("timestamp"))))
    needed = F.when(F.col("altitude_deg") > 1, heights.required_height(F.lit(20.0), "altitude_deg"))
    return placed.select("event_id", half_up("azimuth_deg", 6).alias("azimuth_deg"), half_up("altitude_deg", 6).alias("altitude_deg"), "daylight",
                         geo.compass_point("azimuth_deg").alias("direction"), half_up(needed, 6).alias("needed_m"))


@query("cell_index", f"""{given('route_vertices', 'grids')}
SELECT route_id, seq, CASE WHEN ok THEN CAST(cx AS INT) END AS x, CASE WHEN ok THEN CAST(cy AS INT) END AS y, CASE WHEN ok THEN CAST(cy * width + cx AS BIGINT) END AS cell_no FROM (
  SELECT route_id, seq, width, floor((x_m * 1.25 - 20 - west) / res_m) AS cx, floor((north - y_m * 1.25 + 20) / res_m) AS cy,
    floor((x_m * 1.25 - 20 - west) / res_m) BETWEEN 0 AND width - 1 AND floor((north - y_m * 1.25 + 20) / res_m) BETWEEN 0 AND height - 1 AS ok
  FROM route_vertices v JOIN grids g ON g.area_id = v.area_id) s""")
def cell_index(src: Source) -> DataFrame:
    moved = src.view("route_vertices").select("route_id", "seq", "area_id", (F.col("x_m") * 1.25 - 20).alias("easting"), (F.col("y_m") * 1.25 - 20).alias("northing"))
    return geo.with_cell_index(moved.join(src.view("grids"), "area_id")).select("route_id", "seq", "x", "y", "cell_no")


@query("triangular_exceedance", f"""
WITH p AS (SELECT p_partkey, CAST(p_size % 7 AS DOUBLE) AS a, CAST(p_size % 7 + p_size % 3 * 2 AS DOUBLE) AS m, CAST(p_size % 7 + p_size % 3 * 2 + p_partkey % 4 AS DOUBLE) AS b, CAST(p_partkey % 17 AS DOUBLE) / 1.3 AS r FROM part)
SELECT p_partkey, {r6('CASE WHEN a = b THEN CASE WHEN r <= a THEN 1 ELSE 0 END WHEN r <= a THEN 1 WHEN r >= b THEN 0 WHEN r <= m AND m > a THEN 1 - (r - a) * (r - a) / ((b - a) * (m - a)) ELSE (b - r) * (b - r) / ((b - a) * (b - m)) END')} AS chance FROM p""")
def triangular_exceedance(src: Source) -> DataFrame:
    df = src.sql("""SELECT p_partkey, CAST(p_size % 7 AS DOUBLE) AS a, CAST(p_size % 7 + p_size % 3 * 2 AS DOUBLE) AS m,
        CAST(p_size % 7 + p_size % 3 * 2 + p_partkey % 4 AS DOUBLE) AS b, CAST(p_partkey % 17 AS DOUBLE) / 1.3D AS r FROM {part}""")
    return df.select("p_partkey", half_up(heights.triangular_exceedance("r", "a", "m", "b"), 6).alias("chance"))


@query("parsed_heights", """
WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 10 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN s || ' m' WHEN 1 THEN s || '.25metres' WHEN 2 THEN s || ' FT' WHEN 3 THEN s || '''' || (s % 14) || '"' WHEN 4 THEN s || '''' WHEN 5 THEN 'about ' || s
    WHEN 6 THEN (s * 100) || 'm' WHEN 7 THEN '0 m' WHEN 8 THEN ' ' || s || '.5 ' ELSE NULL END AS tag,
  CAST(CASE k WHEN 0 THEN s WHEN 1 THEN s + 0.25 WHEN 2 THEN floor(s * 0.3048::DOUBLE * 100 + 0.5) / 100 WHEN 3 THEN CASE WHEN s % 14 < 12 THEN floor((s * 0.3048::DOUBLE + (s % 14) * 0.0254::DOUBLE) * 100 + 0.5) / 100 END
    WHEN 4 THEN floor(s * 0.3048::DOUBLE * 100 + 0.5) / 100 WHEN 6 THEN CASE WHEN s * 100 <= 1000 THEN s * 100 END WHEN 8 THEN s + 0.5 END AS DOUBLE) AS metres FROM p""")
def parsed_heights(src: Source) -> DataFrame:
    df = src.sql("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN concat(p_size, ' m') WHEN 1 THEN concat(p_size, '.25metres') WHEN 2 THEN concat(p_size, ' FT')
        WHEN 3 THEN concat(p_size, "'", p_size % 14, '"') WHEN 4 THEN concat(p_size, "'") WHEN 5 THEN concat('about ', p_size) WHEN 6 THEN concat(p_size * 100, 'm')
        WHEN 7 THEN '0 m' WHEN 8 THEN concat(' ', p_size, '.5 ') END AS tag FROM {part}""")
    return df.withColumn("metres", heights.parsed_height_m("tag"))


@query("civil_time", """
WITH w AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderdate + to_minutes(CAST(o_orderkey * 17 % 1440 AS INT)) AS u FROM orders),
z AS (SELECT *, CAST(timezone('Europe/London', timezone('UTC', u)) AS TIMESTAMP) AS local_ FROM w)
SELECT o_orderkey, strftime(local_, '%Y-%m-%dT%H:%M') AS local_time, CAST(hour(local_) * 60 + minute(local_) AS INT) AS minutes,
  strftime(CASE WHEN hour(local_) BETWEEN 7 AND 18 THEN date_trunc('hour', local_) + to_minutes(CAST(ceil(minute(local_) / 15.0) * 15 AS INT)) ELSE date_trunc('day', local_) + to_minutes(870) END, '%Y-%m-%dT%H:%M') AS departure,
  strftime(local_, '%Y-%m-%d') || 'T09:00' AS at_nine,
  d || 'T' || lpad(CAST(least(1425, o_orderkey % 2000) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(least(1425, o_orderkey % 2000) % 60 AS VARCHAR), 2, '0') AS at_minutes
FROM z""")
def civil_time(src: Source) -> DataFrame:
    df = src.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.timestamp_add(
        "MINUTE", (F.col("o_orderkey") * 17 % 1440).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("u"))
    df = df.withColumn("local_time", civil.local_from_instant("u"))
    return df.select("o_orderkey", "local_time", civil.minutes_of_day("local_time").alias("minutes"), civil.default_departure("u").alias("departure"),
                     civil.with_local_hour("local_time", F.lit(9)).alias("at_nine"), civil.local_at_minutes("d", F.col("o_orderkey") % 2000).alias("at_minutes"))


# Parsing local time must reject the spring gap and take the earlier autumn instant.
@query("civil_time_instants", """
WITH w AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-03-31 00:00:00' WHEN 1 THEN TIMESTAMP '2024-10-27 00:00:00' ELSE date_trunc('day', ts) END + to_minutes(CAST(event_id * 7 % 300 AS INT)) AS wall FROM events),
i AS (SELECT *, wall - INTERVAL 1 HOUR AS a, wall AS b FROM w),
c AS (SELECT *, CAST(timezone('Europe/London', timezone('UTC', a)) AS TIMESTAMP) = wall AS a_ok, CAST(timezone('Europe/London', timezone('UTC', b)) AS TIMESTAMP) = wall AS b_ok FROM i)
SELECT event_id, strftime(CASE WHEN a_ok THEN a WHEN b_ok THEN b END, '%Y-%m-%dT%H:%M') AS instant FROM c""")
def civil_time_instants(src: Source) -> DataFrame:
    df = src.sql("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-03-31 00:00:00' WHEN 1 THEN TIMESTAMP '2024-10-27 00:00:00' ELSE date_trunc('DAY', CAST(ts AS TIMESTAMP)) END AS d FROM {events}""")
    wall = F.date_format(F.timestamp_add("MINUTE", (F.col("event_id") * 7 % 300).cast("int"), F.col("d")), civil.LOCAL_FORMAT)
    return df.select("event_id", F.date_format(civil.instant_from_local(wall), civil.LOCAL_FORMAT).alias("instant"))


@query("walking_pace", f"{given('routes')} SELECT route_id, duration_s * CASE pace WHEN 'slow' THEN 1.5 WHEN 'brisk' THEN 0.8 ELSE 1.0 END::DOUBLE AS walk_s FROM routes")
def walking_pace(src: Source) -> DataFrame:
    return src.view("routes").select("route_id", lookups.pace_duration("duration_s", "pace").alias("walk_s"))


@query("weather_text", f"""
WITH w AS (SELECT event_id, CAST(event_id % 32 AS INT) AS code FROM events)
SELECT event_id, CASE code {' '.join(f"WHEN {k} THEN '{v}'" for k, v in lookups.WEATHER.items())} END AS condition,
  CASE WHEN code < 2 THEN 'clear-or-sunny' WHEN code < 4 THEN 'partly-cloudy' WHEN code IN (7, 8) THEN 'cloudy-or-overcast' ELSE 'not-separately-reported' END AS cloud_signal FROM w""")
def weather_text(src: Source) -> DataFrame:
    df = src.table("events").select("event_id", (F.col("event_id") % 32).cast("int").alias("code"))
    return df.select("event_id", lookups.weather_condition("code").alias("condition"), lookups.cloud_signal("code").alias("cloud_signal"))


@query("clean_text", """
SELECT doc_id, nullif(substring(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '[ \\t\\n\\f\\r\\x{0B}]+', ' ', 'g')), 1, 500), '') AS bounded,
  CASE WHEN regexp_matches(text, '^[\\t\\r ]*[=+\\-@]') THEN '''' || text ELSE text END AS safe FROM documents""")
def clean_text(src: Source) -> DataFrame:
    return src.table("documents").select("doc_id", text.bounded_text("text").alias("bounded"), text.spreadsheet_safe("text").alias("safe"))


@query("tree_labels", """
WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Not Provided' WHEN 1 THEN ' ' ELSE c_mktsegment END AS n1, CASE c_custkey % 3 WHEN 0 THEN 'N/A' ELSE '  ' || c_name || ' ' END AS n2, c_mktsegment AS n3 FROM customer)
SELECT c_custkey, CASE WHEN trim(n1) <> '' AND lower(n1) NOT IN ('not provided', 'unknown', 'n/a') THEN trim(n1) WHEN lower(n2) <> 'n/a' THEN trim(n2) ELSE n3 END AS label FROM c""")
def tree_labels(src: Source) -> DataFrame:
    df = src.sql("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Not Provided' WHEN 1 THEN ' ' ELSE c_mktsegment END AS n1,
        CASE c_custkey % 3 WHEN 0 THEN 'N/A' ELSE concat('  ', c_name, ' ') END AS n2, c_mktsegment AS n3 FROM {customer}""")
    return df.select("c_custkey", text.usable_name("n1", "n2", "n3").alias("label"))


@query("buffered_areas", f"""{given('grids')}, b AS (SELECT area_id, -0.12 + area_id * 0.01 AS w, 51.5 AS s, -0.10 + area_id * 0.01 AS e, 51.52 AS n FROM grids)
SELECT area_id, {r6('w - 250.0::DOUBLE / (111320 * greatest(0.1, cos(radians((s + n) / 2))))')} AS west, {r6('s - 250.0::DOUBLE / 111320')} AS south,
  {r6('e + 250.0::DOUBLE / (111320 * greatest(0.1, cos(radians((s + n) / 2))))')} AS east, {r6('n + 250.0::DOUBLE / 111320')} AS north FROM b""")
def buffered_areas(src: Source) -> DataFrame:
    df = src.sql("SELECT area_id, -0.12D + area_id * 0.01D AS w, 51.5D AS s, -0.10D + area_id * 0.01D AS e, 51.52D AS n FROM {grids}")
    box = geo.buffered_bbox("w", "s", "e", "n", 250)
    return df.select("area_id", *[half_up(c, 6).alias(n) for c, n in zip(box, ("west", "south", "east", "north"))])


@query("route_lengths", f"""{given('geo_vertices')},
h AS (SELECT route_id, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM geo_vertices WINDOW w AS (PARTITION BY route_id ORDER BY seq))
SELECT route_id, count(*) AS points, {r6(f"coalesce(sum({haversine_sql('plat', 'plon', 'lat', 'lon')}) FILTER (plon IS NOT NULL), 0.0)")} AS geometry_m FROM h GROUP BY route_id""")
def route_lengths(src: Source) -> DataFrame:
    return geometry.route_lengths(src.view("geo_vertices")).withColumn("geometry_m", half_up("geometry_m", 6))


@query("schedule_offsets", f"""{given('routes')}
SELECT route_id, CAST(j AS INT) AS journey, departure_ms + j * repeat_min * 60000 AS leaves_ms, departure_ms AS base_ms FROM (SELECT *, unnest(range(journey_count)) AS j FROM routes)""")
def schedule_offsets(src: Source) -> DataFrame:
    from ..operators.profile import journey_departure
    out = scoring.expand_journeys(src.view("routes")).withColumn("leaves_ms", F.col("journey_departure_ms").cast("bigint"))
    base = journey_departure(F.col("leaves_ms"), F.col("journey"), F.col("repeat_min"), inverse=True)
    return out.select("route_id", "journey", "leaves_ms", base.cast("bigint").alias("base_ms"))
