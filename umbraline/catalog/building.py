"""Buildings: heights, footprint shade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up
from ..operators import footprints, geometry, polygons
from .registry import Source, VIEWS, given, query, r6
from .scoring import SEGMENT_SQL, SUN_SQL, planar_segments, with_slot_sun

# Outlines a little off the cell grid, one to three cells wide, with tag text.
VIEWS["outlines"] = """
    SELECT area_id, building_id, x0 + 1 AS xa, y0 - 1 AS ya, x0 + 1 + 4 * (1 + building_id % 3) AS xb, y0 - 1 + 4 * (1 + building_id % 2) AS yb,
      CASE building_id % 6 WHEN 0 THEN '12.5 m' WHEN 1 THEN '40 ft' WHEN 2 THEN 'tall' END AS height_tag,
      CASE building_id % 4 WHEN 1 THEN '3' WHEN 3 THEN '0' END AS levels_tag
    FROM {buildings}"""


def rectangle_edges(df: DataFrame, xa: str, ya: str, xb: str, yb: str, keys: list[str]) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner(xa, ya), corner(xb, ya), corner(xb, yb), corner(xa, yb))
    return polygons.ring_edges(df.select(*keys, ring.alias("ring")), keys).withColumn("ring_no", F.lit(0))


HEIGHTS_SQL = """
spot AS (SELECT *, x * 4 + 2.0 AS cx, -(y * 4 + 2.0) AS cy, height_steps * 0.5 AS h FROM cells WHERE validity = 255 AND height_steps > 0),
near AS (SELECT o.area_id, building_id, h, cx BETWEEN xa AND xb AND cy BETWEEN ya AND yb AS inside,
    sqrt(pow(greatest(xa - cx, 0, cx - xb), 2) + pow(greatest(ya - cy, 0, cy - yb), 2)) AS away
  FROM outlines o JOIN spot s ON s.area_id = o.area_id AND cx BETWEEN xa - 8 AND xb + 8 AND cy BETWEEN ya - 8 AND yb + 8),
med AS (SELECT area_id, building_id, coalesce(median(h) FILTER (inside), median(h) FILTER (away <= 4)) AS m FROM near GROUP BY area_id, building_id),
ras AS (SELECT area_id, building_id, floor(greatest(3, least(120, m)) / 0.5 + 0.5) * 0.5 AS raster_m FROM med WHERE m IS NOT NULL),
resolved AS (SELECT o.area_id, o.building_id, CAST(CASE building_id % 6 WHEN 0 THEN 12.5 WHEN 1 THEN 12.19 ELSE CASE WHEN levels_tag = '3' THEN 9.0 ELSE coalesce(raster_m, 12.0) END END AS DOUBLE) AS height_m,
    CASE WHEN building_id % 6 < 2 THEN 'explicit' WHEN levels_tag = '3' THEN 'levels' WHEN raster_m IS NOT NULL THEN 'raster' ELSE 'fallback' END AS source
  FROM outlines o LEFT JOIN ras USING (area_id, building_id))"""


def _resolved(src: Source) -> DataFrame:
    outlines = src.view("outlines")
    edges = rectangle_edges(outlines, "xa", "ya", "xb", "yb", ["area_id", "building_id"]).withColumn("polygon_id", F.col("building_id"))
    raster = polygons.zonal_building_height(edges, src.view("cells"), src.view("grids"))
    return footprints.resolve_building_heights(outlines, raster)


@query("building_heights", f"""{given('outlines', 'cells', 'grids')},{HEIGHTS_SQL}
SELECT area_id, building_id, height_m, source AS height_source FROM resolved""")
def building_heights(src: Source) -> DataFrame:
    return _resolved(src).select("area_id", "building_id", "height_m", "height_source")


@query("height_source_counts", f"""{given('outlines', 'cells', 'grids')},{HEIGHTS_SQL}
SELECT area_id, count(*) AS buildings, count(*) FILTER (source = 'explicit') AS explicit, count(*) FILTER (source = 'levels') AS levels,
  count(*) FILTER (source = 'raster') AS raster, count(*) FILTER (source = 'fallback') AS fallback FROM resolved GROUP BY area_id""")
def height_source_counts(src: Source) -> DataFrame:
    return footprints.height_source_counts(_resolved(src))


def _blocks(src: Source) -> tuple[DataFrame, DataFrame]:
    blocks = footprints.footprint_heights(src.view("buildings")).withColumns({
        "polygon_id": F.col("building_id"), "xb": F.col("x0") + 4, "yb": F.col("y0") + 4})
    return blocks, rectangle_edges(blocks, "x0", "y0", "xb", "yb", ["area_id", "polygon_id"])


def shade_ctes(points: str) -> str:
    """Slab test per axis-aligned block: independent of edges and bins.  ``points``: ray_id, area_id, px, py, azimuth, altitude."""
    return f"""
blk AS (SELECT area_id, building_id, x0, y0, x0 + 4 AS xb, y0 + 4 AS yb, CASE WHEN height_m IS NOT NULL THEN height_m WHEN levels > 0 THEN levels * 3 ELSE 6 END AS lo,
    CASE WHEN height_m IS NOT NULL THEN height_m WHEN levels > 0 THEN levels * 3 ELSE 12 END AS mo, CASE WHEN height_m IS NOT NULL THEN height_m WHEN levels > 0 THEN levels * 3 ELSE 18 END AS hi FROM buildings),
lim AS (SELECT area_id, max(hi) AS top FROM blk GROUP BY area_id),
ry AS (SELECT p.*, sin(radians(azimuth_deg)) AS ux, cos(radians(azimuth_deg)) AS uy, tan(radians(altitude_deg)) AS tg, (top - 1.5) / tan(radians(altitude_deg)) AS reach
  FROM {points} p JOIN lim ON lim.area_id = p.area_id WHERE altitude_deg > 0),
bx AS (SELECT *, unnest(range(CAST(floor(least(px, px + ux * reach) / 4) AS BIGINT) - 1, CAST(floor(greatest(px, px + ux * reach) / 4) AS BIGINT) + 2)) AS gx FROM ry),
by_ AS (SELECT *, px + ux * reach AS qx, CASE WHEN abs(ux * reach) < 1e-9 THEN py ELSE py + uy * greatest(0, least(reach, least((gx * 4 - px) / ux, (gx * 4 + 4 - px) / ux))) END AS ya,
    CASE WHEN abs(ux * reach) < 1e-9 THEN py + uy * reach ELSE py + uy * greatest(0, least(reach, greatest((gx * 4 - px) / ux, (gx * 4 + 4 - px) / ux))) END AS yb2 FROM bx),
bz AS (SELECT *, unnest(range(CAST(floor(least(ya, yb2) / 4) AS BIGINT) - 1, CAST(floor(greatest(ya, yb2) / 4) AS BIGINT) + 2)) AS gy FROM by_),
cand AS (SELECT DISTINCT r.ray_id, r.px, r.py, r.ux, r.uy, r.tg, r.reach, b.building_id, b.x0, b.y0, b.xb, b.yb, lo, mo, hi FROM bz r
  JOIN blk b ON b.area_id = r.area_id AND CAST(floor(b.x0 / 4) AS BIGINT) = r.gx AND CAST(floor(b.y0 / 4) AS BIGINT) = r.gy),
slab AS (SELECT *, greatest(least((x0 - px) / ux, (xb - px) / ux), least((y0 - py) / uy, (yb - py) / uy)) AS t0,
    least(greatest((x0 - px) / ux, (xb - px) / ux), greatest((y0 - py) / uy, (yb - py) / uy)) AS t1 FROM cand),
hit AS (SELECT *, greatest(0, t0) AS d, 1.5 + greatest(0, t0) * tg AS need FROM slab WHERE t1 >= greatest(0, t0) - 1e-9 AND greatest(0, t0) <= reach + 1e-9),
prob AS (SELECT ray_id, building_id, d, CASE WHEN lo = hi THEN CASE WHEN mo >= need THEN 1.0 ELSE 0.0 END WHEN need <= lo THEN 1.0 WHEN need >= hi THEN 0.0
    WHEN need <= mo THEN 1 - (need - lo) * (need - lo) / ((hi - lo) * (mo - lo)) ELSE (hi - need) * (hi - need) / ((hi - lo) * (hi - mo)) END AS p FROM hit),
tot AS (SELECT ray_id, product(1 - p) AS clear, max(CASE WHEN p >= 1 - 1e-12 THEN 1 ELSE 0 END) AS sure, min(d) AS nearest, count(*) AS n FROM prob WHERE p > 0 GROUP BY ray_id),
lit AS (SELECT p.*, altitude_deg > 0 AS daylight, CASE WHEN altitude_deg <= 0 THEN 0.0 ELSE greatest(0, least(1, coalesce(clear, 1.0))) END AS direct,
    CASE WHEN altitude_deg <= 0 OR clear IS NOT NULL THEN 0.0 ELSE 1.0 END AS best, CASE WHEN altitude_deg <= 0 OR sure = 1 THEN 0.0 ELSE 1.0 END AS worst, nearest, n
  FROM {points} p LEFT JOIN tot ON tot.ray_id = p.ray_id)"""


@query("footprint_point_shade", f"""{given('buildings', 'grids')},
raw AS (SELECT event_id AS ray_id, CAST(event_id % (SELECT count(*) FROM grids) AS INT) AS area_id, CAST((event_id * 13) % 1999 AS DOUBLE) / 10 + 0.013 AS px,
    -(CAST((event_id * 17) % 1599 AS DOUBLE) / 10) - 0.017 AS py, CAST(event_id % 60 AS BIGINT) AS minute FROM events),
pts AS (SELECT *, {SUN_SQL} FROM raw),{shade_ctes('pts')}
SELECT ray_id AS point_id, {r6('direct')} AS direct_probability, CAST(best AS DOUBLE) AS best_direct, CAST(worst AS DOUBLE) AS worst_direct, {r6('nearest')} AS nearest_m, CAST(coalesce(n, 0) AS INT) AS occluders FROM lit""")
def footprint_point_shade(src: Source) -> DataFrame:
    blocks, edges = _blocks(src)
    points = with_slot_sun(src.sql("""
        SELECT event_id AS point_id, CAST(event_id % (SELECT count(*) FROM {grids}) AS INT) AS area_id, CAST((event_id * 13) % 1999 AS DOUBLE) / 10 + 0.013D AS px,
          -(CAST((event_id * 17) % 1599 AS DOUBLE) / 10) - 0.017D AS py, CAST(event_id % 60 AS BIGINT) AS minute FROM {events}"""))
    out = footprints.point_shade(points, edges, blocks)
    return out.select("point_id", half_up("direct_probability", 6).alias("direct_probability"), "best_direct", "worst_direct",
                      half_up("nearest_m", 6).alias("nearest_m"), F.coalesce(F.size("occluders"), F.lit(0)).alias("occluders"))


# Shifted a little off the metre grid so no ray runs along a wall.
@query("footprint_route_score", f"""{given('buildings', 'route_vertices', 'routes')},{SEGMENT_SQL},
timed AS (SELECT row_number() OVER () AS ray_id, s.area_id, s.route_id, easting + 0.013 AS px, northing - 0.017 AS py, piece_m,
    CAST(floor((departure_ms + mid_fraction * total_m / 1.2 * 1000) / 60000) AS BIGINT) AS minute FROM samples s JOIN routes r ON r.route_id = s.route_id WHERE length_positive),
pts AS (SELECT *, {SUN_SQL} FROM timed),{shade_ctes('pts')},
sums AS (SELECT route_id, sum(piece_m) AS m, sum(CASE WHEN daylight THEN piece_m / 1.2 ELSE 0 END) AS up, sum(CASE WHEN daylight THEN piece_m / 1.2 * direct ELSE 0 END) AS su,
    sum(CASE WHEN daylight THEN piece_m / 1.2 * best ELSE 0 END) AS be, sum(CASE WHEN daylight THEN piece_m / 1.2 * worst ELSE 0 END) AS wo FROM lit GROUP BY route_id)
SELECT r.route_id, {r6('coalesce(m, 0)')} AS distance_m, {r6('coalesce(m, 0) / 1.2')} AS duration_s, {r6('coalesce(su, 0)')} AS sun_s, {r6('coalesce(be, 0)')} AS best_s, {r6('coalesce(wo, 0)')} AS worst_s,
  coalesce(up, 0) > 0 AS is_daylight, CASE WHEN up > 0 THEN {r6('greatest(0, least(100, (up - su) / up * 100))')} END AS shade_percent,
  CASE WHEN m IS NOT NULL AND r.area_id IN (SELECT area_id FROM blk) THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS coverage_percent
FROM routes r LEFT JOIN sums USING (route_id)""".replace("WHERE length_positive", "WHERE piece_m > 1e-9"))
def footprint_route_score(src: Source) -> DataFrame:
    blocks, edges = _blocks(src)
    routes = src.view("routes").select("route_id", "area_id", "departure_ms")
    segs = planar_segments(src).join(routes, "route_id")

    def cut(lines: DataFrame, along: list[str]) -> DataFrame:
        samples = geometry.densify(lines, carry=("departure_ms", *along)).filter(F.col("piece_m") > 1e-9)
        return with_slot_sun(samples.select(
            "route_id", "sample_idx", (F.col("x_mid") + 0.013).alias("px"), (F.col("y_mid") - 0.017).alias("py"), "piece_m",
            F.floor((F.col("departure_ms") + F.col("mid_fraction") * F.col("total_m") / footprints.WALKING_MPS * 1000) / 60_000).alias("minute"), *along))

    shaded = footprints.cut_shade(segs, cut, edges, blocks, ["route_id", "sample_idx"], ["piece_m"], salt="route_id",
                                  blank={"pieces": F.lit(1), "length_m": F.lit(1.0)}, slack_m=0.02)
    out = footprints.route_score(shaded, ["route_id"], routes=routes)
    return out.select("route_id", *[half_up(c, 6).alias(c) for c in ("distance_m", "duration_s", "sun_s", "best_s", "worst_s")], "is_daylight",
                      half_up("shade_percent", 6).alias("shade_percent"), "coverage_percent")
