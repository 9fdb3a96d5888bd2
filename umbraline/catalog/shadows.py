"""Shadow frames and cell building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up
from ..operators import raster, shadows
from .registry import Source, VIEWS, given, query, r6

# Five frames per area: three high suns, one low sun, one night.
VIEWS["frames"] = """
    SELECT CAST(area_id * 10 + slot AS INT) AS frame_id, area_id, CAST((area_id * 53 + slot * 77) % 360 AS DOUBLE) + CAST(0.37 AS DOUBLE) AS azimuth_deg,
      CAST(CASE slot WHEN 0 THEN 51.3 WHEN 1 THEN 33.7 WHEN 2 THEN 23.1 WHEN 3 THEN 2.5 ELSE -4.0 END AS DOUBLE) AS altitude_deg
    FROM (SELECT DISTINCT area_id, x % 5 AS slot FROM {cells}) s"""
# Native pixels: one per order, 1 m apart, with holes.
VIEWS["pixels"] = """
    SELECT CAST(floor(o_orderkey / 15000.0) AS INT) AS area_id, CAST((o_orderkey % 15000) % 150 AS INT) AS px, CAST(floor((o_orderkey % 15000) / 150.0) AS INT) AS py,
      CAST((o_orderkey * 7) % 23 AS DOUBLE) AS dtm, CAST((o_orderkey * 7) % 23 + CASE WHEN o_orderkey % 501 = 7 THEN 200 ELSE (o_orderkey * 13) % 41 - 5 END AS DOUBLE) AS dsm,
      CAST(22 AS DOUBLE) AS nodata_dtm, CAST(0 AS DOUBLE) AS nodata_dsm
    FROM {orders}"""

CAST_CTES = f"""{given('cells', 'grids', 'frames')},
good AS (SELECT * FROM cells WHERE validity = 255 AND surf_min <= surf_max),
ext AS (SELECT c.area_id, max(CASE WHEN validity = 255 THEN surf_max END) - min(CASE WHEN validity = 255 THEN terrain END) AS tallest, min(CASE WHEN validity = 255 THEN 1 ELSE 0 END) AS complete FROM cells c GROUP BY c.area_id),
f0 AS (SELECT f.frame_id, f.area_id, azimuth_deg, altitude_deg, g.width, g.height, tan(radians(altitude_deg)) AS tg, tallest, complete,
    CASE WHEN tallest > 1.5 THEN (tallest - 1.5) / tan(radians(altitude_deg)) ELSE 0.0 END AS natural_m FROM frames f JOIN grids g ON g.area_id = f.area_id JOIN ext ON ext.area_id = f.area_id WHERE altitude_deg > 0),
f1 AS (SELECT *, CASE WHEN complete = 1 THEN least(250.0, natural_m) ELSE 250.0 END AS trace_m, -sin(radians(azimuth_deg)) AS de, cos(radians(azimuth_deg)) AS ds FROM f0),
f2 AS (SELECT *, greatest(abs(de), abs(ds)) AS dom FROM f1),
f3 AS (SELECT *, unnest(range(1, 1 + CAST(floor(trace_m * dom / 4.0) AS BIGINT))) AS k FROM f2),
offs AS (SELECT frame_id, area_id, tg, natural_m > 250 AS limited, CAST(floor(de * k / dom + 0.5) AS BIGINT) AS dx, CAST(floor(ds * k / dom + 0.5) AS BIGINT) AS dy, trace_m FROM f3),
offd AS MATERIALIZED (SELECT *, sqrt(dx * dx + dy * dy) * 4.0 AS dist FROM offs WHERE sqrt(dx * dx + dy * dy) * 4.0 <= trace_m),
pairs AS MATERIALIZED (SELECT o.frame_id, t.area_id, t.x, t.y, max(CASE WHEN s.validity = 255 AND s.surf_min >= t.terrain + 1.5 + dist * tg + 2 THEN 1 ELSE 0 END) AS sure,
    max(CASE WHEN NOT limited AND s.validity = 255 AND s.surf_max >= t.terrain + 1.5 + dist * tg - 2 THEN 1 ELSE 0 END) AS maybe, max(CASE WHEN s.validity <> 255 THEN 1 ELSE 0 END) AS hidden
  FROM offd o JOIN cells t ON t.area_id = o.area_id JOIN cells s ON s.area_id = t.area_id AND s.x = t.x - o.dx AND s.y = t.y - o.dy GROUP BY o.frame_id, t.area_id, t.x, t.y),
full_ AS (SELECT f.frame_id, c.area_id, c.x, c.y, c.validity = 255 AS ok, natural_m > 250 AS limited, coalesce(sure, 0) AS sure, coalesce(maybe, 0) AS maybe, coalesce(hidden, 0) AS hidden,
    c.surf_min - c.terrain >= 3.5 AS own_sure, c.surf_max - c.terrain > 1.5 AS own_maybe, natural_m,
    4.0 * least(CASE WHEN de < 0 THEN (width - c.x - 0.5) / -de WHEN de > 0 THEN (c.x + 0.5) / de ELSE 1e18 END, CASE WHEN ds < 0 THEN (height - c.y - 0.5) / -ds WHEN ds > 0 THEN (c.y + 0.5) / ds ELSE 1e18 END) AS edge_m
  FROM f2 f JOIN cells c ON c.area_id = f.area_id LEFT JOIN pairs p ON p.frame_id = f.frame_id AND p.area_id = c.area_id AND p.x = c.x AND p.y = c.y),
shadow AS (SELECT frame_id, area_id, x, y, CASE WHEN ok AND (own_sure OR sure = 1) THEN 'certain'
    WHEN NOT ok OR hidden = 1 OR (natural_m > 0 AND edge_m < least(natural_m, 250)) THEN 'unknown' WHEN limited THEN 'search-limited'
    WHEN own_maybe OR maybe = 1 THEN 'possible' ELSE 'clear' END AS state FROM full_)"""


@query("ground_shadow", f"{CAST_CTES} SELECT frame_id, area_id, x, y, state FROM shadow")
def ground_shadow(src: Source) -> DataFrame:
    return shadows.ground_shadow(src.view("cells"), src.view("grids"), src.view("frames"))


@query("shadow_summary", f"""{CAST_CTES},
c AS (SELECT frame_id, count(*) AS n, {', '.join(f"sum(CASE WHEN state = '{s}' THEN 1.0 ELSE 0.0 END) AS n_{s[:3]}" for s in shadows.STATES)} FROM shadow GROUP BY frame_id)
SELECT f.frame_id, altitude_deg > 0 AS daylight, altitude_deg > 0 AND altitude_deg < 3 AS low_sun,
  CASE WHEN altitude_deg <= 0 THEN 100.0 ELSE {r6('(n_cer + n_pos) / n * 100')} END AS shadow_percent, coalesce({r6('n_cer / n * 100')}, 0.0) AS certain_percent,
  coalesce({r6('n_pos / n * 100')}, 0.0) AS possible_percent, coalesce({r6('n_unk / n * 100')}, 0.0) AS unknown_percent, coalesce({r6('n_sea / n * 100')}, 0.0) AS search_limited_percent
FROM frames f LEFT JOIN c ON c.frame_id = f.frame_id""")
def shadow_summary(src: Source) -> DataFrame:
    cells, grids, frames = src.view("cells"), src.view("grids"), src.view("frames")
    out = shadows.shadow_summary(shadows.ground_shadow(cells, grids, frames), shadows.frame_reach(cells, grids, frames))
    shares = [c for c in out.columns if c.endswith("_percent")]
    return out.select("frame_id", "daylight", "low_sun", *[half_up(c, 6).alias(c) for c in shares])


CELL_CTES = f"""{given('pixels')},
ok AS (SELECT *, dsm > -1000 AND dsm <> nodata_dsm AND dtm > -1000 AND dtm <> nodata_dtm AS good FROM pixels),
coarse AS (SELECT area_id, CAST(floor(px / 4.0) AS INT) AS x, CAST(floor(py / 4.0) AS INT) AS y, count(*) AS pixels, count(*) FILTER (good) AS valid_pixels,
    (min(dtm) FILTER (good) + max(dtm) FILTER (good)) / 2 AS terrain, min(dtm) FILTER (good) AS dtm_min, max(dtm) FILTER (good) AS dtm_max,
    min(dsm) FILTER (good) AS surf_min, max(dsm) FILTER (good) AS surf_max, floor(greatest(0, coalesce(max(dsm - dtm) FILTER (good), 0)) / 0.5 + 0.5) AS steps
  FROM ok GROUP BY ALL)"""


@query("downsample_cells", f"""{CELL_CTES}
SELECT area_id, x, y, pixels, valid_pixels, terrain, surf_min, surf_max, CAST(least(255, steps) AS INT) AS height_steps, steps > 255 AS clipped,
  CAST(floor(valid_pixels / CAST(pixels AS DOUBLE) * 255 + 0.5) AS INT) AS validity FROM coarse""")
def downsample_cells(src: Source) -> DataFrame:
    out = raster.downsample_cells(src.view("pixels"))
    return out.select("area_id", "x", "y", "pixels", "valid_pixels", "terrain", "surf_min", "surf_max",
                      F.col("height_steps").cast("int").alias("height_steps"), "clipped", F.col("validity").cast("int").alias("validity"))


@query("grid_summary", f"""{CELL_CTES}
SELECT area_id, CAST(max(x) + 1 AS INT) AS width, CAST(max(y) + 1 AS INT) AS height, floor(count(*) FILTER (pixels = valid_pixels) / CAST(count(*) AS DOUBLE) * 1000 + 0.5) / 10 AS coverage_percent,
  floor(count(*) FILTER (valid_pixels > 0) / CAST(count(*) AS DOUBLE) * 1000 + 0.5) / 10 AS any_coverage_percent, CAST(count(*) FILTER (steps > 255) AS BIGINT) AS clipped_cells,
  min(dtm_min) AS terrain_min, max(dtm_max) AS terrain_max, min(surf_min) AS surface_min, max(surf_max) AS surface_max FROM coarse GROUP BY area_id""")
def grid_summary(src: Source) -> DataFrame:
    return raster.grid_summary(raster.downsample_cells(src.view("pixels")))
