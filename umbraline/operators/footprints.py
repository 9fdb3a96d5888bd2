"""The footprint model: sun rays against building outlines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.basics import clamp
from ..functions.heights import (
    FALLBACK_HEIGHT_M, FALLBACK_SPREAD_M, MAX_TAGGED_LEVELS, RECEIVER_HEIGHT_M, STOREY_HEIGHT_M,
    bounded_positive, parsed_height_m, required_height, triangular_exceedance,
)
from .outlines import HALO_M, TILE, TILE_M, TILE_POWER, bin_powers, in_tile, line_tiles, meeting, outline_rows, outline_tiles, ray_bins, ray_hits
from .shares import SALT, beside

# Fixed values.
WALKING_MPS = 1.2
HEIGHTS = ["low_m", "mode_m", "high_m"]
HEIGHT_SOURCES = ["explicit", "levels", "raster", "fallback"]


def footprint_heights(buildings: DataFrame) -> DataFrame:
    """low_m, mode_m, high_m and source from height_m, else levels, else an uncertain fallback."""
    tagged = F.col("height_m").isNotNull() & (F.col("height_m") >= 0)
    storeys = F.col("levels").isNotNull() & (F.col("levels") > 0)
    exact = F.when(tagged, F.col("height_m")).when(storeys, F.col("levels") * STOREY_HEIGHT_M)
    return buildings.withColumns({
        "low_m": F.coalesce(exact, F.lit(max(0.0, FALLBACK_HEIGHT_M - FALLBACK_SPREAD_M))),
        "mode_m": F.coalesce(exact, F.lit(FALLBACK_HEIGHT_M)),
        "high_m": F.coalesce(exact, F.lit(FALLBACK_HEIGHT_M + FALLBACK_SPREAD_M)),
        "height_source": F.when(tagged, "height").when(storeys, "levels").otherwise("fallback")})


def resolve_building_heights(buildings: DataFrame, raster: DataFrame) -> DataFrame:
    """Map height per building: tag, storeys, raster, fallback - with its source.

    ``buildings`` has height_tag and levels_tag strings; ``raster`` comes from
    the zonal median.
    """
    joined = buildings.join(raster, ["area_id", "building_id"], "left")
    tag, storeys = parsed_height_m("height_tag"), bounded_positive("levels_tag", MAX_TAGGED_LEVELS) * STOREY_HEIGHT_M
    joined = joined.withColumns({"_tag": tag, "_lev": storeys})
    return joined.withColumns({
        "height_m": F.coalesce("_tag", "_lev", "raster_m", F.lit(FALLBACK_HEIGHT_M)),
        "height_source": F.when(F.col("_tag").isNotNull(), "explicit").when(F.col("_lev").isNotNull(), "levels")
        .when(F.col("raster_m").isNotNull(), "raster").otherwise("fallback")}).drop("_tag", "_lev", "raster_m")


def height_source_counts(resolved: DataFrame) -> DataFrame:
    """Buildings per area and source of their height; a source without buildings counts 0."""
    n = lambda source: F.sum((F.col("height_source") == source).cast("bigint")).alias(source)
    return resolved.groupBy("area_id").agg(F.count(F.lit(1)).alias("buildings"), *(n(s) for s in HEIGHT_SOURCES))


def with_tallest(df: DataFrame, buildings: DataFrame) -> DataFrame:
    """Adds by area_id the height of the tallest building, null where there is none."""
    return df.join(buildings.groupBy("area_id").agg(F.max("high_m").alias("_tallest")), "area_id", "left")


def with_outlooks(df: DataFrame, edges: DataFrame, buildings: DataFrame) -> DataFrame:
    """Adds by area_id what a ray must know before it is cast: height of the tallest building, widths of the bins of the outlines."""
    return with_tallest(df, buildings).join(bin_powers(outline_rows(edges)), "area_id", "left")


def _reach(max_shadow_m: float | None) -> Column:
    """How far a ray must look by day, null by night and where nothing is built."""
    reach = F.greatest(F.lit(0.0), (F.col("_tallest") - RECEIVER_HEIGHT_M) / F.tan(F.radians("altitude_deg")))
    if max_shadow_m is not None:
        reach = F.least(reach, F.lit(float(max_shadow_m)))
    return F.when((F.col("altitude_deg") > 0) & F.col("_tallest").isNotNull(), reach)


def point_shade(points: DataFrame, edges: DataFrame, buildings: DataFrame, key: str = "point_id", max_shadow_m: float | None = None) -> DataFrame:
    """Chance of shade at each point from the outlines sunward of it.

    ``points`` needs area_id, px, py, azimuth_deg, altitude_deg; buildings carry
    polygon_id and the columns of :func:`footprint_heights`.  A ray need not go
    beyond where the tallest building could still block it.  ``covered``: the
    area has buildings at all.
    """
    located = with_outlooks(points, edges, buildings)
    cast = located.withColumn("reach_m", _reach(max_shadow_m)).filter(F.col("reach_m").isNotNull())
    sides = edges.join(buildings.select("area_id", "polygon_id", *HEIGHTS), ["area_id", "polygon_id"])
    chance = F.when(F.col("low_m") < F.col("high_m"), triangular_exceedance(F.col("_need"), *HEIGHTS)).otherwise(
        F.when(F.col("mode_m") >= F.col("_need"), 1.0).otherwise(0.0))
    hits = ray_hits(cast, sides, [key, "altitude_deg"], HEIGHTS)
    hits = hits.withColumn("_need", required_height("distance_m", "altitude_deg")).withColumn("_p", chance).filter(F.col("_p") > 0)
    # One exchange by point serves the outlines that were met in two bins, the points and the join below.
    once = hits.select(key, "polygon_id", "distance_m", "_p").repartition(key).groupBy(key, "polygon_id").agg(
        F.min("distance_m").alias("distance_m"), F.max("_p").alias("_p"))
    shade = once.groupBy(key).agg(
        F.product(1 - F.col("_p")).alias("_clear"), F.max(F.col("_p") >= 1 - 1e-12).alias("guaranteed"),
        F.min("distance_m").alias("nearest_m"), F.array_sort(F.collect_set("polygon_id")).alias("occluders"))
    out = located.withColumn("covered", F.col("_tallest").isNotNull()).drop("_tallest", "_powers").join(shade, key, "left")
    return _judged(out.withColumn("daylight", F.col("altitude_deg") > 0))


def _judged(out: DataFrame) -> DataFrame:
    """Points with _clear, the chance that all outlines met let the sun through (null: none was met), and guaranteed."""
    direct = F.when(~F.col("daylight"), 0.0).otherwise(clamp(F.coalesce("_clear", F.lit(1.0)), 0.0, 1.0))
    hit = F.col("_clear").isNotNull()
    return out.withColumns({
        "direct_probability": direct,
        "best_direct": F.when(~F.col("daylight") | hit, 0.0).otherwise(1.0),
        "worst_direct": F.when(~F.col("daylight") | F.coalesce("guaranteed", F.lit(False)), 0.0).otherwise(1.0),
    }).withColumn("shade_probability", 1 - F.col("direct_probability")).drop("_clear", "guaranteed")


def cut_shade(lines: DataFrame, cut: Callable[[DataFrame, list[str]], DataFrame], edges: DataFrame, buildings: DataFrame, key: list[str], carry: list[str],
              salt: str, blank: dict[str, Column], slack_m: float = 0.0, max_shadow_m: float | None = None) -> DataFrame:
    """:func:`point_shade` for points that are cut from straight lines (area_id, x1, y1, x2, y2), with the columns ``key`` and ``carry``.

    Lines meet the tiles they touch and are cut behind that exchange.  A ray of HALO_M or less finds all it can meet in the tile of its
    point, so it is settled there and no more is shuffled.  Longer rays go once to each tile they pass; an outline counts in the tile where it is met.
    ``cut`` makes points of rows that carry the named columns along, no further than ``slack_m`` off their line; ``salt`` is a column whose
    hash deals out a tile with very many lines.  ``blank``: values that let ``cut`` keep a row that is no line, which brings a tile.
    """
    sides = edges.join(buildings.select("area_id", "polygon_id", *HEIGHTS), ["area_id", "polygon_id"])
    # Lines that come twice: their rays count as one when it is asked on which side of an outline they begin (see ray_hits).
    alike = lines.withColumn("_alike", F.count(F.lit(1)).over(W.partitionBy(*lines.columns)))
    tiles, located = outline_tiles(sides, HEIGHTS), with_tallest(alike, buildings)
    held = list(dict.fromkeys([*key, *carry]))
    # What the task works out from few columns stays out of the plan: code of more than 8,000 bytes in a method is interpreted.
    turned = {"ux": F.sin(F.radians("azimuth_deg")), "uy": F.cos(F.radians("azimuth_deg")), "_tan": F.tan(F.radians("altitude_deg"))}
    ray = ["px", "py", *turned, "altitude_deg", "_tallest", "_alike", *TILE, "_tile"]

    def settled(dealt: DataFrame) -> DataFrame:
        points = cut(dealt, list(dict.fromkeys(["_tallest", "_alike", *TILE, "_tile"]))).withColumns(turned)
        return points.filter(F.col("_tile").isNotNull() | in_tile()).select(*dict.fromkeys([*held, *ray]))

    wanted = cut(located, ["_tallest"]).schema
    kinds = {c: wanted[c].dataType.simpleString() for c in held} | {"_here": "boolean", "_bx": "bigint", "_by": "bigint"}
    polygon = edges.schema["polygon_id"].dataType
    known = [*held, "daylight", "covered"]
    result = f"daylight boolean, covered boolean, _clear double, guaranteed boolean, nearest_m double, occluders array<{polygon.simpleString()}>"
    shape = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + result
    ready, work = _shading(held, to_arrow_type(polygon), max_shadow_m, False)
    short = beside(line_tiles(located, slack_m, salt), tiles.withColumns(blank), TILE, settled, ready, work, shape(held))

    rays = cut(located, ["area_id", "_tallest", "_alike"]).withColumn("reach_m", _reach(max_shadow_m)).filter(F.col("reach_m") > HALO_M)
    rays = rays.select(*dict.fromkeys([*held, "area_id", "px", "py", "azimuth_deg", "altitude_deg", "reach_m", "_tallest", "_alike"]), F.array(F.lit(TILE_POWER)).alias("_powers"))
    rays = ray_bins(rays).withColumns({**turned, "_here": in_tile(), "_salt": F.pmod(F.hash(*key), F.lit(SALT))})
    passing = [*held, "_here", "_bx", "_by"]
    ready, work = _shading(passing, to_arrow_type(polygon), max_shadow_m, True)
    met = beside(rays.select(*dict.fromkeys([*passing, *ray[:-1]])), tiles, TILE, lambda dealt: dealt.select(*dict.fromkeys([*passing, *ray])), ready, work, shape(passing))
    # Rows that come twice are met twice; they count as often as their points do.
    whole = met.groupBy(*known).agg(F.collect_set(F.when(F.col("_clear").isNotNull(), F.struct("_bx", "_by", "_clear", "guaranteed", "nearest_m", "occluders"))).alias("_met"),
                                    F.sum(F.col("_here").cast("int")).alias("_times"))
    some = F.size("_met") > 0
    whole = whole.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(
        *known, F.when(some, F.aggregate("_met", F.lit(1.0), lambda a, m: a * m["_clear"])).alias("_clear"), F.when(some, F.exists("_met", lambda m: m["guaranteed"])).alias("guaranteed"),
        F.array_min("_met.nearest_m").alias("nearest_m"), F.when(some, F.array_sort(F.array_distinct(F.flatten("_met.occluders")))).alias("occluders"))
    return _judged(short.unionByName(whole))


def _shading(keep: list[str], polygon: pa.DataType, max_shadow_m: float | None, passing: bool) -> tuple[Callable, Callable]:
    """What a task does with a tile and its rays: the chance that all outlines met let the sun through.

    ``passing``: rays look at the tile only, all of them; else at all they can meet, and those longer than HALO_M are left out.
    """
    ready, meet = meeting(HEIGHTS)
    at_once = 250 if passing else 2_000  # rays, so that their pairs stay in the cache

    def chance(need, low, mode, high):  # noqa: ANN001, ANN202 - as in triangular_exceedance
        below = 1 - (need - low) * (need - low) / ((high - low) * (mode - low))
        above = (high - need) * (high - need) / ((high - low) * (high - mode))
        spread = np.where((need <= mode) & (mode > low), np.clip(below, 0.0, 1.0), np.clip(above, 0.0, 1.0))
        spread = np.where(need <= low, 1.0, np.where(need >= high, 0.0, spread))
        return np.where(low < high, spread, (mode >= need).astype(float))

    def work(tile, rays: pa.RecordBatch) -> pa.RecordBatch:  # noqa: ANN001
        column = lambda c: rays.column(c).to_numpy(zero_copy_only=False)
        day, covered = column("altitude_deg") > 0, rays.column("_tallest").is_valid().to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):  # as in _reach
            reach = np.where(day & covered, np.maximum(0.0, (column("_tallest") - RECEIVER_HEIGHT_M) / column("_tan")), np.nan)
        reach = reach if max_shadow_m is None else np.minimum(reach, max_shadow_m)
        if not passing and (far := reach > HALO_M).any():
            rays, day, covered, reach = rays.filter(pa.array(~far)), day[~far], covered[~far], reach[~far]
        n = rays.num_rows
        clear, nearest, sure, many, who = np.ones(n), np.full(n, np.inf), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), []
        px, py, ux, uy, tan = (column(c) for c in ("px", "py", "ux", "uy", "_tan"))
        alike = column("_alike")
        cast = np.flatnonzero(reach >= 0) if tile else np.zeros(0, dtype=np.int64)
        for k in range(0, len(cast), at_once):
            some = cast[k:k + at_once]
            ray, outline, distance = meet(tile, px[some], py[some], ux[some], uy[some], reach[some], alike[some])
            ray = some[ray]
            with np.errstate(all="ignore"):
                p = chance(RECEIVER_HEIGHT_M + distance * tan[ray], *(tile[c][outline] for c in HEIGHTS))
            counts = p > 0
            if passing:
                counts &= np.floor((px[ray] + ux[ray] * distance) / TILE_M) == tile["bx"]
                counts &= np.floor((py[ray] + uy[ray] * distance) / TILE_M) == tile["by"]
            ray, outline, distance, p = ray[counts], outline[counts], distance[counts], p[counts]
            if len(ray):
                first = np.flatnonzero(np.diff(ray, prepend=-1))
                of = ray[first]
                clear[of], nearest[of] = np.multiply.reduceat(1 - p, first), np.minimum.reduceat(distance, first)
                sure[of], many[of] = np.logical_or.reduceat(p >= 1 - 1e-12, first), np.diff([*first, len(ray)])
                who.append(outline)
        none, ends = many == 0, np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        ids = tile["ids"].take(pa.array(np.concatenate(who))) if who else pa.nulls(0, tile["ids"].type if tile else polygon)
        found = pa.ListArray.from_arrays(pa.array(ends), ids, mask=pa.array(none))
        out = [*(rays.column(c) for c in keep), pa.array(day), pa.array(covered), pa.array(clear, mask=none), pa.array(sure, mask=none), pa.array(nearest, mask=none), found]
        return pa.RecordBatch.from_arrays(out, names=[*keep, "daylight", "covered", "_clear", "guaranteed", "nearest_m", "occluders"])

    return ready, work


def route_score(shaded: DataFrame, keys: list[str], speed_mps: float = WALKING_MPS, routes: DataFrame | None = None) -> DataFrame:
    """Route totals at constant speed; night pieces add no seconds.  Coverage is that of the route's area.

    ``routes`` adds a row of zeros, without coverage or percentage, for routes that have no piece.
    """
    s = F.col("piece_m") / speed_mps
    lit = lambda value: F.sum(F.when(F.col("daylight"), s * value).otherwise(0.0))
    out = shaded.groupBy(*keys).agg(
        F.sum("piece_m").alias("distance_m"), F.sum(s).alias("duration_s"), lit(F.lit(1.0)).alias("daylight_s"),
        lit(F.col("direct_probability")).alias("sun_s"), lit(F.col("shade_probability")).alias("_shade"),
        lit(F.col("best_direct")).alias("best_s"), lit(F.col("worst_direct")).alias("worst_s"), F.max("covered").alias("_covered"))
    if routes is not None:
        out = routes.select(*keys).join(out, keys, "left").fillna(0.0, [c for c in out.columns if c not in (*keys, "_covered")])
    return out.withColumns({
        "shade_percent": F.when(F.col("daylight_s") > 0, clamp(F.col("_shade") / F.col("daylight_s") * 100, 0.0, 100.0)),
        "is_daylight": F.col("daylight_s") > 0,
        "coverage_percent": F.when(F.col("_covered"), 100.0).otherwise(0.0)}).drop("_shade", "_covered")
