"""Ground shadow of whole height grids.

A source cell throws its top along the anti-solar line.  Whether it shades a
target depends on the source only through (surface - height lost on the way), so
a frame is the maximum, over the offsets of its line, of the grid shifted by the offset and
lowered by what is lost.  Tiles (:mod:`.tiles`) hold the cells up to the longest
line around them, so a tile's frames are shifted maxima of whole arrays: one join
of tiles with frames, and nothing is shuffled for an offset or a cell.

The digital line of a target is not that of its neighbour (each rounds from its
own cell), so a running maximum along fixed lines would not give the same cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import is_finite
from .rays import COMPLETE, LOW_SUN_DEG, MARGIN_M, MAX_RAY_M, OBSERVER_M
from .tiles import SIDE, tile_arrays

STATES = ["certain", "unknown", "search-limited", "possible", "clear"]
FRAMES_AT_ONCE = 32    # frames that travel with a copy of a tile


def cast_offsets(azimuth_deg: Column, reach_m: Column, res_m: Column) -> Column:
    """Array of (dx, dy, metres): cells a shadow crosses, walked along the dominant axis.

    One cell per step, halves rounded up, repeats and cells beyond the reach left out.
    """
    east, south = -F.sin(F.radians(azimuth_deg)), F.cos(F.radians(azimuth_deg))
    major = F.greatest(F.abs(east), F.abs(south))
    count = F.floor(reach_m * major / res_m).cast("int")
    at = lambda k, axis: F.floor(axis * k / major + 0.5).cast("int")
    dist = lambda k: F.sqrt((at(k, east) * at(k, east) + at(k, south) * at(k, south)).cast("double")) * res_m
    # The dominant axis moves one whole cell per step, so no step repeats the previous cell.
    walk = F.transform(F.sequence(F.lit(1), count), lambda k: F.struct(
        at(k, east).alias("dx"), at(k, south).alias("dy"), dist(k).alias("metres")))
    return F.filter(F.when(count >= 1, walk), lambda o: o["metres"] <= reach_m)


def frame_reach(cells: DataFrame, grids: DataFrame, frames: DataFrame, mode: str = "absolute") -> DataFrame:
    """Frames (frame_id, area_id, azimuth_deg, altitude_deg) with their grid and casting distances."""
    ok = _valid(mode)
    top = (F.max(F.when(ok, F.col("surf_max"))) - F.min(F.when(ok, F.col("terrain")))) if mode == "absolute" else F.max(F.when(ok, F.col("height_steps")))
    extent = cells.groupBy("area_id").agg(
        F.coalesce(top.cast("double"), F.lit(0.0)).alias("_top"), F.min(ok.cast("int")).alias("_all_valid"))
    joined = frames.join(grids.select("area_id", "width", "height", "res_m", "step_m"), "area_id").join(extent, "area_id")
    tallest = F.greatest(F.lit(0.0), F.col("_top")) if mode == "absolute" else F.col("_top") * F.col("step_m")
    tangent = F.tan(F.radians("altitude_deg"))
    day = F.col("altitude_deg") > 0
    natural = F.when(day & (tallest > OBSERVER_M), (tallest - OBSERVER_M) / tangent).otherwise(0.0)
    joined = joined.withColumns({"daylight": day, "natural_m": natural, "tangent": tangent})
    return joined.withColumns({
        "limited": F.col("natural_m") > MAX_RAY_M,
        "trace_m": F.when(~F.col("daylight"), 0.0).when(F.col("_all_valid") == 1, F.least(F.lit(MAX_RAY_M), F.col("natural_m"))).otherwise(MAX_RAY_M),
        "low_sun": F.col("daylight") & (F.col("altitude_deg") < LOW_SUN_DEG),
    }).drop("_top", "_all_valid")


def _valid(mode: str) -> Column:
    ok = F.coalesce(F.col("validity") == COMPLETE, F.lit(True))
    if mode == "absolute":
        return ok & is_finite("terrain") & is_finite("surf_min") & is_finite("surf_max") & (F.col("surf_min") <= F.col("surf_max"))
    return ok & F.col("height_steps").isNotNull()


def shadow_tiles(cells: DataFrame, grids: DataFrame, mode: str = "absolute", side: int = SIDE) -> DataFrame:
    """The tiles that frames of a mode are cast over: ok (1, 0, or null where the table has no cell), low, high, base."""
    if mode == "absolute":
        low, high, base = F.col("surf_min").cast("double"), F.col("surf_max").cast("double"), F.col("terrain").cast("double")
    else:
        steps = grids.select(F.col("area_id").alias("s_area"), "step_m")
        cells = cells.join(steps, cells["area_id"] == steps["s_area"])
        low = high = F.col("height_steps") * F.col("step_m")
        base = F.lit(0.0)
    ok = _valid(mode)
    return tile_arrays(cells, grids, {"ok": ok.cast("int"), "low": F.when(ok, low), "high": F.when(ok, high), "base": F.when(ok, base)}, MAX_RAY_M, side, numbered=False)


def cast_frame(tile: dict[str, np.ndarray], frame: dict, left: int, top: int, core: tuple[slice, slice]) -> np.ndarray:
    """State numbers (places in STATES) of a tile's own cells in one frame. core cuts them out of the tile's arrays, whose
    first cell is (left, top) of the grid."""
    around = tile["ok"]
    ok, low, high, base = (tile[c][core] for c in ("ok", "low", "high", "base"))
    own = ok == 1
    # A shifted grid is a window of the padded one, so an offset costs no copy.
    pad = max((max(abs(o["dx"]), abs(o["dy"])) for o in frame["offsets"]), default=0)
    padded = [np.pad(a, pad, constant_values=empty) for a, empty in (
        (np.where(around == 1, tile["low"], -np.inf), -np.inf), (np.where(around == 1, tile["high"], -np.inf), -np.inf), (around == 0, False))]
    reach_low, reach_high, hidden = np.full(ok.shape, -np.inf), np.full(ok.shape, -np.inf), np.zeros(ok.shape, bool)
    for o in frame["offsets"]:
        spent = OBSERVER_M + o["metres"] * frame["tangent"]
        at_y, at_x = core[0].start + pad - o["dy"], core[1].start + pad - o["dx"]
        from_low, from_high, from_broken = (a[at_y:at_y + ok.shape[0], at_x:at_x + ok.shape[1]] for a in padded)
        np.maximum(reach_low, from_low - spent - MARGIN_M, out=reach_low)
        np.maximum(reach_high, from_high - spent + MARGIN_M, out=reach_high)
        hidden |= from_broken
    y, x = np.mgrid[top + core[0].start:top + core[0].stop, left + core[1].start:left + core[1].stop]
    with np.errstate(invalid="ignore", divide="ignore"):
        certain = own & ((low - base >= OBSERVER_M + MARGIN_M) | (reach_low >= base))
        possible = own & ((high - base > OBSERVER_M) | (~np.bool_(frame["limited"]) & (reach_high >= base)))
        edges = []
        for along, at, size in ((frame["sin_az"], x, frame["width"]), (-frame["cos_az"], y, frame["height"])):
            edges.append((size - at - 0.5) / along if along > 0 else (at + 0.5) / -along if along < 0 else np.full(ok.shape, np.inf))
        to_edge = np.maximum(0.0, np.minimum(*edges) * frame["res_m"])
    off_edge = (frame["natural_m"] > 0) & (to_edge < min(frame["natural_m"], MAX_RAY_M))
    return np.select([certain, ~own | hidden | off_edge, np.full(ok.shape, frame["limited"]), possible], [0, 1, 2, 3], 4)


def ground_shadow(cells: DataFrame, grids: DataFrame, frames: DataFrame, mode: str = "absolute", side: int = SIDE) -> DataFrame:
    """State of every cell in every daylight frame: frame_id, area_id, x, y, state.

    Frames at night have no cells here; :func:`shadow_summary` reports them.
    """
    return cast(shadow_tiles(cells, grids, mode, side), frame_reach(cells, grids, frames, mode), side)


def cast(tiles: DataFrame, ready: DataFrame, side: int = SIDE) -> DataFrame:
    """States from the tiles of :func:`shadow_tiles` and the frames of :func:`frame_reach`."""
    none = F.expr("CAST(array() AS array<struct<dx:int,dy:int,metres:double>>)")
    day = ready.filter("daylight").select("area_id", F.struct(
        "frame_id", "tangent", "natural_m", "limited", "width", "height", "res_m", F.sin(F.radians("azimuth_deg")).alias("sin_az"), F.cos(F.radians("azimuth_deg")).alias("cos_az"),
        F.coalesce(cast_offsets(F.col("azimuth_deg"), F.col("trace_m"), F.col("res_m")), none).alias("offsets")).alias("frame"))
    # Frames of an area in lists of a bounded length, so that a tile is copied once for many of them.
    chunk = F.pmod(F.xxhash64("frame.frame_id"), F.greatest(F.lit(1), F.ceil(F.col("many") / FRAMES_AT_ONCE)))
    counted = day.groupBy("area_id").agg(F.count("*").alias("many"))
    lists = day.join(counted, "area_id").withColumn("chunk", chunk).groupBy("area_id", "chunk").agg(F.collect_list("frame").alias("frames"))
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    joined = tiles.join(lists, tiles["t_area"] == lists["area_id"]).select("area_id", "t_x", "t_y", "left", "top", "across", "ok", "low", "high", "base", "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame_type = batch.schema.field("frames").type.value_type.field("frame_id").type
            for k in range(batch.num_rows):
                t_x, t_y, left, top, across = (batch.column(c)[k].as_py() for c in ("t_x", "t_y", "left", "top", "across"))
                arrays = {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, across) for c in ("ok", "low", "high", "base")}
                rows, columns = arrays["ok"].shape
                start_x, start_y = t_x * side - left, t_y * side - top
                core = slice(start_y, min(rows, start_y + side)), slice(start_x, min(columns, start_x + side))
                y, x = np.mgrid[top + core[0].start:top + core[0].stop, left + core[1].start:left + core[1].stop]
                mine = ~np.isnan(arrays["ok"][core])
                x, y = pa.array(x[mine], pa.int32()), pa.array(y[mine], pa.int32())
                for frame in batch.column("frames")[k].as_py():
                    state = cast_frame(arrays, frame, left, top, core)[mine]
                    n = len(state)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([frame["frame_id"]] * n, frame_type), pa.array([batch.column("area_id")[k].as_py()] * n, batch.schema.field("area_id").type),
                         x, y, pa.DictionaryArray.from_arrays(pa.array(state, pa.int32()), pa.array(STATES)).dictionary_decode()],
                        names=["frame_id", "area_id", "x", "y", "state"])

    return joined.mapInArrow(run, f"frame_id {kinds['frame_id']}, area_id {kinds['area_id']}, x int, y int, state string")


def shadow_summary(shadow: DataFrame, frames_ready: DataFrame) -> DataFrame:
    """Percent of cells per state and frame; a night frame displays as fully shaded.

    ``frames_ready`` comes from :func:`frame_reach`.
    """
    share = lambda *names: F.sum(F.when(F.col("state").isin(*names), 1.0).otherwise(0.0)) / F.count(F.lit(1)) * 100
    counted = shadow.groupBy("frame_id").agg(
        share("certain", "possible").alias("shadow_percent"), share("certain").alias("certain_percent"),
        share("possible").alias("possible_percent"), share("unknown").alias("unknown_percent"),
        share("search-limited").alias("search_limited_percent"))
    joined = frames_ready.select("frame_id", "area_id", "daylight", "low_sun", "limited").join(counted, "frame_id", "left")
    return joined.withColumn("shadow_percent", F.when(F.col("daylight"), F.coalesce("shadow_percent", F.lit(0.0))).otherwise(100.0)).fillna(
        0.0, ["certain_percent", "possible_percent", "unknown_percent", "search_limited_percent"])
