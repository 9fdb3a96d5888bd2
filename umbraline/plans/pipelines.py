"""The whole jobs: score requests, take in routes, build packs, validate the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import split_valid
from ..functions.civil import instant_from_local
from ..functions.geo import with_bng
from ..functions.solar import with_solar_position
from ..operators import advice, calibration, geometry, labels, raster, rays, routes as rt, scoring, shadows, walks


def prepared_samples(vertices: DataFrame, directions: DataFrame, carry: tuple[str, ...] = ("in_passage",)) -> DataFrame:
    """Samples of all routes on the national grid: geometry is prepared once, whatever the number of departures."""
    segs = scoring.mark_passages(geometry.segments(vertices), directions)
    return with_bng(geometry.densify(segs, carry=carry), "x_mid", "y_mid")


def score_requests(vertices: DataFrame, directions: DataFrame, routes: DataFrame, requests: DataFrame, cells: DataFrame, grids: DataFrame,
                   offset_minutes: list[int] | None = None, mode: str = "absolute") -> DataFrame:
    """Schedule score per request, route and departure slot.

    ``routes``: request_id, route_id (one row per candidate and request), route_pos, area_id, duration_s, distance_m.
    ``requests``: request_id, departure_ms, journey_count, repeat_min, pace, profile.
    """
    asked = routes.join(requests, "request_id").withColumn("trip_id", F.concat_ws("/", "request_id", "route_id"))
    slots = offset_minutes or [0]
    journeys = scoring.expand_journeys(asked, offset_minutes=slots)
    narrow = journeys.select("trip_id", "route_id", "area_id", "offset_min", "journey", "journey_departure_ms", "walk_s")
    samples = prepared_samples(vertices, directions).select(
        "route_id", "sample_idx", "x_mid", "y_mid", "easting", "northing", "piece_m", "total_m", "mid_fraction", "in_passage")
    timed = scoring.time_samples(samples, narrow)
    sunny = with_solar_position(timed, "epoch_ms", "x_mid", "y_mid")
    exposed = scoring.expose_samples(
        sunny, cells, grids, mode, key=["trip_id", "offset_min", "journey", "sample_idx"], carry=["walk_s", "sample_s", "in_passage"])
    trips = scoring.score_journeys(exposed, ["trip_id", "offset_min", "journey", "walk_s"])
    trips = scoring.with_unsampled(trips, narrow.join(vertices.select("route_id").distinct(), "route_id", "left_semi"), ["trip_id", "offset_min", "journey"])
    schedules = scoring.score_schedules(trips, ["trip_id", "offset_min"])
    return schedules.join(asked.select("trip_id", "request_id", "route_id", "route_pos", "profile", "distance_m"), "trip_id").drop("trip_id")


def rank_requests(scores: DataFrame, access: DataFrame, step_free: DataFrame) -> DataFrame:
    """Labels and guarded suggestion for the first departure slot.

    ``access``: route_id, avoids_barriers.  ``step_free``: request_id, step_free.
    """
    now = scores.filter(F.col("offset_min") == 0).join(access.select("route_id", "avoids_barriers"), "route_id", "left").fillna(False, ["avoids_barriers"])
    labelled = labels.label_routes(now, extra=["coverage_percent", "low_sun", "avoids_barriers"])
    return labels.apply_access_guard(labelled.join(step_free.select("request_id", "step_free"), "request_id"))


def advise_requests(scores: DataFrame, access: DataFrame, step_free: DataFrame, min_coverage: float = advice.MIN_COVERAGE) -> DataFrame:
    """Departure advice over all scanned slots; a step-free request only considers routes without known barriers."""
    joined = scores.join(step_free.select("request_id", "step_free"), "request_id").join(access.select("route_id", "avoids_barriers"), "route_id", "left")
    usable = joined.filter(~F.col("step_free") | F.coalesce("avoids_barriers", F.lit(False)))
    labelled = labels.label_routes(usable, ["request_id", "offset_min"], ["coverage_percent", "low_sun"])
    found = advice.departure_advice(advice.departure_options(labelled), min_coverage=min_coverage)
    return advice.with_empty_requests(found, step_free)


def take_in_trips(trips: DataFrame, maneuvers: DataFrame, ends: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept routes, their vertices, their directions) of router trips.

    ``ends``: response, area_id, ox, oy, dx, dy.  A candidate that breaks any
    rule is left out; the first three different ones per response remain.
    """
    sound, _ = split_valid(trips, rt.trip_checks())
    vertices, _ = rt.decode_shapes(sound)
    counts = vertices.groupBy("route_id").agg(F.count(F.lit(1)).alias("points"))
    directions, spoiled = rt.project_directions(maneuvers.join(sound.select("route_id"), "route_id", "left_semi"), counts)
    measured = sound.join(spoiled, "route_id", "left_anti").join(ends, "response").withColumns({
        "distance_m": F.floor(F.col("length_km") * 1000 + 0.5).cast("double"), "duration_s": F.floor(F.col("time_s") + 0.5).cast("double"), "request_id": F.col("response")})
    judged = rt.route_problems(measured, vertices, areas).filter(F.size("problems") == 0)
    kept = rt.distinct_routes(judged, rt.near_duplicates(vertices, judged))
    final = judged.join(kept.select("route_id", "position"), "route_id")
    only = final.select("route_id")
    return final, vertices.join(only, "route_id", "left_semi"), directions.join(only, "route_id", "left_semi")


def build_grid(pixels: DataFrame, factor: int = raster.FACTOR) -> tuple[DataFrame, DataFrame]:
    """(cells, coverage summary) from aligned pixels."""
    cells = raster.downsample_cells(pixels, factor)
    return cells, raster.grid_summary(cells)


def shadow_frames(cells: DataFrame, grids: DataFrame, moments: DataFrame, mode: str = "absolute") -> tuple[DataFrame, DataFrame]:
    """(cell states, summary) for frames at moments: frame_id, area_id, epoch_ms, lon, lat of the frame centre."""
    frames = with_solar_position(moments).select("frame_id", "area_id", "azimuth_deg", "altitude_deg")
    states = shadows.ground_shadow(cells, grids, frames, mode)
    return states, shadows.shadow_summary(states, shadows.frame_reach(cells, grids, frames, mode))


def predict_at_observations(observations: DataFrame, cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Model exposure at each observed point and local time."""
    placed = observations.select(
        "observation_id", F.col("pilot_area").alias("area_id"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"),
        F.unix_millis(instant_from_local("observed_london_datetime")).alias("epoch_ms")).filter(F.col("epoch_ms").isNotNull())
    return rays.classify_points(with_solar_position(with_bng(placed)), cells, grids, key=["observation_id"]).select(
        "observation_id", "exposure", "shade_fraction", "ray_coverage", rays.reason_names("reason_bits").alias("reasons"))


def validate_fixed_points(observations: DataFrame, plan: calibration.Plan) -> DataFrame:
    """The gate over typed observations as read from their CSV format."""
    named = observations.withColumnsRenamed({
        "pilot_area": "area", "planned_point_id": "point_id", "latitude": "lat", "longitude": "lon", "weather_visibility": "weather",
        "observed_state": "observed", "predicted_state": "predicted", "gps_accuracy_metres": "gps_accuracy_m"})
    named = named.withColumn("local_hour", F.substring("observed_london_datetime", 12, 2).cast("int"))
    return calibration.calibration_gate(calibration.mark_observations(named, plan), plan)


def validate_walks(rows: DataFrame, constant: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, comparisons, rejected comparison ids) of typed walk rows; one bad row spoils its comparison."""
    _, bad_rows = split_valid(rows, walks.row_checks())
    verdicts = walks.group_verdicts(rows, constant)
    rejected = verdicts.filter(F.size("broken_rules") > 0).select("comparison_id").unionByName(bad_rows.select("comparison_id")).distinct()
    compared = walks.compare_walks(rows.join(rejected, "comparison_id", "left_anti"))
    return walks.summarise_walks(compared), compared, rejected
