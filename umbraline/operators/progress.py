"""Steps, progress and position along a route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.basics import clamp

# Planar metres per degree used for map matching.
METRES_PER_LON, METRES_PER_LAT = 111_320.0, 110_540.0
NEAR_M = 0.01
BUCKET_M = 500.0


def mark_chunks(segs: DataFrame, key: str = "route_id") -> DataFrame:
    """Vertex distances in one row per chunk of a route: key, lowest and highest idx, marks in order.

    A row holds at most as many marks as a chunk has vertices, and behind them one without idx, the length of the route.
    """
    mark = lambda idx, metres: F.struct(idx.cast("bigint").alias("idx"), F.col(metres).cast("double").alias("along_m"))
    packed = segs.groupBy(key, "chunk").agg(
        F.array_sort(F.concat(F.collect_list(mark(F.col("seg_idx"), "start_m")), F.collect_list(F.when(F.col("last"), mark(F.col("seg_idx") + 1, "total_m"))))).alias("marks"),
        F.max("total_m").alias("total_m"))
    return packed.select(key, F.element_at("marks", 1)["idx"].alias("low"), F.element_at("marks", -1)["idx"].alias("high"),
                         F.concat("marks", F.array(mark(F.lit(None), "total_m"))).alias("marks"))


def _marked(steps: DataFrame, marks: DataFrame, idx: str, name: str, key: str) -> DataFrame:
    """Steps with ``name``: the distance of vertex ``idx`` and the length of its route; null where the route has no such vertex."""
    held = marks.select(F.col(key).alias("_key"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("marks").alias("_marks"))
    joined = steps.join(held, (steps[key] == held["_key"]) & (steps[idx] >= held["_low"]) & (steps[idx] <= held["_high"]), "left")
    # Vertices without a place leave gaps; without gaps the mark stands at its place in the row.
    whole = F.size("_marks") == F.col("_high") - F.col("_low") + 2
    mark = F.when(whole, F.get("_marks", (F.col(idx) - F.col("_low")).cast("int"))).otherwise(F.get(F.filter("_marks", lambda m: m["idx"] == F.col(idx)), F.lit(0)))
    return joined.withColumn("_mark", mark).withColumn(name, F.when(F.col("_mark.idx").isNotNull(), F.struct(
        F.col("_mark.along_m").alias("along_m"), F.element_at("_marks", -1)["along_m"].alias("total_m")))).drop("_key", "_low", "_high", "_marks", "_mark")


def journey_steps(directions: DataFrame, routes: DataFrame, segs: DataFrame, key: str = "route_id") -> DataFrame:
    """Directions as distance and time intervals on the route.

    Vertex indices are used where they fit the geometry, otherwise the
    directions' own distances in proportion.  ``routes`` has distance_m and
    duration_s; a route without directions gets one step.
    """
    lengths = routes.select(key, F.greatest(F.lit(0.0), F.coalesce(F.col("distance_m").cast("double"), F.lit(0.0))).alias("route_m"),
                            F.greatest(F.lit(0.0), F.coalesce(F.col("duration_s").cast("double"), F.lit(0.0))).alias("route_s"))
    given = directions.select(
        key, "dir_idx", "instruction", F.floor("begin_idx").alias("begin_idx"), F.floor("end_idx").alias("end_idx"),
        F.greatest(F.lit(0.0), F.coalesce(F.col("distance_m").cast("double"), F.lit(0.0))).alias("step_m"),
        F.greatest(F.lit(0.0), F.coalesce(F.col("duration_s").cast("double"), F.lit(0.0))).alias("step_s"))
    steps = lengths.join(given, key, "left")
    bare = F.col("dir_idx").isNull()
    steps = steps.withColumns({
        "dir_idx": F.coalesce("dir_idx", F.lit(0)), "begin_idx": F.when(bare, 0).otherwise(F.col("begin_idx")),
        "step_m": F.when(bare, F.col("route_m")).otherwise(F.col("step_m")),
        "step_s": F.when(bare, F.col("route_s")).otherwise(F.col("step_s")),
        "instruction": F.when(bare, "Continue to the destination.")
        .when(F.trim("instruction") == "", "Continue.").otherwise(F.trim("instruction")),
        "_bare": bare})
    whole = W.partitionBy(key)
    line = whole.orderBy("dir_idx")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumns({
        "_all_m": F.sum("step_m").over(whole), "_all_s": F.sum("step_s").over(whole),
        "_done_m": F.coalesce(F.sum("step_m").over(before), F.lit(0.0)),
        "_done_s": F.coalesce(F.sum("step_s").over(before), F.lit(0.0))})
    # Directions stay where their route's window put them; the distances come to them, a chunk in a row, both times by the same exchange.
    marks = mark_chunks(segs, key)
    steps = _marked(_marked(steps, marks, "begin_idx", "_first", key), marks, "end_idx", "_until", key)
    steps = steps.withColumns({"_from": F.col("_first.along_m"), "_total": F.col("_first.total_m"),
                               "_to": F.when(F.col("_bare"), F.col("_first.total_m")).otherwise(F.col("_until.along_m"))})
    usable = F.coalesce((F.col("_total") > 0) & F.col("_to").isNotNull() & (F.col("_bare") | (F.col("end_idx") >= F.col("begin_idx"))), F.lit(False))
    share = lambda top, whole_, scale: F.col(top) / F.col(whole_) * F.col(scale)
    rough_start = F.when(F.col("_all_m") > 0, share("_done_m", "_all_m", "route_m")).when(F.col("dir_idx") == 0, 0.0).otherwise(F.col("route_m"))
    rough_end = F.when(F.col("_all_m") > 0, (F.col("_done_m") + F.col("step_m")) / F.col("_all_m") * F.col("route_m")).otherwise(F.col("route_m"))
    steps = steps.withColumns({
        "start_m": clamp(F.when(usable, share("_from", "_total", "route_m")).otherwise(rough_start), 0.0, "route_m"),
        "_end": F.when(usable, share("_to", "_total", "route_m")).otherwise(rough_end)})
    steps = steps.withColumn("end_m", clamp(F.greatest("start_m", "_end"), 0.0, "route_m"))
    by_time = F.col("_all_s") > 0
    by_length = F.col("route_m") > 0
    steps = steps.withColumns({
        "start_s": clamp(F.when(by_time, share("_done_s", "_all_s", "route_s"))
                         .when(by_length, share("start_m", "route_m", "route_s")).otherwise(0.0), 0.0, "route_s"),
        "end_s": clamp(F.when(by_time, (F.col("_done_s") + F.col("step_s")) / F.col("_all_s") * F.col("route_s"))
                       .when(by_length, share("end_m", "route_m", "route_s")).otherwise(F.col("route_s")), 0.0, "route_s")})
    return steps.select(key, "dir_idx", "instruction", "step_m", "step_s", "start_m", "end_m", "start_s", "end_s", "route_m", "route_s")


def step_arrays(steps: DataFrame, key: str = "route_id") -> DataFrame:
    """The steps of each route as one ordered array (at most 512 by validation)."""
    fields = ["dir_idx", "instruction", "start_m", "end_m", "start_s", "end_s"]
    return steps.groupBy(key, "route_m", "route_s").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"))


def journey_progress(active: DataFrame, steps: DataFrame, key: str = "route_id") -> DataFrame:
    """Current and next step of each (route, active_idx) row, and what remains. A row meets its one step by number.

    Steps are counted where they are numbered, so they are built and dealt out once; rows meet them by route, at most 512 by validation.
    """
    whole = W.partitionBy(key)
    line = whole.orderBy("dir_idx")
    numbered = steps.select(
        F.col(key).alias("_key"), (F.row_number().over(line) - 1).alias("_no"), F.count(F.lit(1)).over(whole).alias("_many"),
        "instruction", F.lead("instruction").over(line).alias("next_instruction"), "start_m", "start_s", "route_m", "route_s")
    asked = active.withColumn("active_idx", F.floor(F.coalesce(F.col("active_idx"), F.lit(0))))
    placed = clamp(asked["active_idx"], 0, numbered["_many"] - 1).cast("int")
    joined = asked.join(numbered, (asked[key] == numbered["_key"]) & (placed == numbered["_no"])).withColumn("active_idx", F.col("_no"))
    joined = joined.withColumns({
        "remaining_m": F.greatest(F.lit(0.0), F.col("route_m") - F.col("start_m")), "remaining_s": F.greatest(F.lit(0.0), F.col("route_s") - F.col("start_s"))})
    return joined.select(
        *active.columns, "instruction", "next_instruction", "start_m", "start_s", "remaining_m", "remaining_s",
        ((F.col("remaining_m") <= NEAR_M) & (F.col("remaining_s") <= NEAR_M)).alias("complete"), "route_m")


def upcoming_exposure(positions: DataFrame, spans: DataFrame, key: str = "route_id", at: str = "distance_m",
                      route_m: str = "route_m", bucket_m: float = BUCKET_M) -> DataFrame:
    """State under each position, metres left in it, and the next different state.

    ``spans`` (span_no, exposure, start_m, end_m) must cover each route gaplessly.

    An as-of window: spans and positions meet by route and stretch of ``bucket_m``, sorted by distance, and a position takes the
    nearest span end ahead of it. A span stands once, in the stretch of its end; a stretch that holds positions also gets the first
    end beyond it. So routes of any length spread out, and no row is copied by its length.
    """
    line = W.partitionBy(key).orderBy("span_no")
    back = W.partitionBy(key).orderBy(F.desc("span_no"))
    marked = spans.select(
        key, "span_no", "exposure", "end_m", F.lead("span_no").over(line).isNull().alias("_last"),
        F.coalesce(F.lag("exposure").over(line) != F.col("exposure"), F.lit(False)).alias("_fresh"))
    change = F.last(F.when(F.col("_fresh"), F.col("exposure")), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))
    marked = marked.withColumn("_later", change)
    stretch = lambda metres: F.floor(metres / bucket_m)
    # A span answers for positions up to NEAR_M before its end; the last one of a route to NEAR_M beyond, that place included.
    answers = marked.select(
        key, F.when(F.col("_last"), F.col("end_m") + NEAR_M).otherwise(F.col("end_m") - NEAR_M).alias("_at"), F.when(F.col("_last"), 0).otherwise(2).alias("_rank"),
        F.struct("exposure", "end_m", F.col("_later").alias("later")).alias("_now"))
    answers = answers.filter(F.col("_at").isNotNull()).withColumn("_bucket", stretch(F.col("_at")))
    here = positions.withColumn("_at", clamp(F.greatest(F.lit(0.0), F.coalesce(F.col(at), F.lit(0.0))), 0.0, route_m))
    here = here.withColumns({"_bucket": stretch(F.col("_at")), "_rank": F.lit(1)})
    # One row for every stretch with spans or positions; its first span end answers for the stretches before it.
    stretches = answers.select(key, "_bucket", F.struct(-F.col("_at"), "_rank").alias("_near"), "_now", F.lit(False).alias("_asked")).unionByName(
        here.select(key, "_bucket", F.lit(True).alias("_asked")), allowMissingColumns=True).groupBy(key, "_bucket").agg(
        F.max_by("_now", "_near").alias("_first"), F.max("_asked").alias("_asked"))
    onward = W.partitionBy(key).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    beyond = stretches.withColumn("_now", F.last("_first", ignorenulls=True).over(onward)).filter(F.col("_asked") & F.col("_now").isNotNull()).select(
        key, "_bucket", "_now", F.lit(float("inf")).alias("_at"), F.lit(0).alias("_rank"))
    both = here.unionByName(answers, allowMissingColumns=True).unionByName(beyond, allowMissingColumns=True)
    ahead = W.partitionBy(key, "_bucket").orderBy(F.desc("_at"), "_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = both.withColumn("_now", F.last("_now", ignorenulls=True).over(ahead)).filter("_rank = 1")
    finished = (F.col(route_m) <= NEAR_M) | (F.col("_at") >= F.col(route_m) - NEAR_M)
    state = F.coalesce(F.col("_now.exposure"), F.lit("unknown"))
    left = F.greatest(F.lit(0.0), F.coalesce(F.col("_now.end_m"), F.col(route_m)) - F.col("_at"))
    return joined.withColumns({
        "exposure": F.when(finished, "unknown").otherwise(state),
        "exposure_left_m": F.when(finished, 0.0).otherwise(left),
        "next_exposure": F.when(~finished, F.col("_now.later")),
    }).drop("_at", "_bucket", "_rank", "_now")


def match_positions(positions: DataFrame, segs: DataFrame, routes: DataFrame, steps: DataFrame | None = None,
                    position: str = "position_id", key: str = "route_id") -> DataFrame:
    """Nearest point of its route to each position, as distance along and away.

    Works on a stream of positions too: the route tables stay static and the
    nearest segment is a plain minimum, combined before the shuffle.
    """
    finite = positions.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat"))
    joined = finite.select(position, key, "lon", "lat").join(segs, key)
    sx = METRES_PER_LON * F.cos(F.radians("lat"))
    joined = joined.withColumns({
        "_ax": (F.col("x1") - F.col("lon")) * sx, "_ay": (F.col("y1") - F.col("lat")) * METRES_PER_LAT,
        "_bx": (F.col("x2") - F.col("lon")) * sx, "_by": (F.col("y2") - F.col("lat")) * METRES_PER_LAT,
    }).withColumns({"_dx": F.col("_bx") - F.col("_ax"), "_dy": F.col("_by") - F.col("_ay")})
    square = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
    joined = joined.withColumn("_f", F.when(square > 0, clamp(
        -(F.col("_ax") * F.col("_dx") + F.col("_ay") * F.col("_dy")) / square, 0.0, 1.0)).otherwise(0.0))
    px, py = F.col("_ax") + F.col("_dx") * F.col("_f"), F.col("_ay") + F.col("_dy") * F.col("_f")
    away = F.sqrt(px * px + py * py)
    along = F.col("start_m") + F.col("length_m") * F.col("_f")
    # At equal distances the first segment wins, whatever the order of the rows.
    best = joined.groupBy(position, key).agg(F.min(F.struct(away.alias("away_m"), "seg_idx", along.alias("_along"))).alias("_b"), F.max("total_m").alias("_total"))
    best = best.select(position, key, "_b.away_m", "_b._along", "_total")
    out = best.join(routes.select(key, F.greatest(F.lit(0.0), F.coalesce(F.col("distance_m").cast("double"), F.lit(0.0))).alias("route_m")), key)
    out = out.select(position, key, "away_m", "route_m",
                     F.when(F.col("_total") > 0, F.col("_along") / F.col("_total") * F.col("route_m")).otherwise(0.0).alias("along_m"))
    if steps is None:
        return out
    packed = step_arrays(steps, key).select(key, "steps")
    hit = F.get(F.filter("steps", lambda s: s["end_m"] > F.col("along_m") + NEAR_M), F.lit(0))
    return out.join(packed, key, "left").withColumn(
        "step_idx", F.coalesce(hit["dir_idx"], F.greatest(F.lit(0), F.size("steps") - 1))).drop("steps")
