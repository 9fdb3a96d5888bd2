"""When to leave: the best departure slot of a request, and when to say nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import steps
from .labels import fold

# Fixed values.
WINDOW_MINUTES, STEP_MINUTES = 120, 15
MIN_SAVING_S, MIN_COVERAGE, TOLERANCE_S = 60.0, 80.0, 1e-6


def slot_minutes(window: int = WINDOW_MINUTES, step: int = STEP_MINUTES) -> list[int]:
    if window < 0 or step <= 0:
        raise ValueError("window must be non-negative and step positive")
    return list(range(0, window + 1, step))


def departure_options(labelled: DataFrame, request: str = "request_id", slot: str = "offset_min") -> DataFrame:
    """The recommended route of each slot (the first route where none is), per-journey values."""
    rank = F.struct(F.when(F.array_contains("labels", "recommended"), 0).otherwise(1).alias("late"), F.col("route_pos"))
    fields = ["route_pos", "route_id", "duration_s", "journey_count", "sun_s", "best_s", "worst_s",
              "is_daylight", "coverage_percent", "low_sun"]
    best = labelled.groupBy(request, slot).agg(F.min_by(F.struct(*fields), rank).alias("o"))
    count = F.greatest(F.lit(1), F.col("o.journey_count"))
    return best.select(
        request, slot, "o.route_id", "o.route_pos", (F.col("o.duration_s") / count).alias("walk_s"),
        (F.col("o.sun_s") / count).alias("sun_s"), (F.col("o.best_s") / count).alias("best_s"),
        (F.col("o.worst_s") / count).alias("worst_s"), "o.is_daylight", "o.coverage_percent", "o.low_sun")


def _better(item: Column, best: Column) -> Column:
    """Compare estimate, worst case, walking time (each with a tolerance), then departure, then route order."""
    verdict = F.lit(False)
    tie_order = (item["offset_min"] < best["offset_min"]) | (
        (item["offset_min"] == best["offset_min"]) & (item["route_pos"] < best["route_pos"]))
    verdict = tie_order
    for name in ("walk_s", "worst_s", "sun_s"):
        gap = item[name] - best[name]
        verdict = F.when(gap < -TOLERANCE_S, True).when(gap > TOLERANCE_S, False).otherwise(verdict)
    return verdict


def departure_advice(options: DataFrame, request: str = "request_id", min_saving_s: float = MIN_SAVING_S,
                     min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per request: best slot, saving, confidence and the reason for withholding, if any.

    A request has as many options as the scan has slots, a number fixed by the caller.
    """
    if not 0 <= min_coverage <= 100 or min_saving_s < 0:
        raise ValueError("coverage must be a percentage and the saving non-negative")
    fields = ["offset_min", "route_pos", "route_id", "walk_s", "sun_s", "best_s", "worst_s", "is_daylight", "coverage_percent", "low_sun"]
    folded = options.groupBy(request).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("options"))
    now, best = F.col("now"), F.col("best")
    folded = steps(
        folded,
        {"now": F.get("options", F.lit(0))},
        {"open": F.filter("options", lambda o: ~now["is_daylight"] | o["is_daylight"])},
        {"best": fold(F.col("open"), _better, start=now)},
        {"saved_s": F.greatest(F.lit(0.0), now["sun_s"] - best["sun_s"])},
    )
    needed = F.greatest(F.lit(min_saving_s), now["sun_s"] * 0.1)
    reason = (
        F.when(~now["is_daylight"], "no-daylight")
        .when((now["coverage_percent"] < min_coverage) | (best["coverage_percent"] < min_coverage), "low-model-coverage")
        .when(F.col("saved_s") + TOLERANCE_S < needed, "insufficient-saving")
        .when(now["low_sun"] | best["low_sun"], "low-sun-confidence")
        .when(now["best_s"] - best["worst_s"] <= TOLERANCE_S, "sensitivity-overlap"))
    folded = folded.withColumn("withheld_reason", reason)
    confidence = (
        F.when(F.col("withheld_reason").isNull(), "moderate")
        .when(F.col("withheld_reason").isin("no-daylight", "low-model-coverage"), "unavailable").otherwise("limited"))
    return folded.select(
        request, best["route_id"].alias("route_id"), best["offset_min"].alias("offset_min"),
        best["sun_s"].alias("sun_s"), "saved_s",
        F.greatest(F.lit(0.0), best["walk_s"] - now["walk_s"]).alias("extra_walk_s"),
        F.least(now["coverage_percent"], best["coverage_percent"]).alias("coverage_percent"),
        confidence.alias("confidence"), "withheld_reason", F.col("withheld_reason").isNull().alias("recommended"),
        F.size("options").alias("scanned"))


def with_empty_requests(advice: DataFrame, requests: DataFrame, request: str = "request_id") -> DataFrame:
    """Add a row for requests that had no route at all."""
    full = requests.select(request).join(advice, request, "left")
    missing = F.col("scanned").isNull()
    return full.withColumns({
        "withheld_reason": F.when(missing, "no-routes").otherwise(F.col("withheld_reason")),
        "confidence": F.when(missing, "unavailable").otherwise(F.col("confidence")),
        "recommended": F.coalesce("recommended", F.lit(False)), "scanned": F.coalesce("scanned", F.lit(0))})
