"""Coordinate-free decision records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up, split_valid
from ..functions.lookups import LABELS, canonical
from .rays import reason_names
from .records import evidence_checks

MAX_JOURNEYS = 8


def _instant(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def journey_sums(journeys: DataFrame, request: str = "request_id") -> DataFrame:
    """Per request: rounded sums, index range, ordering, reasons - what a record must agree with."""
    whole = {c: half_up(c) for c in ("sun_s", "best_s", "worst_s")}
    ordered = (whole["best_s"] <= whole["sun_s"]) & (whole["sun_s"] <= whole["worst_s"])
    return journeys.groupBy(request).agg(
        F.count(F.lit(1)).alias("j_n"), F.min("journey").alias("j_first"), F.max("journey").alias("j_last"), F.min(ordered).alias("j_ordered"),
        *[F.sum(v).alias(f"j_{c}") for c, v in whole.items()], F.bit_or("reason_bits").alias("j_reason_bits"))


def decision_evidence(selected: DataFrame, journeys: DataFrame, constants: dict[str, str], limitations: list[str],
                      request: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(records, rejected requests).

    ``selected``: the chosen schedule score per request with the fastest route's
    figures, names, labels, access evidence and provenance.  ``journeys``: its
    journeys, at most eight.  ``constants`` holds schema, version and model names.
    """
    joined = selected.join(journey_sums(journeys, request), request, "left")
    good, bad = split_valid(joined, evidence_checks())
    percent = lambda c: half_up(c, 1)
    whole = lambda c: half_up(c).cast("bigint")
    entry = F.struct(
        F.col("journey").alias("index"), _instant(F.col("departure_ms")).alias("departure"), _instant(F.col("departure_ms") + F.col("walk_s") * 1000).alias("arrival"),
        whole("sun_s").alias("estimatedPotentialDirectSunSeconds"),
        F.struct(whole("best_s").alias("bestCase"), whole("worst_s").alias("worstCase")).alias("potentialDirectSunRangeSeconds"),
        percent("shade_percent").alias("estimatedShadePercent"), percent("coverage_percent").alias("modelledCoveragePercent"),
        F.struct((F.col("reason_bits") != 0).alias("limited"), reason_names("reason_bits").alias("reasons")).alias("confidence"))
    listed = journeys.join(good.select(request), request, "left_semi").groupBy(request).agg(F.array_sort(F.collect_list(entry)).alias("_journeys"))
    j = good.join(listed, request)
    fixed = lambda **kv: F.struct(*[F.lit(v).alias(k) for k, v in kv.items()])
    extra = whole("walk_s") - whole("fastest_s")
    record = F.struct(
        F.lit(constants["schema"]).alias("schema"), F.lit(int(constants["schema_version"])).alias("schemaVersion"), _instant(F.col("created_ms")).alias("createdAt"),
        fixed(scope="planned-journey-only", plannedEndpointCoordinatesIncluded=False, deviceLocationIncluded=False, freeTextNotesIncluded=False,
              savedHistoryIncluded=False, inferredHealthDataIncluded=False).alias("privacy"),
        F.struct(
            F.struct(F.col("area_id").cast("string").alias("id"), F.col("area_name").alias("name")).alias("area"),
            F.struct(F.struct(F.col("origin_name").alias("name")).alias("origin"), F.struct(F.col("destination_name").alias("name")).alias("destination")).alias("plannedEndpoints"),
            _instant(F.col("departure_ms")).alias("departure"),
            F.struct(F.col("profile").alias("id"), F.lit("user-selected-planning-mode").alias("basis")).alias("planningProfile"),
            F.col("pace").alias("walkingPace"), F.struct(F.col("journey_count").alias("journeyCount"), F.col("repeat_min").alias("repeatEveryMinutes")).alias("schedule")).alias("journey"),
        F.struct(
            F.struct(F.col("route_id").cast("string").alias("id"), whole("distance_m").alias("distanceMetresPerJourney"), whole("walk_s").alias("durationSecondsPerJourney"),
                     canonical("labels", LABELS).alias("labels")).alias("selectedRoute"),
            F.struct(F.col("fastest_id").cast("string").alias("routeId"), whole("fastest_m").alias("distanceMetresPerJourney"), whole("fastest_s").alias("durationSecondsPerJourney")).alias("fastestAlternative"),
            F.struct(extra.alias("additionalDurationSecondsPerJourney"), (whole("distance_m") - whole("fastest_m")).alias("distanceDifferenceMetresPerJourney")).alias("selectedVsFastest"),
            F.struct(F.col("avoid_steps").alias("avoidKnownStepsRequested"), F.col("access_evidence").alias("evidenceStatus"), F.col("crossing_evidence").alias("crossingEvidence"),
                     F.col("surface_evidence").alias("surfaceEvidence"), F.lit("not-step-free-certified").alias("certification")).alias("access")).alias("decision"),
        F.struct(
            F.lit("clear-sky-geometric-model").alias("basis"), F.lit("whole-schedule").alias("scope"), F.col("j_sun_s").cast("bigint").alias("estimatedPotentialDirectSunSeconds"),
            F.struct(F.col("j_best_s").cast("bigint").alias("bestCase"), F.col("j_worst_s").cast("bigint").alias("worstCase")).alias("potentialDirectSunRangeSeconds"),
            percent("shade_percent").alias("estimatedShadePercent"), percent("coverage_percent").alias("modelledCoveragePercent"), whole("daylight_s").alias("daylightSeconds"),
            whole("modelled_s").alias("modelledDaylightSeconds"), whole("unknown_s").alias("unknownDaylightSeconds"),
            F.struct((F.col("j_reason_bits") != 0).alias("limited"), reason_names("j_reason_bits").alias("reasons")).alias("confidence"), F.col("_journeys").alias("journeys")).alias("modelOutput"),
        F.struct(
            fixed(source=constants["route_source"], sourceDate=constants["route_date"]).alias("routeData"),
            fixed(source=constants["height_source"], sourceDate=constants["height_date"], processedDate=constants["height_processed"]).alias("heightData"),
            fixed(name=constants["model_name"], version=constants["model_version"]).alias("model")).alias("provenance"),
        F.struct(F.lit("uncalibrated").alias("validationStatus"), F.array(*[F.lit(t) for t in limitations]).alias("limitations")).alias("assurance"))
    return j.select(request, record.alias("record")), bad
