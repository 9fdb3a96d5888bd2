"""Rules for field observations, feedback, saved journeys and provider rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import between, half_up, holds, is_finite
from ..functions.civil import instant_from_local
from ..functions.lookups import EXPOSURES, SITE_TYPES

# Permitted words and identifier patterns.
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,119}$"
SAFE_VERSION = r"^[A-Za-z0-9][A-Za-z0-9._:+/-]{0,119}$"
FINGERPRINT = r"^sha256-[0-9a-f]{64}$"
SIDES = ["left", "right", "centre"]
WEATHER_SEEN = ["clear-direct-sun", "intermittent-sun", "overcast"]
LEAVES = ["leaf-on", "partial", "leaf-off", "not-applicable"]
COORDINATE_SOURCES = ["manual", "one-shot-gps"]
OUTCOMES = ["predicted-correct", "actually-sunny", "actually-shaded", "blocked-or-inaccessible", "other"]
CLOCK = r"^(?:[01]\d|2[0-3]):[0-5]\d$"


def _text(name: str, low: int, high: int) -> Column:
    """Already trimmed text of permitted length: nothing is repaired silently."""
    c = F.coalesce(F.col(name), F.lit(""))
    return (c == F.trim(c)) & F.length(c).between(low, high)


def _decimals(name: str, digits: int) -> Column:
    return holds(F.col(name) == F.round(F.col(name), digits))


def observation_checks(schema: str | None = None, schema_version: int = 2, protocol: str | None = None) -> list[tuple[str, Column]]:
    """Rules for one observation joined to its area's box (west, south, east, north; null for an unknown area)."""
    word = lambda name, allowed: holds(F.col(name).isin(*allowed))
    like = lambda name, pattern: holds(F.col(name).rlike(pattern))
    gps, accuracy = F.col("coordinate_source") == "one-shot-gps", F.col("gps_accuracy_metres")
    checks = [
        ("schema-version", holds(F.col("schema_version") == schema_version)),
        ("model-version", like("model_version", SAFE_VERSION)), ("data-pack-version", like("data_pack_version", SAFE_VERSION)),
        ("fingerprint", like("data_pack_fingerprint", FINGERPRINT)), ("observation-id", _text("observation_id", 1, 120)),
        ("point-id", like("planned_point_id", SAFE_ID)), ("site-type", word("site_type", SITE_TYPES)),
        ("position", between("latitude", -90, 90) & between("longitude", -180, 180)
         & holds(F.col("longitude").between(F.col("west"), F.col("east")) & F.col("latitude").between(F.col("south"), F.col("north")))),
        ("decimals", _decimals("latitude", 7) & _decimals("longitude", 7) & (accuracy.isNull() | _decimals("gps_accuracy_metres", 1))),
        ("coordinate-source", word("coordinate_source", COORDINATE_SOURCES)),
        ("gps-accuracy", holds(F.when(gps, between("gps_accuracy_metres", 0, 10_000)).otherwise(accuracy.isNull()))),
        ("pavement-side", word("pavement_side", SIDES)), ("local-time", instant_from_local("observed_london_datetime").isNotNull()),
        ("weather", word("weather_visibility", WEATHER_SEEN)), ("observed", word("observed_state", ["sun", "shade"])), ("predicted", word("predicted_state", EXPOSURES)),
        ("predicted-first", holds(F.col("predicted_before_observation"))), ("leaf-state", word("leaf_state", LEAVES)),
        ("conditions", _text("temporary_conditions", 0, 500)), ("notes", _text("observer_notes", 0, 1_000))]
    if schema is not None:
        checks.insert(0, ("schema", holds(F.col("schema") == schema)))
    if protocol is not None:
        checks.insert(1, ("protocol", holds(F.col("protocol_version") == protocol)))
    return checks


def feedback_checks() -> list[tuple[str, Column]]:
    """Identity, outcome, and a usable position exactly when it was offered."""
    offered = F.coalesce(F.col("include_location"), F.lit(False))
    return [
        ("id", F.col("id").isNotNull()), ("route", F.col("route_id").isNotNull()), ("submitted", F.col("submitted_at").isNotNull()),
        ("outcome", holds(F.col("outcome").isin(*OUTCOMES))),
        ("location", ~offered | (between("location.latitude", -90, 90) & between("location.longitude", -180, 180)))]


def clean_feedback(feedback: DataFrame) -> DataFrame:
    """Unknown words become 'not-recorded' (states: null); a position without consent is dropped."""
    else_blank = lambda name, allowed: F.when(F.col(name).isin(*allowed), F.col(name)).otherwise("not-recorded")
    kept = F.when(F.coalesce(F.col("include_location"), F.lit(False)), F.col("location"))
    return feedback.withColumns({
        "predicted_state": F.when(F.col("predicted_state").isin(*EXPOSURES), F.col("predicted_state")),
        "pavement_side": else_blank("pavement_side", SIDES), "weather_visibility": else_blank("weather_visibility", WEATHER_SEEN),
        "leaf_state": else_blank("leaf_state", LEAVES), "seen_first": F.coalesce("seen_first", F.lit(False)),
        "include_location": F.coalesce("include_location", F.lit(False)), "location": kept})


def saved_journey_checks() -> list[tuple[str, Column]]:
    whole = lambda name, low, high: between(name, low, high) & holds(F.col(name) == F.floor(F.col(name)))
    end = lambda p: F.col(f"{p}_name").isNotNull() & between(f"{p}_lat", -90, 90) & between(f"{p}_lon", -180, 180)
    return [
        ("id", F.col("id").isNotNull()), ("label", F.col("label").isNotNull()), ("origin", end("origin")), ("destination", end("destination")),
        ("profile", holds(F.col("profile").isin("vulnerable", "worker"))), ("journeys", whole("journey_count", 1, 50)), ("repeat", whole("repeat_min", 5, 1_440)),
        ("steps", F.col("avoid_steps").isNotNull()), ("time", F.col("departure_time").isNull() | holds(F.col("departure_time").rlike(CLOCK)))]


def evidence_checks() -> list[tuple[str, Column]]:
    """Rules for one schedule score joined to the sums of its journeys (j_* columns)."""
    ordered = (F.col("best_s") >= 0) & (F.col("best_s") <= F.col("sun_s")) & (F.col("sun_s") <= F.col("worst_s"))
    n = F.col("journey_count")
    near = lambda c: F.abs(half_up(c) - F.col(f"j_{c}")) <= n
    return [
        ("journeys", holds(n.between(1, 8) & (F.col("j_n") == n) & (F.col("j_first") == 0) & (F.col("j_last") == n - 1))),
        ("repeat", holds(F.col("repeat_min").between(5, 1_440))), ("range", holds(ordered) & is_finite("sun_s")), ("journey-range", holds(F.col("j_ordered"))),
        ("daylight", holds(half_up("modelled_s") + half_up("unknown_s") == half_up("daylight_s"))),
        ("totals", holds(near("sun_s") & near("best_s") & near("worst_s"))),
        ("slower-than-fastest", holds((F.col("fastest_s") > 0) & (F.col("fastest_s") <= F.col("walk_s")))), ("distance", holds(F.col("distance_m") > 0)),
        ("coverage", between("coverage_percent", 0, 100)), ("shade", F.col("shade_percent").isNull() | between("shade_percent", 0, 100)),
        ("pace", holds(F.col("pace").isin("slow", "standard", "brisk"))), ("profile", holds(F.col("profile").isin("vulnerable", "worker")))]


def provider_row_checks(bounds: dict[str, tuple[float, float]], equal: dict[str, str], texts: dict[str, int]) -> list[tuple[str, Column]]:
    """Bounded numbers, required identities and bounded texts of a provider row."""
    checks = [(c, between(c, low, high)) for c, (low, high) in bounds.items()]
    checks += [(c, holds(F.col(c) == value)) for c, value in equal.items()]
    return checks + [(c, holds((F.trim(F.col(c)) != "") & (F.length(F.col(c)) <= limit))) for c, limit in texts.items()]
