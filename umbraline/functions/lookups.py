"""Fixed vocabularies and the small lookups built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import ColumnLike, col, half_up

# Vocabularies, in canonical order.
EXPOSURES = ["sun", "shade", "uncertain", "unknown", "night"]
REASONS = [
    "incomplete-height-coverage", "low-sun-angle", "near-clearance-threshold",
    "ray-search-limit", "subcell-surface-variation", "unmodelled-passage",
]
LABELS = ["fastest", "least-sun", "lowest-estimate", "recommended"]
CATEGORIES = ["cool-space", "drinking-water", "toilet", "rest", "tree"]
SUBTYPE_CATEGORY = {
    "official-cool-space": "cool-space", "drinking-fountain": "drinking-water", "toilet": "toilet",
    "bench": "rest", "shelter": "rest", "individual-tree": "tree", "public-realm-street-tree": "tree",
}
SITE_TYPES = ["open-street", "building-edge", "tree-canopy", "street-canyon", "station-approach", "hospital-entrance"]
TREE_LOCATIONS = ["Highways", "Housing", "Other", "Outside London", "Parks"]
PACE_FACTOR = {"slow": 1.5, "standard": 1.0, "brisk": 0.8}
# Provider weather codes (there is no code 4).
WEATHER = {
    0: "Clear night", 1: "Sunny day", 2: "Partly cloudy night", 3: "Partly cloudy day",
    5: "Mist", 6: "Fog", 7: "Cloudy", 8: "Overcast",
    9: "Light rain shower at night", 10: "Light rain shower by day", 11: "Drizzle", 12: "Light rain",
    13: "Heavy rain shower at night", 14: "Heavy rain shower by day", 15: "Heavy rain",
    16: "Sleet shower at night", 17: "Sleet shower by day", 18: "Sleet",
    19: "Hail shower at night", 20: "Hail shower by day", 21: "Hail",
    22: "Light snow shower at night", 23: "Light snow shower by day", 24: "Light snow",
    25: "Heavy snow shower at night", 26: "Heavy snow shower by day", 27: "Heavy snow",
    28: "Thunder shower at night", 29: "Thunder shower by day", 30: "Thunder",
}
# Upper bounds (exclusive, milliseconds) of the duration buckets.
DURATION_BUCKETS = [(50, "under_50_ms"), (200, "50_to_199_ms"), (1_000, "200_to_999_ms"), (4_000, "1_to_3_999_s")]


def pace_duration(duration_s: ColumnLike, pace: ColumnLike) -> Column:
    """Walking time at a pace; an unknown pace counts as standard."""
    table = F.create_map(*[part for k, v in PACE_FACTOR.items() for part in (F.lit(k), F.lit(v))])
    return col(duration_s) * F.coalesce(F.try_element_at(table, col(pace)), F.lit(1.0))


def weather_condition(code: ColumnLike) -> Column:
    table = F.create_map(*[part for k, v in WEATHER.items() for part in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, col(code).cast("int"))


def cloud_signal(code: ColumnLike) -> Column:
    c = col(code)
    return (
        F.when(c.isin(0, 1), "clear-or-sunny").when(c.isin(2, 3), "partly-cloudy")
        .when(c.isin(7, 8), "cloudy-or-overcast").otherwise("not-separately-reported"))


def duration_bucket(ms: ColumnLike) -> Column:
    """Bucket name; null for a negative or missing duration."""
    c = col(ms)
    out = F.when(c.isNull() | (c < 0), F.lit(None).cast("string"))
    for bound, name in DURATION_BUCKETS:
        out = out.when(c < bound, name)
    return out.otherwise("4_s_or_more")


def extra_time_kind(duration_s: ColumnLike, fastest_s: ColumnLike) -> tuple[Column, Column]:
    """(kind, whole minutes shown) of the extra time against the fastest route."""
    shown = F.greatest(F.lit(0), half_up(col(duration_s) / 60) - half_up(col(fastest_s) / 60))
    same = col(duration_s) - col(fastest_s) <= 1
    kind = F.when(same, "same").when(shown > 0, "minutes").otherwise("under-minute")
    return kind, F.when(same, 0).otherwise(shown).cast("bigint")


def reported_state(outcome: ColumnLike, predicted: ColumnLike) -> Column:
    o, p = col(outcome), col(predicted)
    return (
        F.when(o == "actually-sunny", "sun").when(o == "actually-shaded", "shade")
        .when((o == "predicted-correct") & p.isin("sun", "shade"), p).otherwise("not-recorded"))


def canonical(values: ColumnLike, order: list[str]) -> Column:
    """Distinct members of an array, in the fixed order."""
    return F.filter(F.array(*[F.lit(v) for v in order]), lambda item: F.array_contains(col(values), item))
