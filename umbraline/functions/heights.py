"""Occluder heights: required height, uncertainty and tag parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import ColumnLike, clamp, col, half_up

# Fixed values.
RECEIVER_HEIGHT_M = 1.5
STOREY_HEIGHT_M = 3.0
FALLBACK_HEIGHT_M = 12.0
FALLBACK_SPREAD_M = 6.0
MAX_TAGGED_HEIGHT_M = 1_000.0
MAX_TAGGED_LEVELS = 200.0


def required_height(distance_m: ColumnLike, altitude_deg: ColumnLike, receiver_m: float = RECEIVER_HEIGHT_M) -> Column:
    """Height an object must reach at this distance to block the sun."""
    return F.lit(receiver_m) + col(distance_m) * F.tan(F.radians(col(altitude_deg)))


def triangular_exceedance(required: ColumnLike, low: ColumnLike, mode: ColumnLike, high: ColumnLike) -> Column:
    """P(height >= required) for a triangular distribution."""
    r, a, m, b = col(required), col(low), col(mode), col(high)
    below = 1 - (r - a) * (r - a) / ((b - a) * (m - a))
    above = (b - r) * (b - r) / ((b - a) * (b - m))
    return (
        F.when(a == b, F.when(r <= a, 1.0).otherwise(0.0))
        .when(r <= a, 1.0)
        .when(r >= b, 0.0)
        .when((r <= m) & (m > a), clamp(below, 0.0, 1.0))
        .otherwise(clamp(above, 0.0, 1.0))
    )


def bounded_positive(text: ColumnLike, maximum: float) -> Column:
    """A plain decimal in (0, maximum]; anything else is null."""
    cleaned = F.trim(col(text))
    number = F.when(cleaned.rlike(r"^\d+(\.\d+)?$"), cleaned.try_cast("double"))
    return F.when((number > 0) & (number <= maximum), number)


def parsed_height_m(text: ColumnLike) -> Column:
    """Metres from a height tag: metres, feet, or feet and inches; null if unusable."""
    raw = F.trim(col(text))
    # The accepted spellings of each unit.
    metric = r"(?i)^(\d+(?:\.\d+)?)\s*(?:m|metres?|meters?)?$"
    feet = r"(?i)^(\d+(?:\.\d+)?)\s*(?:ft|feet|foot)$"
    mixed = r"^(\d+)'(?:\s*(\d+(?:\.\d+)?)\")?$"
    inches = F.coalesce(F.regexp_extract(raw, mixed, 2).try_cast("double"), F.lit(0.0))
    from_feet = F.regexp_extract(raw, feet, 1).try_cast("double") * 0.3048
    from_mixed = F.regexp_extract(raw, mixed, 1).try_cast("double") * 0.3048 + inches * 0.0254
    in_feet = F.when((from_feet > 0) & (from_feet <= MAX_TAGGED_HEIGHT_M), half_up(from_feet, 2))
    in_mixed = F.when((inches < 12) & (from_mixed > 0) & (from_mixed <= MAX_TAGGED_HEIGHT_M), half_up(from_mixed, 2))
    return (
        F.when(raw.rlike(metric), bounded_positive(F.regexp_extract(raw, metric, 1), MAX_TAGGED_HEIGHT_M))
        .when(raw.rlike(feet), in_feet)
        .when(raw.rlike(mixed), in_mixed)
    )
