"""Europe/London civil time against instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import ColumnLike, clamp, col, half_up

ZONE = "Europe/London"
LOCAL_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"
LOCAL_FORMAT = "yyyy-MM-dd'T'HH:mm"


def _wall(value: ColumnLike) -> Column:
    return F.when(col(value).rlike(LOCAL_PATTERN), F.try_to_timestamp(col(value), F.lit(LOCAL_FORMAT)))


def instant_from_local(value: ColumnLike) -> Column:
    """Instant of a local 'YYYY-MM-DDTHH:MM'; null in the spring gap, the earlier one in the autumn overlap.

    Assumes the session time zone is UTC.
    """
    wall = _wall(value)
    instant = F.to_utc_timestamp(wall, ZONE)
    return F.when(F.from_utc_timestamp(instant, ZONE) == wall, instant)


def local_from_instant(ts: ColumnLike) -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), ZONE), LOCAL_FORMAT)


def with_local_hour(value: ColumnLike, hour: ColumnLike) -> Column:
    """The same local date at a whole hour; bad input comes back unchanged."""
    ok = _wall(value).isNotNull() & col(hour).between(0, 23)
    moved = F.concat(F.substring(col(value), 1, 11), F.lpad(col(hour).cast("string"), 2, "0"), F.lit(":00"))
    return F.when(F.coalesce(ok, F.lit(False)), moved).otherwise(col(value))


def default_departure(now: ColumnLike) -> Column:
    """Next local quarter hour between 07:00 and 19:00, otherwise 14:30 on the same date."""
    local = F.from_utc_timestamp(col(now), ZONE)
    hour_start = F.date_trunc("HOUR", local)
    quarters = F.ceil(F.minute(local) / 15) * 15
    rounded = F.timestamp_add("MINUTE", quarters.cast("int"), hour_start)
    fixed = F.timestamp_add("MINUTE", F.lit(14 * 60 + 30), F.date_trunc("DAY", local))
    daytime = (F.hour(local) >= 7) & (F.hour(local) < 19)
    return F.date_format(F.when(daytime, rounded).otherwise(fixed), LOCAL_FORMAT)


def minutes_of_day(value: ColumnLike) -> Column:
    """Minutes after local midnight of a local date-time, optional seconds allowed; null if malformed."""
    full = r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2})(?::\d{2}(?:\.\d+)?)?$"
    day_ok = F.try_to_timestamp(F.regexp_extract(col(value), full, 1), F.lit("yyyy-MM-dd")).isNotNull()
    hour = F.regexp_extract(col(value), full, 2).try_cast("int")
    minute = F.regexp_extract(col(value), full, 3).try_cast("int")
    return F.when(col(value).rlike(full) & day_ok & (hour <= 23) & (minute <= 59), hour * 60 + minute)


def local_at_minutes(date: ColumnLike, minutes: ColumnLike) -> Column:
    """Local date-time from a date and minutes, rounded and held inside 00:00-23:45."""
    held = clamp(half_up(minutes), 0, 23 * 60 + 45).cast("int")
    two = lambda part: F.lpad(part.cast("string"), 2, "0")
    return F.concat(col(date), F.lit("T"), two(F.floor(held / 60)), F.lit(":"), two(held % 60))


def is_iso_date(value: ColumnLike) -> Column:
    """Exact YYYY-MM-DD naming a real calendar day."""
    return F.coalesce(
        col(value).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(col(value), F.lit("yyyy-MM-dd")).isNotNull(),
        F.lit(False))


def epoch_ms(ts: ColumnLike) -> Column:
    return F.unix_millis(col(ts))


def instant_from_iso(value: ColumnLike) -> Column:
    """Instant of an ISO date-time string of at most 40 characters; null if unreadable."""
    # Spark wants seconds; feeds often stop at the minute.
    full = F.regexp_replace(col(value), r"T(\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?$", "T$1:00$2")
    return F.when(F.length(col(value)) <= 40, full.try_cast("timestamp"))
