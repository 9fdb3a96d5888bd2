"""Operational events, admission audits and request generations, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.basics import holds
from ..functions.lookups import duration_bucket
from ..session import cut_lineage

# The permitted words of the two event kinds.
HEAT_OUTCOMES = ["available", "no_active_alert", "stale", "unavailable"]
HEAT_DELIVERY = ["cache", "upstream", "stale_cache", "none"]
ROUTE_OUTCOMES = ["success", "busy", "invalid_request", "outside_pilot", "unavailable"]
ROUTE_DELIVERY = ["primary", "fallback", "none"]


def event_checks(kind: str = "route", areas: list[str] | None = None) -> list[tuple[str, Column]]:
    route = kind == "route"
    checks = [
        ("outcome", F.col("outcome").isin(*(ROUTE_OUTCOMES if route else HEAT_OUTCOMES))),
        ("delivery", F.col("delivery").isin(*(ROUTE_DELIVERY if route else HEAT_DELIVERY))),
        ("status", F.col("status_code").between(100, 599)), ("duration", F.col("duration_ms") >= 0)]
    if route:
        checks.append(("routes", F.col("route_count").between(0, 3)))
        if areas:
            checks.append(("area", F.col("area").isin(*areas)))
    return checks


def allow_listed(events: DataFrame, kind: str = "route", areas: list[str] | None = None) -> DataFrame:
    """Valid events reduced to the permitted fields; the duration only as a bucket."""
    ok = F.lit(True)
    for _, condition in event_checks(kind, areas):
        ok = ok & holds(condition)
    fields = ["outcome", "delivery", duration_bucket("duration_ms").alias("duration_bucket"), "status_code"]
    if kind == "route":
        fields += [c for c in ("area", "route_count") if c in events.columns]
    return events.filter(ok).select("ts", *fields)


def event_rollup(events: DataFrame, every: str = "1 minute") -> DataFrame:
    """Counts per tumbling window, outcome, delivery and duration bucket; batch or stream."""
    return events.groupBy(F.window("ts", every).alias("w"), "outcome", "delivery", "duration_bucket").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), "outcome", "delivery", "duration_bucket", "events")


def trailing_counts(events: DataFrame, key: list[str], window_ms: int = 60_000, limit: int = 120) -> DataFrame:
    """Requests in the trailing window (t - window, t] at every millisecond with one, and whether they pass the limit.

    Counts per millisecond come first. Each comes in at its time and leaves a
    window later, so what is inside is a running sum; time is cut into buckets of
    one window that begin with the sum of the one before, however busy the key is.
    """
    per_ms = events.groupBy(*key, F.col("at_ms")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("at_ms").isNotNull())
    bucket = F.floor(F.col("at_ms") / window_ms)
    entry = lambda at, n, here, b: F.struct(at.alias("_at"), n.alias("_n"), F.lit(here).alias("_here"), b.alias("_bucket"))
    moves = per_ms.select(*key, "at_ms", "n", F.explode(F.array(
        entry(F.col("at_ms"), F.col("n"), True, bucket), entry(F.col("at_ms") + window_ms, -F.col("n"), False, bucket + 1))).alias("_m")).select(*key, "at_ms", "n", "_m.*")
    opening = per_ms.groupBy(*key, bucket.alias("_home")).agg(F.sum("n").alias("_n")).select(
        *key, ((F.col("_home") + 1) * window_ms).alias("_at"), "_n", F.lit(False).alias("_here"), (F.col("_home") + 1).alias("_bucket"))
    line = W.partitionBy(*key, "_bucket").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = moves.unionByName(opening, allowMissingColumns=True).withColumn("in_window", F.sum("_n").over(line)).filter("_here")
    return counted.select(*key, "at_ms", "n", "in_window", (F.col("in_window") > limit).alias("over_limit"))


def tumbling_admission(events: DataFrame, key: list[str], window_ms: int = 60_000, limit: int = 30) -> DataFrame:
    """Requests per client in windows aligned to the clock: cheaper than ``anchored_admission`` and close to it."""
    return events.groupBy(*key, F.floor(F.col("at_ms") / window_ms).alias("window_no")).agg(F.count(F.lit(1)).alias("requests")).withColumn(
        "refused", F.greatest(F.lit(0), F.col("requests") - limit).cast("bigint"))


def anchored_admission(events: DataFrame, key: list[str], window_ms: int = 60_000, limit: int = 30) -> DataFrame:
    """Requests and refusals in windows that begin with a key's first request after the one before has ended.

    ``key`` may be a client or an instance.  A request without another in the
    window before it opens one; from each opening, the first request a window
    later opens the next.  Following these steps doubles their length in every
    round, so a key that is never quiet takes a logarithmic number of rounds,
    and time buckets of one window, copied to a neighbour, keep every sort small.
    """
    per_ms = cut_lineage(events.groupBy(*key, F.col("at_ms").cast("bigint").alias("at_ms")).agg(F.count(F.lit(1)).alias("n")))
    bucket = F.floor(F.col("at_ms") / window_ms)
    part = W.partitionBy(*key, "_b").orderBy("_at")
    # Next opening if a window opens here: the first request in this or the following bucket of its end.
    ends = per_ms.select(*key, "at_ms", (F.col("at_ms") + window_ms).alias("_at"), (bucket + 1).alias("_b"), F.lit(None).cast("bigint").alias("_seen"))
    seen = per_ms.select(*key, "at_ms", F.col("at_ms").alias("_at"), F.explode(F.array(bucket - 1, bucket)).alias("_b"), F.col("at_ms").alias("_seen"))
    # What lies ahead is a running minimum from the far end; a frame that ends at the last row would be folded anew for every row.
    back = W.partitionBy(*key, "_b").orderBy(F.desc("_at"))
    ahead = F.min("_seen").over(back.rangeBetween(W.unboundedPreceding, W.currentRow))
    steps = cut_lineage(ends.unionByName(seen).withColumn("_next", ahead).filter("_seen IS NULL AND _next IS NOT NULL").select(*key, "at_ms", F.col("_next").alias("next_ms")))
    # Openings known from the start: nothing in the window before.
    near = per_ms.select(*key, "at_ms", F.col("at_ms").alias("_at"), bucket.alias("_home"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    last = F.max("at_ms").over(part.rangeBetween(-(window_ms - 1), -1))
    opened = near.withColumn("_last", last).filter("_home = _b AND _last IS NULL").select(*key, "at_ms")
    opened = cut_lineage(opened)
    while not steps.isEmpty():
        reached = opened.join(steps, [*key, "at_ms"]).select(*key, F.col("next_ms").alias("at_ms"))
        opened = cut_lineage(opened.unionByName(reached).distinct())
        onward = steps.select(*key, F.col("at_ms").alias("next_ms"), F.col("next_ms").alias("_far"))
        steps = cut_lineage(steps.join(onward, [*key, "next_ms"]).select(*key, "at_ms", F.col("_far").alias("next_ms")))
    # Every request lies in the latest window opened before it, less than a window ago.
    starts = opened.select(*key, F.col("at_ms").alias("_at"), F.explode(F.array(bucket, bucket + 1)).alias("_b"), F.col("at_ms").alias("_open"), F.lit(None).cast("bigint").alias("n"))
    asked = per_ms.select(*key, F.col("at_ms").alias("_at"), bucket.alias("_b"), F.lit(None).cast("bigint").alias("_open"), "n")
    both = starts.unionByName(asked).withColumn("window_start_ms", F.max("_open").over(part.rangeBetween(W.unboundedPreceding, W.currentRow)))
    return both.filter("n IS NOT NULL").groupBy(*key, "window_start_ms").agg(F.sum("n").alias("requests")).withColumn(
        "refused", F.greatest(F.lit(0), F.col("requests") - limit).cast("bigint"))


def latest_generation(requests: DataFrame, key: list[str], order: str = "generation") -> DataFrame:
    """The newest request per task key."""
    fields = [c for c in requests.columns if c not in (*key, order)]
    return requests.groupBy(*key).agg(F.max(F.struct(order, *fields)).alias("b")).select(*key, "b.*")


def reject_known(incoming: DataFrame, stored: DataFrame, key: str = "observation_id") -> tuple[DataFrame, DataFrame]:
    """(rows with a new id, rows whose id is stored already or repeats within the batch)."""
    twice = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(key)
    taken = stored.select(key).unionByName(twice).distinct()
    return incoming.join(taken, key, "left_anti"), incoming.join(taken, key, "left_semi")
