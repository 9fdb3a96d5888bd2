"""Walked comparisons: predicted against observed sun on two or three routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up, holds
from ..functions.civil import instant_from_local

MINUTES = ["duration", "sun", "shade", "unknown"]
MAX_MINUTES = 240.0
# Id and version patterns, the permitted weather.
WALK_ID, WALK_VERSION = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,119}$", r"^[A-Za-z0-9][A-Za-z0-9._:+/-]{0,79}$"
WALK_WEATHER = "clear-direct-sun"


def minute_ok(name: str, positive: bool = False) -> Column:
    """Minutes with at most three decimals inside the permitted range."""
    v = F.col(name)
    fine = F.abs(v * 1000 - half_up(v * 1000)) < 1e-9
    return F.coalesce((v > 0 if positive else v >= 0) & (v <= MAX_MINUTES) & fine, F.lit(False))


def row_checks() -> list[tuple[str, Column]]:
    """Row rules: permitted minutes, permitted ranks, totals equal to the millesimal minute."""
    units = lambda name: half_up(F.col(name) * 1000)
    checks = []
    for side in ("predicted", "observed"):
        checks += [(f"{side}-{m}", minute_ok(f"{side}_{m}_min", m == "duration")) for m in MINUTES]
        parts = sum((units(f"{side}_{m}_min") for m in MINUTES[1:]), F.lit(0))
        checks.append((f"{side}-total", F.coalesce(units(f"{side}_duration_min") == parts, F.lit(False))))
    checks.append(("predicted-order", F.coalesce(F.col("predicted_order").between(1, 3), F.lit(False))))
    checks.append(("observed-order", F.col("observed_order").isNull() | F.col("observed_order").between(1, 3)))
    return checks


def entry_checks(areas: list[str], schema: str | None = None, schema_version: int | None = None) -> list[tuple[str, Column]]:
    """Rules for a whole entry: what names it, how it was walked, then its minutes and ranks."""
    checks = [
        ("comparison-id", holds(F.col("comparison_id").cast("string").rlike(WALK_ID))), ("area", holds(F.col("area").isin(*areas))),
        ("local-time", instant_from_local("comparison_london_datetime").isNotNull()), ("model-version", holds(F.col("model_version").rlike(WALK_VERSION))),
        ("route-id", holds(F.col("route_id").cast("string").rlike(WALK_ID))), ("walk-complete", holds(F.col("walk_complete"))),
        ("predicted-first", holds(F.col("prediction_frozen_before_walk"))), ("weather", holds(F.col("weather_visibility") == WALK_WEATHER))]
    if schema is not None:
        checks.insert(0, ("schema", holds(F.col("schema") == schema)))
    if schema_version is not None:
        checks.insert(len(checks) - 8, ("schema-version", holds(F.col("schema_version") == schema_version)))
    return checks + row_checks()


def group_verdicts(walks: DataFrame, constant: list[str] | None = None) -> DataFrame:
    """One row per comparison with the rules it breaks (empty when valid).

    Plain aggregates only, so even a comparison id repeated a million times is
    counted in parallel and rejected.
    """
    at = lambda side, rank: F.max(F.when(F.col(f"{side}_order") == rank, F.col(f"{side}_sun_min")))
    bit = lambda c: F.when(c == 1, 2).when(c == 2, 4).when(c == 3, 8).when(c.isNotNull(), 1).otherwise(0)
    ranks = lambda side: F.bit_or(bit(F.col(f"{side}_order")))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_distinct("route_id").alias("routes"),
            F.max(F.col("observed_unknown_min") > 0).alias("has_unknown"), F.count("observed_order").alias("ranked")]
    for side in ("predicted", "observed"):
        aggs += [ranks(side).alias(f"{side}_ranks"), *[at(side, r).alias(f"{side}_{r}") for r in (1, 2, 3)]]
    aggs += [(F.min(c) == F.max(c)).alias(f"same_{c}") for c in constant or []]
    g = walks.groupBy("comparison_id").agg(*aggs)
    # Bits 1..n set: the ranks are exactly 1..n.
    full = lambda side: F.col(f"{side}_ranks") == F.when(F.col("n") == 2, 6).when(F.col("n") == 3, 14)
    rising = lambda side: (F.col(f"{side}_1") <= F.col(f"{side}_2")) & (F.col(f"{side}_3").isNull() | (F.col(f"{side}_2") <= F.col(f"{side}_3")))
    rule = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), name)
    broken = F.array(
        rule(F.col("n").between(2, 3), "route-count"), rule(F.col("routes") == F.col("n"), "repeated-route"),
        *[rule(F.col(f"same_{c}"), f"varying-{c.replace('_', '-')}") for c in constant or []],
        rule(full("predicted"), "predicted-ranks"), rule(rising("predicted"), "predicted-order"),
        rule(~F.col("has_unknown") | (F.col("ranked") == 0), "ranked-despite-unknown"),
        rule(F.col("has_unknown") | full("observed"), "observed-ranks"), rule(F.col("has_unknown") | rising("observed"), "observed-order"))
    return g.select("comparison_id", "n", F.filter(broken, lambda b: b.isNotNull()).alias("broken_rules"))


def compare_walks(walks: DataFrame) -> DataFrame:
    """One row per valid comparison: best routes, agreement, regret, and sums for the summary."""
    first = lambda side, value: F.max(F.when(F.col(f"{side}_order") == 1, F.col(value)))
    comparable = F.min(F.col("observed_order").isNotNull().cast("int")) == 1
    error = F.when(F.col("observed_unknown_min") == 0, half_up(F.abs(F.col("predicted_sun_min") - F.col("observed_sun_min")), 3))
    out = walks.groupBy("comparison_id").agg(
        F.count(F.lit(1)).alias("routes"), first("predicted", "route_id").alias("predicted_best"),
        comparable.alias("comparable"), first("observed", "route_id").alias("_observed_best"),
        F.min((F.col("predicted_order") == F.col("observed_order")).cast("int")).alias("_agree"),
        half_up(first("predicted", "observed_sun_min") - first("observed", "observed_sun_min"), 3).alias("_regret"),
        F.sum(error).alias("error_sum"), F.count(error).alias("error_n"),
        *[F.sum(f"{side}_{m}_min").alias(f"{side}_{m}") for side in ("predicted", "observed") for m in ("duration", "unknown")])
    only = lambda value: F.when(F.col("comparable"), value)
    return out.withColumns({"observed_best": only(F.col("_observed_best")), "order_agrees": only(F.col("_agree") == 1),
                            "regret_min": only(F.col("_regret"))}).drop("_observed_best", "_agree", "_regret")


def summarise_walks(comparisons: DataFrame) -> DataFrame:
    """One row of headline measures; rates are null where nothing is comparable."""
    s = comparisons.groupBy().agg(
        F.sum("routes").alias("walks"), F.sum("error_n").alias("comparable_walks"), F.sum("error_sum").alias("_error"),
        F.count(F.lit(1)).alias("comparisons"), F.sum(F.col("comparable").cast("int")).cast("bigint").alias("comparable"),
        F.sum(F.col("order_agrees").cast("int")).cast("bigint").alias("agreeing"), F.sum("regret_min").alias("_regret"),
        *[F.sum(f"{side}_{m}").alias(f"_{side}_{m}") for side in ("predicted", "observed") for m in ("duration", "unknown")])
    rate = lambda part, whole: half_up(part / whole * 100, 3)
    shares = {}
    for side in ("predicted", "observed"):
        d, u = F.col(f"_{side}_duration"), F.col(f"_{side}_unknown")
        shares[f"{side}_coverage_percent"], shares[f"{side}_unknown_percent"] = rate(d - u, d), rate(u, d)
    return s.withColumns({
        "mae_min": F.when(F.col("comparable_walks") > 0, half_up(F.col("_error") / F.col("comparable_walks"), 3)),
        "agreement_percent": F.when(F.col("comparable") > 0, rate(F.coalesce("agreeing", F.lit(0)), F.col("comparable"))),
        "mean_regret_min": F.when(F.col("comparable") > 0, half_up(F.col("_regret") / F.col("comparable"), 3)), **shares,
    }).drop(*[c for c in s.columns if c.startswith("_")])
