"""Ranking the few alternatives of one request.

A request holds at most eight candidate routes, so its scores fit one short
array.  The comparisons use tolerances and are not transitive: they must run in
route order, which is what the array folds below do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.basics import holds, steps
from ..functions.lookups import extra_time_kind

# Detour caps (seconds, share of the fastest) per profile.
DETOUR = {"vulnerable": (300.0, 0.20), "worker": (180.0, 0.15)}
VISIBLE_S = 30.0
MEANINGFUL_SHARE = 0.05
GUARD_COVERAGE = 90.0

Better = Callable[[Column, Column], Column]


def fold(items: Column, better: Better, start: Column | None = None) -> Column:
    """Best item of an array under a pairwise rule, taken in array order; null when empty."""
    first = F.get(items, F.lit(0)) if start is None else start
    rest = items if start is not None else F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda best, item: F.when(better(item, best), item).otherwise(best))


def per_journey(score: Column) -> Column:
    return score["duration_s"] / F.greatest(F.lit(1), score["journey_count"])


def _faster(item: Column, best: Column) -> Column:
    return per_journey(item) < per_journey(best)


def _lower_range(reference: Column, candidate: Column) -> Column:
    return candidate["worst_s"] < reference["best_s"]


def _below_all(candidate: Column, others: Column) -> Column:
    return F.forall(others, lambda o: (o["route_id"] == candidate["route_id"]) | _lower_range(o, candidate))


def _requests(scores: DataFrame, request: list[str], extra: list[str]) -> DataFrame:
    fields = ["route_pos", "route_id", "duration_s", "journey_count", "sun_s", "best_s", "worst_s", "is_daylight", *extra]
    return scores.groupBy(*request).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("routes"))


def _choice(items: str, base: str, least_gain: Column) -> dict[str, Column]:
    """Alternatives of ``items`` proven below ``base``, the one below all others, and the shortest."""
    b = F.col(base)
    return {"alternatives": F.filter(
        items, lambda s: (s["route_id"] != b["route_id"]) & (b["sun_s"] - s["sun_s"] >= least_gain) & _lower_range(b, s))}


def label_routes(scores: DataFrame, request: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """One row per route with labels, reason code, and the numbers behind the reason.

    Needs route_pos, route_id, profile, journey_count, duration_s, sun_s,
    best_s, worst_s and is_daylight.  ``extra`` columns ride along.
    """
    request, extra = request or ["request_id"], extra or []
    folded = _requests(scores, [*request, "profile"], extra)
    fastest, least = F.col("fastest"), F.col("least")
    worker = F.col("profile") == "worker"
    cap = F.when(worker, DETOUR["worker"][0]).otherwise(DETOUR["vulnerable"][0])
    share = F.when(worker, DETOUR["worker"][1]).otherwise(DETOUR["vulnerable"][1])

    def least_sun(item: Column, best: Column) -> Column:
        gap = item["sun_s"] - best["sun_s"]
        return (gap < 0) | ((gap == 0) & _faster(item, best))

    def eligible_sun(item: Column, best: Column) -> Column:
        gap = item["sun_s"] - best["sun_s"]
        return (gap < -F.col("tie")) | ((F.abs(gap) <= F.col("tie")) & _faster(item, best))

    suns = F.transform("routes", lambda s: s["sun_s"])
    folded = steps(
        folded,
        {"fastest": fold(F.col("routes"), _faster), "least": fold(F.col("routes"), least_sun)},
        {"visible": VISIBLE_S * F.greatest(F.lit(1), fastest["journey_count"]), "fast_s": per_journey(fastest)},
        {
            "any_day": F.exists("routes", lambda s: s["is_daylight"]),
            "allowed_s": F.least(cap, F.col("fast_s") * share),
            "tie": F.when(worker, F.col("visible")).otherwise(0.0),
            "gain_s": F.greatest(F.col("visible"), fastest["sun_s"] * MEANINGFUL_SHARE),
        },
        {
            "differs": F.col("any_day") & (F.array_max(suns) - F.array_min(suns) >= F.col("visible")),
            "eligible": F.filter("routes", lambda s: per_journey(s) <= F.col("fast_s") + F.col("allowed_s")),
        },
        {"ordered": F.col("differs") & _below_all(least, F.col("routes")), "best": fold(F.col("eligible"), eligible_sun)},
        _choice("eligible", "fastest", F.col("gain_s")),
        {"clear": F.get(F.filter("alternatives", lambda c: _below_all(c, F.col("alternatives"))), F.lit(0)),
         "short": fold(F.col("alternatives"), _faster)},
        {"pick": F.coalesce("clear", "short", "fastest")},
    )
    pick = F.col("pick")
    same = pick["route_id"] == fastest["route_id"]
    estimate_only = (F.col("best")["route_id"] != fastest["route_id"]) & (
        fastest["sun_s"] - F.col("best")["sun_s"] >= F.col("gain_s")) & (F.size("alternatives") == 0)
    reason = (
        F.when(~F.col("any_day"), "no-daylight")
        .when(same & (pick["route_id"] == least["route_id"]), "fastest-and-lowest")
        .when(estimate_only, "ranges-overlap")
        .when(same, "small-saving")
        .when((F.size("alternatives") > 1) & F.col("clear").isNull(), "several-lower")
        .otherwise("lower-sun"))
    folded = folded.withColumns({
        "reason_code": reason, "saving_s": fastest["sun_s"] - pick["sun_s"],
        "extra_s": F.greatest(F.lit(0.0), per_journey(pick) - F.col("fast_s"))})
    row = F.col("row")
    chosen, quickest, lowest = (row["route_id"] == F.col(n)["route_id"] for n in ("pick", "fastest", "least"))
    labels = F.filter(F.array(
        F.when(chosen, "recommended"),
        F.when(F.col("differs") & lowest, F.when(F.col("ordered"), "least-sun").otherwise("lowest-estimate")),
        F.when(quickest, "fastest")), lambda item: item.isNotNull())
    out = folded.withColumn("row", F.explode("routes")).withColumns({
        "labels": labels, **{n: F.when(chosen, F.col(n)) for n in ("reason_code", "saving_s", "extra_s", "allowed_s")}})
    return out.select(*request, "profile", "row.*", "labels", "reason_code", "saving_s", "extra_s", "allowed_s")


def label_routes_footprint(scores: DataFrame, request: list[str] | None = None) -> DataFrame:
    """Labels of the footprint model: one detour rule, a 30 s tie for workers only."""
    request = request or ["request_id"]
    folded = scores.groupBy(*request, "profile").agg(
        F.array_sort(F.collect_list(F.struct("route_pos", "route_id", "duration_s", "sun_s"))).alias("routes"))
    quick = lambda item, best: item["duration_s"] < best["duration_s"]

    def least_sun(item: Column, best: Column) -> Column:
        return (item["sun_s"] < best["sun_s"]) | ((item["sun_s"] == best["sun_s"]) & quick(item, best))

    def advised(item: Column, best: Column) -> Column:
        gap = item["sun_s"] - best["sun_s"]
        tied = (F.col("profile") == "worker") & (F.abs(gap) < VISIBLE_S)
        return F.when(tied, quick(item, best)).otherwise((gap < 0) | ((gap == 0) & quick(item, best)))

    folded = steps(
        folded,
        {"fastest": fold(F.col("routes"), quick), "least": fold(F.col("routes"), least_sun)},
        {"eligible": F.filter("routes", lambda s: s["duration_s"] <= F.col("fastest")["duration_s"]
                              + F.least(F.lit(300.0), F.col("fastest")["duration_s"] * 0.2) + 1e-9)},
        {"pick": fold(F.col("eligible"), advised)},
    )
    row = F.col("row")
    labels = F.filter(F.array(*[
        F.when(row["route_id"] == F.col(c)["route_id"], name)
        for c, name in (("pick", "recommended"), ("least", "least-sun"), ("fastest", "fastest"))]), lambda i: i.isNotNull())
    return folded.withColumn("row", F.explode("routes")).withColumn("labels", labels).select(*request, "row.*", "labels")


def apply_access_guard(labelled: DataFrame, step_free: str = "step_free", request: list[str] | None = None) -> DataFrame:
    """Withhold or re-rank the suggestion of :func:`label_routes`.

    Without enough coverage or with a low sun nothing is recommended.  A
    step-free request chooses among routes without known barriers.  Needs
    coverage_percent, low_sun and avoids_barriers (pass them as ``extra``).
    """
    request = request or ["request_id"]
    fields = [c for c in labelled.columns if c not in (*request, step_free)]
    ordered = ["route_pos", *[c for c in fields if c != "route_pos"]]
    folded = labelled.groupBy(*request, step_free).agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("routes"))
    base = F.col("base")
    folded = steps(
        folded,
        {"supported": F.exists("routes", lambda s: s["is_daylight"]) & F.forall(
            "routes", lambda s: ~s["is_daylight"] | ((s["coverage_percent"] >= GUARD_COVERAGE) & ~s["low_sun"])),
         "suitable": F.filter("routes", lambda s: s["avoids_barriers"])},
        {"base": fold(F.col("suitable"), _faster)},
        {"base_s": per_journey(base), "gain_s": F.greatest(
            VISIBLE_S * F.greatest(F.lit(1), base["journey_count"]), base["sun_s"] * MEANINGFUL_SHARE)},
        {"eligible": F.filter("suitable", lambda s: per_journey(s) <= F.col("base_s") + F.least(F.lit(300.0), F.col("base_s") * 0.2))},
        _choice("eligible", "base", F.col("gain_s")),
        {"clear": F.get(F.filter("alternatives", lambda c: _below_all(c, F.col("alternatives"))), F.lit(0)),
         "short": fold(F.col("alternatives"), _faster)},
        {"pick": F.coalesce("clear", "short", "base")},
    )
    row, pick = F.col("row"), F.col("pick")
    plain = F.filter(row["labels"], lambda label: label != "recommended")
    chosen = holds(F.col("supported") & F.col(step_free) & (row["route_id"] == pick["route_id"]))
    untouched = holds(F.col("supported") & ~F.col(step_free))
    code = (
        F.when(pick["route_id"] == base["route_id"], "access-fastest")
        .when((F.size("alternatives") > 1) & F.col("clear").isNull(), "access-several-lower").otherwise("access-lower-sun"))
    out = folded.withColumn("row", F.explode("routes")).withColumns({
        "labels": F.when(untouched, row["labels"]).when(chosen, F.concat(F.array(F.lit("recommended")), plain)).otherwise(plain),
        "reason_code": F.when(untouched, row["reason_code"]).when(chosen, code)})
    kept = [f"row.{c}" for c in fields if c not in ("labels", "reason_code", "saving_s", "extra_s", "allowed_s")]
    return out.select(*request, step_free, *kept, "labels", "reason_code")


def with_display_order(labelled: DataFrame, request: list[str] | None = None) -> DataFrame:
    """Recommended first, then source order; with the time difference to the fastest route."""
    request = request or ["request_id"]
    whole = W.partitionBy(*request)
    first = F.when(F.array_contains("labels", "recommended"), 0).otherwise(1)
    fastest = F.min("duration_s").over(whole)
    kind, shown = extra_time_kind(F.col("duration_s"), F.col("fastest_s"))
    return labelled.withColumns({
        "display_rank": F.row_number().over(whole.orderBy(first, "route_pos")), "fastest_s": fastest,
    }).withColumns({"time_kind": kind, "shown_minutes": shown})
