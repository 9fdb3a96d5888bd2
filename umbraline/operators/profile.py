"""Exposure along a route: runs, totals, full coverage, timelines.

All windows here run inside one route and journey, which validation bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.basics import clamp, is_finite
from ..functions.lookups import EXPOSURES

# Fixed values.
SLIVER_M, TOUCH_M = 0.01, 0.1


def known_exposure(value: str) -> Column:
    return F.when(F.col(value).isin(*EXPOSURES), F.col(value)).otherwise("unknown")


def exposure_runs(sections: DataFrame, keys: list[str], order: str = "sample_idx", length: str = "length_m",
                  supplied: str | None = None) -> DataFrame:
    """Merge neighbours of equal exposure into runs with start, end and percent.

    The denominator is the larger of the measured and the supplied distance; a
    shortfall over a centimetre becomes a trailing unknown run.
    """
    whole = W.partitionBy(*keys)
    line = whole.orderBy(order)
    measured = F.sum(length).over(whole)
    given = F.when(is_finite(supplied) & (F.col(supplied) > 0), F.col(supplied).cast("double")) if supplied else F.lit(None).cast("double")
    rows = sections.select(
        *keys, order, known_exposure("exposure").alias("exposure"), F.col(length).cast("double").alias("length_m"),
        F.greatest(measured, F.coalesce(given, measured)).cast("double").alias("denominator_m"),
        (F.greatest(measured, F.coalesce(given, measured)) - measured).alias("_short"),
        F.lead(order).over(line).isNull().alias("_last"))
    here = F.struct("exposure", "length_m", F.lit(0).alias("tail"))
    tail = F.struct(F.lit("unknown").alias("exposure"), F.col("_short").cast("double").alias("length_m"), F.lit(1).alias("tail"))
    rows = rows.withColumn("p", F.explode(F.when(F.col("_last") & (F.col("_short") > SLIVER_M), F.array(here, tail)).otherwise(F.array(here))))
    rows = rows.select(*keys, order, "denominator_m", "p.*")
    line = whole.orderBy(order, "tail")
    changed = F.coalesce(F.lag("exposure").over(line) != F.col("exposure"), F.lit(True)).cast("int")
    numbered = rows.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(line) - 1)
    runs = numbered.groupBy(*keys, "run", "exposure", "denominator_m").agg(F.sum("length_m").alias("length_m"))
    before = whole.orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("start_m", F.coalesce(F.sum("length_m").over(before), F.lit(0.0)))
    return runs.withColumns({
        "end_m": F.col("start_m") + F.col("length_m"),
        "percent": F.when(F.col("denominator_m") > 0, F.col("length_m") / F.col("denominator_m") * 100).otherwise(0.0)})


def exposure_totals(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Metres and percent per exposure; all five states present."""
    metres = lambda e: F.sum(F.when(F.col("exposure") == e, F.col("length_m")).otherwise(0.0))
    out = runs.groupBy(*keys).agg(F.max("denominator_m").alias("denominator_m"), *[metres(e).alias(f"{e}_m") for e in EXPOSURES])
    share = lambda e: F.when(F.col("denominator_m") > 0, F.col(f"{e}_m") / F.col("denominator_m") * 100).otherwise(0.0)
    return out.withColumns({f"{e}_percent": share(e) for e in EXPOSURES})


def complete_coverage(spans: DataFrame, keys: list[str], route_m: str = "route_m") -> DataFrame:
    """Spans made gapless over [0, route_m]: overlaps cut, gaps filled as unknown, touching equals merged.

    The cut position moves only past a usable piece, so this is a fold over the
    spans of one route in start order.
    """
    length = F.greatest(F.lit(0.0), F.coalesce(F.col(route_m).cast("double"), F.lit(0.0)))
    piece = lambda e, a, b: F.struct(e.alias("exposure"), a.alias("start_m"), b.alias("end_m"))
    packed = spans.withColumn("_length", length).groupBy(*keys, "_length").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start_m").cast("double").alias("start_m"), F.col("end_m").cast("double").alias("end_m"),
        known_exposure("exposure").alias("exposure")))).alias("spans"))

    def take(state: Column, span: Column) -> Column:
        start = clamp(span["start_m"], state["cursor"], F.col("_length"))
        end = clamp(span["end_m"], start, F.col("_length"))
        gap = F.filter(F.array(piece(F.lit("unknown"), state["cursor"], start)), lambda p: p["end_m"] > p["start_m"] + SLIVER_M)
        kept = F.filter(F.array(piece(span["exposure"], start, end)), lambda p: p["end_m"] > p["start_m"] + SLIVER_M)
        return F.struct(
            F.when(end > start + SLIVER_M, end).otherwise(state["cursor"]).alias("cursor"),
            F.when(state["cursor"] >= F.col("_length"), state["out"]).otherwise(F.concat(state["out"], gap, kept)).alias("out"))

    empty = F.array().cast("array<struct<exposure:string,start_m:double,end_m:double>>")
    packed = packed.withColumn("_s", F.aggregate(
        "spans", F.struct(F.lit(0.0).alias("cursor"), empty.alias("out")), take))
    rest = F.filter(F.array(piece(F.lit("unknown"), F.col("_s.cursor"), F.col("_length"))), lambda p: p["end_m"] > p["start_m"] + SLIVER_M)
    flat = packed.select(*keys, F.posexplode(F.concat("_s.out", rest)).alias("_pos", "_p")).select(*keys, "_pos", "_p.*")
    line = W.partitionBy(*keys).orderBy("_pos")
    joined = (F.lag("exposure").over(line) == F.col("exposure")) & (F.abs(F.lag("end_m").over(line) - F.col("start_m")) <= TOUCH_M)
    numbered = flat.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("span_no", F.sum("_new").over(line) - 1)
    return numbered.groupBy(*keys, "span_no", "exposure").agg(F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"))


def spans_from_runs(runs: DataFrame, keys: list[str], route_m: str = "route_m") -> DataFrame:
    """Runs rescaled to the reported route length."""
    measured = F.max("end_m").over(W.partitionBy(*keys))
    scale = F.when(measured > 0, F.col(route_m) / measured).otherwise(1.0)
    return runs.withColumn("_scale", scale).withColumns({
        "start_m": F.col("start_m") * F.col("_scale"), "end_m": F.col("end_m") * F.col("_scale")}).drop("_scale")


def longest_sun_run(sections: DataFrame, keys: list[str], order: str = "sample_idx", length: str = "length_m") -> DataFrame:
    """Longest uninterrupted stretch of definite sun, in metres (0 when there is none)."""
    line = W.partitionBy(*keys).orderBy(order)
    sunny = F.col("exposure") == "sun"
    breaks = sections.withColumn("_block", F.sum(F.when(sunny, 0).otherwise(1)).over(line))
    stretch = breaks.groupBy(*keys, "_block").agg(F.sum(F.when(sunny, F.col(length)).otherwise(0.0)).alias("_m"))
    return stretch.groupBy(*keys).agg(F.max("_m").alias("longest_sun_m"))


def shift_timeline(journeys: DataFrame, route: str = "route_id", journey: str = "journey") -> DataFrame:
    """Flag the daylight journey with most sun; the earliest wins a tie."""
    rank = F.struct(F.col("sun_s"), (-F.col(journey)).alias("early"))
    top = F.max(F.when(F.col("is_daylight"), rank)).over(W.partitionBy(route))
    return journeys.withColumn("_top", top).withColumn(
        "highest_sun", F.coalesce(F.col("is_daylight") & (-F.col("_top.early") == F.col(journey)), F.lit(False))).drop("_top")


def journey_departure(base: Column, index: Column, repeat_min: Column, inverse: bool = False) -> Column:
    """Departure of the index-th journey of a schedule, or the schedule's base from it."""
    offset = F.greatest(F.lit(0), F.floor(F.coalesce(index, F.lit(0)))) * F.greatest(F.lit(0), F.coalesce(repeat_min, F.lit(0))) * 60_000
    return base - offset if inverse else base + offset
