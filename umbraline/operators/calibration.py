"""Fixed-point field observations against the threshold plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up
from ..functions.geo import MEAN_RADIUS_M, haversine_m


@dataclass(frozen=True)
class Plan:
    """Pre-registered thresholds; a fixed-size record."""

    protocol_version: str
    model_version: str
    data_pack_version: str
    fingerprints: dict[str, str]
    site_types: list[str]
    # (name, first hour, hour after the last)
    bands: list[tuple[str, int, int]] = field(default_factory=lambda: [("morning", 8, 11), ("solar-noon", 11, 15), ("late-afternoon", 15, 19)])
    min_points: int = 6
    min_per_band: int = 6
    max_gps_m: float = 20
    max_spread_m: float = 25
    min_total: int = 36
    min_agreement: float = 80
    min_area_agreement: float = 75
    max_unclassified: float = 10

    @property
    def areas(self) -> list[str]:
        return list(self.fingerprints)


def percent3(part: Column, whole: Column) -> Column:
    """Percentage to three decimals; null for an empty whole."""
    return F.when(whole > 0, half_up(part / whole * 100, 3))


def mark_observations(observations: DataFrame, plan: Plan) -> DataFrame:
    """Add the time band and the first reason for exclusion (null when eligible)."""
    fingerprint = F.lit(None).cast("string")
    for area, value in plan.fingerprints.items():
        fingerprint = F.when(F.col("area") == area, value).otherwise(fingerprint)
    same = lambda name, value: F.coalesce(F.col(name) == value, F.lit(False))
    identity = (
        same("protocol_version", F.lit(plan.protocol_version)) & same("model_version", F.lit(plan.model_version))
        & same("data_pack_version", F.lit(plan.data_pack_version)) & same("data_pack_fingerprint", fingerprint))
    band = F.lit(None).cast("string")
    for name, start, end in plan.bands:
        band = F.when((F.col("local_hour") >= start) & (F.col("local_hour") < end), name).otherwise(band)
    coarse = (F.col("coordinate_source") == "one-shot-gps") & (F.col("gps_accuracy_m") > plan.max_gps_m)
    marked = observations.withColumn("band", band)
    return marked.withColumn("exclusion", (
        F.when(~identity, "release-mismatch").when(F.col("weather") != "clear-direct-sun", "not-clear-sun")
        .when(F.coalesce(coarse, F.lit(False)), "gps-too-coarse").when(F.col("band").isNull(), "outside-bands")))


def contradictory_points(marked: DataFrame) -> DataFrame:
    """Points given two site types among rows of the right release; any such row voids the analysis."""
    return marked.filter(F.coalesce(F.col("exclusion") != "release-mismatch", F.lit(True))).groupBy("area", "point_id").agg(
        F.min("site_type").alias("_a"), F.max("site_type").alias("_b")).filter(F.col("_a") != F.col("_b")).select("area", "point_id")


def exclusion_counts(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("exclusion").isNotNull()).groupBy("exclusion").agg(F.count(F.lit(1)).alias("observations"))


def convex_outline(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Positions of the corners of the convex outline, counter-clockwise (degrees, one small neighbourhood).

    Coordinates are projected from the sphere's centre onto the plane at the
    first of them, where great circles are straight and circles stay convex: the
    farthest pair of all coordinates is a pair of corners.
    """
    la, lo = np.radians(lat), np.radians(lon - lon[0])
    near = np.sin(la[0]) * np.sin(la) + np.cos(la[0]) * np.cos(la) * np.cos(lo)
    # As sums of small terms: nothing cancels.
    x = np.cos(la) * np.sin(lo) / near
    y = (np.sin(la - la[0]) + 2 * np.cos(la) * np.sin(la[0]) * np.sin(lo / 2) ** 2) / near
    order = np.lexsort((y, x))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    order = order[first]
    if len(order) < 3:
        return order

    def chain(points):
        kept: list[int] = []
        for i in points:
            while len(kept) > 1:
                a, b = kept[-2], kept[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                    break
                kept.pop()
            kept.append(i)
        return kept[:-1]

    return np.array(chain(order) + chain(order[::-1]))


def outline_width_m(lat: np.ndarray, lon: np.ndarray) -> float:
    """Largest distance between corners of a convex outline, by opposite corners: one turn around it."""
    h = len(lat)
    la, lo = np.radians(lat), np.radians(lon)

    def apart(i, j):
        a = np.sin((la[j] - la[i]) / 2) ** 2 + np.cos(la[i]) * np.cos(la[j]) * np.sin((lo[j] - lo[i]) / 2) ** 2
        return 2 * MEAN_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))

    if h < 4:
        return max((float(apart(i, j)) for i in range(h) for j in range(i)), default=0.0)
    x, y = (lo - lo[0]) * np.cos(la[0]), la - la[0]
    area = lambda a, b, c: (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
    best, j = 0.0, 1
    for i in range(h):
        k = (i + 1) % h
        while area(i, k, (j + 1) % h) > area(i, k, j):
            j = (j + 1) % h
            best = max(best, float(apart(i, j)), float(apart(k, j)))
        # The next corner too: equally far ones of parallel sides.
        for other in (j, (j + 1) % h):
            best = max(best, float(apart(i, other)), float(apart(k, other)))
    return best


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Corners per point and batch, before any shuffle."""
    for batch in batches:
        parts = [part.iloc[convex_outline(part["lat"].to_numpy(), part["lon"].to_numpy())] for _, part in batch.groupby(["area", "point_id"], sort=False)]
        if parts:
            yield pd.concat(parts)


def _widest_over(limit_m: float):
    """Verdict per point from rows sorted by point; only the outline so far is held."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lat, lon = None, np.empty(0), np.empty(0)
        for batch in batches:
            out = []
            for now, part in batch.groupby(["area", "point_id"], sort=False):
                if now != key:
                    if key is not None:
                        out.append((*key, outline_width_m(lat, lon) > limit_m))
                    key, lat, lon = now, np.empty(0), np.empty(0)
                lat, lon = np.append(lat, part["lat"].to_numpy()), np.append(lon, part["lon"].to_numpy())
                corners = convex_outline(lat, lon)
                lat, lon = lat[corners], lon[corners]
            if out:
                yield pd.DataFrame(out, columns=["area", "point_id", "spread_over"])
        if key is not None:
            yield pd.DataFrame([(*key, outline_width_m(lat, lon) > limit_m)], columns=["area", "point_id", "spread_over"])

    return check


def wide_points(eligible: DataFrame, limit_m: float) -> DataFrame:
    """(area, point_id, spread_over): whether repeats of a point lie farther apart than the limit.

    Extents settle most points.  For the rest only the two latitude extremes per
    longitude can be farthest apart, and of those only corners of the convex
    outline.  Outlines merge: each task reduces its batches to corners, these are
    shuffled and sorted by point, and one pass keeps the outline so far, so
    memory follows the corners and not the coordinates, however fine they are.
    """
    ends = eligible.groupBy("area", "point_id", "lon").agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))
    box = ends.groupBy("area", "point_id").agg(
        F.min("lat0").alias("s"), F.max("lat1").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    near = F.when((F.col("s") <= 0) & (F.col("n") >= 0), 0.0).otherwise(F.least(F.abs("s"), F.abs("n")))
    far = F.greatest(F.abs("s"), F.abs("n"))
    up = haversine_m("s", "w", "n", "w", MEAN_RADIUS_M)
    across = lambda at: haversine_m(at, "w", at, "e", MEAN_RADIUS_M)
    longest = F.sqrt(up * up + across(near) * across(near)) * 1.000001
    box = box.withColumn("verdict", F.when(longest <= limit_m, False).when((up > limit_m) | (across(far) > limit_m), True))
    settled = box.filter(F.col("verdict").isNotNull()).select("area", "point_id", F.col("verdict").alias("spread_over"))
    corners = F.when(F.col("lat0") == F.col("lat1"), F.array("lat0")).otherwise(F.array("lat0", "lat1"))
    open_ = ends.join(box.filter(F.col("verdict").isNull()).select("area", "point_id"), ["area", "point_id"], "left_semi")
    open_ = open_.select("area", "point_id", "lon", F.explode(corners).alias("lat"))
    fields = {f.name: f.dataType.simpleString() for f in eligible.schema.fields}
    corners = open_.mapInPandas(_outlines, f"area {fields['area']}, point_id {fields['point_id']}, lon double, lat double")
    checked = corners.repartition("area", "point_id").sortWithinPartitions("area", "point_id").mapInPandas(
        _widest_over(limit_m), f"area {fields['area']}, point_id {fields['point_id']}, spread_over boolean")
    return settled.unionByName(checked)


def calibration_points(marked: DataFrame, plan: Plan) -> DataFrame:
    """One row per planned point with eligible observations."""
    eligible = marked.filter(F.col("exclusion").isNull())
    has = lambda name: F.max(F.when(F.col("band") == name, 1).otherwise(0)) == 1
    complete = F.lit(True)
    for name, _, _ in plan.bands:
        complete = complete & has(name)
    points = eligible.groupBy("area", "point_id").agg(
        F.max("site_type").alias("site_type"), F.count(F.lit(1)).alias("observations"), complete.alias("complete"))
    wide = wide_points(eligible.select("area", "point_id", "lat", "lon"), plan.max_spread_m)
    return points.join(wide, ["area", "point_id"])


def calibration_by_area(marked: DataFrame, plan: Plan) -> DataFrame:
    """Counts and rates per required area; areas without observations included."""
    eligible = marked.filter(F.col("exclusion").isNull())
    classed = F.col("predicted").isin("sun", "shade")
    n = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")
    counts = eligible.groupBy("area").agg(
        F.count(F.lit(1)).alias("eligible"), n(classed).alias("classifiable"), n(classed & (F.col("predicted") == F.col("observed"))).alias("matching"),
        n(~classed).alias("unclassified"),
        *[n(F.col("band") == name).alias(f"band_{name.replace('-', '_')}") for name, _, _ in plan.bands])
    spark = marked.sparkSession
    wanted = spark.createDataFrame([(i, a) for i, a in enumerate(plan.areas)], "area_pos int, area string")
    full = wanted.join(counts, "area", "left").fillna(0)
    return full.withColumns({
        "agreement_percent": percent3(F.col("matching"), F.col("classifiable")),
        "unclassified_percent": percent3(F.col("unclassified"), F.col("eligible"))})


def calibration_gate(marked: DataFrame, plan: Plan) -> DataFrame:
    """One row: status, ordered failure codes, totals.  Performance gates apply only once coverage is met.

    A point with two site types voids the result (status 'invalid').  The claim
    of model accuracy is never granted by this gate.
    """
    points = calibration_points(marked, plan)
    has_type = lambda extra=None: F.collect_set(F.when(extra, F.col("site_type")) if extra is not None else F.col("site_type"))
    per_area = points.groupBy("area").agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.col("complete").cast("int")).alias("complete_points"),
        F.sum(F.col("spread_over").cast("int")).alias("wide"), has_type().alias("types"), has_type(F.col("complete")).alias("complete_types"))
    areas = calibration_by_area(marked, plan).join(per_area, "area", "left").fillna(0, ["points", "complete_points", "wide"])
    code = lambda bad, name: F.when(bad, F.concat(F.col("area"), F.lit(f":{name}")))
    held = lambda name, value: F.coalesce(F.array_contains(name, value), F.lit(False))
    coverage = [
        code(F.col("points") < plan.min_points, "minimum-unique-points"),
        code(F.col("complete_points") < plan.min_points, "repeat-each-point-in-every-time-band"),
        code(F.col("wide") > 0, "point-repeat-distance"),
        *[F.coalesce(code(~held("types", t), f"missing-site-type:{t}"),
                     code(~held("complete_types", t), f"site-type-not-repeated-in-every-time-band:{t}")) for t in plan.site_types],
        *[code(F.col(f"band_{n.replace('-', '_')}") < plan.min_per_band, f"minimum-time-band:{n}") for n, _, _ in plan.bands]]
    low = code(F.col("agreement_percent").isNull() | (F.col("agreement_percent") < plan.min_area_agreement), "minimum-classification-agreement")
    areas = areas.withColumns({"coverage_codes": F.array(*coverage), "low_code": low})
    total = areas.groupBy().agg(
        *[F.sum(c).alias(c) for c in ("eligible", "classifiable", "matching", "unclassified")],
        # As many entries as the plan has areas.
        F.array_sort(F.collect_list(F.struct("area_pos", "coverage_codes", "low_code"))).alias("_areas"))
    # One row each: overall count and contradictions, brought in as further aggregates of one row.
    seen = marked.groupBy().agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.lit(0))
    broken = contradictory_points(marked).groupBy().agg(F.count(F.lit(1)).alias("contradictions")).withColumn("k", F.lit(0))
    total = total.withColumn("k", F.lit(0)).unionByName(seen, True).unionByName(broken, True)
    total = total.groupBy("k").agg(*[F.max(c).alias(c) for c in ("eligible", "classifiable", "matching", "unclassified", "total", "contradictions")],
                                   F.first("_areas", ignorenulls=True).alias("_areas"))
    tidy = lambda a: F.filter(a, lambda c: c.isNotNull())
    cover = tidy(F.concat(
        F.array(F.when(F.col("eligible") < plan.min_total, "minimum-total-eligible-observations")),
        F.flatten(F.transform("_areas", lambda a: a["coverage_codes"]))))
    total = total.withColumns({
        "agreement_percent": percent3(F.col("matching"), F.col("classifiable")),
        "unclassified_percent": percent3(F.col("unclassified"), F.col("eligible")), "_cover": cover})
    perform = tidy(F.concat(
        F.array(F.when(F.col("agreement_percent").isNull() | (F.col("agreement_percent") < plan.min_agreement), "minimum-overall-classification-agreement")),
        F.transform("_areas", lambda a: a["low_code"]),
        F.array(F.when(F.col("unclassified_percent").isNull() | (F.col("unclassified_percent") > plan.max_unclassified), "maximum-unclassified-prediction-rate"))))
    gap = F.size("_cover") > 0
    total = total.withColumn("failures", F.when(gap, F.col("_cover")).otherwise(perform))
    met = F.when((F.col("eligible") > 0) & ~gap, F.size("failures") == 0)
    return total.withColumn("gate_met", met).select(
        (F.when(F.col("contradictions") > 0, "invalid").when(F.col("total") == 0, "no-observations").when(gap, "insufficient-evidence")
         .when(F.col("gate_met"), "fixed-point-thresholds-met").otherwise("thresholds-not-met")).alias("status"),
        "gate_met", F.lit(False).alias("can_claim_accuracy"), "total", "eligible", "classifiable", "matching", "unclassified",
        "agreement_percent", "unclassified_percent", "failures")
