"""From source pixels to model cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up, is_finite

# Fixed values.
FACTOR, STEP_M, LOWEST_M = 4, 0.5, -1_000.0


def usable_elevation(value: str, nodata: str) -> Column:
    return is_finite(value) & (F.col(value) > LOWEST_M) & F.coalesce(F.col(value) != F.col(nodata), F.lit(True))


def downsample_cells(pixels: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Group pixel pairs (dsm, dtm) into cells; all sums and extremes combine before the shuffle."""
    ok = usable_elevation("dsm", "nodata_dsm") & usable_elevation("dtm", "nodata_dtm")
    keep = lambda name: F.when(ok, F.col(name))
    grouped = pixels.groupBy(
        "area_id", F.floor(F.col("px") / factor).cast("int").alias("x"), F.floor(F.col("py") / factor).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("pixels"), F.sum(ok.cast("int")).alias("valid_pixels"),
        F.min(keep("dtm")).alias("dtm_min"), F.max(keep("dtm")).alias("dtm_max"),
        F.min(keep("dsm")).alias("surf_min"), F.max(keep("dsm")).alias("surf_max"),
        F.greatest(F.lit(0.0), F.max(F.when(ok, F.col("dsm") - F.col("dtm")))).alias("_above"))
    raw_steps = half_up(F.col("_above") / STEP_M)
    return grouped.select(
        "area_id", "x", "y", "pixels", "valid_pixels",
        ((F.col("dtm_min") + F.col("dtm_max")) / 2).alias("terrain"), "dtm_min", "dtm_max", "surf_min", "surf_max",
        F.least(F.lit(255), raw_steps).cast("smallint").alias("height_steps"), (raw_steps > 255).alias("clipped"),
        half_up(F.col("valid_pixels") / F.col("pixels") * 255).cast("smallint").alias("validity"))


def grid_summary(cells: DataFrame) -> DataFrame:
    """Coverage and extremes per area."""
    percent = lambda condition: half_up(F.sum(condition.cast("int")) / F.count(F.lit(1)) * 1000) / 10
    return cells.groupBy("area_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"),
        percent(F.col("valid_pixels") == F.col("pixels")).alias("coverage_percent"),
        percent(F.col("valid_pixels") > 0).alias("any_coverage_percent"),
        F.sum(F.col("clipped").cast("int")).alias("clipped_cells"),
        F.min("dtm_min").alias("terrain_min"), F.max("dtm_max").alias("terrain_max"),
        F.min("surf_min").alias("surface_min"), F.max("surf_max").alias("surface_max"))


def check_pixel_alignment(dsm: DataFrame, dtm: DataFrame) -> DataFrame:
    """Join the two rasters pixel by pixel; the job fails if either has a pixel the other lacks."""
    joined = dsm.join(dtm, ["area_id", "px", "py"], "full_outer")
    aligned = F.col("has_dsm").isNotNull() & F.col("has_dtm").isNotNull()
    return joined.filter(F.when(aligned, True).otherwise(F.raise_error(F.lit("surface and terrain rasters differ in extent")).cast("boolean")))
