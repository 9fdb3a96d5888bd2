"""Elevation packs: binary planes, source pixels, tiled cell tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import check_pixel_alignment

PLANES = {"height_steps": "heights", "validity": "validityFile", "terrain": "terrainFile",
          "surf_min": "minimumSurfaceFile", "surf_max": "maximumSurfaceFile"}
META = """id string, width int, height int, bboxBng array<double>, resolutionMetres double, heightStepMetres double,
  validityFile string, terrainFile string, minimumSurfaceFile string, maximumSurfaceFile string, maximumSurfaceElevationMetres double"""
TILE_CELLS = 256


def _fail_unless(ok: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))


def read_grid_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Grid table from metadata JSON files; a partial set of elevation planes is an error."""
    raw = spark.read.schema(META).option("multiLine", True).json(path)
    named = sum((F.col(c).isNotNull().cast("int") for c in ("terrainFile", "minimumSurfaceFile", "maximumSurfaceFile")), F.lit(0))
    whole = raw.filter(_fail_unless(named.isin(0, 3), F.concat(F.lit("partial elevation planes in "), "id")))
    return whole.select(
        F.col("id").alias("area_id"), "width", "height", F.get("bboxBng", F.lit(0)).alias("west"), F.get("bboxBng", F.lit(3)).alias("north"),
        F.col("resolutionMetres").alias("res_m"), F.col("heightStepMetres").alias("step_m"), F.col("maximumSurfaceElevationMetres").alias("max_surface_m"),
        "validityFile", "terrainFile", "minimumSurfaceFile", "maximumSurfaceFile")


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One plane file to one row per cell; little-endian floats or bytes."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            kind = "<f4" if row.plane in ("terrain", "surf_min", "surf_max") else "u1"
            values = np.frombuffer(row.content, dtype=kind).astype("float64")
            yield pd.DataFrame({"area_id": row.area_id, "plane": row.plane, "cell_no": np.arange(len(values), dtype="int64"),
                                "width": np.int32(row.width), "value": values})


def read_cell_planes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cells, grids) from a folder of `<area>-heights.json` files and their planes.

    A missing plane, or one whose length differs from width x height, fails the
    job.  Each plane file is unpacked by its own task.
    """
    grids = read_grid_metadata(spark, f"{folder}/*-heights.json")
    files = {"heights": F.concat("area_id", F.lit("-heights.bin"))}
    wanted = grids.select("area_id", "width", "height", F.explode(F.map_from_arrays(
        F.array(*[F.lit(p) for p in PLANES]), F.array(*[files.get(c, F.col(c)) if c in files else F.col(c) for c in PLANES.values()]))).alias("plane", "file"))
    wanted = wanted.filter(F.col("file").isNotNull())
    stored = spark.read.format("binaryFile").load(f"{folder}/*.bin").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content")
    joined = wanted.join(stored, "file", "left")
    size = F.when(F.col("plane").isin("terrain", "surf_min", "surf_max"), 4).otherwise(1)
    sound = F.coalesce(F.col("length") == F.col("width").cast("bigint") * F.col("height") * size, F.lit(False))
    joined = joined.filter(_fail_unless(sound, F.concat(F.lit("incomplete plane "), "file")))
    flat = joined.select("area_id", "plane", "width", "content").mapInPandas(_unpack, "area_id string, plane string, cell_no bigint, width int, value double")
    pick = lambda p: F.max(F.when(F.col("plane") == p, F.col("value")))
    cells = flat.groupBy("area_id", "cell_no", "width").agg(
        pick("height_steps").cast("smallint").alias("height_steps"), F.coalesce(pick("validity"), F.lit(255.0)).cast("smallint").alias("validity"),
        *[pick(p).cast("float").alias(p) for p in ("terrain", "surf_min", "surf_max")])
    cells = cells.withColumns({"x": (F.col("cell_no") % F.col("width")).cast("int"), "y": F.floor(F.col("cell_no") / F.col("width")).cast("int")}).drop("width")
    return cells, grids


def read_pixels(spark: SparkSession, dsm_path: str, dtm_path: str) -> DataFrame:
    """Surface and terrain rasters (area_id, px, py, value, nodata) as one aligned pixel table."""
    dsm = spark.read.parquet(dsm_path).select("area_id", "px", "py", F.col("value").alias("dsm"), F.col("nodata").alias("nodata_dsm"), F.lit(True).alias("has_dsm"))
    dtm = spark.read.parquet(dtm_path).select("area_id", "px", "py", F.col("value").alias("dtm"), F.col("nodata").alias("nodata_dtm"), F.lit(True).alias("has_dtm"))
    return check_pixel_alignment(dsm, dtm).drop("has_dsm", "has_dtm")


def with_tile(cells: DataFrame, side: int = TILE_CELLS) -> DataFrame:
    """Square tile number ``tile`` of each cell, so a reader can prune by area and tile."""
    return cells.withColumn("tile", F.concat(F.floor(F.col("x") / side).cast("string"), F.lit("_"), F.floor(F.col("y") / side).cast("string")))


def write_cells(cells: DataFrame, summary: DataFrame, folder: str, side: int = TILE_CELLS) -> None:
    """Tiled parquet pack plus its coverage table.  Tiles are one partition each, bounded by side x side cells."""
    with_tile(cells, side).repartition("area_id", "tile").write.mode("overwrite").partitionBy("area_id", "tile").parquet(f"{folder}/cells")
    summary.write.mode("overwrite").parquet(f"{folder}/grids")


def read_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/cells"), spark.read.parquet(f"{folder}/grids")


def canonical_manifest_id(files: DataFrame, version: str) -> DataFrame:
    """SHA-256 over area, version and every (path, bytes, hash) in path order, per area."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    entry = F.concat(F.lit("["), quoted(F.col("path")), F.lit(","), F.col("bytes").cast("string"), F.lit(","), quoted(F.col("sha256")), F.lit("]"))
    listed = files.groupBy("area_id").agg(F.array_sort(F.collect_list(F.struct("path", entry.alias("entry")))).alias("_f"))
    body = F.concat(F.lit("["), quoted(F.col("area_id").cast("string")), F.lit(","), quoted(F.lit(version)), F.lit(",["),
                    F.array_join(F.transform("_f", lambda f: f["entry"]), ","), F.lit("]]"))
    return listed.select("area_id", F.concat(F.lit("sha256-"), F.sha2(body, 256)).alias("manifest_id"))


def audit_pack_integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare stored files (binaryFile rows with a relative ``path``) with the manifest; one row per difference."""
    found = files.select("path", F.length("content").cast("bigint").alias("found_bytes"), F.sha2("content", 256).alias("found_sha256"))
    j = manifest.select("path", "bytes", "sha256").join(found, "path", "full_outer")
    verdict = (F.when(F.col("found_bytes").isNull(), "missing").when(F.col("bytes").isNull(), "unexpected").when(F.col("found_bytes") < 1, "empty")
               .when(F.col("bytes") != F.col("found_bytes"), "length").when(F.col("sha256") != F.col("found_sha256"), "content"))
    return j.withColumn("verdict", verdict).filter(F.col("verdict").isNotNull()).select("path", "verdict")
