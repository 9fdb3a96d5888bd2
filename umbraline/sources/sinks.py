"""Writers: spreadsheet-safe CSV, GeoJSON lines, evidence records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.civil import local_from_instant
from ..functions.lookups import EXPOSURES, reported_state
from ..functions.text import spreadsheet_safe


def safe_columns(df: DataFrame, leading_space: bool = True) -> DataFrame:
    """Guard every text column against being read as a formula."""
    return df.withColumns({c: spreadsheet_safe(c, leading_space) for c, t in df.dtypes if t == "string"})


def write_safe_csv(df: DataFrame, path: str, columns: list[str] | None = None, quote_all: bool = False, leading_space: bool = True) -> None:
    ordered = df.select(*(columns or df.columns))
    (safe_columns(ordered, leading_space).write.mode("overwrite").option("header", True).option("quoteAll", quote_all)
     .option("escape", '"').option("emptyValue", "").csv(path))


def feedback_export(feedback: DataFrame) -> DataFrame:
    """Feedback in its export columns: reported state, local times, outcome note."""
    note = F.when(F.col("outcome") == "blocked-or-inaccessible", "Route blocked or inaccessible.").when(F.col("outcome") == "other", "Other field outcome.")
    return feedback.select(
        F.col("id").alias("report_id"), "pilot_area", F.col("location.latitude").alias("model_section_latitude"), F.col("location.longitude").alias("model_section_longitude"),
        "pavement_side", local_from_instant("submitted_at").alias("report_saved_london_datetime"), "weather_visibility",
        reported_state("outcome", "predicted_state").alias("reported_state"), F.col("predicted_state").alias("modelled_state"), F.col("seen_first").alias("estimate_seen_before_report"),
        "temporary_conditions", "leaf_state", F.concat_ws(" ", note, F.col("note")).alias("observer_notes"), "route_id", "route_name", "segment_id", "segment_label",
        local_from_instant("predicted_at").alias("modelled_london_datetime"), F.col("include_location").alias("include_model_section_location"),
        F.col("location.accuracyMetres").alias("model_section_accuracy_metres"))


def feature_json(geometry_type: str | Column, coordinates: Column, **properties: Column) -> Column:
    """One GeoJSON Feature as text."""
    kind = F.lit(geometry_type) if isinstance(geometry_type, str) else geometry_type
    props = F.struct(*[v.alias(k) for k, v in properties.items()]) if properties else F.expr("named_struct()")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"),
                              F.struct(kind.alias("type"), coordinates.alias("coordinates")).alias("geometry")), {"ignoreNullFields": "false"})


def section_features(sections: DataFrame) -> DataFrame:
    """Scored sections as line features; an unrecognised exposure is unknown."""
    state = F.when(F.col("exposure").isin(*EXPOSURES), F.col("exposure")).otherwise("unknown")
    line = F.array(F.array("x_start", "y_start"), F.array("x_end", "y_end"))
    return sections.select(feature_json("LineString", line, exposure=state, routeId=F.col("route_id"), routeSegmentIndex=F.col("seg_idx")).alias("value"))


def route_features(routes: DataFrame) -> DataFrame:
    line = F.transform("coordinates", lambda p: F.array(p["lon"], p["lat"]))
    return routes.select(feature_json("LineString", line, routeId=F.col("route_id")).alias("value"))


def map_features(features: DataFrame) -> DataFrame:
    """Map features with kind, class and name: lines, polygons with their holes, and several polygons as one.

    ``features``: geometry, polygons (polygon, ring, point) and line, as ``operators.rings.map_features`` gives them;
    a ``height_m`` column, where there is one, goes along.
    """
    spot = lambda p: F.array(p["lon"], p["lat"])
    drawn = F.transform("polygons", lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, spot)))
    own = {"kind": F.col("kind"), "class": F.col("class"), "name": F.col("name")} | ({"heightMetres": F.col("height_m")} if "height_m" in features.columns else {})
    several = feature_json("MultiPolygon", drawn, **own)
    one = feature_json("Polygon", F.get(drawn, F.lit(0)), **own)
    plain = feature_json("LineString", F.transform("line", spot), **own)
    return features.select(F.when(F.col("geometry") == "MultiPolygon", several).when(F.col("geometry") == "Polygon", one).otherwise(plain).alias("value"))


def write_geojson(lines: DataFrame, path: str) -> None:
    """One Feature per line."""
    lines.select("value").write.mode("overwrite").text(path)


def write_evidence(records: DataFrame, path: str) -> None:
    records.select("record.*").write.mode("overwrite").option("ignoreNullFields", "false").json(path)
