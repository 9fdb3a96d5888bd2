"""JSON and CSV inputs of routes, maps, feeds, field work and saved journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basics import between, half_up, holds
from ..functions.civil import instant_from_iso, is_iso_date
from ..functions.geo import with_lon_lat
from ..functions.lookups import WEATHER, weather_condition
from ..functions.text import bounded_text, kind_title, opaque_id, provider_text, trimmed_text
from ..operators.calibration import Plan

MAX_FIELD = 2_000
AFTER_LIFTS = 1 << 20  # disruptions follow all lifts in payload order
# Column order of the CSV formats.
TREE_COLUMNS = ["borough", "lat", "lon", "uniqueid", "taxon_species", "common_name", "taxon_genus", "common_genus", "gla_name", "taxon_family",
                "maintainer", "location", "climate_suitability", "cs_confidence", "age_cat", "canopy_m", "height_m", "girth_dbh"]
OBSERVATION_COLUMNS = ["schema", "schema_version", "protocol_version", "model_version", "data_pack_version", "data_pack_fingerprint", "observation_id",
                       "pilot_area", "planned_point_id", "site_type", "latitude", "longitude", "coordinate_source", "gps_accuracy_metres", "pavement_side",
                       "observed_london_datetime", "weather_visibility", "observed_state", "predicted_state", "predicted_before_observation",
                       "temporary_conditions", "leaf_state", "observer_notes"]
WALK_COLUMNS = ["schema", "schema_version", "comparison_id", "pilot_area", "comparison_london_datetime", "model_version", "route_id", "walk_complete",
                "prediction_frozen_before_walk", "weather_visibility", "predicted_duration_minutes", "predicted_direct_sun_minutes", "predicted_shade_minutes",
                "predicted_unknown_minutes", "observed_duration_minutes", "observed_direct_sun_minutes", "observed_shade_minutes", "observed_unknown_minutes",
                "predicted_order", "observed_order"]

TRIP = "struct<summary:struct<length:double,time:double>,legs:array<struct<shape:string,maneuvers:array<struct<" \
       "type:int,instruction:string,verbal_succinct_transition_instruction:string,bearing_after:double,time:double,length:double," \
       "begin_shape_index:bigint,end_shape_index:bigint,rough:boolean,travel_type:string>>>>>"


def leading(items: Column | str, limit: int | None) -> Column:
    """The whole array, or its first `limit` items where the caller sets one."""
    return F.col(items) if isinstance(items, str) and limit is None else items if limit is None else F.slice(items, 1, limit)


def read_route_responses(spark: SparkSession, path: str, max_alternates: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(trips, manoeuvres) of router responses: the primary trip and its alternates."""
    raw = spark.read.schema(f"trip {TRIP}, alternates array<struct<trip:{TRIP}>>").option("multiLine", True).json(path)
    raw = raw.withColumn("response", F.input_file_name())
    spare = F.transform(leading(F.coalesce("alternates", F.expr(f"CAST(array() AS array<struct<trip:{TRIP}>>)")), max_alternates), lambda a: a["trip"])
    trips = raw.select("response", F.posexplode(F.concat(F.array("trip"), spare)).alias("route_pos", "trip")).filter(F.col("trip").isNotNull())
    trips = trips.select(
        F.concat_ws("#", "response", "route_pos").alias("route_id"), "response", "route_pos", F.col("trip.summary.length").alias("length_km"),
        F.col("trip.summary.time").alias("time_s"), F.coalesce(F.size("trip.legs"), F.lit(0)).alias("legs"), F.get("trip.legs", F.lit(0)).alias("leg"))
    steps = trips.select("route_id", F.posexplode("leg.maneuvers").alias("dir_idx", "m")).select(
        "route_id", "dir_idx", F.col("m.instruction").alias("instruction"), F.col("m.length").alias("length_km"), F.col("m.time").alias("time_s"),
        F.col("m.begin_shape_index").alias("begin_idx"), F.col("m.end_shape_index").alias("end_idx"), F.col("m.rough").alias("rough"),
        F.col("m.travel_type").alias("travel_type"), F.col("m.type").alias("maneuver_type"), F.col("m.bearing_after").alias("bearing_after"),
        F.substring(F.col("m.verbal_succinct_transition_instruction"), 1, 500).alias("succinct"))
    return trips.select("route_id", "response", "route_pos", "length_km", "time_s", "legs", F.col("leg.shape").alias("shape")), steps


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, members) of map extracts."""
    schema = "elements array<struct<type:string,id:bigint,lon:double,lat:double,nodes:array<bigint>,tags:map<string,string>," \
             "members:array<struct<type:string,ref:bigint,role:string>>>>"
    flat = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    nodes = flat.filter((F.col("type") == "node") & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(F.col("id").alias("node_id"), "lon", "lat")
    ways = flat.filter(F.col("type") == "way").select(F.col("id").alias("way_id"), "nodes", tags.alias("tags"))
    relations = flat.filter(F.col("type") == "relation").select(F.col("id").alias("relation_id"), tags.alias("tags"), F.posexplode("members").alias("pos", "m"))
    members = relations.select("relation_id", "tags", "pos", F.col("m.type").alias("type"), F.col("m.ref").alias("ref"), F.coalesce(F.col("m.role"), F.lit("")).alias("role"))
    return nodes, ways, members


def _strict_csv(spark: SparkSession, path: str, columns: list[str], quoted: bool) -> DataFrame:
    """All columns as text in the exact order; a wrong header fails the read."""
    schema = ", ".join(f"{c} string" for c in columns) + ", _bad string"
    reader = (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_bad").option("emptyValue", "").option("nullValue", "\u0000"))
    if quoted:
        reader = reader.option("multiLine", True).option("quote", '"').option("escape", '"')
    else:
        reader = reader.option("quote", "\u0000")
    # A header with other names raises; the corrupt-record column is ours, not the file's.
    return reader.csv(path)


def read_tree_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected rows) of a tree inventory: exact columns, no field over 2,000 characters."""
    rows = _strict_csv(spark, path, TREE_COLUMNS, True)
    long = F.greatest(*[F.length(F.coalesce(c, F.lit(""))) for c in TREE_COLUMNS]) > MAX_FIELD
    bad = F.col("_bad").isNotNull() | long
    return rows.filter(~bad).drop("_bad"), rows.filter(bad)


def check_row_count(rows: DataFrame, low: int, high: int) -> int:
    """Count the rows and raise unless the number lies inside the bounds."""
    n = rows.count()
    if not low <= n <= high:
        raise ValueError(f"expected {low} to {high} rows, found {n}")
    return n


def read_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, malformed rows) of fixed-point observations."""
    rows = _strict_csv(spark, path, OBSERVATION_COLUMNS, True)
    typed = rows.withColumns({
        "schema_version": F.col("schema_version").try_cast("int"), "latitude": F.col("latitude").try_cast("double"), "longitude": F.col("longitude").try_cast("double"),
        "gps_accuracy_metres": F.when(F.col("gps_accuracy_metres") != "", F.col("gps_accuracy_metres")).try_cast("double"),
        "predicted_before_observation": F.col("predicted_before_observation") == "true"})
    bad = F.col("_bad").isNotNull()
    return typed.filter(~bad).drop("_bad"), rows.filter(bad)


def read_route_walks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, malformed rows) of walked comparisons; an unknown observed order is null."""
    rows = _strict_csv(spark, path, WALK_COLUMNS, False)
    minutes = {}
    for side in ("predicted", "observed"):
        for name, column in (("duration", "duration"), ("sun", "direct_sun"), ("shade", "shade"), ("unknown", "unknown")):
            text = F.col(f"{side}_{column}_minutes")
            minutes[f"{side}_{name}_min"] = F.when(text.rlike(r"^(0|[1-9]\d{0,2})(\.\d{1,3})?$"), text.try_cast("double"))
    order = lambda c: F.when(F.col(c).rlike("^[1-3]$"), F.col(c).try_cast("int"))
    minutes["order_text"] = F.col("observed_order")
    typed = rows.withColumns(minutes).withColumns({"predicted_order": order("predicted_order"), "observed_order": order("observed_order")})
    bad = F.col("_bad").isNotNull() | ~(F.col("order_text") == "unknown") & F.col("observed_order").isNull()
    for name in [m for m in minutes if m.endswith("_min")] + ["predicted_order"]:
        bad = bad | F.col(name).isNull()
    bad = F.coalesce(bad, F.lit(True))
    drop = ["_bad", "order_text", *[c for c in WALK_COLUMNS if c.endswith("_minutes")]]
    return typed.filter(~bad).drop(*drop), typed.filter(bad)


def read_context(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, completeness per area and category) of context packs; other versions give no rows."""
    detail = "struct<access:string,fee:string,wheelchair:string,indoor:string,backrest:string,openingHours:string,level:string,checkDate:string,treeSpecies:string,treeMaintainer:string,treeInventoryLocation:string,notes:array<string>>"
    schema = f"""schemaVersion int, areaId string, bbox array<double>, completeness map<string,struct<status:string,note:string>>,
      features array<struct<id:string,category:string,subtype:string,name:string,coordinate:array<double>,sourceRef:struct<osmType:string,osmId:bigint,dataset:string,recordId:bigint,url:string>,details:{detail}>>"""
    raw = spark.read.schema(schema).option("multiLine", True).json(path).filter("schemaVersion = 1")
    f = raw.select(F.col("areaId").alias("area_id"), F.explode("features").alias("f"))
    features = f.select(
        "area_id", F.col("f.id").alias("feature_id"), F.col("f.category").alias("category"), F.col("f.subtype").alias("subtype"), F.col("f.name").alias("name"),
        F.get("f.coordinate", F.lit(0)).alias("lon"), F.get("f.coordinate", F.lit(1)).alias("lat"),
        F.coalesce(F.col("f.sourceRef.dataset"), F.concat(F.lit("osm-"), F.col("f.sourceRef.osmType"))).alias("source_kind"),
        F.coalesce(F.col("f.sourceRef.recordId"), F.col("f.sourceRef.osmId")).alias("source_id"), F.col("f.details").alias("details"))
    known = raw.select(F.col("areaId").alias("area_id"), F.explode("completeness").alias("category", "c")).select("area_id", "category", "c.status", "c.note")
    return features, known


def read_transit_issues(spark: SparkSession, lifts: str, disruptions: str, max_lifts: int | None = None, max_disruptions: int | None = None) -> DataFrame:
    """Lift and station-disruption payloads (one JSON array per file) as one issue table; lifts come first in payload order."""
    text = lambda p: spark.read.text(p, wholetext=True)
    a = text(lifts).select(F.posexplode(leading(F.from_json("value", "array<struct<naptanCode:string,message:string>>"), max_lifts)).alias("pos", "r")).select(
        F.col("r.naptanCode").alias("station"), F.lit("lift").alias("kind"), bounded_text("r.message").alias("summary"),
        F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("pos").alias("payload_pos"))
    shape = "array<struct<atcoCode:string,stationAtcoCode:string,description:string,fromDate:string,toDate:string>>"
    b = text(disruptions).select(F.posexplode(leading(F.from_json("value", shape), max_disruptions)).alias("pos", "r"))
    codes = F.array_distinct(F.filter(F.array("r.atcoCode", "r.stationAtcoCode"), lambda c: c.isNotNull()))
    b = b.withColumn("station", F.explode(codes)).select(
        "station", F.lit("station-disruption").alias("kind"), bounded_text("r.description").alias("summary"), instant_from_iso("r.fromDate").alias("valid_from"),
        instant_from_iso("r.toDate").alias("valid_to"), (F.col("pos") + AFTER_LIFTS).alias("payload_pos"))
    return a.unionByName(b).filter(F.col("summary").isNotNull())


def read_forecasts(spark: SparkSession, path: str, max_hours: int | None = None) -> DataFrame:
    """Hourly forecasts, values inside their bounds."""
    series = "array<struct<time:string,screenTemperature:double,feelsLikeTemperature:double,uvIndex:double,significantWeatherCode:double>>"
    raw = spark.read.schema(f"type string, features array<struct<properties:struct<modelRunDate:string,timeSeries:{series}>>>").option("multiLine", True).json(path)
    p = raw.filter("type = 'FeatureCollection'").select(F.input_file_name().alias("payload"), F.get("features", F.lit(0))["properties"].alias("p"))
    rows = p.select("payload", instant_from_iso("p.modelRunDate").alias("model_run_at"), F.explode(leading("p.timeSeries", max_hours)).alias("r"))
    code = F.col("r.significantWeatherCode")
    good = (between("r.screenTemperature", -80, 60) & between("r.feelsLikeTemperature", -100, 70) & between("r.uvIndex", 0, 30)
            & holds((code == F.floor(code)) & code.isin(*[float(c) for c in WEATHER])))
    rows = rows.withColumn("forecast_at", instant_from_iso("r.time")).filter(good & F.col("forecast_at").isNotNull() & F.col("model_run_at").isNotNull())
    one = lambda c: half_up(F.col(c), 1)
    return rows.select("payload", "model_run_at", "forecast_at", one("r.screenTemperature").alias("temperature_c"), one("r.feelsLikeTemperature").alias("feels_like_c"),
                       one("r.uvIndex").alias("uv_index"), code.cast("int").alias("weather_code"), weather_condition(code).alias("condition"))


def read_street_works(spark: SparkSession, path: str, max_works: int | None = None) -> DataFrame:
    """Street works; incomplete records are dropped."""
    names = {"reference": ("work_reference_number", 120), "street": ("street", 160), "category": ("work_category_string", 120),
             "traffic_management": ("traffic_management_type_string", 160), "permit_status": ("permit_status_string", 120)}
    props = ",".join(f"{c}:string" for c in [*[n for n, _ in names.values()], "start_date", "end_date", "current_traffic_management_update_date"])
    raw = spark.read.schema(f"type string, features array<struct<properties:struct<{props}>>>").option("multiLine", True).json(path)
    flat = raw.filter("type = 'FeatureCollection'").select(F.input_file_name().alias("payload"), F.posexplode(leading("features", max_works)).alias("payload_pos", "f"))
    out = flat.select("payload", "payload_pos", *[bounded_text(f"f.properties.{c}", n).alias(k) for k, (c, n) in names.items()],
                      instant_from_iso("f.properties.start_date").alias("starts_at"), instant_from_iso("f.properties.end_date").alias("ends_at"),
                      instant_from_iso("f.properties.current_traffic_management_update_date").alias("updated_at"))
    return out.dropna(subset=[*names, "starts_at", "ends_at"])


def read_heat_metrics(spark: SparkSession, path: str, metric: str, region: str, region_code: str, region_type: str) -> tuple[DataFrame, DataFrame]:
    """(valid metric rows, pages with their empty flag); array, results and data wrappers, both name styles."""
    page = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("payload"), F.col("value").alias("v"))
    get = lambda p: F.get_json_object("v", p)
    is_list = lambda c: F.trim(c).startswith("[")
    body = (F.when(is_list(F.col("v")), F.col("v")).when(is_list(get("$.results")), get("$.results")).when(is_list(get("$.data")), get("$.data"))
            .when(is_list(get("$.data.results")), get("$.data.results")).otherwise(F.concat(F.lit("["), "v", F.lit("]"))))
    empty = holds((get("$.count") == "0") & get("$.next").isNull() & get("$.previous").isNull() & (F.regexp_replace(get("$.results"), r"\s", "") == "[]"))
    pages = page.select(F.lit(region).alias("region"), "payload", empty.alias("empty_page"))
    rows = page.select("payload", F.posexplode(F.from_json(body, "array<map<string,string>>")).alias("payload_pos", "r"))
    any_of = lambda *names: F.coalesce(*[F.try_element_at("r", F.lit(n)) for n in names])
    kind = F.lower(F.trim(F.regexp_replace(F.translate(any_of("geography_type", "geographyType"), "_", " "), r"\s+", " ")))
    code, score = any_of("geography_code", "geographyCode"), any_of("metric_value", "metricValue").try_cast("double")
    ok = holds((any_of("metric", "metric_name", "metricName") == metric) & (any_of("geography", "geography_name", "geographyName") == region)
               & (code.isNull() | (code == region_code)) & (kind == region_type.lower()) & (score == F.floor(score)) & score.between(1, 16)) & is_iso_date(any_of("date"))
    return rows.filter(ok).select(F.lit(region).alias("region"), "payload", "payload_pos", score.cast("int").alias("metric_value"), any_of("date").alias("date")), pages


def read_gazetteer(spark: SparkSession, path: str, layout: str, max_places: int | None = None) -> DataFrame:
    """Places of one provider layout ('grid' or 'lonlat'): place_id, name, kind, lon, lat, payload_pos."""
    if layout == "grid":
        entry = "struct<ID:string,NAME1:string,GEOMETRY_X:double,GEOMETRY_Y:double,LOCAL_TYPE:string>"
        raw = spark.read.schema(f"results array<struct<GAZETTEER_ENTRY:{entry}>>").option("multiLine", True).json(path)
        rows = raw.select(F.posexplode(leading("results", max_places)).alias("payload_pos", "r")).select("payload_pos", "r.GAZETTEER_ENTRY.*")
        rows = rows.withColumn("name", provider_text("NAME1", 160)).filter(
            F.col("name").isNotNull() & between("GEOMETRY_X", 0, 700_000) & between("GEOMETRY_Y", -100_000, 1_300_000))
        placed = with_lon_lat(rows, "GEOMETRY_X", "GEOMETRY_Y")
        source = F.coalesce(provider_text("ID", 160), F.concat_ws(":", "name", "GEOMETRY_X", "GEOMETRY_Y"))
        return placed.select(opaque_id("os", source).alias("place_id"), "name", kind_title("LOCAL_TYPE", "Named place").alias("kind"), "lon", "lat", "payload_pos")
    if layout != "lonlat":
        raise ValueError("layout must be 'grid' or 'lonlat'")
    entry = "struct<place_id:string,lon:double,lat:double,country_code:string,formatted:string,address_line1:string,address_line2:string,result_type:string>"
    raw = spark.read.schema(f"results array<{entry}>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode(leading("results", max_places)).alias("payload_pos", "r")).select("payload_pos", "r.*")
    lines = F.concat_ws(", ", provider_text("address_line1", 120), provider_text("address_line2", 120))
    rows = rows.withColumn("name", F.coalesce(provider_text("formatted", 180), F.when(lines != "", lines)))
    home = F.coalesce(F.lower(provider_text("country_code", 3)) == "gb", F.lit(True))
    rows = rows.filter(F.col("name").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull() & home)
    source = F.coalesce(provider_text("place_id", 180), F.concat_ws(":", "name", "lon", "lat"))
    return rows.select(opaque_id("geo", source).alias("place_id"), "name", kind_title("result_type", "Address").alias("kind"), "lon", "lat", "payload_pos")


def _envelope(spark: SparkSession, path: str, member: str, item: str) -> DataFrame:
    raw = spark.read.schema(f"schemaVersion int, {member} array<{item}>").option("multiLine", True).json(path)
    return raw.filter("schemaVersion = 1").select(F.posexplode(member).alias("ingest_pos", "r")).select("ingest_pos", "r.*")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback records of version-1 envelopes, texts trimmed; other versions give no rows."""
    item = """struct<id:string,submittedAt:string,routeId:string,pilotArea:string,routeName:string,segmentId:string,segmentLabel:string,predictedState:string,predictedAt:string,
      outcome:string,predictionRecordedFirst:boolean,pavementSide:string,weatherVisibility:string,leafState:string,temporaryConditions:string,note:string,includeLocation:boolean,
      location:struct<latitude:double,longitude:double,accuracyMetres:double>>"""
    r = _envelope(spark, path, "feedback", item)
    limits = {"id": 120, "routeId": 120, "pilotArea": 80, "routeName": 160, "segmentId": 120, "segmentLabel": 240, "temporaryConditions": 500, "note": 1_000}
    cleaned = r.withColumns({c: trimmed_text(c, n) for c, n in limits.items()})
    snake = {"routeId": "route_id", "pilotArea": "pilot_area", "routeName": "route_name", "segmentId": "segment_id", "segmentLabel": "segment_label",
             "predictedState": "predicted_state", "predictionRecordedFirst": "seen_first", "pavementSide": "pavement_side", "weatherVisibility": "weather_visibility",
             "leafState": "leaf_state", "temporaryConditions": "temporary_conditions", "includeLocation": "include_location"}
    return cleaned.withColumns({"submitted_at": F.col("submittedAt").try_cast("timestamp"), "predicted_at": F.col("predictedAt").try_cast("timestamp")}).drop(
        "submittedAt", "predictedAt").withColumnsRenamed(snake)


def read_saved_journeys(spark: SparkSession, path: str) -> DataFrame:
    """Saved journeys of version-1 envelopes, flattened."""
    point = "struct<name:string,lat:double,lon:double>"
    item = f"struct<id:string,label:string,setup:struct<areaId:string,origin:{point},destination:{point},departureTime:string,profile:string,walkingPace:string,journeyCount:double,repeatEveryMinutes:double,avoidSteps:boolean,preferredRouteId:string>>"
    r = _envelope(spark, path, "journeys", item)
    s = lambda c: F.col(f"setup.{c}")
    return r.select(
        "ingest_pos", trimmed_text("id", 120).alias("id"), trimmed_text("label", 100).alias("label"), trimmed_text(s("areaId"), 80).alias("area_id"),
        trimmed_text(s("origin.name"), 160).alias("origin_name"), s("origin.lat").alias("origin_lat"), s("origin.lon").alias("origin_lon"),
        trimmed_text(s("destination.name"), 160).alias("destination_name"), s("destination.lat").alias("destination_lat"), s("destination.lon").alias("destination_lon"),
        trimmed_text(s("departureTime"), 5).alias("departure_time"), s("profile").alias("profile"),
        F.when(s("walkingPace").isin("slow", "standard", "brisk"), s("walkingPace")).otherwise("standard").alias("pace"),
        s("journeyCount").alias("journey_count"), s("repeatEveryMinutes").alias("repeat_min"), s("avoidSteps").alias("avoid_steps"),
        trimmed_text(s("preferredRouteId"), 120).alias("preferred_route_id"))


def read_threshold_plan(spark: SparkSession, path: str) -> Plan:
    """The one-record plan, checked: areas, sites, three separate bands, positive bounds; anything else raises."""
    rows = spark.read.option("multiLine", True).json(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a plan is exactly one record")
    r = rows[0].asDict(recursive=True)
    bands = sorted(((b["id"], b["start_hour_inclusive"], b["end_hour_exclusive"]) for b in r["time_bands"]), key=lambda b: b[1])
    separate = all(a[2] <= b[1] for a, b in zip(bands, bands[1:]))
    if len(bands) != 3 or len({b[0] for b in bands}) != 3 or not separate or any(not 0 <= b[1] < b[2] <= 24 for b in bands):
        raise ValueError("time bands must be three separate spans of the day")
    numbers = ["minimum_unique_points_per_pilot", "minimum_observations_per_pilot_time_band", "maximum_gps_accuracy_metres", "maximum_point_repeat_distance_metres",
               "minimum_total_eligible_observations", "minimum_classification_agreement_percent", "minimum_per_pilot_classification_agreement_percent",
               "maximum_unclassified_prediction_rate_percent"]
    if any(not isinstance(r.get(n), (int, float)) or r[n] <= 0 for n in numbers) or any(r[n] > 100 for n in numbers if n.endswith("percent")):
        raise ValueError("bounds must be positive and percentages at most 100")
    areas = r["required_pilot_areas"]
    if set(r["data_pack_fingerprints"]) != set(areas) or len(set(areas)) != len(areas):
        raise ValueError("every required area needs one fingerprint")
    return Plan(r["protocol_version"], r["model_version"], r["data_pack_version"], {a: r["data_pack_fingerprints"][a] for a in areas},
                list(r["required_site_types"]), [b for b in bands], *[r[n] for n in numbers])
