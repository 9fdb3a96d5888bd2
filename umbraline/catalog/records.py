"""Record rules, decision evidence and export text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up, reasons
from ..operators import evidence, records
from ..operators.rays import reason_names
from ..sources import sinks
from .registry import Source, VIEWS, given, query, r6

VIEWS["obs_rows"] = """
    SELECT event_id, CASE WHEN event_id % 29 = 3 THEN 1 ELSE 2 END AS schema_version, CASE WHEN event_id % 31 = 5 THEN '-bad' ELSE 'model-1' END AS model_version, 'pack/1' AS data_pack_version,
      CASE WHEN event_id % 13 = 4 THEN 'sha256-xyz' ELSE concat('sha256-', repeat('ab', 32)) END AS data_pack_fingerprint, concat('obs ', event_id, CASE WHEN event_id % 37 = 6 THEN ' ' ELSE '' END) AS observation_id,
      CASE WHEN event_id % 41 = 7 THEN 'p 1' ELSE 'p1' END AS planned_point_id, CASE WHEN event_id % 43 = 8 THEN 'beach' ELSE 'tree-canopy' END AS site_type,
      51.5 + (event_id % 100) * 0.0002 AS latitude, -0.12 + (event_id % 70) * 0.0001 AS longitude, CASE WHEN event_id % 2 = 0 THEN 'manual' ELSE 'one-shot-gps' END AS coordinate_source,
      CASE WHEN event_id % 2 = 1 AND event_id % 7 <> 3 THEN CAST(event_id % 30 AS DOUBLE) WHEN event_id % 16 = 2 THEN CAST(5 AS DOUBLE) END AS gps_accuracy_metres, 'left' AS pavement_side,
      CASE WHEN event_id % 17 = 1 THEN '2024-03-31T01:30' WHEN event_id % 17 = 2 THEN '2024-02-30T10:00' ELSE '2024-06-01T10:00' END AS observed_london_datetime,
      CASE event_type WHEN 'error' THEN 'hail' ELSE 'overcast' END AS weather_visibility, CASE WHEN event_id % 19 = 9 THEN 'fog' ELSE 'sun' END AS observed_state, 'uncertain' AS predicted_state,
      event_id % 23 <> 10 AS predicted_before_observation, 'leaf-on' AS leaf_state, '' AS temporary_conditions, 'ok' AS observer_notes
    FROM {events}"""


@query("validate_observations", f"""{given('obs_rows')}
SELECT event_id, concat_ws(',', CASE WHEN schema_version <> 2 THEN 'schema-version' END, CASE WHEN model_version = '-bad' THEN 'model-version' END, CASE WHEN data_pack_fingerprint = 'sha256-xyz' THEN 'fingerprint' END,
  CASE WHEN observation_id LIKE '% ' THEN 'observation-id' END, CASE WHEN planned_point_id = 'p 1' THEN 'point-id' END, CASE WHEN site_type = 'beach' THEN 'site-type' END, CASE WHEN latitude > 51.5151 OR longitude > -0.1149 THEN 'position' END,
  CASE WHEN (coordinate_source = 'manual') <> (gps_accuracy_metres IS NULL) THEN 'gps-accuracy' END, CASE WHEN observed_london_datetime <> '2024-06-01T10:00' THEN 'local-time' END, CASE WHEN weather_visibility = 'hail' THEN 'weather' END,
  CASE WHEN observed_state = 'fog' THEN 'observed' END, CASE WHEN NOT predicted_before_observation THEN 'predicted-first' END) AS problems FROM obs_rows""")
def validate_observations(src: Source) -> DataFrame:
    boxed = src.view("obs_rows").withColumns({
        "west": F.lit(-0.13), "south": F.lit(51.49), "east": F.lit(-0.1149), "north": F.lit(51.5151),
        "latitude": F.round(F.col("latitude").cast("double"), 7), "longitude": F.round(F.col("longitude").cast("double"), 7)})
    return boxed.select("event_id", F.array_join(reasons(records.observation_checks()), ",").alias("problems"))


VIEWS["report_rows"] = """
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('r', event_id) END AS id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'route' END AS route_id, CAST(ts AS TIMESTAMP) AS submitted_at,
      CASE event_type WHEN 'error' THEN 'broken' ELSE 'other' END AS outcome, event_id % 3 = 0 AS include_location, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS DOUBLE) END AS latitude, CAST(event_id % 200 AS DOUBLE) AS longitude
    FROM {events}"""


@query("validate_feedback", f"""{given('report_rows')}
SELECT event_id, concat_ws(',', CASE WHEN id IS NULL THEN 'id' END, CASE WHEN route_id IS NULL THEN 'route' END, CASE WHEN outcome = 'broken' THEN 'outcome' END,
  CASE WHEN include_location AND NOT coalesce(latitude <= 90 AND longitude <= 180, false) THEN 'location' END) AS problems FROM report_rows""")
def validate_feedback(src: Source) -> DataFrame:
    rows = src.view("report_rows").withColumn("location", F.struct("latitude", "longitude"))
    return rows.select("event_id", F.array_join(reasons(records.feedback_checks()), ",").alias("problems"))


VIEWS["plan_rows"] = """
    SELECT c_custkey, concat('j', c_custkey) AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'Way to work' END AS label, 'a' AS origin_name, CAST(51 AS DOUBLE) AS origin_lat, CAST(c_custkey % 190 AS DOUBLE) AS origin_lon, 'b' AS destination_name,
      CAST(c_custkey % 100 AS DOUBLE) AS destination_lat, CAST(0 AS DOUBLE) AS destination_lon, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'robot' ELSE 'worker' END AS profile, CAST(c_custkey % 60 AS DOUBLE) AS journey_count,
      CAST(c_custkey % 11 AS DOUBLE) + 0.5 * (c_custkey % 2) AS repeat_min, c_custkey % 2 = 0 AS avoid_steps, CASE WHEN c_custkey % 5 = 0 THEN '24:10' WHEN c_custkey % 5 = 1 THEN '08:15' END AS departure_time FROM {customer}"""


@query("validate_saved_journeys", f"""{given('plan_rows')}
SELECT c_custkey, concat_ws(',', CASE WHEN label IS NULL THEN 'label' END, CASE WHEN origin_lon > 180 THEN 'origin' END, CASE WHEN destination_lat > 90 THEN 'destination' END, CASE WHEN profile = 'robot' THEN 'profile' END,
  CASE WHEN journey_count NOT BETWEEN 1 AND 50 THEN 'journeys' END, CASE WHEN repeat_min < 5 OR repeat_min <> floor(repeat_min) THEN 'repeat' END, CASE WHEN departure_time = '24:10' THEN 'time' END) AS problems FROM plan_rows""")
def validate_saved_journeys(src: Source) -> DataFrame:
    return src.view("plan_rows").select("c_custkey", F.array_join(reasons(records.saved_journey_checks()), ",").alias("problems"))


@query("validate_provider_rows", """
SELECT event_id, concat_ws(',', CASE WHEN value NOT BETWEEN 1 AND 16 THEN 'value' END, CASE WHEN event_type <> 'view' THEN 'event_type' END, CASE WHEN length(props) > 9 THEN 'props' END) AS problems FROM events""")
def validate_provider_rows(src: Source) -> DataFrame:
    checks = records.provider_row_checks({"value": (1, 16)}, {"event_type": "view"}, {"props": 9})
    return src.table("events").select("event_id", F.array_join(reasons(checks), ",").alias("problems"))


# One chosen route per request; its journeys add up, except every eleventh request.
VIEWS["chosen"] = """
    SELECT route_id AS request_id, route_id, profile, journey_count, CAST(15 AS INT) AS repeat_min, CASE WHEN route_id % 9 = 4 THEN 'jog' ELSE 'brisk' END AS pace, duration_s / journey_count AS walk_s, sun_s, best_s, worst_s,
      CAST(journey_count * 600 AS DOUBLE) AS daylight_s, CAST(journey_count * 500 AS DOUBLE) AS modelled_s, CAST(journey_count * 100 AS DOUBLE) AS unknown_s, CAST(route_id % 101 AS DOUBLE) AS shade_percent, coverage_percent,
      CAST(route_id % 1000 + 1 AS DOUBLE) AS distance_m, CAST(route_id % 400 + 1 AS DOUBLE) AS fastest_s FROM {schedules}"""
_JOURNEYS = """
    SELECT request_id, CAST(n AS INT) AS journey, walk_s, (sun_s + CASE WHEN request_id % 11 = 1 THEN 90 ELSE 0 END) / journey_count AS sun_s, best_s / journey_count AS best_s,
      (worst_s + CASE WHEN request_id % 11 = 1 THEN 90 ELSE 0 END) / journey_count AS worst_s, CAST((request_id + n) % 101 AS DOUBLE) AS shade_percent, coverage_percent,
      CAST(n * 900000 AS BIGINT) AS departure_ms, CAST((request_id + n) % 64 AS INT) AS reason_bits
    FROM (SELECT *, EACH AS n FROM {chosen}) c"""
VIEWS["chosen_journeys"] = (_JOURNEYS.replace("EACH", "explode(sequence(0, journey_count - 1))"), _JOURNEYS.replace("EACH", "unnest(range(journey_count))"))
EVIDENCE = f"""{given('chosen', 'chosen_journeys')},
s AS (SELECT request_id, count(*) AS n, sum(floor(sun_s + 0.5)) AS js, sum(floor(best_s + 0.5)) AS jb, sum(floor(worst_s + 0.5)) AS jw, bool_and(floor(best_s + 0.5) <= floor(sun_s + 0.5) AND floor(sun_s + 0.5) <= floor(worst_s + 0.5)) AS ok, bit_or(reason_bits) AS bits
  FROM chosen_journeys GROUP BY request_id),
v AS (SELECT c.*, n, js, jb, jw, bits, concat_ws(',', CASE WHEN NOT ok THEN 'journey-range' END, CASE WHEN abs(floor(sun_s + 0.5) - js) > journey_count OR abs(floor(best_s + 0.5) - jb) > journey_count OR abs(floor(worst_s + 0.5) - jw) > journey_count THEN 'totals' END,
    CASE WHEN fastest_s > walk_s THEN 'slower-than-fastest' END, CASE WHEN pace = 'jog' THEN 'pace' END) AS problems FROM chosen c JOIN s ON s.request_id = c.request_id)"""


@query("validate_evidence", f"{EVIDENCE} SELECT request_id, problems FROM v")
def validate_evidence(src: Source) -> DataFrame:
    joined = src.view("chosen").join(evidence.journey_sums(src.view("chosen_journeys")), "request_id")
    return joined.select("request_id", F.array_join(reasons(records.evidence_checks()), ",").alias("problems"))


@query("decision_evidence", f"""{EVIDENCE}
SELECT request_id, CAST(js AS BIGINT) AS sun_s, CAST(jb AS BIGINT) AS best_s, CAST(jw AS BIGINT) AS worst_s, CAST(floor(walk_s + 0.5) - floor(fastest_s + 0.5) AS BIGINT) AS extra_s, CAST(n AS INT) AS journeys, bits <> 0 AS limited,
  strftime(make_timestamp(CAST((n - 1) * 900000000 + floor(walk_s * 1000) * 1000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS last_arrival FROM v WHERE problems = ''""")
def decision_evidence(src: Source) -> DataFrame:
    text = {"created_ms": F.lit(0), "area_id": F.lit("a"), "area_name": F.lit("Area"), "origin_name": F.lit("From"), "destination_name": F.lit("To"), "departure_ms": F.lit(0),
            "labels": F.array(F.lit("recommended"), F.lit("fastest")), "fastest_id": F.col("route_id"), "fastest_m": F.col("distance_m"), "avoid_steps": F.lit(False),
            "access_evidence": F.lit("unavailable"), "crossing_evidence": F.lit("unavailable"), "surface_evidence": F.lit("unavailable")}
    constants = {k: "x" for k in ("schema", "route_source", "route_date", "height_source", "height_date", "height_processed", "model_name", "model_version")}
    good, _ = evidence.decision_evidence(src.view("chosen").withColumns(text), src.view("chosen_journeys"), {**constants, "schema_version": "1"}, ["Clear sky only."])
    out = F.col("record.modelOutput")
    return good.select(
        "request_id", out["estimatedPotentialDirectSunSeconds"].alias("sun_s"), out["potentialDirectSunRangeSeconds"]["bestCase"].alias("best_s"),
        out["potentialDirectSunRangeSeconds"]["worstCase"].alias("worst_s"), F.col("record.decision.selectedVsFastest.additionalDurationSecondsPerJourney").alias("extra_s"),
        F.size(out["journeys"]).alias("journeys"), out["confidence"]["limited"].alias("limited"),
        F.substring(F.element_at(out["journeys"], -1)["arrival"], 1, 19).alias("last_arrival"))


@query("union_reasons", f"""{given('chosen', 'chosen_journeys')}, b AS (SELECT request_id, bit_or(reason_bits) AS m FROM chosen_journeys GROUP BY request_id)
SELECT request_id, concat_ws(',', CASE WHEN m & 1 <> 0 THEN 'incomplete-height-coverage' END, CASE WHEN m & 2 <> 0 THEN 'low-sun-angle' END, CASE WHEN m & 4 <> 0 THEN 'near-clearance-threshold' END,
  CASE WHEN m & 8 <> 0 THEN 'ray-search-limit' END, CASE WHEN m & 16 <> 0 THEN 'subcell-surface-variation' END, CASE WHEN m & 32 <> 0 THEN 'unmodelled-passage' END) AS reasons FROM b""")
def union_reasons(src: Source) -> DataFrame:
    bits = src.view("chosen_journeys").groupBy("request_id").agg(F.bit_or("reason_bits").alias("m"))
    return bits.select("request_id", F.array_join(reason_names("m"), ",").alias("reasons"))


@query("section_geojson", f"""{given('geo_vertices')},
h AS (SELECT route_id, seq, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM geo_vertices WINDOW w AS (PARTITION BY route_id ORDER BY seq))
SELECT route_id, seq, 'LineString' AS kind, CASE WHEN seq % 6 = 5 THEN 'unknown' ELSE 'sun' END AS exposure, {r6('lon')} AS first_lon, {r6('lat2')} AS last_lat FROM h WHERE lon2 IS NOT NULL""")
def section_geojson(src: Source) -> DataFrame:
    from ..operators.geometry import segments
    state = F.when(F.col("seg_idx") % 6 == 5, "haze").otherwise("sun")
    text = sinks.section_features(segments(src.view("geo_vertices")).withColumns({"exposure": state}).withColumnsRenamed(
        {"x1": "x_start", "y1": "y_start", "x2": "x_end", "y2": "y_end"}))
    get = lambda p, t="string": F.get_json_object("value", p).cast(t)
    return text.select(get("$.properties.routeId", "bigint").alias("route_id"), get("$.properties.routeSegmentIndex", "int").alias("seq"), get("$.geometry.type").alias("kind"),
                       get("$.properties.exposure").alias("exposure"), half_up(get("$.geometry.coordinates[0][0]", "double"), 6).alias("first_lon"),
                       half_up(get("$.geometry.coordinates[1][1]", "double"), 6).alias("last_lat"))
