"""Field observations and walked comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import reasons
from ..functions.lookups import SITE_TYPES, reported_state
from ..operators import calibration as cal
from ..operators import walks as wk
from .registry import Source, VIEWS, given, haversine_sql, query

PLAN = cal.Plan("p1", "current", "d1", {"a": "fp-a", "b": "fp-b"}, SITE_TYPES)
VIEWS["field_rows"] = """
    SELECT observation_id, area, point_id, CASE site_no WHEN 0 THEN 'open-street' WHEN 1 THEN 'building-edge' WHEN 2 THEN 'tree-canopy' WHEN 3 THEN 'street-canyon'
        WHEN 4 THEN 'station-approach' ELSE 'hospital-entrance' END AS site_type, weather, local_hour, predicted, observed, coordinate_source, gps_accuracy_m,
      CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, 'p1' AS protocol_version, release AS model_version, 'd1' AS data_pack_version, concat('fp-', area) AS data_pack_fingerprint
    FROM {observations}"""

MARK = f"""{given('field_rows')},
m0 AS (SELECT *, CASE WHEN local_hour BETWEEN 8 AND 10 THEN 'morning' WHEN local_hour BETWEEN 11 AND 14 THEN 'solar-noon' WHEN local_hour BETWEEN 15 AND 18 THEN 'late-afternoon' END AS band FROM field_rows),
marked AS (SELECT *, CASE WHEN model_version <> 'current' THEN 'release-mismatch' WHEN weather <> 'clear-direct-sun' THEN 'not-clear-sun'
    WHEN coordinate_source = 'one-shot-gps' AND gps_accuracy_m > 20 THEN 'gps-too-coarse' WHEN band IS NULL THEN 'outside-bands' END AS exclusion FROM m0),
el AS (SELECT * FROM marked WHERE exclusion IS NULL),
per AS (SELECT area, count(*) AS eligible, count(*) FILTER (predicted IN ('sun', 'shade')) AS classifiable, count(*) FILTER (predicted IN ('sun', 'shade') AND predicted = observed) AS matching,
    count(*) FILTER (predicted NOT IN ('sun', 'shade')) AS unclassified, count(*) FILTER (band = 'morning') AS band_morning, count(*) FILTER (band = 'solar-noon') AS band_solar_noon,
    count(*) FILTER (band = 'late-afternoon') AS band_late_afternoon FROM el GROUP BY area),
place AS (SELECT DISTINCT area, point_id, lat, lon FROM el),
far AS (SELECT a.area, a.point_id, max({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371008.8)}) AS widest FROM place a JOIN place b ON a.area = b.area AND a.point_id = b.point_id GROUP BY a.area, a.point_id),
pts AS (SELECT e.area, e.point_id, max(site_type) AS site_type, count(*) AS observations, count(DISTINCT band) = 3 AS complete FROM el e GROUP BY e.area, e.point_id)"""


def _marked(src: Source) -> DataFrame:
    return cal.mark_observations(src.view("field_rows"), PLAN)


@query("exclusion_counts", f"{MARK} SELECT exclusion, count(*) AS observations FROM marked WHERE exclusion IS NOT NULL GROUP BY exclusion")
def exclusion_counts(src: Source) -> DataFrame:
    return cal.exclusion_counts(_marked(src))


@query("calibration_by_area", f"""{MARK}
SELECT area, eligible, classifiable, matching, unclassified, band_morning, band_solar_noon, band_late_afternoon,
  floor(matching / CAST(classifiable AS DOUBLE) * 100 * 1000 + 0.5) / 1000 AS agreement_percent, floor(unclassified / CAST(eligible AS DOUBLE) * 100 * 1000 + 0.5) / 1000 AS unclassified_percent FROM per""")
def calibration_by_area(src: Source) -> DataFrame:
    return cal.calibration_by_area(_marked(src), PLAN).drop("area_pos")


@query("calibration_points", f"""{MARK}
SELECT p.area, p.point_id, site_type, observations, complete, widest > 25 AS spread_over FROM pts p JOIN far f ON f.area = p.area AND f.point_id = p.point_id""")
def calibration_points(src: Source) -> DataFrame:
    return cal.calibration_points(_marked(src), PLAN)


@query("calibration_gate", f"""{MARK},
ar AS (SELECT p.area, count(*) AS points, count(*) FILTER (complete) AS done, count(*) FILTER (widest > 25) AS wide FROM pts p JOIN far f ON f.area = p.area AND f.point_id = p.point_id GROUP BY p.area),
codes AS (SELECT 0 AS o, CASE WHEN sum(eligible) < 36 THEN 'minimum-total-eligible-observations' END AS c FROM per
  UNION ALL SELECT CASE area WHEN 'a' THEN 10 ELSE 20 END, CASE WHEN points < 6 THEN area || ':minimum-unique-points' END FROM ar
  UNION ALL SELECT CASE area WHEN 'a' THEN 11 ELSE 21 END, CASE WHEN done < 6 THEN area || ':repeat-each-point-in-every-time-band' END FROM ar
  UNION ALL SELECT CASE area WHEN 'a' THEN 12 ELSE 22 END, CASE WHEN wide > 0 THEN area || ':point-repeat-distance' END FROM ar)
SELECT 'insufficient-evidence' AS status, (SELECT count(*) FROM marked) AS total, CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(matching) AS BIGINT) AS matching,
  floor(sum(matching) / CAST(sum(classifiable) AS DOUBLE) * 100 * 1000 + 0.5) / 1000 AS agreement_percent, (SELECT string_agg(c, ',' ORDER BY o) FROM codes) AS failures FROM per""")
def calibration_gate(src: Source) -> DataFrame:
    out = cal.calibration_gate(_marked(src), PLAN)
    return out.select("status", "total", "eligible", "matching", "agreement_percent", F.array_join("failures", ",").alias("failures"))


# Ranks follow the minutes; comparisons with an unknown stretch stay unranked.
VIEWS["walk_rows"] = """
    SELECT comparison_id, route_id, 'pilot' AS area, CAST(duration_mmin / 1000.0 AS DOUBLE) AS predicted_duration_min, CAST(predicted_sun_mmin / 1000.0 AS DOUBLE) AS predicted_sun_min,
      CAST(predicted_unknown_mmin / 1000.0 AS DOUBLE) AS predicted_unknown_min, CAST((duration_mmin - predicted_sun_mmin - predicted_unknown_mmin) / 1000.0 AS DOUBLE) AS predicted_shade_min,
      CAST(duration_mmin / 1000.0 AS DOUBLE) AS observed_duration_min, CAST(observed_sun_mmin / 1000.0 AS DOUBLE) AS observed_sun_min,
      CAST(observed_unknown_mmin / 1000.0 AS DOUBLE) AS observed_unknown_min, CAST((duration_mmin - observed_sun_mmin - observed_unknown_mmin) / 1000.0 AS DOUBLE) AS observed_shade_min,
      CAST(CASE WHEN comparison_id % 101 = 5 THEN route_pos + 1 ELSE row_number() OVER (PARTITION BY comparison_id ORDER BY predicted_sun_mmin, route_id) END AS INT) AS predicted_order,
      CAST(CASE WHEN observed_unknown_mmin > 0 AND comparison_id % 35 <> 0 THEN NULL ELSE row_number() OVER (PARTITION BY comparison_id ORDER BY observed_sun_mmin, route_id) END AS INT) AS observed_order
    FROM {walks}"""


# Entries with one flaw or several, each on its own stride.
VIEWS["walk_entries"] = """
    SELECT CASE WHEN route_id % 23 = 5 THEN '-' ELSE concat('c', CAST(comparison_id AS VARCHAR(20))) END AS comparison_id, route_id AS entry_no, concat('r', CAST(route_id AS VARCHAR(20))) AS route_id,
      CASE WHEN route_id % 29 = 7 THEN 'elsewhere' ELSE area END AS area, CASE WHEN route_id % 31 = 3 THEN '2024-03-31T01:30' WHEN route_id % 37 = 4 THEN '2024-6-1' ELSE '2024-06-01T12:00' END AS comparison_london_datetime,
      CASE WHEN route_id % 41 = 2 THEN '' ELSE 'v1.2+b/3' END AS model_version, route_id % 43 <> 6 AS walk_complete, CASE WHEN route_id % 47 <> 8 THEN TRUE END AS prediction_frozen_before_walk,
      CASE WHEN route_id % 53 = 9 THEN 'overcast' ELSE 'clear-direct-sun' END AS weather_visibility,
      CAST(CASE WHEN route_id % 59 = 1 THEN 240.5 ELSE predicted_duration_min END AS DOUBLE) AS predicted_duration_min, predicted_sun_min, predicted_unknown_min, predicted_shade_min,
      observed_duration_min, CAST(CASE WHEN route_id % 61 = 2 THEN observed_sun_min + 0.0006 ELSE observed_sun_min END AS DOUBLE) AS observed_sun_min, observed_unknown_min,
      CAST(CASE WHEN route_id % 67 = 3 THEN observed_shade_min + 0.001 ELSE observed_shade_min END AS DOUBLE) AS observed_shade_min,
      CAST(CASE WHEN route_id % 71 = 4 THEN 4 ELSE route_id % 3 + 1 END AS INT) AS predicted_order, CAST(CASE WHEN route_id % 73 = 5 THEN 0 WHEN route_id % 2 = 0 THEN NULL ELSE 1 END AS INT) AS observed_order
    FROM {walk_rows}"""


@query("validate_route_walks", f"""{given('walk_entries')}
SELECT entry_no, concat_ws(',', CASE WHEN entry_no % 23 = 5 THEN 'comparison-id' END, CASE WHEN entry_no % 29 = 7 THEN 'area' END, CASE WHEN entry_no % 31 = 3 OR entry_no % 37 = 4 THEN 'local-time' END,
  CASE WHEN entry_no % 41 = 2 THEN 'model-version' END, CASE WHEN entry_no % 43 = 6 THEN 'walk-complete' END, CASE WHEN entry_no % 47 = 8 THEN 'predicted-first' END, CASE WHEN entry_no % 53 = 9 THEN 'weather' END,
  CASE WHEN predicted_duration_min > 240 THEN 'predicted-duration' END, CASE WHEN predicted_sun_min < 0 THEN 'predicted-sun' END, CASE WHEN predicted_shade_min < 0 THEN 'predicted-shade' END,
  CASE WHEN CAST(predicted_duration_min * 1000 AS BIGINT) <> CAST((predicted_sun_min + predicted_shade_min + predicted_unknown_min) * 1000 AS BIGINT) THEN 'predicted-total' END,
  CASE WHEN entry_no % 61 = 2 THEN 'observed-sun' END, CASE WHEN observed_shade_min < 0 THEN 'observed-shade' END,
  CASE WHEN entry_no % 61 = 2 AND entry_no % 67 <> 3 OR entry_no % 67 = 3 THEN 'observed-total' END, CASE WHEN entry_no % 71 = 4 THEN 'predicted-order' END, CASE WHEN entry_no % 73 = 5 THEN 'observed-order' END) AS problems FROM walk_entries""")
def validate_route_walks(src: Source) -> DataFrame:
    return src.view("walk_entries").select("entry_no", F.array_join(reasons(wk.entry_checks(["pilot"])), ",").alias("problems"))


@query("validate_walk_groups", f"""{given('walk_rows')},
s AS (SELECT *, lag(predicted_sun_min) OVER (PARTITION BY comparison_id ORDER BY predicted_order) AS pp, lag(observed_sun_min) OVER (PARTITION BY comparison_id ORDER BY observed_order) AS oo FROM walk_rows),
g AS (SELECT comparison_id, count(*) AS n, bool_or(pp > predicted_sun_min) AS bad_p, bool_or(observed_unknown_min > 0) AS unk, count(observed_order) AS ranked,
    list_sort(list(predicted_order)) = range(1, count(*) + 1) AS full_p FROM s GROUP BY comparison_id)
SELECT comparison_id, n, concat_ws(',', CASE WHEN n NOT BETWEEN 2 AND 3 THEN 'route-count' END, CASE WHEN n NOT BETWEEN 2 AND 3 OR NOT full_p THEN 'predicted-ranks' END,
  CASE WHEN bad_p OR n = 1 THEN 'predicted-order' END, CASE WHEN unk AND ranked > 0 THEN 'ranked-despite-unknown' END, CASE WHEN n = 1 AND NOT unk THEN 'observed-ranks' END,
  CASE WHEN n = 1 AND NOT unk THEN 'observed-order' END) AS broken FROM g""")
def validate_walk_groups(src: Source) -> DataFrame:
    out = wk.group_verdicts(src.view("walk_rows"), ["area"])
    return out.select("comparison_id", "n", F.array_join("broken_rules", ",").alias("broken"))


def _valid_walks(src: Source) -> DataFrame:
    rows = src.view("walk_rows")
    good = wk.group_verdicts(rows, ["area"]).filter(F.size("broken_rules") == 0)
    return rows.join(good.select("comparison_id"), "comparison_id", "left_semi")


WALK = f"""{given('walk_rows')},
t AS (SELECT *, lag(predicted_sun_min) OVER (PARTITION BY comparison_id ORDER BY predicted_order) AS pp FROM walk_rows),
bad AS (SELECT comparison_id FROM t GROUP BY comparison_id HAVING bool_or(pp > predicted_sun_min) OR count(*) NOT BETWEEN 2 AND 3 OR (bool_or(observed_unknown_min > 0) AND count(observed_order) > 0)),
ok AS (SELECT * FROM walk_rows WHERE comparison_id NOT IN (SELECT comparison_id FROM bad)),
cmp AS (SELECT comparison_id, count(*) AS routes, arg_min(route_id, predicted_order) AS predicted_best, CASE WHEN count(observed_order) = count(*) THEN arg_min(route_id, observed_order) END AS observed_best,
    CASE WHEN count(observed_order) = count(*) THEN bool_and(predicted_order = observed_order) END AS order_agrees,
    CASE WHEN count(observed_order) = count(*) THEN floor((arg_min(observed_sun_min, predicted_order) - min(observed_sun_min)) * 1000 + 0.5) / 1000 END AS regret_min FROM ok GROUP BY comparison_id)"""


@query("walk_comparisons", f"{WALK} SELECT * FROM cmp")
def walk_comparisons(src: Source) -> DataFrame:
    return wk.compare_walks(_valid_walks(src)).select("comparison_id", "routes", "predicted_best", "observed_best", "order_agrees", "regret_min")


R3 = "floor(({0}) * 1000 + 0.5) / 1000"


@query("walk_summary", f"""{WALK},
a AS (SELECT count(*) AS walks, count(*) FILTER (observed_unknown_min = 0) AS comparable_walks, {R3.format('avg(abs(predicted_sun_min - observed_sun_min)) FILTER (observed_unknown_min = 0)')} AS mae_min,
    {R3.format('(sum(predicted_duration_min) - sum(predicted_unknown_min)) / sum(predicted_duration_min) * 100')} AS predicted_coverage_percent, {R3.format('sum(predicted_unknown_min) / sum(predicted_duration_min) * 100')} AS predicted_unknown_percent,
    {R3.format('(sum(observed_duration_min) - sum(observed_unknown_min)) / sum(observed_duration_min) * 100')} AS observed_coverage_percent, {R3.format('sum(observed_unknown_min) / sum(observed_duration_min) * 100')} AS observed_unknown_percent FROM ok),
b AS (SELECT count(*) AS comparisons, count(order_agrees) AS comparable, count(*) FILTER (order_agrees) AS agreeing, {R3.format('count(*) FILTER (order_agrees) / CAST(count(order_agrees) AS DOUBLE) * 100')} AS agreement_percent,
    {R3.format('avg(regret_min)')} AS mean_regret_min FROM cmp)
SELECT * FROM a, b""")
def walk_summary(src: Source) -> DataFrame:
    return wk.summarise_walks(wk.compare_walks(_valid_walks(src)))


VIEWS["feedback"] = """
    SELECT event_id AS report_id, CASE event_id % 6 WHEN 0 THEN 'predicted-correct' WHEN 1 THEN 'actually-sunny' WHEN 2 THEN 'actually-shaded' WHEN 3 THEN 'blocked-or-inaccessible' WHEN 4 THEN 'other' ELSE 'predicted-correct' END AS outcome,
      CASE event_id % 7 WHEN 0 THEN 'sun' WHEN 1 THEN 'shade' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'unknown' WHEN 4 THEN 'night' WHEN 5 THEN 'sun' END AS predicted_state
    FROM {events}"""
STATE_SQL = """CASE WHEN outcome = 'actually-sunny' THEN 'sun' WHEN outcome = 'actually-shaded' THEN 'shade' WHEN outcome = 'predicted-correct' AND predicted_state IN ('sun', 'shade') THEN predicted_state ELSE 'not-recorded' END"""


@query("feedback_confusion", f"""{given('feedback')}, s AS (SELECT coalesce(predicted_state, 'none') AS predicted, {STATE_SQL} AS reported FROM feedback)
SELECT predicted, count(*) FILTER (reported = 'sun') AS sun, count(*) FILTER (reported = 'shade') AS shade, count(*) FILTER (reported = 'not-recorded') AS not_recorded FROM s GROUP BY predicted""")
def feedback_confusion(src: Source) -> DataFrame:
    df = src.view("feedback").select(F.coalesce("predicted_state", F.lit("none")).alias("predicted"), reported_state("outcome", "predicted_state").alias("reported"))
    out = df.groupBy("predicted").pivot("reported", ["sun", "shade", "not-recorded"]).count().fillna(0)
    return out.withColumnRenamed("not-recorded", "not_recorded")
