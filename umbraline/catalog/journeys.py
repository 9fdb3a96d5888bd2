"""Ranking, advice, profiles and progress along a route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up
from ..functions.lookups import EXPOSURES
from ..operators import advice, geometry, labels, profile, progress
from .registry import Source, given, haversine_sql, query, r6

# The twin folds its lists in route order too; each step keeps the best so far.
PER = "{0}.duration_s / greatest(1, {0}.journey_count)"
FASTER = PER.format("s") + " < " + PER.format("b")


def _fold(items: str, better: str) -> str:
    return f"list_reduce({items}, lambda b, s: CASE WHEN {better} THEN s ELSE b END)"


def _clear(items: str) -> str:
    return (f"list_filter({items}, lambda c: len(list_filter({items}, lambda o: o.route_id <> c.route_id AND NOT (c.worst_s < o.best_s))) = 0)")


def _first(items: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN {items}[1] END"


PACK = "{'route_pos': route_pos, 'route_id': route_id, 'duration_s': duration_s, 'journey_count': journey_count, 'sun_s': sun_s, 'best_s': best_s, 'worst_s': worst_s, 'is_daylight': is_daylight, 'coverage_percent': coverage_percent, 'low_sun': low_sun, 'avoids_barriers': avoids_barriers}"


def label_ctes(source: str = "schedules", key: str = "request_id") -> str:
    return f"""
l0 AS (SELECT {key}, profile, list({PACK} ORDER BY route_pos) AS routes FROM {source} GROUP BY {key}, profile),
l1 AS (SELECT *, {_fold('routes', FASTER)} AS fastest,
    {_fold('routes', 's.sun_s < b.sun_s OR (s.sun_s = b.sun_s AND ' + FASTER + ')')} AS least FROM l0),
l2 AS (SELECT *, 30.0 * fastest.journey_count AS visible, {PER.format('fastest')} AS fast_s FROM l1),
l3 AS (SELECT *, least(CASE WHEN profile = 'worker' THEN 180.0 ELSE 300.0 END, fast_s * CASE WHEN profile = 'worker' THEN 0.15 ELSE 0.2 END) AS allowed_s,
    CASE WHEN profile = 'worker' THEN visible ELSE 0.0 END AS tie, greatest(visible, fastest.sun_s * 0.05) AS gain_s,
    len(list_filter(routes, lambda s: s.is_daylight)) > 0 AS any_day,
    list_max(list_transform(routes, lambda s: s.sun_s)) - list_min(list_transform(routes, lambda s: s.sun_s)) AS spread FROM l2),
l4 AS (SELECT *, any_day AND spread >= visible AS differs, list_filter(routes, lambda s: {PER.format('s')} <= fast_s + allowed_s) AS eligible FROM l3),
l5 AS (SELECT *, {_fold('eligible', 's.sun_s - b.sun_s < -tie OR (abs(s.sun_s - b.sun_s) <= tie AND ' + FASTER + ')')} AS best,
    list_filter(eligible, lambda s: s.route_id <> fastest.route_id AND fastest.sun_s - s.sun_s >= gain_s AND s.worst_s < fastest.best_s) AS alts,
    len(list_filter(routes, lambda o: o.route_id <> least.route_id AND NOT (least.worst_s < o.best_s))) = 0 AS lowest_sure FROM l4),
l6 AS (SELECT *, {_clear('alts')} AS clears FROM l5),
l7 AS (SELECT *, coalesce({_first('clears')}, CASE WHEN len(alts) > 0 THEN {_fold('alts', FASTER)} END, fastest) AS pick FROM l6),
l8 AS (SELECT *, CASE WHEN NOT any_day THEN 'no-daylight'
    WHEN pick.route_id = fastest.route_id AND pick.route_id = least.route_id THEN 'fastest-and-lowest'
    WHEN best.route_id <> fastest.route_id AND fastest.sun_s - best.sun_s >= gain_s AND len(alts) = 0 THEN 'ranges-overlap'
    WHEN pick.route_id = fastest.route_id THEN 'small-saving' WHEN len(alts) > 1 AND len(clears) = 0 THEN 'several-lower' ELSE 'lower-sun' END AS code,
    unnest(routes) AS r FROM l7),
labelled AS (SELECT {key}, profile, r.*, concat_ws(',', CASE WHEN r.route_id = pick.route_id THEN 'recommended' END,
    CASE WHEN differs AND r.route_id = least.route_id THEN CASE WHEN lowest_sure THEN 'least-sun' ELSE 'lowest-estimate' END END,
    CASE WHEN r.route_id = fastest.route_id THEN 'fastest' END) AS labels,
    CASE WHEN r.route_id = pick.route_id THEN code END AS reason_code,
    CASE WHEN r.route_id = pick.route_id THEN fastest.sun_s - pick.sun_s END AS saving_s,
    CASE WHEN r.route_id = pick.route_id THEN greatest(0, {PER.format('pick')} - fast_s) END AS extra_s FROM l8)"""


EXTRA = ["coverage_percent", "low_sun", "avoids_barriers"]


@query("label_routes", f"""{given('schedules')},{label_ctes()}
SELECT route_id, labels, reason_code, {r6('saving_s')} AS saving_s, {r6('extra_s')} AS extra_s FROM labelled""")
def label_routes(src: Source) -> DataFrame:
    out = labels.label_routes(src.view("schedules"))
    return out.select("route_id", F.array_join("labels", ",").alias("labels"), "reason_code",
                      half_up("saving_s", 6).alias("saving_s"), half_up("extra_s", 6).alias("extra_s"))


@query("access_guard", f"""{given('schedules')},{label_ctes()},
g0 AS (SELECT request_id, request_id % 3 = 1 AS step_free, list({{'route_pos': route_pos, 'route_id': route_id, 'duration_s': duration_s,
    'journey_count': journey_count, 'sun_s': sun_s, 'best_s': best_s, 'worst_s': worst_s, 'is_daylight': is_daylight,
    'coverage_percent': coverage_percent, 'low_sun': low_sun, 'avoids_barriers': avoids_barriers, 'labels': labels, 'reason_code': reason_code}}
    ORDER BY route_pos) AS routes FROM labelled GROUP BY request_id),
g1 AS (SELECT *, len(list_filter(routes, lambda s: s.is_daylight)) > 0 AND len(list_filter(routes, lambda s: s.is_daylight AND NOT (s.coverage_percent >= 90 AND NOT s.low_sun))) = 0 AS supported,
    list_filter(routes, lambda s: s.avoids_barriers) AS suitable FROM g0),
g2 AS (SELECT *, CASE WHEN len(suitable) > 0 THEN {_fold('suitable', FASTER)} END AS base FROM g1),
g3 AS (SELECT *, {PER.format('base')} AS base_s, greatest(30.0 * base.journey_count, base.sun_s * 0.05) AS gain_s FROM g2),
g4 AS (SELECT *, list_filter(list_filter(suitable, lambda s: {PER.format('s')} <= base_s + least(300.0, base_s * 0.2)),
    lambda s: s.route_id <> base.route_id AND base.sun_s - s.sun_s >= gain_s AND s.worst_s < base.best_s) AS alts FROM g3),
g5 AS (SELECT *, {_clear('alts')} AS clears FROM g4),
g6 AS (SELECT *, coalesce({_first('clears')}, CASE WHEN len(alts) > 0 THEN {_fold('alts', FASTER)} END, base) AS pick FROM g5),
g7 AS (SELECT *, unnest(routes) AS r FROM g6),
g8 AS (SELECT *, array_to_string(list_filter(string_split(r.labels, ','), lambda x: x <> 'recommended'), ',') AS plain,
    coalesce(supported AND step_free AND r.route_id = pick.route_id, false) AS chosen FROM g7)
SELECT r.route_id AS route_id, CASE WHEN supported AND NOT step_free THEN r.labels
    WHEN chosen THEN CASE WHEN plain = '' THEN 'recommended' ELSE 'recommended,' || plain END ELSE plain END AS labels,
  CASE WHEN supported AND NOT step_free THEN r.reason_code WHEN chosen THEN CASE WHEN pick.route_id = base.route_id THEN 'access-fastest'
    WHEN len(alts) > 1 AND len(clears) = 0 THEN 'access-several-lower' ELSE 'access-lower-sun' END END AS reason_code FROM g8""")
def access_guard(src: Source) -> DataFrame:
    scores = src.view("schedules")
    labelled = labels.label_routes(scores, extra=EXTRA).withColumn("step_free", F.col("request_id") % 3 == 1)
    out = labels.apply_access_guard(labelled)
    return out.select("route_id", F.array_join("labels", ",").alias("labels"), "reason_code")


@query("display_order", f"""{given('schedules')},{label_ctes()},
f AS (SELECT *, min(duration_s) OVER (PARTITION BY request_id) AS fastest_s,
  row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN labels LIKE 'recommended%' THEN 0 ELSE 1 END, route_pos) AS rk FROM labelled)
SELECT route_id, CAST(rk AS INT) AS display_rank, CASE WHEN duration_s - fastest_s <= 1 THEN 'same'
    WHEN floor(duration_s / 60 + 0.5) - floor(fastest_s / 60 + 0.5) > 0 THEN 'minutes' ELSE 'under-minute' END AS time_kind,
  CAST(CASE WHEN duration_s - fastest_s <= 1 THEN 0 ELSE greatest(0, floor(duration_s / 60 + 0.5) - floor(fastest_s / 60 + 0.5)) END AS BIGINT) AS shown_minutes
FROM f""")
def display_order(src: Source) -> DataFrame:
    out = labels.with_display_order(labels.label_routes(src.view("schedules")))
    return out.select("route_id", "display_rank", "time_kind", "shown_minutes")


@query("label_routes_footprint", f"""{given('schedules')},
f0 AS (SELECT request_id, profile, list({{'route_pos': route_pos, 'route_id': route_id, 'duration_s': duration_s, 'sun_s': sun_s}} ORDER BY route_pos) AS routes
  FROM schedules GROUP BY request_id, profile),
f1 AS (SELECT *, {_fold('routes', 's.duration_s < b.duration_s')} AS fastest,
  {_fold('routes', 's.sun_s < b.sun_s OR (s.sun_s = b.sun_s AND s.duration_s < b.duration_s)')} AS least FROM f0),
f2 AS (SELECT *, list_filter(routes, lambda s: s.duration_s <= fastest.duration_s + least(300.0, fastest.duration_s * 0.2) + 1e-9) AS eligible FROM f1),
f3 AS (SELECT *, {_fold('eligible', "CASE WHEN profile = 'worker' AND abs(s.sun_s - b.sun_s) < 30 THEN s.duration_s < b.duration_s ELSE s.sun_s < b.sun_s OR (s.sun_s = b.sun_s AND s.duration_s < b.duration_s) END")} AS pick FROM f2),
f4 AS (SELECT *, unnest(routes) AS r FROM f3)
SELECT r.route_id AS route_id, concat_ws(',', CASE WHEN r.route_id = pick.route_id THEN 'recommended' END,
  CASE WHEN r.route_id = least.route_id THEN 'least-sun' END, CASE WHEN r.route_id = fastest.route_id THEN 'fastest' END) AS labels FROM f4""")
def label_routes_footprint(src: Source) -> DataFrame:
    out = labels.label_routes_footprint(src.view("schedules"))
    return out.select("route_id", F.array_join("labels", ",").alias("labels"))


def slot_schedules(src: Source) -> DataFrame:
    """Nine departure slots per request, values shifting from slot to slot."""
    out = src.view("schedules").withColumn("offset_min", F.explode(F.array(*[F.lit(m) for m in advice.slot_minutes()])))
    moved = F.pmod(F.col("route_id") * 53 + F.col("offset_min") * 31, F.lit(400)).cast("double")
    return out.withColumns({
        "sun_s": moved, "best_s": F.greatest(F.lit(0.0), moved - F.col("route_id") * 7 % 40),
        "worst_s": moved + (F.col("route_id") * 11 + F.col("offset_min")) % 60,
        "is_daylight": F.col("is_daylight") & (F.col("offset_min") < 105)})


SLOT_CTES = f"""
slotted AS (SELECT * REPLACE (CAST((route_id * 53 + offset_min * 31) % 400 AS DOUBLE) AS sun_s), is_daylight AS base_day FROM (
    SELECT *, unnest(range(9)) * 15 AS offset_min FROM schedules)),
slots AS (SELECT * REPLACE (greatest(0.0, sun_s - route_id * 7 % 40) AS best_s, sun_s + (route_id * 11 + offset_min) % 60 AS worst_s,
    base_day AND offset_min < 105 AS is_daylight) FROM slotted),{label_ctes('slots', 'request_id, offset_min')},
choice AS (SELECT *, row_number() OVER (PARTITION BY request_id, offset_min ORDER BY CASE WHEN labels LIKE 'recommended%' THEN 0 ELSE 1 END, route_pos) AS rn FROM labelled),
options AS (SELECT request_id, offset_min, route_id, route_pos, duration_s / journey_count AS walk_s, sun_s / journey_count AS sun_s,
    best_s / journey_count AS best_s, worst_s / journey_count AS worst_s, is_daylight, coverage_percent, low_sun FROM choice WHERE rn = 1)"""


def _options(src: Source) -> DataFrame:
    labelled = labels.label_routes(slot_schedules(src), ["request_id", "offset_min"], ["coverage_percent", "low_sun"])
    return advice.departure_options(labelled)


@query("departure_options", f"""{given('schedules')},{SLOT_CTES}
SELECT request_id, CAST(offset_min AS INT) AS offset_min, route_id, {r6('walk_s')} AS walk_s, {r6('sun_s')} AS sun_s, {r6('best_s')} AS best_s,
  {r6('worst_s')} AS worst_s, is_daylight FROM options""")
def departure_options(src: Source) -> DataFrame:
    return _options(src).select(
        "request_id", "offset_min", "route_id", *[half_up(c, 6).alias(c) for c in ("walk_s", "sun_s", "best_s", "worst_s")], "is_daylight")


BETTER_SQL = """CASE WHEN s.sun_s - b.sun_s < -1e-6 THEN true WHEN s.sun_s - b.sun_s > 1e-6 THEN false
  WHEN s.worst_s - b.worst_s < -1e-6 THEN true WHEN s.worst_s - b.worst_s > 1e-6 THEN false
  WHEN s.walk_s - b.walk_s < -1e-6 THEN true WHEN s.walk_s - b.walk_s > 1e-6 THEN false
  WHEN s.offset_min <> b.offset_min THEN s.offset_min < b.offset_min ELSE s.route_pos < b.route_pos END"""


@query("departure_advice", f"""{given('schedules')},{SLOT_CTES},
a0 AS (SELECT request_id, list({{'offset_min': offset_min, 'route_pos': route_pos, 'route_id': route_id, 'walk_s': walk_s, 'sun_s': sun_s, 'best_s': best_s,
    'worst_s': worst_s, 'is_daylight': is_daylight, 'coverage_percent': coverage_percent, 'low_sun': low_sun}} ORDER BY offset_min) AS o FROM options GROUP BY request_id),
a1 AS (SELECT *, o[1] AS cur, list_filter(o, lambda x: NOT o[1].is_daylight OR x.is_daylight) AS open FROM a0),
a2 AS (SELECT *, {_fold('list_prepend(cur, open)', BETTER_SQL)} AS best FROM a1),
a3 AS (SELECT *, greatest(0, cur.sun_s - best.sun_s) AS saved_s FROM a2),
a4 AS (SELECT *, CASE WHEN NOT cur.is_daylight THEN 'no-daylight' WHEN least(cur.coverage_percent, best.coverage_percent) < 90 THEN 'low-model-coverage'
    WHEN saved_s + 1e-6 < greatest(60, cur.sun_s * 0.1) THEN 'insufficient-saving' WHEN cur.low_sun OR best.low_sun THEN 'low-sun-confidence'
    WHEN cur.best_s - best.worst_s <= 1e-6 THEN 'sensitivity-overlap' END AS withheld_reason FROM a3)
SELECT request_id, best.route_id AS route_id, CAST(best.offset_min AS INT) AS offset_min, {r6('best.sun_s')} AS sun_s, {r6('saved_s')} AS saved_s,
  {r6('greatest(0, best.walk_s - cur.walk_s)')} AS extra_walk_s, least(cur.coverage_percent, best.coverage_percent) AS coverage_percent,
  CASE WHEN withheld_reason IS NULL THEN 'moderate' WHEN withheld_reason IN ('no-daylight', 'low-model-coverage') THEN 'unavailable' ELSE 'limited' END AS confidence,
  withheld_reason, withheld_reason IS NULL AS recommended, CAST(len(o) AS INT) AS scanned FROM a4""")
def departure_advice(src: Source) -> DataFrame:
    out = advice.departure_advice(_options(src), min_coverage=90)
    return out.withColumns({c: half_up(c, 6) for c in ("sun_s", "saved_s", "extra_walk_s")})


# --- Profiles ---------------------------------------------------------------

RUN_CTES = f"""{given('sections', 'reported')},
p0 AS (SELECT s.route_id, s.seq, s.length_m, CASE WHEN exposure = 'haze' THEN 'unknown' ELSE exposure END AS exposure,
    greatest(sum(s.length_m) OVER (PARTITION BY s.route_id), r.distance_m) AS den FROM sections s JOIN reported r ON r.route_id = s.route_id),
p1 AS (SELECT route_id, seq, length_m, exposure, den FROM p0 UNION ALL
    SELECT route_id, max(seq) + 1, max(den) - sum(length_m), 'unknown', max(den) FROM p0 GROUP BY route_id HAVING max(den) - sum(length_m) > 0.01),
p2 AS (SELECT *, CASE WHEN lag(exposure) OVER w = exposure THEN 0 ELSE 1 END AS ch FROM p1 WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
p3 AS (SELECT *, sum(ch) OVER (PARTITION BY route_id ORDER BY seq) - 1 AS run FROM p2),
runs AS (SELECT route_id, run, exposure, max(den) AS den, sum(length_m) AS length_m FROM p3 GROUP BY route_id, run, exposure)"""


def _runs(src: Source) -> DataFrame:
    sections = src.view("sections").join(src.view("reported"), "route_id")
    return profile.exposure_runs(sections, ["route_id"], "seq", supplied="distance_m")


@query("exposure_profile", f"""{RUN_CTES}
SELECT route_id, CAST(run AS BIGINT) AS run, exposure, length_m, coalesce(sum(length_m) OVER (PARTITION BY route_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start_m,
  {r6('length_m / den * 100')} AS percent FROM runs""")
def exposure_profile(src: Source) -> DataFrame:
    return _runs(src).select("route_id", "run", "exposure", "length_m", "start_m", half_up("percent", 6).alias("percent"))


@query("profile_totals", f"""{RUN_CTES}
SELECT route_id, {', '.join(f"sum(CASE WHEN exposure = '{e}' THEN length_m ELSE 0.0 END) AS {e}_m, {r6(f'''sum(CASE WHEN exposure = '{e}' THEN length_m ELSE 0.0 END) / max(den) * 100''')} AS {e}_percent" for e in EXPOSURES)}
FROM runs GROUP BY route_id""")
def profile_totals(src: Source) -> DataFrame:
    out = profile.exposure_totals(_runs(src), ["route_id"])
    return out.select("route_id", *[f"{e}_m" for e in EXPOSURES], *[half_up(f"{e}_percent", 6).alias(f"{e}_percent") for e in EXPOSURES])


def _spans(src: Source) -> DataFrame:
    """Deliberately gappy, overlapping spans."""
    return src.view("sections").select(
        "route_id", "exposure", F.lit(ROUTE_M).alias("route_m"),
        (F.col("seq") * 40 + F.col("length_m") % 7).alias("start_m"), (F.col("seq") * 40 + F.col("length_m") + 8).alias("end_m"))


ROUTE_M = 600_000.0
SPAN_CTES = f"""{given('sections')},
q0 AS (SELECT route_id, seq, CASE WHEN exposure = 'haze' THEN 'unknown' ELSE exposure END AS exposure, least(600000.0, seq * 40 + length_m % 7) AS a,
    least(600000.0, seq * 40 + length_m + 8) AS b FROM sections),
q1 AS (SELECT *, coalesce(max(b) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cur FROM q0),
q2 AS (SELECT route_id, seq * 2 + 1 AS pos, exposure, greatest(a, cur) AS a, greatest(b, greatest(a, cur)) AS b FROM q1
  UNION ALL SELECT route_id, seq * 2, 'unknown', cur, a FROM q1 WHERE a > cur + 0.01
  UNION ALL SELECT route_id, max(seq) * 2 + 2, 'unknown', max(b), 600000.0 FROM q0 GROUP BY route_id),
q3 AS (SELECT * FROM q2 WHERE b - a > 0.01),
q4 AS (SELECT *, CASE WHEN lag(exposure) OVER w = exposure AND abs(lag(b) OVER w - a) <= 0.1 THEN 0 ELSE 1 END AS fresh FROM q3 WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
q5 AS (SELECT *, sum(fresh) OVER (PARTITION BY route_id ORDER BY pos) - 1 AS span_no FROM q4),
spans AS (SELECT route_id, CAST(span_no AS BIGINT) AS span_no, exposure, min(a) AS start_m, max(b) AS end_m FROM q5 GROUP BY route_id, span_no, exposure)"""


@query("complete_coverage", f"{SPAN_CTES} SELECT route_id, span_no, exposure, start_m, end_m FROM spans")
def complete_coverage(src: Source) -> DataFrame:
    return profile.complete_coverage(_spans(src), ["route_id"])


@query("upcoming_exposure", f"""{given('sections', 'positions')},{SPAN_CTES[len(given('sections')) + 1:]},
s0 AS (SELECT *, lag(end_m) OVER w AS before, lag(exposure) OVER w AS held, lead(span_no) OVER w IS NULL AS final FROM spans WINDOW w AS (PARTITION BY route_id ORDER BY span_no)),
s1 AS (SELECT *, lead(CASE WHEN held <> exposure THEN exposure END IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY span_no) AS later FROM s0),
spot AS (SELECT position_id, route_id, least(600000.0, distance_m) AS d FROM positions),
hits AS (SELECT a.position_id, s.exposure, s.end_m, s.later, s.span_no FROM spot a JOIN s1 s ON s.route_id = a.route_id
  WHERE (a.d < s.end_m - 0.01 AND (before IS NULL OR a.d >= before - 0.01)) OR (final AND a.d <= s.end_m + 0.01 AND a.d >= coalesce(before, 0) - 0.01))
SELECT a.position_id, CASE WHEN a.d >= 599999.99 THEN 'unknown' ELSE coalesce(n.exposure, 'unknown') END AS exposure,
  CASE WHEN a.d >= 599999.99 THEN 0.0 ELSE coalesce(n.end_m - a.d, 600000.0 - a.d) END AS exposure_left_m, CASE WHEN a.d < 599999.99 THEN n.later END AS next_exposure
FROM spot a LEFT JOIN hits n ON n.position_id = a.position_id""")
def upcoming_exposure(src: Source) -> DataFrame:
    spans = profile.complete_coverage(_spans(src), ["route_id"])
    positions = src.view("positions").select("position_id", "route_id", "distance_m", F.lit(ROUTE_M).alias("route_m"))
    return progress.upcoming_exposure(positions, spans).select("position_id", "exposure", "exposure_left_m", "next_exposure")


@query("shift_timeline", f"""{given('sections', 'routes')},
j AS (SELECT route_id, duration_s, request_id, unnest(range(journey_count)) AS journey FROM routes),
s0 AS (SELECT j.route_id, j.journey, s.seq, s.length_m, CASE WHEN (s.seq + j.journey) % 3 = 0 THEN 'sun' ELSE s.exposure END AS exposure FROM j JOIN sections s ON s.route_id = j.route_id),
s1 AS (SELECT *, sum(CASE WHEN exposure = 'sun' THEN 0 ELSE 1 END) OVER (PARTITION BY route_id, journey ORDER BY seq) AS blk FROM s0),
s2 AS (SELECT route_id, journey, blk, sum(CASE WHEN exposure = 'sun' THEN length_m ELSE 0.0 END) AS m FROM s1 GROUP BY route_id, journey, blk),
s3 AS (SELECT route_id, journey, max(m) AS longest_sun_m FROM s2 GROUP BY route_id, journey),
s4 AS (SELECT route_id, journey, sum(CASE WHEN exposure = 'sun' THEN length_m ELSE 0.0 END) AS sun_s, (route_id + journey) % 5 <> 0 AS is_daylight FROM s0 GROUP BY route_id, journey),
s5 AS (SELECT route_id, journey, row_number() OVER (PARTITION BY route_id ORDER BY sun_s DESC, journey) AS rn FROM s4 WHERE is_daylight)
SELECT s4.route_id, CAST(s4.journey AS INT) AS journey, s4.sun_s, s3.longest_sun_m, coalesce(s5.rn = 1, false) AS highest_sun
FROM s4 JOIN s3 ON s3.route_id = s4.route_id AND s3.journey = s4.journey LEFT JOIN s5 ON s5.route_id = s4.route_id AND s5.journey = s4.journey""")
def shift_timeline(src: Source) -> DataFrame:
    journeys = src.view("routes").withColumn("journey", F.explode(F.sequence(F.lit(0), F.col("journey_count") - 1)))
    sections = src.view("sections").join(journeys.select("route_id", "journey"), "route_id").withColumn(
        "exposure", F.when((F.col("seq") + F.col("journey")) % 3 == 0, "sun").otherwise(F.col("exposure")))
    keys = ["route_id", "journey"]
    sums = sections.groupBy(*keys).agg(F.sum(F.when(F.col("exposure") == "sun", F.col("length_m")).otherwise(0.0)).alias("sun_s"))
    sums = sums.withColumn("is_daylight", (F.col("route_id") + F.col("journey")) % 5 != 0)
    runs = profile.longest_sun_run(sections, keys, "seq")
    return profile.shift_timeline(sums.join(runs, keys)).select(*keys, "sun_s", "longest_sun_m", "highest_sun")


# --- Steps and positions ----------------------------------------------------

STEP_CTES = f"""{given('geo_vertices', 'directions', 'reported', 'positions')},
h0 AS (SELECT route_id, seq, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM geo_vertices WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
h1 AS (SELECT *, CASE WHEN plon IS NULL THEN 0.0 ELSE {haversine_sql('plat', 'plon', 'lat', 'lon')} END AS hop FROM h0),
v AS (SELECT route_id, seq, lon, lat, plon, plat, hop, sum(hop) OVER (PARTITION BY route_id ORDER BY seq) AS along, sum(hop) OVER (PARTITION BY route_id) AS total, count(*) OVER (PARTITION BY route_id) AS n FROM h1),
d0 AS (SELECT r.route_id, r.distance_m AS rm, r.duration_s AS rs, coalesce(dir_idx, 0) AS dir_idx, CASE WHEN dir_idx IS NULL THEN 'Continue to the destination.' WHEN trim(instruction) = '' THEN 'Continue.' ELSE instruction END AS instruction,
    begin_idx, end_idx, coalesce(CAST(d.distance_m AS DOUBLE), r.distance_m) AS sm, coalesce(CAST(d.duration_s AS DOUBLE), r.duration_s) AS ss
  FROM reported r LEFT JOIN directions d ON d.route_id = r.route_id),
d1 AS (SELECT d0.*, b.along AS fa, e.along AS ta, b.total, sum(sm) OVER p AS am, sum(ss) OVER p AS tot_s, coalesce(sum(sm) OVER u, 0.0) AS dm, coalesce(sum(ss) OVER u, 0.0) AS ds
  FROM d0 LEFT JOIN v b ON b.route_id = d0.route_id AND b.seq = d0.begin_idx AND b.n > 1 LEFT JOIN v e ON e.route_id = d0.route_id AND e.seq = d0.end_idx AND e.n > 1
  WINDOW p AS (PARTITION BY d0.route_id), u AS (PARTITION BY d0.route_id ORDER BY dir_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (SELECT *, coalesce(total > 0 AND fa IS NOT NULL AND ta IS NOT NULL AND end_idx >= begin_idx, false) AS ok FROM d1),
d3 AS (SELECT *, greatest(0.0, least(rm, CASE WHEN ok THEN fa / total * rm WHEN am > 0 THEN dm / am * rm WHEN dir_idx = 0 THEN 0.0 ELSE rm END)) AS start_m,
    CASE WHEN ok THEN ta / total * rm WHEN am > 0 THEN (dm + sm) / am * rm ELSE rm END AS e0 FROM d2),
d4 AS (SELECT *, greatest(0.0, least(rm, greatest(start_m, e0))) AS end_m FROM d3),
steps AS (SELECT *, CASE WHEN tot_s > 0 THEN ds / tot_s * rs ELSE start_m / rm * rs END AS start_s, CASE WHEN tot_s > 0 THEN (ds + ss) / tot_s * rs ELSE end_m / rm * rs END AS end_s FROM d4)"""


def _geo_segments(src: Source) -> DataFrame:
    return geometry.segments(src.view("geo_vertices"))


def _steps(src: Source) -> DataFrame:
    return progress.journey_steps(src.view("directions"), src.view("reported"), _geo_segments(src))


@query("journey_steps", f"""{STEP_CTES}
SELECT route_id, CAST(dir_idx AS INT) AS dir_idx, instruction, {r6('start_m')} AS start_m, {r6('end_m')} AS end_m, {r6('start_s')} AS start_s, {r6('least(rs, end_s)')} AS end_s FROM steps""")
def journey_steps(src: Source) -> DataFrame:
    return _steps(src).select("route_id", "dir_idx", "instruction", *[half_up(c, 6).alias(c) for c in ("start_m", "end_m", "start_s", "end_s")])


@query("journey_progress", f"""{STEP_CTES},
k AS (SELECT route_id, max(dir_idx) AS top FROM steps GROUP BY route_id),
a AS (SELECT p.position_id, p.route_id, least(p.active_idx, k.top) AS i FROM positions p JOIN k ON k.route_id = p.route_id)
SELECT position_id, CAST(i AS INT) AS active_idx, c.instruction, n.instruction AS next_instruction, {r6('c.rm - c.start_m')} AS remaining_m, {r6('c.rs - c.start_s')} AS remaining_s,
  c.rm - c.start_m <= 0.01 AND c.rs - c.start_s <= 0.01 AS complete
FROM a JOIN steps c ON c.route_id = a.route_id AND c.dir_idx = a.i LEFT JOIN steps n ON n.route_id = a.route_id AND n.dir_idx = a.i + 1""")
def journey_progress(src: Source) -> DataFrame:
    out = progress.journey_progress(src.view("positions").select("position_id", "route_id", "active_idx"), _steps(src))
    return out.select("position_id", "active_idx", "instruction", "next_instruction", half_up("remaining_m", 6).alias("remaining_m"),
                      half_up("remaining_s", 6).alias("remaining_s"), "complete")


@query("match_positions", f"""{STEP_CTES},
m0 AS (SELECT p.position_id, p.route_id, v.seq, v.along - v.hop AS sofar, v.hop, v.total, (plon - p.lon) * 111320.0 * cos(radians(p.lat)) AS ax, (plat - p.lat) * 110540.0 AS ay,
    (v.lon - p.lon) * 111320.0 * cos(radians(p.lat)) AS bx, (v.lat - p.lat) * 110540.0 AS by_ FROM positions p JOIN v ON v.route_id = p.route_id AND v.plon IS NOT NULL),
m1 AS (SELECT *, CASE WHEN (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) > 0 THEN greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) ELSE 0.0 END AS f FROM m0),
m2 AS (SELECT *, sqrt((ax + (bx - ax) * f) * (ax + (bx - ax) * f) + (ay + (by_ - ay) * f) * (ay + (by_ - ay) * f)) AS away FROM m1),
m3 AS (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY floor(away * 1e6), seq) AS rn FROM m2),
m4 AS (SELECT position_id, m3.route_id, away, CASE WHEN total > 0 THEN (sofar + hop * f) / total * r.distance_m ELSE 0.0 END AS along FROM m3 JOIN reported r ON r.route_id = m3.route_id WHERE rn = 1),
k AS (SELECT m4.position_id, min(s.dir_idx) AS hit FROM m4 JOIN steps s ON s.route_id = m4.route_id AND {r6('s.end_m')} > {r6('along')} + 0.01 GROUP BY m4.position_id),
n AS (SELECT route_id, count(*) AS many FROM steps GROUP BY route_id)
SELECT m4.position_id, {r6('away')} AS away_m, {r6('along')} AS along_m, CAST(coalesce(k.hit, n.many - 1) AS INT) AS step_idx
FROM m4 LEFT JOIN k ON k.position_id = m4.position_id LEFT JOIN n ON n.route_id = m4.route_id""")
def match_positions(src: Source) -> DataFrame:
    out = progress.match_positions(src.view("positions"), _geo_segments(src), src.view("reported"), _steps(src))
    return out.select("position_id", half_up("away_m", 6).alias("away_m"), half_up("along_m", 6).alias("along_m"), F.col("step_idx").cast("int").alias("step_idx"))
