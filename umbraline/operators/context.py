"""Amenities near routes, works, forecasts, freshness, alerts, stations, places, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.basics import clamp, half_up, holds, is_finite
from ..functions.geo import ROUTE_RADIUS_M, haversine_m
from ..functions.lookups import CATEGORIES, SUBTYPE_CATEGORY, TREE_LOCATIONS

# Fixed values.
RADIUS_M, RADIUS_RANGE, LIMIT, LIMIT_RANGE = 250.0, (10.0, 2_000.0), 3, (1, 20)
LISTED, LOOKAHEAD_MS = 12, 7 * 86_400_000
DEGREE_M = 111_320.0
# Bins no finer than a usual segment: a small radius must not list it many times over.
MIN_BIN_M = 60.0
# Bins of 1, 2, 4 ... times that width: a box is listed in the widest ones it needs to touch four at most, a longer one in more.
WIDTHS = 4
GRAM = 3  # characters by which a place query finds its candidates


def bounded_option(value: float | None, fallback: float, low: float, high: float) -> float:
    return fallback if value is None else max(low, min(high, int(value)))


def round_up_10(metres: Column) -> Column:
    """Up to the next ten metres; nothing at or below zero."""
    return F.when(metres > 0, F.ceil(metres / 10) * 10).otherwise(0).cast("double")


def _offsets(metric: str) -> tuple[Column, Column, Column, Column]:
    """Segment start and span in metres relative to the point px, py."""
    if metric == "haversine":
        mid = F.radians((F.col("py") + F.col("y1") + F.col("y2")) / 3)
        kx, ky = F.lit(ROUTE_RADIUS_M) * F.cos(mid) * F.radians(F.lit(1.0)), F.lit(ROUTE_RADIUS_M) * F.radians(F.lit(1.0))
    else:
        kx = ky = F.lit(1.0)
    ax, ay = (F.col("x1") - F.col("px")) * kx, (F.col("y1") - F.col("py")) * ky
    return ax, ay, (F.col("x2") - F.col("x1")) * kx, (F.col("y2") - F.col("y1")) * ky


def in_bins(segs: DataFrame, grow_x: Column, grow_y: Column, size_x: float, size_y: float) -> DataFrame:
    """Segments in the bins (_level, _bx, _by) that their grown boxes touch. The level is that of the first width which
    reaches across the box, so four bins hold it, unless it is longer than the widest."""
    box = {"_x0": F.least("x1", "x2") - grow_x, "_x1": F.greatest("x1", "x2") + grow_x, "_y0": F.least("y1", "y2") - grow_y, "_y1": F.greatest("y1", "y2") + grow_y}
    extent = F.greatest((F.col("_x1") - F.col("_x0")) / size_x, (F.col("_y1") - F.col("_y0")) / size_y)
    level = F.lit(WIDTHS - 1)
    for k in reversed(range(WIDTHS - 1)):
        level = F.when(extent <= 2 ** k, k).otherwise(level)
    wide = F.expr("shiftleft(1, _level)")
    bins = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(a) / (wide * size)).cast("int"), F.floor(F.col(b) / (wide * size)).cast("int")))
    listed = segs.withColumns(box).withColumn("_level", level)
    return listed.withColumn("_bx", bins("_x0", "_x1", size_x)).withColumn("_by", bins("_y0", "_y1", size_y)).drop(*box)


def nearby_features(segs: DataFrame, features: DataFrame, radius_m: float | None = None, metric: str = "haversine",
                    key: str = "route_id") -> DataFrame:
    """(route, feature) pairs within the radius, with distance, return detour and progress.

    ``segs`` needs area_id.  Joined on area and bin: a segment is listed in the
    bins its radius-grown box touches, of a width that follows the box, and a
    feature asks its own bin of every width.
    """
    radius = bounded_option(radius_m, RADIUS_M, *RADIUS_RANGE)
    points = features.withColumnsRenamed({"x": "px", "y": "py"}) if "px" not in features.columns else features
    if metric == "haversine":
        reach = radius / DEGREE_M
        grow_x = F.lit(reach) / F.greatest(F.lit(0.1), F.cos(F.radians(F.greatest(F.abs("y1"), F.abs("y2")) + reach)))
        # Degrees of longitude are the shorter ones, so a bin is wider in them.
        grow_y, size_y = F.lit(reach * 1.01), max(radius, MIN_BIN_M) / DEGREE_M
        size_x = size_y * 1.6
    else:
        grow_x = grow_y = F.lit(radius)
        size_x = size_y = max(radius, MIN_BIN_M)
    listed = in_bins(segs, grow_x, grow_y, size_x, size_y)
    wide = F.expr("shiftleft(1, _level)")
    asked = points.withColumn("_level", F.explode(F.array(*(F.lit(k) for k in range(WIDTHS)))))
    asked = asked.withColumns({"_bx": F.floor(F.col("px") / (wide * size_x)).cast("int"), "_by": F.floor(F.col("py") / (wide * size_y)).cast("int")})
    met = listed.join(asked, ["area_id", "_level", "_bx", "_by"])
    ax, ay, dx, dy = _offsets(metric)
    dot, square = ax * dx + ay * dy, dx * dx + dy * dy
    # A zero span divides to null, which least() skips: any fraction of nothing is the start.
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-dot, square)))
    # A cheap planar test (with slack) is what reaches the join; the exact distance is only taken for what is left.
    met = met.filter(ax * ax + ay * ay + t * (2 * dot + t * square) <= (radius * 1.01) ** 2)
    met = met.withColumn("_f", F.when(square > 0, t).otherwise(0.0))
    cx, cy = F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("_f"), F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("_f")
    met = met.withColumns({"_cx": cx, "_cy": cy})
    if metric == "haversine":
        away = haversine_m("py", "px", "_cy", "_cx")
    else:
        away = F.sqrt((F.col("_cx") - F.col("px")) * (F.col("_cx") - F.col("px")) + (F.col("_cy") - F.col("py")) * (F.col("_cy") - F.col("py")))
    met = met.withColumn("_away", away)
    kept = [c for c in points.columns if c not in ("area_id", "px", "py")]
    # At equal distances the first segment wins, whatever the order of the rows.
    along = F.col("start_m") + F.col("length_m") * F.col("_f")
    best = met.groupBy(key, *kept).agg(F.min(F.struct(F.col("_away").alias("raw_m"), "seg_idx", along.alias("_along"))).alias("_b"), F.max("total_m").alias("_total"))
    best = best.select(key, *kept, "_b.raw_m", "_b._along", "_total")
    return best.filter(F.col("raw_m") <= radius).select(
        key, *kept, "raw_m", round_up_10(F.col("raw_m")).alias("distance_m"),
        round_up_10(F.col("raw_m") * 2).alias("return_detour_m"), round_up_10(F.col("_along")).alias("progress_m"),
        F.when(F.col("_total") > 0, clamp(F.col("_along") / F.col("_total") * 100, 0.0, 100.0)).otherwise(0.0).alias("progress_percent"))


def nearest_per_category(nearby: DataFrame, limit: int | None = None, key: str = "route_id", category: str = "category",
                         name: str = "name") -> DataFrame:
    """First features per route and category by exact distance, then name.

    Spark cuts each task's rows to the limit before the shuffle.
    """
    count = int(bounded_option(limit, LIMIT, *LIMIT_RANGE))
    order = W.partitionBy(key, category).orderBy("raw_m", name)
    return nearby.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def category_counts(nearby: DataFrame, routes: DataFrame, limit: int | None = None, key: str = "route_id",
                    category: str = "category", categories: list | None = None) -> DataFrame:
    """Matches shown and left out per route and category; every category present."""
    count = int(bounded_option(limit, LIMIT, *LIMIT_RANGE))
    names = categories or CATEGORIES
    found = nearby.groupBy(key, category).agg(F.count(F.lit(1)).alias("_n"))
    every = routes.select(key).distinct().withColumn(category, F.explode(F.array(*[F.lit(c) for c in names])))
    out = every.join(found, [key, category], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return out.select(key, category, F.least("_n", F.lit(count)).cast("bigint").alias("shown"),
                      F.greatest(F.lit(0), F.col("_n") - count).cast("bigint").alias("additional"))


def feature_problems(features: DataFrame, areas: DataFrame, buffered: str = "public-realm-trees") -> DataFrame:
    """Features with the rules they break.  ``areas`` has the box and the buffered box (b_west ...), and
    ``not_collected`` categories; ids and source ids must be unique within the area."""
    table = F.create_map(*[part for k, v in SUBTYPE_CATEGORY.items() for part in (F.lit(k), F.lit(v))])
    repeats = lambda col_: features.groupBy("area_id", *col_).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    twice = repeats(["feature_id"]).withColumn("_dup_id", F.lit(True))
    source_twice = repeats(["source_kind", "source_id"]).withColumn("_dup_source", F.lit(True))
    j = features.join(areas, "area_id", "left").join(twice, ["area_id", "feature_id"], "left").join(source_twice, ["area_id", "source_kind", "source_id"], "left")
    wide = F.col("source_kind") == buffered
    inside = lambda p: F.col("lon").between(F.col(f"{p}west"), F.col(f"{p}east")) & F.col("lat").between(F.col(f"{p}south"), F.col(f"{p}north"))
    rules = [
        ("name", F.length(F.trim("name")).between(1, 240)), ("subtype", F.try_element_at(table, F.col("subtype")) == F.col("category")),
        ("source", F.col("source_id") > 0), ("position", is_finite("lon") & is_finite("lat") & F.when(wide, inside("b_")).otherwise(inside(""))),
        ("repeated-id", F.col("_dup_id").isNull()), ("repeated-source", F.col("_dup_source").isNull()),
        ("not-collected", ~F.array_contains("not_collected", F.col("category")))]
    broken = F.filter(F.array(*[F.when(~holds(ok), name) for name, ok in rules]), lambda r: r.isNotNull())
    return j.withColumn("problems", broken).select(*features.columns, "problems")


# --- Feeds -------------------------------------------------------------------

def works_in_window(works: DataFrame, now: DataFrame) -> DataFrame:
    """Works that overlap the seven days from their area's ``now``, both ends inclusive."""
    until = F.timestamp_add("MILLISECOND", F.lit(LOOKAHEAD_MS), F.col("now"))
    j = works.join(now.select("area_id", "now"), "area_id")
    return j.filter((F.col("starts_at") <= F.col("ends_at")) & (F.col("ends_at") >= F.col("now")) & (F.col("starts_at") <= until)).drop("now")


def first_listed(rows: DataFrame, key: str, order: str, limit: int = LISTED) -> DataFrame:
    """First rows of each key in payload order (a display limit)."""
    line = W.partitionBy(key).orderBy(order)
    return rows.withColumn("position", F.row_number().over(line)).filter(F.col("position") <= limit)


def works_summary(valid: DataFrame, areas: DataFrame) -> DataFrame:
    """Count, latest update and whether the list is longer than shown, per area."""
    counted = valid.groupBy("area_id").agg(F.count(F.lit(1)).alias("records"), F.max("updated_at").alias("updated_at"))
    out = areas.select("area_id").join(counted, "area_id", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return out.withColumn("limited", F.col("records") > LISTED)


def next_forecast(forecasts: DataFrame, asked: DataFrame, key: str = "area_id") -> DataFrame:
    """The first forecast at or after ``now``, otherwise the latest one before it.

    ``asked`` is keyed by area; plain extreme aggregates, combined before the shuffle.
    """
    fields = [c for c in forecasts.columns if c not in (key, "forecast_at")]
    j = forecasts.join(asked.select(key, "now"), key).withColumn("_row", F.struct("forecast_at", *fields))
    ahead = F.col("forecast_at") >= F.col("now")
    best = j.groupBy(key).agg(F.min(F.when(ahead, F.col("_row"))).alias("_next"), F.max(F.when(~ahead, F.col("_row"))).alias("_last"))
    return best.select(key, F.coalesce("_next", "_last").alias("f")).select(key, "f.*")


def feed_freshness(requests: DataFrame, attempts: DataFrame, fresh_ms: int = 300_000, stale_ms: int = 1_800_000) -> DataFrame:
    """available / stale / unavailable per request, from the log of refresh attempts.

    requests: request_id, feed, at_ms; attempts: feed, at_ms, ok.  Only the last
    good attempt younger than the stale limit matters, so time is cut into
    buckets of that length and each attempt is copied to the next bucket: one
    busy feed spreads over its buckets, and equal milliseconds collapse first.
    """
    bucket = F.floor(F.col("at_ms") / stale_ms)
    good = attempts.filter("ok").select("feed", "at_ms").distinct().withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    times = requests.select("feed", "at_ms").distinct().withColumn("bucket", bucket)
    marks = good.select("feed", "bucket", "at_ms", F.col("at_ms").alias("good_ms"), F.lit(0).alias("kind")).unionByName(
        times.select("feed", "bucket", "at_ms", F.lit(None).cast("bigint").alias("good_ms"), F.lit(1).alias("kind")))
    line = W.partitionBy("feed", "bucket").orderBy("at_ms", "kind").rowsBetween(W.unboundedPreceding, 0)
    seen = marks.withColumn("good_ms", F.last("good_ms", ignorenulls=True).over(line)).filter(F.col("kind") == 1).select("feed", "at_ms", "good_ms")
    age = F.col("at_ms") - F.col("good_ms")
    state = F.when(age < fresh_ms, "available").when(age < stale_ms, "stale").otherwise("unavailable")
    return requests.join(seen, ["feed", "at_ms"]).withColumns({"state": state, "age_ms": F.when(age < stale_ms, age)}).drop("good_ms")


def latest_heat_metric(metrics: DataFrame, pages: DataFrame, region: str = "region") -> DataFrame:
    """Latest valid score per region; an empty documented page means no alert, anything else unavailable.

    ``pages``: region, empty_page.  On equal dates the first record in payload order counts.
    """
    valid = metrics.filter(F.col("metric_value").between(1, 16))
    best = valid.groupBy(region).agg(F.max(F.struct("date", (-F.col("payload_pos")).alias("_first"), "metric_value")).alias("b"))
    out = pages.join(best, region, "left")
    return out.select(
        region, F.when(F.col("empty_page"), "no_active_alert").when(F.col("b").isNotNull(), "available").otherwise("unavailable").alias("status"),
        F.when(~F.col("empty_page"), F.col("b.metric_value")).alias("risk_score"), F.when(~F.col("empty_page"), F.col("b.date")).alias("as_of"))


def station_issues(issues: DataFrame, limit: int = LISTED) -> DataFrame:
    """Distinct issues per station by kind and lower-case summary, first twelve in payload order.

    Repeats collapse before the ranking, so a flooded feed stays small.
    """
    unique = issues.groupBy("station", "kind", F.lower("summary").alias("_s")).agg(F.min(F.struct("payload_pos", "summary")).alias("b"))
    flat = unique.select("station", "kind", F.col("b.payload_pos").alias("payload_pos"), F.col("b.summary").alias("summary"))
    return first_listed(flat, "station", "payload_pos", limit)


# --- Places and trees ---------------------------------------------------------

def distinct_places(places: DataFrame, key: list[str] | None = None) -> DataFrame:
    """First place per lower-case name and position to five decimals, in payload order."""
    scope = key or []
    fields = [c for c in places.columns if c not in (*scope, "payload_pos")]
    near = [half_up(F.col(c), 5).alias(f"_{c}") for c in ("lon", "lat")]
    first = places.groupBy(*scope, F.lower("name").alias("_n"), *near).agg(F.min(F.struct("payload_pos", *fields)).alias("b"))
    return first.select(*scope, "b.*")


def _runs(text: str, size: int) -> Column:
    """Every run of ``size`` characters of a text column; none where the text is shorter."""
    return F.expr(f"CASE WHEN length({text}) >= {size} THEN transform(sequence(1, length({text}) - {size - 1}), i -> substring({text}, i, {size})) ELSE array() END")


def rarest_runs(postings: DataFrame, needles: DataFrame) -> DataFrame:
    """(_asked, area_id, _gram) with the run of each text that the fewest places of its area hold.

    ``postings``: area_id, _gram per place; ``needles``: _asked (area_id, text).
    A text with a run that no place holds is left out.  Texts shorter than a run
    ask with themselves.  Counts combine before the shuffle.
    """
    short = F.length("_asked.text") < GRAM
    flat = needles.select("_asked", F.col("_asked.area_id").alias("area_id"), F.col("_asked.text").alias("_text"))
    flat = flat.select("_asked", "area_id", F.explode(F.when(short, F.array("_text")).otherwise(F.array_distinct(_runs("_text", GRAM)))).alias("_gram"))
    sizes = postings.groupBy("area_id", "_gram").agg(F.count(F.lit(1)).alias("_size"))
    best = flat.join(sizes, ["area_id", "_gram"], "left").groupBy("_asked").agg(F.min(F.struct(F.coalesce("_size", F.lit(0)).alias("n"), "_gram")).alias("b"))
    return best.filter("b.n > 0").select("_asked", F.col("_asked.area_id").alias("area_id"), F.col("b._gram").alias("_gram"))


def search_places(places: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """Places whose name and kind contain the query text; the first eight distinct ones per query.

    ``queries``: query_id, area_id, text (already normalised).  A place answers
    to every run of up to three of its characters; a query asks with the one of
    its own that is rarest in its area, so a word that every street carries does
    not bring all streets to all queries.
    """
    hay = places.withColumn("_hay", F.lower(F.concat("name", F.lit(" "), "kind"))).filter(F.col("_hay").isNotNull())
    keyed = hay.withColumn("_gram", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[_runs("_hay", n) for n in (1, 2, GRAM)]))))
    asked = queries.select("query_id", F.struct("area_id", F.lower("text").alias("text")).alias("_asked"))
    # Equal texts of an area are looked up once, however often they are asked.
    needles = rarest_runs(keyed.select("area_id", "_gram"), asked.select("_asked").distinct())
    met = keyed.join(needles, ["area_id", "_gram"]).filter(F.col("_hay").contains(F.col("_asked.text"))).drop("_hay", "_gram")
    return asked.join(first_listed(distinct_places(met, ["_asked"]), "_asked", "payload_pos", limit), "_asked").drop("_asked")


def tree_checks() -> list[tuple[str, Column]]:
    return [
        ("uniqueid", holds(F.col("uniqueid").rlike(r"^[1-9]\d{0,15}$"))),
        ("latitude", holds(F.col("lat").try_cast("double").between(-90, 90))), ("longitude", holds(F.col("lon").try_cast("double").between(-180, 180))),
        ("location", holds(F.col("location").isin(*TREE_LOCATIONS)))]


def trees_by_area(trees: DataFrame, areas: DataFrame) -> DataFrame:
    """Street trees inside each buffered area box (b_west ...), typed and keyed by area.

    Boxes meet trees on half-degree bins rather than by a bare range join.
    """
    street = trees.filter(F.col("location") == "Highways").withColumns({
        "tree_id": F.col("uniqueid").cast("bigint"), "lon": F.col("lon").cast("double"), "lat": F.col("lat").cast("double")})
    size = 0.5
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor(F.col(b) / size).cast("int")))
    boxes = areas.withColumn("_bx", bins("b_west", "b_east")).withColumn("_by", bins("b_south", "b_north"))
    placed = street.withColumns({"_bx": F.floor(F.col("lon") / size).cast("int"), "_by": F.floor(F.col("lat") / size).cast("int")})
    j = placed.join(boxes, ["_bx", "_by"])
    return j.filter(F.col("lon").between(F.col("b_west"), F.col("b_east")) & F.col("lat").between(F.col("b_south"), F.col("b_north"))).drop("_bx", "_by")


def tree_extract_counts(extract: DataFrame, max_trees: int | None) -> DataFrame:
    """Trees and repeated ids per area, and whether the extract may be used: no id twice, and no more than the caller's limit if there is one."""
    per_id = extract.groupBy("area_id", "tree_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_id.groupBy("area_id").agg(F.sum("_n").alias("trees"), F.sum((F.col("_n") > 1).cast("int")).cast("bigint").alias("repeated_ids")).withColumn(
        "usable", (F.lit(True) if max_trees is None else F.col("trees") <= max_trees) & (F.col("repeated_ids") == 0))


def replace_generated(features: DataFrame, generated: DataFrame, source_kind: str) -> DataFrame:
    """Context features with the rows of one generated source replaced."""
    return features.filter(F.col("source_kind") != source_kind).unionByName(generated)


def extract_drift(stored: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Rows present on one side only, marked missing or unexpected; empty when nothing drifted."""
    gone = stored.exceptAll(regenerated).withColumn("drift", F.lit("missing"))
    return gone.unionByName(regenerated.exceptAll(stored).withColumn("drift", F.lit("unexpected")))


def first_by_id(rows: DataFrame, key: str = "id", order: str = "ingest_pos") -> DataFrame:
    """First row per id in ingest order."""
    fields = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min(F.struct(order, *fields)).alias("b")).select(key, "b.*")


def missing_members(present: DataFrame, required: DataFrame, key: list[str]) -> DataFrame:
    """Required combinations without a row."""
    return required.join(present.select(*key).distinct(), key, "left_anti")
