"""Routes from a router's trips: decoding, validation, duplicates, access, names, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.basics import half_up, holds, is_finite
from ..functions.geo import haversine_m
from ..session import cut_lineage
from .geometry import DUPLICATE_SAMPLES, resample, reverse_routes, segments, span_m

# Fixed values.
MAX_POINTS = 10_000  # vertices of a walkable shape
MAX_TRIP_M, MAX_TRIP_S = 10_000.0, 14_400.0
MAX_DIRECTIONS, MAX_TEXT, MAX_TRAVEL_TYPE = 512, 500, 40
END_TOLERANCE_M, LENGTH_SLACK_M, LENGTH_SLACK = 100.0, 100.0, 0.15
MEAN_APART_M, P90_APART_M, MAX_APART_M = 10.0, 20.0, 35.0
KEEP_ROUTES, MIN_TRIP_APART_M, ENDPOINT_MATCH_M = 3, 20.0, 4.0
# Words that name a barrier or a crossing, and street names to skip.
STAIRS, ESCALATOR = r"\bstair(?:s|way)?\b", r"\bescalator\b"
UNDERGROUND = r"level\s*-\d|underground|subway|tunnel|below ground"
CROSSING = r"(?i)cross(?:ing|walk)|traffic signal|zebra"
STREET, NOT_A_STREET = r"(?i)(?:onto|on) ([^.]*)", r"(?i)walkway|crosswalk|ramp"
ORDINALS = ["Route one", "Route two", "Route three"]


def trip_checks() -> list[tuple[str, Column]]:
    """Exactly one leg; length (km) and time (s) positive, bounded, and not rounding to zero."""
    metres = F.col("length_km") * 1000
    return [
        ("length", holds((F.col("length_km") > 0) & (half_up(metres) > 0) & (metres <= MAX_TRIP_M)) & is_finite("length_km")),
        ("time", holds((F.col("time_s") > 0) & (half_up("time_s") > 0) & (F.col("time_s") <= MAX_TRIP_S)) & is_finite("time_s")),
        ("legs", holds(F.col("legs") == 1)),
        ("shape", holds(F.length("shape") > 0)),
    ]


def decode_shapes(trips: DataFrame, key: str = "route_id", shape: str = "shape", digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Encoded polylines as vertices (key, seq, lon, lat), and the keys that do not decode.

    A value is a run of continuation characters and one closing character, so a
    pattern splits the text in one pass; the running sums are a window over one
    route, which has at most 10,000 points.
    """
    # The two character ranges of the encoding, 63..94 closing and 95..126 continuing.
    values = F.regexp_extract_all(shape, F.lit(r"([_-~]*[?-^])"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform("_v", lambda v: F.length(v))), F.lit(0))
    split = trips.select(key, F.col(shape).alias("_shape"), values.alias("_v"))
    whole = F.length(F.array_join("_v", "")) == F.length("_shape")
    sized = (F.size("_v") % 2 == 0) & (F.size("_v") <= 2 * MAX_POINTS) & (longest <= 7)
    split = split.withColumn("_ok", holds(whole & sized))
    flat = split.filter("_ok").select(key, F.posexplode("_v").alias("_pos", "_text"))
    code = lambda i: F.when(F.length("_text") >= i, F.ascii(F.substring("_text", i, 1)) - 63).otherwise(0).bitwiseAND(F.lit(31))
    raw = F.lit(0)
    for i in range(1, 8):
        raw = raw.bitwiseOR(F.shiftleft(code(i).cast("int"), 5 * (i - 1)))
    half = F.shiftright(F.col("_raw"), 1)
    step = F.when(F.col("_raw").bitwiseAND(F.lit(1)) == 1, F.bitwise_not(half)).otherwise(half)
    flat = flat.withColumn("_raw", raw.cast("int")).withColumn("_step", step.cast("bigint"))
    pairs = flat.groupBy(key, F.floor(F.col("_pos") / 2).cast("int").alias("seq")).agg(
        F.max(F.when(F.col("_pos") % 2 == 0, F.col("_step"))).alias("_dlat"), F.max(F.when(F.col("_pos") % 2 == 1, F.col("_step"))).alias("_dlon"))
    so_far = W.partitionBy(key).orderBy("seq")
    factor = float(10**digits)
    points = pairs.select(key, "seq", (F.sum("_dlon").over(so_far) / factor).alias("lon"), (F.sum("_dlat").over(so_far) / factor).alias("lat"))
    outside = points.filter((F.abs("lon") > 180) | (F.abs("lat") > 90)).select(key).distinct()
    bad = split.filter(~F.col("_ok")).select(key).unionByName(outside)
    return points.join(outside, key, "left_anti"), bad


def project_directions(maneuvers: DataFrame, points: DataFrame, key: str = "route_id") -> tuple[DataFrame, DataFrame]:
    """(directions of routes whose manoeuvres are all sound, keys of the dropped routes).

    ``maneuvers``: dir_idx, instruction, length_km, time_s, begin_idx, end_idx,
    rough, travel_type.  ``points`` has the vertex count per route.
    """
    text = F.trim(F.coalesce("instruction", F.lit("")))
    joined = maneuvers.join(points.select(key, "points"), key, "left")
    whole = lambda c: F.col(c) == F.floor(c)
    sound = holds(
        whole("begin_idx") & whole("end_idx") & (F.col("begin_idx") >= 0) & (F.col("end_idx") >= F.col("begin_idx")) & (F.col("end_idx") < F.col("points"))
        & (F.col("length_km") >= 0) & (F.col("time_s") >= 0) & (F.length(text) <= MAX_TEXT)) & is_finite("length_km") & is_finite("time_s")
    judged = joined.withColumn("_sound", sound)
    bad = judged.groupBy(key).agg(F.min(F.col("_sound").cast("int")).alias("_all"), F.count(F.lit(1)).alias("_n")).filter(
        (F.col("_all") == 0) | (F.col("_n") > MAX_DIRECTIONS)).select(key)
    good = judged.join(bad, key, "left_anti").select(
        key, "dir_idx", F.when(text == "", "Continue").otherwise(text).alias("instruction"),
        half_up(F.col("length_km") * 1000).cast("bigint").alias("distance_m"), half_up("time_s").cast("bigint").alias("duration_s"),
        F.col("begin_idx").cast("int").alias("begin_idx"), F.col("end_idx").cast("int").alias("end_idx"),
        F.coalesce("rough", F.lit(False)).alias("rough"), F.substring("travel_type", 1, MAX_TRAVEL_TYPE).alias("travel_type"))
    return good, bad


def route_problems(routes: DataFrame, vertices: DataFrame, areas: DataFrame, key: str = "route_id", metric: str = "haversine",
                   x: str = "lon", y: str = "lat") -> DataFrame:
    """Routes with the names of the rules they break (empty array when valid).

    ``routes``: area_id, distance_m, duration_s, origin/destination as ox, oy,
    dx, dy.  ``areas``: west, south, east, north.  One window pass over the
    vertices, one aggregate per route.
    """
    order = W.partitionBy(key).orderBy("seq")
    hop = vertices.select(
        key, F.col("seq"), F.col(x).alias("x1"), F.col(y).alias("y1"), F.lead(x).over(order).alias("x2"), F.lead(y).over(order).alias("y2"))
    shape = hop.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"), F.coalesce(F.sum(span_m("x1", "y1", "x2", "y2", metric)), F.lit(0.0)).alias("geometry_m"),
        F.min_by(F.struct("x1", "y1"), "seq").alias("_a"), F.max_by(F.struct("x1", "y1"), "seq").alias("_b"),
        F.min("x1").alias("_w"), F.max("x1").alias("_e"), F.min("y1").alias("_s"), F.max("y1").alias("_n"))
    j = routes.join(shape, key, "left").join(areas.select("area_id", "west", "south", "east", "north"), "area_id", "left")
    j = j.withColumns({"_ax": F.col("_a.x1"), "_ay": F.col("_a.y1"), "_bx": F.col("_b.x1"), "_by": F.col("_b.y1")})
    inside = (F.col("_w") >= F.col("west")) & (F.col("_e") <= F.col("east")) & (F.col("_s") >= F.col("south")) & (F.col("_n") <= F.col("north"))
    near = lambda a, b, c, d: span_m(a, b, c, d, metric) <= END_TOLERANCE_M
    slack = F.greatest(F.lit(LENGTH_SLACK_M), F.col("distance_m") * LENGTH_SLACK)
    rules = [
        ("measures", (F.col("points") >= 2) & (F.col("distance_m") > 0) & (F.col("duration_s") > 0)),
        ("origin", near("_ax", "_ay", "ox", "oy")), ("destination", near("_bx", "_by", "dx", "dy")), ("outside-area", inside),
        ("length", F.abs(F.col("geometry_m") - F.col("distance_m")) <= slack)]
    broken = F.filter(F.array(*[F.when(~holds(ok), name) for name, ok in rules]), lambda r: r.isNotNull())
    return j.withColumn("problems", broken).drop("_a", "_b", "_w", "_e", "_s", "_n", "_ax", "_ay", "_bx", "_by")


def near_duplicates(vertices: DataFrame, routes: DataFrame, request: str = "request_id", x: str = "lon", y: str = "lat",
                    metric: str = "haversine") -> DataFrame:
    """Pairs of routes of one request that follow the same path.

    A request has at most eight candidates, so a route meets at most seven
    others.  End points settle the direction of comparison and most pairs; only
    the routes of pairs left over are resampled and compared point by point, as
    plain aggregates.  Segments are dealt out, points are not.
    """
    # Ends are plain aggregates of numbers, so only routes of pairs left over are cut into segments.  A route moves when its points differ.
    ends = vertices.groupBy("route_id").agg(
        *(fn(c, "seq").alias(f"_{n}{k}") for n, fn in (("h", F.min_by), ("t", F.max_by)) for k, c in (("x", x), ("y", y))),
        ((F.min(x) < F.max(x)) | (F.min(y) < F.max(y))).alias("_moves")).filter("_moves")
    ends = ends.select("route_id", *(F.struct(F.col(f"_{n}x").alias("x"), F.col(f"_{n}y").alias("y")).alias(name) for n, name in (("h", "head"), ("t", "tail"))))
    own = routes.select(request, "route_id", "route_pos").join(ends, "route_id")
    side = lambda p: own.select(request, *[F.col(c).alias(f"{p}_{n}") for c, n in (("route_id", "id"), ("route_pos", "pos"), ("head", "head"), ("tail", "tail"))])
    pairs = side("a").join(side("b"), request).filter(F.col("a_pos") < F.col("b_pos"))

    def apart(p: str, q: str) -> Column:
        return span_m(f"{p}.x", f"{p}.y", f"{q}.x", f"{q}.y", metric)

    pairs = pairs.withColumns({
        "_hh": apart("a_head", "b_head"), "_tt": apart("a_tail", "b_tail"), "_ht": apart("a_head", "b_tail"), "_th": apart("a_tail", "b_head")})
    pairs = pairs.withColumn("turned", F.col("_ht") + F.col("_th") < F.col("_hh") + F.col("_tt"))
    worst = F.when(F.col("turned"), F.greatest("_ht", "_th")).otherwise(F.greatest("_hh", "_tt"))
    # Few pairs are left and the branches below read them: written once rather than planned in every branch.
    pairs = cut_lineage(pairs.filter(worst <= MAX_APART_M).select(request, "a_id", "a_pos", "b_id", "b_pos", "turned"))
    wanted = pairs.select(F.col("a_id").alias("route_id")).unionByName(pairs.select(F.col("b_id").alias("route_id"))).distinct()
    segs = segments(vertices.join(wanted, "route_id", "left_semi"), x=x, y=y, metric=metric)
    # The segments of a chunk travel in one row to the pairs of their route; points are cut where both routes of a pair have met.
    carried = ["seg_idx", "x1", "y1", "x2", "y2", "length_m", "start_m", "last"]
    packed = segs.filter(F.col("total_m") > 0).groupBy("route_id", "chunk", "total_m").agg(F.collect_list(F.struct(*carried)).alias("segs"))
    pair = [request, "a_id", "a_pos", "b_id", "b_pos"]
    sides = pairs.select(*pair, F.col("a_id").alias("route_id"), F.lit(True).alias("_of_a"), F.col("turned").alias("_flip")).unionByName(
        pairs.select(*pair, F.col("b_id").alias("route_id"), F.lit(False).alias("_of_a"), F.lit(False).alias("_flip")))
    met = sides.join(packed, "route_id").repartition("a_id", "b_id")
    points = resample(met.select(*pair, "_of_a", "_flip", "total_m", F.explode("segs").alias("s")).select(*pair, "_of_a", "_flip", "total_m", "s.*"),
                      key=[*pair, "_of_a", "_flip"])
    last = DUPLICATE_SAMPLES - 1
    of = lambda a, c: F.max(F.when(F.col("_of_a") == a, F.col(c)))
    many = lambda a: F.count(F.when(F.col("_of_a") == a, True))
    lined = points.withColumn("k", F.when(F.col("_flip"), last - F.col("sample_no")).otherwise(F.col("sample_no"))).groupBy(*pair, "k").agg(
        of(True, "x").alias("_ax"), of(True, "y").alias("_ay"), of(False, "x").alias("_bx"), of(False, "y").alias("_by"), (many(True) * many(False)).alias("_met"))
    gaps = lined.filter(F.col("_met") > 0).select(*pair, "_met", span_m("_ax", "_ay", "_bx", "_by", metric).alias("gap"))
    # The 37th of 41 ordered gaps is the ninetieth percentile: at least 37 must be small enough.
    needed = -(-DUPLICATE_SAMPLES * 9 // 10)
    found = gaps.groupBy(*pair).agg(
        F.sum("_met").alias("_n"), F.avg("gap").alias("mean_m"), F.max("gap").alias("max_m"),
        F.sum(F.when(F.col("gap") <= P90_APART_M, 1).otherwise(0)).alias("close_points"))
    return found.filter(
        (F.col("_n") == DUPLICATE_SAMPLES) & (F.col("mean_m") <= MEAN_APART_M) & (F.col("close_points") >= needed) & (F.col("max_m") <= MAX_APART_M)).drop("_n")


def distinct_routes(routes: DataFrame, duplicates: DataFrame, request: str = "request_id", limit: int = KEEP_ROUTES) -> DataFrame:
    """First routes of each request that copy no route kept before them, in source order."""
    twins = duplicates.groupBy(request, F.col("b_pos").alias("route_pos")).agg(F.collect_set("a_pos").alias("twins"))
    listed = routes.select(request, "route_id", "route_pos").join(twins, [request, "route_pos"], "left")
    packed = listed.groupBy(request).agg(F.array_sort(F.collect_list(F.struct(
        "route_pos", "route_id", F.coalesce("twins", F.array().cast("array<int>")).alias("twins")))).alias("all"))
    kept = F.aggregate(
        "all", F.array().cast("array<int>"),
        lambda kept, r: F.when((F.size(kept) < limit) & ~F.arrays_overlap(kept, r["twins"]), F.concat(kept, F.array(r["route_pos"]))).otherwise(kept))
    out = packed.withColumn("kept", kept).withColumn("r", F.explode("all"))
    return out.filter(F.array_contains("kept", F.col("r.route_pos"))).select(
        request, F.col("r.route_id").alias("route_id"), F.array_position("kept", F.col("r.route_pos")).cast("int").alias("position"))


def access_summary(routes: DataFrame, directions: DataFrame, key: str = "route_id") -> DataFrame:
    """Known barriers and evidence per route, from its directions and access text."""
    low = F.lower(F.coalesce("instruction", F.lit("")))
    any_of = lambda ok: F.max(ok)
    seen = directions.groupBy(key).agg(
        any_of(low.rlike(STAIRS)).alias("_stairs"), any_of(low.rlike(ESCALATOR)).alias("_escalator"), any_of(low.rlike(UNDERGROUND)).alias("_under"),
        any_of(F.col("instruction").rlike(CROSSING)).alias("_crossing"), any_of(F.coalesce("rough", F.lit(False))).alias("_rough"),
        any_of(F.trim(low) != "").alias("_text"))
    text = F.lower(F.coalesce(F.col("access_reference"), F.lit(""))) if "access_reference" in routes.columns else F.lit("")
    j = routes.join(seen, key, "left").withColumn("_ref", text)
    flag = lambda c, pattern: F.coalesce(F.col(c), F.lit(False)) | F.col("_ref").rlike(pattern)
    none = F.col("_text").isNull()
    j = j.withColumns({
        "has_stairs": flag("_stairs", STAIRS), "has_escalator": flag("_escalator", ESCALATOR), "has_underground": flag("_under", UNDERGROUND),
        "has_evidence": F.coalesce(F.col("_text"), F.lit(False)) | (F.trim("_ref") != ""),
        "crossing_evidence": F.when(none, "unavailable").when(F.col("_crossing"), "mapped").otherwise("not-mentioned"),
        "surface_evidence": F.when(none, "unavailable").when(F.col("_rough"), "rough-flag").otherwise("not-flagged")})
    return j.withColumn("avoids_barriers", F.col("has_evidence") & ~F.col("has_stairs") & ~F.col("has_escalator")).drop(
        "_stairs", "_escalator", "_under", "_crossing", "_rough", "_text", "_ref")


def route_names(routes: DataFrame, directions: DataFrame, key: str = "route_id") -> DataFrame:
    """'Via' the first usable street named after on/onto, else the route's position in words."""
    street = F.trim(F.regexp_extract("instruction", STREET, 1))
    usable = directions.withColumn("_s", street).filter((F.col("_s") != "") & ~F.col("_s").rlike(NOT_A_STREET))
    first = usable.groupBy(key).agg(F.min_by("_s", "dir_idx").alias("_street"))
    words = F.coalesce(F.get(F.array(*[F.lit(o) for o in ORDINALS]), F.col("route_pos")), F.concat(F.lit("Route "), (F.col("route_pos") + 1).cast("string")))
    return routes.join(first, key, "left").withColumn(
        "route_name", F.coalesce(F.concat(F.lit("Via "), F.col("_street")), words)).drop("_street")


def request_checks() -> list[tuple[str, Column]]:
    """Endpoints finite, inside one area and at least 20 m apart; known preference and profile."""
    ends = ["olon", "olat", "dlon", "dlat"]
    finite = is_finite("olon") & is_finite("olat") & is_finite("dlon") & is_finite("dlat")
    inside = lambda lon, lat: holds(F.col(lon).between(F.col("west"), F.col("east")) & F.col(lat).between(F.col("south"), F.col("north")))
    return [
        ("finite", finite), ("area", inside(*ends[:2]) & inside(*ends[2:])),
        ("apart", holds(haversine_m("olat", "olon", "dlat", "dlon") >= MIN_TRIP_APART_M)),
        ("access", holds(F.col("access").isin("standard", "avoid-known-steps"))), ("profile", holds(F.col("profile").isin("vulnerable", "worker")))]


def match_stored_routes(requests: DataFrame, areas: DataFrame) -> DataFrame:
    """Direction in which a request repeats its area's stored trip: forward, reverse or null.

    Both ends must lie within 4 m of the area's start and destination.
    """
    j = requests.join(areas.select("area_id", "start_lon", "start_lat", "end_lon", "end_lat"), "area_id", "left")
    at = lambda lon, lat, plon, plat: holds(haversine_m(lat, lon, plat, plon) < ENDPOINT_MATCH_M)
    forward = at("olon", "olat", "start_lon", "start_lat") & at("dlon", "dlat", "end_lon", "end_lat")
    back = at("olon", "olat", "end_lon", "end_lat") & at("dlon", "dlat", "start_lon", "start_lat")
    return j.withColumn("stored_direction", F.when(forward, "forward").when(back, "reverse")).drop("start_lon", "start_lat", "end_lon", "end_lat")


def stored_routes(matched: DataFrame, routes: DataFrame) -> DataFrame:
    """The answer of every request that repeats a stored trip: its area's routes, reversed where the request is.

    ``matched`` comes from ``match_stored_routes``; ``routes`` has area_id, route_id
    (text), coordinates and directions.  Routes are turned round once per area,
    not once per request.
    """
    forward = routes.withColumn("access_reference", F.lit(None).cast("string"))
    both = forward.withColumn("stored_direction", F.lit("forward")).unionByName(reverse_routes(routes).withColumn("stored_direction", F.lit("reverse")))
    return matched.filter(F.col("stored_direction").isNotNull()).select("request_id", "area_id", "stored_direction").join(both, ["area_id", "stored_direction"])


def assign_areas(requests: DataFrame, areas: DataFrame, order: str = "area_pos", bin_deg: float = 0.05) -> DataFrame:
    """Requests with the first area whose closed box holds both ends (null when none does).

    ``areas``: area_id, west, south, east, north and their order.  Boxes meet
    origins on bins of a few kilometres.
    """
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / bin_deg), F.floor(F.col(high) / bin_deg)))
    boxes = areas.select(F.col("area_id").alias("_area"), F.col(order).alias("_order"), "west", "south", "east", "north")
    boxes = boxes.withColumn("_bx", bins("west", "east")).withColumn("_by", bins("south", "north"))
    asked = requests.select("request_id", "olon", "olat", "dlon", "dlat").withColumns({
        "_bx": F.floor(F.col("olon") / bin_deg), "_by": F.floor(F.col("olat") / bin_deg)})
    held = asked.join(boxes, ["_bx", "_by"]).filter(in_box("olon", "olat") & in_box("dlon", "dlat"))
    first = held.groupBy("request_id").agg(F.min(F.struct("_order", "_area")).alias("_b"))
    return requests.join(first, "request_id", "left").withColumn("area_id", F.col("_b._area")).drop("_b")


def in_box(x: str, y: str) -> Column:
    """Point inside the closed box of the row."""
    return F.col(x).between(F.col("west"), F.col("east")) & F.col(y).between(F.col("south"), F.col("north"))
