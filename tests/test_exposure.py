"""Rays, scores and shadows against goldens and plain-Python brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from umbraline.operators import geometry, rays, scoring, shadows

GRID = "area_id int, width int, height int, west double, north double, res_m double, step_m double, max_surface_m double"
CELL = "area_id int, x int, y int, cell_no int, height_steps int, validity int, terrain double, surf_min double, surf_max double"
POINT = "ray_id int, area_id int, easting double, northing double, azimuth_deg double, altitude_deg double"


def cell_table(spark, width, height, fn):
    rows = [(0, x, y, y * width + x, *fn(x, y)) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, CELL)


def classify(spark, cells, points, width=40, height=40, top=None, mode="absolute"):
    grids = spark.createDataFrame([(0, width, height, 0.0, height * 4.0, 4.0, 0.5, top)], GRID)
    out = rays.classify_points(spark.createDataFrame(points, POINT), cells, grids, mode)
    return {r.ray_id: r for r in out.withColumn("reasons", rays.reason_names("reason_bits")).collect()}


def flat(special=None, terrain=0.0, steps=0):
    special = special or {}
    return lambda x, y: special.get((x, y), (steps, 255, terrain, terrain, terrain))


def test_obstacle_shades_only_from_the_sunward_side(spark):
    tower = {(20, 17): (160, 255, 0.0, 80.0, 80.0)}
    cells = cell_table(spark, 40, 40, flat(tower))
    # The tower stands 12 m north of the point; the sun stands north or south of it.
    points = [(1, 0, 82.0, 78.0, 0.0, 45.0), (2, 0, 82.0, 78.0, 180.0, 45.0), (3, 0, 82.0, 78.0, 0.0, -1.0)]
    got = classify(spark, cells, points, top=80.0)
    assert got[1].exposure == "shade" and got[1].shade_fraction == 1 and got[1].guaranteed
    assert got[2].exposure == "sun" and got[2].shade_fraction == 0 and not got[2].possible
    assert got[3].exposure == "night" and got[3].shade_fraction is None and got[3].covered and not got[3].reasons


def test_terrain_matters_only_with_absolute_planes(spark):
    # Ground at 100 m everywhere; the cell ahead carries a legacy height but no absolute one.
    cells = cell_table(spark, 40, 40, flat({(20, 17): (160, 255, 100.0, 100.0, 100.0)}, terrain=100.0))
    point = [(1, 0, 82.0, 78.0, 0.0, 45.0)]
    assert classify(spark, cells, point, top=100.0)[1].exposure == "sun"
    assert classify(spark, cells, point, mode="legacy")[1].exposure == "shade"


def test_surface_spread_is_uncertain_and_gaps_are_unknown(spark):
    cells = cell_table(spark, 40, 40, flat({(20, 17): (0, 255, 100.0, 100.0, 180.0)}, terrain=100.0))
    got = classify(spark, cells, [(1, 0, 82.0, 78.0, 0.0, 45.0)], top=180.0)[1]
    assert got.exposure == "uncertain" and got.reasons == ["near-clearance-threshold", "subcell-surface-variation"]
    holes = cell_table(spark, 40, 40, flat({(20, 17): (0, 254, 0.0, 0.0, 0.0), (5, 5): (0, 255, float("nan"), 0.0, 0.0)}))
    got = classify(spark, holes, [(1, 0, 82.0, 78.0, 0.0, 45.0), (2, 0, 22.0, 138.0, 0.0, 45.0), (3, 0, -5.0, 10.0, 0.0, 45.0)], top=80.0)
    for i in (1, 2, 3):
        assert got[i].exposure == "unknown" and got[i].possible and got[i].reasons == ["incomplete-height-coverage"]


def test_search_limit_and_low_sun(spark):
    cells = cell_table(spark, 80, 80, flat())
    got = classify(spark, cells, [(1, 0, 160.0, 20.0, 0.0, 2.0)], 80, 80, top=60.0)[1]
    assert got.exposure == "unknown" and got.reasons == ["low-sun-angle", "ray-search-limit"] and got.low_sun


def brute_point(cells, width, height, top, e, n, az, alt):
    """The walk as a plain loop with early stopping."""
    if alt <= 0:
        return "night", None
    look = lambda a, b: cells.get((math.floor(a / 4), math.floor((height * 4 - b) / 4)))
    here = look(e, n)
    if here is None:
        return "unknown", None
    tan = math.tan(math.radians(alt))
    natural = max(4.0, (max(0.0, top - here[0]) - 1.5) / tan)
    bc = be = bp = -math.inf
    complete, step = True, 1
    while step * 4.0 <= min(250.0, natural):
        d = step * 4.0
        cell = look(e + math.sin(math.radians(az)) * d, n + math.cos(math.radians(az)) * d)
        if cell is None:
            complete = False
            break
        need = here[0] + 1.5 + d * tan
        bc, bp, be = max(bc, cell[1] - need), max(bp, cell[2] - need), max(be, (cell[1] + cell[2]) / 2 - need)
        if bc >= 2:
            break
        step += 1
    sure = bc >= 2
    if (natural > 250 or not complete) and not sure:
        return "unknown", None
    return ("shade" if sure else "uncertain" if bp >= -2 else "sun"), max(0.0, min(1.0, (be + 2) / 4))


def test_rays_match_a_plain_walk_on_random_grids(spark):
    rng = random.Random(7)
    w = h = 30
    table = {}
    for x in range(w):
        for y in range(h):
            ground = rng.uniform(0, 5)
            low = ground + (rng.uniform(5, 40) if rng.random() < 0.15 else 0)
            table[(x, y)] = (0, 200 if rng.random() < 0.02 else 255, ground, low, low + rng.choice([0, 1, 3, 8]))
    good = {k: v[2:] for k, v in table.items() if v[1] == 255}
    top = max(v[2] for v in good.values())
    points = [(i, 0, rng.uniform(-2, 122), rng.uniform(-2, 122), rng.uniform(0, 360), rng.choice([-3.0, 2.0, 8.0, 25.0, 60.0])) for i in range(400)]
    got = classify(spark, cell_table(spark, w, h, lambda x, y: table[(x, y)]), points, w, h, top)
    for i, _, e, n, az, alt in points:
        want = brute_point(good, w, h, top, e, n, az, alt)
        assert got[i].exposure == want[0], (i, want)
        assert got[i].shade_fraction == (None if want[1] is None else pytest.approx(want[1], abs=1e-9))


def test_shadow_matches_a_plain_cast(spark):
    rng = random.Random(3)
    w, h = 18, 15
    table = {(x, y): (0, 190 if (x, y) == (4, 4) else 255, rng.uniform(0, 3), 0, 0) for x in range(w) for y in range(h)}
    for k, v in table.items():
        low = v[2] + (rng.uniform(3, 25) if rng.random() < 0.1 else 0)
        table[k] = (0, v[1], v[2], low, low + rng.choice([0, 2, 6]))
    cells = cell_table(spark, w, h, lambda x, y: table[(x, y)])
    grids = spark.createDataFrame([(0, w, h, 0.0, h * 4.0, 4.0, 0.5, None)], GRID)
    suns = [(1, 0, 33.3, 40.0), (2, 0, 181.0, 12.0), (3, 0, 275.5, 2.0), (4, 0, 10.0, -5.0)]
    frames = spark.createDataFrame(suns, "frame_id int, area_id int, azimuth_deg double, altitude_deg double")
    got = {(r.frame_id, r.x, r.y): r.state for r in shadows.ground_shadow(cells, grids, frames).collect()}
    ok = lambda k: table[k][1] == 255
    for frame, _, az, alt in suns[:3]:
        tan, a = math.tan(math.radians(alt)), math.radians(az)
        tallest = max(v[4] for k, v in table.items() if ok(k)) - min(v[2] for k, v in table.items() if ok(k))
        natural = (tallest - 1.5) / tan if tallest > 1.5 else 0
        de, ds = -math.sin(a), math.cos(a)
        major = max(abs(de), abs(ds))
        offs = []
        for k in range(1, int(250 * major / 4) + 1):
            o = (math.floor(de * k / major + 0.5), math.floor(ds * k / major + 0.5))
            if math.hypot(*o) * 4 <= 250:
                offs.append((*o, math.hypot(*o) * 4))
        for (x, y), v in table.items():
            sure = ok((x, y)) and v[3] - v[2] >= 3.5
            maybe = ok((x, y)) and v[4] - v[2] > 1.5
            dark = not ok((x, y))
            for dx, dy, d in offs:
                s = (x - dx, y - dy)
                if s not in table or not ok((x, y)):
                    continue
                if not ok(s):
                    dark = True
                    continue
                need = v[2] + 1.5 + d * tan
                sure = sure or table[s][3] >= need + 2
                maybe = maybe or (natural <= 250 and table[s][4] >= need - 2)
            sx, sy = math.sin(a), -math.cos(a)
            ex = (w - x - 0.5) / sx if sx > 0 else (x + 0.5) / -sx
            ey = (h - y - 0.5) / sy if sy > 0 else (y + 0.5) / -sy
            if natural > 0 and min(ex, ey) * 4 < min(natural, 250) and ok((x, y)):
                dark = True
            want = "certain" if sure else "unknown" if dark else "search-limited" if natural > 250 else "possible" if maybe else "clear"
            assert got[(frame, x, y)] == want, (frame, x, y)
    summary = {r.frame_id: r for r in shadows.shadow_summary(shadows.ground_shadow(cells, grids, frames), shadows.frame_reach(cells, grids, frames)).collect()}
    assert summary[4].shadow_percent == 100 and not summary[4].daylight
    for f in (1, 2, 3):
        r = summary[f]
        assert 0 <= r.certain_percent + r.possible_percent + r.unknown_percent + r.search_limited_percent <= 100 + 1e-9


def test_densify_counts(spark):
    lat = 51.5
    step = 101 / (6_371_000 * math.pi / 180)
    df = spark.createDataFrame([(1, 0, -0.12, lat), (1, 1, -0.12, lat + step), (1, 2, -0.12, lat + step), (2, 0, -0.1, 51.5)], "route_id int, seq int, lon double, lat double")
    segs = geometry.segments(df)
    out = geometry.densify(segs).collect()
    assert len(out) == 14  # 13 pieces of the 101 m leg, and one for the zero-length leg
    assert len(geometry.densify(segs, skip_zero=True).collect()) == 13
    assert sum(r.piece_m for r in out) == pytest.approx(101)
    points = sorted(geometry.resample(segs).collect(), key=lambda r: r.sample_no)
    assert len(points) == 41 and points[0].y == lat and points[-1].y == pytest.approx(lat + step)


def test_chunks_give_what_whole_routes_give(spark):
    """Running sums, sample numbers and resampled points do not depend on where a route is cut; gaps in seq and lone vertices too."""
    rng = random.Random(21)
    rows = [(r, s, float(rng.choice([0, 0, 3, 9, 40]) + s), float(rng.randint(0, 30))) for r, n in enumerate((1, 2, 7, 8, 9, 60, 200)) for s in sorted(rng.sample(range(3 * n), n))]
    rows += [(r, s + 1, x, y) for r, s, x, y in rows if r == 5 and (r, s + 1) not in {(q, t) for q, t, _, _ in rows}][:9]   # segments of no length
    df = spark.createDataFrame(rows, "route_id int, seq int, x double, y double")

    def made(chunk):
        segs = geometry.segments(df, x="x", y="y", metric="planar", lone=True, chunk=chunk)
        frames = [segs.drop("chunk"), geometry.densify(segs).drop("chunk"), geometry.densify(segs, skip_zero=True).drop("chunk"), geometry.resample(segs)]
        return [sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in f.collect()) for f in frames]

    cut, whole = made(7), made(4_096)
    assert cut == whole and len(whole[0]) == sum(1 for _ in rows) - 7 + 1
    numbers = {}
    for r in geometry.densify(geometry.segments(df, x="x", y="y", metric="planar", chunk=7)).collect():
        numbers.setdefault(r.route_id, []).append(r.sample_idx)
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())


def test_a_long_route_is_spread_over_tasks(spark):
    df = spark.range(200_000).selectExpr("id DIV 1000000 AS route_id", "CAST(id AS INT) AS seq", "CAST(id * 2 AS DOUBLE) AS x", "0D AS y")
    segs = geometry.segments(df, x="x", y="y", metric="planar")
    tasks = segs.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("start_m").alias("far")).collect()
    assert len(tasks) > 8 and max(t.n for t in tasks) < 50_000 and max(t.far for t in tasks) == 2.0 * 199_998


def test_passages_pace_and_percent(spark):
    exposed = spark.createDataFrame([
        (1, 0, 10.0, True, True, 0.5, False, True, False, 0), (1, 0, 10.0, True, False, None, False, True, False, 1),
        (2, 0, 10.0, False, True, None, False, False, False, 0)],
        "route_id int, journey int, sample_s double, daylight boolean, covered boolean, shade_fraction double, guaranteed boolean, possible boolean, low_sun boolean, reason_bits int")
    got = {r.route_id: r for r in scoring.score_journeys(exposed, ["route_id", "journey"]).collect()}
    assert (got[1].sun_s, got[1].best_s, got[1].worst_s, got[1].coverage_percent, got[1].shade_percent) == (15.0, 0.0, 20.0, 50.0, 25.0)
    assert (got[2].sun_s, got[2].shade_percent, got[2].coverage_percent, got[2].is_daylight) == (0.0, None, 100.0, False)
    directions = spark.createDataFrame([(1, "Take the stairs.", 3, 3), (1, "Go to Level -2.", 7, 9), (1, "Downstairsville", 0, 9)], "route_id int, instruction string, begin_idx int, end_idx int")
    segs = spark.createDataFrame([(1, i) for i in range(10)], "route_id int, seg_idx int")
    assert [r.seg_idx for r in scoring.mark_passages(segs, directions).filter("in_passage").orderBy("seg_idx").collect()] == [3, 7, 8]


def test_more_unknown_never_lowers_the_estimate(spark):
    rng = random.Random(11)
    w = h = 20
    base = {(x, y): (0, 255, 0.0, 30.0 if rng.random() < 0.2 else 0.0, 30.0) for x in range(w) for y in range(h)}
    base = {k: (v[0], v[1], v[2], v[3], v[3]) for k, v in base.items()}
    worse = {k: (v[0], 100 if rng.random() < 0.2 else 255, *v[2:]) for k, v in base.items()}
    points = [(i, 0, rng.uniform(0, 80), rng.uniform(0, 80), rng.uniform(0, 360), 50.0) for i in range(200)]
    a = classify(spark, cell_table(spark, w, h, lambda x, y: base[(x, y)]), points, w, h, 30.0)
    b = classify(spark, cell_table(spark, w, h, lambda x, y: worse[(x, y)]), points, w, h, 30.0)
    sun = lambda r: 1 - (r.shade_fraction or 0)
    assert all(sun(b[i]) >= sun(a[i]) - 1e-12 for i in a)


def test_tiles_with_halos_give_what_one_tile_gives(spark):
    """Rays and shadows cross the borders of small tiles; holes, missing cells and a grid that is no multiple of a tile."""
    rng = random.Random(12)
    w, h = 83, 71
    rows = [(0, x, y, y * w + x, rng.randint(0, 60), 200 if rng.random() < 0.01 else 255, 0.0, g := rng.uniform(0, 30) if rng.random() < 0.05 else 0.0, g + rng.choice([0, 3]))
            for y in range(h) for x in range(w) if rng.random() > 0.005]
    cells = spark.createDataFrame(rows, CELL)
    grids = spark.createDataFrame([(0, w, h, 0.0, h * 4.0, 4.0, 0.5, 33.0), (1, 5, 5, 0.0, 0.0, 4.0, 0.5, None)], GRID)
    points = spark.createDataFrame([(i, 0, rng.uniform(-5, w * 4 + 5), rng.uniform(-5, h * 4 + 5), rng.uniform(0, 360), rng.choice([4.0, 7.0, 12.0])) for i in range(300)], POINT)
    frames = spark.createDataFrame([(i, 0, rng.uniform(0, 360), rng.choice([6.0, 9.0, 30.0])) for i in range(40)], "frame_id int, area_id int, azimuth_deg double, altitude_deg double")
    for mode in ("absolute", "legacy"):
        seen = [sorted(map(str, rays.classify_points(points, cells, grids, mode, side=side).collect())) for side in (256, 16)]
        assert seen[0] == seen[1] and len(seen[0]) == 300
    cast = [sorted(map(tuple, shadows.ground_shadow(cells, grids, frames, side=side).collect())) for side in (256, 16)]
    assert cast[0] == cast[1] and len(cast[0]) == 40 * len(rows)


@pytest.mark.parametrize("mode", ["absolute", "legacy"])
def test_points_cut_from_lines_see_what_points_see(spark, mode):
    """Lines across tiles, off the grid, of no length, in no area, without a place: each sample once, judged as on its own."""
    rng = random.Random(3)
    cells = cell_table(spark, 40, 40, lambda x, y: (rng.randrange(60), 255 if rng.random() < 0.97 else 200, 0.0, (h := rng.choice([0.0, 0.0, 0.0, 25.0])), h + rng.randrange(4)))
    cells = spark.createDataFrame(cells.collect(), cells.schema)
    grids = spark.createDataFrame([(0, 40, 40, 0.0, 160.0, 4.0, 0.5, 28.0)], GRID)
    far = lambda: rng.uniform(-60.0, 220.0)
    rows = [(i, rng.choice([0, 0, 0, 7]), far(), far(), far(), far()) for i in range(30)]
    rows += [(90, 0, 64.0, 64.0, 64.0, 64.0), (91, None, 1.0, 1.0, 9.0, 9.0), (92, 0, None, 4.0, 80.0, 9.0), (93, 0, float("nan"), 4.0, 80.0, 9.0), (94, 0, 0.0, 0.0, 160.0, 160.0)]
    lines = spark.createDataFrame(rows, "line int, area_id int, x1 double, y1 double, x2 double, y2 double")

    def cut(df, along=()):
        f = F.col("no") / 9.0
        return df.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
            "line", "no", *dict.fromkeys(["area_id", *along]), (F.col("x1") + (F.col("x2") - F.col("x1")) * f).alias("easting"), (F.col("y1") + (F.col("y2") - F.col("y1")) * f).alias("northing"),
            (F.col("no") * 37.0 + 0.5).alias("azimuth_deg"), F.when(F.col("no") == 4, -1.0).otherwise(30.0 + F.col("no")).alias("altitude_deg"))

    key = ["line", "no"]
    want = sorted(map(str, rays.classify_points(cut(lines), cells, grids, mode, key=key).collect()))
    for side in (256, 16):
        got = rays.classify_cut(lines, cut, cells, grids, mode, key, side=side, salt="line")
        assert sorted(map(str, got.select(*key, *[c for c in got.columns if c not in key]).collect())) == want
