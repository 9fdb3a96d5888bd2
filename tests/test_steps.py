"""Steps of a route: what is dealt out, and that long or gappy routes come out as short ones do."""

import pytest

import umbraline.catalog as catalog
from umbraline.operators import geometry, progress

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt(plan):
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("name", ["journey_steps", "journey_progress"])
def test_directions_are_not_dealt_out_by_vertex(spark, name):
    """Vertex distances come to the directions in chunks; steps are built once."""
    plan = plan_of(spark, name)
    assert dealt(plan) and not [line for line in dealt(plan) if "begin_idx" in line or "end_idx" in line]
    assert plan.count("_all_m#") and len([line for line in plan.splitlines() if "Window [sum(step_m" in line and "unboundedfollowing" in line]) == 1


def test_steps_over_chunks_and_gaps(spark):
    """A route cut into many chunks has the steps of the same route in one; a vertex without a place is no mark."""
    places = [(r, i, None if (r, i) == (2, 3) else -0.12 + i * 0.0001, 51.5 + (i % 3) * 0.0001) for r in (1, 2) for i in range(9)]
    vertices = spark.createDataFrame(places, "route_id bigint, seq int, lon double, lat double")
    asked = [(r, n, "go", b, e, 10, 5) for r in (1, 2) for n, (b, e) in enumerate([(0, 2), (2, 3), (3, 4), (4, 8), (8, 8), (5, 11), (None, 2)])]
    directions = spark.createDataFrame(asked, "route_id bigint, dir_idx int, instruction string, begin_idx int, end_idx int, distance_m int, duration_s int")
    routes = spark.createDataFrame([(1, 700.0, 400.0), (2, 700.0, 400.0), (3, 50.0, 20.0)], "route_id bigint, distance_m double, duration_s double")

    def rows(chunk):
        steps = progress.journey_steps(directions, routes, geometry.segments(vertices, chunk=chunk))
        return {(r.route_id, r.dir_idx): [round(v, 6) for v in (r.start_m, r.end_m, r.start_s, r.end_s)] for r in steps.collect()}

    whole = rows(4_096)
    assert len(whole) == 15 and whole == rows(2) == rows(1)
    segs = geometry.segments(vertices).filter("route_id = 1")
    along = {r.seg_idx: r.start_m / r.total_m * 700.0 for r in segs.collect()} | {8: 700.0}
    assert whole[1, 3][:2] == [round(along[4], 6), round(along[8], 6)]
    # The segment before the lost vertex has no end, so vertex 2 is no mark, and there is no vertex 11: shares of the directions' own lengths.
    assert whole[2, 0][:2] == [0.0, 100.0] and whole[2, 1][:2] == [100.0, 200.0] and whole[1, 5][:2] == [500.0, 600.0]


def test_progress_takes_the_step_by_number(spark):
    steps = spark.createDataFrame([(1, n, f"s{n}", n * 10.0, n * 2.0, 30.0, 6.0) for n in (3, 5, 9)],
                                  "route_id bigint, dir_idx int, instruction string, start_m double, start_s double, route_m double, route_s double")
    active = spark.createDataFrame([(p, r, i) for p, (r, i) in enumerate([(1, None), (1, -4), (1, 1), (1, 2), (1, 70), (2, 0), (None, 0)])],
                                   "position_id int, route_id bigint, active_idx int")
    rows = {r.position_id: (r.active_idx, r.instruction, r.next_instruction) for r in progress.journey_progress(active, steps).collect()}
    assert rows == {0: (0, "s3", "s5"), 1: (0, "s3", "s5"), 2: (1, "s5", "s9"), 3: (2, "s9", None), 4: (2, "s9", None)}
