"""Pairs of routes on one path: what is dealt out, long routes and routes listed twice."""

import re

import umbraline.catalog as catalog
from umbraline.operators import geometry
from umbraline.operators import routes as rt

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt(plan):
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_points_of_twins_are_not_dealt_out(spark):
    """Segments travel to the pairs of their route, and points are cut where both routes met."""
    plan = plan_of(spark, "near_duplicates")
    assert dealt(plan) and not [line for line in dealt(plan) if re.search(r"\bk#|sample_no#", line)]


def test_twins_over_chunks(spark, monkeypatch):
    """Long routes, cut into chunks, forwards and backwards; a route listed twice stays out, as before."""
    monkeypatch.setattr(rt, "segments", lambda *a, **k: geometry.segments(*a, **k, chunk=7))
    side = lambda route, off, back=False: [(route, 99 - i if back else i, i * 3.0, (i % 5) * 1.0 + off) for i in range(60)]
    vertices = spark.createDataFrame(side(1, 0.0) + side(2, 4.0, True) + side(3, 60.0) + side(4, 0.0) + side(5, 1.0), "route_id bigint, seq int, x double, y double")
    routes = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 4, 0), (2, 5, 1), (2, 5, 1)], "request_id bigint, route_id bigint, route_pos int")
    found = rt.near_duplicates(vertices, routes, x="x", y="y", metric="planar").collect()
    assert [(r.a_id, r.b_id, r.close_points, round(r.mean_m, 6), round(r.max_m, 6)) for r in found] == [(1, 2, 41, 4.0, 4.0)]
