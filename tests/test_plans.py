"""No registered query may plan a nested-loop or Cartesian join; exchanges stay few on the scoring path."""

import pytest

import umbraline.catalog as catalog

FOLDER = "/root/testdata/sf0.001"
# Path finding runs its levels while it builds, so it is checked by its own tests.
EAGER = {"pareto_paths", "stitch_rings"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - EAGER))
def test_no_nested_loop(spark, name):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # An empty-grouping scalar (a count used as a number) is a one-row subquery, not a join.
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scoring_shuffles_samples_once(spark):
    frame = catalog.QUERIES["score_journeys"](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Generate explode(sequence(0")[0]
    # Above the sampling step: no exchange other than broadcasts of the looked-up tables.
    assert "hashpartitioning(route_id, journey" not in plan
    read = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "l_orderkey" in line]
    assert read and all("l_comment" not in line and "l_quantity" not in line for line in read)


def without_broadcasts(spark, make):
    """The plan of a frame where no side is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ray_steps_are_not_shuffled(spark):
    """Steps meet the tile of their ray behind the join; only whole rays are combined afterwards."""
    plan = without_broadcasts(spark, lambda: catalog.QUERIES["predict_observations"](spark, FOLDER))
    above = plan.split("Generate explode(CASE WHEN (_steps")[0]
    assert "Generate explode(CASE WHEN (_steps" in plan and above.count("Exchange ") == 1 and "Join" not in above


def test_shadow_offsets_are_not_shuffled(spark):
    plan = without_broadcasts(spark, lambda: catalog.QUERIES["ground_shadow"](spark, FOLDER))
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Exchange" not in above and "offsets" not in above


@pytest.mark.parametrize("name", ["score_journeys", "score_schedules", "bucketed_edge_costs"])
def test_samples_are_cut_behind_the_tile_join(spark, name):
    """No sample is shuffled: above the sampling, exchanges deal out journeys only."""
    plan = without_broadcasts(spark, lambda: catalog.QUERIES[name](spark, FOLDER))
    assert "Generate explode(sequence(0, (pieces" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "sample_idx" in line]
    above = plan.split("Generate explode(sequence(0, (pieces")[0].splitlines()
    assert not [line for line in above if "Exchange hashpartitioning" in line and "area_id" in line]


def test_rays_at_outlines_are_folded_where_they_met(spark):
    """Samples take what they need of their route and area from their segment; sides are folded without another exchange."""
    plan = without_broadcasts(spark, lambda: catalog.QUERIES["footprint_route_score"](spark, FOLDER))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in dealt if "polygon_id" in line and "_bx" in line]
    above = [line for line in plan.split("Generate explode(sequence(0, (pieces")[0].splitlines() if "Exchange hashpartitioning" in line]
    assert above and not [line for line in above if "hashpartitioning(area_id" in line and "_bx" not in line]


def test_exchanges_begin_in_small_shares(spark):
    """The tables' size shows in the number of tasks, not in the rows of one."""
    plan = without_broadcasts(spark, lambda: catalog.QUERIES["exposure_profile"](spark, FOLDER))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all(", 1024), ENSURE_REQUIREMENTS" in line for line in dealt)
