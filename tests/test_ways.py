"""Ways on the map: what meets the nodes."""

from pyspark.sql import functions as F

import umbraline.catalog as catalog
from umbraline.operators import rings

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ways_are_listed_twice_at_most(spark):
    """Ways that are nothing on the map meet no nodes, and buildings are told apart without a second pass."""
    plan = plan_of(spark, "osm_features")
    assert "Union" not in plan
    met = plan.split("Generate posexplode")[1]
    assert "highway" in met.split("Exchange")[0]


def test_kinds_are_kept(spark):
    rows = {r["kind"]: r["n"] for r in catalog.QUERIES["osm_features"](spark, FOLDER).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(rows) == {"building", "road", "water", "green"}


def test_a_node_listed_twice_makes_two_points(spark):
    """A way of one node is drawn where that node stands twice among the nodes, as before."""
    ways = spark.createDataFrame([(1, [5], {"highway": "footway"}), (2, [6], {"highway": "footway"}), (3, [5, 6], {"power": "line"})],
                                 "way_id bigint, nodes array<bigint>, tags map<string,string>")
    nodes = spark.createDataFrame([(5, 0.1, 51.0), (5, 0.1, 51.0), (6, 0.2, 51.0)], "node_id bigint, lon double, lat double")
    assert [(r.way_id, len(r.coordinates)) for r in rings.way_features(ways, nodes).collect()] == [(1, 2)]


def test_drawn_buildings_are_left_out(spark):
    ways = spark.createDataFrame([(1, {"building": "yes"}), (2, {"building": "yes"}), (1, {"highway": "footway"}), (None, {"building": "yes"})],
                                 "way_id bigint, tags map<string,string>")
    members = spark.createDataFrame([("way", 1), ("way", 1), ("node", 2), ("way", None)], "type string, ref bigint")
    left = [(r.way_id, next(iter(r.tags))) for r in rings.drop_represented_ways(ways, members).collect()]
    assert sorted(left, key=str) == [(1, "highway"), (2, "building"), (None, "building")]
