"""Map features as GeoJSON: holes, several polygons, lines, heights."""

import json

from umbraline.functions.text import compatibility_form
from umbraline.sources import sinks

POINT = "struct<lon: double, lat: double>"
SCHEMA = f"kind string, class string, name string, geometry string, polygons array<array<array<{POINT}>>>, line array<{POINT}>, height_m double"


def ring(low, high):
    return [(low, low), (high, low), (high, high), (low, low)]


def test_polygons_keep_holes_and_several_stay_one_feature(spark):
    rows = [("building", "yes", "a", "MultiPolygon", [[ring(0.0, 9.0), ring(1.0, 2.0)], [ring(20.0, 21.0)]], None, 12.5),
            ("building", "yes", None, "Polygon", [[ring(0.0, 9.0), ring(1.0, 2.0)]], None, None),
            ("path", "footway", "b", "LineString", None, [(0.0, 1.0), (2.0, 3.0)], None)]
    got = [json.loads(r[0]) for r in sinks.map_features(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()]
    lists = lambda r: [list(p) for p in r]
    assert [g["geometry"]["type"] for g in got] == ["MultiPolygon", "Polygon", "LineString"]
    assert got[0]["geometry"]["coordinates"] == [[lists(ring(0.0, 9.0)), lists(ring(1.0, 2.0))], [lists(ring(20.0, 21.0))]]
    assert got[1]["geometry"]["coordinates"] == [lists(ring(0.0, 9.0)), lists(ring(1.0, 2.0))]
    assert got[2]["geometry"]["coordinates"] == [[0.0, 1.0], [2.0, 3.0]]
    assert got[0]["properties"] == {"kind": "building", "class": "yes", "name": "a", "heightMetres": 12.5}
    assert got[1]["properties"]["name"] is None


def test_compatibility_form_of_ascii_other_text_and_null(spark):
    rows = spark.createDataFrame([("plain",), ("\ufb01n \uff21",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(compatibility_form("t")).collect()] == ["plain", "fin A", None, ""]
