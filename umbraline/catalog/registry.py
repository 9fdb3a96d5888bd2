"""Registry of queries and the domain views they read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import bound_tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Source:
    """The tables of one scale folder and the domain views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        bound_tasks(spark)
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._known[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.sql(view_text(name, 0))
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL over tables and views named in braces."""
        names = sorted(set(re.findall(r"\{(\w+)\}", text)))
        return self.spark.sql(text, **{n: self.table(n) if n in TABLES else self.view(n) for n in names})


def query(name: str, oracle: str | None = None):
    """Register ``fn(source) -> DataFrame`` under a name, with its SQL twin."""

    def wrap(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Source(spark, folder))
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return wrap


def view_text(name: str, engine: int) -> str:
    """Text of a view: one for both engines, or a (Spark, twin) pair where they spell exploding differently."""
    text = VIEWS[name]
    return text if isinstance(text, str) else text[engine]


def _needs(name: str, seen: list[str]) -> None:
    for inner in re.findall(r"\{(\w+)\}", view_text(name, 1)):
        if inner not in TABLES:
            _needs(inner, seen)
    if name not in seen:
        seen.append(name)


def given(*names: str) -> str:
    """The opening WITH clause that defines the named views (and what they need)."""
    ordered: list[str] = []
    for name in names:
        _needs(name, ordered)
    strip = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    return "WITH " + ",\n".join(f"{n} AS ({strip(view_text(n, 1))})" for n in ordered)


def r6(expression: str) -> str:
    """SQL: six decimals, halves up - the rounding both engines share."""
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 6_371_000.0) -> str:
    up, across = f"sin((radians({lat2}) - radians({lat1})) / 2)", f"sin(radians({lon2} - {lon1}) / 2)"
    h = f"{up} * {up} + cos(radians({lat1})) * cos(radians({lat2})) * {across} * {across}"
    return f"2 * {radius} * asin(sqrt(greatest(0, least(1, {h}))))"


# Domain views.  The given tables carry no geography, so these map them onto
# the domain with integer arithmetic; each text runs in both engines.
VIEWS: dict[str, str | tuple[str, str]] = {
    # 50 x 40 cells of 4 m per area; one area per 2,000 parts.
    "cells": """
        SELECT CAST(floor(p_partkey / 2000.0) AS INT) AS area_id, CAST(p_partkey % 50 AS INT) AS x,
          CAST(floor((p_partkey % 2000) / 50.0) AS INT) AS y, CAST(p_partkey % 2000 AS INT) AS cell_no,
          CAST((p_partkey * 7) % 5 AS INT) AS terrain,
          CAST((p_partkey * 7) % 5 + CASE WHEN p_size > 35 THEN p_size - 20 ELSE 0 END AS INT) AS surf_min,
          CAST((p_partkey * 7) % 5 + CASE WHEN p_size > 35 THEN p_size - 20 ELSE 0 END + p_partkey % 4 AS INT) AS surf_max,
          CAST(2 * (CASE WHEN p_size > 35 THEN p_size - 20 ELSE 0 END + p_partkey % 4) AS INT) AS height_steps,
          CAST(CASE WHEN p_partkey % 97 = 0 THEN 200 ELSE 255 END AS INT) AS validity
        FROM {part}""",
    "grids": """
        SELECT area_id, CAST(50 AS INT) AS width, CAST(max(y) + 1 AS INT) AS height,
          CAST(0 AS DOUBLE) AS west, CAST(0 AS DOUBLE) AS north, CAST(4 AS DOUBLE) AS res_m,
          CAST(0.5 AS DOUBLE) AS step_m, CAST(max(surf_max) AS DOUBLE) AS max_surface_m
        FROM {cells} GROUP BY area_id""",
    # Every order is a route, whatever its length.
    "route_vertices": """
        SELECT l_orderkey AS route_id, CAST(floor(l_orderkey / 15000.0) AS INT) AS area_id,
          CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS seq,
          CAST((l_partkey * 13) % 200 AS DOUBLE) AS x_m, CAST(-((l_suppkey * 17) % 160) AS DOUBLE) AS y_m
        FROM {lineitem}""",
    "routes": """
        SELECT o_orderkey AS route_id, CAST(floor(o_orderkey / 3.0) AS BIGINT) AS request_id, CAST(o_orderkey % 3 AS INT) AS route_pos,
          CAST(floor(o_orderkey / 15000.0) AS INT) AS area_id, CAST(300 + (o_orderkey * 37) % 400 AS DOUBLE) AS duration_s,
          CAST(floor(o_orderkey / 3.0) % 60 AS BIGINT) * 60000 AS departure_ms,
          CASE WHEN floor(o_orderkey / 3.0) % 2 = 0 THEN 'vulnerable' ELSE 'worker' END AS profile,
          CASE CAST(floor(o_orderkey / 3.0) % 4 AS INT) WHEN 0 THEN 'slow' WHEN 1 THEN 'standard' WHEN 2 THEN 'brisk' ELSE 'jog' END AS pace,
          CAST(1 + floor(o_orderkey / 3.0) % 3 AS INT) AS journey_count, CAST(5 + 5 * (floor(o_orderkey / 3.0) % 4) AS INT) AS repeat_min
        FROM {orders}""",
    # One instruction per vertex interval; every eleventh part names a passage.
    "directions": """
        SELECT route_id, seq AS dir_idx, CAST(CASE WHEN seq % 5 = 4 THEN 2 ELSE seq END AS INT) AS begin_idx, seq + 1 AS end_idx,
          CAST((abs(x_m) * 3 + abs(y_m)) % 300 AS INT) AS distance_m, CAST((abs(x_m) + abs(y_m) * 7) % 120 AS INT) AS duration_s,
          (CAST(abs(x_m) AS INT) % 7 = 3) AS rough,
          CASE CAST(abs(x_m) AS INT) % 11 WHEN 0 THEN 'Take the stairs to Level -1.' WHEN 1 THEN 'Turn left onto Lower Marsh.'
            WHEN 2 THEN 'Continue on the crosswalk.' WHEN 3 THEN 'Walk north on York Road.' WHEN 4 THEN 'Enter the subway.'
            WHEN 5 THEN '' WHEN 6 THEN 'Turn right onto the walkway.' ELSE 'Keep left.' END AS instruction
        FROM {route_vertices}""",
    "geo_vertices": """
        SELECT route_id, area_id, seq, -0.12 + x_m * 0.00001 AS lon, 51.5 + y_m * 0.00001 AS lat FROM {route_vertices}""",
    # Reported length and time per route: a little more than the geometry.
    "reported": """
        SELECT o_orderkey AS route_id, CAST(200 + (o_orderkey * 29) % 300 AS DOUBLE) AS distance_m, CAST(300 + (o_orderkey * 37) % 400 AS DOUBLE) AS duration_s
        FROM {orders}""",
    # Scored sections, one exposure per vertex; 'haze' is no known state.
    "sections": """
        SELECT route_id, seq, CAST((abs(x_m) + abs(y_m)) % 50 + 1 AS DOUBLE) AS length_m,
          CASE CAST(abs(x_m) AS INT) % 7 WHEN 0 THEN 'sun' WHEN 1 THEN 'sun' WHEN 2 THEN 'sun' WHEN 3 THEN 'shade' WHEN 4 THEN 'uncertain' WHEN 5 THEN 'haze' ELSE 'night' END AS exposure
        FROM {route_vertices}""",
    "positions": """
        SELECT event_id AS position_id, (event_id * 3) % (SELECT count(*) FROM {orders}) AS route_id, -0.12 + ((event_id * 13) % 200) * 0.00001 AS lon,
          51.5 - ((event_id * 17) % 160) * 0.00001 AS lat, CAST((event_id * 7) % 500 AS DOUBLE) AS distance_m, CAST(event_id % 9 AS INT) AS active_idx
        FROM {events}""",
    # Whole schedules per route, for the ranking operators.
    "schedules": """
        SELECT CAST(floor(o_orderkey / 3.0) AS BIGINT) AS request_id, o_orderkey AS route_id, CAST(o_orderkey % 3 AS INT) AS route_pos,
          CASE WHEN floor(o_orderkey / 3.0) % 2 = 0 THEN 'vulnerable' ELSE 'worker' END AS profile,
          CAST(1 + floor(o_orderkey / 3.0) % 3 AS INT) AS journey_count,
          CAST((300 + (o_orderkey * 37) % 120) * (1 + floor(o_orderkey / 3.0) % 3) AS DOUBLE) AS duration_s,
          CAST((o_orderkey * 53) % 400 AS DOUBLE) AS sun_s,
          CAST(greatest(0, (o_orderkey * 53) % 400 - (o_orderkey * 7) % 40) AS DOUBLE) AS best_s,
          CAST((o_orderkey * 53) % 400 + (o_orderkey * 11) % 60 AS DOUBLE) AS worst_s,
          (floor(o_orderkey / 3.0) % 13 <> 0) AS is_daylight, CAST(84 + (o_orderkey * 3) % 17 AS DOUBLE) AS coverage_percent,
          (floor(o_orderkey / 3.0) % 17 = 0) AS low_sun, (o_orderkey % 4 <> 1) AS avoids_barriers,
          (floor(o_orderkey / 3.0) % 3 = 1) AS step_free
        FROM {orders}""",
    "walks": """
        SELECT CAST(floor(o_orderkey / 3.0) AS BIGINT) AS comparison_id, o_orderkey AS route_id, CAST(o_orderkey % 3 AS INT) AS route_pos,
          CAST(1000 * (3 + (o_orderkey * 7) % 11) AS BIGINT) AS predicted_sun_mmin, CAST(1000 * (2 + (o_orderkey * 5) % 13) AS BIGINT) AS observed_sun_mmin,
          CAST(CASE WHEN floor(o_orderkey / 3.0) % 5 = 0 THEN 2000 ELSE 0 END AS BIGINT) AS observed_unknown_mmin,
          CAST(1000 * (o_orderkey % 2) AS BIGINT) AS predicted_unknown_mmin, CAST(20000 AS BIGINT) AS duration_mmin
        FROM {orders}""",
    "edges": """
        SELECT o_orderkey AS edge_id, CAST(floor(o_orderkey / 60.0) AS BIGINT) AS graph_id, CAST(o_orderkey % 6 AS INT) AS src,
          CAST((o_orderkey * 5 + 1) % 12 AS INT) AS dst, CAST(20 + (o_orderkey * 11) % 50 AS DOUBLE) AS duration_s,
          CAST((o_orderkey * 7) % 15 AS DOUBLE) AS sun_s, CAST(o_orderkey % 4 AS DOUBLE) AS unknown_s
        FROM {orders}""",
    "observations": """
        SELECT event_id AS observation_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS area, CAST(user_id % 12 AS INT) AS point_id,
          CAST(floor((user_id % 12) / 2.0) AS INT) AS site_no,
          CASE event_type WHEN 'error' THEN 'overcast' WHEN 'signup' THEN 'intermittent-sun' ELSE 'clear-direct-sun' END AS weather,
          CAST(hour(ts) AS INT) AS local_hour,
          CASE event_id % 5 WHEN 0 THEN 'sun' WHEN 1 THEN 'shade' WHEN 2 THEN 'shade' WHEN 3 THEN 'sun' ELSE 'unknown' END AS predicted,
          CASE WHEN event_id % 3 = 0 THEN 'sun' ELSE 'shade' END AS observed,
          CASE WHEN event_id % 4 = 0 THEN 'manual' ELSE 'one-shot-gps' END AS coordinate_source, CAST(event_id % 30 AS INT) AS gps_accuracy_m,
          CASE WHEN event_id % 50 = 49 THEN 'old' ELSE 'current' END AS release,
          51.5 + (event_id * 7 % 20) * 0.00001 AS lat, -0.12 + (event_id * 11 % (10 + user_id % 12)) * 0.00002 AS lon
        FROM {events}""",
    # Twenty features and three thousand routes per area, whatever the scale.
    "features": """
        SELECT s_suppkey AS feature_id, CAST(floor(s_suppkey / 20.0) AS INT) AS area_id, CAST(s_suppkey % 5 AS INT) AS category_no,
          s_name AS name, CAST((s_suppkey * 29) % 200 AS DOUBLE) AS x_m, CAST(-((s_suppkey * 31) % 160) AS DOUBLE) AS y_m
        FROM {supplier}""",
    "op_events": """
        SELECT event_id, ts, user_id AS client, CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'signup' THEN 'busy' WHEN 'click' THEN 'teapot' ELSE 'success' END AS outcome,
          CASE event_type WHEN 'error' THEN 'none' WHEN 'signup' THEN 'none' WHEN 'view' THEN 'fallback' ELSE 'primary' END AS delivery,
          CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 ELSE 200 END AS status_code,
          CAST(event_id % 5000 AS INT) AS duration_ms, CAST(event_id % 5 AS INT) AS route_count
        FROM {events}""",
    "works": """
        SELECT o_orderkey AS reference, CAST(o_custkey % 25 AS INT) AS area_id, o_orderdate AS starts_at,
          o_orderdate + INTERVAL '5' DAY AS ends_at, o_orderdate - INTERVAL '2' DAY AS updated_at, o_orderkey AS payload_pos
        FROM {orders}""",
    # 4 m square footprints on the tall cells; ring vertices run counter-clockwise.
    "buildings": """
        SELECT CAST(floor(p_partkey / 2000.0) AS INT) AS area_id, p_partkey AS building_id,
          CAST((p_partkey % 50) * 4 AS DOUBLE) AS x0, CAST(-floor((p_partkey % 2000) / 50.0) * 4 - 4 AS DOUBLE) AS y0,
          CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size - 20 AS DOUBLE) END AS height_m,
          CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size % 9 AS DOUBLE) END AS levels
        FROM {part} WHERE p_size > 35""",
}
