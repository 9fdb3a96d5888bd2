"""Polygons against points, cells and rays.

Geometry is joined on bin keys, never by a bare inequality: a polygon or edge is
listed in every bin it touches and a point or ray asks only the bins it needs.
Edge tables have area_id, polygon_id, ring_no (0 = outer), x1, y1, x2, y2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import half_up, shuffled

# Fixed values.
BOUNDARY = 1e-8
MIN_RASTER_M, MAX_RASTER_M = 3.0, 120.0


def ring_edges(rings: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """Edges of closed or open rings given as arrays of (x, y) structs; the last point joins the first."""
    nxt = F.when(F.col("_i") + 1 < F.size(ring), F.get(ring, F.col("_i") + 1)).otherwise(F.get(ring, F.lit(0)))
    flat = rings.select(*keys, ring, F.posexplode(ring).alias("_i", "_p")).withColumn("_q", nxt)
    return flat.select(*keys, F.col("_i").alias("edge_no"), F.col("_p.x").alias("x1"), F.col("_p.y").alias("y1"),
                       F.col("_q.x").alias("x2"), F.col("_q.y").alias("y2"))


def on_edge(px: Column, py: Column) -> Column:
    """Point lies on the edge of the row, within a tiny tolerance."""
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rx, ry = px - F.col("x1"), py - F.col("y1")
    along = rx * ex + ry * ey
    return (F.abs(ex * ry - ey * rx) <= BOUNDARY) & (along >= -BOUNDARY) & (along <= ex * ex + ey * ey + BOUNDARY)


def crosses(px: Column, py: Column) -> Column:
    """The edge of the row crosses the eastward line from the point."""
    spans = (F.col("y1") > py) != (F.col("y2") > py)
    at = (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / F.when(spans, F.col("y2") - F.col("y1")) + F.col("x1")
    return F.coalesce(spans & (px < at), F.lit(False))


def _inside_rings(pairs: DataFrame, keys: list[str], px: Column, py: Column) -> DataFrame:
    """Reduce candidate (point, edge) rows to one row per ring with ``in_ring``."""
    return pairs.groupBy(*keys).agg(
        ((F.sum(crosses(px, py).cast("int")) % 2 == 1) | F.max(on_edge(px, py))).alias("in_ring"))


def _segment_distance(px: Column, py: Column) -> Column:
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = ex * ex + ey * ey
    f = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("x1")) * ex + (py - F.col("y1")) * ey) / square))).otherwise(0.0)
    dx, dy = px - (F.col("x1") + f * ex), py - (F.col("y1") + f * ey)
    return F.sqrt(dx * dx + dy * dy)


def zonal_building_height(edges: DataFrame, cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Median positive height of the complete cells in each building, 3-120 m, nearest half metre.

    A building without such a cell inside takes the cells within one cell size.
    ``edges`` carries building_id beside polygon_id: several polygons pool.
    Heights are at most 256 distinct values, so the exact median stays small.
    """
    box = edges.groupBy("area_id", "building_id", "polygon_id").agg(
        F.min(F.least("x1", "x2")).alias("_w"), F.max(F.greatest("x1", "x2")).alias("_e"),
        F.min(F.least("y1", "y2")).alias("_s"), F.max(F.greatest("y1", "y2")).alias("_n"))
    grid = grids.select("area_id", "west", "north", "res_m", "step_m", "width", "height")
    box = box.join(grid, "area_id")
    res = F.col("res_m")
    lowest = lambda v: F.greatest(F.lit(0), F.floor(v)).cast("int")
    x0, x1 = lowest((F.col("_w") - res - F.col("west")) / res), F.least(F.col("width") - 1, F.floor((F.col("_e") + res - F.col("west")) / res).cast("int"))
    y0, y1 = lowest((F.col("north") - F.col("_n") - res) / res), F.least(F.col("height") - 1, F.floor((F.col("north") - F.col("_s") + res) / res).cast("int"))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b))
    asked = box.withColumn("x", F.explode(span(x0, x1))).withColumn("y", F.explode(span(y0, y1))).select(
        "area_id", "building_id", "polygon_id", "x", "y", "res_m", "step_m",
        (F.col("west") + (F.col("x") + 0.5) * res).alias("px"), (F.col("north") - (F.col("y") + 0.5) * res).alias("py"))
    tall = cells.filter((F.col("validity") == 255) & (F.col("height_steps") > 0)).select("area_id", "x", "y", "height_steps")
    asked = asked.join(tall, ["area_id", "x", "y"])
    keys = ["area_id", "building_id", "polygon_id", "x", "y", "res_m", "step_m", "height_steps"]
    px, py = F.col("px"), F.col("py")
    tested = asked.join(edges.select("area_id", "polygon_id", "ring_no", "x1", "y1", "x2", "y2"), ["area_id", "polygon_id"])
    rings = tested.groupBy(*keys, "ring_no").agg(
        ((F.sum(crosses(px, py).cast("int")) % 2 == 1) | F.max(on_edge(px, py))).alias("in_ring"),
        F.min(_segment_distance(px, py)).alias("_away"))
    placed = rings.groupBy(*keys).agg(
        F.max(F.when(F.col("ring_no") == 0, F.col("in_ring")).otherwise(False)).alias("_in"),
        F.max(F.when(F.col("ring_no") > 0, F.col("in_ring")).otherwise(False)).alias("_hole"),
        F.min(F.when(F.col("in_ring"), 0.0).otherwise(F.col("_away"))).alias("_away"))
    inside = F.col("_in") & ~F.col("_hole")
    metres = F.col("height_steps") * F.col("step_m")
    found = placed.groupBy("area_id", "building_id").agg(
        F.median(F.when(inside, metres)).alias("_inside"), F.median(F.when(inside | (F.col("_away") <= F.col("res_m")), metres)).alias("_near"))
    value = F.coalesce("_inside", "_near")
    held = F.greatest(F.lit(MIN_RASTER_M), F.least(F.lit(MAX_RASTER_M), value))
    return found.filter(value.isNotNull()).select("area_id", "building_id", (half_up(held / 0.5) * 0.5).alias("raster_m"))


def holes_to_outers(outers: DataFrame, inners: DataFrame, outer_edges: DataFrame, relation: str = "relation_id") -> DataFrame:
    """Each inner ring with the smallest outer ring around its first point (null when none contains it).

    ``outers`` has polygon_id and ring_area; ``inners`` has inner_id, px, py.  Rings
    of one relation meet only each other, on bins about as wide as the outer
    ring: an outer lies in four bins at most, and a point asks one bin for every
    bin width of its relation.
    """
    extent = outer_edges.groupBy(relation, "polygon_id").agg(
        F.min(F.least("x1", "x2")).alias("_w"), F.max(F.greatest("x1", "x2")).alias("_e"),
        F.min(F.least("y1", "y2")).alias("_s"), F.max(F.greatest("y1", "y2")).alias("_n"))
    widest = F.greatest(F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s"), F.lit(1e-9))
    sized = extent.withColumn("_size", F.pow(F.lit(2.0), F.ceil(F.log2(widest))))
    cell = lambda v: F.floor(F.col(v) / F.col("_size"))
    boxes = sized.withColumn("_bx", F.explode(F.sequence(cell("_w"), cell("_e")))).withColumn("_by", F.explode(F.sequence(cell("_s"), cell("_n"))))
    asked = inners.select("inner_id", relation, "px", "py").join(shuffled(sized.select(relation, "_size").distinct()), relation)
    asked = asked.withColumns({"_bx": cell("px"), "_by": cell("py")})
    near = asked.join(shuffled(boxes), [relation, "_size", "_bx", "_by"]).filter(F.col("px").between(F.col("_w"), F.col("_e")) & F.col("py").between(F.col("_s"), F.col("_n")))
    tested = near.select("inner_id", relation, "polygon_id", "px", "py").join(shuffled(outer_edges), [relation, "polygon_id"])
    held = _inside_rings(tested, ["inner_id", relation, "polygon_id"], F.col("px"), F.col("py")).filter("in_ring")
    best = held.join(shuffled(outers.select(relation, "polygon_id", "ring_area")), [relation, "polygon_id"]).groupBy("inner_id").agg(
        F.min(F.struct("ring_area", "polygon_id")).alias("_b"))
    return inners.select("inner_id", relation).join(shuffled(best), "inner_id", "left").select("inner_id", relation, F.col("_b.polygon_id").alias("polygon_id"))
