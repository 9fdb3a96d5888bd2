"""Map ways and relations: geometry, ring stitching, ring normal form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.basics import is_finite, shuffled
from ..session import cut_lineage
from .polygons import holes_to_outers, ring_edges

# Fixed values.
GREEN_LAND_USE = ["forest", "grass", "meadow", "recreation_ground", "village_green"]
# Nodes of a relation that one task may hold; relations with more are stitched by joins.
NODES_AT_ONCE = 100_000
RING, REJECTED, LEFT = 0, 1, 2


def osm_kind(tags: str = "tags") -> Column:
    """building, road, water or green; null for anything else."""
    tag = lambda k: F.try_element_at(F.col(tags), F.lit(k))
    filled = lambda k: F.coalesce(tag(k) != "", F.lit(False))
    return (
        F.when(filled("building"), "building").when(filled("highway"), "road")
        .when((tag("natural") == "water") | (tag("waterway") == "riverbank"), "water")
        .when(tag("leisure").isin("park", "garden") | tag("landuse").isin(*GREEN_LAND_USE), "green"))


def osm_class(tags: str = "tags") -> Column:
    tag = lambda k: F.try_element_at(F.col(tags), F.lit(k))
    other = F.coalesce(tag("highway"), tag("landuse"), tag("leisure"), tag("natural"), F.lit(""))
    return F.when(osm_kind(tags) == "building", tag("building")).otherwise(other)


def way_coordinates(ways: DataFrame, nodes: DataFrame, key: str = "way_id") -> DataFrame:
    """Ways with ``coordinates`` in node order, six decimals; unknown nodes are left out."""
    known = nodes.filter(is_finite("lon") & is_finite("lat")).select(
        "node_id", F.round(F.col("lon").cast("double"), 6).alias("lon"), F.round(F.col("lat").cast("double"), 6).alias("lat"))
    flat = ways.select(key, F.posexplode("nodes").alias("pos", "node_id")).join(shuffled(known), "node_id")
    # A way holds at most a few thousand nodes, so its list is a bounded value.
    line = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("_l"))
    return ways.join(shuffled(line), key, "left").withColumn(
        "coordinates", F.transform(F.coalesce("_l", F.expr("CAST(array() AS array<struct<pos:int,lon:double,lat:double>>)")),
                                   lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))).drop("_l")


def way_features(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Map features from tagged ways: at least two points, areas closed."""
    # Ways that are nothing on the map meet no nodes.
    drawn = ways.withColumn("kind", osm_kind()).filter(F.col("kind").isNotNull())
    shaped = way_coordinates(drawn, nodes).withColumns({
        "class": osm_class(), "name": F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit(""))})
    closed = F.element_at("coordinates", 1) == F.element_at("coordinates", -1)
    return shaped.filter(F.size("coordinates") >= 2).filter((F.col("kind") == "road") | closed).withColumn(
        "geometry", F.when(F.col("kind") == "road", "LineString").otherwise("Polygon"))


def drop_represented_ways(ways: DataFrame, members: DataFrame) -> DataFrame:
    """Leave out building ways that a usable building relation already draws; ``members`` are those of usable relations."""
    inside = members.filter(F.col("type") == "way").select(F.col("ref").alias("way_id")).distinct()
    building = F.coalesce(F.try_element_at("tags", F.lit("building")) != "", F.lit(False))
    held = shuffled(inside.select(F.col("way_id").alias("_held")))
    return ways.join(held, building & (ways["way_id"] == held["_held"]), "left_anti")


def _walked(ways: list[tuple]) -> list[tuple] | None:
    """Rings (role, ring_id, nodes) of one relation's (role, way_id, nodes); None for an open or branching end."""
    rings, at = [], {}
    for way in ways:
        role, way_id, nodes = way
        if nodes[0] == nodes[-1]:
            rings.append(way)
        else:
            at.setdefault((role, nodes[0]), []).append(way)
            at.setdefault((role, nodes[-1]), []).append(way)
    if any(len(met) != 2 for met in at.values()):
        return None
    done = set()
    for role, way_id, nodes in sorted((w for met in at.values() for w in met), key=lambda w: w[:2]):
        if (role, way_id) in done:
            continue
        # The smallest way of its ring runs forward.
        ring, last = list(nodes), way_id
        done.add((role, way_id))
        while ring[-1] != ring[0]:
            one, two = at[role, ring[-1]]
            _, last, more = two if one[1] == last else one
            done.add((role, last))
            ring += more[1:] if more[0] == ring[-1] else more[-2::-1]
        rings.append((role, way_id, ring))
    return rings


def _stitched(schema: pa.Schema, most: int):
    """Relations in order of relation_id, role and way_id, one after the other; those with gaps or too many nodes are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, here, size, left = [], [], None, 0, True

        def close() -> None:
            if held and not left:
                rings = _walked(held)
                out.extend([(here, None, None, None, REJECTED)] if rings is None else [(here, *ring, RING) for ring in rings])

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for relation, role, way_id, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if relation != here or relation is None:
                    close()
                    here, held, size, left = relation, [], 0, relation is None
                if not left and held and held[-1][:2] == (role, way_id):
                    continue
                size += len(nodes or ())
                if not left and (role is None or way_id is None or nodes is None or len(nodes) < 2 or nodes[0] is None or nodes[-1] is None or size > most):
                    out.extend((here, *way, LEFT) for way in held)
                    held, left = [], True
                if left:
                    out.append((relation, role, way_id, nodes, LEFT))
                else:
                    held.append((role, way_id, nodes))
            if out:
                yield batch_of()
        close()
        if out:
            yield batch_of()

    return run


def stitch_rings(member_ways: DataFrame, max_rounds: int = 40, at_once: int = NODES_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """Join member ways into closed rings, for many relations at once.

    ``member_ways``: relation_id, role, way_id, nodes (array of at least two).
    Returns (rings: relation_id, role, ring_id, nodes; rejected: relation_id).
    A relation with an open or branching end is rejected as a whole.

    Relations meet their ways in one exchange and are walked one after the other;
    those with more than ``at_once`` nodes or with nulls go to ``stitch_by_joins``.
    """
    ways = member_ways.select("relation_id", "role", "way_id", "nodes")
    wide = StructType([StructField(f.name, f.dataType) for f in ways.schema]).add("_state", IntegerType())
    ordered = ways.repartition("relation_id").sortWithinPartitions("relation_id", "role", "way_id")
    walked = cut_lineage(ordered.mapInArrow(_stitched(to_arrow_schema(wide), at_once), wide))
    rings = walked.filter(F.col("_state") == RING).select("relation_id", "role", F.col("way_id").alias("ring_id"), "nodes")
    rejected = walked.filter(F.col("_state") == REJECTED).select("relation_id")
    rest = walked.filter(F.col("_state") == LEFT).drop("_state")
    if rest.isEmpty():
        return rings, rejected
    more, refused = stitch_by_joins(rest, max_rounds)
    return rings.unionByName(more), rejected.unionByName(refused)


def stitch_by_joins(member_ways: DataFrame, max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """``stitch_rings`` for relations of any size.

    Each way is two directed halves; the half leaving a node follows the half
    arriving there.  Pointer doubling finds every cycle's leader and each half's
    place in it in log2(longest ring) rounds, with no ring gathered in a task
    before it is complete.
    """
    ways = member_ways.select("relation_id", "role", "way_id", "nodes").dropDuplicates(["relation_id", "role", "way_id"])
    first, last = F.element_at("nodes", 1), F.element_at("nodes", -1)
    closed = ways.filter(first == last)
    open_ = ways.filter(first != last)
    ends = open_.select("relation_id", "role", "way_id", F.explode(F.array(first, last)).alias("node"))
    uneven = ends.groupBy("relation_id", "role", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != 2)
    short = member_ways.filter(F.coalesce(F.size("nodes"), F.lit(0)) < 2).select("relation_id")
    rejected = uneven.select("relation_id").unionByName(short).distinct()
    live = open_.join(rejected, "relation_id", "left_anti")
    halves = live.select("relation_id", "role", "way_id", F.lit(0).alias("dir"), first.alias("a"), last.alias("b")).unionByName(
        live.select("relation_id", "role", "way_id", F.lit(1).alias("dir"), last.alias("a"), first.alias("b")))
    here = ["relation_id", "role"]
    # The next half starts at this half's end and belongs to another way.
    following = halves.select(*here, F.col("way_id").alias("next_way"), F.col("dir").alias("next_dir"), F.col("a").alias("b"))
    chain = halves.join(following, [*here, "b"]).filter(F.col("way_id") != F.col("next_way"))
    # lead: smallest half seen ahead within the covered stretch, hops: how far on it first lies.
    me = F.struct("way_id", "dir")
    chain = cut_lineage(chain.select(*here, "way_id", "dir", "next_way", "next_dir", me.alias("lead"), F.lit(0).cast("bigint").alias("hops")))
    span = 1
    for _ in range(max_rounds):
        ahead = chain.select(*here, F.col("way_id").alias("next_way"), F.col("dir").alias("next_dir"),
                             F.col("next_way").alias("_w"), F.col("next_dir").alias("_d"), F.col("lead").alias("_lead"), F.col("hops").alias("_hops"))
        joined = chain.join(ahead, [*here, "next_way", "next_dir"])
        better = F.col("_lead") < F.col("lead")
        doubled = joined.select(
            *here, "way_id", "dir", F.col("_w").alias("next_way"), F.col("_d").alias("next_dir"),
            F.least("lead", "_lead").alias("lead"), F.when(better, F.col("_hops") + span).otherwise(F.col("hops")).alias("hops"), better.alias("moved"))
        doubled = cut_lineage(doubled)
        chain, span = doubled.drop("moved"), span * 2
        if doubled.filter("moved").isEmpty() and span > 1:
            break
    else:
        raise ValueError(f"rings of more than {span} halves: raise max_rounds")
    # A ring is found in both directions; the one led by a forward half of its smallest way stays.
    kept = chain.filter(F.col("lead.dir") == 0).join(live, [*here, "way_id"])
    # hops counts forward to the leader, so larger means earlier in the ring after the leader.
    along = F.when(F.col("dir") == 0, F.col("nodes")).otherwise(F.reverse("nodes"))
    part = F.struct(F.when(F.col("hops") == 0, F.lit(-(2**62))).otherwise(-F.col("hops")).alias("order"), along.alias("nodes"))
    rings = kept.groupBy(*here, F.col("lead.way_id").alias("ring_id")).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    glued = F.flatten(F.transform("_parts", lambda p, i: F.when(i == 0, p["nodes"]).otherwise(F.slice(p["nodes"], 2, F.size(p["nodes"])))))
    whole = closed.join(rejected, "relation_id", "left_anti").select(*here, F.col("way_id").alias("ring_id"), "nodes")
    return rings.select(*here, "ring_id", glued.alias("nodes")).unionByName(whole), rejected


def _signed_area(ring: Column) -> Column:
    """Twice-signed shoelace area over two of an open ring's point array."""
    size = F.size(ring)
    terms = F.transform(ring, lambda p, i: p["lon"] * F.get(ring, (i + 1) % size)["lat"] - F.get(ring, (i + 1) % size)["lon"] * p["lat"])
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2


def normalise_rings(rings: DataFrame, coordinates: str = "coordinates", outer: str = "is_outer") -> DataFrame:
    """Canonical closed rings: no repeats, outer counter-clockwise, inner clockwise, smallest rotation first.

    Adds ``ring`` (null when unusable) and ``ring_area`` (absolute).
    """
    c = F.col(coordinates)
    distinct_run = F.filter(c, lambda p, i: (i == 0) | (p != F.get(c, i - 1)))
    df = rings.withColumn("_run", distinct_run)
    usable = (F.size("_run") >= 4) & (F.element_at("_run", 1) == F.element_at("_run", -1))
    df = df.withColumn("_core", F.when(usable, F.slice("_run", 1, F.size("_run") - 1)))
    df = df.withColumn("_core", F.when(F.size(F.array_distinct("_core")) >= 3, F.col("_core")))
    df = df.withColumn("_area", _signed_area(F.col("_core")))
    df = df.withColumn("_core", F.when(F.col("_area") != 0, F.when((F.col("_area") > 0) == F.col(outer), F.col("_core")).otherwise(F.reverse("_core"))))
    size = F.size("_core")
    # Only rotations that start at the smallest point can be smallest.
    low = F.array_min("_core")
    starts = F.filter(F.transform("_core", lambda p, i: F.when(p == low, i)), lambda i: i.isNotNull())
    turn = lambda i: F.concat(F.slice("_core", i + 1, size), F.slice("_core", F.lit(1), i))
    best = F.array_min(F.transform(starts, turn))
    df = df.withColumn("_best", best)
    return df.withColumns({
        "ring": F.when(F.col("_best").isNotNull(), F.concat("_best", F.slice("_best", 1, 1))), "ring_area": F.abs("_area"),
    }).drop("_run", "_core", "_area", "_best")


def relation_features(relations: DataFrame, members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Building features from multipolygon relations: relation_id, class, name, geometry, polygons.

    ``relations``: relation_id, tags; ``members``: relation_id, type, ref, role (none
    means outer).  ``polygons`` is an array of polygons, each its outer ring and
    then its holes, all in normal form and in order of their points.

    A relation is left out as a whole for a member that is no way, a foreign role,
    a way that is missing or too short, an end that meets no other, a ring with
    an unknown node or without area, or a hole in no outer ring.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    wanted = relations.filter((tag("type") == "multipolygon") & F.coalesce(tag("building") != "", F.lit(False)))
    role = F.when(F.coalesce("role", F.lit("")) == "", "outer").otherwise(F.col("role"))
    own = members.join(shuffled(wanted.select("relation_id")), "relation_id", "left_semi").select("relation_id", "type", F.col("ref").alias("way_id"), role.alias("role"))
    own = own.join(shuffled(ways.select("way_id", "nodes")), "way_id", "left")
    usable = F.coalesce((F.col("type") == "way") & F.col("role").isin("outer", "inner") & (F.size("nodes") >= 2), F.lit(False))
    own = cut_lineage(own.withColumn("_usable", usable))
    found, refused = stitch_rings(own.filter("_usable").drop("_usable", "type"))
    lost = own.filter(~F.col("_usable")).select("relation_id").unionByName(refused).distinct()
    found = found.join(shuffled(lost), "relation_id", "left_anti").withColumns({
        "_key": F.struct("relation_id", "role", "ring_id"), "is_outer": F.col("role") == "outer"})
    shaped = normalise_rings(way_coordinates(found, nodes, "_key"))
    whole = F.col("ring").isNotNull() & (F.size("coordinates") == F.size("nodes"))
    shaped = cut_lineage(shaped.select("relation_id", "is_outer", F.col("ring_id").alias("polygon_id"), "ring", "ring_area", whole.alias("_whole")))
    good = shaped.join(shuffled(shaped.filter(~F.col("_whole")).select("relation_id").distinct()), "relation_id", "left_anti").drop("_whole")
    outers, inners = good.filter("is_outer"), good.filter(~F.col("is_outer")).withColumn("inner_id", F.struct("relation_id", "polygon_id"))
    flat = outers.withColumn("ring", F.transform("ring", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))
    first = F.element_at("ring", 1)
    placed = holes_to_outers(outers, inners.select("inner_id", "relation_id", first["lon"].alias("px"), first["lat"].alias("py")),
                             ring_edges(flat, ["relation_id", "polygon_id"]))
    placed = cut_lineage(placed.join(shuffled(inners.select("inner_id", "ring")), "inner_id"))
    homeless = placed.filter(F.col("polygon_id").isNull()).select("relation_id").distinct()
    # Rings of a polygon and polygons of a relation are one feature's own geometry.
    holes = placed.groupBy("relation_id", "polygon_id").agg(F.array_sort(F.collect_list("ring")).alias("_holes"))
    parts = outers.join(shuffled(homeless), "relation_id", "left_anti").join(shuffled(holes), ["relation_id", "polygon_id"], "left")
    rings = F.when(F.col("_holes").isNull(), F.array("ring")).otherwise(F.concat(F.array("ring"), "_holes"))
    drawn = parts.groupBy("relation_id").agg(F.array_sort(F.collect_list(rings)).alias("polygons"))
    return wanted.join(shuffled(drawn), "relation_id").select(
        "relation_id", tag("building").alias("class"), F.coalesce(tag("name"), F.lit("")).alias("name"),
        F.when(F.size("polygons") == 1, "Polygon").otherwise("MultiPolygon").alias("geometry"), "polygons")


def map_features(ways: DataFrame, nodes: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """Way features, then relation features: source, feature_id, kind, class, name, geometry, polygons, line.

    A building way goes only where one of its relations became a feature.
    """
    drawn = cut_lineage(relation_features(relations, members, ways, nodes))
    held = members.join(shuffled(drawn.select("relation_id")), "relation_id", "left_semi")
    single = way_features(drop_represented_ways(ways, held), nodes)
    area = F.col("geometry") == "Polygon"
    one = single.select(
        F.lit("way").alias("source"), F.col("way_id").alias("feature_id"), "kind", "class", "name", "geometry",
        F.when(area, F.array(F.array("coordinates"))).alias("polygons"), F.when(~area, F.col("coordinates")).alias("line"))
    two = drawn.select(F.lit("relation").alias("source"), F.col("relation_id").alias("feature_id"), F.lit("building").alias("kind"), "class", "name", "geometry", "polygons")
    return one.unionByName(two, allowMissingColumns=True)
