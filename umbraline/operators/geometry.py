"""Route geometry as tables: segments, running distance, samples.

A route is cut into chunks of CHUNK numbers of ``seq``, and windows run over a chunk.
Running sums are those of the chunk plus an offset, which one short row per chunk
yields (the first vertex of the next chunk closes the last segment of a chunk), so a
route of millions of vertices is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_m

CHUNK = 4_096
SAMPLE_SPACING_M = 8.0
ZERO_M = 1e-9
DUPLICATE_SAMPLES = 41


def spread(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Hash-partition by key into as many partitions as the caller says, else four times those of the session's shuffles.

    Samples and ray steps multiply a row a hundredfold after the shuffle, hence
    the smaller partitions, and AQE must not merge them by their size before
    that; a stated number is kept. Windows and groupings on the keys reuse the partitioning.
    """
    spark = df.sparkSession
    base = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(partitions or 4 * base, *keys)


def span_m(x1: str, y1: str, x2: str, y2: str, metric: str) -> Column:
    """Length between two points: great circle over lon/lat, or straight over metres."""
    if metric == "haversine":
        return haversine_m(y1, x1, y2, x2)
    dx, dy = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def segments(vertices: DataFrame, key: str = "route_id", x: str = "lon", y: str = "lat", metric: str = "haversine",
             partitions: int | None = None, lone: bool = False, spacing_m: float = SAMPLE_SPACING_M, chunk: int = CHUNK) -> DataFrame:
    """Consecutive vertex pairs with length, distance before them and route total.

    With ``lone`` a route of one vertex is a segment of no length.

    Output: key, seg_idx, x1, y1, x2, y2, length_m, start_m, total_m, and for samples: chunk, last (of its route), pieces (of
    at most ``spacing_m``), first_piece and zeros_before (pieces, and segments of no length, before the segment).
    """
    order = W.partitionBy(key, "chunk").orderBy("seq")
    placed = vertices.select(key, "seq", F.col(x).alias("x1"), F.col(y).alias("y1"), F.floor(F.col("seq") / chunk).alias("chunk"))
    pairs = spread(placed, key, "chunk", partitions=partitions).select(
        key, "chunk", (F.row_number().over(order) - 1).alias("_n"), "x1", "y1",
        F.lead("x1").over(order).alias("x2"), F.lead("y1").over(order).alias("y2"))
    pairs = pairs.withColumn("length_m", span_m("x1", "y1", "x2", "y2", metric)).withColumn("pieces", _pieces(spacing_m))
    zero = F.when(F.col("length_m") <= ZERO_M, 1).otherwise(0)
    parts = pairs.groupBy(key, "chunk").agg(
        F.count(F.lit(1)).alias("_many"), F.coalesce(F.sum("length_m"), F.lit(0.0)).alias("_m"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("_p"), F.sum(zero).alias("_z"),
        F.min_by(F.struct("x1", "y1"), "_n").alias("_head"), F.max_by(F.struct("x1", "y1"), "_n").alias("_tail"))
    line = W.partitionBy(key).orderBy("chunk")
    parts = parts.withColumn("_next", F.lead("_head").over(line)).select(
        "*", F.col("_tail.x1").alias("_ax"), F.col("_tail.y1").alias("_ay"), F.col("_next.x1").alias("_bx"), F.col("_next.y1").alias("_by"))
    gap = span_m("_ax", "_ay", "_bx", "_by", metric)
    parts = parts.withColumn("_gap", F.when(F.col("_next").isNotNull(), gap)).withColumns({
        "_gp": F.when(F.col("_next").isNotNull(), _pieces(spacing_m, "_gap")).otherwise(0), "_gz": F.when(F.col("_gap") <= ZERO_M, 1).otherwise(0)})
    before = lambda c: F.coalesce(F.sum(c).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_all", F.col("_m") + F.coalesce("_gap", F.lit(0.0))).select(
        F.col(key).alias("_key"), F.col("chunk").alias("_chunk"), "_many", "_next", "_gap", "_gp", before("_many").cast("int").alias("_base_n"), before("_all").alias("_base_m"),
        before(F.col("_p") + F.col("_gp")).alias("_base_p"), before(F.col("_z") + F.col("_gz")).alias("_base_z"),
        F.sum("_all").over(W.partitionBy(key)).alias("total_m"), F.sum("_many").over(W.partitionBy(key)).alias("_whole"))
    run = W.partitionBy(key, "chunk").orderBy("_n").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(run), F.lit(0))
    pairs = pairs.withColumns({"start_m": so_far("length_m").cast("double"), "first_piece": so_far("pieces"), "zeros_before": so_far(zero)})
    # The pairs stay where they are, sorted; were they small enough to be broadcast, later steps would run in the few tasks of parts.
    joined = pairs.hint("merge").join(parts, (pairs[key] == parts["_key"]) & (pairs["chunk"] == parts["_chunk"]))
    closing = F.col("_n") == F.col("_many") - 1   # the last vertex of a chunk
    alone = closing & (F.col("_whole") == 1) if lone else F.lit(False)
    joined = joined.withColumns({
        "x2": F.when(alone, F.col("x1")).when(closing, F.col("_next.x1")).otherwise(F.col("x2")), "y2": F.when(alone, F.col("y1")).when(closing, F.col("_next.y1")).otherwise(F.col("y2")),
        "length_m": F.when(alone, 0.0).when(closing, F.col("_gap")).otherwise(F.col("length_m")), "pieces": F.when(alone, 1).when(closing, F.col("_gp")).otherwise(F.col("pieces"))})
    index = F.col("_base_n") + F.col("_n")
    return joined.filter(F.col("x2").isNotNull()).select(
        key, index.alias("seg_idx"), "x1", "y1", "x2", "y2", "length_m", (F.col("_base_m") + F.col("start_m")).alias("start_m"), "total_m", "chunk",
        (index >= F.col("_whole") - 2).alias("last"), F.col("pieces").cast("int").alias("pieces"), (F.col("_base_p") + F.col("first_piece")).alias("first_piece"),
        (F.col("_base_z") + F.col("zeros_before")).alias("zeros_before"))


def _pieces(spacing_m: float, length: str = "length_m") -> Column:
    """Equal pieces no longer than the spacing; null where there is no length."""
    return F.when(F.col(length).isNotNull(), F.greatest(F.lit(1), F.ceil(F.col(length) / spacing_m)))


def route_lengths(vertices: DataFrame, key: str = "route_id", x: str = "lon", y: str = "lat",
                  metric: str = "haversine") -> DataFrame:
    """Vertex count and geometry length per route, single-vertex routes included."""
    order = W.partitionBy(key).orderBy("seq")
    hop = vertices.select(
        key, F.col(x).alias("x1"), F.col(y).alias("y1"),
        F.lead(x).over(order).alias("x2"), F.lead(y).over(order).alias("y2"))
    return hop.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"),
        F.coalesce(F.sum(span_m("x1", "y1", "x2", "y2", metric)), F.lit(0.0)).alias("geometry_m"))


def densify(segs: DataFrame, skip_zero: bool = False, key: str = "route_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut every segment into its equal pieces.

    ``skip_zero`` is the footprint model's rule: zero-length segments give no piece.
    Output adds piece, sample_idx, x_start..y_mid, piece_m, piece_start_m, mid_fraction, chunk.
    """
    first = F.col("first_piece")
    if skip_zero:
        segs, first = segs.filter(F.col("length_m") > ZERO_M), first - F.col("zeros_before")
    cut = segs.withColumn("_first", first).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    lo, hi = F.col("piece") / F.col("pieces"), (F.col("piece") + 1) / F.col("pieces")
    at = lambda a, b, f: F.col(a) + (F.col(b) - F.col(a)) * f
    mid = (lo + hi) / 2
    return cut.select(
        key, "seg_idx", "piece", (F.col("_first") + F.col("piece")).cast("int").alias("sample_idx"),
        at("x1", "x2", lo).alias("x_start"), at("y1", "y2", lo).alias("y_start"),
        at("x1", "x2", mid).alias("x_mid"), at("y1", "y2", mid).alias("y_mid"),
        at("x1", "x2", hi).alias("x_end"), at("y1", "y2", hi).alias("y_end"),
        (F.col("length_m") / F.col("pieces")).alias("piece_m"),
        (F.col("start_m") + F.col("piece") * (F.col("length_m") / F.col("pieces"))).alias("piece_start_m"),
        F.when(F.col("total_m") > 0, (F.col("start_m") + F.col("length_m") * mid) / F.col("total_m"))
        .otherwise(0.0).alias("mid_fraction"),
        "total_m", "chunk", *carry,
    )


def resample(segs: DataFrame, count: int = DUPLICATE_SAMPLES, key: str | list[str] = "route_id") -> DataFrame:
    """``count`` equally spaced points per route; routes of zero length give none. ``key``: the columns kept.

    Each segment emits the targets it owns - those beyond its start and up to
    its end, with target 0 owned by the first segment - so no lookup join is needed.
    """
    last = count - 1
    live = segs.filter(F.col("total_m") > 0)
    end_m = F.col("start_m") + F.col("length_m")
    # Candidate target numbers around the segment, then the exact ownership test.
    low = F.greatest(F.lit(0), F.floor(F.col("start_m") / F.col("total_m") * last) - 1).cast("int")
    high = F.least(F.lit(last), F.ceil(end_m / F.col("total_m") * last) + 1).cast("int")
    spread = live.withColumn("sample_no", F.explode(F.sequence(low, high)))
    target = F.col("total_m") * F.col("sample_no") / last
    owned = ((target > F.col("start_m")) | (F.col("seg_idx") == 0)) & ((target <= end_m) | F.col("last"))
    fraction = F.when(F.col("length_m") > 0, (target - F.col("start_m")) / F.col("length_m")).otherwise(0.0)
    return spread.filter(owned).select(
        *([key] if isinstance(key, str) else key), "sample_no",
        (F.col("x1") + (F.col("x2") - F.col("x1")) * fraction).alias("x"),
        (F.col("y1") + (F.col("y2") - F.col("y1")) * fraction).alias("y"))


def reverse_routes(routes: DataFrame) -> DataFrame:
    """Routes walked backwards: coordinates reversed, directions cleared, their text kept for access checks."""
    text = F.array_join(F.transform("directions", lambda d: d["instruction"]), " ")
    return routes.withColumns({
        "route_id": F.concat("route_id", F.lit("-reversed")),
        "coordinates": F.reverse("coordinates"),
        "access_reference": text,
        "directions": F.filter("directions", lambda d: F.lit(False)),
    })
