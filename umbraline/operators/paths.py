"""Non-dominated walking paths over exposure graphs, for many origin-destination pairs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.basics import holds, is_finite
from ..session import cut_lineage

# Fixed values.
EPSILON = 1e-9
MAX_HOPS, MAX_LABELS, MAX_RESULTS, MAX_EXPANDED = 512, 48, 8, 50_000
SALT = 16


def edge_checks() -> list[tuple[str, Column]]:
    text = lambda c: F.length(F.trim(F.col(c).cast("string"))) > 0
    costs = is_finite("sun_s") & is_finite("unknown_s") & (F.col("sun_s") >= 0) & (F.col("unknown_s") >= 0)
    return [
        ("identifiers", text("edge_id") & text("src") & text("dst")),
        ("duration", is_finite("duration_s") & (F.col("duration_s") > 0)),
        ("costs", costs & (F.col("sun_s") + F.col("unknown_s") <= F.col("duration_s") + EPSILON)),
    ]


def validate_edges(edges: DataFrame) -> DataFrame:
    """Edges with ``problem``: null, a broken rule, or 'duplicate-id' (all holders of a repeated id)."""
    problem = F.lit(None).cast("string")
    for name, ok in reversed(edge_checks()):
        problem = F.when(~holds(ok), name).otherwise(problem)
    twice = edges.groupBy("graph_id", "edge_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    marked = edges.withColumn("problem", problem).join(twice, ["graph_id", "edge_id"], "left")
    return marked.withColumn("problem", F.coalesce("problem", F.when(F.col("_n").isNotNull(), "duplicate-id"))).drop("_n")


def _undominated(df: DataFrame, keys: list[str], order: list[str | Column], exposure: str) -> DataFrame:
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    best = F.min(exposure).over(before)
    return df.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col(exposure) < F.col("_best") - EPSILON)).drop("_best")


def skyline(df: DataFrame, keys: list[str], order: list[str | Column] | None = None, duration: str = "duration_s",
            exposure: str = "exposure_s", salt: Column | None = None) -> DataFrame:
    """Rows not dominated on (duration, exposure) within their key; of equal rows the first in order stays.

    With ``salt`` a first pass prunes salted slices of each key, so a hot key
    spreads out and only slice winners meet in the second pass.
    """
    order = [duration, exposure, *(order or [])]
    if salt is not None:
        df = _undominated(df.withColumn("_salt", salt), [*keys, "_salt"], order, exposure).drop("_salt")
    return _undominated(df, keys, order, exposure)


def pareto_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = MAX_HOPS, max_labels: int = MAX_LABELS,
                 max_results: int = MAX_RESULTS, max_expanded: int = MAX_EXPANDED) -> DataFrame:
    """Non-dominated simple paths per pair (pair_id, graph_id, origin, destination).

    Level by level: extend every live label over its out-edges, keep the
    undominated labels per (pair, node), continue with the new ones.  The loop
    runs over levels, not rows; each level is written to a reliable checkpoint.
    Nothing is cut in silence.  A pair that expands more labels than allowed
    yields one row with ``problem`` set and no path; a pair with labels beyond
    ``max_labels`` at a node, or still growing after ``max_hops``, has its paths
    and one more row, without path, that names the bound.
    """
    if min(max_hops, max_labels, max_results, max_expanded) < 1:
        raise ValueError("bounds must be positive")
    node_type = dict(edges.dtypes)["src"]
    id_type = dict(edges.dtypes)["edge_id"]
    out = edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("_to"), "edge_id",
                       F.col("duration_s").alias("_d"), F.col("sun_s").alias("_s"), F.col("unknown_s").alias("_u"))
    start = pairs.select(
        "pair_id", "graph_id", "destination", F.col("origin").cast(node_type).alias("node"),
        F.lit(0.0).alias("duration_s"), F.lit(0.0).alias("sun_s"), F.lit(0.0).alias("unknown_s"), F.lit(0.0).alias("exposure_s"),
        F.array().cast(f"array<{id_type}>").alias("edge_ids"), F.array(F.col("origin").cast(node_type)).alias("nodes"), F.lit(0).alias("hop"))
    names = start.columns
    kept = cut_lineage(start)
    live = kept
    spent = cut_lineage(pairs.select("pair_id", F.lit(0).cast("bigint").alias("expanded")))
    text = F.array_join(F.col("edge_ids").cast("array<string>"), " ")
    cut: list[DataFrame] = []
    for hop in range(1, max_hops + 1):
        growing = live.filter(F.col("node") != F.col("destination"))
        spent = cut_lineage(spent.unionByName(growing.groupBy("pair_id").agg(F.count(F.lit(1)).alias("expanded")))
                            .groupBy("pair_id").agg(F.sum("expanded").alias("expanded")))
        over = spent.filter(F.col("expanded") > max_expanded).select("pair_id")
        if not over.isEmpty():
            growing = growing.join(over, "pair_id", "left_anti")
        reached = growing.join(out, ["graph_id", "node"])
        reached = reached.filter(~F.array_contains("nodes", F.col("_to"))).select(
            "pair_id", "graph_id", "destination", F.col("_to").alias("node"), (F.col("duration_s") + F.col("_d")).alias("duration_s"),
            (F.col("sun_s") + F.col("_s")).alias("sun_s"), (F.col("unknown_s") + F.col("_u")).alias("unknown_s"),
            (F.col("exposure_s") + F.col("_s") + F.col("_u")).alias("exposure_s"),
            F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), F.concat("nodes", F.array("_to")).alias("nodes"), F.lit(hop).alias("hop"))
        # One exchange, which text and ranks do without; a node has max_labels labels for each edge into it at most.
        both = kept.unionByName(reached).repartition("pair_id", "node").withColumn("_path", text)
        best = skyline(both, ["pair_id", "node"], ["unknown_s", "_path"])
        ranked = W.partitionBy("pair_id", "node").orderBy("duration_s", "exposure_s", "unknown_s", "_path")
        most = cut_lineage(best.withColumn("_rank", F.row_number().over(ranked)).select(*names, "_rank"))
        kept = most.filter(F.col("_rank") <= max_labels).select(*names)
        beyond = most.filter((F.col("_rank") > max_labels) & (F.col("node") != F.col("destination"))).select("pair_id").distinct()
        if not beyond.isEmpty():
            cut.append(beyond.withColumn("problem", F.lit("node-label-bound")))
        live = kept.filter(F.col("hop") == hop)
        if live.isEmpty():
            break
    else:
        growing = live.filter(F.col("node") != F.col("destination")).select("pair_id").distinct()
        cut.append(growing.withColumn("problem", F.lit("hop-bound")))
    order = W.partitionBy("pair_id").orderBy("duration_s", "exposure_s", "unknown_s", text)
    over = spent.filter(F.col("expanded") > max_expanded).select("pair_id")
    found = kept.filter(F.col("node") == F.col("destination")).join(over, "pair_id", "left_anti")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_results)
    found = found.select("pair_id", "rank", "duration_s", "sun_s", "unknown_s", "exposure_s", "edge_ids", "nodes", F.lit(None).cast("string").alias("problem"))
    problems = over.withColumn("problem", F.lit("label-expansion-bound"))
    for part in cut:
        problems = problems.unionByName(part.join(over, "pair_id", "left_anti"))
    return found.unionByName(problems.distinct(), allowMissingColumns=True)


def edge_costs(bucket_scores: DataFrame) -> DataFrame:
    """Graph edge costs from journey scores of edges walked in time buckets.

    The score counts unknown daylight as sun; a graph keeps the two apart.
    """
    return bucket_scores.select(
        F.col("route_id").alias("edge_id"), F.col("journey").alias("bucket"), F.col("walk_s").alias("duration_s"),
        F.greatest(F.lit(0.0), F.col("sun_s") - F.col("unknown_s")).alias("sun_s"), "unknown_s")
