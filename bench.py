"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from umbraline.catalog import QUERIES
from umbraline.session import build_session

HEADLINE = [
    "densify_samples", "score_journeys", "score_schedules", "ground_shadow", "label_routes", "departure_advice",
    "exposure_profile", "downsample_cells", "building_heights", "footprint_point_shade", "near_duplicates",
    "nearby_features", "calibration_by_area", "walk_summary", "skyline", "event_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.enabled": "false"})
    spark.range(1_000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in (n for n in HEADLINE if n in QUERIES):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    # Throughput in the reference's own unit: sample rays judged per second.
    from pyspark.sql import functions as F

    rays = QUERIES["densify_samples"](spark, folder).agg(F.sum("samples")).first()[0]
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")), "sample_rays": rays, "rays_per_sec": round(rays / took["score_journeys"]),
        "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
