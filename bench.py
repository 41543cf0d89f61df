"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local threads),
BENCH_ONLY (optional comma-separated query names).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rasterspark.plans import QUERIES  # noqa: E402
from rasterspark.session import local_session  # noqa: E402

HEADLINE = (
    "e01_measure_regions", "e10_measurement_window_qc", "c02_project_z", "c04_select_active_z", "b01_robust01", "b05_structural_map",
    "b06_threshold_otsu", "d01_gaussian", "d06_ridge_response", "d09_distance_to", "d02_close", "g01_components", "g01_components_mosaic", "g03_grow", "g05_seeded_assign_mosaic", "e16_overlap_counts",
    "f02_unique_match", "f08_group_fragments", "e17_pairwise_iou", "h03_rank_candidates", "i01_partition_compartments", "i10_apply_ledger", "j02_terminal_latch",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One small run starts the JVM code paths and the Python workers.
    QUERIES["d01_gaussian"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total_wall", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
