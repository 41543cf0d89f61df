"""Distances of many small objects: lines of all objects in one pass, cut anywhere between Arrow batches, and nothing broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from rasterspark.operators import focal, zonal

SEED = "field_id string, label_id bigint, y int, x int, height int, width int"


def test_objects_share_batches(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for i in range(30):
        h, w = int(rng.integers(1, 9)), int(rng.integers(1, 12))
        field = None if i == 7 else f"f{i % 4}"
        at = sorted({(int(rng.integers(h)), int(rng.integers(w))) for _ in range(5)})
        rows += [(field, i, y, x, h, w) for y, x in at]
        for y in range(h):
            for x in range(w):
                want[field, i, y, x] = min((y - a) ** 2 * 0.25 + (x - b) ** 2 * 0.09 for a, b in at) ** 0.5
    df = spark.createDataFrame(rows, SEED)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for size in ("3", "10000"):
            spark.conf.set(key, size)
            # A key may be a struct.
            near = focal.nearest_seed(df.withColumn("at", F.struct("label_id", "field_id")), {"y": 0.5, "x": 0.3}, ["field_id", "label_id", "at"], label=None, block_px=40)
            assert near.count() == len(want)
            near = focal.nearest_seed(df, {"y": 0.5, "x": 0.3}, ["field_id", "label_id"], label=None, block_px=40)
            got = {(r.field_id, r.label_id, r.y, r.x): r.distance for r in near.collect()}
            assert got.keys() == want.keys()
            assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    finally:
        spark.conf.set(key, old)


def test_thickness_has_no_group_per_object_and_no_broadcast(spark):
    px = spark.createDataFrame([("f", 1, i // 8, i % 8, 9, 9) for i in range(64)], SEED)
    plan = zonal.thickness(px, {"y": 1.0, "x": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "FlatMapGroupsInArrow" not in plan
