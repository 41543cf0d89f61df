"""Crop statistics of many objects in one pass equal Spark's percentiles, wherever the Arrow batches are cut."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.operators import evidence

PX = "field_id string, label_id bigint, z int, y int, x int, value double, distance double"


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, old)


def test_crops_equal_percentiles(spark, small_batches):
    rng = np.random.default_rng(5)
    rows = []
    for o in range(12):
        # One object has no outside, one no value at all, one too small a ring.
        for i in range(90 if o % 3 else 11):
            v = None if o == 4 or rng.random() < 0.1 else float(rng.integers(0, 40))
            rows.append((f"f{o % 2}", o, i // 9, i % 9, 0, v, 0.0 if o == 5 or i < 3 else float(rng.random() * 3)))
    px = spark.createDataFrame(rows, PX)
    shells = {"near": (lambda d: (d > 0) & (d <= 1.5), 0.75)}
    stats, voxels = evidence.crop_evidence(px, (1.0, 2.5), 0.99, lambda s: s["bg_median"] + s["bg_mad"], lambda v, d, t: v > t, shells)
    ring = F.col("distance").between(1.0, 2.5)
    bg = px.join(px.groupBy("label_id").agg((F.count_if(ring) >= 32).alias("e")), "label_id").where(F.when(F.col("e"), ring).otherwise(F.col("distance") > 0))
    p = lambda c, q: F.percentile(c, F.lit(q))
    m = bg.groupBy("label_id").agg(p("value", 0.5).alias("m"), p("value", 0.75).alias("p75"))
    mad = bg.join(m, "label_id").groupBy("label_id").agg((1.4826 * p(F.abs(F.col("value") - F.col("m")), 0.5)).alias("mad"))
    t = m.join(mad, "label_id").join(px.groupBy("label_id").agg(p("value", 0.99).alias("high"), p(F.when(F.col("distance").between(1e-9, 1.5), F.col("value")), 0.75).alias("q")), "label_id")
    want = {r.label_id: tuple(r)[1:] for r in t.where("m IS NOT NULL").collect()}
    got = {r.label_id: (r.bg_median, r.bg_p75, r.bg_mad, r.high, r.near_q) for r in stats.where("threshold IS NOT NULL").collect()}
    assert stats.count() == 12 and len(got) == 10 and got == want
    passed = px.join(t, "label_id").where(F.col("value") > F.col("m") + F.col("mad")).select("label_id", "z", "y")
    assert {tuple(r) for r in voxels.where("on").select("label_id", "z", "y").collect()} == {tuple(r) for r in passed.collect()}


def test_reach_is_exact(spark):
    rng = np.random.default_rng(6)
    at = lambda n: {(int(rng.integers(3)), *(int(v) for v in rng.integers(0, 12, 3))) for _ in range(n)}
    points, targets = at(150), at(60)
    df = lambda s: spark.createDataFrame([("f", *r) for r in s], "field_id string, label_id bigint, z int, y int, x int")
    got = evidence.within_reach(df(points), df(targets), {"z": 0.3, "y": 0.25, "x": 0.25}, evidence.OBJ, 0.55)
    near = {p for p in points if any(p[0] == q[0] and (p[1] - q[1]) ** 2 * 0.09 + ((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) * 0.0625 <= 0.3025 + 1e-12 for q in targets)}
    assert {(r.label_id, r.z, r.y, r.x) for r in got.collect()} == near and got.count() == len(near)
