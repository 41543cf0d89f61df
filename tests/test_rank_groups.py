"""Ranking steps over many small windows: near duplicates close in one pass, peers need no window of their own."""

from __future__ import annotations

import math

import numpy as np
import pytest

from rasterspark.operators import graph, rank


@pytest.mark.parametrize("batch", ["5", "10000"])
def test_near_duplicates_close_in_one_pass(spark, monkeypatch, batch):
    rng = np.random.default_rng(3)
    rows = [(f"f{f}", p, 10**12 + int(a), 10**12 + int(b)) for f in range(5) for p in range(3) for a, b in rng.integers(0, 14, (9, 2))]
    edges = spark.createDataFrame(rows, "field_id string, position int, a bigint, b bigint")
    want = sorted(map(tuple, graph.label_closure(edges, rank.KEYS).select(*rank.KEYS, "node", "root").collect()))

    def no_round(df):
        raise AssertionError("a round of a closure was written")

    monkeypatch.setattr(graph, "cut_lineage", no_round)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        assert sorted(map(tuple, graph.group_closure(edges, rank.KEYS).select(*rank.KEYS, "node", "root").collect())) == want
        metrics = spark.createDataFrame([("f", 1, c, "m" if c < 5 else "n") for c in range(1, 7)], "field_id string, position int, candidate int, family string")
        pairs = spark.createDataFrame([("f", 1, 1, 3, 1.0), ("f", 1, 3, 4, 0.995), ("f", 1, 4, 5, 1.0), ("f", 1, 5, 6, 0.99)], "field_id string, position int, a int, b int, iou double")
        got = {r.candidate: r.representative for r in rank.near_duplicate_clusters(metrics, pairs).collect()}
        assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 6}
    finally:
        spark.conf.set(key, old)


def test_weighted_rank_has_no_window_per_value(spark):
    values = [1.0, 1.0, None, 0.0, -0.0, math.nan, 7.5, None, math.nan, 1.0]
    rows = [(str(f), i, v, float(i % 4)) for f in range(3) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "field_id string, i int, v double, w double")
    df = df.select("field_id", "i", rank.weighted_rank01(df.v, df.w, ["field_id"]).alias("r"))
    place = lambda v: (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)
    total = sum(float(i % 4) for i in range(len(values)))
    for r in df.collect():
        below = sum(j % 4 for j, v in enumerate(values) if place(v) < place(values[r.i]))
        same = sum(j % 4 for j, v in enumerate(values) if place(v) == place(values[r.i]))
        assert r.r == pytest.approx((below + same / 2) / total, abs=1e-12)
    assert df._jdf.queryExecution().sparkPlan().toString().count("Window [") == 2
