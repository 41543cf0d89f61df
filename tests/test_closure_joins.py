"""Pairs and closures of large tables are joined by shuffles, whatever the planner guesses."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterspark.operators import graph, match

REC = "field_id string, object_id bigint, component_2d bigint, z_min int, z_max int, center_z double, center_y double, center_x double, volume_um3 double"


def test_grid_pairs_are_never_broadcast(spark):
    o = spark.createDataFrame([("f", i, 0, 0, 3, 1.0, float(i % 7), float(i % 5), 10.0) for i in range(40)], REC)
    plan = match.fragment_pairs(o, (0.25, 0.25), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_closure_is_the_same_by_shuffles(spark, monkeypatch):
    e = spark.range(300).select(F.lit("f").alias("field_id"), F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 10 < 9, 1).otherwise(0)).alias("b"))
    want = {(r.node, r.root) for r in graph.label_closure(e).collect()}
    assert want == {(i, i - i % 10) for i in range(300)}
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
    assert {(r.node, r.root) for r in graph.label_closure(e).collect()} == want
