"""The pixels of a split are joined by shuffles, whatever size the planner guesses."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterspark.operators import partition


def test_child_pixels_are_never_broadcast(spark):
    px = spark.range(100).select(
        F.lit("f").alias("field_id"), F.lit(1).cast("long").alias("cell_id"), F.floor(F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"),
        F.lit(10).alias("height"), F.lit(10).alias("width"), F.lit("processes").alias("part"))
    at = ["field_id", "cell_id", "y", "x"]
    seeds = px.where("y = 5 AND x IN (2, 7)").select(*at, F.when(F.col("x") == 2, 1).otherwise(2).cast("long").alias("label_id"))
    half = px.where("y = 5").select(*at, F.when(F.col("x") < 5, 1).otherwise(2).cast("long").alias("label_id"))
    child = partition.child_gates(px, half, seeds, (0.25, 0.25))
    assert "Broadcast" not in child._jdf.queryExecution().executedPlan().toString()
    rows = child.collect()
    assert len(rows) == 100 and all(r.label_id == (1 if r.x < 5 else 2) for r in rows)
