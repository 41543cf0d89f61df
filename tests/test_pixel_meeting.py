"""Tables of pixels meet in partitions by their number, whatever the planner guesses of exploded rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterspark.operators import ledger


def cells(spark, fields=40, side=32):
    i = F.col("i")
    px = spark.range(fields).repartition(2, "id").select(F.col("id").cast("string").alias("field_id"), F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("i"))
    return px.select("field_id", F.floor(i / side).cast("int").alias("y"), (i % side).cast("int").alias("x"), (F.floor(i / (side * side // 2)) + 1).alias("cell_id"))


def test_partitions_follow_the_pixels(spark, monkeypatch):
    monkeypatch.setattr(ledger, "MEET_PIXELS", 2000, raising=False)
    whole = cells(spark)
    soma = whole.where((F.col("x") < 8) & (F.col("y") < 8))
    stray = spark.createDataFrame([("0", 99, 0, 1)], whole.schema)
    out = ledger.partition_compartments(whole, soma.union(soma).union(stray))
    # 40,960 pixels of cells, 5,121 of somas.
    assert out.rdd.getNumPartitions() == (40960 + 5121) // 2000 + 1
    assert {(r.part, r["count"]) for r in out.groupBy("part").count().collect()} == {("soma", 2560), ("processes", 38400)}
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan.split("Initial Plan")[0] and "SortMergeJoin" in plan

    proc = whole.join(soma, whole.columns, "left_anti").where(~((F.col("field_id") == "3") & (F.col("x") == 20)))
    got = {tuple(r) for r in ledger.check_partition(whole, soma.union(stray), proc).collect()}
    assert got == {("3", 1, "not_covered", 16), ("3", 2, "not_covered", 16), ("0", 1, "soma_outside_whole", 1)}
