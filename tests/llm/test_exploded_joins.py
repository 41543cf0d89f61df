"""The joins of exploded fingerprints are shuffled, whatever size the planner guesses."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rasterspark.llm import simhash


@pytest.mark.parametrize("name", ["links", "groups"])
def test_no_broadcast(spark, tmp_path, name):
    spark.range(300).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fp")
    prints = spark.read.parquet(f"{tmp_path}/fp")
    if name == "links":
        df = simhash.links(prints)
    else:
        df = simhash.simhash_groups(prints.select(F.col("fp").alias("doc_id"), F.col("fp").cast("string").alias("text")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
