"""Fields of one tile are done inside it; planes are projected, written and thresholded once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterspark.operators import depth, graph, local
from rasterspark.plans import zonal_queries

PX = "field_id string, y int, x int, height int, width int"


def _mask(spark, n=6, h=20, w=23, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"f{i}", y, x, h, w) for i in range(n) for y in range(h) for x in range(w) if rng.random() < 0.45], PX)


@pytest.mark.parametrize("dense", [True, False])
def test_components_of_one_tile_need_no_closure(spark, monkeypatch, dense):
    mask = _mask(spark)
    rows = lambda df: sorted(map(tuple, df.select("field_id", "y", "x", "height", "width", "label_id").collect()))
    many = rows(graph.components(mask, dense=dense, tile=7))

    def no(*_):
        raise AssertionError("closed without tile borders")

    monkeypatch.setattr(graph, "label_closure", no)
    assert rows(graph.components(mask, dense=dense)) == many
    with pytest.raises(AssertionError):
        graph.components(mask, dense=dense, tile=7)


def test_assignment_of_one_tile_is_one_pass(spark, monkeypatch):
    # A field of one tile beside one of many.
    px = _mask(spark).withColumn("cost", (F.hash("field_id", "y", "x") % 7).cast("double") / 7).localCheckpoint()
    seeds = px.where((F.col("y") % 9 == 4) & (F.col("x") % 8 == 3)).select("field_id", "y", "x", (F.col("y") * 23 + F.col("x")).cast("long").alias("label_id"))
    rows = lambda df: sorted(map(tuple, df.select("field_id", "y", "x", "label_id", "level", "hops").collect()))
    many = rows(graph.seeded_assign(px, seeds, tile=6))
    mixed = px.withColumns({"height": F.when(F.col("field_id") == "f2", 400).otherwise(F.col("height"))})
    assert rows(graph.seeded_assign(mixed, seeds)) == many
    passes, write = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: passes.append(1) or write(df))
    assert rows(graph.seeded_assign(px, seeds)) == many
    assert len(passes) == 1


def test_otsu_of_many_groups_sums_no_window(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i}", float(v)) for i in range(40) for v in (rng.normal(size=60) if i else [2.5] * 9)]
    df = spark.createDataFrame(rows, "field_id string, value double")
    cut = local.threshold_otsu(df)
    assert "Window" not in cut._jdf.queryExecution().executedPlan().toString()
    got = {r.field_id: r.otsu for r in cut.collect()}
    assert got["g0"] == 2.5
    for name in sorted({g for g, _ in rows} - {"g0"}):
        v = np.array([x for g, x in rows if g == name])
        lo, hi = v.min(), v.max()
        n = np.bincount(np.minimum(255, np.floor((v - lo) / (hi - lo) * 256)).astype(int), minlength=256)
        center = lo + (hi - lo) * (np.arange(256) + 0.5) / 256
        split = [n[: k + 1].sum() * n[k + 1 :].sum() * ((n * center)[: k + 1].sum() / n[: k + 1].sum() - (n * center)[k + 1 :].sum() / n[k + 1 :].sum()) ** 2 for k in range(255)]
        assert abs(got[name] - center[int(np.argmax(np.round(split, 9)))]) < 1e-9


def test_positions_project_the_stack_once(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 0.13, 64)]) for i in range(50)], "vec_id bigint, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    calls, project = [], depth.project_z
    monkeypatch.setattr(depth, "project_z", lambda *a: calls.append(1) or project(*a))
    got = zonal_queries.position_scores(spark, str(tmp_path))
    assert len(calls) == 1 and got.count() == 10
