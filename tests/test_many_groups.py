"""Small fields share batches: the same results wherever the Arrow batches and the tiles are cut, and no group per field."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.operators import focal, graph, ledger
from rasterspark.sources import adapters

PX = "field_id string, label_id bigint, y int, x int, height int, width int"


@pytest.fixture(params=["5", "10000"])
def batches(spark, request):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, old)


def scattered(rng, fields=6, side=11, n=45):
    return sorted({(None if f == 2 else f"f{f}", int(rng.integers(1, 4)), *(int(v) for v in rng.integers(0, side, 2)), side, side) for f in range(fields) for _ in range(n)}, key=str)


def test_boundary_of_overlapping_labels(spark, batches):
    rows = scattered(np.random.default_rng(1))
    for full in (True, False):
        near = lambda p, q: max(abs(p[2] - q[2]), abs(p[3] - q[3])) == 1 and (full or abs(p[2] - q[2]) + abs(p[3] - q[3]) == 1)  # noqa: E731,B023
        want = {p[:4] for p in rows if any(p[0] == q[0] and p[1] != q[1] and near(p, q) for q in rows)}
        got = focal.label_boundary(spark.createDataFrame(rows + rows[:9], PX), full=full, tile=4)
        got = [(r.field_id, r.label_id, r.y, r.x) for r in got.collect()]
        # Rows without a field meet each other like those of any field.
        assert set(got) == want and len(got) == len(want)
    plan = got_plan(focal.label_boundary(spark.createDataFrame(rows, PX)))
    assert "Join" not in plan and plan.count("Exchange") == 1


def got_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_of_small_fields(spark, batches):
    rows = [r for r in scattered(np.random.default_rng(2), n=30) if r[1] == 1]
    df = spark.createDataFrame(rows, PX).drop("label_id").distinct()
    got = {}
    for r in graph.components(df.where("field_id IS NOT NULL"), dense=False, tile=4).collect():
        got.setdefault((r.field_id, r.label_id), set()).add((r.y, r.x))
    for (f, first), px in got.items():
        assert first == min(y * 11 + x for y, x in px)
        rest, seen = set(px), [px.copy().pop()]
        rest.discard(seen[0])
        for y, x in seen:
            near = {q for q in rest if max(abs(q[0] - y), abs(q[1] - x)) == 1}
            rest -= near
            seen += sorted(near)
        assert not rest
        others = set().union(*[p for (g, k), p in got.items() if g == f and k != first], set())
        assert not any(max(abs(y - b), abs(x - a)) <= 1 for y, x in px for b, a in others)
    assert sum(map(len, got.values())) == df.where("field_id IS NOT NULL").count()


def test_assignment_of_many_fields_in_a_strip(spark, batches):
    rng = np.random.default_rng(3)
    cost = [(f"f{f}", y, x, 3 + f, 7, float(rng.integers(0, 3))) for f in range(5) for y in range(3 + f) for x in range(7) if rng.random() < 0.8]
    seeds = [(c[0], c[1], c[2], i) for i, c in enumerate(cost) if i % 11 == 0]
    cost_df = spark.createDataFrame(cost, "field_id string, y int, x int, height int, width int, cost double")
    seed_df = spark.createDataFrame(seeds, "field_id string, y int, x int, label_id bigint")
    rows = lambda tile: {tuple(r) for r in graph.seeded_assign(cost_df, seed_df, tile=tile).select("field_id", "y", "x", "label_id", "level", "hops").collect()}
    together, cut = rows(256), rows(4)
    alone = set()
    for f in range(5):
        a = graph.seeded_assign(cost_df.where(F.col("field_id") == f"f{f}"), seed_df.where(F.col("field_id") == f"f{f}"))
        alone |= {tuple(r) for r in a.select("field_id", "y", "x", "label_id", "level", "hops").collect()}
    assert together == cut == alone and len(alone) > 60


def test_rows_of_a_state_travel_once(spark):
    rows = spark.range(200).select((F.col("id") % 3).cast("string").alias("field_id"), F.col("id").alias("y"))
    plan = got_plan(ledger.state_hash(rows, ["y"]))
    # The rows, and the at most 256 hashes of a field.
    assert plan.count("Exchange") == 2


def test_cells_are_not_left_to_a_few_tasks(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert adapters.compartments(spark, str(tmp_path)).rdd.getNumPartitions() >= 3000 * 1024 // adapters.CELL_PIXELS
