"""Bounded distances sweep long lines in pieces; somas are merged by runs, valleys and strokes are labelled once."""

from __future__ import annotations

import numpy as np
from rasterspark.operators import focal, graph, ledger, partition


def test_bounded_distance_of_a_tall_field(spark):
    rng = np.random.default_rng(8)
    h, w, far = 400, 9, 2.0
    at = {(int(rng.integers(h)), int(rng.integers(w))): int(rng.integers(5)) for _ in range(90)} | {(63, 4): 7, (64, 4): 3, (383, 0): 2}
    df = spark.createDataFrame([("a", y, x, h, w, v) for (y, x), v in at.items()], "field_id string, y int, x int, height int, width int, label_id bigint")
    near = focal.nearest_seed(df, {"y": 0.3, "x": 0.5}, block_px=300, max_um=far)
    got = {(r.y, r.x): (round(r.distance, 9), r.label_id) for r in near.collect()}
    want = {}
    for y in range(h):
        for x in range(w):
            d2, label = min((round((y - a) ** 2 * 0.09 + (x - b) ** 2 * 0.25, 9), v) for (a, b), v in at.items())
            if d2 <= far * far:
                want[y, x] = (round(d2**0.5, 9), label)
    assert got == want
    # A line is no longer one group of one task.
    assert "_seg" in near._jdf.queryExecution().executedPlan().toString()


def test_merge_compares_runs_not_pixels(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = sorted({(f"f{f}", int(rng.integers(4)) + 9 * (c % 3) + f, int(rng.integers(5)) + 7 * (c // 3), c) for f in range(3) for c in range(6) for _ in range(14)})
    regions = spark.createDataFrame([(*r, "soma") for r in rows], "field_id string, y int, x int, cell_id bigint, part string")
    merges = [(f"f{f}", m, c) for f in range(3) for m, cells in enumerate(((0, 1), (1, 2, 4), (0, 3), (3, 4, 5), (2,))) for c in cells]
    pairs, sizes, close, write = [], [], graph.label_closure, ledger.cut_lineage
    monkeypatch.setattr(graph, "label_closure", lambda e, k: pairs.append(e) or close(e, k))
    monkeypatch.setattr(ledger, "cut_lineage", lambda df: (lambda out: sizes.append(out.count()) or out)(write(df)))
    dy, dx, gap = 0.3, 0.2, 1.0
    ledger.edit_merge(regions, spark.createDataFrame(merges, "field_id string, merge_id int, cell_id bigint"), (dy, dx), gap)[1].collect()
    px = {}
    for f, y, x, c in rows:
        px.setdefault((f, c), []).append((y, x))
    want = {(f, m, a, b) for f, m, a in merges for g, n, b in merges if (f, m) == (g, n) and a < b and any(
        ((y - v) * dy) ** 2 + ((x - u) * dx) ** 2 <= gap * gap * (1 + 1e-12) for y, x in px[f, a] for v, u in px[f, b])}
    assert {tuple(r) for r in pairs[0].collect()} == want and 0 < len(want)
    in_merges = sum(len(px[f, c]) for f, _, c in merges)
    assert max(sizes) < in_merges


def _counted(monkeypatch):
    calls, label = [], graph.components
    monkeypatch.setattr(graph, "components", lambda *a, **k: calls.append(a[0].count()) or label(*a, **k))
    return calls


def test_gaps_are_tried_only_where_a_valley_is(spark, monkeypatch):
    # Two cells of one field; only the first has a valley.
    bright = [(y, x) for y in range(24) for x in range(24)]
    dark = {(y, x) for y in range(11, 13) for x in range(6, 18)}
    px = [("f", y, x, 30, 60, 1) for y, x in bright] + [("f", y, x + 28, 30, 60, 2) for y, x in bright]
    comp = spark.createDataFrame(px, "field_id string, y int, x int, height int, width int, component_id bigint")
    smap = spark.createDataFrame([("f", y, x, 0.1 if (y, x) in dark else 0.9) for _, y, x, *_ in px], "field_id string, y int, x int, s double")
    nuclei = comp.where("y = 2 and x = 2").withColumnRenamed("component_id", "label_id")
    calls = _counted(monkeypatch)
    out = partition.restore_gaps(comp, smap, nuclei, (0.25, 0.25), 0.0, 0.3)
    left = {(r.y, r.x) for r in out.where("component_id = 1").collect()}
    assert left == set(bright) - dark and out.where("component_id = 2").count() == len(bright)
    # The low pixels, all cells once, and the one cell that is tried.
    assert [n for n in calls if n > len(dark)] == [len(px), len(bright) - len(dark)]
