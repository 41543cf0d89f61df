"""Neighbourhood, connectivity and distance operators against plain arrays, with tiles smaller than the field."""

from __future__ import annotations

import numpy as np
import pytest
from brute import components, greedy, mask_rows, minimax
from pyspark.sql import functions as F

from rasterspark.functions.quantile import dense_index, exact_quantiles
from rasterspark.functions.tiles import disk_offsets
from rasterspark.operators import focal, graph, local, match, zonal

PIX = "field_id string, y int, x int, height int, width int"


def raster(spark, a, field="f"):
    h, w = a.shape
    rows = [(field, y, x, h, w, float(a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, PIX + ", value double")


def mask(spark, a, field="f"):
    return spark.createDataFrame(mask_rows(a, field), PIX)


def back(df, shape, col="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[col]
    return out


@pytest.mark.parametrize("seed,full", [(1, True), (2, False), (3, True)])
def test_components_across_tiles(spark, seed, full):
    a = np.random.default_rng(seed).random((29, 31)) < 0.45
    want = components([(int(y), int(x)) for y, x in zip(*np.nonzero(a))], full)
    got = {(r.y, r.x): r.label_id for r in graph.components(mask(spark, a), conn_full=full, tile=7).collect()}
    assert got == want


def test_components_3d(spark):
    a = np.random.default_rng(4).random((6, 9, 40)) < 0.25
    pts = [tuple(map(int, p)) for p in np.argwhere(a)]
    df = spark.createDataFrame([("f", *p, 9, 40) for p in pts], "field_id string, z int, y int, x int, height int, width int")
    got = {(r.z, r.y, r.x): r.label_id for r in graph.components(df, tile=8).collect()}
    assert got == components(pts)


def test_components_edge_cases(spark):
    for a in (np.zeros((4, 4), bool), np.ones((4, 4), bool), np.eye(4, dtype=bool)):
        n = graph.components(mask(spark, a), conn_full=True, tile=2).select("label_id").distinct().count()
        assert n == (1 if a.any() else 0)


def test_gaussian_tiles_match_one_tile(spark):
    a = np.random.default_rng(5).random((23, 19))
    one = back(focal.gaussian(raster(spark, a), 1.3), a.shape)
    many = back(focal.gaussian(raster(spark, a), 1.3, tile=6), a.shape)
    k = focal.gaussian_kernel(1.3)
    r = len(k) // 2
    p = np.pad(a, r, mode="edge")
    want = sum(k[i] * k[j] * p[i : i + 23, j : j + 19] for i in range(len(k)) for j in range(len(k)))
    assert np.allclose(one, want) and np.allclose(many, want)


@pytest.mark.parametrize("op", ["dilate", "erode", "open", "close"])
def test_morphology_tiles(spark, op):
    a = np.random.default_rng(6).random((21, 17)) < 0.55
    offs = disk_offsets(2)
    h, w = a.shape

    def step(m, grow):
        out = np.zeros_like(m)
        for y in range(h):
            for x in range(w):
                inside = [m[y + i, x + j] for i, j in offs if 0 <= y + i < h and 0 <= x + j < w]
                out[y, x] = any(inside) if grow else all(inside)
        return out

    want = a
    for s in {"dilate": "d", "erode": "e", "open": "ed", "close": "de"}[op]:
        want = step(want, s == "d")
    got = {(r.y, r.x) for r in focal.morphology(mask(spark, a), op, offs, tile=5).collect()}
    assert got == {(int(y), int(x)) for y, x in zip(*np.nonzero(want))}


def test_distance_and_labels_2d_3d(spark):
    rng = np.random.default_rng(7)
    pts = rng.integers(0, (5, 11, 13), (9, 3))
    df = spark.createDataFrame([("f", *map(int, p), 11, 13, 5, i) for i, p in enumerate(pts)], "field_id string, z int, y int, x int, height int, width int, depth int, label_id long")
    pitch = {"x": 0.3, "y": 0.5, "z": 1.1}
    got = {(r.z, r.y, r.x): (r.distance, r.label_id) for r in focal.nearest_seed(df, pitch, block_px=20).collect()}
    assert len(got) == 5 * 11 * 13
    for (z, y, x), (d, lab) in got.items():
        all_d = [np.sqrt(((x - p[2]) * 0.3) ** 2 + ((y - p[1]) * 0.5) ** 2 + ((z - p[0]) * 1.1) ** 2) for p in pts]
        assert d == pytest.approx(min(all_d)) and lab == next(i for i, v in enumerate(all_d) if v == pytest.approx(min(all_d), abs=1e-12))
    near = focal.nearest_seed(df, pitch, max_um=0.8).collect()
    assert len(near) == sum(d <= 0.8 + 1e-9 for d, _ in got.values())


def test_seeded_assign_tiles(spark):
    rng = np.random.default_rng(8)
    cost = np.round(rng.random((13, 12)), 1)
    marks = {(1, 1): 5, (10, 9): 2, (3, 10): 9}
    df = raster(spark, cost).withColumnRenamed("value", "cost")
    m = spark.createDataFrame([("f", y, x, v) for (y, x), v in marks.items()], "field_id string, y int, x int, label_id long")
    level, best = minimax(cost, marks)
    for tile in (256, 5):
        for r in graph.seeded_assign(df, m, tile=tile).collect():
            assert r.level == level[r.y, r.x] and (r.hops, r.label_id) == best[(r.y, r.x)]


def test_label_closure_path_and_star(spark):
    path = [("p", i, i + 1) for i in range(40)]
    star = [("s", 100, i) for i in range(30)]
    e = spark.createDataFrame(path + star, "field_id string, a long, b long")
    got = {(r.field_id, r.node): r.root for r in graph.label_closure(e).collect()}
    assert set(got.values()) == {0} and len(got) == 41 + 31


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=501), "b": np.round(rng.random(300) * 5), "c": np.array([2.5]), "d": np.r_[np.zeros(50), -1e9, 1e-12, 3.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", float("nan")), ("a", None)], "field_id string, value double")
    probs = {"p0": 0.0, "p1": 0.005, "p50": 0.5, "p87": 0.873, "p100": 1.0}
    for small in (False, True):
        for r in exact_quantiles(df, ["field_id"], "value", probs, small_groups=small).collect():
            for n, q in probs.items():
                assert r[n] == pytest.approx(float(np.quantile(groups[r.field_id], q)), rel=1e-12, abs=1e-15)


def test_dense_index_is_contiguous(spark):
    df = spark.createDataFrame([("f", i * 977) for i in range(400)], "field_id string, v long")
    rows = dense_index(df, ["field_id"], "v", "id", 5000).orderBy("v").collect()
    assert [r.id for r in rows] == list(range(1, 401))


def test_greedy_matches_sequential(spark):
    rng = np.random.default_rng(10)
    edges = [(int(a), int(b), float(np.round(rng.random(), 1))) for a in range(12) for b in range(12) if rng.random() < 0.4]
    df = spark.createDataFrame([("f", 0, *e) for e in edges], "field_id string, z int, l int, r int, score double")
    got = sorted((x.l, x.r) for x in match.greedy_one_to_one(df, ["field_id", "z"], "l", "r").collect())
    assert got == greedy(edges)


def test_greedy_of_a_falling_chain_and_small_bounds(spark):
    """10,000 links of which each depends on the one before; and a bound that takes several rounds."""
    chain = [("c", i // 2, (i + 1) // 2, 1.0 - i / 20_000) for i in range(10_000)]
    edges = spark.createDataFrame(chain, "field_id string, a long, b long, score double")
    assert {(r.a, r.b) for r in match.greedy_one_to_one(edges, ["field_id"], "a", "b").collect()} == {(i, i) for i in range(5000)}
    rng = np.random.default_rng(3)
    rows = [("f" + str(i % 3), int(rng.integers(20)), int(rng.integers(20)), float(rng.integers(9))) for i in range(300)]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "field_id string, a long, b long, score double")
    want = set()
    for f in ("f0", "f1", "f2"):
        left, right = set(), set()
        for _, a, b, s in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[3], r[1], r[2])):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.add((f, a, b, s))
    for bound in (7, 40, 1000):
        assert {tuple(r) for r in match.greedy_one_to_one(df, ["field_id"], "a", "b", bound=bound).collect()} == want


def plain_sweep(d2, lb, pitch):
    best, who = np.full(d2.shape, np.inf), np.full(d2.shape, np.iinfo(np.int64).max)
    for k in range(d2.shape[1]):
        cost, label = d2[:, k : k + 1] + ((np.arange(d2.shape[1]) - k) * pitch)[None] ** 2, lb[:, k : k + 1]
        better = (cost < best) | ((cost == best) & (label < who))
        best, who = np.where(better, cost, best), np.where(better, label, who)
    return best, who


def test_line_sweeps_equal_the_plain_scan():
    """The envelope gives the same distance and label everywhere, also where several parabolas meet."""
    rng = np.random.default_rng(1)
    for t in range(400):
        shape = (int(rng.integers(1, 6)), int(rng.integers(1, 40)))
        pitch = [1.0, 0.5, 0.3, 0.2, 1.7][t % 5]
        there = rng.random(shape) < [0.1, 0.5, 0.9, 0.0][t % 4]
        heights = (rng.integers(0, 8, shape) * pitch) ** 2 if t % 3 else (25 - rng.integers(0, 6, shape) ** 2) * pitch * pitch
        lb = np.where(there, rng.integers(1, 9, shape), np.iinfo(np.int64).max)
        d2 = np.where(there, heights, np.inf)
        for got, want in ((focal._envelope_on_lines(d2, lb, pitch), plain_sweep(d2, lb, pitch)), (focal._nearest_on_lines(lb, pitch), plain_sweep(np.where(there, 0.0, np.inf), lb, pitch))):
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_constant_plane_and_empty(spark):
    flat = raster(spark, np.full((5, 6), 3.0))
    assert {r.norm for r in local.robust01(flat).collect()} == {0.0}
    assert local.threshold_otsu(flat).first().otsu == 3.0
    assert focal.inside_distance(mask(spark, np.ones((3, 3), bool)), {"x": 1.0, "y": 1.0}).where(F.col("distance").isNotNull()).count() == 0


def test_solidity_of_square_and_l(spark):
    a = np.zeros((12, 12), bool)
    a[1:5, 1:5] = True
    b = np.zeros((12, 12), bool)
    b[6:11, 6:7] = b[10:11, 6:11] = True
    lab = graph.components(mask(spark, a | b))
    got = {r.label_id: r.solidity for r in zonal.solidity(lab).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(9 / 17.0)


def test_thickness_per_label(spark):
    rows = [("f", 1 if x < 4 else 2, y, x, 7, 8) for y in range(7) for x in range(8)]
    df = spark.createDataFrame(rows, "field_id string, label_id long, y int, x int, height int, width int")
    for r in zonal.thickness(df, {"x": 1.0, "y": 1.0}).collect():
        assert r.thickness == (4 - r.x if r.x < 4 else r.x - 3)
