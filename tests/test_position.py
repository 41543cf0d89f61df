"""The position score from pixels against a plain program for one field."""

import itertools
import math

import numpy as np
from brute import components

from rasterspark.operators import position, rank

N, H, W = 14, 20, 22
STEP, PIX = 0.5, 0.9
RAILS = (0.0, 255.0)
WEIGHT = {"eGFP": 0.55, "GFAP": 0.45}


def scaled(a, lo, hi):
    p, q = np.percentile(a, [lo, hi])
    return np.clip((a - p) / (q - p), 0, 1) if q > p else np.zeros(a.shape)


def otsu(a):
    counts, edges = np.histogram(a, 256)
    mid = (edges[:-1] + edges[1:]) / 2
    w1, w2 = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    with np.errstate(all="ignore"):
        m1, m2 = np.cumsum(counts * mid) / w1, (np.cumsum((counts * mid)[::-1]) / w2[::-1])[::-1]
        var = w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2
    return a.flat[0] if (a == a.flat[0]).all() else mid[np.nanargmax(var)]


def gauss(a):
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(a, [(4, 4) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        a = sum(w * np.take(p, np.arange(i, i + a.shape[axis]), axis) for i, w in enumerate(k))
    return a


def labelled(mask):
    out = np.zeros(mask.shape, int)
    pts = list(zip(*map(list, np.nonzero(mask))))
    for p, k in (components(pts) if pts else {}).items():
        out[p] = k
    return out


def nearest(points, p):
    return min(math.dist(p, q) for q in points)




def runs_of(profile, field, base_z):
    base, top = np.percentile(profile, 10), profile.max()
    low = max(np.finfo(np.float32).eps * 16 * max(abs(field).max(), np.finfo(np.float32).tiny), 0.04 * (np.percentile(field, 99.9) - np.percentile(field, 0.1)))
    if top - base < low:
        return []
    on = profile >= base + 0.22 * (top - base)
    least = max(1, math.ceil(0.35 / STEP))
    spans = []
    for v, g in itertools.groupby(range(len(on)), key=lambda i: on[i]):
        g = list(g)
        if v and len(g) >= least:
            if spans and g[0] - spans[-1][1] - 1 <= 2:
                spans[-1][1] = g[-1]
            else:
                spans.append([g[0], g[-1]])
    high = profile >= base + 0.48 * (top - base)
    return [(a + base_z, b + base_z) for a, b in spans if high[a : b + 1].any() and (b - a + 1) * STEP >= 0.35]


def plain(stack, window, mask, core, extent):
    """The inputs of one window that don't come from operators with an oracle of their own: matching, faces, mask and support."""
    z0, z1 = window
    cores = labelled(core)
    seeds = {c: list(zip(*np.nonzero(cores == c))) for c in range(1, cores.max() + 1)}
    label = np.zeros(core.shape, int)
    for p in zip(*np.nonzero(core | extent)):
        label[p] = min(seeds, key=lambda c: (nearest(seeds[c], p), c)) if seeds else 0
    area = PIX * PIX
    comp = labelled(mask)
    norm = np.stack([scaled(p, 0.5, 99.8) for p in stack["DAPI"]])
    guard = math.ceil(2.0 / STEP)
    a, b = max(0, z0 - guard), min(N - 1, z1 + guard)
    rows = []
    for c in seeds:
        if ((label == c) & mask).sum() * area < 0.6:
            continue
        profile = np.array([np.percentile(norm[z][cores == c], 85) for z in range(a, b + 1)])
        for s, e in runs_of(profile, norm[a : b + 1][:, label == c], a):
            if z0 <= (s + e) / 2 <= z1:
                hits = [k for k in range(1, comp.max() + 1) if ((label == c) & (comp == k)).sum() * area >= 0.6]
                rows.append((c, s, e, hits))
    linked = [r for r in rows if r[3]]
    degree = {k: sum(k in r[3] for r in linked) for k in range(1, comp.max() + 1)}
    one = [r for r in linked if len(r[3]) == 1 and degree[r[3][0]] == 1]
    mid = (z0 + z1) / 2
    proj = {c: stack[c][z0 : z1 + 1].max(0) for c in stack}
    mix = sum(w * scaled(proj[c], 0.5, 99.8) for c, w in WEIGHT.items())
    s = np.clip(gauss(mix / max(mix.max(), 1e-6)), 0, 1)
    sup = s > otsu(s)
    n = max(mask.sum(), 1)
    anchored = np.isin(comp, [r[3][0] for r in one]) & mask
    rim = np.zeros(mask.shape, bool)
    rim[[0, -1]] = rim[:, [0, -1]] = True
    edge = np.isin(comp, np.unique(comp[rim & mask]))  & mask
    back = list(zip(*np.nonzero(~mask)))
    wide = sum(nearest(back, p) > 1.5 and not sup[p] for p in zip(*np.nonzero(mask)))

    def support(c, z):
        v = scaled(stack[c][z], 0.5, 99.8)
        return v > otsu(v) if (v > 0).any() else np.zeros(v.shape, bool)

    def face(z, outside):
        if not 0 <= outside < N:
            return 0.0
        total = 0.0
        for c, w in WEIGHT.items():
            here, there = support(c, z) & mask, support(c, outside)
            p = np.pad(there, 1)
            near = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
            total += w * (here & near).sum() / here.sum() if here.any() else 0.0
        return total

    return {
        "unique": len(one), "associated": len(linked), "components": int(comp.max()),
        "retention": np.mean([(min(e, z1) - max(s_, z0) + 1) / (e - s_ + 1) for _, s_, e, _ in linked]) if linked else 0.0,
        "rms_um": math.sqrt(np.mean([(((s_ + e) / 2 - mid) * STEP) ** 2 for _, s_, e, _ in linked])) if linked else None,
        "half_span_um": (z1 - z0) * STEP / 2, "completeness": min(1, max(0, 1 - (face(z0, z0 - 1) + face(z1, z1 + 1)) / 2)),
        "coverage": (sup & mask).sum() / sup.sum() if sup.any() else 0.0, "precision": (sup & mask).sum() / n, "unsupported": wide / n,
        "unanchored": (mask & ~anchored).sum() / n, "edge_area": edge.sum() / n,
    }


def scene(seed):
    """Blobs at several depths; masks and nuclear masks differ by position."""
    rng = np.random.default_rng(seed)
    z, y, x = np.mgrid[0:N, 0:H, 0:W]
    stack = {c: rng.random((N, H, W)) * 20 for c in ("DAPI", "eGFP", "GFAP")}
    spots = [(rng.integers(2, N - 2), rng.integers(3, H - 3), rng.integers(3, W - 3)) for _ in range(4)]
    for cz, cy, cx in spots:
        near = np.exp(-(((z - cz) / 1.6) ** 2 + ((y - cy) / 2.0) ** 2 + ((x - cx) / 2.0) ** 2))
        stack["DAPI"] += 180 * near
        stack["eGFP"] += 150 * np.exp(-(((z - cz) / 3) ** 2 + ((y - cy) / 4.0) ** 2 + ((x - cx) / 3.0) ** 2))
    stack["GFAP"] += 90 * np.exp(-(((y - H / 2) / 3) ** 2)) * (z > 4)
    stack = {c: np.round(np.clip(a, 0, 255), 3) for c, a in stack.items()}
    windows = [(1, 6), (3, 8), (7, 12)]
    masks, cores, extents = [], [], []
    for z0, z1 in windows:
        d, g = stack["DAPI"][z0 : z1 + 1].max(0), stack["eGFP"][z0 : z1 + 1].max(0)
        masks.append(g > 80)
        cores.append(d > 120)
        extents.append(d > 60)
    return stack, windows, masks, cores, extents


def test_inputs_equal_plain(spark):
    px, win, layers = [], [], ([], [], [])
    scenes = {f"f{k}": scene(k) for k in range(3)}
    for f, (stack, windows, *masks) in scenes.items():
        px += [(f, c, int(z), int(y), int(x), H, W, float(a[z, y, x])) for c, a in stack.items() for z, y, x in np.ndindex(N, H, W)]
        win += [(f, i + 1, z0, z1) for i, (z0, z1) in enumerate(windows)]
        for rows, per in zip(layers, masks):
            rows += [(f, i + 1, int(y), int(x), H, W) for i, m in enumerate(per) for y, x in zip(*np.nonzero(m))]
    win.append(("none", 1, 2, 5))
    at = "field_id string, position int, y int, x int, height int, width int"
    stack = spark.createDataFrame(px, "field_id string, channel string, z int, y int, x int, height int, width int, value double")
    tables = [spark.createDataFrame(r, at) for r in layers]
    windows = spark.createDataFrame(win, "field_id string, position int, z0 long, z1 long")
    out = position.score_positions(stack, windows, *tables, (PIX, PIX), STEP, RAILS, 1.5)
    got = {(r.field_id, r.position): r for r in out.collect()}
    assert len(got) == 10 and not got["none", 1].valid
    for f, (stk, wins, masks, cores, extents) in scenes.items():
        for i, w in enumerate(wins):
            r = got[f, i + 1]
            for name, value in plain(stk, w, masks[i], cores[i], extents[i]).items():
                assert (r[name] is None) if value is None else abs(r[name] - value) < 1e-9, (f, i, name, r[name], value)
            assert 0 <= min(r.sharpness, r.unclipped, r.background) and 0 < r.total_score < 1
    assert sum(r.valid for r in got.values()) >= 4 and any(r.associated > r.unique for r in got.values())
    chosen = {r.field_id: r for r in rank.select_position(out).collect()}
    assert chosen["none"].status == "invalid" and {chosen[f].status for f in scenes} <= {"selected", "invalid"}
    for f in scenes:
        best = max((r.total_score for (g, _), r in got.items() if g == f and r.valid), default=None)
        assert chosen[f].best_score == best
