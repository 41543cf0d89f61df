"""Ownership partition against a plain one-field program."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import components, minimax

from rasterspark.operators import ownership
from rasterspark.params import OwnershipParams

H = W = 44
P = OwnershipParams()


def pieces(points):
    by = defaultdict(set)
    for p, k in (components(points) if points else {}).items():
        by[k].add(p)
    return list(by.values())


def nearest(points, p):
    return min((math.dist(p, q) for q in points), default=None)


def gauss(a):
    r = 4
    k = np.exp(-0.5 * np.arange(-r, r + 1) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        a = sum(w * np.take(p, np.arange(i, i + a.shape[axis]), axis) for i, w in enumerate(k))
    return a


def marker(comp, depth, s, extent):
    scale = max(np.percentile([depth[p] for p in comp], 99), 1e-6)
    best = None
    for p in comp:
        d = nearest(extent, p)
        if d <= 0.75:
            score = 0.58 * min(depth[p] / scale, 1) + 0.27 * s[p] + 0.15 * math.exp(-((d / 0.75) ** 2))
            key = (score, -p[0], -p[1])
            best = max(best or (key, p), (key, p))
    if best is None:
        return set()
    y, x = best[1]
    return {q for q in ((y, x), (y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if q in comp}


def plain(cells, extents, groups, s, keep_peripheral=True):
    """{component: (status, {owner: pixels})} with one-unit pixels."""
    at = defaultdict(set)
    for p, c in cells.items():
        at[c].add(p)
    meets = {(c, g): len(px & e) for c, px in at.items() for g, e in extents.items() if px & e}
    total = Counter()
    for (_, g), n in meets.items():
        total[g] += n
    out = {}
    for c, comp in at.items():
        rows = [(g, n, *groups[g]) for (k, g), n in meets.items() if k == c]
        if not rows:
            continue
        share = {g: n / len(extents[g]) for g, n, *_ in rows}
        keep = lambda status: (status, {owner: comp})  # noqa: B023, E731
        own = [r for r in rows if r[4]]
        owner = min(own, key=lambda r: (-r[1], -r[2], -r[3], r[0]))[0] if own else None
        if any(amb and share[g] >= 0.3 for g, _, _, _, _, amb in rows):
            out[c] = ("drop_ambiguous_envelope", {})
            continue
        if owner is None:
            out[c] = keep("keep_without_owner")
            continue
        first = next(n for g, n, *_ in rows if g == owner)
        accepted = [g for g, n, v, _, acc, _ in rows if acc and g != owner and share[g] >= 0.45 and v >= 4]
        free = [g for g, n, v, e, acc, _ in rows if not acc and n >= 1.6 and share[g] >= 0.45 and n >= 0.15 * first and n / total[g] >= 0.8 and v >= 12 and e >= 0.2]
        if not accepted and not free:
            out[c] = keep("keep")
            continue
        ring = {(y + i, x + j) for y, x in comp for i in (-1, 0, 1) for j in (-1, 0, 1)} - comp
        ring = {p for p in ring if 0 <= p[0] < H and 0 <= p[1] < W}
        depth = {p: nearest(ring, p) for p in comp}
        marks = {g: marker(comp, depth, s, extents[g]) for g in [owner, *accepted]}
        near = {p: nearest(set().union(*(extents[g] for g in free)), p) if free else None for p in comp}
        if not marks[owner]:
            out[c] = ("drop_owner_marker_unavailable", {})
            continue
        if not accepted:
            cut = np.percentile([s[p] for p in comp], 60)
            allowed = {p for p in comp if not (near[p] <= 1.10 and (depth[p] >= 0.18 or s[p] >= cut))}
            child = set()
            for piece in pieces(allowed):
                child |= piece if piece & marks[owner] else set()
            good = len(child) >= max(12, math.ceil(0.12 * len(comp)))
            out[c] = ("pruned_unowned_foreign", {owner: child}) if good else ("drop_barrier_invalid_owner", {})
            continue
        if any(not m for m in marks.values()) or len(set().union(*marks.values())) < sum(map(len, marks.values())):
            out[c] = ("drop_marker_build_failed", {})
            continue
        mask = {p for p in comp if near[p] is None or near[p] > 0.45}
        if not set().union(*marks.values()) <= mask:
            out[c] = ("drop_unowned_barrier_hit_owner", {})
            continue
        y0, x0 = min(p[0] for p in comp), min(p[1] for p in comp)
        y1, x1 = max(p[0] for p in comp) + 1, max(p[1] for p in comp) + 1
        smooth = gauss(s[y0:y1, x0:x1])
        scale = max(np.percentile([depth[p] for p in comp], 99), 1e-6)
        cost = np.full((y1 - y0, x1 - x0), np.inf)
        for y, x in mask:
            cost[y - y0, x - x0] = 0.72 * (1 - min(depth[y, x] / scale, 1)) + 0.28 * (1 - smooth[y - y0, x - x0])
        _, best = minimax(cost, {(y - y0, x - x0): g for g, m in marks.items() for y, x in m})
        part = {(y + y0, x + x0): g for (y, x), (_, g) in best.items() if (y + y0, x + x0) in mask}
        size = Counter(part.values())
        small = {g: size[g] < max(12, math.ceil((0.12 if g == owner else 0.08) * len(comp))) for g in marks}
        whole = all(len(pieces({p for p, v in part.items() if v == g})) == 1 for g in marks)
        seam = {p for p, g in part.items() for d in ((0, 1), (1, 0), (0, -1), (-1, 0)) if part.get((p[0] + d[0], p[1] + d[1]), g) != g}
        core = max(min(np.percentile([depth[p] for p in m], 90) for m in marks.values()), 1e-6)
        cores = max(min(np.percentile([s[p] for p in m], 75) for m in marks.values()), 1e-6)
        clear = bool(seam) and (np.percentile([depth[p] for p in seam], 75) / core <= 0.86 or np.median([s[p] for p in seam]) / cores <= 0.88)
        if not any(small.values()) and whole and clear:
            out[c] = ("split_between_owners", {g: {p for p, v in part.items() if v == g} for g in marks})
        elif keep_peripheral and any(v for g, v in small.items() if g != owner):
            out[c] = keep("keep_peripheral_nucleus")
        else:
            out[c] = ("drop_ambiguous_partition", {})
    return out


def disc(y, x, r):
    return {(y + i, x + j) for i in range(-9, 10) for j in range(-9, 10) if i * i + j * j <= r * r and 0 <= y + i < H and 0 <= x + j < W}


def scenes():
    """Fields that meet every decision, and random ones."""
    rng = np.random.default_rng(5)
    # Two round bodies with a waist: divided; the same with a wide waist, with a small neighbour, with an unowned one.
    fields = []
    pair = disc(12, 11, 7) | disc(12, 25, 7)
    two = {1: disc(12, 11, 3), 2: disc(12, 25, 3)}
    ok = {1: (40.0, 0.5, True, False), 2: (30.0, 0.5, True, False), 3: (20.0, 0.5, False, False), 4: (20.0, 0.5, False, True)}
    flat = np.full((H, W), 0.5)
    rough = np.round(rng.random((H, W)), 3)
    for s in (flat, rough):
        fields.append(({p: 7 for p in pair}, two, ok, s))
        fields.append(({p: 7 for p in pair}, {1: two[1], 3: two[2]}, ok, s))
        fields.append(({p: 7 for p in pair}, {1: two[1], 2: two[2], 3: disc(12, 18, 2)}, ok, s))
        fields.append(({p: 7 for p in pair}, {1: two[1], 2: two[2], 3: disc(12, 22, 3)}, ok, s))
        fields.append(({p: 7 for p in pair}, {1: two[1], 4: two[2]}, ok, s))
        fields.append(({p: 7 for p in pair}, {3: two[1]}, ok, s))
        fields.append(({p: 7 for p in disc(12, 12, 8)}, {1: disc(12, 9, 2), 2: disc(12, 15, 2)}, ok, s))
        fields.append(({p: 7 for p in disc(12, 12, 8)}, {1: disc(12, 11, 3), 2: disc(12, 12, 2)}, ok, s))
        fields.append(({p: 7 for p in disc(12, 12, 8) | disc(12, 22, 2)}, {1: disc(12, 11, 3), 2: disc(12, 23, 1)}, ok, s))
        fields.append(({p: 7 for p in disc(12, 12, 4)}, {1: disc(12, 12, 2), 3: disc(12, 10, 3)}, ok, s))
        fields.append(({p: 7 for p in disc(12, 12, 4)} | {p: 9 for p in disc(30, 30, 5)}, {1: disc(12, 12, 3), 2: disc(12, 17, 3)}, ok, s))
    for _ in range(10):
        cells, extents, groups = {}, {}, {}
        for c in range(1, 5):
            y, x = rng.integers(6, H - 6, 2).tolist()
            cells |= {p: c for p in disc(y, x, int(rng.integers(3, 9))) if p not in cells}
            cells |= {p: c for p in disc(y + 3, x + 8, int(rng.integers(2, 8))) if p not in cells}
        for g in range(1, 8):
            c = list(cells)[int(rng.integers(len(cells)))]
            extents[g] = disc(*c, int(rng.integers(1, 4)))
            groups[g] = (float(rng.integers(2, 30)), round(float(rng.random()), 2), bool(rng.random() < 0.6), bool(rng.random() < 0.1))
        fields.append((cells, extents, groups, np.round(rng.random((H, W)), 3)))
    return fields


@pytest.fixture(scope="module")
def tables(spark):
    px, ex, gr, st = [], [], [], []
    for i, (cells, extents, groups, s) in enumerate(scenes()):
        f = f"f{i:02d}"
        px += [(f, y, x, H, W, c) for (y, x), c in cells.items()]
        ex += [(f, y, x, H, W, g) for g, e in extents.items() for y, x in e]
        gr += [(f, g, *groups[g]) for g in extents]
        st += [(f, y, x, float(s[y, x])) for y in range(H) for x in range(W)]
    at = "field_id string, y int, x int, height int, width int, label_id long"
    return (
        spark.createDataFrame(px, at), spark.createDataFrame(ex, at),
        spark.createDataFrame(gr, "field_id string, nucleus_id long, volume_um3 double, enclosure double, accepted boolean, ambiguous boolean"),
        spark.createDataFrame(st, "field_id string, y int, x int, s double"),
    )


@pytest.mark.parametrize("keep", [True, False])
def test_partition_equals_plain(spark, tables, keep):
    pixels, decisions = ownership.ownership_partition(*tables, (1.0, 1.0), keep_peripheral=keep)
    got = defaultdict(lambda: defaultdict(set))
    for r in pixels.collect():
        got[r.field_id, r.component_id][r.owner_id].add((r.y, r.x))
    status = {(r.field_id, r.component_id): r for r in decisions.collect()}
    seen = Counter()
    for i, scene in enumerate(scenes()):
        f = f"f{i:02d}"
        for c, (want, parts) in plain(*scene, keep_peripheral=keep).items():
            assert status[f, c].status == want, (f, c, status[f, c])
            assert dict(got[f, c]) == parts
            assert status[f, c].kept_px == sum(map(len, parts.values())) <= status[f, c].area_px
            seen[want] += 1
        for c in set(scene[0].values()) - {c for g, c in status if g == f}:
            assert set(got[f, c]) == {None}
    names = {"drop_ambiguous_envelope", "keep_without_owner", "keep", "pruned_unowned_foreign", "drop_barrier_invalid_owner", "drop_unowned_barrier_hit_owner", "split_between_owners", "drop_marker_build_failed"}
    assert names <= set(seen) and ("keep_peripheral_nucleus" in seen) == keep and ("drop_ambiguous_partition" in seen or keep)


def test_no_rows(spark, tables):
    none = [t.where("false") for t in tables]
    pixels, decisions = ownership.ownership_partition(*none, (1.0, 1.0))
    assert pixels.count() == decisions.count() == 0
