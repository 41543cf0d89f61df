"""Plain-array twins of the operators, for small random fixtures."""

from __future__ import annotations

import heapq
import itertools

import numpy as np


def mask_rows(a, field="f", keys=()):
    h, w = a.shape
    return [(field, *keys, int(y), int(x), h, w) for y, x in zip(*np.nonzero(a))]


def components(points, full=True):
    """Raster-ranked component of each point, by flood fill; works in any dimension."""
    todo, out, k = set(points), {}, 0
    dims = len(next(iter(points)))
    steps = [o for o in itertools.product((-1, 0, 1), repeat=dims) if any(o) and (full or sum(map(abs, o)) == 1)]
    for p in sorted(points):
        if p not in todo:
            continue
        k += 1
        stack = [p]
        todo.discard(p)
        while stack:
            q = stack.pop()
            out[q] = k
            for o in steps:
                n = tuple(a + b for a, b in zip(q, o))
                if n in todo:
                    todo.discard(n)
                    stack.append(n)
    return out


def minimax(cost, markers):
    """(level, hops, label) of every pixel: lowest path maximum, then fewest level-preserving hops, then label."""
    h, w = cost.shape
    around = lambda y, x: [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and 0 <= y + i < h and 0 <= x + j < w]
    level = np.full(cost.shape, np.inf)
    heap = []
    for (y, x) in markers:
        level[y, x] = cost[y, x]
        heapq.heappush(heap, (cost[y, x], y, x))
    while heap:
        v, y, x = heapq.heappop(heap)
        if v > level[y, x]:
            continue
        for n in around(y, x):
            t = max(v, cost[n])
            if t < level[n]:
                level[n] = t
                heapq.heappush(heap, (t, *n))
    best = {p: (0, m) for p, m in markers.items()}
    changed = True
    while changed:
        changed = False
        for p in np.ndindex(*cost.shape):
            for n in around(*p):
                if n in best and max(level[n], cost[p]) == level[p]:
                    c = (best[n][0] + 1, best[n][1])
                    if p not in best or c < best[p]:
                        best[p] = c
                        changed = True
    return level, best


def greedy(edges):
    """Sequential greedy one-to-one matching of (left, right, score)."""
    left, right, out = set(), set(), []
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b))
    return sorted(out)


def anchors(rows, separation=6.0, limit=4):
    """Sequential anchor choice of one component; rows in score order."""
    groups = []
    top = rows[0]["score"]
    for i, r in enumerate(rows):
        near = min(((np.hypot(r["cy"] - g["cy"], r["cx"] - g["cx"]), j) for j, g in enumerate(groups)), default=(np.inf, None))
        if near[0] < separation:
            groups[near[1]]["ids"].append(r["id"])
            continue
        if i == 0:
            ok = r["score"] >= 0.62 and r["th"] >= 0.60 and r["st"] >= 0.34 and (r["ov"] >= 0.35 or r["model"] >= 0.55)
        else:
            ok = r["score"] >= max(0.60, top - 0.16) and r["th"] >= 0.65 and r["st"] >= 0.35 and (r["ov"] >= 0.55 or r["model"] >= 0.60)
        if ok and len(groups) < limit:
            groups.append({"ids": [r["id"]], "cy": r["cy"], "cx": r["cx"]})
    return sorted(sorted(g["ids"]) for g in groups)
