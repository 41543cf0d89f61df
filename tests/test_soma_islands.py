"""Joining of soma islands against a plain program."""

import heapq
import math
import random
from collections import defaultdict

from brute import components

from rasterspark.operators import partition

PIX = (0.1, 0.12)
N = 26


def ways(main, free, targets, limit):
    """{island: (d, path)} by Dijkstra; ties go to the way whose pixels come first."""
    best, out = {}, {}
    heap = [(0.0, (), p) for p in main]
    while heap:
        d, path, p = heapq.heappop(heap)
        if p in best and best[p] <= (d, path):
            continue
        best[p] = (d, path)
        if p in targets and d > 0:
            out[targets[p]] = min(out.get(targets[p], (d, path)), (d, path))
        if d and p not in free:
            continue
        here = path + ((p,) if d else ())
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                q = (p[0] + i, p[1] + j)
                e = d + math.sqrt(i * i * PIX[0] ** 2 + j * j * PIX[1] ** 2)
                if (i or j) and e <= limit + 1e-9 and (q in free or q in targets):
                    heapq.heappush(heap, (e, here, q))
    return out


def plain(px, foreign, max_gap=0.38, min_process=0.08, max_added=0.15):
    """(part by pixel, {island: (status, added)}) of one cell."""
    soma = {p for p, v in px.items() if v == "soma"}
    pieces = defaultdict(set)
    for p, k in components(soma).items():
        pieces[k].add(p)
    name = {k: min(y * N + x for y, x in v) for k, v in pieces.items()}
    order = sorted(pieces, key=lambda k: (-len(pieces[k]), name[k]))
    main, todo = set(pieces[order[0]]), set(order[1:])
    free = {p for p, v in px.items() if v == "processes" and all(math.hypot((p[0] - f[0]) * PIX[0], (p[1] - f[1]) * PIX[1]) > 0.18 for f in foreign)}
    processes = sum(v == "processes" for v in px.values())
    added, out = 0, {}
    while todo:
        found = ways(main, free, {p: name[k] for k in todo for p in pieces[k]}, max_gap + max(PIX))
        if not found:
            out |= {name[k]: ("no_path_within_gap", 0) for k in todo}
            break
        island = min(found, key=lambda k: (round(found[k][0], 12), k))
        k = next(k for k in todo if name[k] == island)
        path = found[island][1]
        todo.discard(k)
        if (processes - added - len(path)) / len(px) < min_process:
            out[island] = ("process_fraction_too_low", 0)
        elif added + len(path) > max_added * len(soma):
            out[island] = ("too_many_added", 0)
        else:
            out[island] = ("joined", len(path))
            added += len(path)
            main |= set(path) | pieces[k]
            free -= set(path)
            px = px | {p: "soma" for p in path}
    return px, out


def cells():
    rng = random.Random(4)
    block = lambda y, x, h, w: {(i, j) for i in range(y, y + h) for j in range(x, x + w)}
    scenes = []
    for _ in range(14):
        whole = block(2, 2, 22, 22)
        soma = block(4, 4, 8, 7)
        for _ in range(rng.randrange(1, 5)):
            y, x = rng.randrange(3, 20), rng.randrange(3, 20)
            soma |= block(y, x, rng.randrange(1, 4), rng.randrange(1, 4))
        whole -= {(rng.randrange(2, 24), rng.randrange(2, 24)) for _ in range(60)} - soma
        foreign = {(rng.randrange(2, 24), rng.randrange(2, 24)) for _ in range(2)}
        scenes.append(({p: "soma" if p in soma else "processes" for p in whole}, foreign))
    # One island joined and one refused; a chain that is reached island by island; almost no processes.
    scenes.append(({**{p: "processes" for p in block(2, 2, 20, 20)}, **{p: "soma" for p in block(5, 5, 6, 6) | block(5, 13, 3, 2) | block(19, 19, 2, 2)}}, set()))
    scenes.append(({**{p: "processes" for p in block(2, 2, 20, 20)}, **{p: "soma" for p in block(5, 3, 8, 6) | block(6, 11, 2, 2) | block(6, 15, 2, 2) | block(6, 19, 2, 2)}}, set()))
    scenes.append(({**{p: "soma" for p in block(5, 5, 9, 6) | block(5, 13, 9, 4)}, (7, 11): "processes", (7, 12): "processes"}, set()))
    scenes.append(({**{p: "processes" for p in block(2, 2, 9, 20)}, **{p: "soma" for p in block(4, 4, 2, 4) | block(4, 10, 2, 2)}}, set()))
    return scenes


def test_islands_equal_plain(spark):
    px, foreign = [], []
    for i, (cell, nuclei) in enumerate(cells()):
        px += [(f"f{i}", y, x, N, N, 7, part) for (y, x), part in cell.items()]
        foreign += [(f"f{i}", y, x, N, N, 1) for y, x in nuclei]
    at = "field_id string, y int, x int, height int, width int"
    out, decisions = partition.rejoin_soma_islands(spark.createDataFrame(px, at + ", cell_id long, part string"), spark.createDataFrame(foreign, at + ", label_id long"), PIX)
    parts, status = defaultdict(dict), defaultdict(dict)
    for r in out.collect():
        parts[r.field_id][r.y, r.x] = r.part
    for r in decisions.collect():
        status[r.field_id][r.island_id] = (r.status, r.added_px)
    seen = set()
    for i, (cell, nuclei) in enumerate(cells()):
        want, islands = plain(cell, nuclei)
        assert parts[f"f{i}"] == want and {k: v for k, v in islands.items()} == {k: v for k, v in status[f"f{i}"].items()}, i
        seen |= {s for s, _ in islands.values()}
    assert seen == {"joined", "no_path_within_gap", "process_fraction_too_low", "too_many_added"}


def test_without_islands(spark):
    r = spark.createDataFrame([("f", 1, 1, 5, 5, 1, "soma"), ("f", 1, 2, 5, 5, 1, "processes")], "field_id string, y int, x int, height int, width int, cell_id long, part string")
    out, decisions = partition.rejoin_soma_islands(r, None, PIX)
    assert out.count() == 2 and decisions.count() == 0
