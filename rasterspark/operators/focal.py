"""Neighbourhood operators on halo tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.functions.quantile import exact_quantiles
from rasterspark.functions.tiles import TILE, Tile, correlate1d, disk_offsets, group_starts, shifted, tile_map, whole_groups
from rasterspark.operators.local import FIELD, normalize, structural_sum
from rasterspark.params import StructureParams
from rasterspark.session import cut_lineage

Offsets = list[tuple[int, int]]


def _reach(offsets: Offsets) -> int:
    return max((max(abs(i), abs(j)) for i, j in offsets), default=0)


def gaussian_kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    """Sampled Gaussian, normalised, or its first/second derivative (as a correlation kernel)."""
    radius = int(truncate * sigma + 0.5)
    x = np.arange(-radius, radius + 1, dtype=float)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    if order == 1:
        return g * x / sigma**2
    if order == 2:
        return g * (x**2 / sigma**4 - 1.0 / sigma**2)
    return g


def _separable(tile: Tile, name: str, ky: np.ndarray, kx: np.ndarray, halo: int, mode: str) -> np.ndarray:
    a = tile.padded(name, mode)
    trim_y, trim_x = halo - len(ky) // 2, halo - len(kx) // 2
    a = a[trim_y : a.shape[0] - trim_y, trim_x : a.shape[1] - trim_x]
    return correlate1d(correlate1d(a, ky, 0), kx, 1)


def gaussian(
    df: DataFrame, sigma: float | tuple[float, float], value: str = "value", out: str | None = None,
    keys: list[str] = FIELD, mode: str = "edge", tile: int = TILE, emit: str = "present",
) -> DataFrame:
    """Gaussian smoothing in pixels, isotropic or (sigma_y, sigma_x).

    Pixels without a row add nothing. They get no row either, unless ``emit`` is
    ``all``, for sparse rasters whose other pixels are zero.
    """
    sy, sx = (sigma, sigma) if isinstance(sigma, (int, float)) else sigma
    ky, kx = gaussian_kernel(sy), gaussian_kernel(sx)
    halo, name = max(len(ky), len(kx)) // 2, out or value

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        return {name: _separable(t, value, ky, kx, halo, mode)}

    return tile_map(df, keys, [value], halo, kernel, {name: "double"}, emit=emit, tile=tile)


def _dilate(a: np.ndarray, offsets: Offsets) -> np.ndarray:
    halo = _reach(offsets)
    p, out = np.pad(a, halo), np.zeros_like(a)
    for i, j in offsets:
        out |= shifted(p, i, j, halo)
    return out


def _erode(a: np.ndarray, offsets: Offsets, outside: np.ndarray) -> np.ndarray:
    """Erosion where pixels outside the field never remove anything."""
    halo = _reach(offsets)
    p, out = np.pad(a | outside, halo, constant_values=True), np.ones_like(a)
    for i, j in offsets:
        out &= shifted(p, -i, -j, halo)
    return out


def morphology(
    mask: DataFrame, op: str, offsets: Offsets, keys: list[str] = FIELD, tile: int = TILE
) -> DataFrame:
    """Binary dilate, erode, open or close of a sparse mask.

    Outside the field counts as unset for dilation and as set for erosion.
    """
    steps = {"dilate": "d", "erode": "e", "open": "ed", "close": "de"}[op]
    reach = _reach(offsets)
    halo = reach * len(steps)

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        # A margin of ``halo`` on every side; beyond the field it is "outside".
        a = np.pad(t.present, t.missing)
        outside = np.pad(np.zeros_like(t.present), t.missing, constant_values=True)
        for s in steps:
            a = _dilate(a, offsets) & ~outside if s == "d" else _erode(a, offsets, outside) & ~outside
        return {"_on": a[halo : a.shape[0] - halo or None, halo : a.shape[1] - halo or None].astype(np.int32)}

    # Tiles without any input pixel cannot become set: dilation reaches at most the halo.
    return tile_map(mask.select(*keys, "y", "x", "height", "width"), keys, [], halo, kernel, {"_on": "int"}, emit="nonzero", tile=tile).drop("_on")


def grey_morphology(df: DataFrame, op: str, offsets: Offsets, value: str = "value", keys: list[str] = FIELD) -> DataFrame:
    """Grey erosion, dilation, opening or white top-hat; borders and pixels without a row are ignored."""
    halo = _reach(offsets) * (1 if op in ("erode", "dilate") else 2)
    reach = _reach(offsets)

    def extreme(a: np.ndarray, low: bool) -> np.ndarray:
        fill = np.inf if low else -np.inf
        p = np.pad(a, reach, constant_values=fill)
        best = np.full(a.shape, fill)
        for i, j in offsets:
            best = (np.minimum if low else np.maximum)(best, shifted(p, i, j, reach))
        return best

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        a = t.arrays[value]
        known = lambda v, low: np.where(t.present, v, np.inf if low else -np.inf)
        if op in ("erode", "dilate"):
            return {value: extreme(known(a, op == "erode"), op == "erode")[t.core]}
        eroded = extreme(known(a, True), True)
        # A place that no known pixel reaches has no eroded value.
        opened = extreme(np.where(eroded == np.inf, -np.inf, eroded), False)
        return {value: (opened if op == "open" else a - opened)[t.core]}

    return tile_map(df, keys, [value], halo, kernel, {value: "double"}, emit="present")


def white_tophat(df: DataFrame, radius: int = 9, value: str = "value", keys: list[str] = FIELD) -> DataFrame:
    return grey_morphology(df, "tophat", disk_offsets(radius), value, keys)


def sharpness_sums(df: DataFrame, value: str = "value", keys: list[str] = FIELD, gaps: bool = False) -> DataFrame:
    """Per-group difference sums: squared and absolute first differences and squared Laplacian.

    A pixel without a row is zero; with ``gaps`` it is unknown, like one beyond the border.
    """

    def known(t: Tile) -> dict[str, float]:
        p, there = t.padded(value, "edge"), np.pad(t.present, t.missing)
        c, here = shifted(p, 0, 0, 1), shifted(there, 0, 0, 1)
        d = {s: np.where(here & shifted(there, *s, 1), shifted(p, *s, 1) - c, 0.0) for s in ((0, 1), (0, -1), (1, 0), (-1, 0))}
        dx, dy, lap = d[0, 1], d[1, 0], sum(d.values())
        return {
            "dx2": float((dx * dx).sum()), "dy2": float((dy * dy).sum()), "adx": float(np.abs(dx).sum()),
            "ady": float(np.abs(dy).sum()), "lap2": float((lap * lap).sum()), "n": int(here.sum()),
            "nx": int((here & shifted(there, 0, 1, 1)).sum()), "ny": int((here & shifted(there, 1, 0, 1)).sum()),
        }

    def kernel(t: Tile) -> dict[str, float]:
        p = t.padded(value, "edge")
        c, right, down = shifted(p, 0, 0, 1), shifted(p, 0, 1, 1), shifted(p, 1, 0, 1)
        lap = right + shifted(p, 0, -1, 1) + down + shifted(p, -1, 0, 1) - 4.0 * c
        # The padded edge repeats the last pixel, so border differences are zero.
        dx, dy = right - c, down - c
        last_x = t.x0 + t.core[1].stop == t.width
        last_y = t.y0 + t.core[0].stop == t.height
        return {
            "dx2": float((dx * dx).sum()), "dy2": float((dy * dy).sum()), "adx": float(np.abs(dx).sum()),
            "ady": float(np.abs(dy).sum()), "lap2": float((lap * lap).sum()), "n": int(c.size),
            "nx": int(c.size - (c.shape[0] if last_x else 0)), "ny": int(c.size - (c.shape[1] if last_y else 0)),
        }

    out = {"dx2": "double", "dy2": "double", "adx": "double", "ady": "double", "lap2": "double", "n": "bigint", "nx": "bigint", "ny": "bigint"}
    per_tile = tile_map(df, keys, [value], 1, known if gaps else kernel, out, reduce=True)
    return per_tile.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in out])


def gradient_energy(df: DataFrame, value: str = "value", keys: list[str] = FIELD, gaps: bool = False) -> DataFrame:
    """Mean squared first differences and mean squared Laplacian."""
    s = sharpness_sums(df, value, keys, gaps)
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(0.0)
    return s.select(
        *keys, (mean("dx2", "nx") + mean("dy2", "ny")).alias("first_energy"), mean("lap2", "n").alias("second_energy"),
        "adx", "ady", "nx", "ny",
    )


def threshold_sauvola(
    df: DataFrame, window: int = 121, k: float = 0.12, value_range: float = 1.0, value: str = "value", keys: list[str] = FIELD
) -> DataFrame:
    """Local threshold mean*(1 + k*(std/R - 1)) with R half the value range; mirrored border."""
    r = window // 2
    half = value_range / 2.0

    def box(a: np.ndarray) -> np.ndarray:
        c = np.cumsum(np.pad(a, ((1, 0), (0, 0))), axis=0)
        a = c[window:] - c[:-window]
        c = np.cumsum(np.pad(a, ((0, 0), (1, 0))), axis=1)
        return (c[:, window:] - c[:, :-window]) / float(window * window)

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        p = t.padded(value, "symmetric")
        mean = box(p)
        std = np.sqrt(np.maximum(box(p * p) - mean * mean, 0.0))
        return {"threshold": mean * (1.0 + k * (std / half - 1.0))}

    return tile_map(df, keys, [value], r, kernel, {"threshold": "double"}, emit="present")


# ------------------------------------------------------------ fibre structure


def structural_map(channels: DataFrame, sigma: float = 1.0, keys: list[str] = FIELD, emit: str = "present", small_groups: bool = False) -> DataFrame:
    """Weighted channel mix, smoothed and clipped to 0..1 (column ``s``); ``emit`` as in ``gaussian``."""
    smooth = gaussian(structural_sum(channels, keys, small_groups), sigma, "s", keys=keys, emit=emit)
    return smooth.withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s"))))


def background_correct(
    stack: DataFrame, pixel_um: tuple[float, float], sigma_um: float = 2.8, keys: list[str] = ["field_id", "z"]
) -> DataFrame:
    """Subtract the smooth background of each plane, floored at zero."""
    sigma = tuple(max(0.5, sigma_um / p) for p in pixel_um)
    ky, kx = gaussian_kernel(sigma[0]), gaussian_kernel(sigma[1])
    halo = max(len(ky), len(kx)) // 2

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        return {"value": np.maximum(t.arrays["value"][t.core] - _separable(t, "value", ky, kx, halo, "edge"), 0.0)}

    return tile_map(stack, keys, ["value"], halo, kernel, {"value": "double"}, emit="all")


def ridge_response(
    df: DataFrame, sigmas: list[tuple[float, float]], value: str = "value", keys: list[str] = FIELD
) -> DataFrame:
    """Largest curvature x coherence of bright ridges over several scales (column ``ridge``)."""
    halo = max(int(4.0 * max(s) + 0.5) for s in sigmas)

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        best = 0.0
        for sy, sx in sigmas:
            g = lambda oy, ox: _separable(t, value, gaussian_kernel(sy, oy), gaussian_kernel(sx, ox), halo, "edge")  # noqa: E731,B023
            yy, xx, xy = g(2, 0), g(0, 2), g(1, 1)
            mean, spread = (xx + yy) / 2.0, np.sqrt(((xx - yy) / 2.0) ** 2 + xy**2)
            low, high = mean - spread, mean + spread
            coherence = np.clip(1.0 - np.abs(high) / np.maximum(np.abs(low), 1e-6), 0.0, 1.0)
            best = np.maximum(best, np.maximum(-low, 0.0) * coherence)
        return {"ridge": best}

    return tile_map(df, keys, [value], halo, kernel, {"ridge": "double"}, emit="present")


def ridge_score(corrected: DataFrame, pixel_um: tuple[float, float], params: StructureParams = StructureParams()) -> DataFrame:
    """Normalised intensity, ridge evidence and their weighted score per pixel."""
    unit = normalize(corrected, FIELD, 0.01, 0.997, out="intensity")
    sigmas = [tuple(max(0.55, s / p) for p in pixel_um) for s in params.ridge_scales_um]
    raw = ridge_response(unit, sigmas, "intensity")
    ridge = normalize(raw, FIELD, 0.01, 0.997, value="ridge", out="ridge01").select("field_id", "y", "x", F.col("ridge01").alias("ridge"))
    total = max(params.intensity_weight + params.ridge_weight, 1e-6)
    return unit.select("field_id", "y", "x", "height", "width", "intensity").join(ridge, ["field_id", "y", "x"]).withColumn(
        "score", (F.lit(params.intensity_weight) * F.col("intensity") + F.lit(params.ridge_weight) * F.col("ridge")) / total)


def branch_features(smooth_input: DataFrame, background_sigma: float = 7.0, value: str = "value", keys: list[str] = FIELD) -> DataFrame:
    """Fine-branch evidence: smoothed signal, local detail and line response."""
    smooth = cut_lineage(gaussian(smooth_input, 0.8, value, out="smooth", keys=keys))
    back = gaussian(smooth, background_sigma, "smooth", out="back", keys=keys)
    line = ridge_response(smooth, [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "smooth", keys)
    at = [*keys, "y", "x"]
    return (
        smooth.join(back.select(*at, "back"), at).join(line.select(*at, F.col("ridge").alias("line")), at)
        .withColumn("detail", F.greatest(F.lit(0.0), F.col("smooth") - F.col("back"))).drop("back")
    )


def candidate_floors(scored: DataFrame, params: StructureParams = StructureParams()) -> DataFrame:
    """Per-field percentile floors of the fibre mask."""
    pos = scored.where(F.col("intensity") > 0)
    a = exact_quantiles(pos, FIELD, "intensity", {"intensity_floor": params.intensity_q})
    b = exact_quantiles(pos, FIELD, "score", {"score_floor": params.score_q})
    c = exact_quantiles(scored.where(F.col("ridge") > 0), FIELD, "ridge", {"ridge_floor": params.ridge_q})
    return a.join(b, FIELD).join(c, FIELD, "left").withColumn("ridge_floor", F.coalesce("ridge_floor", F.lit(1.0)))


def structural_candidate_pixels(scored: DataFrame, params: StructureParams = StructureParams()) -> DataFrame:
    """Pixels passing the fibre thresholds, before closing and size filtering."""
    strong = (F.col("score") >= F.col("score_floor")) & (F.col("intensity") >= F.col("intensity_floor"))
    ridge = (F.col("ridge") >= F.col("ridge_floor")) & (F.col("intensity") >= 0.5 * F.col("intensity_floor"))
    return scored.join(candidate_floors(scored, params), FIELD).where(strong | ridge).select("field_id", "y", "x", "height", "width")


# ------------------------------------------------------------------- distance


def _nearest_on_lines(lb: np.ndarray, pitch: float) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, label) of the nearest labelled place of each line, by one pass from either end; ties take the lower label."""
    n = lb.shape[1]
    none = np.iinfo(np.int64).max
    at = np.arange(n)
    left = np.maximum.accumulate(np.where(lb < none, at, -1), axis=1)
    right = np.minimum.accumulate(np.where(lb < none, at, 2 * n)[:, ::-1], axis=1)[:, ::-1]
    best, who = np.full(lb.shape, np.inf), np.full(lb.shape, none)
    for site in (left, right):
        there = (site >= 0) & (site < n)
        cost = np.where(there, ((at - site) * pitch) ** 2, np.inf)
        label = np.where(there, np.take_along_axis(lb, np.clip(site, 0, n - 1), axis=1), none)
        better = (cost < best) | ((cost == best) & (label < who))
        best, who = np.where(better, cost, best), np.where(better, label, who)
    return best, who


def _envelope_on_lines(d2: np.ndarray, lb: np.ndarray, pitch: float) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, label): the lower envelope of a parabola over each finite ``d2`` of a line, all lines together.

    Every place is pushed once and leaves once, so the work is linear in the line. Parabolas that
    touch the envelope in one point only stay on it (within ``slack``), and at every place all that
    meet there are compared, so that ties go to the lower label.
    """
    lines, n = d2.shape
    none, slack = np.iinfo(np.int64).max, 1e-6
    site = np.zeros((lines, n), np.int64)
    start = np.full((lines, n + 1), np.inf)  # where the parabola begins to be the lowest
    top = np.full(lines, -1)
    for k in range(n):
        rows = np.flatnonzero(np.isfinite(d2[:, k]))
        height = d2[rows, k] / pitch**2 + k * k
        here = np.full(len(rows), -np.inf)
        todo = np.flatnonzero(top[rows] >= 0)
        while len(todo):
            r = rows[todo]
            last = site[r, top[r]]
            cut = (height[todo] - d2[r, last] / pitch**2 - last * last) / (2.0 * (k - last))
            begin = start[r, top[r]]
            out = cut < begin - slack
            here[todo[~out]] = np.maximum(cut, begin)[~out]
            top[r[out]] -= 1
            todo = todo[out]
            here[todo[top[rows[todo]] < 0]] = -np.inf
            todo = todo[top[rows[todo]] >= 0]
        top[rows] += 1
        site[rows, top[rows]] = k
        start[rows, top[rows]] = here
        start[rows, top[rows] + 1] = np.inf
    best, who = np.full((lines, n), np.inf), np.full((lines, n), none)
    live = np.flatnonzero(top >= 0)
    at = np.zeros(lines, np.int64)
    for p in range(n):
        rows = live[start[live, at[live] + 1] < p - slack]
        while len(rows):
            at[rows] += 1
            rows = rows[start[rows, at[rows] + 1] < p - slack]
        rows, j = live, at[live]
        while len(rows):
            k = site[rows, j]
            cost, label = d2[rows, k] + ((p - k) * pitch) ** 2, lb[rows, k]
            better = (cost < best[rows, p]) | ((cost == best[rows, p]) & (label < who[rows, p]))
            best[rows[better], p], who[rows[better], p] = cost[better], label[better]
            more = start[rows, j + 1] <= p + slack
            rows, j = rows[more], j[more] + 1
    return best, who


def _line_sweep(
    keys: list[str], axis: str, others: list[str], pitch: float, side: dict[str, str], names: list[str], first: bool, block_px: int, piece: tuple[int, int] | None = None,
):
    """Kernel of one sweep: the best (distance, label) along every line.

    Rows come sorted by length of the line, keys and line. Lines of any keys are swept together, ``block_px``
    places at a time; a line that goes on in the next batch waits for it. ``piece``: (length, reach) of pieces
    of lines, numbered by ``_seg``, whose rows include those within the reach of the piece.
    """
    line = [side[axis], *keys, *others, *(["_seg"] if piece else [])]

    def places(length: np.ndarray) -> np.ndarray:
        return np.minimum(length, piece[0] + 2 * piece[1]) if piece else length

    def sweep(t: pa.Table, starts: np.ndarray) -> pa.Table:
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        length = t[side[axis]].to_numpy()[starts]
        begin = t["_seg"].to_numpy()[starts].astype(np.int64) * piece[0] if piece else np.zeros(len(starts), np.int64)
        origin = np.maximum(begin - piece[1], 0) if piece else begin
        lab, at = t["_lab"].to_numpy(), t[axis].to_numpy() - origin[row]
        # Lowest label is written last, so it wins where seeds coincide.
        order = np.argsort(-lab, kind="stable")
        lb = np.full((len(starts), places(length).max()), np.iinfo(np.int64).max)
        lb[row[order], at[order]] = lab[order]
        if first:
            best, who = _nearest_on_lines(lb, pitch)
        else:
            d2 = np.full(lb.shape, np.inf)
            d2[row[order], at[order]] = t["_d2"].to_numpy()[order]
            best, who = _envelope_on_lines(d2, lb, pitch)
        place = np.arange(lb.shape[1]) + origin[:, None]
        end = np.minimum(length, begin + piece[0]) if piece else length
        r, p = np.nonzero(np.isfinite(best) & (place >= begin[:, None]) & (place < end[:, None]))
        out = t.select([*keys, *side.values(), *others]).take(pa.array(starts[r]))
        cols = {c: out[c] for c in out.column_names}
        cols.update({axis: pa.array(place[r, p].astype(np.int32)), "_lab": pa.array(who[r, p]), "_d2": pa.array(best[r, p])})
        return pa.table({c: cols[c] for c in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def lines(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends = np.append(starts, t.num_rows)
            length = places(t[side[axis]].to_numpy()[starts]) if len(starts) else []
            a = 0
            while a < len(starts):
                # Lengths rise, so the last line is the longest of its block.
                b = a + 1
                while b < len(starts) and (b + 1 - a) * int(length[b]) <= block_px:
                    b += 1
                part = t.slice(ends[a], ends[b] - ends[a])
                yield from sweep(part, starts[a:b] - ends[a]).to_batches()
                a = b

        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            starts = group_starts(t, line)
            if len(starts) > 1:
                last = int(starts[-1])
                yield from lines(t.slice(0, last), starts[:-1])
                held = t.slice(last).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield from lines(t, group_starts(t, line))

    return run


def nearest_seed(
    seeds: DataFrame, pitch_um: dict[str, float], keys: list[str] = FIELD, label: str | None = "label_id", block_px: int = 131072,
    max_um: float | None = None,
) -> DataFrame:
    """Exact distance from every pixel to the nearest seed, with that seed's label.

    ``pitch_um`` maps each axis (``x``, ``y`` and optionally ``z``) to its
    spacing; ``max_um`` drops farther pixels after every sweep, and long lines are swept in pieces
    that know the seeds within that reach. Axes are swept one
    after the other; a task sweeps lines of any keys, ``block_px`` pixels at a time, so
    it never holds a whole large field, and many small objects cost no group each. Ties
    take the lowest label. Seeds need ``height`` and ``width`` (and ``depth`` for 3D). A
    field without seeds has no rows.
    """
    names_of = {"x": "width", "y": "height", "z": "depth"}
    axes = [a for a in ("x", "y", "z") if a in pitch_um]
    side = {a: names_of[a] for a in axes}
    types = dict(seeds.dtypes)
    lab = F.col(label).cast("long") if label else F.lit(1).cast("long")
    current = seeds.select(*keys, *axes, *side.values(), lab.alias("_lab"), F.lit(0.0).alias("_d2"))
    names = [*keys, *axes, *side.values(), "_lab", "_d2"]
    schema = ", ".join(
        [*(f"`{k}` {types[k]}" for k in keys), *(f"{a} int" for a in axes), *(f"{s} int" for s in side.values()), "_lab bigint", "_d2 double"]
    )
    for axis in axes:
        others = [a for a in axes if a != axis]
        line = [*keys, *others]
        piece = None
        if max_um is not None:
            reach = int(max_um / pitch_um[axis]) + 1
            piece = max(64, 4 * reach), reach
            at = lambda move: F.floor((F.col(axis) + move) / piece[0]).cast("int")  # noqa: B023, E731
            last = F.floor((F.col(side[axis]) - 1) / piece[0]).cast("int")
            current = current.withColumn("_seg", F.explode(F.sequence(F.greatest(F.lit(0), at(-reach)), F.least(last, at(reach)))))
            line.append("_seg")
        sweep = _line_sweep(keys, axis, others, pitch_um[axis], side, names, axis == axes[0], block_px, piece)
        current = current.repartition(*line).sortWithinPartitions(side[axis], *line).mapInArrow(sweep, schema)
        if max_um is not None:
            current = current.where(F.col("_d2") <= F.lit(max_um * max_um * (1 + 1e-12)))
    out = current.withColumn("distance", F.sqrt("_d2")).drop("_d2")
    return out.withColumnRenamed("_lab", label) if label else out.drop("_lab")


def distance_to(mask: DataFrame, pitch_um: dict[str, float], max_um: float | None = None, keys: list[str] = FIELD) -> DataFrame:
    """Distance of every pixel to the nearest mask pixel (optionally only within ``max_um``)."""
    return nearest_seed(mask, pitch_um, keys, label=None, max_um=max_um)


def complement(mask: DataFrame, keys: list[str] = FIELD) -> DataFrame:
    """Background pixels of every field that has a mask, tile by tile."""

    dims = mask.groupBy(*keys).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    # One marker per tile makes sure that empty tiles are visited as well.
    rows = dims.withColumn("y", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / TILE).cast("int"))))
    marks = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / TILE).cast("int"))))
    marks = marks.select(*keys, (F.col("y") * TILE).alias("y"), (F.col("x") * TILE).alias("x"), "height", "width", F.lit(0).alias("_m"))
    both = mask.select(*keys, "y", "x", "height", "width", F.lit(1).alias("_m")).unionByName(marks)

    def flip(t: Tile) -> dict[str, np.ndarray]:
        return {"_on": (t.arrays["_m"][t.core] == 0).astype(np.int32)}

    grouped = both.groupBy(*keys, "y", "x", "height", "width").agg(F.max("_m").alias("_m"))
    return tile_map(grouped, keys, ["_m"], 0, flip, {"_on": "int"}, emit="nonzero").drop("_on")


def inside_distance(mask: DataFrame, pitch_um: dict[str, float], keys: list[str] = FIELD, background: DataFrame | None = None) -> DataFrame:
    """Distance of every mask pixel to the nearest background pixel of the field.

    ``background`` is for fields whose frame has pixels that are neither, because the
    raster has no row for them. A mask without background has the distance NULL.
    """
    other = complement(mask, keys) if background is None else background
    d = distance_to(other, pitch_um, keys=keys).select(*keys, "y", "x", "distance")
    return mask.join(d, [*keys, "y", "x"], "left")


def shell(labels: DataFrame, inner_um: float, outer_um: float, pitch_um: dict[str, float], keys: list[str] = FIELD) -> DataFrame:
    """Pixels whose nearest labelled pixel lies in (inner, outer], with that label."""
    return nearest_seed(labels, pitch_um, keys, max_um=outer_um).where(F.col("distance") > inner_um)


# ------------------------------------------------------------------- borders


def neighbour_offsets(dims: int, full: bool = True) -> list[tuple[int, ...]]:
    """Forward half of the neighbourhood: each unordered pair appears once."""
    import itertools

    out = []
    for o in itertools.product((-1, 0, 1), repeat=dims):
        if o > (0,) * dims and (full or sum(map(abs, o)) == 1):
            out.append(o)
    return out


def label_contacts(labels: DataFrame, keys: list[str] = FIELD, full: bool = True, axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Touching pixel pairs of different labels: (keys, axes of both, left_id, right_id)."""
    offsets = neighbour_offsets(len(axes), full)
    moves = F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, o)]) for o in offsets]))
    left = labels.select(*keys, *[F.col(a).alias(f"_{a}") for a in axes], F.col("label_id").alias("left_id"), moves.alias("_o"))
    left = left.select(*keys, "left_id", *[F.col(f"_{a}") for a in axes], *[(F.col(f"_{a}") + F.col(f"_o.{a}")).alias(a) for a in axes])
    right = labels.select(*keys, *axes, F.col("label_id").alias("right_id"))
    return left.join(right, [*keys, *axes]).where(F.col("left_id") != F.col("right_id"))


def label_boundary(labels: DataFrame, keys: list[str] = FIELD, full: bool = True, tile: int = TILE) -> DataFrame:
    """Label pixels with a neighbour of another label; a pixel may have several. Every pixel is sent once, tile rims twice."""
    moves = [o for h in neighbour_offsets(2, full) for o in (h, (-h[0], -h[1]))]
    names, types = [*keys, "y", "x", "label_id"], dict(labels.dtypes)
    group = [*keys, "_ty", "_tx"]

    def rims(t: pa.Table, starts: np.ndarray) -> pa.Table:
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        y, x = t["y"].to_numpy().astype(np.int64), t["x"].to_numpy().astype(np.int64)
        ty, tx, label = t["_ty"].to_numpy().astype(np.int64), t["_tx"].to_numpy().astype(np.int64), t["label_id"].to_numpy()
        # Each tile with its rim, and an empty line round both, has a range of codes of its own.
        wide = tile + 4
        code = (of * wide + y - ty * tile + 2) * wide + x - tx * tile + 2
        order = np.lexsort((label, code))
        code, label = code[order], label[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        last = np.append(first[1:], len(code)) - 1
        places, low, high = code[first], label[first], label[last]
        found = np.zeros(len(code), bool)
        for i, j in moves:
            target = code + i * wide + j
            at = np.minimum(np.searchsorted(places, target), len(places) - 1)
            found |= (places[at] == target) & ((low[at] != label) | (high[at] != label))
        found &= np.append(True, (code[1:] != code[:-1]) | (label[1:] != label[:-1]))
        found &= ((y // tile == ty) & (x // tile == tx))[order]
        return t.select(names).take(pa.array(order[found]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, group):
            yield from rims(t, starts).combine_chunks().to_batches()

    known = labels.where(F.col("label_id").isNotNull()).select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "label_id")
    span = lambda c: F.sequence(F.floor((F.col(c) - 1) / tile).cast("int"), F.floor((F.col(c) + 1) / tile).cast("int"))
    # Only a pixel on a tile's rim goes to a second tile; those before the field have no pixel of their own.
    sent = known.withColumn("_ty", F.explode(F.filter(span("y"), lambda v: v >= 0))).withColumn("_tx", F.explode(F.filter(span("x"), lambda v: v >= 0)))
    schema = ", ".join(f"`{n}` {'int' if n in ('y', 'x') else types[n]}" for n in names)
    return sent.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def neighbour_count(mask: DataFrame, keys: list[str] = FIELD) -> DataFrame:
    """Mask pixels with the number of their set 8-neighbours."""

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        p = np.pad(t.present, t.missing).astype(np.int32)
        total = sum(shifted(p, i, j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))
        return {"neighbours": total}

    return tile_map(mask.select(*keys, "y", "x", "height", "width"), keys, [], 1, kernel, {"neighbours": "int"}, emit="present")



def smoothed_mask(mask: DataFrame, sigma: float = 1.15, cut: float = 0.42, keys: list[str] = FIELD) -> DataFrame:
    """Pixels where the Gaussian of a binary mask reaches ``cut``."""
    k = gaussian_kernel(sigma)
    halo = len(k) // 2

    def kernel(t: Tile) -> dict[str, np.ndarray]:
        return {"_on": (_separable(t, "one", k, k, halo, "edge") >= cut).astype(np.int32)}

    ones = mask.select(*keys, "y", "x", "height", "width", F.lit(1.0).alias("one"))
    return tile_map(ones, keys, ["one"], halo, kernel, {"_on": "int"}, emit="nonzero").drop("_on")


def smooth_outline(mask: DataFrame, sigma: float = 1.15, min_area: int = 180, keys: list[str] = FIELD) -> DataFrame:
    """Smoothed outline source: blur, cut, close by one pixel and drop small parts."""
    from rasterspark.operators.graph import remove_small

    closed = morphology(smoothed_mask(mask, sigma, 0.42, keys), "close", disk_offsets(1), keys)
    return remove_small(closed, max(30, min_area // 2), keys)


def dual_channel_union(channels: DataFrame, scale: float = 1.0, sigma: float = 1.0) -> DataFrame:
    """Union of the per-channel histogram cuts of the smoothed normalised channels."""
    from rasterspark.operators.local import above, robust01, threshold_otsu

    keys = ["field_id", "channel"]
    smooth = gaussian(robust01(channels, keys), sigma, "norm", keys=keys)
    factor = F.when(F.col("channel") == "eGFP", 0.82).otherwise(0.76)
    cut = threshold_otsu(smooth, keys, "norm").withColumn("otsu", F.col("otsu") * factor * scale)
    return above(smooth, cut, keys, "norm", "otsu").drop("channel").distinct()


def top_hat_union(channels: DataFrame, scale: float = 1.0, radius: int = 9) -> DataFrame:
    """Histogram cut of the channel mix plus its small bright structures."""
    from rasterspark.operators.local import above, requested_weight, robust01, threshold_otsu

    keys = ["field_id", "channel"]
    unit = robust01(channels, keys).select(*keys, "y", "x", "height", "width", F.col("norm").alias("value"))
    hat = white_tophat(unit, radius, keys=keys).select(*keys, "y", "x", F.col("value").alias("hat"))
    present = unit.select(*keys).distinct().withColumn("w", requested_weight(F.col("channel")))
    total = present.groupBy("field_id").agg(F.sum("w").alias("_sum"))
    weights = present.join(total, "field_id").select(*keys, (F.col("w") / F.col("_sum")).alias("w"))
    mixed = (
        unit.join(hat, [*keys, "y", "x"]).join(weights, keys).groupBy("field_id", "y", "x", "height", "width")
        .agg(F.sum(F.col("w") * (0.45 * F.col("value") + 0.55 * F.col("hat"))).alias("mix"))
    )
    peak = mixed.groupBy("field_id").agg(F.greatest(F.max("mix"), F.lit(1e-6)).alias("_p"))
    unit_mix = mixed.join(peak, "field_id").withColumn("mix", F.col("mix") / F.col("_p")).drop("_p")
    return above(unit_mix, threshold_otsu(unit_mix, FIELD, "mix"), FIELD, "mix", "otsu", scale)


def extract_structure(stack: DataFrame, pixel_um: tuple[float, float], params: StructureParams = StructureParams()) -> DataFrame:
    """Background correction, percentile projection, fibre score and fibre mask in one table."""
    import math

    from rasterspark.operators.depth import project_percentile_z
    from rasterspark.operators.graph import remove_small

    corrected = background_correct(stack, pixel_um, params.background_sigma_um)
    flat = cut_lineage(project_percentile_z(corrected, params.projection_q))
    scored = cut_lineage(ridge_score(flat, pixel_um, params))
    gap = disk_offsets(params.gap_um, *pixel_um)
    min_px = max(2, math.ceil(params.min_area_um2 / (pixel_um[0] * pixel_um[1])))
    mask = remove_small(morphology(structural_candidate_pixels(scored, params), "close", gap), min_px)
    at = ["field_id", "y", "x"]
    flags = mask.select(*at, F.lit(True).alias("structure"))
    return scored.join(flat.select(*at, "peak_z"), at).join(flags, at, "left").withColumn("structure", F.coalesce("structure", F.lit(False)))
