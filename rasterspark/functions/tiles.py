"""Halo tiles: the one physical primitive behind all neighbourhood operators.

A pixel is routed to every fixed-size tile whose halo contains it (interior
pixels to exactly one), so a task holds one tile however large the field is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


@dataclass
class Tile:
    """Dense arrays of one tile with its halo, cut at the field border."""

    arrays: dict[str, np.ndarray]
    present: np.ndarray
    y0: int
    x0: int
    core: tuple[slice, slice]
    missing: tuple[tuple[int, int], tuple[int, int]]
    height: int
    width: int

    def padded(self, name: str, mode: str = "edge", fill: float = 0.0) -> np.ndarray:
        """Array with the full halo: only true field borders are padded."""
        a = self.arrays[name]
        if mode == "constant":
            return np.pad(a, self.missing, mode="constant", constant_values=fill)
        return np.pad(a, self.missing, mode=mode)


def route_to_tiles(df: DataFrame, halo: int, tile: int) -> DataFrame:
    def span(c: str, side: str):
        lo = F.floor(F.greatest(F.col(c) - halo, F.lit(0)) / tile).cast("int")
        hi = F.floor(F.least(F.col(c) + halo, F.col(side) - 1) / tile).cast("int")
        return F.sequence(lo, hi)

    pairs = F.flatten(
        F.transform(span("y", "height"), lambda a: F.transform(span("x", "width"), lambda b: F.struct(a.alias("ty"), b.alias("tx"))))
    )
    return df.withColumn("_t", F.explode(pairs)).withColumns({"_ty": F.col("_t.ty"), "_tx": F.col("_t.tx")}).drop("_t")


def tile_map(
    df: DataFrame,
    keys: list[str],
    cols: list[str],
    halo: int,
    kernel: Callable[[Tile], dict[str, np.ndarray]],
    out: dict[str, str],
    emit: str = "present",
    reduce: bool = False,
    tile: int = TILE,
) -> DataFrame:
    """Run ``kernel`` on every tile of every group, one after the other within a task.

    The kernel returns core-shaped arrays named as in ``out``. ``emit`` selects
    the pixel rows: ``present`` (those of the input), ``all`` (every core pixel)
    or ``nonzero`` (pixels whose first output is non-zero). With ``reduce`` the
    kernel returns scalars and one row per tile is emitted instead.
    """
    types = dict(df.dtypes)
    names = [*keys, *([] if reduce else ["y", "x", "height", "width"]), *out]
    all_types = {**{k: types[k] for k in keys}, "y": "int", "x": "int", "height": "int", "width": "int", **out}
    schema = ", ".join(f"`{n}` {all_types[n]}" for n in names)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def one(ty: int, tx: int, height: int, width: int, at: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        y0, x0 = max(0, ty * tile - halo), max(0, tx * tile - halo)
        y1, x1 = min(height, (ty + 1) * tile + halo), min(width, (tx + 1) * tile + halo)
        ys, xs = at["y"] - y0, at["x"] - x0
        present = np.zeros((y1 - y0, x1 - x0), dtype=bool)
        present[ys, xs] = True
        arrays = {}
        for c in cols:
            a = np.zeros(present.shape)
            a[ys, xs] = at[c]
            arrays[c] = a
        cy0, cx0 = ty * tile - y0, tx * tile - x0
        cy1, cx1 = min(height, (ty + 1) * tile) - y0, min(width, (tx + 1) * tile) - x0
        missing = (
            (halo - cy0, halo - (y1 - y0 - cy1)),
            (halo - cx0, halo - (x1 - x0 - cx1)),
        )
        core = (slice(cy0, cy1), slice(cx0, cx1))
        result = kernel(Tile(arrays, present, y0, x0, core, missing, height, width))
        if reduce:
            return {o: np.array([result[o]]) for o in out}
        if emit == "present":
            keep = present[core]
        elif emit == "all":
            keep = np.ones((cy1 - cy0, cx1 - cx0), dtype=bool)
        else:
            keep = np.asarray(result[next(iter(out))]) != 0
        py, px = np.nonzero(keep)
        place = {"y": py + ty * tile, "x": px + tx * tile, "height": np.full(len(py), height), "width": np.full(len(py), width)}
        return {**place, **{o: np.asarray(result[o])[keep] for o in out}}

    def tiles(t: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        ends = np.append(starts[1:], t.num_rows)
        head = t.take(pa.array(starts))
        columns = {c: t[c].to_numpy() for c in ("y", "x", *cols)}
        where = zip(*(head[c].to_pylist() for c in ("_ty", "_tx", "height", "width")))
        held, done, rows = [], 0, 0

        def made() -> pa.Table:
            counts = [len(r[next(iter(r))]) for r in held]
            group = pa.array(np.repeat(np.arange(done, done + len(held)), counts))
            got = {k: head[k].take(group) for k in keys}
            for c in held[0]:
                got[c] = pa.array(np.concatenate([r[c] for r in held]), type=arrow.get(all_types[c]))
            return pa.table({n: got[n] for n in names})

        for (ty, tx, height, width), a, b in zip(where, starts, ends):
            held.append(one(ty, tx, height, width, {c: v[a:b] for c, v in columns.items()}))
            rows += len(next(iter(held[-1].values())))
            if rows >= tile * tile:
                yield made()
                done, held, rows = done + len(held), [], 0
        if held:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, group):
            for made in tiles(t, starts):
                yield from made.combine_chunks().to_batches()

    group = [*keys, "_ty", "_tx"]
    routed = route_to_tiles(df.select(*keys, "y", "x", "height", "width", *cols), halo, tile)
    # Small fields are tiles of few pixels: many of them share a batch.
    return routed.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


# ------------------------------------------------------- many groups in a task


def group_starts(t: pa.Table, names: list[str]) -> np.ndarray:
    """Rows of a sorted table at which one of the columns changes."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    parts = t.select(names)
    while any(pa.types.is_struct(f.type) for f in parts.schema):
        parts = parts.flatten()
    for column in parts.columns:
        code = column.combine_chunks().dictionary_encode(null_encoding="encode")
        code = code.combine_chunks().indices if isinstance(code, pa.ChunkedArray) else code.indices
        code = code.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted batches, with the row at which each group begins; the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        last = int(group_starts(pa.Table.from_batches([*before, batch]), names)[-1]) - len(before)
        if last < 0 or not (held or last):
            held.append(batch)
            continue
        t = pa.Table.from_batches([*held, batch.slice(0, last)])
        yield t, group_starts(t, names)
        held = [batch.slice(last)]
    if held:
        t = pa.Table.from_batches(held)
        yield t, group_starts(t, names)


def group_quantile(values: np.ndarray, group: np.ndarray, groups: int, q: float) -> np.ndarray:
    """Exact interpolated quantile of each of ``groups`` groups, as Spark's ``percentile``; NaN where a group is empty."""
    v = values[np.lexsort((values, group))]
    n = np.bincount(group, minlength=groups)
    out = np.full(groups, np.nan)
    has = np.flatnonzero(n)
    first, at = (np.cumsum(n) - n)[has], (n[has] - 1) * q
    lo, hi = np.floor(at), np.ceil(at)
    a, b = v[first + lo.astype(np.int64)], v[first + hi.astype(np.int64)]
    out[has] = np.where((lo == hi) | (a == b), a, (hi - at) * a + (at - lo) * b)
    return out


# ------------------------------------------------------- small array kernels


def shifted(a: np.ndarray, dy: int, dx: int, halo: int) -> np.ndarray:
    """View of a fully padded array moved by (dy, dx), trimmed to the core."""
    h, w = a.shape[0] - 2 * halo, a.shape[1] - 2 * halo
    return a[halo + dy : halo + dy + h, halo + dx : halo + dx + w]


def correlate1d(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Valid-mode correlation along one axis."""
    n = a.shape[axis] - len(weights) + 1
    out = 0.0
    for k, w in enumerate(weights):
        out = out + w * np.take(a, np.arange(k, k + n), axis=axis)
    return out


def disk_offsets(radius: float, dy_um: float = 1.0, dx_um: float = 1.0, at_least_one: bool = False) -> list[tuple[int, int]]:
    """Offsets within a physical ellipse (a pixel disk by default)."""
    ry, rx = int(np.floor(radius / dy_um + 1e-9)), int(np.floor(radius / dx_um + 1e-9))
    if at_least_one:
        ry, rx = max(1, ry), max(1, rx)
    limit = radius * radius * (1 + 1e-12)
    return [(i, j) for i in range(-ry, ry + 1) for j in range(-rx, rx + 1) if (i * dy_um) ** 2 + (j * dx_um) ** 2 <= limit]
