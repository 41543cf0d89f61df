"""Column expressions shared by all operators (all stay inside codegen)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), col(c)))


def linear_evidence(value: str | Column, lo: Column | float, hi: Column | float) -> Column:
    """Evidence ramp: 0 at ``lo``, 1 at ``hi``, clipped."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return clip((col(value) - lo) / (hi - lo), 0.0, 1.0)


def half_up(c: str | Column) -> Column:
    """Round a non-negative number half up to a long (never banker's rounding)."""
    return F.floor(col(c) + F.lit(0.5)).cast("long")


def safe_div(num: str | Column, den: str | Column, default: float | None = None) -> Column:
    d = col(den)
    out = F.when(d != 0, col(num) / d)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def close_to(a: Column, b: Column, rel: float = 1e-5, absolute: float = 1e-9) -> Column:
    """Symmetric relative/absolute closeness; NULL matches only NULL."""
    near = F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def reasons(*pairs: tuple[str, Column]) -> Column:
    """Ordered array of the names whose predicate holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def first_reason(*pairs: tuple[str, Column], default: str | None = None) -> Column:
    """Name of the first predicate that holds."""
    start = F.lit(default).cast("string")
    return reduce(lambda rest, p: F.when(p[1], F.lit(p[0])).otherwise(rest), reversed(pairs), start)


def sphere_radius(volume: str | Column) -> Column:
    """Radius of the sphere with this volume."""
    return F.cbrt(col(volume) * F.lit(3.0 / (4.0 * math.pi)))


def distance_um(
    dy: Column, dx: Column, height_um: float, width_um: float, dz: Column | None = None, depth_um: float = 0.0
) -> Column:
    """Anisotropic physical distance."""
    total = F.pow(dy * F.lit(height_um), F.lit(2.0)) + F.pow(dx * F.lit(width_um), F.lit(2.0))
    if dz is not None:
        total = total + F.pow(dz * F.lit(depth_um), F.lit(2.0))
    return F.sqrt(total)


def sector(dy: Column, dx: Column, n: int = 12, half_offset: bool = False) -> Column:
    """Index of the angular sector of a direction, 0..n-1."""
    turn = F.lit(2.0 * math.pi)
    angle = F.atan2(dy, dx) + (F.lit(math.pi / n) if half_offset else F.lit(0.0))
    return F.least(F.floor(F.pmod(angle + turn, turn) * F.lit(n) / turn), F.lit(n - 1)).cast("int")


def near_edge(margin: int | Column) -> Column:
    """Pixel inside the outer band; the band never exceeds half the side."""
    m = margin if isinstance(margin, Column) else F.lit(int(margin))
    my = F.least(m, F.floor(F.col("height") / 2)).cast("int")
    mx = F.least(m, F.floor(F.col("width") / 2)).cast("int")
    y, x = F.col("y"), F.col("x")
    return (y < my) | (y >= F.col("height") - my) | (x < mx) | (x >= F.col("width") - mx)


def on_border() -> Column:
    y, x = F.col("y"), F.col("x")
    return (y == 0) | (y == F.col("height") - 1) | (x == 0) | (x == F.col("width") - 1)


def dtype_rail(dtype: str | Column, upper: bool) -> Column:
    """Digital minimum or maximum of a pixel type; NULL for floating types."""
    d = col(dtype)
    lows = {"bool": 0, "uint8": 0, "uint16": 0, "uint32": 0, "int8": -128, "int16": -32768, "int32": -2147483648}
    highs = {
        "bool": 1, "uint8": 255, "uint16": 65535, "uint32": 4294967295,
        "int8": 127, "int16": 32767, "int32": 2147483647,
    }
    table = highs if upper else lows
    out = F.lit(None).cast("double")
    for name, limit in table.items():
        out = F.when(d == name, F.lit(float(limit))).otherwise(out)
    return out
