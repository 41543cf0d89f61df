"""Depth (z) operators: window plans, projections, active ranges and axial runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterspark.functions.quantile import exact_quantiles
from rasterspark.functions.scalar import half_up
from rasterspark.params import ActiveZParams, AxialRunParams, WindowParams


def plan_z_windows(meta: DataFrame, params: WindowParams = WindowParams()) -> DataFrame:
    """Equally spaced depth windows between end guards, one row per window.

    ``meta`` has ``field_id, n_z, pixel_depth_um``. A stack too short for
    distinct windows gives one row with status ``z_step_limit``.
    """
    step = F.col("pixel_depth_um")
    last = params.n_windows - 1
    planned = (
        meta.select("field_id", "n_z", "pixel_depth_um")
        .withColumn("_int", half_up(F.lit(params.target_um) / step))
        .withColumn("guard_slices", F.ceil(F.lit(params.guard_um) / step).cast("long"))
        .withColumn("window_slices", F.col("_int") + 1)
        .withColumn("_span", F.col("n_z") - F.col("guard_slices") - F.col("window_slices") - F.col("guard_slices"))
        .withColumn(
            "_starts",
            F.transform(F.sequence(F.lit(0), F.lit(last)), lambda p: F.col("guard_slices") + half_up(p * F.col("_span") / F.lit(last))),
        )
        .withColumn("_ok", (F.col("_span") >= last) & (F.size(F.array_distinct("_starts")) == params.n_windows))
    )
    rows = F.when(F.col("_ok"), F.col("_starts")).otherwise(F.array(F.lit(None).cast("long")))
    z0 = F.col("z0")
    return (
        planned.select("*", F.posexplode(rows).alias("_p", "z0"))
        .select(
            "field_id",
            F.when(F.col("_ok"), F.col("_p") + 1).alias("position"),
            "z0",
            (z0 + F.col("window_slices") - 1).alias("z1"),
            "window_slices",
            (F.col("_int") * step).alias("actual_width_um"),
            "guard_slices",
            (F.col("guard_slices") * step).alias("actual_guard_um"),
            F.when(
                F.col("_ok"), F.format_string("fixed_z%02d_%d_%d", F.col("_p") + 1, z0, z0 + F.col("window_slices") - 1)
            ).alias("z_mode"),
            F.when(F.col("_ok"), "ok").otherwise("z_step_limit").alias("status"),
        )
    )


def in_windows(stack: DataFrame, windows: DataFrame) -> DataFrame:
    """Attach every window position that contains a plane.

    Windows are expanded to one row per plane, which turns the band condition
    into an equi-join on (field, z).
    """
    per_plane = windows.where(F.col("z0").isNotNull()).select(
        "field_id", "position", F.explode(F.sequence(F.col("z0").cast("int"), F.col("z1").cast("int"))).alias("z")
    )
    return stack.join(per_plane, ["field_id", "z"])


def project_z(stack: DataFrame, windows: DataFrame, mode: str = "max") -> DataFrame:
    how = {"max": F.max, "mean": F.avg, "sum": F.sum}[mode]
    extra = [c for c in ("height", "width") if c in stack.columns]
    return in_windows(stack, windows).groupBy("field_id", "position", "channel", "y", "x", *extra).agg(how("value").alias("value"))


def project_percentile_z(stack: DataFrame, q: float = 0.95, value: str = "value") -> DataFrame:
    """Percentile along depth and the first plane of the maximum, per pixel column."""
    peak = F.max_by("z", F.struct(F.col(value), -F.col("z")))
    level = F.max(value) if q >= 1 else F.percentile(value, F.lit(q))
    extra = [c for c in ("height", "width") if c in stack.columns]
    return stack.groupBy("field_id", "y", "x", *extra).agg(level.alias("value"), peak.alias("peak_z"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def select_active_z(stack: DataFrame, step_um: float, params: ActiveZParams = ActiveZParams(), n_z: int | None = None) -> DataFrame:
    """Contiguous active depth range per field from the smoothed plane contrast.

    ``n_z`` is the depth of every stack where planes may be missing; a missing plane adds nothing.

    The planes of one stack (tens to hundreds of scalars) form the window, never pixels.
    """
    q = exact_quantiles(stack, ["field_id", "z"], "value", {"p50": 0.5, "high": params.high}, small_groups=True)
    act = q.select("field_id", F.col("z").cast("long").alias("z"), F.greatest(F.lit(0.0), F.col("high") - F.col("p50")).alias("raw"))
    last = F.max("z") if n_z is None else F.lit(n_z - 1).cast("long")
    bounds = act.groupBy("field_id").agg(last.alias("_last"))
    weights = gaussian_weights(params.smooth_um / step_um)
    r = len(weights) // 2
    taps = F.explode(F.array(*[F.struct(F.lit(k - r).alias("dz"), F.lit(w).alias("w")) for k, w in enumerate(weights)]))
    # Each plane asks for its taps; positions beyond the ends repeat the end plane.
    smooth = (
        act.join(bounds, "field_id")
        .select("field_id", "z", "_last", taps.alias("t"))
        .withColumn("_src", F.greatest(F.lit(0), F.least(F.col("_last"), F.col("z") + F.col("t.dz"))))
        .join(act.select("field_id", F.col("z").alias("_src"), "raw"), ["field_id", "_src"])
        .groupBy("field_id", "z", "_last")
        .agg(F.sum(F.col("t.w") * F.col("raw")).alias("s"))
    )
    stats = smooth.groupBy("field_id", "_last").agg(
        F.min("s").alias("lo"), F.max("s").alias("hi"), F.percentile("s", F.lit(params.activity)).alias("pa"),
        F.max_by("z", F.struct("s", -F.col("z"))).alias("peak"),
    )
    dyn = F.col("hi") - F.col("lo")
    flat = dyn <= F.greatest(F.lit(2.220446049250313e-16) * F.greatest(F.abs("hi"), F.lit(1.0)), F.lit(1e-9))
    cut = F.when(flat, F.col("lo")).otherwise(F.greatest(F.col("pa"), F.col("lo") + F.lit(params.min_relative) * dyn))
    n = F.col("_last") + 1
    pad = math.ceil(params.pad_um / step_um)
    span = F.least(n, F.lit(max(1, math.ceil(params.min_span_um / step_um) + 1)))
    ranged = (
        smooth.join(stats.withColumn("threshold", cut).withColumn("_flat", flat), ["field_id", "_last"])
        .groupBy("field_id", "_last", "threshold", "_flat", "peak")
        .agg(F.min(F.when(F.col("s") >= F.col("threshold"), F.col("z"))).alias("a"),
             F.max(F.when(F.col("s") >= F.col("threshold"), F.col("z"))).alias("b"))
        .withColumn("a", F.greatest(F.lit(0), F.coalesce("a", "peak") - pad))
        .withColumn("b", F.least(F.col("_last"), F.coalesce("b", "peak") + pad))
        .withColumn("_span", span)
        .withColumn("_c", F.greatest(F.lit(0), F.col("peak") - F.floor((F.col("_span") - 1) / 2)))
        .withColumn("_c", F.when(F.col("_c") + F.col("_span") > n, F.greatest(F.lit(0), n - F.col("_span"))).otherwise(F.col("_c")))
        .withColumn("_short", F.col("b") - F.col("a") + 1 < F.col("_span"))
    )
    z0 = F.when(F.col("_flat"), 0).when(F.col("_short"), F.col("_c")).otherwise(F.col("a"))
    z1 = F.when(F.col("_flat"), F.col("_last")).when(F.col("_short"), F.col("_c") + F.col("_span") - 1).otherwise(F.col("b"))
    return ranged.select("field_id", z0.cast("int").alias("z0"), z1.cast("int").alias("z1"), "threshold")


def parse_z_mode(df: DataFrame, mode: str = "z_mode", n_windows: int = 5) -> DataFrame:
    pattern = r"^fixed_z(\d{2})_(\d+)_(\d+)$"
    part = [F.try_to_number(F.regexp_extract(mode, pattern, i), F.lit("999999999")).cast("int") for i in (1, 2, 3)]
    ok = F.coalesce(part[0].between(1, n_windows) & (part[2] >= part[1]), F.lit(False))
    return df.withColumns({
        "mode_position": F.when(ok, part[0]), "mode_z0": F.when(ok, part[1]), "mode_z1": F.when(ok, part[2]), "mode_ok": ok,
    })


def check_z_windows(windows: DataFrame, meta: DataFrame, n_windows: int = 5) -> DataFrame:
    """Violations of a window plan, one row per field and rule."""
    w = parse_z_mode(windows.where(F.col("position").isNotNull()), n_windows=n_windows).join(meta.select("field_id", "n_z"), "field_id")
    agrees = F.col("mode_ok") & (F.col("mode_position") == F.col("position")) & (F.col("mode_z0") == F.col("z0")) & (F.col("mode_z1") == F.col("z1"))
    g = w.groupBy("field_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("z_mode").alias("modes"), F.countDistinct("position").alias("np"),
        F.min("position").alias("p0"), F.max("position").alias("p1"),
        F.count_if((F.col("z0") < 0) | (F.col("z1") >= F.col("n_z"))).alias("oob"),
        F.count_if(F.col("z1") - F.col("z0") + 1 != F.col("window_slices")).alias("slices"),
        F.count_if(~agrees).alias("mode_bad"),
    )
    rules = F.array_compact(F.array(
        F.when(F.col("n") != n_windows, "window_count"),
        F.when((F.col("np") != n_windows) | (F.col("p0") != 1) | (F.col("p1") != n_windows), "positions"),
        F.when(F.col("modes") != F.col("n"), "duplicate_mode"), F.when(F.col("oob") > 0, "bounds"),
        F.when(F.col("slices") > 0, "slice_count"), F.when(F.col("mode_bad") > 0, "mode_text"),
    ))
    return g.select("field_id", F.explode(rules).alias("violation"))


def true_runs(df: DataFrame, keys: list[str], flag: str = "active", z: str = "z") -> DataFrame:
    """Maximal runs of consecutive true planes: (keys, run_start, run_end, run_length)."""
    order = Window.partitionBy(*keys).orderBy(z)
    on = df.where(F.col(flag)).withColumn("_g", F.col(z) - F.row_number().over(order))
    return on.groupBy(*keys, "_g").agg(
        F.min(z).alias("run_start"), F.max(z).alias("run_end"), F.count(F.lit(1)).alias("run_length")
    ).drop("_g")


def longest_true_run(df: DataFrame, keys: list[str], flag: str = "active", z: str = "z") -> DataFrame:
    best = true_runs(df, keys, flag, z).groupBy(*keys).agg(F.max("run_length").alias("longest"))
    return df.select(*keys).distinct().join(best, keys, "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def axial_runs(
    profile: DataFrame, dynamic: DataFrame, step_um: float, params: AxialRunParams = AxialRunParams(), keys: list[str] = ["field_id", "label_id"]
) -> DataFrame:
    """Depth runs of nuclei from their plane profiles.

    ``profile``: (keys, z, p85); ``dynamic``: (keys, dynamic, top) with the P99.9 - P0.1 range and the largest magnitude of the
    nucleus extent. Short active runs are dropped first, then gaps of up to two
    planes are closed, and runs must reach the peak cut.
    """
    base = profile.groupBy(*keys).agg(F.percentile("p85", F.lit(0.10)).alias("base"), F.max("p85").alias("_top"))
    contrast = F.col("_top") - F.col("base")
    floor = F.lit(1.1920928955078125e-07 * 16.0) * F.greatest(F.col("top"), F.lit(1.1754943508222875e-38))
    need = F.greatest(floor, F.lit(params.min_contrast_fraction) * F.col("dynamic"))
    ok = base.join(dynamic, keys).withColumn("contrast", contrast).where(contrast >= need)
    planes = profile.join(ok, keys).withColumn("active", F.col("p85") >= F.col("base") + params.active_fraction * F.col("contrast"))
    minimum = max(1, math.ceil(params.min_span_um / step_um))
    runs = true_runs(planes, keys).where(F.col("run_length") >= minimum)
    order = Window.partitionBy(*keys).orderBy("run_start")
    island = F.sum(F.when(F.col("run_start") - F.lag("run_end").over(order) - 1 <= params.max_gap, 0).otherwise(1)).over(order)
    merged = runs.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("run_start").alias("z0"), F.max("run_end").alias("z1"))
    peak = planes.where(F.col("p85") >= F.col("base") + params.peak_fraction * F.col("contrast")).select(*keys, "z")
    has_peak = merged.join(peak, keys).where(F.col("z").between(F.col("z0"), F.col("z1"))).select(*keys, "z0", "z1").distinct()
    return has_peak.where((F.col("z1") - F.col("z0") + 1) * F.lit(step_um) >= params.min_span_um)
