"""Per-pixel operators and per-group statistics joined back to pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterspark.functions.quantile import exact_quantiles
from rasterspark.functions.scalar import clip
from rasterspark.functions.tiles import whole_groups
from rasterspark.params import CHANNEL_WEIGHTS

FIELD = ["field_id"]


def normalize(
    df: DataFrame, keys: list[str], lo: float, hi: float, value: str = "value", out: str = "norm", eps: float = 0.0,
    small_groups: bool = False,
) -> DataFrame:
    """Clip between two exact quantiles of the group and rescale to 0..1; flat groups give 0."""
    bounds = exact_quantiles(df, keys, value, {"_lo": lo, "_hi": hi}, small_groups=small_groups)
    span = F.col("_hi") - F.col("_lo")
    unit = F.when(span > eps, clip((F.col(value) - F.col("_lo")) / (span + F.lit(eps)), 0, 1)).otherwise(F.lit(0.0))
    return df.join(bounds, keys).withColumn(out, unit).drop("_lo", "_hi")


def robust01(df: DataFrame, keys: list[str] = FIELD, lo: float = 0.005, hi: float = 0.998, **kw) -> DataFrame:
    return normalize(df, keys, lo, hi, **kw)


def robust01_gfap(df: DataFrame, keys: list[str] = FIELD, **kw) -> DataFrame:
    return normalize(df, keys, 0.01, 0.997, **kw)


def normalize_plane(df: DataFrame, keys: list[str] = ["field_id", "z"], **kw) -> DataFrame:
    """Percentile scaling per plane with a small constant in the denominator."""
    return normalize(df, keys, 0.001, 0.999, eps=1e-6, small_groups=True, **kw)


def plane_bounds(df: DataFrame, lo: float = 0.005, hi: float = 0.998) -> DataFrame:
    return exact_quantiles(df, ["field_id", "z"], "value", {"low": lo, "high": hi}, small_groups=True)


def normalize_per_plane(df: DataFrame) -> DataFrame:
    return normalize(df, ["field_id", "z"], 0.005, 0.998, small_groups=True)


def channel_weights(channels: DataFrame) -> DataFrame:
    """Weight of each structural channel present in a field, summing to one.

    Negative requests count as zero; when nothing positive is left, channels
    share equally.
    """
    per_field = Window.partitionBy("field_id")
    total, n = F.sum("_w").over(per_field), F.count(F.lit(1)).over(per_field)
    return (
        channels.withColumn("_w", F.greatest(F.lit(0.0), F.col("requested")))
        .withColumn("weight", F.when(total > 0, F.col("_w") / total).otherwise(F.lit(1.0) / n))
        .drop("_w")
    )


def requested_weight(channel: Column) -> Column:
    out = F.lit(0.0)
    for name, w in CHANNEL_WEIGHTS.items():
        out = F.when(channel == name, F.lit(w)).otherwise(out)
    return out


def structural_sum(df: DataFrame, keys: list[str] = FIELD, small_groups: bool = False) -> DataFrame:
    """Weighted sum of the normalised structural channels, divided by the group maximum."""
    present = (
        df.select(*keys, "channel").distinct().withColumn("requested", requested_weight(F.col("channel")))
    )
    per_group = Window.partitionBy(*keys)
    total, n = F.sum("requested").over(per_group), F.count(F.lit(1)).over(per_group)
    weights = present.withColumn("weight", F.when(total > 0, F.col("requested") / total).otherwise(1.0 / n)).drop("requested")
    mixed = (
        robust01(df, [*keys, "channel"], small_groups=small_groups)
        .join(weights, [*keys, "channel"])
        .groupBy(*keys, "y", "x", "height", "width")
        .agg(F.sum(F.col("norm") * F.col("weight")).alias("mix"))
    )
    peak = mixed.groupBy(*keys).agg(F.greatest(F.max("mix"), F.lit(1e-6)).alias("_peak"))
    return mixed.join(peak, keys).withColumn("s", F.col("mix") / F.col("_peak")).drop("mix", "_peak")


# ---------------------------------------------------------------- histograms


def histogram(df: DataFrame, keys: list[str], value: str = "value", bins: int = 256) -> DataFrame:
    """Equal-width histogram per group; only occupied bins are rows."""
    lim = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.col("hi") - F.col("lo")
    index = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width * bins))).otherwise(F.lit(0))
    return (
        df.where(F.col(value).isNotNull())
        .join(lim, keys)
        .groupBy(*keys, "lo", "hi", index.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("center", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + F.lit(0.5)) / F.lit(float(bins)))
    )


def _cumulative(h: DataFrame, keys: list[str]) -> tuple:
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = Window.partitionBy(*keys).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    return up, rest


def threshold_otsu(df: DataFrame, keys: list[str] = FIELD, value: str = "value", name: str = "otsu") -> DataFrame:
    """Histogram cut that maximises the between-class variance; the lowest such bin wins.

    Empty bins never change the split, so only occupied bins compete. A constant
    group returns its value.
    """
    h = histogram(df, keys, value)
    types = dict(df.dtypes)

    def cut(t: pa.Table, starts: np.ndarray) -> pa.Table:
        # The bins of many groups side by side, in order; what is above a bin is summed upwards as well.
        size = np.diff(np.append(starts, t.num_rows))
        row, column = np.repeat(np.arange(len(starts)), size), np.arange(t.num_rows) - np.repeat(starts, size)
        n, center = np.zeros((len(starts), size.max()), np.int64), np.zeros((len(starts), size.max()))
        n[row, column], center[row, column] = t["n"].to_numpy(), t["center"].to_numpy()
        weight = n * center
        w1, s1 = np.cumsum(n, axis=1), np.cumsum(weight, axis=1)
        w2, s2 = w1[:, -1:] - w1, np.zeros(weight.shape)
        for j in range(1, weight.shape[1]):
            s2[:, :j] += weight[:, j : j + 1]
        with np.errstate(all="ignore"):
            between = np.where((n > 0) & (w2 > 0), w1 * w2 * (s1 / w1 - s2 / w2) ** 2, -np.inf)
        best = np.argmax(np.where(np.isnan(between), np.inf, between), axis=1)
        at = np.arange(len(starts))
        level = np.where(size > 1, center[at, best], t["lo"].to_numpy()[starts])
        return t.select(keys).take(pa.array(starts)).append_column(name, pa.array(level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, keys):
            yield from cut(t, starts).combine_chunks().to_batches()

    bins = h.select(*keys, "bin", F.col("lo").cast("double").alias("lo"), F.col("center").cast("double").alias("center"), F.col("n").cast("long").alias("n"))
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"`{name}` double"])
    return bins.repartition(*keys).sortWithinPartitions(*keys, "bin").mapInArrow(run, schema)


def threshold_yen(df: DataFrame, keys: list[str] = FIELD, value: str = "value", name: str = "yen") -> DataFrame:
    """Histogram cut that maximises the correlation criterion of the two classes."""
    h = histogram(df, keys, value)
    every = Window.partitionBy(*keys)
    p = h.withColumn("p", F.col("n") / F.sum("n").over(every))
    up, rest = _cumulative(h, keys)
    scored = p.select(
        *keys, "bin", "lo", "center", F.sum("p").over(up).alias("p1"),
        F.sum(F.col("p") * F.col("p")).over(up).alias("q1"), F.sum(F.col("p") * F.col("p")).over(rest).alias("q2"),
    ).withColumn("crit", 2 * F.log(F.col("p1") * (1 - F.col("p1"))) - F.log(F.col("q1") * F.col("q2")))
    best = F.max_by("center", F.when(F.col("crit").isNotNull(), F.struct(F.col("crit"), -F.col("bin"))))
    return scored.groupBy(*keys).agg(F.coalesce(best, F.min("lo")).alias(name))


def threshold_li(df: DataFrame, keys: list[str] = FIELD, value: str = "value", bins: int = 4096) -> DataFrame:
    """Minimum cross-entropy cut, iterated on a fixed-size histogram per group."""
    import numpy as np
    import pandas as pd

    h = histogram(df, keys, value, bins)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        base = pdf["lo"].iloc[0]
        c, n = pdf["center"].to_numpy() - base, pdf["n"].to_numpy(dtype=float)
        cut = float((c * n).sum() / n.sum())
        tol = max((pdf["hi"].iloc[0] - base) / (2.0 * bins), np.finfo(float).tiny)
        steps = 0
        for steps in range(1, 201):
            fore, back = c > cut, c <= cut
            if not fore.any() or not back.any():
                break
            mf, mb = np.average(c[fore], weights=n[fore]), np.average(c[back], weights=n[back])
            if mb <= 0 or mf == mb:
                break
            new = (mb - mf) / (math.log(mb) - math.log(mf))
            done = abs(new - cut) <= tol
            cut = float(new)
            if done:
                break
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, "li": cut + base, "steps": steps}])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "li double", "steps int"])
    return h.groupBy(*keys).applyInPandas(solve, schema)


def above(df: DataFrame, cut: DataFrame, keys: list[str], column: str, name: str, scale: float = 1.0) -> DataFrame:
    """Sparse mask: pixels whose value reaches the scaled group cut."""
    kept = df.join(cut, keys).where(F.col(column) >= F.col(name) * F.lit(scale))
    return kept.select(*keys, "y", "x", "height", "width")


# ------------------------------------------------------- display and contrast


def display_range(df: DataFrame, lo: float = 0.003, hi: float = 0.998) -> DataFrame:
    """Display bounds from the every-4th-pixel grid, with min/max and +1 fallbacks."""
    grid = df.where((F.col("y") % 4 == 0) & (F.col("x") % 4 == 0))
    q = exact_quantiles(grid, FIELD, "value", {"_lo": lo, "_hi": hi})
    m = grid.groupBy(*FIELD).agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    flat = F.col("_hi") <= F.col("_lo")
    low = F.when(flat, F.col("_min")).otherwise(F.col("_lo"))
    high = F.when(flat, F.col("_max")).otherwise(F.col("_hi"))
    return q.join(m, FIELD).select(
        "field_id", F.round(low, 6).alias("low"), F.round(F.when(high <= low, low + 1.0).otherwise(high), 6).alias("high")
    )


def snr_sensitivity(stack: DataFrame) -> DataFrame:
    """Contrast-to-noise of the every-8th-pixel grid, mapped to 0..1 per field."""
    keys = ["field_id", "channel"]
    grid = stack.where((F.col("y") % 8 == 0) & (F.col("x") % 8 == 0)).select(*keys, "value")
    q = exact_quantiles(grid, keys, "value", {"p50": 0.5, "p75": 0.75, "p995": 0.995})
    low = grid.join(q, keys).where(F.col("value") <= F.col("p75"))
    med = exact_quantiles(low, keys, "value", {"bg": 0.5})
    mad = exact_quantiles(low.join(med, keys), keys, F.abs(F.col("value") - F.col("bg")), {"mad": 0.5})
    signal = F.greatest(F.col("p995") - F.col("p50"), F.lit(0.0))
    noise = F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(0.02) * signal, F.lit(2.220446049250313e-16))
    per_channel = q.join(mad, keys).select(*keys, (signal / noise).alias("score"))
    lo, hi = math.log1p(3.0), math.log1p(20.0)
    # A field has at most a handful of channels, so this percentile is tiny.
    return per_channel.groupBy("field_id").agg(
        clip((F.log1p(F.percentile("score", F.lit(0.5))) - lo) / (hi - lo), 0, 1).alias("sensitivity")
    )


def normalize_evidence(df: DataFrame, keys: list[str] = FIELD, value: str = "value", out: str = "norm") -> DataFrame:
    """P1/P99.5 scaling of finite values; flat input gives 1 when positive, else 0."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    q = exact_quantiles(finite, keys, value, {"_lo": 0.01, "_hi": 0.995})
    v, lo, hi = F.col(value), F.col("_lo"), F.col("_hi")
    flat = hi <= lo + F.lit(1.1920928955078125e-07)
    unit = (
        F.when(v.isNull() | F.isnan(v), 0.0)
        .when(flat, F.when((v > lo) | ((hi > 0) & (lo == hi)), 1.0).otherwise(0.0))
        .otherwise(clip((v - lo) / (hi - lo), 0, 1))
    )
    return df.join(q, keys, "left").withColumn(out, F.coalesce(unit, F.lit(0.0))).drop("_lo", "_hi")
