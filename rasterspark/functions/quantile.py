"""Exact quantiles that never put a whole field into one task.

``F.percentile`` keeps every distinct value of a group in one state object. That
is fine for small groups (objects, planes' tiles), not for all pixels of a huge
field. Here values are first counted (map-side combine), then located by a
monotone logarithmic bin: a bin holds at most 2,048 distinct float32 values
whatever the data look like, so both the per-group bin list and the values
inside a selected bin stay small, and the result is still exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BINS_PER_OCTAVE = 4096


def magnitude_bin(value: Column) -> Column:
    """Monotone step function of ``value``; about 4,096 steps per octave."""
    # 1,100 octaves cover every double exponent, so the offset keeps bins positive.
    magnitude = F.floor((F.log2(F.abs(value)) + F.lit(1100.0)) * F.lit(float(_BINS_PER_OCTAVE))).cast("long")
    return F.when(value == 0, F.lit(0).cast("long")).otherwise(F.signum(value).cast("long") * magnitude)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str | Column,
    probs: dict[str, float],
    weight: str | None = None,
    small_groups: bool = False,
) -> DataFrame:
    """Linear-interpolation quantiles per group: one row per group, one column per name.

    NULL and NaN values are ignored. ``weight`` is an optional integer
    multiplicity, for data that is already counted. ``small_groups`` is for keys
    that bound the group themselves (one plane, one tile, one object): there the
    counted values go straight into the built-in aggregate.
    """
    v = F.col(value) if isinstance(value, str) else value
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = (
        df.select(*keys, v.cast("double").alias("_v"), *([weight] if weight else []))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(n.cast("long").alias("_n"))
    )
    if small_groups:
        every = F.percentile("_v", F.array(*[F.lit(float(q)) for q in probs.values()]), F.col("_n"))
        got = counted.groupBy(*keys).agg(every.alias("_q"))
        return got.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    counted = counted.withColumn("_bin", magnitude_bin(F.col("_v")))
    up_to = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = (
        counted.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_end", F.sum("_bn").over(up_to))
        .withColumn("_tot", F.sum("_bn").over(Window.partitionBy(*keys)))
    )
    wanted = []
    for name, q in probs.items():
        pos = (F.col("_tot") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            wanted.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.cast("long").alias("rank")))
    start = F.col("_end") - F.col("_bn")
    hits = (
        bins.withColumn("_want", F.filter(F.array(*wanted), lambda s: (s["rank"] >= start) & (s["rank"] < F.col("_end"))))
        .where(F.size("_want") > 0)
        .select(*keys, "_bin", start.alias("_start"), "_tot", "_want")
    )
    same_bin = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*keys, "_bin"]])
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counted.alias("c")
        .join(hits.alias("h"), same_bin)
        .select(*[F.col(f"c.{k}").alias(k) for k in keys], F.col("c._bin").alias("_bin"), "_v", "_n", "_start", "_tot", "_want")
        .withColumn("_to", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_n"))
        .withColumn("_got", F.filter("_want", lambda s: (s["rank"] >= F.col("_from")) & (s["rank"] < F.col("_to"))))
        .where(F.size("_got") > 0)
        .select(*keys, "_v", "_tot", F.explode("_got").alias("_g"))
    )
    out = []
    for name, q in probs.items():
        lo = F.max(F.when((F.col("_g.name") == name) & (F.col("_g.side") == "lo"), F.col("_v")))
        hi = F.max(F.when((F.col("_g.name") == name) & (F.col("_g.side") == "hi"), F.col("_v")))
        pos = (F.max("_tot") - 1) * F.lit(float(q))
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, name: str = "quantile") -> DataFrame:
    """First value whose cumulative weight reaches ``q`` of the total weight."""
    per_value = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*keys)
    return (
        per_value.withColumn("_cum", F.sum("_w").over(run))
        .withColumn("_tot", F.sum("_w").over(every))
        .groupBy(*keys)
        .agg(F.coalesce(F.min(F.when(F.col("_cum") >= F.lit(q) * F.col("_tot"), F.col(value))), F.max(value)).alias(name))
    )


def dense_index(df: DataFrame, keys: list[str], order: str, name: str, bucket: int = 65536) -> DataFrame:
    """1-based dense numbering of unique integer ``order`` values per group.

    Numbers inside fixed-width buckets are offset by the running bucket counts,
    so no task sorts more than one bucket.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / F.lit(bucket)).cast("long"))
    totals = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*keys, "_b").orderBy(order)
    return (
        b.withColumn("_rn", F.row_number().over(within))
        .join(offsets, [*keys, "_b"])
        .withColumn(name, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_b", "_rn", "_off")
    )
