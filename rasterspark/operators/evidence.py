"""Object evidence: enclosure, association, age, outliers, truncation and anchors."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterspark.functions.quantile import exact_quantiles
from rasterspark.functions.scalar import clip, first_reason, linear_evidence, reasons, sector
from rasterspark.functions.tiles import disk_offsets, group_quantile, whole_groups
from rasterspark.operators import depth, focal, graph, local, zonal
from rasterspark.operators.local import FIELD
from rasterspark.params import AGE_SETS
from rasterspark.session import cut_lineage

OBJ = ["field_id", "label_id"]
EPS32 = 1.1920928955078125e-07


def box_distance(objects: DataFrame, pitch_um: dict[str, float], pad_um: dict[str, float], max_um: float | None = None) -> DataFrame:
    """Distance to an object for every in-field voxel of its padded bounding box.

    ``objects``: (field_id, label_id, axes, height, width[, depth]). Each object is
    swept in its own crop, so overlapping crops never mix and the work follows
    object sizes.
    """
    axes = [a for a in ("z", "y", "x") if a in pitch_um]
    side = {"z": "depth", "y": "height", "x": "width"}
    lo = {a: F.greatest(F.lit(0), F.min(a) - math.ceil(pad_um[a] / pitch_um[a])) for a in axes}
    hi = {a: F.least(F.max(side[a]) - 1, F.max(a) + math.ceil(pad_um[a] / pitch_um[a])) for a in axes}
    box = objects.groupBy(*OBJ).agg(*[lo[a].cast("int").alias(f"_{a}0") for a in axes], *[(hi[a] - lo[a] + 1).cast("int").alias(side[a]) for a in axes])
    origin = [f"_{a}0" for a in axes]
    local_px = objects.select(*OBJ, *axes).join(box.hint("merge"), OBJ).select(
        *OBJ, *origin, *[(F.col(a) - F.col(f"_{a}0")).cast("int").alias(a) for a in axes], *[side[a] for a in axes])
    near = focal.nearest_seed(local_px, pitch_um, [*OBJ, *origin], label=None, max_um=max_um)
    return near.select(*OBJ, *[(F.col(a) + F.col(f"_{a}0")).cast("int").alias(a) for a in axes], "distance")


def _p(col: str | Column, q: float) -> Column:
    """Percentile inside one object crop (a bounded group)."""
    return F.percentile(col, F.lit(q))


Shell = Callable[[np.ndarray], np.ndarray]


def crop_evidence(
    px: DataFrame, ring_um: tuple[float, float], high: float, cut: Callable[[dict[str, np.ndarray]], np.ndarray],
    on: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], shells: dict[str, tuple[Shell, float]], keep: Shell | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Background, threshold and shells of every object crop, and the voxels that pass.

    ``px``: (field_id, label_id, z, y, x, value, distance). The background is the ring,
    or everything outside where the ring has fewer than 32 voxels. ``cut`` makes the
    threshold of the crops' median, mad, p75, ``high`` quantile and largest magnitude;
    ``on`` tells from value, distance and threshold which voxels pass. ``shells`` are
    regions by distance with a quantile each.

    Returns crops (field_id, label_id, bg_median, bg_p75, bg_mad, high, peak, threshold
    and name_q, name_share, name_on per shell) and voxels (field_id, label_id, z, y, x, on): those
    in ``keep``, or without it those that pass. A task takes the crops of many objects at once.
    """
    types = dict(px.dtypes)
    base = ["bg_median", "bg_p75", "bg_mad", "high", "peak", "threshold"]
    names = [*base, *(f"{n}_{c}" for n in shells for c in ("q", "share", "on"))]
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in OBJ), "z int", "y int", "x int", "`on` boolean", *(f"`{n}` double" for n in names)])

    def crops(t: pa.Table, starts: np.ndarray) -> pa.Table:
        n = len(starts)
        g = np.repeat(np.arange(n), np.diff(np.append(starts, t.num_rows)))
        known = t["value"].is_valid().to_numpy()
        v, d = t["value"].fill_null(0.0).to_numpy(), t["distance"].to_numpy()
        ring = (d >= ring_um[0]) & (d <= ring_um[1])
        enough = np.bincount(g[ring], minlength=n) >= 32
        back = np.where(enough[g], ring, d > 0) & known
        s = {"bg_median": group_quantile(v[back], g[back], n, 0.5), "bg_p75": group_quantile(v[back], g[back], n, 0.75)}
        s["bg_mad"] = 1.4826 * group_quantile(np.abs(v[back] - s["bg_median"][g[back]]), g[back], n, 0.5)
        s["high"] = group_quantile(v[known], g[known], n, high)
        s["peak"] = group_quantile(np.abs(v[known]), g[known], n, 1.0)
        s["threshold"] = cut(s)
        some = np.bincount(g[back], minlength=n) > 0
        passed = on(v, d, s["threshold"][g]) & known & some[g]
        missing = {c: ~some for c in base}
        for name, (inside, q) in shells.items():
            m = inside(d) & known & some[g]
            count, hit = np.bincount(g[m], minlength=n), np.bincount(g[m & passed], minlength=n)
            s[f"{name}_q"], s[f"{name}_on"] = group_quantile(v[m], g[m], n, q), hit.astype(float)
            s[f"{name}_share"] = hit / np.maximum(count, 1)
            missing |= {f"{name}_q": count == 0, f"{name}_share": count == 0, f"{name}_on": np.zeros(n, bool)}
        rows = np.flatnonzero(passed if keep is None else keep(d) & known & some[g])
        none = lambda k, kind: pa.nulls(k, kind)
        ids = pa.concat_tables([t.select(OBJ).take(pa.array(starts)), t.select(OBJ).take(pa.array(rows))])
        at = {a: pa.chunked_array([none(n, pa.int32()), t[a].take(pa.array(rows)).combine_chunks().cast(pa.int32())]) for a in ("z", "y", "x")}
        flag = pa.chunked_array([none(n, pa.bool_()), pa.array(passed[rows])])
        stats = {c: pa.chunked_array([pa.array(s[c], mask=missing[c]), none(len(rows), pa.float64())]) for c in names}
        return pa.table({**{k: ids[k] for k in OBJ}, **at, "on": flag, **stats})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, OBJ):
            yield from crops(t, starts).combine_chunks().to_batches()

    sent = px.select(*OBJ, "z", "y", "x", F.col("value").cast("double"), "distance").repartition(*OBJ).sortWithinPartitions(*OBJ)
    both = cut_lineage(sent.mapInArrow(run, schema))
    return both.where(F.col("on").isNull()).select(*OBJ, *names), both.where(F.col("on").isNotNull()).select(*OBJ, "z", "y", "x", "on")


def within_reach(points: DataFrame, targets: DataFrame, pitch_um: dict[str, float], keys: list[str], max_um: float) -> DataFrame:
    """The points that have a target of the same keys within ``max_um``: (keys, axes). For short reaches: every offset inside it is looked up."""
    axes = [a for a in ("x", "y", "z") if a in pitch_um]
    steps = [range(-math.floor(max_um / pitch_um[a] + 1e-9), math.floor(max_um / pitch_um[a] + 1e-9) + 1) for a in axes]
    near = [o for o in itertools.product(*steps) if sum((i * pitch_um[a]) ** 2 for a, i in zip(axes, o)) <= max_um * max_um * (1 + 1e-12)]
    moves = F.explode(F.array(*[F.struct(*[F.lit(i).alias(a) for a, i in zip(axes, o)]) for o in near]))
    seen = points.select(*keys, *axes, moves.alias("_o")).select(*keys, *axes, *[(F.col(a) + F.col(f"_o.{a}")).alias(f"_{a}") for a in axes])
    hit = seen.join(targets.select(*keys, *[F.col(a).alias(f"_{a}") for a in axes]).hint("merge"), [*keys, *[f"_{a}" for a in axes]], "left_semi")
    return hit.select(*keys, *axes).distinct()


def longest_circular_run(sectors: DataFrame, n: int = 12) -> DataFrame:
    """Longest run of supported sectors on a circle: (field_id, label_id, supported, longest)."""
    twice = sectors.select(*OBJ, F.explode(F.array(F.col("sector"), F.col("sector") + n)).alias("z"), F.lit(True).alias("active"))
    run = depth.true_runs(twice, OBJ).groupBy(*OBJ).agg(F.max("run_length").alias("_l"))
    k = sectors.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("supported"))
    return k.join(run, OBJ).select(*OBJ, "supported", F.least(F.col("_l"), F.lit(n)).alias("longest"))


def angular_coverage(boundary: DataFrame, keys: list[str] = OBJ, n: int = 12, share: float = 0.20) -> DataFrame:
    """Share of observed sectors whose boundary is covered to at least ``share``.

    ``boundary``: (keys, y, x, covered BOOLEAN).
    """
    c = boundary.groupBy(*keys).agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
    s = boundary.join(c, keys).withColumn("_s", sector(F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx"), n))
    g = s.groupBy(*keys, "_s").agg(F.avg(F.col("covered").cast("double")).alias("_c"))
    return g.groupBy(*keys).agg((F.count_if(F.col("_c") >= share) / F.count(F.lit(1))).alias("angular_coverage"))


def contact_sectors(contact: DataFrame, centres: DataFrame, pixel_area_um2: float, min_area_um2: float = 0.08, n: int = 12) -> DataFrame:
    """Sectors with enough contact area and their longest circular run.

    Sectors are centred on the axes. ``contact``: (field_id, label_id, y, x);
    ``centres``: (field_id, label_id, cy, cx).
    """
    s = contact.join(centres, OBJ).withColumn("sector", sector(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"), n, True))
    ok = s.groupBy(*OBJ, "sector").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * pixel_area_um2 >= min_area_um2)
    return longest_circular_run(ok.select(*OBJ, "sector"), n)


# ------------------------------------------------------------------ enclosure


def nucleus_enclosure(
    objects: DataFrame, structural: DataFrame, core: DataFrame, pitch_um: dict[str, float], dynamics: DataFrame | None = None, margin_um: float = 4.60
) -> DataFrame:
    """3D enclosure evidence of nuclei with scores, gates and reasons.

    ``objects``: (field_id, label_id, z, y, x, height, width, depth);
    ``structural``: (field_id, z, y, x, value), already smoothed; ``core``:
    (field_id, label_id, y, x), the 2D core of each object; ``dynamics``:
    (field_id, label_id, dynamic, min_dynamic) of the nuclear signal.
    """
    zs, ys, xs = pitch_um["z"], pitch_um["y"], pitch_um["x"]
    voxel = zs * ys * xs
    size = objects.groupBy(*OBJ).agg(
        (F.count(F.lit(1)) * voxel).alias("volume_um3"), ((F.max("z") - F.min("z") + 1) * zs).alias("z_span_um"),
        F.avg("z").alias("center_z"), F.avg("y").alias("center_y"), F.avg("x").alias("center_x"))
    flat = objects.select(*OBJ, "y", "x").distinct()
    share = core.join(flat.withColumn("_f", F.lit(1)), [*OBJ, "y", "x"], "left").groupBy(*OBJ).agg((F.count("_f") / F.count(F.lit(1))).alias("projection_overlap"))
    base = size.join(share, OBJ, "left").fillna(0.0, ["projection_overlap"])
    valid = (F.col("volume_um3") >= 0.45) & (F.col("z_span_um") >= 0.35) & (F.col("projection_overlap") >= 0.30)
    if dynamics is not None:
        base = base.join(dynamics, OBJ, "left")
        valid = valid & F.coalesce(F.col("dynamic") >= F.col("min_dynamic"), F.lit(False))
    base = base.withColumn("dapi_valid", valid).drop("dynamic", "min_dynamic")

    crop = box_distance(objects, pitch_um, {a: margin_um for a in pitch_um})
    px = crop.join(structural.select("field_id", "z", "y", "x", "value").hint("merge"), ["field_id", "z", "y", "x"])
    # Shells in um.
    edges = [0.08 + (0.95 - 0.08) * i / 3 for i in range(4)]
    bands = {f"band{i}": ((lambda d, i=i: (d >= edges[i]) & (d < edges[i + 1]) & (d > 0)), 0.70) for i in range(3)}
    floor = lambda s: EPS32 * 16.0 * np.maximum(s["peak"], 1.1754943508222875e-38)
    cut = lambda s: s["bg_median"] + np.maximum(np.maximum(floor(s), 1.5 * s["bg_mad"]), 0.12 * np.maximum(s["high"] - s["bg_median"], 0.0))
    stats, pos = crop_evidence(
        px, (1.35, 2.20), 0.99, cut, lambda v, d, t: (v > t) & (d > 0), {**bands, "shell": ((lambda d: (d >= 0.08) & (d <= 0.95)), 0.75)})
    dyn = F.greatest(F.col("high") - F.col("bg_median"), F.lit(EPS32 * 16.0) * F.greatest(F.col("peak"), F.lit(1.1754943508222875e-38)))
    ok = [F.coalesce((F.col(f"{b}_share") >= 0.08) & (F.col(f"{b}_q") >= F.col("threshold")), F.lit(False)).cast("double") for b in bands]
    g = stats.where(F.col("threshold").isNotNull()).select(
        *OBJ, clip((F.coalesce("shell_q", F.lit(0.0)) - F.col("bg_p75")) / dyn, -1, 1).alias("shell_enrichment"),
        ((ok[0] + ok[1] + ok[2]) / 3.0).alias("radial_bands"), F.col("threshold").alias("structural_threshold"))

    def outer(px3: DataFrame, axes: tuple[str, ...], keys: list[str]) -> DataFrame:
        """Object voxels with a face neighbour outside the object."""
        moves = [F.struct(*[F.lit(s if a == b else 0).alias(f"d{b}") for b in axes]) for a in axes for s in (-1, 1)]
        near = px3.select(*keys, *axes, F.explode(F.array(*moves)).alias("o")).select(
            *keys, *axes, *[(F.col(a) + F.col(f"o.d{a}")).alias(f"n{a}") for a in axes])
        have = px3.select(*keys, *[F.col(a).alias(f"n{a}") for a in axes])
        return near.join(have, [*keys, *[f"n{a}" for a in axes]], "left_anti").select(*keys, *axes).distinct()

    skin = cut_lineage(outer(objects.select(*OBJ, "z", "y", "x"), ("z", "y", "x"), OBJ))
    touched = within_reach(skin, pos, pitch_um, OBJ, 0.55).groupBy(*OBJ).agg(F.count(F.lit(1)).alias("_t"))
    surface = skin.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("_n")).join(touched, OBJ, "left").select(
        *OBJ, (F.coalesce("_t", F.lit(0)) / F.col("_n")).alias("surface_coverage"))
    areas = objects.groupBy(*OBJ, "z").agg(F.count(F.lit(1)).alias("_a")).withColumn("_m", F.max("_a").over(Window.partitionBy(*OBJ)))
    central = areas.where(F.col("_a") >= 0.45 * F.col("_m")).select(*OBJ, "z")
    rim = outer(objects.join(central, [*OBJ, "z"], "left_semi").select(*OBJ, "z", "y", "x"), ("y", "x"), [*OBJ, "z"])
    # In-plane contact: the plane becomes part of the key.
    rim = cut_lineage(rim)
    flat_reach = within_reach(rim, pos, {"y": ys, "x": xs}, [*OBJ, "z"], 0.55).withColumn("_c", F.lit(True))
    cov = cut_lineage(rim.join(flat_reach.hint("merge"), [*OBJ, "z", "y", "x"], "left").withColumn("covered", F.coalesce("_c", F.lit(False))))
    per_z = cov.groupBy(*OBJ, "z").agg(F.avg(F.col("covered").cast("double")).alias("_b")).join(angular_coverage(cov, [*OBJ, "z"]), [*OBJ, "z"])
    flags = per_z.withColumn("active", (F.col("_b") >= 0.42) & (F.col("angular_coverage") >= 0.75))
    med = per_z.groupBy(*OBJ).agg(_p("_b", 0.5).alias("boundary_coverage"), _p("angular_coverage", 0.5).alias("angular_coverage"))
    run = depth.longest_true_run(flags, OBJ).join(central.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("_cz")), OBJ).select(*OBJ, (F.col("longest") / F.col("_cz")).alias("z_support"))
    zero = {"surface_coverage": 0.0, "boundary_coverage": 0.0, "angular_coverage": 0.0, "z_support": 0.0, "radial_bands": 0.0, "shell_enrichment": -1.0}
    j = base.join(g, OBJ, "left").join(surface, OBJ, "left").join(med, OBJ, "left").join(run, OBJ, "left").fillna(zero)
    j = j.withColumns({n: F.when(F.col("dapi_valid"), F.col(n)).otherwise(F.lit(v)) for n, v in zero.items()})
    ramp = lambda c, lo, width: linear_evidence(c, lo, lo + width)
    score = (0.30 * ramp("surface_coverage", 0.20, 0.55) + 0.25 * ramp("angular_coverage", 0.20, 0.65) + 0.20 * ramp("z_support", 0.15, 0.70)
             + 0.15 * ramp("shell_enrichment", -0.02, 0.35) + 0.10 * F.col("radial_bands"))
    j = j.withColumn("enclosure", F.when(F.col("dapi_valid"), score).otherwise(0.0))
    why = reasons(
        ("invalid_3d_dapi_object", ~F.col("dapi_valid")), ("low_enclosure_score", F.col("enclosure") < 0.48),
        ("surface", F.col("surface_coverage") < 0.34), ("angular", F.col("angular_coverage") < 0.75),
        ("z_continuity", F.col("z_support") < 0.34), ("shell_enrichment", F.col("shell_enrichment") < 0.04))
    hard = F.size(F.array_except(why, F.array(F.lit("shell_enrichment")))) == 0
    return j.withColumns({"accepted": hard, "reasons": F.when(hard, F.array().cast("array<string>")).otherwise(why)})


def nucleus_inventory(dapi: DataFrame, cores: DataFrame, whole: DataFrame, pitch_um: dict[str, float], link_um: float = 0.75) -> DataFrame:
    """3D nucleus objects grown from 2D cores that lie near a whole cell.

    ``dapi``: (field_id, z, y, x, value, height, width, depth); ``cores``:
    (field_id, label_id, y, x, height, width); ``whole``: mask. Voxels above the
    low cut of their core's column range, in profile-active planes, are kept when
    connected to a voxel above the high cut.
    """
    flat = {"y": pitch_um["y"], "x": pitch_um["x"]}
    near = focal.distance_to(whole, flat, link_um).select("field_id", "y", "x")
    linked = cores.join(cores.join(near, ["field_id", "y", "x"], "left_semi").select(*OBJ).distinct(), OBJ, "left_semi")
    reach = focal.nearest_seed(linked, flat, max_um=0.75).select("field_id", "y", "x", "label_id")
    px = cut_lineage(dapi.join(reach, ["field_id", "y", "x"]))
    core_px = dapi.join(linked.select(*OBJ, "y", "x"), ["field_id", "y", "x"])
    profile = exact_quantiles(core_px, [*OBJ, "z"], "value", {"p85": 0.85}, small_groups=True)
    span = profile.groupBy(*OBJ).agg(_p("p85", 0.10).alias("_b"), F.max("p85").alias("_t"))
    act = profile.join(span, OBJ).where(F.col("p85") >= F.col("_b") + 0.22 * (F.col("_t") - F.col("_b"))).select(*OBJ, "z")
    lim = px.groupBy(*OBJ).agg(_p("value", 0.001).alias("_lo"), _p("value", 0.999).alias("_hi"))
    dyn = F.col("_hi") - F.col("_lo")
    dom = px.join(act, [*OBJ, "z"], "left_semi").join(lim, OBJ).where(F.col("value") >= F.col("_lo") + 0.28 * dyn)
    dom = dom.withColumn("_seed", F.col("value") >= F.col("_lo") + 0.48 * dyn)
    comp = graph.components(dom.withColumnRenamed("label_id", "core_id").select("field_id", "core_id", "z", "y", "x", "height", "width"), ["field_id", "core_id"])
    at = ["field_id", "core_id", "z", "y", "x"]
    seeds = dom.where("_seed").select("field_id", F.col("label_id").alias("core_id"), "z", "y", "x")
    hit = comp.join(seeds, at, "left_semi").select("field_id", "core_id", "label_id").distinct()
    depth_of = dapi.groupBy("field_id").agg(F.max("depth").alias("depth"))
    return comp.join(hit, ["field_id", "core_id", "label_id"], "left_semi").withColumnRenamed("label_id", "object_id").join(depth_of, "field_id")


# ---------------------------------------------------------------- association


def gfap_association(
    nuclei: DataFrame, gfap: DataFrame, structure: DataFrame, pitch_um: dict[str, float], min_strong: float = 0.30
) -> DataFrame:
    """Local fibre evidence of every 3D nucleus, with ordered reasons.

    ``nuclei``: (field_id, label_id, z, y, x, height, width, depth); ``gfap``:
    (field_id, z, y, x, value); ``structure``: (field_id, y, x, score, structure).
    """
    zs, ys, xs = pitch_um["z"], pitch_um["y"], pitch_um["x"]
    crop = box_distance(nuclei, pitch_um, {"z": 4.0, "y": 8.0, "x": 8.0})
    px = crop.join(gfap.select("field_id", "z", "y", "x", "value").hint("merge"), ["field_id", "z", "y", "x"])
    floor = lambda s: np.maximum(1.0, EPS32 * 16.0 * np.maximum(np.abs(s["high"]), 1.0))
    cut = lambda s: s["bg_median"] + np.maximum(np.maximum(floor(s), 1.5 * s["bg_mad"]), 0.08 * np.maximum(s["high"] - s["bg_median"], 0.0))
    near = lambda d: (d > 0) & (d <= 1.50)
    stats, shell = crop_evidence(px, (2.0, 4.0), 0.995, cut, lambda v, d, t: (v >= t) | np.isnan(v), {"shell": (near, 0.75)}, near)
    least = F.greatest(F.lit(1.0), F.lit(EPS32 * 16.0) * F.greatest(F.abs("high"), F.lit(1.0)))
    a = stats.select(
        *OBJ, ((F.col("shell_q") - F.col("bg_median")) / F.greatest(F.col("bg_mad"), least)).alias("shell_enrichment"),
        (F.col("shell_on") * zs * ys * xs).alias("shell_support_um3"))
    planes = nuclei.select(*OBJ, "z").distinct()
    pz = shell.groupBy(*OBJ, "z").agg(F.avg(F.col("on").cast("double")).alias("_f"))
    act = planes.join(pz, [*OBJ, "z"], "left").withColumn("active", F.coalesce(F.col("_f") >= 0.03, F.lit(False)))
    z = act.groupBy(*OBJ).agg(F.count_if("active").alias("supported_z"), F.count(F.lit(1)).alias("_nz"))
    z = z.join(depth.longest_true_run(act, OBJ), OBJ).withColumn("supported_z_fraction", F.col("longest") / F.col("_nz")).drop("_nz", "longest")

    flat = nuclei.select(*OBJ, "y", "x", "height", "width").distinct()
    d2 = cut_lineage(box_distance(flat, {"y": ys, "x": xs}, {"y": 8.0, "x": 8.0}).join(structure.select("field_id", "y", "x", "score", "structure"), ["field_id", "y", "x"]))
    ref = d2.where((F.col("distance") >= 2.0) & (F.col("distance") <= 4.0)).groupBy(*OBJ).agg(_p("score", 0.95).alias("_r"))
    cut = F.greatest(F.lit(min_strong), F.coalesce("_r", F.lit(0.0)))
    dims = flat.groupBy(*OBJ).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    strong = d2.join(ref, OBJ, "left").where(F.col("structure") & (F.col("score") >= cut) & (F.col("distance") > 0) & (F.col("distance") <= 8.0)).join(dims, OBJ)
    owner = strong.withColumnRenamed("label_id", "nucleus_id")
    comp = graph.components(owner, ["field_id", "nucleus_id"], dense=False)
    k2 = ["field_id", "nucleus_id"]
    pxs = comp.join(owner.select(*k2, "y", "x", "distance"), [*k2, "y", "x"])
    touch = pxs.where(F.col("distance") <= 1.50).select(*k2, "label_id").distinct()
    anchored = cut_lineage(pxs.join(touch, [*k2, "label_id"], "left_semi").drop("label_id").withColumnRenamed("nucleus_id", "label_id"))
    s = anchored.groupBy(*OBJ).agg((F.count(F.lit(1)) * ys * xs).alias("anchored_area_um2"), F.max("distance").alias("anchored_reach_um"))
    centres = flat.groupBy(*OBJ).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    c = contact_sectors(anchored.where(F.col("distance") <= 1.50).select(*OBJ, "y", "x"), centres, ys * xs)
    py, pxn = math.ceil(4.0 / ys), math.ceil(4.0 / xs)
    trunc = flat.groupBy(*OBJ).agg(((F.min("y") - py < 0) | (F.max("y") + 1 + py > F.max("height")) | (F.min("x") - pxn < 0) | (F.max("x") + 1 + pxn > F.max("width"))).alias("truncated"))
    j = trunc.join(a, OBJ, "left").join(z, OBJ, "left").join(s, OBJ, "left").join(c, OBJ, "left").fillna(
        0.0, ["shell_enrichment", "shell_support_um3", "supported_z_fraction", "anchored_area_um2", "anchored_reach_um"]).fillna(0, ["supported_z", "supported", "longest"])
    return j.withColumn("reasons", association_reasons()).withColumn("associated", F.size("reasons") == 0)


def association_reasons() -> Column:
    # Reason names and limits.
    return reasons(
        ("weak_perinuclear_gfap_enrichment", F.col("shell_enrichment") < 4.5), ("local_reference_annulus_image_truncated", F.col("truncated")),
        ("gfap_support_not_repeated_across_z", F.col("supported_z") < 2), ("gfap_support_lacks_z_continuity", F.col("supported_z_fraction") < 0.25),
        ("insufficient_perinuclear_gfap_volume", F.col("shell_support_um3") < 0.30), ("insufficient_connected_gfap_structure", F.col("anchored_area_um2") < 0.75),
        ("connected_gfap_structure_too_short", F.col("anchored_reach_um") < 1.6),
        ("single_direction_gfap_contact", (F.col("supported") < 3) | (F.col("longest") < 2) | (F.col("supported") / 12.0 < 0.20)))


def weak_enrichment_fallback(assoc: DataFrame, minimum: float = 4.5, share: float = 0.75) -> DataFrame:
    """Accept the only nucleus of a field that failed on mildly weak enrichment alone."""
    w = Window.partitionBy("field_id")
    only = F.array_join("reasons", ",") == "weak_perinuclear_gfap_enrichment"
    fit = only & (F.col("shell_enrichment") >= minimum * share)
    j = assoc.withColumns({"_fit": fit, "_any": F.max("associated").over(w)}).withColumn("_k", F.count_if("_fit").over(w))
    used = F.col("_fit") & ~F.col("_any") & (F.col("_k") == 1)
    return j.withColumns({
        "fallback": used, "associated": F.col("associated") | used, "reasons": F.when(used, F.array().cast("array<string>")).otherwise(F.col("reasons"))}).drop("_fit", "_any", "_k")


# --------------------------------------------------------------------- age


def age_profile(components: DataFrame, params: str = "egfp_gfap", pixel_area_um2: float = 1.0, top: int = 24) -> DataFrame:
    """Age class per field from the largest components.

    ``components``: (field_id, label_id, area, touches_border, thin_fraction,
    solidity, axis_ratio, skeleton_px, endpoints, branchpoints, nuclei).
    """
    cfg = AGE_SETS[params]
    pitch = math.sqrt(pixel_area_um2)
    minimum = max(32, int(round(12.0 / pixel_area_um2)))
    w = Window.partitionBy("field_id")
    big = F.col("area") >= minimum
    inner = big & ~F.col("touches_border")
    c = components.withColumns({"_big": F.count_if(big).over(w), "_in": F.count_if(inner).over(w)})
    use = F.when(F.col("_in") >= 3, inner).when(F.col("_big") > 0, big).otherwise(F.lit(True))
    order = w.orderBy(F.desc("area"), "label_id")
    # Top-k is the feature: only the largest components vote.
    c = c.where(use).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    length = F.greatest(F.col("skeleton_px") * pitch, F.lit(pitch))
    m = lambda col: F.percentile(col, F.lit(0.5))
    g = c.groupBy("field_id").agg(
        F.count(F.lit(1)).alias("components"), m(F.col("area") * pixel_area_um2 / length).alias("width_um"), m("thin_fraction").alias("thin_fraction"),
        m("solidity").alias("solidity"), m("axis_ratio").alias("axis_ratio"), m(10.0 * F.col("branchpoints") / length).alias("branch_density"),
        m(10.0 * F.col("endpoints") / length).alias("endpoint_density"), F.avg((F.col("nuclei") >= 2).cast("double")).alias("multi_nucleus"))
    source = {
        "broad_structure": ("width_um", False), "solid_structure": ("solidity", False), "limited_thin_arbor": ("thin_fraction", True),
        "limited_branching": ("branch_density", True), "polarized_shape": ("axis_ratio", False), "multi_nucleus_overlap": ("multi_nucleus", False)}
    score = F.lit(0.0)
    for name, (col, inverse) in source.items():
        e = linear_evidence(col, *cfg["bounds"][name])
        score = score + F.lit(cfg["weights"][name]) * ((1.0 - e) if inverse else e)
    return g.withColumn("score", F.round(score, 6)).withColumns({
        "profile": F.when(F.col("score") >= cfg["threshold"], "neonatal").otherwise("mature"), "margin": F.round(F.abs(F.col("score") - cfg["threshold"]), 6)})


def age_parameter_set(channels: DataFrame) -> DataFrame:
    """Calibrated parameter set by structural channels present: (field_id, parameter_set)."""
    g = channels.groupBy("field_id").agg(F.array_sort(F.collect_set(F.when(F.col("channel").isin("eGFP", "GFAP"), F.col("channel")))).alias("c"))
    return g.select("field_id", F.when(F.array_contains("c", "GFAP") & F.array_contains("c", "eGFP"), "egfp_gfap").when(F.array_contains("c", "eGFP"), "egfp_only").alias("parameter_set"))


# ------------------------------------------------------------------ outliers


def morphology_outliers(cells: DataFrame, robust_z: float = 3.5, min_reference: int = 8, min_consensus: int = 3) -> DataFrame:
    """Votes, reasons and removal of outlying cells per field.

    ``cells``: (field_id, cell_id, area_px, area_um2, core_um, skeleton_um,
    branchpoints, endpoints, solidity, axis_ratio, contrast, process_fraction,
    anchors, protected).
    """
    from rasterspark.operators.rank import leave_one_out

    ln = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-6)))
    feats = {
        "log_area": ln("area_um2"), "log_core": ln("core_um"), "log_skeleton": ln("skeleton_um"), "branchpoints": F.col("branchpoints").cast("double"),
        "endpoints": F.col("endpoints").cast("double"), "solidity": F.col("solidity"), "axis_ratio": F.col("axis_ratio"), "contrast": F.col("contrast")}
    wide = cells.select("field_id", "cell_id", *[c.alias(n) for n, c in feats.items()])
    long = wide.unpivot(["field_id", "cell_id"], list(feats), "feature", "value")
    loo = leave_one_out(long, ["field_id", "feature"]).withColumn("z", (F.col("value") - F.col("median")) / F.col("scale"))
    z = loo.groupBy("field_id", "cell_id").pivot("feature", list(feats)).agg(F.first("z"))
    z = z.select("field_id", "cell_id", *[F.col(n).alias(f"z_{n}") for n in feats])
    med = lambda c: F.percentile(c, F.lit(0.5))
    f = cells.groupBy("field_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("area_px").alias("_px"), F.exp(med(feats["log_area"])).alias("_area"), F.exp(med(feats["log_core"])).alias("_core"),
        F.exp(med(feats["log_skeleton"])).alias("_skel"), med("branchpoints").alias("_br"), med("solidity").alias("_sol"), med("process_fraction").alias("_pf"))
    j = cells.join(z, ["field_id", "cell_id"]).join(f, "field_id")
    c = F.col
    few = lambda share: F.greatest(F.lit(1), F.floor(share * c("_br")))
    # Reason names and limits of votes and cues.
    votes = reasons(
        ("small_area", (c("z_log_area") <= -robust_z) & (c("area_um2") <= 0.45 * c("_area"))), ("thin_core", (c("z_log_core") <= -robust_z) & (c("core_um") <= 0.65 * c("_core"))),
        ("short_skeleton", (c("z_log_skeleton") <= -robust_z) & (c("skeleton_um") <= 0.45 * c("_skel"))), ("few_branches", (c("z_branchpoints") <= -robust_z) & (c("branchpoints") <= few(0.25))),
        ("few_endpoints", (c("z_endpoints") <= -robust_z) & (c("endpoints") <= 2)), ("high_solidity", (c("z_solidity") >= robust_z) & (c("solidity") >= 0.82)),
        ("high_axis_ratio", (c("z_axis_ratio") >= robust_z) & (c("axis_ratio") >= 4.25)), ("low_structural_contrast", (c("z_contrast") <= -robust_z) & (c("contrast") <= 0)))
    cues = reasons(
        ("relative_small_area", c("area_um2") <= 0.45 * c("_area")), ("relative_short_skeleton", c("skeleton_um") <= 0.45 * c("_skel")), ("relative_few_branches", c("branchpoints") <= few(0.45)),
        ("relative_low_process_fraction", c("process_fraction") <= F.least(F.lit(0.55), 0.75 * c("_pf"))), ("relative_high_solidity", c("solidity") >= F.greatest(F.lit(0.50), 1.25 * c("_sol"))))
    j = j.withColumns({"votes": votes, "cues": cues})
    enough, bare = c("_n") >= min_reference, c("anchors") == 0
    reason = first_reason(
        ("small_elongated_morphology_outlier", enough & (c("axis_ratio") >= 4.25) & (c("area_um2") <= 0.35 * c("_area")) & (c("skeleton_um") <= 0.35 * c("_skel")) & (c("core_um") <= 1.10 * c("_core"))),
        ("unanchored_thin_fragment", bare & (c("axis_ratio") >= 4.25) & (c("branchpoints") <= 1) & (c("core_um") <= 0.95)),
        ("unanchored_multimetric_outlier", enough & bare & (F.size("votes") >= min_consensus)),
        ("compact_multimetric_outlier", enough & (c("_pf") >= 0.60) & (c("_br") >= 3.0) & F.array_contains("cues", "relative_high_solidity") & (F.size("cues") >= min_consensus + 1)))
    zs = [c(f"z_{n}") for n in feats]
    severity = F.size("votes") + F.size("cues") + F.greatest(F.abs(F.least(*zs)), F.abs(F.greatest(*zs))) / 10.0
    j = j.withColumns({"reason": reason, "severity": severity}).withColumn("_cand", c("reason").isNotNull() & ~c("protected"))
    order = Window.partitionBy("field_id").orderBy(F.desc("_cand"), F.desc(F.round("severity", 12)), "cell_id")
    j = j.withColumn("_r", F.row_number().over(order))
    w = Window.partitionBy("field_id")
    j = j.withColumn("_take", c("_cand") & (c("_r") <= F.greatest(F.lit(1), F.floor(c("_n") * 0.25))))
    j = j.withColumns({"_k": F.count_if("_take").over(w), "_kp": F.sum(F.when(c("_take"), c("area_px")).otherwise(0)).over(w)})
    allowed = (c("_n") - c("_k") >= 5) & (c("_kp") <= 0.25 * c("_px"))
    return j.withColumn("removed", c("_take") & allowed).select("field_id", "cell_id", "votes", "cues", "reason", "severity", "removed")


def valid_soma_gate(cells: DataFrame) -> DataFrame:
    """Keep cells with exactly one connected soma; survivors get dense new ids.

    ``cells``: (field_id, cell_id, anchors, soma_px, process_px, soma_components, unresolved).
    """
    c = F.col
    why = first_reason(
        ("unresolved_multi_soma_instance_split", c("unresolved")), ("no_valid_soma", (c("anchors") == 0) | (c("soma_px") == 0)),
        ("multiple_valid_somata_after_instance_split", c("anchors") > 1), ("disconnected_soma_geometry", c("soma_components") != 1), ("empty_processes_compartment", c("process_px") == 0))
    j = cells.withColumn("reason", why)
    run = Window.partitionBy("field_id").orderBy("cell_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keep = c("reason").isNull()
    return j.withColumn("new_id", F.when(keep, F.sum(keep.cast("long")).over(run)))


def soma_components(regions: DataFrame) -> DataFrame:
    """Number of connected soma parts per cell."""
    s = regions.where(F.col("part") == "soma").select("field_id", "cell_id", "y", "x", "height", "width")
    lab = graph.components(s, ["field_id", "cell_id"], dense=False)
    return lab.groupBy("field_id", "cell_id").agg(F.countDistinct("label_id").alias("soma_components"))


def post_compartment_quality(regions: DataFrame, pitch_um: dict[str, float]) -> DataFrame:
    """Process area and fraction, hub distance and border contact per cell, with reasons.

    ``regions``: (field_id, y, x, cell_id, part, height, width).
    """
    k = ["field_id", "cell_id"]
    area = pitch_um["y"] * pitch_um["x"]
    edge = local_border()
    part = lambda p: F.col("part") == p
    g = regions.groupBy(*k).agg(
        F.count(F.lit(1)).alias("_w"), F.count_if(part("processes")).alias("_p"), F.max(part("soma") & edge).alias("soma_border"), F.max(edge).alias("incomplete"))
    proc = regions.where(part("processes")).select(*k, "y", "x", "height", "width")
    soma = regions.where(part("soma")).select(*k, "y", "x")
    th = cut_lineage(zonal.thickness(proc, pitch_um, label="cell_id"))
    top = th.groupBy(*k).agg(F.max("thickness").alias("_t"))
    hubs = th.join(top.hint("merge"), k).where(F.col("thickness") >= F.col("_t") - F.greatest(F.lit(1e-9), 1e-6 * F.col("_t"))).select(*k, "y", "x", "_t")
    hub = zonal.label_distance(soma, hubs, pitch_um, label="cell_id", out="hub").groupBy(*k).agg(
        F.min("hub").alias("hub_distance_um"), F.max("_t").alias("max_thickness_um"), F.count(F.lit(1)).alias("hub_px"))
    j = g.join(hub.hint("merge"), k, "left").withColumns({"process_area_um2": F.col("_p") * area, "process_fraction": F.col("_p") / F.greatest(F.col("_w"), F.lit(1))})
    far = F.coalesce(F.col("hub_distance_um") > 15.0, F.lit(False))
    return j.withColumn("reasons", reasons(
        ("empty_assigned_processes", F.col("hub_distance_um").isNull()), ("assigned_process_area_below_minimum", F.col("process_area_um2") < 15.0),
        ("processes_whole_fraction_below_minimum", F.col("process_fraction") < 0.12), ("owner_centered_hub_distance_above_maximum", far),
        ("soma_touches_image_border", F.col("soma_border")))).drop("_w", "_p")


def local_border() -> Column:
    from rasterspark.functions.scalar import on_border

    return on_border()


# ------------------------------------------------------------- truncation


def axial_truncation(owners: DataFrame, extents: DataFrame, dapi: DataFrame, window: DataFrame, pitch_um: dict[str, float]) -> DataFrame:
    """Cells whose owner nucleus demonstrably continues beyond a selected depth face.

    ``owners``: (field_id, cell_id, label_id, volume_um3, z_min, z_max,
    threshold); ``extents``: (field_id, label_id, y, x, height, width); ``dapi``:
    (field_id, z, y, x, value); ``window``: (field_id, z0, z1, depth).
    """
    zs, area = pitch_um["z"], pitch_um["y"] * pitch_um["x"]
    band, guard = max(1, math.ceil(0.55 / zs)), max(1, math.ceil(2.0 / zs))
    o = owners.join(window, "field_id")
    ref = F.percentile("volume_um3", F.lit(0.5))
    med = owners.groupBy("field_id").agg(F.when(F.count(F.lit(1)) >= 4, ref).otherwise(0.0).alias("_ref"))
    front = (F.col("z0") > 0) & (F.col("z_min") <= F.col("z0") + band - 1)
    back = (F.col("z1") < F.col("depth") - 1) & (F.col("z_max") >= F.col("z1") - band + 1)
    face = F.array_compact(F.array(
        F.when(front, F.struct(F.lit("front").alias("face"), F.greatest(F.lit(0), F.col("z0") - guard).alias("a"), (F.col("z0") + band - 1).alias("b"), F.col("z0").alias("split"))),
        F.when(back, F.struct(F.lit("back").alias("face"), (F.col("z1") - band + 1).alias("a"), F.least(F.col("depth") - 1, F.col("z1") + guard).alias("b"), (F.col("z1") + 1).alias("split")))))
    faces = o.select("field_id", "cell_id", "label_id", "threshold", F.explode(face).alias("f")).select("field_id", "cell_id", "label_id", "threshold", "f.face", "f.a", "f.b", "f.split")
    flat = {"y": pitch_um["y"], "x": pitch_um["x"]}
    support = box_distance(extents, flat, {"y": 0.45, "x": 0.45}, 0.45).select(*OBJ, "y", "x")
    slabs = faces.withColumn("z", F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))))
    dims = extents.groupBy(*OBJ).agg(F.max("height").alias("height"), F.max("width").alias("width"), F.count(F.lit(1)).alias("_ext"))
    px = slabs.join(support, OBJ).join(dapi.select("field_id", "z", "y", "x", "value"), ["field_id", "z", "y", "x"]).where(F.col("value") >= F.col("threshold")).join(dims, OBJ)
    k = ["field_id", "cell_id", "face"]
    # The slab column rides in the key-wise components of each face.
    lab = graph.components(px.select(*k, "z", "y", "x", "height", "width"), k, dense=False)
    lab = lab.drop("height", "width").join(faces.join(dims, OBJ).select(*k, "split", "_ext"), k)
    outside = F.when(F.col("face") == "front", F.col("z") < F.col("split")).otherwise(F.col("z") >= F.col("split"))
    edge = F.when(F.col("face") == "front", F.col("z").between(F.col("split"), F.col("split") + band - 1)).otherwise(F.col("z").between(F.col("split") - band, F.col("split") - 1))
    lab = lab.withColumns({"_o": outside, "_e": edge})
    per = lab.groupBy(*k, "label_id").agg(F.count_if("_o").alias("_on"), F.max("_e").alias("_touch")).where("_touch")
    out = per.groupBy(*k).agg((F.max("_on") * zs * area).alias("outside_um3"))
    touching = per.select(*k, "label_id")
    plane = lab.where("_e").join(touching, [*k, "label_id"], "left_semi").groupBy(*k, "z").agg((F.count(F.lit(1)) / F.max("_ext")).alias("_r"))
    ratio = plane.groupBy(*k).agg(F.max("_r").alias("boundary_ratio"))
    j = faces.select(*k, "label_id").join(out, k, "left").join(ratio, k, "left").fillna(0.0, ["outside_um3", "boundary_ratio"]).join(owners.drop("threshold"), ["field_id", "cell_id", "label_id"]).join(med, "field_id")
    v = F.col("volume_um3")
    cont = (F.col("outside_um3") >= 0.35) & (F.col("outside_um3") / v >= 0.12) & (F.col("boundary_ratio") >= 0.24)
    small = (v / (v + F.col("outside_um3")) < 0.62) | ((F.col("z_max") - F.col("z_min") + 1) * zs < 0.50) | ((F.col("_ref") > 0) & (v / F.col("_ref") < 0.34))
    hit = j.withColumns({"continuation": cont, "small": small})
    cell = hit.groupBy("field_id", "cell_id").agg(F.max(F.col("continuation") & F.col("small")).alias("_x"), F.max("outside_um3").alias("outside_um3"), F.max("boundary_ratio").alias("boundary_ratio"))
    r = owners.select("field_id", "cell_id").join(cell, ["field_id", "cell_id"], "left")
    return r.select("field_id", "cell_id", "outside_um3", "boundary_ratio", F.when(F.coalesce("_x", F.lit(False)), "removed_confirmed_axial_truncation").otherwise("retained").alias("status"))


# ------------------------------------------------------------------- anchors


def nuclei_core_extent(dapi: DataFrame, pixel_um: float = 1.0, min_px: int = 40, core_q: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Strict nuclear cores and their seed-connected, lower-threshold extents."""
    norm = cut_lineage(local.robust01(dapi).select("field_id", "y", "x", "height", "width", "norm"))
    q = exact_quantiles(norm, FIELD, "norm", {"_core": core_q, "_low": 0.68})
    cut = local.threshold_otsu(norm, FIELD, "norm").join(q, FIELD).withColumn("high", F.greatest("otsu", "_core"))
    cut = cut.withColumn("low", F.least("high", F.greatest(F.col("_low"), 0.58 * F.col("high")))).select("field_id", "high", "low")
    px = norm.join(cut, "field_id")
    cols = ["field_id", "y", "x", "height", "width"]
    core = cut_lineage(graph.remove_small(focal.morphology(px.where(F.col("norm") >= F.col("high")).select(*cols), "open", disk_offsets(1)), min_px))
    grown = graph.grow(core, px.where(F.col("norm") >= F.col("low")).select(*cols))
    closed = focal.morphology(grown, "close", disk_offsets(max(1, round(0.18 / max(pixel_um, 1e-4)))))
    filled = graph.remove_small_holes(closed, max(16, round(0.20 / max(pixel_um**2, 1e-6))))
    extent = graph.remove_small(filled, min_px).unionByName(core).dropDuplicates(["field_id", "y", "x"])
    return core, extent


def nuclei_mask(dapi: DataFrame, min_px: int = 40, q: float = 0.85) -> DataFrame:
    return nuclei_core_extent(dapi, 1.0, min_px, q)[0]


def anchor_groups(nuclei: DataFrame, separation_um: float = 6.0, max_groups: int = 4) -> DataFrame:
    """Distinct soma anchors of every component, in score order, with merged nuclei.

    ``nuclei``: (field_id, component_id, nucleus_id, score, thickness, structure,
    overlap, model, cy_um, cx_um). Each round adds the best eligible nucleus that
    is not near an earlier anchor, so at most ``max_groups`` rounds are planned
    and no component is gathered.
    """
    k = ["field_id", "component_id"]
    c = F.col
    w = Window.partitionBy(*k).orderBy(F.desc("score"), "nucleus_id")
    n = nuclei.withColumns({"rank": F.row_number().over(w), "_top": F.max("score").over(Window.partitionBy(*k))})
    # Score limits of the first and of further anchors.
    primary = (c("score") >= 0.62) & (c("thickness") >= 0.60) & (c("structure") >= 0.34) & ((c("overlap") >= 0.35) | (c("model") >= 0.55))
    second = (c("score") >= 0.60) & (c("score") >= c("_top") - 0.16) & (c("thickness") >= 0.65) & (c("structure") >= 0.35) & ((c("overlap") >= 0.55) | (c("model") >= 0.60))
    n = cut_lineage(n.withColumns({"_ok": F.when(c("rank") == 1, primary).otherwise(second), "_near": F.lit(float("inf")), "anchor_id": F.lit(None).cast("bigint")}).drop("_top"))
    for _ in range(max_groups):
        free = n.where(c("_ok") & (c("_near") >= separation_um) & c("anchor_id").isNull())
        pick = free.groupBy(*k).agg(F.min_by(F.struct("nucleus_id", "rank", "cy_um", "cx_um"), "rank").alias("g"))
        d = F.hypot(c("cy_um") - c("g.cy_um"), c("cx_um") - c("g.cx_um"))
        j = n.join(pick, k, "left")
        me = F.coalesce(c("nucleus_id") == c("g.nucleus_id"), F.lit(False))
        # A later candidate joins the nearest earlier anchor; the first of equals stays.
        closer = F.coalesce((c("rank") > c("g.rank")) & (d < c("_near")), F.lit(False))
        n = cut_lineage(j.withColumns({
            "anchor_id": F.when(me, c("nucleus_id")).when(closer & (d < separation_um), c("g.nucleus_id")).otherwise(c("anchor_id")),
            "_near": F.when(closer, d).otherwise(c("_near"))}).drop("g"))
    hit = n.where(c("anchor_id").isNotNull())
    return hit.groupBy(*k, "anchor_id").agg(F.array_sort(F.collect_list("nucleus_id")).alias("nucleus_ids"), F.max("score").alias("score")).withColumn(
        "position", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("score"), "anchor_id")))


def validated_anchor_groups(groups: DataFrame, min_overlap_px: int) -> DataFrame:
    """Accepted nucleus groups as anchors, ordered by overlap, score and id."""
    w = Window.partitionBy("field_id", "component_id").orderBy(F.desc("overlap_px"), F.desc("score"), "group_id")
    return groups.where(F.col("accepted") & (F.col("overlap_px") >= min_overlap_px)).withColumn("position", F.row_number().over(w))


def marker_for_group(component: DataFrame, extent: DataFrame, pixel_um: tuple[float, float], search_um: float = 0.75, radius_um: float = 0.25) -> DataFrame:
    """Marker disc of every (component, group) at its best inside pixel.

    ``component``: (field_id, component_id, y, x, depth_um, s); ``extent``:
    (field_id, label_id, y, x, height, width) of the groups.
    """
    k = ["field_id", "component_id", "label_id"]
    flat = {"y": pixel_um[0], "x": pixel_um[1]}
    scale = component.groupBy("field_id", "component_id").agg(F.greatest(F.percentile("depth_um", F.lit(0.99)), F.lit(1e-6)).alias("_scale"))
    near = box_distance(extent, flat, {"y": search_um, "x": search_um}, search_um)
    px = component.join(scale, ["field_id", "component_id"]).join(near, ["field_id", "y", "x"])
    score = 0.58 * clip(F.col("depth_um") / F.col("_scale"), 0, 1) + 0.27 * F.col("s") + 0.15 * F.exp(-F.pow(F.col("distance") / search_um, 2.0))
    seed = px.withColumn("_score", score).groupBy(*k).agg(F.max_by(F.struct("y", "x"), F.struct(F.col("_score"), -F.col("y"), -F.col("x"))).alias("s0"))
    ry, rx = (max(1, round(radius_um / p)) for p in pixel_um)
    disc = [(i, j) for i in range(-ry, ry + 1) for j in range(-rx, rx + 1) if (i / ry) ** 2 + (j / rx) ** 2 <= 1.0]
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in disc]))
    m = seed.select(*k, "s0", moves.alias("o")).select(*k, (F.col("s0.y") + F.col("o.dy")).alias("y"), (F.col("s0.x") + F.col("o.dx")).alias("x"))
    return m.join(component.select("field_id", "component_id", "y", "x"), ["field_id", "component_id", "y", "x"], "left_semi")
