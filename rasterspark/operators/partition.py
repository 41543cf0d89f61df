"""Growth, refinement and partition of cells into somas and processes."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterspark.functions.quantile import exact_quantiles
from rasterspark.functions.scalar import clip, first_reason
from rasterspark.functions.tiles import disk_offsets
from rasterspark.operators import focal, graph, zonal
from rasterspark.operators.local import FIELD
from rasterspark.session import cut_lineage

AT = ["field_id", "y", "x"]
PX = [*AT, "height", "width"]
CELL = ["field_id", "cell_id"]
UNIT = {"x": 1.0, "y": 1.0}


def _semi(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*AT), AT, "left_semi")


def _anti(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*AT), AT, "left_anti")


def _union(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*PX)
    for m in masks[1:]:
        out = out.unionByName(m.select(*PX))
    return out.distinct()


def _bright(smap: DataFrame, q: float) -> DataFrame:
    cut = exact_quantiles(smap, FIELD, "s", {"_c": q})
    return smap.join(cut, FIELD).where(F.col("s") >= F.col("_c")).select(*PX)


# ------------------------------------------------------- mask refinement


def log1p_gmm_mask(smap: DataFrame, model: DataFrame, scale: float = 1.0, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Pixels at or above the scaled posterior threshold; fields with a failed model are reported."""
    ok = model.where("qc_pass").select("field_id", "threshold")
    mask = smap.join(ok, "field_id").where(F.col(value) >= F.col("threshold") * scale).select(*PX)
    failed = model.where(~F.col("qc_pass")).select("field_id", F.coalesce("error", F.array_join("reasons", ",")).alias("error"))
    return mask, failed


def anchor_cleanup(mask: DataFrame, anchors: DataFrame, smap: DataFrame, mode: str, bridge: int = 8, low_q: float = 0.83, max_fraction: float = 0.34) -> DataFrame:
    """Reconnect a mask to its anchors; revert where the result covers too much of the field.

    ``anchor_bridge`` closes gaps near anchored parts, ``seed_reconstruct`` grows
    anchors through bright structure, ``hybrid_reconstruct`` does both.
    """
    disk = disk_offsets(bridge)
    parts = []
    if mode in ("anchor_bridge", "hybrid_reconstruct"):
        parts.append(graph.grow(_semi(mask, anchors), focal.morphology(mask, "close", disk)))
    if mode in ("seed_reconstruct", "hybrid_reconstruct"):
        parts.append(graph.grow(_semi(anchors, mask), _union(mask, _bright(smap, low_q))))
    new = cut_lineage(_union(*parts)) if parts else mask
    share = new.groupBy("field_id").agg((F.count(F.lit(1)) / F.max(F.col("height") * F.col("width"))).alias("_f"))
    fine = share.where(F.col("_f") <= max_fraction).select("field_id")
    return new.join(fine, "field_id", "left_semi").select(*PX).unionByName(mask.join(fine, "field_id", "left_anti").select(*PX))


def refine_fused(
    mask: DataFrame, smap: DataFrame, soma: DataFrame, support_q: float = 0.38, half_width: float = 10.0, protect: int = 22,
    background: DataFrame | None = None,
) -> DataFrame:
    """Keep pixels that are supported, thin, or close to a soma; ``background`` as in ``inside_distance``."""
    support = focal.morphology(_bright(smap, support_q), "dilate", disk_offsets(2))
    thin = focal.inside_distance(mask, UNIT, background=background).where(F.coalesce(F.col("distance"), F.lit(float("inf"))) <= half_width)
    near = focal.morphology(soma, "dilate", disk_offsets(protect))
    return _union(_semi(mask, support), thin, _semi(mask, near))


def artifact_filter(mask: DataFrame, soma: DataFrame, min_area: int = 1100, near_radius: int = 36, eccentricity: float = 0.78, major_axis: float = 42.0) -> DataFrame:
    """Drop isolated components that are small, far from somas and not process-like."""
    lab = graph.components(mask, dense=False)
    shape = zonal.region_props(lab)
    near = focal.morphology(soma, "dilate", disk_offsets(near_radius))
    touch = _semi(lab, near).select("field_id", "label_id").distinct().withColumn("_near", F.lit(True))
    keep = shape.join(touch, ["field_id", "label_id"], "left").where(
        (F.col("area") >= min_area) | F.col("_near").isNotNull() | ((F.col("eccentricity") >= eccentricity) & (F.col("major_axis") >= major_axis)))
    return graph.pixels_only(lab.join(keep.select("field_id", "label_id"), ["field_id", "label_id"], "left_semi"))


def refine_with_prior(mask: DataFrame, prior: DataFrame, smap: DataFrame, soma: DataFrame, min_area: int = 180) -> DataFrame:
    """Union of the mask with prior parts touching it, refined and cleaned."""
    grown = graph.grow(mask, _union(mask, prior))
    return graph.remove_small(refine_fused(grown, smap, soma), min_area)


def postprocess_without_prior(mask: DataFrame, soma: DataFrame, min_area: int = 180) -> DataFrame:
    return graph.remove_small(artifact_filter(mask, soma), min_area)


def channel_consensus(evidence: DataFrame, trusted: DataFrame, radius: int = 1) -> DataFrame:
    """Evidence on which channels agree within a radius, plus pieces touching trusted area.

    ``evidence``: (field_id, channel, y, x, height, width).
    """
    wide = focal.morphology(evidence, "dilate", disk_offsets(radius), ["field_id", "channel"])
    n = evidence.groupBy("field_id").agg(F.countDistinct("channel").alias("_n"))
    agree = wide.groupBy(*PX).agg(F.countDistinct("channel").alias("_k")).join(n, "field_id").where(F.col("_k") == F.col("_n"))
    flat = evidence.select(*PX).distinct()
    both = _semi(flat, agree)
    single = _anti(flat, agree)
    near = focal.morphology(_union(trusted, both), "dilate", disk_offsets(radius))
    lab = graph.components(single, dense=False)
    hit = _semi(lab, near).select("field_id", "label_id").distinct()
    return _union(both, graph.pixels_only(lab.join(hit, ["field_id", "label_id"], "left_semi")))


def topology_continuity(base: DataFrame, lines: DataFrame, support: DataFrame, gap: int = 4, min_skeleton: int = 10, hops: int = 3) -> DataFrame:
    """Line components reached through low support within a gap, over a few hops.

    ``lines``: (PX, label_id) candidate line components with their ``skeleton_px``.
    """
    reached = cut_lineage(base.select(*PX))
    good = cut_lineage(lines.where(F.col("skeleton_px") >= min_skeleton))
    for _ in range(hops):
        near = reached
        for _ in range(gap):
            near = cut_lineage(_union(reached, _semi(focal.morphology(near, "dilate", disk_offsets(1)), _union(support, good))))
        touch = _semi(good, focal.morphology(near, "dilate", disk_offsets(1))).select("field_id", "label_id").distinct()
        new = cut_lineage(_anti(good.join(touch, ["field_id", "label_id"], "left_semi").select(*PX), reached))
        if new.isEmpty():
            break
        reached = cut_lineage(_union(reached, new))
    return reached


def recover_branches(base: DataFrame, features: DataFrame, detail_q: float = 0.92, intensity_q: float = 0.68, min_area: int = 16, major_axis: float = 12.0, eccentricity: float = 0.62) -> DataFrame:
    """Add line-like fine branches that grow from the base components without joining two of them.

    ``features``: (field_id, channel, PX, smooth, detail, line).
    """
    k = ["field_id", "channel"]
    cut = exact_quantiles(features, k, "detail", {"_d": detail_q}).join(exact_quantiles(features, k, "smooth", {"_s": intensity_q}), k)
    hit = features.join(cut, k).where((F.col("detail") >= F.col("_d")) & (F.col("smooth") >= F.col("_s"))).select(*k, "y", "x", "height", "width")
    lab = graph.components(hit.select(*PX).distinct(), dense=False)
    line = zonal.region_props(lab).where((F.col("area") >= min_area) & (F.col("major_axis") >= major_axis) & (F.col("eccentricity") >= eccentricity))
    branches = graph.pixels_only(lab.join(line.select("field_id", "label_id"), ["field_id", "label_id"], "left_semi"))
    roots = graph.components(base, dense=False)
    domain = cut_lineage(graph.grow(base, _union(base, branches)))
    owned = cut_lineage(graph.seeded_assign(domain.withColumn("cost", F.lit(0.0)), roots))
    seam = _anti(focal.label_boundary(owned), base)
    return _anti(owned.select(*PX), seam)


# ----------------------------------------------------------- cell partition


def build_soma(nuclei: DataFrame, smap: DataFrame, pixel_um: tuple[float, float], excluded: DataFrame | None = None, base_um: float = 0.80, max_um: float = 1.25, support_q: float = 0.38, closing_um: float = 0.22) -> DataFrame:
    """Soma labels: a mandatory shell around each nucleus and supported pixels a little farther."""
    pitch = {"y": pixel_um[0], "x": pixel_um[1]}
    floor = exact_quantiles(smap.where(F.col("s") > 0), FIELD, "s", {"_f": support_q})
    near = focal.nearest_seed(nuclei, pitch, max_um=max_um).join(smap.select(*AT, "s"), AT).join(floor, FIELD, "left")
    soma = near.where((F.col("distance") <= base_um) | (F.col("s") >= F.coalesce("_f", F.lit(1.0)))).select(*PX, "label_id")
    if excluded is not None:
        soma = _anti(soma, _anti(excluded, nuclei))
    k = ["field_id", "label_id"]
    closed = focal.morphology(soma, "close", disk_offsets(closing_um, *pixel_um), k) if closing_um > 0 else soma
    if excluded is not None:
        closed = _anti(closed, _anti(excluded, nuclei))
    # Overlaps of closed regions go to the lower id; nuclei always keep their own.
    one = closed.groupBy(*PX).agg(F.min("label_id").alias("label_id"))
    return _anti(one, nuclei).select(*PX, "label_id").unionByName(nuclei.select(*PX, "label_id"))


def exclusive_structure(soma: DataFrame, structure: DataFrame, smap: DataFrame, pixel_um: tuple[float, float], competitors: DataFrame | None = None, peak_z: DataFrame | None = None, z_ranges: DataFrame | None = None, depth_um: float = 1.0) -> DataFrame:
    """Assign connected structure to somas by competitive path cost, then re-check depth and connection.

    ``soma``/``competitors``: (PX, label_id) with distinct ids; ``peak_z``: (AT,
    peak_z); ``z_ranges``: (field_id, label_id, z_min, z_max).
    """
    pitch = {"y": pixel_um[0], "x": pixel_um[1]}
    strong = _semi(smap, structure)
    floor = exact_quantiles(strong, FIELD, "s", {"_q": 0.25})
    near = focal.distance_to(structure, pitch, 0.28).select(*AT)
    weak = _semi(smap.join(floor, FIELD).where(F.col("s") >= 0.88 * F.col("_q")), near).select(*PX)
    domain = graph.grow(structure, _union(structure, weak))
    markers = soma.select(*PX, "label_id")
    if competitors is not None:
        markers = markers.unionByName(_anti(competitors, soma).select(*PX, "label_id"))
    markers = cut_lineage(markers)
    cost = _union(domain, markers).join(smap.select(*AT, "s"), AT, "left").withColumn("cost", 1.0 - clip(F.coalesce("s", F.lit(0.0)), 0, 1))
    owned = cut_lineage(graph.seeded_assign(cost, markers).select(*PX, "label_id"))
    if peak_z is not None and z_ranges is not None:
        k = ["field_id", "label_id"]
        # Each owner may claim structure pixels within reach of its own markers.
        from rasterspark.operators.evidence import box_distance

        reach = box_distance(markers, pitch, {"y": 8.0, "x": 8.0}).join(z_ranges, k).join(peak_z.select(*AT, "peak_z"), AT)
        zc = F.greatest(F.col("z_min") - F.col("peak_z"), F.col("peak_z") - F.col("z_max"), F.lit(0)) * depth_um
        claim = cut_lineage(reach.withColumns({"_z": zc, "_t": F.col("distance") + 0.65 * zc}).select(*AT, "label_id", "_z", "_t"))
        best = claim.groupBy(*AT).agg(F.min_by(F.struct("label_id", "_z", "_t"), F.struct("_t", "label_id")).alias("b"))
        mine = owned.join(claim.select(*AT, "label_id", F.col("_z").alias("_mz"), F.col("_t").alias("_mt")), [*AT, "label_id"], "left")
        j = mine.join(best, AT, "left").join(structure.select(*AT, F.lit(True).alias("_in")), AT, "left")
        move = F.col("_in").isNotNull() & (F.col("b.label_id") != F.col("label_id")) & (F.col("b._z") + 1e-6 < F.col("_mz")) & (F.col("b._t") + 0.35 < F.col("_mt"))
        owned = j.select(*PX, F.when(F.coalesce(move, F.lit(False)), F.col("b.label_id")).otherwise(F.col("label_id")).alias("label_id"))
    comp = graph.components(owned.withColumnRenamed("label_id", "cell_id"), CELL, dense=False)
    seeds = comp.join(markers.select(*AT, F.col("label_id").alias("cell_id")), [*AT, "cell_id"], "left_semi").select(*CELL, "label_id").distinct()
    kept = comp.join(seeds, [*CELL, "label_id"], "left_semi")
    ids = soma.select("field_id", F.col("label_id").alias("cell_id")).distinct()
    whole = _anti(kept.join(ids, CELL, "left_semi"), soma).select(*PX, "cell_id")
    return whole.unionByName(soma.select(*PX, F.col("label_id").alias("cell_id")))


def split_touching(components: DataFrame, anchors: DataFrame, smap: DataFrame, depth: DataFrame, pixel_area_um2: float, min_child_um2: float = 12.0, min_fraction: float = 0.12, max_neck: float = 0.72, max_boundary: float = 0.72, max_markers: int = 2) -> tuple[DataFrame, DataFrame]:
    """Split components that hold several anchors where the seam is narrow and dark.

    ``components``: (PX, component_id); ``anchors``: (AT, component_id,
    label_id) marker pixels; ``depth``: (AT, distance). Returns (labels,
    decisions); the pixel union never changes.
    """
    k = ["field_id", "component_id"]
    n = anchors.groupBy(*k).agg(F.countDistinct("label_id").alias("markers"))
    todo = n.where(F.col("markers").between(2, max_markers)).select(*k)
    dom = components.join(todo, k, "left_semi").join(smap.select(*AT, "s"), AT, "left").join(depth.select(*AT, "distance"), AT, "left")
    dom = cut_lineage(dom.withColumns({"s": F.coalesce("s", F.lit(0.0)), "distance": F.coalesce("distance", F.lit(0.0))}))
    top = dom.groupBy(*k).agg(F.greatest(F.max("distance"), F.lit(1e-6)).alias("_m"))
    cost = dom.join(top, k).withColumn("cost", 1.0 - 0.72 * F.col("distance") / F.col("_m") - 0.28 * F.col("s"))
    part = cut_lineage(graph.seeded_assign(cost.select(*k, "y", "x", "height", "width", "cost"), anchors.join(todo, k, "left_semi"), k))
    child = part.groupBy(*k, "label_id").agg(F.count(F.lit(1)).alias("px"))
    size = child.groupBy(*k).agg(F.sum("px").alias("_all"), F.min("px").alias("_min"), F.count(F.lit(1)).alias("children"))
    lab = graph.components(part.withColumnRenamed("label_id", "child"), [*k, "child"], dense=False)
    solid = lab.groupBy(*k, "child").agg(F.countDistinct("label_id").alias("_c")).groupBy(*k).agg(F.max("_c").alias("_pieces"))
    seam = focal.label_boundary(part, k).join(dom.select(*k, "y", "x", "s", "distance"), [*k, "y", "x"])
    seam = seam.groupBy(*k).agg(F.max("distance").alias("_neck"), F.avg("s").alias("_bs"))
    core = part.join(dom.select(*k, "y", "x", "s", "distance"), [*k, "y", "x"]).groupBy(*k, "label_id").agg(F.max("distance").alias("_d"), F.avg("s").alias("_s"))
    core = core.groupBy(*k).agg(F.min("_d").alias("_core"), F.avg("_s").alias("_cs"))
    j = n.join(size, k, "left").join(solid, k, "left").join(seam, k, "left").join(core, k, "left")
    small = (F.col("_min") * pixel_area_um2 < min_child_um2) | (F.col("_min") < min_fraction * F.col("_all"))
    why = first_reason(
        ("single_anchor", F.col("markers") < 2), ("too_many_anchors", F.col("markers") > max_markers), ("marker_lost", F.coalesce(F.col("children"), F.lit(0)) < F.col("markers")),
        ("child_too_small", small), ("child_disconnected", F.col("_pieces") > 1), ("neck_too_wide", F.col("_neck") > max_neck * F.col("_core")),
        ("boundary_too_bright", F.col("_bs") > max_boundary * F.col("_cs")))
    d = cut_lineage(j.withColumn("refusal", why).select(*k, "markers", "refusal"))
    ok = d.where(F.col("refusal").isNull()).select(*k)
    split = part.join(ok, k, "left_semi").select(*k, "y", "x", "height", "width", "label_id")
    rest = components.join(ok, k, "left_anti").withColumn("label_id", F.lit(0).cast("bigint"))
    return split.unionByName(rest.select(*k, "y", "x", "height", "width", "label_id")), d


def restore_gaps(components: DataFrame, smap: DataFrame, nuclei: DataFrame, pixel_um: tuple[float, float], min_depth_um: float = 0.27, protect_um: float = 2.10, min_area_um2: float = 0.14, major_axis_um: float = 0.90, eccentricity: float = 0.62) -> DataFrame:
    """Remove dark internal valleys that do not cut their component, largest first.

    Valleys of one component are tried one per round, all components in parallel,
    until none is left; a removal that would disconnect its component is undone.
    """
    pitch = {"y": pixel_um[0], "x": pixel_um[1]}
    k = ["field_id", "component_id"]
    dark = components.join(smap.select(*AT, "s"), AT)
    cut = exact_quantiles(dark, k, "s", {"_p": 0.25})
    deep = zonal.thickness(components, pitch, label="component_id").where(F.col("thickness") >= min_depth_um).select(*AT)
    near = focal.distance_to(nuclei, pitch, protect_um).select(*AT)
    low = _anti(_semi(dark.join(cut, k).where(F.col("s") < F.col("_p")), deep), near)
    lab = graph.components(low.select(*k, "y", "x", "height", "width"), k, dense=False)
    pitch_mean = (pixel_um[0] * pixel_um[1]) ** 0.5
    shape = zonal.region_props(lab, k).where(
        (F.col("area") * pixel_um[0] * pixel_um[1] >= min_area_um2) & (F.col("major_axis") * pitch_mean >= major_axis_um) & (F.col("eccentricity") >= eccentricity))
    order = Window.partitionBy(*k).orderBy(F.desc("area"), "label_id")
    ranked = cut_lineage(shape.select(*k, "label_id", "area").withColumn("_r", F.row_number().over(order)))
    lab = cut_lineage(lab)
    current = cut_lineage(components.select(*k, "y", "x", "height", "width"))
    pieces = lambda px, name: graph.components(px, k, dense=False).groupBy(*k).agg(F.countDistinct("label_id").alias(name))
    whole = cut_lineage(pieces(current, "_w"))
    for r in itertools.count(1):
        hole = cut_lineage(lab.join(ranked.where(F.col("_r") == r).select(*k, "label_id"), [*k, "label_id"], "left_semi").select(*k, "y", "x"))
        if hole.isEmpty():
            break
        # Only components with a valley of this round are tried; the others keep their number of pieces.
        trial = current.join(hole.select(*k).distinct(), k, "left_semi").join(hole, [*k, "y", "x"], "left_anti")
        fine = cut_lineage(pieces(trial, "_n").join(whole, k).where(F.col("_n") <= F.col("_w")).select(*k, "_n"))
        current = cut_lineage(current.join(hole.join(fine, k, "left_semi"), [*k, "y", "x"], "left_anti"))
        whole = cut_lineage(whole.join(fine, k, "left").select(*k, F.coalesce("_n", "_w").alias("_w")))
    return current


def soma_partition(cells: DataFrame, anchors: DataFrame, smap: DataFrame, pixel_um: tuple[float, float], zone_um: tuple[float, float] = (2.1, 5.2), min_area_um2: float = 4.5, max_fraction: float = 0.72, min_process: float = 0.08, fallback_um: float = 1.55) -> tuple[DataFrame, DataFrame]:
    """Soma and processes of every cell from its anchor zone, thickness and structure.

    ``cells``: (PX, cell_id); ``anchors``: (AT, cell_id) nucleus pixels. Returns
    (regions with ``part``, per-cell decisions).
    """
    pitch = {"y": pixel_um[0], "x": pixel_um[1]}
    area, unit = pixel_um[0] * pixel_um[1], (pixel_um[0] * pixel_um[1]) ** 0.5
    th = cut_lineage(zonal.thickness(cells, pitch, label="cell_id").join(smap.select(*AT, "s"), AT, "left").withColumn("s", F.coalesce("s", F.lit(0.0))))
    seeds = anchors.select(*AT, "cell_id").join(cells.select(*AT, "cell_id"), [*AT, "cell_id"], "left_semi")
    px = cut_lineage(zonal.label_distance(seeds, th, pitch, label="cell_id", out="dn"))
    link = 0.75
    near = F.coalesce(F.col("dn"), F.lit(float("inf")))
    scale = px.groupBy(*CELL).agg(F.greatest(F.percentile("thickness", F.lit(0.99)), F.lit(1e-6)).alias("_p99"), F.count(F.lit(1)).alias("_n"))
    core = px.where(near <= link).groupBy(*CELL).agg(F.greatest(F.percentile("thickness", F.lit(0.90)), F.lit(0.55)).alias("core_um"))
    j = px.join(scale, CELL).join(core, CELL, "left")
    thin = F.greatest(F.lit(1.5 * unit), 0.42 * F.col("core_um"))
    rich = j.groupBy(*CELL).agg(clip((F.avg((F.col("thickness") <= thin).cast("double")) - 0.20) / 0.55, 0, 1).alias("richness"))
    j = j.join(rich, CELL)
    mix = lambda compact, branched: F.lit(compact) + (F.lit(branched) - F.lit(compact)) * F.col("richness")
    radius = F.greatest(F.lit(zone_um[0]), F.least(F.lit(zone_um[1]), F.col("core_um") * mix(2.85, 2.15)))
    q = px.groupBy(*CELL).agg(F.percentile("s", F.lit(0.46)).alias("_s46"), F.percentile("s", F.lit(0.58)).alias("_s58"))
    j = j.join(q, CELL)
    bright = F.col("s") >= F.col("_s46") + (F.col("_s58") - F.col("_s46")) * F.col("richness")
    thick = F.col("thickness") >= F.greatest(F.lit(0.32), F.col("core_um") * mix(0.24, 0.34))
    zone = (near <= radius) & (thick | (bright & (F.col("thickness") >= F.greatest(F.lit(1.5 * unit), 0.14 * F.col("core_um")))))
    dom = cut_lineage(j.where(zone | (near <= 0.0)).select(*PX, "cell_id"))
    lab = graph.components(dom, CELL, dense=False)
    hit = lab.join(seeds, [*AT, "cell_id"], "left_semi").select(*CELL, "label_id").distinct()
    grown = graph.pixels_only(lab.join(hit, [*CELL, "label_id"], "left_semi"), CELL)
    closed = cut_lineage(focal.morphology(grown, "close", disk_offsets(2), CELL).join(cells.select(*AT, "cell_id"), [*AT, "cell_id"], "left_semi"))
    size = closed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_k"))
    j2 = scale.join(size, CELL, "left").join(core, CELL, "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    poor = (F.col("_k") * area < min_area_um2) | (F.col("_k") > max_fraction * F.col("_n"))
    d = cut_lineage(j2.withColumn("mode", F.when(F.col("core_um").isNull(), "no_anchor").when(poor, "fallback_disc").otherwise("zone")))
    disc = px.join(d.where(F.col("mode") == "fallback_disc").select(*CELL), CELL, "left_semi").where(near <= fallback_um).select(*PX, "cell_id")
    soma = cut_lineage(closed.join(d.where(F.col("mode") == "zone").select(*CELL), CELL, "left_semi").select(*PX, "cell_id").unionByName(disc).unionByName(
        seeds.join(cells, [*AT, "cell_id"]).select(*PX, "cell_id")).distinct())
    left = scale.join(soma.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_k2")), CELL, "left")
    full = left.where(F.coalesce("_k2", F.lit(0)) > (1.0 - min_process) * F.col("_n")).select(*CELL)
    # A cell without enough processes keeps only its nucleus pixels as soma.
    trimmed = soma.join(full, CELL, "left_anti").unionByName(seeds.join(full, CELL, "left_semi").join(cells, [*AT, "cell_id"]).select(*PX, "cell_id"))
    soma_px = trimmed.select(*AT, "cell_id", F.lit("soma").alias("part"))
    regions = cells.select(*PX, "cell_id").join(soma_px, [*AT, "cell_id"], "left").withColumn("part", F.coalesce("part", F.lit("processes")))
    return regions, d.select(*CELL, "mode", "core_um")


# ------------------------------------------------------------ soma completion


def complete_soma_in_whole(regions: DataFrame, extents: DataFrame, min_coverage: float = 0.70, max_added: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Add the rest of an owner's nuclear extent to the soma when it lies inside the cell.

    ``extents``: (AT, cell_id), the owner extent of each cell.
    """
    j = extents.select(*AT, "cell_id").join(regions.select(*AT, "cell_id", "part"), [*AT, "cell_id"], "left")
    e = j.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_e"), F.count("part").alias("_in"), F.count_if(F.col("part") == "soma").alias("_s"))
    soma = regions.where(F.col("part") == "soma").groupBy(*CELL).agg(F.count(F.lit(1)).alias("_soma"))
    proc = regions.where(F.col("part") == "processes").groupBy(*CELL).agg(F.count(F.lit(1)).alias("_proc"))
    add = F.col("_in") - F.col("_s")
    why = first_reason(
        ("no_soma", F.col("_soma").isNull()), ("extent_outside_whole", F.col("_in") < F.col("_e")), ("low_extent_coverage", F.col("_s") < min_coverage * F.col("_e")),
        ("already_complete", add == 0), ("too_many_added", add > max_added * F.col("_soma")), ("empty_processes", add >= F.coalesce("_proc", F.lit(0))), default="completed")
    d = e.join(soma, CELL, "left").join(proc, CELL, "left").withColumns({"status": why, "added_px": F.when(why == "completed", add).otherwise(0)})
    new = j.where(F.col("part") == "processes").join(d.where(F.col("status") == "completed").select(*CELL), CELL, "left_semi").select(*AT, "cell_id", F.lit(1).alias("_a"))
    out = regions.join(new, [*AT, "cell_id"], "left").withColumn("part", F.when(F.col("_a") == 1, "soma").otherwise(F.col("part"))).drop("_a")
    return out, d.select(*CELL, "status", "added_px")


def complete_soma_to_owner(regions: DataFrame, extents: DataFrame, cores: DataFrame, foreign: DataFrame, removed: DataFrame, pixel_um: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """Approve the whole owner extent of a cell at once, also outside the cell, or refuse it.

    ``extents``/``cores``: (PX, cell_id); ``foreign``: (PX, label_id) nuclei of
    others; ``removed``: pixels taken away by an earlier guard. Plans that
    overlap each other are refused together.
    """
    pitch, area = {"y": pixel_um[0], "x": pixel_um[1]}, pixel_um[0] * pixel_um[1]
    lab = graph.components(extents, CELL, dense=False)
    soma = regions.where(F.col("part") == "soma").select(*AT, "cell_id")
    in_core = lab.join(cores.select(*AT, "cell_id"), [*AT, "cell_id"], "left_semi").select(*CELL, "label_id").distinct()
    in_soma = lab.join(soma, [*AT, "cell_id"], "left_semi").select(*CELL, "label_id").distinct()
    anchored = in_core.join(in_soma, [*CELL, "label_id"], "left_semi")
    n = anchored.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_anchors"), F.min("label_id").alias("label_id"))
    plan = cut_lineage(lab.join(n.where(F.col("_anchors") == 1).select(*CELL, "label_id"), [*CELL, "label_id"], "left_semi").select(*PX, "cell_id"))
    fsoma = foreign.select(*AT).distinct().join(soma, AT).groupBy(*CELL).agg((F.count(F.lit(1)) * area).alias("_fs"))
    near = focal.distance_to(foreign, pitch, 1.10).select(*AT, F.lit(1).alias("_n"))
    contact = _anti(plan, regions).join(near, AT).select(*CELL).distinct().withColumn("_near", F.lit(True))
    other = plan.join(regions.select(*AT, F.col("cell_id").alias("_o")), AT).where(F.col("_o") != F.col("cell_id")).select(*CELL).distinct().withColumn("_other", F.lit(True))
    edge = plan.where((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == F.col("width") - 1)).select(*CELL).distinct().withColumn("_edge", F.lit(True))
    gone = plan.join(removed.select(*AT), AT, "left_semi").select(*CELL).distinct().withColumn("_gone", F.lit(True))
    clash = plan.groupBy(*AT).agg(F.countDistinct("cell_id").alias("_c")).where(F.col("_c") > 1).select(*AT)
    both = plan.join(clash, AT, "left_semi").select(*CELL).distinct().withColumn("_clash", F.lit(True))
    j = regions.select(*CELL).distinct().join(n.drop("label_id"), CELL, "left")
    for t in (fsoma, contact, other, edge, gone, both):
        j = j.join(t, CELL, "left")
    yes = lambda c: F.col(c).isNotNull()
    why = first_reason(
        ("missing_anchor", F.col("_anchors").isNull()), ("multiple_anchors", F.col("_anchors") > 1), ("foreign_nucleus_in_soma", F.coalesce("_fs", F.lit(0.0)) >= 0.55),
        ("foreign_nucleus_contact", yes("_near")), ("competing_cell", yes("_other")), ("touches_border", yes("_edge")), ("removed_by_earlier_guard", yes("_gone")), ("overlapping_plans", yes("_clash")), default="completed")
    d = j.withColumn("status", why).select(*CELL, "status")
    ok = plan.join(d.where(F.col("status") == "completed").select(*CELL), CELL, "left_semi").withColumn("part", F.lit("soma"))
    return regions.select(*PX, "cell_id", "part").join(ok.select(*AT, "cell_id"), [*AT, "cell_id"], "left_anti").unionByName(ok.select(*PX, "cell_id", "part")), d


def _own_paths(main: DataFrame, free: DataFrame, targets: DataFrame, pixel_um: tuple[float, float], limit_um: float) -> DataFrame:
    """Shortest way from each cell's main soma to the pixels of its islands, over free process pixels only.

    ``main`` and ``free``: (CELL, y, x); ``targets``: (CELL, y, x, label_id). Returns the best
    island pixel of every (CELL, label_id) with ``d`` (physical, between pixel centres) and ``path``
    (the process pixels between, in order). No way within the limit has more steps than the limit has
    pixels, so a fixed small number of relaxations finds all, and the ways are short enough to ride
    along in the row. Ties go to the way whose pixels come first.
    """
    dy, dx = pixel_um
    moves = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx"), F.lit(float((i * i * dy * dy + j * j * dx * dx) ** 0.5)).alias("w"))
                      for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    at = [*CELL, "y", "x"]

    def stepped(front: DataFrame) -> DataFrame:
        s = front.select(*CELL, "y", "x", "d", "path", F.explode(moves).alias("_m"))
        return s.select(*CELL, (F.col("y") + F.col("_m.dy")).alias("y"), (F.col("x") + F.col("_m.dx")).alias("x"), (F.col("d") + F.col("_m.w")).alias("d"), "path").where(F.col("d") <= limit_um + 1e-9)

    none = F.expr("CAST(array() AS array<struct<y:int,x:int>>)")
    front = main.select(*CELL, "y", "x", F.lit(0.0).alias("d"), none.alias("path"))
    best = F.min(F.struct("d", "path")).alias("_b")
    found = None
    for _ in range(int(limit_um / min(pixel_um) + 1e-9)):
        new = cut_lineage(stepped(front).groupBy(*at).agg(best).select(*at, "_b.*"))
        hit = new.join(targets, at).groupBy(*CELL, "label_id").agg(best)
        found = hit if found is None else found.unionByName(hit)
        here = F.array(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")))
        front = new.join(free, at, "left_semi").withColumn("path", F.concat("path", here))
    if found is None:
        return targets.select(*CELL, "label_id").where("false").withColumns({"d": F.lit(0.0), "path": none})
    return found.groupBy(*CELL, "label_id").agg(F.min("_b").alias("_b")).select(*CELL, "label_id", "_b.*")


def rejoin_soma_islands(
    regions: DataFrame, foreign: DataFrame | None, pixel_um: tuple[float, float], max_gap_um: float = 0.38, min_process: float = 0.08, max_added: float = 0.15, clearance_um: float = 0.18
) -> tuple[DataFrame, DataFrame]:
    """Join detached soma islands to the main soma along the cell's own processes, nearest first.

    The largest part of a soma is its main part. Island by island, the nearest one is joined over
    the shortest way through process pixels that keep clear of foreign nuclei; the way becomes
    soma, and from then on the island belongs to the main part, so islands behind it can be
    reached from there. Returns regions and a decision for every island: (CELL, island_id,
    status, gap_um, added_px), where gap_um leaves one pixel of the way between centres out.
    Refusals are an island's own: ``no_path_within_gap``, ``process_fraction_too_low`` (of the
    cell, after joining) and ``too_many_added`` (for the cell, over its soma before). Every round
    treats one island of each cell, all cells together.
    """
    at = [*CELL, "y", "x"]
    key = [*CELL, "label_id"]
    step = max(pixel_um)
    soma = cut_lineage(regions.where(F.col("part") == "soma").select(*PX, "cell_id"))
    lab = cut_lineage(graph.components(soma, CELL, dense=False).select(*at, "label_id"))
    size = lab.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rank = size.withColumn("_r", F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("_n"), "label_id")))
    todo = cut_lineage(rank.where("_r > 1").select(*key))
    cells = todo.select(*CELL).distinct()
    main = lab.join(rank.where("_r = 1").select(*key), key, "left_semi").join(cells, CELL, "left_semi").select(*at)
    process = regions.where(F.col("part") == "processes").select(*PX, "cell_id").join(cells, CELL, "left_semi")
    free = cut_lineage((_anti(process, focal.distance_to(foreign, {"y": pixel_um[0], "x": pixel_um[1]}, clearance_um)) if foreign is not None else process).select(*at))
    part = F.col("part")
    count = cut_lineage(regions.join(cells, CELL, "left_semi").groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("_w"), F.count_if(part == "processes").alias("_p"), F.count_if(part == "soma").alias("_s"), F.lit(0).cast("long").alias("_added")))
    decided, bridges = None, None
    main = cut_lineage(main)
    while not todo.isEmpty():
        ways = _own_paths(main, free, lab.join(todo, key, "left_semi"), pixel_um, max_gap_um + step)
        near = ways.withColumn("_r", F.row_number().over(Window.partitionBy(*CELL).orderBy("d", "label_id"))).where("_r = 1").drop("_r")
        near = near.join(count, CELL).withColumn("_k", F.size("path").cast("long"))
        why = first_reason(
            ("process_fraction_too_low", (F.col("_p") - F.col("_added") - F.col("_k")) / F.col("_w") < min_process),
            ("too_many_added", F.col("_added") + F.col("_k") > max_added * F.col("_s")), default="joined")
        near = cut_lineage(near.withColumn("status", why))
        # A cell without any way to an island is done: its main part won't grow any more.
        lost = todo.join(near.select(*CELL), CELL, "left_anti")
        new = near.select(*key, "status", F.greatest(F.lit(0.0), F.col("d") - step).alias("gap_um"), F.when(F.col("status") == "joined", F.col("_k")).otherwise(0).cast("long").alias("added_px"))
        new = new.unionByName(lost.select(*key, F.lit("no_path_within_gap").alias("status"), F.lit(None).cast("double").alias("gap_um"), F.lit(0).cast("long").alias("added_px")))
        new = cut_lineage(new)
        decided = new if decided is None else decided.unionByName(new)
        joined = near.where("status = 'joined'")
        bridge = cut_lineage(joined.select(*CELL, F.explode("path").alias("_q")).select(*CELL, "_q.y", "_q.x"))
        bridges = bridge if bridges is None else bridges.unionByName(bridge)
        main = cut_lineage(main.unionByName(bridge).unionByName(lab.join(joined.select(*key), key, "left_semi").select(*at)))
        free = cut_lineage(free.join(bridge, at, "left_anti"))
        count = cut_lineage(count.join(joined.select(*CELL, "_k"), CELL, "left").withColumn("_added", F.col("_added") + F.coalesce("_k", F.lit(0))).drop("_k"))
        todo = cut_lineage(todo.join(new.select(*key), key, "left_anti"))
    if decided is None:
        return regions, todo.select(*CELL, F.col("label_id").alias("island_id"), F.lit("joined").alias("status"), F.lit(0.0).alias("gap_um"), F.lit(0).cast("long").alias("added_px"))
    changed = bridges.withColumn("_a", F.lit(True))
    out = regions.join(changed, at, "left").withColumn("part", F.when(F.col("_a"), F.lit("soma")).otherwise(part)).drop("_a")
    return out, decided.withColumnRenamed("label_id", "island_id")


def prune_foreign_tips(regions: DataFrame, foreign: DataFrame, skeleton: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove process tips that lie inside a foreign nucleus.

    A piece goes when it holds a true tip and no branch point of the cell's
    skeleton; the removal is rolled back where it would disconnect the cell.
    ``skeleton``: (PX, cell_id).
    """
    inside = regions.where(F.col("part") == "processes").select(*PX, "cell_id").join(foreign.select(*AT).distinct(), AT, "left_semi")
    lab = cut_lineage(graph.components(inside, CELL, dense=False))
    n = focal.neighbour_count(skeleton, CELL)
    s = lab.join(n.select(*CELL, "y", "x", "neighbours"), [*CELL, "y", "x"]).groupBy(*CELL, "label_id").agg(F.count_if(F.col("neighbours") == 1).alias("tips"), F.count_if(F.col("neighbours") >= 3).alias("branches"))
    go = s.where((F.col("tips") >= 1) & (F.col("branches") == 0)).select(*CELL, "label_id")
    cut = cut_lineage(lab.join(go, [*CELL, "label_id"], "left_semi").select(*CELL, "y", "x"))
    touched = regions.join(cut.select(*CELL).distinct(), CELL, "left_semi").select(*CELL, "y", "x", "height", "width")
    pieces = lambda df, name: graph.components(df, CELL, dense=False).groupBy(*CELL).agg(F.countDistinct("label_id").alias(name))
    d = pieces(touched, "_b").join(pieces(touched.join(cut, [*CELL, "y", "x"], "left_anti"), "_a"), CELL, "left").withColumn(
        "status", F.when(F.coalesce("_a", F.lit(0)) == F.col("_b"), "pruned").otherwise("rolled_back")).select(*CELL, "status")
    ok = cut.join(d.where(F.col("status") == "pruned").select(*CELL), CELL, "left_semi")
    return regions.join(ok, [*CELL, "y", "x"], "left_anti"), d


# ------------------------------------------------------------ requested edits


def edit_enlarge(regions: DataFrame, requests: DataFrame, nuclei: DataFrame, foreign: DataFrame, smap: DataFrame, pixel_um: tuple[float, float], shell_um: float = 0.75, max_um: float = 1.25, clearance_um: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Enlarge requested somas into their nuclear shell and supported surroundings, or refuse.

    ``requests``: (field_id, cell_id); ``nuclei``: (PX, cell_id) owner nuclei;
    ``foreign``: (PX, label_id). Other cells and foreign nuclei keep a clearance.
    """
    pitch, area = {"y": pixel_um[0], "x": pixel_um[1]}, pixel_um[0] * pixel_um[1]
    mine = cut_lineage(nuclei.join(requests.select(*CELL), CELL, "left_semi").withColumnRenamed("cell_id", "label_id"))
    near = focal.nearest_seed(mine, pitch, max_um=max_um).withColumnRenamed("label_id", "cell_id")
    blocked = focal.distance_to(foreign, pitch, 0.45).select(*AT)
    others = regions.select(*PX, F.col("cell_id").alias("label_id"))
    # Pixels of other cells and those within the clearance around them.
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in disk_offsets(clearance_um, *pixel_um)]))
    halo = others.select("field_id", "y", "x", F.col("label_id").alias("_o"), moves.alias("_m")).select(
        "field_id", (F.col("y") + F.col("_m.dy")).alias("y"), (F.col("x") + F.col("_m.dx")).alias("x"), "_o").distinct()
    cut = exact_quantiles(smap, FIELD, "s", {"_c": 0.45})
    dom = _anti(near, blocked).join(smap.select(*AT, "s"), AT, "left").join(cut, FIELD, "left")
    dom = dom.where((F.col("distance") <= shell_um) | (F.coalesce("s", F.lit(0.0)) >= F.col("_c")))
    close = dom.select(*AT, "cell_id").join(halo, AT).where(F.col("_o") != F.col("cell_id")).select(*AT, "cell_id").distinct()
    dom = dom.join(close, [*AT, "cell_id"], "left_anti").select(*PX, "cell_id")
    soma = regions.where(F.col("part") == "soma").select(*PX, "cell_id").join(requests.select(*CELL), CELL, "left_semi")
    closed = focal.morphology(dom.unionByName(soma).distinct(), "close", disk_offsets(0.30, *pixel_um), CELL)
    allowed = closed.join(dom.select(*AT, "cell_id").unionByName(regions.select(*AT, "cell_id")).distinct(), [*AT, "cell_id"], "left_semi")
    lab = graph.components(allowed, CELL, dense=False)
    hit = lab.join(soma.select(*AT, "cell_id"), [*AT, "cell_id"], "left_semi").select(*CELL, "label_id").distinct()
    new = cut_lineage(graph.pixels_only(lab.join(hit, [*CELL, "label_id"], "left_semi"), CELL).unionByName(soma.select(*CELL, "y", "x", "height", "width")).distinct())
    old = soma.groupBy(*CELL).agg((F.count(F.lit(1)) * area).alias("_old"))
    now = new.groupBy(*CELL).agg((F.count(F.lit(1)) * area).alias("_new"), F.max((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == F.col("width") - 1)).alias("_edge"))
    rest = regions.where(F.col("part") == "processes").select(*CELL, "y", "x").join(new.select(*CELL, "y", "x"), [*CELL, "y", "x"], "left_anti").groupBy(*CELL).agg(F.count(F.lit(1)).alias("_left"))
    own = mine.select("field_id", F.col("label_id").alias("cell_id")).distinct().withColumn("_nuc", F.lit(True))
    j = requests.select(*CELL).distinct().join(old, CELL, "left").join(now, CELL, "left").join(rest, CELL, "left").join(own, CELL, "left")
    grown = F.col("_new") - F.col("_old")
    why = first_reason(
        ("cell_without_soma", F.col("_old").isNull()), ("owner_nucleus_missing", F.col("_nuc").isNull()), ("no_growth", grown <= 0), ("added_fraction_above_maximum", grown > 4.0 * F.col("_old")),
        ("added_area_above_maximum", grown > 350.0), ("final_area_above_maximum", F.col("_new") > 650.0), ("touches_border", F.col("_edge")), ("empty_processes", F.col("_left").isNull()), default="applied")
    d = j.withColumn("status", why).select(*CELL, "status", F.coalesce("_new", F.lit(0.0)).alias("soma_um2"))
    ok = new.join(d.where(F.col("status") == "applied").select(*CELL), CELL, "left_semi").withColumn("part", F.lit("soma"))
    keep = regions.select(*PX, "cell_id", "part").join(ok.select(*CELL, "y", "x"), [*CELL, "y", "x"], "left_anti")
    return keep.unionByName(ok.select(*PX, "cell_id", "part")), d


def edit_split(regions: DataFrame, requests: DataFrame, seeds: DataFrame, smap: DataFrame, pixel_um: tuple[float, float], min_area_um2: float = 6.0, min_fraction: float = 0.06) -> tuple[DataFrame, DataFrame]:
    """Split requested cells between two exclusive nuclei, or refuse with a reason.

    ``seeds``: (AT, cell_id, label_id), pixels of the owner (1) and second
    nucleus (2) of each request. Every edit is its own group of tiles, so many
    edits run in parallel.
    """
    area = pixel_um[0] * pixel_um[1]
    req = requests.select(*CELL).distinct()
    cells = cut_lineage(regions.join(req, CELL, "left_semi"))
    # The planner doesn't count exploded rows and would broadcast pixels; here and in child_gates they are shuffled.
    inside = cut_lineage(seeds.join(cells.select(*AT, "cell_id").hint("merge"), [*AT, "cell_id"], "left_semi"))
    n = inside.groupBy(*CELL).agg(F.countDistinct("label_id").alias("_seeds"))
    cost = cells.join(smap.select(*AT, "s").hint("merge"), AT, "left").withColumn("cost", 1.0 - clip(F.coalesce("s", F.lit(0.0)), 0, 1))
    part = cut_lineage(graph.seeded_assign(cost.select(*CELL, "y", "x", "height", "width", "cost"), inside, CELL))
    # Pixels no path reaches go to the nearest seed inside the cell.
    child = cut_lineage(child_gates(cells, part, inside, pixel_um))
    size = child.groupBy(*CELL, "label_id").agg(F.count(F.lit(1)).alias("_k"), F.count_if(F.col("part") == "processes").alias("_p"))
    g = size.groupBy(*CELL).agg(F.min("_k").alias("_min"), F.sum("_k").alias("_all"), F.min("_p").alias("_proc"), F.count(F.lit(1)).alias("_c"))
    j = req.join(n, CELL, "left").join(g, CELL, "left")
    why = first_reason(
        ("second_nucleus_missing", F.coalesce(F.col("_seeds"), F.lit(0)) < 2), ("child_missing", F.coalesce(F.col("_c"), F.lit(0)) < 2), ("child_area_below_minimum", F.col("_min") * area < min_area_um2),
        ("child_fraction_below_minimum", F.col("_min") < min_fraction * F.col("_all")), ("child_without_processes", F.col("_proc") == 0), default="applied")
    d = cut_lineage(j.withColumn("status", why).select(*CELL, "status"))
    ok = d.where(F.col("status") == "applied").select(*CELL)
    top = regions.groupBy("field_id").agg(F.max("cell_id").alias("_top"))
    order = ok.withColumn("_i", F.row_number().over(Window.partitionBy("field_id").orderBy("cell_id"))).join(top, "field_id")
    out = child.join(order.hint("merge"), CELL).withColumn("cell_id", F.when(F.col("label_id") == 1, F.col("cell_id")).otherwise(F.col("_top") + F.col("_i")))
    return regions.select(*PX, "cell_id", "part").join(ok, CELL, "left_anti").unionByName(out.select(*PX, "cell_id", "part")), d


def child_gates(cells: DataFrame, part: DataFrame, seeds: DataFrame, pixel_um: tuple[float, float], growth_um: float = 0.65) -> DataFrame:
    """Complete children of a split: unreached pixels to the nearest seed, soma from the nuclear zone.

    A child's soma is its share of the old soma plus its own pixels within
    ``growth_um`` of its nucleus that are connected to it.
    """
    pitch = {"y": pixel_um[0], "x": pixel_um[1]}
    k = [*CELL, "y", "x"]
    dims = cells.select(*k, "height", "width", "part")
    near = focal.nearest_seed(seeds.join(dims.select(*k, "height", "width").hint("merge"), k), pitch, CELL).select(*k, F.col("label_id").alias("_n"))
    j = dims.join(part.select(*k, "label_id").hint("merge"), k, "left").join(near.hint("merge"), k, "left").withColumn("label_id", F.coalesce("label_id", "_n")).drop("_n")
    j = cut_lineage(j.where(F.col("label_id").isNotNull()))
    zone = zonal.label_distance(seeds.select(*CELL, "label_id", "y", "x"), j, pitch, CELL, "label_id", "_d")
    want = zone.where((F.col("part") == "soma") | (F.col("_d") <= growth_um))
    lab = graph.components(want.withColumnRenamed("label_id", "child").select(*CELL, "child", "y", "x", "height", "width"), [*CELL, "child"], dense=False)
    hit = lab.join(seeds.select(*CELL, F.col("label_id").alias("child"), "y", "x").hint("merge"), [*CELL, "child", "y", "x"], "left_semi").select(*CELL, "child", "label_id").distinct()
    soma = lab.join(hit.hint("merge"), [*CELL, "child", "label_id"], "left_semi").select(*CELL, F.col("child").alias("label_id"), "y", "x", F.lit(1).alias("_s"))
    return j.drop("part").join(soma.hint("merge"), [*CELL, "label_id", "y", "x"], "left").withColumn("part", F.when(F.col("_s") == 1, "soma").otherwise("processes")).drop("_s")
