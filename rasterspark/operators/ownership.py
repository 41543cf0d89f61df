"""Partition of components between the nuclei that claim them, with rollback by component (F11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.functions.scalar import clip, first_reason
from rasterspark.operators import focal, graph, match
from rasterspark.operators.evidence import marker_for_group
from rasterspark.operators.zonal import label_distance, thickness
from rasterspark.params import OwnershipParams
from rasterspark.session import cut_lineage

PART = ["field_id", "component_id"]
AT = [*PART, "y", "x"]


def ownership_pairs(cells: DataFrame, extents: DataFrame, groups: DataFrame, pixel_um: tuple[float, float]) -> DataFrame:
    """Every component with every nucleus group that overlaps it, and the measures its role is decided by.

    ``cells`` and ``extents``: (field_id, y, x, label_id); ``groups``: (field_id,
    nucleus_id, volume_um3, enclosure, accepted, ambiguous).
    """
    area = pixel_um[0] * pixel_um[1]
    size = extents.groupBy("field_id", F.col("label_id").alias("nucleus_id")).agg((F.count(F.lit(1)) * area).alias("extent_um2"))
    met = match.overlap_counts(extents, cells).select("field_id", F.col("left_id").alias("nucleus_id"), F.col("right_id").alias("component_id"), (F.col("overlap") * area).alias("overlap_um2"))
    labelled = met.groupBy("field_id", "nucleus_id").agg(F.sum("overlap_um2").alias("_all"))
    return (
        met.join(labelled, ["field_id", "nucleus_id"]).join(size, ["field_id", "nucleus_id"]).join(groups, ["field_id", "nucleus_id"])
        .select(*PART, "nucleus_id", "overlap_um2", "extent_um2", "volume_um3", "enclosure", "accepted", (F.col("overlap_um2") / F.col("_all")).alias("dominance"), "ambiguous")
    )


def _cropped(px: DataFrame, box: DataFrame) -> DataFrame:
    """Pixels of components in the coordinates of the component's bounding box."""
    rest = [c for c in px.columns if c not in (*AT, "height", "width")]
    return px.join(box, PART).select(*PART, (F.col("y") - F.col("_y0")).alias("y"), (F.col("x") - F.col("_x0")).alias("x"), F.col("_h").alias("height"), F.col("_w").alias("width"), *rest)


def _barrier_children(px: DataFrame, markers: DataFrame, unowned: DataFrame, pitch: dict[str, float], params: OwnershipParams) -> DataFrame:
    """What the owner's marker reaches when a barrier stands around nuclei without an owner: (PART, y, x)."""
    near = label_distance(unowned, px, pitch, label="component_id")
    cut = px.groupBy(*PART).agg(F.percentile("s", F.lit(0.60)).alias("_cut"))
    barrier = (F.col("distance") <= params.barrier_radius_um) & ((F.col("depth_um") >= params.barrier_inner_um) | (F.col("s") >= F.col("_cut")))
    allowed = near.join(cut, PART).where(~barrier).select(*AT, "height", "width")
    seeds = allowed.join(markers.select(*AT), AT, "left_semi")
    return graph.grow(seeds, allowed, PART).select(*AT)


def _elevation(px: DataFrame, s: DataFrame, params: OwnershipParams) -> DataFrame:
    """Cost of growing: shallow and weakly structured pixels are high. In crop coordinates."""
    box = px.groupBy(*PART).agg(
        F.min("y").alias("_y0"), F.min("x").alias("_x0"), (F.max("y") - F.min("y") + 1).cast("int").alias("_h"), (F.max("x") - F.min("x") + 1).cast("int").alias("_w"),
        F.greatest(F.percentile("depth_um", F.lit(0.99)), F.lit(1e-6)).alias("_scale"))
    box = cut_lineage(box)
    # The structure of the whole crop is smoothed, also beside the component; every crop pixel is made once.
    rows = box.select("*", F.explode(F.sequence(F.col("_y0"), F.col("_y0") + F.col("_h") - 1)).alias("y"))
    crop = rows.select("*", F.explode(F.sequence(F.col("_x0"), F.col("_x0") + F.col("_w") - 1)).alias("x")).select(*AT)
    crop = crop.join(s.select("field_id", "y", "x", F.col("s").cast("double").alias("s")), ["field_id", "y", "x"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    smooth = focal.gaussian(_cropped(crop, box.drop("_scale")), 1.0, value="s", out="smooth", keys=PART)
    local = _cropped(px, box.drop("_scale")).join(box.select(*PART, "_scale", "_y0", "_x0"), PART).join(smooth.select(*AT, "smooth"), AT)
    cost = 0.72 * (1.0 - clip(F.col("depth_um") / F.col("_scale"), 0, 1)) + 0.28 * (1.0 - F.col("smooth"))
    return local.withColumn("cost", cost)


def ownership_partition(
    cells: DataFrame, extents: DataFrame, groups: DataFrame, structure: DataFrame, pixel_um: tuple[float, float], params: OwnershipParams = OwnershipParams(),
    keep_peripheral: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Components after the conflict rules, and the decision of each one that a nucleus overlaps.

    Returns pixels (field_id, component_id, owner_id, y, x, height, width) and
    decisions (field_id, component_id, owner_id, status, area_px, kept_px, parts,
    core_ratio, structure_ratio). A component with accepted foreign nuclei is divided
    by competitive growth from one marker a nucleus, kept out of nuclei without an
    owner; one with only such nuclei loses what its marker can't reach round their
    barrier. A division that fails a gate is rolled back for that component: it is
    dropped, or kept whole where (``keep_peripheral``) a foreign part is too small to be
    a cell. Pixels never grow. Components without any nucleus stay as they are, with
    neither an owner nor a decision. ``structure``: (field_id, y, x, s).

    Work follows the conflicting components: each is a raster of its own bounding box,
    cut into tiles like any other.
    """
    pitch = {"y": pixel_um[0], "x": pixel_um[1]}
    area_um2 = pixel_um[0] * pixel_um[1]
    # Both are read many times below, and neither is made again.
    cells, extents = cut_lineage(cells), cut_lineage(extents)
    comp = cells.select("field_id", F.col("label_id").alias("component_id"), "y", "x", "height", "width")
    pairs = cut_lineage(ownership_pairs(cells, extents, groups, pixel_um))
    roles = cut_lineage(match.ownership_roles(pairs, params).select(*PART, "nucleus_id", "role"))
    first = cut_lineage(match.ownership_conflicts(pairs, params))
    hot = first.where(F.col("decision").isin("partition_accepted_foreign", "barrier_unowned_foreign"))

    px = comp.join(hot.select(*PART, "decision"), PART).withColumn("label_id", F.col("component_id"))
    px = thickness(px, pitch, ["field_id"], "component_id").withColumnRenamed("thickness", "depth_um").drop("label_id")
    px = px.join(structure.select("field_id", "y", "x", F.col("s").cast("double").alias("s")), ["field_id", "y", "x"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    px = cut_lineage(px)
    area = px.groupBy(*PART).agg(F.count(F.lit(1)).alias("area_px"))

    claims = roles.where(F.col("role").isin("owner", "accepted_foreign")).join(hot.select(*PART), PART, "left_semi")
    wanted = extents.join(claims.select("field_id", F.col("nucleus_id").alias("label_id")).distinct(), ["field_id", "label_id"], "left_semi")
    markers = marker_for_group(px, wanted, pixel_um).join(claims.withColumnRenamed("nucleus_id", "label_id"), [*PART, "label_id"])
    markers = cut_lineage(markers.select(*PART, "label_id", "role", "y", "x"))
    foreign = roles.where("role = 'unowned_foreign'").select(*PART, F.col("nucleus_id").alias("label_id"))
    unowned = cut_lineage(extents.join(foreign, ["field_id", "label_id"]).select(*AT).distinct())

    # Markers there are, claims there should be, and pixels that two markers share.
    made = markers.groupBy(*PART, "label_id", "role").agg(F.count(F.lit(1)).alias("_n"))
    ready = claims.groupBy(*PART).agg(F.count(F.lit(1)).alias("_claims")).join(
        made.groupBy(*PART).agg(F.count(F.lit(1)).alias("_made"), F.count_if(F.col("role") == "owner").alias("_own")), PART, "left")
    shared = markers.groupBy(*AT).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*PART).distinct().withColumn("_shared", F.lit(True))
    ready = ready.join(shared, PART, "left").select(
        *PART, (F.coalesce("_own", F.lit(0)) > 0).alias("has_owner"), ((F.coalesce("_made", F.lit(0)) == F.col("_claims")) & F.col("_shared").isNull()).alias("has_all"))

    # Nuclei without an owner only: a barrier round them.
    barrier_px = px.where("decision = 'barrier_unowned_foreign'")
    around = cut_lineage(_barrier_children(barrier_px, markers.where("role = 'owner'"), unowned, pitch, params))

    # Accepted foreign nuclei: competitive growth, out of nuclei without an owner.
    split_px = label_distance(unowned, px.where("decision = 'partition_accepted_foreign'"), pitch, label="component_id")
    split_px = split_px.withColumn("_free", F.coalesce(F.col("distance") > params.exclusion_um, F.lit(True))).drop("distance")
    local = cut_lineage(_elevation(split_px, structure, params))
    box = local.select(*PART, "_y0", "_x0").distinct()
    own = markers.join(box, PART).select(*PART, "label_id", (F.col("y") - F.col("_y0")).alias("y"), (F.col("x") - F.col("_x0")).alias("x"))
    marked = cut_lineage(own.join(local.select(*AT, "_free", "depth_um", "s"), AT))
    hit = marked.groupBy(*PART).agg(F.max(~F.col("_free")).alias("hit_marker"))
    usable = marked.join(ready.where("has_all"), PART, "left_semi").join(hit.where("NOT hit_marker"), PART, "left_semi")
    free = local.where("_free").join(usable.select(*PART).distinct(), PART, "left_semi")
    grown = graph.seeded_assign(free.select(*AT, "height", "width", "cost"), usable.select(*AT, "label_id"), PART)
    grown = cut_lineage(grown.select(*AT, "height", "width", "label_id"))

    gates = _partition_gates(grown, local, usable, claims, area, area_um2, params)
    kept_around = around.groupBy(*PART).agg(F.count(F.lit(1)).alias("around_px"))
    least_owner = _least(area_um2, params.min_owner_child_fraction, params)
    whole = comp.groupBy(*PART).agg(F.count(F.lit(1)).alias("whole_px"))
    j = (
        first.join(whole, PART).join(ready, PART, "left").join(hit, PART, "left").join(gates, PART, "left").join(kept_around, PART, "left")
        .withColumn("area_px", F.col("whole_px")).withColumn("around_px", F.coalesce("around_px", F.lit(0)))
    )
    split, barrier = F.col("decision") == "partition_accepted_foreign", F.col("decision") == "barrier_unowned_foreign"
    status = first_reason(
        ("drop_owner_marker_unavailable", (split | barrier) & ~F.coalesce("has_owner", F.lit(False))),
        ("drop_barrier_invalid_owner", barrier & (F.col("around_px") < least_owner)), ("pruned_unowned_foreign", barrier),
        ("drop_marker_build_failed", split & ~F.col("has_all")), ("drop_unowned_barrier_hit_owner", split & F.col("hit_marker")),
        ("split_between_owners", split & F.col("passed")), ("keep_peripheral_nucleus", split & F.lit(keep_peripheral) & F.col("small_foreign")),
        ("drop_ambiguous_partition", split), default="")
    j = j.withColumn("status", F.when(status == "", F.col("decision")).otherwise(status))
    kept = F.when(F.col("status").startswith("drop"), 0).when(F.col("status") == "pruned_unowned_foreign", F.col("around_px")).when(
        F.col("status") == "split_between_owners", F.col("grown_px")).otherwise(F.col("whole_px"))
    parts = F.when(F.col("status").startswith("drop"), 0).when(F.col("status") == "split_between_owners", F.col("children")).otherwise(1)
    decisions = cut_lineage(j.select(
        *PART, "owner_id", "status", "area_px", kept.cast("long").alias("kept_px"), parts.cast("long").alias("parts"),
        F.when(split, F.col("core_ratio")).alias("core_ratio"), F.when(split, F.col("structure_ratio")).alias("structure_ratio")))

    chosen = comp.join(decisions.select(*PART, "owner_id", "status"), PART, "left")
    stays = chosen.where(F.col("status").isNull() | F.col("status").startswith("keep"))
    pruned = chosen.where("status = 'pruned_unowned_foreign'").join(around, AT, "left_semi")
    back = grown.join(box, PART).select(*PART, (F.col("y") + F.col("_y0")).alias("y"), (F.col("x") + F.col("_x0")).alias("x"), F.col("label_id").alias("_new"))
    parted = chosen.where("status = 'split_between_owners'").join(back, AT).withColumn("owner_id", F.col("_new"))
    columns = [*PART, "owner_id", "y", "x", "height", "width"]
    return stays.select(*columns).unionByName(pruned.select(*columns)).unionByName(parted.select(*columns)), decisions


def _least(area_um2: float, fraction: float, params: OwnershipParams):
    """Fewest pixels of a part of a component with ``area_px`` pixels."""
    return F.greatest(F.lit(1), F.ceil(F.lit(params.min_child_um2 / area_um2)), F.ceil(F.lit(fraction) * F.col("area_px")))


def _partition_gates(grown: DataFrame, local: DataFrame, markers: DataFrame, claims: DataFrame, area: DataFrame, area_um2: float, params: OwnershipParams) -> DataFrame:
    """Sizes, connection and seam of every divided component: (PART, children, grown_px, core_ratio, structure_ratio, small_foreign, passed)."""
    size = grown.groupBy(*PART, "label_id").agg(F.count(F.lit(1)).alias("px"))
    least = F.when(F.col("role") == "owner", _least(area_um2, params.min_owner_child_fraction, params)).otherwise(_least(area_um2, params.min_accepted_child_fraction, params))
    sized = claims.withColumnRenamed("nucleus_id", "label_id").join(size, [*PART, "label_id"], "left").join(area, PART).withColumn("small", F.coalesce("px", F.lit(0)) < least)
    sizes = sized.groupBy(*PART).agg(
        F.count(F.lit(1)).alias("children"), F.sum("px").alias("grown_px"), F.max("small").alias("_any_small"), F.coalesce(F.max(F.when(F.col("role") != "owner", F.col("small"))), F.lit(False)).alias("small_foreign"))
    pieces = graph.components(grown.withColumnRenamed("label_id", "owner"), [*PART, "owner"], dense=False).select(*PART, "owner", "label_id").distinct()
    broken = pieces.groupBy(*PART, "owner").agg(F.count(F.lit(1)).alias("_n")).groupBy(*PART).agg((F.max("_n") > 1).alias("_broken"))
    seam = focal.label_boundary(grown, PART, full=False).select(*AT).distinct().join(local.select(*AT, "depth_um", "s"), AT)
    seam = seam.groupBy(*PART).agg(F.percentile("depth_um", F.lit(0.75)).alias("_seam_depth"), F.percentile("s", F.lit(0.5)).alias("_seam_s"))
    core = markers.groupBy(*PART, "label_id").agg(F.percentile("depth_um", F.lit(0.90)).alias("_d"), F.percentile("s", F.lit(0.75)).alias("_s"))
    core = core.groupBy(*PART).agg(F.greatest(F.min("_d"), F.lit(1e-6)).alias("_core"), F.greatest(F.min("_s"), F.lit(1e-6)).alias("_core_s"))
    j = sizes.join(core, PART).join(broken, PART, "left").join(seam, PART, "left").withColumns({
        "core_ratio": F.col("_seam_depth") / F.col("_core"), "structure_ratio": F.col("_seam_s") / F.col("_core_s")})
    # Without a seam there is no ratio, and no gate is passed.
    clear = F.coalesce((F.col("core_ratio") <= params.max_seam_core_ratio) | (F.col("structure_ratio") <= params.max_seam_structure_ratio), F.lit(False))
    passed = ~F.col("_any_small") & ~F.coalesce("_broken", F.lit(False)) & clear
    return j.select(*PART, "children", "grown_px", "core_ratio", "structure_ratio", "small_foreign", passed.alias("passed"))
