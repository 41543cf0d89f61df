"""Composite plans: owner resolution and whole analysis routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.operators import evidence, match
from rasterspark.session import cut_lineage


def resolve_owners(slice_labels: DataFrame, gfap: DataFrame, structure: DataFrame, pitch_um: dict[str, float]) -> DataFrame:
    """Link plane labels to nuclei, test their fibre evidence, and project the owners exclusively.

    ``slice_labels``: (field_id, z, y, x, label_id, height, width, depth).
    """
    px = (pitch_um["y"], pitch_um["x"])
    lab = cut_lineage(slice_labels)
    edges = cut_lineage(match.link_edges(lab, px))
    links = match.greedy_one_to_one(edges.where(~F.col("conflict")), ["field_id", "z"], "prev_id", "cur_id")
    tracks = match.tracks_from_links(match.slice_objects(lab, px), links).select("field_id", "z", "label_id", "track_id")
    voxels = cut_lineage(lab.join(tracks, ["field_id", "z", "label_id"]).drop("label_id").withColumnRenamed("track_id", "label_id"))
    size = voxels.groupBy("field_id", "label_id").agg(
        (F.count(F.lit(1)) * pitch_um["z"] * px[0] * px[1]).alias("_v"), ((F.max("z") - F.min("z") + 1) * pitch_um["z"]).alias("_s"))
    solid = size.where(F.col("_v").between(3.0, 1500.0) & (F.col("_s") >= 0.48)).select("field_id", "label_id")
    valid = voxels.join(solid, ["field_id", "label_id"], "left_semi")
    assoc = evidence.weak_enrichment_fallback(evidence.gfap_association(valid, gfap, structure, pitch_um))
    owners = cut_lineage(assoc.where("associated").select("field_id", "label_id"))
    return match.exclusive_projection(valid.join(owners, ["field_id", "label_id"], "left_semi"), {"y": 1.0, "x": 1.0})


def reconcile_identity(regions: DataFrame, nuclei: DataFrame, pixel_um: tuple[float, float]) -> DataFrame:
    """Unite cells that one nucleus holds together; the covered pixels never change."""
    cells = regions.select("field_id", "y", "x", F.col("cell_id").alias("label_id"))
    root = match.merge_same_nucleus(nuclei, cells, pixel_um)
    j = regions.join(root, ["field_id", "cell_id"], "left")
    return j.withColumn("cell_id", F.coalesce("root", "cell_id")).drop("root")


def finalize_cells(
    regions: DataFrame, nuclei: DataFrame, extents: DataFrame, cores: DataFrame, foreign: DataFrame, removed: DataFrame,
    pixel_um: tuple[float, float], truncated: DataFrame | None = None, skeleton: DataFrame | None = None,
) -> DataFrame:
    """Fixed order: reconcile, drop truncated cells, prune tips (when a skeleton is given), complete and rejoin somas."""
    from rasterspark.operators import partition

    r = cut_lineage(reconcile_identity(regions, nuclei, pixel_um))
    if truncated is not None:
        r = r.join(truncated.where(F.col("status") != "retained").select("field_id", "cell_id"), ["field_id", "cell_id"], "left_anti")
    if skeleton is not None:
        r = cut_lineage(partition.prune_foreign_tips(r, foreign, skeleton)[0])
    r = cut_lineage(partition.complete_soma_in_whole(r, extents.select("field_id", "y", "x", "cell_id"))[0])
    r = cut_lineage(partition.complete_soma_to_owner(r, extents, cores, foreign, removed, pixel_um)[0])
    return partition.rejoin_soma_islands(r, foreign, pixel_um)[0]
