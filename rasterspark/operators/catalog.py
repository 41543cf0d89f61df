"""Candidate catalog, compartment parameter sets and user-model hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.operators import graph
from rasterspark.operators.local import FIELD

# Profile, family, module, threshold scale, detail and intensity
# percentile, minimum branch area, major axis, eccentricity, gap radius.
PROFILES = (
    ("process", "process_sensitivity", "morphology_baseline", 0.93, 92.0, 68.0, 16, 12.0, 0.62, 2),
    ("balanced", "balanced_adaptive", "morphology_baseline", 0.96, 93.0, 70.0, 18, 13.0, 0.65, 2),
    ("clean", "precision", "morphology_baseline", 1.00, 94.0, 72.0, 20, 15.0, 0.68, 2),
    ("strict", "strict_merge", "morphology_baseline", 1.04, 95.0, 74.0, 22, 18.0, 0.72, 1),
    ("process_refined", "process_sensitivity", "morphology_baseline", 0.93, 92.5, 69.0, 17, 12.5, 0.64, 2),
    ("clean_refined", "precision", "morphology_baseline", 1.00, 93.5, 71.0, 19, 14.0, 0.67, 2),
    ("fine_process_guarded", "process_sensitivity", "structural_refinement", 0.93, 91.5, 66.5, 14, 10.5, 0.58, 2),
    ("precision_guarded", "precision", "structural_refinement", 1.06, 96.0, 76.0, 24, 20.0, 0.75, 1),
    ("merge_resistant", "strict_merge", "structural_refinement", 1.02, 94.5, 73.0, 20, 16.0, 0.72, 1),
    ("structural_snr_adaptive", "balanced_adaptive", "structural_refinement", 0.96, None, None, None, None, None, None),
    ("channel_consensus_guarded", "channel_consensus", "structural_refinement", 0.93, 91.5, 66.5, 14, 10.5, 0.58, 2),
    ("topology_continuity_guarded", "topology_continuity", "structural_refinement", 0.93, 91.5, 66.5, 14, 10.5, 0.58, 2),
    ("gmm_process_guarded", "distributional_threshold", "distributional_threshold", 0.90, 91.5, 66.5, 14, 10.5, 0.58, 2),
    ("gmm_balanced", "distributional_threshold", "distributional_threshold", 0.98, None, None, None, None, None, None),
    ("gmm_precision_guarded", "distributional_threshold", "distributional_threshold", 1.08, 96.0, 76.0, 24, 20.0, 0.75, 1),
    ("gmm_merge_resistant", "distributional_threshold", "distributional_threshold", 1.04, 94.5, 73.0, 20, 16.0, 0.72, 1),
    ("gmm_channel_consensus_guarded", "distributional_threshold", "distributional_threshold", 1.00, 91.5, 66.5, 14, 10.5, 0.58, 2),
    ("gmm_topology_continuity_guarded", "distributional_threshold", "distributional_threshold", 0.94, 91.5, 66.5, 14, 10.5, 0.58, 2),
)


def candidate_catalog(windows: DataFrame, snr: DataFrame) -> DataFrame:
    """Eighteen candidate specifications for every depth window.

    ``windows``: (field_id, position, z_mode); ``snr``: (field_id, sensitivity).
    Profiles without own values adapt to the field's contrast; where that is
    unknown such values stay null and ``reason`` says so.
    """
    names = ("profile", "family", "module", "threshold_scale", "detail", "intensity", "min_area", "major_axis", "eccentricity", "gap")
    kinds = ("string", "string", "string", "double", "double", "double", "int", "double", "double", "int")
    rows = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(p, names, kinds)]) for p in PROFILES])
    c = windows.join(snr, "field_id", "left").select("field_id", "position", "z_mode", F.col("sensitivity").alias("s"), F.posexplode(rows).alias("i", "p"))
    s = F.col("s")
    mode = F.when(F.col("p.profile").contains("consensus"), "channel_consensus").when(F.col("p.profile").contains("topology"), "topology_continuity").otherwise("union")
    return c.select(
        "field_id", "position", "z_mode", (F.col("i") + 1).alias("candidate"), "p.profile", "p.family", "p.module", "p.threshold_scale",
        F.when(F.col("p.module") == "distributional_threshold", "log1p_gmm").otherwise("profile").alias("method"), mode.alias("evidence_mode"),
        F.coalesce("p.detail", 94.5 - 2.0 * s).alias("detail"), F.coalesce("p.intensity", 73.0 - 3.0 * s).alias("intensity"),
        F.coalesce("p.min_area", F.bround(21.0 - 4.0 * s).cast("int")).alias("min_area"), F.coalesce("p.major_axis", 16.0 - 3.0 * s).alias("major_axis"),
        F.coalesce("p.eccentricity", 0.70 - 0.05 * s).alias("eccentricity"), F.coalesce("p.gap", F.when(s >= 0.35, 2).when(s < 0.35, 1)).alias("gap"),
        F.when(s.isNull() & F.col("p.detail").isNull(), "snr_missing").alias("reason"))


def check_catalog(catalog: DataFrame, windows: int = 5) -> DataFrame:
    """Fields whose catalog is not complete or repeats a signature."""
    g = catalog.groupBy("field_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("position", "candidate").alias("k"),
        F.countDistinct("z_mode", "method", "threshold_scale", "detail", "intensity", "min_area", "major_axis", "eccentricity", "gap", "evidence_mode").alias("u"))
    rules = F.array_compact(F.array(
        F.when(F.col("n") != windows * len(PROFILES), "candidate_count"), F.when(F.col("k") != F.col("n"), "repeated_candidate"), F.when(F.col("u") != F.col("n"), "repeated_signature")))
    return g.select("field_id", F.explode(rules).alias("violation"))


# Compartment parameters as (mature, neonatal).
COMPARTMENT_PARAMETERS = {
    "soma_zone_max_um": (5.2, 4.60), "soma_zone_scale_process_rich": (2.15, 1.95), "soma_zone_scale_compact": (2.85, 2.45),
    "thickness_fraction_process_rich": (0.34, 0.40), "thickness_fraction_compact": (0.24, 0.30), "structural_percentile_process_rich": (58.0, 62.0),
    "structural_percentile_compact": (46.0, 50.0), "fallback_soma_radius_um": (1.55, 1.45), "max_soma_fraction": (0.72, 0.64), "primary_anchor_min_score": (0.62, 0.60),
    "primary_anchor_min_thickness_support": (0.60, 0.56), "primary_anchor_min_structural_support": (0.34, 0.32), "primary_anchor_min_overlap_fraction": (0.35, 0.32),
    "multi_anchor_min_score": (0.60, 0.58), "multi_anchor_max_score_delta": (0.16, 0.18), "multi_anchor_min_thickness_support": (0.65, 0.60), "multi_anchor_min_structural_support": (0.35, 0.33),
    "multi_anchor_min_overlap_fraction": (0.55, 0.48), "soma_anchor_min_separation_um": (6.0, 3.8), "soma_part_max_axis_ratio": (3.50, 4.50), "soma_trusted_core_radius_scale": (1.55, 1.45),
    "soma_trusted_core_max_um": (3.60, 3.20), "soma_trusted_core_nucleus_margin_um": (0.65, 0.60), "instance_split_min_anchor_score": (0.68, 0.66), "instance_split_min_anchor_separation_um": (6.0, 4.0),
    "instance_split_min_child_fraction": (0.12, 0.10), "instance_split_max_neck_core_ratio": (0.72, 0.82), "instance_split_max_markers": (2.0, 4.0), "soma_zone_min_um": (2.1, 2.1),
    "min_soma_area_um2": (4.5, 4.5), "min_process_fraction": (0.08, 0.08), "nucleus_link_um": (0.55, 0.55), "soma_part_min_core_radius_um": (0.90, 0.90),
}


def profile_parameters(fields: DataFrame) -> DataFrame:
    """Compartment parameters of each field's age profile as a long table (field_id, profile, name, value)."""
    i = F.when(F.col("profile") == "neonatal", 2).otherwise(1)
    table = F.map_from_arrays(
        F.array(*[F.lit(n) for n in COMPARTMENT_PARAMETERS]),
        F.array(*[F.when(i == 2, F.lit(v[1])).otherwise(F.lit(v[0])) for v in COMPARTMENT_PARAMETERS.values()]))
    return fields.select("field_id", "profile", F.explode(table).alias("name", "value"))


# -------------------------------------------------------------- user models


def with_segmenter(planes: DataFrame, predict: Callable, min_side: int = 32) -> DataFrame:
    """Apply a user segmentation model to every stored plane.

    ``predict(image) -> integer label image`` sees one plane at a time, edge-padded
    to at least ``min_side``; blank planes are skipped and labels are independent
    per plane. Planes stream through Arrow batches, so no shuffle happens.
    """
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = np.asarray(r.px, dtype=float).reshape(r.height, r.width)
                if a.max() <= a.min():
                    continue
                pad = [(0, max(0, min_side - n)) for n in a.shape]
                lab = np.asarray(predict(np.pad(a, pad, mode="edge")))[: r.height, : r.width]
                y, x = np.nonzero(lab)
                yield pd.DataFrame({
                    "field_id": r.field_id, "channel": r.channel, "z": r.z, "y": y.astype("int32"), "x": x.astype("int32"),
                    "label_id": lab[y, x].astype("int64"), "height": r.height, "width": r.width})

    schema = "field_id string, channel string, z int, y int, x int, label_id bigint, height int, width int"
    return planes.select("field_id", "channel", "z", "height", "width", "px").mapInPandas(run, schema)


def resize_nearest(labels: DataFrame, scale: float, keys: list[str] = FIELD) -> DataFrame:
    """Sparse label image at ``scale`` times its size, at least one pixel high and wide.

    A pixel of the result takes the label under its centre, so a stored pixel y
    fills the rows from ceil(y * scale - 1/2) up to the next pixel's first row.
    """
    first = lambda c: F.ceil(c * F.lit(scale) - 0.5).cast("int")
    side = lambda n: F.greatest(F.lit(1), F.floor(F.col(n) * F.lit(scale) + 0.5)).cast("int")
    out = labels.withColumns({"_h": side("height"), "_w": side("width")})
    for axis, end in (("y", "_h"), ("x", "_w")):
        low, high = first(F.col(axis)), F.least(first(F.col(axis) + 1), F.col(end)) - 1
        out = out.where(low <= high).withColumn(axis, F.explode(F.sequence(low, high)))
    return out.select(*keys, "y", "x", "label_id", F.col("_h").alias("height"), F.col("_w").alias("width"))


def model_prior(labels: DataFrame, min_px: int = 55, scale: float = 1.0, keys: list[str] = FIELD) -> DataFrame:
    """Mask of any positive model label, resized by nearest pixel and cleaned of small parts.

    ``scale`` is field pixels per model pixel, any positive number.
    """
    if scale != 1.0:
        labels = resize_nearest(labels, scale, keys)
    return graph.remove_small(labels.select(*keys, "y", "x", "height", "width").distinct(), min_px, keys)


def stroke_pixels(strokes: DataFrame) -> DataFrame:
    """Pixels of rectangular strokes: (field_id, y0, x0, y1, x1) inclusive."""
    s = strokes.select("*", F.explode(F.sequence("y0", "y1")).alias("y"))
    return s.select("field_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
