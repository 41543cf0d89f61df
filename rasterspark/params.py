"""Calibrated parameter sets, as frozen records (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class WindowParams:
    target_um: float = 9.5
    guard_um: float = 5.0
    n_windows: int = 5


@dataclass(frozen=True)
class QcParams:
    max_endpoint_fraction: float = 0.05
    min_sharpness: float = 0.002
    max_nonuniformity: float = 0.18


@dataclass(frozen=True)
class ActiveZParams:
    high: float = 0.992
    activity: float = 0.55
    min_relative: float = 0.15
    smooth_um: float = 0.75
    pad_um: float = 1.0
    min_span_um: float = 4.0


@dataclass(frozen=True)
class StructureParams:
    background_sigma_um: float = 2.8
    ridge_scales_um: tuple[float, ...] = (0.12, 0.24, 0.48)
    intensity_weight: float = 0.58
    ridge_weight: float = 0.42
    projection_q: float = 0.95
    score_q: float = 0.84
    intensity_q: float = 0.64
    ridge_q: float = 0.94
    gap_um: float = 0.18
    min_area_um2: float = 0.10


@dataclass(frozen=True)
class AxialRunParams:
    active_fraction: float = 0.22
    peak_fraction: float = 0.48
    min_contrast_fraction: float = 0.04
    min_span_um: float = 0.35
    max_gap: int = 2


@dataclass(frozen=True)
class SelectionParams:
    near_duplicate_iou: float = 0.995
    margin: float = 0.01
    # Score weights in ranking order.
    weights: dict[str, float] = field(default_factory=lambda: {
        "mean_iou": 0.27, "coverage": 0.10, "precision": 0.15, "unsupported": 0.09, "soma": 0.20,
        "unanchored": 0.08, "edge": 0.02, "border_removed": 0.01, "border_preserved": 0.04,
    })
    baseline_families: tuple[str, ...] = (
        "process_sensitivity", "balanced_adaptive", "precision", "strict_merge", "channel_consensus",
        "topology_continuity",
    )
    last_family: str = "distributional_threshold"


@dataclass(frozen=True)
class LinkParams:
    min_overlap: float = 0.18
    max_distance_um: float = 0.85
    contact_um: float = 0.22
    ambiguity: float = 0.72


@dataclass(frozen=True)
class OwnershipParams:
    radius_factor: float = 1.25
    owner_min_overlap_um2: float = 0.60
    accepted_min_extent_fraction: float = 0.45
    foreign_min_overlap_um2: float = 1.60
    foreign_min_fraction: float = 0.45
    foreign_min_owner_ratio: float = 0.15
    foreign_min_dominance: float = 0.80
    accepted_min_volume_um3: float = 4.0
    unowned_min_volume_um3: float = 12.0
    unowned_min_enclosure: float = 0.20
    ambiguous_fraction: float = 0.30
    barrier_radius_um: float = 1.10
    barrier_inner_um: float = 0.18
    exclusion_um: float = 0.45
    min_child_um2: float = 12.0
    min_owner_child_fraction: float = 0.12
    min_accepted_child_fraction: float = 0.08
    max_seam_core_ratio: float = 0.86
    max_seam_structure_ratio: float = 0.88


@dataclass(frozen=True)
class IdentityParams:
    min_overlap_um2: float = 0.55
    min_overlap_fraction: float = 0.16
    merge_contact_um: float = 0.30
    max_sources: int = 3
    satellite_volume_ratio: float = 0.38
    satellite_radius_factor: float = 1.20
    satellite_z_overlap: float = 0.60


@dataclass(frozen=True)
class WorkloadLimits:
    max_parent_fragments: int = 2_600
    max_total_fragments: int = 7_500
    max_parent_comparisons: int = 27_000_000_000
    max_total_comparisons: int = 60_000_000_000
    max_parent_payload_bytes: int = 4 * 1024**3


# Age evidence bounds and weights by channel set.
AGE_SETS = {
    "egfp_gfap": {
        "threshold": 0.55,
        "bounds": {
            "broad_structure": (0.95, 2.20), "solid_structure": (0.24, 0.54), "limited_thin_arbor": (0.62, 0.88),
            "limited_branching": (0.14, 0.50), "polarized_shape": (1.70, 3.20), "multi_nucleus_overlap": (0.05, 0.30),
        },
        "weights": {
            "broad_structure": 0.26, "solid_structure": 0.20, "limited_thin_arbor": 0.18,
            "limited_branching": 0.16, "polarized_shape": 0.10, "multi_nucleus_overlap": 0.10,
        },
    },
    "egfp_only": {
        "threshold": 0.38,
        "bounds": {
            "broad_structure": (0.95, 2.20), "solid_structure": (0.24, 0.54), "limited_thin_arbor": (0.35, 0.52),
            "limited_branching": (0.14, 0.50), "polarized_shape": (1.70, 3.20), "multi_nucleus_overlap": (0.05, 0.30),
        },
        "weights": {
            "broad_structure": 0.0, "solid_structure": 0.0, "limited_thin_arbor": 0.60,
            "limited_branching": 0.0, "polarized_shape": 0.40, "multi_nucleus_overlap": 0.0,
        },
    },
}

# Requested weight of each structural channel.
CHANNEL_WEIGHTS = {"eGFP": 0.55, "GFAP": 0.45}
