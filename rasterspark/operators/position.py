"""Score of depth positions from pixels: axial runs matched with windows, and the inputs of the position score (E30, H11)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.operators import depth, focal, graph, local, match, zonal
from rasterspark.params import AxialRunParams
from rasterspark.session import cut_lineage

WIN = ["field_id", "position"]
AT = [*WIN, "y", "x"]
RUN = [*WIN, "label_id", "run_start"]
#: Least overlap of a nucleus with a component, depth guard around a window, share of the nuclear channel in the optics.
MIN_OVERLAP_UM2, GUARD_UM, DAPI_SHARE = 0.60, 2.0, 0.5


def core_extents(core: DataFrame, extent: DataFrame, keys: list[str] = WIN) -> DataFrame:
    """Extent pixels with the number of their nearest core: (keys, y, x, height, width, label_id, is_core).

    Cores are the connected parts of ``core``; a core's own pixels always belong to it.
    """
    at = [*keys, "y", "x"]
    cores = cut_lineage(graph.components(core.select(*at, "height", "width"), keys))
    near = focal.nearest_seed(cores, {"y": 1.0, "x": 1.0}, keys).select(*at, "label_id")
    px = extent.select(*at, "height", "width").unionByName(core.select(*at, "height", "width")).dropDuplicates(at)
    own = cores.select(*at, F.lit(True).alias("is_core"))
    return px.join(near, at).join(own, at, "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))


def linked_cores(labels: DataFrame, masks: DataFrame, pixel_area_um2: float, min_overlap_um2: float = MIN_OVERLAP_UM2) -> DataFrame:
    """The pixels of cores whose extent overlaps the mask of their position enough."""
    hit = labels.join(masks.select(*AT), AT, "left_semi").groupBy(*WIN, "label_id").agg((F.count(F.lit(1)) * pixel_area_um2).alias("_a"))
    return labels.join(hit.where(F.col("_a") >= min_overlap_um2).select(*WIN, "label_id"), [*WIN, "label_id"], "left_semi")


def window_runs(labels: DataFrame, dapi: DataFrame, windows: DataFrame, step_um: float, guard_um: float = GUARD_UM, params: AxialRunParams = AxialRunParams()) -> DataFrame:
    """Depth runs of every core of every window, over the window's planes and a guard on both sides.

    ``dapi``: (field_id, z, y, x, norm). Returns (WIN, label_id, run_start, run_end).
    """
    guard = math.ceil(guard_um / step_um)
    planes = windows.select(*WIN, F.explode(F.sequence((F.col("z0") - guard).cast("int"), (F.col("z1") + guard).cast("int"))).alias("z"))
    px = labels.select(*AT, "label_id", "is_core").join(planes, WIN).join(dapi.select("field_id", "z", "y", "x", "norm"), ["field_id", "z", "y", "x"])
    k = [*WIN, "label_id"]
    profile = px.where("is_core").groupBy(*k, "z").agg(F.percentile("norm", F.lit(0.85)).alias("p85"))
    q = lambda p: F.percentile("norm", F.lit(p))
    dynamic = px.groupBy(*k).agg((q(0.999) - q(0.001)).alias("dynamic"), F.max(F.abs("norm")).alias("top"))
    return depth.axial_runs(profile, dynamic, step_um, params, k).select(*k, F.col("z0").alias("run_start"), F.col("z1").alias("run_end"))


def match_runs(runs: DataFrame, labels: DataFrame, components: DataFrame, windows: DataFrame, pixel_area_um2: float, step_um: float, min_overlap_um2: float = MIN_OVERLAP_UM2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs centred in their window against the components of its mask.

    Returns per position (associated, unique, retention, rms_um), the uniquely matched
    components (WIN, label_id) and the associated cores (WIN, label_id). A run is kept by
    its plane interval: the centre must lie in the window, and its share of planes
    inside the window is its retention.
    """
    centre = (F.col("run_start") + F.col("run_end")) / 2
    inside = runs.join(windows.select(*WIN, "z0", "z1"), WIN).where(centre.between(F.col("z0"), F.col("z1")))
    shared = F.least("run_end", "z1") - F.greatest("run_start", "z0") + 1
    inside = inside.withColumns({
        "_keep": F.greatest(shared, F.lit(0)) / (F.col("run_end") - F.col("run_start") + 1),
        "_off": (centre - (F.col("z0") + F.col("z1")) / 2) * step_um})
    pairs = match.overlap_counts(labels, components, WIN).where(F.col("overlap") * pixel_area_um2 >= min_overlap_um2)
    hit = cut_lineage(inside.join(pairs.select(*WIN, F.col("left_id").alias("label_id"), F.col("right_id").alias("component_id")), [*WIN, "label_id"]))
    by_run = hit.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_d"), F.min("component_id").alias("component_id"), F.first("_keep").alias("_keep"), F.first("_off").alias("_off"))
    by_component = hit.groupBy(*WIN, "component_id").agg(F.count(F.lit(1)).alias("_k"))
    one = by_run.join(by_component, [*WIN, "component_id"]).where((F.col("_d") == 1) & (F.col("_k") == 1))
    total = by_run.groupBy(*WIN).agg(F.count(F.lit(1)).alias("associated"), F.avg("_keep").alias("retention"), F.sqrt(F.avg(F.col("_off") * F.col("_off"))).alias("rms_um"))
    unique = one.groupBy(*WIN).agg(F.count(F.lit(1)).alias("unique"))
    counts = total.join(unique, WIN, "left").withColumn("unique", F.coalesce("unique", F.lit(0)))
    return counts, one.select(*WIN, F.col("component_id").alias("label_id")).distinct(), by_run.select(*WIN, "label_id").distinct()


def plane_support(structural: DataFrame) -> DataFrame:
    """Otsu support of every plane: (field_id, channel, z, y, x, height, width); a plane of one value has none."""
    keys = ["field_id", "channel", "z"]
    norm = cut_lineage(local.robust01(structural, keys, small_groups=True))
    cut = local.threshold_otsu(norm, keys, "norm")
    return norm.join(cut, keys).where(F.col("norm") > F.col("otsu")).select(*keys, "y", "x", "height", "width")


def position_inputs(
    stack: DataFrame, windows: DataFrame, masks: DataFrame, core: DataFrame, extent: DataFrame, pixel_um: tuple[float, float], step_um: float,
    rails: tuple[float, float], wide_px: float = 10.0, nuclear: str = "DAPI", params: AxialRunParams = AxialRunParams(), projected: DataFrame | None = None,
) -> DataFrame:
    """The fifteen inputs of ``zonal.position_score`` for every window, derived from pixels.

    ``stack``: (field_id, channel, z, y, x, height, width, value) of the nuclear and the
    structural channels; ``windows``: (WIN, z0, z1); ``masks``: the best whole mask of each
    position; ``core`` and ``extent``: its nuclear masks (AT, height, width); ``rails``: digital
    end points; ``projected``: ``project_z`` of the stack, where the caller has it. A position
    without nuclei or mask has zeros and is not valid.
    """
    area = pixel_um[0] * pixel_um[1]
    win = cut_lineage(windows.select(*WIN, "z0", "z1"))
    masks = cut_lineage(masks.select(*AT, "height", "width"))
    dapi = stack.where(F.col("channel") == nuclear)
    fibres = stack.where(F.col("channel") != nuclear)
    weights = local.channel_weights(fibres.select("field_id", "channel").distinct().withColumn("requested", local.requested_weight(F.col("channel")))).select("field_id", "channel", "weight")

    labels = cut_lineage(linked_cores(core_extents(core, extent), masks, area))
    norm = local.normalize_per_plane(dapi.drop("channel"))
    runs = cut_lineage(window_runs(labels, norm, win, step_um, params=params))
    parts = cut_lineage(graph.components(masks.select(*AT, "height", "width"), WIN))
    counts, matched, cores = match_runs(runs, labels, parts, win, area, step_um)
    matched = cut_lineage(matched)

    projected = cut_lineage(depth.project_z(stack, win)) if projected is None else projected
    smap = cut_lineage(focal.structural_map(projected.where(F.col("channel") != nuclear), keys=WIN, emit="all", small_groups=True))
    otsu = cut_lineage(local.threshold_otsu(smap, WIN, "s"))
    whole = zonal.whole_metrics(masks, smap, otsu, matched, wide_px, WIN, parts).drop("area")
    # Only the planes on both sides of a window's faces are asked for support.
    z0, z1 = F.col("z0"), F.col("z1")
    faces = win.select("field_id", F.explode(F.array(*[c.cast("int") for c in (z0 - 1, z0, z1, z1 + 1)])).alias("z")).distinct()
    support = cut_lineage(plane_support(fibres.join(faces, ["field_id", "z"], "left_semi")))
    face = zonal.z_boundary_continuation(support, masks, win, weights).select(*WIN, "completeness")

    # The nuclei of the nuclear channel and the mask of the others, all channels in one pass.
    nuclei = labels.join(cores, [*WIN, "label_id"], "left_semi").select(*AT, F.lit(nuclear).alias("channel"))
    shown = nuclei.unionByName(masks.select(*AT).join(weights.select("field_id", "channel"), "field_id"))
    optics = cut_lineage(zonal.optical_quality(projected, shown, *rails, [*WIN, "channel"], small_groups=True))
    names = ("sharpness", "unclipped", "background")
    lit, by_channel = optics.where(F.col("channel") == nuclear).drop("channel"), optics.where(F.col("channel") != nuclear)
    mixed = by_channel.join(weights, ["field_id", "channel"]).groupBy(*WIN).agg(*[F.sum(F.col(n) * F.col("weight")).alias(f"_{n}") for n in names])
    optics = lit.join(mixed, WIN, "full_outer").select(*WIN, *[(DAPI_SHARE * F.coalesce(n, F.lit(0.0)) + (1 - DAPI_SHARE) * F.coalesce(f"_{n}", F.lit(0.0))).alias(n) for n in names])

    j = win.join(counts, WIN, "left").join(whole, WIN, "left").join(face, WIN, "left").join(optics, WIN, "left")
    half = (F.col("z1") - F.col("z0")) * step_um / 2
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return j.select(
        *WIN, number("unique"), number("associated"), number("components"), share("retention"), "rms_um", half.alias("half_span_um"),
        share("completeness"), share("coverage"), share("precision"), share("unsupported"), share("unanchored"), share("edge_area"), *[share(n) for n in names])


def score_positions(*args, **kw) -> DataFrame:
    """``position_inputs`` with the scores of every position; ``rank.select_position`` takes the best."""
    return zonal.position_score(position_inputs(*args, **kw))
