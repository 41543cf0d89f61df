"""Overlap, one-to-one matching, linking, grouping and owner decisions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterspark.functions.scalar import first_reason, reasons, sphere_radius
from rasterspark.operators.graph import label_closure
from rasterspark.operators.local import FIELD
from rasterspark.params import IdentityParams, LinkParams, OwnershipParams

AT = ["field_id", "y", "x"]


def zonal_join(px: DataFrame, labels: DataFrame, how: str = "inner", keys: list[str] = FIELD) -> DataFrame:
    """Pixels joined to labels by position (inner), or masked (left_semi) or excluded (left_anti)."""
    at = [*keys, "y", "x"]
    right = labels.select(*at) if how in ("left_semi", "left_anti") else labels.drop("height", "width")
    return px.join(right, at, how)


def overlap_counts(a: DataFrame, b: DataFrame, keys: list[str] = FIELD, axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Contingency counts of two label layers: (keys, left_id, right_id, overlap)."""
    at = [*keys, *axes]
    left = a.select(*at, F.col("label_id").alias("left_id"))
    right = b.select(*at, F.col("label_id").alias("right_id"))
    return left.join(right, at).groupBy(*keys, "left_id", "right_id").agg(F.count(F.lit(1)).alias("overlap"))


def unique_match(a: DataFrame, b: DataFrame, pixel_area_um2: float, min_overlap_um2: float = 0.60, keys: list[str] = FIELD) -> DataFrame:
    """Significant overlaps with the degree of both ends; unique when both are one."""
    pairs = overlap_counts(a, b, keys).withColumn("overlap_um2", F.col("overlap") * pixel_area_um2).where(F.col("overlap_um2") >= min_overlap_um2)
    return pairs.withColumns({
        "left_degree": F.count(F.lit(1)).over(Window.partitionBy(*keys, "left_id")),
        "right_degree": F.count(F.lit(1)).over(Window.partitionBy(*keys, "right_id")),
    }).withColumn("unique", (F.col("left_degree") == 1) & (F.col("right_degree") == 1))


def match_counts(matches: DataFrame, keys: list[str] = FIELD) -> DataFrame:
    return matches.groupBy(*keys).agg(F.countDistinct("left_id").alias("associated"), F.count_if("unique").alias("unique"))


# ------------------------------------------------------------ slice linking


def slice_objects(labels: DataFrame, pixel_um: tuple[float, float]) -> DataFrame:
    """Area and physical centroid of every label of every plane."""
    return labels.groupBy("field_id", "z", "label_id").agg(
        F.count(F.lit(1)).alias("area"), (F.avg("y") * pixel_um[0]).alias("cy_um"), (F.avg("x") * pixel_um[1]).alias("cx_um"))


def slice_overlaps(labels: DataFrame) -> DataFrame:
    """Overlap of labels in adjacent planes: (field_id, z, prev_id, cur_id, overlap), z of the lower plane."""
    up = labels.select("field_id", (F.col("z") - 1).alias("z"), "y", "x", F.col("label_id").alias("cur_id"))
    return labels.select("field_id", "z", "y", "x", F.col("label_id").alias("prev_id")).join(up, ["field_id", "z", "y", "x"]).groupBy(
        "field_id", "z", "prev_id", "cur_id").agg(F.count(F.lit(1)).alias("overlap"))


def link_edges(labels: DataFrame, pixel_um: tuple[float, float], params: LinkParams = LinkParams()) -> DataFrame:
    """Candidate links of adjacent planes with score and conflict flag.

    A pair links by relative overlap, or by near centroids with contact after a
    small dilation. Contact pairs come from dilated pixels, never from all pairs.
    """
    from rasterspark.functions.tiles import disk_offsets

    obj = slice_objects(labels, pixel_um)
    offsets = disk_offsets(params.contact_um, *pixel_um, at_least_one=True)
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in offsets]))
    wide = labels.select("field_id", "z", "label_id", "y", "x", moves.alias("o")).select(
        "field_id", "z", "label_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    up = labels.select("field_id", (F.col("z") - 1).alias("z"), "y", "x", F.col("label_id").alias("cur_id"))
    near = wide.withColumnRenamed("label_id", "prev_id").join(up, ["field_id", "z", "y", "x"]).select("field_id", "z", "prev_id", "cur_id").distinct()
    lo = obj.select("field_id", "z", F.col("label_id").alias("prev_id"), F.col("area").alias("_pa"), F.col("cy_um").alias("_py"), F.col("cx_um").alias("_px"))
    hi = obj.select("field_id", (F.col("z") - 1).alias("z"), F.col("label_id").alias("cur_id"), F.col("area").alias("_ca"), F.col("cy_um").alias("_cy"), F.col("cx_um").alias("_cx"))
    e = near.join(slice_overlaps(labels), ["field_id", "z", "prev_id", "cur_id"], "left").join(lo, ["field_id", "z", "prev_id"]).join(hi, ["field_id", "z", "cur_id"])
    share = F.coalesce(F.col("overlap") / F.least("_pa", "_ca"), F.lit(0.0))
    dist = F.hypot(F.col("_py") - F.col("_cy"), F.col("_px") - F.col("_cx"))
    linked = e.withColumns({"share": share, "distance_um": dist}).where((F.col("share") >= params.min_overlap) | (F.col("distance_um") <= params.max_distance_um))
    scored = linked.withColumn("score", F.col("share") + F.greatest(F.lit(0.0), 1.0 - F.col("distance_um") / params.max_distance_um))
    return flag_conflicts(scored, params.ambiguity).select("field_id", "z", "prev_id", "cur_id", "share", "distance_um", "score", "conflict")


def flag_conflicts(edges: DataFrame, ratio: float) -> DataFrame:
    """Mark every edge at or above the cut of an end whose second choice is close to its best."""
    out, flags = edges, []
    for i, side in enumerate(("prev_id", "cur_id")):
        w = Window.partitionBy("field_id", "z", side)
        order = w.orderBy(F.desc("score"))
        out = out.withColumn(f"_b{i}", F.max("score").over(w)).withColumn(f"_r{i}", F.row_number().over(order))
        out = out.withColumn(f"_s{i}", F.max(F.when(F.col(f"_r{i}") == 2, F.col("score"))).over(w))
        cut = F.col(f"_b{i}") * ratio
        flags.append(F.coalesce((F.col(f"_s{i}") >= cut) & (F.col("score") >= cut), F.lit(False)))
    return out.withColumn("conflict", flags[0] | flags[1]).drop("_b0", "_r0", "_s0", "_b1", "_r1", "_s1")


#: Most edges of one group that a task matches at once.
GREEDY_EDGES = 500_000


def _greedy(left: str, right: str):
    """The sequential greedy over the edges of one group, which come best first."""

    def run(edges: pa.Table) -> pa.Table:
        edges = edges.sort_by("_r")
        used_left, used_right, take = set(), set(), []
        for i, (a, b) in enumerate(zip(edges.column(left).to_pylist(), edges.column(right).to_pylist())):
            if a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                take.append(i)
        return edges.drop_columns(["_r"]).take(pa.array(take, pa.int64()))

    return run


def greedy_one_to_one(edges: DataFrame, keys: list[str], left: str, right: str, score: str = "score", bound: int = GREEDY_EDGES) -> DataFrame:
    """Greedy matching by (-score, left, right).

    What the greedy does with the best edges of a group doesn't depend on the others. So the
    best ``bound`` edges of every group are matched in one task a group; only where a group has
    more, edges of taken ends leave and the next ``bound`` follow. The number of rounds
    depends on sizes alone, never on how scores fall along a chain.
    """
    from rasterspark.session import cut_lineage

    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.col(left), F.col(right))
    rest = edges.select(*keys, left, right, score)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    chosen = None
    while True:
        ranked = cut_lineage(rest.withColumn("_r", F.row_number().over(order)))
        best = cut_lineage(ranked.where(F.col("_r") <= bound).groupBy(*keys).applyInArrow(_greedy(left, right), schema))
        chosen = best if chosen is None else chosen.unionByName(best)
        rest = ranked.where(F.col("_r") > bound).drop("_r")
        if rest.isEmpty():
            return chosen
        rest = rest.join(best.select(*keys, left), [*keys, left], "left_anti").join(best.select(*keys, right), [*keys, right], "left_anti")


def tracks_from_links(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Track id of every slice object: the raster rank of its first (z, label).

    ``objects``: (field_id, z, label_id); ``links``: (field_id, z, prev_id, cur_id).
    """
    code = lambda z, i: (z.cast("long") * F.lit(1 << 32) + i)
    e = links.select("field_id", code(F.col("z"), F.col("prev_id")).alias("a"), code(F.col("z") + 1, F.col("cur_id")).alias("b"))
    root = label_closure(e).withColumnRenamed("root", "track_root")
    o = objects.withColumn("node", code(F.col("z"), F.col("label_id"))).join(root, ["field_id", "node"], "left")
    o = o.withColumn("track_root", F.coalesce("track_root", "node")).drop("node")
    from rasterspark.functions.quantile import dense_index

    ids = dense_index(o.select("field_id", "track_root").distinct(), FIELD, "track_root", "track_id", 1 << 44)
    return o.join(ids, ["field_id", "track_root"]).drop("track_root")


def link_slices(labels: DataFrame, pixel_um: tuple[float, float], depth_um: float, params: LinkParams = LinkParams(),
                min_volume: float = 3.0, max_volume: float = 1500.0, min_span: float = 0.48) -> DataFrame:
    """3D nuclei from plane labels: one row per track with volume, span, and ordered reasons."""
    edges = link_edges(labels, pixel_um, params)
    links = greedy_one_to_one(edges.where(~F.col("conflict")), ["field_id", "z"], "prev_id", "cur_id")
    obj = slice_objects(labels, pixel_um)
    tracks = tracks_from_links(obj, links)
    ends = F.explode(F.array(F.struct(F.col("z").alias("z"), F.col("prev_id").alias("label_id")), F.struct((F.col("z") + 1).alias("z"), F.col("cur_id").alias("label_id"))))
    amb = edges.where("conflict").select("field_id", ends.alias("e")).select("field_id", "e.z", "e.label_id").distinct().withColumn("_amb", F.lit(True))
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == F.col("width") - 1)
    rim = labels.where(edge).select("field_id", "z", "label_id").distinct().withColumn("_rim", F.lit(True))
    t = tracks.join(amb, ["field_id", "z", "label_id"], "left").join(rim, ["field_id", "z", "label_id"], "left")
    g = t.groupBy("field_id", "track_id").agg(
        F.sum("area").alias("voxels"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count(F.lit(1)).alias("slices"),
        F.max(F.coalesce("_amb", F.lit(False))).alias("ambiguous"), F.max(F.coalesce("_rim", F.lit(False))).alias("touches_border"))
    vol = F.col("voxels") * pixel_um[0] * pixel_um[1] * depth_um
    span = (F.col("z_max") - F.col("z_min") + 1) * depth_um
    why = reasons(
        ("ambiguous_slice_link", F.col("ambiguous")), ("volume_below_minimum", vol < min_volume), ("volume_above_maximum", vol > max_volume),
        ("z_span_below_minimum", span < min_span), ("touches_xy_border", F.col("touches_border")),
        ("disconnected_z", F.col("slices") != F.col("z_max") - F.col("z_min") + 1))
    return g.withColumns({"volume_um3": vol, "z_span_um": span, "reasons": why, "valid": F.size(why) == 0})


def link_by_mutual_overlap(labels: DataFrame, min_share: float = 0.08) -> DataFrame:
    """Tracks from the greedy strongest one-to-one overlaps of adjacent planes."""
    obj = labels.groupBy("field_id", "z", "label_id").agg(F.count(F.lit(1)).alias("area"))
    lo = obj.select("field_id", "z", F.col("label_id").alias("prev_id"), F.col("area").alias("_pa"))
    hi = obj.select("field_id", (F.col("z") - 1).alias("z"), F.col("label_id").alias("cur_id"), F.col("area").alias("_ca"))
    e = slice_overlaps(labels).join(lo, ["field_id", "z", "prev_id"]).join(hi, ["field_id", "z", "cur_id"])
    e = e.withColumn("score", F.col("overlap") / F.least("_pa", "_ca")).where(F.col("score") >= min_share)
    return tracks_from_links(obj, greedy_one_to_one(e, ["field_id", "z"], "prev_id", "cur_id"))


def match_known(tracks_px: DataFrame, known_px: DataFrame, min_share: float = 0.55) -> DataFrame:
    """Best known nucleus per track when the overlap reaches a share of the smaller."""
    size = lambda df, n: df.groupBy("field_id", "label_id").agg(F.count(F.lit(1)).alias(n))
    o = overlap_counts(tracks_px, known_px).join(size(tracks_px, "_a").withColumnRenamed("label_id", "left_id"), ["field_id", "left_id"])
    o = o.join(size(known_px, "_b").withColumnRenamed("label_id", "right_id"), ["field_id", "right_id"])
    o = o.withColumn("share", F.col("overlap") / F.least("_a", "_b")).where(F.col("share") >= min_share)
    w = Window.partitionBy("field_id", "left_id").orderBy(F.desc("share"), "right_id")
    return o.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("field_id", "left_id", "right_id", "overlap", "share")


# -------------------------------------------------------------- owner choice


def assign_nucleus_to_cell(nuclei: DataFrame, cells: DataFrame, pitch_um: dict[str, float], max_um: float = 1.2) -> DataFrame:
    """Cell of each nucleus: the largest overlap, else the nearest cell to the centroid within reach."""
    from rasterspark.operators.focal import nearest_seed

    w = Window.partitionBy("field_id", "left_id").orderBy(F.desc("overlap"), "right_id")
    best = overlap_counts(nuclei, cells).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
        "field_id", F.col("left_id").alias("label_id"), F.col("right_id").alias("_by_overlap"))
    centre = nuclei.groupBy("field_id", "label_id").agg(
        F.bround(F.avg("y")).cast("int").alias("y"), F.bround(F.avg("x")).cast("int").alias("x"))
    near = nearest_seed(cells, pitch_um, max_um=max_um).select(*AT, F.col("label_id").alias("_near"))
    j = centre.join(best, ["field_id", "label_id"], "left").join(near, AT, "left")
    return j.select("field_id", F.col("label_id").alias("nucleus_id"), F.coalesce("_by_overlap", "_near").alias("cell_id"),
                    F.when(F.col("_by_overlap").isNotNull(), "overlap").when(F.col("_near").isNotNull(), "nearest").otherwise("none").alias("source"))


def owner_for_soma(pairs: DataFrame) -> DataFrame:
    """Owner per cell: accepted nuclei first, then overlap, then volume (field_id, cell_id, nucleus_id, accepted, overlap, volume_um3)."""
    w = Window.partitionBy("field_id", "cell_id").orderBy(F.desc("accepted"), F.desc("overlap"), F.desc("volume_um3"), "nucleus_id")
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def owner_map(declared: DataFrame, recorded: DataFrame, soma: DataFrame, whole: DataFrame) -> DataFrame:
    """Owner cascade over four sources of (field_id, nucleus_id, cell_id[, overlap]), one nucleus per cell."""
    parts = None
    for rank, (name, df) in enumerate((("declared", declared), ("recorded", recorded), ("soma_overlap", soma), ("whole_overlap", whole))):
        score = F.col("overlap") if "overlap" in df.columns else F.lit(0)
        p = df.select("field_id", "nucleus_id", "cell_id", F.lit(rank).alias("_rank"), F.lit(name).alias("source"), score.cast("double").alias("_o"))
        parts = p if parts is None else parts.unionByName(p)
    w = Window.partitionBy("field_id", "nucleus_id").orderBy("_rank", F.desc("_o"), "cell_id")
    pick = parts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "_o", "_rank")
    s = soma.select("field_id", "nucleus_id", "cell_id", F.col("overlap").alias("_so"))
    h = whole.select("field_id", "nucleus_id", "cell_id", F.col("overlap").alias("_wo"))
    k = ["field_id", "nucleus_id", "cell_id"]
    j = pick.join(s, k, "left").join(h, k, "left")
    per_cell = Window.partitionBy("field_id", "cell_id").orderBy(F.desc(F.coalesce("_so", F.lit(0))), F.desc(F.coalesce("_wo", F.lit(0))), "nucleus_id")
    return j.withColumn("_r", F.row_number().over(per_cell)).where(F.col("_r") == 1).select(*k, "source")


# ----------------------------------------------------- grouping of 3D records


def _grid_pairs(objects: DataFrame, keys: list[str], factor: float, pixel_um: tuple[float, float], columns: list[str]) -> DataFrame:
    """Ordered pairs of objects whose centres may lie within ``factor`` times the sum of their radii.

    Objects fall into classes by the power of two above their radius. A pair meets
    on the grid of its larger class, whose cells are as wide as two objects of that
    class reach: the larger one lies in one cell, the other in the 3 x 3 cells around
    it. So an object of any size finds its partners, and small objects of a crowded
    field never meet on a coarse grid unless a large one is there.
    """
    size = F.ceil(F.log2(F.greatest(sphere_radius("volume_um3"), F.lit(2.0**-20)))).cast("int")
    sized = objects.withColumn("_k", size)
    top = F.max("_k").over(Window.partitionBy(*keys))
    every = sized.withColumn("_top", top).withColumn("_level", F.explode(F.sequence("_k", "_top"))).drop("_top")
    cell = F.lit(2.0 * factor) * F.pow(F.lit(2.0), F.col("_level"))
    every = every.withColumns({
        "_gy": F.floor(F.col("center_y") * pixel_um[0] / cell).cast("long"), "_gx": F.floor(F.col("center_x") * pixel_um[1] / cell).cast("long")})
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = every.withColumn("_m", moves).withColumns({"_gy": F.col("_gy") + F.col("_m.dy"), "_gx": F.col("_gx") + F.col("_m.dx")})
    at = [*keys, "_level", "_gy", "_gx"]
    # The planner measures a side by its file and doesn't see the copies made above, so it would broadcast
    # tables of any size; both sides are shuffled.
    named = lambda df, side: df.select(*at, *[F.col(c).alias(f"{side}_{c}") for c in columns]).hint("merge")
    large = F.col("_k") == F.col("_level")
    first = named(every.where(large), "a").join(named(around, "b"), at)
    second = named(around.where(~large), "a").join(named(every.where(large), "b"), at)
    return first.unionByName(second).drop("_level", "_gy", "_gx")


def _pair_distance(pixel_um: tuple[float, float], depth_um: float):
    d = lambda c, s: (F.col(f"a_center_{c}") - F.col(f"b_center_{c}")) * s
    return F.sqrt(F.pow(d("z", depth_um), 2.0) + F.pow(d("y", pixel_um[0]), 2.0) + F.pow(d("x", pixel_um[1]), 2.0))


_RECORD = ["object_id", "z_min", "z_max", "center_z", "center_y", "center_x", "volume_um3"]


def fragment_pairs(objects: DataFrame, pixel_um: tuple[float, float], depth_um: float, params: OwnershipParams = OwnershipParams()) -> DataFrame:
    """Fragments of one nucleus: same 2D component, overlapping depth, centres within the radius sum."""
    p = _grid_pairs(objects, ["field_id", "component_2d"], params.radius_factor, pixel_um, _RECORD).where(F.col("a_object_id") < F.col("b_object_id"))
    touch = (F.col("a_z_min") <= F.col("b_z_max")) & (F.col("b_z_min") <= F.col("a_z_max"))
    limit = params.radius_factor * (sphere_radius("a_volume_um3") + sphere_radius("b_volume_um3"))
    return p.where(touch & (_pair_distance(pixel_um, depth_um) <= limit)).select("field_id", F.col("a_object_id").alias("a"), F.col("b_object_id").alias("b"))


def group_fragments(objects: DataFrame, pixel_um: tuple[float, float], depth_um: float, params: OwnershipParams = OwnershipParams()) -> DataFrame:
    """Union of fragments into nucleus groups with volume-weighted centres."""
    root = label_closure(fragment_pairs(objects, pixel_um, depth_um, params)).withColumnRenamed("node", "object_id")
    o = objects.join(root.hint("merge"), ["field_id", "object_id"], "left").withColumn("group_id", F.coalesce("root", "object_id"))
    v = F.col("volume_um3")
    weighted = lambda c: (F.sum(F.col(c) * v) / F.sum(v)).alias(c)
    g = o.groupBy("field_id", "group_id").agg(
        F.array_sort(F.collect_list("object_id")).alias("source_ids"), F.sum(v).alias("volume_um3"), F.min("z_min").alias("z_min"),
        F.max("z_max").alias("z_max"), weighted("center_z"), weighted("center_y"), weighted("center_x"), F.max("enclosure").alias("enclosure"),
        F.max("accepted").alias("_any"))
    return g.withColumn("accepted", F.col("_any") & (F.col("volume_um3") >= params.accepted_min_volume_um3)).drop("_any")


def collapse_satellites(groups: DataFrame, pixel_um: tuple[float, float], depth_um: float, params: IdentityParams = IdentityParams()) -> DataFrame:
    """Alias of each satellite record to the root record that contains its sources."""
    cols = ["group_id", "source_ids", "z_min", "z_max", "center_z", "center_y", "center_x", "volume_um3"]
    p = _grid_pairs(groups, ["field_id"], params.satellite_radius_factor, pixel_um, cols)
    small, big = F.col("a_source_ids"), F.col("b_source_ids")
    overlap = F.least("a_z_max", "b_z_max") - F.greatest("a_z_min", "b_z_min") + 1
    span = F.col("a_z_max") - F.col("a_z_min") + 1
    subset = (F.size(F.array_except(small, big)) == 0) & (F.size(small) < F.size(big))
    near = _pair_distance(pixel_um, depth_um) <= params.satellite_radius_factor * (sphere_radius("a_volume_um3") + sphere_radius("b_volume_um3"))
    hit = p.where(subset & (F.col("a_volume_um3") <= params.satellite_volume_ratio * F.col("b_volume_um3")) & (overlap / span >= params.satellite_z_overlap) & near)
    # The largest host wins; alias chains are followed to their end.
    w = Window.partitionBy("field_id", "a_group_id").orderBy(F.desc("b_volume_um3"), "b_group_id")
    alias = hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("field_id", F.col("a_group_id").alias("group_id"), F.col("b_group_id").alias("host"))
    return follow_alias(groups.select("field_id", "group_id"), alias, "group_id", "host")


def follow_alias(nodes: DataFrame, alias: DataFrame, node: str, target: str) -> DataFrame:
    """Follow alias chains to their end by pointer doubling: (field_id, node, root)."""
    from rasterspark.session import cut_lineage

    # Written tables keep the planner's guess of their size, so it is told to shuffle them.
    cur = cut_lineage(nodes.join(alias.hint("merge"), ["field_id", node], "left").withColumn("root", F.coalesce(target, node)).select("field_id", node, "root"))
    while True:
        hop = cur.select("field_id", F.col(node).alias("root"), F.col("root").alias("_n")).hint("merge")
        nxt = cut_lineage(cur.join(hop, ["field_id", "root"], "left").select("field_id", node, F.coalesce("_n", "root").alias("root"), (F.coalesce("_n", "root") != F.col("root")).alias("_c")))
        cur = nxt.drop("_c")
        if nxt.where("_c").isEmpty():
            return cur


def merge_same_nucleus(nuclei: DataFrame, cells: DataFrame, pixel_um: tuple[float, float], params: IdentityParams = IdentityParams()) -> DataFrame:
    """Cells to unite because one nucleus overlaps two or three of them at close range: (field_id, cell_id, root)."""
    from rasterspark.functions.tiles import disk_offsets

    area = pixel_um[0] * pixel_um[1]
    size = nuclei.groupBy("field_id", "label_id").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("label_id", "left_id")
    o = overlap_counts(nuclei, cells).join(size, ["field_id", "left_id"])
    sig = o.where((F.col("overlap") * area >= params.min_overlap_um2) & (F.col("overlap") / F.col("_n") >= params.min_overlap_fraction))
    k = F.count(F.lit(1)).over(Window.partitionBy("field_id", "left_id"))
    sig = sig.withColumn("_k", k).where(F.col("_k").between(2, params.max_sources)).select("field_id", "left_id", F.col("right_id").alias("cell_id"))
    # Only the nucleus' own pixels in those cells are compared, within the contact radius.
    px = nuclei.select(*AT, F.col("label_id").alias("left_id")).join(cells.select(*AT, F.col("label_id").alias("cell_id")), AT).join(sig, ["field_id", "left_id", "cell_id"], "left_semi")
    offsets = [(i, j) for i, j in disk_offsets(params.merge_contact_um, *pixel_um, at_least_one=True)]
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in offsets]))
    moved = px.select("field_id", "left_id", F.col("cell_id").alias("a"), "y", "x", moves.alias("o")).select(
        "field_id", "left_id", "a", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    pairs = moved.join(px.withColumnRenamed("cell_id", "b"), ["field_id", "left_id", "y", "x"]).where(F.col("a") < F.col("b")).select("field_id", "a", "b").distinct()
    return label_closure(pairs).withColumnRenamed("node", "cell_id")


def ownership_roles(pairs: DataFrame, params: OwnershipParams = OwnershipParams()) -> DataFrame:
    """``pairs`` of a component and a nucleus with ``role``: owner, accepted_foreign, unowned_foreign or other, and ``vague``.

    ``pairs``: (field_id, component_id, nucleus_id, overlap_um2, extent_um2,
    volume_um3, enclosure, accepted, dominance, ambiguous).
    """
    k = ["field_id", "component_id"]
    share = F.col("overlap_um2") / F.col("extent_um2")
    enough = F.col("overlap_um2") >= params.owner_min_overlap_um2
    order = Window.partitionBy(*k).orderBy(F.desc(F.col("accepted") & enough), F.desc("overlap_um2"), F.desc("volume_um3"), F.desc("enclosure"), "nucleus_id")
    p = pairs.withColumn("_owner", F.col("accepted") & enough & (F.row_number().over(order) == 1))
    p = p.withColumn("_owner_overlap", F.max(F.when(F.col("_owner"), F.col("overlap_um2"))).over(Window.partitionBy(*k)))
    accepted_foreign = F.col("accepted") & enough & (share >= params.accepted_min_extent_fraction) & (F.col("volume_um3") >= params.accepted_min_volume_um3)
    unowned = (
        ~F.col("accepted") & (F.col("overlap_um2") >= params.foreign_min_overlap_um2) & (share >= params.foreign_min_fraction)
        & (F.col("overlap_um2") >= params.foreign_min_owner_ratio * F.coalesce("_owner_overlap", F.lit(0.0))) & (F.col("dominance") >= params.foreign_min_dominance)
        & (F.col("volume_um3") >= params.unowned_min_volume_um3) & (F.col("enclosure") >= params.unowned_min_enclosure)
    )
    role = F.when(F.col("_owner"), "owner").when(accepted_foreign, "accepted_foreign").when(unowned, "unowned_foreign").otherwise("other")
    vague = F.col("ambiguous") & enough & (share >= params.ambiguous_fraction)
    return p.withColumns({"role": role, "vague": vague}).drop("_owner", "_owner_overlap")


def ownership_conflicts(pairs: DataFrame, params: OwnershipParams = OwnershipParams()) -> DataFrame:
    """Owner, foreign nuclei and decision of every component of ``pairs`` (see ``ownership_roles``)."""
    role = F.col("role")
    g = ownership_roles(pairs, params).groupBy("field_id", "component_id").agg(
        F.max(F.when(role == "owner", F.col("nucleus_id"))).alias("owner_id"), F.count_if(role == "accepted_foreign").alias("accepted_foreign"),
        F.count_if(role == "unowned_foreign").alias("unowned_foreign"), F.max("vague").alias("ambiguous"))
    return g.withColumn("decision", first_reason(
        ("drop_ambiguous_envelope", F.col("ambiguous")), ("keep_without_owner", F.col("owner_id").isNull()),
        ("partition_accepted_foreign", F.col("accepted_foreign") > 0), ("barrier_unowned_foreign", F.col("unowned_foreign") > 0), default="keep"))


def consensus_owner(cells: DataFrame, lineage: DataFrame, records: DataFrame, accepted: DataFrame, axial: DataFrame) -> DataFrame:
    """Owner on which lineage, record, accepted list and axial decision agree; first failing reason.

    Each source has (field_id, cell_id, owner_id) except ``accepted``
    (field_id, owner_id) and ``axial`` (field_id, owner_id, keep).
    """
    j = (
        cells.select("field_id", "cell_id")
        .join(lineage.select("field_id", "cell_id", F.col("owner_id").alias("_lin")), ["field_id", "cell_id"], "left")
        .join(records.select("field_id", "cell_id", F.col("owner_id").alias("_rec")), ["field_id", "cell_id"], "left")
        .withColumn("owner_id", F.col("_lin"))
        .join(accepted.select("field_id", "owner_id").distinct().withColumn("_acc", F.lit(True)), ["field_id", "owner_id"], "left")
        .join(axial.select("field_id", "owner_id", F.col("keep").alias("_keep")), ["field_id", "owner_id"], "left")
    )
    claims = F.count("owner_id").over(Window.partitionBy("field_id", "owner_id"))
    j = j.withColumn("_claims", claims)
    why = first_reason(
        ("missing_lineage_owner", F.col("_lin").isNull()), ("missing_record_owner", F.col("_rec").isNull()),
        ("lineage_record_disagree", F.col("_lin") != F.col("_rec")), ("owner_not_accepted", F.col("_acc").isNull()),
        ("axial_rejected", ~F.coalesce("_keep", F.lit(True))), ("duplicate_owner_claim", F.col("_claims") > 1))
    return j.withColumn("reason", why).select("field_id", "cell_id", F.when(why.isNull(), F.col("owner_id")).alias("owner_id"), "reason")


# ----------------------------------------------------------- 2D projections


def exclusive_projection(voxels: DataFrame, pitch_um: dict[str, float], min_exclusive: float = 0.20) -> DataFrame:
    """Exclusive 2D labels of 3D owners: collisions go to the nearest exclusive area, then the lower id."""
    from rasterspark.operators.focal import nearest_seed

    cols = voxels.select(*AT, "height", "width", "label_id").distinct()
    owners = cols.groupBy(*AT, "height", "width").agg(F.count(F.lit(1)).alias("_n"), F.min("label_id").alias("_one"))
    px = cols.join(owners.select(*AT, "_n"), AT)
    share = px.groupBy("field_id", "label_id").agg((F.count_if(F.col("_n") == 1) / F.count(F.lit(1))).alias("_f"))
    kept = share.where(F.col("_f") >= min_exclusive).select("field_id", "label_id")
    live = cols.join(kept, ["field_id", "label_id"], "left_semi")
    n = live.groupBy(*AT, "height", "width").agg(F.count(F.lit(1)).alias("_n"), F.min("label_id").alias("label_id"))
    single = n.where(F.col("_n") == 1).drop("_n")
    clash = live.join(n.where(F.col("_n") > 1).select(*AT), AT, "left_semi")
    # Distance of each contested pixel to every contender's own exclusive area.
    from rasterspark.operators.zonal import label_distance

    d = label_distance(single, clash, pitch_um)
    w = Window.partitionBy(*AT).orderBy(F.col("distance").asc_nulls_last(), "label_id")
    won = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(*AT, "height", "width", "label_id")
    return single.select(*AT, "height", "width", "label_id").unionByName(won)


def majority_projection(voxels: DataFrame) -> DataFrame:
    """2D label with most voxels in the column, then the lower id."""
    n = voxels.groupBy(*AT, "label_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*AT).agg(F.max_by("label_id", F.struct("n", -F.col("label_id"))).alias("label_id"))


def validate_projection(projection: DataFrame, valid_ids: DataFrame, required_ids: DataFrame) -> DataFrame:
    """Ids that are unknown, or required but absent: (field_id, label_id, violation)."""
    k = ["field_id", "label_id"]
    seen = projection.select(*k).distinct()
    unknown = seen.join(valid_ids.select(*k), k, "left_anti").withColumn("violation", F.lit("unknown_id"))
    missing = required_ids.select(*k).distinct().join(seen, k, "left_anti").withColumn("violation", F.lit("missing_id"))
    return unknown.unionByName(missing)


def owner_priority(owner_px: DataFrame, all_px: DataFrame) -> DataFrame:
    """The accepted-owner projection overrides the all-valid projection."""
    j = owner_px.select(*AT, F.col("label_id").alias("_o")).join(all_px.select(*AT, F.col("label_id").alias("_a")), AT, "full_outer")
    return j.select(*AT, F.coalesce("_o", "_a").alias("label_id"))


# --------------------------------------------------------------- split choice


def split_owner_choice(pairs: DataFrame) -> DataFrame:
    """Owner of the cell to split: explicitly owned pool first, then the five-key order."""
    w = Window.partitionBy("field_id", "cell_id").orderBy(
        F.desc("explicit"), F.desc("soma_overlap"), F.desc("whole_overlap"), F.desc("accepted"), F.desc("confidence"), "nucleus_id")
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def split_candidate_choice(cands: DataFrame) -> DataFrame:
    """Best second nucleus of a cell, or the first refusal that applies to all of them.

    ``cands``: one row per (field_id, cell_id, nucleus_id) with distance_um,
    in_other_cell, overlap, centre_inside, separation_um, iou, projection_overlap,
    z_gap_um, confidence and soma_overlap.
    """
    ok_xy = (F.col("separation_um") >= 1.0) & (F.col("iou") <= 0.32) & (F.col("projection_overlap") <= 0.50)
    ok_z = (F.col("z_gap_um") >= 0.70) & (F.col("separation_um") >= 0.35)
    why = first_reason(
        ("too_far_from_cell", F.col("distance_um") > 2.75), ("belongs_to_another_cell", F.col("in_other_cell")),
        ("insufficient_overlap", F.col("overlap") < 0.35), ("centre_outside_cell", ~F.col("centre_inside")),
        ("not_separated_from_owner", ~(ok_xy | ok_z)))
    c = cands.withColumn("refusal", why)
    score = 0.45 * F.col("overlap") + 0.30 * F.col("confidence") + 0.25 * F.least(F.lit(1.0), F.col("separation_um") / 3.0)
    w = Window.partitionBy("field_id", "cell_id").orderBy(F.col("refusal").isNotNull(), F.desc("score"), "nucleus_id")
    best = c.withColumn("score", score).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return best.select("field_id", "cell_id", F.when(F.col("refusal").isNull(), F.col("nucleus_id")).alias("nucleus_id"), "score", "refusal")


def merge_split_candidates(canonical: DataFrame, proposals: DataFrame) -> DataFrame:
    """Canonical nuclei joined with model proposals; a matched one is locally confirmed.

    Both: (field_id, nucleus_id, z_min, z_max, confidence).
    """
    a, b = canonical.alias("a"), proposals.alias("b")
    j = a.join(b, (F.col("a.field_id") == F.col("b.field_id")) & (F.col("a.nucleus_id") == F.col("b.nucleus_id")), "full_outer")
    both = F.col("a.nucleus_id").isNotNull() & F.col("b.nucleus_id").isNotNull()
    return j.select(
        F.coalesce("a.field_id", "b.field_id").alias("field_id"), F.coalesce("a.nucleus_id", "b.nucleus_id").alias("nucleus_id"),
        F.coalesce("b.z_min", "a.z_min").alias("z_min"), F.coalesce("b.z_max", "a.z_max").alias("z_max"),
        F.greatest("a.confidence", "b.confidence").alias("confidence"), both.alias("locally_confirmed"),
        F.when(both, "both").when(F.col("a.nucleus_id").isNull(), "model").otherwise("canonical").alias("source"))


RECOVERABLE_REFUSALS = ("too_far_from_cell", "insufficient_overlap", "not_separated_from_owner", "no_candidate")


def nucleus_records(ids: DataFrame, records: DataFrame, z_shift: DataFrame | None = None) -> DataFrame:
    """One record per 2D nucleus: 3D records when complete for the field, else projection-only rows.

    ``ids``: (field_id, nucleus_id); ``records``: (field_id, nucleus_id, z_min,
    z_max, volume_um3, status).
    """
    j = ids.join(records.withColumn("_has", F.lit(1)), ["field_id", "nucleus_id"], "left")
    whole = F.min(F.coalesce("_has", F.lit(0))).over(Window.partitionBy("field_id")) == 1
    j = j.withColumn("_all", whole)
    if z_shift is not None:
        j = j.join(z_shift.select("field_id", F.col("z0").alias("_s")), "field_id", "left")
    shift = F.coalesce("_s", F.lit(0)) if z_shift is not None else F.lit(0)
    on = F.col("_all")
    return j.select(
        "field_id", "nucleus_id", F.when(on, F.col("z_min") + shift).alias("z_min"), F.when(on, F.col("z_max") + shift).alias("z_max"),
        F.when(on, F.col("volume_um3")).alias("volume_um3"), F.when(on, F.col("status")).otherwise("projection_only").alias("status"))


ALLOWED_STATUS = ("accepted", "rejected", "ambiguous", "unowned", "projection_only")


def check_nucleus_records(records: DataFrame, owners: DataFrame, whole_ids: DataFrame) -> DataFrame:
    """Violations: unknown status, an owner claimed twice, or an owner cell that does not exist."""
    bad = records.where(~F.col("status").isin(*ALLOWED_STATUS)).select("field_id", "nucleus_id", F.lit("status").alias("violation"))
    dup = owners.groupBy("field_id", "nucleus_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("field_id", "nucleus_id", F.lit("duplicate_owner").alias("violation"))
    lost = owners.join(whole_ids.select("field_id", "cell_id"), ["field_id", "cell_id"], "left_anti").select("field_id", "nucleus_id", F.lit("owner_not_in_whole").alias("violation"))
    return bad.unionByName(dup).unionByName(lost)
