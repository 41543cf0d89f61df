"""Queries of object evidence, quality gates and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterspark.operators import evidence, focal, zonal
from rasterspark.plans.match_queries import slice_labels
from rasterspark.plans.registry import joined, query, rounded, with_ctes
from rasterspark.sources import adapters as src

AT = ["field_id", "y", "x"]
PITCH = {"z": 0.3, "y": 0.25, "x": 0.25}


def nuclei_voxels(spark, d):
    """3D objects of the dense stack: blocks of bright voxels, one id per quadrant and depth slab."""
    s = src.dense_stack(spark, d).where(F.col("value") > -0.05)
    lab = F.floor(F.col("z") / 6) * 4 + F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4) + 1
    return s.where((F.col("y") % 4 < 3) & (F.col("x") % 4 < 3)).select("field_id", lab.cast("long").alias("label_id"), "z", "y", "x", "height", "width", F.lit(25).alias("depth"))


def stack_values(spark, d, scale=100.0):
    s = src.dense_stack(spark, d)
    return s.select("field_id", "z", "y", "x", ((F.col("value") + 1.0) * scale).alias("value"))


@query("e18_angular_coverage", with_ctes("dense") + """, o AS (SELECT field_id, (y // 10) * 8 + x // 8 AS label_id, y, x, value > .1 AS covered FROM dense WHERE value > 0),
c AS (SELECT field_id, label_id, avg(y) AS cy, avg(x) AS cx FROM o GROUP BY 1, 2),
s AS (SELECT o.*, CAST(least(11, floor(fmod(atan2(y - cy, x - cx) + 2 * pi(), 2 * pi()) * 12 / (2 * pi()))) AS INT) AS s FROM o JOIN c USING (field_id, label_id)),
g AS (SELECT field_id, label_id, s, avg(CAST(covered AS INT)) AS c FROM s GROUP BY 1, 2, 3)
SELECT field_id, CAST(label_id AS BIGINT) AS label_id, round(count(*) FILTER (WHERE c >= .2) / count(*), 6) + 0.0 AS angular_coverage FROM g GROUP BY 1, 2""")
def e18(spark, d):
    px = src.dense_plane(spark, d).where(F.col("value") > 0)
    o = px.select("field_id", (F.floor(F.col("y") / 10) * 8 + F.floor(F.col("x") / 8)).cast("long").alias("label_id"), "y", "x", (F.col("value") > 0.1).alias("covered"))
    return rounded(evidence.angular_coverage(o), "angular_coverage")


@query("e18_contact_sectors", with_ctes("dense") + """, o AS (SELECT field_id, (y // 10) * 8 + x // 8 AS label_id, y, x FROM dense WHERE value > .12),
s AS (SELECT field_id, label_id, CAST(least(11, floor(fmod(atan2(y - ((label_id // 8) * 10 + 4.3), x - ((label_id % 8) * 8 + 3.6)) + pi() / 12 + 2 * pi(), 2 * pi()) * 12 / (2 * pi()))) AS INT) AS s, count(*) AS n FROM o GROUP BY 1, 2, 3),
k AS (SELECT * FROM s WHERE n * .0625 >= .08), t AS (SELECT field_id, label_id, s FROM k UNION ALL SELECT field_id, label_id, s + 12 FROM k),
i AS (SELECT *, s - row_number() OVER (PARTITION BY field_id, label_id ORDER BY s) AS g FROM t), r AS (SELECT field_id, label_id, g, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT r.field_id, CAST(r.label_id AS BIGINT) AS label_id, any_value(c.n) AS supported, least(max(r.n), 12) AS longest FROM r JOIN (SELECT field_id, label_id, count(*) AS n FROM k GROUP BY 1, 2) c ON c.field_id = r.field_id AND c.label_id = r.label_id GROUP BY 1, 2""")
def e18c(spark, d):
    px = src.dense_plane(spark, d).where(F.col("value") > 0.12)
    o = px.select("field_id", (F.floor(F.col("y") / 10) * 8 + F.floor(F.col("x") / 8)).cast("long").alias("label_id"), "y", "x")
    k = F.col("label_id")
    c = o.select("field_id", "label_id").distinct().withColumns({"cy": F.floor(k / 8) * 10 + 4.3, "cx": k % 8 * 8 + 3.6})
    return evidence.contact_sectors(o, c, 0.0625)


@query("e19_nucleus_enclosure")
def e19(spark, d):
    v = nuclei_voxels(spark, d)
    core = v.select("field_id", "label_id", "y", "x").distinct()
    r = evidence.nucleus_enclosure(v, stack_values(spark, d), core, PITCH)
    nums = ["volume_um3", "projection_overlap", "surface_coverage", "boundary_coverage", "angular_coverage", "z_support", "shell_enrichment", "radial_bands", "enclosure"]
    return joined(rounded(r, *nums), "reasons").select("field_id", "label_id", *nums, "dapi_valid", "accepted", "reasons")


@query("e20_nucleus_inventory")
def e20(spark, d):
    s = src.dense_stack(spark, d)
    dapi = s.select("field_id", "z", "y", "x", "value", "height", "width", F.lit(25).alias("depth"))
    flat = s.groupBy(*AT, "height", "width").agg(F.max("value").alias("m"))
    cores = flat.where(F.col("m") > 0.27).withColumn("label_id", (F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4) + 1).cast("long"))
    whole = flat.where(F.col("m") > 0.2).select(*AT, "height", "width")
    o = evidence.nucleus_inventory(dapi, cores.drop("m"), whole, PITCH)
    return o.groupBy("field_id", "core_id", "object_id").agg(F.count(F.lit(1)).alias("voxels"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@query("e22_gfap_association")
def e22(spark, d):
    flat = src.dense_stack(spark, d).groupBy(*AT).agg(F.max("value").alias("m"))
    st = flat.select(*AT, F.greatest(F.col("m") * 2, F.lit(0.0)).alias("score"), (F.col("m") > 0.2).alias("structure"))
    r = evidence.gfap_association(nuclei_voxels(spark, d), stack_values(spark, d), st, PITCH)
    nums = ["shell_enrichment", "shell_support_um3", "supported_z_fraction", "anchored_area_um2", "anchored_reach_um"]
    return joined(rounded(r, *nums), "reasons")


@query("e23_weak_enrichment_fallback", with_ctes("objects") + """, a AS (SELECT field_id, object_id AS label_id, volume_um3 / 10 AS e, object_id % 40 = 0 AS ok, CASE WHEN object_id % 40 = 0 THEN '' WHEN object_id % 9 > 0 THEN 'weak_perinuclear_gfap_enrichment,x' ELSE 'weak_perinuclear_gfap_enrichment' END AS r FROM objects),
f AS (SELECT *, r = 'weak_perinuclear_gfap_enrichment' AND e >= 3.375 AS fit FROM a), w AS (SELECT *, bool_or(ok) OVER (PARTITION BY field_id) AS an, count(*) FILTER (WHERE fit) OVER (PARTITION BY field_id) AS k FROM f)
SELECT field_id, label_id, ok OR (fit AND NOT an AND k = 1) AS associated, fit AND NOT an AND k = 1 AS fallback, CASE WHEN fit AND NOT an AND k = 1 THEN '' ELSE r END AS reasons FROM w""")
def e23(spark, d):
    o, k = src.nuclei_objects(spark, d), F.col("object_id")
    weak = F.lit("weak_perinuclear_gfap_enrichment")
    why = F.when(k % 40 == 0, F.array().cast("array<string>")).when(k % 9 > 0, F.array(weak, F.lit("x"))).otherwise(F.array(weak))
    a = o.select("field_id", k.alias("label_id"), (F.col("volume_um3") / 10).alias("shell_enrichment"), (k % 40 == 0).alias("associated"), why.alias("reasons"))
    return joined(evidence.weak_enrichment_fallback(a), "reasons").drop("shell_enrichment")


def shape_rows(spark, d):
    """Parts as component shape records."""
    k, v = F.col("p_partkey"), F.col("p_size")
    return src.table(spark, d, "part").select(
        F.floor(k / 25).cast("string").alias("field_id"), k.alias("label_id"), (v * 20).cast("long").alias("area"), (k % 3 == 0).alias("touches_border"), (k % 17 / 17).alias("thin_fraction"),
        (k % 23 / 23).alias("solidity"), (1 + k % 11 / 4).alias("axis_ratio"), (v * 4 + k % 7).cast("double").alias("skeleton_px"), (k % 9).alias("endpoints"), (k % 5).alias("branchpoints"), (k % 4).alias("nuclei"))


_EV = lambda v, lo, hi: f"greatest(0, least(1, ({v} - {lo}) / ({hi} - {lo})))"


@query("e24_age_profile", f"""WITH c AS (SELECT CAST(p_partkey // 25 AS VARCHAR) AS field_id, p_partkey AS id, p_size * 20 AS area, p_partkey % 3 = 0 AS tb, p_partkey % 17 / 17 AS th, p_partkey % 23 / 23 AS so, 1 + p_partkey % 11 / 4 AS ax,
  greatest(p_size * 4 + p_partkey % 7, 1) AS sk, p_partkey % 9 AS ep, p_partkey % 5 AS br, p_partkey % 4 AS nu FROM part),
n AS (SELECT *, count(*) FILTER (WHERE area >= 32) OVER w AS nb, count(*) FILTER (WHERE area >= 32 AND NOT tb) OVER w AS ni FROM c WINDOW w AS (PARTITION BY field_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY area DESC, id) AS r FROM n WHERE CASE WHEN ni >= 3 THEN area >= 32 AND NOT tb WHEN nb > 0 THEN area >= 32 ELSE true END),
m AS (SELECT field_id, count(*) AS components, median(area / sk) AS w, median(th) AS th, median(so) AS so, median(ax) AS ax, median(10 * br / sk) AS br, median(10 * ep / sk) AS ep, avg(CAST(nu >= 2 AS INT)) AS mn FROM u WHERE r <= 24 GROUP BY 1),
s AS (SELECT *, round(.26 * {_EV('w', .95, 2.2)} + .2 * {_EV('so', .24, .54)} + .18 * (1 - {_EV('th', .62, .88)}) + .16 * (1 - {_EV('br', .14, .5)}) + .1 * {_EV('ax', 1.7, 3.2)} + .1 * {_EV('mn', .05, .3)}, 6) AS score FROM m)
SELECT field_id, components, round(w, 6) + 0.0 AS width_um, round(th, 6) + 0.0 AS thin_fraction, round(br, 6) + 0.0 AS branch_density, score, CASE WHEN score >= .55 THEN 'neonatal' ELSE 'mature' END AS profile FROM s""")
def e24(spark, d):
    r = evidence.age_profile(shape_rows(spark, d))
    return rounded(r, "width_um", "thin_fraction", "branch_density").select("field_id", "components", "width_um", "thin_fraction", "branch_density", "score", "profile")


@query("b23_age_parameter_set", with_ctes("sparse") + """, m AS (SELECT field_id, channel, avg(value) AS a FROM sparse GROUP BY 1, 2), f AS (SELECT field_id, avg(value) AS fa FROM sparse GROUP BY 1),
c AS (SELECT field_id, bool_or(channel = 'eGFP') AS e, bool_or(channel = 'GFAP') AS g FROM m JOIN f USING (field_id) WHERE a >= fa GROUP BY 1)
SELECT field_id, CASE WHEN e AND g THEN 'egfp_gfap' WHEN e THEN 'egfp_only' END AS parameter_set FROM c""")
def b23(spark, d):
    """A channel counts as recorded where it is at least as bright on average as the whole field."""
    px = src.sparse_stack(spark, d)
    field = px.groupBy("field_id").agg(F.avg("value").alias("_f"))
    bright = px.groupBy("field_id", "channel").agg(F.avg("value").alias("_c")).join(field, "field_id").where(F.col("_c") >= F.col("_f"))
    return evidence.age_parameter_set(px.join(bright.select("field_id", "channel"), ["field_id", "channel"], "left_semi"))


def cell_shapes(spark, d):
    k, v = F.col("p_partkey"), F.col("p_size")
    odd = k % 25 == 7
    return src.table(spark, d, "part").select(
        F.floor(k / 25).cast("string").alias("field_id"), k.alias("cell_id"), F.when(odd, 40).otherwise(2000 + k % 9 * 10).cast("long").alias("area_px"), F.when(odd, 5.0).otherwise(200.0 + v).alias("area_um2"),
        F.when(odd, 0.4).otherwise(2.0 + k % 5 / 10).alias("core_um"), F.when(odd, 2.0).otherwise(80.0 + k % 13).alias("skeleton_um"), F.when(odd, 0).otherwise(6 + k % 4).alias("branchpoints"),
        F.when(odd, 1).otherwise(8 + k % 5).alias("endpoints"), F.when(odd, 0.95).otherwise(0.30 + k % 7 / 100).alias("solidity"), F.when(odd, 6.0).otherwise(1.5 + k % 6 / 10).alias("axis_ratio"),
        F.when(odd, -0.2).otherwise(0.3 + k % 8 / 100).alias("contrast"), F.when(odd, 0.1).otherwise(0.7 + k % 3 / 100).alias("process_fraction"), F.when(odd, 0).otherwise(1).alias("anchors"), (k % 50 == 7).alias("protected"))


@query("e25_morphology_outliers", """SELECT CAST(p_partkey // 25 AS VARCHAR) AS field_id, p_partkey AS cell_id, CASE WHEN p_partkey % 25 = 7 THEN 'small_elongated_morphology_outlier' END AS reason, p_partkey % 25 = 7 AND p_partkey % 50 <> 7 AS removed FROM part""")
def e25(spark, d):
    return evidence.morphology_outliers(cell_shapes(spark, d)).select("field_id", "cell_id", "reason", "removed")


@query("e26_valid_soma_gate", """WITH c AS (SELECT CAST(p_partkey // 25 AS VARCHAR) AS field_id, p_partkey AS cell_id, CASE WHEN p_partkey % 13 = 0 THEN 'unresolved_multi_soma_instance_split' WHEN p_partkey % 5 = 0 OR p_size = 1 THEN 'no_valid_soma' WHEN p_partkey % 5 = 2 THEN 'multiple_valid_somata_after_instance_split'
  WHEN p_partkey % 7 <> 1 AND p_partkey % 7 > 4 THEN 'disconnected_soma_geometry' WHEN p_partkey % 11 = 0 THEN 'empty_processes_compartment' END AS reason FROM part)
SELECT field_id, cell_id, reason, CASE WHEN reason IS NULL THEN count(*) FILTER (WHERE reason IS NULL) OVER (PARTITION BY field_id ORDER BY cell_id) END AS new_id FROM c""")
def e26(spark, d):
    k = F.col("p_partkey")
    c = src.table(spark, d, "part").select(
        F.floor(k / 25).cast("string").alias("field_id"), k.alias("cell_id"), F.when(k % 5 == 0, 0).when(k % 5 == 2, 2).otherwise(1).alias("anchors"), (F.col("p_size") - 1).alias("soma_px"), (k % 11).alias("process_px"),
        F.when(k % 7 > 4, 2).otherwise(1).alias("soma_components"), (k % 13 == 0).alias("unresolved"))
    return evidence.valid_soma_gate(c).select("field_id", "cell_id", "reason", "new_id")


@query("e26_soma_components", with_ctes("cells") + "SELECT DISTINCT field_id, cell_id, 1 AS soma_components FROM cells")
def e26s(spark, d):
    return evidence.soma_components(src.compartments(spark, d))


@query("e27_post_compartment_quality", with_ctes("cells") + """, f AS (SELECT a.field_id, a.cell_id, a.y, a.x, min((a.y - b.y) ** 2 * .25 + (a.x - b.x) ** 2 * .25) AS t FROM cells a JOIN cells b ON a.field_id = b.field_id AND b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3
  AND (b.cell_id <> a.cell_id OR b.part = 'soma') WHERE a.part = 'processes' AND a.field_id = (SELECT min(field_id) FROM cells) GROUP BY 1, 2, 3, 4),
h AS (SELECT *, max(t) OVER (PARTITION BY cell_id) AS mt FROM f),
s AS (SELECT h.cell_id, sqrt(any_value(mt)) AS max_thickness_um, count(DISTINCT h.y * 32 + h.x) AS hub_px, sqrt(min((h.y - c.y) ** 2 * .25 + (h.x - c.x) ** 2 * .25)) AS hub FROM h JOIN cells c ON c.field_id = h.field_id AND c.cell_id = h.cell_id AND c.part = 'soma' WHERE t >= mt - 1e-9 GROUP BY 1),
g AS (SELECT field_id, cell_id, count(*) FILTER (WHERE part = 'processes') / count(*) AS process_fraction, CAST(count(*) FILTER (WHERE part = 'processes') * .25 AS DOUBLE) AS process_area_um2, bool_or(y IN (0, 31) OR x IN (0, 31)) AS incomplete FROM cells GROUP BY 1, 2)
SELECT field_id, cell_id, process_fraction, process_area_um2, incomplete, round(hub, 6) + 0.0 AS hub_distance_um, round(max_thickness_um, 6) + 0.0 AS max_thickness_um, hub_px, CASE WHEN process_area_um2 < 15 THEN 'assigned_process_area_below_minimum' ELSE '' END AS reasons FROM g JOIN s USING (cell_id)""")
def e27(spark, d):
    r = evidence.post_compartment_quality(src.compartments(spark, d), {"y": 0.5, "x": 0.5})
    return joined(rounded(r, "hub_distance_um", "max_thickness_um"), "reasons").drop("soma_border")


@query("e29_axial_truncation")
def e29(spark, d):
    v = nuclei_voxels(spark, d).where(F.col("z").between(6, 17))
    own = v.groupBy("field_id", "label_id").agg((F.count(F.lit(1)) * 0.3 * 0.0625).alias("volume_um3"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    own = own.withColumns({"cell_id": F.col("label_id"), "threshold": F.lit(95.0)})
    win = v.select("field_id").distinct().withColumns({"z0": F.lit(6), "z1": F.lit(17), "depth": F.lit(25)})
    ext = v.select("field_id", "label_id", "y", "x", "height", "width").distinct()
    return rounded(evidence.axial_truncation(own, ext, stack_values(spark, d), win, PITCH), "outside_um3", "boundary_ratio")


@query("b20_nuclei_core_extent")
def b20(spark, d):
    core, extent = evidence.nuclei_core_extent(focal.gaussian(src.dense_plane(spark, d), 2.0), 1.0, 20)
    both = core.withColumn("part", F.lit("core")).unionByName(extent.withColumn("part", F.lit("extent")))
    return both.select(*AT, "part")


@query("h10_anchor_groups")
def h10(spark, d):
    k = F.col("nucleus_id")
    n = src.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("field_id"), F.col("l_linenumber").alias("component_id"), (F.col("l_partkey") % 12).alias("nucleus_id")).agg(
        F.round(0.5 + F.max("l_quantity") / 100, 4).alias("score"))
    n = n.withColumns({"thickness": 0.6 + k / 30, "structure": 0.3 + k / 20, "overlap": 0.3 + k / 15, "model": F.lit(0.0), "cy_um": (k % 4 * 4).cast("double"), "cx_um": (F.floor(k / 4) * 5).cast("double")})
    return joined(evidence.anchor_groups(n), "nucleus_ids")


@query("h10_validated_anchor_groups", with_ctes("objects") + """, g AS (SELECT field_id, component_2d AS component_id, object_id AS group_id, object_id * 7 % 40 AS overlap_px, enclosure AS score FROM objects WHERE accepted AND object_id * 7 % 40 >= 5)
SELECT field_id, component_id, group_id, overlap_px, row_number() OVER (PARTITION BY field_id, component_id ORDER BY overlap_px DESC, score DESC, group_id) AS position FROM g""")
def h10v(spark, d):
    o, k = src.nuclei_objects(spark, d), F.col("object_id")
    g = o.select("field_id", F.col("component_2d").alias("component_id"), k.alias("group_id"), (k * 7 % 40).alias("overlap_px"), F.col("enclosure").alias("score"), "accepted")
    return evidence.validated_anchor_groups(g, 5).select("field_id", "component_id", "group_id", "overlap_px", "position")


@query("g16_marker_for_group", with_ctes("dense") + """, c AS (SELECT field_id, CAST((y // 10) * 8 + x // 8 AS BIGINT) AS component_id, y, x, abs(value) AS dp, value AS s FROM dense),
sc AS (SELECT field_id, component_id, greatest(quantile_cont(dp, .99), 1e-6) AS sc FROM c GROUP BY 1, 2),
e AS (SELECT field_id, CAST((y // 25) * 2 + x // 32 AS BIGINT) AS label_id, y, x FROM dense WHERE value > .3),
nr AS (SELECT c.*, label_id, min((c.y - e.y) ** 2 * .0625 + (c.x - e.x) ** 2 * .0625) AS d2 FROM c JOIN e ON c.field_id = e.field_id AND abs(c.y - e.y) <= 3 AND abs(c.x - e.x) <= 3 GROUP BY ALL HAVING d2 <= .5625 + 1e-9),
sd AS (SELECT field_id, component_id, label_id, arg_max({'y': y, 'x': x}, (round(.58 * greatest(0, least(1, dp / sc)) + .27 * s + .15 * exp(-d2 / .5625), 12), -y, -x)) AS p FROM nr JOIN sc USING (field_id, component_id) GROUP BY 1, 2, 3)
SELECT sd.field_id, sd.component_id, label_id, c.y, c.x FROM sd CROSS JOIN (SELECT unnest([0, 1, -1, 0, 0]) AS dy, unnest([0, 0, 0, 1, -1]) AS dx) JOIN c ON c.field_id = sd.field_id AND c.component_id = sd.component_id AND c.y = p.y + dy AND c.x = p.x + dx""")
def g16(spark, d):
    px = src.dense_plane(spark, d)
    c = px.select("field_id", (F.floor(F.col("y") / 10) * 8 + F.floor(F.col("x") / 8)).cast("long").alias("component_id"), "y", "x", F.abs("value").alias("depth_um"), F.col("value").alias("s"))
    e = px.where(F.col("value") > 0.3).select("field_id", (F.floor(F.col("y") / 25) * 2 + F.floor(F.col("x") / 32)).cast("long").alias("label_id"), "y", "x", "height", "width")
    return evidence.marker_for_group(c, e, (0.25, 0.25))


@query("f20_resolve_owners")
def f20(spark, d):
    from rasterspark.plans.routes import resolve_owners

    flat = src.dense_stack(spark, d).groupBy(*AT).agg(F.max("value").alias("m"))
    st = flat.select(*AT, F.greatest(F.col("m") * 2, F.lit(0.0)).alias("score"), (F.col("m") > 0.2).alias("structure"))
    labels = slice_labels(spark, d).withColumn("depth", F.lit(25))
    return resolve_owners(labels, stack_values(spark, d), st, PITCH).drop("height", "width")


@query("e03_thickness", with_ctes("dense") + """, a AS (SELECT field_id, y, x, CAST((y // 10) * 8 + x // 8 AS BIGINT) AS l FROM dense WHERE value > -.1), al AS (SELECT d.field_id, d.y, d.x, coalesce(l, -1) AS l FROM dense d LEFT JOIN a USING (field_id, y, x))
SELECT a.field_id, a.l AS label_id, a.y, a.x, round(sqrt(min((a.y - b.y) ** 2 * .25 + (a.x - b.x) ** 2 * .0625)), 6) + 0.0 AS thickness FROM a JOIN al b ON a.field_id = b.field_id AND b.l <> a.l AND abs(a.y - b.y) <= 10 AND abs(a.x - b.x) <= 16 GROUP BY 1, 2, 3, 4""")
def e03t(spark, d):
    px = src.dense_plane(spark, d)
    lab = px.where(F.col("value") > -0.1).select("field_id", (F.floor(F.col("y") / 10) * 8 + F.floor(F.col("x") / 8)).cast("long").alias("label_id"), "y", "x", "height", "width")
    return rounded(zonal.thickness(lab, {"y": 0.5, "x": 0.25}, raster=px), "thickness").select("field_id", "label_id", "y", "x", "thickness")

