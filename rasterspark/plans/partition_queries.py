"""Queries of growth, partition, completion and requested edits on block cells of the dense raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterspark.operators import focal, graph, partition, zonal
from rasterspark.plans.focal_queries import top_mask, wide_background, wide_mask
from rasterspark.plans.graph_queries import comp_sql
from rasterspark.plans.registry import query, rounded, with_ctes
from rasterspark.session import cut_lineage
from rasterspark.sources import adapters as src

AT = ["field_id", "y", "x"]
PX = [*AT, "height", "width"]
UM = (0.25, 0.25)


def _block(y, x):
    return (F.floor(y / 25) * 2 + F.floor(x / 32) + 1).cast("long")


def smap(spark, d):
    return src.dense_plane(spark, d).select(*PX, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") + 0.5)).alias("s"))


def cells(spark, d):
    """Four block cells per field made of all but the darkest pixels."""
    px = src.dense_plane(spark, d).where((F.col("value") > -0.1) & (F.col("y") % 25 > 0) & (F.col("x") % 32 > 0))
    return px.select(*PX, _block(F.col("y"), F.col("x")).alias("cell_id"))


def disc(spark, d, cy, cx, r, name="label_id"):
    """One disc per block, at block-local (cy, cx)."""
    px = src.dense_plane(spark, d)
    dy, dx = F.col("y") % 25 - cy, F.col("x") % 32 - cx
    return px.where(dy * dy + dx * dx <= r * r).select(*PX, _block(F.col("y"), F.col("x")).alias(name))


def regions(spark, d):
    c = cells(spark, d)
    near = disc(spark, d, 12, 16, 5).select(*AT, F.lit("soma").alias("_p"))
    return c.join(near, AT, "left").withColumn("part", F.coalesce("_p", F.lit("processes"))).drop("_p")


_CELLS = """cells AS (SELECT field_id, y, x, CAST((y // 25) * 2 + x // 32 + 1 AS BIGINT) AS cell_id FROM dense WHERE value > -.1 AND y % 25 > 0 AND x % 32 > 0),
reg AS (SELECT *, CASE WHEN (y % 25 - 12) ** 2 + (x % 32 - 16) ** 2 <= 25 THEN 'soma' ELSE 'processes' END AS part FROM cells)"""


def summary(df, *keys):
    return df.groupBy("field_id", *keys).agg(F.count(F.lit(1)).alias("pixels"))


@query("b13_log1p_gmm_mask")
def b13(spark, d):
    px = src.dense_plane(spark, d).withColumn("value", F.when(F.col("value") > 0.12, 900.0).otherwise(100.0) * (1.0 + F.col("value")))
    return partition.log1p_gmm_mask(px, zonal.gmm_log1p_threshold(px))[0].select(*AT)


@query("e07_anchor_mask", with_ctes("dense") + """, q AS (SELECT field_id, quantile_cont(value, .74) AS c FROM dense GROUP BY 1),
m AS (SELECT field_id, y, x FROM dense JOIN q USING (field_id) WHERE value > -.1 AND value >= c AND (y % 25 - 12) ** 2 + (x % 32 - 16) ** 2 <= 64)
SELECT field_id, count(*) AS pixels FROM m GROUP BY 1""")
def e07m(spark, d):
    s = src.dense_plane(spark, d).withColumnRenamed("value", "s")
    cut = zonal.exact_quantiles(s, ["field_id"], "s", {"_c": 0.74})
    near = disc(spark, d, 12, 16, 8)
    return summary(wide_mask(spark, d).join(near.select(*AT), AT, "left_semi").join(s.join(cut, "field_id").where(F.col("s") >= F.col("_c")).select(*AT), AT, "left_semi"))


@query("e07_dapi_supported_anchor", with_ctes("dense", extra="""s AS (SELECT field_id, y, x, value, greatest(0, least(1, value + .5)) AS s FROM dense), q AS (SELECT field_id, quantile_cont(s, .45) AS c FROM s GROUP BY 1),
m AS (SELECT field_id, y, x FROM s JOIN q USING (field_id) WHERE value > -.1 AND s >= c AND (y % 25 - 12) ** 2 + (x % 32 - 16) ** 2 <= 64),""" + comp_sql("cc", "m", False)) + """
SELECT field_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY field_id, label_id) AS n FROM cc) WHERE n >= 40""")
def e07d(spark, d):
    return zonal.dapi_supported_anchor(wide_mask(spark, d), disc(spark, d, 12, 16, 8), smap(spark, d), 40, 0.45).select(*AT)


@query("g06_anchor_cleanup")
def g06(spark, d):
    return partition.anchor_cleanup(top_mask(spark, d, 0.05), disc(spark, d, 12, 16, 5), smap(spark, d), "hybrid_reconstruct", 1, 0.8, 0.6).select(*AT)


@query("g07_refine_fused", with_ctes("dense") + """, s AS (SELECT field_id, y, x, greatest(0, least(1, value + .5)) AS s, value FROM dense), q AS (SELECT field_id, quantile_cont(s, .9) AS c FROM s GROUP BY 1),
br AS (SELECT field_id, y, x FROM s JOIN q USING (field_id) WHERE s >= c), o2 AS (SELECT dy, dx FROM (SELECT unnest(range(5)) - 2 AS dy), (SELECT unnest(range(5)) - 2 AS dx) WHERE dy * dy + dx * dx <= 4),
sp AS (SELECT DISTINCT field_id, y + dy AS y, x + dx AS x FROM br, o2), bg AS (SELECT field_id, y, x FROM dense WHERE value <= -.1),
th AS (SELECT a.field_id, a.y, a.x, min((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d2 FROM s a JOIN bg b ON a.field_id = b.field_id WHERE a.value > -.1 GROUP BY 1, 2, 3),
nr AS (SELECT DISTINCT field_id, y + dy AS y, x + dx AS x FROM (SELECT field_id, y, x FROM dense WHERE (y % 25 - 12) ** 2 + (x % 32 - 16) ** 2 <= 9), o2)
SELECT field_id, y, x FROM th WHERE d2 <= 1 UNION SELECT field_id, y, x FROM s SEMI JOIN sp USING (field_id, y, x) WHERE value > -.1 UNION SELECT field_id, y, x FROM s SEMI JOIN nr USING (field_id, y, x) WHERE value > -.1""")
def g07(spark, d):
    return partition.refine_fused(
        wide_mask(spark, d), smap(spark, d), disc(spark, d, 12, 16, 3), 0.9, 1.0, 2, wide_background(spark, d)).select(*AT)


@query("g07_artifact_filter")
def g07a(spark, d):
    return partition.artifact_filter(top_mask(spark, d, 0.05), disc(spark, d, 12, 16, 3), 30, 4, 0.8, 8.0).select(*AT)


@query("g07_refine_with_prior")
def g07p(spark, d):
    return partition.refine_with_prior(top_mask(spark, d, 0.1), disc(spark, d, 12, 16, 4), smap(spark, d), disc(spark, d, 12, 16, 3), 6).select(*AT)


@query("g07_postprocess_without_prior")
def g07w(spark, d):
    return partition.postprocess_without_prior(top_mask(spark, d, 0.05), disc(spark, d, 12, 16, 3), 40).select(*AT)


def _evidence(spark, d):
    return src.dense_channels(spark, d).where(F.col("value") > 0.15).select("field_id", "channel", "y", "x", "height", "width")


@query("g08_channel_consensus", with_ctes("dense", "dense2", extra="""ev AS (SELECT DISTINCT field_id, channel, y, x FROM dense2 WHERE value > .15), o AS (SELECT unnest([-1, 0, 0, 0, 1]) AS dy, unnest([0, -1, 0, 1, 0]) AS dx),
ag AS (SELECT field_id, y + dy AS y, x + dx AS x FROM ev, o GROUP BY ALL HAVING count(DISTINCT channel) = 2), fl AS (SELECT DISTINCT field_id, y, x FROM ev),
bo AS (SELECT * FROM fl SEMI JOIN ag USING (field_id, y, x)), sg AS (SELECT * FROM fl ANTI JOIN ag USING (field_id, y, x)),
nr AS (SELECT DISTINCT field_id, y + dy AS y, x + dx AS x FROM (SELECT * FROM bo UNION SELECT field_id, y, x FROM dense WHERE (y % 25 - 12) ** 2 + (x % 32 - 16) ** 2 <= 9), o),""" + comp_sql("cc", "sg")) + """
SELECT field_id, y, x FROM bo UNION ALL SELECT field_id, y, x FROM cc SEMI JOIN (SELECT DISTINCT field_id, label_id FROM cc SEMI JOIN nr USING (field_id, y, x)) h USING (field_id, label_id)""")
def g08(spark, d):
    return partition.channel_consensus(_evidence(spark, d), disc(spark, d, 12, 16, 3)).select(*AT)


@query("g09_topology_continuity")
def g09(spark, d):
    lab = cut_lineage(graph.components(top_mask(spark, d, 0.12), dense=False))
    lines = lab.join(graph.component_sizes(lab).withColumnRenamed("pixels", "skeleton_px"), ["field_id", "label_id"])
    return partition.topology_continuity(disc(spark, d, 12, 16, 4), lines, top_mask(spark, d, 0.0), 2, 4, 2).select(*AT)


@query("g10_recover_branches")
def g10(spark, d):
    f = cut_lineage(focal.branch_features(src.dense_channels(spark, d), keys=["field_id", "channel"]))
    return partition.recover_branches(disc(spark, d, 12, 16, 4), f, 0.7, 0.6, 4, 3.0, 0.5).select(*AT)


@query("g11_restore_gaps")
def g11(spark, d):
    c = cells(spark, d).withColumnRenamed("cell_id", "component_id")
    return summary(partition.restore_gaps(c, smap(spark, d), disc(spark, d, 12, 16, 3), UM), "component_id")


@query("g12_split_touching")
def g12(spark, d):
    c = cells(spark, d).withColumn("component_id", F.floor((F.col("cell_id") - 1) / 2).cast("long")).drop("cell_id")
    a = disc(spark, d, 12, 16, 3).withColumn("component_id", F.floor((F.col("label_id") - 1) / 2).cast("long"))
    a = a.join(c.select(*AT, "component_id"), [*AT, "component_id"], "left_semi")
    depth = focal.inside_distance(cells(spark, d).select(*PX), {"x": 0.25, "y": 0.25})
    return summary(partition.split_touching(c, a, smap(spark, d), depth, 0.0625, 2.0, 0.12, 5.0, 5.0)[0], "component_id", "label_id")


@query("g13_exclusive_structure")
def g13(spark, d):
    z = src.dense_plane(spark, d).select(*AT, (F.col("y") % 9).cast("double").alias("peak_z"))
    soma = disc(spark, d, 12, 16, 3)
    ranges = soma.select("field_id", "label_id").distinct().withColumns({"z_min": F.col("label_id") * 2 - 2, "z_max": F.col("label_id") * 2})
    rival = disc(spark, d, 12, 26, 2).withColumn("label_id", F.col("label_id") + 100)
    return summary(partition.exclusive_structure(soma, top_mask(spark, d, 0.05), smap(spark, d), UM, rival, z, ranges), "cell_id")


@query("g14_build_soma", with_ctes("dense") + """, s AS (SELECT field_id, y, x, greatest(0, least(1, value + .5)) AS s FROM dense), q AS (SELECT field_id, quantile_cont(s, .38) AS c FROM s WHERE s > 0 GROUP BY 1),
n AS (SELECT field_id, y, x, CAST((y // 25) * 2 + x // 32 + 1 AS BIGINT) AS l FROM dense WHERE (y % 25 - 12) ** 2 + (x % 32 - 16) ** 2 <= 9),
d AS (SELECT s.field_id, s.y, s.x, s.s, n.l, min((s.y - n.y) ** 2 + (s.x - n.x) ** 2) * .0625 AS d2 FROM s JOIN n ON s.field_id = n.field_id GROUP BY 1, 2, 3, 4, 5)
SELECT d.field_id, l AS label_id, count(*) AS pixels FROM d JOIN q USING (field_id) WHERE d2 <= .64 + 1e-9 OR (d2 <= 1.5625 + 1e-9 AND s >= c) GROUP BY 1, 2""")
def g14(spark, d):
    return summary(partition.build_soma(disc(spark, d, 12, 16, 3), smap(spark, d), UM, closing_um=0.0), "label_id")


@query("g15_soma_partition")
def g15(spark, d):
    r, _ = partition.soma_partition(cells(spark, d), disc(spark, d, 12, 16, 3, "cell_id"), smap(spark, d), UM)
    return summary(r, "cell_id", "part")


@query("f13_complete_soma_in_whole", with_ctes("dense", extra=_CELLS) + """, ext AS (SELECT field_id, y, x, cell_id FROM reg WHERE part = 'soma'
  UNION SELECT field_id, y, x, cell_id FROM cells WHERE (y % 25 - 12) ** 2 + (x % 32 - 16) ** 2 <= 5.2 * 5.2),
e AS (SELECT field_id, cell_id, count(*) AS e, count(*) FILTER (part = 'soma') AS s FROM ext JOIN reg USING (field_id, y, x, cell_id) GROUP BY 1, 2),
n AS (SELECT field_id, cell_id, count(*) FILTER (part = 'soma') AS so, count(*) FILTER (part = 'processes') AS pr FROM reg GROUP BY 1, 2),
ok AS (SELECT field_id, cell_id FROM e JOIN n USING (field_id, cell_id) WHERE so > 0 AND s >= .7 * e AND e > s AND e - s <= .15 * so AND e - s < pr)
SELECT r.field_id, r.cell_id, CASE WHEN r.part = 'soma' OR (ok.cell_id IS NOT NULL AND x.cell_id IS NOT NULL) THEN 'soma' ELSE 'processes' END AS part, count(*) AS pixels
FROM reg r LEFT JOIN ok ON ok.field_id = r.field_id AND ok.cell_id = r.cell_id LEFT JOIN ext x ON x.field_id = r.field_id AND x.y = r.y AND x.x = r.x GROUP BY 1, 2, 3""")
def f13(spark, d):
    r = regions(spark, d)
    ext = r.where(F.col("part") == "soma").select(*AT, "cell_id").unionByName(
        cells(spark, d).join(disc(spark, d, 12, 16, 5.2).select(*AT), AT, "left_semi").select(*AT, "cell_id")).distinct()
    return summary(partition.complete_soma_in_whole(r, ext)[0], "cell_id", "part")


@query("f14_complete_soma_to_owner", with_ctes("dense", extra=_CELLS) + """, f AS (SELECT field_id, y, x FROM dense WHERE (y % 25 - 18) ** 2 + (x % 32 - 24) ** 2 <= 4),
pl AS (SELECT field_id, y, x, CAST((y // 25) * 2 + x // 32 + 1 AS BIGINT) AS cell_id FROM dense WHERE (y % 25 - 12) ** 2 + (x % 32 - 16) ** 2 <= 36),
an AS (SELECT DISTINCT field_id, cell_id FROM reg WHERE part = 'soma'),
nr AS (SELECT DISTINCT p.field_id, p.cell_id FROM pl p ANTI JOIN cells c ON c.field_id = p.field_id AND c.y = p.y AND c.x = p.x
  JOIN f ON f.field_id = p.field_id AND ((f.y - p.y) ** 2 + (f.x - p.x) ** 2) * .0625 <= 1.1 * 1.1)
SELECT c.field_id, c.cell_id, CASE WHEN an.cell_id IS NULL THEN 'missing_anchor' WHEN nr.cell_id IS NOT NULL THEN 'foreign_nucleus_contact' ELSE 'completed' END AS status
FROM (SELECT DISTINCT field_id, cell_id FROM cells) c LEFT JOIN an USING (field_id, cell_id) LEFT JOIN nr USING (field_id, cell_id)""")
def f14(spark, d):
    none = top_mask(spark, d, 10.0)
    _, dec = partition.complete_soma_to_owner(regions(spark, d), disc(spark, d, 12, 16, 6, "cell_id"), disc(spark, d, 12, 16, 2, "cell_id"), disc(spark, d, 18, 24, 2), none, UM)
    return dec


@query("f15_rejoin_soma_islands")
def f15(spark, d):
    r = regions(spark, d)
    gap = (F.col("part") == "soma") & (F.col("x") % 32 == 19)
    r = r.withColumn("part", F.when(gap, "processes").otherwise(F.col("part")))
    return partition.rejoin_soma_islands(r, disc(spark, d, 20, 29, 2), UM, 0.6, 0.08, 0.5)[1]


@query("f16_prune_foreign_tips")
def f16(spark, d):
    c = cells(spark, d)
    skel = c.where((F.col("y") % 25 == 12) | (F.col("x") % 32 == 16)).select(*PX, "cell_id")
    return partition.prune_foreign_tips(regions(spark, d), disc(spark, d, 12, 29, 3), skel)[1]


@query("i08_edit_split")
def i08(spark, d):
    a = disc(spark, d, 12, 10, 2, "cell_id").withColumn("label_id", F.lit(1).cast("long"))
    b = disc(spark, d, 12, 22, 2, "cell_id").withColumn("label_id", F.lit(2).cast("long"))
    r = regions(spark, d)
    req = r.select("field_id", "cell_id").distinct().where(F.col("cell_id") <= 3)
    out, _ = partition.edit_split(r, req, a.unionByName(b).select(*AT, "cell_id", "label_id"), smap(spark, d), UM)
    return summary(out, "cell_id", "part")


@query("i09_edit_enlarge")
def i09(spark, d):
    r = regions(spark, d)
    req = r.select("field_id", "cell_id").distinct()
    return rounded(partition.edit_enlarge(r, req, disc(spark, d, 12, 16, 5, "cell_id"), disc(spark, d, 12, 29, 2), smap(spark, d), UM)[1], "soma_um2")


@query("i13_reconcile_identity")
def i13(spark, d):
    from rasterspark.plans.routes import reconcile_identity

    r = regions(spark, d)
    wide = disc(spark, d, 12, 16, 4).withColumn("label_id", F.floor((F.col("label_id") - 1) / 2).cast("long"))
    return summary(reconcile_identity(r, wide, UM), "cell_id", "part")


@query("i14_finalize_cells")
def i14(spark, d):
    from rasterspark.plans.routes import finalize_cells

    r = regions(spark, d)
    ext = disc(spark, d, 12, 16, 5.2, "cell_id")
    out = finalize_cells(r, disc(spark, d, 12, 16, 4), ext, disc(spark, d, 12, 16, 2, "cell_id"), disc(spark, d, 20, 29, 2), top_mask(spark, d, 10.0), UM)
    return summary(out, "cell_id", "part")


@query("i17_child_gates")
def i17(spark, d):
    c = regions(spark, d)
    a = disc(spark, d, 12, 10, 2, "cell_id").withColumn("label_id", F.lit(1).cast("long"))
    b = disc(spark, d, 12, 22, 2, "cell_id").withColumn("label_id", F.lit(2).cast("long"))
    seeds = a.unionByName(b).select(*AT, "cell_id", "label_id").join(c.select(*AT, "cell_id"), [*AT, "cell_id"], "left_semi")
    part = c.where(F.col("y") % 2 == 0).select("field_id", "cell_id", "y", "x", F.when(F.col("x") % 32 < 16, 1).otherwise(2).cast("long").alias("label_id"))
    return summary(partition.child_gates(c, part, seeds, UM), "cell_id", "label_id", "part")

