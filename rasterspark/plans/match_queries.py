"""Queries of the matching, linking and owner operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterspark.operators import match, ownership
from rasterspark.plans.registry import joined, query, rounded, with_ctes
from rasterspark.plans.zonal_queries import grid_labels
from rasterspark.sources import adapters as src

AT = ["field_id", "y", "x"]
_AB = """a AS (SELECT field_id, y, x, CAST((y // 10) * 8 + x // 8 AS BIGINT) AS l FROM dense WHERE value > 0),
b AS (SELECT field_id, y, x, CAST((y // 7) * 10 + x // 7 AS BIGINT) AS r FROM dense WHERE value < .15),
ov AS (SELECT field_id, l AS left_id, r AS right_id, count(*) AS overlap FROM a JOIN b USING (field_id, y, x) GROUP BY 1, 2, 3)"""


@query("f01_zonal_join", with_ctes("dense", extra=_AB) + """SELECT field_id, 'inner' AS how, count(*) AS pixels FROM a JOIN b USING (field_id, y, x) GROUP BY 1
UNION ALL SELECT field_id, 'left_semi', count(*) FROM a SEMI JOIN b USING (field_id, y, x) GROUP BY 1 UNION ALL SELECT field_id, 'left_anti', count(*) FROM a ANTI JOIN b USING (field_id, y, x) GROUP BY 1""")
def f01(spark, d):
    a, b = grid_labels(spark, d)
    out = None
    for how in ("inner", "left_semi", "left_anti"):
        n = match.zonal_join(a.select(*AT), b, how).groupBy("field_id").agg(F.lit(how).alias("how"), F.count(F.lit(1)).alias("pixels"))
        out = n if out is None else out.unionByName(n)
    return out


@query("f02_unique_match", with_ctes("dense", extra=_AB) + """, s AS (SELECT *, overlap * .125 AS um FROM ov WHERE overlap * .125 >= 1.9),
g AS (SELECT *, count(*) OVER (PARTITION BY field_id, left_id) AS left_degree, count(*) OVER (PARTITION BY field_id, right_id) AS right_degree FROM s)
SELECT field_id, left_id, right_id, overlap, left_degree, right_degree, left_degree = 1 AND right_degree = 1 AS "unique" FROM g""")
def f02(spark, d):
    return match.unique_match(*grid_labels(spark, d), 0.125, 1.9).drop("overlap_um2")


@query("f02_match_counts", with_ctes("dense", extra=_AB) + """, s AS (SELECT * FROM ov WHERE overlap * .125 >= 1.9),
g AS (SELECT *, count(*) OVER (PARTITION BY field_id, left_id) = 1 AND count(*) OVER (PARTITION BY field_id, right_id) = 1 AS u FROM s)
SELECT field_id, count(DISTINCT left_id) AS associated, count(*) FILTER (WHERE u) AS "unique" FROM g GROUP BY 1""")
def f02c(spark, d):
    return match.match_counts(match.unique_match(*grid_labels(spark, d), 0.125, 1.9))


def slice_labels(spark, d):
    """Positive pixels of every plane in 3 x 3 blocks: plane-local label ids."""
    s = src.dense_stack(spark, d).where(F.col("value") > 0.05)
    return s.select("field_id", "z", "y", "x", "height", "width", (F.floor(F.col("y") / 3) * 3 + F.floor(F.col("x") / 3) + 1).cast("long").alias("label_id"))


_SL = """sl AS (SELECT field_id, z, y, x, CAST((y // 3) * 3 + x // 3 + 1 AS BIGINT) AS l FROM stack WHERE value > .05),
ob AS (SELECT field_id, z, l, count(*) AS area, avg(y) * .5 AS cy, avg(x) * .2 AS cx FROM sl GROUP BY 1, 2, 3),
so AS (SELECT a.field_id, a.z, a.l AS p, b.l AS c, count(*) AS overlap FROM sl a JOIN sl b ON a.field_id = b.field_id AND b.z = a.z + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1, 2, 3, 4)"""
_LE = _SL + """, nr AS (SELECT DISTINCT a.field_id, a.z, a.l AS p, b.l AS c FROM sl a CROSS JOIN (SELECT unnest([0, 0, 0, -1, 1]) AS dx) JOIN sl b ON a.field_id = b.field_id AND b.z = a.z + 1 AND b.y = a.y AND b.x = a.x + dx),
ed AS (SELECT nr.field_id, nr.z, nr.p, nr.c, coalesce(overlap / least(pa.area, ca.area), 0) AS share, sqrt((pa.cy - ca.cy) ** 2 + (pa.cx - ca.cx) ** 2) AS dist FROM nr
  LEFT JOIN so ON so.field_id = nr.field_id AND so.z = nr.z AND so.p = nr.p AND so.c = nr.c
  JOIN ob pa ON pa.field_id = nr.field_id AND pa.z = nr.z AND pa.l = nr.p JOIN ob ca ON ca.field_id = nr.field_id AND ca.z = nr.z + 1 AND ca.l = nr.c),
lk AS (SELECT *, share + greatest(0, 1 - dist / .85) AS score FROM ed WHERE share >= .18 OR dist <= .85),
cf AS (SELECT *, max(score) OVER a AS ba, max(score) OVER b AS bb, nth_value(score, 2) OVER (PARTITION BY field_id, z, p ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sa,
  nth_value(score, 2) OVER (PARTITION BY field_id, z, c ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sb FROM lk
  WINDOW a AS (PARTITION BY field_id, z, p), b AS (PARTITION BY field_id, z, c))"""


@query("f03_link_edges", with_ctes("stack", extra=_LE) + """SELECT field_id, z, p AS prev_id, c AS cur_id, round(share, 6) + 0.0 AS share, round(dist, 6) + 0.0 AS distance_um, round(score, 6) + 0.0 AS score,
  coalesce(sa >= .72 * ba AND score >= .72 * ba, false) OR coalesce(sb >= .72 * bb AND score >= .72 * bb, false) AS conflict FROM cf""")
def f03e(spark, d):
    return rounded(match.link_edges(slice_labels(spark, d), (0.5, 0.2)), "share", "distance_um", "score")


@query("f03_link_slices")
def f03(spark, d):
    return joined(match.link_slices(slice_labels(spark, d), (0.5, 0.2), 0.3), "reasons")


@query("f04_link_by_mutual_overlap")
def f04(spark, d):
    return match.link_by_mutual_overlap(slice_labels(spark, d))


@query("f04_match_known", with_ctes("dense", extra=_AB) + """, sa AS (SELECT field_id, l, count(*) AS n FROM a GROUP BY 1, 2), sb AS (SELECT field_id, r, count(*) AS n FROM b GROUP BY 1, 2),
s AS (SELECT ov.*, overlap / least(sa.n, sb.n) AS share FROM ov JOIN sa ON sa.field_id = ov.field_id AND sa.l = left_id JOIN sb ON sb.field_id = ov.field_id AND sb.r = right_id),
k AS (SELECT *, row_number() OVER (PARTITION BY field_id, left_id ORDER BY share DESC, right_id) AS rn FROM s WHERE share >= .55)
SELECT field_id, left_id, right_id, overlap, round(share, 6) + 0.0 AS share FROM k WHERE rn = 1""")
def f04k(spark, d):
    return rounded(match.match_known(*grid_labels(spark, d)), "share")


@query("f05_assign_nucleus_to_cell", with_ctes("dense") + """, nu AS (SELECT field_id, y, x, CAST((y // 5) * 13 + x // 5 AS BIGINT) AS n FROM dense WHERE value > .2),
ce AS (SELECT field_id, y, x, CAST((y // 10) * 8 + x // 8 AS BIGINT) AS c FROM dense WHERE value < -.15),
bo AS (SELECT field_id, n, c, row_number() OVER (PARTITION BY field_id, n ORDER BY count(*) DESC, c) AS rn FROM nu JOIN ce USING (field_id, y, x) GROUP BY 1, 2, 3),
ct AS (SELECT field_id, n, CAST(round_even(avg(y), 0) AS INT) AS y, CAST(round_even(avg(x), 0) AS INT) AS x FROM nu GROUP BY 1, 2),
nr AS (SELECT ct.field_id, ct.n, ce.c, row_number() OVER (PARTITION BY ct.field_id, ct.n ORDER BY (ct.y - ce.y) ** 2 * .25 + (ct.x - ce.x) ** 2 * .0625, ce.c) AS rn
  FROM ct JOIN ce ON ct.field_id = ce.field_id AND abs(ct.y - ce.y) <= 3 AND abs(ct.x - ce.x) <= 5 WHERE (ct.y - ce.y) ** 2 * .25 + (ct.x - ce.x) ** 2 * .0625 <= 1.44 + 1e-12)
SELECT ct.field_id, ct.n AS nucleus_id, coalesce(bo.c, nr.c) AS cell_id, CASE WHEN bo.c IS NOT NULL THEN 'overlap' WHEN nr.c IS NOT NULL THEN 'nearest' ELSE 'none' END AS source
FROM ct LEFT JOIN bo ON bo.field_id = ct.field_id AND bo.n = ct.n AND bo.rn = 1 LEFT JOIN nr ON nr.field_id = ct.field_id AND nr.n = ct.n AND nr.rn = 1""")
def f05(spark, d):
    px = src.dense_plane(spark, d)
    lab = lambda h, n, w: (F.floor(F.col("y") / h) * n + F.floor(F.col("x") / w)).cast("long").alias("label_id")
    nuclei = px.where(F.col("value") > 0.2).select(*AT, lab(5, 13, 5))
    cells = px.where(F.col("value") < -0.15).select(*AT, "height", "width", lab(10, 8, 8))
    return match.assign_nucleus_to_cell(nuclei, cells, {"y": 0.5, "x": 0.25})


@query("f06_owner_for_soma", with_ctes("objects") + """, p AS (SELECT field_id, component_2d AS cell_id, object_id AS nucleus_id, accepted, object_id * 7 % 40 AS overlap, volume_um3 FROM objects),
r AS (SELECT *, row_number() OVER (PARTITION BY field_id, cell_id ORDER BY accepted DESC, overlap DESC, volume_um3 DESC, nucleus_id) AS rn FROM p)
SELECT field_id, cell_id, nucleus_id, accepted, overlap, volume_um3 FROM r WHERE rn = 1""")
def f06(spark, d):
    o = src.nuclei_objects(spark, d)
    return match.owner_for_soma(o.select("field_id", F.col("component_2d").alias("cell_id"), F.col("object_id").alias("nucleus_id"), "accepted", (F.col("object_id") * 7 % 40).alias("overlap"), "volume_um3"))


@query("f07_owner_map", with_ctes("objects") + """, so AS (SELECT field_id, object_id AS n, object_id % 4 AS c, object_id * 7 % 40 AS o FROM objects WHERE object_id % 3 = 0),
wo AS (SELECT field_id, object_id AS n, object_id % 6 AS c, object_id * 11 % 40 AS o FROM objects WHERE object_id % 2 = 0),
al AS (SELECT field_id, object_id AS n, object_id % 5 AS c, 0 AS k, 0 AS o FROM objects WHERE object_id % 11 = 0 UNION ALL SELECT field_id, object_id, object_id % 7, 1, 0 FROM objects WHERE object_id % 5 = 0
  UNION ALL SELECT field_id, n, c, 2, o FROM so UNION ALL SELECT field_id, n, c, 3, o FROM wo),
pk AS (SELECT *, row_number() OVER (PARTITION BY field_id, n ORDER BY k, o DESC, c) AS rn FROM al),
pc AS (SELECT pk.field_id, pk.n, pk.c, pk.k, row_number() OVER (PARTITION BY pk.field_id, pk.c ORDER BY coalesce(so.o, 0) DESC, coalesce(wo.o, 0) DESC, pk.n) AS r2 FROM pk
  LEFT JOIN so ON so.field_id = pk.field_id AND so.n = pk.n AND so.c = pk.c LEFT JOIN wo ON wo.field_id = pk.field_id AND wo.n = pk.n AND wo.c = pk.c WHERE rn = 1)
SELECT field_id, n AS nucleus_id, c AS cell_id, ['declared', 'recorded', 'soma_overlap', 'whole_overlap'][k + 1] AS source FROM pc WHERE r2 = 1""")
def f07(spark, d):
    o, k = src.nuclei_objects(spark, d), F.col("object_id")
    part = lambda cond, cell, over=None: o.where(cond).select("field_id", k.alias("nucleus_id"), cell.alias("cell_id"), *([] if over is None else [over.alias("overlap")]))
    return match.owner_map(part(k % 11 == 0, k % 5), part(k % 5 == 0, k % 7), part(k % 3 == 0, k % 4, k * 7 % 40), part(k % 2 == 0, k % 6, k * 11 % 40))


_FP = """fp AS (SELECT a.field_id, a.object_id AS a, b.object_id AS b FROM objects a JOIN objects b ON a.field_id = b.field_id AND a.component_2d = b.component_2d AND a.object_id < b.object_id
  AND a.z_min <= b.z_max AND b.z_min <= a.z_max AND sqrt(((a.center_z - b.center_z) * .5) ** 2 + ((a.center_y - b.center_y) * .25) ** 2 + ((a.center_x - b.center_x) * .25) ** 2)
  <= 1.25 * (cbrt(a.volume_um3 * .75 / pi()) + cbrt(b.volume_um3 * .75 / pi())))"""
_GR = _FP + """, sy AS (SELECT field_id, a, b FROM fp UNION ALL SELECT field_id, b, a FROM fp),
cl(field_id, node, root) USING KEY (field_id, node) AS (SELECT field_id, object_id, object_id FROM objects UNION SELECT s.field_id, s.b, min(c.root) FROM cl c JOIN sy s ON s.field_id = c.field_id AND s.a = c.node
  JOIN recurring.cl k ON k.field_id = s.field_id AND k.node = s.b WHERE c.root < k.root GROUP BY 1, 2)"""


@query("f08_fragment_pairs", with_ctes("objects", extra=_FP) + "SELECT field_id, a, b FROM fp")
def f08p(spark, d):
    return match.fragment_pairs(src.nuclei_objects(spark, d), (0.25, 0.25), 0.5)


@query("f08_group_fragments", with_ctes("objects", extra=_GR) + """SELECT o.field_id, root AS group_id, array_to_string(list_sort(list(object_id)), ',') AS source_ids, sum(volume_um3) AS volume_um3, min(z_min) AS z_min, max(z_max) AS z_max,
  round(sum(center_z * volume_um3) / sum(volume_um3), 6) + 0.0 AS center_z, round(sum(center_y * volume_um3) / sum(volume_um3), 6) + 0.0 AS center_y, round(sum(center_x * volume_um3) / sum(volume_um3), 6) + 0.0 AS center_x,
  max(enclosure) AS enclosure, bool_or(accepted) AND sum(volume_um3) >= 4 AS accepted FROM objects o JOIN cl ON cl.field_id = o.field_id AND cl.node = o.object_id GROUP BY 1, 2""")
def f08(spark, d):
    g = match.group_fragments(src.nuclei_objects(spark, d), (0.25, 0.25), 0.5)
    return joined(rounded(g, "center_z", "center_y", "center_x"), "source_ids")


@query("f09_collapse_satellites", with_ctes("objects") + """, g AS (SELECT field_id, object_id AS id, CASE WHEN object_id % 2 = 0 THEN [object_id] ELSE [object_id, object_id - 1] END AS src, center_z,
  CAST(object_id // 2 % 25 AS DOUBLE) AS cy, CAST(object_id // 2 * 3 % 40 AS DOUBLE) AS cx, volume_um3 AS v FROM objects),
h AS (SELECT a.field_id, a.id, b.id AS host, row_number() OVER (PARTITION BY a.field_id, a.id ORDER BY b.v DESC, b.id) AS rn FROM g a JOIN g b ON a.field_id = b.field_id AND a.id <> b.id
  AND list_has_all(b.src, a.src) AND len(a.src) < len(b.src) AND a.v <= .38 * b.v
  AND sqrt(((a.center_z - b.center_z) * .05) ** 2 + ((a.cy - b.cy) * .25) ** 2 + ((a.cx - b.cx) * .25) ** 2) <= 1.2 * (cbrt(a.v * .75 / pi()) + cbrt(b.v * .75 / pi()))),
up(field_id, group_id, root) AS (SELECT field_id, id, id FROM g UNION ALL SELECT u.field_id, u.group_id, h.host FROM up u JOIN h ON h.field_id = u.field_id AND h.id = u.root AND h.rn = 1)
SELECT field_id, group_id, root FROM up u WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.field_id = u.field_id AND h.id = u.root)""")
def f09(spark, d):
    o = src.nuclei_objects(spark, d)
    first = F.when(F.col("object_id") % 2 == 0, F.array("object_id")).otherwise(F.array("object_id", F.col("object_id") - 1))
    g = o.select("field_id", F.col("object_id").alias("group_id"), first.alias("source_ids"), F.lit(0).alias("z_min"), F.lit(9).alias("z_max"), "center_z",
                 (F.floor(F.col("object_id") / 2) % 25).cast("double").alias("center_y"), (F.floor(F.col("object_id") / 2) * 3 % 40).cast("double").alias("center_x"), "volume_um3")
    return match.collapse_satellites(g, (0.25, 0.25), 0.05)


@query("f10_merge_same_nucleus", with_ctes("dense", extra=_AB + """, sz AS (SELECT field_id, l, count(*) AS n FROM a GROUP BY 1, 2),
sg AS (SELECT ov.*, count(*) OVER (PARTITION BY ov.field_id, left_id) AS k FROM ov JOIN sz ON sz.field_id = ov.field_id AND sz.l = ov.left_id WHERE overlap * .0625 >= .55 AND overlap / n >= .16),
px AS (SELECT a.field_id, a.y, a.x, a.l, b.r FROM a JOIN b USING (field_id, y, x) SEMI JOIN (SELECT * FROM sg WHERE k BETWEEN 2 AND 3) s ON s.field_id = a.field_id AND s.left_id = a.l AND s.right_id = b.r),
pr AS (SELECT DISTINCT p.field_id, p.r AS a, q.r AS b FROM px p CROSS JOIN (SELECT unnest([0, 1, -1, 0, 0]) AS dy, unnest([0, 0, 0, 1, -1]) AS dx) JOIN px q ON q.field_id = p.field_id AND q.l = p.l AND q.y = p.y + dy AND q.x = p.x + dx WHERE p.r <> q.r),
cl(field_id, node, root) USING KEY (field_id, node) AS (SELECT DISTINCT field_id, a, a FROM pr UNION SELECT s.field_id, s.b, min(c.root) FROM cl c JOIN pr s ON s.field_id = c.field_id AND s.a = c.node
  JOIN recurring.cl k ON k.field_id = s.field_id AND k.node = s.b WHERE c.root < k.root GROUP BY 1, 2)""") + "SELECT field_id, node AS cell_id, root FROM cl")
def f10(spark, d):
    a, b = grid_labels(spark, d)
    return match.merge_same_nucleus(a, b, (0.25, 0.25))


_PAIR = """pr AS (SELECT CAST(l_suppkey AS VARCHAR) AS field_id, l_linenumber AS component_id, l_partkey % 9 AS nucleus_id, sum(l_quantity) / 40 AS ov, sum(l_quantity) / 40 + any_value(l_partkey % 9) AS ex,
  max(l_quantity) AS v, min(l_discount) * 10 AS en, l_partkey % 9 < 4 AS acc, .5 + (l_partkey % 9) / 16 AS dom, l_partkey % 9 = 8 AS amb FROM lineitem GROUP BY 1, 2, 3, 8, 9, 10)"""


@query("f11_ownership_conflicts", "WITH " + _PAIR + """, r AS (SELECT *, ov / ex AS sh, acc AND ov >= .6 AS own, row_number() OVER (PARTITION BY field_id, component_id ORDER BY (acc AND ov >= .6) DESC, ov DESC, v DESC, en DESC, nucleus_id) AS rn FROM pr),
o AS (SELECT *, own AND rn = 1 AS io, max(CASE WHEN own AND rn = 1 THEN ov END) OVER (PARTITION BY field_id, component_id) AS oo FROM r),
g AS (SELECT field_id, component_id, max(CASE WHEN io THEN nucleus_id END) AS owner_id, count(*) FILTER (WHERE NOT io AND acc AND ov >= .6 AND sh >= .45 AND v >= 4) AS accepted_foreign,
  count(*) FILTER (WHERE NOT io AND NOT acc AND ov >= 1.6 AND sh >= .45 AND ov >= .15 * coalesce(oo, 0) AND dom >= .8 AND v >= 12 AND en >= .2) AS unowned_foreign, bool_or(amb AND ov >= .6 AND sh >= .3) AS ambiguous FROM o GROUP BY 1, 2)
SELECT *, CASE WHEN ambiguous THEN 'drop_ambiguous_envelope' WHEN owner_id IS NULL THEN 'keep_without_owner' WHEN accepted_foreign > 0 THEN 'partition_accepted_foreign' WHEN unowned_foreign > 0 THEN 'barrier_unowned_foreign' ELSE 'keep' END AS decision FROM g""")
def f11(spark, d):
    n = F.col("l_partkey") % 9
    li = src.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("field_id"), F.col("l_linenumber").alias("component_id"), n.alias("nucleus_id")).agg(
        (F.sum("l_quantity") / 40).alias("overlap_um2"), F.max("l_quantity").alias("volume_um3"), (F.min("l_discount") * 10).alias("enclosure"))
    k = F.col("nucleus_id")
    li = li.withColumns({"extent_um2": F.col("overlap_um2") + k, "accepted": k < 4, "dominance": 0.5 + k / 16, "ambiguous": k == 8})
    return match.ownership_conflicts(li)


@query("f11_ownership_partition")
def f11_partition(spark, d):
    """Blocks where the stack has voxels, claimed by nuclei of bright DAPI voxels that straddle the blocks."""
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    stack = src.sparse_stack(spark, d).select("field_id", "channel", "y", "x", "value")
    widened = lambda px: px.select("field_id", "value", "y", "x", ring.alias("o")).select("field_id", "value", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    present = widened(stack).select("field_id", "y", "x").distinct()
    cells = src.compartments(spark, d).join(present, match.AT, "left_semi").select(*match.AT, "height", "width", F.col("cell_id").alias("label_id"))
    dapi = stack.where((F.col("channel") == "DAPI") & (F.col("value") >= 25))
    near = widened(dapi).where(F.col("y").between(0, 31) & F.col("x").between(0, 31))
    label = (F.floor((F.col("y") + 2) / 5) * 7 + F.floor((F.col("x") + 1) / 5) + 1).cast("long")
    near = near.withColumns({"label_id": label, "height": F.lit(32), "width": F.lit(32)})
    groups = near.groupBy("field_id", F.col("label_id").alias("nucleus_id")).agg(
        (F.sum("value") / 9).alias("volume_um3"), ((F.max("value") - F.min("value")) / 50).alias("enclosure"), (F.avg("value") >= 36).alias("accepted"), (F.min("value") >= 46).alias("ambiguous"))
    light = stack.where(F.col("channel") != "DAPI").groupBy(*match.AT).agg((F.max("value") / 50).alias("s"))
    extents = near.select(*match.AT, "height", "width", "label_id").distinct()
    return rounded(ownership.ownership_partition(cells, extents, groups, light, (1.0, 1.0))[1], "core_ratio", "structure_ratio")


@query("f12_consensus_owner", with_ctes("objects") + """, c AS (SELECT field_id, object_id AS cell_id, CASE WHEN object_id % 13 > 0 THEN object_id - object_id % 9 // 8 END AS lin, CASE WHEN object_id % 7 = 0 THEN object_id + 1 WHEN object_id % 17 > 0 THEN object_id - object_id % 9 // 8 END AS rec FROM objects),
ac AS (SELECT field_id, object_id AS o FROM objects WHERE object_id % 5 > 0), ax AS (SELECT field_id, object_id AS o, object_id % 4 > 0 AS keep FROM objects WHERE object_id % 3 = 0),
j AS (SELECT c.*, ac.o IS NOT NULL AS acc, coalesce(keep, true) AS keep, count(lin) OVER (PARTITION BY c.field_id, lin) AS claims FROM c LEFT JOIN ac ON ac.field_id = c.field_id AND ac.o = lin LEFT JOIN ax ON ax.field_id = c.field_id AND ax.o = lin),
w AS (SELECT *, CASE WHEN lin IS NULL THEN 'missing_lineage_owner' WHEN rec IS NULL THEN 'missing_record_owner' WHEN lin <> rec THEN 'lineage_record_disagree' WHEN NOT acc THEN 'owner_not_accepted' WHEN NOT keep THEN 'axial_rejected' WHEN claims > 1 THEN 'duplicate_owner_claim' END AS reason FROM j)
SELECT field_id, cell_id, CASE WHEN reason IS NULL THEN lin END AS owner_id, reason FROM w""")
def f12(spark, d):
    o, k = src.nuclei_objects(spark, d), F.col("object_id")
    base = k - F.floor(k % 9 / 8)
    cells = o.select("field_id", k.alias("cell_id"))
    lin = o.where(k % 13 > 0).select("field_id", k.alias("cell_id"), base.alias("owner_id"))
    rec = o.where((k % 7 == 0) | (k % 17 > 0)).select("field_id", k.alias("cell_id"), F.when(k % 7 == 0, k + 1).otherwise(base).alias("owner_id"))
    acc = o.where(k % 5 > 0).select("field_id", k.alias("owner_id"))
    ax = o.where(k % 3 == 0).select("field_id", k.alias("owner_id"), (k % 4 > 0).alias("keep"))
    return match.consensus_owner(cells, lin, rec, acc, ax)


def voxels(spark, d):
    """Overlapping 3D owners: each plane shifts its block labels."""
    s = src.dense_stack(spark, d).where(F.col("value") > 0.1)
    return s.select("field_id", "z", "y", "x", "height", "width", (F.floor((F.col("y") + F.col("z") % 3) / 4) * 3 + F.floor(F.col("x") / 4) + 1).cast("long").alias("label_id"))


_VX = "vx AS (SELECT field_id, z, y, x, CAST(((y + z % 3) // 4) * 3 + x // 4 + 1 AS BIGINT) AS l FROM stack WHERE value > .1)"


@query("f17_exclusive_projection", with_ctes("stack", extra=_VX) + """, co AS (SELECT DISTINCT field_id, y, x, l FROM vx), n1 AS (SELECT *, count(*) OVER (PARTITION BY field_id, y, x) AS n FROM co),
kp AS (SELECT field_id, l FROM n1 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE n = 1) / count(*) >= .2),
lv AS (SELECT co.*, count(*) OVER (PARTITION BY co.field_id, y, x) AS n FROM co SEMI JOIN kp USING (field_id, l)),
ds AS (SELECT a.field_id, a.y, a.x, a.l, min((a.y - e.y) ** 2 + (a.x - e.x) ** 2) AS d FROM lv a LEFT JOIN lv e ON e.field_id = a.field_id AND e.l = a.l AND e.n = 1 WHERE a.n > 1 GROUP BY 1, 2, 3, 4),
wn AS (SELECT *, row_number() OVER (PARTITION BY field_id, y, x ORDER BY d NULLS LAST, l) AS rn FROM ds)
SELECT field_id, y, x, l AS label_id FROM lv WHERE n = 1 UNION ALL SELECT field_id, y, x, l FROM wn WHERE rn = 1""")
def f17(spark, d):
    return match.exclusive_projection(voxels(spark, d), {"x": 1.0, "y": 1.0}).drop("height", "width")


@query("f17_majority_projection", with_ctes("stack", extra=_VX) + """SELECT field_id, y, x, l AS label_id FROM (SELECT field_id, y, x, l, row_number() OVER (PARTITION BY field_id, y, x ORDER BY count(*) DESC, l) AS rn FROM vx GROUP BY 1, 2, 3, 4) WHERE rn = 1""")
def f17m(spark, d):
    return match.majority_projection(voxels(spark, d))


@query("f18_validate_projection", with_ctes("stack", extra=_VX) + """, s AS (SELECT DISTINCT field_id, l FROM vx)
SELECT field_id, l AS label_id, 'unknown_id' AS violation FROM s WHERE l % 4 = 0 UNION ALL
SELECT DISTINCT f.field_id, r.l, 'missing_id' FROM (SELECT DISTINCT field_id FROM vx) f CROSS JOIN (SELECT unnest([1, 5, 99]) AS l) r ANTI JOIN s ON s.field_id = f.field_id AND s.l = r.l""")
def f18(spark, d):
    v = voxels(spark, d)
    ids = v.select("field_id", "label_id").distinct()
    need = v.select("field_id").distinct().select("field_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 5, 99)])).alias("label_id"))
    return match.validate_projection(v, ids.where(F.col("label_id") % 4 != 0), need)


_CH = """c AS (SELECT CAST(o_custkey % 200 AS VARCHAR) AS field_id, o_custkey % 5 AS cell_id, o_orderkey AS n, o_orderkey % 37 / 10 AS dist, o_orderkey % 6 = 0 AS oth, o_orderkey % 11 / 10 AS ov, o_orderkey % 5 > 0 AS ci,
  o_orderkey % 23 / 10 AS sep, o_orderkey % 7 / 10 AS iou, o_orderkey % 8 / 10 AS po, o_orderkey % 9 / 10 AS zg, o_orderkey % 13 / 13 AS conf FROM orders)"""


@query("f19_split_candidate_choice", "WITH " + _CH + """, w AS (SELECT *, .45 * ov + .3 * conf + .25 * least(1, sep / 3) AS score, CASE WHEN dist > 2.75 THEN 'too_far_from_cell' WHEN oth THEN 'belongs_to_another_cell' WHEN ov < .35 THEN 'insufficient_overlap' WHEN NOT ci THEN 'centre_outside_cell'
  WHEN NOT ((sep >= 1 AND iou <= .32 AND po <= .5) OR (zg >= .7 AND sep >= .35)) THEN 'not_separated_from_owner' END AS refusal FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY field_id, cell_id ORDER BY refusal IS NOT NULL, score DESC, n) AS rn FROM w)
SELECT field_id, cell_id, CASE WHEN refusal IS NULL THEN n END AS nucleus_id, round(score, 6) + 0.0 AS score, refusal FROM r WHERE rn = 1""")
def f19(spark, d):
    k = F.col("o_orderkey")
    c = src.table(spark, d, "orders").select(
        (F.col("o_custkey") % 200).cast("string").alias("field_id"), (F.col("o_custkey") % 5).alias("cell_id"), k.alias("nucleus_id"), (k % 37 / 10).alias("distance_um"), (k % 6 == 0).alias("in_other_cell"),
        (k % 11 / 10).alias("overlap"), (k % 5 > 0).alias("centre_inside"), (k % 23 / 10).alias("separation_um"), (k % 7 / 10).alias("iou"), (k % 8 / 10).alias("projection_overlap"), (k % 9 / 10).alias("z_gap_um"), (k % 13 / 13).alias("confidence"))
    return rounded(match.split_candidate_choice(c), "score")


@query("f21_split_owner_choice", """WITH c AS (SELECT CAST(o_custkey % 200 AS VARCHAR) AS field_id, o_custkey % 5 AS cell_id, o_orderkey AS nucleus_id, o_orderkey % 4 = 0 AS e, o_orderkey % 5 AS s, o_orderkey % 7 AS w, o_orderkey % 2 = 0 AS a, o_orderkey % 13 AS cf FROM orders)
SELECT field_id, cell_id, nucleus_id FROM (SELECT *, row_number() OVER (PARTITION BY field_id, cell_id ORDER BY e DESC, s DESC, w DESC, a DESC, cf DESC, nucleus_id) AS rn FROM c) WHERE rn = 1""")
def f21(spark, d):
    k = F.col("o_orderkey")
    c = src.table(spark, d, "orders").select(
        (F.col("o_custkey") % 200).cast("string").alias("field_id"), (F.col("o_custkey") % 5).alias("cell_id"), k.alias("nucleus_id"), (k % 4 == 0).alias("explicit"), (k % 5).alias("soma_overlap"),
        (k % 7).alias("whole_overlap"), (k % 2 == 0).alias("accepted"), (k % 13).alias("confidence"))
    return match.split_owner_choice(c).select("field_id", "cell_id", "nucleus_id")


@query("f22_merge_split_candidates", with_ctes("objects") + """, a AS (SELECT field_id, object_id AS n, z_min, z_max, enclosure AS c FROM objects WHERE object_id % 3 > 0), b AS (SELECT field_id, object_id AS n, z_min + 1 AS z_min, z_max + 1 AS z_max, 1 - enclosure AS c FROM objects WHERE object_id % 2 = 0)
SELECT coalesce(a.field_id, b.field_id) AS field_id, coalesce(a.n, b.n) AS nucleus_id, coalesce(b.z_min, a.z_min) AS z_min, coalesce(b.z_max, a.z_max) AS z_max, round(greatest(a.c, b.c), 6) + 0.0 AS confidence,
  a.n IS NOT NULL AND b.n IS NOT NULL AS locally_confirmed, CASE WHEN a.n IS NULL THEN 'model' WHEN b.n IS NULL THEN 'canonical' ELSE 'both' END AS source FROM a FULL JOIN b ON a.field_id = b.field_id AND a.n = b.n""")
def f22(spark, d):
    o, k = src.nuclei_objects(spark, d), F.col("object_id")
    a = o.where(k % 3 > 0).select("field_id", k.alias("nucleus_id"), "z_min", "z_max", F.col("enclosure").alias("confidence"))
    b = o.where(k % 2 == 0).select("field_id", k.alias("nucleus_id"), (F.col("z_min") + 1).alias("z_min"), (F.col("z_max") + 1).alias("z_max"), (1 - F.col("enclosure")).alias("confidence"))
    return rounded(match.merge_split_candidates(a, b), "confidence")


@query("f23_nucleus_records", with_ctes("objects") + """, j AS (SELECT o.field_id, o.object_id, CAST(o.field_id AS INT) % 4 > 0 OR o.object_id % 6 > 0 AS has, z_min, z_max, volume_um3, accepted FROM objects o), k AS (SELECT *, bool_and(has) OVER (PARTITION BY field_id) AS al FROM j)
SELECT field_id, object_id AS nucleus_id, CASE WHEN al THEN z_min + CAST(field_id AS INT) % 3 END AS z_min, CASE WHEN al THEN z_max + CAST(field_id AS INT) % 3 END AS z_max, CASE WHEN al THEN volume_um3 END AS volume_um3,
  CASE WHEN al THEN CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END ELSE 'projection_only' END AS status FROM k""")
def f23(spark, d):
    o, k, f = src.nuclei_objects(spark, d), F.col("object_id"), F.col("field_id").cast("int")
    rec = o.where((f % 4 > 0) | (k % 6 > 0)).select("field_id", k.alias("nucleus_id"), "z_min", "z_max", "volume_um3", F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("status"))
    return match.nucleus_records(o.select("field_id", k.alias("nucleus_id")), rec, o.select("field_id").distinct().withColumn("z0", f % 3))


@query("f23_check_nucleus_records", with_ctes("objects") + """SELECT field_id, object_id AS nucleus_id, 'status' AS violation FROM objects WHERE object_id % 50 = 0 UNION ALL SELECT field_id, object_id, 'duplicate_owner' FROM objects WHERE object_id % 40 = 1
UNION ALL SELECT field_id, object_id, 'owner_not_in_whole' FROM objects WHERE object_id % 5 = 4 UNION ALL SELECT field_id, object_id, 'owner_not_in_whole' FROM objects WHERE object_id % 40 = 1 AND object_id % 5 = 3""")
def f23c(spark, d):
    o, k = src.nuclei_objects(spark, d), F.col("object_id")
    rec = o.select("field_id", k.alias("nucleus_id"), F.when(k % 50 == 0, "maybe").otherwise("accepted").alias("status"))
    own = o.select("field_id", k.alias("nucleus_id"), (k % 5).alias("cell_id"))
    own = own.unionByName(o.where(k % 40 == 1).select("field_id", k.alias("nucleus_id"), ((k + 1) % 5).alias("cell_id")))
    cells = o.select("field_id").distinct().select("field_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("cell_id"))
    return match.check_nucleus_records(rec, own, cells)


@query("f24_owner_priority", with_ctes("dense", extra=_AB) + "SELECT coalesce(a.field_id, b.field_id) AS field_id, coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, coalesce(l, r) AS label_id FROM a FULL JOIN b ON a.field_id = b.field_id AND a.y = b.y AND a.x = b.x")
def f24(spark, d):
    return match.owner_priority(*grid_labels(spark, d))

