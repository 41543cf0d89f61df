"""Queries of the per-pixel and threshold operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterspark.functions import scalar
from rasterspark.operators import local
from rasterspark.plans.registry import joined, query, r6, rounded, with_ctes
from rasterspark.sources import adapters as src

_SCALE = "round(greatest(0, least(1, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END)), 6) + 0.0"


def _bounds(table, lo, hi, keys="field_id"):
    return (f"(SELECT {keys}, quantile_cont(value, {lo}) AS lo, quantile_cont(value, {hi}) AS hi "
            f"FROM {table} GROUP BY {keys}) b USING ({keys})")


@query("b01_robust01", with_ctes("dense") + f"SELECT field_id, y, x, {_SCALE} AS norm FROM dense JOIN {_bounds('dense', .005, .998)}")
def b01(spark, d):
    return rounded(local.robust01(src.dense_plane(spark, d)), "norm").select("field_id", "y", "x", "norm")


@query("b02_robust01_gfap", with_ctes("dense") + f"SELECT field_id, y, x, {_SCALE} AS norm FROM dense JOIN {_bounds('dense', .01, .997)}")
def b02(spark, d):
    return rounded(local.robust01_gfap(src.dense_plane(spark, d)), "norm").select("field_id", "y", "x", "norm")


@query("b02_normalize_plane", with_ctes("stack") + f"""SELECT field_id, z, y, x,
  round(greatest(0, least(1, CASE WHEN hi - lo > 1e-6 THEN (value - lo) / (hi - lo + 1e-6) ELSE 0 END)), 6) + 0.0 AS norm
  FROM stack JOIN {_bounds('stack', .001, .999, 'field_id, z')}""")
def b02n(spark, d):
    return rounded(local.normalize_plane(src.dense_stack(spark, d)), "norm").select("field_id", "z", "y", "x", "norm")


@query("b03_plane_bounds", with_ctes("stack") + """SELECT field_id, z, round(quantile_cont(value, .005), 6) + 0.0 AS low,
  round(quantile_cont(value, .998), 6) + 0.0 AS high FROM stack GROUP BY field_id, z""")
def b03(spark, d):
    return rounded(local.plane_bounds(src.dense_stack(spark, d)), "low", "high")


@query("b03_normalize_per_plane", with_ctes("stack") + f"SELECT field_id, z, y, x, {_SCALE} AS norm FROM stack JOIN {_bounds('stack', .005, .998, 'field_id, z')}")
def b03n(spark, d):
    return rounded(local.normalize_per_plane(src.dense_stack(spark, d)), "norm").select("field_id", "z", "y", "x", "norm")


_CH = """ch AS (SELECT DISTINCT field_id, channel,
  CASE channel WHEN 'eGFP' THEN .55 WHEN 'GFAP' THEN .45 ELSE -1.0 END AS requested FROM sparse)"""


@query("b04_channel_weights", with_ctes("sparse", extra=_CH) + """SELECT field_id, channel,
  round(CAST(greatest(requested, 0) AS DOUBLE) / sum(CAST(greatest(requested, 0) AS DOUBLE)) OVER (PARTITION BY field_id), 6) + 0.0 AS weight FROM ch""")
def b04(spark, d):
    ch = src.sparse_stack(spark, d).select("field_id", "channel").distinct()
    requested = F.when(F.col("channel") == "eGFP", 0.55).when(F.col("channel") == "GFAP", 0.45).otherwise(-1.0)
    return rounded(local.channel_weights(ch.withColumn("requested", requested)).drop("requested"), "weight")


STRUCT_SQL = f"""nrm AS (SELECT field_id, channel, y, x, greatest(0, least(1, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END)) AS n
  FROM dense2 JOIN {_bounds('dense2', .005, .998, 'field_id, channel')}),
mixed AS (SELECT field_id, y, x, sum(n * CASE channel WHEN 'eGFP' THEN .55 ELSE .45 END) AS m FROM nrm GROUP BY ALL),
smap AS (SELECT field_id, y, x, m / greatest(max(m) OVER (PARTITION BY field_id), 1e-6) AS s FROM mixed)"""


@query("b05_structural_sum", with_ctes("dense", "dense2", extra=STRUCT_SQL) + "SELECT field_id, y, x, round(s, 6) + 0.0 AS s FROM smap")
def b05(spark, d):
    return rounded(local.structural_sum(src.dense_channels(spark, d)), "s").select("field_id", "y", "x", "s")


def hist_sql(bins=256, table="dense", value="value"):
    return f"""lim AS (SELECT field_id, min({value}) AS lo, max({value}) AS hi FROM {table} GROUP BY 1),
hist AS (SELECT field_id, lo, hi, CAST(CASE WHEN hi > lo THEN least({bins - 1}, floor(({value} - lo) / (hi - lo) * {bins})) ELSE 0 END AS INT) AS bin,
  count(*) AS n FROM {table} JOIN lim USING (field_id) GROUP BY ALL),
hc AS (SELECT *, lo + (hi - lo) * (bin + .5) / {bins}.0 AS center FROM hist)"""


OTSU_SQL = """cum AS (SELECT field_id, bin, center,
  sum(n) OVER u AS w1, sum(n * center) OVER u AS s1, sum(n) OVER f AS w2, sum(n * center) OVER f AS s2 FROM hc
  WINDOW u AS (PARTITION BY field_id ORDER BY bin), f AS (PARTITION BY field_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
otsu AS (SELECT field_id, center AS otsu FROM (SELECT *, row_number() OVER (PARTITION BY field_id
  ORDER BY w1 * w2 * (s1 / w1 - s2 / w2) ** 2 DESC NULLS LAST, bin) AS rn FROM cum) WHERE rn = 1)"""


@query("b06_threshold_otsu", with_ctes("dense", extra=hist_sql() + "," + OTSU_SQL) + "SELECT field_id, round(otsu, 6) + 0.0 AS otsu FROM otsu")
def b06(spark, d):
    return rounded(local.threshold_otsu(src.dense_plane(spark, d)), "otsu")


@query("b07_threshold_yen", with_ctes("dense", extra=hist_sql()) + """, p AS (SELECT *, n / sum(n) OVER (PARTITION BY field_id) AS p FROM hc),
c AS (SELECT field_id, bin, center, sum(p) OVER u AS p1, sum(p * p) OVER u AS q1, sum(p * p) OVER f AS q2 FROM p
  WINDOW u AS (PARTITION BY field_id ORDER BY bin), f AS (PARTITION BY field_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
b AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY 2 * ln(p1 * (1 - p1)) - ln(q1 * q2) DESC, bin) AS rn FROM c
  WHERE q2 IS NOT NULL AND p1 < 1)
SELECT field_id, round(center, 6) + 0.0 AS yen FROM b WHERE rn = 1""")
def b07(spark, d):
    return rounded(local.threshold_yen(src.dense_plane(spark, d)), "yen")


@query("b08_threshold_li", with_ctes("dense", extra=hist_sql(4096)) + """, t AS (SELECT field_id, center - lo AS c, n, (hi - lo) / 8192.0 AS tol, lo FROM hc),
it(field_id, i, cut, done) AS (SELECT field_id, 0, sum(c * n) / sum(n), false FROM t GROUP BY 1
  UNION ALL SELECT field_id, i + 1, CASE WHEN stop THEN cut ELSE nw END, stop OR abs(nw - cut) <= tol FROM (
    SELECT it.field_id, i, cut, max(tol) AS tol, sum(c * n) FILTER (c > cut) / sum(n) FILTER (c > cut) AS mf, sum(c * n) FILTER (c <= cut) / sum(n) FILTER (c <= cut) AS mb,
      coalesce(mb <= 0 OR mf = mb, true) AS stop, CASE WHEN NOT stop THEN (mb - mf) / (ln(mb) - ln(mf)) END AS nw
    FROM it JOIN t ON it.field_id = t.field_id WHERE NOT done AND i < 200 GROUP BY 1, 2, 3))
SELECT field_id, round(arg_max(cut, i) + any_value(lo), 6) + 0.0 AS li, CAST(max(CASE WHEN i > 0 THEN i ELSE 0 END) AS INTEGER) AS steps FROM it JOIN lim USING (field_id) GROUP BY 1""")
def b08(spark, d):
    return rounded(local.threshold_li(src.dense_plane(spark, d)), "li")


@query("b14_edge_zone", with_ctes("dense") + """SELECT field_id, count(*) AS pixels,
  count(*) FILTER (WHERE y < 12 OR y >= 38 OR x < 12 OR x >= 52) AS band,
  count(*) FILTER (WHERE y = 0 OR y = 49 OR x = 0 OR x = 63) AS border,
  count(*) FILTER (WHERE y < 25 OR y >= 25 OR x < 32 OR x >= 32) AS clamped FROM dense GROUP BY 1""")
def b14(spark, d):
    return src.dense_plane(spark, d).groupBy("field_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(scalar.near_edge(12)).alias("band"),
        F.count_if(scalar.on_border()).alias("border"), F.count_if(scalar.near_edge(100)).alias("clamped"))


@query("b15_linear_evidence", with_ctes("dense") + """SELECT field_id, y, x,
  round(greatest(0, least(1, (value + .1) / (.2 + .1))), 6) + 0.0 AS evidence FROM dense""")
def b15(spark, d):
    return src.dense_plane(spark, d).select("field_id", "y", "x", r6(scalar.linear_evidence("value", -0.1, 0.2)).alias("evidence"))


@query("b16_display_range", with_ctes("dense") + """SELECT field_id, round(quantile_cont(value, .003), 6) AS low,
  round(quantile_cont(value, .998), 6) AS high FROM dense WHERE y % 4 = 0 AND x % 4 = 0 GROUP BY 1""")
def b16(spark, d):
    return local.display_range(src.dense_plane(spark, d))


@query("b17_snr_sensitivity", with_ctes("sparse") + """, g AS (SELECT field_id, channel, value FROM sparse WHERE y % 8 = 0 AND x % 8 = 0),
q AS (SELECT field_id, channel, quantile_cont(value, .5) AS p50, quantile_cont(value, .75) AS p75, quantile_cont(value, .995) AS p995 FROM g GROUP BY 1, 2),
lowp AS (SELECT g.* FROM g JOIN q USING (field_id, channel) WHERE value <= p75),
md AS (SELECT field_id, channel, median(value) AS bg FROM lowp GROUP BY 1, 2),
mad AS (SELECT field_id, channel, median(abs(value - bg)) AS mad FROM lowp JOIN md USING (field_id, channel) GROUP BY 1, 2),
sc AS (SELECT field_id, greatest(p995 - p50, 0) / greatest(1.4826 * mad, .02 * greatest(p995 - p50, 0), 2.220446049250313e-16) AS score FROM q JOIN mad USING (field_id, channel))
SELECT field_id, round(greatest(0, least(1, (ln(1 + median(score)) - ln(4)) / (ln(21) - ln(4)))), 6) + 0.0 AS sensitivity FROM sc GROUP BY 1""")
def b17(spark, d):
    return rounded(local.snr_sensitivity(src.sparse_stack(spark, d)), "sensitivity")


@query("b21_dtype_rails", """SELECT p_partkey, ['uint8','uint16','int16','float32'][p_partkey % 4 + 1] AS dtype,
  CAST([0, 0, -32768, NULL][p_partkey % 4 + 1] AS DOUBLE) AS low, CAST([255, 65535, 32767, NULL][p_partkey % 4 + 1] AS DOUBLE) AS high FROM part""")
def b21(spark, d):
    kinds = F.array(*[F.lit(t) for t in ("uint8", "uint16", "int16", "float32")])
    p = src.table(spark, d, "part").select("p_partkey", F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")).alias("dtype"))
    return p.withColumns({"low": scalar.dtype_rail("dtype", False), "high": scalar.dtype_rail("dtype", True)})


@query("b22_normalize_evidence", with_ctes("dense") + f"SELECT field_id, y, x, {_SCALE} AS norm FROM dense JOIN {_bounds('dense', .01, .995)}")
def b22(spark, d):
    return rounded(local.normalize_evidence(src.dense_plane(spark, d)), "norm").select("field_id", "y", "x", "norm")
