"""Queries of the ranking operators on threshold candidates of the projected stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterspark.operators import depth, rank
from rasterspark.params import SelectionParams
from rasterspark.plans.depth_queries import windows
from rasterspark.plans.registry import query, rounded, with_ctes
from rasterspark.session import cut_lineage
from rasterspark.sources import adapters as src

K = ["field_id", "position"]
FAMILIES = (*SelectionParams().baseline_families, SelectionParams().last_family)


def projected(spark, d):
    p = depth.project_z(src.dense_stack(spark, d), windows(spark, d))
    return p.select(*K, "y", "x", "value")


def masks(px):
    """Eighteen threshold masks of every window."""
    hit = F.filter(F.sequence(F.lit(1), F.lit(18)), lambda i: F.col("value") > (0.1 + i * 0.01))
    return px.select(*K, "y", "x", "value", F.explode(hit).alias("candidate"))


def family_of(c):
    """Candidates 1..12 in the six baseline families, 13..18 in the last one."""
    names = F.array(*[F.lit(f) for f in FAMILIES])
    return F.element_at(names, F.when(c <= 12, (c - 1) % 6 + 1).otherwise(7).cast("int"))


def candidates(spark, d):
    return windows(spark, d).select(*K, F.explode(F.sequence(F.lit(1), F.lit(18))).alias("candidate"))


def metrics(spark, d, px=None):
    """Mask statistics standing in for the full candidate evaluation."""
    px = projected(spark, d) if px is None else px
    total = px.groupBy(*K).agg(F.sum("value").alias("_t"))
    m = masks(px)
    share = lambda c: (F.count_if(c) / F.count(F.lit(1)))
    y, x = F.col("y"), F.col("x")
    g = m.groupBy(*K, "candidate").agg(
        F.sum("value").alias("_s"), F.avg("value").alias("precision"), share(F.col("value") < 0.25).alias("unsupported"),
        F.count_if(F.col("value") > 0.3).alias("soma_count"), share((y + x) % 5 == 0).alias("unanchored"), share((y == 0) | (y == 7)).alias("edge"),
        share(x == 0).alias("border_removed"), share(x == 7).alias("border_preserved"), F.count_if((x == 0) & (y < 4)).alias("incomplete_border"))
    j = candidates(spark, d).join(g, [*K, "candidate"], "left").join(total, K)
    names = ["precision", "unsupported", "unanchored", "edge", "border_removed", "border_preserved"]
    j = j.withColumn("coverage", F.coalesce(F.round(F.col("_s") / F.col("_t"), 9), F.lit(0.0))).withColumn("error", F.when(F.col("_s").isNull(), "empty"))
    j = j.withColumns({n: F.round(F.coalesce(n, F.lit(0.0)), 9) for n in names}).fillna(0, ["soma_count", "incomplete_border"])
    return j.withColumn("family", family_of(F.col("candidate"))).drop("_s", "_t")


def pairs(spark, d, px=None):
    return rank.pairwise_iou(masks(projected(spark, d) if px is None else px), candidates(spark, d))


def clusters(spark, d):
    """Near-duplicate clusters of all candidates: those of a window without pixels are empty and alike."""
    return rank.near_duplicate_clusters(candidates(spark, d).withColumn("family", family_of(F.col("candidate"))), pairs(spark, d))


_FAM = "CASE WHEN c <= 12 THEN [" + ", ".join(f"'{f}'" for f in FAMILIES[:6]) + "][(c - 1) % 6 + 1] ELSE 'distributional_threshold' END"
CAND = f"""cand AS (SELECT field_id, CAST(position AS INT) AS position, CAST(c AS INT) AS candidate, {_FAM} AS family FROM wins, (SELECT unnest(range(1, 19)) AS c)),
msk AS (SELECT field_id, CAST(position AS INT) AS position, y, x, value, CAST(c AS INT) AS candidate FROM proj, (SELECT unnest(range(1, 19)) AS c) WHERE value > .1 + c * .01),
ar AS (SELECT field_id, position, candidate, count(*) AS area FROM msk GROUP BY ALL),
ca AS (SELECT cand.*, coalesce(area, 0) AS area FROM cand LEFT JOIN ar USING (field_id, position, candidate)),
nn AS (SELECT l.field_id, l.position, l.candidate AS a, r.candidate AS b, count(*) AS inter FROM msk l JOIN msk r USING (field_id, position, y, x) WHERE l.candidate < r.candidate GROUP BY ALL),
iou AS (SELECT l.field_id, l.position, l.candidate AS a, r.candidate AS b, CASE WHEN l.area + r.area = 0 THEN 1.0 ELSE coalesce(inter, 0) / (l.area + r.area - coalesce(inter, 0)) END AS iou
  FROM ca l JOIN ca r ON l.field_id = r.field_id AND l.position = r.position AND l.candidate < r.candidate
  LEFT JOIN nn ON nn.field_id = l.field_id AND nn.position = l.position AND nn.a = l.candidate AND nn.b = r.candidate),
sym AS (SELECT field_id, position, a, b, iou FROM iou UNION ALL SELECT field_id, position, b, a, iou FROM iou),
tt AS (SELECT field_id, position, sum(value) AS t FROM proj GROUP BY ALL),
cm AS (SELECT cand.field_id, cand.position, cand.candidate, any_value(cand.family) AS family, coalesce(round(sum(value) / any_value(t), 9), 0) AS coverage, coalesce(round(avg(value), 9), 0) AS precision,
  coalesce(round(count(*) FILTER (WHERE value < .25) / nullif(count(value), 0), 9), 0) AS unsupported, count(*) FILTER (WHERE value > .3) AS soma_count,
  coalesce(round(count(*) FILTER (WHERE (y + x) % 5 = 0) / nullif(count(value), 0), 9), 0) AS unanchored, coalesce(round(count(*) FILTER (WHERE y IN (0, 7)) / nullif(count(value), 0), 9), 0) AS edge,
  coalesce(round(count(*) FILTER (WHERE x = 0) / nullif(count(value), 0), 9), 0) AS border_removed, coalesce(round(count(*) FILTER (WHERE x = 7) / nullif(count(value), 0), 9), 0) AS border_preserved,
  count(*) FILTER (WHERE x = 0 AND y < 4) AS incomplete_border, CASE WHEN count(value) = 0 THEN 'empty' END AS error
  FROM cand JOIN tt ON tt.field_id = cand.field_id AND tt.position = cand.position LEFT JOIN msk ON msk.field_id = cand.field_id AND msk.position = cand.position AND msk.candidate = cand.candidate GROUP BY 1, 2, 3)"""
_ALL = ("stack", "wins", "proj")


def _rank_sql(v, table="PARTITION BY field_id, position"):
    return f"((rank() OVER ({table} ORDER BY {v}) - 1 + count(*) OVER ({table}, {v}) / 2) / count(*) OVER ({table}))"


def score_sql(src_table, name="sc"):
    """Mid-rank score over ``src_table`` (metrics with mean_iou and cap)."""
    up = lambda v: _rank_sql(v)
    down = lambda v: f"(1 - {_rank_sql(v)})"
    return f"""{name} AS (SELECT *, .27 * mean_iou + .10 * {up('coverage')} + .15 * {up('precision')} + .20 * {up('capped')} + .09 * {down('unsupported')}
  + .08 * {down('unanchored')} + .02 * {down('edge')} + .01 * {down('border_removed')} + .04 * {down('border_preserved')} AS score FROM {src_table})"""


_H3 = """mi AS (SELECT field_id, position, a AS candidate, avg(iou) AS mean_iou FROM sym GROUP BY ALL),
cp AS (SELECT field_id, position, quantile_cont(soma_count, .75) AS cap FROM cm GROUP BY ALL),
mj AS (SELECT cm.*, mean_iou, least(soma_count, cap) AS capped FROM cm JOIN mi USING (field_id, position, candidate) JOIN cp USING (field_id, position)),""" + score_sql("mj")


@query("e17_pairwise_iou", with_ctes(*_ALL, extra=CAND) + "SELECT field_id, position, a, b, round(iou, 6) + 0.0 AS iou FROM iou")
def e17(spark, d):
    return rounded(pairs(spark, d), "iou")


@query("h01_rank01", with_ctes(*_ALL, extra=CAND) + f"SELECT field_id, position, candidate, round({_rank_sql('coverage')}, 6) + 0.0 AS up, round(1 - {_rank_sql('soma_count')}, 6) + 0.0 AS down FROM cm")
def h01(spark, d):
    m = metrics(spark, d)
    return rounded(m.select(*K, "candidate", rank.rank01(F.col("coverage")).alias("up"), rank.rank01(F.col("soma_count"), higher=False).alias("down")), "up", "down")


@query("h02_weighted_rank01", """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS field_id, o_orderkey AS candidate, trunc(o_totalprice / 50000) AS v, o_orderkey % 4 + 1 AS w FROM orders)
SELECT field_id, candidate, round((sum(w) OVER (PARTITION BY field_id ORDER BY v) - sum(w) OVER (PARTITION BY field_id, v) / 2) / sum(w) OVER (PARTITION BY field_id), 6) + 0.0 AS r FROM o""")
def h02(spark, d):
    o = src.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("field_id"), F.col("o_orderkey").alias("candidate"),
                                             F.floor(F.col("o_totalprice") / 50000).alias("v"), (F.col("o_orderkey") % 4 + 1).alias("w"))
    return rounded(o.select("field_id", "candidate", rank.weighted_rank01(F.col("v"), F.col("w"), ["field_id"]).alias("r")), "r")


@query("h03_rank_candidates", with_ctes(*_ALL, extra=CAND + "," + _H3) + """SELECT field_id, position, candidate, round(mean_iou, 6) + 0.0 AS mean_iou, round(score, 6) + 0.0 AS score,
  row_number() OVER (PARTITION BY field_id, position ORDER BY round(score, 12) DESC, candidate) = 1 AS selected FROM sc""")
def h03(spark, d):
    r = rank.rank_candidates(metrics(spark, d), pairs(spark, d))
    return rounded(r.select(*K, "candidate", "mean_iou", "score", "selected"), "mean_iou", "score")


_OK = """okc AS (SELECT * FROM cm WHERE error IS NULL),
mi AS (SELECT s.field_id, s.position, s.a AS candidate, avg(iou) AS mean_iou FROM sym s JOIN okc x ON x.field_id = s.field_id AND x.position = s.position AND x.candidate = s.a
  JOIN okc z ON z.field_id = s.field_id AND z.position = s.position AND z.candidate = s.b GROUP BY ALL),
cp AS (SELECT field_id, position, quantile_cont(soma_count, .75) AS cap, count(*) AS n FROM okc GROUP BY ALL),
mj AS (SELECT okc.*, coalesce(mean_iou, 1) AS mean_iou, least(soma_count, cap) AS capped, n FROM okc LEFT JOIN mi USING (field_id, position, candidate) JOIN cp USING (field_id, position)),""" + score_sql("mj")


@query("h04_rank_eligible", with_ctes(*_ALL, extra=CAND + "," + _OK) + """SELECT field_id, position, candidate, round(CASE WHEN n = 1 THEN 1 ELSE score END, 6) + 0.0 AS score, true AS eligible,
  row_number() OVER (PARTITION BY field_id, position ORDER BY round(score, 12) DESC, candidate) = 1 AS selected, 'ok' AS window_status FROM sc
UNION ALL SELECT field_id, position, candidate, -1.0, false, false, CASE WHEN field_id || '/' || position IN (SELECT field_id || '/' || position FROM okc) THEN 'ok' ELSE 'all_failed' END FROM cm WHERE error IS NOT NULL""")
def h04(spark, d):
    r = rank.rank_eligible(metrics(spark, d), pairs(spark, d))
    return rounded(r.select(*K, "candidate", "score", "eligible", "selected", "window_status"), "score")


_CLUST = """ne AS (SELECT s.field_id, s.position, s.a, s.b FROM sym s JOIN cand x ON x.field_id = s.field_id AND x.position = s.position AND x.candidate = s.a
  JOIN cand z ON z.field_id = s.field_id AND z.position = s.position AND z.candidate = s.b WHERE iou >= .995 AND x.family = z.family),
cl(field_id, position, candidate, rep) USING KEY (field_id, position, candidate) AS (SELECT field_id, position, candidate, candidate FROM cand
  UNION SELECT n.field_id, n.position, n.b, min(c.rep) FROM cl c JOIN ne n ON n.field_id = c.field_id AND n.position = c.position AND n.a = c.candidate
  JOIN recurring.cl k ON k.field_id = n.field_id AND k.position = n.position AND k.candidate = n.b WHERE c.rep < k.rep GROUP BY 1, 2, 3),
cf AS (SELECT cl.*, family FROM cl JOIN cand USING (field_id, position, candidate))"""


@query("h05_near_duplicate_clusters", with_ctes(*_ALL, extra=CAND + "," + _CLUST) + "SELECT field_id, position, candidate, family, rep AS representative FROM cf")
def h05(spark, d):
    return clusters(spark, d)


_WT = """wt AS (SELECT cf.*, CASE WHEN candidate = rep THEN 1 / cells / k ELSE 0 END AS weight FROM cf
  JOIN (SELECT field_id, position, family, count(DISTINCT rep) AS k FROM cf GROUP BY ALL) USING (field_id, position, family)
  JOIN (SELECT field_id, position, count(DISTINCT family) AS cells FROM cf GROUP BY ALL) USING (field_id, position))"""


@query("h06_family_balance_weights", with_ctes(*_ALL, extra=",".join([CAND, _CLUST, _WT])) + "SELECT field_id, position, candidate, family, rep AS representative, round(weight, 6) + 0.0 AS weight FROM wt")
def h06(spark, d):
    return rounded(rank.family_balance_weights(clusters(spark, d)), "weight")


def _wrank(v):
    return f"((sum(weight) OVER (PARTITION BY field_id, position ORDER BY {v}) - sum(weight) OVER (PARTITION BY field_id, position, {v}) / 2) / sum(weight) OVER (PARTITION BY field_id, position))"


_BAL = f"""rp AS (SELECT s.field_id, s.position, s.a, w.family, avg(iou) AS m FROM sym s JOIN wt w ON w.field_id = s.field_id AND w.position = s.position AND w.candidate = s.b AND w.candidate = w.rep
  JOIN wt o ON o.field_id = s.field_id AND o.position = s.position AND o.candidate = s.a WHERE o.rep <> s.b GROUP BY ALL),
bi AS (SELECT field_id, position, a AS candidate, avg(m) AS mean_iou FROM rp GROUP BY ALL),
bw AS (SELECT cm.*, weight FROM cm JOIN wt USING (field_id, position, candidate)),
bc AS (SELECT field_id, position, min(soma_count) FILTER (WHERE c >= .75 * t - 1e-12) AS cap FROM (SELECT *, sum(weight) OVER (PARTITION BY field_id, position ORDER BY soma_count) AS c,
  sum(weight) OVER (PARTITION BY field_id, position) AS t FROM bw) GROUP BY ALL),
bj AS (SELECT bw.*, mean_iou, least(soma_count, cap) AS capped FROM bw JOIN bi USING (field_id, position, candidate) JOIN bc USING (field_id, position)),
bs AS (SELECT *, .27 * mean_iou + .10 * {_wrank('coverage')} + .15 * {_wrank('precision')} + .20 * {_wrank('capped')} + .09 * (1 - {_wrank('unsupported')}) + .08 * (1 - {_wrank('unanchored')})
  + .02 * (1 - {_wrank('edge')}) + .01 * (1 - {_wrank('border_removed')}) + .04 * (1 - {_wrank('border_preserved')}) AS score FROM bj)"""


@query("h07_rank_family_balanced", with_ctes(*_ALL, extra=",".join([CAND, _CLUST, _WT, _BAL])) + """SELECT field_id, position, candidate, round(mean_iou, 6) + 0.0 AS mean_iou, round(score, 5) + 0.0 AS score, 'ok' AS balance_status FROM bs""")
def h07(spark, d):
    r = rank.rank_family_balanced(metrics(spark, d), pairs(spark, d), FAMILIES)
    return rounded(rounded(r.select(*K, "candidate", "mean_iou", "score", "balance_status"), "mean_iou"), "score", digits=5)


@query("h08_dominates", with_ctes(*_ALL, extra=CAND + "," + _H3) + """, w AS (SELECT *, row_number() OVER (PARTITION BY field_id, position ORDER BY round(score, 12) DESC, candidate) AS r FROM sc)
SELECT c.field_id, c.position, c.candidate, c.coverage >= i.coverage AS coverage_not_lower, c.precision >= i.precision AS precision_not_lower, c.unsupported <= i.unsupported AS unsupported_not_higher,
  c.soma_count = i.soma_count AS soma_equal, c.score >= i.score + .01 AS score_margin,
  c.coverage >= i.coverage AND c.precision >= i.precision AND c.unsupported <= i.unsupported AND c.unanchored <= i.unanchored AND c.edge <= i.edge AND c.border_removed <= i.border_removed
  AND c.border_preserved <= i.border_preserved AND c.soma_count = i.soma_count AND c.incomplete_border <= i.incomplete_border AND c.score >= i.score + .01 AS dominates
FROM w c JOIN sc i ON i.field_id = c.field_id AND i.position = c.position AND i.candidate = 1""")
def h08(spark, d):
    r = rank.rank_candidates(metrics(spark, d), pairs(spark, d))
    cols = [*rank.HIGHER, *rank.LOWER, "soma_count", "incomplete_border", "score"]
    c = r.select(*K, "candidate", *[F.col(n).alias(f"c_{n}") for n in cols])
    i = r.where(F.col("candidate") == 1).select(*K, *[F.col(n).alias(f"i_{n}") for n in cols])
    return rank.dominates(c.join(i, K)).select(
        *K, "candidate", "coverage_not_lower", "precision_not_lower", "unsupported_not_higher", "soma_equal", "score_margin", "dominates")


@query("h09_select_with_guard")
def h09(spark, d):
    px = cut_lineage(projected(spark, d))
    r = rank.select_with_guard(metrics(spark, d, px), pairs(spark, d, px))
    return rounded(r, "score1", "challenger_score2", "challenger_score3")


@query("h11_select_position", """WITH p AS (SELECT CAST(p_partkey // 5 AS VARCHAR) AS field_id, CAST(p_partkey % 5 + 1 AS INT) AS position, p_size % 4 > 0 AS valid, CAST(p_size % 7 AS DOUBLE) AS s FROM part),
t AS (SELECT *, max(CASE WHEN valid THEN s END) OVER (PARTITION BY field_id) AS top FROM p)
SELECT field_id, CASE WHEN count(*) FILTER (WHERE valid) = 0 THEN 'invalid' WHEN count(*) FILTER (WHERE valid AND s = top) > 1 THEN 'ambiguous' ELSE 'selected' END AS status,
  CASE WHEN count(*) FILTER (WHERE valid AND s = top) = 1 THEN min(position) FILTER (WHERE valid AND s = top) END AS position, max(top) AS best_score FROM t GROUP BY 1""")
def h11(spark, d):
    p = src.table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 5).cast("string").alias("field_id"), (F.col("p_partkey") % 5 + 1).cast("int").alias("position"),
        (F.col("p_size") % 4 > 0).alias("valid"), (F.col("p_size") % 7).cast("double").alias("total_score"))
    return rank.select_position(p)


@query("h13_leave_one_out", """WITH v AS (SELECT CAST(p_partkey // 25 AS VARCHAR) AS field_id, p_partkey AS cell_id, CAST(p_size AS DOUBLE) * 1.5 AS value FROM part),
o AS (SELECT a.field_id, a.cell_id, a.value, b.value AS ov FROM v a JOIN v b ON a.field_id = b.field_id AND a.cell_id <> b.cell_id),
m AS (SELECT field_id, cell_id, value, median(ov) AS median, quantile_cont(ov, .75) - quantile_cont(ov, .25) AS iqr FROM o GROUP BY ALL),
d AS (SELECT field_id, cell_id, median(abs(ov - median)) AS mad FROM o JOIN m USING (field_id, cell_id) GROUP BY ALL)
SELECT field_id, cell_id, CAST(value AS DOUBLE) AS value, CAST(median AS DOUBLE) AS median, round(greatest(1.4826 * mad, iqr / 1.349, 1e-6), 6) + 0.0 AS scale FROM m JOIN d USING (field_id, cell_id)""")
def h13(spark, d):
    p = src.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 25).cast("string").alias("field_id"), F.col("p_partkey").alias("cell_id"), (F.col("p_size") * 1.5).alias("value"))
    return rounded(rank.leave_one_out(p), "scale")
