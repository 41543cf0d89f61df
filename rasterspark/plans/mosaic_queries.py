"""Neighbourhood and connectivity operators on one tall image, with tiles much smaller than it."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterspark.operators import focal, graph
from rasterspark.plans.graph_queries import comp_sql
from rasterspark.plans.registry import query, rounded, with_ctes
from rasterspark.sources import adapters as src

AT = ["field_id", "y", "x"]
TILE = 32
_STEPS = "(SELECT dy, dx FROM (SELECT unnest(range(3)) - 1 AS dy), (SELECT unnest(range(3)) - 1 AS dx) WHERE dy <> 0 OR dx <> 0)"


def seeded_sql(source: str) -> str:
    """Minimax levels by relaxation, then fewest level-preserving hops and lowest marker, packed into one number."""
    return f"""px AS (SELECT field_id, y, x, round(abs(value), 2) AS cost, value > 0.3 AS mark FROM {source}),
lv(field_id, y, x, level) USING KEY (field_id, y, x) AS (
  SELECT field_id, y, x, CASE WHEN mark THEN cost ELSE 1e300 END FROM px
  UNION SELECT m.field_id, m.y, m.x, min(greatest(c.level, m.cost)) FROM lv c CROSS JOIN {_STEPS} o
    JOIN px m ON m.field_id = c.field_id AND m.y = c.y + o.dy AND m.x = c.x + o.dx
    JOIN recurring.lv k ON k.field_id = m.field_id AND k.y = m.y AND k.x = m.x
    WHERE greatest(c.level, m.cost) < k.level GROUP BY 1, 2, 3),
pl AS (SELECT px.*, lv.level FROM px JOIN lv USING (field_id, y, x) WHERE level < 1e300),
hp(field_id, y, x, level, k) USING KEY (field_id, y, x) AS (
  SELECT field_id, y, x, level, CASE WHEN mark THEN CAST(y AS BIGINT) * 64 + x ELSE 9000000000000000000 END FROM pl
  UNION SELECT m.field_id, m.y, m.x, any_value(m.level), min(c.k + 4294967296) FROM hp c CROSS JOIN {_STEPS} o
    JOIN pl m ON m.field_id = c.field_id AND m.y = c.y + o.dy AND m.x = c.x + o.dx
    JOIN recurring.hp h ON h.field_id = m.field_id AND h.y = m.y AND h.x = m.x
    WHERE c.k < 9000000000000000000 AND greatest(c.level, m.cost) = m.level AND c.k + 4294967296 < h.k GROUP BY 1, 2, 3)"""


SEEDED = " SELECT field_id, y, x, k % 4294967296 AS label_id, round(level, 6) + 0.0 AS level, k // 4294967296 AS hops FROM hp WHERE k < 9000000000000000000"


def seeded(px, tile):
    cost = px.withColumn("cost", F.round(F.abs("value"), 2))
    marks = px.where(F.col("value") > 0.3).select(*AT, (F.col("y") * 64 + F.col("x")).cast("long").alias("label_id"))
    return rounded(graph.seeded_assign(cost, marks, tile=tile), "level").drop("height", "width")


@query("g05_seeded_assign", with_ctes("dense", extra=seeded_sql("dense")) + SEEDED)
def g05(spark, d):
    return seeded(src.dense_plane(spark, d), graph.TILE)


@query("g05_seeded_assign_mosaic", with_ctes("mosaic", extra=seeded_sql("mosaic")) + SEEDED)
def g05_mosaic(spark, d):
    return seeded(src.mosaic(spark, d), TILE)


@query("g01_components_mosaic", with_ctes("mosaic", extra="wide AS (SELECT field_id, y, x FROM mosaic WHERE value > 0)," + comp_sql("cc", "wide")) + "SELECT field_id, y, x, label_id FROM cc")
def g01_mosaic(spark, d):
    mask = src.mosaic(spark, d).where(F.col("value") > 0).select(*AT, "height", "width")
    return graph.components(mask, tile=TILE).select(*AT, "label_id")


@query("d02_erode_mosaic", with_ctes("mosaic") + """, m AS (SELECT field_id, y, x FROM mosaic WHERE value > -.15),
o AS (SELECT unnest([-1, 0, 0, 0, 1]) AS dy, unnest([0, -1, 0, 1, 0]) AS dx), n AS (SELECT max(y) AS last FROM mosaic)
SELECT m.field_id, m.y, m.x FROM m, n WHERE NOT EXISTS (SELECT 1 FROM o WHERE m.y + dy BETWEEN 0 AND last AND m.x + dx BETWEEN 0 AND 63
  AND NOT EXISTS (SELECT 1 FROM m q WHERE q.field_id = m.field_id AND q.y = m.y + dy AND q.x = m.x + dx))""")
def d02_mosaic(spark, d):
    mask = src.mosaic(spark, d).where(F.col("value") > -0.15).select(*AT, "height", "width")
    return focal.morphology(mask, "erode", [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)], ["field_id"], tile=TILE).select(*AT)


@query("d09_distance_mosaic", with_ctes("mosaic") + """, s AS (SELECT y, x FROM mosaic WHERE value > .3)
SELECT m.field_id, m.y, m.x, round(min(sqrt((m.y - s.y) ** 2 * .09 + (m.x - s.x) ** 2 * .25)), 6) AS distance
FROM mosaic m JOIN s ON abs(m.y - s.y) <= 7 AND abs(m.x - s.x) <= 4 WHERE (m.y - s.y) ** 2 * .09 + (m.x - s.x) ** 2 * .25 <= 4 GROUP BY ALL""")
def d09_mosaic(spark, d):
    seeds = src.mosaic(spark, d).where(F.col("value") > 0.3).select(*AT, "height", "width")
    out = focal.nearest_seed(seeds, {"y": 0.3, "x": 0.5}, label=None, block_px=2048, max_um=2.0)
    return rounded(out, "distance").select(*AT, "distance")
