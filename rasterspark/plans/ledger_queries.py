"""Queries of the partition algebra, identities and the edit ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterspark.operators import ledger
from rasterspark.plans.registry import joined, query, with_ctes
from rasterspark.sources import adapters as src

AT = ["field_id", "y", "x"]
# Fixed value: namespace of cell identities.
CELL_NAMESPACE = "1c25d78b-f594-46fb-a14d-df013ac90f35"


def _split_regions(spark, d):
    c = src.compartments(spark, d)
    k = [*AT, "cell_id"]
    return c.select(*k), c.where(F.col("part") == "soma").select(*k)


@query("i01_partition_compartments", with_ctes("cells") + "SELECT field_id, y, x, cell_id, part FROM cells")
def i01(spark, d):
    return ledger.partition_compartments(*_split_regions(spark, d))


def _tampered(spark, d):
    """Drop the first process column of field 1 and grow the soma of field 2 over it."""
    c = src.compartments(spark, d)
    whole = c.select(*AT, "cell_id")
    soma = c.where((F.col("part") == "soma") | ((F.col("field_id") == "2") & (F.col("x") == 1))).select(*AT, "cell_id")
    proc = c.where((F.col("part") == "processes") & ~((F.col("field_id") == "1") & (F.col("x") == 0))).select(*AT, "cell_id")
    return whole, soma, proc


@query("i01_check_partition", with_ctes("cells") + """SELECT field_id, cell_id, 'not_covered' AS violation, count(*) AS pixels FROM cells WHERE field_id = '1' AND x = 0 AND part = 'processes' GROUP BY 1, 2
UNION ALL SELECT field_id, cell_id, 'overlap', count(*) FROM cells WHERE field_id = '2' AND x = 1 AND part = 'processes' GROUP BY 1, 2""")
def i01c(spark, d):
    return ledger.check_partition(*_tampered(spark, d))


def identities(spark, d):
    c = src.compartments(spark, d).select("field_id", "cell_id").distinct()
    f = F.col("field_id").cast("int")
    return c.select("field_id", F.col("cell_id").alias("label_id"), F.when(f % 10 == 3, F.least(F.col("cell_id"), F.lit(15))).otherwise(F.col("cell_id")).alias("original_id"),
                    F.concat(F.lit("cell-"), F.col("field_id"), F.lit("-"), F.when(f % 10 == 4, F.lit(1)).otherwise(F.col("cell_id"))).alias("cell_uid"))


@query("i02_check_triplet", with_ctes("cells") + """, f AS (SELECT DISTINCT field_id, CAST(field_id AS INT) % 10 AS k FROM cells)
SELECT field_id, unnest(CASE k WHEN 3 THEN ['original_id_not_unique'] WHEN 4 THEN ['cell_uid_not_unique'] WHEN 5 THEN ['ids_not_contiguous_soma', 'layer_ids_differ'] WHEN 6 THEN ['layer_ids_differ'] ELSE [] END) AS violation FROM f""")
def i02(spark, d):
    c = src.compartments(spark, d)
    f = F.col("field_id").cast("int") % 10
    parts = c.select("field_id", F.col("part").alias("layer"), "y", "x", F.col("cell_id").alias("label_id"))
    layers = parts.unionByName(parts.withColumn("layer", F.lit("whole")))
    # Fields 5: one soma missing in the middle; fields 6: the last process label missing.
    layers = layers.where(~((f == 5) & (F.col("layer") == "soma") & (F.col("label_id") == 4)) & ~((f == 6) & (F.col("layer") == "processes") & (F.col("label_id") == 16)))
    return ledger.check_triplet(layers, identities(spark, d))


@query("i03_check_edit_delta", with_ctes("cells") + """, f AS (SELECT DISTINCT field_id, CAST(field_id AS INT) % 4 AS k FROM cells)
SELECT field_id, unnest(CASE k WHEN 1 THEN ['other_cell_changed'] WHEN 2 THEN ['cell_count', 'enlarge_lost_pixels'] WHEN 3 THEN ['enlarge_lost_pixels'] ELSE [] END) AS violation FROM f""")
def i03(spark, d):
    before = src.compartments(spark, d).drop("height", "width")
    f = F.col("field_id").cast("int") % 4
    new = F.when((f == 2) & (F.col("cell_id") == 3) & (F.col("y") < 4), 17).otherwise(F.col("cell_id"))
    drop = ((f == 1) & (F.col("cell_id") == 9) & (F.col("y") % 8 == 0)) | ((f == 3) & (F.col("cell_id") == 3) & (F.col("x") % 8 == 0))
    after = before.where(~drop).withColumn("cell_id", new.cast("long"))
    edits = before.select("field_id").distinct().withColumns({"operation": F.lit("enlarge"), "cell_id": F.lit(3).cast("long")})
    return ledger.check_edit_delta(before, after, edits)


def _requests(spark, d):
    """Delete requests from all events, folded onto the sixteen cells of supplier fields; only clicks choose a cell."""
    cell = F.when(F.col("event_type") == "click", F.col("target_id") % 16 + 1).otherwise(1)
    return src.edits(spark, d).select("field_id", cell.alias("cell_id")).distinct()


@query("i04_edit_delete", with_ctes("cells", "ledger") + """, rq AS (SELECT DISTINCT field_id, CASE WHEN event_type = 'click' THEN target_id % 16 + 1 ELSE 1 END AS cell_id FROM ledger),
n AS (SELECT c.field_id, count(*) AS cells, count(rq.cell_id) AS requested FROM (SELECT DISTINCT field_id, cell_id FROM cells) c LEFT JOIN rq USING (field_id, cell_id) GROUP BY 1)
SELECT c.field_id, c.cell_id, count(*) AS pixels FROM cells c LEFT JOIN rq USING (field_id, cell_id) JOIN n ON n.field_id = c.field_id WHERE rq.cell_id IS NULL OR requested = cells GROUP BY 1, 2""")
def i04(spark, d):
    kept, _ = ledger.edit_delete(src.compartments(spark, d), _requests(spark, d))
    return kept.groupBy("field_id", "cell_id").agg(F.count(F.lit(1)).alias("pixels"))


@query("i05_edit_merge", with_ctes("cells", "ledger") + """, mg AS (SELECT DISTINCT field_id, target_id % 4 AS merge_id, CAST(CASE WHEN target_id % 4 = 3 THEN 12 + event_id % 3 * 2 ELSE target_id % 4 * 4 + event_id % 2 + 1 END AS BIGINT) AS cell_id
  FROM ledger WHERE field_id IN (SELECT field_id FROM cells)),
g AS (SELECT field_id, merge_id, count(*) AS n, min(cell_id) AS result_id, array_to_string(list_sort(list(cell_id)), ',') AS source_ids FROM mg GROUP BY 1, 2)
SELECT field_id, merge_id, result_id, source_ids, CASE WHEN n < 2 THEN 'too_few_cells' WHEN merge_id = 3 AND source_ids <> '12,16' THEN 'somas_not_connected' ELSE 'applied' END AS status FROM g""")
def i05(spark, d):
    e = src.edits(spark, d)
    far = F.col("target_id") % 4 == 3
    cell = F.when(far, 12 + F.col("event_id") % 3 * 2).otherwise(F.col("target_id") % 4 * 4 + F.col("event_id") % 2 + 1)
    m = e.select("field_id", (F.col("target_id") % 4).alias("merge_id"), cell.cast("long").alias("cell_id")).distinct()
    regions = src.compartments(spark, d)
    m = m.join(src.field_ids(spark, d), "field_id", "left_semi")
    # Soma gaps of neighbouring cells are four pixels: within 1 um at 0.2 um, beyond it at two cells' distance.
    return joined(ledger.edit_merge(regions, m, (0.2, 0.2))[1], "source_ids").select("field_id", "merge_id", "result_id", "source_ids", "status")


@query("i06_edit_trim", with_ctes("cells", "ledger") + """, st AS (SELECT DISTINCT field_id, CAST(target_id // 2 AS INT) AS y, CAST(event_id % 32 AS INT) AS x FROM ledger)
SELECT field_id, cell_id, count(*) AS deleted_px FROM cells JOIN st USING (field_id, y, x) WHERE part = 'processes' GROUP BY 1, 2""")
def i06(spark, d):
    e = src.edits(spark, d)
    s = e.select("field_id", F.floor(F.col("target_id") / 2).cast("int").alias("y"), (F.col("event_id") % 32).cast("int").alias("x"))
    return ledger.edit_trim(src.compartments(spark, d), s)[1].select("field_id", "cell_id", "deleted_px")


@query("i07_renumber", """WITH s AS (SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS field_id, o_custkey AS old_id FROM orders)
SELECT field_id, old_id, row_number() OVER (PARTITION BY field_id ORDER BY old_id) AS new_id FROM s""")
def i07(spark, d):
    o = src.table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("field_id"), F.col("o_custkey").alias("cell_id"))
    return ledger.renumber(o)


def actions(spark, d):
    """User events as edits: errors revert, everything else commits; some carry a base version."""
    e = src.edits(spark, d)
    return e.select("field_id", "sequence", F.when(F.col("event_type") == "error", "revert").otherwise(F.col("event_type")).alias("action"),
                    F.array("target_id").alias("source_ids"), F.lit(None).cast("long").alias("base_version"))


_LIFO = """ac AS (SELECT field_id, sequence, CASE WHEN event_type = 'error' THEN 'revert' ELSE event_type END AS action FROM ledger),
sm AS (SELECT *, sum(CASE WHEN action = 'revert' THEN -1 ELSE 1 END) OVER (PARTITION BY field_id ORDER BY sequence) AS s FROM ac),
mn AS (SELECT *, least(0, min(s) OVER (PARTITION BY field_id ORDER BY sequence)) AS m FROM sm),
dp AS (SELECT *, CAST(s - m AS BIGINT) AS depth, action = 'revert' AND s = m AND m < coalesce(lag(m) OVER (PARTITION BY field_id ORDER BY sequence), 0) AS refused FROM mn),
lw AS (SELECT *, min(depth) OVER (PARTITION BY field_id ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low FROM dp)"""


@query("i10_apply_ledger", with_ctes("ledger", extra=_LIFO) + """SELECT field_id, sequence, action, NOT refused AS accepted, depth,
  NOT refused AND action <> 'revert' AND coalesce(low < depth, false) AS reverted FROM lw""")
def i10(spark, d):
    return ledger.apply_ledger(actions(spark, d)).select("field_id", "sequence", "action", "accepted", "depth", "reverted")


@query("i10_accept_versions", with_ctes("ledger", extra="""ac AS (SELECT field_id, sequence, event_type = 'error' AS rv, CASE WHEN event_id % 3 = 0 THEN event_id % 9 END AS base FROM ledger),
st(field_id, sequence, status, version, depth) AS (SELECT DISTINCT field_id, CAST(0 AS BIGINT), 'start', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ac UNION ALL
  SELECT a.field_id, a.sequence, CASE WHEN a.base IS NOT NULL AND a.base <> s.version THEN 'stale_version' WHEN a.rv AND s.depth = 0 THEN 'nothing_to_revert' ELSE 'accepted' END,
  CASE WHEN (a.base IS NOT NULL AND a.base <> s.version) OR (a.rv AND s.depth = 0) THEN s.version ELSE s.version + 1 END,
  CASE WHEN (a.base IS NOT NULL AND a.base <> s.version) OR (a.rv AND s.depth = 0) THEN s.depth WHEN a.rv THEN s.depth - 1 ELSE s.depth + 1 END
  FROM st s JOIN ac a ON a.field_id = s.field_id AND a.sequence = s.sequence + 1)""") + "SELECT field_id, sequence, status, version, depth FROM st WHERE sequence > 0")
def i10v(spark, d):
    e = src.edits(spark, d)
    a = e.select("field_id", "sequence", F.when(F.col("event_type") == "error", "revert").otherwise("split").alias("action"),
                 F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 9).alias("base_version"))
    return ledger.accept_edits(a).select("field_id", "sequence", "status", "version", "depth")


@query("i10_accept_proposals", with_ctes("ledger", extra="""pr AS (SELECT field_id || '/' || ((sequence - 1) // 6) AS f, (sequence - 1) % 6 + 1 AS k, event_type = 'error' AS rv, event_id AS e,
  event_id * 7919 % 1000003 AS d1, event_id * 31 % 65537 AS d2 FROM ledger),
cl AS (SELECT *, coalesce(bit_xor(CASE WHEN NOT rv THEN d1 END) OVER w, 0) AS b1, coalesce(bit_xor(CASE WHEN NOT rv THEN d2 END) OVER w, 0) AS b2,
  k - 1 + CASE WHEN e % 13 = 0 THEN 1 ELSE 0 END AS bv, k + CASE WHEN e % 11 = 0 THEN 1 ELSE 0 END AS nv FROM pr WINDOW w AS (PARTITION BY f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st(f, k, status, v, c1, c2, undo) AS (SELECT DISTINCT f, CAST(0 AS BIGINT), 'start', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(v BIGINT, c1 BIGINT, c2 BIGINT, p1 BIGINT, p2 BIGINT)[]) FROM pr
  UNION ALL SELECT f, k, status, CASE WHEN status IN ('committed', 'reverted') THEN v + 1 ELSE v END,
    CASE status WHEN 'committed' THEN xor(c1, d1) WHEN 'reverted' THEN undo[-1].p1 ELSE c1 END, CASE status WHEN 'committed' THEN xor(c2, d2) WHEN 'reverted' THEN undo[-1].p2 ELSE c2 END,
    CASE status WHEN 'committed' THEN list_append(undo, {'v': v + 1, 'c1': xor(c1, d1), 'c2': xor(c2, d2), 'p1': c1, 'p2': c2}) WHEN 'reverted' THEN undo[:-2] ELSE undo END
  FROM (SELECT a.f, a.k, a.d1, a.d2, s.v, s.c1, s.c2, s.undo, CASE
    WHEN rv AND len(undo) = 0 THEN 'nothing_to_revert' WHEN rv AND (undo[-1].v <> s.v OR undo[-1].c1 <> s.c1 OR undo[-1].c2 <> s.c2) THEN 'changed_since_commit' WHEN rv THEN 'reverted'
    WHEN bv <> s.v THEN 'stale_version' WHEN b1 <> s.c1 OR b2 <> s.c2 THEN 'foreign_content' WHEN nv <> s.v + 1 THEN 'wrong_revision'
    WHEN xor(xor(b1, d1), CASE WHEN e % 7 = 0 THEN 1 ELSE 0 END) <> xor(s.c1, d1) THEN 'tampered_result' ELSE 'committed' END AS status
    FROM st s JOIN cl a ON a.f = s.f AND a.k = s.k + 1))""") + "SELECT f AS field_id, k AS sequence, status, v AS version, c1, c2, len(undo) AS depth FROM st WHERE k > 0")
def i10_proposals(spark, d):
    """Runs of six events as proposals: their clients took every earlier commit for granted, and some claim a wrong version, revision or result."""
    e = src.edits(spark, d)
    n, i = F.col("sequence") - 1, F.col("event_id")
    p = e.select(
        F.concat("field_id", F.lit("/"), F.floor(n / 6).cast("string")).alias("field_id"), (n % 6 + 1).alias("sequence"), F.when(F.col("event_type") == "error", "revert").otherwise("commit").alias("action"), i.alias("e"),
        (i * 7919 % 1000003).alias("delta_c1"), (i * 31 % 65537).alias("delta_c2"))
    before = Window.partitionBy("field_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    commits = lambda c: F.coalesce(F.bit_xor(F.when(F.col("action") == "commit", F.col(c))).over(before), F.lit(0))
    wrong = lambda k: (F.col("e") % k == 0).cast("long")
    p = p.withColumns({"base_c1": commits("delta_c1"), "base_c2": commits("delta_c2"), "base_version": F.col("sequence") - 1 + wrong(13), "result_version": F.col("sequence") + wrong(11)})
    p = p.withColumns({"result_c1": F.col("base_c1").bitwiseXOR(F.col("delta_c1")).bitwiseXOR(wrong(7)), "result_c2": F.col("base_c2").bitwiseXOR(F.col("delta_c2"))})
    none = p.select("field_id", *[F.lit(0).alias(c) for c in ("version", "c1", "c2")]).where("false")
    return ledger.accept_proposals(p, none).drop("accepted")


_NS = CELL_NAMESPACE.replace("-", "")


@query("i11_cell_identity", f"""WITH h AS (SELECT o_orderkey AS cell_id, sha1(unhex('{_NS}') || encode('initial:' || o_custkey || ':' || o_orderkey)) AS h FROM orders)
SELECT cell_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[CAST(('0x' || h[17]) AS INT) % 4 + 1] || h[18:20] || '-' || h[21:32] AS cell_uid FROM h""")
def i11(spark, d):
    o = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").cast("string").alias("s"))
    return ledger.initial_identity(o, CELL_NAMESPACE, F.col("s")).select("cell_id", "cell_uid")


@query("i12_lineage_maps", """WITH o AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS field_id, o_orderkey AS id FROM orders),
l AS (SELECT field_id, id // 3 AS label_id, id AS s FROM o WHERE id % 5 > 0 UNION ALL SELECT field_id, id // 3 + 1, id FROM o WHERE id % 5 > 0 AND id % 7 = 0)
SELECT o.field_id, o.id AS source_id, array_to_string(list_sort(list(DISTINCT label_id)), ',') AS final_ids, CASE WHEN count(label_id) = 0 THEN 'deleted' WHEN count(DISTINCT label_id) > 1 THEN 'split' ELSE 'kept' END AS status
FROM o LEFT JOIN l ON l.field_id = o.field_id AND l.s = o.id GROUP BY 1, 2""")
def i12(spark, d):
    o = src.table(spark, d, "orders").select((F.col("o_custkey") % 100).cast("string").alias("field_id"), F.col("o_orderkey").alias("original_id"))
    live = o.where(F.col("original_id") % 5 > 0)
    base = F.floor(F.col("original_id") / 3)
    rows = live.select("field_id", base.alias("label_id"), "original_id").unionByName(live.where(F.col("original_id") % 7 == 0).select("field_id", (base + 1).alias("label_id"), "original_id"))
    ident = rows.groupBy("field_id", "label_id").agg(F.min("original_id").alias("original_id"), F.collect_set("original_id").alias("lineage"))
    return joined(ledger.lineage_maps(ident, o), "final_ids").withColumn("final_ids", F.nullif(F.coalesce("final_ids", F.lit("")), F.lit("")))


@query("i15_state_hash", with_ctes("cells") + """, r AS (SELECT field_id, sha256(length(CAST(y AS VARCHAR)) || ':' || y || length(CAST(x AS VARCHAR)) || ':' || x || length(CAST(cell_id AS VARCHAR)) || ':' || cell_id || length(part) || ':' || part) AS h FROM cells),
b AS (SELECT field_id, h, CAST('0x' || substr(h, 1, 4) AS INT) % 16384 AS b FROM r),
i AS (SELECT field_id, b, sha256(array_to_string(list_sort(list(h)), ',')) AS h FROM b GROUP BY 1, 2),
m AS (SELECT field_id, b % 256 AS b, sha256(array_to_string(list_sort(list(h)), ',')) AS h FROM i GROUP BY 1, 2)
SELECT field_id, sha256(array_to_string(list_sort(list(h)), ',')) AS state_hash FROM m GROUP BY 1""")
def i15(spark, d):
    return ledger.state_hash(src.compartments(spark, d), ["y", "x", "cell_id", "part"])


@query("i16_transport_identity", """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS field_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
res AS (SELECT field_id, r AS label_id, r AS wish, 'u' || k AS cell_uid FROM o WHERE r % 4 <> 2 UNION ALL SELECT field_id, r, r, 'n' || k || 'a' FROM o WHERE r % 4 = 2
  UNION ALL SELECT field_id, 100000 + r, r, 'n' || k || 'b' FROM o WHERE r % 4 = 2),
x AS (SELECT *, row_number() OVER (PARTITION BY field_id, wish ORDER BY label_id) > 1 AS dup, max(wish) OVER (PARTITION BY field_id) AS top FROM res)
SELECT field_id, label_id, cell_uid, CAST(CASE WHEN dup THEN top + sum(CAST(dup AS INT)) OVER (PARTITION BY field_id ORDER BY label_id) ELSE wish END AS BIGINT) AS original_id FROM x""")
def i16(spark, d):
    from pyspark.sql import Window

    o = src.table(spark, d, "orders")
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    k = o.select(F.col("o_custkey").cast("string").alias("field_id"), F.col("o_orderkey").cast("string").alias("k"), r.alias("r"))
    prior = k.select("field_id", F.concat(F.lit("u"), F.col("k")).alias("cell_uid"), F.col("r").alias("original_id"), F.array("r").alias("lineage"))
    none = F.array().cast("array<string>")
    keep = k.where(F.col("r") % 4 != 2).select("field_id", F.col("r").alias("label_id"), F.concat(F.lit("u"), "k").alias("cell_uid"), F.lit(None).cast("string").alias("parent_uid"), none.alias("sources"))
    split = k.where(F.col("r") % 4 == 2)
    kid = lambda add, tag: split.select("field_id", (F.col("r") + add).alias("label_id"), F.concat(F.lit("n"), "k", F.lit(tag)).alias("cell_uid"), F.concat(F.lit("u"), "k").alias("parent_uid"), none.alias("sources"))
    res = keep.unionByName(kid(0, "a")).unionByName(kid(100000, "b"))
    return ledger.transport_identity(res, prior).select("field_id", "label_id", "cell_uid", "original_id")
