"""Merkle fixity audit of archives and their replicas (operator 4).

Every record is hashed with its offset and length. Leaves cover fixed ranges of
LEAF_BYTES of an archive: the records that start in a range, in order of offset.
FAN neighbouring nodes make one node of the level above, up to one root for each
archive. Two replicas are compared root by root; only the children of nodes that
differ are looked at on the next level, and only the records of differing leaves
are compared one by one. A node never gathers more than FAN children, and a leaf
no more records than fit its range.

Records with the same archive and offset (overlapping writes) are one slot: their
digests are hashed together in order.

Defined results: a null payload is hashed like an empty one but with length -1;
records without archive or offset can't be placed and are reported as ``unplaced``;
archives that only one replica has are reported record by record as ``missing`` or
``extra``; two empty replicas give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterspark.llm.common import table, written

LEAF_BYTES = 65_536
FAN = 16
#: Pages of one archive in the query; an archive is a file of bounded size.
ARCHIVE_PAGES = 500


def record_hash(payload: str = "payload") -> Column:
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    size = F.when(F.col(payload).isNull(), F.lit(-1)).otherwise(F.octet_length(body))
    return F.sha2(F.concat_ws(":", F.col("offset").cast("string"), size.cast("string"), F.sha2(body, 256)).cast("binary"), 256)


def _joined(order: str, digest: str) -> Column:
    """Hash of the digests of a bounded group, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order, digest)))
    return F.sha2(F.array_join(F.transform(pairs, lambda p: p[digest]), "").cast("binary"), 256)


def slots(records: DataFrame) -> DataFrame:
    """(archive, offset, hash, n): one row for each start of a record."""
    placed = records.where(F.col("archive").isNotNull() & F.col("offset").isNotNull())
    hashed = placed.select(F.col("archive").cast("string").alias("archive"), F.col("offset").cast("long").alias("offset"), record_hash().alias("hash"))
    one = F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), "").cast("binary"), 256)
    return hashed.groupBy("archive", "offset").agg(F.when(F.count("hash") == 1, F.min("hash")).otherwise(one).alias("hash"), F.count("hash").alias("n"))


def tree(rows: DataFrame, leaf_bytes: int = LEAF_BYTES, fan: int = FAN) -> list[DataFrame]:
    """Levels of the trees of all archives, leaves first: (archive, node, digest). The last level has node 0 only."""
    leaf = rows.select("archive", F.expr(f"offset div {int(leaf_bytes)}").alias("node"), "offset", "hash")
    level = written(leaf.groupBy("archive", "node").agg(_joined("offset", "hash").alias("digest")))
    levels = [level]
    top = level.agg(F.max("node")).first()[0] or 0
    while top > 0:
        up = level.select("archive", F.expr(f"node div {int(fan)}").alias("up"), "node", "digest")
        level = written(up.groupBy("archive", F.col("up").alias("node")).agg(_joined("node", "digest").alias("digest")))
        levels.append(level)
        top //= fan
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, node) where the two levels differ; a node that one side lacks differs."""
    other = b.select("archive", "node", F.col("digest").alias("_other"))
    return a.join(other, ["archive", "node"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("_other"))).select("archive", "node")


def audit(first: DataFrame, second: DataFrame, leaf_bytes: int = LEAF_BYTES, fan: int = FAN) -> DataFrame:
    """(archive, offset, kind, first_hash, second_hash) of every record that differs.

    ``first`` and ``second`` have archive, offset and payload. kind is ``changed``,
    ``missing`` (only the first replica has it), ``extra`` or ``unplaced``.
    """
    left, right = written(slots(first)), written(slots(second))
    lefts, rights = tree(left, leaf_bytes, fan), tree(right, leaf_bytes, fan)
    while len(lefts) < len(rights):
        lefts.append(_raised(lefts[-1], fan))
    while len(rights) < len(lefts):
        rights.append(_raised(rights[-1], fan))
    bad = _differing(lefts[-1], rights[-1])
    for a, b in zip(reversed(lefts[:-1]), reversed(rights[:-1])):
        bad = written(bad)
        if bad.isEmpty():
            break
        up = bad.select("archive", F.col("node").alias("_up"))
        under = [x.withColumn("_up", F.expr(f"node div {int(fan)}")).join(up, ["archive", "_up"], "left_semi") for x in (a, b)]
        bad = _differing(*under)
    bad = written(bad).withColumnRenamed("node", "_leaf")
    sides = []
    for rows, name in ((left, "first_hash"), (right, "second_hash")):
        at = rows.withColumn("_leaf", F.expr(f"offset div {int(leaf_bytes)}")).join(bad, ["archive", "_leaf"], "left_semi")
        sides.append(at.select("archive", "offset", F.col("hash").alias(name)))
    both = sides[0].join(sides[1], ["archive", "offset"], "full_outer").where(~F.col("first_hash").eqNullSafe(F.col("second_hash")))
    kind = F.when(F.col("second_hash").isNull(), "missing").when(F.col("first_hash").isNull(), "extra").otherwise("changed")
    found = both.select("archive", "offset", kind.alias("kind"), "first_hash", "second_hash")
    for records, column in ((first, "first_hash"), (second, "second_hash")):
        lost = records.where(F.col("archive").isNull() | F.col("offset").isNull())
        other = "second_hash" if column == "first_hash" else "first_hash"
        found = found.unionByName(
            lost.select(
                F.col("archive").cast("string").alias("archive"), F.col("offset").cast("long").alias("offset"), F.lit("unplaced").alias("kind"),
                record_hash().alias(column), F.lit(None).cast("string").alias(other),
            )
        )
    return found


def _raised(level: DataFrame, fan: int) -> DataFrame:
    """The level above a root."""
    up = level.select("archive", F.expr(f"node div {int(fan)}").alias("up"), "node", "digest")
    return up.groupBy("archive", F.col("up").alias("node")).agg(_joined("node", "digest").alias("digest"))


def page_records(pages: DataFrame) -> DataFrame:
    """Pages as WARC records: (archive, offset, payload, page_id); an archive has the pages of one block of ids."""
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(F.col("url"), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    rows = pages.where(F.col("page_id").isNotNull()).select(
        "page_id", F.concat(F.lit("part-"), F.expr(f"page_id div {ARCHIVE_PAGES}")).alias("archive"), F.concat(head, body, F.lit("\r\n\r\n")).alias("payload")
    )
    before = Window.partitionBy("archive").orderBy("page_id", F.xxhash64("payload")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.octet_length("payload")).over(before), F.lit(0)))


def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives of all pages against a replica in which some records were damaged, lost or added."""
    records = written(page_records(table(spark, sf_dir, "pages")))
    fate = F.expr("page_id * 7919 % 50")
    flipped = F.concat(F.expr("substring(payload, 1, length(payload) - 5)"), F.lit("#"), F.expr("right(payload, 4)"))
    kept = records.where(fate != 1).select("archive", "offset", F.when(fate == 0, flipped).otherwise(F.col("payload")).alias("payload"))
    added = records.where(fate == 2).select("archive", (F.col("offset") + 1).alias("offset"), "payload")
    return audit(records.select("archive", "offset", "payload"), kept.unionByName(added))


ORACLE = f"""
WITH p AS (SELECT page_id, page_id * 7919 % 50 AS fate, 'part-' || page_id // {ARCHIVE_PAGES} AS archive,
    'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nContent-Length: ' || strlen(coalesce(html, ''))
    || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n' AS payload FROM pages WHERE page_id IS NOT NULL),
r AS (SELECT *, CAST(coalesce(sum(strlen(payload)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p),
copies AS (SELECT fate, archive, "offset", payload, 1 AS side FROM r
    UNION ALL SELECT fate, archive, "offset", CASE WHEN fate = 0 THEN left(payload, length(payload) - 5) || '#' || right(payload, 4) ELSE payload END, 2 FROM r WHERE fate <> 1
    UNION ALL SELECT fate, archive, "offset" + 1, payload, 2 FROM r WHERE fate = 2),
hashed AS (SELECT archive, "offset", side, sha256("offset" || ':' || strlen(payload) || ':' || sha256(payload)) AS h FROM copies),
sides AS (SELECT archive, "offset", max(h) FILTER (side = 1) AS first_hash, max(h) FILTER (side = 2) AS second_hash FROM hashed GROUP BY ALL)
SELECT archive, "offset", CASE WHEN second_hash IS NULL THEN 'missing' WHEN first_hash IS NULL THEN 'extra' ELSE 'changed' END AS kind, first_hash, second_hash
FROM sides WHERE first_hash IS DISTINCT FROM second_hash
""".replace("\r\n", "' || chr(13) || chr(10) || '")
