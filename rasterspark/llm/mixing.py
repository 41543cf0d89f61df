"""Mixing sources to target weights by Pfair scheduling (operator 7).

The documents of a source, in the order of a hash, are cut into blocks of
BLOCK_DOCS. Block j (from 1) of a source with weight w is released at slot
floor((j - 1) / w) and due at slot ceil(j / w); each slot takes the released block
with the earliest deadline. So at any slot every source has got its share to within
less than one block.

Weights are exact: whole numbers of any size, with their sum as denominator, and never
rounded to slots of a frame. One task walks the slots of the whole horizon and writes
them as a table as it goes; all it holds is one block number a source. Numbering the
documents of a source needs no task with a whole source: they are dealt into hash
ranges of about RANGE_DOCS, counted, and numbered within.

The horizon is the shortest one in which every document is emitted: the source that
is longest for its weight is emitted once, the others begin again (the next epoch)
until the horizon. Nothing is dropped.

Defined results: a null source is a source of its own; weights for sources without
documents are left out, sources without a weight are an error; rows that agree in
doc_id and text stand side by side; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterspark.llm.common import table, text_key, written

BLOCK_DOCS = 16
RANGE_DOCS = 4096
#: Target weight of a source is its number of documents to this power.
POWER = 0.9


def whole_weights(weights: dict) -> dict:
    """``weights`` as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    by = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * by) for s, x in exact.items()}


def edf(weights: list[int]) -> Iterator[tuple[int, int]]:
    """(source, its how manieth block from 0) of every slot, without end; ``weights`` are whole numbers."""
    total = sum(weights)
    waiting = [(0, i, 1) for i in range(len(weights))]  # by release
    ready: list[tuple[int, int, int]] = []  # by deadline
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // weights[i]), i, j))
        _, i, j = heapq.heappop(ready)
        yield i, j - 1
        heapq.heappush(waiting, (j * total // weights[i], i, j + 1))
        slot += 1


def schedule(spark: SparkSession, weights: list[int], blocks: list[int]) -> DataFrame:
    """(_i, block, epoch, slot) of every slot until each source has had each of its ``blocks`` once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            open_, slot, slots = sum(n > 0 for n in blocks), 0, edf(weights)
            while open_:
                part = []
                while open_ and len(part) < 8192:
                    i, number = next(slots)
                    open_ -= number + 1 == blocks[i]
                    part.append((i, number % blocks[i], number // blocks[i], slot))
                    slot += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=["_i", "block", "epoch", "slot"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "_i long, block long, epoch long, slot long")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_src`` and ``_no``, the dense number from 0 of a row in its source by a hash of its key (_k1, _k2 if given)."""
    k1, k2 = (F.col("_k1"), F.col("_k2")) if {"_k1", "_k2"} <= set(docs.columns) else text_key()
    keyed = docs.withColumns({"_k1": k1, "_k2": k2, "_src": F.col("source").cast("string")})
    keyed = keyed.withColumn("_h", F.xxhash64("_k1", "_k2").bitwiseAND(F.lit(2**40 - 1)))
    counts = keyed.groupBy("_src").agg(F.ceil(F.count(F.lit(1)) / F.lit(RANGE_DOCS)).cast("long").alias("_ranges"))
    # A few numbers for each source; left to the size-checked planner.
    wide = keyed.join(counts, keyed["_src"].eqNullSafe(counts["_src"])).drop(counts["_src"])
    wide = wide.withColumn("_range", F.expr("_h * _ranges div 1099511627776"))
    sizes = written(wide.groupBy("_src", "_range").agg(F.count(F.lit(1)).alias("_size")))
    before = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_src").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    at = wide.join(starts, wide["_src"].eqNullSafe(starts["_s"]) & (wide["_range"] == starts["_r"])).drop("_s", "_r")
    within = Window.partitionBy("_src", "_range").orderBy("_h", "_k1", "_k2")
    return at.withColumn("_no", F.col("_start") + F.row_number().over(within) - 1).drop("_h", "_ranges", "_range", "_start")


def mix(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` in mixed order: columns slot, block, epoch and place (within the block) are added (or replaced).

    ``weights`` maps every source to a positive number; without it they follow POWER.
    """
    spark = docs.sparkSession
    docs = docs.drop("slot", "block", "epoch", "place")
    counts = {r[0]: r[1] for r in docs.groupBy(F.col("source").cast("string")).count().collect()}  # one number a source
    if not counts:
        return docs.select("*", *[F.lit(0).cast("long").alias(c) for c in ("slot", "block", "epoch", "place")])
    if weights is None:
        weights = {s: round(n**POWER * 1000) for s, n in counts.items()}
    if unknown := [s for s in counts if not weights.get(s, 0) > 0]:
        raise ValueError(f"sources without a positive weight: {unknown[:5]}")
    whole = whole_weights({s: weights[s] for s in counts})
    names = sorted(counts, key=lambda s: (s is None, str(s)))
    plan = written(schedule(spark, [whole[s] for s in names], [-(-counts[s] // block_docs) for s in names]))
    rows = numbered(docs).withColumn("block", F.expr(f"_no div {int(block_docs)}"))
    index = spark.createDataFrame(list(enumerate(names)), "_i long, _s string")  # a row a source
    rows = rows.join(index, rows["_src"].eqNullSafe(index["_s"])).drop("_s")
    placed = rows.join(plan, ["_i", "block"])
    return placed.select(*docs.columns, "slot", "block", "epoch", (F.col("_no") % F.lit(block_docs)).alias("place"))


def placed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (_k1, _k2, ...), one for each emission that ``stage`` made, with slot, epoch and place.

    ``docs`` is what ``stage`` returned; its distinct documents are scheduled once more by their keys alone,
    which gives the same order. A document's rows are alike, so any of them stands for any of its epochs.
    """
    once = docs.select(*text_key(), "source").dropDuplicates(["_k1", "_k2"])
    order = mix(written(once)).select("_k1", "_k2", "slot", "epoch", "place")
    turn = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(F.lit(0))) - 1
    return rows.withColumn("epoch", turn.cast("long")).join(order, ["_k1", "_k2", "epoch"])


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, slot, block, epoch and place of every emission."""
    docs = table(spark, sf_dir, "documents")
    # Only a digest of each text travels; it is part of the key that orders a source.
    return mix(docs.select("doc_id", "source", F.xxhash64("text").cast("string").alias("text"))).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents in mixed order; those of later epochs occur again.

    A table keeps rows and not their order, and the columns are those of documents; the stage
    behind this one gets every row's slot, epoch and place back from ``placed``. Documents are
    told apart by doc_id and text (the near-dup stage leaves no two alike). A null source is a source.
    """
    return mix(docs).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*docs.columns)
