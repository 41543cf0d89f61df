"""SimHash near-dedup by deletion-variant signatures (operator 9).

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints
differ in at most three bits, one segment differs in at most one. So every
distinct fingerprint is indexed under the exact value of each segment and under
its 32 one-wildcard variants (one bit blanked). Equal keys meet by an equality
join, and every pair that meets is verified on all 64 bits. A wildcard key
only pairs fingerprints whose blanked bits differ, so a pair meets at most once
for a segment.

Only distinct fingerprints are indexed: any number of copies is one row. A key
gives a spanning forest of its verified links, never all its pairs. A key with
more than BLOCK fingerprints is dealt out as pairs of blocks, so no task holds
more than about two blocks of one key, and every pair of its rows still meets.

Defined results: null text is an empty text, with fingerprint zero, which links
like any other; a component of rows without doc_id has a null component_id;
repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm import minhash
from rasterspark.llm.common import map_rows, table, text_key, text_or_empty, written
from rasterspark.operators.graph import label_closure

#: Most fingerprints of one key in a block.
BLOCK = 1024

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of one text: a bit is 1 if more than half the hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        whole = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        shingles = [whole[s : e - 1] for s, e in zip(starts, ends[width - 1 :])]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of ``hashes`` have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batch: pa.RecordBatch) -> dict:
    prints = np.array([fingerprint(t) for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
    return {n: batch.column(n) for n in ("_k1", "_k2", "doc_id")} | {"fp": pa.array(prints)}


def fingerprints(docs: DataFrame) -> DataFrame:
    """(_k1, _k2, doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    rows = docs.select(*text_key(), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    return map_rows(rows, "_k1 long, _k2 long, doc_id long, fp long", _fingerprints, by="_text")


def _forest(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(smallest, member) of every component of ``values`` linked at ``bits`` or fewer differing bits."""
    values = np.unique(values)
    out, rest = [], values
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        frontier = [seed]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= bits
            if near.any():
                found = rest[near].tolist()
                out += [(int(seed), v) for v in found]
                frontier += list(rest[near])
                rest = rest[~near]
    return out


def _links(bits: int):
    def run(batch: pa.RecordBatch) -> dict | None:
        lists = batch.column("_fps")
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(lists.offsets.to_numpy())
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        two = starts[sizes == 2]
        a, b = flat[two], flat[two + 1]
        near = np.bitwise_count(a ^ b) <= bits
        left, right = [np.minimum(a[near], b[near])], [np.maximum(a[near], b[near])]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if pairs := np.array(_forest(flat[s : s + n], bits), np.uint64).reshape(-1, 2).tolist():
                pairs = np.array(pairs, np.uint64)
                left.append(pairs[:, 0])
                right.append(pairs[:, 1])
        left, right = np.concatenate(left), np.concatenate(right)
        return {"a": pa.array(left.view(np.int64)), "b": pa.array(right.view(np.int64))} if len(left) else None

    return run


def links(distinct: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that join exactly the fingerprints which links of at most ``bits`` (0 to 3) bits join.

    ``distinct`` has one long column ``fp`` without repeats.
    """
    slot = F.explode(F.sequence(F.lit(0), F.lit(65))).alias("_slot")
    keyed = distinct.select("fp", slot).select(
        "fp", "_slot", (F.col("_slot") % 33).alias("_w"), F.expr("shiftrightunsigned(fp, 32 * (_slot div 33)) & 4294967295L").alias("_v")
    )
    keyed = keyed.select(
        "fp",
        F.expr("shiftleft(CAST(_slot AS LONG), 32) | IF(_w = 32, _v, _v & ~shiftleft(1L, _w))").alias("_key"),
        F.expr("IF(_w = 32, 2, CAST(shiftrightunsigned(_v, _w) & 1L AS INT))").alias("_side"),
    )
    live = (
        keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
        .where((F.col("_n") > 1) & ((F.col("_lo") == 2) | (F.col("_lo") != F.col("_hi"))))
        .select("_key", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_g"))
    )
    # The planner doesn't count exploded rows and would collect and broadcast them; so it is for all joins below.
    met = keyed.join(live.hint("merge"), "_key").select("_key", "_g", "fp", F.pmod(F.xxhash64("fp"), F.col("_g")).cast("int").alias("_b"))
    other = F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_o")
    dealt = met.select("_key", "_g", "fp", "_b", other).select("_key", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "fp")
    gathered = dealt.groupBy("_key", "_i", "_j").agg(F.collect_list("fp").alias("_fps")).where(F.size("_fps") > 1)
    return map_rows(gathered.select("_fps"), "a long, b long", _links(bits), rows=5000).distinct()


def components(prints: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint; component_id is the smallest doc_id that is reachable.

    ``prints`` has (doc_id, fp) of every row.
    """
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("_least")))
    edges = written(links(distinct.select("fp"), bits, block))
    roots = label_closure(edges, keys=[]).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rooted.select("fp", "root").join(least.hint("merge"), "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    prints = written(fingerprints(docs))
    return prints.join(components(prints, bits).hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one with the smallest doc_id (null last).

    Documents are linked by the Jaccard similarity of their five-word shingles, from four
    fifths on. The fingerprints of these shingles are linked by this operator, and its
    components are verified first; two documents at four fifths differ in about ten bits
    of a fingerprint, so what three bits can't reach is proposed by minimal hashes
    (minhash.py) and verified in the same way. Of rows that agree in doc_id and text one
    stays; null text is an empty text; an empty table gives no rows.
    """
    rows = written(minhash.sketches(docs, majority))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")
    best = rows.join(minhash.components(rows, docs, components), "_set").groupBy("root").agg(F.min(rank).alias("_best"))
    keep = best.select("_best._k1", "_best._k2").distinct()
    k1, k2 = text_key()
    named = docs.withColumns({"_k1": k1, "_k2": k2}).join(keep, ["_k1", "_k2"])
    return named.dropDuplicates(["_k1", "_k2"]).select(*docs.columns)
