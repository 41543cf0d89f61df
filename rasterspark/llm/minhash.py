"""Near-duplicates by word shingles: groups proposed by keys, verified by their exact Jaccard similarity.

Documents are compared by their sets of WIDTH-word shingles and are linked from
SIMILARITY on. Sets that have a key in common are compared: first those that the caller
groups by fingerprints, then those with a band of minimal hashes in common. A set has
BANDS * ROWS minimal hashes, and two sets meet where all ROWS hashes of a band agree: at
similarity s with probability 1 - (1 - s^ROWS)^BANDS, 0.9993 at 0.8. Whatever meets is
verified on the shingles, so nothing below SIMILARITY is linked.

Equal sets are one row from the start. The sets of a key are dealt to blocks, each with
the shingles of its sets, and a block gives a spanning forest of its links: whether two
sets of one component are alike is not asked. The fingerprint groups and the first FIRST
bands are compared within blocks first, which unites nearly all of a large family. Then
every key, fingerprint groups too, whose sets are still in different components is dealt out in cells: a
component too large for a block has cells of its own, the others share some; all pairs
of cells meet but those of one component, so no pair in different components is missed.

Defined results: a text of fewer than WIDTH words is one shingle; texts without words
are alike.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterspark.llm.common import discard, map_rows, text_key, text_or_empty, written
from rasterspark.operators.graph import label_closure

WIDTH = 5
SIMILARITY = Fraction(4, 5)
BANDS, ROWS = 24, 6
#: Bands that are compared within blocks first.
FIRST = 4
#: Most sets and shingles (8 bytes each) of a block, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64)
_BAND_FACTORS = _RANDOM.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(whole)] if words else [], np.uint64)
    return np.unique(np.fromiter((digest(whole[s : e - 1]) for s, e in zip([0, *ends], ends[width - 1 :])), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimal hash under each permutation; all ones for an empty set."""
    out = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        np.minimum(out, ((part[None, :] ^ _SHIFTS[:, None]) * _FACTORS[:, None]).min(1), out=out)
    return out


def sketches(docs: DataFrame, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """(_k1, _k2, doc_id, _set, _size, fp, _bands) of every row; _set names the set of shingles, fp is its fingerprint."""
    rows = docs.select(*text_key(), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))

    def run(batch: pa.RecordBatch) -> dict:
        names, sizes, prints, bands = [], [], [], []
        for text in batch.column("_text").to_pylist():
            hashes = shingle_set(text)
            names.append(xxhash.xxh64_intdigest(hashes.tobytes()))
            sizes.append(len(hashes))
            prints.append(fingerprint(hashes))
            bands.append((minima(hashes).reshape(BANDS, ROWS) * _BAND_FACTORS).sum(1, dtype=np.uint64).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(bands)))
        return {n: batch.column(n) for n in ("_k1", "_k2", "doc_id")} | {
            "_set": pa.array(np.array(names, np.uint64).view(np.int64)), "_size": pa.array(sizes, pa.int64()),
            "fp": pa.array(np.array(prints, np.uint64).view(np.int64)), "_bands": lists,
        }

    return map_rows(rows, "_k1 long, _k2 long, doc_id long, _set long, _size long, fp long, _bands array<long>", run, by="_text")


def _shingled(batch: pa.RecordBatch) -> dict:
    sets = [shingle_set(t).view(np.int64) for t in batch.column("_text").to_pylist()]
    ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
    return {"_set": batch.column("_set"), "_shingles": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))}


def forest(sizes: np.ndarray, shingles: np.ndarray, roots: np.ndarray, least: Fraction = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of roots: a spanning forest of the links between sets of different roots.

    ``shingles`` holds the distinct shingles of all sets, one set after the other.
    """
    n = len(sizes)
    component = np.unique(roots, return_inverse=True)[1]
    left = int(component.max(initial=-1)) + 1
    ends = np.cumsum(sizes)
    _, number, count = np.unique(shingles, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)[np.argsort(number, kind="stable")]
    first = np.cumsum(count) - count
    out = []
    for i in range(n):
        if left == 1:
            break
        own = number[ends[i] - sizes[i] : ends[i]]
        own = own[count[own] > 1]
        many = count[own]
        inside = np.arange(int(many.sum())) + np.repeat(first[own] - (np.cumsum(many) - many), many)
        both = np.bincount(owner[inside], minlength=n)
        near = (both * least.denominator >= least.numerator * (sizes[i] + sizes - both)) & (component != component[i])
        for j in np.flatnonzero(near).tolist():
            if component[j] != component[i]:
                out.append((int(roots[i]), int(roots[j])))
                component[component == component[j]] = component[i]
                left -= 1
    return out


def _edges(block: pa.Table) -> pa.Table:
    """The forest of one block."""
    roots = block.column("root").to_numpy()
    sets = block.column("_shingles").combine_chunks()
    sizes = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    found = np.array(forest(sizes, flat, roots), np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(found.min(1)), "b": pa.array(found.max(1))} if len(found) else {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _gathered(dealt: DataFrame, keys: list[str], shingles: DataFrame) -> DataFrame:
    """(a, b) of roots for rows (keys, _set, root); a task holds one block at a time."""
    rows = dealt.join(shingles, "_set").select(*keys, "root", "_shingles")
    return written(rows.groupBy(*keys).applyInArrow(_edges, "a long, b long"))


def _blocks(sets: str, size: str, block: int) -> Column:
    """Blocks for so many sets with so many shingles."""
    return F.greatest(F.ceil(F.col(sets) / F.lit(block)), F.ceil(F.col(size) / F.lit(BLOCK_SHINGLES))).cast("long")


def within_blocks(keyed: DataFrame, shingles: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links inside the blocks of each key of ``keyed`` (_key, _set, _size, root)."""
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"), F.min("root").alias("_lo"), F.max("root").alias("_hi"))
    # Counted tables are written before they are joined: a join of two plain shuffles can split a hot key.
    sizes = written(sizes.where("_lo != _hi").select("_key", _blocks("_n", "_s", block).alias("_g")))
    dealt = keyed.join(sizes, "_key").select("_key", F.pmod(F.xxhash64("_set", "_key"), F.col("_g")).alias("_cell"), "_set", "root")
    return _gathered(dealt, ["_key", "_cell"], shingles)


def between_cells(keyed: DataFrame, shingles: DataFrame, block: int = BLOCK) -> DataFrame:
    """All links between sets of different roots that have a key in common."""
    parts = written(keyed.groupBy("_key", "root").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s")))
    parts = parts.withColumn("_g", _blocks("_n", "_s", block))
    # Of a key: small components share cells, each large one has its own.
    large = F.col("_g") > 1
    both = parts.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_roots"), F.sum(F.when(~large, F.col("_n"))).alias("_n"), F.sum(F.when(~large, F.col("_s"))).alias("_s"),
        F.flatten(F.collect_list(F.when(large, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_g") - 1), lambda i: F.struct(F.col("root").alias("of"), i.alias("no")))))).alias("_own"),
    )
    # A list of cells: sets of the key over sets of a block.
    shared = F.coalesce(_blocks("_n", "_s", block), F.lit(0).cast("long"))
    common = F.when(shared > 0, F.transform(F.sequence(F.lit(0).cast("long"), shared - 1), lambda i: F.struct(F.lit(None).cast("long").alias("of"), i.alias("no"))))
    cells = F.concat(F.coalesce(common, F.expr("array()").cast("array<struct<of:bigint,no:bigint>>")), "_own")
    keys = written(both.where("_roots > 1").select("_key", shared.alias("_shared"), cells.alias("_cells")))
    big = written(parts.where(large).select("_key", "root", "_g"))
    met = keyed.join(big, ["_key", "root"], "left").join(keys, "_key")
    mine = F.when(F.col("_g").isNotNull(), F.struct(F.col("root").alias("of"), F.pmod(F.xxhash64("_set"), F.col("_g")).alias("no")))
    mine = F.coalesce(mine, F.struct(F.lit(None).cast("long").alias("of"), F.pmod(F.xxhash64("root"), F.col("_shared")).alias("no")))
    met = met.select("_key", "_set", "root", "_cells", mine.alias("_mine"))
    other = F.explode(F.expr("filter(transform(_cells, (c, i) -> struct(i AS i, c AS c)), x -> x.c.of IS NULL OR _mine.of IS NULL OR x.c.of != _mine.of).i")).alias("_o")
    met = met.withColumn("_i", (F.array_position("_cells", F.col("_mine")) - 1).cast("int")).select("_key", "_set", "root", "_i", other)
    dealt = met.select("_key", F.least("_i", "_o").alias("_i"), F.greatest("_i", "_o").alias("_o"), "_set", "root")
    return _gathered(dealt, ["_key", "_i", "_o"], shingles)


def _joined(rooted: DataFrame, edges: DataFrame) -> DataFrame:
    """``rooted`` (_set, root) after the links ``edges`` of roots."""
    closed = label_closure(edges, keys=[]).select(F.col("node").alias("root"), F.col("root").alias("_new"))
    return written(rooted.join(closed, "root", "left").select("_set", "_size", F.coalesce("_new", "root").alias("root")))


def components(rows: DataFrame, docs: DataFrame, propose: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """(_set, root) of every distinct set of shingles; ``rows`` are the sketches of ``docs``.

    ``propose`` groups fingerprints: from (doc_id, fp) it makes (fp, root).
    """
    of_set = F.min(F.struct("_k1", "_k2", "_size", "fp", "_bands")).alias("_one")
    sets = written(rows.groupBy("_set").agg(of_set).select("_set", "_one.*"))
    groups = propose(sets.select(F.col("_set").alias("doc_id"), "fp")).select("fp", F.col("root").alias("_key"))
    keyed = sets.join(groups, "fp").select("_key", "_set", "_size", F.lit(-1).alias("_band"))
    keyed = keyed.unionByName(sets.select("_set", "_size", F.posexplode("_bands").alias("_band", "_key")))
    counts = keyed.groupBy("_key", F.col("_band") < 0).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    counts = written(counts.toDF("_key", "_fp", "_n").select("_key", "_fp"))
    keyed = written(keyed.withColumn("_fp", F.col("_band") < 0).join(counts, ["_key", "_fp"]).select("_key", "_set", "_band"))
    needed = written(sets.select("_set", "_k1", "_k2").join(keyed.select("_set").distinct(), "_set"))
    texts = docs.select(*text_key(), text_or_empty().alias("_text")).join(needed, ["_k1", "_k2"]).select("_set", "_text")
    # Rows that agree in doc_id and text name one set.
    shingles = map_rows(texts, "_set long, _shingles array<long>", _shingled, by="_text")
    shingles = written(shingles.dropDuplicates(["_set"]))

    rooted = sets.select("_set", "_size", F.col("_set").alias("root"))
    # What the blocks of a key leave apart is compared by the last step, which takes every key.
    for bands, compare in (("_band < 0", within_blocks), (f"_band >= 0 AND _band < {FIRST}", within_blocks), ("true", between_cells)):
        now = keyed.where(bands).drop("_band").join(rooted, "_set")
        rooted = _joined(rooted, compare(now, shingles, block))
    # The roots are a written table by now; the sets and their shingles are not needed again.
    discard(shingles, keyed, sets)
    return rooted.select("_set", "root")
