"""Approximate nearest neighbours by an adaptive dimension scan (operator 5).

Largest inner product becomes smallest distance by one more dimension (each vector
is scaled by the longest norm and completed to length 1). Distinct vectors are
dealt to the lists of a k-means index. A query scans its nearest lists; within a
list the vectors, turned by a random rotation, are read in blocks of columns. After
each block a hypothesis test on the partial distance, scaled up to all dimensions,
abandons candidates that are too far to enter the query's best so far. What is left
is scored in double precision on the original vectors.

Copies of a vector are one entry with its smallest ids, K + 1 of them: more can
never be among K nearest. Equal queries are searched once. Lists are packed into
shards of at most SHARD vectors and queries into blocks of at most QUERIES; a large
list takes several shards, so no task depends on how vectors cluster. A shard meets
exactly the blocks with a query that probes one of its lists.

The index is fitted on SAMPLE vectors (chosen by hash), every row is indexed. On
the same sample the number of probed lists is set to the least one with a recall of
TARGET against brute force; a sample is sparser than the table, so its neighbours
are farther apart and that number is on the safe side.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do vectors of another length than most have; rows
without vec_id take no part; rows that repeat a vec_id are one candidate id, and
never neighbours of themselves; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterspark.llm.common import table, written

K = 20
SAMPLE = 16_384
LIST_ROWS = 400
MAX_LISTS = 4096
SHARD = 4096
QUERIES = 256
TARGET = 0.97
#: Columns of a block, and how many standard deviations a partial distance may be off.
BLOCK = 16
DOUBT = 2.5




def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


class Index:
    """Centroids, scale and rotation; small enough to go along with every task."""

    def __init__(self, sample: np.ndarray, rows: int, longest: float, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.longest = longest
        self.dims = sample.shape[1] + 1
        points = self.lift(sample)
        lists = int(np.clip(rows // LIST_ROWS, 1, min(MAX_LISTS, len(points))))
        self.centroids = points[rng.choice(len(points), lists, replace=False)]
        for _ in range(8):
            near = self.rank(points)[0].argmax(1)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, points)
            filled = np.bincount(near, minlength=lists)
            # An empty list starts again from some point.
            again = points[rng.choice(len(points), lists)]
            self.centroids = np.where(filled[:, None] > 0, sums / np.maximum(filled, 1)[:, None], again)
        self.rotation = np.linalg.qr(rng.standard_normal((self.dims, self.dims)))[0]
        self.probes = self._probes(sample, points)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.longest
        rest = np.sqrt(np.maximum(0.0, 1 - (scaled * scaled).sum(1)))
        return np.concatenate([scaled, rest[:, None]], axis=1)

    def lift_queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors / np.linalg.norm(vectors, axis=1)[:, None], np.zeros((len(vectors), 1))], axis=1)

    def rank(self, points: np.ndarray) -> tuple[np.ndarray]:
        """Nearness of every list to every point, larger is nearer."""
        return (points @ self.centroids.T - 0.5 * (self.centroids**2).sum(1),)

    def _probes(self, sample: np.ndarray, points: np.ndarray, k: int = K, queries: int = 256) -> int:
        q = sample[:: max(1, len(sample) // queries)]
        own = self.rank(points)[0].argmax(1)
        scores = q @ sample.T
        scores[np.arange(len(q)), np.arange(len(q)) * max(1, len(sample) // queries)] = -np.inf
        best = np.argpartition(-scores, min(k, len(sample) - 1), axis=1)[:, :k]
        order = np.argsort(-self.rank(self.lift_queries(q))[0], axis=1)
        place = np.argsort(order, axis=1)
        needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return 1 + int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)])


def scan(index: Index, queries: np.ndarray, probed: np.ndarray, vectors: np.ndarray, lists: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its best ``k`` vectors in the lists it probes."""
    turned = index.lift(vectors) @ index.rotation
    aims = index.lift_queries(queries) @ index.rotation
    norms = np.linalg.norm(queries, axis=1) * index.longest
    limit = np.full(len(queries), np.inf)  # squared distance of the k-th best so far
    best_at = np.full((len(queries), k), -1)
    best = np.full((len(queries), k), -np.inf)
    for one in np.unique(lists):
        rows = np.flatnonzero(lists == one)
        qs = np.flatnonzero((probed == one).any(1))
        if not len(qs):
            continue
        x, q = turned[rows], aims[qs]
        partial = np.zeros((len(qs), len(rows)))
        alive = np.ones(partial.shape, bool)
        for start in range(0, index.dims, BLOCK):
            a, b = q[:, start : start + BLOCK], x[:, start : start + BLOCK]
            seen = min(start + BLOCK, index.dims)
            if alive.mean() > 0.2:
                partial += (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
            else:
                i, j = np.nonzero(alive)
                partial[i, j] += ((a[i] - b[j]) ** 2).sum(1)
            if seen < index.dims:
                # Partial distances scatter around their share of the whole by about one part in sqrt(seen).
                alive &= partial * (index.dims / seen) <= (limit[qs] * (1 + DOUBT / np.sqrt(seen)) ** 2)[:, None]
            else:
                alive &= partial <= (limit[qs] + 1e-9)[:, None]
        i, j = np.nonzero(alive)
        if not len(i):
            continue
        exact = np.full(partial.shape, -np.inf)
        exact[i, j] = np.einsum("nd,nd->n", queries[qs[i]], vectors[rows[j]])
        joined = np.concatenate([best[qs], exact], axis=1)
        places = np.concatenate([best_at[qs], np.broadcast_to(rows, exact.shape)], axis=1)
        top = np.argsort(-joined, axis=1, kind="stable")[:, :k]
        best[qs], best_at[qs] = np.take_along_axis(joined, top, 1), np.take_along_axis(places, top, 1)
        full = np.isfinite(best[qs, -1])
        limit[qs[full]] = 2 - 2 * best[qs[full], -1] / norms[qs[full]]
    return [(at[np.isfinite(s)], s[np.isfinite(s)]) for at, s in zip(best_at, best)]


def _matrix(lists: pa.Array) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1)


def _nearest(index: Index, df: DataFrame) -> DataFrame:
    """Column ``_list``: the nearest list of each vector."""
    shared = df.sparkSession.sparkContext.broadcast(index)  # at most MAX_LISTS centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = shared.value.lift(_matrix(batch.column("_vec"))) if batch.num_rows else np.empty((0, shared.value.dims))
            near = shared.value.rank(points)[0].argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "_list"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
    return df.mapInArrow(run, fields + "_list int")


def _packed(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Neighbouring lists together in rows of about ``most`` entries at most; larger lists in several."""
    counts = sorted((r["_list"], r["n"]) for r in rows.groupBy("_list").agg(F.count(F.lit(1)).alias("n")).collect())  # at most MAX_LISTS
    plan, number, filled = [], 0, 0
    for one, n in counts:
        parts = -(-n // most)
        if parts > 1 or filled + n > most:
            number, filled = number + (filled > 0), 0
        plan.append((one, number, parts))
        filled += n
        if parts > 1:
            number, filled = number + parts, 0
    where = rows.sparkSession.createDataFrame(plan, "_list int, _first int, _parts int")
    entry = F.struct("_h1", "_h2", "_list", "_vec")
    return (
        rows.join(where, "_list")
        .groupBy((F.col("_first") + F.pmod(F.xxhash64("_h1", "_h2"), F.col("_parts"))).cast("int").alias(name))
        .agg(F.collect_list(entry).alias(f"{name}_rows"))
    )


def _search(index: Index, met: DataFrame, k: int) -> DataFrame:
    shared = met.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries, vectors = (batch.column(c)[i].values for c in ("_block_rows", "_shard_rows"))
                q, x = _matrix(queries.field("_vec")), _matrix(vectors.field("_vec"))
                probed = np.argsort(-shared.value.rank(shared.value.lift_queries(q))[0], axis=1)[:, : shared.value.probes]
                found = scan(shared.value, q, probed, x, vectors.field("_list").to_numpy(), k)
                owner = np.repeat(np.arange(len(q)), [len(at) for at, _ in found])
                at = np.concatenate([a for a, _ in found])
                columns = [queries.field(n).take(pa.array(owner)) for n in ("_h1", "_h2")] + [vectors.field(n).take(pa.array(at)) for n in ("_h1", "_h2")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([s for _, s in found]))], ["_q1", "_q2", "_h1", "_h2", "score"])

    return met.mapInArrow(run, "_q1 long, _q2 long, _h1 long, _h2 long, score double")


def _probed_lists(index: Index, blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``_lists``: all lists that a query of the block probes."""
    shared = blocks.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for row in batch.column("_block_rows"):
                q = _matrix(row.values.field("_vec"))
                own.append(np.unique(np.argsort(-shared.value.rank(shared.value.lift_queries(q))[0], axis=1)[:, : shared.value.probes]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("_block"), pa.array(own, pa.list_(pa.int32()))], ["_block", "_lists"])

    return blocks.mapInArrow(run, "_block int, _lists array<int>")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` neighbours found for each query row."""
    spark = vectors.sparkSession
    good = vectors.where(F.col(id_col).isNotNull() & usable(vector))
    good = good.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_vec"), F.coalesce(is_query, F.lit(False)).alias("_query"))
    dims = good.groupBy(F.size("_vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = written(good.where(F.size("_vec") == dims["d"]).withColumns({"_h1": F.xxhash64("_vec"), "_h2": F.xxhash64(F.lit(1), "_vec")}))
    first = Window.partitionBy("_h1", "_h2").orderBy("_id")
    ids = good.select("_h1", "_h2", "_id").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r")
    entries = good.dropDuplicates(["_h1", "_h2"]).select("_h1", "_h2", "_vec")
    length = F.sqrt(F.aggregate("_vec", F.lit(0.0), lambda a, x: a + x * x))
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).first()
    sample = entries.orderBy("_h1", "_h2").limit(SAMPLE).select("_vec").toArrow().column("_vec").combine_chunks()
    index = Index(_matrix(sample), size["n"], size["longest"])
    listed = written(_nearest(index, entries))
    asked = good.where("_query").select("_h1", "_h2").distinct()
    shards = written(_packed(listed, SHARD, "_shard"))
    blocks = written(_packed(listed.join(asked, ["_h1", "_h2"]), QUERIES, "_block"))
    of_shard = shards.select("_shard", F.explode(F.array_distinct("_shard_rows._list")).alias("_list"))
    meets = _probed_lists(index, blocks).select("_block", F.explode("_lists").alias("_list")).join(of_shard, "_list").select("_block", "_shard").distinct()
    met = meets.join(blocks, "_block").join(shards, "_shard").select("_block_rows", "_shard_rows")
    found = _search(index, met, k + 1)
    # Ties at the end could hide a smaller id, so all entries as good as the last one stay.
    found = found.withColumn("_r", F.rank().over(Window.partitionBy("_q1", "_q2").orderBy(F.desc("score")))).where(F.col("_r") <= k + 1).drop("_r")
    # An id with several vectors is one candidate, as near as the nearest of them.
    people = found.join(ids, ["_h1", "_h2"]).groupBy("_q1", "_q2", F.col("_id").alias("vec_id")).agg(F.max("score").alias("score"))
    ask = good.where("_query").select(F.col("_h1").alias("_q1"), F.col("_h2").alias("_q2"), F.col("_id").alias("query_id")).distinct()
    order = Window.partitionBy("_q1", "_q2").orderBy(F.desc("score"), "vec_id")
    people = people.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r")
    pairs = ask.join(people, ["_q1", "_q2"]).where(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
