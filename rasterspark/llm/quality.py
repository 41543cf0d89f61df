"""Quality classifier: a byte-level convolutional network in numpy (operator 1).

Bytes are embedded; filters of eight bytes slide over them in steps of four. The
document is covered by overlapping chunks of 256 bytes, each half as a mean and a
maximum of every filter; a second layer of learned filters reads each chunk. Its
outputs are max-pooled (and averaged) over all chunks, and one logistic unit makes
the probability. Every byte of a document is read, however long it is.

The network is fitted on the driver with Adam on a bounded sample: at most
FIT_PER_CLASS labelled documents of each class, chosen by a hash of doc_id, of at
most FIT_BYTES bytes each. Rows whose crc32(doc_id as text) mod 5 is 0 are held
out of it. Only bytes are inputs of a score.

Defined results: null text is an empty text; an empty text is one padded chunk and
gets a score like any other; without labels of both classes every score is the
smoothed share of label 1; documents without doc_id are scored, never fitted, and
count as not held out; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm.common import table, text_or_empty

FIT_PER_CLASS = 1500
FIT_BYTES = 65_536
EPOCHS = 6
THRESHOLD = 0.3

_PAD = 256
_STEP = 4  # bytes between filter positions
_HALF = 128  # bytes of half a chunk
_STEPS = _HALF // _STEP
_SEGMENT = 1 << 18  # a longer text is read in overlapping segments of this many bytes


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class ByteConvNet:
    """Weights and both directions of the network."""

    def __init__(self, seed: int = 7, width: int = 8, filters: int = 32, hidden: int = 24) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda n, *shape: (rng.standard_normal(shape) / np.sqrt(n)).astype(np.float32)
        self.offset = 0.0
        self.w = {
            "embed": draw(1, _PAD + 1, width), "conv": draw(2 * _STEP * width, 2 * _STEP * width, filters), "conv_b": np.zeros(filters, np.float32),
            "chunk": draw(4 * filters, 4 * filters, hidden), "chunk_b": np.zeros(hidden, np.float32),
            "out": draw(2 * hidden, 2 * hidden), "out_b": np.zeros(1, np.float32),
        }

    @staticmethod
    def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Padded bytes of all segments, the four bytes after each, halves of each, and the text of each."""
        flat, tails, halves, owner = [], [], [], []
        for i, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            total = max(2, -(-len(data) // _HALF))
            data = np.concatenate([data, np.full(total * _HALF + _STEP - len(data), _PAD, np.uint16)]).astype(np.uint16)
            span = _SEGMENT // _HALF
            for s in range(0, max(1, total - 1), span - 1):  # neighbours share half a chunk
                e = min(total, s + span)
                flat.append(data[s * _HALF : e * _HALF])
                tails.append(data[e * _HALF : e * _HALF + _STEP])
                halves.append(e - s)
                owner.append(i)
        return np.concatenate(flat), np.stack(tails), np.array(halves), np.array(owner)

    def forward(self, texts: list[bytes]) -> dict:
        flat, tails, halves, owner = self.layout(texts)
        w, k = self.w, len(self.w["conv"]) // 2
        block = w["embed"][flat].reshape(-1, k)
        last = np.cumsum(halves) * _STEPS - 1
        follow = np.concatenate([block[1:], block[:1]])
        follow[last] = w["embed"][tails].reshape(-1, k)
        conv = block @ w["conv"][:k]
        conv += follow @ w["conv"][k:]
        conv += w["conv_b"]
        np.maximum(conv, 0, out=conv)
        by_half = conv.reshape(-1, _STEPS, conv.shape[1])
        pooled = np.concatenate([by_half.mean(1), by_half.max(1)], axis=1)
        ends = np.cumsum(halves)
        first = np.ones(len(pooled), bool)
        first[ends - 1] = False
        at = np.flatnonzero(first)  # a chunk is a half and the next one of the same segment
        x = np.concatenate([pooled[at], pooled[at + 1]], axis=1)
        z = np.maximum(x @ w["chunk"] + w["chunk_b"], 0)
        chunks = halves - 1
        text_chunks = np.bincount(owner, chunks, len(texts)).astype(np.int64)
        starts = np.cumsum(text_chunks) - text_chunks
        top, mean = np.maximum.reduceat(z, starts), np.add.reduceat(z, starts) / text_chunks[:, None]
        both = np.concatenate([top, mean], axis=1)
        logit = both @ w["out"] + w["out_b"]
        return {"flat": flat, "tails": tails, "last": last, "block": block, "follow": follow, "conv": conv, "pooled": pooled, "at": at, "x": x, "z": z,
                "starts": starts, "n": text_chunks, "both": both, "logit": logit}

    def gradients(self, f: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Of the loss, given its slope at every logit."""
        w, k = self.w, len(self.w["conv"]) // 2
        g = {"out": f["both"].T @ slope, "out_b": slope.sum(keepdims=True)}
        d_both = slope[:, None] * w["out"]
        hidden = f["z"].shape[1]
        owner = np.repeat(np.arange(len(slope)), f["n"])
        d_z = d_both[owner, hidden:] / f["n"][owner, None]
        is_top = f["z"] == f["both"][owner, :hidden]
        ties = np.add.reduceat(is_top.astype(np.float32), f["starts"])
        d_z += is_top * (d_both[:, :hidden] / ties)[owner]
        d_z *= f["z"] > 0
        g["chunk"], g["chunk_b"] = f["x"].T @ d_z, d_z.sum(0)
        d_x = d_z @ w["chunk"].T
        n = f["pooled"].shape[1]
        d_pooled = np.zeros_like(f["pooled"])
        d_pooled[f["at"]] += d_x[:, :n]
        d_pooled[f["at"] + 1] += d_x[:, n:]
        filters = f["conv"].shape[1]
        by_half = f["conv"].reshape(-1, _STEPS, filters)
        d_conv = np.repeat(d_pooled[:, None, :filters] / _STEPS, _STEPS, axis=1)
        peak = by_half.argmax(1)
        rows, cols = np.indices(peak.shape)
        d_conv[rows, peak, cols] += d_pooled[:, filters:]
        d_conv = (d_conv * (by_half > 0)).reshape(-1, filters)
        g["conv"] = np.concatenate([f["block"].T @ d_conv, f["follow"].T @ d_conv])
        g["conv_b"] = d_conv.sum(0)
        d_block = d_conv @ w["conv"][:k].T
        d_follow = d_conv @ w["conv"][k:].T
        d_tail = d_follow[f["last"]]
        d_follow[f["last"]] = 0
        d_block[1:] += d_follow[:-1]
        width = w["embed"].shape[1]
        values = np.concatenate([d_block.reshape(-1, width), d_tail.reshape(-1, width)])
        keys = np.concatenate([f["flat"], f["tails"].reshape(-1)])
        g["embed"] = np.stack([np.bincount(keys, values[:, j], len(w["embed"])) for j in range(width)], axis=1).astype(np.float32)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, least_steps: int = 400, rate: float = 0.004, seed: int = 3) -> ByteConvNet:
        """Adam on the logistic loss; both classes weigh the same. Few texts are gone through more often."""
        batch_bytes = min(100_000, sum(map(len, texts)) // 16 + 1)
        epochs = max(epochs, -(-least_steps * batch_bytes // (sum(map(len, texts)) + 1)))
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        first = {n: np.zeros_like(v) for n, v in self.w.items()}
        second = {n: np.zeros_like(v) for n, v in self.w.items()}
        done, total = 0, sum(map(len, texts)) * epochs + 1
        seen = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts)).tolist()
            while order:
                batch, size = [], 0
                while order and (not batch or size < batch_bytes):
                    batch.append(order.pop())
                    size += len(texts[batch[-1]])
                f = self.forward([texts[i] for i in batch])
                p = 1 / (1 + np.exp(-np.clip(f["logit"], -30, 30)))
                slope = ((p - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
                done += 1
                seen += size
                step = rate * max(0.05, 1 - seen / total) * np.sqrt(1 - 0.999**done) / (1 - 0.9**done)
                for name, grad in self.gradients(f, slope).items():
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.001 * (grad * grad - second[name])
                    self.w[name] -= step * first[name] / (np.sqrt(second[name]) + 1e-8)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 of every text. One at a time, so that equal texts get equal bits."""
        logits = np.array([self.forward([t])["logit"][0] for t in texts], np.float64) + self.offset
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


class Constant:
    """What is known without labels of both classes."""

    def __init__(self, share: float) -> None:
        self.share = share

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = FIT_PER_CLASS, epochs: int = EPOCHS) -> ByteConvNet | Constant:
    """A network fitted on at most ``per_class`` documents of each class."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality").distinct()
    counts = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    zero, one = counts.get(0, 0), counts.get(1, 0)
    if not zero or not one:
        return Constant((one + 1) / (zero + one + 2))
    order = F.xxhash64("doc_id")
    picked = [usable.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class) for q in (0, 1)]
    # At most 2 * per_class pairs of numbers are broadcast.
    sample = docs.select("doc_id", text_or_empty().alias("_text")).join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    rows = sample.where(F.octet_length("_text") <= FIT_BYTES).orderBy(order, "doc_id", F.xxhash64("_text")).limit(4 * per_class).collect()
    texts, marks = [r["_text"].encode() for r in rows], np.array([r["quality"] for r in rows])
    if len(set(marks.tolist())) < 2:
        return Constant((one + 1) / (zero + one + 2))
    net = ByteConvNet().fit(texts, marks, epochs)
    net.offset = float(np.log(one / zero))  # both classes weighed the same in the fit
    return net


def score_quality(docs: DataFrame, model: ByteConvNet | Constant, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into`` added (or replaced)."""
    docs = docs.drop(into).withColumn("_quality_text", text_or_empty())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 40 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = net.scores(part.column("_quality_text").cast(pa.binary()).to_pylist())
                names = [n for n in part.schema.names if n != "_quality_text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores, pa.float64())], [*names, into])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.drop("_quality_text").schema.fields)
    return docs.mapInArrow(run, schema + f"`{into}` double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is at least the threshold."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, "_quality").where(F.col("_quality") >= THRESHOLD).select(*docs.columns)
