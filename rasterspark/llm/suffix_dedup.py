"""Removal of repeated byte strings by maximal repeats of suffix arrays (operator 8).

Every string of LENGTH bytes that starts at more than one place of the corpus is cut
out wherever it stands. A suffix array of a whole corpus would not fit anywhere, so
places that can be equal are first brought together:

1. Each window of LENGTH bytes has an anchor: among the hashes of its GRAM-byte
   strings the smallest one, rightmost if tied. Equal windows have equal anchors. The
   windows of one anchor follow each other; with their bytes they are its context.
   Anchors with a hash that occurs once are done: nothing repeats there.
2. Equal contexts of an anchor are one class with a multiplicity. A class that occurs
   twice is a repeat as a whole. Where all contexts of an anchor are equal, that is all.
3. For the other anchors one context of each class is fetched, and an enhanced suffix
   array (order and common prefixes) of a bounded bucket of them is built. A stack scan
   visits the intervals of common prefixes of at least LENGTH bytes; an interval whose
   suffixes are preceded by different bytes is a maximal repeat, put out with all its
   occurrences. Every repeated window lies in an occurrence of one.
4. An anchor with more than CLASSES different contexts is not put into one bucket. Its
   windows are hashed one by one to 128 bits and counted by hash over all tasks, which
   splits any group.

Contexts are told apart by 128-bit digests, and the windows of step 4 by 128 bits of
polynomial hashes, without a comparison of bytes behind them.

Defined results: null text is an empty text; texts shorter than LENGTH lose nothing;
rows that agree in doc_id and text are two documents with equal results (each repeats
the other); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm.common import map_rows, table, text_key, text_or_empty, written

LENGTH = 400
GRAM = 64
#: Most different contexts of one anchor that go into a bucket together; a context has at most 2 * LENGTH bytes.
CLASSES = 4096
BUCKET_BYTES = 1 << 20
BUCKETS = 256  # at least

_BLOCK = 1 << 22  # window starts of a very long text that are looked at together
_PLACE = np.uint64((1 << 24) - 1)
_KEYS = ("_ah", "_c1", "_c2")


def _mixer(seed: int) -> tuple[np.ndarray, np.uint64]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, 256, dtype=np.uint64), rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power_hashes(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each place; doubling, then the binary digits of the length."""
    values, factor = _mixer(seed)
    size, level, step = 1, values[data], factor
    total, covered, shift = None, 0, np.uint64(1)
    rest = length
    n = len(data) - length + 1
    while True:
        if rest & 1:
            part = level[covered : covered + n]
            total = part.copy() if total is None else total + part * shift
            covered += size
            shift = shift * step
        rest >>= 1
        if not rest:
            break
        level = level[:-size] + level[size:] * step
        step = step * step
        size *= 2
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(anchor hash, first start, end of starts): the windows of a text, by anchor."""
    out = []
    data = np.frombuffer(text, np.uint8)
    for base in range(0, len(data) - length + 1, _BLOCK):
        part = data[base : base + _BLOCK + length - 1]
        with np.errstate(over="ignore"):
            h = _power_hashes(part, gram, 11)
        places = np.arange(len(h), dtype=np.uint64)
        low = (h & ~_PLACE) | (_PLACE - places)
        span, width = 1, length - gram + 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        cuts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        at = (_PLACE - (low[cuts] & _PLACE)).astype(np.int64)
        ends = np.append(cuts[1:], len(low))
        out += zip(h[at].view(np.int64).tolist(), (cuts + base).tolist(), (ends + base).tolist())
    return out


def _occurrence_rows(batch: pa.RecordBatch) -> dict | None:
    hashes, starts, ends, owner, digests = [], [], [], [], []
    for i, text in enumerate(batch.column("_text").to_pylist()):
        for h, s, e in anchors(text) if len(text) >= LENGTH else ():
            hashes.append(h)
            starts.append(s)
            ends.append(e)
            owner.append(i)
            digests.append(hashlib.blake2b(text[s : e - 1 + LENGTH], digest_size=16).digest())
    if not hashes:
        return None
    c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    take = pa.array(owner, pa.int64())
    return {
        "_ah": pa.array(hashes, pa.int64()), "_c1": pa.array(c[:, 0]), "_c2": pa.array(c[:, 1]), "_k1": batch.column("_k1").take(take),
        "_k2": batch.column("_k2").take(take), "_s": pa.array(starts, pa.int32()), "_e": pa.array(ends, pa.int32()),
    }


def _context_rows(batch: pa.RecordBatch) -> dict | None:
    found = [(e["ah"], e["c1"], e["c2"], e["big"], text[e["s"] : e["e"] - 1 + LENGTH]) for text, es in zip(batch.column("_text").to_pylist(), batch.column("_wanted").to_pylist()) for e in es]
    if not found:
        return None
    ah, c1, c2, big, context = zip(*found)
    return {"_ah": pa.array(ah, pa.int64()), "_c1": pa.array(c1, pa.int64()), "_c2": pa.array(c2, pa.int64()), "_big": pa.array(big), "_context": pa.array(context, pa.binary())}


class EnhancedSuffixArray:
    """Order and common prefixes of the suffixes of several texts that have at least ``least`` bytes."""

    def __init__(self, texts: list[bytes], least: int) -> None:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes + 1) - 1  # where each text's terminator stands
        self.begin = ends - sizes
        self.symbols = np.zeros(int(ends[-1]) + 1, np.uint16)
        inside = np.ones(len(self.symbols), bool)
        inside[ends] = False
        self.symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
        n = len(self.symbols)
        self.owner = np.repeat(np.arange(len(texts)), sizes + 1)
        self.left = ends[self.owner] - np.arange(n)  # bytes of the suffix
        self.levels = self._levels(int(sizes.max(initial=0)))
        starts = np.flatnonzero(self.left >= least)
        self.order = starts[np.argsort(self.levels[-1][1][starts], kind="stable")]
        self.lcp = self._common(self.order[:-1], self.order[1:])

    def _levels(self, longest: int) -> list[tuple[int, np.ndarray]]:
        """Ranks of the blocks of 4, 8, 16, ... bytes from each place, cut at the text's end."""
        n = len(self.symbols)
        padded = np.concatenate([self.symbols, np.zeros(4, np.uint16)])
        key = np.zeros(n, np.uint64)
        for j in range(4):
            key = key << np.uint64(16) | np.where(self.left >= j, padded[j : j + n], 0).astype(np.uint64)
        size, out = 4, []
        while True:
            rank = np.unique(key, return_inverse=True)[1].astype(np.int32) + 1
            out.append((size, rank))
            if size >= longest:
                return out
            after = np.zeros(n, np.int32)
            after[:-size] = np.where(self.left[:-size] >= size, rank[size:], 0) if size < n else 0
            key = rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
            size *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(self.left[a], self.left[b])
        got = np.zeros(len(a), np.int64)
        for size, rank in reversed(self.levels):
            fits = np.flatnonzero(got + size <= most)
            same = rank[a[fits] + got[fits]] == rank[b[fits] + got[fits]]
            got[fits[same]] += size
        for _ in range(3):
            fits = np.flatnonzero(got < most)
            same = self.symbols[a[fits] + got[fits]] == self.symbols[b[fits] + got[fits]]
            got[fits[same]] += 1
        return got

    def before(self) -> np.ndarray:
        """The byte before each suffix; a number of its own where the text begins."""
        at = self.order
        return np.where(at == self.begin[self.owner[at]], -1 - np.arange(len(at)), self.symbols[at - 1].astype(np.int64))


def maximal_repeats(texts: list[bytes], least: int) -> dict[str, np.ndarray]:
    """All maximal repeats of at least ``least`` bytes.

    One row for each occurrence and the longest repeat that begins there: group,
    parent (the repeat that this one extends to the right, or -1), length, text,
    start. A group's occurrences are its own rows and those of its descendants; a
    group whose occurrences all begin longer repeats has a row for one of them.
    """
    esa = EnhancedSuffixArray(texts, least)
    lcp, before = esa.lcp, esa.before()
    long = lcp >= least
    edge = np.diff(np.concatenate([[0], long.astype(np.int8), [0]]))
    groups: list[tuple[int, int, int, int]] = []  # length, first, last, parent
    member = np.full(len(esa.order), -1)
    for first, last in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        chars = before[first : last + 1]
        if chars[0] >= 0 and (chars == chars[0]).all():
            continue  # extends to the left as a whole, and so does every interval in it
        _scan(lcp[first:last].tolist(), chars.tolist(), first, groups)
    for number in range(len(groups) - 1, -1, -1):  # a parent comes after its children
        _, first, last, _ = groups[number]
        member[first : last + 1] = number
    rows = np.flatnonzero(member >= 0)
    table_ = np.array(groups, np.int64).reshape(-1, 4)
    bare = np.setdiff1d(np.arange(len(groups)), member[rows])
    at, group = esa.order[np.concatenate([rows, table_[bare, 1]])], np.concatenate([member[rows], bare])
    return {"group": group, "parent": table_[group, 3], "length": table_[group, 0], "text": esa.owner[at], "start": at - esa.begin[esa.owner[at]]}


def _scan(lcp: list[int], chars: list[int], base: int, groups: list[tuple[int, int, int, int]]) -> None:
    """Left-diverse intervals of one stretch of the array, children before parents."""
    mixed = None  # of a set of bytes before a suffix: that byte, or None where they differ
    # An open interval: length, first suffix, the byte before its suffixes, its finished groups without a parent.
    stack: list[list] = []
    for i in range(len(lcp) + 1):
        value = lcp[i] if i < len(lcp) else -1
        first, char, loose = i, chars[i], []
        while stack and stack[-1][0] > value:
            length, first, own, below = stack.pop()
            own = own if own == char else mixed
            below = below + loose
            if own is mixed:
                number = len(groups)
                groups.append((length, base + first, base + i, -1))
                for k in below:
                    groups[k] = (*groups[k][:3], number)
                below = [number]
            char, loose = own, below
        if value < 0:
            return
        if stack and stack[-1][0] == value:
            top = stack[-1]
            top[2] = top[2] if top[2] == char else mixed
            top[3] = top[3] + loose
        else:
            stack.append([value, first, char, loose])


_REPEATS = "_bucket int, _group int, _parent int, _length int, _ah long, _c1 long, _c2 long, _start int"


def _bucket_repeats(bucket: pa.Table) -> pa.Table:
    found = maximal_repeats(bucket.column("_context").to_pylist(), LENGTH)
    take = pa.array(found["text"], pa.int64())
    columns = {"_bucket": bucket.column("_bucket").take(take)}
    columns |= {f"_{n}": pa.array(found[n], pa.int32()) for n in ("group", "parent", "length")}
    columns |= {n: bucket.column(n).take(take) for n in _KEYS} | {"_start": pa.array(found["start"], pa.int32())}
    return pa.table(columns)


def _window_rows(batch: pa.RecordBatch) -> dict | None:
    contexts = batch.column("_context").to_pylist()
    if not contexts:
        return None
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = (np.cumsum(sizes) - sizes)[owner] + start
    with np.errstate(over="ignore"):
        w1, w2 = (_power_hashes(data, LENGTH, seed)[place].view(np.int64) for seed in (12, 13))
    take = pa.array(owner, pa.int64())
    return {"_w1": pa.array(w1), "_w2": pa.array(w2), **{n: batch.column(n).take(take) for n in _KEYS}, "_start": pa.array(start.astype(np.int32))}


class Repeats:
    """The steps of the operator over one table of documents; written tables are made once."""

    def __init__(self, docs: DataFrame) -> None:
        k1, k2 = text_key()
        self.texts = docs.select(k1, k2, text_or_empty().cast("binary").alias("_text"))
        places = map_rows(self.texts, "_ah long, _c1 long, _c2 long, _k1 long, _k2 long, _s int, _e int", _occurrence_rows, rows=500, by="_text")
        places = written(places)
        ends = [f(c).alias(f"_{n}{c}") for c in ("_c1", "_c2") for n, f in (("lo", F.min), ("hi", F.max))]
        # Counted tables are written before they are joined: a join of two plain shuffles can split a hot key.
        groups = written(places.groupBy("_ah").agg(F.count(F.lit(1)).alias("_n"), *ends).where(F.col("_n") > 1))
        equal = (F.col("_lo_c1") == F.col("_hi_c1")) & (F.col("_lo_c2") == F.col("_hi_c2"))
        #: Occurrences of anchors that occur more than once.
        self.places = written(places.join(groups.select("_ah", equal.alias("_equal")), "_ah"))
        self.classes = self._classes()

    def _classes(self) -> DataFrame:
        """One row for each different context of anchors whose contexts differ."""
        one = F.min(F.struct("_k1", "_k2", "_s", "_e")).alias("_at")
        classes = written(self.places.where(~F.col("_equal")).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_n"), one))
        big = written(classes.groupBy("_ah").count().where(F.col("count") > CLASSES).select("_ah", F.lit(True).alias("_big")))
        return classes.join(big, "_ah", "left").withColumn("_big", F.coalesce("_big", F.lit(False)))

    def contexts(self) -> DataFrame:
        """(_ah, _c1, _c2, _big, _context) of every class."""
        want = F.struct(F.col("_ah").alias("ah"), F.col("_c1").alias("c1"), F.col("_c2").alias("c2"), F.col("_at._s").alias("s"), F.col("_at._e").alias("e"), F.col("_big").alias("big"))
        # A document's own list; it is bounded by the document.
        wanted = self.classes.groupBy(F.col("_at._k1").alias("_k1"), F.col("_at._k2").alias("_k2")).agg(F.collect_list(want).alias("_wanted"))
        found = self.texts.join(wanted, ["_k1", "_k2"]).select("_text", "_wanted")
        return map_rows(found, "_ah long, _c1 long, _c2 long, _big boolean, _context binary", _context_rows, rows=200)

    def groups(self, contexts: DataFrame) -> DataFrame:
        """Maximal repeats among the contexts of each bucket, all occurrences of each."""
        size = contexts.where(~F.col("_big")).agg(F.sum(F.octet_length("_context"))).first()[0] or 0
        buckets = max(BUCKETS, -(-size // BUCKET_BYTES))
        dealt = contexts.where(~F.col("_big")).withColumn("_bucket", F.pmod(F.xxhash64("_ah"), F.lit(buckets)).cast("int"))
        return dealt.groupBy("_bucket").applyInArrow(_bucket_repeats, _REPEATS)

    def windows(self, contexts: DataFrame) -> DataFrame:
        """Repeated windows of the anchors with very many different contexts."""
        rows = map_rows(contexts.where("_big").drop("_big"), "_w1 long, _w2 long, _ah long, _c1 long, _c2 long, _start int", _window_rows, rows=500)
        rows = written(rows)
        again = written(rows.groupBy("_w1", "_w2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_w1", "_w2"))
        return rows.join(again, ["_w1", "_w2"]).select(*_KEYS, "_start", F.lit(LENGTH).alias("_length"))

    def spans(self) -> DataFrame:
        """(_k1, _k2, _spans): all repeated stretches of each document that has some."""
        contexts = written(self.contexts())
        parts = self.groups(contexts).select(*_KEYS, "_start", "_length").unionByName(self.windows(contexts))
        parts = parts.groupBy(*_KEYS).agg(F.collect_set(F.struct("_start", "_length")).alias("_parts"))
        known = self.classes.select(*_KEYS, (F.col("_n") > 1).alias("_whole")).join(parts, [*_KEYS], "left")
        known = written(known.where(F.col("_whole") | F.col("_parts").isNotNull()))
        whole = F.array(F.struct(F.col("_s").alias("s"), (F.col("_e") - 1 + LENGTH).alias("e")))
        equal = self.places.where("_equal").select("_k1", "_k2", whole.alias("_found"))
        some = F.transform("_parts", lambda p: F.struct((F.col("_s") + p["_start"]).alias("s"), (F.col("_s") + p["_start"] + p["_length"]).alias("e")))
        other = self.places.where(~F.col("_equal")).join(known, [*_KEYS]).select("_k1", "_k2", F.when(F.col("_whole"), whole).otherwise(some).alias("_found"))
        found = equal.unionByName(other.where(F.col("_found").isNotNull()))
        # Rows that repeat a document bring its stretches again; one of each stays, so a list is bounded by the document.
        return found.select("_k1", "_k2", F.explode("_found").alias("_s")).groupBy("_k1", "_k2").agg(F.collect_set("_s").alias("_spans"))


def _cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, list[dict]]:
    runs: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    kept, at = [], 0
    for s, e in runs:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]]), [{"start": s, "end": e} for s, e in runs]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay) and ``removed`` (their byte offsets) added (or replaced)."""
    docs = docs.drop("kept", "removed")
    spans = Repeats(docs).spans()
    k1, k2 = text_key()
    marked = docs.withColumns({"_k1": k1, "_k2": k2, "_bytes": text_or_empty().cast("binary")}).join(spans, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                cut = [_cut(t, s) for t, s in zip(part.column("_bytes").to_pylist(), part.column("_spans").to_pylist())]
                names = [n for n in part.schema.names if n not in ("_bytes", "_spans")]
                arrays = [pa.array([k for k, _ in cut], pa.binary()), pa.array([r for _, r in cut], kind)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *arrays], [*names, "kept", "removed"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return marked.mapInArrow(run, fields + "kept binary, removed array<struct<start:int,end:int>>")


def maximal_repeat_groups(docs: DataFrame) -> DataFrame:
    """(bucket, group, parent, length, doc_id, start): the maximal repeats of anchors with different contexts, with their occurrences.

    A group's occurrences are its own rows and those of the groups whose parent it is. ``doc_id`` and
    ``start`` (byte) are every place of the context in which the repeat was found.
    """
    repeats = Repeats(docs)
    k1, k2 = text_key()
    ids = docs.select(k1, k2, F.col("doc_id").cast("long").alias("doc_id"))
    groups = written(repeats.groups(written(repeats.contexts())))
    places = repeats.places.where(~F.col("_equal")).join(groups, [*_KEYS]).join(ids, ["_k1", "_k2"])
    return places.select(
        F.col("_bucket").alias("bucket"), F.col("_group").alias("group"), F.col("_parent").alias("parent"), F.col("_length").alias("length"), "doc_id",
        (F.col("_s") + F.col("_start")).cast("long").alias("start"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then ``text`` (what is left; characters that a cut splits become replacement characters) and ``removed`` (byte offsets)."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(text_or_empty()).cast("long")
    return out.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), "removed",
    )
