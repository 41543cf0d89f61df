"""Best-fit packing of documents into token sequences, certified by lower bounds (operator 11).

A document is tokenized, closed with an end id and, if longer than a sequence, cut into
pieces. Pieces are dealt at random into partitions of about PART pieces, and each
partition is packed by itself: longest piece first, into the fullest sequence that
still has room (best-fit decreasing).

Dual feasible functions give each partition a number of sequences that no packing can
go below. A partition that needs no more than that is certified: only its emptiest
sequence is opened again. A partition with a gap opens every sequence that is not full.
The pieces of opened sequences are exchanged: dealt anew over as many partitions as they
fill, and best-fit decreasing runs again. A round counts only if it saves sequences, and
rounds go on until one saves none or the bound of all pieces together is reached. Nothing
larger than a count a length comes to the driver.

Defined results: null text is an empty text, which is one piece with the end id only;
rows are packed one by one, so repeated rows and rows without doc_id each have their own
pieces; a very long text is tokenized in parts cut at ASCII white space, where tokens
never meet; strings of special tokens in a text are ordinary text; an empty table gives
no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterspark.llm.common import slices, table, text_or_empty, written

CAPACITY = 4096
END = 1
#: Pieces of a partition.
PART = 32768
#: Words whose ids a worker remembers, and their bytes together; beyond, it begins anew.
WORDS, WORD_BYTES = 500_000, 1 << 25
#: Bytes of a text that are tokenized together.
PASSAGE = 1 << 18


#: What follows is the split of the vocabulary's own pre-tokenizer, for words of Latin characters only.
_LATIN = re.compile("[!-~\u00a1-\u024f]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordIds:
    """Ids of a text, word by word between ASCII white space, which no token crosses.

    Words of Latin characters are split and merged together by the rank-based library, which is
    several times faster: a merge of this vocabulary has the rank of its place in the list, and the
    end of a word is a character of its own (NUL) that merges first. All other words, and those with
    control characters, go to the tokenizer one by one.
    """

    def __init__(self, path: str) -> None:
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        model = json.loads(self.plain.to_str())["model"]
        end, vocabulary = model["end_of_word_suffix"], model["vocab"]
        letter = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        rest = sorted(set(range(256)) - set(letter.values()))
        letter |= {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda token: bytes(letter[c] for c in token.removesuffix(end)) + (b"\0" if token.endswith(end) else b"")
        tokens = [*letter, *(c + end for c in letter), *("".join(m) for m in model["merges"])]
        # Single bytes come first; the ranks of the others tell the order of the merges.
        ranks = {raw(t): i for i, t in reversed(list(enumerate(tokens)))}
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.id_of = np.array([vocabulary[t] for t in tokens], np.int64)
        self.last = np.array([t.endswith(end) for t in tokens])
        self.forget()

    def forget(self) -> None:
        """Word k has the ids flat[ends[k] : ends[k + 1]]."""
        self.index: dict[bytes, int] = {}
        self.flat, self.ends, self.size = array("I"), array("q", [0]), 0

    def _learn(self, new: set[bytes]) -> None:
        latin, many, pieces = [], [], []
        for w in new:
            text = w.decode("utf-8", "replace")
            if _LATIN.fullmatch(text):
                own = _PIECES.findall(text.lower())
                latin.append(w)
                many.append(len(own))
                pieces += own
            else:
                self._keep(w, self.plain.encode(text, add_special_tokens=False).ids)
        if latin:
            ranks = np.array(self.fast.encode_ordinary("\0".join([*pieces, ""])))
            ends = (np.flatnonzero(self.last[ranks]) + 1)[np.cumsum(many) - 1].tolist()
            ids = self.id_of[ranks].tolist()
            for w, start, stop in zip(latin, [0, *ends], ends):
                self._keep(w, ids[start:stop])

    def _keep(self, word: bytes, ids: list[int]) -> None:
        self.index[word] = len(self.index)
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        self.size += len(word)

    def _gathered(self, words: np.ndarray) -> np.ndarray:
        ends = np.frombuffer(self.ends, np.int64)
        first = ends[words]
        many = ends[words + 1] - first
        return np.frombuffer(self.flat, np.uint32)[np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)]

    def ids(self, text: bytes) -> np.ndarray:
        """The ids of one text as 32-bit numbers."""
        parts = []
        start = 0
        while start < len(text):
            stop = start + PASSAGE
            if stop < len(text):  # white space before the limit, else behind it
                at = max(text.rfind(c, start, stop) for c in (b" ", b"\n", b"\t", b"\r"))
                if at <= start:
                    at = min((p for c in (b" ", b"\n", b"\t", b"\r") if (p := text.find(c, stop)) >= 0), default=len(text))
                stop = at
            words = text[start:stop].split()
            if len(self.index) > WORDS or self.size > WORD_BYTES:
                self.forget()
            at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
            new = np.flatnonzero(at < 0).tolist()
            if new:
                self._learn({words[i] for i in new})
                at[new] = [self.index[words[i]] for i in new]
            parts.append(self._gathered(at))
            start = max(stop, start + 1)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _deal[, ids]) of every piece of ``docs``.

    ``_deal`` is a number of the row for dealing pieces at random; the table must be written before it is used twice.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = _words(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "_text"):
                owner, piece, length, sums, kept = [], [], [], [], []
                for i, text in enumerate(part.column("_text").to_pylist()):
                    whole = np.append(own.ids(text), np.uint32(end)).astype("<u4")
                    for at in range(0, len(whole), capacity):
                        cut = whole[at : at + capacity]
                        owner.append(i)
                        piece.append(at // capacity)
                        length.append(len(cut))
                        sums.append(zlib.crc32(cut.tobytes()))
                        if ids:
                            kept.append(cut)
                piece = np.array(piece, np.int32)
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(owner, pa.int64())), "piece": pa.array(piece),
                    "start": pa.array(piece.astype(np.int64) * capacity), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                    "_deal": pa.array(np.arange(number, number + len(owner))),
                }
                if ids:
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).view(np.int32)))
                number += len(owner)
                yield pa.RecordBatch.from_pydict(columns)

    more = ", ids array<int>" if ids else ""
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, _deal long" + more)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; the longest first, each into the fullest bin with room for it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_: dict[int, list[int]] = {}  # bins by the room they have left
    rooms = 0  # bit r is set if a bin has room r
    used = 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, used
            used += 1
        bins[i], offsets[i] = at, capacity - room
        room -= size
        if room:
            open_.setdefault(room, []).append(at)
            rooms |= 1 << room
    return bins, offsets


def lower_bound(counts: np.ndarray, goal: int, capacity: int = CAPACITY) -> int:
    """A number of bins that ``counts`` (pieces by length, index 0 unused) need in any packing.

    A dual feasible function maps lengths to weights so that no full bin weighs more than
    one; the whole weight, rounded up, is a bound. The families are tried in turn and the
    greatest bound counts; it is enough to reach ``goal``, a packing's number of bins.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    ceil = lambda a, b: -(-int(a) // int(b))
    best = ceil((counts * size).sum(), capacity)
    # Lengths above capacity - e weigh one, those below e nothing, the others their share.
    number, total = np.cumsum(counts), np.cumsum(counts * size)
    for e in range(1, capacity // 2 + 1):
        if best >= goal:
            return best
        top = capacity - e
        best = max(best, ceil((number[-1] - number[top]) * capacity + total[top] - total[e - 1], capacity))
    # Lengths rounded to multiples of 1 / (k + 1), which a bin can't overfill by k parts.
    for k in range(1, 101):
        if best >= goal:
            return best
        scaled = size * (k + 1)
        weight = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in parts of k * capacity
        best = max(best, ceil((counts * weight).sum(), k * capacity))
    # Small lengths of at least e weigh 1 / floor(capacity / e), large ones what the room beside them leaves.
    for e in range(1, capacity // 2 + 1):
        if best >= goal:
            return best
        k = capacity // e
        weight = np.where(2 * size > capacity, k - (capacity - size) // e, np.where(size >= e, 1, 0))
        best = max(best, ceil((counts * weight).sum(), k))
    return best


def _packer(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_deal")
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used = int(bins.max(initial=-1)) + 1
        fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), used, capacity)
        opened = fill < capacity
        if bound == used:
            opened &= np.arange(used) == fill.argmin()
        more = {"_bin": bins, "offset": offsets, "_open": opened[bins], "certified": np.full(len(bins), bound == used)}
        for name, values in more.items():
            group = group.append_column(name, pa.array(values))
        return group

    return run


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def pack(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """``pieces`` (a written table with ``length`` and ``_deal``) with sequence_id, offset and certified.

    ``certified`` tells whether the bound proves that the piece's partition has as few sequences as can be.
    """
    added = ("_part", "_bin", "_open", "sequence_id", "offset", "certified")
    rows = pieces.drop(*added)
    # At most one row a length.
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[list(counts)] = list(counts.values())
    least = lower_bound(histogram, 2**62, capacity) if counts else 0
    number = F.coalesce(F.sum((F.col("offset") == 0).cast("long")), F.lit(0)).alias("bins")  # each sequence has one piece at its beginning

    def packed(pool: DataFrame, size: int, turn: int) -> tuple[DataFrame, int, int]:
        """The pool's new packing, its sequences and its partitions."""
        parts = max(1, -(-size // part))
        dealt = pool.withColumn("_part", F.pmod(F.xxhash64("_deal", F.lit(turn)), F.lit(parts)).cast("int"))
        more = "_bin long, offset long, _open boolean, certified boolean"
        out = written(dealt.groupBy("_part").applyInArrow(_packer(capacity), _fields(dealt) + more))
        return out, out.agg(number).first().bins, parts

    turn, done = 0, []
    current, total, parts = packed(rows, sum(counts.values()), turn)
    # A single partition has nothing to exchange with.
    while total > least and parts > 1:
        opened = current.where("_open")
        before = opened.agg(number, F.count(F.lit(1)).alias("n")).first()
        repacked, after, parts = packed(opened.select(*rows.columns), before.n, turn + 1)
        if after >= before.bins:
            break
        done.append((turn, current.where("NOT _open")))
        turn, current, total = turn + 1, repacked, total - before.bins + after
    name = lambda t: (F.lit(t).cast("long") * 2**56 + F.col("_part").cast("long") * 2**24 + F.col("_bin")).alias("sequence_id")
    out = [df.select(*rows.columns, name(t), "offset", "certified") for t, df in [*done, (turn, current)]]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole.drop("_deal")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the sequences themselves, of a packing whose pieces kept their ``ids``."""
    # A sequence's own pieces: no more than its tokens.
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_all"), F.sum("length").alias("length"))
    return rows.select("sequence_id", "length", F.flatten("_all.ids").alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(written(pieces(table(spark, sf_dir, "documents"), ids=False)))
