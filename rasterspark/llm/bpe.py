"""Byte-level BPE by a hierarchical-bitmap rank queue (operator 2).

All pre-tokens of a batch lie in one linked list of byte positions. A bucket per
merge rank holds the positions where that merge is possible; a bitmap of three
levels marks the buckets that are not empty, and find-first-set on it gives the
lowest rank. The whole bucket is merged at once: positions whose pair has changed
since they were queued are stale and skipped, overlapping positions are taken from
the left, and the pairs that the merges create are queued in their buckets. The
cost follows the number of merges and never the square of a pre-token's length.

Pre-tokens do not touch each other, so doing a rank for all of them together
equals doing it for each alone, unless a merge creates a pair of a lower rank.
That does not happen with trained ranks; where a given rank table does it, the
pre-token is encoded once more by the same queue, one position at a time.

Defined results: null or empty text has no ids and decodes to no bytes; a null id
list decodes to no bytes; texts are encoded in slices of a few MB, a longer one by itself;
repeated rows give equal results; extra columns stay.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm import mixing
from rasterspark.llm.common import slices, table, text_key, text_or_empty

#: Most words whose ids a task remembers, and the longest word it remembers.
CACHE_WORDS = 150_000
CACHE_LENGTH = 64
#: Texts that are encoded together, and pre-tokens where texts can't be cut into words.
SLICE, SLICE_BYTES = 2000, 1 << 23
BATCH = 100_000
_NONE = np.int32(2**31 - 1)


class BitmapQueue:
    """Buckets by rank below 64 ** 3; three bitmap levels find the lowest one in use."""

    def __init__(self) -> None:
        self.bucket: dict[int, list] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def add(self, rank: int, item) -> None:
        if rank in self.bucket:
            self.bucket[rank].append(item)
            return
        self.bucket[rank] = [item]
        word, page = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[page] = self.mid.get(page, 0) | 1 << (word & 63)
        self.top |= 1 << page

    def first(self) -> int:
        """The lowest rank in use, or -1."""
        if not self.top:
            return -1
        page = (self.top & -self.top).bit_length() - 1
        word = page << 6 | (self.mid[page] & -self.mid[page]).bit_length() - 1
        return word << 6 | (self.low[word] & -self.low[word]).bit_length() - 1

    def take(self, rank: int) -> list:
        word, page = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[page] &= ~(1 << (word & 63))
            if not self.mid[page]:
                self.top &= ~(1 << page)
        return self.bucket.pop(rank)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing or max(ranks.values()) >= 64**3:
            raise ValueError(f"bytes without a rank: {missing[:5]}; ranks must be below {64**3}")
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        by_rank = [b""] * (max(ranks.values()) + 1)
        pairs = {}
        for token, rank in ranks.items():
            by_rank[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 18 | right] = rank
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.token_sizes = np.array([len(t) for t in by_rank])
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, 2**62)
        self.pair_ranks = np.array([pairs[k] for k in keys.tolist()] + [0], np.int32)
        self._forget()

    def _token(self, rank: int) -> bytes:
        at = int(self.token_starts[rank])
        return self.token_bytes[at : at + int(self.token_sizes[rank])].tobytes()

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 18 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def decode_ids(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of several id lists that follow each other, and where each ends (0 first)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_sizes) or not self.token_sizes[ids].all()):
            raise ValueError("an id without a token")
        ends = np.concatenate([[0], np.cumsum(self.token_sizes[ids])])
        return _rows(self.token_bytes, self.token_sizes, ids, self.token_starts), ends[np.concatenate([[0], np.cumsum(counts)])]

    def encode_one(self, piece: bytes) -> list[int]:
        """One pre-token, one position at a time: the leftmost pair of the lowest rank."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        token, after, before = [int(self.of_byte[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int] = [-1] * n
        queue = BitmapQueue()

        def see(p: int) -> None:
            q = after[p]
            pair[p] = self.ranks.get(self._token(token[p]) + self._token(token[q]), -1) if q < n else -1
            if pair[p] >= 0:
                queue.add(pair[p], p)

        for p in range(n):
            see(p)
        while (rank := queue.first()) >= 0:
            heap = queue.take(rank)
            heapq.heapify(heap)
            while heap:
                p = heapq.heappop(heap)
                if token[p] < 0 or pair[p] != rank:
                    continue  # stale
                gone = after[p]
                token[p], token[gone], pair[gone] = rank, -1, -1
                after[p] = after[gone]
                if after[p] < n:
                    before[after[p]] = p
                see(p)
                if before[p] >= 0:
                    see(before[p])
                if heap and queue.top and queue.first() < rank:
                    for rest in heap:
                        queue.add(rank, rest)
                    break
        return [t for t in token if t >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in one array, and the number of ids of each."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        sizes = np.fromiter((len(p) > 0 for p in pieces), np.int64, len(pieces))
        todo = np.flatnonzero((whole < 0) & (sizes > 0)).tolist()
        if not todo:
            return whole[sizes > 0].astype(np.int32), sizes
        data = np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)
        n = len(data)
        ends = np.cumsum([len(pieces[i]) for i in todo])
        starts = np.concatenate([[0], ends[:-1]])
        # Position n is the end of every piece; it never pairs.
        token = np.append(self.of_byte[data], -1).astype(np.int64)
        after = np.arange(1, n + 2)
        after[ends - 1] = n
        before = np.arange(-1, n)
        before[starts] = -1
        pair = np.full(n + 1, _NONE, np.int32)
        inner = np.flatnonzero(after[:n] != n)
        pair[inner] = self._pair_ranks(token[inner], token[after[inner]])
        alive = np.ones(n, bool)
        queue, odd = BitmapQueue(), set()

        def push(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks != _NONE], ranks[ranks != _NONE]
            if len(at) == 1:
                queue.add(int(ranks[0]), at)
            elif len(at):
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(np.diff(ranks)) + 1
                for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                    queue.add(rank, part)

        push(inner)
        while (rank := queue.first()) >= 0:
            parts = queue.take(rank)
            at = parts[0] if len(parts) == 1 else _distinct(np.concatenate(parts))
            at = at[pair[at] == rank]  # the rest is stale
            if not len(at):
                continue
            if len(at) > 1 and (meets := after[at[:-1]] == at[1:]).any():
                index = np.arange(len(at))
                start = np.maximum.accumulate(np.where(np.append(False, meets), 0, index))
                at = at[(index - start) % 2 == 0]
            gone = after[at]
            if len(at) > 1 and (next_to := after[gone[:-1]] == at[1:]).any():
                # Alone, the left one would merge while its neighbour is still in halves.
                lower = self._pair_ranks(np.full(int(next_to.sum()), rank), token[at[1:][next_to]]) < rank
                odd.update(np.searchsorted(ends, at[1:][next_to][lower], side="right").tolist())
            token[at] = rank
            alive[gone] = False
            pair[gone] = _NONE
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            left = left[left >= 0]
            new = _distinct(np.concatenate([at, left])) if len(left) else at
            pair[new] = _NONE
            new = new[after[new] != n]
            if not len(new):
                continue
            pair[new] = self._pair_ranks(token[new], token[after[new]])
            if (lower := pair[new] < rank).any():
                odd.update(np.searchsorted(ends, new[lower], side="right").tolist())
            push(new)
        counts = np.add.reduceat(alive, starts)
        flat = token[:n][alive]
        for k in sorted(odd, reverse=True):
            ids = self.encode_one(pieces[todo[k]])
            at = int(counts[:k].sum())
            flat = np.concatenate([flat[:at], ids, flat[at + int(counts[k]) :]])
            counts[k] = len(ids)
        sizes[todo] = counts
        owner = np.repeat(whole, sizes)
        owner[owner < 0] = flat
        return owner.astype(np.int32), sizes

    def _encode_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of pre-tokens that may repeat, and how many each has."""
        number = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        flat, sizes = self.encode_pieces([p.encode() for p in number])
        order = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        return _rows(flat, sizes, order), sizes[order]

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Keep only the words with these numbers."""
        if keep is None:
            self.words = _Numbers()
            self.word_ids, self.word_sizes = np.empty(0, np.int32), np.empty(0, np.int64)
            self.word_bad, self.word_uses = np.empty(0, bool), np.empty(0, np.int64)
            return
        known = list(self.words)
        self.words = _Numbers((known[k], i) for i, k in enumerate(keep.tolist()))
        self.word_ids = _rows(self.word_ids, self.word_sizes, keep)
        self.word_sizes, self.word_bad, self.word_uses = self.word_sizes[keep], self.word_bad[keep], self.word_uses[keep] // 2

    def _learn(self, new: list[str]) -> None:
        """Ids of new words. A word stands for itself after a space; with a space in front it is the first of a text."""
        bad = np.fromiter((w[-1].isspace() for w in new), bool, len(new))
        sizes = np.zeros(len(new), np.int64)
        heads = [i for i, w in enumerate(new) if w[0] == " " and not bad[i]]
        later = [i for i, w in enumerate(new) if w[0] != " " and not bad[i]]
        pieces, starts = [], []
        for i in heads:
            starts.append(len(pieces))
            pieces += self.pattern.findall(new[i][1:])
        if later:
            # A piece begins with a space exactly where a word begins.
            rest = self.pattern.findall(" " + " ".join([new[i] for i in later]))
            starts += [len(pieces) + i for i, p in enumerate(rest) if p[0] == " "]
            pieces += rest
        ids, counts = self._encode_all(pieces)
        order = np.array(heads + later, np.int64)
        if len(order):
            sizes[order] = np.add.reduceat(counts, starts)
        self.word_ids = np.concatenate([self.word_ids, _rows(ids, sizes[order], np.argsort(order))])
        self.word_sizes = np.concatenate([self.word_sizes, sizes])
        self.word_bad = np.concatenate([self.word_bad, bad])
        self.word_uses = np.concatenate([self.word_uses, np.zeros(len(new), np.int64)])

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each.

        No match crosses the place before a space that follows a non-space, so a
        text is cut there into words, and a word that is remembered needs no match.
        Texts with other white space before a space, or a space at an end, are
        matched whole.
        """
        known, number = len(self.words), self.words.__getitem__
        orders, plain = [], []
        for i, text in enumerate(texts):
            if text and "  " not in text and text[0] != " " and text[-1] != " ":
                words = text.split(" ")
                words[0] = " " + words[0]
                orders.append(np.fromiter(map(number, words), np.int32, len(words)))
                plain.append(i)
        self._learn(list(islice(self.words, known, None)))
        starts = np.cumsum(self.word_sizes) - self.word_sizes
        out = dict.fromkeys(range(len(texts)))
        for i, order in zip(plain, orders):
            if not self.word_bad[order].any():
                out[i] = _rows(self.word_ids, self.word_sizes, order, starts)
        self._encode_whole([i for i, ids in out.items() if ids is None], texts, out)
        self._age(orders)
        sizes = np.fromiter(map(len, out.values()), np.int64, len(out))
        return np.concatenate([np.empty(0, np.int32), *out.values()]), sizes

    def _encode_whole(self, left: list[int], texts: list[str], out: dict[int, np.ndarray]) -> None:
        """Texts that can't be cut into words, many in one batch."""
        pieces, held = [], []
        for i in left:
            found = self.pattern.findall(texts[i])
            held.append((i, len(found)))
            pieces += found
            if len(pieces) > BATCH or i == left[-1]:
                ids, sizes = self._encode_all(pieces)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                at = 0
                for k, n in held:
                    out[k] = ids[ends[at] : ends[at + n]]
                    at += n
                pieces, held = [], []

    def _age(self, orders: list[np.ndarray]) -> None:
        """Beyond CACHE_WORDS forget long words, then those least used."""
        if orders:
            self.word_uses += np.bincount(np.concatenate(orders), minlength=len(self.word_uses))
        if len(self.words) > CACHE_WORDS:
            uses = np.where(np.fromiter(map(len, self.words), np.int64, len(self.words)) > CACHE_LENGTH, 0, self.word_uses)
            least = np.partition(uses, -(CACHE_WORDS // 2))[-(CACHE_WORDS // 2)]
            self._forget(np.flatnonzero(uses > least))


class _Numbers(dict):
    """Numbers words as they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


def _rows(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The rows ``order`` of a ragged array, one after the other."""
    starts = np.cumsum(sizes) - sizes if starts is None else starts
    lengths = sizes[order]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[order] - ends + lengths, lengths) + np.arange(total)]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return Encoder(ranks, pattern)


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def _list_column(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def encode(
    df: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``df`` with the array column ``ids`` added (or replaced).

    With ``decoded`` the ids are decoded again in the same pass, into a binary column of that name.
    """
    path = path or default_ranks()
    added = [ids] if decoded is None else [ids, decoded]
    df = df.withColumn("_bpe_text", text_or_empty(text)).drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "_bpe_text", SLICE, SLICE_BYTES):
                flat, sizes = own.encode_texts(part.column("_bpe_text").to_pylist())
                columns = [_list_column(flat, sizes)]
                if decoded is not None:
                    columns.append(_binary_column(*own.decode_ids(flat, sizes)))
                names = [n for n in part.schema.names if n != "_bpe_text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], [*names, *added])
        # The worker lives on for other tasks and stages; the words of this one would only take its memory.
        own._forget()
        pa.default_memory_pool().release_unused()

    more = f"`{ids}` array<int>" + (f", `{decoded}` binary" if decoded is not None else "")
    return df.mapInArrow(run, _fields(df.drop("_bpe_text")) + more)


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for in the binary column ``into``; an id without a token is an error."""
    path = path or default_ranks()
    df = df.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = part.column(ids)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                column = _binary_column(*own.decode_ids(lists.flatten().to_numpy(zero_copy_only=False), counts))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, into])

    return df.mapInArrow(run, _fields(df) + f"`{into}` binary")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts end in the worker; only ids and decoded bytes come back.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("ids"))
    coded = encode(docs, text="ids", decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id and source with the ids of the text, and a digest of the decoded bytes; slot, epoch and place tell the mixed order."""
    k1, k2 = text_key()
    coded = encode(docs.select("doc_id", "source", k1, k2, F.col("text").alias("ids")), text="ids", decoded="decoded")
    coded = coded.select("_k1", "_k2", "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return mixing.placed(coded, docs).select("doc_id", "source", "n_tokens", "ids", "decoded_sha256", "slot", "epoch", "place")
