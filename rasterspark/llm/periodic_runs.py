"""Runs of repeated words, found on a grammar (operator 13).

The words of a text become numbers, and Re-Pair turns each text into a grammar: the
pairs of neighbouring symbols that are more frequent than the pairs they overlap are
replaced by a nonterminal, again and again, until no pair occurs twice in its text. What
is left is paired up evenly, so that every text is one binary tree. All texts of a slice
take each step together; symbols of different texts are different.

A run lies across the boundary between the two children of the lowest node that holds
it whole. So each distinct nonterminal is looked at once, at its first place: a run of
four periods has two of them on one side of the boundary, and there the two words at
the boundary come again one period on. Such places are looked up, and the common
extensions in both directions give the run as far as the nonterminal reaches. Extensions
are measured by hashes and every run is compared word for word afterwards, so the result
is exact. The runs of a nonterminal are then moved to all places where it was derived;
intervals of one period that share a period are parts of one run and merge, and of the
multiples of a period the smallest stays.

Defined results: null text and text without words have no runs; a row's own doc_id
decides whether its words are made periodic first (null: they are not); repeated rows
give equal results; a long text is a slice of its own, cut into words passage by passage;
an empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm.common import slices, table, text_or_empty

#: A run has at least POWER periods and LEAST words.
POWER, LEAST = 4, 6
#: Bytes of text cut into words together, and candidates looked at together.
PASSAGE, CANDIDATES = 1 << 22, 1 << 21
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """A number for each word, in the order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def word_numbers(text: bytes, numbers: dict) -> np.ndarray:
    """The words of one text as their ``numbers``."""
    parts, start = [], 0
    while start < len(text):
        stop = len(text)
        if stop - start > PASSAGE:
            stop = max(text.rfind(c, start, start + PASSAGE) for c in (b" ", b"\n", b"\t", b"\v", b"\f", b"\r"))
            if stop <= start:
                stop = min((p for c in b" \n\t\v\f\r" if (p := text.find(c, start + PASSAGE)) >= 0), default=len(text))
        parts.append(np.fromiter(map(numbers.__getitem__, text[start:stop].split()), np.int64))
        start = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each key, first place of each different key, how often it occurs)."""
    order = np.argsort(key, kind="stable")
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[order[1:]], key[order[:-1]], out=new[1:])
    index = np.empty(len(key), np.int64)
    index[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return index, order[first], np.diff(np.append(first, len(key)))


class Grammar:
    """Binary grammars of several texts that lie one after the other.

    ``nodes`` has (begin, boundary, end) of the first place of every nonterminal, and
    ``places`` (nonterminal, begin) of every derivation.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray) -> None:
        self.size = len(words)
        symbol, _, _ = _dense(owner * (int(words.max(initial=0)) + 1) + words)
        self.symbols = int(symbol.max(initial=-1)) + 1
        self.terminals = symbol
        begin, end = np.arange(self.size), np.arange(1, self.size + 1)
        self._nodes: list[np.ndarray] = []
        self._places: list[np.ndarray] = []
        self._count = 0
        rest: list[tuple] = []
        while len(symbol):
            symbol, begin, end, owner, done = self._replace(symbol, begin, end, owner)
            rest.append(done)
        begin, end, owner = (np.concatenate(c) for c in zip(*rest)) if rest else (begin, end, owner)
        order = np.argsort(begin)
        self._even(begin[order], end[order], owner[order])
        self.nodes = np.concatenate(self._nodes) if self._nodes else np.zeros((0, 3), np.int64)
        self.places = np.concatenate(self._places) if self._places else np.zeros((0, 2), np.int64)

    def _add(self, begin: np.ndarray, boundary: np.ndarray, end: np.ndarray, which: np.ndarray, first: np.ndarray) -> None:
        """Nonterminals ``which`` (from 0) derived at all ``begin``; ``first`` is a place of each."""
        self._nodes.append(np.stack([begin[first], boundary[first], end[first]], 1))
        self._places.append(np.stack([which + self._count, begin], 1))
        self._count += len(first)

    def _replace(self, symbol, begin, end, owner):
        """One round on the texts that still have a pair twice; the symbols of the others are done."""
        same = owner[:-1] == owner[1:]
        left, right = symbol[:-1], symbol[1:]
        index, _, count = _dense(np.where(same, left * self.symbols + right, -1))
        often = count[index]
        # Of aaaa only every second pair can be taken.
        equal = same & (left == right)
        at = np.arange(len(left))
        odd = (at - np.maximum.accumulate(np.where(equal, 0, at + 1))) & 1 == 1
        often = np.where(same & (often > 1) & ~(equal & odd), often, 0)
        busy = np.zeros(int(owner[-1]) + 1, bool)
        busy[owner[:-1][often > 0]] = True
        # More often first, then a number that differs between pairs.
        mixed = (index + 1).astype(np.uint64) * _FACTOR >> np.uint64(40)
        rank = np.where(often > 0, (often << 24 | mixed.astype(np.int64)) + 1, 0)
        around = np.concatenate([[0], rank, [0]])
        take = (rank > around[:-2]) & (rank >= around[2:]) & (rank > 0)
        take[1:] &= ~take[:-1]
        chosen = np.flatnonzero(take)
        which, first, _ = _dense(index[chosen])
        self._add(begin[chosen], begin[chosen + 1], end[chosen + 1], which, first)
        symbol, end = symbol.copy(), end.copy()
        symbol[chosen] = self.symbols + which
        end[chosen] = end[chosen + 1]
        self.symbols += len(first)
        keep = np.ones(len(symbol), bool)
        keep[chosen + 1] = False
        live = busy[owner]
        done = keep & ~live
        keep &= live
        return symbol[keep], begin[keep], end[keep], owner[keep], (begin[done], end[done], owner[done])

    def _even(self, begin, end, owner) -> None:
        """Pairs the symbols of each text up, level by level, until one is left."""
        while True:
            new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
            at = np.arange(len(owner))
            place = at - np.maximum.accumulate(np.where(new, at, 0))
            head = np.flatnonzero((place[:-1] % 2 == 0) & ~new[1:])
            if not len(head):
                return
            self._add(begin[head], begin[head + 1], end[head + 1], np.arange(len(head)), np.arange(len(head)))
            end = end.copy()
            end[head] = end[head + 1]
            keep = np.ones(len(owner), bool)
            keep[head + 1] = False
            begin, end, owner = begin[keep], end[keep], owner[keep]


class _Extensions:
    """Common extensions of places of one sequence, by hashes of its prefixes; never too short."""

    def __init__(self, symbol: np.ndarray) -> None:
        self.symbol = symbol
        n = len(symbol)
        random = np.random.default_rng(13).integers(0, 2**64, int(symbol.max(initial=0)) + 1, np.uint64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _FACTOR)]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(random[symbol] * self.power[:n])])

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For a <= b: whether ``length`` words from a and from b have one hash."""
        with np.errstate(over="ignore"):
            return (self.sums[a + length] - self.sums[a]) * self.power[b - a] == self.sums[b + length] - self.sums[b]

    def _most(self, limit: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The greatest length up to ``limit`` for which ``fits``, which holds for all smaller ones."""
        got = np.zeros(len(limit), np.int64)
        step = 1 << max(int(limit.max(initial=0)).bit_length() - 1, 0)
        while step:
            at = np.flatnonzero(got + step <= limit)
            more = at[fits(at, got[at] + step)]
            got[more] += step
            step >>= 1
        return got

    def after(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self._most(limit, lambda i, length: self._equal(a[i], b[i], length))

    def before(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self._most(limit, lambda i, length: self._equal(a[i] - length, b[i] - length, length))


def _repeats(group: np.ndarray, node: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, by_group: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, place) of the places from low to high (without) that have the group of ``place``; in parts of bounded size."""
    key, order, size = by_group
    lo = np.searchsorted(key, group[place] * size + low)
    many = np.maximum(np.searchsorted(key, group[place] * size + np.maximum(low, high)) - lo, 0)
    total = np.concatenate([[0], np.cumsum(many)])
    start = 0
    while start < len(node):
        stop = max(int(np.searchsorted(total, total[start] + CANDIDATES, side="right")) - 1, start + 1)
        n = many[start:stop]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if len(inside):
            yield np.repeat(node[start:stop], n), order[np.repeat(lo[start:stop], n) + inside]
        start = stop


def _true(symbol: np.ndarray, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each interval has its period, word for word."""
    ok = np.ones(len(begin), bool)
    length = end - begin - period
    for at in np.flatnonzero(length > 4096).tolist():
        b, e, q = int(begin[at]), int(end[at]), int(period[at])
        ok[at] = np.array_equal(symbol[b : e - q], symbol[b + q : e])
    short = np.flatnonzero(length <= 4096)
    for part in range(0, len(short), 1024):
        i = short[part : part + 1024]
        n = length[i]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a = np.repeat(begin[i], n) + inside
        bad = symbol[a] != symbol[a + np.repeat(period[i], n)]
        ok[i] = np.bincount(np.repeat(np.arange(len(i)), n)[bad], minlength=len(i)) == 0
    return ok


def _exact(symbol: np.ndarray, low: int, high: int, seed: int, period: int) -> tuple[int, int]:
    """The longest interval with ``period`` around the equal words seed and seed + period, within low and high."""
    begin, end = seed, seed + period
    while begin > low and symbol[begin - 1] == symbol[begin - 1 + period]:
        begin -= 1
    while end < high and symbol[end] == symbol[end - period]:
        end += 1
    return begin, end


def _crossing(grammar: Grammar, owner: np.ndarray) -> np.ndarray:
    """(nonterminal, begin, end, period) of the runs across the boundary of each nonterminal, at its first place."""
    symbol, n = grammar.terminals, grammar.size
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    group = np.full(n, -1)
    group[inside], _, count = _dense(symbol[inside] * (int(symbol.max(initial=0)) + 1) + symbol[inside + 1])
    order = inside[np.argsort(group[inside], kind="stable")]
    key = group[order] * n + order
    twice = np.zeros(n, bool)
    twice[inside] = count[group[inside]] > 1
    begin, boundary, end = grammar.nodes.T
    number = np.arange(len(begin))
    extend = _Extensions(symbol)
    found = []

    def keep(node: np.ndarray, a: np.ndarray, period: np.ndarray) -> None:
        """The runs in which a and a + period are equal and next to the boundary."""
        forward = extend.after(a, a + period, end[node] - a - period)
        backward = extend.before(a, a + period, a - begin[node])
        long = forward + backward + period >= np.maximum(LEAST, POWER * period)
        node, a, period = node[long], a[long], period[long]
        b, e = a - backward[long], a + period + forward[long]
        # Multiples of a true period have its interval; the smallest is enough.
        turn = np.lexsort((period, e, b, node))
        node, b, e, period, a = node[turn], b[turn], e[turn], period[turn], a[turn]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (b[1:] != b[:-1]) | (e[1:] != e[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))
        true = np.zeros(len(node), bool)
        true[new] = _true(symbol, b[new], e[new], period[new])
        left = new | ~true[head] | (period % period[head] != 0)
        check = np.flatnonzero(left & ~new)
        true[check] = _true(symbol, b[check], e[check], period[check])
        for i in np.flatnonzero(left & ~true).tolist():  # equal hashes of different words
            b[i], e[i] = _exact(symbol, int(begin[node[i]]), int(end[node[i]]), int(a[i]), int(period[i]))
        long = left & (e - b >= np.maximum(LEAST, POWER * period))
        found.append(np.stack([node, b, e, period], 1)[long])

    # Two periods to the right of the boundary: its two words come again.
    some = number[twice[np.minimum(boundary, n - 1)] & (end - boundary > 2)]
    at = boundary[some]
    for node, place in _repeats(group, some, at, at + 1, at + (end[some] - at) // 2 + 1, (key, order, n)):
        keep(node, boundary[node], place - boundary[node])
    # Two periods to the left: the two words before it came before.
    some = number[(boundary - begin > 2) & twice[np.maximum(boundary - 2, 0)]]
    at = boundary[some] - 2
    for node, place in _repeats(group, some, at, boundary[some] - (boundary[some] - begin[some]) // 2 - 2, at, (key, order, n)):
        keep(node, place, boundary[node] - 2 - place)
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def runs(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """(begin, end, period) of all runs, by begin and period; ``owner`` (ascending) says whose text a word is."""
    if len(words) < LEAST:
        return np.zeros((0, 3), np.int64)
    grammar = Grammar(words, owner)
    crossing = _crossing(grammar, owner)
    node, b, e, period = crossing.T
    # To every place where the nonterminal was derived.
    places = grammar.places[np.isin(grammar.places[:, 0], node)]
    places = places[np.argsort(places[:, 0], kind="stable")]
    lo = np.searchsorted(places[:, 0], node)
    many = np.searchsorted(places[:, 0], node, side="right") - lo
    inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    shift = places[np.repeat(lo, many) + inside, 1] - np.repeat(grammar.nodes[node, 0], many)
    b, e, period = np.repeat(b, many) + shift, np.repeat(e, many) + shift, np.repeat(period, many)
    # Intervals of one period that share a period's length are one run.
    order = np.lexsort((b, period))
    b, e, period = b[order], e[order], period[order]
    far = period * (grammar.size + 1)
    reach = np.maximum.accumulate(far + e) if len(e) else e
    new = np.ones(len(b), bool)
    new[1:] = (period[1:] != period[:-1]) | (far[1:] + b[1:] > reach[:-1] - period[1:])
    head = np.flatnonzero(new)
    b, e, period = b[head], np.maximum.reduceat(e, head) if len(head) else e, period[head]
    # Multiples of the smallest period have the same interval.
    order = np.lexsort((period, e, b))
    b, e, period = b[order], e[order], period[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (e[1:] != e[:-1])
    out = np.stack([b, e, period], 1)[new]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def made_periodic(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """``words``, of which a tenth of the doc_ids get a periodic ending."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not len(words):
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def dropped(found: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a run of ``found`` behind its first period."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length for its period; ties: smallest start, then period."""
    best = found[0]
    for b, length, q in found[1:]:
        here, there = length * best[2], best[1] * q
        if here > there or (here == there and (b, q) < (best[0], best[2])):
            best = (b, length, q)
    return best


SCHEMA = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _rows(part: pa.RecordBatch, change: Callable[[np.ndarray, int | None], np.ndarray] | None, texts: bool) -> dict:
    numbers = _Numbers()
    ids = part.column("doc_id").to_pylist()
    cut = [word_numbers(t, numbers) for t in part.column("_text").to_pylist()]
    if change is not None:
        cut = [change(w, i) for w, i in zip(cut, ids)]
    words = np.concatenate(cut) if cut else np.zeros(0, np.int64)
    ends = np.cumsum([len(w) for w in cut])
    found = runs(words, np.repeat(np.arange(len(cut)), [len(w) for w in cut]))
    whose = np.searchsorted(ends, found[:, 0], side="right")
    gone = dropped(found, len(words))
    first = np.searchsorted(whose, np.arange(len(cut) + 1))
    vocabulary = list(numbers)
    out: dict[str, list] = {n: [] for n in ("n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256", "collapsed")}
    for i, own in enumerate(cut):
        base = int(ends[i]) - len(own)
        mine = [(b - base, e - b, q) for b, e, q in found[first[i] : first[i + 1]].tolist()]
        best = _strongest(mine) if mine else (None, None, None)
        out["n_runs"].append(len(mine))
        for name, value in zip(("start", "length", "period"), best):
            out[name].append(value)
        out["exponent_milli"].append(1000 * best[1] // best[2] if mine else None)
        out["runs"].append([{"start": b, "length": n, "period": q} for b, n, q in mine])
        out["runs_sha256"].append(hashlib.sha256("".join(f"{b},{n},{q}\n" for b, n, q in mine).encode()).hexdigest())
        kept = own[~gone[base : base + len(own)]] if mine else own
        digest, parts = hashlib.sha256(), []
        for at in range(0, len(kept), 1 << 16):
            text = (b" " if at else b"") + b" ".join(map(vocabulary.__getitem__, kept[at : at + (1 << 16)].tolist()))
            digest.update(text)
            if texts:
                parts.append(text)
        out["collapsed_sha256"].append(digest.hexdigest())
        out["collapsed"].append(b"".join(parts).decode("utf-8", "replace") if texts else None)
    return out


def periodic_runs(docs: DataFrame, change: Callable[[np.ndarray, int | None], np.ndarray] | None = None, collapsed: bool = True) -> DataFrame:
    """doc_id and the columns of SCHEMA for every row, and with ``collapsed`` the text without repeats.

    ``change`` may alter the words (as numbers) of a document first.
    """
    schema = "doc_id long, " + SCHEMA + (", collapsed string" if collapsed else "")
    kinds = {"runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                out = _rows(part, change, collapsed)
                if not collapsed:
                    del out["collapsed"]
                text = pa.string()
                types = {n: kinds.get(n, text if "sha256" in n or n == "collapsed" else pa.int64()) for n in out}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **{n: pa.array(v, types[n]) for n, v in out.items()}})

    return rows.mapInArrow(run, schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), made_periodic, collapsed=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
