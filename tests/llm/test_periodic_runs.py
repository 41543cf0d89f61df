import hashlib
import random
import re
import zlib

import numpy as np

from rasterspark.llm import periodic_runs as pr


def plain_runs(words):
    """All (start, length, period) by looking at every period."""
    out = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and (s, i + q - s) not in out:
                out[s, i + q - s] = q
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(rows), sha(kept))


def check(texts):
    words = np.concatenate([np.array(t, np.int64) for t in texts])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    base, want = 0, []
    for t in texts:
        want += [(base + s, base + s + n, q) for s, n, q in plain_runs(list(t))]
        base += len(t)
    assert [tuple(r) for r in pr.runs(words, owner).tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_random_sequences():
    rng = random.Random(1)
    for trial in range(400):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            kind, n = rng.randrange(5), rng.randrange(0, 120)
            if kind == 0:
                t = [rng.randrange(2) for _ in range(n)]
            elif kind == 1:
                t = [rng.randrange(50) for _ in range(n)]
            elif kind == 2:
                p = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
                t = [rng.randrange(3) for _ in range(rng.randrange(9))] + (p * 40)[:n] + [rng.randrange(3) for _ in range(rng.randrange(9))]
            elif kind == 3:  # a period of a period
                inner = [5] * rng.randrange(1, 9) + [rng.randrange(9)]
                t = (inner * rng.randrange(1, 6) + [7]) * rng.randrange(1, 7)
            else:
                a, b = [0], [0, 1]
                for _ in range(7):
                    a, b = b, b + a
                t = b[: n + 20]
            texts.append(t)
        check(texts)


def test_extreme_sequences():
    check([[1] * 5000])
    check([[1, 2] * 700 + [1] * 900 + [1, 2, 3] * 300, [], [4], [1] * 6, [1] * 5])
    word = [0]
    for _ in range(11):  # no cube in it
        word = word + [1 - w for w in word]
    check([word, word])


def test_many_nonterminals_and_places():
    rng = random.Random(2)
    parts = [[rng.randrange(4) for _ in range(6)] * 5 for _ in range(12)]
    check([sum((rng.choice(parts) + [rng.randrange(100)] for _ in range(60)), []) for _ in range(3)])


def test_equal_hashes_are_compared_word_by_word(monkeypatch):
    """With one hash for all words nothing but the comparison is left."""
    begin = pr._Extensions.__init__

    def blind(self, symbol):
        begin(self, symbol)
        self.sums[:] = 0

    monkeypatch.setattr(pr._Extensions, "__init__", blind)
    rng = random.Random(3)
    for _ in range(60):
        p = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
        check([[rng.randrange(3) for _ in range(9)] + p * 7 + [rng.randrange(3) for _ in range(9)], [rng.randrange(2) for _ in range(60)]])


def test_query_equals_brute_force(spark, folder, rows):
    got = sorted(map(tuple, pr.op13_periodic_runs(spark, folder).collect()), key=str)
    assert got == sorted((plain_row(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 3


def test_texts_spans_and_odd_tables(spark, empty):
    docs = spark.createDataFrame([(1, "go go go go go go now", "x"), (2, None, "y"), (None, "a b " * 9, "z")], "doc_id long, text string, runs string")
    got = {r.doc_id: r for r in pr.periodic_runs(docs).collect()}
    assert got[1].collapsed == "go now" and [tuple(r) for r in got[1].runs] == [(0, 6, 1)]
    assert got[2].collapsed == "" and got[2].n_runs == 0 and got[2].start is None
    assert got[None].collapsed == "a b" and got[None].exponent_milli == 9000
    assert pr.op13_periodic_runs(spark, empty).count() == 0


def test_words_of_a_long_text_in_passages(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode() + b"\x0b" + b"x" * 3000 + b"\n  end"
    numbers = pr._Numbers()
    whole = pr.word_numbers(text, numbers)
    monkeypatch.setattr(pr, "PASSAGE", 300)
    assert pr.word_numbers(text, numbers).tolist() == whole.tolist() and len(whole) == 5002
