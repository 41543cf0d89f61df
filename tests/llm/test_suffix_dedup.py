import hashlib
import random
from collections import Counter

from rasterspark.llm import suffix_dedup


def repeated(texts, least):
    """Bytes covered by a string of ``least`` bytes that starts at two places."""
    counts = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        marks = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if counts[t[i : i + least]] > 1:
                marks[i : i + least] = b"\1" * least
        out.append(bytes(marks))
    return out


def small_texts(rng):
    base = bytes(rng.choice(b"ab") for _ in range(60))
    texts = []
    for _ in range(rng.randrange(1, 7)):
        t = bytearray()
        while len(t) < rng.randrange(5, 80):
            a = rng.randrange(50)
            t += base[a : a + rng.randrange(1, 30)]
        texts.append(bytes(t))
    return texts


def test_repeats_cover_what_brute_force_covers():
    rng = random.Random(3)
    for _ in range(200):
        texts, least = small_texts(rng), rng.choice([4, 6, 9, 17])
        found = suffix_dedup.maximal_repeats(texts, least)
        marks = [bytearray(len(t)) for t in texts]
        for t, s, n in zip(*(found[k].tolist() for k in ("text", "start", "length"))):
            marks[t][s : s + n] = b"\1" * n
        assert [bytes(m) for m in marks] == repeated(texts, least)


def test_groups_are_maximal_repeats_with_all_occurrences():
    rng = random.Random(4)
    for _ in range(100):
        texts, least = small_texts(rng), 5
        found = suffix_dedup.maximal_repeats(texts, least)
        rows = list(zip(*(found[k].tolist() for k in ("group", "parent", "length", "text", "start"))))
        parent, length, members = {}, {}, {}
        for g, p, n, t, s in rows:
            parent[g], length[g] = p, n
            members.setdefault(g, set()).add((t, s))
        for g in list(members):
            string = {texts[t][s : s + length[g]] for t, s in members[g]}
            assert len(string) == 1
        for g, own in members.items():
            every = set(own)
            for h in members:
                up = h
                while up in parent and up != g:
                    up = parent[up]
                if up == g:
                    every |= members[h]
            t, s = next(iter(own))
            string = texts[t][s : s + length[g]]
            places = {(i, j) for i, x in enumerate(texts) for j in range(len(x)) if x.startswith(string, j)}
            assert every == places
            left = {texts[i][j - 1] if j else (-1, i) for i, j in places}
            right = {texts[i][j + len(string)] if j + len(string) < len(texts[i]) else (-1, i) for i, j in places}
            assert len(left) > 1 and len(right) > 1


def test_anchors_split_all_windows():
    rng = random.Random(6)
    data = bytes(rng.choice(b"abcdefgh ") for _ in range(5000))
    got = suffix_dedup.anchors(data)
    assert [s for _, s, _ in got] == [0, *[e for *_, e in got[:-1]]] and got[-1][2] == len(data) - suffix_dedup.LENGTH + 1
    of = {p: h for h, s, e in got for p in range(s, e)}
    moved = suffix_dedup.anchors(b"xyz" * 50 + data[1000:2000] + b"tail" * 60)
    also = {p: h for h, s, e in moved for p in range(s, e)}
    assert all(also[150 + i] == of[1000 + i] for i in range(600))
    assert suffix_dedup.anchors(b"a" * 399) == [] and len(suffix_dedup.anchors(b"a" * 400)) == 1


def check(spark, folder, rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = Counter()
    for (i, *_), t, m in zip(rows, texts, repeated(texts, suffix_dedup.LENGTH)):
        kept = bytes(b for b, gone in zip(t, m) if not gone)
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        want[i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.op8_suffix_dedup(spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_query(spark, folder, rows, empty, monkeypatch):
    check(spark, folder, rows)
    assert suffix_dedup.op8_suffix_dedup(spark, empty).count() == 0
    monkeypatch.setattr(suffix_dedup, "CLASSES", 2)  # more contexts go by window hashes
    check(spark, folder, rows)
