import random
from collections import defaultdict

import numpy as np
import xxhash
from llm_samples import SCHEMA

from rasterspark.llm import minhash, simhash
from rasterspark.llm.common import written


def changed(rng, words, places):
    """``words`` with single words changed, far enough apart that each takes five shingles."""
    out = list(words)
    for k in range(places):
        out[(2 * k + 1) * len(words) // (2 * places)] = f"new{rng.getrandbits(60):x}"
    return out


def family_rows():
    """(family, doc_id, words): near copies from 0.8 on; and (pair, doc_id, words): pairs just below."""
    rng = random.Random(5)
    near, far = [], []
    ids = iter(range(10**6))
    for f in range(120):
        size, places = [(250, 1), (250, 2), (500, 4), (120, 2), (104, 2), (454, 10)][f % 6]
        words = [f"w{rng.getrandbits(60):x}" for _ in range(size)]
        near += [(f, next(ids), words), (f, next(ids), changed(rng, words, places))]
    for f in range(60):
        words = [f"w{rng.getrandbits(60):x}" for _ in range(104)]
        far += [(1000 + 2 * f, next(ids), words), (1001 + 2 * f, next(ids), changed(rng, words, 3))]
    # A chain whose ends are below 0.8, and one set in other cases and spaces.
    words = [f"w{rng.getrandbits(60):x}" for _ in range(204)]
    for step in range(5):
        near.append((500, next(ids), list(words)))
        words[20 + 40 * step] = f"new{step}"
        words[35 + 40 * step] = f"more{step}"
    near += [(501, next(ids), ["One", "two"]), (501, next(ids), ["one\n", "TWO"]), (502, next(ids), []), (502, next(ids), [" "])]
    return near + far


def plain_similarity(a, b):
    cut = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b)


def near_groups(texts):
    """A group for each text, by all pairs of at least four fifths."""
    group = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if group[i] != group[j] and plain_similarity(a, texts[j]) >= 0.8:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return group


def test_stage_takes_near_copies_from_four_fifths(spark, tmp_path):
    rows = [(f, i, " ".join(w)) for f, i, w in family_rows()]
    families = defaultdict(list)
    for f, i, t in rows:
        families[f].append(t)
    assert all(plain_similarity(*families[f]) >= 0.8 for f in range(120))
    assert 0.7 < plain_similarity(families[1000][0], families[1001][0]) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for _, i, t in rows], SCHEMA).repartition(4)
    kept = {r.doc_id for r in simhash.stage(spark, docs, "").collect()}
    want = {min(i for f, i, _ in rows if f == g) for g in families}
    assert kept == want


def test_components_of_a_hot_band(spark):
    """Keys dealt out as pairs of small cells give the same components."""
    rows = [(f, i, " ".join(w)) for f, i, w in family_rows()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for _, i, t in rows], SCHEMA)
    sketched = written(minhash.sketches(docs, simhash.majority))
    parts = [as_parts(minhash.components(sketched, docs, simhash.components, block)) for block in (2, minhash.BLOCK)]
    assert parts[0] == parts[1]


def as_parts(rooted):
    """The components as sets; which member names one is open."""
    groups = defaultdict(set)
    for r in rooted.collect():
        groups[r.root].add(r["_set"])
    return set(map(frozenset, groups.values()))


def large_family(rng):
    """One family around four fifths, in which some pairs are linked and others are not."""
    base = [f"w{rng.getrandbits(60):x}" for _ in range(150)]
    out = []
    for i in range(160):
        words = list(base)
        for place in rng.sample(range(len(words)), rng.randrange(1, 9)):
            words[place] = f"n{rng.getrandbits(60):x}"
        out.append((i, " ".join(words)))
    return out


def test_large_family_equals_all_pairs(spark):
    rows = large_family(random.Random(9))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows], SCHEMA)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if plain_similarity(a, b) >= 0.8:
                links += 1
                root[find(i)] = find(j)
    names = {xxhash.xxh64_intdigest(minhash.shingle_set(t).tobytes()): i for i, t in rows}
    want = defaultdict(set)
    for name, i in names.items():
        want[find(i)].add(name)
    sketched = written(minhash.sketches(docs, simhash.majority))
    for block in (8, 512):
        got = as_parts(minhash.components(sketched, docs, simhash.components, block))
        assert {frozenset(v % 2**64 for v in g) for g in got} == set(map(frozenset, want.values()))
    assert 300 < links < 160 * 159 // 3 and len(want) > 3


def test_forest_of_a_block():
    sets = [np.arange(10), np.arange(9), np.arange(1, 10), np.arange(20, 30), np.arange(20, 29), np.zeros(0)]
    flat = np.concatenate(sets).astype(np.uint64)
    sizes = np.array([len(s) for s in sets])
    assert minhash.forest(sizes, flat, np.arange(6)) == [(0, 1), (0, 2), (3, 4)]
    assert minhash.forest(sizes, flat, np.array([7, 7, 7, 8, 9, 7])) == [(8, 9)]
    assert minhash.forest(sizes, flat, np.array([7] * 6)) == []
