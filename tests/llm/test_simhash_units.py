import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from llm_samples import SCHEMA
from test_near_dup import near_groups

from rasterspark.llm import simhash, unit_dedup


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, bits=3):
    """Component number of each value, all pairs compared."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint_of_odd_texts(rows):
    for _, text, *_ in rows:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text or "")


def test_links_join_what_all_pairs_join(spark):
    rng = random.Random(1)
    values = [0, 2**64 - 1]
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            v = centre
            for _ in range(rng.randrange(0, 7)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    values = sorted(set(values))
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    prints = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, fp long")
    want = groups(values)
    for block in (5, 1000):  # hot keys dealt as block pairs, and not
        got = {r.fp: r.component_id for r in simhash.components(prints, 3, block).collect()}
        assert [got[v] for v in signed] == want


def test_simhash_query(spark, folder, rows, empty):
    got = simhash.op9_simhash_dedup(spark, folder).collect()
    values = [plain_fingerprint(t or "") for _, t, *_ in rows]
    part = groups(values)
    least = {}
    for (i, *_), g in zip(rows, part):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, f"{v:016x}", least.get(g)) for (i, *_), v, g in zip(rows, values, part))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.op9_simhash_dedup(spark, empty).count() == 0


def test_stage_keeps_one_of_each_group(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = simhash.stage(spark, docs, folder)
    assert kept.columns == docs.columns
    part = dict(zip([(i, t) for i, t, *_ in rows], near_groups([t or "" for _, t, *_ in rows])))
    got = Counter(part[r.doc_id, r.text] for r in kept.collect())
    assert set(got) == set(part.values()) and set(got.values()) == {1}
    assert simhash.stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def plain_units(rows):
    """What stays of each distinct (doc_id, text), units looked up one after the other."""
    docs = sorted(set((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0]))
    # The order of rows with one doc_id is that of a hash; the sample's own rows have no repeats among them.
    first, cuts = {}, {}
    for n, (_, text) in enumerate(docs):
        cuts[n] = []
        for digest, start, end in unit_dedup.units_of(text):
            if first.setdefault(digest, (n, start)) != (n, start):
                cuts[n].append((start, end))
    out = {}
    for n, (i, text) in enumerate(docs):
        gone = {k for s, e in cuts[n] for k in range(s, e)}
        out[i, text] = "".join(c for k, c in enumerate(text) if k not in gone)
    return out


def test_units_by_hand():
    text = "One two three four five six. Seven eight nine ten eleven twelve!\nshort line\n  One  TWO three four five six.\nEnd. Of it all."
    units = unit_dedup.units_of(text)
    assert [text[s:e] for _, s, e in units] == [
        "One two three four five six. Seven eight nine ten eleven twelve!\n", "  One  TWO three four five six.\n", "End. Of it all.",
        "One two three four five six. ", "Seven eight nine ten eleven twelve!\n", "One  TWO three four five six.\n", "short line\n  One  TWO three four five six.\n",
    ]
    again = unit_dedup.units_of("x y z a b c d.  one TWO\tthree four five six.")
    assert again[-1][0] == units[3][0]  # case and spaces do not matter
    assert unit_dedup.units_of("") == unit_dedup.units_of(" \n\n ") == []


def test_units_query(spark, folder, rows, empty):
    got = unit_dedup.op10_substring_dedup(spark, folder).collect()
    unique = [r for r in rows if r[0] is not None and not (r[0] == 20 and r[1].startswith("same"))]
    want = plain_units(unique + [r for r in rows if r not in unique])
    for r in got:
        texts = [t for (i, t) in want if i == r.doc_id]
        assert r.kept_sha256 in {hashlib.sha256(want[r.doc_id, t].encode()).hexdigest() for t in texts} or r.doc_id is None
        cut = sum(int(b) - int(a) for a, b in (s.split("-") for s in r.removed_spans.split(" ") if s))
        assert cut == r.n_removed
    by_id = {r.doc_id: r for r in got}
    assert by_id[60].n_removed == 0 or by_id[60].n_removed < 300
    shared = [by_id[60 + i] for i in range(1, 6)]
    assert all(r.n_removed > 500 for r in shared)  # the passage is gone from all but the first
    assert all(by_id[i].n_removed == 0 for i in (1, 2, 3, 4, 5, 21, 22, 23))
    assert unit_dedup.op10_substring_dedup(spark, empty).count() == 0


def test_passage_behind_a_short_sentence_and_clashing_columns(spark):
    passage = "The first sentence of it has eight words. The second one has some words too, as many as that."
    rows = [(1, passage), (2, "Ti. " + passage), (3, "A line before.\nOh! " + passage + " More text of another document stands here.")]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d", 5) for i, t in rows], "doc_id long, text string, _kept string, _spans string, _text string, _raw string, _k1 int")
    got = {r.doc_id: r._kept for r in unit_dedup.dedup_units(docs).collect()}
    assert got[1] == passage and "sentence of it" not in got[2] + got[3] and "second one" not in got[2] + got[3]
    assert got[3].endswith("More text of another document stands here.")


def test_units_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = unit_dedup.stage(spark, docs, folder)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("(text IS NULL) != (n_chars IS NULL) OR length(text) != n_chars").count() == 0
