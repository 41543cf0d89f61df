import random
import re
import zlib
from collections import Counter

import duckdb
from rasterspark.llm import spelling as sp

LOW = str.maketrans(sp._UPPER, sp._LOWER)


def plain_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, times=10):
    near = {w: [o for o in counts if o != w and plain_near(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def plain_counts(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def documents(rng, rows=150):
    """Words of which some are frequent and many are one or two edits away from each other."""
    words = ["".join(rng.choice("abcdeé÷") for _ in range(rng.randrange(6, 11))) for _ in range(30)]
    many = []
    for w in words:
        many += [w] * rng.choice([1, 20, 60, 300])
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(w))
            many += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]])] * rng.randrange(1, 4)
    out = [(None, "Nothing happens twice Nothing happens Ünïcödé ünïcÖdé"), (7, None), (8, ""), (9, "aaaaaaaa" * 400 + " " + "aaaaaaaa" * 400), (9, "aaaaaaaa" * 400 + "b "), (10, "aaaaaaaa" * 400 + "b")]
    return out + [(20 + i, rng.choice([" ", ", ", "\n"]).join(rng.choice([w, w.title()]) for w in rng.choices(many, k=60))) for i in range(rows)]


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rows = documents(random.Random(4))
    spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, sp.op12_spelling_variants(spark, str(tmp_path)).collect()))
    want = plain_variants(plain_counts(rows))
    assert got == want and sum(r[1] is not None for r in got) > 5
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(sp.ORACLE).fetchall()) == want


def test_pairs_of_hot_chunks(spark):
    """Many words with one half in common are cut again; the pairs are the same."""
    rng = random.Random(6)
    words = {"sevenletters" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(500)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))) + "oftheothers" for _ in range(60)}
    words |= {"q" * n for n in range(7, 40)} | {"a" * 500 + c + "a" * 500 for c in "bcdefghijklmnop"}
    words = sorted(words)
    table = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if plain_near(a, b)}
    for group in (sp.GROUP, 20):
        got = [tuple(r) for r in sp.near_pairs(table, group).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_ways_to_the_root(spark):
    counts = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefghijk": 9999, "zbcdefghijk": 9999, "lonelyword": 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, sp.variants(table).collect())) == plain_variants(counts)


def test_empty_table(spark, empty):
    assert sp.op12_spelling_variants(spark, empty).count() == 0
