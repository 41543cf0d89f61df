from collections import Counter, defaultdict

import corpus_pipeline
from llm_samples import SCHEMA
from test_bpe import _reference
from test_near_dup import near_groups
from test_simhash_units import plain_units

from rasterspark.llm import mixing, quality


def plain_order(sources):
    """(slot, epoch) of every block of each source, by walking the slots: of the sources that are released the earliest deadline."""
    names = sorted(sources, key=lambda s: (s is None, str(s)))
    weights = mixing.whole_weights({s: round(n**mixing.POWER * 1000) for s, n in sources.items()})
    whole = sum(weights.values())
    blocks = {s: -(-n // mixing.BLOCK_DOCS) for s, n in sources.items()}
    done, slots = dict.fromkeys(names, 0), []
    while any(done[s] < blocks[s] for s in names):
        ready = [s for s in names if done[s] * whole // weights[s] <= len(slots)]
        best = min(ready, key=lambda s: (-(-(done[s] + 1) * whole // weights[s]), names.index(s)))
        slots.append((best, done[best] % blocks[best], done[best] // blocks[best]))
        done[best] += 1
    return slots


def test_run_equals_brute_force(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = [r for r in rows if model.scores([(r[1] or "").encode()])[0] >= quality.THRESHOLD]
    part = near_groups([t or "" for _, t, *_ in good])
    best = {}
    for g, r in zip(part, good):
        if g not in best or (r[0] is None, r[0]) < (best[g][0] is None, best[g][0]):
            best[g] = r
    kept = plain_units(list(best.values()))
    ref = _reference()
    want = {(r[0], tuple(ref.encode_ordinary(kept[r[0], r[1] or ""]))) for r in best.values()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert 0 < len(want) < len(rows) and {(r.doc_id, tuple(r.ids)) for r in got} == want
    # Which of the rows with one doc_id and text stays is open, and so is its source.
    counts = Counter(s for _, s, _ in {(r.doc_id, r.source, tuple(r.ids)) for r in got})
    assert sum(counts.values()) == len(best)
    # Every slot has the block that a plain walk gives it, and every document of the block once.
    by_slot = defaultdict(list)
    for r in got:
        by_slot[r.slot].append(r)
    members = defaultdict(set)
    slots = plain_order(counts)
    assert sorted(by_slot) == list(range(len(slots)))
    for slot, (source, block, epoch) in enumerate(slots):
        assert {(r.source, r.epoch) for r in by_slot[slot]} == {(source, epoch)}
        assert sorted(r.place for r in by_slot[slot]) == list(range(len(by_slot[slot])))
        members[source, block].add(frozenset((r.doc_id, tuple(r.ids)) for r in by_slot[slot]))
    assert all(len(m) == 1 for m in members.values())


def test_stages_return_documents(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
