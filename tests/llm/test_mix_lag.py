import random
from collections import Counter
from fractions import Fraction
from itertools import islice
from math import ceil, floor

from rasterspark.llm import mixing


def test_windows_of_target_weights_over_many_frames():
    """Nothing is rounded to slots of a frame, so the lag stays below one block for any number of slots."""
    rng = random.Random(4)
    for weights in ([700_000, *[90_007] * 18, 3], [10**12, 7, 1], [rng.randrange(1, 10**9) for _ in range(40)], [5, 5], [1]):
        total, seen = sum(weights), Counter()
        for slot, (i, number) in enumerate(islice(mixing.edf(weights), 40_000)):
            w = Fraction(weights[i], total)
            assert number == seen[i] and floor(number / w) <= slot < ceil((number + 1) / w)
            seen[i] += 1
            if slot % 977 == 0:
                assert all(abs(seen[k] - Fraction(weights[k] * (slot + 1), total)) < 1 for k in range(len(weights)))
    assert mixing.whole_weights({"a": 0.5, "b": 1, "c": Fraction(1, 3)}) == {"a": 3, "b": 6, "c": 2}


def test_mix_meets_a_very_small_weight(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "a" if i < 6000 else "b" if i < 6300 else "c") for i in range(6301)], "doc_id long, text string, source string")
    weights = {"a": 20_000, "b": 9_700, "c": 1}
    got = mixing.mix(docs, weights, block_docs=1).select("source", "slot").collect()
    horizon = 1 + max(r.slot for r in got)
    assert sorted(r.slot for r in got) == list(range(horizon)) and horizon > 8000
    taken = Counter(r.source for r in got)
    for s, w in weights.items():
        assert abs(taken[s] - Fraction(w * horizon, sum(weights.values()))) < 1
