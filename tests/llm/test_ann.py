import numpy as np

from rasterspark.llm import ann


def exact(ids, vectors, k):
    out = {}
    for n, i in enumerate(ids):
        if i % 20:
            continue
        scores = vectors @ vectors[n]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
        out[i] = [(ids[j], scores[j]) for j in order]
    return out


def write(spark, at, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{at}/embeddings.parquet")


def test_recall_scores_and_order(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.3, 3, (1500, 1))
    x[700:900] = x[700]  # copies
    x = x.astype(np.float32).astype(float)
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(1500)]
    bad = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] + [1.0] * 15, 1), (2060, [None] + [1.0] * 15, 1), (2080, [1.0], 1), (2100, [], 1), (None, rows[0][1], 1)]
    write(spark, tmp_path, [*rows, *bad, rows[40]])
    got = ann.op5_ann(spark, str(tmp_path)).collect()
    want = exact(np.arange(1500), x, 20)
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9
    assert mine.keys() == want.keys()
    hits = [len({v for v, _ in mine[i]} & {v for v, _ in want[i]}) for i in want]
    assert sum(hits) / (20 * len(want)) > 0.9 and {len(v) for v in mine.values()} == {20}
    for i, found in mine.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and i not in [v for v, _ in found]
    # Among copies the smallest ids count.
    assert [v for v, _ in mine[720] if 700 <= v < 900] == [v for v, _ in want[720] if 700 <= v < 900]


def test_an_id_with_two_vectors_is_one_candidate(spark, tmp_path):
    write(spark, tmp_path, [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (20, [0.0, 3.0], 1), (3, [0.5, 2.0], 1)])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.op5_ann(spark, str(tmp_path)).collect()}
    assert got == {(0, 1): (20, 1.0), (0, 2): (3, 0.5), (20, 1): (3, 6.0), (20, 2): (0, 1.0)}


def test_few_rows_and_none(spark, tmp_path, empty):
    write(spark, tmp_path, [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [0.0, 2.0], 1)])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.op5_ann(spark, str(tmp_path)).collect()}
    assert got == {(0, 1): (20, 1.0), (0, 2): (3, 0.0), (20, 1): (0, 1.0), (20, 2): (3, 0.0)}
    assert ann.op5_ann(spark, empty).count() == 0


def test_abandoned_candidates_are_far():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    index = ann.Index(x, 400, float(np.linalg.norm(x, axis=1).max()))
    lists = index.rank(index.lift(x))[0].argmax(1)
    every = np.tile(np.arange(len(index.centroids)), (30, 1))
    found = ann.scan(index, x[:30], every, x, lists, 5)
    best = np.argsort(-(x[:30] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(at) & set(b)) / 5 for (at, _), b in zip(found, best)]) > 0.9
