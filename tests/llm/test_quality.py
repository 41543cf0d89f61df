import random

import numpy as np
from llm_samples import prose

from rasterspark.llm import quality


def test_gradients_match_differences():
    net = quality.ByteConvNet(seed=1, width=3, filters=5, hidden=4)
    net.w = {n: v.astype(np.float64) for n, v in net.w.items()}
    texts = [b"hello world " * 30, b"", b"abc" * 200]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.forward(texts)["logit"]
        return float((np.log1p(np.exp(-p)) * labels + np.log1p(np.exp(p)) * (1 - labels)).sum())

    f = net.forward(texts)
    grads = net.gradients(f, 1 / (1 + np.exp(-f["logit"])) - labels)
    rng = np.random.default_rng(0)
    for name, value in net.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "embed":
                at = (int(rng.choice([ord("h"), ord("a"), 256])), at[1])
            old, step = value[at], 1e-6
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at])), (name, at)


def test_every_part_of_a_long_text_counts():
    net = quality.ByteConvNet(seed=2)
    whole = net.scores([b"x" * 700_000])[0]
    for place in (0, 262_100, 350_000, 699_990):
        text = bytearray(b"x" * 700_000)
        text[place : place + 8] = b"\x01\x02QZ\xff&%!"
        assert net.scores([bytes(text)])[0] != whole
    segments = net.scores([b"x" * 700_000, b"", b"y"])
    assert segments[0] == whole and len(segments) == 3


def test_learns_and_keeps_good_texts(spark, tmp_path, empty):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(240):
        bad = i % 6 == 0
        text = prose(rng, 60)
        if bad:
            text = " | ".join(text.split(" ")) if i % 12 else " ".join(w + "###" for w in text.split(" "))
        rows.append((i, text))
        marks.append((i, 0 if bad else 1, 0))
    rows += [(None, None), (900, ""), (901, "z"), (0, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op1_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 25 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert quality.op1_quality(spark, empty).count() == 0


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, None, "t")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert isinstance(model, quality.Constant)
    out = quality.score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and [r.score for r in out.collect()] == [model.share] * 2
