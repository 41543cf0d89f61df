"""A fingerprint group of several blocks is compared as a whole, also where no band of minimal hashes meets."""

from __future__ import annotations

from llm_samples import SCHEMA
from pyspark.sql import functions as F

from rasterspark.llm import minhash, simhash
from rasterspark.llm.common import written


def test_blocks_of_a_group_meet(spark):
    texts = []
    for pair in range(20):
        words = [f"w{pair}x{i}" for i in range(120)]
        texts += [" ".join(words), " ".join([*words[:60], "other", *words[61:]])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in enumerate(texts)], SCHEMA)
    apart = F.transform(F.sequence(F.lit(0), F.lit(minhash.BANDS - 1)), lambda i: F.xxhash64("_set", i))
    rows = written(minhash.sketches(docs, simhash.majority).withColumn("_bands", apart))
    one = lambda prints: prints.select("fp", F.lit(1).cast("long").alias("root")).distinct()
    got = minhash.components(rows, docs, one, block=1).join(rows.select("_set", "doc_id"), "_set").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == [[2 * i, 2 * i + 1] for i in range(20)]
