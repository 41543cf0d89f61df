"""Hash-checked ledger against a plain program that keeps whole states."""

import random

from pyspark.sql import functions as F

from rasterspark.operators import ledger

COLS = ["y", "x", "cell_id"]


def test_proposals_against_whole_states(spark):
    rng = random.Random(3)
    pixels = [(y, x, c) for y in range(6) for x in range(6) for c in range(1, 4)]
    one = ledger.content_hash(spark.createDataFrame([(str(i), *p) for i, p in enumerate(pixels)], "field_id string, y int, x int, cell_id int"), COLS)
    lane = {pixels[int(r.field_id)]: (r.c1, r.c2) for r in one.collect()}

    def hashed(state):
        a = b = 0
        for p in state:
            a, b = a ^ lane[p][0], b ^ lane[p][1]
        return a, b

    rows, initial, want, last = [], [], {}, {}
    for f in range(40):
        state = frozenset(rng.sample(pixels, 30))
        version, undo = rng.randrange(3), []
        initial.append((f"f{f}", version, *hashed(state)))
        seen = [state]
        for k in range(30):
            if rng.random() < 0.25:
                rows.append((f"f{f}", k, "revert", *[None] * 8))
                if not undo:
                    status = "nothing_to_revert"
                elif undo[-1][:2] != (version, state):
                    status = "changed_since_commit"
                else:
                    status, state, version = "reverted", undo.pop()[2], version + 1
            else:
                base = rng.choice(seen) if rng.random() < 0.2 else state
                result = frozenset(base ^ set(rng.sample(pixels, 3)))
                delta, promised = hashed(base ^ result), hashed(result)
                v, n = version - (rng.random() < 0.1), version + 1 + (rng.random() < 0.1)
                if rng.random() < 0.1:
                    promised = (promised[0] ^ 5, promised[1])
                rows.append((f"f{f}", k, "commit", v, *hashed(base), n, *promised, *delta))
                if v != version:
                    status = "stale_version"
                elif base != state:
                    status = "foreign_content"
                elif n != version + 1:
                    status = "wrong_revision"
                elif promised != hashed(result):
                    status = "tampered_result"
                else:
                    undo.append((n, result, state))
                    status, state, version = "committed", result, n
            seen.append(state)
            want[f"f{f}", k] = (status, version, *hashed(state), len(undo))
        last[f"f{f}"] = state
    schema = "field_id string, sequence long, action string, " + ", ".join(f"{c} long" for c in ledger.PROPOSAL)
    got = ledger.accept_proposals(spark.createDataFrame(rows, schema).repartition(7), spark.createDataFrame(initial, "field_id string, version long, c1 long, c2 long")).collect()
    assert {(r.field_id, r.sequence): (r.status, r.version, r.c1, r.c2, r.depth) for r in got} == want
    assert {w[0] for w in want.values()} == {"committed", "reverted", "nothing_to_revert", "changed_since_commit", "stale_version", "foreign_content", "wrong_revision", "tampered_result"}
    # The chained hash is the hash of the rows that are there at the end.
    final = ledger.content_hash(spark.createDataFrame([(f, *p) for f, s in last.items() for p in s], "field_id string, y int, x int, cell_id int"), COLS)
    assert {r.field_id: (r.c1, r.c2) for r in final.collect()} == {f: want[f, 29][2:4] for f in last}


def test_delta_updates_the_hash(spark):
    before = spark.range(50).select(F.lit("f").alias("field_id"), (F.col("id") % 7).cast("int").alias("y"), F.col("id").cast("int").alias("x"), F.when(F.col("id") % 5 > 0, 1).alias("cell_id"))
    after = before.where("x % 3 > 0").withColumn("cell_id", F.when(F.col("x") < 20, 2).otherwise(F.col("cell_id")))
    a, b, d = (df.first() for df in (ledger.content_hash(before, COLS), ledger.content_hash(after, COLS), ledger.content_delta(before, after, COLS)))
    assert (a.c1 ^ d.c1, a.c2 ^ d.c2) == (b.c1, b.c2) and (a.c1, a.c2) != (b.c1, b.c2)
    assert ledger.content_delta(before, before, COLS).count() == 0
