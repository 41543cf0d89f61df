import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from collections import Counter

from rasterspark.llm import bpe


def _split(encoded):
    flat, sizes = encoded
    out, at = [], 0
    for n in sizes.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def _reference():
    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library_on_odd_texts():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "é", "ß", "1", "23", "!", "\x1c", "中文", "🙂", "aaaa", "the", " \n", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["", "a" * 5000, " " * 3000, "ab" * 4000, "".join(rng.choice("abcde") for _ in range(8000))]
    own = bpe.Encoder(bpe.encoder(bpe.default_ranks(), public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    ref = _reference()
    want = [ref.encode_ordinary(t) for t in texts]
    assert _split(own.encode_texts(texts)) == want
    assert _split(own.encode_texts(texts)) == want  # now with remembered words


def test_ranks_that_no_training_made():
    rng = random.Random(2)
    for _ in range(4):
        tokens = [bytes([i]) for i in range(256)]
        tokens += [t for t in {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 5))) for _ in range(50)}]
        longer = tokens[256:]
        rng.shuffle(longer)
        ranks = {t: i for i, t in enumerate([*tokens[:256], *longer])}
        own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
        ref = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(800)]
        want = [ref.encode_ordinary(p) for p in pieces]
        assert _split(own.encode_pieces([p.encode() for p in pieces])) == want
        assert [own.encode_one(p.encode()) for p in pieces] == want


def test_queue_finds_the_lowest_rank():
    rng = random.Random(3)
    queue, held = bpe.BitmapQueue(), set()
    for _ in range(2000):
        if held and rng.random() < 0.5:
            low = queue.first()
            assert low == min(held)
            queue.take(low)
            held.discard(low)
        else:
            rank = rng.choice([rng.randrange(64**3), rng.randrange(100)])
            queue.add(rank, 0)
            held.add(rank)
    while held:
        held.discard(queue.take(low := queue.first()) and low)
    assert queue.first() == -1


def test_query(spark, folder, rows, empty):
    ref = _reference()
    want = []
    for i, text, *_ in rows:
        ids = ref.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert Counter(map(tuple, bpe.op2_bpe(spark, folder).collect())) == Counter(want)
    assert bpe.op2_bpe(spark, empty).count() == 0


def test_columns_stay_and_names_may_clash(spark):
    df = spark.createDataFrame([(1, "hello hello", [7]), (2, None, None)], "ids long, text string, decoded array<int>")
    coded = bpe.decode(bpe.encode(df))
    assert coded.columns == ["text", "ids", "decoded"]
    assert [bytes(r.decoded) for r in coded.collect()] == [b"hello hello", b""]
