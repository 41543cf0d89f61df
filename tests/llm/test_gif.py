import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from rasterspark.llm import gif


def plain_lzw(stream, bits):
    """Textbook decoder with a string table."""
    clear, table, prev, out, width, at = 1 << bits, None, None, bytearray(), bits + 1, 0
    value = int.from_bytes(stream, "little")
    while at + width <= 8 * len(stream):
        code = value >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, prev, width = [bytes([i]) for i in range(clear)] + [b"", b""], None, bits + 1
            continue
        if code == clear + 1:
            break
        if table is None:
            table = [bytes([i]) for i in range(clear)] + [b"", b""]
        if prev is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else table[prev] + table[prev][:1]
            if len(table) < 4096:
                table.append(table[prev] + word[:1])
        out += word
        if len(table) >= 1 << width and width < 12:
            width += 1
        prev = code
    return bytes(out)


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_lzw_round_trip_and_textbook(bits):
    rng = random.Random(bits)
    for size in (0, 1, 2, 500, 60_000):
        for data in (bytes(rng.randrange(1 << bits) for _ in range(size)), bytes(size), bytes((i // 7) % (1 << bits) for i in range(size))):
            stream = gif.lzw_encode(data, bits)
            assert plain_lzw(stream, bits) == data
            assert gif.lzw_decode(stream, bits, size) == data


def test_stored_payload_comes_back():
    rng = random.Random(4)
    for rows in (1, 2, 255, 256, 257, 700):
        payload = bytes(rng.choice(b"abc \n\xff") for _ in range(rows * gif.WIDTH))
        got = gif.read_gif(gif.write_gif(payload))
        assert got.error is None and len(got.frames) == -(-rows // gif.ROWS)
        assert b"".join(f["rgb"][: f["height"], :, 0].tobytes() for f in got.frames) == payload
        assert all(sum(gif.histogram(f["rgb"])) == 3 * f["rgb"].shape[0] * gif.WIDTH for f in got.frames)


def frame(x, y, w, h, samples, disposal=0, clear=None, delay=5, local=None, interlace=False):
    out = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0)
    out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, (0x80 | 1 if local else 0) | (0x40 if interlace else 0)) + (local or b"")
    stream = gif.lzw_encode(bytes(samples), 2)
    return out + b"\x02" + bytes([len(stream)]) + stream + b"\0"


def test_palettes_disposal_transparency_and_interlace():
    shared = bytes([10, 0, 0, 20, 0, 0, 30, 0, 0, 40, 0, 0])
    local = bytes([0, 1, 0, 0, 2, 0, 0, 3, 0, 0, 4, 0])
    head = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x81, 0, 0) + shared
    body = frame(0, 0, 3, 2, [0, 1, 2, 3, 0, 1], disposal=1)
    body += b"\x21\xfe\x03abc\0"  # a comment
    body += frame(1, 0, 2, 1, [3, 3], disposal=3, clear=3, delay=7)
    body += frame(0, 1, 2, 1, [1, 2], disposal=2, local=local)
    body += frame(2, 0, 1, 2, [0, 1], disposal=3)
    body += frame(2, 0, 1, 1, [2])
    got = gif.read_gif(head + body + b"\x3b")
    assert got.error is None
    assert [f["delay_ms"] for f in got.frames] == [50, 70, 50, 50, 50]
    red = [f["rgb"][:, :, 0].tolist() for f in got.frames]
    first = [[10, 20, 30], [40, 10, 20]]
    assert red[0] == first and red[1] == first  # all of the second frame is transparent
    assert got.frames[2]["rgb"][1].tolist() == [[0, 2, 0], [0, 3, 0], [20, 0, 0]]
    assert red[3] == [[10, 20, 10], [0, 0, 20]]  # the third was cleared
    assert red[4] == [[10, 20, 30], [0, 0, 20]]  # the fourth was taken back
    tall = b"GIF89a" + struct.pack("<HHBBB", 1, 9, 0x81, 0, 0) + shared + frame(0, 0, 1, 9, [0, 0, 1, 2, 2, 3, 3, 3, 3], interlace=True) + b"\x3b"
    assert gif.read_gif(tall).frames[0]["rgb"][:, 0, 0].tolist() == [10, 40, 30, 40, 20, 40, 30, 40, 10]


def test_damage_is_reported():
    whole = gif.write_gif(bytes(range(192)) * 300)
    assert gif.read_gif(None).error and gif.read_gif(b"no gif").error
    short = gif.read_gif(whole[: len(whole) // 2])
    assert short.error and len(short.frames) < 2
    with pytest.raises(ValueError):
        gif.lzw_decode(b"\xff\xff\xff\xff", 8, 100)


def test_frames_as_columns(spark):
    df = spark.createDataFrame([(1, bytearray(gif.write_gif(b"ab" * 96 * 2))), (2, None)], "frames long, media binary")
    out = {bool(r.error): r for r in gif.gif_frames(df.withColumnRenamed("frames", "id")).collect()}
    assert len(out[False].frames) == 1 and out[True].frames == []
    one = out[False].frames[0]
    assert (one.delay_ms, one.width, one.height) == (40, 192, 2) and sum(one.histogram) == 3 * 384
    assert np.frombuffer(one.rgb, np.uint8)[::3].tobytes() == b"ab" * 192


def test_query(spark, folder, rows, empty):
    got = gif.op3_gif(spark, folder).collect()
    want = Counter()
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert gif.op3_gif(spark, empty).count() == 0
