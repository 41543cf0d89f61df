"""GIF media columns (operator 3).

``read_gif`` decodes GIF87a and GIF89a: the LZW code streams, local and global
palettes, interlacing, transparency and the disposal of earlier frames. It gives
timed frames as composed RGB pictures with colour histograms. ``write_gif`` stores
rows of 8-bit samples as grey frames of 192 columns.

Codes are cut out of a stream all at once, because the width of a code depends
only on its place after the last clear code. The string of a code is a run of the
output already made: the string of an earlier code and the byte after it. So the
decoder keeps no string table.

Defined results: null text is an empty text; a null or damaged GIF gives no frames
and an ``error``; frames beyond the damage are left out; repeated rows give equal
values; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm.common import slices, table, text_or_empty

#: Columns of a stored frame and most rows of one; a longer payload takes more frames.
WIDTH = 192
ROWS = 256
DELAY = 4  # hundredths of a second that a stored frame is shown

_WIDEST = 12
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def _offsets(first_free: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code and the bits before each."""
    widths = np.minimum(np.frexp(np.arange(first_free - 1, first_free - 1 + count).astype(float))[1], _WIDEST)
    return widths, np.concatenate([[0], np.cumsum(widths)])


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of samples of ``bits`` bits, with a clear code whenever the table is full."""
    clear, free = 1 << bits, (1 << bits) + 2
    codes, cuts = [clear], [1]
    if data:
        add = codes.append
        seen: dict[int, int] = {}
        find, following = seen.get, free
        prefix = data[0]
        for byte in data[1:]:
            key = prefix << 8 | byte
            code = find(key)
            if code is None:
                add(prefix)
                if following < 1 << _WIDEST:
                    seen[key] = following
                    following += 1
                else:
                    add(clear)
                    seen.clear()
                    following = free
                    cuts.append(len(codes))
                prefix = byte
            else:
                prefix = code
        add(prefix)
    codes.append(clear + 1)
    lengths = np.diff([*cuts, len(codes)])
    widths = np.concatenate([[bits + 1], *[_offsets(free, n)[0] for n in lengths.tolist()]])
    values = np.array(codes, np.int32)
    planes = np.arange(_WIDEST)
    stream = ((values[:, None] >> planes) & 1).astype(np.uint8)[planes < widths[:, None]]
    return np.packbits(stream, bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """Up to ``most`` samples of a code stream; ValueError where it is damaged."""
    clear, free = 1 << bits, (1 << bits) + 2
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total, at = len(stream) * 8, 0
    out = bytearray()
    while at + bits + 1 <= total:
        count = 4096
        while True:  # all codes up to the next clear or end code
            widths, before = _offsets(free, count)
            fit = int(np.searchsorted(before, total - at, side="right")) - 1
            place = at + before[: min(fit, count)]
            byte = place >> 3
            codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7) & ((1 << widths[: len(place)]) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop) or fit <= count:
                break
            count *= 4
        end = int(stop[0]) if len(stop) else len(codes)
        starts: list[int] = []
        begin, n = starts.append, len(out)
        try:
            for code in codes[:end].tolist():
                begin(n)
                if code < clear:
                    out.append(code)
                    n += 1
                else:
                    p, e = starts[code - free], starts[code - free + 1] + 1
                    out += out[p:e]
                    if e > n:  # the code that is just being defined
                        out.append(out[p])
                    n = len(out)
        except IndexError:
            raise ValueError("a code that is not yet defined") from None
        if not len(stop) or codes[end] == clear + 1 or n >= most:
            break
        at += int(before[end + 1])
    return bytes(out[:most])


def write_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF of grey frames that hold ``payload``, whose length is a multiple of ``width``."""
    height = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), _GREY]
    for top in range(0, height, rows):
        part = payload[top * width : (top + rows) * width]
        # Disposal 2: the canvas is clear again before the next frame.
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 2 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        stream = lzw_encode(part)
        out += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


@dataclass
class Gif:
    width: int = 0
    height: int = 0
    frames: list[dict] = field(default_factory=list)
    error: str | None = None


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def _interlaced(rows: int) -> np.ndarray:
    """The picture row of each stored row."""
    return np.concatenate([np.arange(start, rows, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _decode(data: bytes, gif: Gif) -> None:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    gif.width, gif.height, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if packed & 0x80:
        n = 2 << (packed & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((gif.height, gif.width, 3), np.uint8)  # the background is black and shows nothing
    disposal, delay, clear_index = 0, 0, -1
    while (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label, at = data[at], at + 1
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 1)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else -1
            _, at = _blocks(data, at)
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        x, y, w, h, packed = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = shared
        if packed & 0x80:
            n = 2 << (packed & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8)
        if len(samples) < w * h or palette is None or (w * h and samples.max() >= len(palette)) or x + w > gif.width or y + h > gif.height:
            raise ValueError("a frame without all its samples, colours or place")
        picture = samples.reshape(h, w)
        if packed & 0x40:
            picture = picture[np.argsort(_interlaced(h), kind="stable")]
        earlier = canvas.copy() if disposal == 3 else None
        area = canvas[y : y + h, x : x + w]
        if clear_index < 0:
            area[...] = palette[picture]
        else:
            shown = picture != clear_index
            area[shown] = palette[picture[shown]]
        gif.frames.append({"delay_ms": delay * 10, "x": x, "y": y, "width": w, "height": h, "rgb": canvas.copy()})
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = earlier
        disposal, delay, clear_index = 0, 0, -1


def read_gif(data: bytes | None) -> Gif:
    """Composed frames of a GIF; ``error`` says what ended it early."""
    gif = Gif()
    try:
        _decode(data or b"", gif)
    except (ValueError, IndexError, struct.error) as problem:
        gif.error = str(problem) or "cut off"
    return gif


def histogram(rgb: np.ndarray, bins: int = 8) -> list[int]:
    """Counts of ``bins`` equal steps of red, then green, then blue."""
    flat = rgb.reshape(-1, 3)
    shift = 8 - bins.bit_length() + 1
    return np.concatenate([np.bincount(flat[:, c] >> shift, minlength=bins) for c in range(3)]).tolist()


def store_text(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the GIF of each text in ``media``: its UTF-8 bytes, padded with spaces to full rows."""
    docs = docs.drop(media).withColumn("_gif_text", text_or_empty(text).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_gif_text", 1000):
                files = [write_gif(raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")) for raw in part.column("_gif_text").to_pylist()]
                names = [n for n in part.schema.names if n != "_gif_text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(files, pa.binary())], [*names, media])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.drop("_gif_text").schema.fields)
    return docs.mapInArrow(run, fields + f"`{media}` binary")


FRAME = "struct<delay_ms:int,x:int,y:int,width:int,height:int,rgb:binary,histogram:array<int>>"


def gif_frames(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``frames`` (timed, composed, each with its colour histogram) and ``error`` in place of ``media``."""
    df = df.drop("frames", "error")
    kind = pa.list_(pa.struct([*((n, pa.int32()) for n in ("delay_ms", "x", "y", "width", "height")), ("rgb", pa.binary()), ("histogram", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media, 200):
                gifs = [read_gif(raw) for raw in part.column(media).to_pylist()]
                frames = [[{**f, "rgb": f["rgb"].tobytes(), "histogram": histogram(f["rgb"])} for f in g.frames] for g in gifs]
                names = [n for n in part.schema.names if n != media]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(frames, kind), pa.array([g.error for g in gifs], pa.string())], [*names, "frames", "error"]
                )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.drop(media).schema.fields)
    return df.mapInArrow(run, fields + f"frames array<{FRAME}>, error string")


def gif_samples(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what the frames of a grey GIF hold in ``payload``, and ``frames``, ``millis`` and ``histogram`` of the whole."""
    added = ("payload", "frames", "millis", "histogram")
    df = df.drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media, 1000):
                gifs = [read_gif(raw) for raw in part.column(media).to_pylist()]
                own = [[f["rgb"][f["y"] : f["y"] + f["height"], f["x"] : f["x"] + f["width"]] for f in g.frames] for g in gifs]
                payload = [b"".join(p[:, :, 0].tobytes() for p in pictures) for pictures in own]
                counts = [np.sum([histogram(p) for p in pictures] or [[0] * 24], axis=0).tolist() for pictures in own]
                arrays = [
                    pa.array(payload, pa.binary()), pa.array([len(g.frames) for g in gifs], pa.int32()),
                    pa.array([sum(f["delay_ms"] for f in g.frames) for g in gifs], pa.int64()), pa.array(counts, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *added])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
    return df.mapInArrow(run, fields + "payload binary, frames int, millis long, histogram array<bigint>")


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = store_text(docs).select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), "media")
    back = gif_samples(stored)
    grey = F.array_join(F.slice("histogram", 1, 8).cast("array<string>"), ",")
    return back.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), "frames", F.lit(";ms="), "millis", F.lit(";grey="), grey).alias("feature"),
    )
