"""Substring dedup by unit hashing (operator 10).

A text is cut into lines, and once more into sentences. Both kinds of unit are
normalised (lower case, white space collapsed) and hashed to 128 bits. Digests
are grouped over the whole corpus; the earliest occurrence in the order
(doc_id, offset) stays, every other one is cut out, and its original offsets
are kept. A sentence is a unit of its own because shared passages are often
pasted into the middle of a line.

Defined results: null text is an empty text; rows that agree in doc_id and text
are one document and are edited alike; a null doc_id ranks first; units with
fewer words than the minimum always stay; very long texts are cut in slices of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm.common import map_rows, slices, table, text_key, text_or_empty, written

#: Words that a repeated line, or a repeated unit of sentences, needs before it is cut.
LINE_WORDS = 4
SENTENCE_WORDS = 6

_LINE = re.compile(r"[^\n]+\n?")
_SENTENCE = re.compile(r"[^\n]*?[.!?]+\s+|[^\n]*\n\s*|[^\n]+")


def _digest(kind: bytes, words: list[str]) -> bytes:
    return hashlib.blake2b(kind + " ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def units_of(text: str, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> list[tuple[bytes, int, int]]:
    """(digest, start, end) of every unit that is long enough; offsets are characters.

    Short sentences go together with those after them until the unit is long
    enough, so that none inside a shared passage is left over. A sentence that is long
    enough is a unit of its own as well, so that a short one before a shared passage
    doesn't hide the passage's first sentence.
    """
    out = []
    for line in _LINE.finditer(text):
        words = line.group().lower().split()
        if len(words) >= line_words:
            out.append((_digest(b"l", words), line.start(), line.end()))
    start, held = 0, []
    for part in _SENTENCE.finditer(text):
        words = part.group().lower().split()
        if held and len(words) >= sentence_words:
            out.append((_digest(b"s", words), part.start(), part.end()))
        held += words
        if not held:
            start = part.end()
        elif len(held) >= sentence_words:
            out.append((_digest(b"s", held), start, part.end()))
            start, held = part.end(), []
    return out


def _unit_rows(batch: pa.RecordBatch) -> dict | None:
    digests, spans, owner = [], [], []
    for i, text in enumerate(batch.column("_text").to_pylist()):
        found = units_of(text)
        digests += [d for d, _, _ in found]
        spans += [(s << 32) | (e - s) for _, s, e in found]
        owner += [i] * len(found)
    if not spans:
        return None
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    take = pa.array(owner, pa.int64())
    return {"_d1": pa.array(halves[:, 0]), "_d2": pa.array(halves[:, 1]), "_k1": batch.column("_k1").take(take), "_k2": batch.column("_k2").take(take), "_span": pa.array(spans, pa.int64())}


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(_k1, _k2, _spans): the units of each document that occur earlier; one packed start and length each.

    Only documents with such units appear. One document's spans are the only list
    that is gathered, so it is bounded by the document itself.
    """
    units = map_rows(docs.select(*text_key(), text_or_empty().alias("_text")), "_d1 long, _d2 long, _k1 long, _k2 long, _span long", _unit_rows, by="_text")
    units = written(units)
    first = units.groupBy("_d1", "_d2").agg(F.min(F.struct("_k1", "_k2", "_span")).alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    # Both sides are tables when they are joined, so a digest with very many occurrences can be split between tasks.
    again = units.join(written(first), ["_d1", "_d2"]).where(F.struct("_k1", "_k2", "_span") != F.col("_first"))
    return again.groupBy("_k1", "_k2").agg(F.collect_set("_span").alias("_spans"))


def _cut(batch: pa.RecordBatch) -> dict:
    texts, removed = [], []
    for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
        runs: list[list[int]] = []
        for packed in sorted(spans or ()):
            start, end = packed >> 32, (packed >> 32) + (packed & 0xFFFFFFFF)
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([start, end])
        at, kept = 0, []
        for start, end in runs:
            kept.append(text[at:start])
            at = end
        kept.append(text[at:])
        texts.append("".join(kept))
        removed.append([{"start": s, "end": e} for s, e in runs])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    # A null text without cuts stays null.
    texts = [None if raw is None else t for raw, t in zip(batch.column("_raw").to_pylist(), texts)]
    return {**{n: batch.column(n) for n in batch.schema.names}, "_kept": pa.array(texts, pa.string()), "_removed": pa.array(removed, kind)}


def dedup_units(docs: DataFrame) -> DataFrame:
    """The documents with ``_kept`` (text after the cuts) and ``_removed`` (original offsets) added (or replaced).

    Columns of the input named _k1, _k2, _spans, _text or _raw are dropped.
    """
    docs = docs.drop("_k1", "_k2", "_spans", "_text", "_raw", "_kept", "_removed")
    spans = repeated_spans(docs)
    k1, k2 = text_key()
    marked = docs.withColumns({"_k1": k1, "_k2": k2}).join(spans, ["_k1", "_k2"], "left")
    marked = marked.withColumns({"_text": text_or_empty(), "_raw": F.col("text").cast("string")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields) + ", _kept string, _removed array<struct<start:int,end:int>>"
    names = [*marked.columns, "_kept", "_removed"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                out = _cut(part)
                yield pa.RecordBatch.from_pydict({n: out[n] for n in names})

    return marked.mapInArrow(run, schema).drop("_k1", "_k2", "_spans", "_text", "_raw")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with repeated units cut out; n_chars follows the text."""
    out = dedup_units(docs).withColumn("text", F.col("_kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("_kept").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed (characters), n_spans, removed_spans (start-end pairs), kept_sha256."""
    out = dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = F.transform("_removed", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string")))
    return out.select(
        "doc_id",
        F.aggregate("_removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_removed"),
        F.size("_removed").cast("long").alias("n_spans"),
        F.array_join(span, " ").alias("removed_spans"),
        F.sha2(F.coalesce("_kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
