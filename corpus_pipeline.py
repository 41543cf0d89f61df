"""A training corpus from raw documents: five stages, each one operator of rasterspark.llm.

Every stage takes (spark, docs, sf_dir), reads what its predecessor kept, and returns
documents again; the last one returns token ids with the slot, epoch and place of the mixed
order. Between the stages the documents are written as Parquet and read back.

The near-dup stage links documents from four fifths of their five-word shingles on: the
components of their fingerprints are verified first, what three bits can't reach is proposed
by minimal hashes.

Defined results: null text is an empty text and is judged, compared and encoded like one; of
near copies the smallest doc_id stays (null last), and of rows that agree in doc_id and text
one; a null source is a source of its own; further columns of documents pass through until
the last stage; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterspark.llm import bpe, mixing, quality, simhash, unit_dedup
from rasterspark.llm.common import table, written

STAGES = [
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("substring dedup", unit_dedup.stage),
    ("mixing sources", mixing.stage),
    ("byte-level bpe", bpe.stage),
]

#: A fitted network, fingerprints and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
