"""What the operators of this subpackage share: tables, written intermediates and Arrow row maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.session import ensure_checkpoint_dir

QueryFn = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.

    It cuts the lineage, survives lost executors and is compressed, which a
    checkpoint is not. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` returned, once everything made of it has been written too."""
    for df in tables:
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that name a document even where doc_id is null or repeated.

    Rows that agree in doc_id and text are one document to every operator.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)).cast("long")).alias("_k1"),
        F.xxhash64(text_or_empty(text)).alias("_k2"),
    ]


def map_rows(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict | None], rows: int = 2000, by: str | None = None) -> DataFrame:
    """``fn`` on slices of at most ``rows`` rows (and a few MB of column ``by``); it returns columns by name, or None for no row."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, by, rows) if by else (batch.slice(at, rows) for at in range(0, batch.num_rows, rows)):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_pydict({n: out[n] for n in names})

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, rows: int = 2000, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and about ``size`` bytes of ``column``; a longer value is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    start, before = 0, 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, before + size, side="right"))
        stop = min(max(stop, start + 1), start + rows)
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[min(stop, len(ends)) - 1])
