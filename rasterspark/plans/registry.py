"""Named queries with their independent SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query over the driver tables, with optional oracle SQL."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(c: str | Column, digits: int = 6) -> Column:
    """Display rounding; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r6(n, digits) for n in names})


def joined(df: DataFrame, *names: str) -> DataFrame:
    """Show array columns as comma-separated text."""
    return df.withColumns({n: F.array_join(n, ",") for n in names})


# Shared WITH fragments, written against the driver tables only.
CTE = {
    "dense": """dense AS (SELECT CAST(vec_id // 50 AS VARCHAR) AS field_id, CAST(vec_id % 50 AS INTEGER) AS y,
  CAST(i AS INTEGER) AS x, CAST(embedding[i+1] AS DOUBLE) AS value, 50 AS height, 64 AS width
  FROM embeddings, (SELECT unnest(range(64)) AS i))""",
    "mosaic": """mosaic AS (SELECT 'all' AS field_id, CAST(vec_id AS INTEGER) AS y, CAST(i AS INTEGER) AS x,
  CAST(embedding[i+1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(64)) AS i))""",
    "dense2": """dense2 AS (SELECT field_id, 'eGFP' AS channel, y, x, value, height, width FROM dense
  UNION ALL SELECT field_id, 'GFAP', y, 63 - x, value, height, width FROM dense)""",
    "stack": """stack AS (SELECT CAST(vec_id // 25 AS VARCHAR) AS field_id, 'target' AS channel, CAST(vec_id % 25 AS INTEGER) AS z,
  CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i+1] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(64)) AS i))""",
    "sparse": """sparse AS (SELECT CAST(l_suppkey AS VARCHAR) AS field_id,
  CASE l_returnflag WHEN 'A' THEN 'DAPI' WHEN 'N' THEN 'eGFP' ELSE 'GFAP' END AS channel,
  CAST(l_linenumber - 1 AS INTEGER) AS z, CAST(l_partkey % 32 AS INTEGER) AS y, CAST(l_orderkey % 32 AS INTEGER) AS x,
  max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5)""",
    "cells": """cells AS (SELECT field_id, CAST(i // 32 AS INTEGER) AS y, CAST(i % 32 AS INTEGER) AS x,
  CAST(((i // 32) // 8) * 4 + (i % 32) // 8 + 1 AS BIGINT) AS cell_id,
  CASE WHEN ((i // 32) % 8) BETWEEN 2 AND 5 AND ((i % 32) % 8) BETWEEN 2 AND 5 THEN 'soma' ELSE 'processes' END AS part
  FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS field_id FROM lineitem), (SELECT unnest(range(1024)) AS i))""",
    "objects": """objects AS (SELECT CAST(p_partkey // 25 AS VARCHAR) AS field_id, p_partkey AS object_id,
  p_partkey % 5 AS component_2d, CAST(p_partkey * 7 % 20 AS INTEGER) AS z_min,
  CAST(p_partkey * 7 % 20 + p_size % 5 AS INTEGER) AS z_max, CAST(p_partkey * 7 % 20 + (p_size % 5) / 2 AS DOUBLE) AS center_z,
  CAST(p_partkey * 13 % 50 AS DOUBLE) AS center_y, CAST(p_partkey * 29 % 64 AS DOUBLE) AS center_x,
  CAST(p_size AS DOUBLE) AS volume_um3, CAST(trunc(p_retailprice) AS BIGINT) % 3 = 0 AS accepted,
  (p_partkey * 11 % 100) / 100 AS enclosure FROM part)""",
    "ledger": """ledger AS (SELECT CAST(user_id AS VARCHAR) AS field_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
  event_type, event_id % 64 AS target_id, ts, event_id, value FROM events)""",
    "files": """files AS (SELECT '/data/' || o_custkey || '/S' || o_orderkey || '_' ||
  CASE WHEN o_orderstatus = 'P' THEN 'overview'
       WHEN o_orderpriority LIKE '1%' THEN ['DAPI','eGFP','GFAP','KCNN1','SK2','kcnn3','Kir4.1'][o_orderkey % 7 + 1] || '-gfap'
       ELSE ['DAPI','eGFP','GFAP','KCNN1','SK2','kcnn3','Kir4.1'][o_orderkey % 7 + 1] END ||
  CASE WHEN o_orderpriority LIKE '2%' THEN '_mature' WHEN o_orderpriority LIKE '3%' THEN '_NEONATAL' ELSE '' END ||
  CASE WHEN o_orderkey % 2 = 0 THEN '.tif' ELSE '.TIFF' END AS path,
  CAST(trunc(o_totalprice) AS BIGINT) AS length, o_orderdate AS modificationTime FROM orders)""",
    # Depth windows of a 25-plane stack at 1 um: ten intervals, five starts 5..9.
    "wins": """wins AS (SELECT DISTINCT CAST(vec_id // 25 AS VARCHAR) AS field_id, p + 1 AS position, 5 + p AS z0, 15 + p AS z1
  FROM embeddings, (SELECT unnest(range(5)) AS p))""",
    "proj": """proj AS (SELECT s.field_id, w.position, s.y, s.x, max(s.value) AS value
  FROM stack s JOIN wins w ON s.field_id = w.field_id AND s.z BETWEEN w.z0 AND w.z1 GROUP BY ALL)""",
}


def with_ctes(*names: str, extra: str = "") -> str:
    """``WITH a AS (...), b AS (...)`` from the shared fragments."""
    parts = [CTE[n] for n in names]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
