"""Queries of the streaming operators: drained streams and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterspark.plans.registry import query, rounded
from rasterspark.plans.zonal_queries import byte_planes, run_events
from rasterspark.sources import adapters as src
from rasterspark.streaming import events as ev


def event_stream(spark, d):
    """The events table as a file stream of run events (sequence = event id)."""
    raw = spark.readStream.schema(src.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("progress")
    return raw.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("timestamp"),
        kind.alias("type"), F.col("event_type").alias("stage"), (F.col("event_id") % 90).cast("int").alias("current"), F.lit(90).alias("total"))


@query("j01_ordered_events", """SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS sequence, event_type AS stage FROM events""")
def j01(spark, d):
    s = event_stream(spark, d)
    # Every event arrives twice; the duplicate must vanish.
    twice = s.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(2)))).drop("_c")
    return ev.run_to_table(ev.ordered_events(twice, "40 days")).select("run_id", "sequence", "stage")


_TYPE = "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'completed' ELSE 'progress' END"
_LATCH = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS sequence, {_TYPE} AS type FROM events),
t AS (SELECT *, min(sequence) FILTER (WHERE type <> 'progress') OVER (PARTITION BY run_id) AS t FROM e)
SELECT run_id, sequence, type FROM t WHERE t IS NULL OR sequence <= t"""


@query("j02_terminal_latch", _LATCH)
def j02(spark, d):
    e = run_events(spark, d).join(src.table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("timestamp")), ["run_id", "timestamp"])
    return ev.terminal_latch(e.withColumn("sequence", F.col("event_id"))).select("run_id", "sequence", "type")


@query("j02_stream_terminal_latch", _LATCH)
def j02s(spark, d):
    return ev.run_to_table(ev.stream_terminal_latch(event_stream(spark, d))).select("run_id", "sequence", "type")


@query("j03_stage_progress", """WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, CAST(user_id AS VARCHAR) AS run_id, event_type AS stage, event_id, ts FROM events)
SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, run_id, stage, count(*) AS events, CAST(arg_max(event_id, event_id) % 90 AS INT) AS current, 90 AS total FROM e GROUP BY ALL""")
def j03(spark, d):
    e = run_events(spark, d).withColumnRenamed("sequence", "_s").join(
        src.table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("timestamp")), ["run_id", "timestamp"])
    return ev.stage_progress(e, "1 day").withColumn("window_start", F.unix_timestamp("window_start"))


@query("j03_completed_progress", """SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS stage, count(DISTINCT event_id % 90) AS completed, 90 AS total FROM events GROUP BY 1, 2""")
def j03c(spark, d):
    return ev.completed_progress(run_events(spark, d))


@query("j04_run_sessions", """WITH g AS (SELECT CAST(user_id AS VARCHAR) AS run_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY ts) AS i FROM g)
SELECT run_id, count(*) AS events, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) + 0.0 AS seconds FROM s GROUP BY run_id, i""")
def j04(spark, d):
    return rounded(ev.run_sessions(run_events(spark, d), "6 hours"), "seconds", digits=3).select("run_id", "events", "seconds")


@query("j05_stream_edits", """WITH ac AS (SELECT CAST(user_id AS VARCHAR) AS field_id, event_id AS sequence, CASE WHEN event_type = 'error' THEN 'revert' ELSE event_type END AS action FROM events),
sm AS (SELECT *, sum(CASE WHEN action = 'revert' THEN -1 ELSE 1 END) OVER (PARTITION BY field_id ORDER BY sequence) AS s FROM ac),
mn AS (SELECT *, least(0, min(s) OVER (PARTITION BY field_id ORDER BY sequence)) AS m FROM sm),
dp AS (SELECT *, s - m AS depth, action = 'revert' AND s = m AND m < coalesce(lag(m) OVER (PARTITION BY field_id ORDER BY sequence), 0) AS refused FROM mn)
SELECT r.field_id, r.sequence, any_value(r.action) AS action, CASE WHEN any_value(r.refused) THEN 'nothing_to_revert' ELSE 'accepted' END AS status,
  max(c.sequence) FILTER (WHERE r.action = 'revert' AND NOT r.refused) AS reverts_sequence
FROM dp r LEFT JOIN dp c ON c.field_id = r.field_id AND c.sequence < r.sequence AND c.action <> 'revert' AND c.depth = r.depth + 1 GROUP BY 1, 2""")
def j05(spark, d):
    raw = spark.readStream.schema(src.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    e = raw.select(F.col("user_id").cast("string").alias("field_id"), F.col("event_id").alias("sequence"),
                   F.when(F.col("event_type") == "error", "revert").otherwise(F.col("event_type")).alias("action"), F.lit(None).cast("long").alias("base_version"))
    return ev.run_to_table(ev.stream_edits(e)).select("field_id", "sequence", "action", "status", "reverts_sequence")


@query("j06_plane_arrivals", """WITH p AS (SELECT CAST(vec_id // 25 AS VARCHAR) AS field_id, vec_id % 25 AS z FROM embeddings WHERE vec_id % 7 > 0),
w AS (SELECT DISTINCT CAST(vec_id // 25 AS VARCHAR) AS field_id, CAST(p + 1 AS INT) AS position, 5 + p AS z0, 15 + p AS z1 FROM embeddings, (SELECT unnest(range(5)) AS p))
SELECT w.field_id, position, 11 AS window_slices, count(p.z) AS arrived, count(p.z) = 11 AS complete FROM w LEFT JOIN p ON p.field_id = w.field_id AND p.z BETWEEN z0 AND z1 GROUP BY 1, 2""")
def j06(spark, d):
    from rasterspark.operators.zonal import plane_stats
    from rasterspark.plans.depth_queries import windows

    p = byte_planes(spark, d).where((F.col("field_id").cast("int") * 25 + F.col("z")) % 7 > 0)
    return ev.plane_arrivals(plane_stats(p), windows(spark, d))


@query("j07_run_outcome", """WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, CASE o_orderpriority[1] WHEN '1' THEN 'committed' WHEN '2' THEN 'cancelled' WHEN '3' THEN 'progress' WHEN '4' THEN 'failed' ELSE 'stopped' END AS type,
  CASE WHEN o_orderpriority[1] = '5' THEN '2' END AS code FROM orders),
g AS (SELECT run_id, bool_or(type = 'committed') AS c, bool_or(type = 'cancelled') AS x, bool_or(code IS NOT DISTINCT FROM '2') AS q FROM e GROUP BY 1)
SELECT run_id, CASE WHEN c THEN 'completed' WHEN x THEN 'cancelled' ELSE 'failed' END AS status, CASE WHEN c THEN NULL WHEN x THEN 'user_cancelled' WHEN q THEN 'engine_check_stopped' ELSE 'engine_failed' END AS error_code FROM g""")
def j07(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    kind = F.when(p == "1", "committed").when(p == "2", "cancelled").when(p == "3", "progress").when(p == "4", "failed").otherwise("stopped")
    o = src.table(spark, d, "orders")
    return ev.run_outcome(o.select(F.col("o_custkey").cast("string").alias("run_id"), kind.alias("type"), F.when(p == "5", "2").alias("code")))


@query("a14_read_run_events", """SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS events FROM events GROUP BY 1""")
def a14(spark, d):
    import uuid

    from rasterspark.session import ensure_checkpoint_dir
    from rasterspark.sources import catalog

    out = f"{ensure_checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    e = run_events(spark, d)
    e.unionByName(e.withColumn("schema_version", F.lit(2))).write.json(out)
    return catalog.read_run_events(spark, out).groupBy("run_id").agg(F.count(F.lit(1)).alias("events"))

