"""Structured Streaming operators over run events, edits and landing planes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rasterspark.session import ensure_checkpoint_dir

TERMINAL = ("completed", "cancelled", "failed")


def ordered_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Drop repeated (run, sequence) pairs; state is bounded by the watermark on streams."""
    keys = ["run_id", "sequence"]
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(keys)


def _keyed_state(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store, which also spills to disk."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def terminal_latch(events: DataFrame) -> DataFrame:
    """Batch twin of the latch: events up to and including the first terminal one of each run."""
    first = F.min(F.when(F.col("type").isin(*TERMINAL), F.col("sequence"))).over(Window.partitionBy("run_id"))
    return events.withColumn("_t", first).where(F.col("_t").isNull() | (F.col("sequence") <= F.col("_t"))).drop("_t")


class _Latch(StatefulProcessor):
    """Pass events of a run until its first terminal event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "sequence bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stop = self.done.get()[0] if self.done.exists() else None
        for pdf in rows:
            ends = pdf.loc[pdf["type"].isin(TERMINAL), "sequence"]
            if len(ends) and (stop is None or ends.min() < stop):
                stop = int(ends.min())
                self.done.update((stop,))
            yield pdf if stop is None else pdf[pdf["sequence"] <= stop]

    def close(self) -> None:
        pass


def stream_terminal_latch(events: DataFrame) -> DataFrame:
    """Keyed-state latch for streams whose events arrive in sequence order per run."""
    cols = ["run_id", "sequence", "timestamp", "type", "stage", "current", "total"]
    _keyed_state(events.sparkSession)
    return events.select(*cols).groupBy("run_id").transformWithStateInPandas(
        _Latch(), "run_id string, sequence bigint, timestamp timestamp, type string, stage string, current int, total int", "append", "none")


def stage_progress(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Latest progress and event counts per window, run and stage (tumbling, or sliding with ``slide``)."""
    src = events.withWatermark("timestamp", late) if events.isStreaming else events
    win = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    latest = F.max_by(F.struct("current", "total"), F.col("sequence"))
    g = src.groupBy(win.alias("w"), "run_id", "stage").agg(F.count(F.lit(1)).alias("events"), latest.alias("_l"))
    return g.select(F.col("w.start").alias("window_start"), "run_id", "stage", "events", F.col("_l.current").alias("current"), F.col("_l.total").alias("total"))


def completed_progress(events: DataFrame, item: str = "current") -> DataFrame:
    """Progress by the number of distinct completed items, not by their ids."""
    return events.groupBy("run_id", "stage").agg(F.countDistinct(item).alias("completed"), F.max("total").alias("total"))


def run_sessions(events: DataFrame, gap: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Active sessions of a run, split where it was silent for longer than ``gap``."""
    src = events.withWatermark("timestamp", late) if events.isStreaming else events
    g = src.groupBy("run_id", F.session_window("timestamp", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return g.select("run_id", "first", "last", "events", ((F.unix_micros("last") - F.unix_micros("first")) / 1e6).alias("seconds"))


class _Ledger(StatefulProcessor):
    """Version-checked commits with LIFO revert for one field."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version bigint")
        self.stack = handle.getListState("stack", "sequence bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version = self.version.get()[0] if self.version.exists() else 0
        stack = [r[0] for r in self.stack.get()] if self.stack.exists() else []
        # A field's edits of one micro-batch may come in several chunks; their order counts as a whole.
        edits = pd.concat([pdf[["sequence", "action", "base_version"]] for pdf in rows]).sort_values("sequence", kind="stable")
        out = []
        for seq, action, base in edits.itertuples(index=False):
            undone = None
            if not pd.isna(base) and int(base) != version:
                status = "stale_version"
            elif action == "revert" and not stack:
                status = "nothing_to_revert"
            else:
                status, version = "accepted", version + 1
                if action == "revert":
                    undone = stack.pop()
                else:
                    stack.append(int(seq))
            out.append((key[0], int(seq), action, status, version, undone))
        cols = ["field_id", "sequence", "action", "status", "version", "reverts_sequence"]
        yield pd.DataFrame(out, columns=cols).astype({"reverts_sequence": "Int64"})
        self.version.update((version,))
        if stack:
            self.stack.put([(s,) for s in stack])
        else:
            self.stack.clear()

    def close(self) -> None:
        pass


def stream_edits(edits: DataFrame) -> DataFrame:
    """Streamed ledger: status of each edit and the commit that a revert undoes.

    Within a micro-batch edits are taken in sequence order; a field's files must
    land in that order.
    """
    _keyed_state(edits.sparkSession)
    return edits.select("field_id", "sequence", "action", "base_version").groupBy("field_id").transformWithStateInPandas(
        _Ledger(), "field_id string, sequence bigint, action string, status string, version bigint, reverts_sequence bigint", "append", "none")


def plane_arrivals(stats: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows with the number of their planes seen so far and whether they are complete."""
    per_plane = windows.select("field_id", "position", "window_slices", F.explode(F.sequence(F.col("z0").cast("int"), F.col("z1").cast("int"))).alias("z"))
    seen = stats.select("field_id", "z").distinct().withColumn("_s", F.lit(1))
    g = per_plane.join(seen, ["field_id", "z"], "left").groupBy("field_id", "position", "window_slices").agg(F.count("_s").alias("arrived"))
    return g.withColumn("complete", F.col("arrived") == F.col("window_slices"))


def stream_planes_qc(planes: DataFrame, out: str, checkpoint: str):
    """Start a query that appends per-plane statistics as plane files land.

    Each micro-batch replaces its own ``batch`` folder, so a repeated batch after
    a failure is idempotent. Read the result with :func:`read_plane_stats`.
    """
    from rasterspark.operators.zonal import plane_stats

    def write(df: DataFrame, epoch: int) -> None:
        plane_stats(df).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return planes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_plane_stats(spark: SparkSession, out: str) -> DataFrame:
    """Latest statistics of every plane."""
    s = spark.read.parquet(out)
    w = Window.partitionBy("field_id", "channel", "z").orderBy(F.desc("batch"))
    return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "batch")


def run_outcome(events: DataFrame) -> DataFrame:
    """Outcome of each run: committed beats cancelled beats a quality stop beats failure.

    ``events``: (run_id, type, code) where ``committed`` marks publication and the
    code ``2`` a quality stop.
    """
    has = lambda c: F.bool_or(c)
    g = events.groupBy("run_id").agg(
        has(F.col("type") == "committed").alias("_c"), has(F.col("type") == "cancelled").alias("_x"), has(F.col("code").eqNullSafe("2")).alias("_q"),
        has(F.col("type") == "completed").alias("_d"))
    ok = F.col("_c") | (F.col("_d") & ~F.col("_x") & ~F.col("_q"))
    status = F.when(ok, "completed").when(F.col("_x"), "cancelled").otherwise("failed")
    code = F.when(ok, F.lit(None)).when(F.col("_x"), "user_cancelled").when(F.col("_q"), "engine_check_stopped").otherwise("engine_failed")
    return g.select("run_id", status.alias("status"), code.alias("error_code"))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream into a fresh folder of the shared checkpoint folder and read it back."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")

