"""Structured Streaming forms of ingestion, index, windows, patterns, alerts and live tail.

Sinks write each micro-batch to a folder named by its number and overwrite it on a retry, so a batch that runs twice
counts once. Checkpoints make restarts exact; one query owns its state, so no leader election is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import is_blank
from ..operators import alerts, index, ingest, metrics, tail
from ..schema import MINUTE_MS


def with_time(logs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Records with event time ``ts`` and a watermark."""
    return logs.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", watermark)


def deduplicate(logs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """One record per event_id while the watermark has not passed it (bounded state). Records without an id get one of their own for the test."""
    own = F.when(is_blank(F.col("event_id")), F.concat_ws("-", "kafka_partition", "kafka_offset", F.lit("none"))).otherwise(F.col("event_id"))
    return with_time(logs, watermark).withColumn("__id", own).dropDuplicatesWithinWatermark(["__id"]).drop("__id", "ts")


def ingest_stream(logs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The ingestion pipeline on a stream."""
    return ingest.Pipeline().with_step("dedup", lambda df: deduplicate(df, watermark), before="validate")(logs)


def window_counts(logs: DataFrame, length: str = "5 minutes", slide: str = "1 minute", watermark: str = "1 hour") -> DataFrame:
    """Counters of every sliding window of each service; in append mode a window comes once, when the watermark passes it."""
    kept = with_time(logs, watermark).filter(~is_blank(F.col("service_name")))
    counted = kept.groupBy("service_name", F.window("ts", length, slide).alias("w")).agg(*metrics.level_counts())
    return counted.select("service_name", F.unix_millis("w.start").alias("window_ms"), *metrics.COUNTS)


def patterns(logs: DataFrame, bucket: str = "1 minute", length: str = "5 minutes", slide: str = "1 minute", watermark: str = "1 hour", window_minutes: int = metrics.WINDOW_MINUTES, **thresholds) -> DataFrame:
    """service_name, window_ms, pattern, value, description of every pattern in each sliding window (append mode): counters of buckets, then the buckets of a window."""
    kept = with_time(logs, watermark).filter(~is_blank(F.col("service_name")))
    counted = kept.groupBy("service_name", F.window("ts", bucket).alias("b")).agg(*metrics.level_counts())
    buckets = counted.withColumns({"bucket_ms": F.unix_millis("b.start"), "at": F.window_time("b")})
    windows = metrics.gathered(buckets, "service_name", F.window("at", length, slide).alias("w"))
    return metrics.patterns_of(windows.select("service_name", F.unix_millis("w.start").alias("window_ms"), "buckets"), window_minutes, **thresholds)


def interval_metrics(logs: DataFrame, interval: str = "1 minute", watermark: str = "1 hour") -> DataFrame:
    """Alert metrics of each service and interval."""
    counted = with_time(logs.filter("service_name IS NOT NULL"), watermark).groupBy("service_name", F.window("ts", interval).alias("w")).agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(F.col("level").isin("ERROR", "FATAL"), F.lit(False))).alias("errors"), F.count_if(F.coalesce(F.col("level") == "FATAL", F.lit(False))).alias("fatals")
    )
    return counted.select("service_name", F.unix_millis("w.start").alias("bucket_ms"), "total", "errors", "fatals", (F.col("errors") * F.lit(100.0) / F.col("total")).alias("error_rate"))


class AlertProcessor(StatefulProcessor):
    """Keeps one ``AlertState`` per (rule, service) and emits what each reading does to it."""

    def __init__(self, alpha: float = alerts.ALPHA, pending: int = alerts.PENDING, resolve: int = alerts.RESOLVE, score_first: bool = False):
        self.settings = (alpha, pending, resolve, score_first)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("alert", "mean double, variance double, updates long, state string, breaches long, normal long, since_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = alerts.AlertState(*self.kept.get()) if self.kept.exists() else alerts.AlertState()
        data = pd.concat(list(rows)).sort_values("bucket_ms")
        out = []
        for at, x, ewma, threshold, sigmas in data[["bucket_ms", "value", "use_ewma", "threshold", "ewma_sensitivity"]].itertuples(index=False):
            anomaly, event = state.step(float(x), int(at), bool(ewma), float(threshold), float(sigmas), *self.settings)
            out.append((*key, int(at), float(x), state.mean, state.variance, state.updates, anomaly, state.state, event, state.since_ms))
        self.kept.update((state.mean, state.variance, state.updates, state.state, state.breaches, state.normal, state.since_ms))
        yield pd.DataFrame(out, columns=[c.strip().split()[0] for c in alerts.FOLD_SCHEMA.split(",")])

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams that start in this context keep their state in RocksDB; the session's own setting comes back after it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def alert_stream(readings: DataFrame, **settings) -> DataFrame:
    """Alert states of a stream of readings (see ``alerts.readings``). The session's state store must be RocksDB (see ``rocksdb_state``)."""
    if readings.sparkSession.conf.get(PROVIDER, None) != ROCKSDB:
        raise ValueError("alert streams need the RocksDB state store: start them inside rocksdb_state(spark)")
    return readings.groupBy("rule_id", "service_name").transformWithStateInPandas(statefulProcessor=AlertProcessor(**settings), outputStructType=alerts.FOLD_SCHEMA, outputMode="Append", timeMode="None")


def alert_chain(logs: DataFrame, rules: DataFrame, interval: str = "1 minute", watermark: str = "1 hour", **settings) -> DataFrame:
    """Records to alert states in one stream: metrics of each interval once the watermark has passed it, readings of all rules, states."""
    return alert_stream(alerts.readings(interval_metrics(logs, interval, watermark), rules), **settings)


def with_dead_letters(logs: DataFrame, good: str, bad: str, checkpoint: str, counts: str, watermark: str = "1 hour") -> StreamingQuery:
    """Run what is available now: records that pass ingestion go to ``good``, invalid ones with a reason to ``bad``, and each micro-batch's counters to ``counts``."""
    steps = {k: v for k, v in ingest.Pipeline().steps.items() if k != "dedup"}

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        judged = batch.withColumn("reason", ingest.reject_reason()).observe(seen, F.count("*").alias("unique"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
        judged.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{bad}/batch_id={number}")
        ingest.Pipeline(steps)(batch).write.mode("overwrite").parquet(f"{good}/batch_id={number}")
        batch.sparkSession.createDataFrame([(seen.get["unique"], seen.get["rejected"])], "unique long, rejected long").write.mode("overwrite").parquet(f"{counts}/batch_id={number}")

    return deduplicate(logs, watermark).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(logs: DataFrame, path: str, checkpoint: str, buckets: int = index.BUCKETS) -> StreamingQuery:
    """Add the records that are available now to the index at ``path``, a batch of its own for each micro-batch."""
    return logs.writeStream.foreachBatch(lambda batch, number: index.write_index(batch, path, number, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Run everything that is available now into ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch_id={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _trigger(every: str | None) -> dict:
    return {"availableNow": True} if every is None else {"processingTime": every}


def route_tiers(logs: DataFrame, hot: str, warm: str, checkpoint: str, trigger: str | None = "60 seconds") -> StreamingQuery:
    """Write each micro-batch to the hot and the warm dataset (without ``trigger``: what is available now)."""

    def write(batch: DataFrame, number: int) -> None:
        labelled = batch.withColumns({"storage_tier": F.lit("HOT"), "event_date": F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd")})
        labelled.write.mode("overwrite").parquet(f"{hot}/batch_id={number}")
        labelled.write.mode("overwrite").partitionBy("event_date").parquet(f"{warm}/batch_id={number}")

    return logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**_trigger(trigger)).start()


def live_tail(logs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = "1 second") -> StreamingQuery:
    """Push routed records to ``sink`` as they come (start the source at its latest offsets)."""
    return tail.route(logs).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**_trigger(trigger)).start()


STATUS_SCHEMA = "name string, id string, run_id string, leader boolean, batch_id long, input_rows long, watermark string"


def status(spark: SparkSession) -> DataFrame:
    """The streams that this driver runs. A driver owns its streams and their checkpoints alone, so it is the leader of each."""
    rows = []
    for q in spark.streams.active:
        last = q.lastProgress
        rows.append((q.name, str(q.id), str(q.runId), True, last["batchId"] if last else None, last["numInputRows"] if last else None, (last["eventTime"] or {}).get("watermark") if last else None))
    return spark.createDataFrame(rows, STATUS_SCHEMA)


def newest_per_key(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """What an update-mode sink holds in the end: the row of the last batch for each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet folder or file as a stream, with the schema that its files have now. (As a pattern, a path may be a single file.)"""
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


__all__ = ["AlertProcessor", "MINUTE_MS", "alert_chain", "alert_stream", "deduplicate", "index_stream", "ingest_stream", "interval_metrics", "live_tail", "newest_per_key", "patterns", "rocksdb_state", "route_tiers", "status", "stream_of", "to_folder", "window_counts", "with_dead_letters", "with_time"]
