"""Ingestion: capture defaults, dedup, validation, geo and category enrichment, and the pipeline that chains them.

Everything but dedup is a projection or a filter, so a batch has one shuffle (on event_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, is_blank
from ..schema import level_rank

# Fixed values.
EARLIEST_MS = 1_577_836_800_000
LOOPBACK = ("127.0.0.1", "0:0:0:0:0:0:0:1")
GEO_PREFIXES = {"10.": ("IN", "Mumbai"), "192.168.": ("IN", "Pune"), "172.": ("US", "New York"), "52.": ("US", "Virginia"), "35.": ("US", "Oregon"), "13.": ("SG", "Singapore")}
CATEGORY_WORDS = {
    "DATABASE_ERROR": ("sql", "jdbc", "hibernate", "datasource", "connection pool"),
    "EXTERNAL_CALL_FAILURE": ("timeout", "connection refused", "socket", "http client"),
    "SECURITY_EVENT": ("unauthorized", "403", "authentication failed", "jwt", "token expired"),
    "JVM_ERROR": ("outofmemory", "stackoverflow", "gc overhead"),
    "NULL_POINTER": ("nullpointerexception", "npe"),
}
BUFFER = 4096
EXCLUDED_PATHS = ("/health", "/actuator", "/favicon.ico")

Transform = Callable[[DataFrame], DataFrame]


def capture_defaults(logs: DataFrame, now_ms: int | None = None, service: str = "unknown-service", environment: str = "DEVELOPMENT", host: str = "localhost") -> DataFrame:
    """Fill what a client left out: id, time, service, environment; stamp the host and the time of ingestion."""
    now = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    filled = {
        "event_id": F.coalesce("event_id", F.expr("uuid()")),
        "ts_ms": F.when(F.col("ts_ms") > 0, F.col("ts_ms")).otherwise(now),
        "ingested_at_ms": now.cast("long"),
        "service_name": F.coalesce("service_name", F.lit(service)),
        "host_name": F.lit(host),
        "environment": F.coalesce("environment", F.lit(environment)),
    }
    return logs.withColumns(filled)


def default_category(stack_trace: Column) -> Column:
    """Category that the capture API gives: an exception or a custom event."""
    return F.when(stack_trace.isNotNull(), "EXCEPTION").otherwise("CUSTOM_EVENT")


def status_level(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")


def capture_http(requests: DataFrame, service: str = "unknown-service", environment: str = "DEVELOPMENT", minimum: str = "INFO", excluded: tuple[str, ...] = EXCLUDED_PATHS) -> DataFrame:
    """Log records of an access log (method, path, status, start_ms, duration_ms, remote_addr, x_trace_id)."""
    skip = F.lit(False)
    for prefix in excluded:
        skip = skip | F.col("path").startswith(prefix)
    level = status_level(F.col("status"))
    duration = F.concat(F.col("duration_ms").cast("string"), F.lit("ms"))
    tags = F.map_from_arrays(F.array(*map(F.lit, ("method", "path", "status", "duration"))), F.array("method", "path", F.col("status").cast("string"), duration))
    return requests.filter(~skip & (level_rank(level) >= level_rank(F.lit(minimum)))).select(
        F.expr("uuid()").alias("event_id"),
        F.col("start_ms").alias("ts_ms"),
        level.alias("level"),
        F.lit(service).alias("service_name"),
        F.lit(environment).alias("environment"),
        F.format_string("%s %s → %d (%dms)", "method", "path", "status", "duration_ms").alias("message"),
        F.when(is_blank(F.col("x_trace_id")), F.expr("uuid()")).otherwise(F.col("x_trace_id")).alias("trace_id"),
        F.col("remote_addr").alias("source_ip"),
        F.lit("HTTP_REQUEST").alias("category"),
        tags.alias("tags"),
    )


def buffered(logs: DataFrame, capacity: int = BUFFER, arrival: tuple[str, ...] = ("kafka_offset", "kafka_partition")) -> DataFrame:
    """What a bounded buffer takes in of the records that come before it is drained: the first ``capacity`` by arrival; the newest are dropped. (A task keeps no more than that; on a stream, the source's limits per trigger do the same without loss.)"""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity of a buffer must be a power of two")
    return logs.orderBy(*arrival).limit(capacity)


def deduplicate(logs: DataFrame, arrival: tuple[str, ...] = ("kafka_partition", "kafka_offset")) -> DataFrame:
    """The first record by arrival of each event_id; records without an id all stay.

    Records without an id are kept apart before the shuffle: they would otherwise all meet in one task.
    """
    without = is_blank(F.col("event_id"))
    order = Window.partitionBy("event_id").orderBy(*arrival, "ts_ms", "service_name", "message")
    first = logs.filter(~without).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return first.unionByName(logs.filter(without))


def reject_reason(earliest_ms: int = EARLIEST_MS) -> Column:
    """Why a record is invalid (the first reason that holds), or null."""
    return (
        F.when(is_blank(F.col("service_name")), "missing service_name")
        .when(is_blank(F.col("message")), "missing message")
        .when(F.col("level").isNull(), "missing level")
        .when(F.col("ts_ms").isNull() | (F.col("ts_ms") < earliest_ms), "timestamp before 2020")
    )


def validate(logs: DataFrame) -> DataFrame:
    return logs.filter(reject_reason().isNull())


def rejects(logs: DataFrame) -> DataFrame:
    """The invalid records with their ``reason``, for a dead-letter sink."""
    return logs.withColumn("reason", reject_reason()).filter("reason IS NOT NULL")


def counters(logs: DataFrame) -> DataFrame:
    """How many records came, were duplicates, and were rejected after dedup."""
    came = logs.select(F.lit(1).alias("one"), F.lit(0).alias("kept"), F.lit(0).alias("bad"))
    kept = deduplicate(logs).select(F.lit(0).alias("one"), F.lit(1).alias("kept"), F.when(reject_reason().isNotNull(), 1).otherwise(0).alias("bad"))
    total = came.unionByName(kept).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("one", "kept", "bad")])
    return total.select(F.col("one").alias("received"), (F.col("one") - F.col("kept")).alias("duplicates"), F.col("bad").alias("rejected"))


def observed(logs: DataFrame, observation) -> DataFrame:
    """``logs`` with counters that fill ``observation`` (a ``pyspark.sql.Observation``) as a job or stream runs over it, without a pass of their own."""
    return logs.observe(observation, F.count("*").alias("received"), F.count_if(is_blank(F.col("event_id"))).alias("without_id"), F.count_if(reject_reason().isNotNull()).alias("rejected"))


def enrich_geo(logs: DataFrame, prefixes: dict[str, tuple[str, str]] = GEO_PREFIXES) -> DataFrame:
    """Country and city by address prefix; records without an address, with a country, or from the host itself stay as they are."""
    ip = F.col("source_ip")
    untouched = ip.isNull() | F.col("country").isNotNull() | ip.isin(*LOOPBACK)
    place = F.struct(F.lit("UNKNOWN").alias("country"), F.lit("UNKNOWN").alias("city"))
    for prefix, (country, city) in prefixes.items():
        place = F.when(ip.startswith(prefix), F.struct(F.lit(country).alias("country"), F.lit(city).alias("city"))).otherwise(place)
    found = F.when(~untouched, place)
    return logs.withColumns({"country": F.when(untouched, F.col("country")).otherwise(found["country"]), "city": F.when(untouched, F.col("city")).otherwise(found["city"])})


def classify(logs: DataFrame, words: dict[str, tuple[str, ...]] = CATEGORY_WORDS) -> DataFrame:
    """Category by keywords in message and stack trace, for records that have none."""
    text = F.concat_ws(" ", F.lower(F.coalesce("message", F.lit(""))), F.lower(F.coalesce("stack_trace", F.lit(""))))
    category = F.when(~is_blank(F.col("category")), F.col("category"))
    for name, keys in words.items():
        category = category.when(contains_any(text, keys), name)
    return logs.withColumn("category", category.when(~is_blank(F.col("stack_trace")), "EXCEPTION").otherwise("APPLICATION_LOG"))


class Pipeline:
    """An ordered registry of steps (DataFrame to DataFrame); a step may drop, change or add rows."""

    def __init__(self, steps: dict[str, Transform] | None = None):
        self.steps = dict(steps if steps is not None else {"dedup": deduplicate, "validate": validate, "geo": enrich_geo, "classify": classify})

    def with_step(self, name: str, step: Transform, before: str | None = None) -> Pipeline:
        """A pipeline with one more step, at the end or before a named one."""
        items = [(k, v) for k, v in self.steps.items() if k != name]
        at = next((i for i, (k, _) in enumerate(items) if k == before), len(items))
        return Pipeline(dict([*items[:at], (name, step), *items[at:]]))

    def __call__(self, logs: DataFrame) -> DataFrame:
        for step in self.steps.values():
            logs = logs.transform(step)
        return logs
