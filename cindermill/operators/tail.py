"""Live tail: which topics a record goes to, and the viewer's filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SHOWN = 500


def route(logs: DataFrame) -> DataFrame:
    """One row per record and topic: all, the record's service, and errors."""
    service = F.when(F.col("service_name").isNotNull(), F.concat(F.lit("/topic/logs/"), "service_name"))
    errors = F.when(F.col("level").isin("ERROR", "FATAL"), F.lit("/topic/logs/errors"))
    return logs.withColumn("topic", F.explode(F.array_compact(F.array(F.lit("/topic/logs"), service, errors))))


def view(logs: DataFrame, level: str | None = None, service_part: str | None = None, limit: int = MAX_SHOWN) -> DataFrame:
    """The newest records that pass the viewer's filters."""
    if level:
        logs = logs.filter(F.col("level") == level)
    if service_part:
        logs = logs.filter(F.lower("service_name").contains(service_part.lower()))
    return logs.orderBy(F.desc("ts_ms"), "event_id").limit(limit)


def counters(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("level").isin("ERROR", "FATAL"), F.lit(False))).alias("errors"))
