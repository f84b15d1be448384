"""The log record, its domains, and the names of datasets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
#: Datasets that stand for the topics: partitions and days of retention.
DATASETS = {"raw-logs": (12, 7), "processed-logs": (6, 3), "alerts": (3, 7), "metrics": (3, 7), "dead-letter": (3, 30)}

LOG_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("ingested_at_ms", T.LongType()),
        T.StructField("level", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("host_name", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("stack_trace", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("storage_tier", T.StringType()),
    ]
)

MINUTE_MS, HOUR_MS, DAY_MS = 60_000, 3_600_000, 86_400_000


def level_rank(level: Column) -> Column:
    """1 (TRACE) to 6 (FATAL); 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)).cast("int")


def complete(df):
    """``df`` with every column of the log record in order; the ones it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA])
