"""Where log records come from and go to: JSON files, test tables, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DATASETS, LOG_SCHEMA, complete

#: The test table ``events`` as log records; {S} is the string type and {MS} the epoch milliseconds of ``ts``.
EVENT_COLUMNS = {
    "event_id": "cast(event_id as {S})",
    "ts_ms": "{MS}",
    "level": "case when event_type = 'error' and value >= 150 then 'FATAL' when event_type = 'error' then 'ERROR' when event_type = 'signup' and user_id % 3 = 0 then 'WARN' when event_type = 'view' then 'DEBUG' else 'INFO' end",
    "service_name": "case user_id % 4 when 0 then 'payment-service' when 1 then 'auth-service' when 2 then 'order-service' else 'cart-service' end",
    "environment": "case user_id % 3 when 0 then 'PRODUCTION' when 1 then 'STAGING' else 'DEVELOPMENT' end",
    "message": "case event_type when 'error' then case event_id % 6 when 0 then 'Orders store: timeout, no answer for 5 s' when 1 then 'Cannot open the SQL pool, connection refused by replica 2' when 2 then concat('Session ended: JWT token expired, userId=u_', cast(user_id as {S})) when 3 then 'OutOfMemoryError while a report was built' when 4 then 'Card payment gateway timeout, giving up' else 'NullPointerException in the basket page' end "
    "when 'purchase' then concat('Order paid in full, orderId=N-', cast(event_id as {S})) when 'signup' then concat('Account opened, userId=u_', cast(user_id as {S})) when 'click' then 'Second retry of a payment call' else concat('GET /items/', cast(user_id as {S})) end",
    "stack_trace": "case when event_type = 'error' and event_id % 7 = 0 then 'java.lang.RuntimeException: boom' end",
    "source_ip": "case user_id % 8 when 0 then '127.0.0.1' when 1 then '10.0.1.5' when 2 then '192.168.0.9' when 3 then '172.16.0.2' when 4 then '52.1.2.3' when 5 then '35.1.2.3' when 6 then '13.1.2.3' else '8.8.8.8' end",
    "kafka_partition": "cast(event_id % 12 as int)",
    "kafka_offset": "event_id",
}


def event_columns(dialect: str) -> dict[str, str]:
    words = {"S": "string", "MS": "unix_millis(cast(ts as timestamp))"} if dialect == "spark" else {"S": "varchar", "MS": "(epoch_us(ts) // 1000)"}
    return {k: v.format(**words) for k, v in EVENT_COLUMNS.items()}


def logs_from_events(events: DataFrame) -> DataFrame:
    """Log records made from the test table ``events`` (session time zone UTC)."""
    return events.selectExpr(*[f"{v} as {k}" for k, v in event_columns("spark").items()])


def logs_sql() -> str:
    """The same in DuckDB."""
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in event_columns("duckdb").items()) + " FROM events"


def read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the fixed schema: no inference pass; blank lines are skipped."""
    return spark.read.schema(LOG_SCHEMA).json(path)


def stream_json_logs(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A folder of JSON-lines files as a stream; ``max_files`` per trigger bounds a micro-batch."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def stream_kafka_logs(spark: SparkSession, servers: str, topic: str = "raw-logs", starting: str = "earliest", max_offsets: int = 100_000) -> DataFrame:
    """A Kafka topic of JSON records as a stream, with partition and offset stamped (needs Spark's Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("maxOffsetsPerTrigger", max_offsets).load()
    return stamp(raw.select(F.from_json(F.col("value").cast("string"), LOG_SCHEMA).alias("r"), "partition", "offset"))


def stamp(decoded: DataFrame) -> DataFrame:
    """Records decoded into column ``r``, with the stream's ``partition`` and ``offset`` put on them."""
    own = [f.name for f in LOG_SCHEMA if f.name not in ("kafka_partition", "kafka_offset")]
    return complete(decoded.select(*[F.col(f"r.{n}").alias(n) for n in own], F.col("partition").cast("int").alias("kafka_partition"), F.col("offset").cast("long").alias("kafka_offset")))


def to_messages(logs: DataFrame) -> DataFrame:
    """(key, value) of each record for a message sink: key is the service, value is JSON without null fields."""
    return logs.select(F.col("service_name").alias("key"), F.to_json(F.struct(*logs.columns)).alias("value"))


def write_kafka(logs: DataFrame, servers: str, topic: str, checkpoint: str):
    """Start a stream of ``logs`` into a topic of the catalogue."""
    if topic not in DATASETS:
        raise ValueError(f"no topic {topic!r}; there are {', '.join(DATASETS)}")
    return to_messages(logs).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.compression.type", "snappy").option("topic", topic).option("checkpointLocation", checkpoint).start()


def bulk_fixture(spark: SparkSession, ts_ms: int = 1_704_103_200_000) -> DataFrame:
    """The ten canned records of the test injector, within one minute."""
    # The injector's records.
    rows = [
        ("payment-service", "INFO", "Payment processed for orderId=ORD-001"),
        ("payment-service", "ERROR", "Database timeout after 5000ms"),
        ("auth-service", "ERROR", "Authentication failed for userId=u_991"),
        ("auth-service", "INFO", "User login successful userId=u_123"),
        ("order-service", "WARN", "Retry attempt 2 of 3 for payment"),
        ("payment-service", "ERROR", "Payment gateway timeout - call failed"),
        ("payment-service", "FATAL", "OutOfMemoryError: heap space exhausted"),
        ("order-service", "ERROR", "SQL exception: connection refused"),
        ("auth-service", "ERROR", "JWT token expired for userId=u_456"),
        ("payment-service", "INFO", "Refund processed for orderId=ORD-009"),
    ]
    data = [(f"e{i:02d}", ts_ms + i, s, lvl, m, "DEVELOPMENT", "test-host-01", f"10.0.1.{i}", i % 12, i) for i, (s, lvl, m) in enumerate(rows, 1)]
    return complete(spark.createDataFrame(data, "event_id string, ts_ms long, service_name string, level string, message string, environment string, host_name string, source_ip string, kafka_partition int, kafka_offset long"))
