"""The registered queries of the log engine and their SQL.

The test table ``events`` is the log (see ``sources.logs``); buckets are hours and windows days, since it has some 14
rows an hour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DELIMITERS, STOPWORDS
from ..operators import alerts, index, ingest, metrics, storage, tail
from ..schema import DAY_MS, HOUR_MS, LOG_SCHEMA
from ..sources.logs import logs_from_events, logs_sql, read_logs, stamp, stream_json_logs, to_messages
from ..sources.shared import shared_path
from ..streaming import engine
from . import query_language as ql

BUCKET, WINDOW = HOUR_MS, DAY_MS
SIX_HOURS = 6 * HOUR_MS
#: Range used by the time-range queries: five days from 2024-01-10.
FROM_MS, TO_MS = 1_704_844_800_000, 1_705_276_800_000
#: The end of the test events, from which ages count.
AS_OF = 1_706_572_800_000
SHOWN = ["event_id", "ts_ms", "level", "service_name", "environment", "message"]
ALPHA, THRESHOLD = 0.05, 22.0
SPIKE, RATE, FACTOR = 3, 20, 1

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


LOGS = f"WITH logs AS ({logs_sql()})"
_SHOWN = ", ".join(SHOWN)


# --- search language -------------------------------------------------------------------------------------------------
def _search(name: str, text: str, where: str, from_ms: int = 0, to_ms: int = 0) -> None:
    @query(name, f"{LOGS} SELECT {_SHOWN} FROM logs WHERE {where} ORDER BY ts_ms DESC, event_id LIMIT 500")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ql.execute(read_logs(spark, sf_dir), text, from_ms, to_ms).select(SHOWN)


_search("q_level_service_and", "level:ERROR AND service:payment-service", "level = 'ERROR' AND service_name = 'payment-service'")
_search("q_or_terms", "timeout OR refused", "regexp_matches(message, 'timeout', 'i') OR regexp_matches(message, 'refused', 'i')")
_search("q_phrase", '"gateway TIMEOUT"', r"regexp_matches(message, '\bgateway TIMEOUT\b', 'i')")
_search("q_regex", "userId=u_[0-9]+1$", "regexp_matches(message, 'userId=u_[0-9]+1$', 'i')")
_search("q_env", "env:production", "environment = 'PRODUCTION'")
_search("q_unknown_field", "message:timeout", "message = 'timeout'")
_search("q_unreachable_field", "traceId:T-1", "false")
_search("q_empty", "  ", "false")
_search("q_time_range", "level:FATAL OR level:ERROR", f"level IN ('FATAL', 'ERROR') AND ts_ms BETWEEN {FROM_MS} AND {TO_MS}", FROM_MS, TO_MS)

_CATEGORY = """CASE WHEN contains(x, 'sql') OR contains(x, 'jdbc') OR contains(x, 'hibernate') OR contains(x, 'datasource') OR contains(x, 'connection pool') THEN 'DATABASE_ERROR'
 WHEN contains(x, 'timeout') OR contains(x, 'connection refused') OR contains(x, 'socket') OR contains(x, 'http client') THEN 'EXTERNAL_CALL_FAILURE'
 WHEN contains(x, 'unauthorized') OR contains(x, '403') OR contains(x, 'authentication failed') OR contains(x, 'jwt') OR contains(x, 'token expired') THEN 'SECURITY_EVENT'
 WHEN contains(x, 'outofmemory') OR contains(x, 'stackoverflow') OR contains(x, 'gc overhead') THEN 'JVM_ERROR'
 WHEN contains(x, 'nullpointerexception') OR contains(x, 'npe') THEN 'NULL_POINTER'
 WHEN trim(coalesce(stack_trace, '')) <> '' THEN 'EXCEPTION' ELSE 'APPLICATION_LOG' END"""
CLASSIFIED = f"{LOGS}, text AS (SELECT *, lower(coalesce(message, '')) || ' ' || lower(coalesce(stack_trace, '')) AS x FROM logs), classified AS (SELECT *, {_CATEGORY} AS category FROM text)"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.classify(read_logs(spark, sf_dir).withColumn("category", F.lit(None).cast("string")))


@query("q_category", f"{CLASSIFIED} SELECT {_SHOWN}, category FROM classified WHERE category = 'SECURITY_EVENT' ORDER BY ts_ms DESC, event_id LIMIT 500")
def q_category(spark, sf_dir):
    return ql.execute(_classified(spark, sf_dir), "category:Security_Event").select(*SHOWN, "category")


@query("q_hits", f"{LOGS} SELECT count(*) AS hits FROM logs WHERE level = 'ERROR' OR regexp_matches(message, 'retry', 'i')")
def q_hits(spark, sf_dir):
    return ql.hits(read_logs(spark, sf_dir), "level:ERROR OR retry")


@query("q_explain", "SELECT * FROM (VALUES ('AND', 0, 'FIELD', 'level', 'error'), ('AND', 1, 'PHRASE', 'message', 'db timeout')) t(operator, clause, type, field, value)")
def q_explain(spark, sf_dir):
    return ql.explain(spark, 'level:ERROR AND message:"db timeout"')


# --- ingestion -------------------------------------------------------------------------------------------------------
@query(
    "ingest_dedup",
    f"""{LOGS}, ids AS (SELECT * REPLACE (CASE WHEN CAST(event_id AS BIGINT) % 97 = 0 THEN NULL WHEN CAST(event_id AS BIGINT) % 101 = 0 THEN '  ' ELSE event_id END AS event_id) FROM logs),
twice AS (SELECT * FROM ids UNION ALL SELECT * REPLACE (kafka_offset + 1000000000 AS kafka_offset) FROM ids WHERE kafka_offset % 3 = 0)
SELECT event_id, kafka_partition, kafka_offset, ts_ms, service_name FROM twice QUALIFY event_id IS NULL OR trim(event_id) = '' OR row_number() OVER (PARTITION BY event_id ORDER BY kafka_partition, kafka_offset) = 1""",
)
def ingest_dedup(spark, sf_dir):
    logs = read_logs(spark, sf_dir)
    n = F.col("kafka_offset")
    ids = logs.withColumn("event_id", F.when(n % 97 == 0, F.lit(None)).when(n % 101 == 0, F.lit("  ")).otherwise(F.col("event_id")))
    twice = ids.unionByName(ids.filter(n % 3 == 0).withColumn("kafka_offset", n + 1_000_000_000))
    return ingest.deduplicate(twice).select("event_id", "kafka_partition", "kafka_offset", "ts_ms", "service_name")


_FAULTY = f"""{LOGS}, faulty AS (SELECT * REPLACE (CASE WHEN kafka_offset % 11 = 0 THEN ' ' ELSE service_name END AS service_name, CASE WHEN kafka_offset % 13 = 0 THEN NULL ELSE message END AS message,
 CASE WHEN kafka_offset % 17 = 0 THEN NULL ELSE level END AS level, CASE WHEN kafka_offset % 19 = 0 THEN 1577836799999 WHEN kafka_offset % 23 = 0 THEN 1577836800000 ELSE ts_ms END AS ts_ms) FROM logs),
judged AS (SELECT *, CASE WHEN trim(coalesce(service_name, '')) = '' THEN 'missing service_name' WHEN trim(coalesce(message, '')) = '' THEN 'missing message' WHEN level IS NULL THEN 'missing level' WHEN ts_ms < 1577836800000 THEN 'timestamp before 2020' END AS reason FROM faulty)"""


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_faults(read_logs(spark, sf_dir))


def _with_faults(logs: DataFrame) -> DataFrame:
    n = F.col("kafka_offset")
    return logs.withColumns(
        {
            "service_name": F.when(n % 11 == 0, " ").otherwise(F.col("service_name")),
            "message": F.when(n % 13 != 0, F.col("message")),
            "level": F.when(n % 17 != 0, F.col("level")),
            "ts_ms": F.when(n % 19 == 0, F.lit(1_577_836_799_999)).when(n % 23 == 0, F.lit(1_577_836_800_000)).otherwise(F.col("ts_ms")),
        }
    )


@query("ingest_validate", f"{_FAULTY} SELECT event_id, ts_ms, level, service_name, message FROM judged WHERE reason IS NULL")
def ingest_validate(spark, sf_dir):
    return ingest.validate(_faulty(spark, sf_dir)).select("event_id", "ts_ms", "level", "service_name", "message")


@query("ingest_rejects", f"{_FAULTY} SELECT event_id, reason FROM judged WHERE reason IS NOT NULL")
def ingest_rejects(spark, sf_dir):
    return ingest.rejects(_faulty(spark, sf_dir)).select("event_id", "reason")


@query(
    "ingest_counters",
    f"""{_FAULTY}, twice AS (SELECT * FROM judged UNION ALL SELECT * FROM judged WHERE kafka_offset % 3 = 0)
SELECT count(*) AS received, count(*) - count(DISTINCT event_id) AS duplicates, count(DISTINCT event_id) FILTER (WHERE reason IS NOT NULL) AS rejected FROM twice""",
)
def ingest_counters(spark, sf_dir):
    faulty = _faulty(spark, sf_dir)
    return ingest.counters(faulty.unionByName(faulty.filter(F.col("kafka_offset") % 3 == 0)))


def _geo_sql(column: str, other: str) -> str:
    cases = " ".join(f"WHEN starts_with(source_ip, '{p}') THEN '{v[0 if column == 'country' else 1]}'" for p, v in ingest.GEO_PREFIXES.items())
    return f"CASE WHEN country IS NOT NULL OR source_ip IS NULL OR source_ip IN ('127.0.0.1', '0:0:0:0:0:0:0:1') THEN {column} {cases} ELSE 'UNKNOWN' END AS {column}{other}"


_PLACED = f"{LOGS}, placed AS (SELECT *, CASE WHEN kafka_offset % 29 = 0 THEN 'DE' END AS country, CAST(NULL AS VARCHAR) AS city FROM logs)"


def _placed(logs: DataFrame) -> DataFrame:
    return logs.withColumns({"country": F.when(F.col("kafka_offset") % 29 == 0, "DE"), "city": F.lit(None).cast("string")})


@query("ingest_geo", f"{_PLACED} SELECT event_id, source_ip, {_geo_sql('country', '2')}, {_geo_sql('city', '2')} FROM placed")
def ingest_geo(spark, sf_dir):
    out = ingest.enrich_geo(_placed(read_logs(spark, sf_dir)))
    return out.select("event_id", "source_ip", F.col("country").alias("country2"), F.col("city").alias("city2"))


@query("ingest_classify", f"{CLASSIFIED} SELECT event_id, category FROM classified")
def ingest_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("event_id", "category")


_PIPELINE = f"""{_FAULTY}, twice AS (SELECT * FROM judged UNION ALL SELECT * REPLACE (kafka_offset + 1000000000 AS kafka_offset) FROM judged WHERE kafka_offset % 3 = 0),
one AS (SELECT *, CASE WHEN kafka_offset % 29 = 0 THEN 'DE' END AS country, CAST(NULL AS VARCHAR) AS city, lower(message) || ' ' || lower(coalesce(stack_trace, '')) AS x FROM twice WHERE kafka_offset < 1000000000 AND reason IS NULL)
SELECT event_id, ts_ms, service_name, level, {_CATEGORY} AS category, {_geo_sql('country', '2')}, {_geo_sql('city', '2')} FROM one"""


@query("ingest_pipeline", _PIPELINE)
def ingest_pipeline(spark, sf_dir):
    faulty = _faulty(spark, sf_dir).withColumn("category", F.lit(None).cast("string"))
    twice = _placed(faulty).unionByName(_placed(faulty.filter(F.col("kafka_offset") % 3 == 0)).withColumn("kafka_offset", F.col("kafka_offset") + 1_000_000_000))
    out = ingest.Pipeline()(twice)
    return out.select("event_id", "ts_ms", "service_name", "level", "category", F.col("country").alias("country2"), F.col("city").alias("city2"))


_ACCESS = {
    "method": "case when user_id % 5 = 0 then 'POST' else 'GET' end",
    "path": "case when event_id % 10 = 0 then '/healthz' when event_id % 10 = 1 then '/actuator/info' else concat('/items/', cast(user_id as {S})) end",
    "status": "cast(case event_type when 'error' then 500 when 'signup' then 499 when 'view' then 399 when 'click' then 400 else 200 end as int)",
    "start_ms": "{MS}",
    "duration_ms": "event_id % 900",
    "remote_addr": "concat('10.0.0.', cast(user_id % 250 as {S}))",
    "x_trace_id": "concat('t-', cast(event_id as {S}))",
}


def _access(dialect: str) -> list[str]:
    words = {"S": "string", "MS": "unix_millis(cast(ts as timestamp))"} if dialect == "spark" else {"S": "varchar", "MS": "(epoch_us(ts) // 1000)"}
    return [f"{v.format(**words)} as {k}" for k, v in _ACCESS.items()]


@query(
    "http_capture",
    f"""WITH a AS (SELECT {', '.join(_access('duckdb'))} FROM events)
SELECT start_ms AS ts_ms, CASE WHEN status >= 500 THEN 'ERROR' ELSE 'WARN' END AS level, method || ' ' || path || ' → ' || status || ' (' || duration_ms || 'ms)' AS message, x_trace_id AS trace_id, remote_addr AS source_ip, 'HTTP_REQUEST' AS category, duration_ms || 'ms' AS duration
FROM a WHERE NOT (starts_with(path, '/health') OR starts_with(path, '/actuator') OR starts_with(path, '/favicon.ico')) AND status >= 400""",
)
def http_capture(spark, sf_dir):
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_access("spark"))
    out = ingest.capture_http(requests, minimum="WARN")
    return out.select("ts_ms", "level", "message", "trace_id", "source_ip", "category", F.col("tags")["duration"].alias("duration"))


@query("http_trace_ids", f"""WITH a AS (SELECT {', '.join(_access('duckdb'))}, event_id FROM events)
SELECT start_ms AS ts_ms, CASE WHEN event_id % 3 > 0 THEN x_trace_id ELSE 'made' END AS trace_id FROM a WHERE NOT (starts_with(path, '/health') OR starts_with(path, '/actuator') OR starts_with(path, '/favicon.ico'))""")
def http_trace_ids(spark, sf_dir):
    """Requests without a trace id, or with a blank one, get one of their own."""
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_access("spark"), "event_id")
    n = F.col("event_id")
    out = ingest.capture_http(requests.withColumn("x_trace_id", F.when(n % 3 > 0, F.col("x_trace_id")).when(n % 2 == 0, F.lit(" "))))
    made = F.col("trace_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return out.select("ts_ms", F.when(made, "made").otherwise(F.col("trace_id")).alias("trace_id"))


@query("q_tag_field", f"""WITH a AS (SELECT {', '.join(_access('duckdb'))} FROM events)
SELECT start_ms AS ts_ms, path FROM a WHERE NOT (starts_with(path, '/health') OR starts_with(path, '/actuator') OR starts_with(path, '/favicon.ico')) AND status = 500 AND method = 'POST'""")
def q_tag_field(spark, sf_dir):
    logs = ingest.capture_http(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_access("spark")))
    return ql.matches(logs, "tags.status:500").filter(F.col("tags")["method"] == "POST").select("ts_ms", F.col("tags")["path"].alias("path"))


@query("json_round_trip", f"{LOGS} SELECT event_id, ts_ms, level, service_name, message, stack_trace, 3 AS kafka_partition, 7::BIGINT AS kafka_offset FROM logs")
def json_round_trip(spark, sf_dir):
    """Records to messages and back, as a topic's reader decodes and stamps them."""
    sent = to_messages(read_logs(spark, sf_dir)).select(F.from_json("value", LOG_SCHEMA).alias("r"), F.lit(3).alias("partition"), F.lit(7).alias("offset"))
    return stamp(sent).select("event_id", "ts_ms", "level", "service_name", "message", "stack_trace", "kafka_partition", "kafka_offset")


@query(
    "capture_defaults",
    f"""{LOGS} SELECT event_id, CASE WHEN kafka_offset % 5 = 0 THEN {AS_OF} ELSE ts_ms END AS ts_ms, {AS_OF} AS ingested_at_ms, CASE WHEN kafka_offset % 7 = 0 THEN 'shop' ELSE service_name END AS service_name, 'host-1' AS host_name,
 CASE WHEN kafka_offset % 11 = 0 THEN 'STAGING' ELSE environment END AS environment, CASE WHEN stack_trace IS NOT NULL THEN 'EXCEPTION' ELSE 'CUSTOM_EVENT' END AS category FROM logs""",
)
def capture_defaults(spark, sf_dir):
    n = F.col("kafka_offset")
    bare = read_logs(spark, sf_dir).withColumns({"ts_ms": F.when(n % 5 == 0, F.lit(0)).otherwise(F.col("ts_ms")), "service_name": F.when(n % 7 != 0, F.col("service_name")), "environment": F.when(n % 11 != 0, F.col("environment"))})
    out = ingest.capture_defaults(bare, AS_OF, "shop", "STAGING", "host-1").withColumn("category", ingest.default_category(F.col("stack_trace")))
    return out.select("event_id", "ts_ms", "ingested_at_ms", "service_name", "host_name", "environment", "category")


@query("capture_buffer", f"{LOGS} SELECT event_id, kafka_offset FROM logs ORDER BY kafka_offset, kafka_partition LIMIT {ingest.BUFFER}")
def capture_buffer(spark, sf_dir):
    return ingest.buffered(read_logs(spark, sf_dir)).select("event_id", "kafka_offset")


# --- windows and patterns --------------------------------------------------------------------------------------------
BUCKETS = f"""{LOGS}, b AS (SELECT service_name, ts_ms - ts_ms % {BUCKET} AS bucket_ms, count(*) AS total, CAST(count_if(level = 'ERROR') AS BIGINT) AS errors, CAST(count_if(level = 'WARN') AS BIGINT) AS warns, CAST(count_if(level = 'FATAL') AS BIGINT) AS fatals, CAST(count_if(level NOT IN ('ERROR', 'WARN', 'FATAL')) AS BIGINT) AS infos FROM logs GROUP BY ALL)"""
ACTIVE = f"{BUCKETS}, a AS (SELECT * FROM b WHERE bucket_ms >= (SELECT max(ts_ms) FROM logs) - {WINDOW})"
SUMMARY = f"""{ACTIVE}, s AS (SELECT service_name, CAST(sum(total) AS BIGINT) AS total_events, CAST(sum(errors) AS BIGINT) AS total_errors, CAST(sum(warns) AS BIGINT) AS total_warns, CAST(sum(fatals) AS BIGINT) AS total_fatals, CAST(count(*) AS INTEGER) AS active_buckets, 1440 AS window_minutes, CAST(sum(errors) * 100 // sum(total) AS BIGINT) AS error_rate_percent FROM a GROUP BY service_name)"""


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.buckets(read_logs(spark, sf_dir), BUCKET)


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = read_logs(spark, sf_dir)
    return metrics.active(metrics.buckets(logs, BUCKET), metrics.as_of_last(logs), WINDOW)


@query("win_buckets", f"{BUCKETS} SELECT * FROM b")
def win_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir)


@query("win_blank_services", f"{_FAULTY} SELECT service_name, count(*) AS total FROM judged WHERE trim(service_name) <> '' GROUP BY 1")
def win_blank_services(spark, sf_dir):
    """Records without a service are in no window."""
    return metrics.buckets(_faulty(spark, sf_dir), BUCKET).groupBy("service_name").agg(F.sum("total").alias("total"))


@query("win_bucket_rate", f"{BUCKETS} SELECT service_name, bucket_ms, round(100.0 * errors / total, 6) AS error_rate FROM b")
def win_bucket_rate(spark, sf_dir):
    return metrics.bucket_error_rate(_buckets(spark, sf_dir)).select("service_name", "bucket_ms", F.round("error_rate", 6).alias("error_rate"))


@query("win_summary", f"{SUMMARY} SELECT * FROM s")
def win_summary(spark, sf_dir):
    return metrics.ranked(metrics.summaries(_active(spark, sf_dir), 1440))


@query("win_sliding", f"""{BUCKETS}, w AS (SELECT service_name, bucket_ms, {', '.join(f'CAST(sum({c}) OVER f AS BIGINT) AS window_{c}' for c in metrics.COUNTS)}, count(*) OVER f AS window_buckets FROM b WINDOW f AS (PARTITION BY service_name ORDER BY bucket_ms RANGE BETWEEN {23 * BUCKET} PRECEDING AND CURRENT ROW))
SELECT *, CAST(window_errors * 100 // window_total AS BIGINT) AS error_rate_percent FROM w""")
def win_sliding(spark, sf_dir):
    return metrics.sliding(_buckets(spark, sf_dir), BUCKET, 24)


@query("win_stats", f"{SUMMARY} SELECT count(*) AS active_services, CAST(sum(total_events) AS BIGINT) AS total_events, CAST(sum(total_errors) AS BIGINT) AS total_errors, (SELECT service_name FROM s ORDER BY total_errors DESC, service_name LIMIT 1) AS top_error_service FROM s")
def win_stats(spark, sf_dir):
    return metrics.system_stats(metrics.summaries(_active(spark, sf_dir), 1440))


@query("top_error_service", f"{SUMMARY} SELECT service_name, total_errors FROM s ORDER BY total_errors DESC, service_name LIMIT 1")
def top_error_service(spark, sf_dir):
    return metrics.ranked(metrics.summaries(_active(spark, sf_dir), 1440)).select("service_name", "total_errors").limit(1)


PATTERNS = {
    "pattern_error_rate": ("HIGH_ERROR_RATE", f"SELECT service_name, CAST(sum(errors) * 100 // sum(total) AS BIGINT) AS value FROM a GROUP BY service_name HAVING sum(errors) * 100 // sum(total) >= {RATE} AND sum(total) > 5"),
    "pattern_error_spike": ("ERROR_SPIKE", f"SELECT service_name, arg_min(errors, bucket_ms) AS value FROM a WHERE errors >= {SPIKE} GROUP BY service_name"),
    "pattern_fatal": ("FATAL_DETECTED", "SELECT service_name, CAST(sum(fatals) AS BIGINT) AS value FROM a GROUP BY service_name HAVING sum(fatals) > 0"),
    "pattern_volume_spike": ("VOLUME_SPIKE", f"SELECT service_name, arg_min(total, bucket_ms) AS value FROM (SELECT *, avg(total) OVER p AS m, count(*) OVER p AS n FROM a WINDOW p AS (PARTITION BY service_name)) WHERE n > 2 AND total > m * {FACTOR} AND m > 5 GROUP BY service_name"),
}


def _pattern(name: str, kind: str, sql: str) -> None:
    # Volume spikes need buckets of some size: days over all time instead of hours over a day.
    wide = kind == "VOLUME_SPIKE"
    source = ACTIVE if not wide else BUCKETS.replace(f"% {BUCKET}", f"% {SIX_HOURS}") + ", a AS (SELECT * FROM b)"

    @query(name, f"{source} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = metrics.buckets(read_logs(spark, sf_dir), SIX_HOURS) if wide else _active(spark, sf_dir)
        return metrics.detect_patterns(b, 1440, RATE, SPIKE, FACTOR).filter(F.col("pattern") == kind).select("service_name", "value")


for _name, (_kind, _sql) in PATTERNS.items():
    _pattern(_name, _kind, _sql)


# --- index -----------------------------------------------------------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_SPLIT = DELIMITERS.replace("'", "''")
TOKENS = rf"""{CLASSIFIED}, pieces AS (SELECT event_id, ts_ms, service_name, regexp_split_to_array(lower(message), '{_SPLIT}') AS p FROM logs),
tokens AS (SELECT event_id, ts_ms, service_name, term, CAST(pos AS INTEGER) AS pos FROM (SELECT event_id, ts_ms, service_name, unnest(p) AS term, unnest(range(len(p))) AS pos FROM pieces) WHERE length(term) >= 2 AND term NOT IN ({_STOP}))"""
POSTINGS = rf"""{TOKENS}, postings AS (SELECT term, event_id, ts_ms, service_name, list(pos ORDER BY pos) AS positions FROM tokens GROUP BY ALL
UNION ALL SELECT DISTINCT unnest(['service:' || lower(service_name), 'level:' || lower(level), 'category:' || lower(category)]), event_id, ts_ms, service_name, [0] FROM classified)"""


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], object]) -> str:
    """The path of a dataset that ``write`` makes once for each application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _STORED or not storage.exists(spark, _STORED[key]):
        path = shared_path(spark, label)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index of the logs."""
    return index.read_index(spark, _stored(spark, sf_dir, "index", lambda path: index.write_index(_classified(spark, sf_dir), path)))


@query("idx_tokens", f"{TOKENS} SELECT event_id, term, pos FROM tokens")
def idx_tokens(spark, sf_dir):
    return index.tokens(read_logs(spark, sf_dir)).select("event_id", "term", "pos")


@query("idx_postings", f"{POSTINGS} SELECT term, event_id, ts_ms, array_to_string(positions, ',') AS places FROM postings")
def idx_postings(spark, sf_dir):
    return _index(spark, sf_dir).select("term", "event_id", "ts_ms", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("places"))


@query("idx_top_postings", f"{POSTINGS} SELECT term, event_id, ts_ms, CAST(row_number() OVER (PARTITION BY term ORDER BY ts_ms DESC, event_id) AS INTEGER) AS rank FROM postings QUALIFY rank <= 50")
def idx_top_postings(spark, sf_dir):
    return index.top_postings(_index(spark, sf_dir), 50).select("term", "event_id", "ts_ms", "rank")


@query("idx_stats", f"{POSTINGS} SELECT count(DISTINCT term) AS total_terms FROM postings")
def idx_stats(spark, sf_dir):
    return index.term_count(_index(spark, sf_dir))


@query("idx_range", f"{POSTINGS} SELECT event_id, ts_ms FROM postings WHERE term = 'timeout' AND ts_ms BETWEEN {FROM_MS} AND {TO_MS}")
def idx_range(spark, sf_dir):
    return index.postings_between(_index(spark, sf_dir), "timeout", FROM_MS, TO_MS).select("event_id", "ts_ms")


def _lookup(name: str, text: str, where: str) -> None:
    @query(name, f"{POSTINGS} SELECT event_id FROM postings GROUP BY event_id HAVING {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index.search(_index(spark, sf_dir), text)


_lookup("idx_term", "Timeout", "count_if(term = 'timeout') > 0")
_lookup("idx_and", "payment AND timeout", "count_if(term = 'payment') > 0 AND count_if(term = 'timeout') > 0")
_lookup("idx_or", "timeout OR refused", "count_if(term IN ('timeout', 'refused')) > 0")
_lookup("idx_field_and", "level:ERROR AND service:payment-service", "count_if(term = 'level:error') > 0 AND count_if(term = 'service:payment-service') > 0")
_lookup("idx_unquoted_pair", "payment timeout", "false")


@query("idx_phrase", f"{TOKENS} SELECT DISTINCT a.event_id FROM tokens a JOIN tokens b ON a.event_id = b.event_id AND b.pos = a.pos + 1 WHERE a.term = 'payment' AND b.term = 'gateway'")
def idx_phrase(spark, sf_dir):
    return index.search(_index(spark, sf_dir), '"Payment gateway"')


@query("idx_fetch", f"{LOGS} SELECT {_SHOWN} FROM logs WHERE regexp_matches(message, 'token expired', 'i')")
def idx_fetch(spark, sf_dir):
    logs = read_logs(spark, sf_dir)
    return index.fetch(logs, index.search(_index(spark, sf_dir), '"token expired"')).select(SHOWN)


# --- storage ---------------------------------------------------------------------------------------------------------
_TIER = f"CASE WHEN {AS_OF} - ts_ms <= 3600000 THEN 'HOT' WHEN {AS_OF} - ts_ms <= {20 * DAY_MS} THEN 'WARM' ELSE 'COLD' END"
_WARM = 20 * DAY_MS


@query("store_tier_assign", f"{LOGS} SELECT event_id, CASE WHEN {AS_OF} - ts_ms <= {storage.HOT_MS} THEN 'HOT' WHEN {AS_OF} - ts_ms <= {storage.WARM_MS} THEN 'WARM' WHEN {AS_OF} - ts_ms <= {storage.COLD_MS} THEN 'COLD' END AS storage_tier FROM logs")
def store_tier_assign(spark, sf_dir):
    return storage.label_tier(read_logs(spark, sf_dir), AS_OF).select("event_id", "storage_tier")


@query("store_range", f"{LOGS} SELECT {_SHOWN} FROM logs WHERE service_name = 'auth-service' AND ts_ms BETWEEN {FROM_MS} AND {TO_MS} ORDER BY ts_ms DESC, event_id LIMIT 1000")
def store_range(spark, sf_dir):
    logs = read_logs(spark, sf_dir)
    # The tiers overlap on purpose: the merge returns each event once.
    warm, cold = logs.filter(F.col("ts_ms") >= FROM_MS + DAY_MS), logs.filter(F.col("ts_ms") < FROM_MS + 2 * DAY_MS)
    return storage.between(storage.merge_tiers(warm, cold), "auth-service", FROM_MS, TO_MS).select(SHOWN)


@query("store_recent", f"{LOGS} SELECT {_SHOWN} FROM logs WHERE ts_ms >= (SELECT max(ts_ms) FROM logs) - 3600000 ORDER BY ts_ms DESC, event_id LIMIT 50")
def store_recent(spark, sf_dir):
    logs = read_logs(spark, sf_dir)
    return storage.recent(logs, metrics.as_of_last(logs)).select(SHOWN)


@query("store_hot_live", f"{LOGS} SELECT event_id, ts_ms FROM logs WHERE ts_ms >= (SELECT max(ts_ms) FROM logs) - 3600000")
def store_hot_live(spark, sf_dir):
    logs = read_logs(spark, sf_dir)
    return storage.hot_live(logs, metrics.as_of_last(logs)).select("event_id", "ts_ms")


@query("store_by_id", f"{LOGS} SELECT {_SHOWN} FROM logs WHERE event_id = '77'")
def store_by_id(spark, sf_dir):
    return storage.by_id(read_logs(spark, sf_dir), "77").select(SHOWN)


@query("store_hot_get", f"{LOGS} SELECT {_SHOWN} FROM logs WHERE event_id = '78' AND service_name = (SELECT service_name FROM logs WHERE event_id = '78')")
def store_hot_get(spark, sf_dir):
    logs = read_logs(spark, sf_dir)
    service = logs.filter("event_id = '78'").select("service_name").first()[0]
    return storage.by_key(logs, service, "78").select(SHOWN)


@query("store_archive_plan", f"{LOGS} SELECT coalesce(service_name, 'unknown') AS service_name, count(*) AS rows, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM logs WHERE ts_ms < {AS_OF} - {_WARM} GROUP BY 1")
def store_archive_plan(spark, sf_dir):
    due = storage.to_archive(read_logs(spark, sf_dir), AS_OF, _WARM)
    return due.groupBy(storage.service_or_unknown().alias("service_name")).agg(F.count("*").alias("rows"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"))


@query("store_archive_batch", f"{LOGS} SELECT event_id, ts_ms FROM logs WHERE ts_ms < {AS_OF} - {_WARM} ORDER BY ts_ms, event_id LIMIT 1000")
def store_archive_batch(spark, sf_dir):
    return storage.to_archive(read_logs(spark, sf_dir), AS_OF, _WARM, storage.ARCHIVE_BATCH).select("event_id", "ts_ms")


@query("store_survivors", f"{LOGS} SELECT event_id, ts_ms FROM logs WHERE ts_ms >= {AS_OF} - {_WARM}")
def store_survivors(spark, sf_dir):
    return storage.survivors(read_logs(spark, sf_dir), AS_OF, _WARM).select("event_id", "ts_ms")


@query("store_cold_roundtrip", f"{LOGS} SELECT event_id, ts_ms, service_name, level, message FROM logs WHERE ts_ms < {AS_OF} - {_WARM}")
def store_cold_roundtrip(spark, sf_dir):
    _, cold = _archived(spark, sf_dir, "cold-roundtrip")
    return cold.read().select("event_id", "ts_ms", "service_name", "level", "message")


def _archived(spark: SparkSession, sf_dir: str, label: str, batches: tuple[int | None, ...] = (None,)) -> tuple[str, storage.ColdStore]:
    """A new warm tier with all logs, and the cold tier to which runs of the tiering job have moved what was due."""
    warm, cold = shared_path(spark, f"{label}-warm"), storage.ColdStore(spark, shared_path(spark, label))
    storage.write_warm(read_logs(spark, sf_dir), warm)
    for run, batch in enumerate(batches):
        storage.archive(spark, warm, cold, run, AS_OF, _WARM, batch)
    return warm, cold


@query("store_warm_delete", f"{LOGS} SELECT event_id, ts_ms, message FROM logs WHERE ts_ms >= {AS_OF} - {_WARM}")
def store_warm_delete(spark, sf_dir):
    warm, _ = _archived(spark, sf_dir, "warm-delete")
    return spark.read.parquet(warm).select("event_id", "ts_ms", "message")


@query("store_archive_runs", f"""{LOGS}, n AS (SELECT *, row_number() OVER (ORDER BY ts_ms, event_id) AS n FROM logs WHERE ts_ms < {AS_OF} - {_WARM})
SELECT event_id, ts_ms, 'cold' AS tier FROM n WHERE n <= 150 UNION ALL SELECT event_id, ts_ms, 'warm' FROM n WHERE n > 150 UNION ALL SELECT event_id, ts_ms, 'warm' FROM logs WHERE ts_ms >= {AS_OF} - {_WARM}""")
def store_archive_runs(spark, sf_dir):
    """Two runs of 100 and 50 rows: the oldest are cold, all others still warm."""
    warm, cold = _archived(spark, sf_dir, "archive-runs", (100, 50))
    tiers = {"cold": cold.read(), "warm": spark.read.parquet(warm)}
    both = [df.select("event_id", "ts_ms", F.lit(name).alias("tier")) for name, df in tiers.items()]
    return both[0].unionByName(both[1])


@query("store_expire_apply", f"{LOGS} SELECT event_id, ts_ms FROM logs WHERE ts_ms < {AS_OF} - {_WARM} AND ts_ms >= {AS_OF} - {25 * DAY_MS}")
def store_expire_apply(spark, sf_dir):
    """The retention ends at midnight, so whole days go."""
    _, cold = _archived(spark, sf_dir, "expire-apply")
    cold.expire(AS_OF, 25 * DAY_MS)
    return cold.read().select("event_id", "ts_ms")


def _cold(spark: SparkSession, sf_dir: str) -> storage.ColdStore:
    """A cold tier of all logs."""
    return storage.ColdStore(spark, _stored(spark, sf_dir, "cold-all", lambda path: storage.ColdStore(spark, path).append(read_logs(spark, sf_dir), 0)))


@query("store_cold_range", f"{LOGS} SELECT {_SHOWN} FROM logs WHERE service_name = 'auth-service' AND ts_ms BETWEEN {FROM_MS} AND {TO_MS}")
def store_cold_range(spark, sf_dir):
    return _cold(spark, sf_dir).read_range("auth-service", FROM_MS, TO_MS).select(SHOWN)


MANIFEST = f"{LOGS}, m AS (SELECT service_name, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS event_date, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS rows FROM logs GROUP BY ALL)"


@query("store_manifest", f"{MANIFEST} SELECT *, 'service_name=' || service_name || '/event_date=' || event_date AS path FROM m")
def store_manifest(spark, sf_dir):
    return _days(spark, sf_dir)


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.manifest_of_days(_cold(spark, sf_dir).manifest())


@query("store_manifest_prune", f"{MANIFEST} SELECT event_date, min_ts, max_ts FROM m WHERE service_name = 'auth-service' AND min_ts <= {TO_MS} AND max_ts >= {FROM_MS}")
def store_manifest_prune(spark, sf_dir):
    return storage.overlapping(_days(spark, sf_dir), "auth-service", FROM_MS, TO_MS).select("event_date", "min_ts", "max_ts")


@query("store_expire", f"{MANIFEST} SELECT service_name, event_date FROM m WHERE max_ts < {AS_OF} - {25 * DAY_MS}")
def store_expire(spark, sf_dir):
    return storage.expired(_days(spark, sf_dir), AS_OF, 25 * DAY_MS).select("service_name", "event_date")


@query("store_segment_count", f"{MANIFEST} SELECT count(*) AS segments FROM m")
def store_segment_count(spark, sf_dir):
    return storage.segment_count(_days(spark, sf_dir))


# --- alerts ----------------------------------------------------------------------------------------------------------
METRICS = f"""{LOGS.replace('WITH', 'WITH RECURSIVE', 1)}, met AS (SELECT service_name, ts_ms - ts_ms % {SIX_HOURS} AS bucket_ms, count(*) AS total, CAST(count_if(level IN ('ERROR', 'FATAL')) AS BIGINT) AS errors, CAST(count_if(level = 'FATAL') AS BIGINT) AS fatals, count_if(level IN ('ERROR', 'FATAL')) * 100.0::DOUBLE / count(*) AS error_rate FROM logs GROUP BY 1, 2),
rules(rule_id, metric_type, threshold, use_ewma) AS (VALUES ('rule-error-rate-global', 'ERROR_RATE_PERCENT', {THRESHOLD}::DOUBLE, false), ('rule-ewma-anomaly', 'ERROR_RATE_PERCENT', 0.0::DOUBLE, true), ('rule-fatal-events', 'FATAL_COUNT', 1.0::DOUBLE, false)),
read AS (SELECT rule_id, service_name, bucket_ms, threshold, use_ewma, CASE WHEN metric_type = 'FATAL_COUNT' THEN fatals::DOUBLE ELSE error_rate END AS value, row_number() OVER (PARTITION BY rule_id, service_name ORDER BY bucket_ms) AS n FROM met, rules),
fold AS (SELECT rule_id, service_name, bucket_ms, n, value, value AS mean, 0.0::DOUBLE AS variance FROM read WHERE n = 1
 UNION ALL SELECT r.rule_id, r.service_name, r.bucket_ms, r.n, r.value, f.mean + {ALPHA}::DOUBLE * (r.value - f.mean), (1::DOUBLE - {ALPHA}::DOUBLE) * (f.variance + {ALPHA}::DOUBLE * (r.value - f.mean) * (r.value - f.mean)) FROM fold f JOIN read r ON r.rule_id = f.rule_id AND r.service_name = f.service_name AND r.n = f.n + 1),
scored AS (SELECT f.*, r.threshold, r.use_ewma, f.n >= 10 AND (f.value > mean + 3.0::DOUBLE * sqrt(variance) OR f.value < mean - 3.0::DOUBLE * sqrt(variance)) AS anomaly FROM fold f JOIN read r USING (rule_id, service_name, n)),
hit AS (SELECT *, CASE WHEN use_ewma THEN anomaly ELSE value >= threshold END AS breached FROM scored),
fsm AS (SELECT rule_id, service_name, bucket_ms, n, value, CASE WHEN breached THEN 'PENDING' ELSE 'INACTIVE' END AS state, CASE WHEN breached THEN 1 ELSE 0 END AS br, 0 AS ok, CASE WHEN breached THEN bucket_ms END AS since_ms, CAST(NULL AS VARCHAR) AS event FROM hit WHERE n = 1
 UNION ALL SELECT rule_id, service_name, bucket_ms, n, value, state, br, ok, CASE WHEN state <> old THEN bucket_ms ELSE since_ms END, CASE WHEN state <> old AND state IN ('FIRING', 'RESOLVED') THEN state END FROM (
  SELECT h.rule_id, h.service_name, h.bucket_ms, h.n, h.value, f.state AS old, f.since_ms,
   CASE f.state WHEN 'INACTIVE' THEN CASE WHEN h.breached THEN 'PENDING' ELSE 'INACTIVE' END WHEN 'PENDING' THEN CASE WHEN NOT h.breached THEN 'INACTIVE' WHEN f.br + 1 >= 3 THEN 'FIRING' ELSE 'PENDING' END WHEN 'FIRING' THEN CASE WHEN NOT h.breached AND f.ok + 1 >= 5 THEN 'RESOLVED' ELSE 'FIRING' END ELSE 'INACTIVE' END AS state,
   CASE f.state WHEN 'INACTIVE' THEN CASE WHEN h.breached THEN 1 ELSE f.br END WHEN 'PENDING' THEN CASE WHEN h.breached THEN f.br + 1 ELSE 0 END WHEN 'RESOLVED' THEN 0 ELSE f.br END AS br,
   CASE f.state WHEN 'FIRING' THEN CASE WHEN h.breached THEN 0 ELSE f.ok + 1 END WHEN 'RESOLVED' THEN 0 ELSE f.ok END AS ok
  FROM fsm f JOIN hit h ON h.rule_id = f.rule_id AND h.service_name = f.service_name AND h.n = f.n + 1))"""
LATEST = f"{METRICS}, latest AS (SELECT * FROM fsm QUALIFY row_number() OVER (PARTITION BY rule_id, service_name ORDER BY n DESC) = 1)"


def _rules(spark: SparkSession) -> DataFrame:
    return alerts.default_rules(spark, THRESHOLD)


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.readings(alerts.service_metrics(read_logs(spark, sf_dir), SIX_HOURS), _rules(spark))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.evaluate(_readings(spark, sf_dir), ALPHA)


@query("alert_metrics", f"{METRICS} SELECT service_name, bucket_ms, total, errors, fatals, round(error_rate, 6) AS error_rate FROM met")
def alert_metrics(spark, sf_dir):
    return alerts.service_metrics(read_logs(spark, sf_dir), SIX_HOURS).withColumn("error_rate", F.round("error_rate", 6))


@query("alert_rule_match", f"{METRICS} SELECT rule_id, service_name, bucket_ms, round(value, 6) AS value FROM read")
def alert_rule_match(spark, sf_dir):
    return _readings(spark, sf_dir).select("rule_id", "service_name", "bucket_ms", F.round("value", 6).alias("value"))


_SCOPED = [("fatal-pay", "Fatal payments", "payment-service", "FATAL_COUNT", 1.0), ("volume", "Volume", None, "TOTAL_VOLUME", 20.0), ("errors-auth", "Errors", "auth-service", "ERROR_COUNT", 5.0)]


@query("alert_scoped_rules", f"""{METRICS}, scoped(rule_id, service, metric) AS (VALUES {', '.join(f"('{r}', {f"'{s}'" if s else 'NULL'}, '{m}')" for r, _, s, m, _ in _SCOPED)})
SELECT s.rule_id, m.service_name, m.bucket_ms, CAST(CASE metric WHEN 'FATAL_COUNT' THEN fatals WHEN 'TOTAL_VOLUME' THEN total ELSE errors END AS DOUBLE) AS value FROM met m JOIN scoped s ON s.service IS NULL OR s.service = m.service_name""")
def alert_scoped_rules(spark, sf_dir):
    """Rules for one service and for all, after a publication and a reading back."""
    path = shared_path(spark, "rules")
    rules = spark.createDataFrame([(*r, False, 3.0, "LOG_ONLY", "ops", True) for r in _SCOPED], alerts.RULE_SCHEMA)
    alerts.publish_rules(alerts.default_rules(spark), path)
    alerts.publish_rules(rules, path)
    found = alerts.readings(alerts.service_metrics(read_logs(spark, sf_dir), SIX_HOURS), alerts.read_rules(spark, path))
    return found.select("rule_id", "service_name", "bucket_ms", "value")


@query("alert_threshold", f"{METRICS} SELECT rule_id, service_name, bucket_ms, value >= threshold AS breached FROM read WHERE NOT use_ewma")
def alert_threshold(spark, sf_dir):
    return _readings(spark, sf_dir).filter("NOT use_ewma").select("rule_id", "service_name", "bucket_ms", (F.col("value") >= F.col("threshold")).alias("breached"))


@query("alert_ewma", f"{METRICS} SELECT service_name, bucket_ms, round(mean, 6) AS mean, round(variance, 6) AS variance, anomaly FROM scored WHERE rule_id = 'rule-ewma-anomaly'")
def alert_ewma(spark, sf_dir):
    out = _evaluated(spark, sf_dir).filter("rule_id = 'rule-ewma-anomaly'")
    return out.select("service_name", "bucket_ms", F.round("ewma_mean", 6).alias("mean"), F.round("ewma_variance", 6).alias("variance"), "anomaly")


_FSM = "SELECT rule_id, service_name, bucket_ms, state, coalesce(event, '') AS event, coalesce(since_ms, 0) AS since_ms FROM fsm"


def _fsm_columns(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("rule_id", "service_name", "bucket_ms", "state", F.coalesce("event", F.lit("")).alias("event"), F.coalesce("since_ms", F.lit(0)).alias("since_ms"))


@query("alert_fsm", f"{METRICS} {_FSM}")
def alert_fsm(spark, sf_dir):
    return _fsm_columns(_evaluated(spark, sf_dir))


@query("alert_status", f"{LATEST} SELECT count(*) AS total_instances, CAST(count_if(state = 'FIRING') AS BIGINT) AS firing, CAST(count_if(state = 'PENDING') AS BIGINT) AS pending, CAST(count_if(state = 'INACTIVE') AS BIGINT) AS inactive, 3::BIGINT AS total_rules FROM latest")
def alert_status(spark, sf_dir):
    return alerts.status(alerts.latest(_evaluated(spark, sf_dir)), _rules(spark))


@query("alert_active", f"{LATEST} SELECT rule_id, service_name, state, round(value, 6) AS last_value, since_ms FROM latest WHERE state = 'FIRING'")
def alert_active(spark, sf_dir):
    out = alerts.firing(alerts.latest(_evaluated(spark, sf_dir)), _rules(spark))
    return out.select("rule_id", "service_name", "state", F.round("last_value", 6).alias("last_value"), "since_ms")


@query(
    "alert_notify",
    f"""{METRICS}, names(rule_id, rule_name, threshold) AS (VALUES ('rule-error-rate-global', 'High Error Rate', {THRESHOLD}::DOUBLE), ('rule-ewma-anomaly', 'Statistical Anomaly (EWMA)', 0.0::DOUBLE), ('rule-fatal-events', 'Fatal Events Detected', 1.0::DOUBLE))
SELECT rule_id, service_name, bucket_ms AS ts_ms, event AS type, 'NOTIFICATION → ' || CASE WHEN event = 'FIRING' THEN '🔴 [ALERT FIRING] ' ELSE '✅ [ALERT RESOLVED] ' END || rule_name || ' — service: ' || service_name AS text FROM fsm JOIN names USING (rule_id) WHERE event IS NOT NULL""",
)
def alert_notify(spark, sf_dir):
    out = alerts.notifications(alerts.events(_evaluated(spark, sf_dir), _rules(spark)))
    # The figures after the service are rounded half up here and half even in SQL, so they are left to a unit test.
    return out.select("rule_id", "service_name", "ts_ms", "type", F.substring_index("text", " | ", 1).alias("text"))


# --- live tail -------------------------------------------------------------------------------------------------------
@query("tail_route", f"{LOGS} SELECT event_id, '/topic/logs' AS topic FROM logs UNION ALL SELECT event_id, '/topic/logs/' || service_name FROM logs UNION ALL SELECT event_id, '/topic/logs/errors' FROM logs WHERE level IN ('ERROR', 'FATAL')")
def tail_route(spark, sf_dir):
    return tail.route(read_logs(spark, sf_dir)).select("event_id", "topic")


@query("tail_filter", f"{LOGS} SELECT {_SHOWN} FROM logs WHERE level = 'ERROR' AND contains(lower(service_name), 'pay') ORDER BY ts_ms DESC, event_id LIMIT 500")
def tail_filter(spark, sf_dir):
    return tail.view(read_logs(spark, sf_dir), "ERROR", "PAY").select(SHOWN)


@query("tail_counters", f"{LOGS} SELECT count(*) AS total, CAST(count_if(level IN ('ERROR', 'FATAL')) AS BIGINT) AS errors FROM logs")
def tail_counters(spark, sf_dir):
    return tail.counters(read_logs(spark, sf_dir))


# --- streaming -------------------------------------------------------------------------------------------------------
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(engine.stream_of(spark, f"{sf_dir}/events.parquet"))


def _run(stream: DataFrame, label: str, mode: str = "append") -> str:
    path, checkpoint = shared_path(stream.sparkSession, label), shared_path(stream.sparkSession, f"{label}-checkpoint")
    engine.to_folder(stream, path, checkpoint, mode).awaitTermination()
    return path


@query("stream_dedup", f"{LOGS} SELECT event_id, ts_ms, service_name FROM logs")
def stream_dedup(spark, sf_dir):
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    path = _run(engine.deduplicate(twice, "40 days"), "stream-dedup")
    return spark.read.parquet(path).select("event_id", "ts_ms", "service_name")


@query("stream_ingest", f"{CLASSIFIED}, c AS (SELECT *, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS city FROM classified) SELECT event_id, service_name, level, category, {_geo_sql('country', '2')} FROM c")
def stream_ingest(spark, sf_dir):
    logs = _stream(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("category", "country", "city")})
    path = _run(engine.ingest_stream(logs, "40 days"), "stream-ingest")
    return spark.read.parquet(path).select("event_id", "service_name", "level", "category", F.col("country").alias("country2"))


@query("stream_windows", f"{BUCKETS.replace(f'% {BUCKET}', f'% {DAY_MS}')} SELECT service_name, bucket_ms AS window_ms, total, errors, warns, fatals, infos FROM b")
def stream_windows(spark, sf_dir):
    path = _run(engine.window_counts(_stream(spark, sf_dir), "1 day", "1 day", "40 days"), "stream-windows", "update")
    return engine.newest_per_key(spark, path, ("service_name", "window_ms"))


@query("stream_alerts", f"{METRICS} {_FSM}")
def stream_alerts(spark, sf_dir):
    source = shared_path(spark, "stream-readings")
    _readings(spark, sf_dir).select("rule_id", "service_name", "bucket_ms", "value", "use_ewma", "threshold", "ewma_sensitivity").write.parquet(source)
    with engine.rocksdb_state(spark):
        path = _run(engine.alert_stream(engine.stream_of(spark, source), alpha=ALPHA), "stream-alerts")
    return _fsm_columns(spark.read.parquet(path))


#: Rows of a file of a part, roughly.
PART_FILE_ROWS = 250_000


def _parts_stream(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """The logs as a stream of ``parts`` micro-batches, in order of time, however many files the table has.

    Each part is written after the one before it and has as many files as any other, so that a micro-batch is a part. If one
    held some files of a part only, the watermark would pass the rows of the others, and batches would grow in number with the input.
    """

    def write(path: str) -> None:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        ends = events.select(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"), F.count("*").alias("n")).first()
        files = max(1, -(-ends.n // (parts * PART_FILE_ROWS)))
        for k in range(parts):
            low, high = (ends.a + (ends.b - ends.a) * x / parts for x in (k, k + 1))
            at = F.col("ts").cast("timestamp")
            part = events.filter((at >= F.lit(low)) & ((at < F.lit(high)) if k < parts - 1 else F.lit(True)))
            part.repartition(files).write.mode("append").parquet(path)
            # A part of few rows may have left out empty files.
            for _ in range((k + 1) * files - len(spark.read.parquet(path).inputFiles())):
                events.limit(0).coalesce(1).write.mode("append").parquet(path)

    path = _stored(spark, sf_dir, "events-parts", write)
    return logs_from_events(engine.stream_of(spark, path, files_per_trigger=len(spark.read.parquet(path).inputFiles()) // parts))


#: What the watermark of an hour has passed at the end of the test events.
_CLOSED = f"(SELECT max(ts_ms) FROM logs) - {HOUR_MS}"


@query("stream_sliding", f"""{BUCKETS}, k AS (SELECT unnest(range(6)) AS k), w AS (SELECT b.*, bucket_ms - k * {BUCKET} AS window_ms FROM b, k)
SELECT service_name, window_ms, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in metrics.COUNTS)} FROM w WHERE window_ms + {SIX_HOURS} <= {_CLOSED} GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    """Six-hour windows every hour, each once the watermark has passed it."""
    path = _run(engine.window_counts(_parts_stream(spark, sf_dir), "6 hours", "1 hour", "1 hour"), "stream-sliding")
    return spark.read.parquet(path).drop("batch_id")


_WIDE = BUCKETS.replace(f"% {BUCKET}", f"% {SIX_HOURS}")
_FOUND = " UNION ALL ".join(
    f"SELECT service_name, window_ms, '{kind}' AS pattern, {value} AS value FROM g WHERE {when}"
    for kind, value, when in (
        ("HIGH_ERROR_RATE", "CAST(errors * 100 // total AS BIGINT)", f"errors * 100 // total >= {RATE} AND total > 5"),
        ("ERROR_SPIKE", "spike", "spike IS NOT NULL"),
        ("FATAL_DETECTED", "CAST(fatals AS BIGINT)", "fatals > 0"),
        ("VOLUME_SPIKE", "burst", "burst IS NOT NULL"),
    )
)


@query("stream_patterns", f"""{_WIDE}, k AS (SELECT unnest(range(4)) AS k), a AS (SELECT b.*, bucket_ms - k * {SIX_HOURS} AS window_ms FROM b, k),
m AS (SELECT *, avg(total) OVER p AS mean, count(*) OVER p AS n FROM a WINDOW p AS (PARTITION BY service_name, window_ms)),
g AS (SELECT service_name, window_ms, sum(total) AS total, sum(errors) AS errors, sum(fatals) AS fatals, arg_min(errors, bucket_ms) FILTER (WHERE errors >= {SPIKE}) AS spike, arg_min(total, bucket_ms) FILTER (WHERE total > mean * {FACTOR} AND mean > 5 AND n > 2) AS burst FROM m WHERE window_ms + {DAY_MS} <= {_CLOSED} GROUP BY ALL)
{_FOUND}""")
def stream_patterns(spark, sf_dir):
    """Day-long windows every six hours, over buckets of six hours."""
    found = engine.patterns(_parts_stream(spark, sf_dir), "6 hours", "1 day", "6 hours", "1 hour", 1440, rate=RATE, spike=SPIKE, factor=FACTOR)
    return spark.read.parquet(_run(found, "stream-patterns")).select("service_name", "window_ms", "pattern", "value")


@query("stream_rejects", f"{_FAULTY} SELECT event_id, reason FROM judged WHERE reason IS NOT NULL")
def stream_rejects(spark, sf_dir):
    return spark.read.parquet(_ingested(spark, sf_dir)["bad"]).select("event_id", "reason")


@query("stream_counters", f"{_FAULTY} SELECT count(*) AS unique_, count_if(reason IS NOT NULL)::BIGINT AS rejected FROM judged")
def stream_counters(spark, sf_dir):
    counts = spark.read.parquet(_ingested(spark, sf_dir)["counts"])
    return counts.agg(F.sum("unique").alias("unique_"), F.sum("rejected").alias("rejected"))


def _ingested(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Every record twice through ingestion with a dead-letter sink, in several micro-batches."""
    at = {name: shared_path(spark, f"stream-{name}") for name in ("good", "bad", "counts", "checkpoint")}
    logs = _with_faults(_parts_stream(spark, sf_dir)).withColumns({c: F.lit(None).cast("string") for c in ("category", "country", "city")})
    twice = logs.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    engine.with_dead_letters(twice, at["good"], at["bad"], at["checkpoint"], at["counts"], "3000 days").awaitTermination()
    return at


@query("stream_index", f"{POSTINGS} SELECT term, event_id, ts_ms, array_to_string(positions, ',') AS places FROM postings WHERE term IN ('timeout', 'level:fatal', 'gateway')")
def stream_index(spark, sf_dir):
    path, checkpoint = shared_path(spark, "stream-index"), shared_path(spark, "stream-index-checkpoint")
    logs = ingest.classify(_parts_stream(spark, sf_dir).withColumn("category", F.lit(None).cast("string")))
    engine.index_stream(logs, path, checkpoint, 16).awaitTermination()
    found = index.of_terms(index.read_index(spark, path), ["timeout", "level:fatal", "gateway"])
    return found.select("term", "event_id", "ts_ms", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("places"))


@query("stream_tail", f"{LOGS} SELECT event_id, '/topic/logs' AS topic FROM logs UNION ALL SELECT event_id, '/topic/logs/' || service_name FROM logs UNION ALL SELECT event_id, '/topic/logs/errors' FROM logs WHERE level IN ('ERROR', 'FATAL')")
def stream_tail(spark, sf_dir):
    path, checkpoint = shared_path(spark, "stream-tail"), shared_path(spark, "stream-tail-checkpoint")
    push = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")
    engine.live_tail(_parts_stream(spark, sf_dir), push, checkpoint, None).awaitTermination()
    return spark.read.parquet(path).select("event_id", "topic")


@query("stream_tiers", f"{LOGS} SELECT event_id, 'hot' AS tier, 'HOT' AS storage_tier, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS event_date FROM logs UNION ALL SELECT event_id, 'warm', 'HOT', strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') FROM logs")
def stream_tiers(spark, sf_dir):
    """Every record goes to the hot and to the warm tier."""
    hot, warm, checkpoint = (shared_path(spark, f"stream-tiers-{x}") for x in ("hot", "warm", "checkpoint"))
    engine.route_tiers(_parts_stream(spark, sf_dir), hot, warm, checkpoint, None).awaitTermination()
    both = [spark.read.parquet(path).select("event_id", F.lit(tier).alias("tier"), "storage_tier", F.col("event_date").cast("string").alias("event_date")) for tier, path in (("hot", hot), ("warm", warm))]
    return both[0].unionByName(both[1])


@query("stream_json", f"{LOGS} SELECT event_id, ts_ms, service_name, level, message FROM logs")
def stream_json(spark, sf_dir):
    """Raw records from a folder of JSON lines."""
    folder = _stored(spark, sf_dir, "raw-json", lambda path: to_messages(read_logs(spark, sf_dir)).select("value").write.text(path))
    return spark.read.parquet(_run(stream_json_logs(spark, folder), "stream-json")).select("event_id", "ts_ms", "service_name", "level", "message")


@query("stream_alerts_chained", f"{METRICS} {_FSM} WHERE bucket_ms + {SIX_HOURS} <= {_CLOSED}")
def stream_alerts_chained(spark, sf_dir):
    """Records, metrics, readings and alert states in one stream of several micro-batches."""
    with engine.rocksdb_state(spark):
        path = _run(engine.alert_chain(_parts_stream(spark, sf_dir), _rules(spark), "6 hours", "1 hour", alpha=ALPHA), "stream-alerts-chained")
    return _fsm_columns(spark.read.parquet(path))
