from pyspark.sql import functions as F

from cindermill.operators import ingest
from cindermill.schema import LOG_SCHEMA, complete
from cindermill.sources.logs import bulk_fixture, read_json_logs, stamp, to_messages


def logs(spark, rows, columns):
    return complete(spark.createDataFrame(rows, columns))


def test_dedup_keeps_the_first_and_all_without_id(spark):
    df = logs(spark, [("a", 1, 5), ("a", 0, 9), ("b", 0, 1), (None, 0, 2), (None, 0, 3), ("  ", 1, 1), ("  ", 1, 2)], "event_id string, kafka_partition int, kafka_offset long")
    out = ingest.deduplicate(df)
    assert sorted((r.event_id or "-", r.kafka_partition, r.kafka_offset) for r in out.collect()) == [("  ", 1, 1), ("  ", 1, 2), ("-", 0, 2), ("-", 0, 3), ("a", 0, 9), ("b", 0, 1)]
    assert ingest.deduplicate(out).count() == out.count()


def test_a_bounded_buffer_drops_the_newest(spark):
    import pytest

    assert [r.event_id for r in ingest.buffered(bulk_fixture(spark), 4).collect()] == ["e01", "e02", "e03", "e04"]
    with pytest.raises(ValueError, match="power of two"):
        ingest.buffered(bulk_fixture(spark), 10)


def test_similar_ids_are_not_duplicates(spark):
    df = logs(spark, [("evt-001", 0, 1), ("evt-999", 0, 2)], "event_id string, kafka_partition int, kafka_offset long")
    assert ingest.deduplicate(df).count() == 2


def test_an_invalid_first_record_uses_up_its_id(spark):
    df = logs(spark, [("a", 0, 1, "s", None, "INFO", 1_600_000_000_000), ("a", 0, 2, "s", "m", "INFO", 1_600_000_000_000)], "event_id string, kafka_partition int, kafka_offset long, service_name string, message string, level string, ts_ms long")
    assert ingest.Pipeline()(df).count() == 0


def test_validation_borders(spark):
    rows = [("s", "m", "INFO", 1_577_836_799_999), ("s", "m", "INFO", 1_577_836_800_000), (" ", "m", "INFO", 2_000_000_000_000), ("s", "\t", "INFO", 2_000_000_000_000), ("s", "m", None, 2_000_000_000_000), (None, None, None, None)]
    df = logs(spark, rows, "service_name string, message string, level string, ts_ms long")
    assert [r.ts_ms for r in ingest.validate(df).collect()] == [1_577_836_800_000]
    assert sorted(r.reason for r in ingest.rejects(df).collect()) == ["missing level", "missing message", "missing service_name", "missing service_name", "timestamp before 2020"]


def test_geo(spark):
    rows = [(None, None), ("8.8.8.8", None), ("10.0.0.1", "DE"), ("127.0.0.1", None), ("0:0:0:0:0:0:0:1", None), ("192.168.1.1", None), ("52.0.0.1", None), ("1.52.0.0", None)]
    out = ingest.enrich_geo(logs(spark, rows, "source_ip string, country string"))
    assert [(r.country, r.city) for r in out.collect()] == [(None, None), ("UNKNOWN", "UNKNOWN"), ("DE", None), (None, None), (None, None), ("IN", "Pune"), ("US", "Virginia"), ("UNKNOWN", "UNKNOWN")]


def test_categories_of_the_bulk_fixture(spark):
    out = ingest.Pipeline()(bulk_fixture(spark)).orderBy("event_id")
    assert [r.category for r in out.collect()] == [
        "APPLICATION_LOG", "EXTERNAL_CALL_FAILURE", "SECURITY_EVENT", "APPLICATION_LOG", "APPLICATION_LOG", "EXTERNAL_CALL_FAILURE", "JVM_ERROR", "DATABASE_ERROR", "SECURITY_EVENT", "APPLICATION_LOG",
    ]
    assert {(r.country, r.city) for r in out.collect()} == {("IN", "Mumbai")}


def test_classification_keeps_a_category_and_falls_back(spark):
    rows = [("sql", None, "MINE"), ("sql", None, "  "), ("x", "at Foo", None), ("x", " ", None), (None, None, None)]
    out = ingest.classify(logs(spark, rows, "message string, stack_trace string, category string"))
    assert [r.category for r in out.collect()] == ["MINE", "DATABASE_ERROR", "EXCEPTION", "APPLICATION_LOG", "APPLICATION_LOG"]


def test_http_capture(spark):
    rows = [("GET", p, s, 1, 5, "10.0.0.1", t) for p, s, t in (("/a", 200, "t"), ("/a", 399, " "), ("/a", 400, None), ("/a", 499, "t"), ("/a", 500, "t"), ("/healthz", 500, "t"))]
    df = spark.createDataFrame(rows, "method string, path string, status int, start_ms long, duration_ms long, remote_addr string, x_trace_id string")
    out = ingest.capture_http(df).collect()
    assert [r.level for r in out] == ["INFO", "INFO", "WARN", "WARN", "ERROR"]
    assert out[0].message == "GET /a → 200 (5ms)" and out[0].trace_id == "t" and len(out[1].trace_id) == 36
    assert out[0].tags == {"method": "GET", "path": "/a", "status": "200", "duration": "5ms"}
    assert ingest.capture_http(df, minimum="ERROR").count() == 1


def test_pipeline_registry(spark):
    shout = ingest.Pipeline().with_step("shout", lambda df: df.withColumn("message", F.upper("message")), before="classify")
    assert list(shout.steps) == ["dedup", "validate", "geo", "shout", "classify"]
    assert shout(bulk_fixture(spark)).filter("message = upper(message)").count() == 10


def test_messages_leave_out_nulls_and_files_come_back(spark, tmp_path):
    df = bulk_fixture(spark)
    sent = to_messages(df)
    assert '"city"' not in sent.first().value and sent.first().key == "payment-service"
    sent.select("value").write.text(str(tmp_path / "raw"))
    back = read_json_logs(spark, str(tmp_path / "raw"))
    assert back.schema == LOG_SCHEMA and sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    raw = spark.createDataFrame([(r.value, 3, 7) for r in sent.collect()], "value string, partition int, offset long")
    out = stamp(raw.select(F.from_json("value", LOG_SCHEMA).alias("r"), "partition", "offset"))
    assert {(r.kafka_partition, r.kafka_offset) for r in out.collect()} == {(3, 7)} and out.schema.names == LOG_SCHEMA.names


def test_empty_input(spark):
    empty = spark.createDataFrame([], LOG_SCHEMA)
    assert ingest.Pipeline()(empty).count() == 0 and ingest.rejects(empty).count() == 0
