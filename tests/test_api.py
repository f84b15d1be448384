from pyspark.sql import Observation

from cindermill.api import LogEngine
from cindermill.operators import alerts, index, ingest, storage
from cindermill.schema import DAY_MS
from cindermill.sources.logs import bulk_fixture


def test_all_entry_points(spark):
    logs = ingest.Pipeline()(bulk_fixture(spark)).cache()
    cold = logs.filter("event_id < 'e03'").unionByName(logs.filter("event_id = 'e03'").withColumns({"ts_ms": logs.ts_ms - 40 * DAY_MS, "event_id": logs.trace_id}))
    engine = LogEngine(logs, cold)
    assert engine.query("timeout").count() == 2 and engine.hits("level:ERROR").first().hits == 6
    assert engine.explain_query("a OR b:c") == {"raw_query": "a OR b:c", "operator": "OR", "clauses": [{"type": "TEXT", "field": "message", "value": "a"}, {"type": "FIELD", "field": "b", "value": "c"}]}
    assert engine.search("payment AND timeout").count() == 1 and engine.search_records("refund").first().event_id == "e10"
    assert engine.index_stats().first().total_terms == 45
    assert [r.service_name for r in engine.summaries().collect()] == ["auth-service", "payment-service", "order-service"]
    assert engine.summary("order-service").first().total_events == 2 and engine.summary("o'x").count() == 0
    assert engine.stats().first().active_services == 3 and engine.patterns().first().pattern == "FATAL_DETECTED"
    assert engine.logs_between("auth-service", 0, engine.as_of_ms).count() == 4
    assert engine.recent(3).count() == 3 and engine.by_id("e04").count() == 1 and engine.by_id("e04", "x").count() == 0
    assert engine.rules().count() == 3
    engine.add_rule(spark.createDataFrame([("v", "Volume", None, "TOTAL_VOLUME", 1.0, False, 3.0, "SLACK", "#x", True)], alerts.RULE_SCHEMA))
    assert engine.alert_status().first().asDict() == {"total_instances": 12, "firing": 0, "pending": 7, "inactive": 5, "total_rules": 4}
    assert engine.active_alerts().count() == 0 and engine.notifications().count() == 0


def test_stored_index_and_cold_store(spark, tmp_path):
    logs = ingest.Pipeline()(bulk_fixture(spark)).cache()
    cold = storage.ColdStore(spark, str(tmp_path / "cold"))
    cold.append(logs.withColumns({"ts_ms": logs.ts_ms - 40 * DAY_MS, "event_id": logs.trace_id}), 0)
    index.write_index(logs, str(tmp_path / "index"))
    engine = LogEngine(logs, cold, stored_index=str(tmp_path / "index"))
    assert engine.index_stats().first().total_terms == 45 and engine.search("payment AND timeout").count() == 1
    assert engine.logs_between("auth-service", 0, engine.as_of_ms).count() == 6 and engine.query("timeout").count() == 4
    assert engine.logs_between("auth-service", engine.as_of_ms - DAY_MS, engine.as_of_ms).count() == 3
    assert engine.streams().columns[0] == "name" and engine.streams().count() == 0


def test_rules_are_replaced_as_a_whole(spark, tmp_path):
    """A reader finds the old rules until the new version is finished, and old versions stay for a while."""
    path = str(tmp_path / "rules")
    rules = alerts.default_rules(spark)
    alerts.publish_rules(rules, path)
    early = alerts.read_rules(spark, path)
    alerts.publish_rules(rules.limit(2), path)
    assert alerts.read_rules(spark, path).count() == 2 and early.count() == 3
    (tmp_path / "rules" / "version=000000000009-broken").mkdir()
    assert alerts.read_rules(spark, path).count() == 2
    alerts.publish_rules(rules.limit(1), path)
    assert alerts.read_rules(spark, path).count() == 1 and len(list((tmp_path / "rules").glob("version=*/_SUCCESS"))) == 2
    rules.write.json(str(tmp_path / "plain"))
    assert alerts.read_rules(spark, str(tmp_path / "plain")).count() == 3


def test_observed_counters(spark):
    seen = Observation("ingest")
    assert ingest.observed(bulk_fixture(spark).withColumn("message", ingest.F.when(ingest.F.col("event_id") != "e01", ingest.F.col("message"))), seen).count() == 10
    assert seen.get == {"received": 10, "without_id": 0, "rejected": 1}
