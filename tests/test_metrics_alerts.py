import pytest

from cindermill.operators import alerts, metrics, tail
from cindermill.schema import MINUTE_MS
from cindermill.sources.logs import bulk_fixture

T0 = 1_704_103_200_000


def test_bulk_fixture_metrics(spark):
    df = bulk_fixture(spark)
    b = metrics.buckets(df)
    s = {r.service_name: r for r in metrics.summaries(b).collect()}
    assert {k: (r.total_events, r.total_errors, r.total_warns, r.total_fatals, r.error_rate_percent) for k, r in s.items()} == {"payment-service": (5, 2, 0, 1, 40), "auth-service": (3, 2, 0, 0, 66), "order-service": (2, 1, 1, 0, 50)}
    rates = {r.service_name: r.error_rate for r in alerts.service_metrics(df).collect()}
    assert rates == {"payment-service": 60.0, "auth-service": pytest.approx(200 / 3), "order-service": 50.0}
    assert metrics.system_stats(metrics.summaries(b)).first().asDict() == {"active_services": 3, "total_events": 10, "total_errors": 5, "top_error_service": "auth-service"}
    found = metrics.detect_patterns(b).collect()
    assert [(r.service_name, r.pattern, r.value, r.description) for r in found] == [("payment-service", "FATAL_DETECTED", 1, "1 FATAL events detected in last 5 minutes")]


def buckets(spark, rows):
    return spark.createDataFrame([("s", T0 + i * MINUTE_MS, t, e, 0, 0, t - e) for i, (t, e) in enumerate(rows)], "service_name string, bucket_ms long, total long, errors long, warns long, fatals long, infos long")


@pytest.mark.parametrize(
    ("rows", "pattern", "value"),
    [
        ([(5, 3)], None, None),
        ([(6, 3)], "HIGH_ERROR_RATE", 50),
        ([(100, 9)], None, None),
        ([(100, 1), (100, 10), (100, 20)], "ERROR_SPIKE", 10),
        ([(6, 0)] * 11 + [(1000, 0)], "VOLUME_SPIKE", 1000),
        ([(6, 0)] * 9 + [(1000, 0)], None, None),
    ],
)
def test_patterns(spark, rows, pattern, value):
    found = metrics.detect_patterns(buckets(spark, rows)).collect()
    assert [(r.pattern, r.value) for r in found] == ([] if pattern is None else [(pattern, value)])


def test_window_border(spark):
    b = buckets(spark, [(1, 0)] * 6)
    as_of = T0 + 6 * MINUTE_MS
    assert metrics.active(b, as_of, 5 * MINUTE_MS).count() == 5
    assert metrics.active(b, as_of - MINUTE_MS, 5 * MINUTE_MS).count() == 6


def test_system_stats_of_nothing(spark):
    empty = buckets(spark, [(1, 0)]).limit(0)
    assert metrics.system_stats(metrics.summaries(empty)).first().asDict() == {"active_services": 0, "total_events": 0, "total_errors": 0, "top_error_service": "none"}


def test_ewma_trace():
    s = alerts.AlertState()
    for x in (5.0, 5.0, 20.0):
        s.observe(x, 0.3)
    assert (s.mean, s.updates) == (9.5, 3) and s.variance == pytest.approx(47.25) and not s.is_anomaly(1e9, 3)


def test_life_cycle_trace():
    s, seen, sent = alerts.AlertState(), [], []
    for i, v in enumerate((30, 40, 40, 10, 10, 40, 10, 10, 10, 10, 10, 50, 50, 10)):
        sent.append(s.move(v >= 30, i, 3, 5))
        seen.append(s.state[0])
    assert "".join(seen) == "PPFFFFFFFFRIPI"
    assert [(i, e) for i, e in enumerate(sent) if e] == [(2, "FIRING"), (10, "RESOLVED")]


def test_default_alpha_never_fires_unless_scored_first(spark):
    rows = [("s", T0 + i * MINUTE_MS, 100, 5 + i % 2 + 80 * (i == 40), 0, float(5 + i % 2 + 80 * (i == 40))) for i in range(60)]
    m = spark.createDataFrame(rows, "service_name string, bucket_ms long, total long, errors long, fatals long, error_rate double")
    r = alerts.readings(m, alerts.default_rules(spark)).filter("use_ewma")
    assert alerts.evaluate(r).filter("anomaly").count() == 0
    assert [x.bucket_ms for x in alerts.evaluate(r, score_before_update=True).filter("anomaly").collect()] == [T0 + 40 * MINUTE_MS]
    assert alerts.evaluate(r, alpha=0.05).filter("anomaly").count() >= 1


def test_rules_last_definition_wins_and_scope(spark):
    rules = alerts.default_rules(spark)
    new = spark.createDataFrame([("rule-fatal-events", "F2", "a", "ERROR_COUNT", 2.0, False, 3.0, "SLACK", "#ops", True), ("off", "Off", None, "TOTAL_VOLUME", 1.0, False, 3.0, "EMAIL", "x", False)], alerts.RULE_SCHEMA)
    both = alerts.add_rules(rules, new)
    assert both.count() == 4 and both.filter("name = 'F2'").count() == 1
    m = spark.createDataFrame([("a", T0, 10, 4, 1, 40.0), ("b", T0, 10, 4, 1, 40.0)], "service_name string, bucket_ms long, total long, errors long, fatals long, error_rate double")
    got = alerts.readings(m, both)
    assert sorted((r.rule_id, r.service_name, r.value) for r in got.filter("rule_id = 'rule-fatal-events'").collect()) == [("rule-fatal-events", "a", 4.0)]
    assert got.filter("rule_id = 'off'").count() == 0


def test_notification_text(spark):
    e = spark.createDataFrame([("r", "s", "FIRING", 41.26, 1, "High", 30.0, "SLACK", "#ops"), ("r", "s", "RESOLVED", 1.0, 1, "High", 30.0, "LOG_ONLY", "ops")], "rule_id string, service_name string, type string, current_value double, ts_ms long, rule_name string, threshold double, channel string, notification_target string")
    assert [r.text for r in alerts.notifications(e).collect()] == ["[SLACK → #ops] 🔴 [ALERT FIRING] High — service: s | value: 41.3 | threshold: 30.0", "NOTIFICATION → ✅ [ALERT RESOLVED] High — service: s | value: 1.0 | threshold: 30.0"]


def test_live_tail(spark):
    df = bulk_fixture(spark)
    assert tail.route(df).count() == 26
    assert tail.counters(df).first().asDict() == {"total": 10, "errors": 6}
    assert [r.event_id for r in tail.view(df, "ERROR", "AUTH").collect()] == ["e09", "e03"]
    assert tail.view(df, limit=3).count() == 3
