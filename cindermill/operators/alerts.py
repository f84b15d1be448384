"""Alerting: per-service metrics, rules, EWMA anomalies and the alert life cycle.

The life cycle depends on order, so each (rule, service) series is folded in time order. Series are dealt by key and
sorted, and a task runs along its rows with one small state at a time: linear in the rows, constant memory.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MINUTE_MS
from .metrics import bucket_of

ALPHA, WARM_UP, PENDING, RESOLVE = 0.3, 10, 3, 5
ERROR_RATE_THRESHOLD = 30.0
#: Shares of the metrics that rules for all services are joined with.
SALTS = 8
RULE_SCHEMA = "rule_id string, name string, service_name string, metric_type string, threshold double, use_ewma boolean, ewma_sensitivity double, channel string, notification_target string, enabled boolean"


def default_rules(spark: SparkSession, error_rate: float = ERROR_RATE_THRESHOLD) -> DataFrame:
    rows = [
        ("rule-error-rate-global", "High Error Rate", None, "ERROR_RATE_PERCENT", error_rate, False, 3.0, "LOG_ONLY", "ops-team", True),
        ("rule-ewma-anomaly", "Statistical Anomaly (EWMA)", None, "ERROR_RATE_PERCENT", 0.0, True, 3.0, "LOG_ONLY", "ops-team", True),
        ("rule-fatal-events", "Fatal Events Detected", None, "FATAL_COUNT", 1.0, False, 3.0, "LOG_ONLY", "ops-team", True),
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def add_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules with new definitions; the last one of a rule_id holds."""
    ordered = rules.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1)))
    columns = rules.columns
    last = ordered.groupBy("rule_id").agg(F.max_by(F.struct(*columns), "__at").alias("r"))
    return last.select("r.*")


def _versions(spark: SparkSession, path: str) -> tuple:
    """The file system, and the finished versions of the rules at ``path``, oldest first."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []
    done = [p for p in found if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return fs, sorted(done, key=lambda p: p.getName())


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version of published rules, or plain JSON lines; read again by each micro-batch, so edits take effect."""
    _, done = _versions(spark, path)
    return spark.read.schema(RULE_SCHEMA).json(done[-1].toString() if done else path)


def publish_rules(rules: DataFrame, path: str, leave: int = 2) -> None:
    """Publish rules as a new version. Readers take the newest version that is finished, so they see the old or the new ones, never none; the last ``leave`` versions stay for readers that have begun."""
    spark = rules.sparkSession
    number = max((int(p.getName().split("=")[1].split("-")[0]) for p in _versions(spark, path)[1]), default=0) + 1
    rules.coalesce(1).write.json(f"{path}/version={number:012d}-{uuid.uuid4().hex[:8]}")
    fs, done = _versions(spark, path)
    for old in done[:-leave]:
        fs.delete(old, True)


def service_metrics(logs: DataFrame, interval_ms: int = MINUTE_MS) -> DataFrame:
    """Counters of each service and interval; errors include FATAL here. Silent intervals have no row."""
    out = logs.filter("service_name IS NOT NULL").groupBy("service_name", bucket_of(F.col("ts_ms"), interval_ms).alias("bucket_ms"))
    counted = out.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("level").isin("ERROR", "FATAL"), F.lit(False))).alias("errors"), F.count_if(F.coalesce(F.col("level") == "FATAL", F.lit(False))).alias("fatals"))
    return counted.withColumn("error_rate", F.col("errors") * F.lit(100.0) / F.col("total"))


def readings(metrics: DataFrame, rules: DataFrame, error_count_is_rate: bool = False) -> DataFrame:
    """One row per enabled rule, service it applies to, and interval, with the metric's value."""
    live = rules.filter("enabled").withColumnRenamed("service_name", "rule_service")
    kind = F.col("metric_type")
    count = F.col("error_rate") if error_count_is_rate else F.col("errors").cast("double")
    value = F.when(kind == "ERROR_RATE_PERCENT", F.col("error_rate")).when(kind == "FATAL_COUNT", F.col("fatals").cast("double")).when(kind == "TOTAL_VOLUME", F.col("total").cast("double")).when(kind == "ERROR_COUNT", count)
    # Rules for one service are an equi-join. A rule for all meets every row by its task: the salt makes that one, too.
    salt = F.pmod(F.xxhash64("service_name", "bucket_ms"), F.lit(SALTS))
    scoped = metrics.join(live.filter("rule_service IS NOT NULL"), F.col("rule_service") == F.col("service_name"))
    everywhere = live.filter("rule_service IS NULL").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    general = metrics.withColumn("__salt", salt).join(everywhere, "__salt").drop("__salt")
    return scoped.unionByName(general).withColumn("value", value)


@dataclass
class AlertState:
    """State of one (rule, service): EWMA figures and life cycle."""

    mean: float = -1.0
    variance: float = 0.0
    updates: int = 0
    state: str = "INACTIVE"
    breaches: int = 0
    normal: int = 0
    since_ms: int | None = None

    def observe(self, x: float, alpha: float) -> None:
        if self.mean < 0:
            self.mean, self.variance = x, 0.0
        else:
            delta = x - self.mean
            self.mean += alpha * delta
            self.variance = (1 - alpha) * (self.variance + alpha * delta * delta)
        self.updates += 1

    def is_anomaly(self, x: float, sigmas: float) -> bool:
        band = sigmas * math.sqrt(self.variance)
        return self.updates >= WARM_UP and (x > self.mean + band or x < self.mean - band)

    def move(self, breached: bool, at_ms: int, pending: int, resolve: int) -> str | None:
        """Take one reading; returns FIRING or RESOLVED if a notification is due."""
        before, event = self.state, None
        if self.state == "INACTIVE":
            if breached:
                self.state, self.breaches = "PENDING", 1
        elif self.state == "PENDING":
            self.breaches = self.breaches + 1 if breached else 0
            if not breached:
                self.state = "INACTIVE"
            elif self.breaches >= pending:
                self.state = event = "FIRING"
        elif self.state == "FIRING":
            self.normal = 0 if breached else self.normal + 1
            if self.normal >= resolve:
                self.state = event = "RESOLVED"
        else:
            self.state, self.breaches, self.normal = "INACTIVE", 0, 0
        if self.state != before:
            self.since_ms = at_ms
        return event

    def step(self, x: float, at_ms: int, use_ewma: bool, threshold: float, sigmas: float, alpha: float, pending: int, resolve: int, score_first: bool) -> tuple[bool, str | None]:
        """Observe and evaluate one reading: (anomaly, event). ``score_first`` scores it against the figures before it."""
        anomaly = score_first and self.is_anomaly(x, sigmas)
        self.observe(x, alpha)
        if not score_first:
            anomaly = self.is_anomaly(x, sigmas)
        return anomaly, self.move(anomaly if use_ewma else x >= threshold, at_ms, pending, resolve)


FOLD_SCHEMA = "rule_id string, service_name string, bucket_ms long, value double, ewma_mean double, ewma_variance double, updates long, anomaly boolean, state string, event string, since_ms long"


def evaluate(readings_: DataFrame, alpha: float = ALPHA, pending: int = PENDING, resolve: int = RESOLVE, score_before_update: bool = False, parts: int | None = None) -> DataFrame:
    """The state after every reading, and the event it emits.

    With the default order a reading is scored against figures that contain it; with ``alpha`` of 0.1 or more and three
    sigmas such a score never fires. ``score_before_update`` scores first.
    """
    columns = ["rule_id", "service_name", "bucket_ms", "value", "use_ewma", "threshold", "ewma_sensitivity"]
    n = parts or int(readings_.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, AlertState()
        for batch in batches:
            rows = []
            for rule, service, at, x, ewma, threshold, sigmas in batch[columns].itertuples(index=False):
                if (rule, service) != key:
                    key, state = (rule, service), AlertState()
                anomaly, event = state.step(float(x), int(at), bool(ewma), float(threshold), float(sigmas), alpha, pending, resolve, score_before_update)
                rows.append((rule, service, at, x, state.mean, state.variance, state.updates, anomaly, state.state, event, state.since_ms))
            yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in FOLD_SCHEMA.split(",")])

    dealt = readings_.select(*columns).repartition(n, "rule_id", "service_name").sortWithinPartitions("rule_id", "service_name", "bucket_ms")
    return dealt.mapInPandas(run, FOLD_SCHEMA)


def latest(evaluated: DataFrame) -> DataFrame:
    """The last state of each (rule, service)."""
    rest = [c for c in evaluated.columns if c not in ("rule_id", "service_name")]
    return evaluated.groupBy("rule_id", "service_name").agg(F.max_by(F.struct(*rest), "bucket_ms").alias("s")).select("rule_id", "service_name", "s.*")


def status(instances: DataFrame, rules: DataFrame) -> DataFrame:
    """Instances by state, and rules, counted in one aggregation."""
    both = instances.select("state", F.lit(False).alias("rule")).unionByName(rules.select(F.lit(None).cast("string").alias("state"), F.lit(True).alias("rule")))
    return both.agg(F.count_if(~F.col("rule")).alias("total_instances"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("FIRING", "PENDING", "INACTIVE")], F.count_if("rule").alias("total_rules"))


def firing(instances: DataFrame, rules: DataFrame) -> DataFrame:
    """Instances that are firing now."""
    return instances.filter("state = 'FIRING'").join(rules.select("rule_id", F.col("name").alias("rule_name"), "threshold"), "rule_id").select("rule_id", "rule_name", "service_name", "state", F.col("value").alias("last_value"), "threshold", F.col("since_ms"))


def events(evaluated: DataFrame, rules: DataFrame) -> DataFrame:
    """Alert events: FIRING and RESOLVED."""
    fired = evaluated.filter("event IS NOT NULL").select("rule_id", "service_name", F.col("event").alias("type"), F.col("value").alias("current_value"), F.col("bucket_ms").alias("ts_ms"))
    return fired.join(rules.select("rule_id", F.col("name").alias("rule_name"), "threshold", "channel", "notification_target"), "rule_id")


def notifications(alert_events: DataFrame) -> DataFrame:
    """The text of each event's notification, with the channel's prefix; channels without one log the text alone."""
    fires = F.col("type") == "FIRING"
    # The wording of notifications.
    text = F.format_string("%s [%s] %s — service: %s | value: %.1f | threshold: %.1f", F.when(fires, "🔴").otherwise("✅"), F.when(fires, "ALERT FIRING").otherwise("ALERT RESOLVED"), "rule_name", "service_name", "current_value", "threshold")
    prefix = F.when(F.col("channel").isin("SLACK", "EMAIL", "WEBHOOK"), F.format_string("[%s → %s] ", "channel", "notification_target")).otherwise(F.lit("NOTIFICATION → "))
    return alert_events.withColumn("text", F.concat(prefix, text))
