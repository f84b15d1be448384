"""One object for all questions that a log service answers; every answer is a DataFrame or a small dict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import alerts, index, metrics, storage
from .plans import query_language
from .schema import MINUTE_MS
from .streaming import engine


class LogEngine:
    """Queries over processed log records (and, if given, cold records or a cold store, alert rules, and the path of a stored index).

    ``as_of_ms`` is the time that counts as now; by default the newest record's. Without a stored index searches build one.
    """

    def __init__(self, logs: DataFrame, cold: DataFrame | storage.ColdStore | None = None, rules: DataFrame | None = None, as_of_ms: int | None = None, bucket_ms: int = MINUTE_MS, window_minutes: int = metrics.WINDOW_MINUTES, stored_index: str | None = None):
        self.logs, self.cold = logs, cold
        self.rules_ = rules if rules is not None else alerts.default_rules(logs.sparkSession)
        self.as_of_ms = as_of_ms if as_of_ms is not None else metrics.as_of_last(logs)
        self.bucket_ms, self.window_minutes = bucket_ms, window_minutes
        self._index: DataFrame | None = index.read_index(logs.sparkSession, stored_index) if stored_index else None

    # Search language
    def query(self, text: str, from_ms: int = 0, to_ms: int = 0, limit: int = query_language.MAX_RESULTS) -> DataFrame:
        return query_language.execute(self.everything(), text, from_ms, to_ms, limit)

    def hits(self, text: str, from_ms: int = 0, to_ms: int = 0) -> DataFrame:
        return query_language.hits(self.everything(), text, from_ms, to_ms)

    def explain_query(self, text: str) -> dict:
        q = query_language.parse(text)
        return {"raw_query": q.raw, "operator": q.operator, "clauses": [{"type": c.kind, "field": c.field, "value": c.value} for c in q.clauses]}

    # Index
    @property
    def index(self) -> DataFrame:
        if self._index is None:
            self._index = index.postings(self.logs)
        return self._index

    def search(self, text: str, stopword_gap: bool = False) -> DataFrame:
        return index.search(self.index, text, stopword_gap)

    def search_records(self, text: str) -> DataFrame:
        return index.fetch(self.logs, self.search(text))

    def index_stats(self) -> DataFrame:
        return index.term_count(self.index)

    # Metrics
    def active_buckets(self) -> DataFrame:
        return metrics.active(metrics.buckets(self.logs, self.bucket_ms), self.as_of_ms, self.window_minutes * MINUTE_MS)

    def summaries(self) -> DataFrame:
        return metrics.ranked(metrics.summaries(self.active_buckets(), self.window_minutes))

    def summary(self, service: str) -> DataFrame:
        return metrics.summaries(self.active_buckets(), self.window_minutes).filter(F.col("service_name") == service)

    def stats(self) -> DataFrame:
        return metrics.system_stats(metrics.summaries(self.active_buckets(), self.window_minutes))

    def patterns(self) -> DataFrame:
        return metrics.detect_patterns(self.active_buckets(), self.window_minutes)

    # Storage
    def everything(self) -> DataFrame:
        if self.cold is None:
            return self.logs
        cold = self.cold.read() if isinstance(self.cold, storage.ColdStore) else self.cold
        return storage.merge_tiers(self.logs, cold.select(self.logs.columns))

    def logs_between(self, service: str, from_ms: int, to_ms: int, limit: int = storage.RANGE_LIMIT) -> DataFrame:
        """A service's newest records of a time range; of a cold store only the segments that overlap it are opened."""
        if isinstance(self.cold, storage.ColdStore):
            found = storage.merge_tiers(self.logs, self.cold.read_range(service, from_ms, to_ms).select(self.logs.columns))
            return storage.between(found, service, from_ms, to_ms, limit)
        return storage.between(self.everything(), service, from_ms, to_ms, limit)

    def recent(self, limit: int = storage.RECENT_LIMIT) -> DataFrame:
        return storage.recent(self.logs, self.as_of_ms, limit)

    def by_id(self, event_id: str, service: str | None = None) -> DataFrame:
        return storage.by_id(self.everything(), event_id) if service is None else storage.by_key(self.everything(), service, event_id)

    # Alerts
    def rules(self) -> DataFrame:
        return self.rules_

    def streams(self) -> DataFrame:
        return engine.status(self.logs.sparkSession)

    def add_rule(self, rule: DataFrame) -> None:
        self.rules_ = alerts.add_rules(self.rules_, rule)

    def evaluated(self, **settings) -> DataFrame:
        return alerts.evaluate(alerts.readings(alerts.service_metrics(self.logs, self.bucket_ms), self.rules_), **settings)

    def active_alerts(self, **settings) -> DataFrame:
        return alerts.firing(alerts.latest(self.evaluated(**settings)), self.rules_)

    def alert_status(self, **settings) -> DataFrame:
        return alerts.status(alerts.latest(self.evaluated(**settings)), self.rules_)

    def notifications(self, **settings) -> DataFrame:
        return alerts.notifications(alerts.events(self.evaluated(**settings), self.rules_))
