import pytest

from cindermill.functions.text import is_term, raw_tokens
from cindermill.operators import index, ingest, storage
from cindermill.plans import query_language as ql
from cindermill.schema import DAY_MS, HOUR_MS
from cindermill.sources.logs import bulk_fixture


@pytest.fixture(scope="module")
def fixture_logs(spark):
    return ingest.Pipeline()(bulk_fixture(spark)).cache()


@pytest.fixture(scope="module")
def fixture_index(fixture_logs):
    return index.postings(fixture_logs).cache()


PARSED = {
    "timeout": ("AND", [("TEXT", "message", "timeout")]),
    "level:ERROR": ("AND", [("FIELD", "level", "error")]),
    "service:Payment-Service": ("AND", [("FIELD", "service", "payment-service")]),
    "timeout or refused": ("OR", [("TEXT", "message", "timeout"), ("TEXT", "message", "refused")]),
    '"payment timeout"': ("AND", [("PHRASE", "message", "payment timeout")]),
    'level:ERROR AND message:"db timeout"': ("AND", [("FIELD", "level", "error"), ("PHRASE", "message", "db timeout")]),
    "level:ERROR AND service:payment OR timeout": ("OR", [("FIELD", "level", "error and service:payment"), ("TEXT", "message", "timeout")]),
    '"a OR b" AND level:ERROR': ("OR", [("FIELD", '"a or b" and level', "error")]),
    '"connection refused AND x" AND level:error': ("AND", [("PHRASE", "message", "connection refused AND x"), ("FIELD", "level", "error")]),
    "NOT level:ERROR": ("AND", [("FIELD", "not level", "error")]),
    "(level:ERROR)": ("AND", [("FIELD", "(level", "error)")]),
    "traceId:T-1": ("AND", [("FIELD", "traceid", "t-1")]),
    '"': ("AND", [("TEXT", "message", '"')]),
    "": ("AND", []),
}


@pytest.mark.parametrize("text", PARSED)
def test_parser(text):
    q = ql.parse(text)
    assert (q.operator, [(c.kind, c.field, c.value) for c in q.clauses]) == PARSED[text]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("timeout", "e02 e06"),
        ('"payment gateway"', "e06"),
        ("payment gateway", "e06"),
        ("level:ERROR OR level:FATAL", "e02 e03 e06 e07 e08 e09"),
        ("level:ERROR AND service:payment-service", "e02 e06"),
        ('service:"payment-service"', ""),
        ("env:development", "e01 e02 e03 e04 e05 e06 e07 e08 e09 e10"),
        ("", ""),
        (None, ""),
        ("city:Mumbai", ""),
        ("ORD-00[19]", "e01 e10"),
    ],
)
def test_search_language(fixture_logs, text, want):
    assert sorted(r.event_id for r in ql.execute(fixture_logs, text).collect()) == want.split()


def test_newest_first_and_limit(fixture_logs):
    assert [r.event_id for r in ql.execute(fixture_logs, "for", limit=2).collect()] == ["e10", "e09"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("timeout", "e02 e06"),
        ("payment AND timeout", "e06"),
        ("timeout OR refused", "e02 e06 e08"),
        ('"payment gateway"', "e06"),
        ('"token expired"', "e09"),
        ('"failed for userId"', ""),
        ("payment timeout", ""),
        ("level:ERROR AND service:payment-service", "e02 e06"),
        ("level:ERROR AND service:payment", ""),
        ("category:SECURITY_EVENT", "e03 e09"),
        ("", ""),
        ('""', ""),
    ],
)
def test_index_search(fixture_index, text, want):
    assert sorted(r.event_id for r in index.search(fixture_index, text).collect()) == want.split()


def test_stopword_gap(fixture_index):
    assert [r.event_id for r in index.search(fixture_index, '"failed for userId"', stopword_gap=True).collect()] == ["e03"]


def test_index_size_and_fetch(fixture_index, fixture_logs):
    assert index.term_count(fixture_index).first().total_terms == 45
    assert index.fetch(fixture_logs, index.search(fixture_index, "refund")).first().event_id == "e10"
    assert index.top_postings(fixture_index, 1).count() == 45


def test_tokens(spark):
    df = spark.createDataFrame([("Payment gateway timeout after 5000ms for user u_991",), (" lead, x",), ("trail...",), ("  ",), (None,)], "m string")
    from pyspark.sql import functions as F

    got = df.select(F.posexplode(raw_tokens(F.col("m"))).alias("p", "t")).filter(is_term(F.col("t"))).collect()
    assert [(r.t, r.p) for r in got] == [("payment", 0), ("gateway", 1), ("timeout", 2), ("5000ms", 4), ("user", 6), ("u_991", 7), ("lead", 1), ("trail", 0)]


AS_OF = 1_800_000_000_000


def test_tiers(spark):
    ages = [0, HOUR_MS, HOUR_MS + 1, 30 * DAY_MS, 30 * DAY_MS + 1, 365 * DAY_MS, 365 * DAY_MS + 1]
    df = spark.createDataFrame([(str(i), AS_OF - a) for i, a in enumerate(ages)], "event_id string, ts_ms long")
    assert [r.storage_tier for r in storage.label_tier(df, AS_OF).collect()] == ["HOT", "HOT", "WARM", "WARM", "COLD", "COLD", None]


def test_archive_and_reads(spark, fixture_logs, tmp_path):
    warm, cold = str(tmp_path / "warm"), storage.ColdStore(spark, str(tmp_path / "cold"))
    last = fixture_logs.agg({"ts_ms": "max"}).first()[0]
    old = fixture_logs.withColumn("ts_ms", fixture_logs.ts_ms - 40 * DAY_MS)
    assert cold.manifest().count() == 0 and cold.read().count() == 0 and cold.expire(last) == 0
    storage.write_warm(old.unionByName(fixture_logs), warm)
    assert storage.archive(spark, warm, cold, 1, last, batch=4) == 4
    assert storage.archive(spark, warm, cold, 2, last) == 6 and storage.archive(spark, warm, cold, 3, last) == 0
    left = spark.read.parquet(warm)
    assert left.count() == 10 and left.agg({"ts_ms": "min"}).first()[0] > last - DAY_MS
    back = cold.read()
    assert back.count() == 10 and sorted(r.event_id for r in back.filter("service_name = 'auth-service'").collect()) == ["e03", "e04", "e09"]
    assert back.filter("tags IS NULL").count() == 10 and back.columns[-1] == "event_date"
    merged = storage.merge_tiers(fixture_logs, back.select(fixture_logs.columns))
    assert merged.count() == 10
    days = storage.manifest_of_days(cold.manifest())
    assert storage.overlapping(days, "auth-service", 0, last).count() == 1 and storage.overlapping(days, "auth-service", last, last).count() == 0
    assert storage.expired(days, last + 400 * DAY_MS).count() == 3 and storage.segment_count(days).first().segments == 3
    # A run that is written again replaces itself.
    assert cold.append(old.filter("event_id = 'e01'"), 1) == 1 and cold.read().count() == 7


def test_cold_reads_open_matching_segments_only(spark, fixture_logs, tmp_path):
    cold = storage.ColdStore(spark, str(tmp_path / "cold"))
    rows = [fixture_logs.withColumn("ts_ms", fixture_logs.ts_ms - k * DAY_MS) for k in range(3)]
    cold.append(rows[0].unionByName(rows[1]).unionByName(rows[2]), 0)
    last = fixture_logs.agg({"ts_ms": "max"}).first()[0]
    found = cold.read_range("auth-service", last - DAY_MS - 1000, last - DAY_MS)
    assert sorted(r.event_id for r in found.collect()) == ["e03", "e04", "e09"]
    assert all("service_name=auth-service" in f for f in found.inputFiles()) and len(found.inputFiles()) < cold.manifest().count() / 3
    assert cold.read_range("auth-service", 0, 5).count() == 0
    # Expiry deletes files; with some of them gone already it ends all the same.
    before = {r.path for r in cold.manifest().collect()}
    n = cold.expire(last, int(1.5 * DAY_MS))
    assert 0 < n < len(before) and cold.read().count() == 20 and cold.expire(last, int(1.5 * DAY_MS)) == 0
    import os

    assert sum(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in before) == len(before) - n


def test_warm_delete_keeps_the_rest_of_a_day(spark, fixture_logs, tmp_path):
    warm = str(tmp_path / "warm")
    storage.write_warm(fixture_logs.unionByName(fixture_logs.withColumn("ts_ms", fixture_logs.ts_ms - DAY_MS)), warm)
    from pyspark.sql import functions as F

    t = fixture_logs.filter("event_id = 'e05'").first().ts_ms
    storage.delete_warm(spark, warm, F.col("ts_ms") <= t, "2024-01-01")
    assert sorted(r.event_id for r in spark.read.parquet(warm).collect()) == ["e06", "e07", "e08", "e09", "e10"]
    storage.delete_warm(spark, warm, F.col("ts_ms") <= t, "2024-01-01")
    assert spark.read.parquet(warm).count() == 5


def test_stored_index(spark, fixture_logs, fixture_index, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(fixture_logs.filter("event_id <= 'e05'"), path, 0, 8)
    index.write_index(fixture_logs.filter("event_id > 'e05'"), path, 1, 8)
    index.write_index(fixture_logs.filter("event_id > 'e05'"), path, 1, 8)
    stored = index.read_index(spark, path)
    assert stored.count() == fixture_index.count()
    for text in ("timeout", "payment AND timeout", "timeout OR refused", '"payment gateway"', "level:ERROR AND service:payment-service", ""):
        assert sorted(index.search(stored, text).collect()) == sorted(index.search(fixture_index, text).collect())
    plan = index.of_terms(stored, ["timeout"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(cast(bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert len({f for f in index.of_terms(stored, ["timeout"]).select(F_file()).distinct().collect()}) == 2
    twice = fixture_logs.unionByName(fixture_logs)
    assert index.postings(twice).count() == fixture_index.count()


def F_file():
    from pyspark.sql import functions as F

    return F.input_file_name()


def test_bad_patterns_are_refused_on_the_driver(fixture_logs):
    for text in ("a(b", '"x)"', "message:\"[\"", "level:ERROR AND *"):
        with pytest.raises(ValueError, match="regular expression"):
            ql.execute(fixture_logs, text)


def test_hot_tier_expires(spark, fixture_logs, tmp_path):
    path = str(tmp_path / "hot")
    last = fixture_logs.agg({"ts_ms": "max"}).first()[0]
    fixture_logs.write.parquet(f"{path}/batch_id=1")
    fixture_logs.withColumn("ts_ms", fixture_logs.ts_ms - 2 * HOUR_MS).write.parquet(f"{path}/batch_id=0")
    assert storage.expire_hot(spark, path, last) == 1 and spark.read.parquet(path).count() == 10


def test_warm_round_trip(spark, fixture_logs, tmp_path):
    storage.write_warm(fixture_logs, str(tmp_path / "warm"))
    back = spark.read.parquet(str(tmp_path / "warm"))
    assert back.count() == 10 and "event_date" in back.columns
    assert storage.by_id(back, "e04").first().level == "INFO"
    assert storage.by_key(back, "auth-service", "e01").count() == 0


def test_postings_split_a_message_once_and_gather_repeats(spark):
    """Repeated terms, records that come twice and records of one event that differ; two branches read what is split once for both."""
    kind = "event_id string, ts_ms long, service_name string, level string, message string"
    rows = [("a", 1, "S", "ERROR", "The timeout, timeout."), ("a", 1, "S", "ERROR", "The timeout, timeout."), ("a", 1, "S", "WARN", "late timeout"), ("b", 2, None, None, " of the of SQL"), ("c", 3, "S", "INFO", None), ("d", 4, "S", "INFO", "")]
    found = index.postings(spark.createDataFrame(rows, kind))
    got = sorted((r.event_id, r.term, r.positions) for r in found.collect())
    want = [("a", "late", [0]), ("a", "level:error", [0]), ("a", "level:warn", [0]), ("a", "service:s", [0]), ("a", "timeout", [1, 2]), ("b", "sql", [4]), ("d", "level:info", [0]), ("d", "service:s", [0])]
    assert got == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
