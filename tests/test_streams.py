"""Streams of several micro-batches: late rows, restarts from a checkpoint, and sinks of every kind."""

import time

import pytest
from pyspark.sql import functions as F

from cindermill.operators import alerts, index, ingest, metrics, storage
from cindermill.plans import catalogue
from cindermill.schema import HOUR_MS, LOG_SCHEMA, MINUTE_MS
from cindermill.sources.logs import bulk_fixture, stream_json_logs, to_messages
from cindermill.streaming import engine

T0 = 1_704_103_200_000


@pytest.fixture
def source(spark, tmp_path):
    """A folder of JSON lines that grows by calls, each a file and a micro-batch of its own."""
    folder = tmp_path / "raw"
    folder.mkdir()
    written = []

    def add(logs):
        lines = [r.value for r in to_messages(logs).collect()]
        (folder / f"{len(written):03d}.json").write_text("\n".join(lines))
        written.append(len(lines))
        time.sleep(0.02)

    return str(folder), add


def shifted(spark, ms, ids=""):
    return bulk_fixture(spark, T0 + ms).withColumn("event_id", F.concat(F.lit(ids), "event_id"))


def run(stream, tmp_path, name, mode="append"):
    engine.to_folder(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"), mode).awaitTermination()
    return str(tmp_path / name)


def test_sliding_windows_over_batches_with_late_rows_and_a_restart(spark, tmp_path, source):
    folder, add = source
    windows = lambda: engine.window_counts(stream_json_logs(spark, folder, 1), "5 minutes", "1 minute", "10 minutes")
    add(shifted(spark, 0))
    add(shifted(spark, MINUTE_MS, "b"))
    path = run(windows(), tmp_path, "windows")
    assert spark.read.parquet(path).count() == 0  # no window is closed yet
    add(shifted(spark, 60 * MINUTE_MS, "c"))
    add(shifted(spark, 61 * MINUTE_MS, "c2"))  # rows are held against the watermark of the batch before
    add(shifted(spark, 30 * MINUTE_MS, "late"))  # behind the watermark by now
    add(shifted(spark, 120 * MINUTE_MS, "d"))
    run(windows(), tmp_path, "windows")  # goes on from the checkpoint
    got = {(r.service_name, r.window_ms): r.total for r in spark.read.parquet(path).collect()}
    want = {}
    for at in (0, 1, 60, 61):
        for service, n in (("payment-service", 5), ("auth-service", 3), ("order-service", 2)):
            for k in range(5):
                key = (service, T0 + (at - k) * MINUTE_MS)
                want[key] = want.get(key, 0) + n
    assert got == want


def test_dedup_over_batches_and_a_restart(spark, tmp_path, source):
    folder, add = source
    add(shifted(spark, 0))
    add(shifted(spark, 10))
    path = run(engine.deduplicate(stream_json_logs(spark, folder, 1)), tmp_path, "dedup")
    assert spark.read.parquet(path).count() == 10
    add(shifted(spark, 20))
    add(shifted(spark, 20, "new-"))
    run(engine.deduplicate(stream_json_logs(spark, folder, 1)), tmp_path, "dedup")
    assert spark.read.parquet(path).count() == 20


def test_dead_letters_and_counters(spark, tmp_path, source):
    folder, add = source
    add(shifted(spark, 0))
    add(shifted(spark, 0).unionByName(shifted(spark, 5, "x").withColumn("message", F.when(F.col("level") != "ERROR", F.col("message")))))
    at = {k: str(tmp_path / k) for k in ("good", "bad", "counts", "checkpoint")}
    engine.with_dead_letters(stream_json_logs(spark, folder, 1), at["good"], at["bad"], at["checkpoint"], at["counts"]).awaitTermination()
    assert spark.read.parquet(at["good"]).count() == 15 and {r.reason for r in spark.read.parquet(at["bad"]).collect()} == {"missing message"}
    assert spark.read.parquet(at["counts"]).agg(F.sum("unique"), F.sum("rejected")).first() == (20, 5)
    assert spark.read.parquet(at["good"]).filter("category = 'SECURITY_EVENT'").count() == 2


def test_patterns_equal_batch(spark, tmp_path, source):
    folder, add = source
    for k in (0, 1, 2, 60):
        add(shifted(spark, k * MINUTE_MS, f"{k}-"))
    stream = engine.patterns(stream_json_logs(spark, folder, 1), watermark="1 minute", rate=40, spike=2)
    got = sorted(map(tuple, spark.read.parquet(run(stream, tmp_path, "patterns")).drop("batch_id").collect()))
    logs = bulk_fixture(spark, T0).unionByName(bulk_fixture(spark, T0 + MINUTE_MS)).unionByName(bulk_fixture(spark, T0 + 2 * MINUTE_MS))
    want = []
    for start in range(-4, 3):
        inside = metrics.buckets(logs).filter(F.col("bucket_ms").between(T0 + start * MINUTE_MS, T0 + (start + 4) * MINUTE_MS))
        want += [(r.service_name, T0 + start * MINUTE_MS, r.pattern, r.value, r.description) for r in metrics.detect_patterns(inside, rate=40, spike=2).collect()]
    assert got == sorted(want) and len({g[2] for g in got}) == 3


def test_chained_alerts_equal_batch(spark, tmp_path, source):
    folder, add = source
    rules = alerts.default_rules(spark)
    with engine.rocksdb_state(spark):
        for k in range(3):
            add(shifted(spark, 2 * k * MINUTE_MS, f"a{k}-").unionByName(shifted(spark, (2 * k + 1) * MINUTE_MS, f"b{k}-")))
        path = run(engine.alert_chain(stream_json_logs(spark, folder, 1), rules, watermark="0 seconds"), tmp_path, "chain")
        add(shifted(spark, 600 * MINUTE_MS, "end-"))
        run(engine.alert_chain(stream_json_logs(spark, folder, 1), rules, watermark="0 seconds"), tmp_path, "chain")
    got = spark.read.parquet(path).drop("batch_id")
    logs = bulk_fixture(spark, T0)
    for k in range(1, 6):
        logs = logs.unionByName(bulk_fixture(spark, T0 + k * MINUTE_MS))
    want = alerts.evaluate(alerts.readings(alerts.service_metrics(logs), rules))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)
    assert got.filter("event = 'FIRING'").count() > 0
    with pytest.raises(ValueError, match="RocksDB"):
        engine.alert_stream(spark.createDataFrame([], LOG_SCHEMA))


def test_interval_metrics_and_snapshots(spark, tmp_path, source):
    folder, add = source
    add(shifted(spark, 0))
    add(shifted(spark, 1, "b"))
    path = run(engine.interval_metrics(stream_json_logs(spark, folder, 1)), tmp_path, "metrics", "update")
    rows = {r.service_name: (r.total, r.errors, r.fatals, r.error_rate) for r in engine.newest_per_key(spark, path, ("service_name", "bucket_ms")).collect()}
    assert rows["payment-service"] == (10, 6, 2, 60.0) and len(rows) == 3


def test_index_stream(spark, tmp_path, source):
    folder, add = source
    add(shifted(spark, 0))
    add(shifted(spark, 1, "b"))
    path, checkpoint = str(tmp_path / "index"), str(tmp_path / "checkpoint")
    engine.index_stream(stream_json_logs(spark, folder, 1), path, checkpoint, 4).awaitTermination()
    assert sorted(r.event_id for r in index.search(index.read_index(spark, path), "timeout").collect()) == ["be02", "be06", "e02", "e06"]
    add(shifted(spark, 2, "c"))
    engine.index_stream(stream_json_logs(spark, folder, 1), path, checkpoint, 4).awaitTermination()
    assert index.search(index.read_index(spark, path), '"payment gateway"').count() == 3


def _until(done, seconds=60):
    began = time.time()
    while not done() and time.time() - began < seconds:
        time.sleep(0.3)
    assert done()


def test_tier_router_and_live_tail(spark, tmp_path, source):
    folder, add = source
    hot, warm = str(tmp_path / "hot"), str(tmp_path / "warm")
    add(shifted(spark, 0))
    seen = []
    router = engine.route_tiers(stream_json_logs(spark, folder, 1), hot, warm, str(tmp_path / "c1"), "1 second")
    viewer = engine.live_tail(stream_json_logs(spark, folder, 1), lambda batch, number: seen.extend((r.topic, r.event_id) for r in batch.collect()), str(tmp_path / "c2"), "1 second")
    try:
        _until(lambda: len(seen) == 26 and router.recentProgress and router.lastProgress["batchId"] >= 0 and (tmp_path / "warm").exists())
        add(shifted(spark, HOUR_MS, "b"))
        _until(lambda: len(seen) == 52)
        _until(lambda: len(list((tmp_path / "warm").glob("batch_id=*/_SUCCESS"))) == 2)
    finally:
        router.stop()
        viewer.stop()
    assert ("/topic/logs/errors", "be07") in seen and ("/topic/logs/auth-service", "e04") in seen
    assert spark.read.parquet(hot).filter("storage_tier = 'HOT'").count() == 20 and spark.read.parquet(warm).select("event_date").distinct().count() == 1
    assert storage.expire_hot(spark, hot, T0 + HOUR_MS + 30 * MINUTE_MS) == 1 and ingest.validate(spark.read.parquet(hot)).count() == 10


@pytest.mark.parametrize("rows_a_file", [250_000, 40])
def test_a_table_of_several_files_is_as_many_micro_batches(spark, sf_dir, tmp_path, monkeypatch, rows_a_file):
    """Files of a table overlap in time: a micro-batch of one of them would let the watermark pass the rows of the others."""
    import duckdb

    monkeypatch.setattr(catalogue, "PART_FILE_ROWS", rows_a_file)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # Some days have few rows only, so that a part has fewer rows than files.
    thin = events.filter("(ts < timestamp '2024-01-16' OR ts >= timestamp '2024-01-23' OR event_id % 97 = 0)")
    for k in range(3):
        thin.filter(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalogue.queries()["stream_sliding"](spark, str(tmp_path))
    want = connection.execute(catalogue.oracle_sql()["stream_sliding"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 0
    tail = catalogue.queries()["stream_tail"](spark, str(tmp_path))
    batches = {f.rsplit("batch_id=", 1)[1].split("/")[0] for f in tail.inputFiles()}
    assert len(batches) == 4 and tail.filter("topic = '/topic/logs'").count() == thin.count()
