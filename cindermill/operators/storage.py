"""Hot, warm and cold storage as datasets, and the reads, moves and expiries over them.

Warm data is Parquet partitioned by day. Cold data is gzip JSON: each run of the tiering job writes a folder of its own,
partitioned by service and day, and a manifest of its files (service, day, smallest and largest time, rows, path), by
which a read opens the files it needs and no others. What expires is entered in a list before its files go, so a run
that breaks off can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from ..schema import DAY_MS, HOUR_MS, LOG_SCHEMA

HOT_MS, WARM_MS, COLD_MS = HOUR_MS, 30 * DAY_MS, 365 * DAY_MS
RANGE_LIMIT, RECENT_LIMIT, ARCHIVE_BATCH = 1000, 50, 1000


def tier_of(ts_ms: Column, as_of_ms: int) -> Column:
    """HOT, WARM or COLD by age; null once expired."""
    age = F.lit(as_of_ms) - ts_ms
    return F.when(age <= HOT_MS, "HOT").when(age <= WARM_MS, "WARM").when(age <= COLD_MS, "COLD")


def label_tier(logs: DataFrame, as_of_ms: int) -> DataFrame:
    return logs.withColumn("storage_tier", tier_of(F.col("ts_ms"), as_of_ms))


def day(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd")


def write_warm(logs: DataFrame, path: str, mode: str = "append") -> None:
    logs.withColumn("event_date", day(F.col("ts_ms"))).write.mode(mode).partitionBy("event_date").parquet(path)


def write_cold(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Segments: rows meet by service and day before the write, so that a day of a service is few files; Spark splits a hot one by its size."""
    out = logs.withColumns({"event_date": day(F.col("ts_ms")), "service_name": service_or_unknown()})
    out.hint("rebalance", F.col("service_name"), F.col("event_date")).write.mode(mode).option("compression", "gzip").partitionBy("service_name", "event_date").json(path)


def read_cold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_cold_schema()).json(path)


def service_or_unknown() -> Column:
    return F.when(is_blank(F.col("service_name")), "unknown").otherwise(F.col("service_name"))


def hot_live(logs: DataFrame, as_of_ms: int, ttl_ms: int = HOT_MS) -> DataFrame:
    """What the hot tier still holds: records that have not outlived their time."""
    return logs.filter(F.col("ts_ms") >= as_of_ms - ttl_ms)


def by_key(logs: DataFrame, service: str, event_id: str) -> DataFrame:
    """Hot-tier get: one record by service and id."""
    return logs.filter((F.col("service_name") == service) & (F.col("event_id") == event_id)).limit(1)


def by_id(logs: DataFrame, event_id: str) -> DataFrame:
    return logs.filter(F.col("event_id") == event_id).limit(1)


def merge_tiers(*tiers: DataFrame) -> DataFrame:
    """All tiers as one, each event once (records without an id all stay)."""
    everything = tiers[0]
    for t in tiers[1:]:
        everything = everything.unionByName(t)
    blank = is_blank(F.col("event_id"))
    return everything.filter(~blank).dropDuplicates(["event_id"]).unionByName(everything.filter(blank))


def between(logs: DataFrame, service: str, from_ms: int, to_ms: int, limit: int = RANGE_LIMIT) -> DataFrame:
    """A service's newest records of a time range, both ends included."""
    return logs.filter((F.col("service_name") == service) & F.col("ts_ms").between(from_ms, to_ms)).orderBy(F.desc("ts_ms"), "event_id").limit(limit)


def recent(logs: DataFrame, as_of_ms: int, limit: int = RECENT_LIMIT) -> DataFrame:
    """The newest records of the last hour."""
    return logs.filter(F.col("ts_ms") >= as_of_ms - HOT_MS).orderBy(F.desc("ts_ms"), "event_id").limit(limit)


def to_archive(logs: DataFrame, as_of_ms: int, warm_ms: int = WARM_MS, batch: int | None = None) -> DataFrame:
    """Records that are due for the cold tier, oldest first if a batch size is given."""
    due = logs.filter(F.col("ts_ms") < as_of_ms - warm_ms)
    return due if batch is None else due.orderBy("ts_ms", "event_id").limit(batch)


def survivors(logs: DataFrame, as_of_ms: int, warm_ms: int = WARM_MS) -> DataFrame:
    """What stays in the warm tier after the move."""
    return logs.filter(F.col("ts_ms") >= as_of_ms - warm_ms)


MANIFEST_SCHEMA = "service_name string, event_date string, min_ts long, max_ts long, rows long, path string"


class ColdStore:
    """The cold tier at ``path``: ``segments/run=N`` and ``manifest/run=N`` of each run, and ``expired`` lists."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, logs: DataFrame, run: int) -> int:
        """Write a run's segments and their manifest; a run that is written again replaces itself. Returns its rows."""
        folder = f"{self.path}/segments/run={run}"
        write_cold(logs, folder, "overwrite")
        files = read_cold(self.spark, folder).withColumn("path", F.input_file_name())
        figures = [F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.count("*").alias("rows")]
        wrote = Observation()
        entries = files.groupBy("service_name", "event_date", "path").agg(*figures).select(*[c.split()[0] for c in MANIFEST_SCHEMA.split(", ")])
        entries.observe(wrote, F.sum("rows").alias("rows")).write.mode("overwrite").parquet(f"{self.path}/manifest/run={run}")
        return wrote.get["rows"] or 0

    def manifest(self) -> DataFrame:
        """One row per segment file that has not expired."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        known = self.spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")
        if not exists(self.spark, f"{self.path}/expired"):
            return known
        return known.join(self.spark.read.schema("path string").option("recursiveFileLookup", "true").parquet(f"{self.path}/expired"), "path", "left_anti")

    def read(self, segments: DataFrame | None = None) -> DataFrame:
        """The records of some segments (all by default). Their paths come to the driver, as those of any files that are read."""
        paths = [r.path for r in (self.manifest() if segments is None else segments).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], _cold_schema())
        return self.spark.read.schema(_cold_schema()).option("basePath", f"{self.path}/segments").json(paths).drop("run")

    def read_range(self, service: str, from_ms: int, to_ms: int) -> DataFrame:
        """A service's records of a time range, both ends included; only segments that overlap it are opened."""
        return self.read(overlapping(self.manifest(), service, from_ms, to_ms)).filter((F.col("service_name") == service) & F.col("ts_ms").between(from_ms, to_ms))

    def expire(self, as_of_ms: int, cold_ms: int = COLD_MS) -> int:
        """Delete the segments whose newest record has outlived the retention; returns their number."""
        gone = [r.path for r in expired(self.manifest(), as_of_ms, cold_ms).select("path").collect()]
        if gone:
            # The list comes first: from here on no read opens these files, whether they are there still or not.
            self.spark.createDataFrame([(p,) for p in gone], "path string").coalesce(1).write.mode("append").parquet(f"{self.path}/expired")
        for p in gone:
            _delete(self.spark, p)
        return len(gone)


def manifest_of_days(files: DataFrame) -> DataFrame:
    """One row per service and day of a manifest of files: times, rows and folder."""
    out = files.groupBy("service_name", "event_date").agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.sum("rows").alias("rows"))
    return out.withColumn("path", F.concat(F.lit("service_name="), "service_name", F.lit("/event_date="), "event_date"))


def overlapping(segments: DataFrame, service: str, from_ms: int, to_ms: int) -> DataFrame:
    return segments.filter((F.col("service_name") == service) & (F.col("min_ts") <= to_ms) & (F.col("max_ts") >= from_ms))


def expired(segments: DataFrame, as_of_ms: int, cold_ms: int = COLD_MS) -> DataFrame:
    return segments.filter(F.col("max_ts") < as_of_ms - cold_ms)


def segment_count(segments: DataFrame) -> DataFrame:
    return segments.agg(F.count("*").alias("segments"))


def delete_warm(spark: SparkSession, path: str, gone: Column, last_day: str) -> None:
    """Remove the rows for which ``gone`` holds from the warm tier. They are on ``last_day`` or before; later days are not read.

    Days of which rows are left are rewritten as they are (dynamic partition overwrite, put in place at the job's end);
    days of which none is left go as folders. Run again, it finds nothing more to do.
    """
    days = spark.read.parquet(path).filter(F.col("event_date") <= last_day)
    figures = days.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("rows"), F.count_if(F.coalesce(gone, F.lit(False))).alias("gone")).filter("gone > 0").collect()
    part = [r.event_date for r in figures if r.gone < r.rows]
    if part:
        days.filter(F.col("event_date").cast("string").isin(part) & ~F.coalesce(gone, F.lit(False))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    for r in figures:
        if r.gone == r.rows:
            _delete(spark, f"{path}/event_date={r.event_date}")


def archive(spark: SparkSession, warm_path: str, cold: ColdStore, run: int, as_of_ms: int, warm_ms: int = WARM_MS, batch: int | None = None) -> int:
    """One run of the tiering job: what is due in the warm tier (the oldest ``batch`` rows, if given) goes to the cold tier.

    Rows leave the warm tier only after as many have arrived as were due. Returns their number.
    """
    due = to_archive(spark.read.parquet(warm_path), as_of_ms, warm_ms, batch)
    end = due.agg(F.count("*").alias("rows"), F.max(F.struct("ts_ms", "event_id")).alias("last")).first()
    if not end.rows:
        return 0
    wrote = cold.append(due.drop("event_date"), run)
    if wrote != end.rows:
        raise RuntimeError(f"{end.rows} rows were due, {wrote} arrived; nothing is removed from the warm tier")
    gone = F.col("ts_ms") < as_of_ms - warm_ms
    if batch is not None:
        gone = gone & (F.struct("ts_ms", "event_id") <= F.struct(F.lit(end.last.ts_ms), F.lit(end.last.event_id)))
    delete_warm(spark, warm_path, gone, spark.range(1).select(day(F.lit(end.last.ts_ms))).first()[0])
    return wrote


def expire_hot(spark: SparkSession, path: str, as_of_ms: int, ttl_ms: int = HOT_MS) -> int:
    """Delete the batches of the hot tier whose newest record has outlived its time; returns their number."""
    newest = spark.read.parquet(path).groupBy("batch_id").agg(F.max("ts_ms").alias("newest")).filter(F.col("newest") < as_of_ms - ttl_ms).collect()
    for r in newest:
        _delete(spark, f"{path}/batch_id={r.batch_id}")
    return len(newest)


def _cold_schema():
    return T.StructType([*LOG_SCHEMA.fields, T.StructField("event_date", T.StringType())])


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
