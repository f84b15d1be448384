"""Per-service windows: minute buckets, summaries, sliding sums, system figures and patterns.

All levels are aggregations with partial sums before the shuffle, so a service with most of the rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..schema import MINUTE_MS

WINDOW_MINUTES = 5
ERROR_RATE_PERCENT = 50
ERROR_SPIKE = 10
VOLUME_FACTOR = 10
COUNTS = ("total", "errors", "warns", "fatals", "infos")


def bucket_of(ts_ms: Column, bucket_ms: int = MINUTE_MS) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(bucket_ms))


def level_counts() -> list[Column]:
    """Window counters: errors are ERROR only, infos are everything that is not ERROR, WARN or FATAL."""
    level = F.coalesce(F.col("level"), F.lit(""))
    return [
        F.count("*").alias("total"),
        F.count_if(level == "ERROR").alias("errors"),
        F.count_if(level == "WARN").alias("warns"),
        F.count_if(level == "FATAL").alias("fatals"),
        F.count_if(~level.isin("ERROR", "WARN", "FATAL")).alias("infos"),
    ]


def buckets(logs: DataFrame, bucket_ms: int = MINUTE_MS) -> DataFrame:
    """service_name, bucket_ms and counters; records without a service are left out."""
    return logs.filter(~is_blank(F.col("service_name"))).groupBy("service_name", bucket_of(F.col("ts_ms"), bucket_ms).alias("bucket_ms")).agg(*level_counts())


def bucket_error_rate(b: DataFrame) -> DataFrame:
    return b.withColumn("error_rate", F.when(F.col("total") > 0, 100.0 * F.col("errors") / F.col("total")).otherwise(0.0))


def active(b: DataFrame, as_of_ms: int | Column, window_ms: int) -> DataFrame:
    """The buckets that start within ``window_ms`` before ``as_of_ms`` (no upper bound)."""
    as_of = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
    return b.filter(F.col("bucket_ms") >= as_of - window_ms)


def as_of_last(logs: DataFrame) -> int:
    """The time of the newest record."""
    return logs.agg(F.max("ts_ms")).first()[0]


def summaries(b: DataFrame, window_minutes: int = WINDOW_MINUTES) -> DataFrame:
    """One row per service over its (active) buckets; the error rate is a whole per cent, cut off."""
    sums = [F.sum(c).alias(f"total_{c}" if c != "total" else "total_events") for c in ("total", "errors", "warns", "fatals")]
    out = b.groupBy("service_name").agg(*sums, F.count("*").cast("int").alias("active_buckets"))
    return out.withColumns({"window_minutes": F.lit(window_minutes), "error_rate_percent": F.when(F.col("total_events") > 0, F.expr("total_errors * 100 div total_events")).otherwise(F.lit(0).cast("long"))})


def ranked(s: DataFrame) -> DataFrame:
    return s.orderBy(F.desc("total_errors"), "service_name")


def system_stats(s: DataFrame) -> DataFrame:
    """Active services, events, errors, and the service with most errors (the first by name among equals; "none" without any)."""
    best = F.min(F.struct((-F.col("total_errors")).alias("n"), F.col("service_name").alias("s")))
    return s.agg(
        F.count("*").alias("active_services"),
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("total_errors"), F.lit(0)).alias("total_errors"),
        F.coalesce(best["s"], F.lit("none")).alias("top_error_service"),
    )


def sliding(b: DataFrame, bucket_ms: int = MINUTE_MS, window_buckets: int = WINDOW_MINUTES) -> DataFrame:
    """For every bucket the sums over it and the ``window_buckets - 1`` before it, by time."""
    frame = Window.partitionBy("service_name").orderBy("bucket_ms").rangeBetween(-(window_buckets - 1) * bucket_ms, 0)
    out = b.select("service_name", "bucket_ms", *[F.sum(c).over(frame).alias(f"window_{c}") for c in COUNTS], F.count("*").over(frame).alias("window_buckets"))
    return out.withColumn("error_rate_percent", F.expr("window_errors * 100 div window_total"))


#: The figures of a bucket that patterns are found from.
BUCKET = ("bucket_ms", "total", "errors", "fatals")


def gathered(b: DataFrame, *keys: Column | str) -> DataFrame:
    """``keys`` and ``buckets``: the buckets of a window by time. There are as many as the window has intervals, whatever the input."""
    return b.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*BUCKET))).alias("buckets"))


def patterns_of(windows: DataFrame, window_minutes: int = WINDOW_MINUTES, rate: int = ERROR_RATE_PERCENT, spike: int = ERROR_SPIKE, factor: int = VOLUME_FACTOR) -> DataFrame:
    """The columns of ``windows`` without ``buckets``, and pattern, value, description of every pattern in its buckets."""
    keys = [c for c in windows.columns if c != "buckets"]
    add = lambda c: lambda s, x: s + x[c]
    sums = {f"all_{c}": F.aggregate("buckets", F.lit(0).cast("long"), add(c)) for c in ("total", "errors", "fatals")}
    s = windows.withColumns(sums).withColumns({"mean": F.col("all_total") / F.size("buckets"), "rate": F.expr("all_errors * 100 div all_total")})
    first = lambda when, value: F.try_element_at(F.filter("buckets", when), F.lit(1))[value]
    s = s.withColumns({"spike": first(lambda x: x["errors"] >= spike, "errors"), "burst": first(lambda x: (x["total"] > F.col("mean") * factor) & (F.col("mean") > 5) & (F.size("buckets") > 2), "total")})
    found = lambda when, name, value, text: F.when(when, F.struct(F.lit(name).alias("pattern"), F.col(value).cast("long").alias("value"), text.alias("description")))
    w = F.lit(window_minutes)
    # Names and wording of the patterns.
    patterns = F.array_compact(
        F.array(
            found((F.col("rate") >= rate) & (F.col("all_total") > 5), "HIGH_ERROR_RATE", "rate", F.format_string(f"Error rate is %d%% over last %d minutes (threshold: {rate}%%)", "rate", w)),
            found(F.col("spike").isNotNull(), "ERROR_SPIKE", "spike", F.format_string(f"%d errors in a single minute (threshold: {spike})", "spike")),
            found(F.col("all_fatals") > 0, "FATAL_DETECTED", "all_fatals", F.format_string("%d FATAL events detected in last %d minutes", "all_fatals", w)),
            found(F.col("burst").isNotNull(), "VOLUME_SPIKE", "burst", F.format_string("Volume spike: %d events in one minute vs avg %.1f/min", "burst", "mean")),
        )
    )
    return s.select(*keys, F.explode(patterns).alias("p")).select(*keys, "p.*")


def detect_patterns(b: DataFrame, window_minutes: int = WINDOW_MINUTES, rate: int = ERROR_RATE_PERCENT, spike: int = ERROR_SPIKE, factor: int = VOLUME_FACTOR) -> DataFrame:
    """service_name, pattern, value, description of every pattern in the active buckets of each service."""
    return patterns_of(gathered(b, "service_name"), window_minutes, rate, spike, factor)
