"""Statistics of runs and provider calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.scalars import percent


def call_stats(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: calls, failures, characters of all calls, and the mean, least and greatest latency
    of the successful ones; rates in percent, 0 without calls. calls: latency_ms, success, chars, ts."""
    ok = F.col("success")
    lat = F.when(ok, F.col("latency_ms"))
    n, bad = F.count("*"), F.sum((~ok).cast("long"))
    return calls.groupBy(*keys).agg(
        n.alias("total_calls"), F.sum(ok.cast("long")).alias("successes"), bad.alias("failures"), F.count(lat).alias("timed_calls"), F.sum(F.coalesce("chars", F.lit(0))).alias("total_chars"),
        F.round(F.coalesce(F.avg(lat), F.lit(0.0)), 6).alias("avg_latency"), F.min(lat).alias("min_latency"), F.max(lat).alias("max_latency"), F.max("ts").alias("last_call"),
        F.round(percent(bad, n), 6).alias("error_rate"), F.round(percent(F.sum(ok.cast("long")), n), 6).alias("success_rate"),
    )


def merge_stats(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of parts of a run as one: sums, extremes, and latencies weighed by their calls."""
    w = F.sum(F.col("avg_latency") * F.col("timed_calls"))
    n = F.sum("timed_calls")
    return parts.groupBy(*keys).agg(
        F.sum("total_calls").alias("total_calls"), F.sum("successes").alias("successes"), F.sum("failures").alias("failures"), n.alias("timed_calls"), F.sum("total_chars").alias("total_chars"),
        F.round(F.coalesce(w / F.when(n > 0, n), F.lit(0.0)), 4).alias("avg_latency"), F.min("min_latency").alias("min_latency"), F.max("max_latency").alias("max_latency"), F.max("last_call").alias("last_call"),
    )


def file_counters(results: DataFrame) -> DataFrame:
    """Totals of file results (cached, units, translated, skipped, failed, error): a file is processed
    if it wasn't cached, and skipped if it was, or if units were skipped and none translated."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    skipped = F.col("cached") | ((F.col("skipped") > 0) & (F.col("translated") == 0))
    return results.agg(
        F.count("*").alias("files"), s((~F.col("cached")).cast("long")).alias("processed"), s(skipped.cast("long")).alias("skipped_files"), s(F.col("cached").cast("long")).alias("cache_hits"),
        s("units").alias("units"), s("translated").alias("translated"), s(F.col("failed").cast("long")).alias("failed_files"),
    )


def run_report(started: Column, finished: Column, processed: Column, total: Column, hits: Column, misses: Column) -> Column:
    """struct<duration_ms, files_per_second, progress, hit_rate>; zeros where there is nothing to divide by."""
    ms = F.greatest((F.unix_millis(finished.cast("timestamp")) - F.unix_millis(started.cast("timestamp"))), F.lit(0))
    return F.struct(
        ms.alias("duration_ms"), F.round(F.coalesce(processed / F.when(ms > 0, ms / 1000.0), F.lit(0.0)), 6).alias("files_per_second"),
        F.round(percent(processed, total), 6).alias("progress"), F.round(percent(hits, hits + misses), 6).alias("hit_rate"),
    )


def batch_totals(items: DataFrame, batch: str) -> DataFrame:
    """Per batch: texts, characters, successes and failures (each failure counts once)."""
    return items.groupBy(batch).agg(
        F.count("*").alias("total_count"), F.sum(F.coalesce("chars", F.lit(0))).alias("total_chars"),
        F.sum(F.col("success").cast("long")).alias("success_count"), F.sum((~F.col("success")).cast("long")).alias("failed_count"),
    )


def write_stats(results: DataFrame) -> DataFrame:
    ok = F.col("success")
    n = F.count("*")
    return results.agg(n.alias("total"), F.sum(ok.cast("long")).alias("successful"), F.sum((~ok).cast("long")).alias("failed"), F.sum(F.when(ok, F.col("units_written")).otherwise(0)).alias("units_written"), F.round(percent(F.sum(ok.cast("long")), n), 6).alias("success_rate"))
