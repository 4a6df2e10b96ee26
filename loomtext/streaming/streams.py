"""Structured Streaming over file results and sources: bounded triggers, exactly-once sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def files_stream(spark: SparkSession, folder: str, schema, max_files: int = 0, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as a stream; max_files bounds a micro-batch (0: no bound). The
    checkpoint remembers the files seen, so each is processed once."""
    r = spark.readStream.schema(schema)
    if max_files > 0:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.format(fmt).load(folder)


def run_available(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, workers: int = 0) -> StreamingQuery:
    """Process all that is there now and stop. Each micro-batch writes its own partition
    batch_id=n, overwriting it if the batch is repeated after a failure: no row is lost or doubled.
    workers bounds the tasks of a batch."""

    def batch(df: DataFrame, n: int) -> None:
        rows = process(df.repartition(workers) if workers > 0 else df)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Counts of rows and batches, as they are reported."""

    def __init__(self):
        self.rows, self.batches = 0, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def observed(df: DataFrame, name: str = "progress") -> DataFrame:
    """df with counters that any action reports: rows and errors."""
    error = F.col("error").isNotNull().cast("long") if "error" in df.columns else F.lit(0).cast("long")
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.sum(error).alias("errors"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of windowed_counts() over the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = F.window("ts", "1 hour")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


HOURLY_EVENTS = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2"
