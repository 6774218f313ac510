"""Trace folders as streams: typed events, deduplication, windowed metrics, Parquet staging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.functions import scalar as S
from tracelake.operators.trace import kept_events, parse_trace, regular_events


def stream_events(spark: SparkSession, folder: str, files_per_batch: int = 1000, pattern: str = "*.pfw*") -> DataFrame:
    """Regular events of the files that arrive in `folder`, with event_time; each file is read once."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).schema("value string").text(folder)
    events = regular_events(kept_events(parse_trace(lines)))
    return events.withColumn("event_time", F.timestamp_micros("time_start"))


def windowed_metrics(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Per event-time window, category, io_cat and function: time, count, size. Events later than `late` are left out."""
    return (
        events.withWatermark("event_time", late)
        .groupBy(F.window("event_time", window).alias("w"), "cat", S.io_category_code(F.col("func_name")).cast("string").alias("io_cat"), "func_name")
        .agg(F.sum("duration").alias("time"), F.sum("count").alias("count"), F.sum("size").alias("size"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cat", "io_cat", "func_name", "time", "count", "size")
    )


def stage(events: DataFrame, out_dir: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append events to Parquet by day, each once; with `once` the query ends when all files there are were read."""
    w = events.withColumn("day", F.to_date("event_time")).writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).partitionBy("day")
    return (w.trigger(availableNow=True) if once else w).start()
