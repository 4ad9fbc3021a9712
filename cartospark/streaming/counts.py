"""Running tag counts over a folder into which OSM XML extracts arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_TAG = r"<tag\b[^>]*\bk=\"([^\"]+)\"[^>]*\bv=\"([^\"]+)\""


def tag_stream(spark: SparkSession, folder: str, key: str | None = None) -> DataFrame:
    """A stream of (key, value) of the tags in new files, read line by line."""
    lines = spark.readStream.format("text").load(folder)
    one = lines.select(F.regexp_extract("value", _TAG, 1).alias("key"), F.regexp_extract("value", _TAG, 2).alias("value")).where("key <> ''")
    return one if key is None else one.where(F.col("key") == key)


def count_values(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Counts of (key, value) so far, kept in a memory table of that name; state survives restarts by the checkpoint folder."""
    counts = stream.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, event_type, n, total) of an event stream or table with ts, event_type and value; late events are let in for a while."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
