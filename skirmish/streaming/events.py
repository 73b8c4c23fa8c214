"""Event streams: windowed counts with a bound on lateness, for sources that Structured Streaming reads. The library's results
come from tables; this is an addition for live telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, events, total) of each window; windows close once the watermark has passed them."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = timed.groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), key, "events", "total")


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """Events without repeats of their keys within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
