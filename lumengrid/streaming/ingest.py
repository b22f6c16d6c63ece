"""Streams: image files as they arrive, and event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import images


def image_stream(spark: SparkSession, folder: str, synthetic: bool = False) -> DataFrame:
    """A streaming relation of decoded images: each file is decoded once, by whichever trigger sees it first."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return images.decode(files.select("path", "content"), synthetic)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(start, stop, event_type, n, total) over event time, for batches and streams alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n", "total")
