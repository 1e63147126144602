"""Streaming extension: particle traces ingested as their files grow, summarised per run and iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.weighted import weighted_mean


def stream_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_means(stream: DataFrame, time: str, keys: list[str], value: str, weight: str, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Weighted means per key and window; rows later than the watermark are left out of closed windows."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window), *keys).agg(weighted_mean(value, weight).alias("mean"), F.count("*").alias("n"))
