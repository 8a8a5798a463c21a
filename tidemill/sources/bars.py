"""Sources: event tables as ordered series and as open-high-low-close-volume bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bars(events: DataFrame, key: str = "event_type", time: str = "ts", value: str = "value", order: str = "event_id", unit: str = "hour") -> DataFrame:
    """key, bar_ts, open, high, low, close, volume: one row for each key and unit of time with events. One aggregation,
    partial before its shuffle; opening and closing values are those of the lowest and highest order column."""
    bucket = F.date_trunc(unit, F.col(time).cast("timestamp")).cast("timestamp_ntz")
    return events.groupBy(F.col(key), bucket.alias("bar_ts")).agg(
        F.min_by(value, order).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, order).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
