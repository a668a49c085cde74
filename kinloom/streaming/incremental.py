"""Incremental blocking over a stream: new arrivals of a key within the watermark, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_arrivals(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows of ``stream`` whose key has not been seen within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
