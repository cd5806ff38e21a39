"""Extension: products over entries that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_right_multiply(entries: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) over an append-only stream of entries, for update or complete mode; x is static and broadcast."""
    return entries.join(F.broadcast(x), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def windowed_sums(events: DataFrame, ts: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """Sums of value by event-time window and keys; events later than `late` behind the newest are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.sum(value).alias("v"))
