"""Time-limited state over streams: duplicate requests, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_requests(events: DataFrame, keys: Sequence[str], ttl: str) -> DataFrame:
    """Requests not seen within the TTL; state of a key goes when the watermark passes it."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(list(keys))


def sessions(events: DataFrame, key: str, ttl: str, late: str = "1 hour") -> DataFrame:
    """Entries renewed by every access: a session ends when nothing came for a TTL."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("s"), key)
    return grouped.agg(F.count(F.lit(1)).alias("count")).select(
        key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "count"
    )
