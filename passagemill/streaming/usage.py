"""Running usage figures over a stream of calls (see operators.usage for the columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import savings
from passagemill.operators.usage import event_savings


def usage_counts(calls: DataFrame) -> DataFrame:
    """Count per type, updated as calls arrive."""
    return calls.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def running_savings(calls: DataFrame) -> DataFrame:
    """Savings per type after every batch of calls."""
    return (
        event_savings(calls)
        .groupBy("type")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum(savings.tokens(F.col("chars_avoided"))).alias("tokens_saved"),
            F.sum("chars_returned").alias("chars_returned"),
            F.sum("chars_avoided").alias("chars_avoided"),
        )
    )


def latest_state(events: DataFrame, key: str, payload: list[str], order: list[str]) -> DataFrame:
    """The newest payload of every key, for clients that join late."""
    rank = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(c, rank).alias(c) for c in payload])


def windowed_counts(calls: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Calls and characters per type and event-time window; later rows than ``late`` are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        calls.withWatermark("ts", late)
        .groupBy(window.alias("w"), "type")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("chars_returned").alias("chars_returned"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "type", "count", "chars_returned")
    )
