"""Usage counts and savings over event tables.

Events: type, timestamp, chars_returned, chars_avoided, files_avoided, origin. All totals are plain
aggregations with partial sums, so a type or origin holding most rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.functions import savings

# Known commands and their labels.
COMMAND_LABELS = {
    "index_codebase": "Index Codebase",
    "search_code": "Search Code",
    "search_similar": "Search Similar",
    "get_index_status": "Get Status",
    "clear_index": "Clear Index",
    "get_project_instructions": "Get Instructions",
    "commit": "Commit",
    "get_symbols_overview": "Symbols Overview",
    "find_symbol": "Find Symbol",
    "find_referencing_symbols": "Find References",
    "search_for_pattern": "Pattern Search",
    "replace_symbol_body": "Replace Symbol",
    "insert_before_symbol": "Insert Before",
    "insert_after_symbol": "Insert After",
    "rename_symbol": "Rename Symbol",
    "write_memory": "Write Memory",
    "read_memory": "Read Memory",
    "list_memories": "List Memories",
    "delete_memory": "Delete Memory",
    "edit_memory": "Edit Memory",
    "create_worktree": "Create Worktree",
    "list_worktrees": "List Worktrees",
    "remove_worktree": "Remove Worktree",
    "worktree_status": "Worktree Status",
    "list_concepts": "List Concepts",
    "search_by_concept": "Search by Concept",
    "summarize_codebase": "Summarize Codebase",
    "open_dashboard": "Open Dashboard",
    "init_project": "Init Project",
}


def commands_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMMAND_LABELS.items()), "command string, label string")


def event_types_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in savings.EVENT_TYPES], "type string")


def valid_events(events: DataFrame) -> DataFrame:
    """Events of a known type with all their numbers."""
    complete = F.col("type").isin(*savings.EVENT_TYPES)
    for c in ("timestamp", "chars_returned", "chars_avoided", "files_avoided"):
        complete = complete & F.col(c).isNotNull()
    return events.filter(complete)


def event_savings(calls: DataFrame) -> DataFrame:
    """Add files_explored, files_avoided and chars_avoided to calls (type, chars_returned, matched)."""
    kind, count = F.col("type"), F.col("matched")
    explored = F.coalesce(savings.files_explored(kind, count), F.lit(0)).cast("long")
    return calls.withColumn("files_explored", explored).select(
        "*",
        savings.files_avoided(kind, count, F.col("files_explored")).cast("long").alias("files_avoided"),
        savings.chars_avoided(kind, count, F.col("files_explored"), F.col("chars_returned"))
        .cast("long")
        .alias("chars_avoided"),
    )


def _zero_filled(known: DataFrame, key: str, counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every known key once, with 0 where nothing was counted; unknown keys drop out."""
    joined = known.join(counts, key, "left")
    return joined.select(*known.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns])


def savings_by_type(events: DataFrame) -> DataFrame:
    sums = events.groupBy("type").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(savings.tokens(F.col("chars_avoided"))).alias("tokens_saved"),  # floored per event
        F.sum("chars_returned").alias("chars_returned"),
        F.sum("chars_avoided").alias("chars_avoided"),
    )
    known = event_types_table(events.sparkSession)
    return _zero_filled(known, "type", sums, ["count", "tokens_saved", "chars_returned", "chars_avoided"])


def _totals() -> list[Column]:
    returned = F.coalesce(F.sum("chars_returned"), F.lit(0))
    avoided = F.coalesce(F.sum("chars_avoided"), F.lit(0))
    percent = savings.round_half_up(100.0 * avoided / (returned + avoided))
    return [
        F.count(F.lit(1)).alias("operations"),
        savings.tokens(avoided).alias("tokens_saved"),  # floored once
        returned.alias("chars_returned"),
        avoided.alias("chars_avoided"),
        F.coalesce(F.sum("files_avoided"), F.lit(0)).alias("files_avoided"),
        F.when(returned + avoided > 0, percent).otherwise(F.lit(0)).cast("long").alias("efficiency_percent"),
    ]


def savings_totals(events: DataFrame) -> DataFrame:
    return events.agg(*_totals())


def savings_breakdown(events: DataFrame, origins: Sequence[str] = ("main", "agents")) -> DataFrame:
    """Totals per origin and over all, from one pass of grouping sets."""
    sets = events.groupingSets([["origin"], []], "origin").agg(F.grouping_id().alias("level"), *_totals())
    named = sets.withColumn("origin", F.when(F.col("level") == 1, F.lit("total")).otherwise(F.col("origin"))).drop(
        "level"
    )
    known = events.sparkSession.createDataFrame([(o,) for o in (*origins, "total")], "origin string")
    return _zero_filled(known, "origin", named, [c for c in named.columns if c != "origin"])


def union_origins(main: DataFrame, agents: DataFrame) -> DataFrame:
    return main.withColumn("origin", F.lit("main")).unionByName(agents.withColumn("origin", F.lit("agents")))


def command_usage(calls: DataFrame) -> DataFrame:
    """Count of every known command: command, label, count."""
    counts = calls.groupBy("command").agg(F.count(F.lit(1)).alias("count"))
    return _zero_filled(commands_table(calls.sparkSession), "command", counts, ["count"])


def usage_breakdown(calls: DataFrame) -> DataFrame:
    """Counts of every known command for main, agents and both."""
    counts = calls.groupBy("command").agg(
        F.count_if(F.col("origin") == "main").alias("main"),
        F.count_if(F.col("origin") == "agents").alias("agents"),
        F.count(F.lit(1)).alias("total"),
    )
    return _zero_filled(commands_table(calls.sparkSession), "command", counts, ["main", "agents", "total"])


def total_commands(calls: DataFrame) -> DataFrame:
    """One row: all calls, unknown commands included."""
    return calls.agg(F.count(F.lit(1)).alias("total"))


def usage_share(usage: DataFrame) -> DataFrame:
    """Used commands with their share of the most used one. ``usage`` has one row per command."""
    top = F.max("count").over(Window.partitionBy(F.lit(0)))
    return usage.filter(F.col("count") > 0).withColumn("share", F.col("count") / top)


def recent_events(events: DataFrame, n: int = savings.KEPT_EVENTS, id_col: str = "event_id") -> DataFrame:
    """The newest n events: a top-n per partition, merged."""
    return events.orderBy(F.col("timestamp").desc(), F.col(id_col).desc()).limit(n)
