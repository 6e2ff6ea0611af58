"""Usage and savings queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.operators import usage
from passagemill.plans import roles


def _events(spark, sf):
    return roles.usage_events(spark, sf)


def _calls(spark, sf):
    return _events(spark, sf).withColumnRenamed("type", "command")


def event_savings(spark, sf):
    return _events(spark, sf).select(
        "event_id", "type", "timestamp", "chars_returned", "files_explored", "files_avoided", "chars_avoided", "origin"
    )


def event_savings_all_types(spark, sf):
    """Every event scored as each of the seven types."""
    types = F.explode(F.array(*[F.lit(t) for t in usage.savings.EVENT_TYPES])).alias("type")
    calls = roles.usage_calls(roles.table(spark, sf, "events")).drop("type").select("*", types)
    scored = usage.event_savings(calls)
    return scored.groupBy("type").agg(
        F.sum("files_explored").alias("files_explored"),
        F.sum("files_avoided").alias("files_avoided"),
        F.sum("chars_avoided").alias("chars_avoided"),
    )


def valid_events(spark, sf):
    """Purchases without a timestamp and errors of no known type fall out."""
    broken = _events(spark, sf).withColumn(
        "timestamp", F.when(F.col("type") != "find_symbol", F.col("timestamp"))
    ).withColumn("type", F.when(F.col("type") == "list_concepts", F.lit("unknown")).otherwise(F.col("type")))
    return usage.valid_events(broken).select("event_id", "type")


def savings_by_type(spark, sf):
    return usage.savings_by_type(_events(spark, sf))


def savings_totals(spark, sf):
    return usage.savings_totals(_events(spark, sf))


def savings_breakdown(spark, sf):
    return usage.savings_breakdown(_events(spark, sf))


def command_usage(spark, sf):
    return usage.command_usage(_calls(spark, sf))


def usage_breakdown(spark, sf):
    return usage.usage_breakdown(_calls(spark, sf))


def total_commands(spark, sf):
    return usage.total_commands(_calls(spark, sf))


def usage_share(spark, sf):
    shares = usage.usage_share(usage.command_usage(_calls(spark, sf)))
    return shares.withColumn("share", F.round("share", 6))


def recent_events(spark, sf):
    return usage.recent_events(_events(spark, sf)).select("event_id", "type", "timestamp")


def union_origins(spark, sf):
    """Events of two sources in one table, each row marked with its own."""
    events = _events(spark, sf).drop("origin")
    both = usage.union_origins(
        events.filter("type <> 'find_symbol'").select("event_id", "type"),
        events.filter("type = 'find_symbol'").select("event_id", "type"),
    )
    return both


QUERIES = {
    "event_savings": event_savings,
    "event_savings_all_types": event_savings_all_types,
    "valid_events": valid_events,
    "savings_by_type": savings_by_type,
    "savings_totals": savings_totals,
    "savings_breakdown": savings_breakdown,
    "command_usage": command_usage,
    "usage_breakdown": usage_breakdown,
    "total_commands": total_commands,
    "usage_share": usage_share,
    "recent_events": recent_events,
    "union_origins": union_origins,
}

CALLS = """calls AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'search_code' WHEN 'click' THEN 'search_similar' WHEN 'purchase' THEN 'find_symbol'
  WHEN 'signup' THEN 'summarize_codebase' WHEN 'error' THEN 'list_concepts' END AS type, epoch_us(ts) // 1000 AS timestamp, CAST(floor(value * 100) AS BIGINT) AS chars_returned,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS m, CASE WHEN hour(ts) < 8 THEN 'agents' ELSE 'main' END AS origin FROM events)"""


def scored_sql(source: str) -> str:
    return f"""explored AS (SELECT *, CASE type WHEN 'search_code' THEN greatest(5, m + 2) WHEN 'search_similar' THEN greatest(8, m + 3) WHEN 'find_symbol' THEN greatest(4, least(m, 8))
  WHEN 'summarize_codebase' THEN greatest(15, least(m, 25)) WHEN 'list_concepts' THEN greatest(12, m * 2) WHEN 'search_by_concept' THEN greatest(6, m) ELSE 0 END AS files_explored FROM {source}),
scored AS (SELECT *, CASE type WHEN 'search_code' THEN greatest(0, files_explored - m) WHEN 'search_similar' THEN greatest(0, files_explored - m) WHEN 'find_symbol' THEN greatest(0, files_explored - 1)
  WHEN 'search_by_concept' THEN greatest(0, files_explored - CAST(ceil(m / 2.0) AS BIGINT)) WHEN 'get_symbols_overview' THEN 0 ELSE files_explored END AS files_avoided,
  greatest(0, CASE WHEN type = 'get_symbols_overview' THEN m * 60 ELSE files_explored * 6000 END - chars_returned) AS chars_avoided FROM explored)"""


EVENTS = CALLS + ", " + scored_sql("calls")
_TYPES = "(SELECT unnest(['search_code','search_similar','get_symbols_overview','find_symbol','summarize_codebase','list_concepts','search_by_concept']) AS type)"
_COMMANDS = "commands AS (SELECT unnest([" + ",".join(f"'{c}'" for c in usage.COMMAND_LABELS) + "]) AS command, unnest([" + ",".join(
    f"'{v}'" for v in usage.COMMAND_LABELS.values()
) + "]) AS label)"
_TOTALS = """count(*) AS operations, CAST(floor(coalesce(sum(chars_avoided), 0) / 4.0) AS BIGINT) AS tokens_saved, CAST(coalesce(sum(chars_returned), 0) AS BIGINT) AS chars_returned,
  CAST(coalesce(sum(chars_avoided), 0) AS BIGINT) AS chars_avoided, CAST(coalesce(sum(files_avoided), 0) AS BIGINT) AS files_avoided,
  CAST(CASE WHEN sum(chars_returned + chars_avoided) > 0 THEN floor(100.0 * sum(chars_avoided) / sum(chars_returned + chars_avoided) + 0.5) ELSE 0 END AS BIGINT) AS efficiency_percent"""

SQL = {
    "event_savings": f"WITH {EVENTS} SELECT event_id, type, timestamp, chars_returned, files_explored, files_avoided, chars_avoided, origin FROM scored",
    "event_savings_all_types": f"""WITH {CALLS}, crossed AS (SELECT c.* EXCLUDE (type), t.type FROM calls c, {_TYPES} t), {scored_sql('crossed')}
        SELECT type, CAST(sum(files_explored) AS BIGINT) AS files_explored, CAST(sum(files_avoided) AS BIGINT) AS files_avoided, CAST(sum(chars_avoided) AS BIGINT) AS chars_avoided FROM scored GROUP BY type""",
    "valid_events": f"WITH {EVENTS} SELECT event_id, type FROM scored WHERE type NOT IN ('find_symbol', 'list_concepts')",
    "savings_by_type": f"""WITH {EVENTS} SELECT t.type, count(event_id) AS count, CAST(coalesce(sum(floor(chars_avoided / 4.0)), 0) AS BIGINT) AS tokens_saved,
        CAST(coalesce(sum(chars_returned), 0) AS BIGINT) AS chars_returned, CAST(coalesce(sum(chars_avoided), 0) AS BIGINT) AS chars_avoided FROM {_TYPES} t LEFT JOIN scored s ON s.type = t.type GROUP BY t.type""",
    "savings_totals": f"WITH {EVENTS} SELECT {_TOTALS} FROM scored",
    "savings_breakdown": f"WITH {EVENTS} SELECT coalesce(origin, 'total') AS origin, {_TOTALS} FROM scored GROUP BY GROUPING SETS ((origin), ())",
    "command_usage": f"WITH {CALLS}, {_COMMANDS} SELECT command, label, count(event_id) AS count FROM commands LEFT JOIN calls ON type = command GROUP BY command, label",
    "usage_breakdown": f"""WITH {CALLS}, {_COMMANDS} SELECT command, label, count(event_id) FILTER (origin = 'main') AS main, count(event_id) FILTER (origin = 'agents') AS agents,
        count(event_id) AS total FROM commands LEFT JOIN calls ON type = command GROUP BY command, label""",
    "total_commands": "SELECT count(*) AS total FROM events",
    "usage_share": f"""WITH {CALLS}, {_COMMANDS}, u AS (SELECT command, label, count(*) AS count FROM commands JOIN calls ON type = command GROUP BY command, label)
        SELECT command, label, count, round(count / max(count) OVER (), 6) AS share FROM u""",
    "recent_events": f"WITH {EVENTS} SELECT event_id, type, timestamp FROM scored ORDER BY timestamp DESC, event_id DESC LIMIT 1000",
    "union_origins": f"WITH {CALLS} SELECT event_id, type, CASE WHEN type = 'find_symbol' THEN 'agents' ELSE 'main' END AS origin FROM calls",
}
