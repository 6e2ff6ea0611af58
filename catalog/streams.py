"""Streaming queries, run to the end of the event files, with the SQL of their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.chunks import CHUNKS, widened
from catalog.usage import CALLS, EVENTS
from passagemill.operators.chunking import chunk_by_lines
from passagemill.operators.embedding import HashEmbedder
from passagemill.plans import roles
from passagemill.session import new_work_path
from passagemill.sources.store import ChunkStore
from passagemill.streaming import ingest as ingest_ops
from passagemill.streaming import reuse, usage
from passagemill.streaming.sinks import drain, read_stream


def _events(spark, sf):
    return read_stream(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _calls(spark, sf):
    return roles.usage_calls(_events(spark, sf))


def _untimed(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


def stream_usage_counts(spark, sf):
    return drain(usage.usage_counts(_calls(spark, sf)), "update", ["type"])


def stream_savings(spark, sf):
    return drain(usage.running_savings(_calls(spark, sf)), "complete")


def stream_latest_state(spark, sf):
    state = usage.latest_state(_events(spark, sf), "user_id", ["event_type", "value"], ["ts", "event_id"])
    return drain(state, "update", ["user_id"])


def stream_dedup(spark, sf):
    """Requests of a user for one type count once within 60 days."""
    seen = reuse.first_requests(_events(spark, sf), ["user_id", "event_type"], "60 days")
    return drain(seen.select("user_id", "event_type"))


def stream_sessions(spark, sf):
    found = drain(reuse.sessions(_events(spark, sf), "user_id", "2 hours"), "complete")
    return _untimed(found, "session_start", "session_end")


def stream_daily_windows(spark, sf):
    return _untimed(drain(usage.windowed_counts(_calls(spark, sf)), "complete"), "window_start", "window_end")


def stream_sliding_windows(spark, sf):
    counts = usage.windowed_counts(_calls(spark, sf), "2 days", "1 day")
    return _untimed(drain(counts, "complete"), "window_start", "window_end")


def stream_ingest(spark, sf):
    """Document files arrive as a stream and end up as embedded chunks in the store."""
    documents = read_stream(spark, f"{sf}/documents.parquet").select(
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("filepath"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        F.col("n_chars").cast("double").alias("mtime"),
    )
    base = new_work_path(spark, "ingest")
    store = ChunkStore(spark, f"{base}/store", buckets=8)
    query = ingest_ops.ingest(
        documents, store, lambda f: chunk_by_lines(f, 10, 2), HashEmbedder(), f"{base}/checkpoint", {"availableNow": True}
    )
    query.awaitTermination()
    stored = store.load_chunks().select(
        "id", "filepath", "content", "start_line", "end_line", F.size("embedding").cast("long").alias("width")
    )
    return widened(stored)


QUERIES = {
    "stream_usage_counts": stream_usage_counts,
    "stream_savings": stream_savings,
    "stream_latest_state": stream_latest_state,
    "stream_dedup": stream_dedup,
    "stream_sessions": stream_sessions,
    "stream_daily_windows": stream_daily_windows,
    "stream_sliding_windows": stream_sliding_windows,
    "stream_ingest": stream_ingest,
}

_FORMAT = "'%Y-%m-%d %H:%M:%S'"

SQL = {
    "stream_usage_counts": f"WITH {CALLS} SELECT type, count(*) AS count FROM calls GROUP BY type",
    "stream_savings": f"""WITH {EVENTS} SELECT type, count(*) AS count, CAST(sum(floor(chars_avoided / 4.0)) AS BIGINT) AS tokens_saved,
        CAST(sum(chars_returned) AS BIGINT) AS chars_returned, CAST(sum(chars_avoided) AS BIGINT) AS chars_avoided FROM scored GROUP BY type""",
    "stream_latest_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_sessions": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
        SELECT user_id, strftime(min(ts), {_FORMAT}) AS session_start, strftime(max(ts) + INTERVAL 2 HOURS, {_FORMAT}) AS session_end, count(*) AS count FROM s GROUP BY user_id, n""",
    "stream_daily_windows": f"""WITH {CALLS} SELECT strftime(date_trunc('day', ts), {_FORMAT}) AS window_start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, {_FORMAT}) AS window_end,
        type, count(*) AS count, CAST(sum(chars_returned) AS BIGINT) AS chars_returned FROM calls GROUP BY date_trunc('day', ts), type""",
    "stream_sliding_windows": f"""WITH {CALLS}, w AS (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM calls)
        SELECT strftime(s, {_FORMAT}) AS window_start, strftime(s + INTERVAL 2 DAYS, {_FORMAT}) AS window_end, type, count(*) AS count, CAST(sum(chars_returned) AS BIGINT) AS chars_returned FROM w GROUP BY s, type""",
    "stream_ingest": f"WITH {CHUNKS} SELECT id, filepath, content, start_line, end_line, 64::BIGINT AS width FROM chunks",
}
