import time

import pytest
from pyspark.sql import functions as F

from passagemill.operators import usage
from passagemill.operators.chunking import chunk_by_lines
from passagemill.session import new_work_path
from passagemill.streaming import reuse, sinks
from passagemill.streaming import usage as running

CALL = "type string, chars_returned long, matched long"
EVENT = "event_id long, type string, timestamp long, chars_returned long, chars_avoided long, files_avoided long"

CASES = [
    ("search_code", 1000, 3, 29000, 2),
    ("search_code", 0, 10, 72000, 2),
    ("search_code", 10**6, 3, 0, 2),
    ("search_similar", 500, 2, 47500, 6),
    ("get_symbols_overview", 100, 50, 2900, 0),
    ("find_symbol", 0, 100, 48000, 7),
    ("find_symbol", 0, 1, 24000, 3),
    ("summarize_codebase", 0, 100, 150000, 25),
    ("list_concepts", 0, 10, 120000, 20),
    ("search_by_concept", 0, 9, 54000, 4),
]


@pytest.mark.parametrize("kind,returned,matched,avoided,files", CASES)
def test_savings(spark, kind, returned, matched, avoided, files):
    row = usage.event_savings(spark.createDataFrame([(kind, returned, matched)], CALL)).first()
    assert (row["chars_avoided"], row["files_avoided"]) == (avoided, files)


def test_totals_floor_once_and_types_floor_each(spark):
    events = spark.createDataFrame([(i, "search_code", i, 1, 3, 1) for i in range(4)], EVENT)
    assert usage.savings_totals(events).first()["tokens_saved"] == 3
    by_type = {r["type"]: r["tokens_saved"] for r in usage.savings_by_type(events).collect()}
    assert by_type["search_code"] == 0 and len(by_type) == 7
    empty = usage.savings_totals(events.limit(0)).first()
    assert (empty["operations"], empty["efficiency_percent"], empty["tokens_saved"]) == (0, 0, 0)
    assert usage.savings_totals(events).first()["efficiency_percent"] == 75


def test_only_well_formed_events_count(spark):
    rows = [(1, "search_code", 1, 1, 1, 1), (2, "other", 1, 1, 1, 1), (3, "find_symbol", None, 1, 1, 1), (4, None, 1, 1, 1, 1)]
    assert [r["event_id"] for r in usage.valid_events(spark.createDataFrame(rows, EVENT)).collect()] == [1]


def test_last_thousand_events(spark):
    events = spark.range(1500).select(F.col("id").alias("event_id"), (F.col("id") % 700).alias("timestamp"))
    kept = {r["event_id"] for r in usage.recent_events(events).collect()}
    want = {i for _, i in sorted(((i % 700, i) for i in range(1500)), reverse=True)[:1000]}
    assert kept == want


def test_unknown_commands_count_in_the_total_only(spark):
    calls = spark.createDataFrame([("search_code", "main"), ("search_code", "agents"), ("nope", "main")], "command string, origin string")
    counts = {r["command"]: r["count"] for r in usage.command_usage(calls).collect()}
    assert counts["search_code"] == 2 and "nope" not in counts and len(counts) == len(usage.COMMAND_LABELS)
    assert usage.total_commands(calls).first()[0] == 3
    parts = {r["command"]: (r["main"], r["agents"], r["total"]) for r in usage.usage_breakdown(calls).collect()}
    assert parts["search_code"] == (1, 1, 2) and parts["commit"] == (0, 0, 0)
    shares = usage.usage_share(usage.command_usage(calls)).collect()
    assert [(r["command"], r["share"]) for r in shares] == [("search_code", 1.0)]


# ------------------------------------------------------------------ streams


def stream_of(spark, tmp_path, frames, files_per_batch=1):
    """Each frame becomes one file, read one file per micro-batch in this order."""
    path = tmp_path / "in"
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # files are taken by modification time
    return sinks.read_stream(spark, str(path), files_per_batch)


def test_late_rows_are_dropped_and_windows_closed(spark, tmp_path):
    day = 86400
    schema = "sec long, type string, chars_returned long"
    batches = [
        [(0, "a", 1), (day - 1, "a", 1)],
        [(3 * day, "a", 5)],
        [(3 * day + 1, "a", 5)],
        [(10, "a", 100), (3 * day + 5, "a", 5)],  # the first is three days late
        [(9 * day, "b", 0)],
    ]
    frames = [spark.createDataFrame(b, schema).withColumn("ts", F.timestamp_seconds("sec")) for b in batches]
    out = sinks.drain(running.windowed_counts(stream_of(spark, tmp_path, frames), "1 day", late="1 hour"))
    got = sorted((r["type"], r["count"], r["chars_returned"]) for r in out.collect())
    assert got == [("a", 2, 2), ("a", 3, 15)]


def test_counts_after_every_batch_and_fan_out(spark, tmp_path):
    frames = [spark.createDataFrame([("a",), ("b",)], "type string"), spark.createDataFrame([("a",)], "type string")]
    stream = stream_of(spark, tmp_path, frames)
    seen, out = [], new_work_path(spark, "test")
    query = sinks.fan_out(
        running.usage_counts(stream),
        {"log": lambda df, n: seen.append((n, sorted(map(tuple, df.collect())))), "table": sinks.batch_table(out)},
        new_work_path(spark, "checkpoint"),
        "update",
        {"availableNow": True},
    )
    query.awaitTermination()
    assert [s for s in seen if s[1]] == [(0, [("a", 1), ("b", 1)]), (1, [("a", 2)])]
    assert spark.read.parquet(out).count() == 3
    latest = sinks.drain(running.usage_counts(stream), "update", ["type"])
    assert sorted(map(tuple, latest.collect())) == [("a", 2), ("b", 1)]


def test_ingest_replaces_changed_files(spark, tmp_path):
    from passagemill.operators.embedding import HashEmbedder
    from passagemill.sources.store import ChunkStore
    from passagemill.streaming.ingest import ingest

    schema = "filepath string, content string, language string, mtime double"
    frames = [
        spark.createDataFrame([("a", "one\ntwo\nthree", "en", 1.0), ("b", "x", "en", 1.0)], schema),
        spark.createDataFrame([("a", "older", "en", 2.0), ("a", "new", "en", 3.0)], schema),
    ]
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=4)
    query = ingest(
        stream_of(spark, tmp_path, frames), store, lambda f: chunk_by_lines(f, 2, 0), HashEmbedder(),
        str(tmp_path / "checkpoint"), {"availableNow": True},
    )
    query.awaitTermination()
    got = sorted((r["id"], r["content"]) for r in store.load_chunks().collect())
    assert got == [("a:1-1", "new"), ("b:1-1", "x")]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "filepath string, n int"
    stream = stream_of(spark, tmp_path, [spark.createDataFrame([("a", 1)], schema)])
    checkpoint, seen = str(tmp_path / "checkpoint"), []

    def run():
        sink = {"log": lambda df, n: seen.extend(r["filepath"] for r in df.collect())}
        sinks.fan_out(stream, sink, checkpoint, "append", {"availableNow": True}).awaitTermination()

    run()
    run()
    spark.createDataFrame([("b", 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert seen == ["a", "b"]
