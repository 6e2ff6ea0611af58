"""Whole index runs, the store's own calls and streams with several sinks, with their SQL.

The trees hold every document as a file of its own, so the SQL can cut the same texts.
"""

from __future__ import annotations

from pyarrow import ArrowInvalid
from pyspark.sql import functions as F

from catalog.chunks import CHUNKS, text_chunks, widened
from passagemill.operators.embedding import HashEmbedder, embed
from passagemill.plans import roles
from passagemill.plans.index_job import CorpusIndex
from passagemill.session import new_work_path
from passagemill.sources.files import file_stats, scan_for_symbols, write_texts
from passagemill.sources.store import RECORD_SCHEMA, ChunkStore, read_json_record
from passagemill.streaming import usage
from passagemill.streaming.sinks import batch_table, fan_out, read_stream


def _doc():
    return F.regexp_extract("filepath", "doc_id=([0-9]+)", 1).cast("long").alias("doc_id")


def _write_tree(spark, sf, root, where="true"):
    """One text file a document, named by its id, in folders by source and language.

    A folder system that only Spark writes to gets a folder a document, which is slower to write and to list.
    """
    texts = roles.table(spark, sf, "documents").where(where).select("source", "lang", "doc_id", "text")
    part = lambda name: F.concat(F.lit(f"{name}="), F.coalesce(F.url_encode(F.col(name).cast("string")), F.lit("null")))
    path = F.concat(part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id"), F.lit(".txt"))
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    try:
        write_texts(texts.select(path.alias("filepath"), content.alias("content")), root)
    except ArrowInvalid:
        texts.write.mode("append").partitionBy("source", "lang", "doc_id").text(root)


def _index(spark, root, store, embedder=None):
    return CorpusIndex(spark, root, store, embedder, ["**/*.txt"], [], 10, 2)


def _stored(index):
    chunks = index.store.load_chunks()
    return widened(chunks.select(_doc(), "start_line", "end_line", "content", F.size("embedding").cast("long").alias("width")))


def index_full_run(spark, sf):
    """All documents as files, indexed in one full run."""
    base = new_work_path(spark, "full")
    _write_tree(spark, sf, f"{base}/tree")
    index = _index(spark, f"{base}/tree", f"{base}/store")
    index.index(force=True)
    return _stored(index)


class _Failing(HashEmbedder):
    def __call__(self, texts):
        raise RuntimeError("no embedder")


def index_resumed_run(spark, sf):
    """The first run fails while embedding; the next one goes on from its chunks."""
    base = new_work_path(spark, "resume")
    _write_tree(spark, sf, f"{base}/tree")
    try:
        _index(spark, f"{base}/tree", f"{base}/store", _Failing()).index()
        raise AssertionError("the first run was to fail")
    except Exception as failed:  # noqa: BLE001
        if "no embedder" not in str(failed):
            raise
    index = _index(spark, f"{base}/tree", f"{base}/store")
    done = index.index()
    return _stored(index).withColumn("resumed", F.lit(done.resumed))


def index_run_modes(spark, sf):
    """Full, nothing to do, incremental after new files, full again for another embedder."""
    base = new_work_path(spark, "modes")
    root = f"{base}/tree"
    index = _index(spark, root, f"{base}/store")
    rows = []

    def run(step, index):
        done = index.index()
        rows.append((step, done.files_indexed, index.store.count_rows(), done.incremental))

    _write_tree(spark, sf, root, "lang <> 'fr'")
    run(1, index)
    run(2, index)
    _write_tree(spark, sf, root, "lang = 'fr'")
    run(3, index)
    run(4, _index(spark, root, f"{base}/store", HashEmbedder(32)))
    return spark.createDataFrame(rows, "step long, files long, chunks long, incremental boolean")


def concept_cache(spark, sf):
    """Concepts are kept while the index is the same: the second call returns the first one's rows."""
    base = new_work_path(spark, "concepts")
    _write_tree(spark, sf, f"{base}/tree")
    index = _index(spark, f"{base}/tree", f"{base}/store")
    index.index()
    first = index.concepts(k=4)[0]
    kept = first.select("id", F.col("cluster_id").alias("before")).join(index.concepts(k=4)[0], "id")
    return kept.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("before") == F.col("cluster_id")).alias("same"))


def _store_of(spark, sf, where="true"):
    store = ChunkStore(spark, new_work_path(spark, "store"), buckets=8)
    store.write_chunks(embed(text_chunks(spark, sf).where(where), "content", HashEmbedder()))
    return store


def store_append(spark, sf):
    store = _store_of(spark, sf, "language <> 'fr'")
    store.append_chunks(embed(text_chunks(spark, sf).where("language = 'fr'"), "content", HashEmbedder()))
    return widened(store.load_chunks().select("id", "filepath", "content", "start_line", "end_line"))


def store_count_and_clear(spark, sf):
    """Rows before, and whether the table is there before and after clearing."""
    store = _store_of(spark, sf)
    before, there = store.count_rows(), store.exists()
    store.clear()
    return spark.createDataFrame([(before, there, store.exists())], "chunks long, there boolean, still_there boolean")


def store_metadata(spark, sf):
    """The record and the file times, written and read back."""
    store = ChunkStore(spark, new_work_path(spark, "store"))
    store.write_files(roles.files(spark, sf))
    n = text_chunks(spark, sf).count()
    known = {"file_count": F.count(F.lit(1)), "chunk_count": F.lit(n), "embedding_backend": F.lit("hash")}
    record = store.load_files().agg(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA])
    store.write_record(record)
    times = store.load_files().agg(F.sum("mtime").alias("times"), F.lit(1).alias("one"))
    back = store.load_record().select("file_count", "chunk_count", "embedding_backend", F.lit(1).alias("one"))
    return back.join(times, "one").drop("one")


def json_sidecar(spark, sf):
    """Totals of the events left as one JSON record, read back; a missing record gives no row."""
    path = new_work_path(spark, "sidecar")
    totals = roles.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))
    totals.coalesce(1).write.json(path)
    return read_json_record(spark, path, totals.schema).unionByName(read_json_record(spark, f"{path}-none", totals.schema))


def tree_file_stats(spark, sf):
    root = new_work_path(spark, "tree")
    _write_tree(spark, sf, root)
    return file_stats(spark, root, ["**/*.txt"], []).select(_doc(), F.col("size").cast("long").alias("bytes"))


def tree_scan_for_symbols(spark, sf):
    """Documents in files of code extensions by language; others have no symbols."""
    root = new_work_path(spark, "code")
    texts = roles.table(spark, sf, "documents").select("source", "lang", "text")
    texts.write.partitionBy("source", "lang").text(root)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    endings = {"en": ".py", "de": ".ts", "es": ".java"}
    for status in fs.globStatus(fs_path(f"{root}/source=*/lang=*/part-*.txt")):  # a few files a folder
        path = status.getPath().toString()
        ending = endings.get(path.split("lang=")[1].split("/")[0])
        if ending:
            fs.rename(fs_path(path), fs_path(path[: -len(".txt")] + ending))
    found = scan_for_symbols(spark, root)
    folder = F.regexp_extract("filepath", "source=([^/]*)/", 1).alias("source")
    return found.groupBy(folder, "language").agg(F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def _calls(spark, sf):
    events = read_stream(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return roles.usage_calls(events)


def stream_fan_out(spark, sf):
    """Every micro-batch goes to two tables; both hold the same counts."""
    base = new_work_path(spark, "fan")
    sinks = {name: batch_table(f"{base}/{name}") for name in ("left", "right")}
    fan_out(usage.usage_counts(_calls(spark, sf)), sinks, f"{base}/checkpoint", "complete", {"availableNow": True}).awaitTermination()
    sides = [spark.read.parquet(f"{base}/{name}").select(F.lit(name).alias("sink"), "type", "count") for name in sinks]
    return sides[0].unionByName(sides[1])


def stream_micro_batches(spark, sf):
    """The default trigger, until all input is taken."""
    base = new_work_path(spark, "micro")
    query = fan_out(usage.usage_counts(_calls(spark, sf)), {"table": batch_table(f"{base}/out")}, f"{base}/checkpoint", "complete")
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(f"{base}/out").groupBy("type").agg(F.max_by("count", "batch").alias("count"))


def stream_restart(spark, sf):
    """A stream stopped after the first half of the events and started again takes each event once."""
    base = new_work_path(spark, "restart")
    events = roles.table(spark, sf, "events").select("event_id", "event_type")

    def run():
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        fan_out(stream, {"table": batch_table(f"{base}/out")}, f"{base}/checkpoint", "append", {"availableNow": True}).awaitTermination()

    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{base}/in")
        run()
    run()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        index_full_run, index_resumed_run, index_run_modes, concept_cache, store_append, store_count_and_clear, store_metadata,
        json_sidecar, tree_file_stats, tree_scan_for_symbols, stream_fan_out, stream_micro_batches, stream_restart,
    )
}

#: A text file ends with a line end, so its last line is empty.
_FILE_CHUNKS = """lines AS (SELECT doc_id, lang, string_split(text || chr(10), chr(10)) AS ls FROM documents),
cut AS (SELECT doc_id, lang, i + 1 AS start_line, least(i + 10, len(ls)) AS end_line, array_to_string(ls[i+1:i+10], chr(10)) AS content
  FROM (SELECT *, unnest(range(0, len(ls), 8)) AS i FROM lines)),
stored AS (SELECT * FROM cut WHERE regexp_matches(content, '\\S'))"""
_KINDS = """kinds AS (SELECT CASE event_type WHEN 'view' THEN 'search_code' WHEN 'click' THEN 'search_similar' WHEN 'purchase' THEN 'find_symbol'
  WHEN 'signup' THEN 'summarize_codebase' ELSE 'list_concepts' END AS type FROM events)"""

SQL = {
    "index_full_run": f"WITH {_FILE_CHUNKS} SELECT doc_id, start_line, end_line, content, 64::BIGINT AS width FROM stored",
    "index_resumed_run": f"WITH {_FILE_CHUNKS} SELECT doc_id, start_line, end_line, content, 64::BIGINT AS width, true AS resumed FROM stored",
    "index_run_modes": f"""WITH {_FILE_CHUNKS}, n AS (SELECT count(*) AS f, count(*) FILTER (lang = 'fr') AS fr FROM documents),
        c AS (SELECT count(*) AS c, count(*) FILTER (lang <> 'fr') AS rest FROM stored)
        SELECT 1::BIGINT AS step, f - fr AS files, rest AS chunks, false AS incremental FROM n, c UNION ALL SELECT 2, 0, rest, true FROM n, c
        UNION ALL SELECT 3, fr, c, true FROM n, c UNION ALL SELECT 4, f, c, false FROM n, c""",
    "concept_cache": f"WITH {_FILE_CHUNKS} SELECT count(*) AS chunks, count(*) AS same FROM stored",
    "store_append": f"WITH {CHUNKS} SELECT id, filepath, content, start_line, end_line FROM chunks",
    "store_count_and_clear": f"WITH {CHUNKS} SELECT count(*) AS chunks, true AS there, false AS still_there FROM chunks",
    "store_metadata": f"WITH {CHUNKS} SELECT (SELECT count(*) FROM files) AS file_count, count(*) AS chunk_count, 'hash' AS embedding_backend, (SELECT sum(mtime) FROM files) AS times FROM chunks",
    "json_sidecar": "SELECT count(*) AS events, count(DISTINCT user_id) AS users FROM events",
    "tree_file_stats": "SELECT doc_id, strlen(text) + 1 AS bytes FROM documents",
    "tree_scan_for_symbols": """SELECT source, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'typescript' ELSE 'java' END AS language, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes
        FROM documents WHERE lang <> 'fr' GROUP BY ALL""",
    "stream_fan_out": f"WITH {_KINDS}, n AS (SELECT type, count(*) AS count FROM kinds GROUP BY type) SELECT unnest(['left', 'right']) AS sink, type, count FROM n",
    "stream_micro_batches": f"WITH {_KINDS} SELECT type, count(*) AS count FROM kinds GROUP BY type",
    "stream_restart": "SELECT event_type, count(*) AS n, count(*) AS events FROM events GROUP BY event_type",
}
