"""Change detection, integrity and index-state queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog.chunks import CHUNKS, FILES, text_chunks, widened
from catalog.search import QUERY
from catalog.search import SQL as SEARCH_SQL
from catalog.usage import CALLS
from passagemill.functions.text import directory_of, line_range, lines_of
from passagemill.operators import changes
from passagemill.operators.chunking import chunk_by_lines
from passagemill.operators.embedding import HashEmbedder, check_dimensions, embed
from passagemill.operators.search import hybrid_search, project_result
from passagemill.plans import roles
from passagemill.session import new_work_path, stage
from passagemill.sources.files import scan_corpus
from passagemill.sources.store import ChunkStore, lookup, nearest, read_many_json


def _changes(spark, sf):
    return changes.detect_changes(roles.current_snapshot(spark, sf), roles.stored_snapshot(spark, sf))


def detect_changes(spark, sf):
    return _changes(spark, sf)


def staleness_reason(spark, sf):
    return changes.staleness(_changes(spark, sf))


def deleted_files(spark, sf):
    return changes.deleted_files(roles.current_snapshot(spark, sf), roles.stored_snapshot(spark, sf))


def current_files(spark, sf):
    """File list after an incremental run: unchanged, added and modified."""
    return _changes(spark, sf).filter("change <> 'deleted'").select("filepath")


def incremental_equals_full(spark, sf):
    """Chunk table after an incremental run over the stored snapshot's chunks."""
    stored = chunk_by_lines(roles.stored_snapshot(spark, sf), 10, 2)
    changed = _changes(spark, sf)
    fresh = chunk_by_lines(changes.to_process(roles.current_snapshot(spark, sf), changed), 10, 2)
    return widened(changes.apply_changes(stored, changed, fresh).select("id", "filepath", "content", "start_line", "end_line"))


def delete_by_key(spark, sf):
    gone = _changes(spark, sf).filter(F.col("change").isin("modified", "deleted"))
    return changes.delete_by_key(text_chunks(spark, sf), gone).select("id", "language")


def index_checksum(spark, sf):
    files = roles.files(spark, sf)
    return changes.index_checksum(files, text_chunks(spark, sf).count())


def index_digest(spark, sf):
    files = roles.files(spark, sf)
    return changes.index_checksum(files.repartition(7), text_chunks(spark, sf).count())


def _record(spark, sf, chunk_shift: int = 0, other_files: bool = False):
    """Index record as an earlier run would have left it."""
    chunks = text_chunks(spark, sf)
    n = chunks.count()
    files = roles.stored_snapshot(spark, sf) if other_files else roles.files(spark, sf)
    checksum = changes.index_checksum(files, n)
    return checksum.select((F.lit(n) + chunk_shift).alias("chunk_count"), "checksum")


def validate_index(spark, sf):
    """The four verdicts: sound, no record, another count, other files."""
    chunks = text_chunks(spark, sf)
    counted = chunks.agg(F.count(F.lit(1)).alias("actual_chunks"))
    actual = changes.index_checksum(roles.files(spark, sf), chunks.count()).withColumnRenamed("checksum", "actual_checksum")
    cases = {
        "sound": _record(spark, sf),
        "missing": _record(spark, sf).limit(0),
        "count": _record(spark, sf, chunk_shift=5),
        "files": _record(spark, sf, other_files=True),
    }
    out = None
    for name, record in cases.items():
        one = changes.validate_index(record, counted, actual).withColumn("case", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def index_status(spark, sf):
    chunks = text_chunks(spark, sf)
    files = roles.files(spark, sf)
    record = files.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.lit("2024-01-01T00:00:00.000Z").alias("last_updated"),
        F.lit("hash").alias("embedding_backend"),
        F.lit("md5-words-64").alias("embedding_model"),
    )
    stored = _record(spark, sf, chunk_shift=1)
    counted = chunks.agg(F.count(F.lit(1)).alias("actual_chunks"))
    actual = changes.index_checksum(files, chunks.count()).withColumnRenamed("checksum", "actual_checksum")
    vectors = roles.vectors(spark, sf)
    dims = vectors.agg(F.max(F.size("embedding")).alias("embedding_dimensions")).select(
        F.lit("hash").alias("embedding_backend"), F.lit("md5-words-64").alias("embedding_model"), "embedding_dimensions"
    )
    return changes.index_status(
        chunks, record, changes.validate_index(stored, counted, actual), check_dimensions(vectors, dims, "hash", "other", 64)
    )


def language_stats(spark, sf):
    return changes.language_stats(text_chunks(spark, sf))


def lookup_chunks(spark, sf):
    """All chunks whose id another table names: the first window of every labelled document."""
    labelled = roles.table(spark, sf, "labels").select("doc_id").distinct()
    first_window = F.least(F.size(lines_of(F.col("content"))), F.lit(10)).cast("string")
    ids = (
        roles.files(spark, sf)
        .join(labelled, "doc_id", "left_semi")
        .select(F.concat("filepath", F.lit(":1-"), first_window).alias("id"))
    )
    return widened(project_result(lookup(text_chunks(spark, sf), ids)).drop("symbol_type", "symbol_name"))


def chunks_reslice(spark, sf):
    """Chunks whose own line range in the file gives another text: none."""
    joined = text_chunks(spark, sf).join(roles.files(spark, sf).select("filepath", F.col("content").alias("text")), "filepath")
    again = line_range(lines_of(F.col("text")), F.col("start_line"), F.col("end_line"))
    return joined.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(again == F.col("content")).alias("equal")
    )


def store_update(spark, sf):
    """Chunk table on disk: written from the stored snapshot, then brought up to date bucket by bucket."""
    store = ChunkStore(spark, new_work_path(spark, "store"), buckets=8)
    blank = F.lit(None).cast("array<float>").alias("embedding")
    store.write_chunks(chunk_by_lines(roles.stored_snapshot(spark, sf), 10, 2).select("*", blank))
    changed = stage(_changes(spark, sf), "changes")
    fresh = chunk_by_lines(changes.to_process(roles.current_snapshot(spark, sf), changed), 10, 2).select("*", blank)
    store.replace_files(changed.filter(F.col("change").isin("modified", "deleted")), fresh)
    return widened(store.load_chunks().select("id", "filepath", "content", "start_line", "end_line"))


def nearest_in_store(spark, sf):
    """Hybrid search that reads the contents of the few fetched chunks only."""
    embedder = HashEmbedder()
    store = ChunkStore(spark, new_work_path(spark, "store"), buckets=8)
    store.write_chunks(embed(text_chunks(spark, sf), "content", embedder))
    vector = embedder([QUERY])[0].astype("float32").tolist()
    found = hybrid_search(store, QUERY, vector, 10, scan=nearest)
    return widened(
        found.select("id", "filepath", "start_line", "end_line", F.col("position").cast("long"), F.round("score", 6).alias("score"))
    )


def json_sidecars(spark, sf):
    """Usage counts that every agent left as JSON in its own folder, read back and merged."""
    path = new_work_path(spark, "agents")
    calls = roles.usage_calls(roles.table(spark, sf, "events"))
    counts = calls.groupBy("origin", F.col("type").alias("command")).agg(F.count(F.lit(1)).alias("count"))
    counts.write.partitionBy("origin").json(path)
    schema = StructType.fromDDL("command string, count long")
    merged = read_many_json(spark, f"{path}/*", schema, multi_line=False)
    agent = F.regexp_extract("source", "origin=([^/]*)/", 1)
    return merged.groupBy(agent.alias("origin"), "command").agg(F.sum("count").alias("count"))


def scan_files(spark, sf):
    """Documents written as a tree of text files, then scanned by glob: bytes and lines per folder."""
    root = new_work_path(spark, "tree")
    texts = roles.table(spark, sf, "documents").select("source", "lang", "text")
    texts.write.partitionBy("source", "lang").text(root)
    found = scan_corpus(spark, root, ["**/*.txt", "source=src1/**"], ["**/lang=fr/**"])
    folder = F.regexp_replace(directory_of(F.col("filepath")), "source=|lang=", "")
    return found.groupBy(folder.alias("folder"), "language").agg(
        F.sum("size").alias("bytes"),
        F.sum(F.octet_length("content")).alias("read_bytes"),
        F.sum(F.size(F.split("content", "\n", -1)) - 1).alias("lines"),
    )


QUERIES = {
    "store_update": store_update,
    "nearest_in_store": nearest_in_store,
    "json_sidecars": json_sidecars,
    "scan_files": scan_files,
    "detect_changes": detect_changes,
    "staleness_reason": staleness_reason,
    "deleted_files": deleted_files,
    "current_files": current_files,
    "incremental_equals_full": incremental_equals_full,
    "delete_by_key": delete_by_key,
    "index_checksum": index_checksum,
    "index_digest": index_digest,
    "validate_index": validate_index,
    "index_status": index_status,
    "language_stats": language_stats,
    "lookup_chunks": lookup_chunks,
    "chunks_reslice": chunks_reslice,
}

_CHANGES = FILES + """,
marks AS (SELECT doc_id, max(quality) - 2 * max(toxic) AS shift FROM labels GROUP BY doc_id),
stored AS (SELECT * FROM files WHERE language <> 'de'),
cur AS (SELECT f.* REPLACE (mtime + coalesce(shift, 0) AS mtime) FROM files f LEFT JOIN marks USING (doc_id) WHERE language <> 'fr'),
changes AS (SELECT coalesce(c.filepath, s.filepath) AS filepath, CASE WHEN s.filepath IS NULL THEN 'added' WHEN c.filepath IS NULL THEN 'deleted'
  WHEN c.mtime > s.mtime THEN 'modified' ELSE 'unchanged' END AS change FROM cur c FULL OUTER JOIN stored s ON c.filepath = s.filepath)"""
_CHUNKS_TOO = CHUNKS[len(FILES):]
_DIGEST = f"""WITH {CHUNKS} SELECT substr(sha256(sum(('0x' || substr(sha256(filepath), 1, 15))::BIGINT)::VARCHAR || ':' || count(*) || ':' || (SELECT count(*) FROM chunks)), 1, 16) AS checksum FROM files"""
_HINT = " Clear it and index again."

SQL = {
    "store_update": f"WITH {CHUNKS} SELECT id, filepath, content, start_line, end_line FROM chunks WHERE language <> 'fr'",
    "nearest_in_store": SEARCH_SQL["index_and_search"],
    "json_sidecars": f"WITH {CALLS} SELECT origin, type AS command, count(*) AS count FROM calls GROUP BY ALL",
    "scan_files": """SELECT source || '/' || lang AS folder, 'txt' AS language, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(strlen(text) + 1) AS BIGINT) AS read_bytes,
        CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents WHERE lang <> 'fr' GROUP BY source, lang""",
    "detect_changes": f"WITH {_CHANGES} SELECT * FROM changes",
    "staleness_reason": f"""WITH {_CHANGES}, n AS (SELECT count(*) FILTER (change='added') AS a, count(*) FILTER (change='modified') AS m, count(*) FILTER (change='deleted') AS d FROM changes)
        SELECT a + m + d > 0 AS stale, nullif(concat_ws(', ', CASE WHEN a > 0 THEN a || ' new file(s)' END, CASE WHEN m > 0 THEN m || ' modified file(s)' END,
        CASE WHEN d > 0 THEN d || ' deleted file(s)' END), '') AS reason FROM n""",
    "deleted_files": f"WITH {_CHANGES} SELECT filepath FROM stored WHERE filepath NOT IN (SELECT filepath FROM cur)",
    "current_files": f"WITH {_CHANGES} SELECT filepath FROM cur",
    "incremental_equals_full": f"WITH {CHUNKS} SELECT id, filepath, content, start_line, end_line FROM chunks WHERE language <> 'fr'",
    "delete_by_key": f"WITH {_CHANGES}{_CHUNKS_TOO} SELECT id, language FROM chunks WHERE filepath NOT IN (SELECT filepath FROM changes WHERE change IN ('modified', 'deleted'))",
    "index_checksum": _DIGEST,
    "index_digest": _DIGEST,
    "validate_index": f"""WITH {CHUNKS}, n AS (SELECT count(*) AS c FROM chunks)
        SELECT 'sound' AS "case", false AS corrupted, NULL AS reason FROM n
        UNION ALL SELECT 'missing', true, 'The index has no record of its last run.{_HINT}' FROM n
        UNION ALL SELECT 'count', true, 'The record counts ' || (c + 5) || ' chunks, the table holds ' || c || '.{_HINT}' FROM n
        UNION ALL SELECT 'files', true, 'The file table is not the one that was indexed.{_HINT}' FROM n""",
    "index_status": f"""WITH {CHUNKS}, n AS (SELECT count(*) AS c FROM chunks)
        SELECT c AS chunk_count, (SELECT count(*) FROM files) AS file_count, '2024-01-01T00:00:00.000Z' AS last_updated, 'hash' AS embedding_backend, 'md5-words-64' AS embedding_model,
        true AS corrupted, 'The record counts ' || (c + 1) || ' chunks, the table holds ' || c || '.{_HINT}' AS corruption_reason,
        true AS backend_mismatch, 'The vectors come from model md5-words-64, this embedder is other. Index again.' AS backend_mismatch_reason FROM n""",
    "language_stats": f"WITH {CHUNKS} SELECT language, count(DISTINCT filepath) AS files, count(*) AS chunks FROM chunks GROUP BY language",
    "lookup_chunks": f"WITH {CHUNKS} SELECT c.* FROM chunks c JOIN files f USING (filepath) WHERE c.start_line = 1 AND f.doc_id IN (SELECT doc_id FROM labels)",
    "chunks_reslice": f"WITH {CHUNKS} SELECT count(*) AS chunks, count(*) AS equal FROM chunks",
}
SQL["lookup_chunks"] = SQL["lookup_chunks"].replace("c.*", "c.id, c.filepath, c.content, c.start_line, c.end_line, c.language")
