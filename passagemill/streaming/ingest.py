"""Indexing a stream of changed files into the chunk store."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill.operators.embedding import embed
from passagemill.sources.store import CHUNK_SCHEMA, ChunkStore
from passagemill.streaming.sinks import fan_out


def ingest(
    files: DataFrame,
    store: ChunkStore,
    chunker: Callable[[DataFrame], DataFrame],
    embedder,
    checkpoint: str,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Chunk and embed arriving files and replace their chunks in the store.

    Of several versions of a file in one micro-batch the newest by ``mtime`` counts. Replacing is
    idempotent, so a batch repeated after a failure leaves the same table.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        fields = [c for c in batch.columns if c not in ("filepath", "mtime")]
        newest = batch.groupBy("filepath").agg(F.max(F.struct("mtime", *fields)).alias("f"))
        current = newest.select("filepath", "f.*")
        chunks = embed(chunker(current), "content", embedder).select(*CHUNK_SCHEMA.names)
        if store.exists():
            store.replace_files(current, chunks)
        else:
            store.write_chunks(chunks)

    return fan_out(files, {"store": upsert}, checkpoint, "append", trigger)
