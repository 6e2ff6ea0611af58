"""Attaching vectors to rows, and checking that they fit the index."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BATCH_SIZE = 256

_WORD = re.compile("[A-Za-z0-9_]+")


class HashEmbedder:
    """Offline embedder: signed word counts hashed into ``dim`` buckets, scaled to length 1.

    Any callable ``list[str] -> ndarray (n, dim)`` with ``name``, ``model`` and ``dim`` can stand in
    its place; it is sent to the tasks, so it should load heavy models on first use.
    """

    name = "hash"

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.model = f"md5-words-{dim}"
        self._known: dict[str, tuple[int, float]] = {}

    def _slot(self, word: str) -> tuple[int, float]:
        digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
        return int(digest[:8], 16) % self.dim, 1.0 if int(digest[8], 16) < 8 else -1.0

    def __call__(self, texts: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > 200_000:
            known.clear()
        rows = []
        for text in texts:
            row = [0.0] * self.dim
            for word, n in Counter(_WORD.findall(text or "")).items():
                slot = known.get(word)
                if slot is None:
                    slot = known[word] = self._slot(word.lower())
                row[slot[0]] += n * slot[1]
            rows.append(row)
        out = np.array(rows).reshape(len(texts), self.dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0)


Embedder = Callable[[list[str]], np.ndarray]


def embed(
    df: DataFrame,
    text_col: str,
    embedder: Embedder,
    batch_size: int = DEFAULT_BATCH_SIZE,
    out_col: str = "embedding",
) -> DataFrame:
    """Add the vector of ``text_col``. Arrow batches, row order kept; a failing batch fails the job."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            blocks = [
                np.asarray(embedder(texts[i : i + batch_size]), dtype=np.float32)
                for i in range(0, len(texts), batch_size)
            ]
            vectors = np.concatenate(blocks) if blocks else np.empty((0, embedder.dim), dtype=np.float32)
            if vectors.shape != (len(texts), embedder.dim):
                raise ValueError(f"embedder returned {vectors.shape}, expected {(len(texts), embedder.dim)}")
            offsets = np.arange(0, vectors.size + 1, embedder.dim, dtype=np.int32)
            column = pa.ListArray.from_arrays(offsets, vectors.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out_col])

    return df.mapInArrow(run, schema)


def embed_queries(queries: DataFrame, query_col: str, embedder: Embedder) -> DataFrame:
    """Embed every distinct query text once and hand the vector to all rows that asked it."""
    distinct = embed(queries.select(query_col).distinct(), query_col, embedder)
    return queries.join(distinct, query_col)


def check_dimensions(
    chunks: DataFrame, index_record: DataFrame, name: str, model: str, dim: int
) -> DataFrame:
    """One row (mismatch, reason): the first of dimension, model and backend that differs.

    ``index_record`` holds embedding_backend, embedding_model and embedding_dimensions of the
    index; the stored vectors' own widths are checked too.
    """
    key = F.lit(1).alias("one")
    widths = chunks.agg(F.min(F.size("embedding")).alias("narrowest"), F.max(F.size("embedding")).alias("widest"), key)
    one = widths.join(index_record.limit(1).select("*", key), "one")
    stored = F.when(F.col("narrowest") != dim, F.col("narrowest")).otherwise(
        F.when(F.col("widest") != dim, F.col("widest")).otherwise(F.col("embedding_dimensions"))
    )
    reason = (
        F.when(
            stored != dim,
            F.concat(
                F.lit("The vectors are "),
                stored.cast("string"),
                F.lit(f" wide, those of {name} are {dim} wide. Index again."),
            ),
        )
        .when(
            F.col("embedding_model") != model,
            F.concat(
                F.lit("The vectors come from model "),
                F.col("embedding_model"),
                F.lit(f", this embedder is {model}. Index again."),
            ),
        )
        .when(
            F.col("embedding_backend") != name,
            F.concat(
                F.lit("The vectors come from "),
                F.col("embedding_backend"),
                F.lit(f", this embedder is {name}. Index again."),
            ),
        )
    )
    return one.select(reason.isNotNull().alias("mismatch"), reason.alias("reason"))
