"""Nearest-neighbour, hybrid, similar-passage and concept search.

Chunks carry id, filepath, content, start_line, end_line, language and embedding. Distances are
squared Euclidean, rounded to 12 decimals so that equal distances stay ties, and ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.text import WHITE_SPACE_CHARACTERS, keyword_score, path_matches, trimmed
from passagemill.functions.vectors import distinct_rows, matrix_of, near_pairs, squared_l2_to
from passagemill.session import small

DISTANCE_DIGITS = 12

# Score weights and over-fetch factors.
SEMANTIC_WEIGHT = 0.7
KEYWORD_WEIGHT = 0.3
FETCH_FACTOR = 3
FILTERED_FETCH_FACTOR = 5

# Broadcasting query vectors is allowed up to this many bytes.
BROADCAST_BYTES = 64 << 20
# Queries whose best rows a task sorts at a time.
QUERY_SLICE = 4096

RESULT_COLUMNS = ["id", "filepath", "content", "start_line", "end_line", "language"]


def with_distance(chunks: DataFrame, query_vec: Sequence[float]) -> DataFrame:
    d = F.round(squared_l2_to(F.col("embedding"), query_vec), DISTANCE_DIGITS)
    return chunks.withColumn("distance", d)


def knn(
    chunks: DataFrame, query_vec: Sequence[float], k: int, keep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The k nearest rows of those that ``keep`` leaves: a scan with a top-k per partition, no shuffle of the table."""
    chunks = chunks if keep is None else keep(chunks)
    return with_distance(chunks, query_vec).orderBy("distance", "id").limit(k)


def filter_language(df: DataFrame, languages: Sequence[str] | None) -> DataFrame:
    if not languages:
        return df
    return df.filter(F.lower("language").isin([x.lower() for x in languages]))


def filter_path(df: DataFrame, glob: str | None) -> DataFrame:
    return df if glob is None else df.filter(path_matches(F.col("filepath"), glob))


def project_result(df: DataFrame, *extra: str) -> DataFrame:
    symbols = [c for c in ("symbol_type", "symbol_name") if c in df.columns]
    return df.select(*RESULT_COLUMNS, *symbols, *extra)


def hybrid_search(
    chunks: DataFrame,
    query: str,
    query_vec: Sequence[float],
    limit: int = 10,
    path_glob: str | None = None,
    languages: Sequence[str] | None = None,
    semantic_weight: float = SEMANTIC_WEIGHT,
    keyword_weight: float = KEYWORD_WEIGHT,
    scan: Callable[..., DataFrame] = knn,
) -> DataFrame:
    """Vector search, then re-ranking by 0.7 * rank score + 0.3 * keyword score.

    Filters work on the whole table, before the top-k. Everything after the top-k runs on at most
    five times ``limit`` rows. ``scan`` is the nearest-row search, for corpora that are not a plain
    DataFrame.
    """
    filtered = path_glob is not None or bool(languages)
    fetch = limit * (FILTERED_FETCH_FACTOR if filtered else FETCH_FACTOR)

    def kept(df: DataFrame) -> DataFrame:
        return filter_language(filter_path(df, path_glob), languages)

    near = scan(chunks, query_vec, fetch, kept if filtered else None)
    by_distance = Window.orderBy("distance", "id")  # over at most `fetch` rows
    scored = near.withColumn("position", F.row_number().over(by_distance) - 1).withColumn(
        "score",
        semantic_weight * (1 - F.col("position") / F.lit(float(fetch)))
        + keyword_weight * keyword_score(query, F.col("content"), F.col("filepath")),
    )
    # equal scores keep distance order; rounding makes arithmetically equal scores equal
    best = scored.orderBy(F.round("score", DISTANCE_DIGITS).desc(), "position").limit(limit)
    return project_result(best, "position", "score")


def _similarity(threshold: float, window, same: Column) -> tuple[Column, Column]:
    """Similarity column and filter shared by the single and the batch form of similar search."""
    farthest = F.max("distance").over(window)
    similarity = F.when(farthest > 0, 1 - F.col("distance") / farthest).otherwise(F.lit(1.0))
    keep = ~same & (F.col("similarity") >= threshold)
    return similarity, keep


def similar_fetch(limit: int) -> int:
    return (limit + 5) * 2


def search_similar(
    chunks: DataFrame,
    query_vec: Sequence[float],
    location: tuple[str, int, int] | None = None,
    text: str | None = None,
    limit: int = 10,
    threshold: float = 0.0,
    exclude_self: bool = True,
    scan: Callable[..., DataFrame] = knn,
) -> DataFrame:
    """Passages like a given one, by location (path, start, end) or by text.

    similarity = 1 - distance / farthest fetched distance; the passage itself is left out after that.
    """
    if location is None and text is None:
        raise ValueError("give a location or a text")
    same = F.lit(False)
    if exclude_self and text is not None:
        same = trimmed(F.col("content")) == F.lit(text.strip(WHITE_SPACE_CHARACTERS))
    elif exclude_self:
        same = (
            (F.col("filepath") == location[0])
            & (F.col("start_line") == location[1])
            & (F.col("end_line") == location[2])
        )
    fetched = Window.partitionBy(F.lit(0))  # over the fetched rows
    similarity, keep = _similarity(threshold, fetched, same)
    near = scan(chunks, query_vec, similar_fetch(limit)).withColumn("similarity", similarity)
    return project_result(near.filter(keep).orderBy("distance", "id").limit(limit), "similarity")


# --------------------------------------------------------------------------- many queries at once


def _smallest(queries: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k smallest (distance, id) of every query."""
    _, rank = np.unique(ids, return_inverse=True)
    order = np.lexsort((rank, dist, queries))
    q = queries[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[place < k]


class _TopK:
    """Running k best rows per query over the batches of one partition, for ``QUERY_SLICE`` queries at a time."""

    def __init__(self, queries: np.ndarray, k: int):
        self.y, self.k = queries, k
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * -(-len(queries) // QUERY_SLICE)

    @property
    def ids(self) -> np.ndarray | None:
        found = [one[1] for one in self.best if one is not None]
        return np.concatenate(found) if found else None

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(x):
            return
        first = distinct_rows(x, ids, self.k)
        ids, x = ids[first], x[first]
        for place, before in enumerate(self.best):
            at = place * QUERY_SLICE
            query, row, dist = near_pairs(x, self.y[at : at + QUERY_SLICE], self.k)
            found = (query + at, ids[row], np.round(dist, DISTANCE_DIGITS))
            if before is not None:
                found = tuple(np.concatenate(c) for c in zip(before, found))
            best = _smallest(found[0], found[2], found[1], self.k)
            self.best[place] = tuple(c[best] for c in found)

    def batches(self, names: list, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        """The rows kept, a batch for each slice; ``names`` are the ids of the queries."""
        for found in self.best:
            if found is not None:
                query, ids, dist = found
                yield _pairs([names[i] for i in query], ids, dist, schema)


def _top_per_query(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def knn_batch(chunks: DataFrame, queries: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k nearest chunks of every query: query_id, id, distance, place (1..k).

    Queries (query_id, embedding) that fit the byte bound are broadcast and the chunk table is read
    once, each partition keeping k rows per query. A larger query set is cut into hash blocks that
    meet hash blocks of the chunks, so no task holds more than one block of each.
    """
    spark = chunks.sparkSession
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    c = chunks.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    first = q.first()
    if first is None:
        width = 1
    else:
        width = len(first["embedding"])
    bound = max(1, broadcast_bytes // (8 * width))
    id_type, query_type = c.schema["id"].dataType, q.schema["query_id"].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("id", id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    head = q.limit(bound + 1).toArrow()
    if head.num_rows <= bound:
        matrix = matrix_of(head.column("embedding").combine_chunks())
        shared = spark.sparkContext.broadcast((head.column("query_id").to_pylist(), matrix))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, y = shared.value
            best = _TopK(y, k)
            for batch in batches:
                if len(names):
                    best.add(_plain(batch.column("id")), matrix_of(batch.column("embedding")))
            yield from best.batches(names, schema)

        return _top_per_query(c.mapInArrow(scan, schema), k)

    n_queries = q.count()
    query_blocks = -(-n_queries // bound)
    chunk_blocks = max(1, -(-c.count() // bound))
    left = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(chunk_blocks - 1)))
    )
    right = (
        c.withColumnRenamed("embedding", "chunk_embedding")
        .withColumn("chunk_block", F.pmod(F.xxhash64("id"), F.lit(chunk_blocks)).cast("int"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    )

    def block(query_rows: pa.Table, chunk_rows: pa.Table) -> pa.Table:
        best = _TopK(matrix_of(query_rows.column("embedding").combine_chunks()), k)
        if query_rows.num_rows and chunk_rows.num_rows:
            best.add(
                _plain(chunk_rows.column("id")), matrix_of(chunk_rows.column("chunk_embedding").combine_chunks())
            )
        names = query_rows.column("query_id").to_pylist()
        none = _pairs([], np.empty(0), np.empty(0), schema)
        return pa.Table.from_batches([none, *best.batches(names, schema)])

    pairs = (
        left.groupBy(F.col("qb").cast("int").alias("a"), F.col("cb").cast("int").alias("b"))
        .cogroup(right.groupBy(F.col("query_block").cast("int").alias("a"), F.col("chunk_block").alias("b")))
        .applyInArrow(block, schema)
    )
    return _top_per_query(pairs, k)


def _plain(column) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(str) if values.dtype == object else values


def _pairs(query_ids: list, ids: np.ndarray, dist: np.ndarray, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query_ids, target.field(0).type),
            pa.array(ids.tolist(), target.field(1).type),
            pa.array(dist, target.field(2).type),
        ],
        schema=target,
    )


def search_similar_batch(
    chunks: DataFrame, sources: DataFrame, limit: int = 10, threshold: float = 0.0
) -> DataFrame:
    """Similar search for many passages of the table at once: query_id, id, similarity, place.

    Per source the result is what ``search_similar`` gives for its location, so the output grows
    with sources times limit however many copies a passage has.
    """
    near = knn_batch(chunks, sources.withColumnRenamed("id", "query_id"), similar_fetch(limit))
    similarity, keep = _similarity(threshold, Window.partitionBy("query_id"), F.col("id") == F.col("query_id"))
    kept = near.withColumn("similarity", similarity).filter(keep)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        kept.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
        .select("query_id", "id", "similarity", "place")
    )


# --------------------------------------------------------------------------- concepts


def search_by_concept(
    chunks: DataFrame,
    assignments: DataFrame,
    cluster: int,
    query_vec: Sequence[float] | None = None,
    limit: int = 10,
    representatives: DataFrame | None = None,
) -> DataFrame:
    """Passages of one cluster: its nearest to the query, or without a query the cluster's stored
    representatives (cluster_id, id, place)."""
    if query_vec is not None:
        members = assignments.filter(F.col("cluster_id") == cluster).select("id")
        return project_result(knn(chunks.join(members, "id", "left_semi"), query_vec, limit), "distance")
    stored = (
        representatives.filter(F.col("cluster_id") == cluster).orderBy("place").limit(limit).select("id", "place")
    )
    return project_result(chunks.join(small(stored, limit), "id").orderBy("place"), "place")
