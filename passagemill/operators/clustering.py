"""Topic clusters: assignment, centroids, k-means, labels, keywords, silhouette.

Vectors: id, embedding. Assignments: id, cluster_id. Centroids: cluster_id, centroid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.text import directory_of
from passagemill.functions.vectors import matrix_of, nearest_rows
from passagemill.session import bounded_rows, small, stage

# Bounds of the number of clusters, and defaults of the iteration.
LEAST_CLUSTERS, MOST_CLUSTERS = 3, 20
MAX_ITERATIONS = 100
CONVERGENCE = 0.001
REPRESENTATIVES = 3
KEYWORDS = 10
SYMBOL_WORD_WEIGHT = 3
LEAST_WORD_LENGTH = 4

# Words that never become keywords.
STOP_WORDS = [
    "function",
    "const",
    "let",
    "var",
    "return",
    "if",
    "else",
    "for",
    "while",
    "import",
    "export",
    "from",
    "class",
    "interface",
    "type",
    "async",
    "await",
    "new",
    "this",
    "true",
    "false",
    "null",
    "undefined",
    "public",
    "private",
    "static",
    "void",
    "string",
    "number",
    "boolean",
    "any",
    "def",
    "self",
    "none",
    "pass",
    "try",
    "except",
    "catch",
    "throw",
    "throws",
    "extends",
    "implements",
    "default",
    "case",
    "break",
    "continue",
]

# Centroids are handed to every task; this many numbers are allowed.
CENTROID_NUMBERS = 8_000_000


def default_clusters(n: int) -> int:
    return max(LEAST_CLUSTERS, min(MOST_CLUSTERS, math.ceil(math.sqrt(n / 2))))


def _centroid_matrix(centroids: DataFrame) -> tuple[list[int], np.ndarray]:
    first = centroids.first()
    width = max(1, len(first["centroid"])) if first else 1
    rows = bounded_rows(centroids, CENTROID_NUMBERS // width, "centroids")
    rows.sort(key=lambda r: r["cluster_id"])
    return [r["cluster_id"] for r in rows], np.array([r["centroid"] for r in rows], dtype=np.float64)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, cluster_id, distance to the nearest centroid; the lowest cluster wins ties."""
    names, matrix = _centroid_matrix(centroids)
    id_type = vectors.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("cluster_id", T.IntegerType()),
            T.StructField("distance", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best, dist = nearest_rows(matrix, matrix_of(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.array(names, dtype=np.int32)[best]),
                    pa.array(dist),
                ],
                ["id", "cluster_id", "distance"],
            )

    return vectors.select("id", "embedding").mapInArrow(run, schema)


def _mean_of_sums(sums: DataFrame) -> DataFrame:
    """Per-partition sums (cluster_id, n, total) -> cluster_id, size, centroid."""
    parts = sums.select("cluster_id", "n", F.posexplode("total").alias("pos", "value"))
    cells = parts.groupBy("cluster_id", "pos").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", (F.col("value") / F.col("n")).alias("mean"))))
    return cells.groupBy("cluster_id").agg(
        F.first("n").alias("size"), F.transform(ordered, lambda p: p["mean"]).alias("centroid")
    )


_SUMS = "cluster_id int, n bigint, total array<double>"


def _sums(groups: np.ndarray, x: np.ndarray, into: dict) -> None:
    names, inverse = np.unique(groups, return_inverse=True)
    counts = np.bincount(inverse, minlength=len(names))
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    totals = np.add.reduceat(x[np.argsort(inverse, kind="stable")], starts, axis=0)
    for name, total, count in zip(names.tolist(), totals, counts.tolist()):
        n, t = into.get(name, (0, 0.0))
        into[name] = (n + count, t + total)


def _sums_batch(sums: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(sums), pa.int32()),
            pa.array([n for n, _ in sums.values()], pa.int64()),
            pa.array([t.tolist() for _, t in sums.values()], pa.list_(pa.float64())),
        ],
        ["cluster_id", "n", "total"],
    )


def centroids(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """Mean vector and size per cluster: each partition sends one sum per cluster."""
    joined = vectors.select("id", "embedding").join(assignments.select("id", "cluster_id"), "id")
    return centroids_of(joined)


def centroids_of(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if batch.num_rows:
                _sums(batch.column("cluster_id").to_numpy(zero_copy_only=False), matrix_of(batch.column("embedding")), sums)
        if sums:
            yield _sums_batch(sums)

    return _mean_of_sums(members.select("cluster_id", "embedding").mapInArrow(run, _SUMS))


def lloyd_step(vectors: DataFrame, start: DataFrame) -> DataFrame:
    """New centroids after one assignment round: one pass, assignment and sums in the same task."""
    names, matrix = _centroid_matrix(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("embedding"))
                best, _ = nearest_rows(matrix, x)
                _sums(np.array(names, dtype=np.int32)[best], x, sums)
        if sums:
            yield _sums_batch(sums)

    return _mean_of_sums(vectors.select("embedding").mapInArrow(run, _SUMS))


def renumber_by_size(clusters: DataFrame) -> DataFrame:
    """Old id -> new id, largest cluster first. One row per cluster goes in."""
    order = Window.orderBy(F.col("size").desc(), "cluster_id")
    return clusters.select("cluster_id", (F.row_number().over(order) - 1).alias("new_id"))


def kmeans(
    vectors: DataFrame,
    k: int | None = None,
    max_iter: int = MAX_ITERATIONS,
    tol: float = CONVERGENCE,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids with size), clusters numbered by size.

    ``vectors`` should be a stored table: it is read once per iteration.
    """
    n = vectors.count()
    spark = vectors.sparkSession
    if n == 0:
        empty = vectors.select("id", F.lit(0).alias("cluster_id")).limit(0)
        return empty, spark.createDataFrame([], "cluster_id int, size bigint, centroid array<double>")
    wanted = min(default_clusters(n) if k is None else k, n)
    if wanted <= 1:
        assigned = vectors.select("id", "embedding", F.lit(0).alias("cluster_id"))
        return assigned.select("id", "cluster_id"), centroids_of(assigned)
    points = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=wanted, maxIter=max_iter, tol=tol, seed=seed, initMode="k-means||").fit(points)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    found = spark.createDataFrame(centers, "cluster_id int, centroid array<double>")
    # staged: sizes, numbering and assignments all read it
    raw = stage(nearest_centroid(vectors, found), "assignments")
    sizes = raw.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    clusters = sizes.join(found, "cluster_id")
    mapping = small(renumber_by_size(clusters), wanted)
    assigned = raw.join(mapping, "cluster_id").select("id", F.col("new_id").cast("int").alias("cluster_id"))
    numbered = clusters.join(mapping, "cluster_id").select(
        F.col("new_id").cast("int").alias("cluster_id"), "size", "centroid"
    )
    return assigned, numbered


def representatives(
    vectors: DataFrame, assignments: DataFrame, centers: DataFrame, n: int = REPRESENTATIVES
) -> DataFrame:
    """The n members nearest to their own centroid: cluster_id, id, place, distance.

    The rank filter is pushed below the shuffle, so a huge cluster sends n rows per partition.
    """
    names, matrix = _centroid_matrix(centers)
    row_of = {name: i for i, name in enumerate(names)}
    members = vectors.select("id", "embedding").join(assignments.select("id", "cluster_id"), "id")
    schema = T.StructType(
        [
            T.StructField("cluster_id", T.IntegerType()),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array([row_of[c] for c in batch.column("cluster_id").to_pylist()])
            diff = matrix_of(batch.column("embedding")) - matrix[own]
            dist = np.round(np.sqrt((diff * diff).sum(axis=1)), 12)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cluster_id").cast(pa.int32()), batch.column("id"), pa.array(dist)],
                ["cluster_id", "id", "distance"],
            )

    near = members.mapInArrow(run, schema)
    order = Window.partitionBy("cluster_id").orderBy("distance", "id")
    return (
        near.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
        .select("cluster_id", "id", "place", "distance")
    )


# --------------------------------------------------------------------------- labels and keywords


def _most_common(members: DataFrame, values: list[str]) -> DataFrame:
    """cluster_id and per column its most frequent non-null value, first by name among equals.

    One pass and no join: the columns are counted together and then turned into (name, value) rows.
    """
    counts = members.groupBy("cluster_id", *values).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("what"), F.col(v).alias("value")) for v in values]))
    sums = counts.select("cluster_id", "n", pairs.alias("p")).groupBy("cluster_id", "p").agg(F.sum("n").alias("n"))

    def commonest(what: str):
        wanted = (F.col("p.what") == what) & F.col("p.value").isNotNull()
        return F.min(F.when(wanted, F.struct(-F.col("n"), F.col("p.value").alias("v"))))["v"].alias(what)

    return sums.groupBy("cluster_id").agg(*[commonest(v) for v in values])


def word_counts(members: DataFrame) -> DataFrame:
    """cluster_id, word, weight over the members' content and symbol names."""
    words = F.regexp_extract_all("content", F.lit("([a-zA-Z][a-zA-Z0-9_]*[a-zA-Z0-9])"), 1)
    in_text = members.select("cluster_id", F.explode(words).alias("word"), F.lit(1).alias("weight"))
    if "symbol_name" in members.columns:
        parts = F.regexp_extract_all("symbol_name", F.lit("([A-Z]?[a-z]+)"), 1)
        named = members.filter(F.col("symbol_name").isNotNull()).select(
            "cluster_id", F.explode(parts).alias("word"), F.lit(SYMBOL_WORD_WEIGHT).alias("weight")
        )
        in_text = in_text.unionByName(named)
    lowered = in_text.withColumn("word", F.lower("word"))
    counted = lowered.filter((F.length("word") >= LEAST_WORD_LENGTH) & ~F.col("word").isin(*STOP_WORDS))
    return counted.groupBy("cluster_id", "word").agg(F.sum("weight").alias("weight"))


def cluster_keywords(members: DataFrame, n: int = KEYWORDS) -> DataFrame:
    """Top words per cluster: cluster_id, word, weight, place; equal weights go by name."""
    order = Window.partitionBy("cluster_id").orderBy(F.col("weight").desc(), "word")
    return word_counts(members).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def keyword_lists(keywords: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("place", "word")))
    return keywords.groupBy("cluster_id").agg(F.transform(ordered, lambda p: p["word"]).alias("keywords"))


def cluster_labels(members: DataFrame, representative_keywords: DataFrame | None = None) -> DataFrame:
    """cluster_id, label: last part of the commonest directory and commonest symbol type with an s.

    Without either: the first two keywords of the representatives joined by &, else ``Code``.
    members: cluster_id, filepath, optionally symbol_type.
    """
    placed = members.withColumn("dir", directory_of(F.col("filepath")))
    parts = [F.element_at(F.split("dir", "/"), -1)]
    if "symbol_type" in members.columns:
        label = _most_common(placed, ["dir", "symbol_type"])
        parts.append(F.concat("symbol_type", F.lit("s")))
    else:
        label = _most_common(placed, ["dir"])
    text = F.concat_ws(" ", *parts)
    fallback = F.lit("Code")
    if representative_keywords is not None:
        label = label.join(representative_keywords, "cluster_id", "left")
        joined = F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 2), " & ")
        fallback = F.when(joined != "", joined).otherwise(F.lit("Code"))
    return label.select("cluster_id", F.when(text != "", text).otherwise(fallback).alias("label"))


# --------------------------------------------------------------------------- silhouette

MOST_MEASURED_CLUSTERS = 100_000


def silhouette(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row: mean silhouette over all points on squared distances (0 for one cluster, 0 inner for a cluster of one).

    The mean squared distance of a point x to a cluster of n points with vector sum S and sum of squared
    norms Q is |x|^2 - 2 x S / n + Q / n, so one pass sums per cluster and a second measures each point:
    linear in the points. The clusters' sums travel to the tasks, at most ``MOST_MEASURED_CLUSTERS`` of them.
    """
    members = vectors.select("id", "embedding").join(assignments.select("id", "cluster_id"), "id").select("embedding", "cluster_id")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("embedding"))
                names, at = np.unique(batch.column("cluster_id").to_numpy(), return_inverse=True)
                sums = np.zeros((len(names), x.shape[1] + 2))
                np.add.at(sums, at, np.column_stack([np.ones(len(x)), (x * x).sum(axis=1), x]))
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(sums.tolist())], names=["cluster_id", "sums"])

    partial = members.mapInArrow(add_up, "cluster_id long, sums array<double>")
    cells = partial.select("cluster_id", F.posexplode("sums")).groupBy("cluster_id", "pos").agg(F.sum("col").alias("value"))
    rows = bounded_rows(
        cells.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda c: c["value"]).alias("sums")),
        MOST_MEASURED_CLUSTERS,
        "clusters",
    )
    names = np.array(sorted(r["cluster_id"] for r in rows), dtype=np.int64)
    by_name = {r["cluster_id"]: r["sums"] for r in rows}
    table = np.array([by_name[n] for n in names.tolist()])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, points = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size, norms, sums = table[:, 0], table[:, 1], table[:, 2:]
            x = matrix_of(batch.column("embedding"))
            own = np.searchsorted(names, batch.column("cluster_id").to_numpy())
            row = np.arange(len(x))
            whole = np.maximum(size * (x * x).sum(axis=1)[:, None] - 2.0 * (x @ sums.T) + norms, 0.0)
            inner = whole[row, own] / np.maximum(size[own] - 1, 1)
            means = whole / size
            means[row, own] = np.inf
            outer = means.min(axis=1)
            most = np.maximum(inner, outer)
            known = np.isfinite(outer) & (most > 0)
            total += float(((outer[known] - inner[known]) / most[known]).sum())
            points += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([points])], names=["total", "points"])

    parts = members.mapInArrow(measure, "total double, points long")
    mean = F.sum("total") / F.sum("points")
    return parts.agg(F.coalesce(F.when(F.sum("points") > 0, mean), F.lit(0.0)).alias("silhouette"))
