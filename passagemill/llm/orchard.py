"""Centroid clustering in whole numbers; a vector's nearest centroid by Orchard's search.

Every centroid has a list of all centroids by their distance to it. A search starts at some centroid and goes
down its list; whenever a closer centroid is found it goes on with that one's list from the top. What was
looked at is marked and not measured again. A list is left once its next entry is strictly more than twice as
far from its owner as the vector is: by the triangle inequality nothing from there on can be as near, so what
was found is exact, ties included. The vectors of an Arrow batch search together, each at its own place.

A round sends one sum for each centroid and component from each task; centroids are the only thing that
passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import stage

DIMENSION, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: The lists are two square tables in every worker (50 MB at this number).
MAX_CENTROIDS = 2048
#: Vectors that search together.
_TOGETHER = 4096


class Centroids:
    """Centroids with their neighbour lists."""

    def __init__(self, points: np.ndarray):
        self.points = points
        k = len(points)
        gaps = np.stack([((points - p) ** 2).sum(axis=1) for p in points])
        #: Of each centroid all centroids by distance, itself first among its equals.
        self.order = np.empty((k, k), np.int32)
        self.gaps = np.full((k, k + 1), np.iinfo(np.int64).max)
        for i in range(k):
            self.order[i] = np.lexsort((np.arange(k) != i, gaps[i]))
            self.gaps[i, :k] = gaps[i][self.order[i]]
        self.measured = 0

    def _distance(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        self.measured += len(numbers)
        apart = vectors - self.points[numbers]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the number of the nearest centroid (of equals the smallest) and the squared distance."""
        n = len(vectors)
        owner, found, at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)
        best = self._distance(vectors, owner)
        seen = np.zeros((n, len(self.points)), bool)
        seen[:, 0] = True
        going = np.arange(n)
        while len(going):
            going = going[self.gaps[owner[going], at[going]] <= 4 * best[going]]
            candidate = self.order[owner[going], np.minimum(at[going], len(self.points) - 1)].astype(np.int64)
            at[going] += 1
            new = ~seen[going, candidate]
            who, candidate = going[new], candidate[new]
            seen[who, candidate] = True
            distance = self._distance(vectors[who], candidate)
            tied = (distance == best[who]) & (candidate < found[who])
            found[who[tied]] = candidate[tied]
            closer = distance < best[who]
            who, candidate = who[closer], candidate[closer]
            owner[who], found[who], best[who], at[who] = candidate, candidate, distance[closer], 1
        return found, best


def whole_vectors(vectors: DataFrame, key: str, vector: str, dimension: int, scale: int) -> DataFrame:
    """id long, v array<bigint>: floor(scale * x) of the vectors with ``dimension`` components, all finite; written to the shared folder."""
    # squared distances, four times over, must fit a long
    most = int((2.0**61 / dimension) ** 0.5 / 2)
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x))
    fits = F.forall("v", lambda x: F.abs(F.lit(float(scale)) * x) < F.lit(float(most)))
    kept = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kept = kept.where((F.size("v") == dimension) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component is {most} or more: distances would not fit a long")).cast("array<bigint>"))
    return stage(kept.select("id", checked.alias("v")), "vectors")


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest digests of ``seed:id`` in that order; equal digests by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = whole.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(frame: pa.RecordBatch) -> np.ndarray:
    values = frame.column(frame.schema.get_field_index("v"))
    return values.flatten().to_numpy().reshape(frame.num_rows, -1)


def _slices(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for at in range(0, frame.num_rows, _TOGETHER):
            yield frame.slice(at, _TOGETHER)


def moved(whole: DataFrame, points: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of the mean of its vectors; one without vectors stays."""
    shared = whole.sparkSession.sparkContext.broadcast(points)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(shared.value)
        k, width = shared.value.shape
        sums, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for frame in _slices(frames):
            own = _matrix(frame)
            found, _ = centroids.nearest(own)
            by = np.argsort(found, kind="stable")
            numbers, starts = np.unique(found[by], return_index=True)
            sums[numbers] += np.add.reduceat(own[by], starts, axis=0)
            n += np.bincount(found, minlength=k)
        used = np.flatnonzero(n)
        columns = [np.repeat(used, width), np.tile(np.arange(width), len(used)), sums[used].ravel(), np.repeat(n[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["c", "i", "s", "n"])

    parts = whole.select("v").mapInArrow(run, "c long, i long, s long, n long")
    total = parts.groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = points.copy()
    for r in total.collect():  # at most centroids x components
        out[r.c, r.i] = int(r.s) // r.n
    return out


def assigned(whole: DataFrame, points: np.ndarray) -> DataFrame:
    """id, cluster int, distance long (squared) of every vector, written to the shared folder."""
    shared = whole.sparkSession.sparkContext.broadcast(points)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(shared.value)
        for frame in _slices(frames):
            found, distance = centroids.nearest(_matrix(frame))
            columns = [frame.column(frame.schema.get_field_index("id")), pa.array(found.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return stage(whole.mapInArrow(run, "id long, cluster int, distance long"), "assigned")


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``key`` long, cluster int, distance long, cluster_inertia, inertia long, centroid_sha256 string, one row per kept vector.

    Vectors that are null, of another size, or hold a null, NaN or infinite component are left out; repeated
    rows and rows without an id are vectors of their own (no id: digest of the seed alone). Fewer vectors than
    ``k`` are each a centroid; equal centroids leave all vectors to the smaller number. An empty table gives no
    rows. A component too large for exact distances in a long is an error.
    """
    if not 0 < k <= MAX_CENTROIDS:
        raise ValueError(f"k must be from 1 to {MAX_CENTROIDS}")
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, key, vector, dimension, scale)
    points = first_centroids(whole, k, seed)
    ends = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(points):
        return spark.createDataFrame([], ends)
    for _ in range(rounds):
        points = moved(whole, points)
    found = assigned(whole, points)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    digests = {c: hashlib.sha256(",".join(map(str, points[c].tolist())).encode()).hexdigest() for c in sums}
    rows = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    about = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(about, "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The rounds written out, every distance measured."""
    out = ["""WITH v0 AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), v AS MATERIALIZED (SELECT * FROM v0)"""]
    out.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS p FROM v ORDER BY c LIMIT {k})")
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        out.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM (SELECT *, {distance} AS d FROM v, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            mean = f"SELECT c, list(m ORDER BY j) AS p FROM (SELECT c, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c"
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.p::BIGINT[], o.p) AS p FROM c{i} o LEFT JOIN ({mean}) n ON o.c = n.c)")
    last = f"""SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(p, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""
    return ",\n".join(out) + "\n" + last
