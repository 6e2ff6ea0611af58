import hashlib
import math
import random

import numpy as np
import pytest

from passagemill.llm import orchard, queries
from tests.oracle import compare, duck


def plain(rows, k=16, rounds=3, dimension=64, scale=64, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for o, (_, v) in zip(own, kept) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = {c: sum(d for _, d, o in last if o == c) for c in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, d, c in last], key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_all_vectors(spark, sf, shared):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(queries.op13_orchard_clustering(spark, sf)) == plain(rows)


def test_sql(spark, sf, shared):
    assert compare(spark, duck(sf), sf, queries.op13_orchard_clustering, orchard.sql()) is None


def test_search_is_exact_with_ties_and_measures_less():
    rng = np.random.default_rng(1)
    for spread, k, width in ((2, 30, 3), (40, 200, 4), (5, 1, 2), (1, 9, 2)):
        points = rng.integers(-spread, spread + 1, (k, width))
        vectors = rng.integers(-spread - 1, spread + 2, (3000, width))
        centroids = orchard.Centroids(points)
        found, best = centroids.nearest(vectors)
        every = ((vectors[:, None, :] - points) ** 2).sum(axis=2)
        assert (found == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        assert centroids.measured <= 3000 * k
    middles = rng.integers(-1000, 1000, (200, 4))
    centroids = orchard.Centroids(middles)
    centroids.nearest(middles[rng.integers(0, 200, 3000)] + rng.integers(-9, 10, (3000, 4)))
    assert centroids.measured < 3000 * 200 / 4


def test_other_parameters(spark, shared):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.5]) for _ in range(3)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "n long, vec array<double>").repartition(5)
    for k, rounds in ((5, 0), (40, 2), (500, 1)):
        assert rows_of(orchard.cluster(frame, "n", "vec", k, rounds, 3, 4, 8)) == plain(rows, k, rounds, 3, 4, 8)


def test_odd_rows(spark, shared):
    rng = random.Random(4)
    good = lambda: [rng.uniform(-2, 2) for _ in range(64)]
    same = good()
    rows = [(None, good()), (None, None), (1, []), (2, good()[:63]), (3, good() + [1.0]), (4, [None, *good()[1:]]), (5, [float("nan"), *good()[1:]]), (6, [float("-inf"), *good()[1:]])]
    rows += [(7, same)] * 40 + [(8 + i, same) for i in range(30)] + [(100 + i, good()) for i in range(30)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int")
    assert rows_of(orchard.cluster(frame)) == plain(rows)
    few = rows[-3:]
    assert rows_of(orchard.cluster(frame.where("vec_id >= 127"))) == plain(few)
    assert orchard.cluster(frame.limit(0)).count() == 0 and orchard.cluster(frame.where("vec_id = 1")).columns == orchard.cluster(frame).columns
    with pytest.raises(Exception, match="would not fit a long"):
        orchard.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="k must be"):
        orchard.cluster(frame, k=0)
