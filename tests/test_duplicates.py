import math

import numpy as np
import pytest

from passagemill.operators import duplicates


def plain(rows, threshold):
    """Every pair of rows by definition."""
    sound = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if k is not None and v is not None and any(v)]
    out = {k: (k, 0) for k, _ in rows}
    if sound:
        x = np.stack([v / np.sqrt((v * v).sum()) for _, v in sound])
        near = x @ x.T >= threshold - 1e-12
        left = set(range(len(sound)))
        while left:
            todo, seen = [min(left)], {min(left)}
            while todo:
                new = set(np.flatnonzero(near[todo.pop()]).tolist()) & left - seen
                seen |= new
                todo.extend(new)
            for i in seen:
                out[sound[i][0]] = (min(sound[j][0] for j in seen), int(near[i].sum()) - 1)
            left -= seen
    return out


def made(n, seed=1, width=16):
    """A third are copies of one vector, some drift around a few centres, the rest are alone."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, width))
    out = []
    for i in range(n):
        v = centres[0] if i % 3 == 0 else centres[i % 4] + 0.12 * rng.standard_normal(width) if i % 3 == 1 else rng.standard_normal(width)
        out.append((i * 7 % n, np.float32(v).tolist()))
    return out


def grouped(spark, rows, **more):
    frame = spark.createDataFrame(rows, "id long, vec array<float>").repartition(4)
    got = duplicates.near_duplicate_groups(frame, "id", "vec", **more).collect()
    assert len(got) == len(rows)
    return {r.id: (r.class_id, r.links) for r in got}


@pytest.mark.parametrize("crowded", [256, 3])
def test_groups_equal_all_pairs(spark, crowded):
    rows = made(300)
    assert grouped(spark, rows, threshold=0.9, crowded=crowded) == plain(rows, 0.9)


def test_recall_of_a_sample_against_all_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((600, 24))
    x = np.repeat(base, 3, axis=0) + 0.28 * rng.standard_normal((1800, 24))  # cosines around the threshold
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    with duplicates.Scratch(spark) as own:
        got = {(r.a, r.b) for r in duplicates.near_pairs(own, frame, 0.92, crowded=20).collect()}
    want = {(min(i, j), max(i, j)) for i in range(0, 1800, 100) for j in np.flatnonzero(x @ x[i] >= 0.92).tolist() if i != j}
    assert want and len(want & got) >= 0.9 * len(want)
    every = (x @ x.T >= 0.92).sum() // 2 - 900
    assert len(got) >= 0.99 * every


def test_bands_find_a_pair_at_the_threshold():
    for threshold in (0.5, 0.9, 0.99, 1.0):
        for planes in (6, 18, 60):
            same = (1 - math.acos(threshold) / math.pi) ** planes
            assert (1 - same) ** duplicates.bands_needed(threshold, planes) <= duplicates.MISS


def test_long_chains_are_one_class(spark):
    rows = [(i, [math.cos(i * 0.02), math.sin(i * 0.02)]) for i in range(150)]
    assert grouped(spark, rows, threshold=0.9997) == plain(rows, 0.9997)
    assert {c for c, _ in grouped(spark, rows, threshold=0.9997).values()} == {0}


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [0.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, -1.0]), (8, [-0.0, -1.0])]
    assert grouped(spark, rows) == plain(rows, 0.95) and grouped(spark, rows)[2] == (1, 2)
    assert grouped(spark, rows[3:4]) == {4: (4, 0)}
    frame = spark.createDataFrame(rows, "id long, vec array<float>")
    assert duplicates.near_duplicate_groups(frame.limit(0), "id", "vec").count() == 0
    with pytest.raises(Exception, match="null, NaN or infinity"):
        duplicates.near_duplicate_groups(spark.createDataFrame([(1, [float("nan")])], "id long, vec array<float>"), "id", "vec")
    with pytest.raises(ValueError, match="threshold"):
        duplicates.near_duplicate_groups(frame, "id", "vec", threshold=0)


def test_rows_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, np.float32(base + 0.002 * rng.standard_normal(16)).tolist()) for i in range(400)]  # each near every other: 79,800 pairs
    sizes = {}
    own = duplicates.Scratch.stage
    monkeypatch.setattr(duplicates.Scratch, "stage", lambda self, df, name: (frame := own(self, df, name), sizes.update({name: max(sizes.get(name, 0), frame.count())}))[0])
    assert set(grouped(spark, rows, threshold=0.999).values()) == {(0, 399)}
    assert sizes and max(sizes.values()) <= 20 * len(rows)
    whole, sizes["links"] = sizes["links"], 0
    assert grouped(spark, rows, threshold=0.999, crowded=64)[7] == (0, 399) and sizes["links"] > whole


def test_a_pair_of_several_bands_counts_once(spark):
    rows = made(200, seed=9)
    frame = spark.createDataFrame([(k, v) for k, v in rows], "node long, v array<float>").repartition(4)
    for crowded in (1000, 7):
        with duplicates.Scratch(spark) as own:
            got = [(r.a, r.b) for r in duplicates.near_pairs(own, frame, 0.9, crowded=crowded).collect()]
        x = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
        assert sorted(got) == sorted((a, b) for a in x for b in x if a < b and x[a] @ x[b] >= 0.9 + 1e-9 or a < b and abs(x[a] @ x[b] - 0.9) < 1e-9)
