import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.functions.vectors import cosine, l2, literal_vector
from passagemill.operators import search
from passagemill.operators.embedding import HashEmbedder, check_dimensions, embed
from passagemill.plans import roles

CHUNK = "id string, filepath string, content string, start_line int, end_line int, language string, embedding array<float>"


def chunks(spark, rows):
    return spark.createDataFrame(
        [(i, path, text, 1, 5, lang, [float(x) for x in v]) for i, path, text, lang, v in rows], CHUNK
    )


@pytest.mark.parametrize(
    "a,b,value",
    [([1, 2, 3], [1, 2, 3], 1), ([1, 0], [0, 1], 0), ([1, 0], [-1, 0], -1), ([0, 0], [1, 1], 0), ([1], [1, 1], 0)],
)
def test_cosine(spark, a, b, value):
    df = spark.createDataFrame([([float(x) for x in a],)], "v array<double>")
    assert df.select(cosine(F.col("v"), literal_vector(b))).first()[0] == pytest.approx(value)


def test_l2_and_unequal_lengths(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert df.select(l2(F.col("v"), literal_vector([3, 4]))).first()[0] == 5
    with pytest.raises(Exception, match="same length"):
        df.select(l2(F.col("v"), literal_vector([3]))).collect()
    with pytest.raises(Exception, match="same length"):
        df.select(cosine(F.col("v"), literal_vector([3]), strict=True)).collect()


def test_filters(spark):
    table = chunks(
        spark,
        [
            ("1", "src/app.ts", "x", "typescript", [0, 1]),
            ("2", "test/utils.test.ts", "x", "typescript", [0, 2]),
            ("3", "src/app.py", "x", "python", [0, 3]),
        ],
    )
    def found(**kw):
        return [r["filepath"] for r in search.hybrid_search(table, "x", [0, 0], 10, **kw).collect()]

    assert found(path_glob="!test/**") == ["src/app.ts", "src/app.py"]
    assert found(path_glob="src/**", languages=["typescript"]) == ["src/app.ts"]
    assert found(languages=["TypeScript"]) == ["src/app.ts", "test/utils.test.ts"]


def test_keyword_match_beats_rank(spark):
    rows = [(f"{i:02d}", f"f{i}", "nothing", "en", [0.0, i]) for i in range(30)]
    rows[9] = ("09", "f9", "needle here", "en", [0.0, 9])
    best = search.hybrid_search(chunks(spark, rows), "needle", [0, 0], 10).first()
    assert best["id"] == "09" and best["score"] == pytest.approx(0.7 * (1 - 9 / 30) + 0.3)


def test_similar_by_text_and_threshold(spark):
    table = chunks(
        spark,
        [("1", "a", " same\n", "en", [0, 0]), ("2", "b", "near", "en", [math.sqrt(0.1), 0]), ("3", "c", "far", "en", [math.sqrt(0.9), 0])],
    )
    got = search.search_similar(table, [0, 0], text="same", threshold=0.5).collect()
    assert [(r["id"], round(r["similarity"], 3)) for r in got] == [("2", 0.889)]
    everything = search.search_similar(table, [0, 0], text="same", exclude_self=False).collect()
    assert [r["id"] for r in everything] == ["1", "2", "3"]
    by_place = search.search_similar(table, [0, 0], location=("a", 1, 5)).collect()
    assert [r["id"] for r in by_place] == ["2", "3"]


def test_all_equal_distances_count_as_similar(spark):
    table = chunks(spark, [("1", "a", "x", "en", [0, 0]), ("2", "b", "y", "en", [0, 0])])
    assert [r["similarity"] for r in search.search_similar(table, [0, 0], text="q").collect()] == [1.0, 1.0]


def brute_knn(ids, x, queries, y, k):
    out = set()
    for name, q in zip(queries, y):
        d = np.round(((x - q) ** 2).sum(axis=1), 12)
        for place, (dist, i) in enumerate(sorted(zip(d.tolist(), ids))[:k], start=1):
            out.add((name, i, place))
    return out


@pytest.mark.parametrize("bytes_allowed", [1 << 20, 40 * 8 * 4])
def test_knn_batch_with_a_third_of_copies(spark, bytes_allowed):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    x[:100] = x[0]
    ids = [f"c{i:03d}" for i in range(300)]
    table = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, embedding array<float>")
    got = search.knn_batch(table, table.withColumnRenamed("id", "query_id"), 7, broadcast_bytes=bytes_allowed)
    assert {(r["query_id"], r["id"], r["place"]) for r in got.collect()} == brute_knn(
        ids, x.astype(np.float64), ids, x.astype(np.float64), 7
    )


def test_batch_equals_single_search(spark, sf):
    table = roles.vectors(spark, sf)
    batch = {}
    for r in search.search_similar_batch(table, table, 3).collect():
        batch.setdefault(r["query_id"], {})[r["place"]] = (r["id"], round(r["similarity"], 9))
    rows = {r["id"]: r["embedding"] for r in table.collect()}
    full = table.select(
        "id", F.col("id").cast("string").alias("filepath"), F.lit("").alias("content"), F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"), F.lit("en").alias("language"), "embedding",
    )
    for i in random.Random(3).sample(sorted(rows), 5):
        single = search.search_similar(full, rows[i], location=(str(i), 1, 1), limit=3).collect()
        assert [batch[i][p] for p in (1, 2, 3)] == [(r["id"], round(r["similarity"], 9)) for r in single]


def test_concept_without_query_gives_representatives(spark):
    table = chunks(spark, [(str(i), f"f{i}", "t", "en", [i, 0]) for i in range(6)])
    reps = spark.createDataFrame([(0, "4", 1), (0, "2", 2), (1, "5", 1)], "cluster_id int, id string, place int")
    assigned = spark.createDataFrame([(str(i), i % 2) for i in range(6)], "id string, cluster_id int")
    got = search.search_by_concept(table, assigned, 0, limit=10, representatives=reps).collect()
    assert [r["id"] for r in got] == ["4", "2"]
    near = search.search_by_concept(table, assigned, 1, [0, 0], limit=1).collect()
    assert [r["id"] for r in near] == ["1"]


def test_embedder_rejects_wrong_shape(spark):
    class Broken(HashEmbedder):
        def __call__(self, texts):
            return np.zeros((len(texts), 3))

    with pytest.raises(Exception, match="embedder returned"):
        embed(spark.createDataFrame([("x",)], "t string"), "t", Broken()).collect()


def test_embed_keeps_order_over_batches(spark):
    texts = [f"word{i} other{i % 7}" for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    want = HashEmbedder()(texts).astype(np.float32)
    got = embed(df, "t", HashEmbedder(), batch_size=64).orderBy("i").collect()
    assert np.array_equal(np.array([r["embedding"] for r in got], dtype=np.float32), want)


def test_stored_width_is_checked(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "id string, embedding array<float>")
    record = spark.createDataFrame([("hash", "m", 2)], "embedding_backend string, embedding_model string, embedding_dimensions int")
    assert check_dimensions(df, record, "hash", "m", 2).first()["mismatch"]
    assert not check_dimensions(df.filter("id = 'a'"), record, "hash", "m", 2).first()["mismatch"]


def test_limits_are_not_capped_and_filters_come_first(spark):
    rows = [(f"{i:03d}", f"f{i}", "t", "de" if i >= 198 else "en", [0.0, i]) for i in range(200)]
    table = chunks(spark, rows)
    assert search.hybrid_search(table, "x", [0, 0], limit=120).count() == 120
    assert search.search_similar(table, [0, 0], text="q", limit=150).count() == 150
    assert {r["id"] for r in search.hybrid_search(table, "x", [0, 0], limit=2, languages=["de"]).collect()} == {"198", "199"}
    assigned = spark.createDataFrame([(r[0], int(r[3] == "de")) for r in rows], "id string, cluster_id int")
    assert search.search_by_concept(table, assigned, 1, [0, 0], limit=5).count() == 2


def test_a_batch_of_copies_gives_few_pairs(spark):
    from passagemill.functions.vectors import distinct_rows

    x, ids = np.repeat([[1.0, 0.0], [0.0, 2.0]], 10_000, axis=0), np.arange(20_000)[::-1]
    kept = distinct_rows(x, ids, 20)
    assert len(kept) == 40 and sorted(ids[kept]) == [*range(20), *range(10_000, 10_020)]
    best = search._TopK(np.zeros((2_000, 2)), 20)
    best.add(ids, x)
    assert len(best.ids) == 40_000 and set(best.ids.tolist()) == set(range(10_000, 10_020))


def test_a_task_sorts_the_rows_of_a_few_queries_at_a_time(monkeypatch):
    import numpy as np
    from pyspark.sql import types as T

    from passagemill.operators import search as ops

    sorted_rows = []
    smallest = ops._smallest
    monkeypatch.setattr(ops, "_smallest", lambda q, *rest: sorted_rows.append(len(q)) or smallest(q, *rest))
    monkeypatch.setattr(ops, "QUERY_SLICE", 3, raising=False)
    x = np.random.default_rng(1).normal(size=(40, 4))
    x[30:] = x[0]
    best = ops._TopK(x, 5)
    for at in (0, 20):
        best.add(np.arange(at, at + 20), x[at : at + 20])
    assert max(sorted_rows) <= 3 * (5 + 20)  # of three queries: kept rows and those of a batch
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "id")] + [T.StructField("distance", T.DoubleType())])
    rows = [tuple(r.values()) for batch in best.batches(list(range(40)), schema) for r in batch.to_pylist()]
    want = []
    for i in range(40):
        d = np.round(((x - x[i]) ** 2).sum(axis=1), ops.DISTANCE_DIGITS)
        want += [(i, j) for j in sorted(range(40), key=lambda j: (d[j], j))[:5]]
    assert sorted((q, i) for q, i, _ in rows) == sorted(want)
