import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import clustering

VECTOR = "id string, embedding array<float>"
GROUPS = [
    ("a1", [1.0, 0.0, 0.0]), ("a2", [0.99, 0.01, 0.0]), ("a3", [0.98, 0.02, 0.0]),
    ("b1", [0.0, 1.0, 0.0]), ("b2", [0.01, 0.99, 0.0]), ("b3", [0.02, 0.98, 0.0]),
]


def test_default_number_of_clusters():
    assert [clustering.default_clusters(n) for n in (1, 18, 50, 200, 10**9)] == [3, 3, 5, 10, 20]


def test_empty_and_single(spark):
    assigned, centers = clustering.kmeans(spark.createDataFrame([], VECTOR))
    assert assigned.count() == 0 and centers.count() == 0
    assigned, centers = clustering.kmeans(spark.createDataFrame([("x", [1.0, 2.0])], VECTOR))
    assert [tuple(r) for r in assigned.collect()] == [("x", 0)]
    assert [tuple(r) for r in centers.collect()] == [(0, 1, [1.0, 2.0])]


def test_groups_are_kept_apart(spark):
    assigned, centers = clustering.kmeans(spark.createDataFrame(GROUPS, VECTOR), k=2)
    got = {r["id"]: r["cluster_id"] for r in assigned.collect()}
    assert got["a1"] == got["a2"] == got["a3"] != got["b1"] == got["b2"] == got["b3"]
    assert sorted(r["size"] for r in centers.collect()) == [3, 3]


def test_assignment_is_the_nearest_center_and_sizes_fall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    vectors = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], VECTOR)
    assigned, centers = clustering.kmeans(vectors)
    center = {r["cluster_id"]: np.array(r["centroid"]) for r in centers.collect()}
    for r in assigned.collect():
        d = {c: np.linalg.norm(x[int(r["id"])] - m) for c, m in center.items()}
        assert d[r["cluster_id"]] <= min(d.values()) + 1e-9
    sizes = [r["size"] for r in centers.orderBy("cluster_id").collect()]
    assert len(sizes) == 10 and sizes == sorted(sizes, reverse=True) and sum(sizes) == 200


def test_nearest_center_and_ties(spark):
    centers = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (0, [1.0, 0.0, 0.0])], "cluster_id int, centroid array<double>")
    vectors = spark.createDataFrame([("x", [0.9, 0.1, 0.0]), ("tie", [1.0, 1.0, 0.0])], VECTOR)
    got = {r["id"]: r["cluster_id"] for r in clustering.nearest_centroid(vectors, centers).collect()}
    assert got == {"x": 0, "tie": 0}


def test_label_and_representatives(spark):
    rows = [(f"c{i}", 0, f"src/utils/f{i}.ts", "shared words", "function") for i in range(10)]
    members = spark.createDataFrame(rows, "id string, cluster_id int, filepath string, content string, symbol_type string")
    assert clustering.cluster_labels(members).first()["label"] == "utils functions"
    flat = members.drop("symbol_type").withColumn("filepath", F.lit("top.ts"))
    assert clustering.cluster_labels(flat).first()["label"] == "Code"
    words = clustering.keyword_lists(clustering.cluster_keywords(flat))
    assert clustering.cluster_labels(flat, words).first()["label"] == "shared & words"
    vectors = spark.createDataFrame([(f"c{i}", [float(i)]) for i in range(10)], VECTOR)
    assigned = members.select("id", "cluster_id")
    reps = clustering.representatives(vectors, assigned, clustering.centroids(vectors, assigned))
    assert [r["id"] for r in reps.orderBy("place").collect()] == ["c4", "c5", "c3"]


def test_keywords(spark):
    rows = [(0, "const userData = fetch_all(); // the THE user_data2 ab abc", "getUserName")]
    members = spark.createDataFrame(rows, "cluster_id int, content string, symbol_name string")
    got = {r["word"]: r["weight"] for r in clustering.word_counts(members).collect()}
    assert got == {"userdata": 1, "fetch_all": 1, "user_data2": 1, "user": 3, "name": 3}


def brute_silhouette(x, labels):
    total = 0.0
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        own = [d[j] for j in range(len(x)) if labels[j] == labels[i] and j != i]
        a = float(np.mean(own)) if own else 0.0
        means = [float(np.mean(d[labels == c])) for c in set(labels.tolist()) - {labels[i]}]
        b = min(means) if means else 0.0
        total += (b - a) / max(a, b) if max(a, b) > 0 and means else 0.0
    return total / len(x)


def test_silhouette_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6)).astype(np.float32)
    x[:40] = x[0]  # a third are copies
    labels = rng.integers(0, 3, size=120)
    labels[119] = 9  # a cluster of one
    vectors = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], VECTOR)
    assigned = spark.createDataFrame([(str(i), int(c)) for i, c in enumerate(labels)], "id string, cluster_id int")
    got = clustering.silhouette(vectors, assigned).first()[0]
    assert got == pytest.approx(brute_silhouette(x.astype(np.float64), labels), abs=1e-6)


def test_silhouette_edges(spark):
    vectors = spark.createDataFrame(GROUPS, VECTOR)
    one = vectors.select("id", F.lit(0).alias("cluster_id"))
    assert clustering.silhouette(vectors, one).first()[0] == 0
    two = vectors.select("id", F.startswith("id", F.lit("b")).cast("int").alias("cluster_id"))
    assert clustering.silhouette(vectors, two).first()[0] > 0.5
    assert clustering.silhouette(vectors.limit(0), two).first()[0] == 0


def test_lloyd_steps_reach_a_fixed_point(spark):
    vectors = spark.createDataFrame(GROUPS, VECTOR)
    centers = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.98, 0.02, 0.0])], "cluster_id int, centroid array<double>")
    for _ in range(4):
        centers = spark.createDataFrame(clustering.lloyd_step(vectors, centers).collect())
    again = clustering.lloyd_step(vectors, centers)
    key = lambda df: sorted((r["cluster_id"], tuple(np.round(r["centroid"], 9))) for r in df.collect())
    assert key(again) == key(centers)
