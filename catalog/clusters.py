"""Clustering queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.chunks import CHUNKS, FILES, text_chunks
from passagemill.functions.vectors import l2, literal_vector
from passagemill.operators import clustering
from passagemill.plans import roles
from passagemill.plans.summary import corpus_summary as summary_of


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df


def _centers(spark, sf):
    return clustering.centroids(roles.vectors(spark, sf), roles.assignments(spark, sf))


def _cells(centers):
    return rounded(
        centers.select("cluster_id", "size", F.posexplode("centroid").alias("pos", "value")).select(
            F.col("cluster_id").cast("long").alias("cluster_id"), "size", F.col("pos").cast("long").alias("pos"), "value"
        ),
        "value",
    )


def cluster_centroids(spark, sf):
    return _cells(_centers(spark, sf))


def nearest_centroid(spark, sf):
    near = clustering.nearest_centroid(roles.vectors(spark, sf), _centers(spark, sf))
    return rounded(near.select("id", F.col("cluster_id").cast("long").alias("cluster_id"), "distance"), "distance")


def lloyd_step(spark, sf):
    return _cells(clustering.lloyd_step(roles.vectors(spark, sf), _centers(spark, sf)))


def representatives(spark, sf):
    reps = clustering.representatives(roles.vectors(spark, sf), roles.assignments(spark, sf), _centers(spark, sf))
    return rounded(
        reps.select(
            F.col("cluster_id").cast("long").alias("cluster_id"), "id", F.col("place").cast("long").alias("place"), "distance"
        ),
        "distance",
    )


def renumber_by_size(spark, sf):
    sizes = roles.assignments(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return clustering.renumber_by_size(sizes).select(
        F.col("cluster_id").cast("long").alias("cluster_id"), F.col("new_id").cast("long").alias("new_id")
    )


def _members(spark, sf):
    """Passages of a cluster; a passage with a quality label counts as a symbol of that name."""
    marks = roles.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    kind = F.when(F.col("quality") == 1, F.lit("class")).when(F.col("quality") == 0, F.lit("function"))
    return (
        roles.passages(spark, sf)
        .join(marks, "doc_id", "left")
        .select(
            F.col("cluster_id").cast("long").alias("cluster_id"), "id", "filepath", "content", "language",
            kind.alias("symbol_type"), F.when(kind.isNotNull(), F.lit("goodText_andMore")).alias("symbol_name"),
        )
    )


def cluster_labels(spark, sf):
    return clustering.cluster_labels(_members(spark, sf))


def cluster_labels_by_keywords(spark, sf):
    """Top-level files without symbol types: the label comes from the keywords."""
    flat = _members(spark, sf).drop("symbol_type", "symbol_name").withColumn("filepath", F.col("language"))
    return clustering.cluster_labels(flat, clustering.keyword_lists(clustering.cluster_keywords(flat)))


def cluster_keywords(spark, sf):
    found = clustering.cluster_keywords(_members(spark, sf))
    return found.select("cluster_id", "word", "weight", F.col("place").cast("long").alias("place"))


def silhouette_squared(spark, sf):
    return rounded(clustering.silhouette(roles.vectors(spark, sf), roles.assignments(spark, sf)), "silhouette")


def kmeans_full(spark, sf):
    """The start is random, so the result is checked by what must hold of any run."""
    vectors = roles.vectors(spark, sf)
    assigned, centers = clustering.kmeans(vectors)
    rows = centers.orderBy("cluster_id").collect()  # at most 20 clusters
    own = F.element_at(F.array(*[literal_vector(r["centroid"]) for r in rows]), F.col("cluster_id") + 1)
    best = clustering.nearest_centroid(vectors, centers).select("id", "distance")
    placed = vectors.join(assigned, "id").join(best, "id")
    sizes = [r["size"] for r in rows]
    return placed.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(l2(F.col("embedding"), own) > F.col("distance") + 1e-9).alias("misplaced"),
        F.lit(len(rows) <= clustering.default_clusters(sum(sizes))).alias("within_bound"),
        F.lit(sizes == sorted(sizes, reverse=True)).alias("largest_first"),
    )


def corpus_summary(spark, sf):
    """Totals, languages, cluster sizes, labels, keywords and quality, one row per fact."""
    return summary_of(
        text_chunks(spark, sf),
        roles.passages(spark, sf).select("id", "filepath", "content", "cluster_id", "embedding"),
    )


QUERIES = {
    "cluster_centroids": cluster_centroids,
    "nearest_centroid": nearest_centroid,
    "lloyd_step": lloyd_step,
    "representatives": representatives,
    "renumber_by_size": renumber_by_size,
    "cluster_labels": cluster_labels,
    "cluster_labels_by_keywords": cluster_labels_by_keywords,
    "cluster_keywords": cluster_keywords,
    "silhouette_squared": silhouette_squared,
    "kmeans_full": kmeans_full,
    "corpus_summary": corpus_summary,
}

CELLS = """cell AS (SELECT vec_id AS id, label::BIGINT AS cluster_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
center AS (SELECT cluster_id, pos, avg(x) AS m, count(*) AS size FROM cell GROUP BY 1, 2)"""
_NEAREST = CELLS + """,
far AS (SELECT p.id, c.cluster_id, round(sqrt(sum((x - m) * (x - m))), 12) AS distance FROM cell p JOIN center c USING (pos) GROUP BY 1, 2),
nearest AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster_id) = 1)"""
_MEMBERS = FILES + """,
marks AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
members AS (SELECT label::BIGINT AS cluster_id, filepath, content, language, CASE quality WHEN 1 THEN 'class' WHEN 0 THEN 'function' END AS symbol_type
  FROM files JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings) LEFT JOIN marks USING (doc_id))"""
_STOP = "(" + ",".join(f"'{w}'" for w in clustering.STOP_WORDS) + ")"


def words_sql(named: bool) -> str:
    symbols = """ UNION ALL SELECT cluster_id, unnest(['good', 'text', 'and', 'more']), 3 FROM members WHERE symbol_type IS NOT NULL""" if named else ""
    return f"""w AS (SELECT cluster_id, lower(unnest(regexp_extract_all(content, '[a-zA-Z][a-zA-Z0-9_]*[a-zA-Z0-9]'))) AS word, 1 AS weight FROM members{symbols}),
k AS (SELECT cluster_id, word, CAST(sum(weight) AS BIGINT) AS weight FROM w WHERE length(word) >= 4 AND word NOT IN {_STOP} GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, word) AS place FROM k QUALIFY place <= 10)"""


_PAIRS = """WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT label, count(*) AS size FROM e GROUP BY label),
s AS (SELECT a.id, a.label, b.label AS other, sum(CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.v, b.v) * list_distance(a.v, b.v) END) AS t FROM e a, e b GROUP BY 1, 2, 3),
p AS (SELECT id, coalesce(max(CASE WHEN s.label = other AND size > 1 THEN t / (size - 1) END), 0) AS a, min(CASE WHEN s.label <> other THEN t / size END) AS b FROM s JOIN n ON n.label = other GROUP BY id),
sil AS (SELECT avg(CASE WHEN b IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM p)"""
_SILHOUETTE = _PAIRS + " SELECT round(silhouette, 6) AS silhouette FROM sil"

SQL = {
    "cluster_centroids": f"WITH {CELLS} SELECT cluster_id, size, pos, round(m, 6) AS value FROM center",
    "nearest_centroid": f"WITH {_NEAREST} SELECT id, cluster_id, round(distance, 6) AS distance FROM nearest",
    "lloyd_step": f"WITH {_NEAREST} SELECT n.cluster_id, count(*) AS size, pos, round(avg(x), 6) AS value FROM nearest n JOIN cell USING (id) GROUP BY n.cluster_id, pos",
    "representatives": f"""WITH {CELLS}, d AS (SELECT id, cluster_id, round(sqrt(sum((x - m) * (x - m))), 12) AS d FROM cell JOIN center USING (cluster_id, pos) GROUP BY 1, 2)
        SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY d, id) AS place, round(d, 6) AS distance FROM d QUALIFY place <= 3""",
    "renumber_by_size": "SELECT label::BIGINT AS cluster_id, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS new_id FROM embeddings GROUP BY label",
    "cluster_labels": f"""WITH {_MEMBERS}, d AS (SELECT cluster_id, regexp_extract(filepath, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM members GROUP BY 1, 2),
        bd AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, dir) = 1),
        t AS (SELECT cluster_id, symbol_type, count(*) AS n FROM members WHERE symbol_type IS NOT NULL GROUP BY 1, 2),
        bt AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, symbol_type) = 1)
        SELECT cluster_id, concat_ws(' ', list_last(string_split(dir, '/')), symbol_type || 's') AS label FROM bd LEFT JOIN bt USING (cluster_id)""",
    "cluster_labels_by_keywords": f"WITH {_MEMBERS}, {words_sql(False)} SELECT cluster_id, string_agg(word, ' & ' ORDER BY place) AS label FROM top WHERE place <= 2 GROUP BY cluster_id",
    "cluster_keywords": f"WITH {_MEMBERS}, {words_sql(True)} SELECT cluster_id, word, weight, place FROM top",
    "silhouette_squared": _SILHOUETTE,
    "kmeans_full": "SELECT count(*) AS points, 0::BIGINT AS misplaced, true AS within_bound, true AS largest_first FROM embeddings",
    "corpus_summary": f"""WITH {CHUNKS}, {_MEMBERS[len(FILES) + 1:]}, {words_sql(False)},
        d AS (SELECT cluster_id, regexp_extract(filepath, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM members GROUP BY 1, 2),
        bd AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, dir) = 1),
        {_PAIRS[len('WITH '):].replace('vec_id AS id', 'doc_id AS id').replace('FROM embeddings)', 'FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings))')}
        SELECT 'total' AS fact, 'files' AS item, CAST(count(DISTINCT filepath) AS DOUBLE) AS value, NULL AS text FROM chunks
        UNION ALL SELECT 'total', 'chunks', count(*), NULL FROM chunks
        UNION ALL SELECT 'language files', language, count(DISTINCT filepath), NULL FROM chunks GROUP BY language
        UNION ALL SELECT 'language chunks', language, count(*), NULL FROM chunks GROUP BY language
        UNION ALL SELECT 'cluster', cluster_id::VARCHAR, count(*), (SELECT list_last(string_split(dir, '/')) FROM bd WHERE bd.cluster_id = m.cluster_id) FROM members m GROUP BY cluster_id
        UNION ALL SELECT 'keyword', cluster_id || '/' || place, weight, word FROM top
        UNION ALL SELECT 'quality', 'silhouette', round(silhouette, 6), NULL FROM sil""",
}
