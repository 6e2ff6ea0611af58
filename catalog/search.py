"""Search queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.chunks import CHUNKS, FILES, text_chunks, vectors_sql, widened
from passagemill.functions.text import keyword_score as keyword_score_of
from passagemill.functions.text import path_matches
from passagemill.functions.vectors import cosine, l2, literal_vector
from passagemill.operators import duplicates, search
from passagemill.operators.clustering import representatives as representatives_of
from passagemill.operators.clustering import centroids
from passagemill.operators.embedding import HashEmbedder, embed
from passagemill.plans import roles
from passagemill.session import spread

QUERY = "that with from"
START = 0  # the passage searches start from
CONCEPT = 3


def scored(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df


def knn_exact(spark, sf):
    near = search.knn(roles.passages(spark, sf), roles.vector_of(spark, sf, START), 20)
    return scored(near.select("id", "distance"), "distance")


def keyword_score(spark, sf):
    """Score of every document for a query with a repeated, a short and a path term."""
    score = keyword_score_of(QUERY + " in src7 that", F.col("content"), F.col("filepath"))
    return scored(roles.files(spark, sf).select("doc_id", score.alias("score")), "score")


def _answer(df):
    return scored(
        df.select("id", F.col("position").cast("long").alias("position"), "score"), "score"
    )


def hybrid_search(spark, sf):
    return _answer(search.hybrid_search(roles.passages(spark, sf), QUERY, roles.vector_of(spark, sf, START), 10))


def hybrid_search_filtered(spark, sf):
    return _answer(
        search.hybrid_search(
            roles.passages(spark, sf), QUERY, roles.vector_of(spark, sf, START), 10, "src1*/**", ["EN", "de"]
        )
    )


def hybrid_search_prefilter(spark, sf):
    return _answer(
        search.hybrid_search(
            roles.passages(spark, sf), QUERY, roles.vector_of(spark, sf, START), 10, "!src1*/**", ["es"]
        )
    )


def index_and_search(spark, sf):
    """Documents -> line chunks -> vectors -> hybrid search for a query text."""
    embedder = HashEmbedder()
    chunks = embed(text_chunks(spark, sf), "content", embedder)
    found = search.hybrid_search(chunks, QUERY, embedder([QUERY])[0].astype("float32").tolist(), 10)
    return scored(
        widened(found.select("id", "filepath", "start_line", "end_line", F.col("position").cast("long"), "score")), "score"
    )


def search_similar(spark, sf):
    corpus = roles.passages(spark, sf)
    own = corpus.filter(F.col("doc_id") == START).select("filepath", "start_line", "end_line").first()
    found = search.search_similar(corpus, roles.vector_of(spark, sf, START), location=tuple(own), limit=10, threshold=0.05)
    return scored(found.select("id", "similarity"), "similarity")


def search_similar_text(spark, sf):
    """By text: every passage with the same text is left out, copies included."""
    embedder = HashEmbedder()
    corpus = roles.files(spark, sf)
    text = corpus.filter(F.col("doc_id") == START).select("content").first()[0]
    chunks = embed(
        corpus.select(
            F.col("filepath").alias("id"), "filepath", "content", F.lit(1).alias("start_line"),
            F.lit(1).alias("end_line"), "language",
        ),
        "content",
        embedder,
    )
    vector = embedder([text])[0].astype("float32").tolist()
    found = search.search_similar(chunks, vector, text="  " + text + "\n", limit=10)
    return scored(found.select("id", "similarity"), "similarity")


def search_similar_batch(spark, sf):
    """Similar passages of every passage at once."""
    every = roles.vectors(spark, sf)
    found = search.search_similar_batch(every, every, limit=5, threshold=0.02)
    return scored(found.select("query_id", "id", "similarity", F.col("place").cast("long").alias("place")), "similarity")


def near_duplicate_groups(spark, sf):
    """Classes of documents by the cosine of their embedded texts."""
    docs = embed(spread(roles.table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), "text", HashEmbedder())
    return duplicates.near_duplicate_groups(docs, "doc_id", "embedding", 0.999)


def search_by_concept_query(spark, sf):
    corpus = roles.passages(spark, sf)
    found = search.search_by_concept(
        corpus, corpus.select("id", "cluster_id"), CONCEPT, roles.vector_of(spark, sf, START), limit=40
    )
    return scored(found.select("id", "distance"), "distance")


def search_by_concept_representatives(spark, sf):
    corpus = roles.passages(spark, sf)
    members = corpus.select("id", "cluster_id")
    reps = representatives_of(corpus.select("id", "embedding"), members, centroids(corpus, members))
    found = search.search_by_concept(corpus, members, CONCEPT, limit=2, representatives=reps)
    return found.select("id", "language", F.col("place").cast("long").alias("place"))


def path_glob_filter(spark, sf):
    files = roles.files(spark, sf)
    path = F.col("filepath")
    return files.select(
        "filepath",
        path_matches(path, "src1*/**").alias("deep"),
        path_matches(path, "src?/{en,de}/*").alias("braces"),
        path_matches(path, "!**/fr/*").alias("negated"),
        path_matches(path, "*").alias("flat"),
        path_matches(path, "src[1-3]/**/*5").alias("classes"),
    )


def filter_language(spark, sf):
    return search.filter_language(roles.files(spark, sf), ["EN", "Fr"]).select("doc_id", "language")


def vector_measures(spark, sf):
    """Cosine, distance and norm of every vector against the start vector."""
    start = literal_vector(roles.vector_of(spark, sf, START))
    v = F.col("embedding")
    return scored(
        roles.vectors(spark, sf).select("id", cosine(v, start).alias("cosine"), l2(v, start).alias("distance")),
        "cosine",
        "distance",
    )


QUERIES = {
    "knn_exact": knn_exact,
    "near_duplicate_groups": near_duplicate_groups,
    "keyword_score": keyword_score,
    "hybrid_search": hybrid_search,
    "hybrid_search_filtered": hybrid_search_filtered,
    "hybrid_search_prefilter": hybrid_search_prefilter,
    "index_and_search": index_and_search,
    "search_similar": search_similar,
    "search_similar_text": search_similar_text,
    "search_similar_batch": search_similar_batch,
    "search_by_concept_query": search_by_concept_query,
    "search_by_concept_reps": search_by_concept_representatives,
    "path_glob_filter": path_glob_filter,
    "filter_language": filter_language,
    "vector_measures": vector_measures,
}

PASSAGES = FILES + """, passages AS (SELECT filepath AS id, doc_id, filepath, content, language, embedding::DOUBLE[] AS v, label
  FROM files JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
start AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT p.*, round(list_sum(list_transform(list_zip(v, q), lambda z: (z[1]-z[2])*(z[1]-z[2]))), 12) AS distance FROM passages p, start)"""


def keyword_sql(terms: list[str]) -> str:
    n = len(terms)
    points = " + ".join(
        f"CAST(contains(lower(content), '{t}') AS DOUBLE) + 0.5 * CAST(contains(lower(filepath), '{t}') AS DOUBLE)" for t in terms
    )
    bonus = " + ".join(f"0.5 * CAST(regexp_matches(lower(content), '\\b{t}\\b') AS DOUBLE)" for t in terms)
    return f"least(({points}) / {n}.0 + least(({bonus}) / {n}.0, 0.5), 1.0)"


TERMS = QUERY.split()


def _hybrid_sql(with_sql: str, fetch: int, before: str = "true", columns: str = "id") -> str:
    return f"""WITH {with_sql}, top AS (SELECT * FROM near WHERE {before} ORDER BY distance, id LIMIT {fetch}),
      ranked AS (SELECT *, row_number() OVER (ORDER BY distance, id) - 1 AS position FROM top),
      s AS (SELECT *, 0.7 * (1 - position / {fetch}.0) + 0.3 * {keyword_sql(TERMS)} AS raw FROM ranked)
      SELECT {columns}, position, round(raw, 6) AS score FROM s ORDER BY round(raw, 12) DESC, position LIMIT 10"""


# cosine-free form: squared distance of two sparse unit vectors = |a|^2 + |b|^2 - 2 a.b over stored floats
def _hashed_near(source: str, query_from: str) -> str:
    """near: rows of ``source`` (id, content, ...) with the distance of their word vectors to the query's."""
    return f"""
{vectors_sql('id', 'content', source)},
unit AS (SELECT id, pos, (v / norm)::FLOAT::DOUBLE AS x FROM cells JOIN norms USING (id) WHERE v <> 0),
qwords AS (SELECT lower(unnest(regexp_extract_all(t, '[A-Za-z0-9_]+'))) AS w FROM ({query_from})),
qslots AS (SELECT ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos, CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM qwords),
qcells AS (SELECT pos, CAST(sum(s) AS DOUBLE) AS v FROM qslots GROUP BY 1),
query AS (SELECT pos, (v / (SELECT sqrt(sum(v * v)) FROM qcells))::FLOAT::DOUBLE AS y FROM qcells),
grid AS (SELECT c.id, p.pos, coalesce(u.x, 0) AS x, coalesce(q.y, 0) AS y FROM {source} c CROSS JOIN (SELECT unnest(range(64)) AS pos) p
  LEFT JOIN unit u ON u.id = c.id AND u.pos = p.pos LEFT JOIN query q ON q.pos = p.pos),
dist AS (SELECT id, round(sum((x - y) * (x - y)), 12) AS distance FROM grid GROUP BY id),
near AS (SELECT c.*, distance FROM {source} c JOIN dist USING (id))"""


_SIMILAR = """
farthest AS (SELECT *, max(distance) OVER () AS far FROM fetched)
SELECT id, round(CASE WHEN far > 0 THEN 1 - distance / far ELSE 1.0 END, 6) AS similarity FROM farthest
WHERE {keep} AND CASE WHEN far > 0 THEN 1 - distance / far ELSE 1.0 END >= {threshold} ORDER BY distance, id LIMIT 10"""

SQL = {
    "near_duplicate_groups": f"""WITH RECURSIVE {vectors_sql('doc_id', 'text', 'documents')},
        vec AS MATERIALIZED (SELECT doc_id, pos, (v / norm)::FLOAT::DOUBLE AS x FROM cells JOIN norms USING (doc_id) WHERE v <> 0),
        len AS MATERIALIZED (SELECT doc_id, sqrt(sum(x * x)) AS l FROM vec GROUP BY doc_id),
        links AS MATERIALIZED (
            SELECT a, b FROM (SELECT v.doc_id AS a, w.doc_id AS b, sum(v.x * w.x) AS d FROM vec v JOIN vec w ON v.pos = w.pos AND v.doc_id <> w.doc_id GROUP BY ALL)
            JOIN len p ON p.doc_id = a JOIN len q ON q.doc_id = b WHERE d / (p.l * q.l) >= 0.999
        ),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, e.b FROM reach r JOIN links e ON r.b = e.a)
        SELECT doc_id, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS links FROM documents""",
    "knn_exact": f"WITH {PASSAGES} SELECT id, round(distance, 6) AS distance FROM near ORDER BY near.distance, id LIMIT 20",
    "keyword_score": f"WITH {FILES} SELECT doc_id, round({keyword_sql(TERMS + ['src7', 'that'])}, 6) AS score FROM files",
    "hybrid_search": _hybrid_sql(PASSAGES, 30),
    "hybrid_search_filtered": _hybrid_sql(PASSAGES, 50, before="starts_with(filepath, 'src1') AND language IN ('en', 'de')"),
    "hybrid_search_prefilter": _hybrid_sql(PASSAGES, 50, before="NOT starts_with(filepath, 'src1') AND language = 'es'"),
    "index_and_search": _hybrid_sql(
        CHUNKS + "," + _hashed_near("chunks", f"SELECT '{QUERY}' AS t"), 30, columns="id, filepath, start_line, end_line"
    ),
    "search_similar": f"WITH {PASSAGES}, fetched AS (SELECT * FROM near ORDER BY distance, id LIMIT 30),"
    + _SIMILAR.format(keep="doc_id <> 0", threshold=0.05),
    "search_similar_text": f"WITH {FILES}, whole AS (SELECT *, filepath AS id FROM files), {_hashed_near('whole', 'SELECT content AS t FROM files WHERE doc_id = 0')},"
    " fetched AS (SELECT * FROM near ORDER BY distance, id LIMIT 30),"
    + _SIMILAR.format(keep="trim(content) <> (SELECT trim(content) FROM files WHERE doc_id = 0)", threshold=0),
    "search_similar_batch": """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
        p AS (SELECT a.id AS query_id, b.id AS id, round(list_distance(a.v, b.v) * list_distance(a.v, b.v), 12) AS distance FROM e a, e b),
        f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 20),
        s AS (SELECT *, max(distance) OVER (PARTITION BY query_id) AS far FROM f),
        k AS (SELECT *, CASE WHEN far > 0 THEN 1 - distance / far ELSE 1.0 END AS sim FROM s)
        SELECT query_id, id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place
        FROM k WHERE id <> query_id AND sim >= 0.02 QUALIFY place <= 5""",
    "search_by_concept_query": f"WITH {PASSAGES}, top AS (SELECT * FROM near WHERE label = {CONCEPT} ORDER BY distance, id LIMIT 40) SELECT id, round(distance, 6) AS distance FROM top",
    "search_by_concept_reps": f"""WITH {PASSAGES}, cell AS (SELECT id, language, unnest(v) AS x, unnest(range(64)) AS pos FROM passages WHERE label = {CONCEPT}),
        c AS (SELECT pos, avg(x) AS m FROM cell GROUP BY pos), d AS (SELECT id, any_value(language) AS language, sqrt(sum((x-m)*(x-m))) AS d FROM cell JOIN c USING (pos) GROUP BY id)
        SELECT id, language, row_number() OVER (ORDER BY d, id) AS place FROM d QUALIFY place <= 2""",
    "path_glob_filter": f"""WITH {FILES} SELECT filepath, regexp_matches(filepath, '^src1[^/]*/.+$') AS deep, regexp_matches(filepath, '^src[^/]/(en|de)/[^/]+$') AS braces,
        NOT regexp_matches(filepath, '^(.*/)?fr/[^/]+$') AS negated, false AS flat, regexp_matches(filepath, '^src[1-3]/(.*/)?[^/]*5$') AS classes FROM files""",
    "filter_language": "SELECT doc_id, lang AS language FROM documents WHERE lang IN ('en', 'fr')",
    "vector_measures": """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT v AS q FROM e WHERE id = 0)
        SELECT id, round(list_cosine_similarity(v, q), 6) AS cosine, round(list_distance(v, q), 6) AS distance FROM e, s""",
}
