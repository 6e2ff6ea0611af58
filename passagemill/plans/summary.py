"""Corpus summary: totals, languages, clusters, keywords and cluster quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators import clustering
from passagemill.operators.changes import language_stats


def corpus_summary(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """One row per fact: fact, item, value, text.

    members: cluster_id, id, filepath, content, embedding of the clustered passages. The parts are
    independent aggregations, all linear in their input.
    """
    languages = language_stats(chunks)
    value = lambda c: F.col(c).cast("double")
    none = F.lit(None).cast("string")

    def fact(df: DataFrame, name: str, item, number, text=none) -> DataFrame:
        return df.select(F.lit(name).alias("fact"), item.alias("item"), number.alias("value"), text.alias("text"))

    # a file has one language, so its totals follow from the language counts
    totals = languages.agg(F.sum("files").alias("files"), F.sum("chunks").alias("chunks"))
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    labels = clustering.cluster_labels(members.drop("embedding"))
    keywords = clustering.cluster_keywords(members.drop("embedding"))
    vectors, assigned = members.select("id", "embedding"), members.select("id", "cluster_id")
    quality = clustering.silhouette(vectors, assigned)
    cluster_name = F.col("cluster_id").cast("string")
    parts = [
        fact(totals, "total", F.lit("files"), value("files")),
        fact(totals, "total", F.lit("chunks"), value("chunks")),
        fact(languages, "language files", F.col("language"), value("files")),
        fact(languages, "language chunks", F.col("language"), value("chunks")),
        fact(sizes.join(labels, "cluster_id"), "cluster", cluster_name, value("size"), F.col("label")),
        fact(
            keywords,
            "keyword",
            F.concat_ws("/", cluster_name, F.col("place").cast("string")),
            value("weight"),
            F.col("word"),
        ),
        fact(quality, "quality", F.lit("silhouette"), F.round("silhouette", 6)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
