"""Keyed text documents: name, content, modified_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import quote_regex


def latest(docs: DataFrame, version: str = "modified_at") -> DataFrame:
    """Newest row per name: a max per key with partial aggregation, no sort of a key's history."""
    others = [c for c in docs.columns if c not in ("name", version)]
    picked = docs.groupBy("name").agg(F.max(F.struct(version, *others)).alias("r"))
    return picked.select("name", *[F.col(f"r.{c}").alias(c) for c in docs.columns if c != "name"]).select(*docs.columns)


def upsert_docs(docs: DataFrame, writes: DataFrame, version: str = "modified_at") -> DataFrame:
    """Writes replace stored documents of the same name; among several writes the newest wins."""
    newest = latest(writes, version)
    return docs.join(newest, "name", "left_anti").unionByName(newest.select(*docs.columns))


def get_doc(docs: DataFrame, name: str) -> DataFrame:
    """The document; an error when it is missing. One row."""
    found = docs.filter(F.col("name") == name).limit(1)
    if found.isEmpty():
        raise KeyError(f"no note is called {name}")
    return found


def docs_exist(names: DataFrame, docs: DataFrame) -> DataFrame:
    """name, found for every asked name."""
    stored = docs.select("name").distinct().withColumn("stored", F.lit(True))
    return names.join(stored, "name", "left").select("name", F.coalesce("stored", F.lit(False)).alias("found"))


def list_docs(docs: DataFrame) -> DataFrame:
    """name, size in bytes, modified_at, newest first."""
    return docs.select("name", F.octet_length("content").alias("size"), "modified_at").orderBy(
        F.col("modified_at").desc(), "name"
    )


def delete_docs(docs: DataFrame, names: DataFrame, strict: bool = False) -> DataFrame:
    if strict:
        missing = names.join(docs, "name", "left_anti").select("name").first()
        if missing is not None:
            raise KeyError(f"no note is called {missing['name']}")
    return docs.join(names.select("name"), "name", "left_anti")


def edit_docs(docs: DataFrame, needle: str, replacement: str, mode: str = "literal", strict: bool = False) -> DataFrame:
    """Replace all matches: every document with its new content and match_count.

    Regular expressions run with ^ and $ at every line and a dot that matches line ends. With
    ``strict`` a document without a match is an error, as for a single edit.
    """
    if mode not in ("literal", "regex"):
        raise ValueError("mode is literal or regex")
    pattern = quote_regex(needle) if mode == "literal" else "(?ms)" + needle
    count: Column = F.regexp_count(F.col("content"), F.lit(pattern))
    if mode == "literal":
        edited = F.replace(F.col("content"), F.lit(needle), F.lit(replacement))
    else:
        edited = F.regexp_replace("content", pattern, replacement)
    result = docs.withColumn("match_count", count).withColumn("content", edited)
    if strict:
        missing = F.raise_error(F.concat(F.lit("nothing in the note matches "), F.lit(needle))).cast("int")
        result = result.withColumn("match_count", F.when(F.col("match_count") == 0, missing).otherwise(F.col("match_count")))
    return result
