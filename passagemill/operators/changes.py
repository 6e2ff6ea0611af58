"""Keeping an index in step with its files: change sets, staleness, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REBUILD_HINT = "Clear it and index again."


def detect_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """filepath, change: added, modified, deleted or unchanged.

    Both sides hold one (filepath, mtime) per file. Only a newer time counts as modified.
    """
    now = current.select("filepath", F.col("mtime").alias("current_mtime"))
    before = stored.select("filepath", F.col("mtime").alias("stored_mtime"))
    change = (
        F.when(F.col("stored_mtime").isNull(), F.lit("added"))
        .when(F.col("current_mtime").isNull(), F.lit("deleted"))
        .when(F.col("current_mtime") > F.col("stored_mtime"), F.lit("modified"))
        .otherwise(F.lit("unchanged"))
    )
    return now.join(before, "filepath", "full_outer").select("filepath", change.alias("change"))


def deleted_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(current, "filepath", "left_anti").select("filepath")


def staleness(changes: DataFrame) -> DataFrame:
    """One row: stale, reason such as ``3 new file(s), 1 deleted file(s)``."""
    counts = changes.agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")]
    )

    def part(column: str, word: str) -> Column:
        return F.when(F.col(column) > 0, F.concat(F.col(column).cast("string"), F.lit(f" {word} file(s)")))

    reason = F.concat_ws(", ", part("added", "new"), part("modified", "modified"), part("deleted", "deleted"))
    return counts.select((reason != "").alias("stale"), F.when(reason != "", reason).alias("reason"))


def delete_by_key(chunks: DataFrame, filepaths: DataFrame) -> DataFrame:
    return chunks.join(filepaths.select("filepath").distinct(), "filepath", "left_anti")


def to_process(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files that are new or newer."""
    return files.join(changes.filter(F.col("change").isin("added", "modified")), "filepath", "left_semi")


def apply_changes(chunks: DataFrame, changes: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunk table after an incremental run: gone and outdated files out, new chunks in."""
    outdated = changes.filter(F.col("change").isin("modified", "deleted"))
    return delete_by_key(chunks, outdated).unionByName(new_chunks.select(*chunks.columns))


def rehydrate_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Refill chunk contents from the files' text; empty where the file is gone.

    The chunks of a file are cut from one split of its text: chunk ranges are gathered per file (at
    most one struct per window of lines) rather than copying the text to every chunk.
    """
    from passagemill.functions.text import let, line_range, lines_of

    others = [c for c in chunks.columns if c not in ("filepath", "content")]
    ranges = chunks.groupBy("filepath").agg(F.collect_list(F.struct(*others)).alias("ranges"))
    joined = ranges.join(files.select("filepath", "content"), "filepath", "left")
    refilled = let(
        lines_of(F.col("content")),
        lambda lines: F.transform(
            F.col("ranges"),
            lambda r: r.withField("content", F.coalesce(line_range(lines, r["start_line"], r["end_line"]), F.lit(""))),
        ),
    )
    rows = joined.select("filepath", F.explode(refilled).alias("r"))
    return rows.select(*[F.col(c) if c == "filepath" else F.col(f"r.{c}").alias(c) for c in chunks.columns])


def index_checksum(files: DataFrame, n_chunks: int) -> DataFrame:
    """One row: 16 hex digits over all paths and the chunk count, as a sum of per-path hashes in any order."""
    value = F.conv(F.substring(F.sha2(F.col("filepath"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,0)")).cast("string")
    text = F.concat_ws(":", total, F.count(F.lit(1)).cast("string"), F.lit(str(n_chunks)))
    return files.agg(F.substring(F.sha2(text, 256), 1, 16).alias("checksum"))


def validate_index(record: DataFrame, n_chunks: DataFrame, checksum: DataFrame) -> DataFrame:
    """One row: corrupted, reason. Inputs are one-row frames; an empty record means no metadata.

    record: chunk_count, checksum; n_chunks: actual_chunks; checksum: actual_checksum.
    """
    actual = n_chunks.select("actual_chunks", F.lit(1).alias("one")).join(
        checksum.select("actual_checksum", F.lit(1).alias("one")), "one"
    )
    known = record.limit(1).select("chunk_count", "checksum", F.lit(1).alias("one"))
    reason = (
        F.when(
            F.col("chunk_count").isNull(),
            F.lit("The index has no record of its last run. " + REBUILD_HINT),
        )
        .when(
            F.col("chunk_count") != F.col("actual_chunks"),
            F.concat(
                F.lit("The record counts "),
                F.col("chunk_count").cast("string"),
                F.lit(" chunks, the table holds "),
                F.col("actual_chunks").cast("string"),
                F.lit(". " + REBUILD_HINT),
            ),
        )
        .when(
            F.col("checksum") != F.col("actual_checksum"),
            F.lit("The file table is not the one that was indexed. " + REBUILD_HINT),
        )
    )
    return actual.join(known, "one", "left").select(reason.isNotNull().alias("corrupted"), reason.alias("reason"))


def language_stats(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    """Files and chunks per language.

    Exact counting goes through one row per (language, file), so a language holding most chunks is
    spread over its files; ``approximate`` uses a sketch instead.
    """
    if approximate:
        return chunks.groupBy("language").agg(
            F.approx_count_distinct("filepath").alias("files"), F.count(F.lit(1)).alias("chunks")
        )
    per_file = chunks.groupBy("language", "filepath").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chunks"))


def index_status(chunks: DataFrame, record: DataFrame, verdict: DataFrame, mismatch: DataFrame) -> DataFrame:
    """One row: counts, last update, corruption and mismatch flags with their reasons."""
    one = F.lit(1).alias("one")
    counted = chunks.agg(F.count(F.lit(1)).alias("chunk_count"), one)
    known = record.limit(1).select("file_count", "last_updated", "embedding_backend", "embedding_model", one)
    checked = verdict.select("corrupted", F.col("reason").alias("corruption_reason"), one)
    differs = mismatch.select(
        F.col("mismatch").alias("backend_mismatch"), F.col("reason").alias("backend_mismatch_reason"), one
    )
    joined = counted.join(known, "one", "left").join(checked, "one", "left").join(differs, "one", "left").drop("one")
    return joined.withColumn("file_count", F.coalesce("file_count", F.lit(0)))
