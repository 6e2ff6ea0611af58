"""Symbol-level jobs over a file tree: lookup, references, rename, edits.

The results are tables of changed files; nothing is written back to the tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators import edits, symbols
from passagemill.session import stage
from passagemill.sources.files import scan_for_references, scan_for_symbols


def symbols_of(spark: SparkSession, root: str, path: str | None = None) -> DataFrame:
    return symbols.extract_symbols(scan_for_symbols(spark, root, path))


def definition_of(spark: SparkSession, root: str, name_path: str, path: str) -> DataFrame:
    """The first symbol of a file or folder that matches; an error if there is none. One row."""
    found = stage(symbols.first_symbol(symbols_of(spark, root, path), name_path), "definition")
    if found.isEmpty():
        raise ValueError(f"{path} defines no {name_path}")
    return found


def references_to(
    spark: SparkSession,
    root: str,
    name_path: str,
    path: str,
    kinds: Sequence[int] | None = None,
    not_kinds: Sequence[int] | None = None,
) -> DataFrame:
    definition = definition_of(spark, root, name_path, path)
    return symbols.find_references(scan_for_references(spark, root), definition, kinds=kinds, not_kinds=not_kinds)


def rename_symbol(
    spark: SparkSession, root: str, name_path: str, path: str, new_name: str, dry_run: bool = False
) -> DataFrame:
    """Changed files with their replacements (and new content unless dry)."""
    definition = definition_of(spark, root, name_path, path)
    files = scan_for_references(spark, root)
    targets = edits.rename_targets(symbols.find_references(files, definition), definition)
    return edits.rename(files, targets, definition.first()["name"], new_name, dry_run)


def edit_symbol(spark: SparkSession, root: str, name_path: str, path: str, action: str, body: str) -> DataFrame:
    """Replace a symbol's lines, or insert before or after them: the file's new content and range."""
    if action not in ("replace", "insert_before", "insert_after"):
        raise ValueError("action is replace, insert_before or insert_after")
    definition = definition_of(spark, root, name_path, path)
    wanted = definition.select(
        "filepath", F.lit(action).alias("action"), "start_line", "end_line", F.lit(body).alias("body")
    )
    return edits.apply_line_edits(scan_for_symbols(spark, root, definition.first()["filepath"]), wanted)
