"""Bulk rename and line edits: one row per file in, one row per file out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import NOT_WHITE_SPACE, is_blank, join_lines, let, lines_of, whole_word

VALID_IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"


def valid_identifier(name: Column) -> Column:
    return name.rlike(rf"\A{VALID_IDENTIFIER}\z")


def _line_flags(targets: Column, n_lines: Column) -> Column:
    """One boolean per line, true at the 1-based positions in ``targets`` (sorted, distinct)."""

    def gap(t: Column, j: Column) -> Column:
        previous = F.when(j > 0, F.element_at(targets, F.greatest(j, F.lit(1)))).otherwise(F.lit(0))
        return F.concat(F.array_repeat(F.lit(False), t - previous - 1), F.array(F.lit(True)))

    last = F.coalesce(F.try_element_at(targets, F.lit(-1)), F.lit(0))
    tail = F.array_repeat(F.lit(False), F.greatest(n_lines - last, F.lit(0)))
    # targets past the last line are ignored
    return F.slice(F.concat(F.flatten(F.transform(targets, gap)), tail), F.lit(1), n_lines)


def rename(files: DataFrame, targets: DataFrame, old: str, new: str, dry_run: bool = False) -> DataFrame:
    """Whole-word, case-sensitive replacement on the target lines (filepath, line).

    Returns the files that change: filepath, replacements and, unless dry, their new content. Every
    occurrence on a target line counts.
    """
    if not re.fullmatch(VALID_IDENTIFIER, new):
        raise ValueError(f"{new} cannot name a symbol")
    word = whole_word(old)
    per_file = targets.groupBy("filepath").agg(F.sort_array(F.collect_set(F.col("line").cast("int"))).alias("targets"))
    joined = files.select("filepath", "content").join(per_file, "filepath")

    def replaced(lines: Column) -> Column:
        def on(flags: Column) -> Column:
            hits = F.zip_with(lines, flags, lambda l, f: F.when(f, F.regexp_count(l, F.lit(word))).otherwise(F.lit(0)))
            count = F.aggregate(hits, F.lit(0), lambda acc, x: acc + x).alias("replacements")
            if dry_run:
                return F.struct(count)
            text = F.zip_with(lines, flags, lambda l, f: F.when(f, F.regexp_replace(l, word, new)).otherwise(l))
            return F.struct(count, join_lines(text).alias("content"))

        return let(_line_flags(F.col("targets"), F.size(lines)), on)

    # exploding the filtered result, not filtering it afterwards, keeps the work to one evaluation per file
    changed = F.filter(F.array(let(lines_of(F.col("content")), replaced)), lambda r: r["replacements"] > 0)
    result = joined.select("filepath", F.explode(changed).alias("r"))
    return result.select("filepath", "r.replacements", *([] if dry_run else ["r.content"]))


def rename_targets(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Lines holding a reference, and the definition's own line."""
    return references.select("filepath", "line").unionByName(
        definitions.select("filepath", F.col("start_line").alias("line"))
    )


def replacement_totals(renamed: DataFrame) -> DataFrame:
    return renamed.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("replacements"), F.lit(0)).alias("replacements")
    )


def indent_of(line: Column) -> Column:
    return F.regexp_extract(line, r"^(\s*)", 1)


def reindent(code: Column, indent: Column) -> Column:
    """Array of lines: common indent of the non-blank lines removed, ``indent`` put in front."""

    def shift(lines: Column) -> Column:
        written = F.filter(lines, lambda l: l.rlike(NOT_WHITE_SPACE))
        common = F.coalesce(F.array_min(F.transform(written, lambda l: F.length(indent_of(l)))), F.lit(0))
        return let(
            common,
            lambda c: F.transform(
                lines,
                lambda l: F.when(is_blank(l), F.lit("")).otherwise(F.concat(indent, F.substr(l, c + 1))),
            ),
        )

    return let(lines_of(code), shift)


def apply_line_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply one edit per file: filepath, content, new_start, new_end.

    edits: filepath, action (replace, insert_before, insert_after), start_line, end_line, body. The
    body takes over the indent of the start line. An insertion is set off by one blank line if the
    neighbouring line is not blank. Line numbers of the result tell where the body now stands.
    """
    joined = docs.select("filepath", "content").join(
        edits.select(
            "filepath", "action", F.col("start_line").cast("int"), F.col("end_line").cast("int"), "body"
        ),
        "filepath",
    )
    action, start, end = F.col("action"), F.col("start_line"), F.col("end_line")
    no_lines = F.array().cast("array<string>")

    def edited(lines: Column) -> Column:
        body = reindent(F.col("body"), indent_of(F.element_at(lines, start)))

        def place(new: Column) -> Column:
            cut = F.when(action == "insert_after", end).otherwise(start - 1)  # lines kept in front
            resume = F.when(action == "insert_before", start).otherwise(end + 1)  # first line kept behind
            head = F.slice(lines, F.lit(1), cut)
            tail = F.slice(lines, resume, F.greatest(F.size(lines) - resume + 1, F.lit(0)))
            above = F.when((action == "insert_after") & ~is_blank(F.element_at(lines, end)), F.array(F.lit(""))).otherwise(no_lines)
            below = F.when((action == "insert_before") & ~is_blank(F.element_at(lines, start)), F.array(F.lit(""))).otherwise(no_lines)
            first = cut + F.size(above) + 1
            return F.struct(
                join_lines(F.concat(head, above, new, below, tail)).alias("content"),
                first.cast("int").alias("new_start"),
                (first + F.size(new) - 1).cast("int").alias("new_end"),
            )

        return let(body, place)

    # exploded, so that a later filter on the new range does not repeat the edit
    result = F.explode(F.array(let(lines_of(F.col("content")), edited)))
    return joined.select("filepath", result.alias("r")).select("filepath", "r.*")
