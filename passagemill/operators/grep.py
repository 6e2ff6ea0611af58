"""Regular-expression search over whole texts, with context lines and an output budget."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import any_path_matches
from passagemill.operators.symbols import batched

# Code extensions, folders left out, size of an answer, extra cost per match.
CODE_EXTENSIONS = [
    ".ts",
    ".tsx",
    ".js",
    ".jsx",
    ".mts",
    ".cts",
    ".mjs",
    ".cjs",
    ".py",
    ".pyi",
    ".go",
    ".rs",
    ".java",
    ".kt",
    ".rb",
    ".php",
    ".c",
    ".cpp",
    ".h",
    ".hpp",
    ".cs",
    ".swift",
    ".scala",
    ".lua",
    ".r",
    ".R",
    ".sh",
    ".bash",
    ".zsh",
    ".sql",
]
EXCLUDED = [
    "node_modules/**",
    ".git/**",
    "dist/**",
    "build/**",
    "coverage/**",
    "__pycache__/**",
    ".next/**",
    ".cache/**",
    "vendor/**",
]
MAX_ANSWER_CHARS = 50_000
MATCH_OVERHEAD = 50

_MATCHES = "filepath string, line int, match_start int, match_length int, content string"


def files_to_search(
    files: DataFrame, include: str | None = None, exclude: str | None = None, code_only: bool = False
) -> DataFrame:
    """Files by glob; the code-extension list beats the include glob. Every file counts once."""
    path = F.col("filepath")
    kept = files.filter(~any_path_matches(path, EXCLUDED))
    if code_only:
        kept = kept.filter(F.regexp_extract(path, r"(\.[^./]*)$", 1).isin(*CODE_EXTENSIONS))
    elif include is not None:
        kept = kept.filter(any_path_matches(path, [include]))
    if exclude is not None:
        kept = kept.filter(~any_path_matches(path, [exclude]))
    return kept


def grep(
    files: DataFrame, pattern: str, before: int = 0, after: int = 0, include: str | None = None,
    exclude: str | None = None, code_only: bool = False,
) -> DataFrame:
    """All matches: filepath, line (from 1), match_start (from 0), match_length, content (context lines).

    The pattern sees the whole text, so a match may span lines; ``^`` and ``$`` stand at every line.
    """
    try:
        compiled = re.compile(pattern, re.MULTILINE | re.ASCII)
    except re.error as e:
        raise ValueError(f"Invalid regex pattern: {pattern}. {e}") from e

    def rows_of(path: str, text: str) -> Iterator[tuple]:
        first = compiled.search(text)
        if first is None:
            return
        lines, ends, at = text.split("\n"), [], -1
        for line in lines:
            at += len(line) + 1
            ends.append(at)
        for m in compiled.finditer(text, first.start()):
            i = bisect.bisect_left(ends, m.start())
            begin = ends[i - 1] + 1 if i else 0
            context = "\n".join(lines[max(0, i - before) : i + 1 + after])
            yield path, i + 1, m.start() - begin, m.end() - m.start(), context

    searched = files_to_search(files, include, exclude, code_only)
    if re.fullmatch(r"[\w ]+", pattern):
        searched = searched.filter(F.contains("content", F.lit(pattern)))  # plain words: skip files in the JVM
    return searched.select("filepath", "content").mapInArrow(batched(rows_of, ["filepath", "content"], _MATCHES), _MATCHES)


def within_budget(matches: DataFrame, max_chars: int = MAX_ANSWER_CHARS) -> DataFrame:
    """Matches in file order as long as the output before them is under ``max_chars``.

    A match costs its context plus 50, so no more than max_chars / 50 can fit: the running total
    only ever sees that many rows, picked by a distributed top-n.
    """
    most = math.ceil(max_chars / MATCH_OVERHEAD)
    order = ["filepath", "line", "match_start", "match_length"]
    head = matches.orderBy(*order).limit(most)
    so_far = F.sum(F.length("content") + MATCH_OVERHEAD).over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return head.withColumn("used", F.coalesce(so_far, F.lit(0))).filter(F.col("used") < max_chars)


def matches_by_file(matches: DataFrame) -> DataFrame:
    return matches.groupBy("filepath").agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line")
    )


def matched_files(results: DataFrame) -> DataFrame:
    return results.agg(F.countDistinct("filepath").alias("files"))


def exclude_paths(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return files.filter(~any_path_matches(F.col("filepath"), patterns))
