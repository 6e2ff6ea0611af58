"""Symbols, name-path lookup and references.

Symbols are one flat table: filepath, name, name_path, parent_path, kind, kind_path, depth,
start_line, end_line, start_column, end_column. ``kind_path`` lists the kinds from the top-level
ancestor down to the symbol, so pruning by kind needs no join.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.kinds import chunk_type_kind, kind_name
from passagemill.functions.names import build_name_path, display_name_path, match_name_path
from passagemill.functions.text import let, lines_of
from passagemill.operators.chunking import (
    OUTLINES,
    Outline,
    _definition_name,
    _definition_type,
    _spans,
    _tags,
    outlined_as,
)

SYMBOL_COLUMNS = [
    "filepath",
    "name",
    "name_path",
    "parent_path",
    "kind",
    "kind_path",
    "depth",
    "start_line",
    "end_line",
    "start_column",
    "end_column",
]

# Extensions searched for symbols and for references.
SYMBOL_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".rb"]
REFERENCE_EXTENSIONS = [
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
]

# A task holds about this many characters of found rows, and this many whole texts as Python strings.
BATCH_CHARS = 4 << 20
INPUT_ROWS = 64

# A set of searched names up to this size is handed to the tasks.
BROADCAST_NAMES = 100_000


def _symbol(line: Column, at: Column, end: Column, defs, parent_path: Column, parent_kinds: Column) -> Column:
    name = F.coalesce(_definition_name(line, defs), F.lit(""))
    kind = chunk_type_kind(_definition_type(line, defs))
    column = F.greatest(F.position(name, line) - 1, F.lit(0))
    return F.struct(
        name.alias("name"),
        build_name_path(parent_path, name).alias("name_path"),
        parent_path.alias("parent_path"),
        kind.alias("kind"),
        F.concat(parent_kinds, F.array(kind)).alias("kind_path"),
        F.size(parent_kinds).alias("depth"),
        at.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
        column.cast("int").alias("start_column"),
        (column + F.length(name)).cast("int").alias("end_column"),
    )


def _symbols_in(lines: Column, outline: Outline) -> Column:
    """Top-level definitions and the members of classes, in line order."""
    no_path, no_kinds = F.lit(None).cast("string"), F.array().cast("array<int>")
    spans = F.filter(
        _spans(_tags(lines, outline.definitions, outline.lead, outline.imports)), lambda s: s["at"].isNotNull()
    )

    def with_members(span: Column) -> Column:
        end = span["start"] + span["n_lines"] - 1
        head = F.element_at(lines, span["at"])
        top = _symbol(head, span["at"], end, outline.definitions, no_path, no_kinds)
        if not outline.members:
            return F.array(top)
        lead = outline.lead and outline.lead.replace("^", r"^\s*", 1)

        def family(parent: Column) -> Column:
            body = F.slice(lines, span["start"], span["n_lines"])
            shift = span["start"] - 1
            inner = F.filter(
                _spans(_tags(body, outline.members, lead)),
                lambda s: s["at"].isNotNull() & (s["at"] + shift != span["at"]),
            )
            children = F.transform(
                inner,
                lambda s: _symbol(
                    F.element_at(lines, s["at"] + shift),
                    s["at"] + shift,
                    s["start"] + s["n_lines"] - 1 + shift,
                    outline.members,
                    parent["name_path"],
                    parent["kind_path"],
                ),
            )
            only = F.array(parent)
            return F.when(parent["kind"] == 5, F.concat(only, children)).otherwise(only)

        return let(top, family)

    return F.flatten(F.transform(spans, with_members))


def extract_symbols(files: DataFrame, outlines: dict[str, Outline] | Outline | None = None) -> DataFrame:
    """Symbol rows of every file, by the line patterns of its language; no shuffle."""
    outlines = OUTLINES if outlines is None else outlines

    def build(lines: Column) -> Column:
        if isinstance(outlines, Outline):
            return _symbols_in(lines, outlines)
        found = None
        for language, outline in outlines.items():
            test, value = outlined_as(F.col("language")) == language, _symbols_in(lines, outline)
            found = F.when(test, value) if found is None else found.when(test, value)
        return found

    rows = files.select("filepath", F.explode(let(lines_of(F.col("content")), build)).alias("s"))
    return rows.select("filepath", *[F.col(f"s.{c}").alias(c) for c in SYMBOL_COLUMNS[1:]])


def children_of(symbols: DataFrame, parent_path: str | None = None) -> DataFrame:
    """Children of one path, or every (parent, child) pair of the table."""
    if parent_path is not None:
        return symbols.filter(F.col("parent_path") == parent_path)
    parents = symbols.select("filepath", F.col("name_path").alias("parent_path"), F.col("kind").alias("parent_kind"))
    return symbols.filter(F.col("parent_path").isNotNull()).join(parents, ["filepath", "parent_path"])


def symbols_overview(symbols: DataFrame, depth: int = 0) -> DataFrame:
    """One row per symbol down to ``depth``: filepath, kind_name, name, name_path, lines, children."""
    shown = symbols.filter(F.col("depth") <= depth)
    counts = (
        symbols.filter(F.col("parent_path").isNotNull())
        .groupBy("filepath", F.col("parent_path").alias("name_path"))
        .agg(F.count(F.lit(1)).alias("children"))
    )
    return shown.join(counts, ["filepath", "name_path"], "left").select(
        "filepath",
        kind_name(F.col("kind")).alias("kind_name"),
        "name",
        display_name_path(F.col("name_path")).alias("name_path"),
        F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines"),
        F.coalesce("children", F.lit(0)).alias("children"),
    )


def overview_counts(symbols: DataFrame, depth: int = 0) -> DataFrame:
    """Symbols per file and kind, and the file's total over all kinds."""
    kinds = symbols.filter(F.col("depth") <= depth).groupBy("filepath", "kind").agg(F.count(F.lit(1)).alias("n"))
    totals = kinds.groupBy("filepath").agg(F.sum("n").alias("total_symbols"))
    return kinds.join(totals, "filepath").select("filepath", kind_name(F.col("kind")).alias("kind_name"), "n", "total_symbols")


def kinds_pass(kind_path: Column, include: Sequence[int] | None, exclude: Sequence[int] | None) -> Column:
    """Every symbol on the way down passes; exclusion beats inclusion."""

    def ok(kind: Column) -> Column:
        test = F.lit(True)
        if exclude is not None:
            test = test & ~kind.isin(*exclude)
        if include is not None:
            test = test & kind.isin(*include)
        return test

    return F.forall(kind_path, ok)


def find_symbol(
    symbols: DataFrame,
    pattern: str,
    path: str | None = None,
    depth: int | None = None,
    kinds: Sequence[int] | None = None,
    not_kinds: Sequence[int] | None = None,
    prefix: bool | None = None,
) -> DataFrame:
    """Symbols whose name path matches; a symbol filtered out by kind hides everything below it."""
    found = symbols
    if path:
        found = found.filter((F.col("filepath") == path) | F.startswith("filepath", F.lit(path.rstrip("/") + "/")))
    if depth is not None:
        found = found.filter(F.col("depth") <= depth)
    if kinds is not None or not_kinds is not None:
        found = found.filter(kinds_pass(F.col("kind_path"), kinds, not_kinds))
    return found.filter(match_name_path(F.col("name_path"), pattern, prefix))


def with_body(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Add each symbol's source lines."""
    from passagemill.functions.text import line_range

    joined = symbols.join(files.select("filepath", "content"), "filepath", "left")
    body = let(lines_of(F.col("content")), lambda lines: line_range(lines, F.col("start_line"), F.col("end_line")))
    return joined.withColumn("body", body).drop("content")


def first_symbol(symbols: DataFrame, pattern: str, path: str | None = None) -> DataFrame:
    """The first match in file order (outer before inner): a top-1, no full sort."""
    return find_symbol(symbols, pattern, path).orderBy("filepath", "start_line", "depth", "name_path").limit(1)


def first_symbol_per_file(symbols: DataFrame, pattern: str) -> DataFrame:
    order = F.struct("start_line", "depth", "name_path")
    return find_symbol(symbols, pattern).groupBy("filepath").agg(F.min_by("name_path", order).alias("name_path"))


# --------------------------------------------------------------------------- references

# A run of word characters. A name is found through the first run in it, whatever other names are asked for:
# it must stand there, and where it begins or ends with a word character no further one may adjoin.
RUN = r"[A-Za-z0-9_]+"
# Up to this many runs are searched as one alternation instead of looking up every run of a text.
ALTERNATION = 50
_TOKENS = "filepath string, line int, column int, name string, snippet string"
_RUNS = "filepath string, line int, column int, name string, snippet string, place int"


def _starts_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at] in _WORD_CHARACTERS


_WORD_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def _stands_at(text: str, name: str, at: int) -> bool:
    end = at + len(name)
    return (
        at >= 0
        and text.startswith(name, at)
        and _starts_word(text, at - 1) != _starts_word(text, at)
        and _starts_word(text, end - 1) != _starts_word(text, end)
    )


def _token_rows(names: frozenset | None):
    """Arrow task: occurrences of ``names`` (or all runs) in whole texts, with the line before and after.

    For all runs the offset of the run in its snippet is added.
    """
    by_run: dict[str, list[tuple[int, str]]] = {}
    for name in sorted(names or ()):
        run = re.search(RUN, name, re.ASCII)
        if run and "\n" not in name:
            by_run.setdefault(run.group(), []).append((run.start(), name))
    if names is not None and len(by_run) <= ALTERNATION:
        some = "|".join(sorted(by_run)) or "(?!)"
        word = re.compile(r"(?<![A-Za-z0-9_])(?:" + some + r")(?![A-Za-z0-9_])", re.ASCII)
    else:
        word = re.compile(RUN, re.ASCII)

    def rows_of(path: str, text: str) -> Iterator[tuple]:
        first = word.search(text)
        if first is None:
            return
        lines, ends, at = text.split("\n"), [], -1
        for line in lines:
            at += len(line) + 1
            ends.append(at)
        for m in word.finditer(text, first.start()):
            found = [(0, m.group())] if names is None else by_run.get(m.group(), ())
            for offset, name in found:
                start = m.start() - offset
                if offset or name != m.group():
                    if not _stands_at(text, name, start):
                        continue
                i = bisect.bisect_left(ends, start)
                begin = ends[i - 1] + 1 if i else 0
                snippet = "\n".join(lines[max(0, i - 1) : i + 2])
                if names is None:
                    yield path, i + 1, start - begin, name, snippet, start - begin + (len(lines[i - 1]) + 1 if i else 0)
                else:
                    yield path, i + 1, start - begin, name, snippet

    return batched(rows_of, ["filepath", "content"], _RUNS if names is None else _TOKENS)


def batched(rows_of, inputs: Sequence[str], ddl: str, size: int = 20_000, chars: int = BATCH_CHARS):
    """mapInArrow function that turns each input row into output rows.

    A batch ends at ``size`` rows or ``chars`` characters, whichever comes first: rows that repeat a long line
    are many times its text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    texts = [i for i, field in enumerate(schema) if pa.types.is_string(field.type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(schema)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
            )
            out.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, INPUT_ROWS):
                part = batch.slice(at, INPUT_ROWS)
                columns = [part.column(c).to_pylist() for c in inputs]
                for values in zip(*columns):
                    if values[-1] is None:
                        continue
                    for row in rows_of(*values):
                        out.append(row)
                        held += sum([len(row[i]) for i in texts])
                        if len(out) >= size or held >= chars:
                            yield flush()
                            held = 0
        if out:
            yield flush()

    return run


def find_occurrences(files: DataFrame, names: DataFrame, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """Every occurrence of one of ``names`` (column name): filepath, line, column, name, snippet.

    Each name is searched on its own, so the rows of a name don't depend on how many are asked for; a name
    without a word character, or over several lines, occurs nowhere. A bounded set of names travels to the
    tasks and nothing is shuffled; a larger one is joined to the runs of word characters.
    """
    wanted = names.select("name").distinct()
    head = [r["name"] for r in wanted.limit(broadcast_names + 1).collect()]
    texts = files.select("filepath", "content")
    if len(head) <= broadcast_names:
        if len(head) == 0:
            return texts.limit(0).mapInArrow(_token_rows(frozenset()), _TOKENS)
        if len(head) <= 3:
            texts = texts.filter(reduce(or_, [F.contains("content", F.lit(n)) for n in head]))
        return texts.mapInArrow(_token_rows(frozenset(head)), _TOKENS)
    run = F.regexp_extract("name", RUN, 0)
    keyed = wanted.where((run != "") & ~F.contains("name", F.lit("\n"))).select(
        F.col("name").alias("wanted"), run.alias("name"), (F.instr("name", run) - 1).alias("offset")
    )
    found = texts.mapInArrow(_token_rows(None), _RUNS).join(keyed, "name")
    start = F.col("place") - F.col("offset")
    length = F.length("wanted")
    is_word = lambda c: F.coalesce(F.rlike(c, F.lit("^[A-Za-z0-9_]$")), F.lit(False))
    char = lambda at: F.when(at < 0, F.lit("")).otherwise(F.substring("snippet", at + 1, F.lit(1)))
    stands = (
        (F.col("column") >= F.col("offset"))
        & (F.substring("snippet", start + 1, length) == F.col("wanted"))
        & (is_word(char(start - 1)) != is_word(char(start)))
        & (is_word(char(start + length - 1)) != is_word(char(start + length)))
    )
    return found.where(stands).select(
        "filepath", "line", (F.col("column") - F.col("offset")).alias("column"), F.col("wanted").alias("name"), "snippet"
    )


def drop_definitions(occurrences: DataFrame, definitions: DataFrame, whole_range: bool = False) -> DataFrame:
    """Leave out occurrences on the definition's first line, or anywhere inside its line range."""
    d = definitions.select(
        F.col("filepath").alias("def_file"),
        F.col("name").alias("def_name"),
        F.col("start_line").alias("def_start"),
        F.col("end_line" if whole_range else "start_line").alias("def_end"),
    )
    inside = (
        (F.col("filepath") == F.col("def_file"))
        & (F.col("name") == F.col("def_name"))
        & F.col("line").between(F.col("def_start"), F.col("def_end"))
    )
    return occurrences.join(d, inside, "left_anti")


def find_references(
    files: DataFrame,
    definitions: DataFrame,
    whole_range: bool = False,
    kinds: Sequence[int] | None = None,
    not_kinds: Sequence[int] | None = None,
) -> DataFrame:
    """References to the defined names, definitions left out.

    Every reference counts as a Variable (13), so kind filters keep all or nothing.
    """
    found = drop_definitions(find_occurrences(files, definitions), definitions, whole_range)
    found = found.withColumn("kind", F.lit(13))
    if not_kinds is not None and 13 in not_kinds or kinds is not None and 13 not in kinds:
        return found.filter(F.lit(False))
    return found


def references_by_file(references: DataFrame) -> DataFrame:
    return references.groupBy("filepath").agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line")
    )
