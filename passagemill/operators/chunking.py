"""Cutting files into chunks.

Every operator here works inside one row (a file) with array functions and one ``explode``: no
shuffle, so the cost is one pass over the text however the files are distributed.
Chunk columns: id, filepath, content, start_line, end_line, language, symbol_type, symbol_name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import is_blank, join_lines, language_of, let, lines_of

# Limits of the line and structure chunkers.
DEFAULT_MAX_LINES = 100
DEFAULT_OVERLAP = 20
MAX_SECTION_LINES = 100
MIN_SECTION_LINES = 3


def chunk_id(filepath: Column, start: Column, end: Column, name: Column) -> Column:
    plain = F.concat(filepath, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.concat(plain, F.coalesce(F.concat(F.lit(":"), F.when(name != "", name)), F.lit("")))


def _exploded(files: DataFrame, pieces: Column, keep: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """One row per piece; ``pieces`` is an array of struct(content, start_line, end_line, type, name).

    ``keep`` are columns of the file, ``extra`` further fields of the pieces.
    """
    rows = files.select("filepath", "language", *keep, F.explode(pieces).alias("p"))
    return rows.select(
        chunk_id(F.col("filepath"), F.col("p.start_line"), F.col("p.end_line"), F.col("p.symbol_name")).alias("id"),
        "filepath",
        F.col("p.content").alias("content"),
        F.col("p.start_line").alias("start_line"),
        F.col("p.end_line").alias("end_line"),
        "language",
        F.col("p.symbol_type").alias("symbol_type"),
        F.col("p.symbol_name").alias("symbol_name"),
        *keep,
        *[F.col(f"p.{c}").alias(c) for c in extra],
    )


def _piece(lines: Column, start: Column, n_lines: Column, symbol_type: Column, name: Column) -> Column:
    """Chunk of ``n_lines`` lines from the 1-based line ``start`` on."""
    return F.struct(
        join_lines(F.slice(lines, start, n_lines)).alias("content"),
        start.cast("int").alias("start_line"),
        (start + n_lines - 1).cast("int").alias("end_line"),
        symbol_type.cast("string").alias("symbol_type"),
        name.cast("string").alias("symbol_name"),
    )


def _line_windows(lines: Column, max_lines: int, overlap: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(max_lines - overlap))
    none = F.lit(None)
    return F.transform(
        starts,
        lambda s: _piece(lines, s, F.least(F.lit(max_lines), F.size(lines) - s + 1), none, none),
    )


def _not_blank(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: ~is_blank(p["content"]))


def chunk_by_lines(
    files: DataFrame, max_lines: int = DEFAULT_MAX_LINES, overlap: int = DEFAULT_OVERLAP, keep: Sequence[str] = ()
) -> DataFrame:
    """Overlapping windows of lines; a window starts every ``max_lines - overlap`` lines."""
    if not 0 <= overlap < max_lines:
        raise ValueError("overlap must be smaller than max_lines")
    pieces = let(lines_of(F.col("content")), lambda lines: _not_blank(_line_windows(lines, max_lines, overlap)))
    return _exploded(files, pieces, keep)


# --------------------------------------------------------------------------- splitting large chunks


def _split_parts(piece: Column, max_lines: int, min_lines: int) -> Column:
    """Near-equal parts of a chunk over the limit; a short tail joins the part before it."""

    def parts_of(lines: Column) -> Column:
        n = F.size(lines)
        count = F.ceil(n / F.lit(max_lines)).cast("int")
        per = F.ceil(n / count).cast("int")
        tail = n - (count - 1) * per
        kept = F.when(per < min_lines, F.lit(1)).otherwise(
            count - F.when(tail < min_lines, F.lit(1)).otherwise(F.lit(0))
        )
        first = piece["start_line"]

        def part(i: Column) -> Column:
            length = F.when(i == kept, n - (i - 1) * per).otherwise(per)
            return F.struct(
                join_lines(F.slice(lines, (i - 1) * per + 1, length)).alias("content"),
                (first + (i - 1) * per).cast("int").alias("start_line"),
                (first + (i - 1) * per + length - 1).cast("int").alias("end_line"),
                piece["symbol_type"].alias("symbol_type"),
                F.concat(piece["symbol_name"], F.lit(" (part "), i.cast("string"), F.lit(")")).alias("symbol_name"),
            )

        whole = F.array(F.struct(*[piece[c].alias(c) for c in _PIECE_FIELDS]))
        return F.when(n <= max_lines, whole).otherwise(F.transform(F.sequence(F.lit(1), kept), part))

    return let(lines_of(piece["content"]), parts_of)


_PIECE_FIELDS = ("content", "start_line", "end_line", "symbol_type", "symbol_name")


def split_large_chunks(
    chunks: DataFrame, max_lines: int = MAX_SECTION_LINES, min_lines: int = MIN_SECTION_LINES
) -> DataFrame:
    piece = F.struct(*[F.col(c) for c in _PIECE_FIELDS])
    pieces = let(piece, lambda p: _split_parts(p, max_lines, min_lines))
    return _exploded(chunks, pieces)


# --------------------------------------------------------------------------- structure


@dataclass(frozen=True)
class Definition:
    """A line that opens a definition: its pattern, the chunk type, and the group holding the name."""

    pattern: str
    symbol_type: str
    name_group: int = 1


@dataclass(frozen=True)
class Outline:
    """Line patterns of one kind of text.

    ``lead`` lines (comments, decorators) directly above a definition belong to it, ``imports``
    lines become one chunk of their own, ``members`` open the parts of an oversized class.
    """

    definitions: tuple[Definition, ...]
    members: tuple[Definition, ...] = ()
    imports: str | None = None
    lead: str | None = None


# Line patterns standing in for a parser, one outline per language.
OUTLINES = {
    "python": Outline(
        (
            Definition(r"^(?:async +)?def +(\w+)", "function"),
            Definition(r"^class +(\w+)", "class"),
        ),
        (Definition(r"^\s+(?:async +)?def +(\w+)", "method"),),
        r"^(?:import|from) ",
        r"^(?:#|@)",
    ),
    "typescript": Outline(
        (
            Definition(r"^(?:export +)?(?:default +)?(?:async +)?function\*? +(\w+)", "function"),
            Definition(r"^(?:export +)?(?:default +)?(?:abstract +)?class +(\w+)", "class"),
            Definition(r"^(?:export +)?interface +(\w+)", "interface"),
            Definition(r"^(?:export +)?type +(\w+)", "type"),
            Definition(r"^(?:export +)?(?:const|let|var) +(\w+)", "variable"),
            Definition(r"^(?:export +)?(?:const +)?enum +(\w+)", "other"),
        ),
        (
            Definition(
                r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly|override) +)*"
                r"(?!if\b|for\b|while\b|switch\b|return\b|catch\b)(\w+)\s*(?:<[^>]*>)?\(.*\)[^;{(=]*\{",
                "method",
            ),
        ),
        r"^(?:import\b|export +(?:\*|\{))",
        r"^(?:/\*\*| \*|//|@)",
    ),
    "go": Outline(
        (
            Definition(r"^func +(?:\([^)]*\) *)?(\w+)", "function"),
            Definition(r"^type +(\w+) +interface", "interface"),
            Definition(r"^type +(\w+)", "type"),
            Definition(r"^(?:var|const) +(\w+)", "variable"),
        ),
        (),
        r"^import\b",
        r"^//",
    ),
    "rust": Outline(
        (
            Definition(r"^(?:pub(?:\([^)]*\))? +)?(?:async +|unsafe +|const +)*fn +(\w+)", "function"),
            Definition(r"^(?:pub(?:\([^)]*\))? +)?trait +(\w+)", "interface"),
            Definition(r"^(?:pub(?:\([^)]*\))? +)?(?:struct|enum|type) +(\w+)", "type"),
            Definition(r"^impl(?:<[^>]*>)? +(?:\w+ +for +)?(\w+)", "type"),
            Definition(r"^(?:pub(?:\([^)]*\))? +)?(?:const|static) +(\w+)", "variable"),
        ),
        (),
        r"^(?:pub +)?use ",
        r"^(?:///|//|#\[)",
    ),
    "java": Outline(
        (
            Definition(
                r"^(?:(?:public|protected|private|abstract|final|static|sealed) +)*(?:class|enum|record) +(\w+)", "class"
            ),
            Definition(r"^(?:(?:public|protected|private) +)*interface +(\w+)", "interface"),
        ),
        (
            Definition(
                r"^\s+(?:(?:public|protected|private|abstract|final|static|synchronized) +)+"
                r"(?:[\w<>\[\], ?]+ +)?(\w+)\s*\(",
                "method",
            ),
        ),
        r"^import ",
        r"^(?:/\*\*| \*|//|@)",
    ),
    "ruby": Outline(
        (
            Definition(r"^(?:class|module) +(\w+)", "class"),
            Definition(r"^def +(?:self\.)?(\w+)", "function"),
        ),
        (Definition(r"^\s+def +(?:self\.)?(\w+)", "method"),),
        r"^require",
        r"^#",
    ),
}
OUTLINES["javascript"] = OUTLINES["typescript"]

# Extensions that name themselves as language but are cut like another one.
CUT_LIKE = {"mts": "typescript", "cts": "typescript", "mjs": "javascript", "cjs": "javascript", "pyi": "python"}


def outlined_as(language: Column) -> Column:
    """The language whose outline cuts files of ``language``."""
    table = F.create_map(*[F.lit(x) for pair in CUT_LIKE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, language), language)


def _first_match(line: Column, definitions: Sequence[Definition], value) -> Column:
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for d in definitions:
        result = result.when(line.rlike(d.pattern), value(d))
    return result


def _definition_type(line: Column, definitions: Sequence[Definition]) -> Column:
    return _first_match(line, definitions, lambda d: F.lit(d.symbol_type))


def _definition_name(line: Column, definitions: Sequence[Definition]) -> Column:
    return _first_match(
        line, definitions, lambda d: F.regexp_extract(line, d.pattern, d.name_group) if d.name_group else F.lit(None)
    )


def _tags(lines: Column, definitions: Sequence[Definition], lead: str | None, imports: str | None = None) -> Column:
    """One letter per line: I import, D definition, L lead, O other."""

    def tag(line: Column) -> Column:
        out = F.when(F.lit(False), F.lit("O"))
        if imports:
            out = out.when(line.rlike(imports), F.lit("I"))
        out = out.when(_definition_type(line, definitions).isNotNull(), F.lit("D"))
        if lead:
            out = out.when(line.rlike(lead), F.lit("L"))
        return out.otherwise(F.lit("O"))

    return F.array_join(F.transform(lines, tag), "")


def _spans(tags: Column) -> Column:
    """struct(start, n_lines, at, is_import) per section: one opens at a definition or the lead above it.

    ``at`` is the line of the definition itself, null for lines before the first definition and for
    a run of imports. Opening lines are marked in the tag string (S lead, T definition, J import,
    P first line after imports), so the work stays linear in the number of lines.
    """
    marked = F.regexp_replace(tags, r"(?<!L)L(?=L*D)", "S")
    marked = F.regexp_replace(marked, r"(?<![LS])D", "T")
    marked = F.regexp_replace(marked, r"(?<!I)I", "J")
    marked = F.regexp_replace(marked, r"(?<=[IJ])[OL]", "P")

    def spans_of(marks: Column) -> Column:
        opens = F.filter(
            F.transform(marks, lambda m, i: F.when(m.isin("S", "T", "J", "P") | (i == 0), i + 1)),
            lambda x: x.isNotNull(),
        )
        return let(opens, lambda starts: F.transform(starts, lambda s, j: span_at(marks, starts, s, j)))

    def span_at(marks: Column, starts: Column, s: Column, j: Column) -> Column:
        n_lines = F.coalesce(F.try_element_at(starts, j + 2), F.size(marks) + 1) - s
        mark = F.element_at(marks, s)
        below_lead = F.array_position(F.slice(marks, s, n_lines), "D").cast("int")
        return F.struct(
            s.alias("start"),
            n_lines.alias("n_lines"),
            F.when(mark == "T", s).when(mark == "S", s + below_lead - 1).alias("at"),
            (mark == "J").alias("is_import"),
        )

    return let(F.split(marked, "(?<=.)(?=.)"), spans_of)


def _import_chunk(lines: Column, tags: Column) -> Column:
    """One chunk from the first to the last import line, as an array of one or none."""
    first = F.instr(tags, "I")
    last = F.length(tags) - F.instr(F.reverse(tags), "I") + 1
    chunk = _piece(lines, F.greatest(first, F.lit(1)), last - first + 1, F.lit("import"), F.lit("imports"))
    return F.filter(F.array(chunk), lambda _: first > 0)


def _sections(lines: Column, outline: Outline) -> Column:
    def build(tags: Column) -> Column:
        def section(s: Column) -> Column:
            head = F.element_at(lines, s["at"])
            named = s["at"].isNotNull()
            return _piece(
                lines,
                s["start"],
                s["n_lines"],
                F.when(named, _definition_type(head, outline.definitions)).otherwise(F.lit("other")),
                F.when(named, _definition_name(head, outline.definitions)),
            )

        plain = F.transform(F.filter(_spans(tags), lambda s: ~s["is_import"]), section)
        return F.array_sort(F.concat(_import_chunk(lines, tags), plain), _by_start)

    return let(_tags(lines, outline.definitions, outline.lead, outline.imports), build)


def _by_start(a: Column, b: Column) -> Column:
    return (
        F.when(a["start_line"] < b["start_line"], F.lit(-1))
        .when(a["start_line"] > b["start_line"], F.lit(1))
        .otherwise(F.lit(0))
    )


def _split_class(section: Column, outline: Outline, max_lines: int) -> Column:
    """An oversized class becomes a ``(header)`` chunk and one chunk per member, named Class.member."""
    same = F.array(F.struct(*[section[c].alias(c) for c in _PIECE_FIELDS]))
    if not outline.members:
        return same

    def members_of(lines: Column) -> Column:
        def piece(s: Column) -> Column:
            member = F.element_at(lines, s["at"])
            name = _definition_name(member, outline.members)
            base = _piece(
                lines,
                s["start"],
                s["n_lines"],
                F.when(s["at"].isNull(), F.lit("class")).otherwise(_definition_type(member, outline.members)),
                F.when(s["at"].isNull(), F.concat(section["symbol_name"], F.lit(" (header)"))).otherwise(
                    F.concat_ws(".", section["symbol_name"], name)
                ),
            )
            shift = section["start_line"] - 1
            return base.withField("start_line", base["start_line"] + shift).withField(
                "end_line", base["end_line"] + shift
            )

        def parts_of(spans: Column) -> Column:
            has_members = F.exists(spans, lambda s: s["at"].isNotNull())
            return F.when(has_members, F.transform(spans, piece)).otherwise(same)

        lead = outline.lead and outline.lead.replace("^", r"^\s*", 1)
        big = (section["symbol_type"] == "class") & (F.size(lines) > max_lines)
        return F.when(big, let(_spans(_tags(lines, outline.members, lead)), parts_of)).otherwise(same)

    return let(lines_of(section["content"]), members_of)


def _structure_pieces(lines: Column, outline: Outline, max_lines: int, min_lines: int) -> Column:
    sections = _not_blank(_sections(lines, outline))
    by_member = F.flatten(F.transform(sections, lambda s: _split_class(s, outline, max_lines)))
    return F.flatten(F.transform(by_member, lambda p: _split_parts(p, max_lines, min_lines)))


def chunk_by_structure(
    files: DataFrame,
    outline: Outline,
    max_lines: int = MAX_SECTION_LINES,
    min_lines: int = MIN_SECTION_LINES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One chunk per definition, imports first as one chunk, oversized ones split."""
    pieces = let(lines_of(F.col("content")), lambda lines: _structure_pieces(lines, outline, max_lines, min_lines))
    return _exploded(files, pieces, keep)


def collapse_preamble(units: DataFrame, preamble_types: Sequence[str] = ("import",)) -> DataFrame:
    """All preamble units of a file become one row from the first to the last of their lines.

    Units: filepath, symbol_type, symbol_name, start_line, end_line.
    """
    is_preamble = F.col("symbol_type").isin(*preamble_types)
    merged = (
        units.filter(is_preamble)
        .groupBy("filepath")
        .agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
        .select(
            "filepath",
            F.lit("import").alias("symbol_type"),
            F.lit("imports").alias("symbol_name"),
            "start_line",
            "end_line",
        )
    )
    return merged.unionByName(units.filter(~is_preamble).select(*merged.columns))


# --------------------------------------------------------------------------- routing


def chunk_method(extension: Column) -> Column:
    """structure for languages with an outline, lines for the rest."""
    return F.when(outlined_as(language_of(extension)).isin(*sorted(OUTLINES)), F.lit("structure")).otherwise(F.lit("lines"))


def chunk_files(
    files: DataFrame,
    max_lines: int = DEFAULT_MAX_LINES,
    overlap: int = DEFAULT_OVERLAP,
    outlines: dict[str, Outline] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Structure chunks where the language has an outline and a definition was found, else line windows.

    One pass over the files: each row builds the pieces of its own language only. ``method`` tells
    which chunker made the chunk and ``fell_back`` whether the structure chunker found nothing; they
    travel inside the pieces, since Catalyst would copy the whole expression for each column.
    """
    outlines = OUTLINES if outlines is None else outlines

    def build(lines: Column) -> Column:
        structured = F.when(F.lit(False), _not_blank(_line_windows(lines, max_lines, overlap)))
        for language, outline in outlines.items():
            structured = structured.when(
                outlined_as(F.col("language")) == language, _structure_pieces(lines, outline, MAX_SECTION_LINES, MIN_SECTION_LINES)
            )

        def choose(pieces: Column) -> Column:
            found = F.coalesce(F.exists(pieces, lambda p: p["symbol_type"] != "other"), F.lit(False))
            by_lines = _not_blank(_line_windows(lines, max_lines, overlap))
            return let(found, lambda f: F.transform(F.when(f, pieces).otherwise(by_lines), lambda p: mark(p, pieces, f)))

        def mark(p: Column, pieces: Column, found: Column) -> Column:
            method = F.when(found, F.lit("structure")).otherwise(F.lit("lines"))
            return p.withField("method", method).withField("fell_back", pieces.isNotNull() & ~found)

        return let(structured, choose)

    pieces = let(lines_of(F.col("content")), build)
    return _exploded(files, pieces, keep, ["method", "fell_back"])


def chunking_stats(chunked_files: DataFrame, shown: int = 5) -> DataFrame:
    """One row: files per method, fallbacks, their share in percent and the first few names.

    Input: one row per file with filepath, method and fell_back. Only ``shown`` names are ever
    gathered, never the whole list.
    """
    counts = chunked_files.agg(
        F.count_if(F.col("method") == "structure").alias("structure_chunked"),
        F.count_if(F.col("method") == "lines").alias("line_chunked"),
        F.count_if("fell_back").alias("fallbacks"),
        F.count(F.lit(1)).alias("files"),
    )
    names = (
        chunked_files.filter("fell_back")
        .select("filepath")
        .orderBy("filepath")
        .limit(shown)
        .agg(F.array_join(F.array_sort(F.collect_list("filepath")), ", ").alias("fallback_names"))
    )
    percent = F.when(F.col("files") > 0, F.round(100.0 * F.col("fallbacks") / F.col("files"), 1)).otherwise(F.lit(0.0))
    return counts.select("*", percent.alias("fallback_percent"), F.lit(1).alias("one")).join(
        names.withColumn("one", F.lit(1)), "one"
    ).drop("one")
