"""Column expressions over file text: lines, words, globs, keyword score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points ECMAScript regular expressions and trim call white space.
WHITE_SPACE_CODES = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
]
WHITE_SPACE_CHARACTERS = "".join(chr(c) for c in WHITE_SPACE_CODES)
WHITE_SPACE = "[" + "".join(f"\\x{{{c:X}}}" for c in WHITE_SPACE_CODES) + "]"
NOT_WHITE_SPACE = "[^" + WHITE_SPACE[1:]

# Java counts accented letters as word characters, ECMAScript and RE2 do not.
WORD_CHARACTER = "[A-Za-z0-9_]"

# File extension -> language name; unknown extensions name themselves.
LANGUAGE_OF_EXTENSION = {
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "py": "python",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "rb": "ruby",
    "php": "php",
    "c": "c",
    "cpp": "cpp",
    "h": "c",
    "hpp": "cpp",
    "cs": "csharp",
    "swift": "swift",
    "kt": "kotlin",
    "md": "markdown",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda a plain column expression would be computed again for every array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(content: Column) -> Column:
    return F.split(content, "\n", -1)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def line_range(lines: Column, start: Column, end: Column) -> Column:
    """Text of the 1-based inclusive line range; empty when the range is."""
    return join_lines(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))))


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_WHITE_SPACE)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE_CHARACTERS))


def quote_regex(text: str) -> str:
    """Escape for Java and RE2 alike: a backslash before every ASCII character that is no word character."""
    return re.sub(r"([^\w\s]|[\n\t])", lambda m: "\\" + m.group(0) if ord(m.group(0)) < 128 else m.group(0), text)


def whole_word(text: str) -> str:
    """Pattern for ``text`` with an ASCII word boundary on both sides.

    Which look-around a boundary needs depends on the character next to it. The literal comes first,
    so the matcher can skip ahead to it before it looks around.
    """

    def is_word(ch: str) -> bool:
        return re.match(WORD_CHARACTER, ch) is not None

    quoted = quote_regex(text)
    before = f"(?<!{WORD_CHARACTER}{quoted})" if is_word(text[0]) else f"(?<={WORD_CHARACTER}{quoted})"
    after = f"(?!{WORD_CHARACTER})" if is_word(text[-1]) else f"(?={WORD_CHARACTER})"
    return quoted + before + after


def extension_of(filepath: Column) -> Column:
    """Extension without the dot, empty when there is none or the name only starts with a dot."""
    return F.regexp_extract(filepath, r"[^/]\.([^./]*)$", 1)


def language_of(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), extension)


def directory_of(filepath: Column) -> Column:
    """Everything before the last slash; null for a top-level file."""
    return F.when(F.contains(filepath, F.lit("/")), F.regexp_replace(filepath, "/[^/]*$", ""))


# --------------------------------------------------------------------------- globs


def _split_braces(pattern: str) -> list[str]:
    """Expand ``{a,b}`` into alternatives, innermost last."""
    depth, start = 0, -1
    for i, ch in enumerate(pattern):
        if ch == "{":
            if depth == 0:
                start = i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                options, part, level = [], "", 0
                for c in pattern[start + 1 : i]:
                    if c == "," and level == 0:
                        options.append(part)
                        part = ""
                        continue
                    level += (c == "{") - (c == "}")
                    part += c
                options.append(part)
                if len(options) < 2:
                    continue
                head, tail = pattern[:start], pattern[i + 1 :]
                return [p for o in options for p in _split_braces(head + o + tail)]
    return [pattern]


def _segment_regex(segment: str) -> str:
    out, i = "", 0
    while i < len(segment):
        ch = segment[i]
        if ch == "*":
            while i + 1 < len(segment) and segment[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in segment[i + 2 :]:
            close = segment.index("]", i + 2)
            body = segment[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = close
        else:
            out += quote_regex(ch)
        i += 1
    if segment[:1] in ("*", "?", "["):
        # wildcards never match a leading dot, nor an empty part
        out = r"(?!\.)(?=[^/])" + out
    return out


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression for a path glob.

    ``*`` and ``?`` stay inside one path part, ``**`` as a whole part crosses parts, and names that
    start with a dot are matched only by a pattern part that starts with one.
    """
    alternatives = []
    for plain in _split_braces(pattern):
        parts = plain.split("/")
        regex = ""
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            if part == "**":
                regex += r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*)" if last else r"(?:(?!\.)[^/]+/)*"
            else:
                regex += _segment_regex(part) + ("" if last else "/")
        alternatives.append(regex)
    return "^(?:" + "|".join(alternatives) + ")$"


def path_matches(filepath: Column, pattern: str) -> Column:
    """Glob test; a leading ``!`` turns the whole test round."""
    if pattern.startswith("!"):
        return ~filepath.rlike(glob_to_regex(pattern[1:]))
    return filepath.rlike(glob_to_regex(pattern))


def any_path_matches(filepath: Column, patterns: Iterable[str]) -> Column:
    joined = "|".join(glob_to_regex(p) for p in patterns)
    return filepath.rlike(joined) if joined else F.lit(False)


# --------------------------------------------------------------------------- keyword score


def query_terms(query: str) -> list[str]:
    return [t for t in query.lower().split() if len(t) > 2]


def keyword_score(query: str, content: Column, filepath: Column) -> Column:
    """Share of query terms found, between 0 and 1.

    A term found in the content counts 1, as a whole word 0.5 more (that bonus is capped at 0.5 on
    average), found in the path 0.5.
    """
    terms = query_terms(query)
    if not terms:
        return F.lit(0.0)
    text, path = F.lower(content), F.lower(filepath)
    points, bonus = F.lit(0.0), F.lit(0.0)
    for term in terms:
        found = F.contains(text, F.lit(term))
        points = points + found.cast("double") + F.contains(path, F.lit(term)).cast("double") * 0.5
        bonus = bonus + (found & text.rlike(whole_word(term))).cast("double") * 0.5
    n = float(len(terms))
    return F.least(points / n + F.least(bonus / n, F.lit(0.5)), F.lit(1.0))
