"""Hierarchical name paths such as ``/Outer/inner``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NamePattern:
    parts: tuple[str, ...]
    absolute: bool = False
    prefix: bool = False
    overload: int | None = None


def parse_name_path(text: str) -> NamePattern:
    """``/`` in front: from the root. ``[n]`` at the end: overload index. ``*`` at the end: prefix."""
    shape = re.fullmatch(r"(?s)(/?)(.*?)(?:\[(\d+)\])?", text.strip())
    parts = [p for p in shape[2].split("/") if p]
    prefix = bool(parts) and parts[-1].endswith("*")
    if prefix:
        parts[-1] = parts[-1].removesuffix("*")
    return NamePattern(tuple(parts), bool(shape[1]), prefix, None if shape[3] is None else int(shape[3]))


def name_parts(name_path: Column) -> Column:
    return F.filter(F.split(name_path, "/", -1), lambda p: p != "")


def match_name_path(name_path: Column, pattern: str | NamePattern, prefix: bool | None = None) -> Column:
    """True where the path equals the pattern (absolute) or ends with it (relative).

    With ``prefix`` the last part only has to start with the pattern's, ignoring case; if it is not
    given, a trailing ``*`` decides.
    """
    p = parse_name_path(pattern) if isinstance(pattern, str) else pattern
    if not p.parts:
        return F.lit(True)
    by_prefix = p.prefix if prefix is None else prefix
    parts = name_parts(name_path)
    length = F.size(parts) == len(p.parts) if p.absolute else F.size(parts) >= len(p.parts)
    tests = [length]
    for back, part in enumerate(reversed(p.parts), start=1):
        found = F.try_element_at(parts, F.lit(-back))
        if back == 1 and by_prefix:
            tests.append(F.startswith(F.lower(found), F.lit(part.lower())))
        else:
            tests.append(found == part)
    result = tests[0]
    for t in tests[1:]:
        result = result & t
    return F.coalesce(result, F.lit(False))


def build_name_path(parent_path: Column, name: Column) -> Column:
    return F.concat(F.coalesce(parent_path, F.lit("")), F.lit("/"), name)


def symbol_name(name_path: Column) -> Column:
    return F.coalesce(F.try_element_at(name_parts(name_path), F.lit(-1)), F.lit(""))


def parent_path(name_path: Column) -> Column:
    """Path without its last part; null for a top-level name."""
    parts = name_parts(name_path)
    return F.when(
        F.size(parts) > 1,
        F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")),
    )


def name_depth(name_path: Column) -> Column:
    return F.greatest(F.lit(0), F.size(name_parts(name_path)) - 1)


def display_name_path(name_path: Column) -> Column:
    return F.regexp_replace(name_path, "^/", "")
