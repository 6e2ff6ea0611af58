"""Reading effort saved per usage event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size estimates, event types, and the least number of files read without the tool.
CHARS_PER_TOKEN = 4
CHARS_PER_LINE = 60
LINES_PER_FILE = 100
KEPT_EVENTS = 1000
EVENT_TYPES = [
    "search_code",
    "search_similar",
    "get_symbols_overview",
    "find_symbol",
    "summarize_codebase",
    "list_concepts",
    "search_by_concept",
]
LEAST_FILES = {
    "search_code": 5,
    "search_similar": 8,
    "find_symbol": 4,
    "summarize_codebase": 15,
    "list_concepts": 12,
    "search_by_concept": 6,
}


def files_explored(event_type: Column, count: Column) -> Column:
    """Files somebody would have opened; ``count`` is the event's matches, files or clusters."""
    estimate = {
        "search_code": count + 2,
        "search_similar": count + 3,
        "find_symbol": F.least(count, F.lit(8)),
        "summarize_codebase": F.least(count, F.lit(25)),
        "list_concepts": count * 2,
        "search_by_concept": count,
    }
    out = F.when(F.lit(False), F.lit(0))
    for name, value in estimate.items():
        out = out.when(event_type == name, F.greatest(F.lit(LEAST_FILES[name]), value))
    return out


def files_avoided(event_type: Column, count: Column, explored: Column) -> Column:
    used = (
        F.when(event_type.isin("search_code", "search_similar"), count)
        .when(event_type == "find_symbol", F.lit(1))
        .when(event_type == "search_by_concept", F.ceil(count / F.lit(2)))
        .otherwise(F.lit(0))
    )
    return F.when(event_type == "get_symbols_overview", F.lit(0)).otherwise(F.greatest(F.lit(0), explored - used))


def chars_avoided(event_type: Column, count: Column, explored: Column, returned: Column) -> Column:
    """For an overview ``count`` is the number of lines of the file."""
    would_read = F.when(event_type == "get_symbols_overview", count * CHARS_PER_LINE).otherwise(
        explored * LINES_PER_FILE * CHARS_PER_LINE
    )
    return F.greatest(F.lit(0), would_read - returned)


def tokens(chars: Column) -> Column:
    return F.floor(chars / F.lit(CHARS_PER_TOKEN))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))
