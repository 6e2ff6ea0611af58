"""Issue lists: views, facet filters, order, pages. Issues: id, title, description, status, priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Page length, and the rank of an issue without priority.
PAGE_SIZE = 10
NO_PRIORITY = 999


def issue_view(issues: DataFrame, view: str = "ready") -> DataFrame:
    """all, open (not closed) or ready (open and not blocked)."""
    if view == "all":
        return issues
    is_open = F.col("status") != "closed"
    if view == "open":
        return issues.filter(is_open)
    if view == "ready":
        return issues.filter(is_open & (F.col("status") != "blocked"))
    raise ValueError("view is ready, open or all")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(
        F.count_if((F.col("status") != "closed") & (F.col("status") != "blocked")).alias("ready"),
        F.count_if(F.col("status") != "closed").alias("open"),
        F.count(F.lit(1)).alias("total"),
    )


def facet_filter(issues: DataFrame, text: str | None = None, priority: int | str | None = None) -> DataFrame:
    """Text in title, description or id, ignoring case; priority equal, or ``none`` for unset or 0."""
    kept = issues
    needle = (text or "").lower().strip()
    if needle:
        hit = F.lit(False)
        for c in ("title", "description", "id"):
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
        kept = kept.filter(hit)
    if priority == "none":
        kept = kept.filter(F.coalesce("priority", F.lit(0)) == 0)
    elif priority is not None:
        kept = kept.filter(F.col("priority") == int(priority))
    return kept


def order_issues(issues: DataFrame, by: str = "priority-desc") -> DataFrame:
    """Most urgent (lowest number) first, or the reverse; or by title."""
    rank = F.when(F.coalesce("priority", F.lit(0)) == 0, F.lit(NO_PRIORITY)).otherwise(F.col("priority"))
    title = F.coalesce("title", F.lit(""))
    keys = {
        "priority-desc": rank.asc(),
        "priority-asc": rank.desc(),
        "alpha-asc": title.asc(),
        "alpha-desc": title.desc(),
    }
    return issues.orderBy(keys[by], "id")


def page(ordered: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) of an ordered frame."""
    return ordered.offset(size * (number - 1)).limit(size)
