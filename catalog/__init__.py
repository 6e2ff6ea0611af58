"""The registered queries by topic, each module with its Spark form and its SQL form side by side."""

from __future__ import annotations

from importlib import import_module

TOPICS = ["chunks", "search", "index", "usage", "clusters", "symbols", "edits", "streams", "runs"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for topic in TOPICS:
        for name, value in getattr(import_module(f"catalog.{topic}"), attribute).items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = value
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
