"""Compare a registered query with its SQL on DuckDB: schema, row count, sorted values."""

from __future__ import annotations

import importlib
import math
import sys
import time
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return {"int": "int", "float": "float", "str": "str", "NoneType": "null"}.get(type(value).__name__, type(value).__name__)


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = sorted([tuple(_cell(r[i]) for i in order) for r in rows])
    kinds = [sorted({_kind(r[i]) for r in rows} - {"null"}) for i in order]
    return [columns[i] for i in order], kinds, table


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(list(rel.columns), rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[2]) != len(want[2]):
        return f"rows {len(got[2])} != {len(want[2])}"
    if got[1] != want[1]:
        return f"types {list(zip(got[0], got[1], want[1]))}"
    bad = [(g, w) for g, w in zip(got[2], want[2]) if g != w]
    if bad:
        return f"{len(bad)} of {len(got[2])} rows differ, first {str(bad[0])[:600]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    sf = sys.argv[1]
    topics = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.log.level", "OFF")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    con = duck(sf)
    import catalog

    picked: dict = {}
    checks: dict = {}
    for topic in catalog.TOPICS:
        if topics and topic not in topics and not any("=" in t for t in topics):
            continue
        module = importlib.import_module(f"catalog.{topic}")
        picked |= module.QUERIES
        checks |= module.SQL
    only = [t[1:] for t in topics if t.startswith("=")]
    for name, query in picked.items():
        if only and name not in only:
            continue
        at = time.time()
        try:
            if name in checks:
                verdict = compare(spark, con, sf, query, checks[name]) or "ok"
            else:
                verdict = f"rows only: {query(spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            verdict = "ERROR " + str(e)[:4000]
        print(f"{name:32s} {time.time() - at:6.2f}s {verdict}", flush=True)
