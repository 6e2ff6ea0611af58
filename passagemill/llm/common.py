"""What the operators of this subpackage share: typed input columns, tables, staged frames, sorted streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from passagemill.session import Scratch, settings, spread, stage

__all__ = ["Scratch", "doc_texts", "free_names", "grow", "groups_of", "mapped", "quoted", "rows_of", "settings", "shuffle_width", "spread", "stage", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame, *others: str) -> DataFrame:
    """Only the id, the text (null: empty) and the named columns; whatever else the table has stays behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *others)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"{'_' * k}{name}" for k in range(1, len(taken) + 2)) if n not in taken) for name in names]


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: Sequence[StructField] = ()) -> DataFrame:
    """``df`` with all its columns, whatever they are called, through ``run``, which may append ``added`` ones."""
    names = df.columns
    usual = [n if n.replace("_", "a").isalnum() else free for n, free in zip(names, free_names(df, *[f"column{i}" for i in range(len(names))]))]
    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(usual, df.schema.fields)] + list(added))
    return df.toDF(*usual).mapInArrow(run, schema).toDF(*names, *[f.name for f in added])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a task's batches, one tuple at a time; a batch is turned into Python objects in slices."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, 256).columns))


def groups_of(rows: Iterator[tuple], width: int = 1) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that agree in their first ``width`` values, as lazy iterators; nothing is gathered."""
    held = next(rows, None)
    while held is not None:
        key = held[:width]

        def run(key=key):
            nonlocal held
            while held is not None and held[:width] == key:
                yield held
                held = next(rows, None)

        members = run()
        yield key, members
        for _ in members:  # what the caller left
            pass


def grow(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows back into Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield grow(list(zip(*held)), schema)
            held = []
    if held:
        yield grow(list(zip(*held)), schema)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)
