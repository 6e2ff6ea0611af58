"""Connected components of a graph given by its edges, as rounds of Spark joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import stage

#: Edges that a task looks at together.
BLOCK = 1 << 18


def _flat(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes of these edges, without the smallest one each reaches over them, the nodes and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        apart = root[a] != root[b]
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: no more edges than came, that connect the same nodes; in each block of them every node has one smaller neighbour."""
    held: list[list[np.ndarray]] = []
    size = 0

    def flat() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _flat(*(np.concatenate(c) for c in zip(*held)))], names=["u", "v"])

    for frame in frames:
        for at in range(0, frame.num_rows, BLOCK):
            held.append([c.to_numpy() for c in frame.slice(at, BLOCK).columns])
            size += len(held[-1][0])
            if size >= BLOCK:
                yield flat()
                held, size = [], 0
    if held:
        yield flat()


def _hung(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by u and v the smallest neighbour of each u (``own``), on which u's other neighbours are hung, too; rows stream."""
    last: tuple[int, int, int] | None = None  # the row before: u, v, u's smallest neighbour
    for frame in frames:
        if not frame.num_rows:
            continue
        u, v = (c.to_numpy() for c in frame.columns)
        begins = np.concatenate([[last is None or u[0] != last[0]], u[1:] != u[:-1]])
        lowest = np.concatenate([[last[2] if last else 0], v[begins]])[np.cumsum(begins)]
        repeats = ~begins & (v == np.concatenate([[last[1] if last else 0], v[:-1]]))
        last = int(u[-1]), int(v[-1]), int(lowest[-1])
        made = [np.where(begins, u, v), lowest, begins]
        yield pa.RecordBatch.from_arrays([pa.array(c[~repeats]) for c in made], names=["u", "v", "own"])


def _stars(edges: DataFrame) -> DataFrame:
    """u, v, own: every node of ``edges`` (u > v) and its neighbours on the smallest one it has."""
    few = edges.select("u", "v").mapInArrow(_contracted, "u long, v long")
    return few.repartition("u").sortWithinPartitions("u", "v").mapInArrow(_hung, "u long, v long, own boolean")


def components(edges: DataFrame, a: str, b: str, rounds: int = 200, write: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """node, root: for every node that has an edge the smallest node it reaches.

    Large stars and small stars by turns: every node hangs its larger, then its smaller neighbours on the
    smallest one it knows, until nothing moves; the rounds grow with the logarithm of the longest path. Before
    edges are dealt out, each task connects those of a block by fewer, as stars. Each round is one join and is
    written to the shared folder, so lineage stays short and no round is computed twice. Self edges
    and repeated edges are allowed; an empty table gives no rows. More than ``rounds`` rounds are an error.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = write(_stars(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))), "edges")
    mark = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v", "own").cast("decimal(38,0)")).alias("sum"))
    before = now.agg(*mark).first()
    for _ in range(rounds):
        lowest = now.where("own").select(F.col("u").alias("v"), F.col("v").alias("lowest"))  # one row a node
        now = write(_stars(now.join(lowest, "v", "left").select("u", F.coalesce("lowest", "v").alias("v"))), "edges")
        after = now.agg(*mark).first()
        if after == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
