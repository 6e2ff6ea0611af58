"""Groups of near duplicates among vectors: bands of random hyperplanes, cosines within their keys, joins for classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.vectors import matrix_of
from passagemill.session import Scratch, stage

#: Chance that a pair at the very threshold shares no band.
MISS = 1e-6
#: Members of a band's key that meet in one cell; a larger key's are dealt into blocks of so many, every two of which meet in a cell.
CROWDED = 1024
FEWEST_PLANES, MOST_PLANES = 6, 60
#: Planes are added only while no more bands are needed, so a node is sent to at most so many keys.
MOST_BANDS = 128
#: Pairs of one cell that are looked at together, and how far from the threshold a product of matrices is not relied on.
_PAIRS, _CLOSE = 1 << 16, 1e-9
_SALTS = 8


def bands_needed(threshold: float, planes: int, miss: float = MISS) -> int:
    """Bands of ``planes`` planes of which a pair of that cosine shares one, but for a chance of ``miss``."""
    same = (1 - math.acos(threshold) / math.pi) ** planes
    return 1 if same >= 1 else math.ceil(math.log(miss) / math.log1p(-same))


def most_planes(threshold: float, miss: float = MISS) -> int:
    """Up to ``MOST_PLANES``, as many as ``MOST_BANDS`` bands allow."""
    return max((k for k in range(1, MOST_PLANES + 1) if bands_needed(threshold, k, miss) <= MOST_BANDS), default=1)


def _dealt(nodes: DataFrame, planes: int, bands: int, seed: int) -> DataFrame:
    """node, copies, v and ``keys``: for each band which side of its planes a node is on."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sides = (1 << np.arange(planes)).astype(np.int64), None
        for frame in frames:
            for at in range(0, frame.num_rows, 1024):
                part = frame.slice(at, 1024)
                x = matrix_of(part.column(2))
                if sides is None:
                    sides = np.random.default_rng([seed, planes]).standard_normal((bands * planes, x.shape[1]))
                keys = (x @ sides.T > 0).reshape(len(x), bands, planes) @ weights
                cuts = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(cuts, pa.array(keys.ravel()))], names=["node", "copies", "v", "keys"])

    made = nodes.select("node", "copies", "v")
    return made.mapInArrow(run, f"node long, copies long, v {made.schema['v'].dataType.simpleString()}, keys array<long>")


_CELL = ["band", "key", "low", "high"]


def _cells(own: Scratch, nodes: DataFrame, threshold: float, crowded: int, miss: float, seed: int) -> DataFrame:
    """Nodes (node, copies, v) beside those that they share a band's key with, cell after cell: the cell, the node's block in it, node, copies, keys, v.

    A key of up to ``crowded`` nodes is one cell; of a larger one each two blocks are, so no cell holds more than two blocks.
    """
    n = max(2, nodes.count())
    planes = min(most_planes(threshold, miss), max(FEWEST_PLANES, math.ceil(2 * math.log2(n)) - 6))
    dealt = own.stage(_dealt(nodes, planes, bands_needed(threshold, planes, miss), seed), "bands")
    met = dealt.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = met.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key", F.ceil(F.col("n") / crowded).cast("int").alias("blocks"))
    fit = met.join(sizes, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = fit.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = other.select("band", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node")
    return placed.join(dealt, "node").select(*_CELL, "block", "node", "copies", "keys", "v").repartition(*_CELL).sortWithinPartitions(*_CELL)


def _runs(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each cell of two nodes or more: its band, whether it is of two blocks, and its rows' blocks, nodes, copies, keys and vectors."""
    parts: list[list[np.ndarray]] = []
    last: tuple = ()

    def whole() -> tuple:
        return last[0], last[2] != last[3], *(np.concatenate(c) for c in zip(*parts))

    for frame in frames:
        for at in range(0, frame.num_rows, 4096):
            part = frame.slice(at, 4096)
            cell = np.stack([part.column(i).to_numpy().astype(np.int64) for i in range(len(_CELL))], axis=1)
            keys = part.column(7).flatten().to_numpy().reshape(len(cell), -1)
            rows = [*(part.column(i).to_numpy() for i in (4, 5, 6)), keys, matrix_of(part.column(8))]
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)])).tolist()
            for start, end in zip(starts, [*starts[1:], len(cell)]):
                here = tuple(cell[start].tolist())
                if here != last:
                    if sum(len(p[0]) for p in parts) > 1:
                        yield whole()
                    parts, last = [], here
                parts.append([c[start:end] for c in rows])
    if sum(len(p[0]) for p in parts) > 1:
        yield whole()


def _linked(split: bool, block: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the pairs of a cell whose cosine reaches the threshold; of two blocks only pairs across."""
    norms = np.sqrt((x * x).sum(axis=1))
    cosines = x @ x.T
    cosines /= norms[:, None]
    cosines /= norms
    near = np.triu(cosines >= threshold - _CLOSE, 1)
    if split:
        near &= block[:, None] != block
    a, b = np.nonzero(near)
    close = np.flatnonzero(cosines[a, b] < threshold + _CLOSE)
    reached = np.ones(len(a), bool)
    for at in range(0, len(close), _PAIRS):
        some = close[at : at + _PAIRS]
        p, q = a[some], b[some]
        reached[some] = (x[p] * x[q]).sum(axis=1) / (norms[p] * norms[q]) >= threshold
    return a[reached], b[reached]


def _first_met(band: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs share no earlier band, so that this one counts them."""
    if not band:
        return np.ones(len(a), bool)
    return np.concatenate([np.empty(0, bool), *(~(keys[a[at : at + _PAIRS], :band] == keys[b[at : at + _PAIRS], :band]).any(axis=1) for at in range(0, len(a), _PAIRS))])


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n rows the first one that each reaches by the pairs."""
    labels = np.arange(n)
    while True:
        lower = labels.copy()
        np.minimum.at(lower, a, labels[b])
        np.minimum.at(lower, b, labels[a])
        lower = lower[lower]
        if (lower == labels).all():
            return labels
        labels = lower


def near_pairs(own: Scratch, nodes: DataFrame, threshold: float, crowded: int = CROWDED, miss: float = MISS, seed: int = 7) -> DataFrame:
    """a, b (a < b): the pairs of ``nodes`` (node long, v array) whose cosine reaches the threshold, each once."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, split, block, node, _, keys, x in _runs(frames):
            a, b = _linked(split, block, x, threshold)
            first = _first_met(band, keys, a, b)
            p, q = node[a[first]], node[b[first]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    return _cells(own, nodes.withColumn("copies", F.lit(1).cast("long")), threshold, crowded, miss, seed).mapInArrow(run, "a long, b long")


def near_sums(own: Scratch, nodes: DataFrame, threshold: float, crowded: int = CROWDED, miss: float = MISS, seed: int = 7) -> DataFrame:
    """a, b, met: what the pairs of ``near_pairs`` come to, without a row for each of them.

    A cell gives one row for each of its nodes that has a pair in it: ``b`` is the first node of the cell that ``a``
    reaches by pairs of the cell (maybe itself), ``met`` the copies of the nodes that ``a`` meets there and in no earlier band.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("met", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def settle() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(held, axis=1)], schema=schema)

        for band, split, block, node, copies, keys, x in _runs(frames):
            a, b = _linked(split, block, x, threshold)
            if not len(a):
                continue
            first = _first_met(band, keys, a, b)
            met = np.zeros(len(node), np.int64)
            np.add.at(met, a[first], copies[b[first]])
            np.add.at(met, b[first], copies[a[first]])
            some = np.union1d(a, b)
            held.append(np.stack([node[some], node[_lowest(len(node), a, b)[some]], met[some]]))
            size += len(some)
            if size >= _PAIRS:
                yield settle()
                held, size = [], 0
        if held:
            yield settle()

    return _cells(own, nodes, threshold, crowded, miss, seed).mapInArrow(run, "a long, b long, met long")


def connected(own: Scratch, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root: the smallest node that each node of an edge (a, b) reaches.

    Every round a node takes the smallest label around it, then its label's label, so the rounds grow with the
    logarithm of the longest path. More than ``rounds`` of them are an error.
    """
    both = own.stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = own.stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), "labels")
    for _ in range(rounds):
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        taken = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        now = own.stage(taken.join(up, "root").select("node", "was", F.least("root", "above").alias("root")), "labels")
        labels = now.select("node", "root")
        if now.where("root <> was").isEmpty():
            return labels
    raise RuntimeError(f"classes did not settle in {rounds} rounds")


def near_duplicate_groups(rows: DataFrame, key: str, vector: str, threshold: float = 0.95, crowded: int = CROWDED, miss: float = MISS) -> DataFrame:
    """``key``, class_id (the smallest key of the class), links long: one row per row.

    Rows whose vectors have a cosine of ``threshold`` or more are linked, and links join rows into classes;
    ``links`` counts the other rows that a row is linked to. Equal vectors are one node with a number of copies
    and are never compared. Keys are whole numbers and unique; rows without a key, without a vector or with one
    of length zero are alone: class_id is their key, links 0. Vectors of several widths, or holding a null, NaN
    or infinity, are an error. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = rows.sparkSession
    with Scratch(spark) as own:
        v = F.col(vector).cast("array<float>")
        sound = F.when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.raise_error(F.lit("a vector holds a null, NaN or infinity")).cast("array<float>")).otherwise(v)
        every = rows.select(F.col(key).cast("long").alias("key"), sound.alias("v"))
        useful = F.col("key").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
        told = every.withColumns({"h": F.when(useful, F.xxhash64("v")), "i": F.when(useful, F.xxhash64(F.lit(1), "v"))})
        marked = own.stage(told, "marked")
        copies = marked.where("h IS NOT NULL").groupBy("h", "i").agg(F.min("key").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
        nodes = own.stage(copies, "nodes")
        sums = own.stage(near_sums(own, nodes.select("node", "copies", "v"), threshold, crowded, miss), "links")
        roots = connected(own, sums.where("a <> b").select("a", "b").distinct())
        met = sums.groupBy(F.col("a").alias("node")).agg(F.sum("met").alias("met"))
        classes = nodes.join(roots, "node", "left").join(met, "node", "left").select(
            "h", "i", F.coalesce("root", "node").alias("class_id"), (F.coalesce("met", F.lit(0)) + F.col("copies") - 1).alias("links")
        )
        # A vector may belong to a third of all rows: its class is copied, its rows are dealt out.
        salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        slim = marked.select("key", "h", "i", F.pmod(F.xxhash64("key"), F.lit(_SALTS)).cast("int").alias("salt"))
        out = slim.join(salted, ["h", "i", "salt"], "left")
        return stage(out.select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "groups")
