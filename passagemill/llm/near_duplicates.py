"""Near duplicates by the exact similarity of sets of five-word shingles.

Two texts are linked if they share 0.8 or more of the shingles that either has; links are joined into
components. Texts with equal sets are one node. Candidates come from prefixes, which lose nothing: with the
shingles of every text in one common order, two texts of that similarity share one of the first
n - ceil(0.8 n) + 1 of each, and at the first shared one their places and sizes still allow the similarity.
The order puts rare shingles first, by counts in ``CELLS`` cells (any order is right, the counts keep common
lines out of the prefixes). Prefix shingles are dealt out once, and those of one node alone end there.

What is left is bounded by sketches before any set is looked at: a node's sketch has a bit for each cell that
an odd number of its shingles fall into, and two sketches never differ in more bits than the sets differ in
shingles. Only nodes of pairs that pass have their sets worked out again, from their texts; of the pairs of
one node its own set travels once to every thousand of them.

In turns each node is compared with some of the first and last nodes of its prefix shingles, those of other, no
smaller components that it meets most often; each turn takes other ones and tries more. That joins a large
group of near copies by some times as many pairs as it has members. Members with many changes are near few others of
their group, those that were changed in the same places; so each is compared with the hub of the component it meets
most, as the component's members are, and then with the members that lack the same shingles of the hub and differ
least from it. Then only pairs of different components are left, and they are all compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from passagemill.llm.common import Scratch, doc_texts, free_names, mapped, quoted, settings, stage
from passagemill.llm.components import components
from passagemill.llm.simhash import SEED

SHINGLE = 5
#: Similarity as a fraction.
PART, WHOLE = 4, 5
#: Shingles are counted by their top bits; tasks send the counts in slices.
CELL_BITS, SLICES = 18, 64
#: Bits of a sketch, as powers of two.
LEAST_SKETCH, MOST_SKETCH = 11, 16
#: Turns in which nodes are tried with a few others each, from turn to turn so many times as many.
HUBS, TURNS = 4, 3
#: Turns in which nodes are tried with those that lack the same shingles of a hub, of components with so many members:
#: a smaller one adds no more pairs of a node than the last of the other turns.
GAP_TURNS, MANY = 2, HUBS**TURNS
#: Pairs of one node that one copy of its set serves.
PAIRS_PER_SET = 1024
#: Texts and sets pass between Spark and Python by so many bytes at a time; each task holds some times as much on both sides.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _finished(values: np.ndarray) -> np.ndarray:
    values = values ^ values >> np.uint64(32)
    values = values * np.uint64(0xE7037ED1A0B428DB)
    return values ^ values >> np.uint64(29)


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """The distinct shingles of a text in order; fewer words than a shingle: one of the whole sequence; none: nothing.

    A shingle is a 64-bit mix of the hashes of its words, A to Z in lower case, white space dropped.
    """
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()  # on bytes, both touch ASCII only
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, [SEED] * len(words)), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    if n < 1:
        return _finished((hashes * _MIX[: len(words)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(words))) if len(words) else hashes
    mixed = hashes[:n] * _MIX[0]
    for k in range(1, SHINGLE):
        mixed += hashes[k : k + n] * _MIX[k]
    return np.unique(_finished(mixed))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def similar(common, a, b):
    """Whether sets of sizes ``a`` and ``b`` with ``common`` shingles in both are similar enough; of numbers or columns."""
    return common * (PART + WHOLE) >= PART * (a + b)


def sketch(shingles: np.ndarray) -> bytes:
    """Of each of 2^k cells of the shingles' low bits whether it holds an odd number of them; k grows with the set."""
    bits = min(max(LEAST_SKETCH, int(len(shingles)).bit_length()), MOST_SKETCH)
    odd = np.bincount((shingles & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of sketches (one a row) how many bits differ, the larger ones folded to the size of the smaller ones."""
    while x.shape[1] != y.shape[1]:
        x, y = (x, y) if x.shape[1] > y.shape[1] else (y, x)
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _texts(frame: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    for text in frame.column(frame.schema.get_field_index(name)).cast(pa.binary()):
        yield text.as_py()


def _counts(docs: DataFrame) -> np.ndarray:
    """How many shingles fall into each cell; a task sends ``SLICES`` rows."""
    cells = 1 << CELL_BITS
    width = cells // SLICES

    def slices(total: np.ndarray) -> pa.RecordBatch:
        used = [i for i in range(SLICES) if total[i * width : (i + 1) * width].any()]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[i * width : (i + 1) * width].tobytes() for i in used], pa.binary())], names=["slice", "counts"])

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        held, size = [], 0
        for frame in frames:
            for text in _texts(frame, "text"):
                held.append(shingle_set(text) >> np.uint64(64 - CELL_BITS))
                size += len(held[-1])
                if size >= cells:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=cells)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=cells)
        yield slices(total)

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for frame in frames:
            for i, counts in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                total[i * width : (i + 1) * width] += np.frombuffer(counts, np.int64)
        yield slices(total)

    schema = "slice int, counts binary"
    summed = doc_texts(docs).select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema)
    out = np.zeros(cells, np.int64)
    for r in summed.collect():  # ``SLICES`` rows
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return out


class _Names:
    """Helper columns beside those of the documents, whatever these are called."""

    def __init__(self, docs: DataFrame):
        self.node, self.row, self.n, self.keys, self.sketch = free_names(docs, "node", "row", "n", "keys", "sketch")


def _marked(docs: DataFrame, names: _Names) -> DataFrame:
    """``docs`` with the node and a number of each row, and for the first row of a node in a task its size, prefix and sketch."""
    counts = docs.sparkSession.sparkContext.broadcast(_counts(docs))  # 2^CELL_BITS numbers
    top = np.uint64(64 - CELL_BITS)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for frame in frames:
            nodes, sizes, prefixes, sketches = [], [], [], []
            for text in _texts(frame, "text"):
                own = shingle_set(text)
                n, node = len(own), node_of(own)
                nodes.append(node)
                new = node not in seen
                seen.add(node)
                sizes.append(n if new else None)
                sketches.append(sketch(own) if new else None)
                rare_first = np.lexsort((own, counts.value[(own >> top).astype(np.int64)]))[: n + PART * -n // WHOLE + 1] if new else None
                prefixes.append(own[rare_first].view(np.int64) if new else None)
            for made in (pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())):
                frame = frame.append_column(f"made{frame.num_columns}", made)
            yield frame

    added = [StructField(names.node, LongType()), StructField(names.n, LongType()), StructField(names.keys, ArrayType(LongType())), StructField(names.sketch, BinaryType())]
    return mapped(docs, run, added).withColumn(names.row, F.monotonically_increasing_id())


def _shared(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node those of keys that at least two nodes have, each node once; rows stream."""
    held: pa.RecordBatch | None = None  # the last row that came, not yet given out
    opened = False  # whether the row before it has its key
    for frame in frames:
        if not frame.num_rows:
            continue
        rows = frame if held is None else pa.concat_batches([held, frame])
        key, node = (rows.column(i).to_numpy() for i in (0, 1))
        same_key = key[1:] == key[:-1]
        first = np.concatenate([[True], ~(same_key & (node[1:] == node[:-1]))])
        rows = rows.filter(pa.array(first))
        key = key[first]
        same_key = np.concatenate([[opened], key[1:] == key[:-1], [False]])
        keep = same_key[:-1] | same_key[1:]
        held, opened = rows.slice(rows.num_rows - 1), bool(same_key[-2])
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
    if held is not None and opened:
        yield held


def _possible(n: Column, pos: Column, n2: Column, pos2: Column) -> Column:
    """Whether sizes and places allow the similarity of two nodes, this key being their first shared one."""
    return similar(F.least(n - pos, n2 - pos2), n, n2)


def _stars(rooted: DataFrame, turn: int) -> DataFrame:
    """a, b: for each node some nodes of other, no smaller components that it meets under most keys, of each key's first and last one.

    First all keys have one order of the nodes, then each its own, and each turn has ``HUBS`` times as many pairs of a node.
    """
    member = F.struct(F.xxhash64(F.lit(turn), "node", *["key"] * bool(turn)).alias("place"), "node", "n", "pos", "root", "members")
    early = rooted.where(similar(F.col("n") - F.col("pos"), F.col("n"), F.col("n")))  # later places are for smaller partners only
    ends = early.groupBy("key").agg(F.min(member).alias("low"), F.max(member).alias("high"))
    met = rooted.join(ends, "key").select("node", "n", "pos", "root", "members", F.explode(F.array("low", "high")).alias("o"))
    near = met.where((F.col("root") != F.col("o.root")) & (F.col("members") <= F.col("o.members")) & _possible(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos")))
    often = near.groupBy("node", F.col("o.node").alias("hub")).agg(F.count("*").alias("keys"))
    most = F.slice(F.sort_array(F.collect_list(F.struct("keys", "hub")), asc=False), 1, HUBS ** (turn + 1))  # of the keys of one text
    chosen = often.groupBy("node").agg(most.alias("hubs")).select("node", F.explode("hubs.hub").alias("hub"))
    return chosen.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _rooted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The prefixes with their nodes' components, of keys that nodes of several components have."""
    sized = roots.join(roots.groupBy("root").agg(F.count("*").alias("members")), "root")
    rooted = shared.join(sized, "node", "left").select("key", "node", "n", "pos", F.coalesce("root", "node").alias("root"), F.coalesce("members", F.lit(1)).alias("members"))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rooted.join(several, "key", "left_semi")


def _across(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and n the possible pairs of members of different components."""
    out: list[np.ndarray] = []
    size = 0

    def pairs() -> pa.RecordBatch:
        a, b = np.concatenate(out, axis=1)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p)) for p in both], names=["a", "b"])

    for node, n, pos, root in _keys(frames):
        upto = np.searchsorted(n, n * WHOLE // PART, "right")  # larger ones are not similar
        for i in np.flatnonzero(upto > np.arange(len(n)) + 1).tolist():
            rest = slice(i + 1, int(upto[i]))
            near = np.flatnonzero(similar(np.minimum(n[i] - pos[i], n[rest] - pos[rest]), n[i], n[rest]) & (root[rest] != root[i])) + i + 1
            if len(near):
                out.append(np.stack([np.repeat(node[i], len(near)), node[near]]))
                size += len(near)
            if size > 1 << 18:
                yield pairs()
                out, size = [], 0
    if out:
        yield pairs()


def _keys(frames: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The other columns of each run of equal first columns."""
    parts: list[list[np.ndarray]] = []
    last = None
    for frame in frames:
        if not frame.num_rows:
            continue
        key, *rest = (c.to_numpy() for c in frame.columns)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
        for start, end in zip(starts, [*starts[1:], len(key)]):
            if parts and key[start] != last:
                yield [np.concatenate(c) for c in zip(*parts)]
                parts = []
            last = key[start]
            parts.append([c[start:end] for c in rest])
    if parts:
        yield [np.concatenate(c) for c in zip(*parts)]


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sketches do not differ in more bits than similar sets may differ in shingles."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            n, m = (frame.column(i).to_numpy() for i in (2, 3))
            x, y = (frame.column(i).to_pylist() for i in (4, 5))
            sizes = np.array([len(v) << 32 | len(w) for v, w in zip(x, y)], np.int64)
            apart = np.zeros(len(x), np.int64)
            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                left, right = (np.frombuffer(b"".join(v[i] for i in some), np.uint8).reshape(len(some), -1) for v in (x, y))
                apart[some] = differing(left, right)
            # sets that differ in d shingles share (n + m - d) / 2
            yield frame.select([0, 1]).filter(pa.array(similar(n + m - apart, 2 * n, 2 * m)))

    of = lambda side, n, own: nodes.select(F.col("node").alias(side), F.col("n").alias(n), F.col("sketch").alias(own))
    both = pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def _beside(own: Scratch, pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, part, b, shingles: of each ``a`` its own set (b null), then those of the nodes it has a pair with, in parts of some pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = nodes.join(wanted, "node", "left_semi").select("row")

    def work_out(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array([shingle_set(t).tobytes() for t in _texts(frame, "text")], pa.binary())], names=["node", "shingles"])

    sets = own.stage(texts.join(rows, "row", "left_semi").select("node", "text").mapInArrow(work_out, "node long, shingles binary"), "sets")
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_SET).cast("int").alias("parts"))
    salted = pairs.join(fans, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    theirs = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "shingles")
    owners = sets.withColumnRenamed("node", "a").join(fans, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return owners.select("a", "part", F.lit(None).cast("long").alias("b"), "shingles").unionByName(theirs).repartition("a", "part").sortWithinPartitions("a", "part", "b")


def _verified(own: Scratch, pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for frame in frames:  # an owner's set comes before those it is compared with
            found = []
            for a, b, shingles in zip(frame.column(0).to_pylist(), frame.column(2).to_pylist(), frame.column(3)):
                other = np.frombuffer(shingles.as_buffer(), np.uint64)
                if b is None:
                    mine = other.copy()
                elif similar(len(np.intersect1d(mine, other, assume_unique=True)), len(mine), len(other)):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    with Scratch(own.spark) as step:  # its sets go as soon as they are compared
        possible = step.stage(_bounded(pairs, nodes), "possible")
        return own.stage(_beside(step, possible, nodes, texts).mapInArrow(compare, "a long, b long"), "verified")


def _gaps(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of ``_beside`` in how many shingles ``b`` differs from ``a``, and those of ``a`` that it lacks; no row if it lacks over a quarter."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int64()), ("gaps", pa.list_(pa.int64()))])
    mine = np.empty(0, np.uint64)
    for frame in frames:
        found = []
        for a, b, shingles in zip(frame.column(0).to_pylist(), frame.column(2).to_pylist(), frame.column(3)):
            other = np.frombuffer(shingles.as_buffer(), np.uint64)
            if b is None:
                mine = other.copy()
                continue
            lacks = np.setdiff1d(mine, other, assume_unique=True)
            if 4 * len(lacks) <= len(mine):
                found.append((a, b, len(other) - len(mine) + 2 * len(lacks), lacks.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)


def _by_gaps(own: Scratch, found: DataFrame, roots: DataFrame, rooted: DataFrame, nodes: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """a, b: for each node some of the members of the components it meets most that lack the same shingles of the component's hub.

    A hub is the member with most links. Of those that lack a shingle, the few that differ least from the hub stand for all.
    Components of under ``MANY`` members are left to the last comparison.
    """
    degrees = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    hubs = roots.join(degrees, "node").groupBy("root").agg(F.max(F.struct("links", "node")).alias("h")).select("root", F.col("h.node").alias("hub"))
    largest = rooted.groupBy("key").agg(F.max(F.struct("members", "root")).alias("o"))
    met = rooted.join(largest, "key").where((F.col("o.members") >= MANY) & (F.col("root") != F.col("o.root")))
    often = met.groupBy("node", F.col("o.root").alias("root")).agg(F.count("*").alias("keys"))
    most = F.slice(F.sort_array(F.collect_list(F.struct("keys", "root")), asc=False), 1, HUBS)  # of the keys of one text
    outer = own.stage(often.groupBy("node").agg(most.alias("most")).select("node", F.explode("most.root").alias("root"), F.lit(False).alias("inner")), "outer")
    inner = roots.join(outer.select("root").distinct(), "root", "left_semi").select("node", "root", F.lit(True).alias("inner"))
    asked = own.stage(outer.unionByName(inner).join(hubs, "root").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "root", "inner"), "asked")
    with Scratch(own.spark) as step:
        told = own.stage(_beside(step, asked.select("a", "b"), nodes, texts).mapInArrow(_gaps, "a long, b long, apart long, gaps array<long>"), "gaps")
    each = told.join(asked, ["a", "b"]).select("root", "inner", F.col("b").alias("node"), "apart", F.explode("gaps").alias("gap"))
    place = F.row_number().over(Window.partitionBy("root", "gap").orderBy("apart", "node"))
    least = each.where("inner").withColumn("place", place).where(F.col("place") <= HUBS ** (turn + 1)).select("root", "gap", F.col("node").alias("hub"), "apart")
    both = each.where("NOT inner").select("root", "gap", "node").join(least, ["root", "gap"])
    near = both.groupBy("node", "hub").agg((2 * F.count("*") - F.first("apart")).alias("near"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("near", "hub")), asc=False), 1, HUBS ** (turn + 2))  # of the gaps of one text
    chosen = near.groupBy("node").agg(best.alias("hubs")).select("node", F.explode("hubs.hub").alias("hub"))
    return chosen.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def links(own: Scratch, marked: DataFrame, names: _Names) -> DataFrame:
    """a, b: similar nodes, enough of them to connect all that are similar directly or by steps."""
    firsts = marked.where(F.col(names.n).isNotNull())
    slim = firsts.select(F.col(names.node).alias("node"), F.struct(F.col(names.row).alias("row"), F.col(names.n).alias("n"), F.col(names.sketch).alias("sketch")).alias("f"))
    nodes = own.stage(slim.groupBy("node").agg(F.min("f").alias("f")).select("node", "f.*"), "nodes")
    texts = firsts.select(F.col(names.row).alias("row"), F.col(names.node).alias("node"), "text")
    prefix = firsts.select(F.col(names.node).alias("node"), F.col(names.n).alias("n"), F.posexplode(names.keys).alias("pos", "key"))
    sized = F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("sized")
    dealt = prefix.select("key", "node", sized).repartition("key").sortWithinPartitions("key", "node")
    shared = own.stage(dealt.mapInArrow(_shared, "key long, node long, sized long"), "prefixes")
    shared = shared.select("key", "node", F.shiftright("sized", 32).alias("n"), F.col("sized").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))
    rooted = shared.withColumns({"root": F.col("node"), "members": F.lit(1).cast("long")})
    found, tried, roots = None, None, None
    with Scratch(own.spark) as last:  # holds the components and prefixes of one turn at a time
        for turn in range(TURNS + GAP_TURNS):
            with Scratch(own.spark) as step:
                fresh = _stars(rooted, turn) if turn < TURNS else _by_gaps(step, found, roots, rooted, nodes, texts, turn - TURNS)
                fresh = own.stage(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"), "stars")
            linked = _verified(own, fresh, nodes, texts)
            tried = fresh if tried is None else tried.unionByName(fresh)
            found = linked if found is None else found.unionByName(linked)
            if turn and linked.isEmpty():
                if turn >= TURNS or found.isEmpty():
                    break
                continue
            last.clear()
            with Scratch(own.spark) as step:
                roots = last.stage(components(found, "a", "b", write=step.stage), "roots")
            rooted = last.stage(_rooted(shared, roots), "rooted")
        split = rooted.drop("members").repartition("key").sortWithinPartitions("key", "n")
        rest = split.mapInArrow(_across, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        across = own.stage(rest, "across")
    return found.unionByName(_verified(own, across, nodes, texts))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, all columns: that of the smallest doc_id, of equal ids the least text.

    A row belongs to the group of its own text, so rows that share an id and not a text are told apart, and of
    repeated rows one stays. Rows without an id stay only where no row of the group has one. Null and empty texts
    and texts without words are copies of each other. An empty table gives no rows; columns may have any names.
    """
    names = _Names(docs)
    with settings(docs.sparkSession, BATCH), Scratch(docs.sparkSession) as own:
        marked = stage(_marked(docs, names), "marked")
        slim = marked.select(F.col(names.row).alias("row"), F.col(names.node).alias("node"), F.col("doc_id").cast("long").alias("id"))
        roots = own.stage(components(links(own, marked, names), "a", "b", write=own.stage), "roots")
        nodes = slim.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        grouped = own.stage(nodes.join(roots, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root")), "groups")
        best = grouped.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("n")).where("n > 1").drop("n")
        several = slim.join(grouped.join(best, "root").select("node", "root", "best"), "node")
        members = own.stage(several.select("row", "root", F.col("id").eqNullSafe(F.col("best")).alias("may_stay")), "members")
        twice = members.where("may_stay").groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
        tied = members.where("may_stay").join(twice.select("root"), "root", "left_semi").select("row", "root")
        going = members.where("NOT may_stay").select("row")
        if not twice.isEmpty():  # rows of one id, or without one, in one group
            texts = marked.select(F.col(names.row).alias("row"), "text").join(tied, "row")
            first = texts.groupBy("root").agg(F.min(F.struct("text", "row")).alias("first")).select("first.row")  # nulls are least
            going = going.unionByName(tied.select("row").join(first, "row", "left_anti"))
        gone = stage(going.withColumnRenamed("row", names.row), "going")
    return marked.join(gone, names.row, "left_anti").select(*quoted(docs.columns))
