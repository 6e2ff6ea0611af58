"""Near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

Two 64-bit fingerprints that differ in at most four bits agree on one of five segments, and of two stretches
of 23 bits cut from the rest one has at most two errors. A 23-bit stretch is decoded by the perfect Golay code
[23, 12, 7] to the indices of all codewords within distance four (one or six of them): any two stretches with
at most two errors between them share an index, because the word half-way lies within three of a codeword.
A key is (segment and stretch, the segment's bits, the index), about 53 keys a fingerprint; fingerprints that
meet under a key are verified, and the links are joined into components.

Equal fingerprints are one node, so copies cost nothing. The rows of a key stream through a task in order; up
to ``DENSE`` fingerprints of a key are compared with each other and give a forest of links, never all pairs.
Members of a larger key take another exact way: each lists all points within two bits, and two fingerprints
differ in at most four bits exactly if they share such a point, which costs 2,081 rows a member however large
the key is (and about as much work as ``DENSE`` / 2 comparisons).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import doc_texts, rows_of, stage
from passagemill.llm.components import components

SHINGLE, SEED, RADIUS, DENSE = 4, 42, 4, 4096
#: Exact segments (lowest bit, bits) of a fingerprint; stretches of the other bits start at these places.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
STRETCHES = (0, 23)
_BLOCK = 1 << 14


def word_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; fewer words: of the whole sequence; none: nothing."""
    words = text.encode().lower().split()  # on bytes, both touch ASCII only
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; no hashes: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.ascontiguousarray(hashes[at : at + _BLOCK]).view(np.uint8)
        ones += np.unpackbits(block, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp long (the 64 bits as a signed number) of every row. Row-local."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held = [], []
        for doc_id, text in rows_of(frames):
            held_ids.append(doc_id)
            held.append(fingerprint(word_hashes(text, shingle)))
            if len(held) == 1024:
                yield _pair_batch(pa.array(held_ids, pa.int64()), np.array(held, np.uint64), ("doc_id", "fp"))
                held_ids, held = [], []
        if held:
            yield _pair_batch(pa.array(held_ids, pa.int64()), np.array(held, np.uint64), ("doc_id", "fp"))

    return doc_texts(docs).mapInArrow(run, "doc_id long, fp long")


def _pair_batch(a, b: np.ndarray, names: tuple[str, str]) -> pa.RecordBatch:
    a = a if isinstance(a, pa.Array) else pa.array(a.view(np.int64) if a.dtype == np.uint64 else a)
    return pa.RecordBatch.from_arrays([a, pa.array(b.view(np.int64))], names=list(names))


class Golay:
    """The cyclic code of the polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1; a codeword's index is its top 12 bits."""

    POLYNOMIAL = 0xC75

    def __init__(self):
        single = np.array([self._remainder(1 << i) for i in range(23)], np.int64)
        self.low = np.array([self._of_bits(v, single[:12]) for v in range(4096)], np.int64)
        self.high = np.array([self._of_bits(v, single[12:]) for v in range(2048)], np.int64)
        # For each syndrome its errors of weight four or less: one, or one of weight three and five of weight four.
        self.errors = np.full((2048, 6), -1, np.int64)
        filled = np.zeros(2048, np.int64)
        for weight in range(5):
            for bits in combinations(range(23), weight):
                s = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
                self.errors[s, filled[s]] = sum(1 << b for b in bits)
                filled[s] += 1

    @classmethod
    def _remainder(cls, value: int) -> int:
        for shift in range(11, -1, -1):
            if value >> (shift + 11) & 1:
                value ^= cls.POLYNOMIAL << shift
        return value

    @staticmethod
    def _of_bits(value: int, single: np.ndarray) -> int:
        out = 0
        for i, s in enumerate(single.tolist()):
            out ^= s * (value >> i & 1)
        return out

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For 23-bit words: the position of the word and the codeword index, for all codewords within four."""
        errors = self.errors[self.low[words & 4095] ^ self.high[words >> 12]]
        at, k = np.nonzero(errors >= 0)
        return at, (words[at] ^ errors[at, k]) >> 11


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and, beside each, the fingerprint that has it."""
    keys, owners = [], []
    for s, (low, bits) in enumerate(SEGMENTS):
        exact = ((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        rest = (fps & np.uint64((1 << low) - 1)) | ((fps >> np.uint64(low + bits - 1)) >> np.uint64(1)) << np.uint64(low)
        for j, start in enumerate(STRETCHES):
            at, index = golay().indices(((rest >> np.uint64(start)) & np.uint64((1 << 23) - 1)).astype(np.int64))
            keys.append((np.int64(s * len(STRETCHES) + j) << 25) | (exact[at] << 12) | index)
            owners.append(fps[at])
    return np.concatenate(keys), np.concatenate(owners)


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is within ``radius`` directly or by steps, fewer than there are fingerprints."""
    links, rest = [], fps
    while len(rest) > 1:
        frontier, rest = [rest[:1]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                hits, rest = rest[near], rest[~near]
                links.append((np.repeat(x, len(hits)), hits))
                frontier.extend(hits[i : i + 1] for i in range(len(hits)))
    return links


def _links(dense: int, radius: int):
    """Streams sorted (key, fp) rows; a link (a, b), or (a, a) for a member of a key with over ``dense`` members."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.empty(0, np.uint64)  # the last, perhaps unfinished group
        over = None  # a key known to be dense
        for frame in _with_end(frames):
            if frame is None:
                keys, fps = np.full(len(held), held_key if held_key is not None else 0, np.int64), held
                last = len(keys)
            else:
                keys, fps = (c.to_numpy() for c in frame.columns)
                fps = fps.view(np.uint64)
                keys, fps = np.concatenate([np.full(len(held), held_key or 0, np.int64), keys]), np.concatenate([held, fps])
                last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            out_a, out_b = [], []
            if over is not None:
                upto = int(np.searchsorted(keys, over, "right"))
                out_a.append(fps[:upto]), out_b.append(fps[:upto])
                keys, fps, last = keys[upto:], fps[upto:], max(0, last - upto)
                over = over if not len(keys) and frame is not None else None
            held_key, held = (int(keys[-1]), fps[last:]) if len(keys) else (None, np.empty(0, np.uint64))
            if len(held) > dense:
                out_a.append(held), out_b.append(held)
                over, held = held_key, np.empty(0, np.uint64)
            keys, fps = keys[:last], fps[:last]
            if len(keys):
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                sizes = np.diff(np.append(starts, len(keys)))
                two = starts[sizes == 2]
                near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
                out_a.append(fps[near]), out_b.append(fps[near + 1])
                for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                    group = fps[start : start + size]
                    if size > dense:
                        out_a.append(group), out_b.append(group)
                        continue
                    for a, b in forest(group, radius):
                        out_a.append(a), out_b.append(b)
            if sum(map(len, out_a)):
                pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
                yield _pair_batch(np.ascontiguousarray(pairs[0]), np.ascontiguousarray(pairs[1]), ("a", "b"))

    return run


def _with_end(frames):
    for frame in frames:
        if frame.num_rows:
            yield frame
    yield None


def _ball_two(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = [np.uint64(1 << i) for i in range(64)]
    masks = np.array([0, *bits, *(a | b for a, b in combinations(bits, 2))], np.uint64)
    for frame in frames:
        fps = frame.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 16):
            some = fps[at : at + 16]
            yield _pair_batch((some[:, None] ^ masks).ravel(), np.repeat(some, len(masks)), ("point", "fp"))


def _stars(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (point, fp) rows, a link from the first fingerprint of each point to each further one."""
    point, first = None, None
    for frame in frames:
        points, fps = (c.to_numpy() for c in frame.columns)
        if not len(points):
            continue
        starts = np.flatnonzero(np.concatenate([[points[0] != point], points[1:] != points[:-1]]))
        run = np.zeros(len(points), np.int64)
        run[starts] = 1
        heads = np.concatenate([[first if first is not None else 0], fps[starts]])[np.cumsum(run)]
        point, first = points[-1], heads[-1]
        other = heads != fps
        if other.any():
            pairs = np.unique(np.stack([heads[other], fps[other]]), axis=1)
            yield _pair_batch(np.ascontiguousarray(pairs[0]), np.ascontiguousarray(pairs[1]), ("a", "b"))


def links(distinct: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """a, b: links between the different fingerprints of ``distinct`` (column fp) that connect all within ``radius``.

    The keys guarantee a radius up to four. What is connected by steps is connected here; a pair within
    the radius may be linked by way of others instead of directly.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the keys guarantee a radius from 0 to {RADIUS}")

    def keyed(frames):
        for frame in frames:
            fps = frame.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 2048):
                yield _pair_batch(*keys_of(fps[at : at + 2048]), ("key", "fp"))

    dealt = distinct.select("fp").mapInArrow(keyed, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = stage(dealt.mapInArrow(_links(dense, radius), "a long, b long"), "links")
    members = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    if members.isEmpty():
        return found
    points = members.mapInArrow(_ball_two, "point long, fp long").repartition("point").sortWithinPartitions("point", "fp")
    shared = points.mapInArrow(_stars, "a long, b long")
    if radius < RADIUS:  # points within two bits link up to four
        raise ValueError("dense keys are joined for a radius of four only")
    return found.where("a <> b").unionByName(shared)


def _components(marked: DataFrame, radius: int, dense: int) -> DataFrame:
    """fp, root, component_id of the fingerprints (rows doc_id, fp) that have a link or several rows."""
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = stage(components(links(nodes, radius, dense), "a", "b"), "roots")
    linked = nodes.join(roots, F.col("fp") == F.col("node"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    copies = nodes.where("n > 1").join(roots, F.col("fp") == F.col("node"), "left_anti")
    return linked.join(smallest, "root").select("fp", "root", "component_id").unionByName(copies.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id")))


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row.

    component_id is the smallest doc_id that links reach. Null or empty texts and texts without words have
    fingerprint zero and are linked like any other; repeated rows stay; a null doc_id never becomes a
    component's id unless nothing else is in it; an empty table gives no rows.
    """
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    found = _components(marked, radius, dense).drop("root")
    # A fingerprint may belong to a third of all rows: both sides are salted.
    salts = 16
    spread_out = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return salted.join(spread_out, ["fp", "salt"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
