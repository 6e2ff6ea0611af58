"""Document fingerprints from prefix polynomial hashes.

A text of code points c0..c(n-1) has the prefix arrays H[k] = sum of (c_j + 1) * B^j over j < k, modulo the
prime 2^31 - 1, for two bases B. Two spans of any two texts are equal when their differences of prefixes,
brought to the same power, agree; the longest common extension of two positions is found by binary search.
The fingerprint is the pair of whole-text hashes with the length; likeness is the part of the longer text
that the longest common prefix and suffix cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import batches, doc_texts, groups_of, rows_of, shuffle_width

PRIME = (1 << 31) - 1
BASES = (1_136_930_381, 845_091_457)
_BLOCK = 1 << 16
_M = np.uint64(PRIME)
_SHIFT = np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _M) + (x >> _SHIFT)
    x = (x & _M) + (x >> _SHIFT)
    return np.where(x == _M, np.uint64(0), x)


def _powers(base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < _BLOCK:
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), PRIME)))])
    return out


_POWERS = [_powers(b) for b in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class PrefixHashes:
    """Prefix arrays of one text: eight bytes a code point. Whole texts, built in blocks."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.arrays = []
        for base, powers in zip(BASES, _POWERS):
            array = np.zeros(self.n + 1, np.uint32)
            total = np.uint64(0)
            for at in range(0, self.n, _BLOCK):
                block = points[at : at + _BLOCK].astype(np.uint64) + np.uint64(1)
                terms = _mod(block * powers[: len(block)])
                if at:
                    terms = _mod(terms * np.uint64(pow(base, at, PRIME)))
                sums = _mod(np.cumsum(terms) + total)
                array[at + 1 : at + 1 + len(block)] = sums
                total = sums[-1]
            self.arrays.append(array)

    @classmethod
    def of(cls, text: str) -> PrefixHashes:
        return cls(code_points(text))

    def fingerprint(self) -> str:
        return f"{self.n:08x}" + "".join(f"{int(a[-1]):08x}" for a in self.arrays)

    def same(self, i: int, other: PrefixHashes, j: int, k: int) -> bool:
        """Whether the k code points from i equal the other text's k code points from j."""
        for base, a, b in zip(BASES, self.arrays, other.arrays):
            left = (int(a[i + k]) - int(a[i])) * (pow(base, j - i, PRIME) if j > i else 1)
            right = (int(b[j + k]) - int(b[j])) * (pow(base, i - j, PRIME) if i > j else 1)
            if (left - right) % PRIME:
                return False
        return True

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Longest common extension: how many code points agree from i on and from j on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(i, other, j, middle) else (low, middle - 1)
        return low

    def backward(self, other: PrefixHashes, most: int) -> int:
        """Longest common suffix of at most ``most`` code points."""
        low, high = 0, most
        while low < high:
            middle = (low + high + 1) // 2
            equal = self.same(self.n - middle, other, other.n - middle, middle)
            low, high = (middle, high) if equal else (low, middle - 1)
        return low


def likeness(a: PrefixHashes, b: PrefixHashes) -> float:
    """Share of the longer text in the common prefix and suffix; two empty texts are alike."""
    longest = max(a.n, b.n)
    if not longest:
        return 1.0
    prefix = a.extension(0, b, 0)
    return (prefix + a.backward(b, min(a.n, b.n) - prefix)) / longest


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row (null text: empty). Row-local, no shuffle."""

    def run(frames):
        def rows():
            for doc_id, text in rows_of(frames):
                hashes = PrefixHashes.of(text)
                yield doc_id, hashes.n, hashes.fingerprint()

        yield from batches(rows(), pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())]))

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _part_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the descending ``bounds`` come after the first and are at or above ``doc_id``: its part.

    Binary search over an array literal, by steps of falling powers of two.
    """
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step < len(bounds)) & (F.try_element_at(array, at + step + 1) >= doc_id), at + step).otherwise(at),
    )


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Every row dealt to a part of its doc_id range, each part followed by the first row of the next part.

    Returns part, last (true for the row that only looks ahead), doc_id, text. Ids run down; the first row of
    all follows the last part. Only ids are read to find the bounds (one a part comes to the driver); texts
    are shuffled once. Null ids come last.
    """
    spark = docs.sparkSession
    parts = parts or 4 * shuffle_width(spark)
    key = F.coalesce("doc_id", F.lit(-(2**63) + 1)).alias("key")
    ids = docs.select(key).repartitionByRange(parts, F.desc("key"))
    tops = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("top")).select("top").distinct()
    bounds = sorted((r.top for r in tops.collect()), reverse=True) or [0]
    part = _part_of(F.col("key"), bounds)
    first = F.col("key").isin(bounds) if len(bounds) < 64 else F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("part") + 1) == F.col("key")
    located = docs.withColumn("key", key).withColumn("part", part)
    ahead = F.pmod(F.col("part") - 1, F.lit(len(bounds)))
    no, yes = F.lit(False).alias("last"), F.lit(True).alias("last")
    here = F.struct(F.col("part").alias("part"), no)
    both = F.array(here, F.struct(ahead.alias("part"), yes))
    dealt = located.withColumn("to", F.explode(F.when(first, both).otherwise(F.array(here))))
    return (
        dealt.select("to.part", "to.last", "doc_id", "text")
        .repartition(shuffle_width(spark), "part")
        .sortWithinPartitions("part", "last", F.desc_nulls_last("doc_id"), "text")
    )


_EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and to the next document.

    The edited text has its last third of code points replaced by as many first ones of the next document,
    by descending doc_id (rows with equal ids by text; null ids last; after the last row the first; a single
    row is its own next). Null text: empty. Repeated rows stay. A task holds two texts at a time.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(members):
            held = None
            for _, last, doc_id, text in members:
                if held is not None:
                    yield held, text
                if last:
                    return
                held = (doc_id, text)

        def rows():
            for _, members in groups_of(rows_of(frames)):
                known: tuple[str, PrefixHashes] | None = None
                for (doc_id, text), following in pairs(members):
                    own = known[1] if known and known[0] == text else PrefixHashes.of(text)
                    third = own.n // 3
                    edited_text = text[: own.n - third] + following[:third]
                    edited, ahead = PrefixHashes.of(edited_text), PrefixHashes.of(following)
                    known = (following, ahead)
                    digest = hashlib.sha256(edited_text.encode()).hexdigest()
                    yield doc_id, own.n, digest, own.fingerprint(), edited.fingerprint(), likeness(own, edited), likeness(own, ahead)

        yield from batches(rows(), _EDITED)

    return with_next(doc_texts(docs), parts).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
