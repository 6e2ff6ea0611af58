"""Importance resampling towards a target: documents drawn by how much their words look like the target's.

Features (runs of consecutive words) fall into a fixed number of buckets. A bucket's gain is the log of its
share in the target over its share in the corpus; gains are one array, broadcast, and a document's weight is
the sum of the gains of its features. Gumbel noise from the id turns the highest scores into a draw without
replacement in proportion to the weights.

The cutoff key is found without a sort of all documents. Every partition (blocks of it, so that a task's
memory is bounded) sends the median of its remaining keys and how many remain; the median of these medians,
weighted by the numbers, has at least a quarter of all remaining keys on either side. It is compared with all
of them, the side without the cutoff is discarded, and the other side's medians, made by the same pass, serve
the next round. Only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import batches, shuffle_width, stage

BUCKETS, LONGEST = 10_000, 1
#: The gains are an array in the driver and in every worker.
MAX_BUCKETS = 1 << 20
SEED, LEAST_WORDS, PERCENT = 2024, 20, 10
#: Keys whose median a task takes at once.
BLOCK = 1 << 20
#: So few remaining keys are sorted by the driver instead of by further rounds.
FEW = 10_000
#: Keys are written anew once so small a part of them remains.
_REWRITE = 8

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_WORDS_ONLY = bytes(ord(c.lower()) if c.isascii() and c.isupper() else ord(c) if ord(c) in _WORD else 0x20 for c in map(chr, range(256)))


def words_of(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A to Z in lower case, then runs of digits, letters a to z and all that is not ASCII."""
    return raw.translate(_WORDS_ONLY).split()


def buckets_of(words: list[bytes], buckets: int, longest: int) -> np.ndarray:
    """The bucket of every run of one to ``longest`` consecutive words."""
    sums: list[int] = list(map(crc32, words))
    for n in range(2, longest + 1):
        sums += [crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return np.array(sums, np.int64) % buckets


def counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks send one row for each bucket."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for frame in frames:
            for text in frame.column(0).cast(pa.binary()):
                total += np.bincount(buckets_of(words_of(text.as_py()), buckets, longest), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    got = texts.select(F.coalesce("text", F.lit(""))).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket, in doubles."""
    total, wanted, buckets = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = ((target + 1.0) * (total + buckets)) / ((corpus + 1.0) * (wanted + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the first 8 hex digits of the digest of the id; no id: of nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_KEYS = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "weight", "score", "n_words", "row")])


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """doc_id, n_features, weight, score, n_words, row (a number of its own) of every document, written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40

        def rows():
            row = first
            for frame in frames:
                for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1).cast(pa.binary())):
                    words = words_of(text.as_py())
                    own = buckets_of(words, len(shared.value), longest)
                    weight = int(shared.value[own].sum())
                    yield doc_id, len(own), weight, weight + noise(doc_id, seed), len(words), row
                    row += 1

        yield from batches(rows(), _KEYS)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return stage(texts.mapInArrow(run, "doc_id long, n_features long, weight long, score long, n_words long, row long"), "scored")


# Keys: score descending, doc_id ascending and null last, then n_features, then the row's number, so no two are equal.

Key = tuple[int, int, int, int, int]


def _key() -> list[Column]:
    return [(-F.col("score")).alias("k0"), F.col("doc_id").isNull().cast("long").alias("k1"), F.coalesce("doc_id", F.lit(0)).alias("k2"), F.col("n_features").alias("k3"), F.col("row").alias("k4")]


def before(keys: np.ndarray, key: Key) -> np.ndarray:
    """Which of ``keys`` (one column each) come before ``key``."""
    less, same = np.zeros(keys.shape[1], bool), np.ones(keys.shape[1], bool)
    for column, value in zip(keys, key):
        less |= same & (column < value)
        same &= column == value
    return less


def weighted_median(medians: list[tuple[int, Key]]) -> Key:
    """Of (number of keys, their median) the first median that with those before it stands for half of all keys."""
    total, passed = sum(n for n, _ in medians), 0
    for n, key in sorted(medians, key=lambda m: m[1]):
        passed += n
        if 2 * passed >= total:
            return key
    raise ValueError("no medians")


def _inside(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    """The keys strictly between two; scores alone decide what is read."""
    out = keys
    for bound, above in ((low, True), (high, False)):
        if bound is not None:
            order = F.struct(*_key())
            limit = F.struct(*[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(bound)])
            out = out.where((F.col("score") <= -bound[0]) & (order > limit) if above else (F.col("score") >= -bound[0]) & (order < limit))
    return out


def _sides(keys: DataFrame, pivot: Key | None) -> tuple[list[tuple[int, Key]], list[tuple[int, Key]]]:
    """Number and median of the keys before and after the pivot, for each block of each partition; no pivot: all are after it."""

    def summary(side: int, keys: np.ndarray) -> Iterator[tuple]:
        n = keys.shape[1]
        if n:
            middle = np.lexsort(keys[::-1])[(n - 1) // 2]
            yield side, n, *keys[:, middle].tolist()

    def blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for frame in frames:
            held.append(np.stack([c.to_numpy() for c in frame.columns]))
            size += frame.num_rows
            if size >= BLOCK:
                yield np.concatenate(held, axis=1)
                held, size = [], 0
        if held:
            yield np.concatenate(held, axis=1)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("side", pa.int64()), ("n", pa.int64()), *[(f"k{i}", pa.int64()) for i in range(5)]])

        def rows():
            for block in blocks(frames):
                if pivot is None:
                    yield from summary(1, block)
                    continue
                less = before(block, pivot)
                same = np.logical_and.reduce([c == v for c, v in zip(block, pivot)])
                yield from summary(0, block[:, less])
                yield from summary(1, block[:, ~less & ~same])

        yield from batches(rows(), schema)

    found = keys.select(*_key()).mapInArrow(run, "side long, n long, k0 long, k1 long, k2 long, k3 long, k4 long").collect()  # one or two rows a block
    return tuple([(r.n, tuple(r)[2:]) for r in found if r.side == side] for side in (0, 1))


def cutoff(keys: DataFrame, place: int, few: int = FEW) -> Key | None:
    """The key at ``place`` (from 1) in order, by rounds of weighted medians of medians; None if there are fewer keys or ``place`` is 0."""
    low = high = None
    written = None
    _, medians = _sides(keys, None)
    left = sum(n for n, _ in medians)
    if not 0 < place <= left:
        return None
    written = left
    while left > few:
        if left * _REWRITE < written:
            keys, written = stage(_inside(keys, low, high), "remaining"), left
        pivot = weighted_median(medians)
        less, more = _sides(_inside(keys, low, high), pivot)
        n_less = sum(n for n, _ in less)
        if place == n_less + 1:
            return pivot
        if place <= n_less:
            high, medians, left = pivot, less, n_less
        else:
            low, medians, left, place = pivot, more, sum(n for n, _ in more), place - n_less - 1
    rest = _inside(keys, low, high).select(*_key()).collect()  # at most ``few``
    return sorted(map(tuple, rest))[place - 1]


def ranked(keys: DataFrame, last: Key) -> DataFrame:
    """The keys up to ``last`` in order, with their rank: sorted by ranges, numbered in each range, ranges numbered by their counts."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for frame in frames:
            numbered = frame.append_column("part", pa.array(np.full(frame.num_rows, part, np.int32)))
            yield numbered.append_column("nth", pa.array(np.arange(at, at + frame.num_rows) + 1))
            at += frame.num_rows

    chosen = _inside(keys, None, (*last[:4], last[4] + 1))
    slim = chosen.select("doc_id", "n_features", "weight", "score", "row")
    in_order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row"))
    order = slim.repartitionByRange(shuffle_width(keys.sparkSession), *in_order).sortWithinPartitions(*in_order)
    numbered = stage(order.mapInArrow(run, "doc_id long, n_features long, weight long, score long, row long, part int, nth long"), "winners")
    sizes = {r.part: r.n for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a range
    base, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, base))
        base += sizes[part]
    bases = F.broadcast(keys.sparkSession.createDataFrame(rows, "part int, base long"))
    return numbered.join(bases, "part").select("doc_id", "n_features", "weight", "score", (F.col("base") + F.col("nth")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn), all long, one row per row of ``docs``.

    Whole texts of both tables count. Null texts have no words (weight 0); a null id takes the noise of the empty
    text and comes after all ids of its score. Of the documents with ``least_words`` words or more (N) the
    floor(``percent`` N / 100) highest scores are drawn, ties to the smaller id; repeated rows count and are
    drawn one by one. An empty target gives every bucket the same share; an empty table gives no rows.
    """
    if not 0 < buckets <= MAX_BUCKETS or longest < 1 or not 0 <= percent <= 100:
        raise ValueError(f"buckets must be from 1 to {MAX_BUCKETS}, longest at least 1, percent from 0 to 100")
    gain = gains(counts(docs, buckets, longest), counts(target, buckets, longest))
    keys = scored(docs, gain, longest, seed)
    able = F.col("n_words") >= least_words
    last = cutoff(keys.where(able), keys.where(able).count() * percent // 100)
    columns = ("doc_id", "n_features", "weight", "score")
    nobody = F.lit(None).cast("long").alias("rank")
    if last is None:
        return keys.select(*columns, nobody)
    rest = keys.where(~able).unionByName(_inside(keys.where(able), last, None))
    return ranked(keys.where(able), last).unionByName(rest.select(*columns, nobody))


#: The tables and formulas in SQL; crc32 is worked out from its polynomial for each distinct word.
SQL = r"""
WITH crc_table AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps
    FROM (SELECT unnest(range(256)) AS n)
),
cut AS (
    SELECT row_number() OVER () AS r, doc_id, true AS own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
    UNION ALL
    SELECT 0, NULL, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
uses AS (SELECT own, r, unnest(words) AS word FROM cut),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM uses)),
bucketed AS (
    SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM hexed, crc_table
),
sums AS (
    SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM uses JOIN bucketed USING (word) GROUP BY bucket
),
gain AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS g FROM sums
),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM uses JOIN bucketed USING (word) JOIN gain USING (bucket) WHERE own GROUP BY r),
scores AS (
    SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM cut LEFT JOIN weights USING (r) WHERE own
),
places AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM scores)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM scores WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM places
"""
