"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model is over the bytes of a text, none merged with another, so it takes any script and has no alphabet to
choose. Grams of ``ORDER`` symbols are counted in the tasks and summed by gram; continuation counts, counts of
counts (for the three discounts), context totals and back-off weights are joins and sums of these tables,
sharded by gram or context, and stay tables: nothing of the model passes through the driver or a broadcast.

Every gram of the corpus gets its probability by joins, order by order: a seen gram its own, others the
back-off weight of their context times the probability of their suffix. Documents are dealt into blocks of
bounded bytes; a block sends each of its distinct grams once, their probabilities come back by a join,
and the block's documents are summed from them. A document's perplexity is 10 ^ -(log10 probability / symbols),
the end counted as a symbol. A language's documents are kept between two quantiles of its trusted documents'
perplexities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import Scratch, doc_texts, rows_of, stage
from passagemill.llm.ctw import Lookup
from passagemill.session import small

#: Symbols are bytes; ``BOUNDARY`` stands before a text and is its end.
BITS, ORDER, BOUNDARY = 9, 5, 256
SYMBOLS = 257
LOW, HIGH = 0.0, 0.99
#: Fewer trusted documents of a language than this, and it takes the quantiles of all languages together.
ENOUGH = 30
#: Bytes of text that one task scores at a time.
BLOCK_BYTES = 16 << 20
#: So many trusted ids (8 bytes each) are broadcast; more are joined by a sort of both sides.
BROADCAST_IDS = 1_000_000
_GRID = 10_000
_PIECE = 1 << 20


def grams_of(text: bytes, order: int = ORDER) -> Iterator[np.ndarray]:
    """The grams that end at each byte and at the end of a text, in pieces of a bounded length."""
    n = len(text) + 1
    for low in range(0, n, _PIECE):
        high = min(n, low + _PIECE)
        symbols = np.full(high - low + order - 1, BOUNDARY, np.int64)
        first = max(0, low - order + 1)
        own = np.frombuffer(text, np.uint8, min(high, n - 1) - first, first) if n > 1 else np.empty(0, np.uint8)
        at = first - (low - order + 1)
        symbols[at : at + len(own)] = own
        grams = symbols[: high - low].copy()
        for k in range(1, order):
            grams <<= BITS
            grams |= symbols[k : k + high - low]
        yield grams


class Distinct:
    """Distinct grams of many arrays. A table that holds the last gram of each slot turns most repeats away before any sorting."""

    _MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 20)

    def __init__(self):
        self.last = np.full(1 << 20, -1, np.int64)
        self.found = np.empty(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, grams: np.ndarray) -> None:
        place = ((grams.view(np.uint64) * self._MIX) >> self._SHIFT).view(np.int64)
        new = np.flatnonzero(self.last[place] != grams)
        self.last[place[new]] = grams[new]
        self.held.append(grams[new])
        self.size += len(new)
        if self.size >= _PIECE:
            self.settle()

    def settle(self) -> np.ndarray:
        self.found, self.held, self.size = np.unique(np.concatenate([self.found, *self.held])), [], 0
        return self.found


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, c of the texts (text binary, trusted): how often each gram of the corpus occurs in trusted ones, 0 if only in others."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        other, size = Distinct(), 0

        def settle() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            unseen = np.setdiff1d(other.settle(), keys, assume_unique=True)
            other.found = np.empty(0, np.int64)
            held.clear()
            columns = [pa.array(np.concatenate([keys, unseen])), pa.array(np.concatenate([n, np.zeros(len(unseen), np.int64)]))]
            return pa.RecordBatch.from_arrays(columns, names=["gram", "c"])

        for text, trusted in rows_of(frames):
            for grams in grams_of(text, order):
                if trusted:
                    held.append(grams)
                    size += len(grams)
                else:
                    other.add(grams)
                if size >= 4 * _PIECE or len(other.found) >= 4 * _PIECE:
                    yield settle()
                    size = 0
        yield settle()

    return texts.select("text", "trusted").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts from how many grams occur once to four times; 0.5, 1, 1.5 where a count of counts is zero."""
    n = [0, *counts.agg(*[F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4)]).first()]
    if not all(n[1:]):
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    made = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k) for k, d in zip((1, 2, 3), made))


def _context(gram: str) -> Column:
    return F.shiftright(gram, BITS)


def _suffix(gram: str, k: int) -> Column:
    """The last ``k`` symbols of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * k) - 1))


@dataclass
class Level:
    """One order: the probabilities of its seen grams (gram, p) and the back-off weights of its seen contexts (context, weight)."""

    seen: DataFrame
    weights: DataFrame


def train(counts: DataFrame, scratch: Scratch, order: int = ORDER) -> list[Level]:
    """Modified Kneser-Ney, order one first, from the counts (gram, c > 0) of the highest order; lower orders count distinct left neighbours."""
    tables = [scratch.stage(counts, "grams")]
    for k in range(order - 1, 0, -1):
        tables.append(scratch.stage(tables[-1].groupBy(_suffix("gram", k).alias("gram")).agg(F.count("*").alias("c")), "grams"))
    levels: list[Level] = []
    for k, table in enumerate(reversed(tables)):
        d1, d2, d3 = discounts(table)
        cost = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        sums = table.groupBy(_context("gram").alias("context")).agg(F.sum("c").alias("total"), (F.sum(cost) / F.sum("c")).alias("weight"))
        contexts = scratch.stage(sums, "contexts")
        parts = table.withColumn("context", _context("gram")).join(contexts, "context")
        own = (F.col("c") - cost) / F.col("total")
        if not levels:
            seen = parts.select("gram", (own + F.col("weight") / SYMBOLS).alias("p"))
        else:
            below = levels[-1].seen.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            seen = parts.withColumn("suffix", _suffix("gram", k)).join(below, "suffix").select("gram", (own + F.col("weight") * F.col("below")).alias("p"))
        levels.append(Level(scratch.stage(seen, "probabilities"), contexts.select("context", "weight")))
    return levels


def probabilities(grams: DataFrame, levels: list[Level], scratch: Scratch) -> DataFrame:
    """gram, p of distinct grams of the highest order, seen or not: those not seen are looked up by their distinct suffixes."""
    if not levels:
        return grams.select("gram", F.lit(1 / SYMBOLS).alias("p"))
    known = scratch.stage(grams.select("gram").join(levels[-1].seen, "gram", "left"), "known")
    missing = known.where(F.col("p").isNull()).select("gram", _context("gram").alias("context"), _suffix("gram", len(levels) - 1).alias("suffix"))
    lower = probabilities(missing.select(F.col("suffix").alias("gram")).distinct(), levels[:-1], scratch)
    backed = missing.join(levels[-1].weights, "context", "left").join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
    return known.where(F.col("p").isNotNull()).unionByName(backed.select("gram", (F.coalesce("weight", F.lit(1.0)) * F.col("below")).alias("p")))


def zipped(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their last column, texts, each compressed by itself, beside its ``size`` in bytes."""
    codec = pa.Codec("zstd", compression_level=1)
    for frame in frames:
        for at in range(0, frame.num_rows, 256):
            *others, texts = frame.slice(at, 256).columns
            small = [codec.compress(text.as_buffer(), asbytes=True) for text in texts]
            yield pa.RecordBatch.from_arrays([*others, pc.binary_length(texts).cast(pa.int64()), pa.array(small, pa.binary())], names=[*frame.schema.names[:-1], "size", "text"])


def unzipped(rows: pa.Table) -> Iterator[bytes]:
    """The texts of such rows, one at a time."""
    codec = pa.Codec("zstd")
    for size, text in zip(rows.column("size"), rows.column("text")):
        yield codec.decompress(text.as_buffer(), decompressed_size=size.as_py(), asbytes=True) if size.as_py() else b""


_PACKED = "block int, grams binary, logs binary"
_RATED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("symbols", pa.int64()), ("log10_prob", pa.float64())])


def _pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams and log10 probabilities by block, many to a row."""
    for frame in frames:
        blocks, grams, logs = (column.to_numpy() for column in frame.columns)
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order], prepend=-1, append=-1))
        parts = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        columns = [pa.array([blocks[p[0]] for p in parts], pa.int32()), pa.array([grams[p].tobytes() for p in parts], pa.binary()), pa.array([logs[p].tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "grams", "logs"])


def perplexities(docs: DataFrame, known: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, symbols, log10_prob of every row; ``known`` (gram, p) holds every gram of ``docs``.

    Blocks are dealt by id and text, so only rows equal in both need share one. The texts are shuffled once:
    the exchange serves both the blocks' questions and their sums. They are compressed on the way, row by row, as
    the shuffle's files stay on disk to the end.
    """
    texts = doc_texts(docs, F.col("lang").cast("string").alias("lang")).withColumn("text", F.col("text").cast("binary"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // BLOCK_BYTES
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    small = texts.select(block, "doc_id", "lang", "text").mapInArrow(zipped, "block int, doc_id long, lang string, size long, text binary")
    dealt = small.repartition(blocks, "block")

    def ask(rows: pa.Table) -> pa.Table:
        seen = Distinct()
        for text in unzipped(rows):
            for grams in grams_of(text, order):
                seen.add(grams)
        distinct = seen.settle()
        return pa.table({"block": pa.array(np.full(len(distinct), rows.column("block")[0].as_py(), np.int32)), "gram": pa.array(distinct)})

    def add_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(g.as_py(), np.int64) for g in answers.column("grams"))])
        logs = np.concatenate([np.empty(0), *(np.frombuffer(g.as_py(), np.float64) for g in answers.column("logs"))])
        logs_of = Lookup(keys, logs)
        size, total = [], []
        for text in unzipped(rows):
            size.append(len(text) + 1)
            total.append(sum(float(logs_of[grams].sum()) for grams in grams_of(text, order)))
        return pa.Table.from_arrays([rows.column("doc_id"), rows.column("lang"), pa.array(size, pa.int64()), pa.array(total, pa.float64())], schema=_RATED)

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, gram long")
    answers = asked.join(known, "gram").select("block", "gram", F.log10("p").alias("log")).mapInArrow(_pack, _PACKED)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, "doc_id long, lang string, symbols long, log10_prob double")


def _limits(trusted: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Exact quantiles on a grid of perplexities: rows a language and grid cell, never rows a document."""
    cells = trusted.groupBy(*by, "cell").agg(F.count("*").alias("n"))
    through = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("through", F.sum("n").over(through)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    reached = lambda q: F.min(F.when(F.col("through") >= q * F.col("total"), F.col("cell")))
    return summed.groupBy(*by).agg(F.max("total").alias("total"), reached(low).alias("low"), reached(high).alias("high"))


def classify(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, enough: int = ENOUGH) -> DataFrame:
    """doc_id, lang, symbols, log10_prob, perplexity, its limits, whose limits they are and ``keep``, for every row.

    Trusted texts are the documents with a label of quality 1. A null text counts as empty (its end is its
    one symbol), a null language as a language of its own; repeated rows stay; ties with a limit are kept.
    A language with fewer than ``enough`` trusted documents has the quantiles of all (``limits_of``: language or all).
    With ``low`` 0 there is no lower limit. Without trusted documents the model is uniform and all are kept.
    """
    trusted_ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    few = trusted_ids.count() <= BROADCAST_IDS
    flags = trusted_ids.withColumn("trusted", F.lit(True)).hint("broadcast" if few else "merge")
    with Scratch(docs.sparkSession) as scratch:
        with Scratch(docs.sparkSession) as model:  # the model's tables are gone before the texts are shuffled
            texts = doc_texts(docs).join(flags, "doc_id", "left").select(F.col("text").cast("binary").alias("text"), F.coalesce("trusted", F.lit(False)).alias("trusted"))
            counts = model.stage(count_grams(texts), "counts")
            levels = train(counts.where(F.col("c") > 0), model)
            known = scratch.stage(probabilities(counts, levels, model), "known")
        rated = perplexities(docs, known).withColumn("cell", F.round(-F.col("log10_prob") / F.col("symbols") * _GRID).cast("long"))
        scored = stage(rated, "perplexities")
    trusted = stage(scored.join(trusted_ids.hint("broadcast" if few else "merge"), "doc_id", "left_semi").select("lang", "cell"), "trusted")
    pooled = _limits(trusted.withColumn("all", F.lit(1)), ["all"], low, high).first()
    by_lang = _limits(trusted, ["lang"], low, high).where(F.col("total") >= enough)
    own = by_lang.select(F.col("lang").alias("_lang"), F.col("low").alias("low_cell"), F.col("high").alias("high_cell"))
    joined = scored.join(small(own, own.count()), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = lambda c: F.coalesce(F.col(f"{c}_cell"), F.lit(pooled[c] if pooled else None).cast("long"))
    ten = lambda c: F.pow(F.lit(10.0), c / _GRID)
    least = ten(limit("low")) if low > 0 else F.lit(0.0)  # the lowest quantile is no bound
    within = F.col("cell").between(limit("low"), limit("high")) if low > 0 else F.col("cell") <= limit("high")
    keep = F.coalesce(within, F.lit(True))
    return joined.select(
        "doc_id", "lang", "symbols", "log10_prob", ten(F.col("cell")).alias("perplexity"),
        least.alias("low"), ten(limit("high")).alias("high"), F.when(F.col("high_cell").isNull(), "all").otherwise("language").alias("limits_of"), keep.alias("keep"),
    )
