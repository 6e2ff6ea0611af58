"""Best-fit packing of tokenized documents into sequences of bounded length, planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Only how many pieces have each length reaches the
driver (``capacity`` rows). There lengths are placed from the longest down, all pieces of a length at once:
of the open sequences those with the least room that still fits take as many as they hold, and only then are
new ones opened. Sequences that look alike are one group (a range of sequence numbers), so the plan's size
depends on the number of lengths and not on the number of documents. A planned slot says: the pieces of
length L with ranks from r on go, ``each`` to a sequence, into the sequences from s on, at offset o. A piece
finds its slot by its rank within its length.

Ranks need no window over a length, which may hold a third of all pieces: the task that makes pieces numbers
those of each length, and the counts by task and length, summed in task order, say where each task begins.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import grow, stage

CAPACITY = 2048
#: The id that closes every document.
CLOSE = 0
#: Longest sequence that can be asked for: the histogram and the plan are driver-side tables of its size.
MAX_CAPACITY = 1 << 16
#: Entries of a worker's caches of words and their parts.
CACHED = 400_000


#: Printable Latin-1: composed already, in lower case letter by letter.
_LATIN = regex.compile("[!-~\u00a1-\u00ff]+")
#: Byte-level vocabularies write a byte that is no printable Latin-1 as a letter from 256 on.
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not _LATIN.fullmatch(chr(b)) or b == 0xAD)}


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins what white space separates.

    Its rules drop white space before anything else is decided, so a text's ids are those of its words in
    turn, and a word that was seen before is looked up. Strings of special tokens are ordinary text. Words of
    printable Latin-1 are cut here, in lower case and by the file's pattern, and their parts go straight to the
    merges; other words take the library's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.merges = self.library.model
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        cuts = rules["pre_tokenizer"]["pretokenizers"]
        lower = any(n["type"] == "Lowercase" for n in rules["normalizer"]["normalizers"])
        if not lower or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"]:
            raise ValueError(f"{path}: not a lower-case tokenizer of words")
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
        self.known, self.parts = _Known(self._word), _Known(self._part)

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [token.id for token in self.merges.tokenize(letters)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if _LATIN.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, self.pattern.findall(text.lower())))
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers, one after the other."""
        return b"".join(map(self.known.__getitem__, text.split()))  # on bytes: ASCII white space


class _Known(dict):
    """What was worked out before; a full cache is set aside, and what it held is taken over when it comes again."""

    def __init__(self, work):
        self.work, self.aside = work, {}

    def __missing__(self, key):
        if len(self) >= CACHED:
            self.aside = dict(self)
            self.clear()
        made = self.aside.get(key)
        made = self[key] = self.work(key) if made is None else made
        return made


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    """The tokenizer of a file, once per worker."""
    return WordTokenizer(path)


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: Texts whose pieces are held at once.
_TEXTS = 64


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with the task that made each (``part``) and its place among that task's pieces of its length (``nth``).

    doc_id, piece int, start, length, ids_crc32 long (of the ids as little-endian unsigned 32-bit numbers),
    part int, nth long; ``with_ids`` adds ids array<int>. Only documents of more than ``capacity`` ids are cut.
    Written to the shared folder: part and nth must not change when a task runs again.
    """
    _check(capacity)
    schema = pa.schema([*_PIECE, ("ids", pa.list_(pa.int32()))]) if with_ids else _PIECE
    close, step = np.array([CLOSE], "<u4").tobytes(), 4 * capacity

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = load(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for frame in frames:
            for at in range(0, frame.num_rows, _TEXTS):
                some = frame.slice(at, _TEXTS)
                rows: list[tuple] = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary())):
                    ids = memoryview(tokenizer.encode(text.as_py()) + close)
                    for piece, start in enumerate(range(0, len(ids), step)):
                        own = ids[start : start + step]
                        length = len(own) // 4
                        row = (doc_id, piece, start // 4, length, zlib.crc32(own), part, int(seen[length]))
                        rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if with_ids else row)
                        seen[length] += 1
                if rows:
                    yield grow(list(zip(*rows)), schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return stage(texts.mapInArrow(run, _PIECE_DDL + ", ids array<int>" * with_ids), "pieces")


class Slots(NamedTuple):
    """Pieces of ``length`` with ranks from ``rank`` on go, ``each`` to a sequence, to the sequences from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    each: int
    sequence: int
    offset: int


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best fit over counts of lengths, the longest first; every rank of every length gets exactly one slot.

    A length takes whole groups of like sequences, but for the last, which it may split in three, so there
    are at most four groups for each length; a sequence holds at most about the root of 2 x ``capacity``
    different lengths, and each group is used at most as often. That bounds the plan whatever the counts are.
    """
    _check(capacity)
    rooms: list[int] = []  # the rooms that open groups have, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room: first sequence and number of sequences
    slots: list[Slots] = []
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room = capacity
                n = -(-left // (room // length))
                first, sequences = sequences, sequences + n
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append(Slots(length, rank, each, first, capacity - room))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than ``each``: one more sequence takes them
                slots.append(Slots(length, rank, left, first + full, capacity - room))
                leave(room - left * length, first + full, 1)
                left, full = 0, full + 1
            leave(room, first + full, n - full)
    return slots


def _check(capacity: int) -> None:
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MAX_CAPACITY}")


def _ranked(made: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The pieces with their rank within their length, and how many pieces each length has."""
    by_task = stage(made.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    return made.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")), histogram


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece int, start, length, ids_crc32, sequence_id, offset long, one row per piece; ``with_ids`` adds ids array<int>.

    A document's ids are those of its whole text (null or empty: none) and the closing id, so every row of
    ``docs`` has a piece; repeated rows and rows without an id are documents of their own. Sequences are
    numbered from 0 and filled from offset 0 without gaps; which of the pieces of one length takes which of
    its slots is not defined. An empty table gives no rows.
    """
    made, histogram = _ranked(pieces(docs, path, capacity, with_ids))
    table = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded, see plan

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, each, sequence, offset = shared.value.T
        keys = length << 44 | rank
        for frame in frames:
            own_length, own_rank = (frame.column(frame.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            slot = np.searchsorted(keys, own_length << 44 | own_rank, "right") - 1
            n = own_rank - rank[slot]
            kept = frame.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            kept = kept.append_column("sequence_id", pa.array(sequence[slot] + n // each[slot]))
            kept = kept.append_column("offset", pa.array(offset[slot] + n % each[slot] * own_length))
            yield kept.append_column("ids", frame.column(frame.schema.get_field_index("ids"))) if with_ids else kept

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *["ids"] * with_ids).mapInArrow(run, columns)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids array<int>, of rows with ids: each sequence's pieces by offset; a group holds one sequence's tokens at most."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"))
