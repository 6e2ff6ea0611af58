"""Byte-level BPE as a monoid: encode halves, join neighbours by re-encoding a growing window at the seam.

Two levels have the same shape. A text is split in halves down to leaves; each leaf is cut into pieces by the
pattern, and two halves are joined by cutting again from two pieces before the seam until a cut falls on one
of the right half. A piece is split in halves down to short byte strings that are merged directly; two token
lists are joined by merging again a window of tokens around the seam, doubled until what stands outside it
provably stays.

Why that is exact. Pieces: the pattern looks ahead only, so what follows a cut does not depend on what came
before it; and more text can change only pieces that touch the end, or an apostrophe with one letter after
it, so all but the last two pieces of a left half stay. Tokens: merges happen by (rank, place). The first
merge that crosses a border between two tokens depends on those two alone, so a list of tokens is the
encoding of its bytes exactly if every two neighbours are the encoding of theirs. A join therefore checks the
two borders of its window and nothing else.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from passagemill.llm.common import batches, doc_texts, rows_of

#: Bytes merged directly, code points cut at once, tokens decoded at once.
LEAF_BYTES, LEAF_CHARS, LEAF_IDS = 32, 1 << 15, 1 << 12
#: Entries of a worker's caches of pieces and borders; full pieces are set aside until the next ones are, full borders emptied.
CACHED = 120_000


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.vocabulary = {i: token for token, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.vocabulary}
        self.pattern = regex.compile(pattern)
        self.bytes = [ranks[bytes([c])] for c in range(256)]
        #: Both halves of every way to make a token of two tokens, packed into one number, with the token's rank.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._aside: dict[str, tuple[int, ...]] = {}
        self._borders: dict[tuple[int, int], bool] = {}

    # Tokens of one piece

    def merge(self, piece: bytes) -> list[int]:
        """Direct encoding: the pair of lowest rank first, the leftmost of equal ones. A token's id is its rank."""
        rank = self.pairs.get
        ids = [self.bytes[c] for c in piece]
        ranks = [rank(x << 32 | y, _NONE) for x, y in zip(ids, ids[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == _NONE:
                break
            at = ranks.index(lowest)
            ids[at] = lowest
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | lowest, _NONE)
            if at < len(ranks):
                ranks[at] = rank(lowest << 32 | ids[at + 1], _NONE)
        return ids

    def stands(self, left: int, right: int) -> bool:
        """Whether a border between these two tokens survives: together they encode to themselves."""
        known = self._borders.get((left, right))
        if known is None:
            known = self.merge(self.vocabulary[left] + self.vocabulary[right]) == [left, right]
            if len(self._borders) >= CACHED:
                self._borders.clear()
            self._borders[left, right] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            before, after = left[-width:], right[:width]
            middle = self.merge(self.decode_flat(before + after))
            outer_left, outer_right = left[: len(left) - len(before)], right[len(after) :]
            if (not outer_left or self.stands(outer_left[-1], middle[0])) and (not outer_right or self.stands(middle[-1], outer_right[0])):
                return outer_left + middle + outer_right
            width *= 2

    def encode_bytes(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.encode_bytes(piece[:half]), self.encode_bytes(piece[half:]))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else tuple(self.encode_bytes(raw))

    # Pieces of one text

    def pieces(self, text: str, start: int = 0, end: int | None = None) -> list[str]:
        end = len(text) if end is None else end
        if end - start <= LEAF_CHARS:
            return self.pattern.findall(text, start, end)
        middle = (start + end) // 2
        return self.join_pieces(text, middle, end, self.pieces(text, start, middle), self.pieces(text, middle, end))

    def join_pieces(self, text: str, seam: int, end: int, left: list[str], right: list[str]) -> list[str]:
        at = seam - sum(map(len, left[-2:]))
        joined = left[:-2]
        cut, used = seam, 0  # where the next piece of the right half begins
        while at != cut:
            found = self.pattern.match(text, at, end)
            joined.append(found[0])
            at = found.end()
            while cut < at:
                cut += len(right[used])
                used += 1
        joined.extend(right[used:])
        return joined

    # Texts

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self._pieces
        for piece in self.pieces(text):
            try:
                ids += known[piece]
            except KeyError:
                tokens = self._aside.get(piece) or self.encode_piece(piece)
                ids += tokens
                if len(piece) <= 64:
                    if len(known) >= CACHED:
                        self._aside, self._pieces = known, {}
                        known = self._pieces
                    known[piece] = tokens
        return ids

    def decode_flat(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree; an id that the vocabulary lacks is a KeyError."""
        if len(ids) <= LEAF_IDS:
            return self.decode_flat(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_NONE = 1 << 60


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """The vocabulary of a rank file (base64 token, rank), once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Bpe(ranks, pattern)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: every row, whole text; null or empty text: no ids. Row-local, no shuffle."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        yield from batches(((doc_id, bpe.encode(text)) for doc_id, text in rows_of(frames)), schema, 256)

    return doc_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded binary, of rows with ``ids``; null ids: empty."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])
        yield from batches(((doc_id, bpe.decode(ids or [])) for doc_id, ids in rows_of(frames)), schema, 256)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Digests of the ids and of the bytes they decode to, one row per input row, in one pass over the texts.

    Null or empty texts have no ids (digests of nothing); repeated rows stay; an empty table gives no rows.
    ``with_ids`` adds the ids themselves.
    """
    schema = pa.schema([*_DIGEST, ("ids", pa.list_(pa.int32()))]) if with_ids else _DIGEST

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)

        def rows():
            for doc_id, text in rows_of(frames):
                ids = bpe.encode(text)
                decimal = " ".join(map(bpe.decimal.__getitem__, ids))
                digests = hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()
                yield (doc_id, len(ids), *digests, np.array(ids, np.int32)) if with_ids else (doc_id, len(ids), *digests)

        yield from batches(rows(), schema, 256)

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
